"""URL filters: pattern rules indexed by their rarest literal token.

Every match of a rule holds certain literal tokens (runs of ASCII letters and digits that its pattern bounds on both sides).
One pass counts in how many URLs each of them stands; a rule is filed under its rarest one. A URL's tokens then fetch the
rules filed under them, and only those run their regular expression. Rules without such a token run on every URL.

URLs meet the rules where they are read: there is no shuffle, and no URL meets a rule that shares no token with it. A slice of
rules of at most SLICE_BYTES travels to the tasks at once; more rules are applied slice after slice within one stage.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from re import _constants as C
from re import _parser

from pactlake.llm.common import fresh

#: Characters of rule patterns that travel to the tasks at once.
SLICE_BYTES = 8 << 20
FLAGS = re.ASCII | re.DOTALL
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
TOKEN = re.compile("[a-z0-9]+")
#: Everything up to the first `://`, and it.
SCHEME = r"^(?:(?!://).)*://"


@dataclass(frozen=True)
class Rule:
    """`pattern` (Python's syntax, ASCII classes, `.` for any character) is searched in the URL with its host in lower case.

    Of the rules that match those of rank 1 (host rules) come before those of rank 0 (patterns), then the longest name
    wins, then the first in order of name.
    """

    verdict: str
    name: str
    pattern: str
    rank: int = 0


def host_rule(verdict: str, host: str, path: str) -> Rule:
    """URLs of `host` and its subdomains whose path starts with `path`; such rules come before pattern rules."""
    return Rule(verdict, host.translate(str.maketrans(UPPER, LOWER)) + path, SCHEME + r"(?:[^/?#]*\.)?" + re.escape(host.translate(str.maketrans(UPPER, LOWER))) + "(?=[/?#]|$)" + _path_pattern(path), 1)


def _path_pattern(path: str) -> str:
    # A path with `?` or `#` can't be the beginning of any path.
    return re.escape(path) if not set(path) & set("?#") else r"(?!)"


def pattern_rule(verdict: str, pattern: str) -> Rule:
    return Rule(verdict, pattern, pattern)


def _word(c: int) -> bool:
    return c < 128 and chr(c).isalnum()


def _edge(node: tuple, left: bool) -> tuple[bool, bool]:
    """(whether the node's first or last character is never part of a token, whether the node may be empty)."""
    op, arg = node
    if op is C.LITERAL:
        return not _word(arg), False
    if op is C.IN:
        return all(kind is C.LITERAL and not _word(x) or kind is C.RANGE and not any(map(_word, range(x[0], min(x[1], 127) + 1))) or kind is C.CATEGORY and x in (C.CATEGORY_SPACE, C.CATEGORY_NOT_WORD) for kind, x in arg), False
    if op is C.SUBPATTERN:
        return _edges(arg[3], left)
    if op in (C.MAX_REPEAT, C.MIN_REPEAT, C.POSSESSIVE_REPEAT):
        fine, empty = _edges(arg[2], left)
        return fine, empty or arg[0] == 0
    if op is C.BRANCH:
        found = [_edges(x, left) for x in arg[1]]
        return all(f for f, _ in found), any(e for _, e in found)
    if op in (C.AT, C.ASSERT, C.ASSERT_NOT):
        return True, True
    return False, op is not C.ANY and op is not C.NOT_LITERAL


def _edges(nodes: Iterable, left: bool) -> tuple[bool, bool]:
    fine = True
    for node in list(nodes) if left else reversed(list(nodes)):
        f, empty = _edge(node, left)
        fine &= f
        if not empty:
            return fine, False
    return fine, True


def _bounded(nodes: list, step: int, at: int) -> bool:
    """Whether no token character can stand beside the literals that end before (step 1) or start after (step -1) `at`."""
    while 0 <= at < len(nodes):
        op, arg = nodes[at]
        if op is C.AT and arg in (C.AT_BEGINNING, C.AT_BEGINNING_STRING, C.AT_END, C.AT_END_STRING, C.AT_BOUNDARY):
            return True
        fine, empty = _edge(nodes[at], step > 0)
        if not fine:
            return False
        if not empty:
            return True
        at += step
    return False  # the search may begin or end anywhere


def sure_tokens(pattern: str) -> list[str]:
    """The tokens that every string matching the pattern holds, in lower case."""
    nodes, flat = list(_parser.parse(pattern, FLAGS)), []

    def unfold(items) -> None:
        for op, arg in items:
            if op is C.SUBPATTERN and not arg[1] and not arg[2]:
                unfold(arg[3])
            else:
                flat.append((op, arg))

    unfold(nodes)
    out, i = set(), 0
    while i < len(flat):
        j = i
        while j < len(flat) and flat[j][0] is C.LITERAL and _word(flat[j][1]):
            j += 1
        if j > i and _bounded(flat, -1, i - 1) and _bounded(flat, 1, j):
            out.add("".join(chr(arg) for _, arg in flat[i:j]).lower())
        i = max(j, i + 1)
    return sorted(out)


class Index:
    """Rules by their rarest token; `best` is the winning rule of a URL."""

    def __init__(self, rules: Iterable[Rule], counts: dict[str, int]) -> None:
        self.filed: dict[str, list] = {}
        self.always: list = []
        for rule in rules:
            tokens = sure_tokens(rule.pattern)
            entry = (order_of(rule), rule, re.compile(rule.pattern, FLAGS).search)
            if tokens:
                self.filed.setdefault(min(tokens, key=lambda t: (counts.get(t, 0), t)), []).append(entry)
            else:
                self.always.append(entry)

    def candidates(self, url: str) -> Iterator[tuple]:
        yield from self.always
        for t in set(TOKEN.findall(url.translate(_LOWER))):
            yield from self.filed.get(t, ())

    def best(self, url: str, held: tuple | None = None) -> tuple | None:
        """(order, rule) of the winner; `held` is that of rules seen before."""
        for order, rule, search in self.candidates(url):
            if (held is None or order > held[0]) and search(url):
                held = order, rule
        return held


_LOWER = str.maketrans(UPPER, LOWER)


def order_of(rule: Rule) -> tuple:
    """Larger wins; of names of one length the first."""
    return rule.rank, len(rule.name), [-ord(c) for c in rule.name]


def slices(rules: list[Rule], limit: int) -> list[list[Rule]]:
    out, size = [], limit
    for rule in rules:
        n = len(rule.pattern) + len(rule.name)
        if size + n > limit:
            out.append([])
            size = 0
        out[-1].append(rule)
        size += n
    return out or [[]]


def parts(url: Column) -> tuple[Column, Column]:
    """Host (A-Z in lower case) and path of a URL; both empty without `://`."""
    part = lambda i: F.coalesce(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)([^?#]*)", i), F.lit(""))
    return F.translate(part(1), UPPER, LOWER), part(2)


def token_counts(pages: DataFrame, tokens: list[str], url_col: str) -> dict[str, int]:
    """In how many URLs each of the tokens stands: one row for each token of the rules comes to the driver."""
    if not tokens:
        return {}
    found = pages.select(F.explode(F.array_distinct(F.regexp_extract_all(F.translate(F.col(url_col), UPPER, LOWER), F.lit("([a-z0-9]+)"), F.lit(1)))).alias("token"))
    wanted = pages.sparkSession.createDataFrame([(t,) for t in tokens], "token string")
    if sum(map(len, tokens)) <= SLICE_BYTES:
        wanted = F.broadcast(wanted)
    return {r["token"]: r["n"] for r in found.join(wanted, "token", "left_semi").groupBy("token").agg(F.count("*").alias("n")).collect()}


def filter_urls(pages: DataFrame, rules: Iterable[Rule], default: str = "allow", url_col: str = "url", slice_bytes: int = SLICE_BYTES) -> DataFrame:
    """`pages` with host, path, rule, verdict and pattern (new names get underscores in front where `pages` has such columns).

    `rule` is the name of the winning host rule, else null; `pattern` the name of the winning pattern rule, else null;
    `verdict` the winner's, else `default`. Null URLs and those without `://` have an empty host and path, match no host
    rule and are searched by patterns as they stand (null: empty). Each row is judged by itself: repeated rows, null ids,
    very long URLs and further columns, whatever their names, pass unchanged, and an empty table gives an empty result.
    Rules with equal text and rank but different verdicts raise ValueError.
    """
    rules = sorted(set(rules), key=lambda r: (r.rank, r.name))
    for a, b in zip(rules, rules[1:], strict=False):
        if (a.rank, a.name) == (b.rank, b.name):
            raise ValueError(f"two rules named {a.name!r}")
    counts = token_counts(pages, sorted({t for r in rules for t in sure_tokens(r.pattern)}), url_col)
    host, path, rule, pattern, verdict = names = fresh(pages, "host", "path", "rule", "pattern", "verdict")
    h, p = parts(F.col(url_col))
    none = F.lit(None).cast("string")
    out = pages.withColumns(dict(zip(names, (h, p, none, none, none), strict=True)))

    def judge(chosen: list[Rule]):
        """Batches with the winner so far in the last three columns."""

        def run(batches):
            import pyarrow as pa

            index = Index(chosen, counts)
            for batch in batches:
                at = batch.schema.names
                columns = [batch.column(at.index(n)).to_pylist() for n in (url_col, host, rule, pattern, verdict)]
                rows = []
                for url, name, *held in zip(*columns, strict=True):
                    before = None
                    if held[2] is not None:
                        old = Rule(held[2], held[1] if held[0] is None else held[0], "", 0 if held[0] is None else 1)
                        before = order_of(old), old
                    best = index.best(with_host(url or "", name), before)
                    won = best and best[1]
                    rows.append((None, None, None) if won is None else (won.name, None, won.verdict) if won.rank else (None, won.name, won.verdict))
                made = [pa.array(c, pa.string()) for c in zip(*rows, strict=True)] if rows else [pa.array([], pa.string())] * 3
                yield pa.RecordBatch.from_arrays([*batch.columns[:-3], *made], schema=batch.schema)

        return run

    for chosen in slices(rules, slice_bytes):
        out = out.mapInArrow(judge(chosen), out.schema)
    return out.withColumn(verdict, F.coalesce(verdict, F.lit(default)))


def with_host(url: str, host: str) -> str:
    """The URL with its host in lower case."""
    at = url.find("://")
    return url if at < 0 else url[: at + 3] + host + url[at + 3 + len(host) :]
