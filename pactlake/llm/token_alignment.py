"""Alignment of two tokenizers' tokens over the same bytes.

Both token sequences of a text are cut where their cumulative ends meet, by a two-pointer merge in numpy inside mapInArrow;
the pieces between two cuts are groups, and every A and B token of one group are linked. Spark then counts in how many
documents each id pair is linked, and joins the counts and each A id's highest count back to the documents' pairs.

 - A document's distinct pairs and how often each occurs are written once (`align-texts`): nothing is encoded twice.
 - Word pairs follow Zipf's law, so a pair of two common words stands in nearly every document. The most frequent pairs, HOT
   at most however large the data, are broadcast with their counts; what is left meets the counts in a shuffle join, in which
   no pair is frequent. Counting needs no such care: partial sums leave one row a pair and task.
 - A group of very many tokens holds few distinct ids: its pairs are made of distinct ids with their numbers, and a document
   of more than SLICE such pairs gives them in several rows, by ranges of A ids.
"""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pactlake.llm.common import byte_slices, discard, materialize

#: Pairs that are broadcast with their counts: 20 bytes each.
HOT = 1 << 17
#: Pairs that are expanded at once, and white space from which the plain library encodes a text.
SLICE, LONG_SPACE = 1 << 21, 20_000
#: Bytes of a text that the piece model encodes at once.
STRETCH = 1 << 18


def byte_level() -> dict[str, int]:
    """Characters of byte-level vocabularies: printable bytes stand for themselves, the others follow from 256 on."""
    plain = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174]
    others = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(others)}


class Tokens:
    """Byte strings of a vocabulary's ids, laid end to end."""

    def __init__(self, entries: list[bytes]) -> None:
        self.entries = entries
        self.size = np.array([len(e) for e in entries], np.int64)

    def joined(self, ids: np.ndarray) -> bytes:
        return b"".join(map(self.entries.__getitem__, ids.tolist()))


class ByteLevel:
    """Ids of ` text` by a byte-level vocabulary file of the tokenizers library, special strings taken as plain text.

    The file's merges in order make tokens of ascending ids, which is checked: so ids are ranks, and the faster rank encoder
    gives the library's ids. It can't take very long stretches of white space; the library itself encodes texts with such.
    """

    def __init__(self, spec: bytes, pattern: str) -> None:
        import tiktoken
        from tokenizers import Tokenizer

        held, chars = json.loads(spec), byte_level()
        special = {t["content"] for t in held["added_tokens"]}
        vocab = held["model"]["vocab"]
        made = [vocab["".join(m if isinstance(m, list) else m.split(" "))] for m in held["model"]["merges"]]
        if any(a >= b for a, b in zip(made, made[1:], strict=False)):
            raise ValueError("the vocabulary's ids do not follow its merges")
        ranks = {bytes(chars[c] for c in t): i for t, i in vocab.items() if t not in special}
        entries = [b""] * (max(vocab.values()) + 1)
        for t, i in ranks.items():
            entries[i] = t
        self.tokens = Tokens(entries)
        self.fast = tiktoken.Encoding("byte-level", pat_str=pattern, mergeable_ranks=ranks, special_tokens={}).encode_ordinary
        self.slow = Tokenizer.from_str(spec.decode())
        self.slow.encode_special_tokens = True
        self.long = re.compile(r"\s{%d}" % LONG_SPACE).search

    def ids(self, text: str) -> np.ndarray:
        if len(text) >= LONG_SPACE and self.long(text):
            return np.array(self.slow.encode(" " + text, add_special_tokens=False).ids, np.int64)
        return np.array(self.fast(" " + text), np.int64)


class Pieces:
    """Ids of a text by a sentencepiece model, which puts a space before it."""

    def __init__(self, model: bytes) -> None:
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_proto=model)
        m = self.model
        names = [m.id_to_piece(i) for i in range(m.get_piece_size())]
        self.tokens = Tokens([bytes([int(p[3:5], 16)]) if m.is_byte(i) else p.replace("▁", " ").encode() for i, p in enumerate(names)])
        # No piece goes on past a space that follows another character, and spaces stay as they are: a long text may then
        # be cut before such spaces, as each stretch has the space that the model puts before it.
        probe = "a  b c "
        self.cuts = not any(re.search("[^▁]▁", p) for p in names) and self.tokens.joined(np.array(m.encode(probe))) == b" " + probe.encode()

    def ids(self, text: str) -> np.ndarray:
        if not self.cuts or len(text) <= STRETCH:
            return np.array(self.model.encode(text), np.int64)
        return np.concatenate([np.array(self.model.encode(x), np.int64) for x in stretches(text, STRETCH)])


def stretches(text: str, size: int) -> Iterator[str]:
    """`text` without the first space of each stretch after the first; stretches begin with a space after another character."""
    a = 0
    while a < len(text):
        at = text.find(" ", a + size)
        while at > 0 and (text[at - 1].isspace() or at + 1 >= len(text) or text[at + 1].isspace()):
            at = text.find(" ", at + 1)
        if at < 0:
            yield text[a:]
            return
        yield text[a:at]
        a = at + 1


def merged_ends(end_a: np.ndarray, end_b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places in both sequences of the ends that they share, by a merge of the two (each ascending)."""
    at = np.searchsorted(end_b, end_a)
    shared = np.flatnonzero(end_b[np.minimum(at, len(end_b) - 1)] == end_a) if len(end_b) else np.zeros(0, np.int64)
    return shared, at[shared]


def group_text(a: np.ndarray, b: np.ndarray, last_a: np.ndarray, last_b: np.ndarray) -> bytes:
    """`a1,a2|b1;a3|b2,b3`: the ids of each group; last_a, last_b are the places of the groups' last tokens."""
    size_a, size_b = np.diff(last_a, prepend=-1), np.diff(last_b, prepend=-1)
    before_b, before_a = np.cumsum(size_b) - size_b, np.cumsum(size_a)
    ids = np.empty(len(a) + len(b), np.int64)
    mark = np.full(len(ids), 0x2C, np.uint8)
    at_a, at_b = np.arange(len(a)) + np.repeat(before_b, size_a), np.arange(len(b)) + np.repeat(before_a, size_b)
    ids[at_a], ids[at_b] = a, b
    mark[at_a[last_a]], mark[at_b[last_b]] = 0x7C, 0x3B
    digits = 1 + (ids >= 10) + (ids >= 100) + (ids >= 1000) + (ids >= 10_000) + (ids >= 100_000) + (ids >= 1_000_000)
    width = int(digits.max()) + 1
    out = np.empty((len(ids), width), np.uint8)
    for k in range(width - 1):  # from the right
        out[:, width - 2 - k] = 48 + ids // 10**k % 10
    out[:, -1] = mark
    return out[np.arange(width) >= (width - 1 - digits)[:, None]].tobytes()[:-1]


def _outer(code_a, n_a, code_b, n_b):
    """Pairs of each group's A and B entries; n_a, n_b: entries of each group."""
    per_a = np.repeat(n_b, n_a)
    i = np.repeat(np.arange(len(code_a)), per_a)
    start = np.repeat(np.cumsum(n_b) - n_b, n_a)
    j = np.arange(len(i)) - np.repeat(np.cumsum(per_a) - per_a, per_a) + np.repeat(start, per_a)
    return i, j


def _distinct(group: np.ndarray, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    code, n = np.unique(group << 32 | ids, return_counts=True)
    return code >> 32, code & 0xFFFFFFFF, n


def link_pairs(a: np.ndarray, b: np.ndarray, last_a: np.ndarray, last_b: np.ndarray, limit: int = SLICE) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(pairs A id << 32 | B id, ascending; how many links each stands for) of one text, by ranges of A ids; no pair comes twice."""
    size_a, size_b = np.diff(last_a, prepend=-1), np.diff(last_b, prepend=-1)
    if int((size_a * size_b).sum()) <= limit:
        i, j = _outer(a, size_a, b, size_b)
        yield np.unique(a[i] << 32 | b[j], return_counts=True)
        return
    groups = np.arange(len(last_a))
    (ga, a, na), (gb, b, nb) = _distinct(np.repeat(groups, size_a), a), _distinct(np.repeat(groups, size_b), b)
    size_a, size_b = np.bincount(ga, minlength=len(groups)), np.bincount(gb, minlength=len(groups))
    start_b = np.cumsum(size_b) - size_b
    order = np.argsort(a, kind="stable")
    a, ga, na = a[order], ga[order], na[order]
    todo = np.cumsum(size_b[ga])
    at = 0
    while at < len(a):
        to = int(np.searchsorted(todo, (todo[at - 1] if at else 0) + limit, "right"))
        to = int(np.searchsorted(a, a[min(max(to, at + 1), len(a)) - 1], "right"))  # whole A ids
        x = slice(at, to)
        per = size_b[ga[x]]
        i = np.repeat(np.arange(at, to), per)
        j = np.arange(len(i)) - np.repeat(np.cumsum(per) - per, per) + np.repeat(start_b[ga[x]], per)
        code, back = np.unique(a[i] << 32 | b[j], return_inverse=True)
        links = np.zeros(len(code), np.int64)
        np.add.at(links, back, na[i] * nb[j])
        yield code, links
        at = to


SCHEMA = "row long, doc_id {id}, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, pairs array<long>, links array<long>"


def _align_rows(spec, model, pattern: str):
    """(id, text) -> rows of SCHEMA; a text's further rows have nulls but for row, pairs and links."""

    def run(batches):
        import pyarrow as pa
        from pyspark import TaskContext

        left, right = _encoders(spec.value, model.value, pattern)
        row = TaskContext.get().partitionId() << 33
        schema = None
        for batch in batches:
            id_type = batch.schema.field(0).type
            schema = pa.schema([("row", pa.int64()), ("doc_id", id_type), *((c, pa.int64()) for c in ("n_a", "n_b", "n_groups", "n_links")), ("groups_sha256", pa.string()), ("pairs", pa.list_(pa.int64())), ("links", pa.list_(pa.int64()))])
            for part in byte_slices(batch, 1, 512, 1 << 21):
                rows = []
                for doc, text in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), strict=True):
                    stats, pairs = align(text, left, right)
                    first = (doc, *stats)
                    for code, links in pairs:
                        rows.append((row, *first, code, links))
                        first = (None,) * 6
                        if len(code) > SLICE // 8:
                            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)
                            rows = []
                    if first[1] is not None:
                        rows.append((row, *first, [], []))
                    row += 1
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)

    return run


def align(text: str | None, left: ByteLevel, right: Pieces):
    """((n_a, n_b, n_groups, n_links, groups_sha256), pairs as of link_pairs) of one text."""
    none = (0, 0, 0, 0, ""), ()
    if not text:
        return none
    whole = b" " + text.encode()
    a = left.ids(text)
    if left.tokens.joined(a) != whole:
        return none
    b = right.ids(text)
    if right.tokens.joined(b) != whole:
        return none
    last_a, last_b = merged_ends(np.cumsum(left.tokens.size[a]), np.cumsum(right.tokens.size[b]))
    n_links = int((np.diff(last_a, prepend=-1) * np.diff(last_b, prepend=-1)).sum())
    return (len(a), len(b), len(last_a), n_links, hashlib.sha256(group_text(a, b, last_a, last_b)).hexdigest()), link_pairs(a, b, last_a, last_b)


_held: dict[tuple, tuple] = {}


def _encoders(spec: bytes, model: bytes, pattern: str) -> tuple[ByteLevel, Pieces]:
    """The worker's encoders; they stay for later tasks."""
    key = hashlib.sha256(spec).digest(), hashlib.sha256(model).digest(), pattern
    if key not in _held:
        _held.clear()
        _held[key] = ByteLevel(spec, pattern), Pieces(model)
    return _held[key]


def _octave():
    """Eighths of an octave of a count."""
    return F.floor(F.log2("count") * 8)


def _hot_from(counts: DataFrame, hot: int) -> int:
    """The lowest eighth of an octave from which on there are at most `hot` pairs: a few hundred rows at most come to the driver."""
    sizes = dict(counts.groupBy(_octave().alias("at")).agg(F.count("*").alias("n")).collect())
    total, at = 0, max(sizes, default=0) + 1
    while at > 0 and total + sizes.get(at - 1, 0) <= hot:
        at -= 1
        total += sizes.get(at, 0)
    return at


def align_tokens(docs: DataFrame, spec_path: str, model_path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text", hot: int = HOT) -> DataFrame:
    """id_col, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256 of every row of `docs`.

    Null and empty texts, and texts that one of the tokenizers does not give back byte for byte after a space, have no
    tokens: zeros, and '' for groups_sha256. Every row is a document of its own, so repeated rows count as often as they
    stand; null ids stay null. Very long texts are aligned whole. Other columns are not read; an empty table gives an empty
    result. The two vocabulary files (fixed, a few MB) are read on the driver and travel once to each worker.
    """
    spark = docs.sparkSession
    shared = []
    for path in (spec_path, model_path):
        with open(path, "rb") as f:
            shared.append(spark.sparkContext.broadcast(f.read()))
    id_type = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    texts, _ = materialize(rows.mapInArrow(_align_rows(*shared, pattern), SCHEMA.format(id=id_type)), "align-texts")
    # In how many documents each pair is linked, and whether that is the highest count of its A id.
    pair_rows = texts.select(F.explode("pairs").alias("pair")).groupBy("pair").agg(F.count("*").alias("count"))
    counts, p_counts = materialize(pair_rows, "align-pairs")
    top = counts.groupBy(F.shiftright("pair", 32).alias("a")).agg(F.max("count").alias("most"))
    judged = counts.withColumn("a", F.shiftright("pair", 32)).join(top, "a").select("pair", "count", (F.col("count") == F.col("most")).cast("long").alias("best"))
    judged, p_judged = materialize(judged, "align-counts")
    discard(spark, p_counts)
    held = texts.select("row", F.explode(F.arrays_zip("pairs", "links")).alias("x")).select("row", F.col("x.pairs").alias("pair"), F.col("x.links").alias("links"))
    sums = [F.sum(F.col("links") * F.col("best")).alias("n_best"), F.sum(F.col("links") * F.col("count")).alias("count_sum")]
    small = F.broadcast(judged.filter(_octave() >= _hot_from(judged, hot)))  # `hot` rows at most
    common = held.join(small, "pair").groupBy("row").agg(*sums)
    rest = held.join(small, "pair", "left_anti").join(judged, "pair").groupBy("row").agg(*sums)
    total = common.unionByName(rest).groupBy("row").agg(F.sum("n_best").alias("n_best"), F.sum("count_sum").alias("count_sum"))
    out = texts.filter("n_a IS NOT NULL").select("row", "doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256").join(total, "row", "left")
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("long").alias(c)
    return out.select(F.col("doc_id").alias(id_col), "n_a", "n_b", "n_groups", "n_links", zero("n_best"), zero("count_sum"), "groups_sha256")
