"""Calling source code as tables of facts: calls with arguments, object literals, declarations, member reads, types.

One pushdown scan of a file cuts it into tokens, each of which knows the bracket around it: strings, templates with their
interpolations, regular expressions and comments are told apart, so text in them is never code. What the tokens say is
returned as rows of one flat table; which call meets which change, which variable holds what and which type a field belongs
to is left to joins (`pactlake.operators.call_sites`). Places are offsets in characters.
"""

from __future__ import annotations

import re
from bisect import bisect_right

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pactlake.functions.urls import HOLE

SPOT = "text: string, at: int, end_at: int, line: int"
ARGUMENTS = f"array<struct<{SPOT}, url: string, literal: string, object: int>>"
MEMBERS = f"array<struct<name: string, label: string, at: int, end_at: int, line: int, short: boolean, value: struct<{SPOT}, url: string, literal: string, object: int>>>"
FIELDS = "array<struct<name: string, at: int, end_at: int, line: int>>"
#: kind, then what that kind has; `id` and `ref` are offsets that stand for a declaration, an object, a function or a type.
SCHEMA = f"""repo string, file string, kind string, at int, end_at int, line int, name string, text string, id int, ref int, type string, cast string,
scope int, scope_end int, depth int, arguments {ARGUMENTS}, members {MEMBERS}, fields {FIELDS}"""
COLUMNS = [c.split()[0] for c in "at,end_at,line,name,text,id,ref,type,cast,scope,scope_end,depth,arguments,members,fields".split(",")]

TOKEN = re.compile(
    r"""(?P<skip>\s+|//[^\n]*|/\*.*?(?:\*/|\Z))|(?P<s>'(?:[^'\\\n]|\\.)*'|"(?:[^"\\\n]|\\.)*")|(?P<d>\d[\w.]*)|(?P<n>(?:[^\W\d]|\$)[\w$]*)|(?P<p>=>|\?\.(?!\d)|\.\.\.|&&|\|\||\?\?|[=!]==?|[<>]=|.)""",
    re.DOTALL,
)
CHUNK = re.compile(r"(?:[^`\\$]|\\.|\$(?!\{))*", re.DOTALL)
REGEX = re.compile(r"/(?![/*])(?:[^/\\\[\n]|\\.|\[(?:[^\]\\\n]|\\.)*\])+/\w*")
ESCAPED = re.compile(r"\\(.)", re.DOTALL)
CLOSERS = {")": "(", "]": "[", "}": "{"}
#: Words after which an expression begins, and words that a parenthesis follows without a call.
BEFORE = {"return", "typeof", "case", "in", "of", "await", "yield", "void", "delete", "else", "do", "new", "throw", "default", "extends"}
NO_CALL = {"if", "for", "while", "switch", "catch", "function", "with", "return", "typeof", "await", "void", "in", "of", "new", "throw", "case", "yield", "super", "import"}
#: Tokens that make a larger expression of the one before them.
GOES_ON = {".", "?.", "(", "[", "?", "+", "-", "*", "/", "%", "&&", "||", "??", "==", "===", "!=", "!==", "<", ">", "<=", ">=", "in", "instanceof", "&", "|", "^"}
#: Facts that leave a Python worker at a time; those of one file stay together.
FACTS = 2048
OBJECT_AFTER = {"(", ",", "=", ":", "[", "?", "&&", "||", "??", "...", "return", "default", "yield"}


class Scan:
    """Tokens of one file: kind (s string, t template, d number, n name, r pattern, p punctuation), place, enclosing token."""

    def __init__(self, text: str) -> None:
        self.source = text
        self.kind, self.a, self.b, self.up, self.nth, self.close = [], [], [], [], [], {}
        self.url: dict[int, str] = {}
        self.lines = [m.end() for m in re.finditer("\n", text)]
        self._read()
        self.n = len(self.kind)

    def word(self, i: int) -> str:
        return self.source[self.a[i] : self.b[i]] if 0 <= i < self.n else ""

    def line(self, offset: int) -> int:
        return bisect_right(self.lines, offset) + 1

    def _add(self, kind: str, a: int, b: int, stack: list) -> int:
        self.kind.append(kind)
        self.a.append(a)
        self.b.append(b)
        self.up.append(stack[-1][1] if stack else -1)
        self.nth.append(stack[-1][2] if stack else 0)
        return len(self.kind) - 1

    def _operand(self) -> bool:
        """Whether the last token ends an expression, so that a slash divides."""
        if not self.kind:
            return False
        last = self.source[self.a[-1] : self.b[-1]]
        return last in (")", "]", "}") or self.kind[-1] in "stdr" or self.kind[-1] == "n" and last not in BEFORE

    def _read(self) -> None:
        text, at, stack = self.source, 0, []  # stack: [opener, token, commas so far]
        while at < len(text):
            c = text[at]
            if c == "`":
                stack.append(["`", self._add("t", at, at + 1, stack), 0])
                at = self._template(at + 1, stack, "")
                continue
            if c == "/" and not self._operand() and (m := REGEX.match(text, at)):
                self._add("r", at, m.end(), stack)
                at = m.end()
                continue
            m = TOKEN.match(text, at)
            at = m.end()
            if m.lastgroup == "skip":
                continue
            i = self._add(m.lastgroup, m.start(), at, stack)
            if m.lastgroup == "s":
                self.url[i] = ESCAPED.sub(r"\1", text[m.start() + 1 : at - 1])
            elif c in "([{":
                stack.append([c, i, 0])
            elif c == "," and stack:
                stack[-1][2] += 1
            elif c in ")]}" and stack:
                if c == "}" and stack[-1][0] == "${":
                    self._drop()
                    stack.pop()
                    at = self._template(at, stack, self.url[stack[-1][1]] + HOLE)
                elif any(o[0] == CLOSERS[c] for o in stack):
                    while stack[-1][0] != CLOSERS[c]:
                        self._shut(stack.pop(), i)
                    self._shut(stack.pop(), i)
                    self.up[i], self.nth[i] = (stack[-1][1], stack[-1][2]) if stack else (-1, 0)
        while stack:
            self._shut(stack.pop(), len(self.kind))

    def _drop(self) -> None:
        for x in (self.kind, self.a, self.b, self.up, self.nth):
            x.pop()

    def _shut(self, opened: list, i: int) -> None:
        if opened[0] in "([{":
            self.close[opened[1]] = i

    def _template(self, at: int, stack: list, before: str) -> int:
        """Read on from `at` in the template on top of the stack, to its end or next interpolation."""
        m, i = CHUNK.match(self.source, at), stack[-1][1]
        self.url[i] = before + ESCAPED.sub(r"\1", m[0])
        at = m.end()
        if self.source.startswith("${", at):
            stack.append(["${", i, 0])
            return at + 2
        stack.pop()
        self.b[i] = at = min(at + 1, len(self.source))
        return at

    # ---- expressions ----

    def last(self, i: int) -> int:
        """The token that ends what token i opens; i itself if it opens nothing."""
        return min(self.close.get(i, i), self.n - 1)

    def spot(self, i: int, j: int) -> tuple:
        return self.source[self.a[i] : self.b[j]], self.a[i], self.b[j], self.line(self.a[i])

    def top(self, i: int, j: int) -> list[int]:
        """Tokens of i..j that no bracket within them holds; of a bracket its opener."""
        out = []
        while i <= j:
            out.append(i)
            if self.kind[i] == "t":  # its interpolations follow
                k = i + 1
                while k <= j and self.a[k] < self.b[i]:
                    k += 1
                i = k
            else:
                i = self.last(i) + 1
        return out

    def object_at(self, i: int, j: int) -> int | None:
        """The brace of an object literal that is all of i..j, bare or inside JSON.stringify(...)."""
        if self.word(i) == "JSON" and self.word(i + 1) == "." and self.word(i + 2) == "stringify" and self.word(i + 3) == "(" and self.last(i + 3) == j:
            first = [k for k in self.top(i + 4, j - 1) if self.nth[k] == 0 and self.word(k) != ","]
            return first[0] if len(first) == 1 and self.word(first[0]) == "{" else None
        return i if self.word(i) == "{" and self.last(i) == j else None

    def shape(self, i: int, j: int) -> str | None:
        """The text of a string, a template or a sum of them, HOLE for what is computed; null for anything else."""
        top = self.top(i, j)
        if len(top) == 1:
            return self.url.get(i)
        if any(self.word(k) in ("?", ":", "=", "&&", "||", "??", "=>", ",", "<", ">", "==", "===", "!=", "!==", "<=", ">=", "|", "&", "^", "in", "instanceof") for k in top):
            return None
        parts: list[list[int]] = [[]]
        for k in top:
            if self.word(k) == "+" and parts[-1]:
                parts.append([])
            else:
                parts[-1].append(k)
        if len(parts) == 1 or not parts[-1]:
            return None
        return "".join(self.url.get(p[0], HOLE) if len(p) == 1 else HOLE for p in parts)

    def value(self, i: int, j: int) -> tuple:
        plain = self.url[i] if i == j and i in self.url and HOLE not in self.url[i] else None
        if self.kind[i] == "t" and self.top(i, j) == [i]:
            plain = self.url[i] if HOLE not in self.url[i] else None
            j = i
        at = self.object_at(i, j)
        return (*self.spot(i, j), self.shape(i, j), plain, None if at is None else self.a[at])

    def parts(self, i: int) -> list[tuple[int, int]]:
        """Token ranges between the commas of bracket i."""
        out: dict[int, list[int]] = {}
        for k in self.top(i + 1, self.last(i) - 1 if i in self.close and self.close[i] < self.n else self.n - 1):
            if self.word(k) != ",":
                out.setdefault(self.nth[k], []).append(k)
        return [(x[0], self._end(x[-1])) for x in out.values()]

    def _end(self, i: int) -> int:
        if self.kind[i] == "t":
            while i + 1 < self.n and self.a[i + 1] < self.b[self.up[i + 1]] and self.kind[self.up[i + 1]] == "t":
                i += 1
            return i
        return self.last(i)

    def type_at(self, i: int) -> tuple[str | None, int]:
        """(plain name of the type that starts at token i, Promise unwrapped; the token after it)."""
        if self.kind[i : i + 1] != ["n"]:
            return None, i
        name, j = self.word(i), i + 1
        if self.word(j) == "<":
            depth, first = 0, j + 1
            while j < self.n:
                depth += {"<": 1, ">": -1}.get(self.word(j), 0)
                j += 1
                if not depth:
                    break
            name = self.type_at(first)[0] if name == "Promise" and self.type_at(first)[1] == j - 1 else None
        if self.word(j) in ("[", "|", "&", "."):
            return None, j
        return name, j

    def outward(self, i: int, j: int) -> tuple[int, int, str | None]:
        """Past await, casts, parentheses and `!` around i..j: (first, last token, type of the outermost cast)."""
        cast = None
        while True:
            before, after = self.word(i - 1), self.word(j + 1)
            if before == "await":
                i -= 1
            elif after == "!":
                j += 1
            elif after == "as":
                name, k = self.type_at(j + 2)
                cast, j = name or cast, max(k - 1, j + 2)
            elif before == "(" and self.close.get(i - 1) == j + 1 and not (self.word(i - 2) in (")", "]") or self.kind[i - 2 : i - 1] == ["n"] and self.word(i - 2) not in BEFORE):
                i, j = i - 1, j + 1
            else:
                return i, j, cast

    def chain(self, j: int) -> int:
        """The first token of the member chain that ends at token j."""
        while True:
            if self.word(j) in (")", "]"):
                opened = self.up_of(j)
                if opened is None:
                    return j
                j = opened
                if self.kind[j - 1 : j] == ["n"] and self.word(j - 1) not in NO_CALL or self.word(j - 1) in (")", "]"):
                    j -= 1
                    continue
            if j >= 2 and self.word(j - 1) in (".", "?."):
                j -= 2
                continue
            return j

    def up_of(self, j: int) -> int | None:
        """The opener of the closing token j."""
        if not hasattr(self, "_opened"):
            self._opened = {b: a for a, b in self.close.items()}
        return self._opened.get(j)


def facts_of(text: str) -> list[dict]:
    """The facts of one file."""
    s = Scan(text)
    out: list[dict] = []
    functions, bodies = {}, {}  # parameter bracket -> fact; body brace -> function

    def scope(i: int) -> tuple[int, int]:
        """Offsets of the block around token i."""
        j = s.up[i]
        while j >= 0 and not (s.kind[j] == "p" and s.word(j) == "{" and j not in objects):
            j = s.up[j]
        return (s.a[j], s.b[s.last(j)]) if j >= 0 else (-1, len(text) + 1)

    braces = [i for i in range(s.n) if s.kind[i] == "p" and s.word(i) == "{"]
    objects = {i for i in braces if s.word(i - 1) in OBJECT_AFTER}
    decl_of: dict[int, dict] = {}  # first token of an initialiser -> declaration

    def declare(name: int, **more) -> dict:
        out.append({"kind": "declare", "id": s.a[name], "name": s.word(name), **more})
        return out[-1]

    # Functions: parameters with types, return types, bodies.
    for i in range(s.n):
        if s.kind[i] != "p" or s.word(i) != "(" or s.close.get(i, s.n) >= s.n:
            continue
        before, end = s.word(i - 1), s.close[i]
        j, returns = end + 1, None
        if s.word(j) == ":":
            returns, j = s.type_at(j + 1)
            while j < s.n and s.word(j) not in ("{", "=>", ";", ")", ",") and s.up[j] == s.up[i]:
                j += 1
        arrow = s.word(j) == "=>"
        named = s.kind[i - 1 : i] == ["n"] and (before not in NO_CALL or before == "function") or before == ">"
        if not arrow and not (s.word(j) == "{" and named):
            continue
        k = i - 1
        if before == ">":
            while k > 0 and s.word(k) != "<":
                k -= 1
            k -= 1
        if arrow:
            while s.word(k) == "async":
                k -= 1
            name = s.word(k - 1) if s.word(k) == "=" and s.kind[k - 1 : k] == ["n"] else s.word(k - 1) if s.word(k) == ":" and s.kind[k - 1 : k] == ["n"] else None
            j += 1
        else:
            name = s.word(k) if s.word(k) != "function" else None
        if s.word(j) == "{":
            span = s.a[j], s.b[s.last(j)]
            bodies[j] = returns
        else:  # an expression: up to the next comma, semicolon or closing bracket around it
            k = j
            while k < s.n and not (s.up[k] == s.up[i] and s.word(k) in (";", ",", ")", "]", "}")) and s.up[k] >= s.up[i]:
                k += 1
            span = (s.a[j] if j < s.n else len(text)), (s.a[k] if k < s.n else len(text))
        functions[i] = True
        out.append({"kind": "function", "name": name, "type": returns, "id": s.a[i], "scope": span[0], "scope_end": span[1], "text": "arrow" if arrow else None})
        decl_of[("body", j)] = returns
        for a, b in s.parts(i):
            while s.word(a) in ("public", "private", "protected", "readonly", "..."):
                a += 1
            if s.kind[a] == "n":
                at = a + 1 + (s.word(a + 1) == "?")
                declare(a, type=s.type_at(at + 1)[0] if s.word(at) == ":" and at < b else None, scope=s.a[i], scope_end=span[1])

    # Variables.
    for i in range(s.n - 1):
        if s.kind[i] != "n" or s.word(i) not in ("const", "let", "var") or s.word(i - 1) == ".":
            continue
        n, (low, high) = i + 1, scope(i)
        j, kind = s.last(n) + 1, None
        if s.word(j) in (":", "!"):
            kind = s.type_at(j + 1)[0] or "?"  # stated, but no plain name
            while j < s.n and s.word(j) not in ("=", ";") and s.up[j] == s.up[i]:
                j = s.last(j) + 1
        made = s.word(j) == "="
        if s.kind[n] == "n":
            d = declare(n, type=kind, scope=low, scope_end=high)
            if made:
                decl_of[j + 1] = d
                k = j + 1
                if s.kind[k : k + 1] == ["n"] and s.word(k + 1) in (";", "", "as") or s.kind[k : k + 1] == ["n"] and k + 1 < s.n and s.line(s.a[k + 1]) > s.line(s.a[k]) and s.word(k + 1) not in (".", "?.", "("):
                    d |= {"text": s.word(k), "ref": s.a[k]}  # another variable
                    if s.word(k + 1) == "as":
                        d["type"] = d["type"] or s.type_at(k + 2)[0]
        elif s.word(n) == "{" and made:
            whole = {"id": s.a[n]}
            decl_of[j + 1] = whole
            for a, b in s.parts(n):
                if s.word(a) == "data" and (a == b or s.word(a + 1) == ":" and a + 2 == b and s.kind[b] == "n"):
                    declare(b, scope=low, scope_end=high)["id"] = s.a[n]
                    out[-1]["cast"] = "data"

    # Types.
    for i in range(s.n - 2):
        if s.kind[i] != "n" or s.word(i) not in ("interface", "type") or s.kind[i + 1] != "n":
            continue
        j = i + 2
        while j < s.n and s.word(j) not in ("{", ";", "=", "(", "}"):
            j += 1
        if s.word(i) == "type":
            if s.word(j) != "=" or s.word(j + 1) != "{":
                continue
            j += 1
        if s.word(j) != "{":
            continue
        objects.discard(j)
        fields = []
        for k in s.top(j + 1, s.last(j) - 1):
            after = k + 1 + (s.word(k + 1) == "?")
            p = k - 1 - (s.word(k - 1) == "readonly")
            fresh = p == j or s.word(p) in (";", ",", "}") or s.line(s.a[k]) > s.line(s.a[p])
            if s.kind[k] in "ns" and s.word(after) == ":" and fresh:
                fields.append((s.url.get(k, s.word(k)), s.a[k], s.b[k], s.line(s.a[k])))
        out.append({"kind": "type", "name": s.word(i + 1), "id": s.a[j], "fields": fields})

    # Object literals.
    for i in sorted(objects):
        members = []
        for a, b in s.parts(i):
            if s.kind[a] in "ns" and (a == b or s.word(a + 1) == ":" and a + 1 < b):
                short = a == b
                if short and s.kind[a] != "n":
                    continue
                members.append((s.url.get(a, s.word(a)), s.word(a), s.a[a], s.b[a], s.line(s.a[a]), short, s.value(a, a) if short else s.value(a + 2, b)))
        if members:
            out.append({"kind": "object", "id": s.a[i], "members": members})

    # Calls.
    for i in range(1, s.n):
        if s.kind[i] != "p" or s.word(i) != "(" or i in functions:
            continue
        j, typed = i - 1, None
        if s.word(j) == ">":
            k = j
            while k > 0 and j - k < 40 and s.word(k) != "<":
                k -= 1
            if s.word(k) == "<" and s.kind[k - 1 : k] == ["n"]:
                typed, j = s.type_at(k + 1)[0], k - 1
        if s.word(j) == "?.":
            j -= 1
        if s.kind[j] != "n" or s.word(j) in NO_CALL and s.word(j - 1) not in (".", "?."):
            continue
        first, end = s.chain(j), s.last(i)
        before, after, cast = s.outward(first, end)
        whole = s.word(after + 1) not in GOES_ON
        held = decl_of.get(before) if whole and s.word(before - 1) == "=" else None
        # What the call is returned from: the nearest function's body, or an arrow without one.
        returned = None
        if whole and s.word(before - 1) == "return":
            k = s.up[i]
            while k >= 0 and k not in bodies:
                k = s.up[k]
            returned = bodies.get(k)
        elif whole and s.word(before - 1) == "=>":
            returned = decl_of.get(("body", before))
        line, name = s.line(s.a[first]), re.sub(r"\s+", "", text[s.a[first] : s.b[j]])
        fact = {"kind": "call", "at": s.a[first], "end_at": s.b[j], "line": line, "name": name, "text": s.word(j), "id": s.a[i], "type": typed, "cast": cast, "scope_end": None}
        if isinstance(held, dict):
            fact["ref"] = held["id"]
            held["call"] = fact
        else:
            fact["ref"] = None
            fact["returned"] = returned
        fact["arguments"] = [s.value(a, b) for a, b in s.parts(i)]
        out.append(fact)
    # A declaration knows the function that makes its value, a cast of it, and its type argument.
    for d in out:
        call = d.pop("call", None)
        if call:
            d["type"] = d.get("type") or call["cast"] or call["type"]
            d["text"] = d.get("text") or None
            d["name_of_call"] = call["text"]
    # Member reads `x.name` and `x.data.name`.
    for i in range(s.n - 2):
        if s.kind[i] == "n" and s.word(i + 1) in (".", "?.") and s.kind[i + 2] == "n" and s.word(i - 1) not in (".", "?."):
            j, depth = i + 2, 1
            while True:
                out.append({"kind": "member", "at": s.a[j], "end_at": s.b[j], "line": s.line(s.a[j]), "name": s.word(j), "text": s.word(i), "ref": s.a[i], "depth": depth})
                if depth == 2 or s.word(j) != "data" or s.word(j + 1) not in (".", "?.") or s.kind[j + 2 : j + 3] != ["n"]:
                    break
                j, depth = j + 2, 2
    return out


def syntax(files: DataFrame) -> DataFrame:
    """Facts of files (repo, file, content), one row each, as of SCHEMA. A null or empty content has none.

    kind `call`: callee at..end_at (name, last part text), id (its parenthesis), arguments, ref (the declaration that receives
    it, awaited, cast or in parentheses), type (its type argument), cast (what it is cast to), scope_type in `type` of
    `returned`. `object`: id (its brace), members. `declare`: id, name, type, scope..scope_end, text and ref where its value is
    another variable, cast = data where it is taken from a pattern. `maker`: id of a declaration and text, the function called
    for its value. `returned`: id of a call and type, the return type of the function that returns it. `function`: name, type.
    `type`: name, id, fields. `member`: name at..end_at read from the variable text at ref, depth 2 for `x.data.name`.
    """

    def run(batches):
        for batch in batches:
            schema, rows = _arrow_schema(batch), []
            for repo, file, content in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                for f in facts_of(content) if content else []:
                    own = {"repo": repo, "file": file}
                    if made := f.pop("name_of_call", None):
                        rows.append(own | {"kind": "maker", "id": f["id"], "text": made})
                    if back := f.pop("returned", None):
                        rows.append(own | {"kind": "returned", "id": f["id"], "type": back})
                    rows.append(own | f)
                if len(rows) >= FACTS:
                    yield _facts_batch(rows, schema)
                    rows = []
            if rows:
                yield _facts_batch(rows, schema)

    return files.select(F.col("repo").cast("string").alias("repo"), F.col("file").cast("string").alias("file"), "content").mapInArrow(run, SCHEMA)


def _facts_batch(rows: list[dict], schema):
    """Facts of one or more files as a record batch."""
    import pyarrow as pa

    columns = []
    for f in schema:
        values = [r.get(f.name) for r in rows]
        if pa.types.is_list(f.type):
            values = [None if v is None else [_struct(x, f.type.value_type) for x in v] for v in values]
        columns.append(pa.array(values, f.type))
    return pa.RecordBatch.from_arrays(columns, schema=schema)


def _struct(values: tuple, kind) -> dict:
    import pyarrow as pa

    return {f.name: _struct(v, f.type) if pa.types.is_struct(f.type) and v is not None else v for f, v in zip(kind, values, strict=True)}


def _arrow_schema(batch):
    import pyarrow as pa

    spot = [("text", pa.string()), ("at", pa.int32()), ("end_at", pa.int32()), ("line", pa.int32())]
    value = pa.struct([*spot, ("url", pa.string()), ("literal", pa.string()), ("object", pa.int32())])
    member = pa.struct([("name", pa.string()), ("label", pa.string()), ("at", pa.int32()), ("end_at", pa.int32()), ("line", pa.int32()), ("short", pa.bool_()), ("value", value)])
    field = pa.struct([("name", pa.string()), ("at", pa.int32()), ("end_at", pa.int32()), ("line", pa.int32())])
    text = {"name", "text", "type", "cast"}
    nested = {"arguments": pa.list_(value), "members": pa.list_(member), "fields": pa.list_(field)}
    kinds = [(c, nested.get(c) or (pa.string() if c in text else pa.int32())) for c in COLUMNS]
    return pa.schema([("repo", pa.string()), ("file", pa.string()), ("kind", pa.string()), *kinds])
