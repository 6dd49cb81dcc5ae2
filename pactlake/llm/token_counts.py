"""Exact token counts at every prefix by dynamic programming, for byte-level BPE files of the `tokenizers` library.

For prefix i of a pre-token exactly one vocabulary token t ending at i is compatible with the last token p of
the prefix before it: the pair (p, t) must survive BPE on its own bytes. So `count[i] = count[i - len(t)] + 1`
holds the token count of every prefix, and truncation or budget questions read the table without encoding again.
"""

from __future__ import annotations

import hashlib
import json

import numpy as np
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pactlake.llm.common import byte_slices
from pactlake.llm.pretokens import TextValues

#: Checked token pairs that a worker remembers; beyond it the memory starts anew.
CACHE = 300_000


def byte_alphabet() -> dict[str, int]:
    """The printable stand-in of each byte in byte-level vocabulary files."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    other = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(other)}


class PrefixCounter:
    """Prefix tables of one byte-level BPE vocabulary."""

    def __init__(self, spec: dict, pattern: str) -> None:
        model, alphabet = spec["model"], byte_alphabet()
        odd = [k for k in ("normalizer", "truncation", "padding") if spec.get(k)]
        if model["type"] != "BPE" or odd or model.get("ignore_merges") or spec["pre_tokenizer"]["type"] != "ByteLevel" or spec["pre_tokenizer"]["add_prefix_space"]:
            raise ValueError("only plain byte-level BPE files without prefix space are supported")
        raw = lambda s: bytes(map(alphabet.__getitem__, s))
        self.ids = {raw(t): i for t, i in model["vocab"].items() if all(c in alphabet for c in t)}
        self.bytes = {i: t for t, i in self.ids.items()}
        self.pairs: dict[tuple[int, int], tuple[int, int]] = {}
        for rank, m in enumerate(model["merges"]):
            a, b = map(raw, m.split(" ") if isinstance(m, str) else m)
            self.pairs[self.ids[a], self.ids[b]] = rank, self.ids[a + b]
        self.suffixes = dict.fromkeys((t[i:] for t in self.ids for i in range(len(t))), -1) | self.ids  # -1: the end of tokens, but no token
        specials = sorted((t["content"] for t in spec.get("added_tokens", [])), key=len, reverse=True)
        if any(t["lstrip"] or t["rstrip"] or t["single_word"] for t in spec.get("added_tokens", [])):
            raise ValueError("added tokens that strip or need whole words are not supported")
        self.special = regex.compile("|".join(map(regex.escape, specials))) if specials else None
        self.split = regex.compile(pattern).findall
        self.fits: dict[tuple[int, int], bool] = {}
        self.values = TextValues(pattern, lambda piece: self.prefixes(piece.encode())[-1], sum)

    def plain(self, data: bytes) -> list[int]:
        """BPE of a few bytes by its definition; used on pairs of tokens only."""
        ids = [self.ids[data[i : i + 1]] for i in range(len(data))]
        get = self.pairs.get
        while True:
            best, at, left = None, -1, -1
            for i, right in enumerate(ids):
                found = get((left, right))
                if found is not None and (best is None or found < best):
                    best, at = found, i
                left = right
            if best is None:
                return ids
            ids[at - 1 : at + 1] = [best[1]]

    def fit(self, last: int, token: int) -> bool:
        """Whether `token` may follow `last`; last -1: whether it may stand first."""
        key = last, token
        ok = self.fits.get(key)
        if ok is None:
            if len(self.fits) >= CACHE:
                self.fits.clear()
            ok = self.fits[key] = self.plain((self.bytes[last] if last >= 0 else b"") + self.bytes[token]) == ([last, token] if last >= 0 else [token])
        return ok

    def prefixes(self, piece: bytes) -> list[int]:
        """Token count of piece[:i] for each i from 0 to its length."""
        n = len(piece)
        count, last = [0] * (n + 1), [-1] * (n + 1)
        suffix, fits, fit = self.suffixes.get, self.fits.get, self.fit
        for i in range(1, n + 1):
            found, a = [], i - 1
            while a >= 0:
                token = suffix(piece[a:i])
                if token is None:
                    break
                if token >= 0:
                    found.append((a, token))
                a -= 1
            for a, token in reversed(found):
                if (ok := fits((last[a], token))) or ok is None and fit(last[a], token):
                    count[i], last[i] = count[a] + 1, token
                    break
            else:
                raise ValueError("a byte without a token")
        return count

    def parts(self, text: str):
        """Texts between special strings; None stands for a special string."""
        if not self.special:
            yield text, 0
            return
        at = 0
        for m in self.special.finditer(text):
            yield text[at : m.start()], 0
            yield None, len(m[0].encode())
            at = m.end()
        yield text[at:], 0

    def count(self, text: str) -> int:
        n = 0
        for part, _ in self.parts(text):
            n += 1 if part is None else self.values.of(part)
        return n

    def prefix_table(self, text: str) -> np.ndarray:
        """Token count of every byte prefix, pre-tokens split as in the whole text; a special string counts at its end."""
        out, base = [np.zeros(1, np.int32)], 0
        for part, width in self.parts(text):
            if part is None:
                t = np.full(width, base, np.int32)
                t[-1] += 1
                out.append(t)
            else:
                for piece in self.split(part):
                    out.append(np.array(self.prefixes(piece.encode())[1:], np.int32) + base)
                    base = int(out[-1][-1])
                continue
            base = int(out[-1][-1])
        return np.concatenate(out)

    def cut(self, text: str, budget: int) -> int:
        """Bytes of the longest prefix with at most `budget` tokens that ends between characters and not within a special string."""
        base = at = 0
        for part, width in self.parts(text):
            for piece in [None] if part is None else self.split(part):
                n = 1 if piece is None else self.values.pieces[piece]
                if base + n > budget:
                    if piece is None:
                        return at
                    data = piece.encode()
                    table = self.prefixes(data)
                    fits = [i for i in range(len(data)) if base + table[i] <= budget and data[i] & 0xC0 != 0x80]
                    return at + fits[-1]
                base += n
                at += width if piece is None else len(piece.encode())
        return at


_counters: dict[tuple[bytes, str], PrefixCounter] = {}


def counter_of(data: bytes, pattern: str) -> PrefixCounter:
    """The worker's counter of this file; it stays for later tasks, with what it remembers."""
    key = hashlib.sha256(data).digest(), pattern
    if key not in _counters:
        _counters.clear()
        _counters[key] = PrefixCounter(json.loads(data), pattern)
    return _counters[key]


def token_counts(docs: DataFrame, tokenizer_path: str, pattern: str, limit: int = 1024, id_col: str = "doc_id", text_col: str = "text", with_prefixes: bool = False) -> DataFrame:
    """Token counts of whole texts, whether they pass `limit`, and where a cut at `limit` tokens falls.

    Returns id_col, n_bytes, n_tokens, over_limit, cut_bytes and, with `with_prefixes`, prefix_tokens array<int>
    (the count at each byte prefix). A null text counts as empty: 0 bytes, 0 tokens. A null id stays null;
    repeated rows give repeated rows; very long texts are counted whole; other columns are not read; an empty table gives an
    empty result.
    """
    with open(tokenizer_path, "rb") as f:
        shared = docs.sparkSession.sparkContext.broadcast(f.read())
    id_type = docs.schema[id_col].dataType.simpleString()
    schema = f"`{id_col}` {id_type}, n_bytes long, n_tokens long, over_limit boolean, cut_bytes long" + ", prefix_tokens array<int>" * with_prefixes

    def run(batches):
        import pyarrow as pa

        counter = counter_of(shared.value, pattern)
        for batch in batches:
            for part in byte_slices(batch, 1):
                texts = [t or "" for t in part.column(1).to_pylist()]
                n = [counter.count(t) for t in texts]
                size = [len(t.encode()) for t in texts]
                cut = [counter.cut(t, limit) if k > limit else s for t, k, s in zip(texts, n, size, strict=True)]
                columns = [part.column(0), pa.array(size, pa.int64()), pa.array(n, pa.int64()), pa.array([k > limit for k in n]), pa.array(cut, pa.int64())]
                if with_prefixes:
                    columns.append(pa.array([counter.prefix_table(t) for t in texts], pa.list_(pa.int32())))
                yield pa.RecordBatch.from_arrays(columns, names=[id_col, "n_bytes", "n_tokens", "over_limit", "cut_bytes", "prefix_tokens"][: len(columns)])

    return docs.select(F.col(id_col), F.col(text_col)).mapInArrow(run, schema)
