"""Byte-level BPE encoding and decoding with a hierarchical-bitmap rank queue.

A pre-token is a doubly linked list of byte runs. Every mergeable pair waits in the bucket of its
merge rank; a two-level bitmap over the ranks gives the lowest non-empty bucket by find-first-set.
A popped position whose pair has changed since it was queued is stale and is skipped. One merge costs
a bitmap step and two pushes, so a pre-token of any length takes time in proportion to that length.
"""

from __future__ import annotations

import base64
import hashlib
from heapq import heappop, heappush
from itertools import pairwise

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pactlake.llm.common import byte_slices, give_back, no_cycles
from pactlake.llm.pretokens import ENTRIES, TextValues

#: Texts whose words are encoded together; their bytes are bounded too.
SLICE_ROWS = 2048
#: Ranks in one word of the bitmap's lower level; the upper level has a bit for each such word.
WORD = 8
#: Bytes of the longest pre-token that is counted in a table of equally long ones, and bytes of one table.
SHORT, TABLE = 32, 1 << 19
#: What stands for the rank of a pair that makes no token.
NEVER = np.iinfo(np.int32).max


def merge(piece: bytes, ranks: dict[bytes, int]) -> list[int]:
    """Ids of one pre-token: the lowest-ranked adjacent pair merges first, the leftmost of equal ones.

    The queue is written out in the loop, as most pre-tokens are short and calls would cost more than it:
    `buckets` holds positions by rank, `leaf` the bitmap words of non-empty buckets, `top` those words.
    """
    get = ranks.get
    whole = get(piece)
    if whole is not None:
        return [whole]
    n, low = len(piece), (1 << WORD) - 1
    nxt, prv = list(range(1, n + 2)), list(range(-1, n))
    want: list[int | None] = [None] * (n + 1)  # the rank of the pair that starts here
    buckets: dict[int, list[int]] = {}
    leaf: dict[int, int] = {}
    top = 0
    for i in range(n - 1):
        r = get(piece[i : i + 2])
        if r is not None:
            want[i] = r
            if r in buckets:
                buckets[r].append(i)
            else:
                buckets[r] = [i]
                w = r >> WORD
                leaf[w] = leaf.get(w, 0) | 1 << (r & low)
                top |= 1 << w
    while top:
        w = (top & -top).bit_length() - 1
        bits = leaf[w]
        r = w << WORD | (bits & -bits).bit_length() - 1
        bucket = buckets[r]
        i = heappop(bucket)
        if not bucket:
            del buckets[r]
            leaf[w] = bits = bits & (bits - 1)
            if not bits:
                top &= top - 1
        if want[i] != r:
            continue  # stale
        j = nxt[i]
        k = nxt[j]
        nxt[i] = k
        prv[k] = i
        want[j] = None
        p = prv[i]
        for at, s in ((i, get(piece[i : nxt[k]]) if k < n else None), (p, get(piece[p:k]) if p >= 0 else None)):
            if at < 0:
                continue
            want[at] = s
            if s is not None:
                if s in buckets:
                    heappush(buckets[s], at)
                else:
                    buckets[s] = [at]
                    w = s >> WORD
                    leaf[w] = leaf.get(w, 0) | 1 << (s & low)
                    top |= 1 << w
    out, i = [], 0
    while i < n:
        out.append(ranks[piece[i : nxt[i]]])
        i = nxt[i]
    return out


class Merger:
    """The same queue for many short pre-tokens at once: they lie end to end in one linked list, and a bucket gives the
    leftmost position of each of them. So one step of the bitmap serves all pre-tokens whose lowest rank it is."""

    def __init__(self, ranks: dict[bytes, int]) -> None:
        self.ranks = ranks
        self.byte = np.array([ranks[bytes([b])] for b in range(256)], np.int64)
        self.bits = max(ranks.values()).bit_length()
        get = ranks.get
        split = [(a << self.bits | b, r) for t, r in ranks.items() for i in range(1, len(t)) if (a := get(t[:i])) is not None and (b := get(t[i:])) is not None]
        split.sort()
        self.codes, self.values = np.array([c for c, _ in split] + [1 << 62], np.int64), np.array([r for _, r in split] + [-1], np.int64)
        both = self.rank(np.repeat(self.byte, 256), np.tile(self.byte, 256))
        self.of_bytes = np.where(both < 0, NEVER, both).astype(np.int32)

    def rank(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """The rank of the token that two tokens make; -1: none."""
        code = a << self.bits | b
        at = np.searchsorted(self.codes, code)
        return np.where(self.codes[at] == code, self.values[at], -1)

    def merge(self, pieces: list[bytes]) -> list[bytes]:
        """Ids of each pre-token, as little-endian unsigned 32-bit numbers."""
        token, owner = self._merged(pieces)
        data = token.astype("<u4").tobytes()
        at = [0, *(4 * np.cumsum(np.bincount(owner, minlength=len(pieces)))).tolist()]
        return [data[a:b] for a, b in pairwise(at)]

    def count(self, pieces: list[bytes]) -> list[int]:
        """Tokens of each pre-token. Short ones of one length are rows of a table, which loses a column with each merge."""
        size = np.fromiter(map(len, pieces), np.int64, len(pieces))
        out, order = np.zeros(len(pieces), np.int64), np.argsort(size, kind="stable")
        upto = np.searchsorted(size[order], np.arange(1, SHORT + 2))
        for n in range(1, SHORT + 1):
            some = order[upto[n - 1] : upto[n]]
            for a in range(0, len(some), step := TABLE // n):
                at = some[a : a + step]
                out[at] = self._counted(np.frombuffer(b"".join([pieces[i] for i in at.tolist()]), np.uint8).reshape(-1, n))
        long = order[upto[-1] :]
        if len(long):
            out[long] = np.bincount(self._merged([pieces[i] for i in long.tolist()])[1], minlength=len(long))
        return out.tolist()

    def _counted(self, raw: np.ndarray) -> np.ndarray:
        """Tokens of each row of bytes: in every step each row merges the leftmost of its pairs of the lowest rank, until it has none."""
        out, row = np.ones(len(raw), np.int64), np.arange(len(raw))
        token, pair = self.byte.astype(np.int32)[raw], self.of_bytes[raw[:, :-1].astype(np.int32) << 8 | raw[:, 1:]]
        while (n := token.shape[1]) > 1:
            at = pair.argmin(1)
            low = pair[np.arange(len(row)), at]
            more = low < NEVER
            if not more.all():
                out[row[~more]] = n
                row, token, pair, at, low = row[more], token[more], pair[more], at[more], low[more]
            if not len(row):
                break
            here = np.arange(len(row))
            token[here, at] = low
            stays = np.ones(token.shape, bool)
            stays[here, at + 1] = False
            token = token[stays].reshape(len(row), n - 1)
            stays = np.ones(pair.shape, bool)
            stays[here, at] = False
            pair = pair[stays].reshape(len(row), n - 2)
            left, right = np.flatnonzero(at > 0), np.flatnonzero(at < n - 2)
            for i, j in ((left, at[left] - 1), (right, at[right])):
                made = self.rank(token[i, j].astype(np.int64), token[i, j + 1].astype(np.int64))
                pair[i, j] = np.where(made < 0, NEVER, made)
        return out

    def _merged(self, pieces: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """The tokens of all pre-tokens in a row, and the number of the pre-token that each is of."""
        size = np.array([len(p) for p in pieces], np.int64)
        n, low = int(size.sum()), (1 << WORD) - 1
        if not n:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        owner = np.repeat(np.arange(len(pieces)), size)
        token = self.byte[np.frombuffer(b"".join(pieces), np.uint8)]
        inner = owner[1:] == owner[:-1]
        nxt, prv = np.full(n + 1, n), np.full(n + 1, -1)
        nxt[:-2][inner] = np.flatnonzero(inner) + 1
        prv[1:-1][inner] = np.flatnonzero(inner)
        want = np.full(n, -1)
        i = np.flatnonzero(inner)
        want[i] = self.rank(token[i], token[i + 1])
        alive = np.ones(n, bool)
        buckets: dict[int, list[np.ndarray]] = {}
        leaf: dict[int, int] = {}
        top = 0
        new = i[want[i] >= 0]
        while True:
            if len(new):
                r = want[new]
                order = np.argsort(r, kind="stable")
                new, r = new[order], r[order]
                head = np.flatnonzero(np.concatenate([[True], r[1:] != r[:-1]])).tolist()
                for a, b, s in zip(head, [*head[1:], len(r)], r[head].tolist(), strict=True):
                    if s in buckets:
                        buckets[s].append(new[a:b])
                    else:
                        buckets[s] = [new[a:b]]
                        w = s >> WORD
                        leaf[w] = leaf.get(w, 0) | 1 << (s & low)
                        top |= 1 << w
            if not top:
                break
            w = (top & -top).bit_length() - 1
            bits = leaf[w]
            r = w << WORD | (bits & -bits).bit_length() - 1
            held = buckets.pop(r)
            at = held[0] if len(held) == 1 else np.unique(np.concatenate(held))
            at = at[want[at] == r]  # the others are stale
            first = np.ones(len(at), bool)
            first[1:] = owner[at[1:]] != owner[at[:-1]]
            i = at[first]
            if len(i) < len(at):
                buckets[r] = [at[~first]]
            else:
                leaf[w] = bits = bits & (bits - 1)
                if not bits:
                    top &= top - 1
            j = nxt[i]
            k = nxt[j]
            token[i] = r
            nxt[i] = k
            prv[k] = i
            want[j] = -1
            alive[j] = False
            right, left = i[k < n], i[prv[i] >= 0]
            want[i] = -1
            # The pairs to the right and to the left of what has merged.
            near = np.concatenate([right, prv[left]])
            made = self.rank(token[near], token[np.concatenate([nxt[right], left])])
            want[near] = made
            new = near[made >= 0]
        return token[alive], owner[alive]


def load_ranks(data: bytes) -> dict[bytes, int]:
    """The lines `base64 rank` of a rank file."""
    return {base64.b64decode(a): int(b) for a, b in (x.split() for x in data.splitlines() if x.strip())}


class Codec:
    """Encoder and decoder of one vocabulary; `encode` gives ids as little-endian unsigned 32-bit bytes."""

    def __init__(self, ranks: dict[bytes, int], pattern: str) -> None:
        self.ranks, self.many = ranks, Merger(ranks)
        self.vocab = {i: b for b, i in ranks.items()}
        self.values = TextValues(pattern, lambda piece: np.array(merge(piece.encode(), ranks), "<u4").tobytes(), b"".join, self._pieces)

        # Counts are small numbers, of which a worker can remember more.
        self.counts = TextValues(pattern, lambda piece: len(merge(piece.encode(), ranks)), sum, self._counts, 2 * ENTRIES)

    def _pieces(self, pieces: list[str]) -> list[bytes]:
        raw = [p.encode() for p in pieces]
        out = [None if (r := self.ranks.get(x)) is None else r.to_bytes(4, "little") for x in raw]
        rest = [i for i, x in enumerate(out) if x is None]
        for i, ids in zip(rest, self.many.merge([raw[i] for i in rest]), strict=True):
            out[i] = ids
        return out

    def _counts(self, pieces: list[str]) -> list[int]:
        raw = [p.encode() for p in pieces]
        out = [1 if x in self.ranks else 0 for x in raw]
        rest = [i for i, n in enumerate(out) if not n]
        for i, n in zip(rest, self.many.count([raw[i] for i in rest]), strict=True):
            out[i] = n
        return out

    def encode(self, text: str) -> bytes:
        return self.values.of(text)

    def encode_all(self, texts: list[str]) -> list[bytes]:
        with no_cycles():
            self.values.learn(texts)
            return [self.values.of(t) for t in texts]

    def count_all(self, texts) -> list[int]:
        """Tokens of each text of a list or an Arrow array, without its ids; a null has none."""
        import pyarrow as pa

        with no_cycles():
            return self.counts.sums(texts if isinstance(texts, pa.Array) else pa.array(texts, pa.large_string())).tolist()

    def decode(self, ids: bytes) -> bytes:
        return b"".join(map(self.vocab.__getitem__, np.frombuffer(ids, "<u4").tolist()))


_codecs: dict[tuple[bytes, str], Codec] = {}


def codec_of(data: bytes, pattern: str) -> Codec:
    """The worker's codec of this file; it stays for later tasks, with what it remembers."""
    key = hashlib.sha256(data).digest(), pattern
    if key not in _codecs:
        _codecs.clear()
        give_back()
        _codecs[key] = Codec(load_ranks(data), pattern)
    return _codecs[key]


def encode_decode(docs: DataFrame, ranks_path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = True) -> DataFrame:
    """Encode whole texts by the rank file and decode the ids again.

    Returns id_col, n_tokens, ids_sha256 (over little-endian uint32 ids), decoded_sha256 and, with
    `with_ids`, token_ids array<int>. A null text counts as empty: no token, hashes of nothing. A null
    id stays null; repeated rows give repeated rows; very long texts are encoded whole; other columns are not
    read; an empty table gives an empty result. The rank file is read
    on the driver and travels once to each worker (it is a fixed vocabulary, about 1 MB).
    """
    spark = docs.sparkSession
    with open(ranks_path, "rb") as f:
        shared = spark.sparkContext.broadcast(f.read())
    id_type = docs.schema[id_col].dataType.simpleString()
    schema = f"`{id_col}` {id_type}, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", token_ids array<int>" * with_ids

    def run(batches):
        import pyarrow as pa

        codec = codec_of(shared.value, pattern)
        for batch in batches:
            for part in byte_slices(batch, 1, SLICE_ROWS):
                n, ids_sha, text_sha, ids = [], [], [], []
                for e in codec.encode_all([t or "" for t in part.column(1).to_pylist()]):
                    n.append(len(e) // 4)
                    ids_sha.append(hashlib.sha256(e).hexdigest())
                    text_sha.append(hashlib.sha256(codec.decode(e)).hexdigest())
                    if with_ids:
                        ids.append(np.frombuffer(e, "<u4").astype(np.int32))
                columns = [part.column(0), pa.array(n, pa.int64()), pa.array(ids_sha, pa.string()), pa.array(text_sha, pa.string())]
                if with_ids:
                    off = np.concatenate([[0], np.cumsum([len(x) for x in ids])]).astype(np.int32)
                    columns.append(pa.ListArray.from_arrays(pa.array(off), pa.array(np.concatenate(ids))))
                names = [id_col, "n_tokens", "ids_sha256", "decoded_sha256", "token_ids"][: len(columns)]
                yield pa.RecordBatch.from_arrays(columns, names=names)

    return docs.select(F.col(id_col), F.col(text_col)).mapInArrow(run, schema)
