"""What the training-data operators share: tables, the shared work folder, byte and word hashing."""

from __future__ import annotations

from contextlib import contextmanager

import numpy as np
from pyspark.sql import DataFrame, SparkSession

from pactlake.work import discard, work_dir  # noqa: F401
from pactlake.work import written as materialize  # noqa: F401

SPACE = np.zeros(256, bool)
SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def fresh(df: DataFrame, *names: str) -> list[str]:
    """The names, with underscores in front as long as `df` has such a column."""
    used, out = {c.lower() for c in df.columns}, []
    for name in names:
        while name.lower() in used:
            name = "_" + name
        used.add(name.lower())
        out.append(name)
    return out


@contextmanager
def no_cycles():
    """Without the search for reference cycles, which large memories of strings only slow down: for loops that make none."""
    import gc

    was = gc.isenabled()
    gc.disable()
    try:
        yield
    finally:
        if was:
            gc.enable()


def give_back() -> None:
    """Return what this worker freed in earlier stages to the system: workers outlive stages and allocators keep their peaks."""
    import ctypes
    import gc

    import pyarrow as pa

    gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # no glibc
        pass


def text_buffer(column) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of an Arrow string column and the row offsets (n + 1); nulls are empty. No copy."""
    import pyarrow as pa

    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    wide = column.type in (pa.large_string(), pa.large_binary())
    if column.null_count:
        column = column.fill_null("" if column.type in (pa.string(), pa.large_string()) else b"")
    _, offsets, data = column.buffers()
    n = len(column)
    off = np.frombuffer(offsets, np.int64 if wide else np.int32)[column.offset : column.offset + n + 1].astype(np.int64) if n else np.zeros(1, np.int64)
    buf = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return buf, off


def row_chunks(off: np.ndarray, limit: int = 1 << 21):
    """Row ranges (a, b) of about `limit` bytes; a row longer than that stands alone."""
    a, n = 0, len(off) - 1
    while a < n:
        b = int(np.searchsorted(off, off[a] + limit, "right")) - 1
        b = min(max(b, a + 1), n)
        yield a, b
        a = b


_BYTE = np.random.default_rng(20260101).integers(0, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_FOLD = _BYTE.copy()
_FOLD[65:91] = _BYTE[97:123]
_P, _PINV = 0x9E3779B97F4A7C15, pow(0x9E3779B97F4A7C15, -1, 1 << 64)
#: Powers that a worker keeps of each base, and bytes that are hashed at once.
KEPT = 1 << 18
_powers: dict[int, np.ndarray] = {}


def _grown(base: int, n: int) -> np.ndarray:
    t, step = np.ones(1, np.uint64), base
    while len(t) < n:
        t = np.concatenate([t, t * np.uint64(step)])
        step = step * step % (1 << 64)
    return t[:n]


def power_table(base: int, n: int) -> np.ndarray:
    """base^0 .. base^(n-1) modulo 2^64; the first KEPT are kept by the worker, more are made anew."""
    if base not in _powers:
        _powers[base] = _grown(base, KEPT)
    return _powers[base][:n] if n <= KEPT else powers_at(base, np.arange(n))


def powers_at(base: int, at: np.ndarray) -> np.ndarray:
    """base^i modulo 2^64 for each i, from a table of small powers and one of their steps."""
    high = at // KEPT
    out = power_table(base, KEPT)[at - high * KEPT]
    if len(at) and high.max():
        out *= _grown(pow(base, KEPT, 1 << 64), int(high.max()) + 1)[high]
    return out


def mix(h: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every input bit reaches every output bit."""
    h = h ^ (h >> np.uint64(30))
    h = h * np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(27)
    h *= np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def word_hashes(buf: np.ndarray, off: np.ndarray, fold: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Words `[^\\x20\\x09-\\x0D]+` of consecutive rows: (64-bit hash, first byte, end byte, words before each row).

    `off` are the rows' byte offsets in `buf`; byte positions are relative to off[0]. `fold` takes A-Z as a-z.
    """
    base = off[0]
    raw = buf[base : off[-1]]
    n = len(raw)
    if not n:
        z = np.zeros(0, np.int64)
        return np.zeros(0, np.uint64), z, z, np.zeros(len(off), np.int64)
    inside = ~SPACE[raw]
    cut = np.zeros(n + 1, bool)
    cut[off - base] = True
    start = inside.copy()
    start[1:] &= ~inside[:-1] | cut[1:n]
    end = inside.copy()
    end[:-1] &= ~inside[1:] | cut[1:n]
    s, e = np.flatnonzero(start), np.flatnonzero(end) + 1
    # Sums of byte * P^place up to each word's edges, a stretch of bytes at a time.
    low, high = np.empty(len(s), np.uint64), np.empty(len(s), np.uint64)
    values, total = _FOLD if fold else _BYTE, np.uint64(0)
    for a in range(0, n, KEPT):
        b = min(n, a + KEPT)
        sums = np.empty(b - a + 1, np.uint64)
        sums[0] = 0
        np.cumsum(values[raw[a:b]] * power_table(_P, b - a), out=sums[1:])
        sums *= np.uint64(pow(_P, a, 1 << 64))
        sums += total
        i, j = np.searchsorted(s, [a, b])
        low[i:j] = sums[s[i:j] - a]
        i, j = np.searchsorted(e, [a + 1, b + 1])
        high[i:j] = sums[e[i:j] - a]
        total = sums[-1]
    h = mix((high - low) * powers_at(_PINV, s) + (e - s).astype(np.uint64))
    return h, s, e, np.searchsorted(s, off - base)


def window_hashes(h: np.ndarray, k: int, seed: int) -> np.ndarray:
    """Hash of the k consecutive word hashes from each position; callers skip windows over a row's end."""
    n = len(h) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    q = 0xD6E8FEB86659FD93 ^ (seed * 2 + 2)
    q |= 1
    out, w = np.zeros(n, np.uint64), 1
    for j in range(k):
        out += h[j : j + n] * np.uint64(w)
        w = w * q % (1 << 64)
    return mix(out)


def byte_slices(batch, column: int, rows: int = 512, limit: int = 1 << 22):
    """Slices of a record batch of about `limit` bytes of one text column and `rows` rows at most; a longer text stands alone."""
    _, off = text_buffer(batch.column(column))
    for a, b in row_chunks(off, limit):
        for x in range(a, b, rows):
            yield batch.slice(x, min(rows, b - x))
