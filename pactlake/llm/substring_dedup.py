"""Removal of repeated word passages by fixed-block anchors.

Any WINDOW consecutive words hold exactly one whole block of BLOCK words that starts at a multiple of BLOCK in their
document (WINDOW = 2 * BLOCK - 1). So a passage that two documents share lets the rolling windows of either one meet a
block of the other.
 1. Every document's non-overlapping blocks are indexed and every rolling BLOCK-word window of all documents probes the
    index. A block that some other document holds anywhere is active. Keys are short here: a false hit costs only work.
 2. Around active blocks, hits extend to exact repeats: all WINDOW-word windows over an active block are compared by 64-bit
    hashes of 64-bit word hashes, and a window goes where a document with a smaller id has it. Neighbouring windows
    together give the maximal repeats.
Keys travel as sorted byte planes, one row for each hash bucket and portion of input. What a portion can tell by itself
(a block that two of its windows hold, a window that a smaller id of the portion holds) is settled there and passes the
buckets by, in rows of its own with a bucket below 0. So a common passage costs its bucket one document a portion.
"""

from __future__ import annotations

import hashlib

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pactlake.llm.common import materialize, mix, row_chunks, text_buffer, window_hashes, word_hashes

BLOCK = 7
WINDOW = 2 * BLOCK - 1
#: Words whose keys one portion of a task holds, and keys that one bucket gets, about.
PORTION, BUCKET_KEYS = 1_000_000, 500_000
SUB = 24  # bits of a key within its bucket in step 1
BYTES_A_WORD, PART_BYTES = 6, 4 << 20


def to_planes(a: np.ndarray, width: int) -> bytes:
    """The low `width` bytes of each value, byte by byte: sorted or small values then compress well."""
    return np.ascontiguousarray(a.astype("<u8", copy=False).view(np.uint8).reshape(-1, 8)[:, :width].T).tobytes()


def from_planes(data: bytes, width: int) -> np.ndarray:
    n = len(data) // width
    out = np.zeros((n, 8), np.uint8)
    out[:, :width] = np.frombuffer(data, np.uint8).reshape(width, n).T
    return out.view("<u8").ravel()


def _buckets(n_words: int) -> int:
    return max(8, -(-n_words // BUCKET_KEYS))


def _valid(first: np.ndarray, n: int, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(row, whether k words from here are in that row) of each word; first: words before each row."""
    row = np.repeat(np.arange(len(first) - 1), np.diff(first))
    return row, np.arange(n) + k <= first[1:][row]


def _runs(values: np.ndarray) -> np.ndarray:
    """First place of each run of equal values."""
    return np.flatnonzero(np.concatenate([[True], values[1:] != values[:-1]])) if len(values) else np.zeros(0, np.int64)


def own_bucket(*content: np.ndarray) -> int:
    """A bucket below 0 that follows from a portion's rows alone: a task that runs again deals them as before."""
    h = np.uint64(len(content[0]))
    for x in content:
        h = mix(np.array([h]) ^ x[:1].astype(np.uint64))[0]
    return -1 - int(h & np.uint64((1 << 40) - 1))


def _anchor_rows(buckets: int):
    """Arrow batches (id, text) -> rows bucket, probes, many, index: the keys of portions of documents."""

    def flush(probe, index):
        import pyarrow as pa

        c = np.sort(np.concatenate(probe))  # bucket << SUB | key; one for each window
        head = _runs(c)
        many = np.diff(np.append(head, len(c))) > 1
        c = c[head]
        ic, doc, block = (np.concatenate(x) for x in zip(*index, strict=True))
        order = np.argsort(ic, kind="stable")
        ic, doc, block = ic[order], doc[order], block[order]
        # A block whose key a second window of the portion has is active, whoever else holds it.
        known = many[np.searchsorted(c, ic)]
        rows = [(own_bucket(doc[known], ic[known]), b"", b"", to_planes(block[known], 4) + to_planes(doc[known], 8))] if known.any() else []
        ic, doc, block = ic[~known], doc[~known], block[~known]
        bucket = c >> np.uint64(SUB)
        a = _runs(bucket)
        edge = bucket[a] << np.uint64(SUB)
        x, y = np.searchsorted(ic, edge), np.searchsorted(ic, edge + np.uint64(1 << SUB))
        for i, (p, q) in enumerate(zip(a.tolist(), [*a[1:].tolist(), len(c)], strict=True)):
            at = slice(x[i], y[i])
            rows.append((int(bucket[p]), to_planes(c[p:q], SUB // 8), np.packbits(many[p:q]).tobytes(), to_planes(ic[at], SUB // 8) + to_planes(block[at], 4) + to_planes(doc[at], 8)))
        kinds = (pa.int64(), pa.binary(), pa.binary(), pa.binary())
        yield pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=["bucket", "probes", "many", "index"])

    def run(batches):
        probe, index, size = [], [], 0
        for batch in batches:
            ids = batch.column(0).to_numpy(zero_copy_only=False)
            buf, off = text_buffer(batch.column(1))
            for a, b in row_chunks(off):
                h, _, _, first = word_hashes(buf, off[a : b + 1], fold=False)
                k = window_hashes(h, BLOCK, 1)
                if not len(k):
                    continue
                row, ok = _valid(first, len(h), BLOCK)
                row, ok = row[: len(k)], ok[: len(k)]
                if not ok.any():
                    continue
                key = (k >> np.uint64(32)) % np.uint64(buckets) << np.uint64(SUB) | k & np.uint64((1 << SUB) - 1)
                probe.append(key[ok])
                place = np.arange(len(k)) - first[row]
                at = ok & (place % BLOCK == 0)
                index.append((key[at], ids[a + row[at]].astype(np.int64).view(np.uint64), (place[at] // BLOCK).astype(np.uint64)))
                size += len(k)
                if size >= PORTION:
                    yield from flush(probe, index)
                    probe, index, size = [], [], 0
        if size:
            yield from flush(probe, index)

    return run


def _among(keys: np.ndarray, found: np.ndarray) -> np.ndarray:
    """Whether each key is one of the found ones, which ascend."""
    return found[np.minimum(np.searchsorted(found, keys), len(found) - 1)] == keys if len(found) else np.zeros(len(keys), bool)


def _active_blocks(t):
    """One bucket's rows -> doc, block of the indexed blocks that two windows hold."""
    import pyarrow as pa

    settled = t.column("bucket")[0].as_py() < 0
    active = np.zeros(0, np.uint64)
    if not settled:
        keys, often = [], []
        for probes, many in zip(t.column("probes").to_pylist(), t.column("many").to_pylist(), strict=True):
            keys.append(from_planes(probes, SUB // 8))
            often.append(np.unpackbits(np.frombuffer(many, np.uint8), count=len(keys[-1])))
        key, twice = np.concatenate(keys), np.concatenate(often)
        order = np.argsort(key, kind="stable")
        key, twice = key[order], twice[order]
        head = _runs(key)
        active = key[head[(np.diff(np.append(head, len(key))) > 1) | (np.maximum.reduceat(twice, head) > 0)]] if len(key) else key
    docs, blocks = [], []
    for data in t.column("index").to_pylist():
        w = 0 if settled else SUB // 8
        n = len(data) // (w + 12)
        on = slice(None) if settled else _among(from_planes(data[: n * w], w), active)
        blocks.append(from_planes(data[n * w : n * (w + 4)], 4)[on])
        docs.append(from_planes(data[n * (w + 4) :], 8)[on])
    return pa.table({"doc": pa.array(np.concatenate(docs).view(np.int64)), "block": pa.array(np.concatenate(blocks).astype(np.int32))})


def _part_of(ids: np.ndarray, parts: int) -> np.ndarray:
    return (mix(ids.astype(np.int64).view(np.uint64)) % np.uint64(parts)).astype(np.int64)


def words_text(buf: np.ndarray, base: int, s: np.ndarray, e: np.ndarray, keep: np.ndarray | None = None) -> bytes:
    """The words [s, e) of the buffer, those kept, joined by one space."""
    if keep is not None:
        s, e = s[keep], e[keep]
    return b" ".join([buf[base + a : base + b].tobytes() for a, b in zip(s.tolist(), e.tolist(), strict=True)]) if len(s) < 8 else _join(buf[base:], s, e)


def _join(raw: np.ndarray, s: np.ndarray, e: np.ndarray) -> bytes:
    size = e - s + 1
    at = np.repeat(s - (np.cumsum(size) - size), size) + np.arange(int(size.sum()))
    out = raw[np.minimum(at, len(raw) - 1)]
    out[np.cumsum(size) - 1] = 32
    return out[:-1].tobytes()


def _split_candidates(parts: int, with_text: bool):
    """(id, text, blocks) -> id, part, text and blocks where a block is active, else the finished result."""

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            buf, off = text_buffer(batch.column(1))
            ids, texts, blocks = batch.column(0), batch.column(1), batch.column(2)
            has = [bool(x) for x in blocks.is_valid().to_pylist()]
            n, sha, kept = [], [], []
            for a, b in row_chunks(off):
                _, s, e, first = word_hashes(buf, off[a : b + 1], fold=False)
                for i in range(a, b):
                    x, y = first[i - a], first[i - a + 1]
                    n.append(int(y - x))
                    data = None if has[i] else words_text(buf, int(off[a]), s[x:y], e[x:y])
                    sha.append(None if has[i] else hashlib.sha256(data).hexdigest())
                    kept.append(None if has[i] or not with_text else data.decode())
            mask = pa.array(has)
            part = _part_of(ids.fill_null(0).to_numpy(zero_copy_only=False), parts)
            yield pa.RecordBatch.from_arrays([
                ids, pa.array(part), pa.compute.if_else(mask, texts.cast(pa.string()), pa.scalar(None, pa.string())), blocks.cast(pa.list_(pa.int32())),
                pa.array(n, pa.int64()), pa.array(sha, pa.string()), pa.array(kept, pa.string()),
            ], names=["id", "part", "text", "blocks", "n_words", "kept_sha256", "kept_text"])

    def compute(batches):
        import pyarrow.compute  # noqa: F401

        yield from run(batches)

    return compute


def _window_rows(buckets: int):
    """Candidates (id, text, blocks) -> rows bucket, data: (hash, id, place) of the windows over active blocks.

    A window that a smaller id of the portion holds is repeated for certain: it travels as (id, place) in a bucket below 0.
    """

    def flush(held):
        import pyarrow as pa

        key, doc, place = (np.concatenate(x) for x in zip(*held, strict=True))
        bucket = (key >> np.uint64(32)) % np.uint64(buckets)
        order = np.lexsort((key, bucket))
        key, doc, place = key[order], doc[order], place[order]
        head = _runs(key)
        gone = doc > np.repeat(np.minimum.reduceat(doc, head), np.diff(np.append(head, len(key)))) if len(key) else np.zeros(0, bool)
        rows = [(own_bucket(doc[gone], place[gone], key[gone]), to_planes(doc[gone].view(np.uint64), 8) + to_planes(place[gone], 4))] if gone.any() else []
        key, doc, place, bucket = key[~gone], doc[~gone].view(np.uint64), place[~gone], bucket[order][~gone]
        a = _runs(bucket).tolist()
        rows += [(int(bucket[p]), to_planes(key[p:q], 8) + to_planes(doc[p:q], 8) + to_planes(place[p:q], 4)) for p, q in zip(a, [*a[1:], len(key)], strict=False)]
        yield pa.RecordBatch.from_arrays([pa.array([x for x, _ in rows], pa.int64()), pa.array([x for _, x in rows], pa.binary())], names=["bucket", "data"])

    def run(batches):
        held, size = [], 0
        for batch in batches:
            ids = batch.column(0).to_numpy(zero_copy_only=False).astype(np.int64)
            buf, off = text_buffer(batch.column(1))
            lists = batch.column(2)
            where, flat = lists.offsets.to_numpy().astype(np.int64), lists.values.to_numpy().astype(np.int64)
            for a, b in row_chunks(off):
                h, _, _, first = word_hashes(buf, off[a : b + 1], fold=False)
                k = window_hashes(h, WINDOW, 2)
                if not len(k):
                    continue
                row, ok = _valid(first, len(h), WINDOW)
                active = np.zeros(len(h) + 1, bool)
                own = np.repeat(np.arange(b - a), np.diff(where[a : b + 1]))
                active[first[own] + flat[where[a] : where[b]] * BLOCK] = True
                row, ok = row[: len(k)], ok[: len(k)]
                place = np.arange(len(k)) - first[row]
                # The block of this row that lies in the window: the first multiple of BLOCK from here on.
                ok &= active[np.minimum(np.arange(len(k)) + (-place) % BLOCK, len(h))]
                held.append((k[ok], ids[a + row[ok]], place[ok].astype(np.uint64)))
                size += int(ok.sum())
                if size >= PORTION:
                    yield from flush(held)
                    held, size = [], 0
        if size:
            yield from flush(held)

    return run


def _repeated(parts: int):
    """One bucket's windows -> rows part, data: (id, place) of those that a document with a smaller id holds."""

    def run(t):
        import pyarrow as pa

        docs, places = [], []
        if t.column("bucket")[0].as_py() < 0:
            for data in t.column("data").to_pylist():
                n = len(data) // 12
                docs.append(from_planes(data[: 8 * n], 8).view(np.int64))
                places.append(from_planes(data[8 * n :], 4))
            doc, place = np.concatenate(docs), np.concatenate(places)
        else:
            keys = []
            for data in t.column("data").to_pylist():
                n = len(data) // 20
                keys.append(from_planes(data[: 8 * n], 8))
                docs.append(from_planes(data[8 * n : 16 * n], 8).view(np.int64))
                places.append(from_planes(data[16 * n :], 4))
            key, doc, place = map(np.concatenate, (keys, docs, places))
            order = np.argsort(key, kind="stable")
            key, doc, place = key[order], doc[order], place[order]
            head = _runs(key)
            out = doc > np.repeat(np.minimum.reduceat(doc, head), np.diff(np.append(head, len(key))))
            doc, place = doc[out], place[out]
        part = _part_of(doc, parts)
        order = np.lexsort((place, doc, part))
        doc, place, part = doc[order], place[order], part[order]
        at, start = np.unique(part, return_index=True)
        end = np.append(start[1:], len(part))[: len(start)]
        data = [to_planes(doc[a:b].view(np.uint64), 8) + to_planes(place[a:b], 4) for a, b in zip(start, end, strict=True)]
        return pa.table({"part": pa.array(at, pa.int64()), "data": pa.array(data, pa.binary())})

    return run


def _finish(with_text: bool):
    """One part's candidates and repeated windows -> results."""

    def run(docs, gone):
        import pyarrow as pa

        ids, places = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        for data in gone.column("data").to_pylist():
            n = len(data) // 12
            ids.append(from_planes(data[: 8 * n], 8).view(np.int64))
            places.append(from_planes(data[8 * n :], 4).astype(np.int64))
        gid, place = np.concatenate(ids), np.concatenate(places)
        order = np.argsort(gid, kind="stable")
        gid, place = gid[order], place[order]
        out = []
        for doc, text in zip(docs.column("id").to_pylist(), docs.column("text").to_pylist(), strict=True):
            data = np.frombuffer(text.encode(), np.uint8)
            h, s, e, _ = word_hashes(data, np.array([0, len(data)]), fold=False)
            a, b = np.searchsorted(gid, [doc, doc + 1]) if doc < (1 << 63) - 1 else (np.searchsorted(gid, doc), len(gid))
            cover = np.zeros(len(h) + 1, np.int32)
            p = np.unique(place[a:b])
            cover[p] += 1
            cover[np.minimum(p + WINDOW, len(h))] -= 1
            keep = np.cumsum(cover)[: len(h)] == 0
            kept = words_text(data, 0, s, e, keep)
            out.append((doc, len(h), int(len(h) - keep.sum()), hashlib.sha256(kept).hexdigest(), kept.decode() if with_text else None))
        kinds = (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string())
        return pa.table({n: pa.array(c, k) for n, c, k in zip(("id", "n_words", "n_removed", "kept_sha256", "kept_text"), zip(*out, strict=True) if out else [[]] * 5, kinds, strict=True)})

    return run


def dedup_substrings(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", with_text: bool = False) -> DataFrame:
    """Remove words covered by WINDOW-word sequences that also start in a document with a smaller id.

    Returns id_col (long), n_words, n_removed, kept_sha256 and, with `with_text`, kept_text (the kept words joined by one
    space). A null or blank text has no words; very long texts are read whole. Rows with a null id keep all their words and
    take none from others; rows that share an id, repeated rows among them, are judged alike, and none takes words from the
    other. Ids must be numbers. Other columns are not read; an empty table gives an empty result. `docs` should be read from
    files or a written table, whose rows come in one order however often a task runs.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.coalesce(text_col, F.lit("")).alias("text"))
    n_bytes = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n_words = n_bytes // BYTES_A_WORD
    anchors = rows.filter("id IS NOT NULL").mapInArrow(_anchor_rows(_buckets(n_words)), "bucket long, probes binary, many binary, index binary")
    active = anchors.groupBy("bucket").applyInArrow(_active_blocks, "doc long, block int")
    lists = active.groupBy("doc").agg(F.collect_list("block").alias("blocks"))
    parts = max(8, n_bytes // PART_BYTES)
    joined = rows.join(lists, rows["id"] == lists["doc"], "left").select("id", "text", "blocks")
    state, path = materialize(joined.mapInArrow(_split_candidates(parts, with_text), "id long, part long, text string, blocks array<int>, n_words long, kept_sha256 string, kept_text string"), "substring-candidates")
    done = state.filter("blocks IS NULL").select("id", "n_words", F.lit(0).cast("long").alias("n_removed"), "kept_sha256", "kept_text")
    cand = state.filter("blocks IS NOT NULL")
    windows = cand.select("id", "text", "blocks").mapInArrow(_window_rows(_buckets(n_words // 2)), "bucket long, data binary")
    gone = windows.groupBy("bucket").applyInArrow(_repeated(parts), "part long, data binary")
    result = "id long, n_words long, n_removed long, kept_sha256 string, kept_text string"
    rest = cand.select("id", "part", "text").groupBy("part").cogroup(gone.groupBy("part")).applyInArrow(_finish(with_text), result)
    out = done.unionByName(rest).withColumnRenamed("id", id_col)
    return out if with_text else out.drop("kept_text")
