"""Exact Jaccard join of word-shingle sets by universe partitioning and the pigeonhole principle.

Sets of sizes r <= s with Jaccard >= 3/4 differ in (r + s) / 7 elements at most. For every size band the hashed universe
is partitioned into segments, more of them than elements may differ, so two linked sets agree on some whole segment.
 - A set is indexed by the subset that falls into each segment of its own band, and probes its own band and the one below.
 - A segment compared for equality counts one unit, one compared within one deletion counts two; a probe needs one unit
   more than the elements that may differ. Costs decide which segments count: those whose subset no other set holds are
   free, then come the rarest. Common subsets are left out as far as the units allow.
 - Where a set has too few non-empty segments, its largest ones are probed with their one-deletion neighbourhood (small
   bands index it) and then its empty ones.
Candidates are verified on the whole shingle sets. Sets that share a subset are first tied to one hub of it; then only
pairs that still lie in different components are made, so groups of copies need no square of their size.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pactlake.llm.common import discard, fresh, materialize, mix, row_chunks, text_buffer, window_hashes, word_hashes
from pactlake.llm.components import components
from pactlake.llm.substring_dedup import from_planes, own_bucket, to_planes

SHINGLE = 5
#: Linked sets of sizes r and s differ in (r + s) / SPAN elements at most: that is Jaccard >= 3/4.
SPAN = 7
#: Bands up to this size index one-deletion neighbourhoods.
SMALL = 48
BUCKET_KEYS, PORTION = 500_000, 1_000_000
SUB = 24
#: Documents under one key of a portion from which they wait outside the key's bucket.
CROWD = 64
#: Buckets of a set's sketch, sets in one side of a block, and candidates of a probe and component in the first round.
SKETCH, BLOCK, FEW = 512, 2048, 32
BOTH, LOW, INDEX, EXTRA = 0, 1, 2, 3  # a key's role: index and probe, probe of the band below, index only, extra probe
FACTS = 16  # in a bucket, a role from here on is what a portion knows of a key, without its documents: bits for index, probe, many, waiting
SHARED, WAITING, MARK = 0, 1, 2  # rows of _shared_keys: a shared key's document, one that waits for the key, and the key's mark


def _band_starts() -> np.ndarray:
    lo = [1]
    while lo[-1] < 1 << 40:
        lo.append(max(lo[-1] + 1, -(-4 * lo[-1] // 3)))
    return np.array(lo, np.int64)


STARTS = _band_starts()


def segments_of(band: np.ndarray) -> np.ndarray:
    """Segments of the universe in a band: two fifths of its largest size, and a few."""
    return 2 * STARTS[band + 1] // 5 + 3


def shingle_sets(buf: np.ndarray, off: np.ndarray) -> list[np.ndarray]:
    """The sorted distinct shingle hashes of each row."""
    h, _, _, first = word_hashes(buf, off, fold=True)
    k = window_hashes(h, SHINGLE, 3)
    out = []
    for a, b in zip(first[:-1].tolist(), first[1:].tolist(), strict=True):
        n = b - a
        if n >= SHINGLE:
            x = np.sort(k[a : b - SHINGLE + 1])
            out.append(x[np.concatenate([[True], x[1:] != x[:-1]])])
        elif n:
            out.append(mix(window_hashes(h[a:b], n, 4) + np.uint64(n)))
        else:
            out.append(h[:0])
    return out


def set_hash(x: np.ndarray) -> tuple[int, int]:
    n = np.uint64(len(x))
    return tuple(int((mix(x + np.uint64(c)).sum(dtype=np.uint64) + n).astype(np.int64)) for c in (0x1234567, 0x89ABCDEF))


def keys_of(sets: list[np.ndarray]) -> dict[str, np.ndarray]:
    """Keys of a list of non-empty sets: key, set (its number), role; and slack_own, slack_low by set.

    A slack is how many of the set's non-empty segments may be left out; -1: none, as extra probes were needed.
    """
    size = np.array([len(x) for x in sets], np.int64)
    x = np.concatenate(sets)
    which = np.repeat(np.arange(len(sets)), size)
    own = np.searchsorted(STARTS, size, "right") - 1
    keys, owner, role = [], [], []
    slack = {}
    for name, band in (("own", own), ("low", own - 1)):
        live = band >= 0
        b = np.maximum(band, 0)
        high = STARTS[b + 1] - 1
        m = np.where(live, segments_of(b), 0)
        need = (size + np.minimum(size, high)) // SPAN + 1
        reach = live & (4 * high >= 3 * size)
        m = np.where(reach, m, 0)
        base = np.concatenate([[0], np.cumsum(m)])
        on = reach[which]
        e, w = x[on], which[on]
        seg = (mix(e ^ np.uint64(0xA5A5A5A5)) % m[w].astype(np.uint64)).astype(np.int64)
        at = base[w] + seg
        v = mix(e + np.uint64(0x51ED27))
        total = int(base[-1])
        count = np.bincount(at, minlength=total)
        low = np.bincount(at, (v & np.uint64(0xFFFFFFFF)).astype(float), minlength=total).astype(np.uint64)
        top = np.bincount(at, (v >> np.uint64(32)).astype(float), minlength=total).astype(np.uint64)
        value = (top << np.uint64(32)) + low
        owner_of = np.repeat(np.arange(len(sets)), m)
        place = np.arange(total) - base[owner_of]
        salt = mix(((b[owner_of].astype(np.uint64) << np.uint64(40)) + place.astype(np.uint64)) * np.uint64(4))

        def put(idx, values, kind, r):
            keys.append(mix(values ^ (salt[idx] + np.uint64(kind))))
            owner.append(owner_of[idx])
            role.append(np.full(len(idx), r, np.uint8))

        filled = np.flatnonzero(count)
        put(filled, value[filled], 0, BOTH if name == "own" else LOW)
        have = np.bincount(owner_of[filled], minlength=len(sets))
        short = np.where(reach, np.maximum(need - have, 0), 0)
        slack[name] = np.where(reach, np.where(short > 0, -1, have - need), 0)
        none = np.zeros(0, np.uint64)
        if name == "own":  # what probes with too few segments look up
            empty = np.flatnonzero(count == 0)
            put(empty, np.zeros(len(empty), np.uint64) if len(empty) else none, 3, INDEX)
            small = high[owner_of] <= SMALL
            i = np.flatnonzero(small)
            put(i, value[i], 1, INDEX)
            j = np.flatnonzero(small[at])
            put(at[j], value[at[j]] - v[j], 2, INDEX)
        for d in np.flatnonzero(short):
            a, z = base[d], base[d + 1]
            left = int(short[d])
            order = a + np.argsort(-count[a:z], kind="stable")
            grown = order[: min(left, int((count[a:z] > 0).sum()))] if high[d] <= SMALL else order[:0]
            j = np.flatnonzero(np.isin(at, grown))
            put(at[j], value[at[j]] - v[j], 1, EXTRA)
            put(grown, value[grown], 2, EXTRA)
            left -= len(grown)
            if left:
                blank = order[count[order] == 0][:left]
                put(blank, np.zeros(len(blank), np.uint64), 3, EXTRA)
    return {"key": np.concatenate(keys), "set": np.concatenate(owner), "role": np.concatenate(role), "slack_own": slack["own"], "slack_low": slack["low"]}


def _set_rows(batches):
    """(id, text) -> id, n, h1, h2, own, low: size, 128-bit hash and slacks of every set."""
    import pyarrow as pa

    for batch in batches:
        buf, off = text_buffer(batch.column(1))
        cols = [[] for _ in range(5)]
        for a, b in row_chunks(off):
            sets = shingle_sets(buf, off[a : b + 1])
            full = [i for i, s in enumerate(sets) if len(s)]
            own, low = np.zeros(len(sets), np.int64), np.zeros(len(sets), np.int64)
            if full:
                k = keys_of([sets[i] for i in full])
                own[full], low[full] = k["slack_own"], k["slack_low"]
            for s in sets:
                p, q = set_hash(s)
                for c, v in zip(cols, (len(s), p, q), strict=False):
                    c.append(v)
            cols[3] += own.tolist()
            cols[4] += low.tolist()
        yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, pa.int64()) for c in cols)], names=["id", "n", "h1", "h2", "own", "low"])


def _groups(key: np.ndarray, role: np.ndarray, doc: np.ndarray):
    """Of entries sorted by key: first entry of each key, and whether it is indexed, probed, of several documents, waiting."""
    start = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])) if len(key) else np.zeros(0, np.int64)
    fact = role >= FACTS
    bit = lambda k, plain: np.logical_or.reduceat(np.where(fact, role >> k & 1 == 1, plain), start)
    many = bit(2, False) | (np.minimum.reduceat(doc, start) != np.maximum.reduceat(doc, start))
    return start, bit(0, (role == BOTH) | (role == INDEX)), bit(1, role != INDEX), many, bit(3, False)


def _key_rows(buckets: int):
    """(id, text) -> rows bucket, kind, data: keys, roles and ids of portions of documents; a portion's copies count once.

    A key that an index and a probe of a portion's documents share is settled there: its documents travel in rows of their
    own (a bucket below 0) and its bucket gets one entry. Unsettled documents that crowd under one key do the same, but wait
    for the bucket's word. So a bucket gets a few entries of a key and portion at most.
    """

    def flush(held):
        import pyarrow as pa

        key, role, doc = (np.concatenate(x) for x in zip(*held, strict=True))
        c = ((key >> np.uint64(32)) % np.uint64(buckets) << np.uint64(SUB)) | (key & np.uint64((1 << SUB) - 1))
        order = np.argsort(c, kind="stable")
        c, role, doc = c[order], role[order], doc[order]
        start, index, probe, many, _ = _groups(c, role, doc)
        size = np.diff(np.append(start, len(c)))
        on = index & probe & many
        wait = ~on & (size > CROWD)
        out = []
        for kind, chosen in ((SHARED, on), (WAITING, wait)):
            at = np.repeat(chosen, size)
            if at.any():
                out.append((own_bucket(doc[at], c[at], role[at] + kind), kind, to_planes(c[at], 8) + role[at].tobytes() + to_planes(doc[at].view(np.uint64), 8)))
        stay, said = np.repeat(~on & ~wait, size), np.flatnonzero(on | wait)
        fact = (FACTS + index[said] + 2 * probe[said] + 4 * many[said] + 8 * wait[said]).astype(np.uint8)
        c, role, doc = (np.concatenate(x) for x in ((c[stay], c[start[said]]), (role[stay], fact), (doc[stay], doc[start[said]])))
        order = np.argsort(c, kind="stable")
        c, role, doc = c[order], role[order], doc[order]
        bucket = c >> np.uint64(SUB)
        head = np.flatnonzero(np.concatenate([[True], bucket[1:] != bucket[:-1]])) if len(c) else np.zeros(0, np.int64)
        for a, b in zip(head.tolist(), [*head[1:].tolist(), len(c)], strict=False):
            out.append((int(bucket[a]), SHARED, to_planes(c[a:b], SUB // 8) + role[a:b].tobytes() + to_planes(doc[a:b].view(np.uint64), 8)))
        kinds = (("bucket", pa.int64()), ("kind", pa.int32()), ("data", pa.binary()))
        yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, (_, k) in zip(zip(*out, strict=True), kinds, strict=True)], names=[n for n, _ in kinds])

    def run(batches):
        held, size, seen = [], 0, set()
        for batch in batches:
            ids = batch.column(0).to_numpy(zero_copy_only=False).astype(np.int64)
            buf, off = text_buffer(batch.column(1))
            for a, b in row_chunks(off):
                sets, mine = [], []
                for i, s in enumerate(shingle_sets(buf, off[a : b + 1])):
                    h = set_hash(s)
                    if len(s) and h not in seen:
                        seen.add(h)
                        sets.append(s)
                        mine.append(ids[a + i])
                if not sets:
                    continue
                k = keys_of(sets)
                held.append((k["key"], k["role"], np.array(mine, np.int64)[k["set"]]))
                size += len(k["key"])
                if size >= PORTION:
                    yield from flush(held)
                    held, size, seen = [], 0, set()
        if size:
            yield from flush(held)

    return run


def _entries(data: bytes, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    n = len(data) // (width + 9)
    return from_planes(data[: n * width], width).view(np.int64), np.frombuffer(data, np.uint8, n, n * width), from_planes(data[n * (width + 1) :], 8).view(np.int64)


def _shared_keys(t):
    """One bucket's rows -> state, doc, role, key of the keys that an index and a probe of different documents share."""
    import pyarrow as pa

    bucket = t.column("bucket")[0].as_py()
    parts = [_entries(x, 8 if bucket < 0 else SUB // 8) for x in t.column("data").to_pylist()]
    key, role, doc = (np.concatenate(x) for x in zip(*parts, strict=True))
    if bucket < 0:
        state = np.repeat(t.column("kind").to_numpy(), [len(p[0]) for p in parts])
    else:
        order = np.argsort(key, kind="stable")
        key, role, doc = key[order], role[order], doc[order]
        start, index, probe, many, wait = _groups(key, role, doc)
        on = index & probe & many
        at = np.repeat(on, np.diff(np.append(start, len(key)))) & (role < FACTS)
        mark = start[on & wait]
        state = np.concatenate([np.full(int(at.sum()), SHARED), np.full(len(mark), MARK)])
        key = (bucket << SUB) + np.concatenate([key[at], key[mark]])
        role, doc = np.concatenate([role[at], role[mark]]), np.concatenate([doc[at], doc[mark]])
    return pa.table({"state": pa.array(state.astype(np.int32)), "doc": pa.array(doc, pa.int64()), "role": pa.array(role.astype(np.int32), pa.int32()), "key": pa.array(key, pa.int64())})


def sketch(x: np.ndarray) -> bytes:
    """Elements counted in SKETCH buckets; empty where a count does not fit a byte.

    The sum over buckets of the smaller count bounds an intersection from above.
    """
    c = np.bincount((x >> np.uint64(20)).astype(np.int64) % SKETCH, minlength=SKETCH)
    return c.astype(np.uint8).tobytes() if c.max(initial=0) < 256 else b""


def _packed_sets(batches):
    import pyarrow as pa

    for batch in batches:
        buf, off = text_buffer(batch.column(1))
        for a, b in row_chunks(off):
            sets = shingle_sets(buf, off[a : b + 1])
            columns = [pa.array([s.tobytes() for s in sets], pa.binary()), pa.array([sketch(s) for s in sets], pa.binary()), pa.array([len(s) for s in sets], pa.int64())]
            hashes = [pa.array(x, pa.int64()) for x in zip(*map(set_hash, sets), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), *columns, *hashes], names=["node", "elements", "sketch", "n", "h1", "h2"])


def _apart(first: int, last: int):
    """One block of a hub's sets -> pairs (a, b) of a probe and an index in different components that may be linked.

    Of each probe's candidates in one component those ranked from `first` to before `last` by their bound are returned;
    a row (null, null) tells that there are more.
    """

    def run(t):
        import pyarrow as pa

        schema = pa.schema([("a", pa.int64()), ("b", pa.int64())])
        probe = t.column("probe").to_numpy()
        node, n, comp = (t.column(c).to_numpy() for c in ("node", "n", "comp"))
        raw = t.column("sketch").to_pylist()
        known = np.array([len(x) > 0 for x in raw])
        counts = np.frombuffer(b"".join(x or bytes(SKETCH) for x in raw), np.uint8).reshape(-1, SKETCH)
        pi, ii = np.flatnonzero(probe == 1), np.flatnonzero(probe == 0)
        found, more = [], False
        for p in pi:
            fit = ii[(comp[ii] != comp[p]) & (n[ii] <= n[p]) & (4 * n[ii] >= 3 * n[p])]
            if not len(fit):
                continue
            most = np.minimum(counts[fit], counts[p]).sum(1, dtype=np.int64)
            spare = np.where(known[fit] & known[p], SPAN * most - 3 * (n[fit] + n[p]), 1 << 40)
            fit, spare = fit[spare >= 0], spare[spare >= 0]
            if not len(fit):
                continue
            order = np.lexsort((node[fit], -spare, comp[fit]))
            fit = fit[order]
            c = comp[fit]
            head = np.concatenate([[True], c[1:] != c[:-1]])
            rank = np.arange(len(fit)) - np.maximum.accumulate(np.where(head, np.arange(len(fit)), 0))
            more |= bool((rank >= last).any())
            for i in fit[(rank >= first) & (rank < last)]:
                found.append((node[p], node[i]))
        if more:
            found.append((None, None))
        return pa.table({"a": pa.array([x for x, _ in found], pa.int64()), "b": pa.array([y for _, y in found], pa.int64())}, schema=schema)

    return run


def _linked(batches):
    """(a, b, x, y) -> the pairs whose sets have 100 * intersection >= 75 * union."""
    import pyarrow as pa

    for batch in batches:
        keep = []
        for x, y in zip(batch.column(2), batch.column(3), strict=True):
            p, q = np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)
            both = len(p) + len(q) - len(np.union1d(p, q)) if 4 * min(len(p), len(q)) >= 3 * max(len(p), len(q)) else 0
            keep.append(100 * both >= 75 * (len(p) + len(q) - both))
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], names=["a", "b"]).filter(pa.array(keep, pa.bool_()))


def verified(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    y = sets.select(F.col("node").alias("b"), F.col("elements").alias("y"))
    x = sets.select(F.col("node").alias("a"), F.col("elements").alias("x"))
    return pairs.join(y, "b").join(x, "a").select("a", "b", "x", "y").mapInArrow(_linked, "a long, b long")


def links(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> tuple[DataFrame, DataFrame]:
    """(per document: id, n, node) and (node, component) of the nodes that have links.

    A node is the smallest id among documents with equal sets; documents without shingles have node null.
    """
    spark = docs.sparkSession
    rows = docs.filter(F.col(id_col).isNotNull()).select(F.col(id_col).cast("long").alias("id"), F.coalesce(text_col, F.lit("")).alias("text"))
    sets, p_sets = materialize(rows.mapInArrow(_set_rows, "id long, n long, h1 long, h2 long, own long, low long"), "jaccard-sets")
    # Of rows that share an id the largest set counts, then that of the largest hashes.
    best = F.max(F.struct("n", "h1", "h2", "own", "low"))
    twice, p_twice = materialize(sets.groupBy("id").agg(F.count("*").alias("c"), best.alias("best")).filter("c > 1").select("id", "best"), "jaccard-twice")
    one = lambda c: F.coalesce(F.col("best")[c], F.col(c)).alias(c)
    chosen = sets.join(twice, "id", "left").select("id", F.col("n").alias("own_n"), *map(one, ("n", "h1", "h2", "own", "low")))
    # Only sets that several documents have; written, so that the join may split a set of very many copies over several tasks.
    copied, p_copied = materialize(chosen.filter("n > 0").groupBy("n", "h1", "h2").agg(F.min("id").alias("low_id"), F.max("id").alias("high_id")).filter("low_id < high_id").drop("high_id"), "jaccard-copied")
    node = F.when(F.col("n") > 0, F.coalesce("low_id", "id")).alias("node")
    known, p_known = materialize(chosen.join(copied, ["n", "h1", "h2"], "left").select("id", "own_n", "n", node, "own", "low"), "jaccard-nodes")
    total = sets.agg(F.sum("n")).first()[0] or 0

    keys = rows.mapInArrow(_key_rows(max(8, -(-total // BUCKET_KEYS))), "bucket long, kind int, data binary")
    shared, p_shared = materialize(keys.groupBy("bucket").applyInArrow(_shared_keys, "state int, doc long, role int, key long"), "jaccard-shared")
    marks = shared.filter(F.col("state") == MARK).select("key").distinct()
    shared = shared.filter(F.col("state") == SHARED).drop("state").unionByName(shared.filter(F.col("state") == WAITING).drop("state").join(marks, "key", "left_semi"))
    node_of = known.filter("node IS NOT NULL").select(F.col("id").alias("doc"), "node", "n", "own", "low").distinct()
    held = shared.join(node_of, "doc").select("node", "n", "own", "low", "role", "key").distinct()
    held, p_held = materialize(held, "jaccard-held")
    discard(spark, p_shared, p_sets, p_copied, p_twice)

    # Cost of a probe: the other sets that the index has under its key. The hub of a key is its set with the most common
    # subsets on average: of copies with edits, the one that has the fewest.
    indexed = held.filter(F.col("role").isin(BOTH, INDEX))
    freq = indexed.groupBy("key").agg(F.count("*").alias("f"))
    central = indexed.join(freq, "key").groupBy("node").agg(F.avg("f").alias("p"))
    hubs = indexed.join(central, "node").groupBy("key").agg(F.count("*").alias("f"), F.max(F.struct("p", (-F.col("node")).alias("h"))).alias("top"))
    hubs, p_hubs = materialize(hubs.select("key", "f", (-F.col("top.h")).alias("hub")), "jaccard-hubs")
    costed = held.filter(F.col("role") != INDEX).join(hubs, "key").withColumn("cost", F.col("f") - (F.col("role") == BOTH).cast("long")).filter("cost > 0")
    rank = F.row_number().over(Window.partitionBy("node", "role").orderBy(F.desc("cost"), "key"))
    slack = F.when(F.col("role") == BOTH, F.col("own")).when(F.col("role") == LOW, F.col("low")).otherwise(F.lit(-1))
    probes, p_probes = materialize(costed.withColumn("rank", rank).filter(F.col("rank") > slack).select("node", "n", "role", "key", "hub"), "jaccard-probes")
    used = probes.select("key").distinct()
    index, p_index = materialize(held.filter(F.col("role").isin(BOTH, INDEX)).select("node", "n", "key").join(used, "key", "left_semi").distinct(), "jaccard-index")
    discard(spark, p_held)

    wanted = probes.select("node").unionByName(index.select("node")).distinct()
    texts = rows.join(wanted, rows["id"] == wanted["node"], "left_semi").select(F.col("id").alias("node"), "text")
    made = texts.mapInArrow(_packed_sets, "node long, elements binary, sketch binary, n long, h1 long, h2 long")
    made = made.groupBy("node").agg(F.max_by(F.struct("elements", "sketch"), F.struct("n", "h1", "h2")).alias("s"))
    packed, p_packed = materialize(made.select("node", "s.elements", "s.sketch"), "jaccard-packed")

    # (1) each probe against the hub that it shares most keys with
    best = probes.filter("hub <> node").groupBy("node", "hub").agg(F.count("*").alias("c"))
    best = best.groupBy("node").agg(F.max(F.struct("c", (-F.col("hub")).alias("h"))).alias("top"))
    star, p_star = materialize(verified(best.select(F.col("node").alias("a"), (-F.col("top.h")).alias("b")), packed), "jaccard-star")
    # (2) what still lies apart: sets under keys of one hub, in blocks, pairs of different components only. Pairs that pass the
    # bound are verified; where a probe has many of them in one component, the best go first, as one link settles them all.
    hub_of = hubs.select("key", "hub").join(used, "key", "left_semi")
    members = probes.select("hub", "node", F.lit(1).alias("probe")).unionByName(index.join(hub_of, "key").select("hub", "node", F.lit(0).alias("probe"))).distinct()
    members, p_members = materialize(members, "jaccard-members")
    size_of = known.filter("id = node").select("node", "n").distinct()
    info, p_info = materialize(packed.select("node", "sketch").join(size_of, "node"), "jaccard-info")
    edges, old, p_near = star, [p_star], None
    first, last = 0, FEW
    while True:
        near, p_next = components(edges)
        discard(spark, p_near)
        p_near = p_next
        placed = members.join(near, "node", "left").select("hub", "probe", "node", F.coalesce("component", "node").alias("comp"))
        mixed = placed.groupBy("hub").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi"), F.sum("probe").alias("np"), F.sum(1 - F.col("probe")).alias("ni")).filter("lo <> hi AND np > 0 AND ni > 0")
        # Written, so that the join below may split a hub of many sets over several tasks.
        mixed, p_mixed = materialize(mixed.select("hub", F.ceil(F.col("np") / BLOCK).cast("int").alias("bp"), F.ceil(F.col("ni") / BLOCK).cast("int").alias("bi")), "jaccard-mixed")
        full = placed.join(mixed, "hub").join(info, "node")
        mine = F.pmod(F.xxhash64("node"), F.when(F.col("probe") == 1, F.col("bp")).otherwise(F.col("bi"))).cast("int")
        full = full.withColumn("mine", mine).withColumn("theirs", F.explode(F.sequence(F.lit(0), F.when(F.col("probe") == 1, F.col("bi")).otherwise(F.col("bp")) - 1)))
        full = full.select("hub", "probe", "node", "n", "comp", "sketch", F.when(F.col("probe") == 1, F.col("mine")).otherwise(F.col("theirs")).alias("x"), F.when(F.col("probe") == 1, F.col("theirs")).otherwise(F.col("mine")).alias("y"))
        pairs, p_pairs = materialize(full.groupBy("hub", "x", "y").applyInArrow(_apart(first, last), "a long, b long").distinct(), "jaccard-pairs")
        more, p_more = materialize(verified(pairs.filter("a IS NOT NULL"), packed), "jaccard-more")
        edges, old = edges.unionByName(more), [*old, p_more]
        left = not pairs.filter("a IS NULL").isEmpty()
        discard(spark, p_pairs, p_mixed)
        if not left:
            break
        first, last = last, 16 * last
    found, _ = components(edges)
    discard(spark, p_probes, p_index, p_packed, p_near, p_members, p_info, p_hubs, *old)
    return known.select("id", F.col("own_n").alias("n"), "node"), found


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id_col (long), n_shingles, component_id of every document with an id.

    Words are taken with A-Z in lower case; a set holds the distinct SHINGLE-word shingles, or the whole text where it has
    fewer words. Null and blank texts have the empty set and link with nothing; very long texts are read whole. Rows with a
    null id are left out, as no row can name them. Rows that share an id, repeated rows among them, give a row each with
    the size of its own set; the largest of their sets, then the one of the largest hash, stands for the id in links, and
    all of them have its component. Equal sets link. Ids must be numbers; an empty table gives an empty result. `docs`
    should be read from files or a written table, whose rows come in one order however often a task runs.
    """
    known, found = links(docs, id_col, text_col)
    joined = known.join(found, "node", "left")
    return joined.select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), F.coalesce("component", "node", "id").alias("component_id"))


def keep_first(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of `docs`, columns unchanged, without documents whose component has a smaller id; null ids stay."""
    (gone,) = fresh(docs, "_gone")
    found = near_duplicates(docs, id_col, text_col).filter(F.col(id_col) != F.col("component_id")).select(F.col(id_col).alias(gone)).distinct()
    return docs.join(found, docs[id_col] == found[gone], "left_anti")
