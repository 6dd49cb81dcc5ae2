"""Embedding near-duplicates by collision-counting projections.

Unit vectors are projected on many random directions. Two vectors at the cosine threshold lie within HALF = Z * distance of
each other on one direction with probability P1: that is a collision of the window [t - HALF, t + HALF] around the one with
the other. Pairs that collide on enough of COUNTED directions, a count that linked pairs reach with probability `recall`, are
verified by cosine in double precision.

 - One sorted projection is of little use alone: at a cosine of 0.98 its window holds a third of all vectors. So further
   directions, in groups of `directions`, cut the sorted lists into ranges WIDTH distances wide, each group from its own
   random start: vectors that share all ranges of a group stand in one cell. In a cell the vectors are sorted by one counted
   projection, the window around each gives its pairs, and these count their collisions on all counted directions.
 - Only ids and cells travel at first. Cells of one vector, which nearly all are, end there; what others need of a vector (its
   counted projections and the marks of its cells) joins them, and vectors only the pairs that reach the count.
 - Groups and count follow from `recall`: a pair at the threshold shares a cell and a window in one of the groups, and then
   reaches the count, with that probability; nearer pairs more often. `directions` follows from the largest label, so that
   about MATES vectors share a cell by chance: it changes what a run costs, never the recall it has. Groups grow with the
   logarithm of a label's size, and meetings by chance stay in proportion to it.
 - Nothing is capped: a cell of many vectors is dealt out as blocks of BLOCK x BLOCK, and a verified block returns sums and
   a spanning forest, never its pairs.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pactlake.llm.common import discard, materialize, text_buffer
from pactlake.llm.components import components

Z, RECALL, BLOCK, SEED = 2.0, 0.9999, 1024, 5
#: Directions whose collisions are counted, width of a range in distances at the threshold, and vectors a cell by chance.
COUNTED, WIDTH, MATES = 24, 5.0, 8
#: Queries whose windows are looked at together, vectors of a cell that is not a task's group of its own, and rows of such cells
#: that are.
STRIP, SMALL, BUNDLE = 128, 128, 40_000
#: Pairs that are counted at once.
PAIRS = 1 << 17


def _same_range(width: float, window: float = math.inf) -> float:
    """Probability that two values a standard normal apart share a range of this width that starts anywhere, within a window."""
    w = min(width, window)
    inside = math.erf(w / math.sqrt(2))
    mean = math.sqrt(2 / math.pi) * (1 - math.exp(-w * w / 2))
    return inside - mean / width


class Projections:
    """Directions for vectors of one length, made from the seed wherever they are needed."""

    def __init__(self, cosine: float, largest: int, recall: float = RECALL, directions: int | None = None) -> None:
        self.cosine = cosine
        distance = max(math.sqrt(max(2 - 2 * cosine, 0.0)), 1e-6)
        self.half, self.width = Z * distance, WIDTH * distance
        #: Probability that unrelated vectors share a range.
        self.chance = _same_range(self.width / math.sqrt(2))
        self.g = directions or min(16, max(2, math.ceil(math.log(max(1.0, largest / MATES)) / -math.log(self.chance))))
        p1, miss = math.erf(Z / math.sqrt(2)), (1 - recall) / 2
        self.groups = max(1, math.ceil(math.log(miss) / math.log(1 - _same_range(WIDTH) ** self.g * p1)))
        tail, self.least = 0.0, 0
        for k in range(COUNTED, -1, -1):  # the largest count that linked pairs reach but for `miss`
            tail += math.comb(COUNTED, k) * p1**k * (1 - p1) ** (COUNTED - k)
            if tail >= 1 - miss:
                self.least = k
                break
        self.axes: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]] = {}

    def of(self, unit: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(counted projections, ranges by group and direction) of unit vectors."""
        d = unit.shape[1]
        if d not in self.axes:
            rng = np.random.default_rng((SEED, d))
            n = self.g * self.groups
            self.axes[d] = rng.normal(size=(d, COUNTED)), rng.normal(size=(d, n)), rng.random(n)
        count, cut, start = self.axes[d]
        return unit @ count, np.floor(unit @ cut / self.width + start).astype(np.int64).reshape(len(unit), self.groups, self.g)


def unit_vectors(values: np.ndarray, n: int) -> np.ndarray:
    x = values.astype(np.float64).reshape(n, -1)
    return x / np.sqrt(np.einsum("ij,ij->i", x, x))[:, None]


def _cells(ranges: np.ndarray, kind: np.ndarray, d: int) -> np.ndarray:
    """64-bit cell of each vector in each group, of its class and length."""
    groups = np.arange(ranges.shape[1], dtype=np.uint64)
    h = (kind.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15))[:, None] + groups * np.uint64(1_000_003) + np.uint64(d)
    for i in range(ranges.shape[2]):
        h = (h ^ (h >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9) + ranges[:, :, i].view(np.uint64)
    return h ^ (h >> np.uint64(32))


def _rows(proj: Projections, points: bool):
    """(rid, class, vector) -> rows cell, group, rid of all groups; or (points) rid, class, at (counted projections in single
    precision) and marks (the low halves of its cells)."""

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            for at in range(0, batch.num_rows, 1024):
                part = batch.slice(at, 1024)
                size = part.column(2).value_lengths().to_numpy()
                kind = part.column(1).to_numpy(zero_copy_only=False).astype(np.int64)
                for d in np.unique(size):
                    rows = np.flatnonzero(size == d)
                    sub = part.take(pa.array(rows))
                    count, ranges = proj.of(unit_vectors(sub.column(2).flatten().to_numpy(zero_copy_only=False), len(rows)))
                    cells = _cells(ranges, kind[rows], int(d))
                    if points:
                        near, marks = count.astype(np.float32), (cells & np.uint64(0xFFFFFFFF)).astype("<u4")
                        yield pa.RecordBatch.from_arrays([sub.column(0), sub.column(1), pa.array([x.tobytes() for x in near], pa.binary()), pa.array([x.tobytes() for x in marks], pa.binary())], names=["rid", "class", "at", "marks"])
                    else:
                        group = np.tile(np.arange(proj.groups, dtype=np.int32), len(rows))
                        yield pa.RecordBatch.from_arrays([pa.array(cells.ravel().view(np.int64)), pa.array(group), sub.column(0).take(pa.array(np.repeat(np.arange(len(rows)), proj.groups)))], names=["cell", "group", "rid"])

    return run


def _array(column, kind, n: int) -> np.ndarray:
    buf, off = text_buffer(column)
    return np.frombuffer(buf[off[0] : off[-1]].tobytes(), kind).reshape(n, -1)


BLOCKS = "cell long, x int, y int, q array<long>, v array<long>, pairs binary"


def _block_schema():
    import pyarrow as pa

    return pa.schema([("cell", pa.int64()), ("x", pa.int32()), ("y", pa.int32()), ("q", pa.list_(pa.int64())), ("v", pa.list_(pa.int64())), ("pairs", pa.binary())])


def _small_cells(proj: Projections):
    """Many small cells -> the blocks of _collisions for those with a pair that reaches the count."""

    def run(t):
        import pyarrow as pa

        cell, rid, kind, group = (t.column(c).to_numpy() for c in ("cell", "rid", "class", "group"))
        p, marks = _array(t.column("at"), np.float32, t.num_rows), _array(t.column("marks"), "<u4", t.num_rows)
        line = p[np.arange(len(p)), group % COUNTED].astype(np.float64)
        order = np.lexsort((line, cell))
        cell, rid, kind, group, p, marks, line = (x[order] for x in (cell, rid, kind, group, p, marks, line))
        # One line of all cells, each far from the next: a window then ends within its cell.
        rank = np.cumsum(np.concatenate([[False], cell[1:] != cell[:-1]]))
        spot = line - line.min() + rank * (np.ptp(line) + 2 * proj.half + 1)
        n = np.searchsorted(spot, spot + proj.half + 1e-6, "right") - np.arange(len(spot)) - 1
        upto = np.cumsum(n)
        found, at = [], 0
        while at < len(n):
            to = max(at + 1, int(np.searchsorted(upto, (upto[at - 1] if at else 0) + PAIRS, "right")))
            m = n[at:to]
            r = np.repeat(np.arange(at, to), m)
            c = np.arange(len(r)) - np.repeat(np.cumsum(m) - m, m) + r + 1
            near = np.abs(p[r] - p[c]) <= proj.half
            on = (near.sum(1, dtype=np.uint8) >= proj.least) & near[np.arange(len(r)), group[r] % COUNTED] & (kind[r] == kind[c])
            r, c, near = r[on], c[on], near[on]
            earlier = np.arange(proj.groups) < group[r][:, None]
            met = earlier & (marks[r] == marks[c]) & near[:, np.arange(proj.groups) % COUNTED]
            on = ~met.any(1)
            found.append((r[on], c[on]))
            at = to
        r, c = (np.concatenate(x) for x in zip(*found, strict=True))
        rows = []
        for a, b in zip(*_stretches(rank[r]), strict=True):
            (qs, i), (vs, j) = np.unique(r[a:b], return_inverse=True), np.unique(c[a:b], return_inverse=True)
            bits = np.zeros((len(qs), len(vs)), bool)
            bits[i, j] = True
            rows.append((int(cell[qs[0]]), 0, 0, rid[qs], rid[vs], np.packbits(bits).tobytes()))
        schema = _block_schema()
        return pa.table([pa.array(x, f.type) for x, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema) if rows else schema.empty_table()

    return run


def _stretches(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Beginnings and ends of runs of equal values."""
    cut = np.flatnonzero(values[1:] != values[:-1]) + 1
    return (np.concatenate([[0], cut]), np.append(cut, len(values))) if len(values) else (cut, cut)


def _collisions(proj: Projections):
    """Rows of one block of one cell -> cell, x, y, q, v, pairs: vectors that have a pair which reaches the count, and a bit for
    each of their pairs; a pair stands once. No row where there is none."""

    def run(t):
        import pyarrow as pa

        schema = _block_schema()
        x, y, j = (t.column(c)[0].as_py() for c in ("x", "y", "group"))
        rid, kind, mine = (t.column(c).to_numpy() for c in ("rid", "class", "mine"))
        p, marks = _array(t.column("at"), np.float32, t.num_rows), _array(t.column("marks"), "<u4", t.num_rows)
        line = p[:, j % COUNTED]
        order = np.argsort(line, kind="stable")
        qi, vi = (order, order) if x == y else (order[mine[order] == x], order[mine[order] == y])
        if not len(qi) or not len(vi):
            return schema.empty_table()
        below, above = np.searchsorted(line[vi], line[qi] - proj.half), np.searchsorted(line[vi], line[qi] + proj.half, "right")
        bits = np.zeros((len(qi), len(vi)), bool)
        for lo in range(0, len(qi), STRIP):  # neighbours in the order of the line share most of their windows
            hi = min(lo + STRIP, len(qi))
            a, b = int(below[lo]), int(above[hi - 1])
            if x == y:
                a = max(a, lo + 1)
            if a >= b:
                continue
            q, v = qi[lo:hi], vi[a:b]
            near = np.abs(p[q].T[:, :, None] - p[v].T[:, None]) <= proj.half  # direction x query x vector
            on = near[j % COUNTED] & (near.sum(0, dtype=np.uint8) >= proj.least) & (kind[q][:, None] == kind[v])
            if x == y:
                on &= np.arange(lo, hi)[:, None] < np.arange(a, b)
            for k in range(j):  # pairs that met in a group before this one go
                if not on.any():
                    break
                on &= ~((marks[q, k][:, None] == marks[v, k]) & near[k % COUNTED])
            bits[lo:hi, a:b] = on
        qs, vs = np.flatnonzero(bits.any(1)), np.flatnonzero(bits.any(0))
        if not len(qs):
            return schema.empty_table()
        bits = bits[np.ix_(qs, vs)]
        row = {"cell": [t.column("cell")[0].as_py()], "x": [x], "y": [y], "q": [rid[qi[qs]]], "v": [rid[vi[vs]]], "pairs": [np.packbits(bits).tobytes()]}
        return pa.table(row, schema=schema)

    return run


def forest(linked: np.ndarray, q: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Smallest id reachable within the block, for its queries and its vectors."""
    a, b = q.copy(), v.copy()
    big = np.iinfo(np.int64).max
    rows, cols = np.nonzero(linked)
    if not len(rows):
        return a, b
    while True:
        a2, b2 = a.copy(), b.copy()
        np.minimum.at(a2, rows, b[cols])
        np.minimum.at(b2, cols, a2[rows])
        # The same vector may stand on both sides.
        ids, where = np.unique(np.concatenate([q, v]), return_inverse=True)
        low = np.full(len(ids), big)
        np.minimum.at(low, where, np.concatenate([a2, b2]))
        a2, b2 = low[where[: len(q)]], low[where[len(q) :]]
        if (a2 == a).all() and (b2 == b).all():
            return a, b
        a, b = a2, b2


def _verified(cosine: float):
    """One block's pairs and its members' vectors -> node, links, other: verified links of each vector, and forest edges."""

    def run(block, members):
        import pyarrow as pa

        schema = pa.schema([("node", pa.int64()), ("links", pa.int64()), ("other", pa.int64())])
        if not block.num_rows:
            return schema.empty_table()
        q, v = (np.array(block.column(k)[0].as_py()) for k in ("q", "v"))
        keep = np.unpackbits(np.frombuffer(block.column("pairs")[0].as_py(), np.uint8), count=len(q) * len(v)).reshape(len(q), len(v)).astype(bool)
        rid, copies = members.column("rid").to_numpy(), members.column("copies").to_numpy()
        size = members.column("vector").combine_chunks().value_lengths().to_numpy()
        x = np.zeros((len(rid), int(size.max())))  # vectors of one cell have one length, but for clashes of its hash
        x[np.arange(x.shape[1]) < size[:, None]] = members.column("vector").combine_chunks().flatten().to_numpy(zero_copy_only=False)
        x /= np.sqrt(np.einsum("ij,ij->i", x, x))[:, None]
        order = np.argsort(rid)
        qx, vx = (order[np.searchsorted(rid[order], k)] for k in (q, v))
        keep &= size[qx][:, None] == size[vx][None]
        for a in range(0, len(q), 256):
            r, c = np.nonzero(keep[a : a + 256])
            for i in range(0, len(r), 65536):
                rr, cc = r[i : i + 65536] + a, c[i : i + 65536]
                keep[rr, cc] = np.einsum("ij,ij->i", x[qx[rr]], x[vx[cc]]) >= cosine
        a, b = forest(keep, q, v)
        some, tied = keep.any(1), keep.any(0)
        links = np.concatenate([(keep @ copies[vx])[some], (copies[qx] @ keep)[tied]])
        return pa.table({"node": pa.array(np.concatenate([q[some], v[tied]]), pa.int64()), "links": pa.array(links, pa.int64()), "other": pa.array(np.concatenate([a[some], b[tied]]), pa.int64())}, schema=schema)

    return run


def near_duplicates(vectors: DataFrame, cosine: float = 0.98, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", directions: int | None = None, recall: float = RECALL) -> DataFrame:
    """id_col (long), n_links, component_id, kept of every row; each linked pair is found with probability `recall` or more.

    Rows are compared where their labels are equal and not null and their vectors have the same length. Vectors that are
    null, empty, zero or hold a null or non-finite component link with nothing. Equal vectors are compared once and count
    as often as they stand. Rows with a null id are left out, as no row can name them; rows that share an id, repeated rows
    among them, are vectors of their own under that id. Ids and labels must be integers. Other columns are not read; an empty
    table gives an empty result. `directions` is chosen by the largest label unless it is given.
    """
    spark = vectors.sparkSession
    rows = vectors.filter(F.col(id_col).isNotNull()).select(F.col(id_col).cast("long").alias("id"), F.col(label_col).cast("long").alias("class"), F.col(vector_col).cast("array<double>").alias("vector"))
    fine = F.forall("vector", lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf"))) & F.exists("vector", lambda v: v != 0)
    usable = F.coalesce(F.col("class").isNotNull() & fine, F.lit(False))
    keyed = rows.filter(usable).withColumns({"a": F.xxhash64("class", "vector"), "b": F.xxhash64(F.lit(1), "vector", "class")})
    reps = keyed.groupBy("a", "b").agg(F.min("id").alias("rid"), F.count("*").alias("copies"))
    reps, p_reps = materialize(reps, "emb-reps")
    same = keyed.select("id", "class", "vector", "a", "b").join(reps, ["a", "b"]).filter("id = rid").dropDuplicates(["a", "b"]).select("rid", "class", "copies", F.col("vector").cast("array<float>").alias("f"), "vector")
    exact = F.forall("vector", lambda v: v.cast("float").cast("double") == v)
    # Single precision travels where it holds the values exactly.
    narrow = same.agg(F.min(exact)).first()[0] is not False
    base, p_base = materialize(same.select("rid", "class", "copies", F.col("f").alias("vector") if narrow else F.col("vector")), "emb-base")
    largest = base.groupBy("class").count().agg(F.max("count")).first()[0] or 0
    proj = Projections(cosine, largest, recall, directions)
    slim = base.select("rid", "class", "vector")
    cells, p_cells = materialize(slim.mapInArrow(_rows(proj, False), "cell long, group int, rid long"), "emb-cells")
    # Cells of several vectors, with the blocks they are dealt into; written, so that the join may split a cell of very many.
    several, p_several = materialize(cells.groupBy("cell").agg(F.count("*").alias("n")).filter("n > 1"), "emb-several")
    points = slim.mapInArrow(_rows(proj, True), "rid long, class long, at binary, marks binary")
    # Small cells are dealt out in bundles, as a group of its own costs more than most of them hold.
    bundles = max(1, -(-(several.filter(F.col("n") <= SMALL).agg(F.sum("n")).first()[0] or 0) // BUNDLE))
    small = cells.join(several.filter(F.col("n") <= SMALL).select("cell"), "cell").join(points, "rid")
    small = small.select("cell", "group", "rid", "class", "at", "marks", F.pmod(F.xxhash64("cell"), F.lit(bundles)).alias("bundle"))
    few = small.groupBy("bundle").applyInArrow(_small_cells(proj), BLOCKS)
    large = several.filter(F.col("n") > SMALL).select("cell", F.ceil(F.col("n") / BLOCK).cast("int").alias("b"))
    dealt = cells.join(large, "cell").join(points, "rid").withColumn("mine", F.pmod(F.xxhash64("rid"), F.col("b")).cast("int"))
    # A block holds two parts of a cell; each vector goes to the blocks of its part with every other part and with itself.
    dealt = dealt.withColumn("theirs", F.explode(F.sequence(F.lit(0), F.col("b") - 1)))
    dealt = dealt.select("cell", "group", "rid", "class", "at", "marks", "mine", F.least("mine", "theirs").alias("x"), F.greatest("mine", "theirs").alias("y"))
    place = ["cell", "x", "y"]
    blocks, p_blocks = materialize(dealt.groupBy(place).applyInArrow(_collisions(proj), BLOCKS).unionByName(few), "emb-blocks")
    members = blocks.select(*place, F.explode(F.array_union("q", "v")).alias("rid")).join(base.select("rid", "copies", "vector"), "rid")
    members = members.select([F.col(c).alias(f"m_{c}") for c in place] + ["rid", "copies", "vector"])
    found, p_found = materialize(blocks.groupBy(place).cogroup(members.groupBy([f"m_{c}" for c in place])).applyInArrow(_verified(cosine), "node long, links long, other long"), "emb-links")
    comp, _ = components(found.select(F.col("node").alias("a"), F.col("other").alias("b")))
    links = found.groupBy("node").agg(F.sum("links").alias("links"))
    whole = reps.join(links, reps["rid"] == links["node"], "left").drop("node").join(comp, F.col("rid") == comp["node"], "left")
    per, _ = materialize(whole.select("a", "b", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"), F.coalesce("component", "rid").alias("component_id")), "emb-result")
    discard(spark, p_reps, p_base, p_cells, p_several, p_blocks, p_found)
    out = rows.withColumns({"a": F.when(usable, F.xxhash64("class", "vector")), "b": F.when(usable, F.xxhash64(F.lit(1), "vector", "class"))}).select("id", "a", "b").join(per, ["a", "b"], "left")
    comp_id = F.coalesce("component_id", "id")
    return out.select(F.col("id").alias(id_col), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), comp_id.alias("component_id"), (F.col("id") == comp_id).alias("kept"))
