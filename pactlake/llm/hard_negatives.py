"""Hard negatives by ball trees: branch and bound on inner products, per partition.

Vectors are scaled to integers, so scores are exact. Rows are dealt into cells of about CELL values; a cell's task builds a ball
tree over its rows (centre, radius and labels of every node) and sends a block of anchors through it at once. A node bounds
every inner product below it from above and below (centre product plus and minus norm times radius); an anchor leaves a node
whose bounds lie outside its score window, whose labels can't do, or whose upper bound lies strictly beneath its current k-th.
 1. Positives: the best rows of an anchor's own label. Cells hold few labels, so an anchor goes to the cells of its label.
 2. Negatives: for each positive a window of scores, searched in all cells; the five windows of an anchor share the products.
Each cell returns k rows a search at most, and Spark merges those of all cells. Anchors meet rows in blocks of anchors x cells:
nothing is broadcast, and no task holds more than one cell and one block. A hot label is dealt over many cells.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pactlake.llm.common import discard, materialize

#: Buckets that labels are hashed to; numbers in a cell's vectors and in those of a block of anchors, about.
BUCKETS, CELL, ANCHORS = 64, 1 << 20, 1 << 18
LEAF = 128
#: Of a row that holds no candidate.
NONE = np.iinfo(np.int64).min + 1
ROW = "id long, label long, v array<int>"


class BallTree:
    """Rows (n x d integers, as floats where products stay exact) under nested balls; leaves hold their rows by id."""

    def __init__(self, x: np.ndarray, ids: np.ndarray, labels: np.ndarray, leaf: int = LEAF) -> None:
        self.x, self.ids, self.labels = x, ids, labels
        self.centre: list[np.ndarray] = []
        self.radius: list[float] = []
        self.kinds: list[tuple[int, int]] = []
        self.below: list[list[int] | np.ndarray] = []
        todo = [(np.arange(len(x)), -1, 0)]
        while todo:
            rows, parent, side = todo.pop()
            points = self.x[rows].astype(np.float64)
            centre = points.mean(0)
            gap = np.sqrt(np.square(points - centre).sum(1))
            node = len(self.centre)
            self.centre.append(centre)
            self.radius.append(float(gap.max()))
            self.kinds.append((int(self.labels[rows].min()), int(self.labels[rows].max())))
            if parent >= 0:
                self.below[parent][side] = node
            if len(rows) <= leaf:
                self.below.append(rows[np.argsort(self.ids[rows], kind="stable")])
                continue
            self.below.append([0, 0])
            far = points[gap.argmax()]
            axis = far - points[np.square(points - far).sum(1).argmax()]  # between two points far apart
            order = np.argsort(points @ axis, kind="stable")
            half = len(rows) // 2
            todo += [(rows[order[:half]], node, 0), (rows[order[half:]], node, 1)]

    def search(self, q: np.ndarray, qid: np.ndarray, qlabel: np.ndarray, low: np.ndarray, high: np.ndarray, k: int, same: bool) -> tuple[np.ndarray, np.ndarray]:
        """(scores, ids) of the first k rows of each anchor and window, of the anchor's label or (not `same`) of others; NONE pads."""
        n, w = low.shape
        score, found = np.full((n, w, k), NONE), np.full((n, w, k), np.iinfo(np.int64).max)
        norm = np.sqrt(np.square(q.astype(np.float64)).sum(1))
        self.products = 0  # inner products with rows
        todo = [(0, np.arange(n), *self.live(0, np.arange(n), q, norm))]
        while todo:
            node, at, top, bottom = todo.pop()
            a, b = self.kinds[node]
            fit = (top[:, None] >= np.maximum(low[at], score[at, :, -1])) & (bottom[:, None] <= high[at])
            keep = fit.any(1) & (((a <= qlabel[at]) & (qlabel[at] <= b)) if same else ~((a == b) & (qlabel[at] == a)))
            at = at[keep]
            if not len(at):
                continue
            below = self.below[node]
            if isinstance(below, np.ndarray):
                self._leaf(below, at, q, qid, qlabel, low, high, score, found, same)
                continue
            bounds = [(c, at, *self.live(c, at, q, norm)) for c in below]
            todo += sorted(bounds, key=lambda x: x[2].sum())  # the nearer child is popped first
        return score, found

    def live(self, node: int, at: np.ndarray, q: np.ndarray, norm: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Upper and lower bounds of the anchors' products below a node, wide enough for rounding."""
        middle = q[at].astype(np.float64) @ self.centre[node]
        reach = norm[at] * (self.radius[node] * (1 + 1e-9) + 1e-9 * (1 + float(np.sqrt(np.square(self.centre[node]).sum()))))
        return middle + reach, middle - reach

    def _leaf(self, rows, at, q, qid, qlabel, low, high, score, found, same) -> None:
        k = score.shape[2]
        s = (q[at] @ self.x[rows].T).astype(np.int64)
        self.products += s.size
        fine = (self.labels[rows] == qlabel[at][:, None]) == same
        fine &= self.ids[rows] != qid[at][:, None]
        for w in range(low.shape[1]):
            some = np.where(fine & (s >= low[at, w][:, None]) & (s <= high[at, w][:, None]), s, NONE)
            best = some.max(1)
            on = np.flatnonzero((best > NONE) & (best >= score[at, w, -1]))
            if not len(on):
                continue
            new_s, new_i = np.full((len(on), k), NONE), np.full((len(on), k), np.iinfo(np.int64).max)
            some = some[on]
            for j in range(k):  # rows of a leaf stand by id, so the first of equal scores has the smallest
                best = some.argmax(1)
                new_s[:, j] = some[np.arange(len(on)), best]
                new_i[:, j] = np.where(new_s[:, j] > NONE, self.ids[rows[best]], np.iinfo(np.int64).max)
                some[np.arange(len(on)), best] = NONE
            all_s, all_i = np.concatenate([score[at[on], w], new_s], 1), np.concatenate([found[at[on], w], new_i], 1)
            order = np.lexsort((all_i, -all_s), axis=1)[:, :k]
            score[at[on], w], found[at[on], w] = np.take_along_axis(all_s, order, 1), np.take_along_axis(all_i, order, 1)


def _matrix(column) -> np.ndarray:
    return column.combine_chunks().flatten().to_numpy(zero_copy_only=False).astype(np.int64).reshape(len(column), -1)


def exact(x: np.ndarray, q: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Both as floats, where all sums of products stay below 2^53, else as they are."""
    most = int(np.abs(x).max(initial=0)) * int(np.abs(q).max(initial=0)) * max(1, x.shape[1])
    return (x.astype(np.float64), q.astype(np.float64)) if most < 1 << 53 else (x, q)


def windows(positive: np.ndarray, lowest: int, highest: int, scale: int) -> tuple[np.ndarray, np.ndarray]:
    """Smallest and largest integer score with lowest * p <= scale * score <= highest * p."""
    p = positive.astype(object)
    return (-(-p * lowest // scale)).astype(np.int64), (p * highest // scale).astype(np.int64)


def _search(k: int, window: tuple[int, int, int] | None):
    """One cell's rows and a block of anchors -> anchor, slot, other, score. Without `window`: positives."""

    def run(data, anchors):
        import pyarrow as pa

        out = {"anchor": [], "slot": [], "other": [], "score": []}
        if not data.num_rows or not anchors.num_rows:
            return pa.table({c: pa.array([], pa.int64()) for c in out})
        sizes, lengths = (c.combine_chunks().value_lengths().to_numpy() for c in (data.column("v"), anchors.column("q_v")))
        for d in np.intersect1d(sizes, lengths):
            rows, asked = data.take(np.flatnonzero(sizes == d)), anchors.take(np.flatnonzero(lengths == d))
            x, q = exact(_matrix(rows.column("v")) if d else np.zeros((rows.num_rows, 0), np.int64), _matrix(asked.column("q_v")) if d else np.zeros((asked.num_rows, 0), np.int64))
            tree = BallTree(x, rows.column("id").to_numpy(), rows.column("label").to_numpy())
            qid, qlabel = asked.column("q_id").to_numpy(), asked.column("q_label").to_numpy()
            if window is None:
                low, high = np.full((len(qid), 1), NONE + 1), np.full((len(qid), 1), np.iinfo(np.int64).max)
            else:
                held = asked.column("q_scores").to_pylist()
                w = max(map(len, held))
                p = np.array([[*s, *[0] * (w - len(s))] for s in held], np.int64)
                low, high = windows(p, *window)
                low[np.arange(w) >= np.array([len(s) for s in held])[:, None]] = np.iinfo(np.int64).max  # no such positive
            score, found = tree.search(q, qid, qlabel, low, high, k, window is None)
            i, j, m = np.nonzero(score > NONE)
            for c, v in zip(out.values(), (qid[i], j, found[i, j, m], score[i, j, m]), strict=True):
                c.append(v)
        return pa.table({c: pa.array(np.concatenate(v) if v else np.zeros(0, np.int64), pa.int64()) for c, v in out.items()})

    return run


def prepare(vectors: DataFrame, id_col: str, vector_col: str, label_col: str, noise: int | None, labels: int) -> DataFrame:
    """Rows that take part: id, label, v = floor(256 * component), one row an id."""
    v = F.col(vector_col).cast("array<double>")
    # Beyond these bounds an inner product may not fit a long.
    fine = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < 2.0**23))
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(label_col).cast("long").alias("label"), v.alias("v"))
    rows = rows.filter(F.col("id").isNotNull() & F.col("label").isNotNull() & F.coalesce(fine, F.lit(False)))
    rows = rows.withColumn("v", F.transform("v", lambda x: F.floor(256 * x).cast("int"))).filter(F.aggregate("v", F.lit(0.0), lambda s, x: s + x.cast("double") * x) < 2.0**62)
    if noise:
        rows = rows.withColumn("label", F.when(F.col("id") % noise == 0, F.pmod(F.col("label") + 1, F.lit(labels))).otherwise(F.col("label")))
    one = F.min(F.struct("label", "v"))
    return rows.groupBy("id").agg(one.alias("r")).select("id", "r.label", "r.v")


def mine(
    vectors: DataFrame, every: int = 50, positives: int = 5, negatives: int = 3, window: tuple[int, int, int] = (50, 95, 100),
    id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", noise: int | None = None, labels: int = 10, cell: int = CELL, block: int = ANCHORS,
) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score of every anchor (ids divisible by `every`).

    Components become floor(256 * x); scores are inner products of these, higher ones first, ties by smaller id. Positives
    are the first `positives` other rows of the anchor's label, negatives the first `negatives` rows of other labels with
    window[0] * positive <= window[2] * negative <= window[1] * positive. With `noise`, rows whose id it divides first move
    to the next of `labels` labels. Rows with a null id or label, a null vector, or a null or non-finite component take no
    part, nor do those with a component of 2^23 or more or an integer norm of 2^31 or more, whose scores a long may not
    hold. Rows that share an id count once: the one with the smallest label, then vector. Vectors meet only others of their
    length; empty and zero vectors score 0. Anchors without positives or negatives give no row; an empty table gives an
    empty result. Other columns are not read.
    """
    spark = vectors.sparkSession
    found = prepare(vectors, id_col, vector_col, label_col, noise, labels).withColumn("bucket", F.pmod(F.xxhash64("label"), F.lit(BUCKETS)).cast("int"))
    rows, p_rows = materialize(found, "negative-rows")
    anchor = F.col("id") % every == 0
    sizes = {r["bucket"]: r for r in rows.groupBy("bucket").agg(F.sum(F.size("v") + 1).alias("values"), F.sum(F.when(anchor, F.size("v") + 1).otherwise(0)).alias("asked")).collect()}
    lay = lambda name, limit: [max(1, -(-sizes[b][name] // limit)) if b in sizes else 0 for b in range(BUCKETS)]
    parts, blocks = lay("values", cell), lay("asked", block)
    whole = max(1, -(-sum(r["asked"] for r in sizes.values()) // block))
    per = lambda sizes: F.element_at(F.array(*map(F.lit, sizes)), F.col("bucket") + 1)
    part, spread = F.pmod(F.xxhash64("id"), per(parts)).cast("int"), lambda n: F.pmod(F.xxhash64("id", F.lit(7)), n).cast("int")
    numbers = lambda n: F.explode(F.sequence(F.lit(0), n - 1))
    key = ["bucket", "part", "block"]
    out = "anchor long, slot long, other long, score long"

    def searched(data: DataFrame, asked: DataFrame, k: int, window) -> DataFrame:
        names = [c for c in ("id", "label", "v", "scores") if c in asked.columns]
        asked = asked.select([F.col(c).alias(f"q_{c}") for c in [*key, *names]])  # both sides come from one table
        return data.select(*key, "id", "label", "v").groupBy(key).cogroup(asked.groupBy([f"q_{c}" for c in key])).applyInArrow(_search(k, window), out)

    dealt = rows.withColumn("part", part)
    asked = rows.filter(anchor)
    near = searched(dealt.withColumn("block", numbers(per(blocks))), asked.withColumn("block", spread(per(blocks))).withColumn("part", numbers(per(parts))), positives, None)
    order = Window.partitionBy("anchor").orderBy(F.desc("score"), "other")
    near, _ = materialize(near.withColumn("slot", F.row_number().over(order) - 1).filter(F.col("slot") < positives).select("anchor", F.col("slot").cast("long"), "other", "score"), "negative-positives")
    held = near.groupBy("anchor").agg(F.array_sort(F.collect_list(F.struct("slot", "score"))).alias("s")).select(F.col("anchor").alias("id"), F.col("s.score").alias("scores"))
    cells = F.explode(F.array(*[F.struct(F.lit(b).alias("bucket"), F.lit(n).alias("parts")) for b, n in enumerate(parts) if n])) if sizes else F.explode(F.array().cast("array<struct<bucket:int,parts:int>>"))
    asked = asked.drop("bucket").join(held, "id").withColumn("block", spread(F.lit(whole))).withColumn("at", cells)
    asked = asked.select("id", "label", "v", "scores", "block", "at.bucket", numbers(F.col("at.parts")).alias("part"))
    far = searched(dealt.withColumn("block", numbers(F.lit(whole))), asked, negatives, window)
    order = Window.partitionBy("anchor", "slot").orderBy(F.desc("score"), "other")
    far, _ = materialize(far.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= negatives), "negative-found")
    near = near.select("anchor", "slot", F.col("other").alias("positive_id"), F.col("score").alias("positive_score"))
    both = far.join(near, ["anchor", "slot"])
    discard(spark, p_rows)
    return both.select(F.col("anchor").alias("anchor_id"), "positive_id", "rank", F.col("other").alias("negative_id"), "positive_score", F.col("score").alias("negative_score"))
