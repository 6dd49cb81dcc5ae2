"""Hard negatives against all products in loops, and the trees' bounds and pruning."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from pactlake.llm import hard_negatives as hn

SCHEMA = "vec_id long, embedding array<double>, label int"


def brute(rows, every=5, positives=5, negatives=3, noise=None):
    held = {}
    for i, x, label in rows:
        if i is None or label is None or x is None or any(c is None or not math.isfinite(c) for c in x):
            continue
        label = (label + 1) % 10 if noise and i % noise == 0 else label
        v = (label, [math.floor(256 * c) for c in x])
        held[i] = min(held.get(i, v), v)
    out = []
    for a, (la, va) in held.items():
        if a % every:
            continue
        score = {b: sum(p * q for p, q in zip(va, vb)) for b, (_, vb) in held.items() if b != a and len(vb) == len(va)}
        first = sorted((-s, b) for b, s in score.items() if held[b][0] == la)[:positives]
        for s, p in first:
            s = -s
            hard = sorted((-n, b) for b, n in score.items() if held[b][0] != la and 50 * s <= 100 * n <= 95 * s)[:negatives]
            out += [(a, p, r + 1, b, s, -n) for r, (n, b) in enumerate(hard)]
    return sorted(out)


def clustered(n, d=6, seed=1, labels=4):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(5, d))
    rows = []
    for i in range(n):
        x = centres[rng.integers(5)] + rng.normal(size=d) * rng.choice([0.0, 0.1, 0.6])
        rows.append((i, np.round(x, 2).tolist(), int(rng.integers(labels)) if i % 3 else 1))  # a third and more of one label
    return rows


def mined(spark, rows, **how):
    df = spark.createDataFrame(rows, SCHEMA)
    found = hn.mine(df.withColumn("bucket", F.lit("x")).withColumn("slot", F.lit(1)), every=5, **how)
    assert found.columns == ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]
    return sorted(map(tuple, found.collect()))


@pytest.mark.parametrize("sizes", [{}, {"cell": 400, "block": 100}])
def test_equals_all_products(spark, sizes):
    rows = clustered(400)
    want = brute(rows, noise=7)
    assert len(want) > 300
    assert mined(spark, rows, noise=7, **sizes) == want


def test_odd_rows(spark):
    rows = clustered(120, seed=2)
    rows += [(None, [1.0] * 6, 1), (200, None, 1), (205, [1.0, None, 0.0, 0.0, 0.0, 0.0], 1), (210, [float("nan")] * 6, 2), (215, [float("inf")] * 6, 2), (220, [0.5] * 6, None)]
    rows += [(225, [], 1), (230, [], 2), (231, [], 1), (235, [0.0] * 6, 1), (240, [0.3, 0.4], 1), (241, [0.3, 0.4], 1), (242, [0.2, 0.3], 2), (243, [0.2, 0.3], 0)]
    rows += [rows[10], rows[10], (12, rows[10][1], 3), (-5, rows[10][1], 1), (-10, rows[11][1], 2)]
    want = brute(rows)
    assert {240, -5, -10, 225} <= {r[0] for r in want}
    assert mined(spark, rows) == want


def test_large_components_stay_exact(spark):
    rng = np.random.default_rng(4)
    rows = [(i, (rng.integers(-(1 << 20), 1 << 20, 5) + rng.integers(0, 256, 5) / 256).tolist(), i % 3) for i in range(150)]
    assert mined(spark, rows) == brute(rows)


def test_empty_and_no_anchor(spark):
    assert mined(spark, []) == []
    assert mined(spark, [(1, [1.0], 0), (2, [1.0], 1)]) == []
    assert mined(spark, [(5, [1.0], 0)]) == []


def test_bounds_hold_and_prune():
    rng = np.random.default_rng(7)
    centres = rng.normal(size=(40, 8)) * 3
    x = np.floor(256 * (centres[rng.integers(40, size=6000)] + 0.1 * rng.normal(size=(6000, 8))))
    q, ids, labels = x[::60], np.arange(6000), rng.integers(0, 5, 6000)
    tree = hn.BallTree(x, ids, labels)
    norm = np.sqrt(np.square(q).sum(1))

    def under(node):
        return np.concatenate([under(c) for c in tree.below[node]]) if isinstance(tree.below[node], list) else tree.below[node]

    for node in range(len(tree.centre)):
        s = q @ x[under(node)].T
        top, bottom = tree.live(node, np.arange(len(q)), q, norm)
        assert (s.max(1) <= top).all() and (s.min(1) >= bottom).all()
    own = np.square(q).sum(1).astype(np.int64)
    low, high = hn.windows(own[:, None], 50, 95, 100)
    score, found = tree.search(q, ids[::60], labels[::60], low, high, 3, same=False)
    assert tree.products < 0.6 * len(q) * len(x)
    for i in range(len(q)):
        s = (x @ q[i]).astype(np.int64)
        fit = sorted((-s[j], j) for j in range(6000) if labels[j] != labels[60 * i] and low[i, 0] <= s[j] <= high[i, 0])[:3]
        assert [(-a, b) for a, b in zip(score[i, 0].tolist(), found[i, 0].tolist()) if a > hn.NONE] == fit


def test_windows_are_the_integers_between():
    p = np.array([-7, -1, 0, 1, 2, 19, 20, 21, 10**15 + 1])
    low, high = hn.windows(p, 50, 95, 100)
    for x, a, b in zip(p.tolist(), low.tolist(), high.tolist()):
        assert 50 * x <= 100 * a and 50 * x > 100 * (a - 1)
        assert 100 * b <= 95 * x and 100 * (b + 1) > 95 * x
