"""Embedding cells: what meets, what is found, and how both follow from the parameters."""

import numpy as np
import pandas as pd
import pytest

from pactlake.llm import embedding_dedup as ed


def meetings(proj, x):
    """Share of ordered pairs that stand in one cell, summed over the groups."""
    _, ranges = proj.of(x)
    cells = ed._cells(ranges, np.zeros(len(x), np.int64), x.shape[1])
    return sum((np.unique(cells[:, j], return_counts=True)[1] ** 2).sum() - len(x) for j in range(proj.groups)) / len(x) ** 2


def units(rng, n, d=64):
    x = rng.normal(size=(n, d))
    return x / np.linalg.norm(x, axis=1)[:, None]


def test_unrelated_vectors_meet_as_rarely_as_the_formula_says():
    rng = np.random.default_rng(1)
    x = units(rng, 4000)
    for n in (10_000, 100_000):
        proj = ed.Projections(0.98, n)
        assert 0.5 < meetings(proj, x) / (proj.groups * proj.chance**proj.g) < 1.6
    share = {n: (p := ed.Projections(0.98, n)).groups * p.chance**p.g for n in (10_000, 100_000, 1_000_000)}
    assert share[10_000] < 0.01 and share[100_000] < 0.0015 and share[1_000_000] < 0.0005


@pytest.mark.parametrize("largest", [500, 50_000, 10**7])
def test_pairs_at_the_threshold_are_found_with_the_recall_asked_for(largest):
    rng = np.random.default_rng(2)
    proj = ed.Projections(0.98, largest, recall=0.99)
    a = units(rng, 3000)
    side = rng.normal(size=a.shape)
    side -= (side * a).sum(1)[:, None] * a
    b = 0.98 * a + np.sqrt(1 - 0.98**2) * side / np.linalg.norm(side, axis=1)[:, None]
    (p, ranges_a), (q, ranges_b) = proj.of(a), proj.of(b)
    near = np.abs(p - q) <= proj.half
    together = (ranges_a == ranges_b).all(2) & near[:, np.arange(proj.groups) % ed.COUNTED]
    found = together.any(1) & (near.sum(1) >= proj.least)
    assert found.mean() >= 0.985


def test_50000_vectors_against_all_cosines(spark):
    rng = np.random.default_rng(3)
    x = units(rng, 50_000, 32)
    label = rng.integers(0, 8, len(x))
    label[:16_000] = 3  # a third and more of one label
    for i in range(200):  # near copies of all degrees about the threshold, some in large groups
        at = rng.integers(0, len(x), 25 if i else 1500)
        x[at] = x[at[0]] + rng.normal(size=(len(at), 32)) * rng.choice([0.005, 0.015, 0.025])
        label[at] = label[at[0]]
    x = x.astype(np.float32)
    df = spark.createDataFrame(pd.DataFrame({"vec_id": np.arange(len(x)), "label": label, "embedding": list(x)}), "vec_id long, label int, embedding array<float>").repartition(8)
    got = ed.near_duplicates(df).toPandas().sort_values("vec_id")
    links = np.zeros(len(x), np.int64)
    for c in range(8):
        at = np.flatnonzero(label == c)
        u = ed.unit_vectors(x[at].ravel(), len(at))
        for a in range(0, len(at), 2048):
            links[at[a : a + 2048]] = (u[a : a + 2048] @ u.T >= 0.98).sum(1) - 1
    found = got["n_links"].to_numpy()
    assert (found <= links).all()
    assert found.sum() >= 0.9999 * links.sum() > 1_000_000
