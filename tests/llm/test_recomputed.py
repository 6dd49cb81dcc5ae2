"""A map task that runs again sends every row to the bucket it went to before, and results survive lost shuffle files."""

import numpy as np
import pyarrow as pa

from pactlake.llm import jaccard_join, substring_dedup


def batch(texts):
    return pa.RecordBatch.from_arrays([pa.array(range(len(texts)), pa.int64()), pa.array(texts)], names=["id", "text"])


def rows(make, *batches):
    return [tuple(r.values()) for b in make(iter(batches)) for r in b.to_pylist()]


def test_rows_of_a_portion_follow_from_its_content(monkeypatch):
    monkeypatch.setattr(jaccard_join, "CROWD", 4)
    rng = np.random.default_rng(1)
    common = " ".join(f"w{x}" for x in rng.integers(0, 50, 60))
    texts = [common + f" tail{i}" for i in range(40)] + [common] * 3 + [" ".join(f"v{x}" for x in rng.integers(0, 900, 80)) for _ in range(20)]
    for make in (jaccard_join._key_rows(8), substring_dedup._anchor_rows(8)):
        first = rows(make, batch(texts))
        assert any(r[0] < 0 for r in first)
        assert first == rows(make, batch(texts))
    blocks = pa.array([list(range(len(t.split()) // 7)) for t in texts], pa.list_(pa.int32()))
    held = pa.RecordBatch.from_arrays([*batch(texts).columns, blocks], names=["id", "text", "blocks"])
    make = substring_dedup._window_rows(8)
    first = rows(make, held)
    assert any(r[0] < 0 for r in first)
    assert first == rows(make, held)


def test_portions_of_other_content_go_elsewhere():
    a, b = np.arange(9), np.arange(9) + 1
    assert substring_dedup.own_bucket(a) == substring_dedup.own_bucket(a.copy()) < 0
    assert len({substring_dedup.own_bucket(x) for x in (a, b, a[:5])}) == 3


def test_rows_that_share_an_id(spark):
    base = " ".join(f"a{i}" for i in range(60))
    near, other, near_other = base + " x", " ".join(f"b{i}" for i in range(90)), " ".join(f"b{i}" for i in range(89))
    docs = spark.createDataFrame([(1, base), (1, other), (2, near), (3, near_other), (3, near_other), (4, base)], "doc_id long, text string")
    found = sorted(map(tuple, jaccard_join.near_duplicates(docs).collect()))
    # The larger set stands for 1: it links with 3, while 2 and 4 link with each other.
    assert found == [(1, 56, 1), (1, 86, 1), (2, 57, 2), (3, 85, 1), (3, 85, 1), (4, 56, 2)]
