"""Keys that documents with negative ids hold, in several portions."""

import random

import numpy as np
import pyarrow as pa
from tests.llm.test_joins import edited

from pactlake.llm import jaccard_join


def _portion(keys, doc):
    """A bucket's portion as _shared_keys reads it: planes of keys, roles, planes of documents."""
    n = len(keys)
    plane = lambda values, width: b"".join(((np.array(values, np.int64).view(np.uint64) >> np.uint64(8 * i)) & np.uint64(255)).astype(np.uint8).tobytes() for i in range(width))
    return plane(keys, jaccard_join.SUB // 8) + bytes([jaccard_join.BOTH]) * n + plane([doc] * n, 8)


def test_a_negative_id_and_a_later_portion_share_a_key():
    keys = [3, 70, 999]
    for a, b in ((-5, 8), (8, -5), (-5, -1), (-1, 8), (4, 8)):
        t = pa.table({"bucket": pa.array([0, 0], pa.int64()), "data": pa.array([_portion(keys, a), _portion(keys, b)], pa.binary())})
        got = jaccard_join._shared_keys(t)
        assert sorted(zip(got["doc"].to_pylist(), got["key"].to_pylist())) == sorted((d, k) for d in (a, b) for k in keys), (a, b)


def test_links_of_negative_ids(spark):
    rng = random.Random(4)
    base = ["w" + str(i) for i in range(60)]
    rows = [(i - 20, " ".join(edited(rng, base, i % 2))) for i in range(40)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(8)
    assert {r["component_id"] for r in jaccard_join.near_duplicates(docs).collect()} == {-20}
