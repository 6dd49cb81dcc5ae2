"""Anchors and windows over as many buckets as a corpus of any size has."""

import collections

import pyarrow as pa
import pytest

from pactlake.llm import substring_dedup as sub


def _grouped(batches, function):
    """Every bucket's rows of some record batches through `function`."""
    held = collections.defaultdict(list)
    for t in map(lambda b: pa.Table.from_batches([b]), batches):
        for i, bucket in enumerate(t.column("bucket").to_pylist()):
            held[bucket].append(t.slice(i, 1))
    return [row for parts in held.values() for row in function(pa.concat_tables(parts)).to_pylist()], held


PASSAGE = " ".join("word" + str(i) for i in range(70))


def _docs(rows):
    return pa.RecordBatch.from_arrays([pa.array([i for i, _ in rows], pa.int64()), pa.array([t for _, t in rows])], names=["id", "text"])


@pytest.mark.parametrize("buckets", [8, 1 << 20, 3 << 20, 33_000_000])
def test_every_anchor_of_a_shared_passage_is_found(buckets):
    run = sub._anchor_rows(buckets)
    apart = [b for i in range(2) for b in run([_docs([(i, PASSAGE + f" own{i} tail{i}")])])]
    found, _ = _grouped(apart, sub._active_blocks)
    assert {(r["doc"], r["block"]) for r in found} == {(i, b) for i in range(2) for b in range(10)}
    together = list(run([_docs([(i, PASSAGE) for i in range(50)])]))
    found, held = _grouped(together, sub._active_blocks)
    assert {(r["doc"], r["block"]) for r in found} == {(i, b) for i in range(50) for b in range(10)}
    assert all(r["index"].to_pylist() == [b""] for bucket, parts in held.items() if bucket >= 0 for r in parts)


@pytest.mark.parametrize("buckets", [8, 33_000_000])
def test_a_common_window_costs_its_bucket_one_document_a_portion(buckets):
    lists = pa.array([list(range(10))] * 50, pa.list_(pa.int32()))
    batch = lambda ids: pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array([PASSAGE] * 50), lists], names=["id", "text", "blocks"])
    rows = [b for ids in (range(100, 150), range(0, 50)) for b in sub._window_rows(buckets)([batch(list(ids))])]
    found, held = _grouped(rows, sub._repeated(4))
    windows = 70 - sub.WINDOW + 1
    assert sum(len(r["data"]) // 12 for r in found) == 99 * windows
    assert sum(len(d) // 20 for bucket, parts in held.items() if bucket >= 0 for p in parts for d in p.column("data").to_pylist()) == 2 * windows
