"""Keys that crowds of documents hold: settled in a portion or waiting for their bucket, they come out as by one table of all."""

import collections
import random

import numpy as np
import pyarrow as pa
import pytest
from tests.llm.test_joins import edited

from pactlake.llm import jaccard_join as join


def _texts(seed):
    rng = random.Random(seed)
    base = ["w" + str(i) for i in range(80)]
    near = [" ".join(edited(rng, base, i % 3)) for i in range(150)]
    apart = [" ".join("u" + str(rng.randrange(10**6)) for _ in range(80)) for _ in range(150)]
    small = [" ".join("s" + str(rng.randrange(6)) for _ in range(rng.randint(1, 12))) for _ in range(200)]
    return near + apart + small


@pytest.mark.parametrize("portions", [1, 3])
def test_shared_keys(portions):
    texts, buckets = _texts(portions), 8
    ids = list(range(-100, len(texts) - 100))
    cuts = np.array_split(np.arange(len(texts)), portions)
    batches = [pa.RecordBatch.from_arrays([pa.array([ids[i] for i in c], pa.int64()), pa.array([texts[i] for i in c])], names=["id", "text"]) for c in cuts]
    held, kinds = collections.defaultdict(list), set()
    for batch in batches:
        for rows in join._key_rows(buckets)([batch]):
            t = pa.Table.from_batches([rows])
            kinds.update(t.column("kind").to_pylist())
            for i, b in enumerate(t.column("bucket").to_pylist()):
                held[b].append(t.slice(i, 1))
    assert kinds == {join.SHARED, join.WAITING}
    rows = [r for parts in held.values() for r in join._shared_keys(pa.concat_tables(parts)).to_pylist()]
    marks = {r["key"] for r in rows if r["state"] == join.MARK}
    got = {(r["doc"], r["role"], r["key"]) for r in rows if r["state"] == join.SHARED or r["state"] == join.WAITING and r["key"] in marks}

    entries = collections.defaultdict(set)
    for batch, c in zip(batches, cuts, strict=True):
        seen, sets, mine = set(), [], []
        for i in c:
            data = np.frombuffer(texts[i].encode(), np.uint8)
            (s,) = join.shingle_sets(data, np.array([0, len(data)]))
            if join.set_hash(s) not in seen:
                seen.add(join.set_hash(s))
                sets.append(s)
                mine.append(ids[i])
        k = join.keys_of(sets)
        for key, owner, role in zip(k["key"].tolist(), k["set"].tolist(), k["role"].tolist(), strict=True):
            entries[(key >> 32) % buckets << join.SUB | key & (1 << join.SUB) - 1].add((mine[owner], role))
    want = set()
    for key, found in entries.items():
        roles = {r for _, r in found}
        if roles & {join.BOTH, join.INDEX} and roles - {join.INDEX} and len({d for d, _ in found}) > 1:
            want |= {(d, r, key) for d, r in found}
    assert got == want and len(want) > 1000
