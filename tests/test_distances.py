"""Edit distances of many strings, and the operations that meet by them, against loops."""

import itertools
import random

import numpy as np
import pytest

from pactlake.functions import distance
from pactlake.functions.text import path_shape
from pactlake.operators import matching
from tests.test_renames import distance as plain
from tests.test_renames import similarity
from tests.test_strata import SCHEMA, sides


@pytest.mark.parametrize(("letters", "longest"), [("ab", 6), ("abcé中\U0001f600", 70), ("abc", 150), ("", 0)])
def test_distances_equal_a_loop(monkeypatch, letters, longest):
    """Words of more than 64 characters, characters that no pattern has, equal strings, empty ones, chunks of any size."""
    rng = random.Random(longest)
    some = lambda n, more: ["".join(rng.choice(letters + more) for _ in range(rng.randint(0, longest))) for _ in range(n)] if letters else []
    a, b = [*some(12, ""), ""], [*some(20, "z"), "", "zz", "zz"]
    b += a[:3]
    want = np.array([[plain(x, y) for x in a] for y in b])
    for size in (1, 40, 1 << 15):
        monkeypatch.setattr(distance, "AT_ONCE", size)
        got = np.full(want.shape, -1)
        for at, d in distance.all_pairs(distance.Patterns(a), b):
            got[at] = d
        assert (got == want).all()
        i, j = (x.ravel() for x in np.meshgrid(np.arange(len(a)), np.arange(len(b))))
        assert (distance.pair_by_pair(distance.Patterns(a), b, i, j) == want.ravel()).all()


def test_marks_lose_no_pair(monkeypatch):
    """Pairs within a limit, whether marks leave few pairs or not."""
    rng = random.Random(2)
    a, b = (["".join(rng.choice("abcdefgh/12") for _ in range(rng.randint(0, 14))) for _ in range(60)] for _ in "ab")
    b += [x[:-1] for x in a[:20]] + ["9" + x for x in a[20:40]]
    full = {(i, j): plain(x, y) for i, x in enumerate(a) for j, y in enumerate(b)}
    for most, left, at_once in itertools.product((0, 2, 5), (0, 1 << 40), (70, 1 << 15)):
        monkeypatch.setattr(distance, "LEFT", left)
        monkeypatch.setattr(distance, "AT_ONCE", at_once)
        limit = np.full((16, len(a)), most)
        got = {(i, j): d for x in distance.within(distance.Patterns(a), distance.marks(a), b, distance.marks(b), limit) for i, j, d in zip(*(y.tolist() for y in x), strict=True)}
        assert got == {k: d for k, d in full.items() if d <= most} and got


def likely(r, a):
    """(from_ord, to_ord, close, alike) of all pairs, by a loop."""
    jaccard = lambda x, y: len(set(x) & set(y)) / len(set(x) | set(y)) if x or y else 1.0
    rows = [df.withColumn("path", path_shape("path")).collect() for df in (r, a)]
    for x, y in itertools.product(*rows):
        if (x["pair_id"], x["method"]) == (y["pair_id"], y["method"]) and None not in (x["path"], y["path"]) and not (x["operation_id"] and x["operation_id"] == y["operation_id"]):
            close, alike = similarity(x["path"], y["path"]), (jaccard(x["request"], y["request"]) + jaccard(x["response"], y["response"])) / 2
            if close >= matching.PATH_FLOOR and alike >= matching.RESEMBLANCE_FLOOR:
                yield x["ord"], y["ord"], close, alike


def test_rows_of_any_size_meet(spark, monkeypatch):
    """Pairs of rows taken together, one by one and passed on in parts; operations without a path stay alone."""
    odd = [("p", "get", None, None, ["w"], ["k"], 900), ("p", "get", "", None, ["w"], ["k"], 901), ("p", "get", "/v1/ünï/{x}", "same", ["w"], ["k"], 902)]
    r, a = (df.unionByName(spark.createDataFrame(odd, SCHEMA)) for df in sides(spark, 11))
    want = sorted(likely(r, a))
    assert len(want) > 100
    for side, few, run, block in ((8192, 4096, 1 << 17, 1024), (3, 0, 2, 2), (5, 6, 8, 1024), (8192, 0, 1 << 17, 7)):
        for name, value in (("SIDE", side), ("FEW", few), ("RUN", run), ("BLOCK", block)):
            monkeypatch.setattr(matching, name, value)
        assert sorted(tuple(x) for x in matching.likely_pairs(r, a).select("from_ord", "to_ord", "close", "alike").collect()) == want


def test_an_operation_is_copied_once_for_a_whole_row_of_others(spark):
    """Not once for each part of 250000 pairs: 1200 by 1200 operations of one payload meet in one row, not in six parts."""
    ops = lambda v: spark.range(1200).selectExpr("'p' AS pair_id", "'get' AS method", f"concat('/{v}/things/', id) AS path", "cast(null as string) AS operation_id", "array('a') AS request", "array('b') AS response", "id AS ord")
    r, a = matching._payloads(ops("v1")), matching._payloads(ops("v2"))
    sides = matching._rows(r, a, matching._alike(r, a).selectExpr("*", "0.0D AS floor"))
    assert [df.selectExpr("count(*)", f"sum(size({p}))").first()[:] for df, p in zip(sides, "ra", strict=True)] == [(1, 1200), (1, 1200)]
