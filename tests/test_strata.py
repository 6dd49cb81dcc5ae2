"""Operation renames chosen in strata, and how the pairs of operations are met."""

import itertools
import random

from pyspark.sql import functions as F

from pactlake.operators import matching

SCHEMA = "pair_id string, method string, path string, operation_id string, request array<string>, response array<string>, ord int"


def sides(spark, seed):
    rng = random.Random(seed)

    def side(n, first):
        for i in range(n):
            path = "/v1/" + "".join(rng.choice("abc") for _ in range(rng.randint(1, 6))) + rng.choice(["", "/{id}"])
            yield ("p", rng.choice(["get", "put"]), path, rng.choice([None, "", f"op{rng.randint(0, 30)}"]), rng.sample("wxyz", rng.randint(0, 2)), rng.sample("klm", rng.randint(1, 3)), first + i)

    return spark.createDataFrame([*side(60, 0), ("q", "get", "/x", "one", [], [], 0)], SCHEMA), spark.createDataFrame([*side(50, 500), ("q", "get", "0y1z", "one", [], [], 1)], SCHEMA)


def rows(df):
    return sorted(tuple(r) for r in df.select("pair_id", "method", "from_ord", "to_ord", "score", "conf").collect())


def test_strata_choose_what_one_fold_chooses(spark, monkeypatch):
    for name, value in (("WHOLE", 20), ("EACH", 1), ("PROBES", 2)):
        monkeypatch.setattr(matching, name, value)
    floors, seen = matching._floors, []
    monkeypatch.setattr(matching, "_floors", lambda *a: seen.append(floors(*a)) or seen[-1])
    r, a = sides(spark, 5)
    want = rows(matching.fold_pairs(matching.operation_candidates(r, a), matching.PLACE))
    assert rows(matching.operation_renames(r, a)) == want and len(seen) > 1
    assert {c for *_, c in want} == {1, 2}


def test_shared_ids_are_chosen_before_payloads_meet(spark, monkeypatch):
    r, a = sides(spark, 6)
    want = [x for x in rows(matching.fold_pairs(matching.operation_candidates(r, a), matching.PLACE)) if x[-1] == 2]
    assert rows(matching.operation_renames(r, a, by_id=True)) == want and want
    meet, met = matching._alike, []
    monkeypatch.setattr(matching, "_alike", lambda *x: met.append(1) or meet(*x))
    plain = lambda df: df.filter("operation_id <> '' AND pair_id = 'p'").withColumn("path", F.concat(F.lit("/v1/"), "operation_id"))
    assert rows(matching.operation_renames(plain(r), plain(a), by_id=True)) and not met


def test_an_id_and_nothing_else_ties_with_all_but_the_id(spark):
    """A score of 2 both ways: the order of the sides decides."""
    for first, last in itertools.permutations((0, 1)):
        r = spark.createDataFrame([("p", "get", "bbbbb", "x", ["q"], ["s"], first), ("p", "get", "/same", None, ["q"], ["s"], last)], SCHEMA)
        a = spark.createDataFrame([("p", "get", "/same", "x", ["q"], ["s"], 7)], SCHEMA)
        want = rows(matching.fold_pairs(matching.operation_candidates(r, a), matching.PLACE))
        assert rows(matching.operation_renames(r, a)) == want
        assert rows(matching.operation_renames(r, a, by_id=True)) == [x for x in want if x[-1] == 2]


def test_pairs_of_operations_are_not_shuffled(spark):
    """What is met is judged in the same step: over the join of the pairs there is no exchange."""
    plan = matching.likely_pairs(*sides(spark, 7))._jdf.queryExecution().sparkPlan().toString()
    above = plan[: plan.index("Join")]
    assert "Exchange" not in above and "Aggregate" not in above and "Join" not in above
