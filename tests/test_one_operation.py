"""What differs is dealt out by operation once: classes, cascades and context meet there."""

import random
import re

from pyspark.sql import functions as F

from pactlake import catalog
from pactlake.operators import diff
from pactlake.operators.cascade import suppress_cascades
from tests.test_one_sided import FIELD

DIR = "/root/testdata/sf0.001"
POINTERS = ["a", "a.b", "a.b.c", "a[]", "a[].d", "ab", "ab.c", "e.f", "e.g", "h"]


def _sides(spark):
    r, sides = random.Random(11), []
    for _ in range(2):
        keys = [(op, d, p) for op in range(80) for d in ("request", "response") for p in POINTERS if r.random() < 0.6]
        rows = [("p", str(op), d, p, p.split(".")[-1], r.choice(["", None, p.rpartition(".")[0]]), r.random() < 0.5, t := r.choice(["string", "integer"]), r.choice([t, None]), r.choice([None, ["1"], ["1", "2"]]), i) for i, (op, d, p) in enumerate(keys)]
        sides.append(spark.createDataFrame(rows, FIELD))
    context = spark.createDataFrame([("p", str(op), f"/{op}", "get", None if op % 3 else str(op), op % 3) for op in range(75)], "pair_id string, op string, path string, method string, operation_id string, rank int")
    return context, *sides


def test_the_sides_of_field_diff_meet_once(spark):
    plan = catalog.queries()["field_diff"](spark, DIR)._jdf.queryExecution()
    # The sides and the contexts.
    assert len(re.findall(r"[-:] Join ", plan.optimizedPlan().toString())) == 2
    # The lines of either side, the sides, the operations' changes, the contexts (at most twice) and the order.
    assert len(re.findall(r"[-:] Exchange ", plan.executedPlan().toString())) <= 8


def test_folding_by_operation_is_folding_by_its_names(spark):
    sides = _sides(spark)
    found = diff.field_changes(*sides)
    rows = lambda df: sorted(map(str, df.collect()))
    want = rows(suppress_cascades(found))
    assert rows(diff.diff_fields(*sides)) == want
    assert len(want) < found.count() and any("nested fields" in w for w in want)


def test_rows_of_a_class_without_another_side_are_not_gathered(spark):
    _, old, new = _sides(spark)
    joined, rest = diff._joined(old, new, diff.FIELD_KEYS)
    classes = diff._classes(joined, rest, diff.FIELD_KEYS, diff.FIELD_CLASS).cache()
    single, key = classes.filter("o IS NULL OR n IS NULL"), ["op", "_direction", "_parent", "_schema_fp"]
    sizes = single.groupBy(*key).agg(F.count("n").alias("a"), F.count("o").alias("r"), F.count("p").alias("p"), F.bool_or("mixed").alias("mixed"), F.max(F.size("r")).alias("nr"), F.max(F.size("a")).alias("na")).collect()
    for c in sizes:
        assert (c.mixed, c.p) == ((True, 1) if c.a and c.r else (False, 0)), c
        assert not c.mixed or (c.nr, c.na) == (c.r, c.a), c
    assert {c.mixed for c in sizes} == {True, False} and classes.filter("o IS NOT NULL AND n IS NOT NULL AND p IS NOT NULL").isEmpty()
