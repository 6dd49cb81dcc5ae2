"""Stream statuses of keys that Spark hands over in several chunks, against the batch form and a loop."""

import random
import time

from pyspark.sql import functions as F

from pactlake.operators import history
from pactlake.streaming import checks

SCHEMA = "spec string, seq long, content string"


def _snapshots(spark):
    """A hot key of 24000 rows and small ones that straddle chunks, in shuffled order."""
    rows = [("hot", i, f"text {random.Random(i // 2).randrange(3)}") for i in range(24_000)]
    rows += [(f"s{i % 40}", i, f"text {random.Random(i // 80).randrange(2)}") for i in range(8_000)]
    random.Random(5).shuffle(rows)
    return spark.createDataFrame(rows, SCHEMA)


def _statuses(df):
    return {tuple(r) for r in df.select("spec", "seq", "status").collect()}


def _want(spark, snaps):
    return _statuses(history.snapshot_status(snaps))


def test_available_equals_batch_beyond_one_chunk(spark, tmp_path):
    snaps = _snapshots(spark)
    snaps.repartition(6).write.parquet(str(tmp_path / "in"))
    got = checks.check_available(spark.readStream.schema(SCHEMA).parquet(str(tmp_path / "in")), str(tmp_path))
    assert got.count() == 32_000
    assert _statuses(got) == _want(spark, snaps)


def test_stream_equals_batch_beyond_one_chunk(spark, tmp_path):
    snaps = _snapshots(spark)
    snaps.repartition(6).write.parquet(str(tmp_path / "in"))
    q = checks.check_stream(spark.readStream.schema(SCHEMA).parquet(str(tmp_path / "in"))).writeStream.format("memory").queryName("long_keys").outputMode("append").option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert _statuses(spark.table("long_keys")) == _want(spark, snaps)


def test_state_over_micro_batches(spark, tmp_path):
    """Late rows, equal seqs, null contents and keys that pause, over three micro-batches, against a loop."""
    parts = [
        [("a", 3, "x"), ("a", 1, "x"), ("b", 1, None), ("c", 5, "x"), (None, 1, "n"), ("a", None, "z")],
        [("a", 2, "y"), ("a", 3, "y"), ("a", 4, "x"), ("b", 2, "x"), (None, 2, "n")],
        [("c", 5, "y"), ("c", 6, "x"), ("a", 4, "x"), ("a", 9, "y"), ("a", 9, "q"), ("d", 1, "x"), ("b", 3, None), ("b", 4, "x")],
    ]
    for i, rows in enumerate(parts):
        spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        if i < len(parts) - 1:
            time.sleep(1.1)  # the file source takes files by their time
    stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    hashes = {r["content"]: r["h"] for r in spark.createDataFrame([(c,) for c in "xyzqn"], "content string").withColumn("h", F.sha2("content", 256)).collect()}
    want, last = [], {}
    for rows in parts:
        for s, n, c in sorted(rows, key=lambda r: (r[1] is not None, r[1] or 0, hashes.get(r[2]) or "")):
            h = hashes.get(c)
            if n is None or s in last and n <= last[s][0]:
                want.append((s, n, "late"))
                continue
            before = last[s][1] if s in last else None
            want.append((s, n, "baseline" if before is None else "unchanged" if before == h else "changed"))
            last[s] = n, h
    got = checks.check_available(stream, str(tmp_path))
    key = lambda r: (r[0] or "", r[1] or 0, r[2])
    assert sorted((tuple(r) for r in got.select("spec", "seq", "status").collect()), key=key) == sorted(want, key=key)
