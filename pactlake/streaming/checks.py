"""Snapshot checks as a stream: each key keeps its last hash and seq."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from pactlake.operators.history import KEPT, batch_statuses
from pactlake.work import discard

OUTPUT = "spec string, seq long, hash string, status string"
STATE = "hash string, seq long"
#: Rows of a key that a step hands back at once.
CHUNK = 10_000


def _hashed(snapshots: DataFrame) -> DataFrame:
    return snapshots.select("spec", F.col("seq").cast("long").alias("seq"), F.sha2("content", 256).alias("hash"))


def _step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    """Rows of a key in order of seq against the stored hash; rows that are not newer than the last are `late`.

    Spark hands a key over in chunks that overlap in seq, so the rows of all of them are put in order first.
    """
    last_hash, last_seq = state.get if state.exists else (None, None)
    rows = pd.concat([b[["seq", "hash"]] for b in batches]).sort_values(["seq", "hash"], na_position="first", ignore_index=True)
    for at in range(0, len(rows), CHUNK):
        out = []
        for seq, h in rows[at : at + CHUNK].itertuples(index=False):
            if pd.isna(seq) or last_seq is not None and seq <= last_seq:
                out.append((key[0], seq, h, "late"))
                continue
            out.append((key[0], seq, h, "baseline" if last_hash is None else "unchanged" if h == last_hash else "changed"))
            last_hash, last_seq = h, seq
        yield pd.DataFrame(out, columns=["spec", "seq", "hash", "status"])
    if last_seq is not None:
        state.update((last_hash, int(last_seq)))


def check_stream(snapshots: DataFrame) -> DataFrame:
    """snapshots (streaming): spec, seq long, content. Status of each as it arrives; contents are hashed before the shuffle.

    For input in order this equals the batch status by lag. A row whose seq is not newer than the key's last is `late`.
    One worker holds the hashes of a key's rows in a micro-batch; `check_available` has no such group.
    """
    return _hashed(snapshots).groupBy("spec").applyInPandasWithState(_step, OUTPUT, STATE, "append", GroupStateTimeout.NoTimeout)


def _batch_step(out: str, state: str):
    """The work of a micro-batch. A batch that is run again writes the same places."""

    def run(batch: DataFrame, number: int) -> None:
        spark: SparkSession = batch.sparkSession
        ranged = f"{state}/ranged-{number}"
        batch.repartitionByRange("spec", "seq").withColumn("range", F.spark_partition_id()).write.mode("overwrite").parquet(ranged)
        kept = spark.read.schema(KEPT).parquet(f"{state}/kept-{number - 1}") if number else spark.createDataFrame([], KEPT)
        statuses, new = batch_statuses(spark.read.schema(f"{KEPT}, range int").parquet(ranged), kept)
        statuses.write.mode("overwrite").parquet(f"{out}/{number}")
        new.write.mode("overwrite").parquet(f"{state}/kept-{number}")
        discard(spark, ranged, f"{state}/kept-{number - 2}")

    return run


def check_available(snapshots: DataFrame, folder: str) -> DataFrame:
    """The statuses of what a stream holds now: one run to the end of its input, results and state under `folder`.

    Statuses are those of `check_stream`: of equal seqs the smaller hash comes first, rows without a seq are `late`. Every
    micro-batch is dealt out by ranges of (spec, seq); only the last seq and hash of each spec are carried on.
    """
    spark = snapshots.sparkSession
    out, state, log = (f"{folder}/stream-{part}-{uuid.uuid4().hex}" for part in ("out", "state", "log"))
    spark.createDataFrame([], OUTPUT).write.parquet(f"{out}/none")
    run = _hashed(snapshots).writeStream.foreachBatch(_batch_step(out, state)).option("checkpointLocation", log).trigger(availableNow=True).start()
    run.awaitTermination()
    return spark.read.schema(OUTPUT).option("recursiveFileLookup", "true").parquet(out)
