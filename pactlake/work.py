"""Tables written to the folder that driver and executors share, to end a lineage."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


#: Spark's setting that removes an execution's shuffle files when it ends.
CLEAN = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
#: Spark's setting for the rows that Python is given at a time.
BATCH = "spark.sql.execution.arrow.maxRecordsPerBatch"


def work_dir(spark: SparkSession) -> str:
    """`spark.checkpoint.dir`; a temporary folder only where all of Spark is one local process and the session names none."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.conf.get("spark.pactlake.workDir", None)
    if not found:
        if not spark.sparkContext.master.split("[")[0] == "local":
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        found = f"file://{tempfile.mkdtemp(prefix='pactlake-')}"
        spark.conf.set("spark.pactlake.workDir", found)
    return found.rstrip("/")


def written(df: DataFrame, tag: str, by: str | None = None, batch: int | None = None) -> tuple[DataFrame, str]:
    """`df` written to the shared folder, in folders by a column if named, and read again, and its path.

    The write's shuffle files go when it is done. `batch`: rows that Python holds at a time, where they are large.
    """
    spark = df.sparkSession
    path, held = f"{work_dir(spark)}/{tag}-{uuid.uuid4().hex}", {CLEAN: spark.conf.get(CLEAN, "false"), BATCH: spark.conf.get(BATCH)}
    spark.conf.set(CLEAN, "true")
    if batch:
        spark.conf.set(BATCH, str(batch))
    try:
        (df.write.partitionBy(by) if by else df.write).parquet(path)
    finally:
        for name, value in held.items():
            spark.conf.set(name, value)
    return spark.read.schema(df.schema).parquet(path), path


def discard(spark: SparkSession, *paths: str | None) -> None:
    """Remove tables of `written` that nothing reads any more."""
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    for p in paths:
        if p:
            at = jvm.org.apache.hadoop.fs.Path(p)
            at.getFileSystem(conf).delete(at, True)
