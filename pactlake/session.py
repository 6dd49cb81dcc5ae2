"""Session factory with the settings the engine is tuned for."""

from __future__ import annotations

import os

from pyspark.sql import SparkSession


def build_session(app: str = "pactlake", master: str | None = None, **conf: str) -> SparkSession:
    """A session with AQE, UTC and Arrow on; `conf` overrides single settings (dots as `__`)."""
    b = SparkSession.builder.appName(app)
    if master:
        b = b.master(master)
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        "spark.ui.enabled": "false",
        "spark.ui.showConsoleProgress": "false",
    }
    if master and master.startswith("local"):
        settings["spark.sql.shuffle.partitions"] = str(os.cpu_count() or 8)
        settings["spark.driver.memory"] = "8g"
    settings |= {k.replace("__", "."): v for k, v in conf.items()}
    for k, v in settings.items():
        b = b.config(k, v)
    return b.getOrCreate()
