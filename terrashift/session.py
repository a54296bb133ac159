"""Session construction used by the benchmark, the tests and interactive runs."""

from __future__ import annotations

import os

from pyspark.sql import SparkSession


def build_session(cores: int | None = None, app: str = "terrashift", **extra: str) -> SparkSession:
    """A local session with the settings the engine is tested under.

    On a cluster the caller passes its own session; nothing in the library
    calls this function.
    """
    cores = cores or int(os.environ.get("BENCH_CPUS", "8"))
    conf = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.shuffle.partitions": str(cores),
        "spark.sql.adaptive.enabled": "true",
        "spark.driver.memory": os.environ.get("TERRASHIFT_DRIVER_MEMORY", "8g"),
        "spark.ui.enabled": "false",
        "spark.ui.showConsoleProgress": "false",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
    }
    conf.update(extra)
    spark = SparkSession.builder.master(f"local[{cores}]").appName(app).config(map=conf).getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark
