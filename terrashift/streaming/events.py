"""Structured Streaming over the append-only event log: totals, windows, sessions and the last state of a run."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from terrashift.sources.storage import shared_dir

EVENT_SCHEMA = "event_id bigint, ts timestamp_ntz, user_id bigint, event_type string, value double, props string"


def event_stream(spark: SparkSession, path: str, glob: str = "events.parquet", max_files: int = 1) -> DataFrame:
    """The events of a folder as a stream; the event time becomes a TIMESTAMP, which watermarks need."""
    rows = spark.readStream.schema(EVENT_SCHEMA).option("pathGlobFilter", glob).option("maxFilesPerTrigger", max_files).parquet(path)
    return rows.withColumn("ts", F.col("ts").cast("timestamp"))


def deduplicated(events: DataFrame, delay: str = "1 hour") -> DataFrame:
    """Each event once; the state forgets ids that the watermark has passed."""
    return events.withWatermark("ts", delay).dropDuplicatesWithinWatermark(["event_id"])


def totals(events: DataFrame) -> DataFrame:
    return events.groupBy("event_type").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("value"), 4).alias("total"))


def tumbling(events: DataFrame, width: str = "1 day", delay: str = "1 hour") -> DataFrame:
    got = events.withWatermark("ts", delay).groupBy(F.window("ts", width), "event_type").agg(F.count(F.lit(1)).alias("n"))
    return got.select(F.col("window.start").alias("start"), "event_type", "n")


def sessions(events: DataFrame, gap: str = "2 hours", delay: str = "1 hour") -> DataFrame:
    got = events.withWatermark("ts", delay).groupBy(F.session_window("ts", gap), "user_id").agg(F.count(F.lit(1)).alias("n"))
    return got.select(F.col("session_window.start").alias("start"), F.col("session_window.end").alias("end"), "user_id", "n")


def running_spend(events: DataFrame, cap: float) -> DataFrame:
    """Each user's running total and whether it is within a cap; state of one number for each user."""

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        total = state.get[0] if state.exists else 0.0
        for rows in batches:
            rows = rows.sort_values(["ts", "event_id"])
            sums = total + rows["value"].cumsum()
            total = float(sums.iloc[-1]) if len(sums) else total
            yield pd.DataFrame({"user_id": key[0], "event_id": rows["event_id"], "running": sums, "within_cap": sums <= cap})
        state.update((total,))

    return events.groupBy("user_id").applyInPandasWithState(
        step, "user_id bigint, event_id bigint, running double, within_cap boolean", "total double", "append", GroupStateTimeout.NoTimeout
    )


def drain(stream: DataFrame, name: str, mode: str = "complete", checkpoint: str | None = None) -> DataFrame:
    """Run a stream over what is there now and return its result as a table.

    Executors write each batch as Parquet below ``spark.checkpoint.dir``; nothing
    passes through the driver. In complete mode a batch replaces the one before
    it, in append mode every batch is kept; a batch that is run again after a
    failure overwrites its own folder.
    """
    spark = stream.sparkSession
    root = f"{shared_dir(spark)}/streams/{name}-{uuid.uuid4().hex}"
    last: list[str] = []

    def keep(batch: DataFrame, number: int) -> None:
        path = f"{root}/rows/batch={number}"
        batch.write.mode("overwrite").parquet(path)
        if mode == "complete":
            last.clear()
        if path not in last:
            last.append(path)

    writer = stream.writeStream.foreachBatch(keep).queryName(name).outputMode(mode).trigger(availableNow=True)
    query = writer.option("checkpointLocation", checkpoint or f"{root}/state").start()
    query.awaitTermination()
    if query.exception():
        raise query.exception()
    rows = spark.read.schema(stream.schema)
    return rows.parquet(*last) if last else spark.createDataFrame([], stream.schema)
