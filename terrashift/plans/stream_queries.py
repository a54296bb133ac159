"""Stateful streams over logs that Spark derives from the event table."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from terrashift.plans import views
from terrashift.plans.registry import query
from terrashift.sources.storage import shared_dir, written
from terrashift.streaming import spending

CAP, TTL_S, SLICES = 2_000_000, 14_400, 4

_LOG = f"""
lg0 AS (SELECT user_id AS session, event_id, ts, 'r' || (event_id % 2) AS fingerprint,
          CASE event_type WHEN 'view' THEN 'quote' WHEN 'click' THEN 'reserve' WHEN 'purchase' THEN 'settle'
            ELSE CASE WHEN event_id % 3 = 0 THEN 'uncertain' ELSE 'release' END END AS kind,
          CAST(floor(value * CASE WHEN event_type = 'purchase' THEN 1000 ELSE 10000 END) AS BIGINT) AS micro
        FROM events WHERE event_type <> 'signup'),
lg AS (SELECT *, row_number() OVER w AS n,
         CASE kind WHEN 'quote' THEN NULL WHEN 'reserve' THEN last_value(CASE WHEN kind = 'quote' THEN event_id END IGNORE NULLS) OVER w
           ELSE last_value(CASE WHEN kind = 'reserve' THEN event_id END IGNORE NULLS) OVER w END AS ref
       FROM lg0 WINDOW w AS (PARTITION BY session ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)),
lr AS (SELECT a.*, q.ts AS q_ts, q.micro AS q_micro, q.fingerprint AS q_print FROM lg a LEFT JOIN lg q ON a.kind = 'reserve' AND q.event_id = a.ref)"""

# One event of every session a step; a session carries what is settled, its holds and its used quotes.
_STATES = f"""
st AS (
  SELECT session, CAST(0 AS BIGINT) AS n, CAST(NULL AS BIGINT) AS event_id, CAST(NULL AS VARCHAR) AS kind, CAST(NULL AS VARCHAR) AS decision, CAST(0 AS BIGINT) AS settled,
         CAST([] AS BIGINT[]) AS ids, CAST([] AS BIGINT[]) AS amounts, CAST([] AS BIGINT[]) AS used FROM (SELECT DISTINCT session FROM lr)
  UNION ALL
  SELECT session, n, event_id, kind, decision, settled + CASE WHEN decision = 'settled' THEN greatest(micro, 0) ELSE 0 END,
         CASE WHEN decision = 'reserved' THEN list_append(ids, event_id) WHEN decision IN ('settled', 'released') THEN ids[:spot - 1] || ids[spot + 1:] ELSE ids END,
         CASE WHEN decision = 'reserved' THEN list_append(amounts, q_micro) WHEN decision IN ('settled', 'released') THEN amounts[:spot - 1] || amounts[spot + 1:] ELSE amounts END,
         CASE WHEN decision = 'reserved' THEN list_append(used, ref) ELSE used END
  FROM (SELECT s.session, lr.n, lr.event_id, lr.kind, lr.micro, lr.ref, lr.q_micro, s.settled, s.ids, s.amounts, s.used, coalesce(list_position(s.ids, lr.ref), 0) AS spot,
          CASE WHEN lr.kind = 'quote' THEN 'quoted'
            WHEN lr.kind = 'reserve' THEN CASE WHEN lr.ref IS NULL OR lr.ts > lr.q_ts + INTERVAL {TTL_S} SECOND THEN 'refused: no live quote'
              WHEN list_contains(s.used, lr.ref) THEN 'refused: already used' WHEN lr.fingerprint <> lr.q_print THEN 'refused: another request'
              WHEN s.settled + coalesce(list_sum(s.amounts), 0) + lr.q_micro > {CAP} THEN 'refused: over the cap' ELSE 'reserved' END
            WHEN lr.ref IS NULL OR NOT list_contains(s.ids, lr.ref) THEN 'refused: no such hold'
            WHEN lr.kind = 'settle' THEN 'settled' WHEN lr.kind = 'uncertain' THEN 'uncertain' ELSE 'released' END AS decision
        FROM st s JOIN lr ON lr.session = s.session AND lr.n = s.n + 1))"""


def spending_log(spark: SparkSession, d: str, slices: int = SLICES) -> tuple[str, int, str]:
    """The folder of a log made of the events, the files that a slice has at most, and the time that they overlap by.

    The slices are written in the order of time, each as one file a core; a
    session's events of a slice are in one file.
    """
    rows = views.table(spark, d, "events").where("event_type <> 'signup'")
    kind = F.when(F.col("event_type") == "view", "quote").when(F.col("event_type") == "click", "reserve").when(F.col("event_type") == "purchase", "settle")
    kind = F.coalesce(kind, F.when(F.col("event_id") % 3 == 0, "uncertain").otherwise("release"))
    scale = F.when(F.col("event_type") == "purchase", 1000).otherwise(10000)
    log = rows.select(
        F.col("user_id").alias("session"), "event_id", F.col("ts").cast("timestamp").alias("ts"), kind.alias("kind"),
        F.concat(F.lit("r"), F.col("event_id") % 2).alias("fingerprint"), F.floor(F.col("value") * scale).cast("bigint").alias("micro"),
    )
    before = Window.partitionBy("session").orderBy("ts", "event_id").rowsBetween(Window.unboundedPreceding, Window.currentRow)

    def last(kind: str):
        return F.last(F.when(F.col("kind") == kind, F.col("event_id")), True).over(before)

    at = F.unix_micros("ts")
    ends = log.agg(F.min(at).alias("a"), F.max(at).alias("b")).first()
    first, span = ends.a or 0, (ends.b or 0) - (ends.a or 0)
    step = span // slices + 1
    ref = F.when(F.col("kind") == "reserve", last("quote")).when(F.col("kind") != "quote", last("reserve"))
    log = log.withColumn("ref", ref).select("session", "event_id", "ts", "kind", "ref", "fingerprint", "micro")
    sliced = written(log.withColumn("slice", F.floor((at - first) / step).cast("int")), "spending-log")
    path, files = f"{shared_dir(spark)}/logs/spending-{uuid.uuid4().hex}", spark.sparkContext.defaultParallelism
    for k in range(slices):
        sliced.where(F.col("slice") == k).drop("slice").repartition(files, "session").write.parquet(f"{path}/slice={k}")
    return path, files, f"{step} microseconds"


@query(
    "spend_decisions",
    f"""WITH RECURSIVE {_LOG}, {_STATES}
    SELECT session, event_id, kind, decision, settled AS settled_micro, CAST(coalesce(list_sum(amounts), 0) AS BIGINT) AS held_micro FROM st WHERE n > 0""",
)
def spend_decisions(spark, d) -> DataFrame:
    path, files, overlap = spending_log(spark, d)
    return spending.decided(spark, path, CAP, TTL_S, max_files=files, delay=overlap)
