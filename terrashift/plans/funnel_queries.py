"""The funnel with calls, late and broken answers and a resumed round, over tables that Spark derives from the customers."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from terrashift.operators import funnel, verdicts
from terrashift.plans import views
from terrashift.plans.registry import query
from terrashift.plans.review_queries import _FUNNEL, _funnel
from terrashift.sources.storage import shared_dir

MODEL, FIRST_CAP, CAP = "claude-opus-5", 150, 260

# What is wrong with an answer, by its number modulo 20.
_CAUSES = {
    0: verdicts.REFUSED,
    1: verdicts.TRUNCATED,
    2: verdicts.EMPTY,
    3: verdicts.EMPTY,
    4: f"schema validation failed: {verdicts.NO_JSON}",
    5: "schema validation failed: confidence is missing",
    6: "schema validation failed: unknown field",
    7: "schema validation failed: vlm_verdict is not allowed",
    8: "schema validation failed: visual_evidence is not 1 to 8 texts",
    9: "schema validation failed: visual_evidence is not 1 to 8 texts",
    10: "schema validation failed: confidence is not between 0 and 1",
    12: "schema validation failed: artifact_risk is not allowed",
    14: "schema validation failed: visual_evidence is not 1 to 8 texts",
    16: "schema validation failed: requires_human_review is no flag",
    18: f"schema validation failed: {verdicts.NO_JSON}",
}
_GOOD = ("real_change", "likely_artifact", "uncertain")


def message(key) -> F.Column:
    """The answer with number ``key`` as JSON text: sound ones, and one for each way to be broken."""
    k = key % 20

    def when(n: int, value, other):
        return F.when(k == n, F.lit(value)).otherwise(other)

    good = F.element_at(F.array(*map(F.lit, _GOOD)), (key % 3 + 1).cast("int"))
    confidence = (key % 101).cast("double") / 100.0
    evidence = F.when(k == 8, F.lit("[]")).when(k == 9, F.lit('["a","b","c","d","e","f","g","h","i"]')).when(k == 14, F.lit('["seen", 3]')).otherwise('["roof"]')
    level = when(12, "extreme", F.lit("low"))
    number = F.when(k == 10, F.lit("1.5")).when(k == 11, F.concat(F.lit('"'), confidence.cast("string"), F.lit('"'))).otherwise(confidence.cast("string"))
    flag = F.when(k == 13, F.lit('"no"')).when(k == 16, F.lit('"perhaps"')).when(k == 17, F.lit("1")).otherwise("false")
    parts = [
        F.lit('{"vlm_verdict": "'), when(7, "certain", good), F.lit('", "change_type": "construction", "visual_evidence": '), evidence,
        F.lit(', "artifact_risk": {"cloud_shadow": "low", "snow": "'), level, F.lit('", "seasonality": "high", "registration": "medium"}'),
        when(5, "", F.concat(F.lit(', "confidence": '), number)), F.lit(', "requires_human_review": '), flag, when(6, ', "note": 1', F.lit("")), F.lit("}"),
    ]
    text = F.when(k == 3, F.lit(" \n ")).when(k == 4, F.lit("I think {so")).when(k == 18, F.lit('["a list"]')).otherwise(F.concat(*parts))
    block = "type string, text string"
    whole = F.array(F.struct(F.lit("text").alias("type"), text.alias("text")))
    split = F.array(
        F.struct(F.lit("text").alias("type"), F.substring(text, 1, 20).alias("text")),
        F.struct(F.lit("thinking").alias("type"), F.lit("ignored").alias("text")),
        F.struct(F.lit("text").alias("type"), F.substring(text, F.lit(21), F.length(text)).alias("text")),
    )
    content = F.when(k == 2, F.array().cast(f"array<struct<{block.replace(' ', ':').replace(',:', ',')}>>")).when(k == 15, split).otherwise(whole)
    stop = F.when(k == 0, "refusal").when(k == 1, "max_tokens").otherwise("end_turn")
    usage = F.struct((1000 + key % 500).alias("input_tokens"), (100 + key % 50).alias("output_tokens"))
    return F.to_json(F.struct(stop.alias("stop_reason"), content.alias("content"), usage.alias("usage")))


def _verdict_sql(key: str) -> str:
    """cause, verdict, confidence and review of the answer ``key``, from what was broken in it."""
    cause = f"CASE {key} % 20 " + " ".join(f"WHEN {n} THEN '{c}'" for n, c in _CAUSES.items()) + " END"
    good = f"CASE {key} % 3 WHEN 0 THEN 'real_change' WHEN 1 THEN 'likely_artifact' ELSE 'uncertain' END"
    broken = f"{key} % 20 IN ({', '.join(map(str, _CAUSES))})"
    confidence = f"CASE WHEN {broken} THEN 0.0E0 ELSE CAST({key} % 101 AS DOUBLE)/100.0E0 END"
    return f"""{cause} AS cause, CASE WHEN {broken} THEN 'uncertain' ELSE {good} END AS vlm_verdict, {confidence} AS vlm_confidence,
      {broken} OR {key} % 3 = 2 OR {key} % 101 < 50 OR {key} % 20 = 17 AS human_review"""


@query("verdict_parse", f"SELECT event_id, {_verdict_sql('event_id')}, CASE WHEN event_id % 20 IN ({', '.join(map(str, _CAUSES))}) THEN 'uncertain' ELSE 'construction' END AS vlm_change_type FROM events")
def verdict_parse(spark, d):
    answers = views.table(spark, d, "events").select("event_id", message(F.col("event_id")).alias("message"))
    return verdicts.parsed(answers).select("event_id", "cause", "vlm_verdict", "vlm_confidence", "human_review", "vlm_change_type")


@query("verdict_redacted", """SELECT o_orderkey AS tile_id, NULL AS cloud, o_orderkey % 7 AS days, TRUE AS clean FROM orders""")
def verdict_redacted(spark, d):
    """What is withheld stays withheld: only listed fields are in the metadata."""
    tiles = views.table(spark, d, "orders").select(
        F.col("o_orderkey").alias("tile_id"), F.lit(None).cast("double").alias("cloud_fraction_max"), (F.col("o_orderkey") % 7).alias("season_delta_days"),
        F.lit("candidate_change").alias("gate"), F.lit(0.9).alias("gate_confidence"), F.col("o_comment" if "o_comment" in views.table(spark, d, "orders").columns else "o_orderstatus").alias("secret"),
    )
    found = verdicts.redacted(tiles)
    body = F.try_parse_json("metadata")
    allowed = {"tile_id", "observation_quality"}
    keys = F.map_keys(F.try_variant_get(body, "$", "map<string,variant>"))
    clean = (F.size(F.array_except(keys, F.array(*map(F.lit, sorted(allowed))))) == 0) & ~F.col("metadata").contains("gate")
    return found.select(
        "tile_id",
        F.try_variant_get(body, "$.observation_quality.cloud_fraction_max", "int").alias("cloud"),
        F.try_variant_get(body, "$.observation_quality.season_delta_days", "bigint").alias("days"),
        clean.alias("clean"),
    )


def results(spark: SparkSession, d: str, path: str) -> None:
    """Answers to every customer that might be called, in three files: some failed, some late, some to nobody's call."""
    c = F.col("c_custkey")
    rows = views.table(spark, d, "customer").select(
        c,
        F.when(c % 19 == 0, F.concat(F.lit("x"), c)).otherwise(F.concat(F.lit("c"), c)).alias("custom_id"),
        F.when(c % 13 == 0, "errored").otherwise("succeeded").alias("kind"),
        F.when(c % 13 == 0, "overloaded").alias("error"),
        F.when(c % 13 != 0, message(c)).alias("message"),
    )
    unknown = rows.where(c % 19 == 0)
    late = rows.where(c % 19 != 0).where(c % 11 == 0).unionByName(unknown.withColumn("custom_id", F.concat(F.lit("c"), c)))
    soon = rows.where((c % 19 == 0) | (c % 11 != 0))
    for k, part in enumerate((soon.where(c % 2 == 0), soon.where(c % 2 == 1), late)):
        part.drop("c_custkey").write.json(f"{path}/file-{k}")


def run(spark: SparkSession, d: str) -> str:
    """Two rounds: even customers first, then all; the late file comes when the run is opened again."""
    root = f"{shared_dir(spark)}/funnel-{uuid.uuid4().hex}"
    judged = _funnel(spark, d).select("tile_id", "city", "gate", "label")
    results(spark, d, f"{root}/answers-to-come")

    def stream(*files: int) -> DataFrame:
        names = "{" + ",".join(f"file-{k}" for k in files) + "}"
        return spark.readStream.schema(funnel.RESULT).option("maxFilesPerTrigger", 1).json(f"{root}/answers-to-come/{names}/*.json")

    even = judged.where(F.substring("tile_id", 2, 20).cast("bigint") % 2 == 0)
    funnel.open_round(even, f"{root}/run", MODEL, FIRST_CAP, "sequential")
    funnel.collect(stream(0, 1), f"{root}/run", "first")
    funnel.open_round(judged, f"{root}/run", MODEL, CAP, "sequential")  # the late ones are still in flight: no new round
    funnel.collect(stream(0, 1, 2), f"{root}/run", "second")
    funnel.open_round(judged, f"{root}/run", MODEL, CAP, "sequential")
    funnel.collect(stream(0, 1, 2), f"{root}/run", "third")
    return f"{root}/run"


@query(
    "e2e_funnel",
    f"""WITH {_FUNNEL},
k AS (SELECT *, CAST(substr(tile_id, 2) AS BIGINT) AS c FROM fn),
a AS (SELECT *, row_number() OVER (ORDER BY city, tile_id) <= {FIRST_CAP} AS called FROM k WHERE c % 2 = 0 AND gate = 'candidate_change'),
b AS (SELECT *, row_number() OVER (ORDER BY city, tile_id) <= {CAP} - (SELECT count(*) FILTER (called) FROM a) AS called FROM k WHERE c % 2 = 1 AND gate = 'candidate_change'),
s AS (SELECT tile_id FROM a WHERE called UNION ALL SELECT tile_id FROM b WHERE called),
v AS (SELECT k.tile_id, k.city, k.gate, k.label, s.tile_id IS NOT NULL AS vlm_called, c % 13 = 0 AS failed, c, {_verdict_sql('c')} FROM k LEFT JOIN s ON s.tile_id = k.tile_id)
SELECT tile_id, CAST(city AS VARCHAR) AS city, gate, label, vlm_called, CASE WHEN vlm_called AND NOT failed THEN vlm_verdict END AS vlm_verdict,
  CASE WHEN vlm_called AND failed THEN 'batch result errored: overloaded' END AS error,
  round(CASE WHEN vlm_called AND NOT failed THEN ((1000 + c % 500)*5.0E0 + (100 + c % 50)*25.0E0)*0.5E0/1000000.0E0 ELSE 0.0E0 END, 6) AS cost_usd
FROM v""",
)
def e2e_funnel(spark, d):
    return funnel.rows(spark, run(spark, d)).select("tile_id", "city", "gate", "label", "vlm_called", "vlm_verdict", "error", F.round("cost_usd", 6).alias("cost_usd"))
