"""The funnel end to end: judged tiles, calls within a cap, answers collected by id, and a ledger that can be resumed.

A run lives in a folder: ``plans`` holds a part for each round, with every
tile that was judged in it and whether it is called, and ``answers`` a part for
each micro-batch of results. The ledger is both: tiles that were not called are
final with their plan, the others with their answer, and the last row counts. A
part is written as a whole before it is seen, and one that is written again
replaces itself, so a step that is repeated after a failure changes nothing.

Calls in flight are paid for: while a round has unanswered calls, opening the
run again returns that round instead of choosing another. Spend and calls of
a resumed run are what the ledger says, so a cap holds over all rounds.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from terrashift.operators import cost, gate, ledger, selection, verdicts
from terrashift.sources.files import LEDGER
from terrashift.sources.storage import exists, folders

RESULT = "custom_id string, kind string, error string, message string"
_ROW = f"{LEDGER}, seq bigint"
_PLAN = f"{_ROW}, called boolean, model string, in_batch boolean"
_NAMES = [c.split()[0] for c in _ROW.split(", ")]


def _parts(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """The rows of all parts below ``path`` that were written to their end."""
    held = [f"{path}/{name}" for name in folders(spark, path, "") if exists(spark, f"{path}/{name}/_SUCCESS")]
    return spark.read.schema(schema).json(held) if held else spark.createDataFrame([], schema)


def plans(spark: SparkSession, path: str) -> DataFrame:
    return _parts(spark, f"{path}/plans", _PLAN)


def rows(spark: SparkSession, path: str) -> DataFrame:
    """The ledger of a run: the last row of each tile."""
    final = plans(spark, path).where("not called").select(_NAMES)
    return ledger.last_wins(final.unionByName(_parts(spark, f"{path}/answers", _ROW)), "tile_id", ["seq"]).drop("seq")


def outstanding(spark: SparkSession, path: str) -> DataFrame:
    """custom_id, city, model and batch of calls without an answer so far: late or lost, and paid for either way."""
    calls = plans(spark, path).where("called").join(rows(spark, path).select("tile_id"), "tile_id", "left_anti")
    return calls.select(F.col("tile_id").alias("custom_id"), "city", "model", F.col("in_batch").alias("batch"))


def open_round(
    judged: DataFrame, path: str, model: str, cap: int | None = None, strategy: str = "stratified", seed: int = 42, batch: bool = True
) -> DataFrame:
    """The calls to make now, as ``outstanding`` gives them: those still in flight, or a new round over the tiles that the ledger lacks.

    ``judged`` has tile_id, city and gate; its other ledger columns are kept.
    Tiles that are not called are final with the round. The cap counts every
    call that the ledger holds.
    """
    spark = judged.sparkSession
    waiting = outstanding(spark, path)
    if not waiting.isEmpty():
        return waiting
    done = rows(spark, path)
    number = len([n for n in folders(spark, f"{path}/plans", "round-") if exists(spark, f"{path}/plans/{n}/_SUCCESS")])
    pending = ledger.remaining(judged, done)
    left = ledger.remaining_budget(cap, done.where("vlm_called").count())
    chosen = selection.select_candidates(pending.where(F.col("gate") == gate.CANDIDATE), left, strategy, seed).select("tile_id", F.lit(True).alias("_called"))
    blank = {"vlm_called": F.lit(False), "cost_usd": F.lit(0.0), "seq": F.lit(number), "called": F.coalesce("_called", F.lit(False))}
    blank |= {"model": F.lit(model), "in_batch": F.lit(batch)}
    planned = pending.join(chosen, "tile_id", "left")
    cells = (c.split() for c in _PLAN.split(", "))
    planned = planned.select(*(blank.get(n, F.col(n) if n in pending.columns else F.lit(None)).cast(k).alias(n) for n, k in cells))
    planned.write.mode("overwrite").json(f"{path}/plans/round-{number:06d}")
    return outstanding(spark, path)


def answered(results: DataFrame, planned: DataFrame, number: int) -> DataFrame:
    """Ledger rows of ``results`` (RESULT) by id, never by position; results of no call in ``planned`` are left out.

    A result that did not succeed is an error without a verdict and without a
    price; an unusable answer is an uncertain verdict that was paid for. Of
    several results of a call in one batch one that succeeded counts.
    """
    once = results.groupBy("custom_id").agg(F.max(F.struct((F.col("kind") == "succeeded").alias("ok"), "kind", "error", "message")).alias("r")).select("custom_id", "r.*")
    calls = planned.where("called").dropDuplicates(["tile_id"])
    met = once.join(calls.select(F.col("tile_id").alias("custom_id"), "model", F.col("in_batch").alias("batch")), "custom_id")
    met = verdicts.with_usage(verdicts.parsed(met))
    paid = cost.priced(met, cost.rates(results.sparkSession))
    ok = F.col("ok") & F.col("message").isNotNull()
    error = F.when(~ok, F.concat(F.lit("batch result "), F.coalesce("kind", F.lit("unknown")), F.lit(": "), F.coalesce("error", "kind", F.lit("unknown"))))
    found = paid.select(
        F.col("custom_id").alias("tile_id"),
        error.alias("_error"),
        *(F.when(ok, F.col(c)).alias(f"_{c}") for c in ("vlm_verdict", "vlm_change_type", "vlm_confidence")),
        *(F.when(ok, F.round(c, 6)).otherwise(0.0).alias(f"_{c}") for c in ("cost_usd", "cost_usd_synchronous")),
        F.col("batch").alias("_batch"),
    )
    both = calls.join(found, "tile_id")
    new = {c: F.col(f"_{c}") for c in ("error", "vlm_verdict", "vlm_change_type", "vlm_confidence", "cost_usd", "cost_usd_synchronous", "batch")}
    new |= {"vlm_called": F.lit(True), "seq": F.lit((1 << 48) + number).cast("bigint")}
    return both.select(*(new.get(n, F.col(n)).alias(n) for n in _NAMES))


def collect(results: DataFrame, path: str, name: str = "results") -> None:
    """Take what the stream ``results`` (RESULT) holds now into the run's ledger, a part for each micro-batch.

    The progress of the stream ``name`` is kept with the run: the next call
    takes what came since. A batch that was interrupted is run again under its
    number and replaces its own part.
    """
    spark = results.sparkSession

    def keep(part: DataFrame, number: int) -> None:
        answered(part, plans(spark, path), number).write.mode("overwrite").json(f"{path}/answers/{name}-{number:08d}")

    query = results.writeStream.foreachBatch(keep).option("checkpointLocation", f"{path}/progress/{name}").trigger(availableNow=True).start()
    query.awaitTermination()
    if query.exception():
        raise query.exception()


def report(spark: SparkSession, path: str) -> DataFrame:
    """The funnel's accounts over the ledger, spend of earlier rounds included."""
    models = plans(spark, path).where("called").select("tile_id", "model").dropDuplicates(["tile_id"])
    listed = cost.rates(spark).select("model", F.lit(True).alias("priced"))
    known = rows(spark, path).join(models, "tile_id", "left").join(listed, "model", "left")
    return cost.funnel(known.withColumns({c: F.coalesce(c, F.lit(False)) for c in ("priced", "batch")}))
