"""Usage to money, and the funnel's accounts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from terrashift.config import CACHE_READ_MULTIPLIER, CACHE_WRITE_MULTIPLIER, RATES_USD_PER_MTOK


def rates(spark: SparkSession, table: dict[str, tuple[float, float]] | None = None) -> DataFrame:
    """model, input_usd and output_usd for a million tokens."""
    rows = [F.struct(F.lit(m).alias("model"), F.lit(i).alias("input_usd"), F.lit(o).alias("output_usd")) for m, (i, o) in (table or RATES_USD_PER_MTOK).items()]
    return spark.range(1).select(F.inline(F.array(*rows)))


def priced(usage: DataFrame, rate: DataFrame) -> DataFrame:
    """``usage`` with cost_usd, cost_usd_synchronous and priced; a model without a rate costs 0 and says so."""
    joined = usage.join(rate, "model", "left")

    def cost(factor):
        tokens_in = (
            F.col("input_tokens")
            + F.col("cache_read_input_tokens") * CACHE_READ_MULTIPLIER
            + F.col("cache_creation_input_tokens") * CACHE_WRITE_MULTIPLIER
        )
        usd = (tokens_in * F.col("input_usd") + F.col("output_tokens") * F.col("output_usd")) * factor / 1_000_000
        return F.coalesce(usd, F.lit(0.0))

    half = F.when(F.col("batch"), 0.5).otherwise(1.0)
    out = joined.withColumns(
        {"cost_usd": cost(half), "cost_usd_synchronous": cost(F.lit(1.0)), "priced": F.col("input_usd").isNotNull()}
    )
    return out.drop("input_usd", "output_usd")


def funnel(rows: DataFrame) -> DataFrame:
    """One row: three separate reductions, spend, counterfactuals and whether the figures are complete.

    ``rows`` has gate, vlm_called, batch, cost_usd, cost_usd_synchronous and priced.
    """
    called = F.col("vlm_called")
    a = rows.agg(
        F.count(F.lit(1)).alias("n_pairs"),
        F.count_if(F.col("gate") == "low_quality").alias("n_tier0_refused"),
        F.count_if(F.col("gate") == "no_change").alias("n_gate_filtered"),
        F.count_if(F.col("gate") == "candidate_change").alias("n_candidates"),
        F.count_if(called).alias("n_vlm_calls"),
        F.count_if(called & F.col("batch")).alias("n_batch_calls"),
        F.count_if(called & ~F.col("priced")).alias("n_unpriced_calls"),
        F.coalesce(F.sum(F.when(called, F.col("cost_usd"))), F.lit(0.0)).alias("total_usd"),
        F.coalesce(F.avg(F.when(called, F.col("cost_usd"))), F.lit(0.0)).alias("per_call"),
        F.coalesce(F.avg(F.when(called, F.col("cost_usd_synchronous"))), F.lit(0.0)).alias("per_call_sync"),
    )
    n = F.greatest(F.col("n_pairs"), F.lit(1))
    assessable = F.col("n_pairs") - F.col("n_tier0_refused")
    naive, projected = F.col("per_call") * F.col("n_pairs"), F.col("per_call") * F.col("n_candidates")
    sync = F.col("per_call_sync") * F.col("n_candidates")
    return a.select(
        "n_pairs",
        "n_tier0_refused",
        "n_gate_filtered",
        "n_candidates",
        "n_vlm_calls",
        "n_batch_calls",
        "n_unpriced_calls",
        assessable.alias("n_assessable"),
        F.round(100.0 * F.col("n_tier0_refused") / n, 2).alias("tier0_refused_pct"),
        F.round(100.0 * F.col("n_gate_filtered") / F.greatest(assessable, F.lit(1)), 2).alias("gate_filtered_pct"),
        F.round(100.0 * (F.col("n_pairs") - F.col("n_candidates")) / n, 2).alias("total_reduction_pct"),
        F.round(100.0 * F.col("n_vlm_calls") / n, 2).alias("vlm_call_rate_pct"),
        F.round("total_usd", 4).alias("total_usd"),
        F.round(F.col("total_usd") / n, 6).alias("usd_per_pair"),
        F.round("per_call", 6).alias("usd_per_call"),
        F.round(naive, 4).alias("review_everything_usd"),
        F.round(projected, 4).alias("projected_usd"),
        F.round(sync, 4).alias("projected_synchronous_usd"),
        F.round(F.when(naive > 0, 100.0 * (1.0 - projected / naive)).otherwise(0.0), 2).alias("savings_pct"),
        F.round(F.when(sync > 0, 100.0 * (1.0 - projected / sync)).otherwise(0.0), 2).alias("batch_saving_pct"),
        (F.col("n_vlm_calls") < F.col("n_candidates")).alias("budget_capped"),
        (F.col("n_unpriced_calls") == 0).alias("cost_is_complete"),
    )


def city_coverage(rows: DataFrame, candidates: DataFrame | None = None) -> DataFrame:
    """city, candidates and verified; cities known only from ``candidates`` (city, n) appear with nothing verified."""
    got = rows.where(F.col("gate") == "candidate_change").groupBy("city").agg(
        F.count(F.lit(1)).alias("candidates"), F.count_if("vlm_called").alias("verified")
    )
    if candidates is None:
        return got
    both = got.join(candidates.groupBy("city").agg(F.max("n").alias("_n")), "city", "full")
    return both.select("city", F.coalesce("candidates", "_n").alias("candidates"), F.coalesce("verified", F.lit(0)).alias("verified"))


def verdict_histogram(rows: DataFrame) -> DataFrame:
    return rows.where("vlm_verdict is not null").groupBy("vlm_verdict").agg(F.count(F.lit(1)).alias("n"))


def second_tier(calls: DataFrame) -> DataFrame:
    """One row: precision of the gate alone and with the verifier, errors rejected, changes retained; an uncertain verdict rejects."""
    from terrashift.functions.stats import wilson

    y, passed = F.col("label"), F.coalesce(F.col("vlm_verdict") == "real_change", F.lit(False))
    a = calls.where("label is not null").agg(
        F.count(F.lit(1)).alias("n"),
        F.count_if(y == 1).alias("changes"),
        F.count_if(y == 0).alias("errors"),
        F.count_if(passed).alias("forwarded"),
        F.count_if(passed & (y == 1)).alias("forwarded_changes"),
        F.count_if(~passed & (y == 0)).alias("rejected_errors"),
    )
    pairs = {
        "gate_alone": ("changes", "n"),
        "gate_plus_verifier": ("forwarded_changes", "forwarded"),
        "errors_rejected": ("rejected_errors", "errors"),
        "changes_retained": ("forwarded_changes", "changes"),
    }
    out = []
    for name, (k, n) in pairs.items():
        low, high = wilson(F.col(k), F.col(n))
        out += [
            F.round(F.when(F.col(n) > 0, F.col(k) / F.col(n)).otherwise(0.0), 6).alias(name),
            F.round(low, 6).alias(f"{name}_low"),
            F.round(high, 6).alias(f"{name}_high"),
        ]
    return a.select("n", *out)


def needs_review(verdicts: DataFrame) -> DataFrame:
    """An uncertain verdict, or one below half confidence, goes to a person."""
    rule = (F.col("vlm_verdict") == "uncertain") | (F.col("vlm_confidence") < 0.5)
    return verdicts.withColumn("human_review", F.coalesce(rule, F.lit(True)))
