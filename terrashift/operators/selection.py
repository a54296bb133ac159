"""Spending a review budget: thresholds, operating points and stratified selection."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from terrashift.operators.metrics import running_down
from terrashift.sources.storage import written


def cumulative(rows: DataFrame, score: str, truth: str | None = None) -> DataFrame:
    """score, flagged (rows at or above it) and hits (positives among them), on distinct scores."""
    hit = F.count_if(F.col(truth) == 1) if truth else F.lit(0).cast("bigint")
    d = rows.groupBy(F.col(score).alias("score")).agg(F.count(F.lit(1)).alias("n"), hit.alias("p"))
    return running_down(d, {"flagged": "n", "hits": "p"}).select("score", "flagged", "hits")


def within_calls(c: DataFrame, calls: DataFrame, k: str) -> DataFrame:
    """Each distinct ``k`` of ``calls`` with b, the lowest point of ``c`` that flags at most k rows; NULL if there is none.

    ``calls`` is a short stated list. Each point goes to the least k that it
    fits, one point of each k is left, and a running maximum over the list
    does the rest: points and list are never multiplied.
    """
    listed = calls.select(k).distinct()
    ks = listed.agg(F.array_sort(F.collect_set(k)).alias("_ks"))
    least = F.get(F.filter("_ks", lambda v: v >= F.col("flagged")), F.lit(0))
    lowest = c.crossJoin(ks).groupBy(least.alias(k)).agg(F.max(F.struct("flagged", "score", "hits")).alias("_b"))
    upto = W.orderBy(k).rowsBetween(W.unboundedPreceding, W.currentRow)
    return listed.join(lowest, k, "left").select(k, F.max("_b").over(upto).alias("b"))


def thresholds_for_calls(rows: DataFrame, calls: DataFrame, score: str) -> DataFrame:
    """For each row k of ``calls`` the lowest score that flags at most k rows, NULL (flag nothing) if there is none.

    A tie that would break the budget is left out as a whole: the budget wins.
    """
    met = within_calls(cumulative(rows, score), calls, "k")
    return met.select("k", F.col("b.score").alias("threshold"), F.coalesce("b.flagged", F.lit(0)).alias("flagged"))


def operating_points(rows: DataFrame, budgets: list[float], cost: float, score: str, truth: str) -> DataFrame:
    """A row for each budget: calls it buys, threshold, flagged, unused calls, recall, precision and spend.

    The budgets are a short stated list.
    """
    c = cumulative(rows, score, truth)
    total = rows.agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col(truth) == 1).alias("positives"))
    wanted = total.select("n", "positives", F.explode(F.array(*(F.lit(float(b)) for b in budgets))).alias("budget"))
    buys = F.least(F.floor(F.col("budget") / cost), F.col("n")) if cost > 0 else F.col("n")
    wanted = wanted.withColumn("calls", F.greatest(buys, F.lit(0)).cast("bigint"))
    best = wanted.join(within_calls(c, wanted, "calls"), "calls")
    flagged, hits = F.coalesce("b.flagged", F.lit(0)), F.coalesce("b.hits", F.lit(0))
    return best.select(
        "budget",
        "calls",
        F.col("b.score").alias("threshold"),
        flagged.alias("flagged"),
        (F.col("calls") - flagged).alias("unused_calls"),
        F.round(F.when(F.col("positives") > 0, hits / F.col("positives")).otherwise(0.0), 6).alias("recall"),
        F.round(F.when(flagged > 0, hits / flagged), 6).alias("precision"),
        F.round(flagged * F.lit(float(cost)), 6).alias("spend"),
    )


def sequential(candidates: DataFrame, budget: int | None) -> DataFrame:
    """The first ``budget`` candidates by city and id; None takes all."""
    ordered = candidates.orderBy("city", "tile_id")
    return ordered if budget is None else ordered.limit(max(0, budget))


def allocation(candidates: DataFrame, budget: int) -> DataFrame:
    """city, n and calls: proportional shares by largest remainder, at least one call for each city, never over budget.

    With fewer calls than cities the largest cities get one each. Otherwise a
    city starts with its whole share, one call at least. Calls that are left go
    to the largest remainders; calls too many come from the smallest ones of
    cities with more than one, again and again while that is needed. A city's
    remainder moves by one with each step, so all steps are keys that are
    known beforehand, and the first of them in order are taken: a bounded
    top-k over cities and steps, and no walk.
    """
    sizes = candidates.groupBy("city").agg(F.count(F.lit(1)).alias("n"))
    if budget <= 0:
        return sizes.withColumn("calls", F.lit(0).cast("bigint"))
    sizes = written(sizes, "cities")
    total, cities = sizes.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count(F.lit(1))).first()
    if budget >= total:
        return sizes.withColumn("calls", F.col("n"))
    if budget < cities:
        largest = sizes.orderBy(F.desc("n"), "city").limit(budget).select("city", F.lit(1).cast("bigint").alias("calls"))
        return sizes.join(largest, "city", "left").na.fill(0, ["calls"])
    fair = F.lit(budget) * F.col("n") / F.lit(total)
    start = F.least(F.col("n"), F.greatest(F.lit(1), F.floor(fair))).cast("bigint")
    held = written(sizes.withColumns({"start": start, "rest": fair - start}), "shares")
    left = budget - held.agg(F.sum("start")).first()[0]
    if left >= 0:  # a city that could take more has a remainder, and there are at least as many as calls left
        steps = held.where("start < n").orderBy(F.desc("rest"), F.desc("city")).limit(left).select("city", F.lit(1).alias("step"))
    else:
        room = F.sequence(F.lit(0).cast("bigint"), F.least(F.col("start") - 2, F.lit(-left - 1)))
        each = held.where("start > 1").select("city", F.explode(room).alias("k"), "rest")
        steps = each.orderBy(F.col("rest") + F.col("k"), "city").limit(-left).select("city", F.lit(-1).alias("step"))
    moved = steps.groupBy("city").agg(F.sum("step").alias("moved"))
    got = held.join(moved, "city", "left")
    return got.select("city", "n", (F.col("start") + F.coalesce("moved", F.lit(0))).alias("calls"))


def drawn_order(seed: int, key: str = "tile_id") -> Column:
    """A seeded order of ids, the same on any cluster."""
    return F.md5(F.concat(F.lit(f"{seed}:"), F.col(key).cast("string")))


def stratified(candidates: DataFrame, budget: int | None, seed: int = 42) -> DataFrame:
    """Each city's share of the budget, drawn by a seeded hash of the id.

    No city takes more than the budget, which is said as a number: each task
    keeps so many of a city before they meet, however large the city is.
    """
    if budget is None:
        return candidates.orderBy("city", "tile_id")
    ranked = W.partitionBy("city").orderBy(drawn_order(seed), "tile_id")
    calls = allocation(candidates, budget).select("city", "calls")
    first = candidates.withColumn("_rank", F.row_number().over(ranked)).where(F.col("_rank") <= max(0, budget))
    return first.join(calls, "city").where("_rank <= calls").drop("_rank", "calls").orderBy("city", "tile_id")


def select_candidates(candidates: DataFrame, budget: int | None, strategy: str = "stratified", seed: int = 42) -> DataFrame:
    if strategy not in ("sequential", "stratified"):
        raise ValueError(f"unknown strategy {strategy!r}")
    return sequential(candidates, budget) if strategy == "sequential" else stratified(candidates, budget, seed)


def sample_tiles(tiles: DataFrame, n: int | None, seed: int = 42) -> DataFrame:
    """n tiles by the least seeded hash, in order of id; None or a larger n gives all."""
    drawn = tiles if n is None else tiles.orderBy(drawn_order(seed), "tile_id").limit(n)
    return drawn.orderBy("tile_id")
