"""Classification metrics: counts first (mergeable, one shuffle of a few rows), then expressions over them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from terrashift.functions import stats


def counts(rows: DataFrame, truth: Column, predicted: Column, keys: list[str] | None = None) -> DataFrame:
    """tp, fp, fn and tn of 0/1 (or boolean) columns, for each key."""
    y, p = truth.cast("int"), predicted.cast("int")
    return rows.groupBy(*(keys or [])).agg(
        F.count_if((y == 1) & (p == 1)).alias("tp"),
        F.count_if((y == 0) & (p == 1)).alias("fp"),
        F.count_if((y == 1) & (p == 0)).alias("fn"),
        F.count_if((y == 0) & (p == 0)).alias("tn"),
    )


def derived(confusion: DataFrame, digits: int = 6) -> DataFrame:
    """All ratios of a confusion table, with Wilson intervals of precision, recall and specificity."""
    tp, fp, fn, tn = (F.col(c) for c in ("tp", "fp", "fn", "tn"))
    out = {
        "precision": stats.precision(tp, fp, fn, tn),
        "recall": stats.recall(tp, fn),
        "specificity": stats.specificity(fp, tn),
        "f1": stats.f1(tp, fp, fn, tn),
        "balanced_accuracy": stats.balanced_accuracy(tp, fp, fn, tn),
        "iou": stats.iou(tp, fp, fn),
    }
    for name, (k, n) in {"precision": (tp, tp + fp), "recall": (tp, tp + fn), "specificity": (tn, tn + fp)}.items():
        out[f"{name}_low"], out[f"{name}_high"] = stats.wilson(k, n)
    return confusion.withColumns({k: F.round(v, digits) for k, v in out.items()})


def distinct_scores(rows: DataFrame, truth: str, score: str) -> DataFrame:
    """score, p and n: positives and negatives at each distinct score.

    What follows is on distinct scores, not rows.
    """
    return rows.groupBy(F.col(score).alias("score")).agg(
        F.count_if(F.col(truth) == 1).alias("p"), F.count_if(F.col(truth) == 0).alias("n")
    )


SLICES = 200


def running_down(points: DataFrame, sums: dict[str, str], by: str = "score") -> DataFrame:
    """``points`` with running sums (new name: summed column) from the highest ``by`` down.

    Points are dealt into slices at approximate quantiles. Each slice is summed
    on its own and starts at the sum of those above it, so only the slices' own
    totals, at most 201 rows, ever meet in one task. Slices only deal the work:
    the sums are exact wherever the cuts fall.
    """
    cuts = points.agg(F.percentile_approx(by, [k / SLICES for k in range(1, SLICES)], 10000).alias("_cuts"))
    at = F.coalesce(F.size(F.filter("_cuts", lambda cut: cut < F.col(by))), F.lit(0))
    placed = points.crossJoin(cuts).withColumn("_slice", at).drop("_cuts")
    totals = placed.groupBy("_slice").agg(*(F.sum(c).alias(f"_{k}") for k, c in sums.items()))
    before = W.orderBy(F.desc("_slice")).rowsBetween(W.unboundedPreceding, -1)
    above = totals.select("_slice", *(F.coalesce(F.sum(f"_{k}").over(before), F.lit(0)).alias(f"_{k}") for k in sums))
    within = W.partitionBy("_slice").orderBy(F.desc(by)).rowsBetween(W.unboundedPreceding, W.currentRow)
    return placed.join(above, "_slice").select(*points.columns, *((F.col(f"_{k}") + F.sum(c).over(within)).alias(k) for k, c in sums.items()))


def curve(rows: DataFrame, truth: str, score: str) -> DataFrame:
    """The precision-recall curve: a point for each distinct score, from the highest down."""
    return running_down(distinct_scores(rows, truth, score), {"tp": "p", "fp": "n"})


def average_precision(rows: DataFrame, truth: str, score: str) -> DataFrame:
    """Sum over the curve of (step in recall) * precision."""
    return curve(rows, truth, score).agg(
        F.round(F.sum(F.col("p") * F.col("tp") / (F.col("tp") + F.col("fp"))) / F.sum("p"), 6).alias("average_precision"),
        F.sum("p").alias("positives"),
    )


def roc_auc(rows: DataFrame, truth: str, score: str) -> DataFrame:
    """The chance that a positive outscores a negative; a tie counts half."""
    p, n, fp = (F.col(c).cast("double") for c in ("p", "n", "fp"))
    pairs = F.sum(p) * F.sum(n)
    return curve(rows, truth, score).agg(F.round((pairs - F.sum(p * fp) + F.sum(p * n) / 2.0) / pairs, 6).alias("roc_auc"))


def precision_at_recall(rows: DataFrame, truth: str, score: str, recalls: list[float]) -> DataFrame:
    """For each wanted recall the best precision at it or above, and the threshold that gives it."""
    c = curve(rows, truth, score)
    c = c.crossJoin(c.agg(F.sum("p").alias("total")))
    c = c.withColumns({"recall": F.col("tp") / F.col("total"), "precision": F.col("tp") / (F.col("tp") + F.col("fp"))})
    wanted = F.explode(F.array(*(F.lit(r) for r in recalls)))
    got = c.select("*", wanted.alias("wanted")).where("recall >= wanted")
    best = got.groupBy("wanted").agg(F.max(F.struct("precision", "score")).alias("b"))
    return best.select("wanted", F.round("b.precision", 6).alias("precision"), F.col("b.score").alias("threshold"))


def playground(rows: DataFrame, truth: Column, flagged: Column) -> DataFrame:
    """What the threshold explorer shows: precision is NULL when nothing is flagged; F1 follows the metrics' rule."""
    c = counts(rows, truth, flagged)
    p = stats.ratio(F.col("tp"), F.col("tp") + F.col("fp"))
    r = stats.ratio(F.col("tp"), F.col("tp") + F.col("fn"))
    f = F.when(p.isNotNull() & r.isNotNull(), F.when(p + r > 0, 2.0 * p * r / (p + r)).otherwise(F.lit(0.0)))
    return c.withColumns({"precision": F.round(p, 6), "recall": F.round(r, 6), "f1": F.round(f, 6)})
