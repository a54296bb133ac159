"""Ratios, intervals and binary-classification metrics as expressions over counts."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

Z95 = 1.959963984540054  # fixed value: the normal quantile of a 95 % interval


def ratio(a: Column, b: Column, empty: float | None = None) -> Column:
    """a / b; ``empty`` where b is 0."""
    otherwise = F.lit(empty).cast("double")
    return F.when(b != 0, a.cast("double") / b.cast("double")).otherwise(otherwise)


def wilson(k: Column, n: Column, z: float = Z95) -> tuple[Column, Column]:
    """The Wilson score interval of k successes in n; (0, 1) when n is 0."""
    n, k = n.cast("double"), k.cast("double")
    p = F.when(n > 0, k / n)
    z2 = z * z
    centre = (p + z2 / (2.0 * n)) / (1.0 + z2 / n)
    half = z * F.sqrt(p * (1.0 - p) / n + z2 / (4.0 * n * n)) / (1.0 + z2 / n)
    low = F.when(n > 0, F.greatest(F.lit(0.0), centre - half)).otherwise(F.lit(0.0))
    high = F.when(n > 0, F.least(F.lit(1.0), centre + half)).otherwise(F.lit(1.0))
    return low, high


def precision(tp: Column, fp: Column, fn: Column, tn: Column) -> Column:
    """NULL without negatives (nothing could be wrong), 0 when nothing was predicted."""
    return F.when(fp + tn > 0, ratio(tp, tp + fp, 0.0))


def recall(tp: Column, fn: Column) -> Column:
    return ratio(tp, tp + fn, 0.0)


def specificity(fp: Column, tn: Column) -> Column:
    return ratio(tn, tn + fp)


def f1(tp: Column, fp: Column, fn: Column, tn: Column) -> Column:
    p, r = precision(tp, fp, fn, tn), recall(tp, fn)
    return F.when(p.isNotNull(), F.when(p + r > 0, 2.0 * p * r / (p + r)).otherwise(F.lit(0.0)))


def balanced_accuracy(tp: Column, fp: Column, fn: Column, tn: Column) -> Column:
    return (recall(tp, fn) + specificity(fp, tn)) / 2.0


def iou(tp: Column, fp: Column, fn: Column, empty: float = 0.0) -> Column:
    """Intersection over union; an empty union gives ``empty`` (1 for masks that agree on nothing, 0 in a report)."""
    return ratio(tp, tp + fp + fn, empty)


def hoeffding_ucb(rate: Column, n: Column, delta: float) -> Column:
    """Upper confidence bound of a mean in [0, 1]; 1 without observations."""
    bound = rate + F.sqrt(F.log(F.lit(1.0 / delta)) / (2.0 * n.cast("double")))
    return F.when(n > 0, F.least(F.lit(1.0), bound)).otherwise(F.lit(1.0))
