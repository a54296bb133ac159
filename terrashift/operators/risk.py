"""Conformal risk control, its falsifier, leakage guards and the threshold sweep."""

from __future__ import annotations

import random
from collections.abc import Callable
from dataclasses import replace
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from terrashift.config import MASK_CHANGING, GateThresholds
from terrashift.functions import stats
from terrashift.operators import gate as gates
from terrashift.sources.storage import written

GRID_STEPS = 200  # fixed value: thresholds 0, 1/200, ..., 1

# The axes that are swept by default.
SWEEP_AXES: dict[str, list[float]] = {
    "background_sigma": [2.0, 3.0, 4.5, 6.0],
    "min_changed_area_percent": [2.0, 5.0, 10.0, 20.0, 35.0],
    "ndvi_strong_min": [0.04, 0.08, 0.14, 0.25],
    "ndbi_strong_min": [0.04, 0.08, 0.14, 0.25],
    "ndvi_delta_mean_min": [0.02, 0.05, 0.10],
    "ndbi_delta_mean_min": [0.02, 0.05, 0.10],
    "urbanization_score_min": [0.05, 0.10, 0.20],
}


def _grid(steps: int = GRID_STEPS):
    return F.explode(F.sequence(F.lit(0), F.lit(steps)))


def misses(rows: DataFrame, truth: str, score: str, keys: list[str] | None = None) -> DataFrame:
    """keys, step, n_pos and missed (positives scored below step / 200).

    Every row is counted once, at the first step above its score; running
    sums over the 201 steps do the rest, so the grid never meets the rows.
    """
    keys = keys or []
    first = F.floor(F.col(score) * GRID_STEPS).cast("int") + 1
    # score < step / 200 must hold exactly as floating point says
    first = F.when(F.col(score) < (first - 1) / F.lit(float(GRID_STEPS)), first - 1).otherwise(first)
    first = F.greatest(F.when(F.col(score) < first / F.lit(float(GRID_STEPS)), first).otherwise(first + 1), F.lit(0))
    at = rows.where(F.col(truth) == 1).groupBy(*keys, first.alias("step")).agg(F.count(F.lit(1)).alias("k"))
    totals = rows.groupBy(*keys).agg(F.count_if(F.col(truth) == 1).alias("n_pos"))
    steps = totals.select(*keys, "n_pos", _grid().alias("step"))
    joined = steps.join(at, [*keys, "step"], "left")
    running = W.partitionBy(*keys).orderBy("step").rowsBetween(W.unboundedPreceding, W.currentRow)
    return joined.select(*keys, "step", "n_pos", F.coalesce(F.sum("k").over(running), F.lit(0)).alias("missed"))


def calibrate(rows: DataFrame, truth: str, score: str, alpha: float, delta: float) -> DataFrame:
    """The highest threshold whose bound on the miss rate is within ``alpha``; NULL and not controlled if there is none."""
    m = misses(rows, truth, score)
    fnr = stats.ratio(F.col("missed"), F.col("n_pos"), 0.0)
    m = m.withColumns({"lambda": F.col("step") / F.lit(float(GRID_STEPS)), "fnr": fnr})
    m = m.withColumn("bound", stats.hoeffding_ucb(F.col("fnr"), F.col("n_pos"), delta))
    best = m.agg(F.max(F.when(F.col("bound") <= alpha, F.struct("lambda", "fnr", "bound"))).alias("b"), F.max("n_pos").alias("n_pos"))
    return best.select(
        F.col("b.lambda").alias("lambda"),
        F.round("b.fnr", 6).alias("fnr"),
        F.round("b.bound", 6).alias("bound"),
        "n_pos",
        F.col("b").isNotNull().alias("controlled"),
    )


def by_group(rows: DataFrame, truth: str, score: str, group: str, threshold: float, alpha: float) -> DataFrame:
    """The falsifier: each group's miss rate at a threshold; ``held`` is NULL without positives."""
    got = rows.groupBy(group).agg(
        F.count_if(F.col(truth) == 1).alias("n_pos"),
        F.count_if((F.col(truth) == 1) & (F.col(score) < threshold)).alias("missed"),
        F.count_if(F.col(score) >= threshold).alias("flagged"),
    )
    fnr = stats.ratio(F.col("missed"), F.col("n_pos"))
    return got.withColumns({"fnr": F.round(fnr, 6), "held": fnr <= alpha})


def overlap(a: DataFrame, b: DataFrame, column: str) -> DataFrame:
    return a.select(column).intersect(b.select(column))


def assert_disjoint(parts: dict[str, DataFrame], column: str) -> None:
    """Raise if any two of the parts share a value: a leak between fitting and evaluation."""
    names = sorted(parts)
    for k, a in enumerate(names):
        for b in names[k + 1 :]:
            if shared := overlap(parts[a], parts[b], column).take(1):
                raise ValueError(f"{a} and {b} share {column} {shared[0][0]!r}")


def split_groups(names: list[str], share: float = 0.3, seed: int = 42) -> tuple[list[str], list[str]]:
    """(calibration, fitting) groups, drawn without replacement; both sides get at least one."""
    names = sorted(set(names))
    if len(names) < 2:
        raise ValueError("a split needs two groups")
    k = min(len(names) - 1, max(1, round(len(names) * share)))
    chosen = sorted(random.Random(seed).sample(names, k))
    return chosen, [n for n in names if n not in chosen]


def split_rows(rows: DataFrame, group: str, share: float = 0.3, seed: int = 42) -> DataFrame:
    """``group`` and side (calibration or fit) of each group: the share of groups whose seeded hash comes first, at least one on both sides.

    Groups are counted and cut by a bounded top-k; their names never meet on
    the driver. Fewer than two groups can't be split.
    """
    names = written(rows.select(group).distinct(), "groups")
    n = names.count()
    if n < 2:
        raise ValueError("a split needs two groups")
    k = min(n - 1, max(1, int(n * share + 0.5)))
    order = F.md5(F.concat(F.lit(f"{seed}:"), F.col(group).cast("string")))
    first = names.orderBy(order, group).limit(k).select(group, F.lit("calibration").alias("_side"))
    return names.join(first, group, "left").select(group, F.coalesce("_side", F.lit("fit")).alias("side"))


def sweep(features: DataFrame, grid: list[dict[str, float]], base: GateThresholds | None = None, truth: str = "label", outer: int = 0) -> DataFrame:
    """combo (its place in ``grid``), counts and balanced accuracy of every combination, best first, the first on a tie.

    With ``outer`` the features come in so many forms (column outer, from 0),
    and the grid is held against each: combo counts forms first.

    A tile's decision depends only on which values of each swept threshold it
    meets. Tiles are counted by label and these answers first; there are no more
    such cells than combinations of answers, however many tiles there are. The
    stated grid then meets the cells and never the tiles. Thresholds that change
    the mask are refused: ``sweep_masks`` makes the features again for those.
    """
    base = base or GateThresholds()
    names = sorted({n for values in grid for n in values})
    if other := set(names) - set(gates.DECIDING):
        raise ValueError(f"can't be swept over given features: {sorted(other)}")
    axes = {n: sorted({values.get(n, getattr(base, n)) for values in grid}) for n in names}
    met = {n: F.array(*(F.coalesce(gates.holds(n, v), F.lit(False)) for v in axes.get(n, [getattr(base, n)]))) for n in gates.DECIDING}
    form = F.col("outer") if outer else F.lit(0)
    if outer:
        features = features.where(F.col("outer") < outer)
    cells = features.where("valid_observation").groupBy(form.alias("form"), F.col(truth).alias("y"), *(c.alias(f"met_{n}") for n, c in met.items())).agg(F.count(F.lit(1)).alias("n"))
    places = [(k, *(axes[n].index(values.get(n, getattr(base, n))) for n in names)) for k, values in enumerate(grid)]
    combos = features.sparkSession.createDataFrame(places, ", ".join(["place int", *(f"at_{n} int" for n in names)]))
    combos = written(combos, "combinations")  # so that its size is known, and cells meet a broadcast list
    hit = F.lit(False)
    for condition, _ in gates.rules(lambda n: F.get(f"met_{n}", F.col(f"at_{n}") if n in axes else F.lit(0))):
        hit = hit | condition
    combo = (F.col("form") * len(grid) + F.col("place")).cast("int").alias("combo")
    judged = cells.crossJoin(combos).select(combo, "y", "n", hit.alias("hit"))
    of = {"tp": "y = 1 and hit", "fp": "y = 0 and hit", "fn": "y = 1 and not hit", "tn": "y = 0 and not hit"}
    got = judged.groupBy("combo").agg(*(F.expr(f"coalesce(sum(n) filter (where {k}), 0)").alias(c) for c, k in of.items()))
    every = features.sparkSession.range(max(1, outer) * len(grid)).select(F.col("id").cast("int").alias("combo"))
    got = every.join(got, "combo", "left").na.fill(0, list(of))  # a row for each combination even without tiles
    score = F.coalesce(stats.balanced_accuracy(*(F.col(c) for c in of)), F.lit(0.0))
    return got.withColumn("score", F.round(score, 6)).orderBy(F.desc("score"), "combo")


def sweep_masks(
    features_of: Callable[[GateThresholds], DataFrame], axes: dict[str, list[float]], base: GateThresholds | None = None, truth: str = "label"
) -> DataFrame:
    """As ``sweep`` over the product of ``axes``, the features made anew for each value of a threshold that changes the mask.

    Those axes are the outer ones, so combinations are numbered with them first.
    """
    base = base or GateThresholds()
    outer = product_grid({n: v for n, v in axes.items() if n in MASK_CHANGING})
    inner = product_grid({n: v for n, v in axes.items() if n not in MASK_CHANGING})
    parts = []
    for k, values in enumerate(outer):
        g = replace(base, **values)
        parts.append(sweep(features_of(g), inner, g, truth).withColumn("combo", F.col("combo") + k * len(inner)))
    return reduce(DataFrame.unionByName, parts).orderBy(F.desc("score"), "combo")


def sweep_sigmas(features: DataFrame, axes: dict[str, list[float]], base: GateThresholds | None = None, truth: str = "label") -> DataFrame:
    """As ``sweep_masks`` where background_sigma is the only axis that changes the mask, over ``features_by_sigma``: one scan for all."""
    inner = product_grid({n: v for n, v in axes.items() if n != "background_sigma"})
    return sweep(features, inner, base, truth, outer=len(axes["background_sigma"]))


def best_and_baseline(features: DataFrame, axes: dict[str, list[float]], base: GateThresholds | None = None, truth: str = "label") -> DataFrame:
    """Two rows, ``best`` and ``baseline``: the swept thresholds, counts, score, and how many combinations were tried.

    ``features`` has a form for each background sigma of ``axes``, and one
    behind them for that of ``base``.
    """
    base = base or GateThresholds()
    names = ["background_sigma", *(n for n in axes if n != "background_sigma")]
    tried = product_grid({n: axes[n] for n in names})
    best = sweep_sigmas(features, axes, base, truth).limit(1)
    at, left = {}, F.col("combo")
    for n in reversed(names):  # the last axis moves fastest
        at[n] = F.element_at(F.array(*(F.lit(float(v)) for v in axes[n])), (left % len(axes[n]) + 1).cast("int"))
        left = F.floor(left / len(axes[n]))
    best = best.withColumns({"which": F.lit("best"), **at})
    own = features.where(F.col("outer") == len(axes["background_sigma"]))
    held = sweep(own, [{}], base, truth).withColumns({"which": F.lit("baseline"), **{n: F.lit(float(getattr(base, n))) for n in names}})
    columns = ["which", *names, "tp", "fp", "fn", "tn", "score"]
    return best.select(*columns).unionByName(held.select(*columns)).withColumn("n_evaluated", F.lit(len(tried)))


def product_grid(axes: dict[str, list[float]]) -> list[dict[str, float]]:
    """All combinations in product order: the last axis moves fastest."""
    out: list[dict[str, float]] = [{}]
    for name, values in axes.items():
        out = [{**held, name: v} for held in out for v in values]
    return out
