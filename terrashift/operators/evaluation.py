"""Evaluation of a run end to end: the report row, pixel agreement, controls, and what is published."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from terrashift.functions import indices as ix
from terrashift.functions import stats
from terrashift.operators import gate, kernels, metrics
from terrashift.sources import storage
from terrashift.sources.storage import written

BANDS = ("blue", "green", "red", "nir", "swir")
REPORTED = ("precision", "recall", "specificity", "f1", "balanced_accuracy", "iou")


def _percent(part: Column, whole: Column) -> Column:
    """Two decimals; of nothing, 0."""
    return F.round(100.0 * part / F.greatest(whole, F.lit(1)), 2)


def summary(judged: DataFrame, truth: str = "label", group: str = "city") -> DataFrame:
    """One row: tiles, refusals, reductions, groups, and metrics over the tiles that were judged.

    A refused tile is no negative: it is left out of the metrics and counted on
    its own. ``groups_scored`` are the groups with at least one judged tile.
    """
    refused, flagged = F.col("gate") == gate.LOW_QUALITY, F.col("gate") == gate.CANDIDATE
    y = F.col(truth)
    got = judged.agg(
        F.count(F.lit(1)).alias("n_tiles"),
        F.count_if(refused).alias("n_low_quality"),
        F.count_if(flagged).alias("n_candidate_change"),
        F.sort_array(F.collect_set(group)).alias("groups"),
        F.sort_array(F.collect_set(F.when(~refused, F.col(group)))).alias("groups_scored"),
        F.count_if(flagged & (y == 1)).alias("tp"),
        F.count_if(flagged & (y == 0)).alias("fp"),
        F.count_if(~flagged & ~refused & (y == 1)).alias("fn"),
        F.count_if(~flagged & ~refused & (y == 0)).alias("tn"),
    )
    n, low, hits = F.col("n_tiles"), F.col("n_low_quality"), F.col("n_candidate_change")
    got = got.withColumns(
        {
            "n_assessable": n - low,
            "candidate_rate_pct": _percent(hits, n),
            "tier0_refused_pct": _percent(low, n),
            "gate_filtered_pct": _percent(n - low - hits, n - low),
            "total_reduction_pct": _percent(n - hits, n),
        }
    )
    return metrics.derived(got)


def evaluate(features: DataFrame, judge: Callable[[DataFrame], DataFrame] = gate.decide, truth: str = "label", group: str = "city") -> tuple[DataFrame, DataFrame]:
    """(judged tiles, their summary)."""
    judged = judge(features)
    return judged, summary(judged, truth, group)


def pixel_summary(pixels: DataFrame, truth: str, changed: str = "changed") -> DataFrame:
    """Confusion of the change mask with the true one over the cells observed at both dates; IoU has 4 decimals and is 0 without any change."""
    seen = pixels.where(F.col("obs1") & F.col("obs2"))
    c = metrics.counts(seen, F.col(truth), F.col(changed))
    return c.withColumn("iou", F.round(stats.iou(F.col("tp"), F.col("fp"), F.col("fn")), 4))


def compare(features: DataFrame, judges: dict[str, Callable[[DataFrame], DataFrame]], truth: str = "label", group: str = "city") -> DataFrame:
    """A row for each way of judging, over the same tiles."""
    rows = None
    for name in sorted(judges):
        one = summary(judges[name](features), truth, group)
        one = one.select(F.lit(name).alias("scorer"), "n_tiles", "n_low_quality", "n_candidate_change", "tp", "fp", "fn", "tn", *REPORTED)
        rows = one if rows is None else rows.unionByName(one)
    return rows


def ranking(scored: DataFrame, recall: float, truth: str = "label", score: str = "score") -> DataFrame:
    """One row: average_precision, roc_auc and the best precision at ``recall`` or above (0 if it isn't reached) of one scorer."""
    points = written(metrics.distinct_scores(scored, truth, score), "distinct-scores")
    down = metrics.running_down(points, {"tp": "p", "fp": "n"})
    total = points.agg(F.sum("p").alias("positives"), F.sum("n").alias("negatives"))
    p, n, fp = (F.col(c).cast("double") for c in ("p", "n", "fp"))
    precision = F.col("tp") / (F.col("tp") + F.col("fp"))
    sums = down.crossJoin(F.broadcast(total)).agg(  # one row by construction
        F.first("positives").alias("positives"),
        F.first("negatives").alias("negatives"),
        F.sum(p * precision).alias("ap"),
        F.sum(p * fp - p * n / 2.0).alias("lost"),
        F.max(F.when(F.col("tp") >= recall * F.col("positives"), precision)).alias("at"),
    )
    pairs = F.col("positives").cast("double") * F.col("negatives")
    return sums.select(
        "positives",
        "negatives",
        F.round(F.col("ap") / F.col("positives"), 6).alias("average_precision"),
        F.round(F.when(pairs > 0, 1.0 - F.col("lost") / pairs), 6).alias("roc_auc"),
        F.round(F.coalesce("at", F.lit(0.0)), 6).alias("precision_at_recall"),
    )


def rank_scorers(scorers: dict[str, DataFrame], recall: float, truth: str = "label", score: str = "score") -> DataFrame:
    """scorer and its ``ranking``, a row each; every scorer's rows hold ``truth`` and ``score``, over the same tiles."""
    rows = None
    for name in sorted(scorers):
        one = ranking(scorers[name], recall, truth, score).select(F.lit(name).alias("scorer"), "*")
        rows = one if rows is None else rows.unionByName(one)
    return rows


def always(flag: bool) -> Callable[[DataFrame], DataFrame]:
    """The baselines that flag every tile, or none; quality still refuses first."""
    said = gate.CANDIDATE if flag else gate.NO_CHANGE
    return lambda features: features.withColumn("gate", F.when(~F.col("valid_observation"), gate.LOW_QUALITY).otherwise(said))


def above(column: str, cut: float) -> Callable[[DataFrame], DataFrame]:
    """The baseline that flags by one feature."""
    return lambda features: gate.score(features, probability=F.col(column), threshold=cut)


def identical(pixels: DataFrame) -> DataFrame:
    """Paired pixels whose second date is the first."""
    return pixels.withColumns({f"{b}2": F.col(f"{b}1") for b in BANDS})


def relit(pixels: DataFrame) -> DataFrame:
    """Paired pixels whose second date is the first in another light."""
    return pixels.withColumns({f"{b}2": ix.photometric(F.col(f"{b}1"), blue=b == "blue") for b in BANDS})


def shifted(pixels: DataFrame, by: int = 3) -> DataFrame:
    """Paired pixels whose second date is the first, moved ``by`` columns around its scene."""
    width = pixels.groupBy("scene").agg((F.max("x") - F.min("x") + 1).alias("_w"), F.min("x").alias("_x0"))
    moved = pixels.join(width, "scene").select("scene", "y", (F.pmod(F.col("x") - F.col("_x0") + by, "_w") + F.col("_x0")).alias("x"), *(F.col(f"{b}1").alias(f"{b}2") for b in BANDS))
    return pixels.drop(*(f"{b}2" for b in BANDS)).join(moved, ["scene", "y", "x"])


def control_battery(pixels: DataFrame, judge: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """name, n_tiles, n_flagged, n_changed and passed of four controls; ``judge`` makes judged tiles of paired pixels.

    identity: a scene against itself has no changed cell and no candidate.
    photometric: another light is no candidate. real_pair_differs: the given
    pair has changed cells, without which the first check says nothing.
    tier0_assessed: the masks come from observed cells.
    """
    calm = (F.col("n_changed") == 0) & (F.col("n_flagged") == 0)
    passes = [
        (identical(pixels), {"identity": calm}),
        (relit(pixels), {"photometric": F.col("n_flagged") == 0}),
        (pixels, {"real_pair_differs": F.col("n_changed") > 0, "tier0_assessed": F.col("n_seen") > 0}),
    ]
    rows = None
    for given, checks in passes:  # each set of pixels is judged once
        one = judge(given).agg(
            F.count(F.lit(1)).alias("n_tiles"),
            F.count_if(F.col("gate") == gate.CANDIDATE).alias("n_flagged"),
            F.count_if(F.col("changed_area_percent") > 0).alias("n_changed"),
            F.count_if(F.col("n_valid") > 0).alias("n_seen"),
        )
        said = F.array(*(F.struct(F.lit(name).alias("name"), passed.alias("passed")) for name, passed in checks.items()))
        one = one.select(F.inline(said), "n_tiles", "n_flagged", "n_changed").select("name", "n_tiles", "n_flagged", "n_changed", "passed")
        rows = one if rows is None else rows.unionByName(one)
    return rows


def registration_control(pixels: DataFrame, by: int = 3, band: str = "red") -> DataFrame:
    """scene, registration_px and passed: a known shift must be measured to half a pixel."""
    got = kernels.scene_registration(shifted(pixels, by), band)
    return got.select("scene", "registration_px", F.col("registration_px").between(by - 0.5, by + 0.5).alias("passed"))


def markdown(report: DataFrame, split: str) -> DataFrame:
    """The summary as lines of a Markdown table, one row each."""
    shown = [(name, F.col(name)) for name in ("n_tiles", "n_low_quality", "n_assessable", "n_candidate_change", "tier0_refused_pct", "gate_filtered_pct", "total_reduction_pct", *REPORTED)]
    intervals = {"precision", "recall", "specificity"}
    lines = [F.lit(f"# Gate evaluation: {split}"), F.lit(""), F.lit("| Metric | Value | 95% CI |"), F.lit("|---|---|---|")]
    for name, value in shown:
        text = F.coalesce(value.cast("string"), F.lit("not assessed"))
        span = F.concat(F.lit("["), F.col(f"{name}_low"), F.lit(", "), F.col(f"{name}_high"), F.lit("]")) if name in intervals else F.lit("")
        lines.append(F.concat(F.lit(f"| {name} | "), text, F.lit(" | "), span, F.lit(" |")))
    return report.select(F.posexplode(F.array(*lines)).alias("line", "value"))


def publish(judged: DataFrame, report: DataFrame, path: str, split: str, note: dict | None = None) -> str:
    """features (CSV with a header), summary (JSON) and report (Markdown) as one new version of ``path``, all or nothing; its folder."""
    lines = markdown(report, split).coalesce(1).sortWithinPartitions("line").select("value")
    parts = {
        "features": lambda folder: judged.write.csv(folder, header=True),
        "summary": lambda folder: report.coalesce(1).write.json(folder),
        "report": lambda folder: lines.write.text(folder),
    }
    return storage.publish(judged.sparkSession, path, parts, {"split": split} | (note or {}))
