"""The rule ladder: the first rule that fits decides, with a monotone confidence."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from terrashift.config import GateThresholds
from terrashift.functions.indices import clip, ramp

LOW_QUALITY, CANDIDATE, NO_CHANGE = "low_quality", "candidate_change", "no_change"
REFUSED = "failed Tier 0 quality checks"
INSUFFICIENT = "insufficient change evidence"
RGB_ONLY_MISSING = ["ndvi", "ndbi", "ndwi", "cva"]


def holds(name: str, value: float) -> Column:
    """The one condition that a threshold decides."""
    column, sign = {
        "ndvi_strong_min": ("ndvi_delta_abs_mean", ">="),
        "ndbi_strong_min": ("ndbi_delta_abs_mean", ">="),
        "ndvi_delta_mean_min": ("ndvi_delta_abs_mean", ">="),
        "ndbi_delta_mean_min": ("ndbi_delta_abs_mean", ">="),
        "ndwi_delta_mean_min": ("ndwi_delta_abs_mean", ">="),
        "min_changed_area_percent": ("changed_area_percent", ">="),
        "ssim_no_change_min": ("ssim", "<"),
        "phash_no_change_max": ("phash_distance", ">"),
        "cva_magnitude_mean_min": ("cva_magnitude_mean", ">="),
        "urbanization_score_min": ("urbanization_score", ">="),
        "magnitude_p95_min": ("magnitude_p95", ">="),
        "min_largest_component_px": ("largest_component_px", ">="),
    }[name]
    c, v = F.col(column), F.lit(value)
    return c >= v if sign == ">=" else c > v if sign == ">" else c < v


# The thresholds that only alter the decision: they may be swept over the same features.
DECIDING = (
    "ndvi_strong_min",
    "ndbi_strong_min",
    "ndvi_delta_mean_min",
    "ndbi_delta_mean_min",
    "ndwi_delta_mean_min",
    "min_changed_area_percent",
    "ssim_no_change_min",
    "phash_no_change_max",
    "cva_magnitude_mean_min",
    "urbanization_score_min",
    "magnitude_p95_min",
    "min_largest_component_px",
)


def rules(met: Callable[[str], Column]) -> list[tuple[Column, str]]:
    """(condition, reason) in order, from ``met(threshold)``; the reasons are fixed values that reports are keyed by."""
    area = met("min_changed_area_percent")
    moderate = met("ndvi_delta_mean_min") | met("ndbi_delta_mean_min")
    structural = met("ssim_no_change_min") | met("phash_no_change_max")
    return [
        (met("ndvi_strong_min") | met("ndbi_strong_min"), "strong landcover index change"),
        (moderate & area, "moderate landcover change over a large area"),
        (met("urbanization_score_min") & area, "built-up gain with vegetation loss"),
        (met("magnitude_p95_min") & met("min_largest_component_px"), "concentrated high-magnitude change region"),
        (area & structural & met("cva_magnitude_mean_min"), "structural break with multi-band change vector"),
        (met("ndwi_delta_mean_min") & area, "water extent change over a large area"),
    ]


def confidence(g: GateThresholds) -> Column:
    """A weighted sum of ramps, so more evidence never lowers it; 0 for a refused tile."""
    spectral = F.greatest("ndvi_delta_abs_mean", "ndbi_delta_abs_mean")
    # The weights of the six kinds of evidence.
    parts = [
        (0.35, ramp(spectral, 0.5 * g.ndvi_delta_mean_min, g.ndvi_strong_min)),
        (0.20, ramp(F.col("changed_area_percent"), 0.0, 2.0 * g.min_changed_area_percent)),
        (0.15, ramp(F.col("cva_magnitude_mean"), 0.0, 2.0 * g.cva_magnitude_mean_min)),
        (0.10, ramp(1.0 - F.col("ssim"), 0.0, 1.0 - g.ssim_no_change_min)),
        (0.12, ramp(F.col("urbanization_score"), 0.0, 2.0 * g.urbanization_score_min)),
        (0.08, ramp(F.col("magnitude_p95"), 0.0, 2.0 * g.magnitude_p95_min)),
    ]
    total = sum((w * part for w, part in parts[1:]), parts[0][0] * parts[0][1])
    return F.when(F.col("valid_observation"), clip(total, 0.0, 1.0)).otherwise(F.lit(0.0))


def decide(features: DataFrame, g: GateThresholds | None = None) -> DataFrame:
    """``features`` with gate, gate_reason and gate_confidence (4 decimals); a projection."""
    g = g or GateThresholds()
    reason = F.when(~F.col("valid_observation"), REFUSED)
    for condition, text in rules(lambda name: holds(name, getattr(g, name))):
        reason = reason.when(condition, text)
    reason = reason.otherwise(INSUFFICIENT)
    gate = F.when(F.col("gate_reason") == REFUSED, LOW_QUALITY).when(F.col("gate_reason") == INSUFFICIENT, NO_CHANGE).otherwise(CANDIDATE)
    return features.withColumns({"gate_reason": reason, "gate_confidence": F.round(confidence(g), 4)}).withColumn("gate", gate)


def rgb_only(features: DataFrame) -> DataFrame:
    """Three bands can't carry the indices: every tile is refused, and the row names what is missing."""
    return features.select(
        "tile_id",
        F.lit(LOW_QUALITY).alias("gate"),
        F.lit("index bands unavailable").alias("gate_reason"),
        F.array(*(F.lit(x) for x in RGB_ONLY_MISSING)).alias("unavailable"),
    )


def score(features: DataFrame, g: GateThresholds | None = None, probability: Column | None = None, threshold: float = 0.5) -> DataFrame:
    """Dispatch: the rules, or a learned probability; quality refuses first either way."""
    if probability is None:
        return decide(features, g)
    gate = F.when(~F.col("valid_observation"), LOW_QUALITY).when(probability >= threshold, CANDIDATE).otherwise(NO_CHANGE)
    reason = F.when(~F.col("valid_observation"), REFUSED).otherwise(F.lit("learned scorer"))
    sure = F.when(F.col("valid_observation"), F.round(probability, 4)).otherwise(F.lit(0.0))
    return features.withColumns({"gate": gate, "gate_reason": reason, "gate_confidence": sure})
