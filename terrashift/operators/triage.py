"""Whole scenes from their bands to a decision: one call for what the single operators do, and its published result.

Bands of paired pixels become masks without shadow, deltas, a scene-wide cut,
the despeckled change over the whole scene, features and the ladder's answer.
Statistics of a scene are exact and distributed (``quantiles``), regions cross
block borders (``regions``); only structural similarity and the registration
error take a scene in one task, and both may be given instead.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from terrashift.config import Settings
from terrashift.operators import evaluation, gate, kernels, quantiles, regions, scene
from terrashift.sources import storage
from terrashift.sources.pixels import BAND_NAMES
from terrashift.sources.storage import written

TAILS = {"ndvi_delta_p10": ("d_ndvi", 0.1), "ndbi_delta_p90": ("d_ndbi", 0.9), "magnitude_p95": ("magnitude", 0.95), "magnitude_p99": ("magnitude", 0.99)}


def changed_cells(pixels: DataFrame, settings: Settings | None = None, block: int = 512) -> DataFrame:
    """Paired pixels with masks, deltas and the despeckled change mask of their scene, in a written table."""
    s = settings or Settings()
    flagged = scene.combined(scene.with_shadow(scene.masks(pixels, s.masks), s.masks.shadow_search_radius_px))
    found = written(scene.with_magnitude(scene.deltas(flagged)), "triage-deltas")
    raw = written(scene.raw_change(found, scene.scene_cut(found, s.gate), s.gate).select("scene", "y", "x", "changed"), "triage-raw")
    clean = regions.despeckled(raw, radius=s.gate.open_radius_px, min_size=s.gate.min_component_size_px, block=block)
    return written(found.join(clean, ["scene", "y", "x"]), "triage-cells")


def scene_features(cells: DataFrame, block: int = 512) -> DataFrame:
    """A row of features and mask fractions for each scene of ``changed_cells``; no task holds a scene."""
    got = cells.groupBy("scene").agg(*(v.alias(k) for k, v in scene.mean_features().items()))
    got = got.withColumn("urbanization_score", F.col("ndbi_delta_mean") - F.col("ndvi_delta_mean"))
    what = F.array(*(F.struct(F.lit(c).alias("what"), F.col(c).alias("v")) for c in ("d_ndvi", "d_ndbi", "magnitude")))
    long = written(cells.where("valid").select("scene", F.inline(what)), "triage-values")
    probs = sorted({p for _, p in TAILS.values()})
    tails = quantiles.quantiles(long, ["scene", "what"], "v", probs, at_most=long.count())
    wide = tails.groupBy("scene").agg(*(F.max(F.when(F.col("what") == c, F.col("q")[probs.index(p)])).alias(k) for k, (c, p) in TAILS.items()))
    parts = regions.summary(cells, block=block).drop("changed_px")
    joined = got.join(wide, "scene", "left").join(parts, "scene", "left").join(scene.fractions(cells).drop("n"), "scene")
    return joined.withColumns({k: F.coalesce(k, F.lit(0.0)) for k in TAILS})


def structure(pixels: DataFrame) -> DataFrame:
    """scene, ssim, phash_distance and registration_px, a scene in a task; the display bands are stretched together."""
    shown = written(pixels.select("scene", "y", "x", *(f"{b}{t}" for b in BAND_NAMES for t in (1, 2))), "triage-display")
    bounds = scene.joint_stretch(shown)
    span = F.greatest(F.col("high") - F.col("low"), F.lit(1e-6))
    scaled = shown.join(bounds, "scene").withColumns({f"{b}{t}": (F.col(f"{b}{t}") - F.col("low")) / span for b in ("red", "green", "blue") for t in (1, 2)})
    alike = kernels.tile_similarity(scaled, ["scene"]).select("scene", "ssim", "phash_distance")
    return alike.join(kernels.scene_registration(shown).select("scene", "registration_px"), "scene")


Evidence = Callable[[DataFrame], DataFrame]


def run(pixels: DataFrame, settings: Settings | None = None, evidence: Evidence = structure, normalise: bool = False, block: int = 512) -> DataFrame:
    """A row for each scene: features, quality, gate, reason, confidence and config_sha.

    ``pixels`` are paired (``pair_dates``); ``evidence`` makes scene, ssim,
    phash_distance and registration_px of the scenes' cells, or says what is
    known already. With ``normalise`` the second date is matched to the first
    one beforehand.
    """
    s = settings or Settings()
    pixels = normalised(pixels, s) if normalise else pixels
    cells = changed_cells(pixels, s, block)
    judged = scene.valid_observation(scene_features(cells, block).join(evidence(cells), "scene", "left"), s.quality)
    return gate.decide(judged, s.gate).withColumn("config_sha", F.lit(s.sha()))


def normalised(pixels: DataFrame, settings: Settings | None = None, bands: tuple[str, ...] = BAND_NAMES, min_pixels: int = 256) -> DataFrame:
    """Paired pixels whose second date is matched to the first through their most steady valid cells."""
    s = settings or Settings()
    flagged = scene.combined(scene.with_shadow(scene.masks(pixels, s.masks), s.masks.shadow_search_radius_px))
    fit = scene.normalise_to_reference(flagged, bands, min_pixels=min_pixels)
    wide = fit.groupBy("scene").agg(*(F.max(F.when(F.col("band") == b, F.struct("gain", "offset"))).alias(f"_{b}") for b in bands))
    joined = pixels.join(written(wide, "triage-fit"), "scene", "left")
    moved = {f"{b}2": F.col(f"{b}2") * F.coalesce(F.col(f"_{b}.gain"), F.lit(1.0)) + F.coalesce(F.col(f"_{b}.offset"), F.lit(0.0)) for b in bands}
    return joined.withColumns(moved).select(pixels.columns)


def ab_normalisation(pixels: DataFrame, labels: DataFrame, settings: Settings | None = None, evidence: Evidence = structure, block: int = 512) -> DataFrame:
    """side (off, on, delta), counts, precision and f1 of the gate without and with normalisation; ``labels`` has scene and label.

    A delta is NULL where either side is not assessed.
    """
    sides = None
    for side, on in (("off", False), ("on", True)):
        judged = run(pixels, settings, evidence, on, block).join(labels, "scene")
        one = evaluation.summary(judged, group="scene").select(F.lit(side).alias("side"), "tp", "fp", "fn", "tn", "precision", "f1")
        sides = one if sides is None else sides.unionByName(one)
    sides = written(sides, "ab-sides")

    def of(side: str, c: str):
        return F.max(F.when(F.col("side") == side, F.col(c)))

    delta = sides.agg(*(F.round(of("on", c) - of("off", c), 6).alias(c) for c in ("tp", "fp", "fn", "tn", "precision", "f1")))
    return sides.unionByName(delta.select(F.lit("delta").alias("side"), *sides.columns[1:]))


def publish(results: DataFrame, path: str, settings: Settings | None = None) -> str:
    """result (JSON, a row a scene) as a new version of ``path`` with the configuration's fingerprint in its marker."""
    sha = (settings or Settings()).sha()
    return storage.publish(results.sparkSession, path, {"result": lambda folder: results.write.json(folder)}, {"config_sha": sha})
