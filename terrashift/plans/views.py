"""The same views as in ``sql``, made by the operators."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from terrashift.config import GateThresholds
from terrashift.functions import indices as ix
from terrashift.operators import gate, kernels, scene, tiles
from terrashift.plans.sql import CLEAR_GATE, CLEAR_MASKS, GATE, MASKS, QUALITY, TILE
from terrashift.sources.pixels import observations, pair_dates, table
from terrashift.sources.storage import written

Spark = SparkSession
TILE_KEYS = ["scene", "row", "col"]


def px(spark: Spark, d: str) -> DataFrame:
    return pair_dates(observations(spark, d))


def mk(spark: Spark, d: str) -> DataFrame:
    return scene.combined(scene.masks(px(spark, d), MASKS))


def dl(spark: Spark, d: str) -> DataFrame:
    return scene.with_magnitude(scene.deltas(mk(spark, d)))


def ch(spark: Spark, d: str, g: GateThresholds = GATE) -> DataFrame:
    pixels = written(dl(spark, d), "deltas")
    return tiles.assign(scene.raw_change(pixels, scene.scene_cut(pixels, g), g), TILE)


def ft(spark: Spark, d: str, g: GateThresholds = GATE) -> DataFrame:
    """Tile features; structure and component size are stand-ins that SQL can compute too."""
    return features(ch(spark, d, g))


def clearness() -> dict:
    return {"cloud_fraction": F.avg(F.col("cloud").cast("double")), "valid_fraction": F.avg(F.col("valid").cast("double"))}


def judged_by(got: DataFrame) -> DataFrame:
    """Tile features with the stand-ins, whether the tile is clear and its made-up label."""
    clear = (F.col("cloud_fraction") <= QUALITY.cloud_fraction_max) & (F.col("valid_fraction") >= QUALITY.min_valid_pixel_fraction)
    return got.withColumns(
        {
            "ssim": F.greatest(F.lit(0.0), 1.0 - F.col("cva_magnitude_mean")),
            "phash_distance": (F.col("n_valid") % 32).cast("int"),
            "valid_observation": clear,
            "label": F.when((F.col("row") + F.col("col") + F.col("scene")) % 2 == 0, 1).otherwise(0),
        }
    )


def features(pixels: DataFrame) -> DataFrame:
    more = {"largest_component_px": F.count_if("changed").cast("int")} | clearness()
    return judged_by(scene.tile_features(pixels, TILE_KEYS, more))


def swept(spark: Spark, d: str, sigmas: list[float], g: GateThresholds = GATE) -> DataFrame:
    """The tile features for each background sigma, from one scan of the deltas."""
    pixels = written(dl(spark, d), "deltas")
    spread = written(scene.scene_spread(pixels), "spread")
    cells = tiles.assign(pixels.join(spread, "scene"), TILE)
    got = scene.features_by_sigma(cells, TILE_KEYS, sigmas, g, clearness())
    return judged_by(got.withColumn("largest_component_px", F.col("changed_px").cast("int")))


def mk_clear(spark: Spark, d: str) -> DataFrame:
    """The masks with shadow taken out of the valid cells."""
    return scene.combined(scene.with_shadow(scene.masks(px(spark, d), CLEAR_MASKS), CLEAR_MASKS.shadow_search_radius_px))


def cr(spark: Spark, d: str) -> DataFrame:
    """Changed cells of shadow-free scenes."""
    pixels = written(scene.with_magnitude(scene.deltas(mk_clear(spark, d))), "deltas")
    return tiles.assign(scene.raw_change(pixels, scene.scene_cut(pixels, CLEAR_GATE), CLEAR_GATE), TILE)


def cl(spark: Spark, d: str) -> DataFrame:
    """The same, despeckled within their tiles."""
    pixels = cr(spark, d)
    carry = ["valid", "cloud", "magnitude", "cva", "d_ndvi", "d_ndbi", "d_ndwi"]
    return kernels.cleaned(pixels, TILE_KEYS, radius=CLEAR_GATE.open_radius_px, min_size=CLEAR_GATE.min_component_size_px, carry=carry)


def fc(spark: Spark, d: str) -> DataFrame:
    """Tile features of the despeckled mask, its largest component among them."""
    pixels = cl(spark, d)
    parts = kernels.tile_components(pixels, TILE_KEYS, radius=0, min_size=1).select(*TILE_KEYS, "largest_component_px")
    return features(pixels).drop("largest_component_px").join(parts, TILE_KEYS)


def stretched(pixels: DataFrame) -> DataFrame:
    """Tiles of the display bands, both dates stretched together by their scene's 2nd and 98th percentile."""
    pixels = written(pixels, "display")
    names = [f"{b}{t}" for b in ("red", "green", "blue") for t in (1, 2)]
    span = F.greatest(F.col("high") - F.col("low"), F.lit(1e-6))
    scaled = {c: ix.clip((F.col(c) - F.col("low")) / span, 0.0, 1.0) for c in names}
    return tiles.assign(pixels.join(scene.joint_stretch(pixels), "scene").withColumns(scaled), TILE)


def gt(spark: Spark, d: str) -> DataFrame:
    return gate.decide(ft(spark, d), GATE)


def scored(spark: Spark, d: str) -> DataFrame:
    docs = table(spark, d, "documents").select("doc_id", F.col("source").alias("city"), "n_chars")
    rows = docs.join(table(spark, d, "labels"), "doc_id")
    score = ((F.col("n_chars") * 7 + F.col("doc_id") * 3 + F.col("quality") * 30) % 101).cast("double") / 100.0
    return rows.select("doc_id", "city", F.col("quality").alias("label"), "toxic", score.alias("score"))


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    """Doubles rounded for comparison, by SQL's rule; everything else as it is.

    DuckDB's round(x, n) rounds the double x * 10^n to a whole number; Spark's
    rounds the decimal digits of x, which differs where that product is next
    to a half (323.0 / 640.0 is 0.504687 there, 0.504688 in Spark).
    """
    scale = 10.0**digits

    def one(c: str) -> Column:
        scaled = F.col(c) * scale
        return F.when(F.abs(scaled) < float("inf"), F.round(scaled) / scale).otherwise(F.col(c)).alias(c)

    return df.select(*(one(c) if k == "double" else F.col(c) for c, k in df.dtypes))
