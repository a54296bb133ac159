"""Declared uploads: validation as predicates, capability lanes, footprints and the manifest."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from terrashift.config import BANDS, INDEX_BANDS

LIMITS = {"pixels": 64_000_000, "bands": 32, "bytes": 2_000_000_000}
DRIVERS = ("GTiff", "COG", "PNG", "JPEG")


def problems(uploads: DataFrame, limits: dict[str, int] | None = None) -> DataFrame:
    """``uploads`` with an ARRAY of the reasons for which a pair can't be taken; empty if it can."""
    limits = limits or LIMITS

    def reason(condition: Column, text: str) -> Column:
        return F.when(F.coalesce(condition, F.lit(False)), F.lit(text))

    overlap = (F.least("east1", "east2") > F.greatest("west1", "west2")) & (F.least("north1", "north2") > F.greatest("south1", "south2"))
    found = F.array(
        reason(~F.col("driver").isin(*DRIVERS), "unsupported driver"),
        reason(F.col("width").cast("bigint") * F.col("height") > limits["pixels"], "too many pixels"),
        reason(F.col("n_bands") > limits["bands"], "too many bands"),
        reason(F.col("bytes") > limits["bytes"], "too large"),
        reason(F.col("crs1") != F.col("crs2"), "the pair has two coordinate systems"),
        reason(F.col("rotated"), "rotated grids are not supported"),
        reason(~overlap, "the footprints don't overlap"),
    )
    return uploads.withColumn("problems", F.array_compact(found))


def capability(uploads: DataFrame, band_map: str = "band_map") -> DataFrame:
    """lane (full, index, rgb or none) by the bands that a declaration names, with both flags behind it."""
    names = F.map_keys(band_map)

    def has(bands: tuple[str, ...]) -> Column:
        return F.size(F.array_except(F.array(*map(F.lit, bands)), names)) == 0

    out = uploads.withColumns({"has_index_bands": has(INDEX_BANDS), "has_all_bands": has(BANDS)})
    lane = F.when(F.col("has_all_bands"), "full").when(F.col("has_index_bands"), "index").when(has(("B02", "B03", "B04")), "rgb")
    return out.withColumn("lane", lane.otherwise("none"))


def rescaled(pixels: DataFrame, bands: list[str], scale: float, offset: float, nodata: float | None = None) -> DataFrame:
    """Raw values to reflectance; a nodata value is not observed (NULL) in every lane."""

    def one(b: str) -> Column:
        value = (F.col(b).cast("double") - offset) / scale
        return value if nodata is None else F.when(F.col(b) != nodata, value)

    return pixels.withColumns({b: one(b) for b in bands})


def crop_windows(pairs: DataFrame) -> DataFrame:
    """``pairs`` with the window that both grids share (row_off, col_off, rows and cols of each date), shared and problem.

    A pair has width, height, west, north, step_x, step_y, epsg and rotated of
    both dates (1 and 2 behind the name). Windows are whole pixels, rounded to
    the nearest; ``shared`` is the part of the first image's width that is
    left. A pair that can't be placed, or whose windows differ in shape, has a
    problem and no window: equal ground is never assumed.
    """

    def c(name: str, t: int) -> Column:
        return F.col(f"{name}{t}")

    east = {t: c("west", t) + c("width", t) * c("step_x", t) for t in (1, 2)}
    south = {t: c("north", t) - c("height", t) * c("step_y", t) for t in (1, 2)}
    left, right = F.greatest("west1", "west2"), F.least(east[1], east[2])
    top, bottom = F.least("north1", "north2"), F.greatest(south[1], south[2])

    def pixels(length: Column) -> Column:
        return F.floor(length + 0.5).cast("int")

    found = {}
    for t in (1, 2):
        found |= {
            f"row_off{t}": pixels((c("north", t) - top) / c("step_y", t)),
            f"col_off{t}": pixels((left - c("west", t)) / c("step_x", t)),
            f"rows{t}": pixels((top - bottom) / c("step_y", t)),
            f"cols{t}": pixels((right - left) / c("step_x", t)),
        }
    problem = (
        F.when(F.col("epsg1").isNull() | F.col("epsg2").isNull(), "no coordinate system")
        .when(F.col("rotated1") | F.col("rotated2"), "rotated grids are not supported")
        .when(F.col("epsg1") != F.col("epsg2"), "the pair has two coordinate systems")
        .when((right <= left) | (top <= bottom), "the footprints don't overlap")
        .when((found["rows1"] != found["rows2"]) | (found["cols1"] != found["cols2"]), "the windows differ in shape")
        .when((found["rows1"] < 1) | (found["cols1"] < 1), "less than a pixel is shared")
    )
    placed = pairs.withColumn("problem", problem)
    shared = (right - left) / (c("width", 1) * c("step_x", 1))
    return placed.withColumns({k: F.when(F.col("problem").isNull(), v) for k, v in (found | {"shared": shared}).items()})


def cropped(pixels: DataFrame, windows: DataFrame, key: str = "scene") -> DataFrame:
    """``pixels`` (key, t, y, x and what else they have) inside their pair's window, y and x counted from its corner."""
    edges = ["row_off1", "row_off2", "col_off1", "col_off2", "rows1", "cols1"]
    inside = pixels.join(windows.where("problem is null").select(key, *edges), key)
    y = F.col("y") - F.when(F.col("t") == 1, F.col("row_off1")).otherwise(F.col("row_off2"))
    x = F.col("x") - F.when(F.col("t") == 1, F.col("col_off1")).otherwise(F.col("col_off2"))
    moved = inside.withColumns({"y": y.cast("int"), "x": x.cast("int")})
    return moved.where("y >= 0 and y < rows1 and x >= 0 and x < cols1").select(pixels.columns)


def manifest_problems(manifest: DataFrame, files: DataFrame) -> DataFrame:
    """name and problem: names without a file, and names listed twice."""
    missing = manifest.join(files.select("name"), "name", "left_anti").select("name", F.lit("missing").alias("problem"))
    twice = manifest.groupBy("name").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("name", F.lit("duplicate").alias("problem"))
    return missing.unionByName(twice).distinct()


def resolve_artifacts(registry: DataFrame, local: DataFrame, sample: DataFrame) -> DataFrame:
    """key, path and where it came from: the local file, else the committed sample, else missing with the command that makes it."""
    got = registry.join(local.select("key", F.col("path").alias("_local")), "key", "left").join(
        sample.select("key", F.col("path").alias("_sample")), "key", "left"
    )
    origin = F.when(F.col("_local").isNotNull(), "local").when(F.col("_sample").isNotNull(), "sample").otherwise("missing")
    hint = F.when(origin == "missing", F.col("command"))
    return got.select("key", F.coalesce("_local", "_sample").alias("path"), origin.alias("origin"), hint.alias("command"))
