"""Tile grids: assignment, labels, sliding windows and what a tile covers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

UNCHANGED, CHANGED = 0, 1
POSITIVE_MIN_FRACTION = 0.005  # fixed value: a smaller changed share that isn't 0 is ambiguous


def tile_name(scene: Column, row: Column, col: Column) -> Column:
    return F.concat(scene.cast("string"), F.lit("_r"), row.cast("string"), F.lit("c"), col.cast("string"))


def assign(pixels: DataFrame, size: int, stride: int | None = None, height: int | None = None, width: int | None = None) -> DataFrame:
    """Pixels with row and col of each full window that covers them.

    Without overlap that is arithmetic on the pixel; with it each pixel is
    repeated for the windows that cover it. Windows that the frame cuts off
    are no tiles (``height`` and ``width`` bound it).
    """
    stride = stride or size

    def windows(v: str, bound: int | None) -> tuple[Column, Column]:
        low = F.greatest(F.lit(0), F.floor((F.col(v) - size) / stride).cast("int") + 1)
        high = F.floor(F.col(v) / stride).cast("int")
        if bound is not None:
            high = F.least(high, F.lit((bound - size) // stride))
        return low, high

    if stride == size:
        out = pixels.withColumns({"row": F.floor(F.col("y") / size).cast("int"), "col": F.floor(F.col("x") / size).cast("int")})
        for c, bound in (("row", height), ("col", width)):
            if bound is not None:
                out = out.where((F.col(c) + 1) * size <= bound)
        return out
    out = pixels
    for c, v, bound in (("row", "y", height), ("col", "x", width)):
        low, high = windows(v, bound)
        out = out.withColumns({"_low": low, "_high": high}).where("_low <= _high").withColumn(c, F.explode(F.sequence("_low", "_high")))
    return out.drop("_low", "_high")


def labelled(pixels: DataFrame, changed: Column, min_fraction: float = POSITIVE_MIN_FRACTION) -> DataFrame:
    """scene, row, col, change_fraction and label; ambiguous tiles are dropped."""
    got = pixels.groupBy("scene", "row", "col").agg((F.count_if(changed) / F.count(F.lit(1))).alias("change_fraction"))
    label = F.when(F.col("change_fraction") == 0, UNCHANGED).when(F.col("change_fraction") >= min_fraction, CHANGED)
    named = got.withColumns({"label": label, "tile_id": tile_name(F.col("scene"), F.col("row"), F.col("col"))})
    return named.where("label is not null")


def summary(tiles: DataFrame) -> DataFrame:
    return tiles.groupBy("split").agg(
        F.count(F.lit(1)).alias("n"), F.count_if(F.col("label") == 1).alias("positives"), F.countDistinct("city").alias("cities")
    )


def context_window(tiles: DataFrame, factor: int = 3) -> DataFrame:
    """Tiles (y0, x0, y1, x1, height, width) with the window around them, clipped to the scene, and the tile's box in it."""
    pad_y = F.floor((F.col("y1") - F.col("y0")) * (factor - 1) / 2).cast("int")
    pad_x = F.floor((F.col("x1") - F.col("x0")) * (factor - 1) / 2).cast("int")
    around = tiles.withColumns(
        {
            "cy0": F.greatest(F.col("y0") - pad_y, F.lit(0)),
            "cx0": F.greatest(F.col("x0") - pad_x, F.lit(0)),
            "cy1": F.least(F.col("y1") + pad_y, F.col("height")),
            "cx1": F.least(F.col("x1") + pad_x, F.col("width")),
        }
    )
    return around.withColumns({"box_y": F.col("y0") - F.col("cy0"), "box_x": F.col("x0") - F.col("cx0")})


def stable_crop(pixels: DataFrame, size: int, step: int, height: int, width: int, min_share: float = 0.95) -> DataFrame:
    """For each scene the first window with the most unchanged cells, if their share is large enough.

    The candidate positions are the overlapping windows of ``assign``, so the
    search is one aggregation.
    """
    covered = assign(pixels, size, step, height, width)
    counts = covered.groupBy("scene", "row", "col").agg(F.count_if(~F.col("changed")).alias("unchanged"))
    best = counts.groupBy("scene").agg(F.max(F.struct("unchanged", (-F.col("row")).alias("r"), (-F.col("col")).alias("c"))).alias("b"))
    got = best.select("scene", (-F.col("b.r") * step).alias("y0"), (-F.col("b.c") * step).alias("x0"), "b.unchanged")
    return got.where(F.col("unchanged") >= min_share * size * size)
