"""The pixel view of a transaction table, and scenes given as arrays.

The view makes a two-date grid of cells out of ``lineitem``: line number is
the scene, supplier and part modulo 32 are row and column, and exact integer
sums give the bands. It has unobserved cells at small scale, which exercises
the rule that unknown is not clean.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

GRID = 32
SPLIT_DATE = "1998-06-01 00:00:00"
BAND_NAMES = ("blue", "green", "red", "nir", "swir")

PIXEL_SCHEMA = "scene string, split string, t tinyint, y int, x int, blue double, green double, red double, nir double, swir double"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def observations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """scene, y, x, t and the bands: one row for each observed cell and date; partial sums before the shuffle."""
    rows = table(spark, sf_dir, "lineitem")

    def mean(value, scale):
        return F.sum(value.cast("bigint")).cast("double") / F.count(F.lit(1)) / F.lit(float(scale))

    cell = [
        F.col("l_linenumber").cast("int").alias("scene"),
        (F.col("l_suppkey") % GRID).cast("int").alias("y"),
        (F.col("l_partkey") % GRID).cast("int").alias("x"),
        F.when(F.col("l_shipdate") < F.lit(SPLIT_DATE).cast("timestamp_ntz"), 1).otherwise(2).alias("t"),
    ]
    return rows.groupBy(*cell).agg(
        mean(F.col("l_orderkey") % 100, 100).alias("blue"),
        mean(F.round(F.col("l_tax") * 100), 8).alias("green"),
        mean(F.col("l_quantity"), 50).alias("red"),
        mean(F.round(F.col("l_extendedprice")), 100000).alias("nir"),
        mean(F.round(F.col("l_discount") * 100), 10).alias("swir"),
    )


def pair_dates(pixels: DataFrame, bands: tuple[str, ...] = BAND_NAMES) -> DataFrame:
    """One row for each cell seen at either date: every band as band1 and band2, NULL where not observed.

    One aggregation instead of a self-join: the two dates of a cell meet in
    the same reduce, so the pixels are shuffled once.
    """
    both = [F.max(F.when(F.col("t") == t, F.col(b))).alias(f"{b}{t}") for t in (1, 2) for b in bands]
    return pixels.groupBy("scene", "y", "x").agg(*both)


def scene_arrays(spark: SparkSession, scenes: dict) -> DataFrame:
    """Scenes held as arrays, {scene: {t: {band: 2-d array}}}, as a pixel table; for fixtures and small uploads."""
    import pandas as pd

    parts = []
    for scene, dates in scenes.items():
        for t, bands in dates.items():
            h, w = next(iter(bands.values())).shape
            cells = {"scene": scene, "split": "test", "t": t, "y": [y for y in range(h) for _ in range(w)], "x": list(range(w)) * h}
            parts.append(pd.DataFrame(cells | {b: bands[b].ravel().astype("float64") for b in BAND_NAMES}))
    return spark.createDataFrame(pd.concat(parts), PIXEL_SCHEMA)
