"""Opening and connected components of masks over whole scenes, cut into blocks that a task can hold.

Opening needs twice its radius around a block, so cells go to every block whose
surroundings hold them. Components are labelled block by block; labels that
touch across a border between blocks are edges of a graph with one vertex for
each local component, and stars join its vertices. No task holds a scene, and
what is joined or iterated over are borders, not areas.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from terrashift.operators import kernels
from terrashift.sources.storage import written

WIDE = 1 << 32  # a cell's number is y * WIDE + x


def _block(v: str | Column, size: int) -> Column:
    return F.floor((F.col(v) if isinstance(v, str) else v) / size).cast("int")


def opened(pixels: DataFrame, mask: str = "changed", radius: int = 1, block: int = 512) -> DataFrame:
    """``pixels`` (scene, y, x and what else they have) with the mask opened over the whole scene.

    Beyond the scene's frame (the least to the greatest y and x) counts as
    set when regions shrink, so none is eaten from the border; inside it, cells
    without a row count as not set.
    """
    if radius <= 0:
        return pixels
    halo = 2 * radius
    if block < 2 * halo:
        raise ValueError("a block must be four radii wide")
    frame = written(pixels.groupBy("scene").agg(F.min("y").alias("fy0"), F.max("y").alias("fy1"), F.min("x").alias("fx0"), F.max("x").alias("fx1")), "frames")
    kind = pixels.schema["scene"].dataType.simpleString()
    cells = pixels.where(F.col(mask)).select("scene", "y", "x")
    for c, v in (("by", "y"), ("bx", "x")):
        around = F.sequence(_block(F.col(v) - halo, block), _block(F.col(v) + halo, block))
        cells = cells.withColumn(c, F.explode(around))

    def one(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        scene, by, bx = key
        f = rows.iloc[0]
        y0, y1 = max(f.fy0, by * block - halo), min(f.fy1, by * block + block - 1 + halo)
        x0, x1 = max(f.fx0, bx * block - halo), min(f.fx1, bx * block + block - 1 + halo)
        dense = np.zeros((y1 - y0 + 1, x1 - x0 + 1), bool)
        dense[rows["y"].to_numpy() - y0, rows["x"].to_numpy() - x0] = True
        ys, xs = np.nonzero(kernels.opening(dense, radius))
        ys, xs = ys + y0, xs + x0
        mine = (ys // block == by) & (xs // block == bx)
        return pd.DataFrame({"scene": scene, "y": ys[mine].astype("int32"), "x": xs[mine].astype("int32")})

    inside = cells.join(frame, "scene").groupBy("scene", "by", "bx").applyInPandas(one, f"scene {kind}, y int, x int")
    kept = inside.withColumn("_kept", F.lit(True))
    joined = pixels.join(kept, ["scene", "y", "x"], "left")
    return joined.withColumn(mask, F.col("_kept").isNotNull()).select(pixels.columns)


def labels(pixels: DataFrame, mask: str = "changed", block: int = 512) -> DataFrame:
    """scene, y, x and label of every set cell: the number (y * 2^32 + x) of the first cell of its 8-connected component."""
    kind = pixels.schema["scene"].dataType.simpleString()

    def local(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        y, x = rows["y"].to_numpy(), rows["x"].to_numpy()
        y0, x0 = y.min(), x.min()
        dense = np.zeros((y.max() - y0 + 1, x.max() - x0 + 1), bool)
        dense[y - y0, x - x0] = True
        at = kernels.components(dense)[y - y0, x - x0]
        number = y.astype(np.int64) * WIDE + x
        first = np.full(at.max() + 1, np.iinfo(np.int64).max)
        np.minimum.at(first, at, number)
        return pd.DataFrame({"scene": key[0], "y": y, "x": x, "label": first[at]})

    cells = pixels.where(F.col(mask)).select("scene", "y", "x").withColumns({"by": _block("y", block), "bx": _block("x", block)})
    held = written(cells.groupBy("scene", "by", "bx").applyInPandas(local, f"scene {kind}, y int, x int, label bigint"), "local-labels")

    def rim(v: str) -> Column:
        return F.pmod(F.col(v), F.lit(block)).isin(0, block - 1)

    border = held.where(rim("y") | rim("x"))
    steps = F.array(*(F.struct(F.lit(dy).alias("dy"), F.lit(dx).alias("dx")) for dy, dx in ((0, 1), (1, 0), (1, 1), (1, -1))))
    near = border.select("scene", "y", "x", F.col("label").alias("a"), F.inline(steps))
    near = near.where((_block(F.col("y") + F.col("dy"), block) != _block("y", block)) | (_block(F.col("x") + F.col("dx"), block) != _block("x", block)))
    near = near.select("scene", (F.col("y") + F.col("dy")).alias("y"), (F.col("x") + F.col("dx")).alias("x"), "a")
    edges = near.join(border.select("scene", "y", "x", F.col("label").alias("b")), ["scene", "y", "x"]).select("scene", "a", "b").distinct()
    roots = written(joined_stars(edges), "label-roots")
    merged = held.join(roots.withColumnRenamed("node", "label"), ["scene", "label"], "left")
    return merged.select("scene", "y", "x", F.coalesce("root", "label").alias("label"))


def joined_stars(edges: DataFrame) -> DataFrame:
    """scene, node and root of every node of ``edges`` (scene, a, b) but the roots: the least node of its component.

    In a round each node tells its larger neighbours of the least one that it
    knows, then its smaller ones; rounds grow with the logarithm of the longest
    chain of blocks. Each is written, so a lost executor costs one round.
    """
    held = written(edges.select("scene", F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).where("a <> b").distinct(), "label-edges")
    mark = None
    while (now := _mark(held)) != mark and now[0]:
        mark = now
        both = held.unionByName(held.select("scene", F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("scene", "a").agg(F.least(F.min("b"), F.col("a")).alias("least"))
        large = both.where("b > a").join(least, ["scene", "a"]).select("scene", F.col("least").alias("a"), "b").where("a <> b").distinct()
        below = large.groupBy("scene", "b").agg(F.min("a").alias("least"))
        hand = large.join(below, ["scene", "b"]).select("scene", "a", "b", "least")
        small = hand.select("scene", F.col("least").alias("a"), F.explode(F.array("a", "b")).alias("b")).where("a <> b")
        held = written(small.distinct(), "label-stars")
    return held.groupBy("scene", F.col("b").alias("node")).agg(F.min("a").alias("root"))


def _mark(edges: DataFrame) -> tuple:
    """Rows and an order-free digest of them."""
    digest = F.coalesce(F.sum(F.xxhash64("scene", "a", "b").cast("decimal(38,0)")), F.lit(0)).cast("string")
    return tuple(edges.agg(F.count(F.lit(1)), digest).first())


def sizes(labelled: DataFrame) -> DataFrame:
    """scene, label, px, the bounding box and fill ratio of each component; added up in the tasks before they meet."""
    box = labelled.groupBy("scene", "label").agg(
        F.count(F.lit(1)).alias("px"), F.min("y").alias("y0"), F.max("y").alias("y1"), F.min("x").alias("x0"), F.max("x").alias("x1")
    )
    area = (F.col("y1") - F.col("y0") + 1).cast("bigint") * (F.col("x1") - F.col("x0") + 1)
    return box.withColumn("fill_ratio", F.col("px") / area)


def summary(pixels: DataFrame, mask: str = "changed", block: int = 512) -> DataFrame:
    """scene, changed_px, largest_component_px, n_components and component_fill_ratio (of the largest, the first on a tie)."""
    found = sizes(labels(pixels, mask, block))
    best = F.max(F.struct("px", (-F.col("label")).alias("first"), "fill_ratio")).alias("b")
    got = found.groupBy("scene").agg(F.sum("px").alias("changed_px"), F.count(F.lit(1)).alias("n_components"), best)
    every = pixels.select("scene").distinct().join(got, "scene", "left")
    none = {"changed_px": F.col("changed_px"), "largest_component_px": F.col("b.px"), "n_components": F.col("n_components")}
    return every.select("scene", *(F.coalesce(v, F.lit(0)).cast("bigint").alias(k) for k, v in none.items()), F.coalesce("b.fill_ratio", F.lit(0.0)).alias("component_fill_ratio"))


def despeckled(pixels: DataFrame, mask: str = "changed", radius: int = 1, min_size: int = 32, block: int = 512) -> DataFrame:
    """``pixels`` with the mask opened over the whole scene and freed of components of fewer than ``min_size`` cells.

    A region that crosses block or tile borders counts as one, as on the whole
    array. ``pixels`` is read twice: give a written table.
    """
    clean = written(opened(pixels, mask, radius, block), "opened")
    if min_size <= 1:
        return clean
    found = labels(clean, mask, block)
    large = found.groupBy("scene", "label").agg(F.count(F.lit(1)).alias("px")).where(F.col("px") >= min_size).select("scene", "label")
    kept = found.join(large, ["scene", "label"], "left_semi").select("scene", "y", "x", F.lit(True).alias("_kept"))
    return clean.join(kept, ["scene", "y", "x"], "left").withColumn(mask, F.col("_kept").isNotNull()).select(pixels.columns)
