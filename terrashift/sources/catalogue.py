"""The catalogue of scene pairs from their files' headers: size, place, dates, labels, previews and neighbours; no pixel is read.

One file at most is opened for the size of the grid that is analysed and one
for the place on the ground, both for their first bytes only. A scene whose
raster states no coordinate system falls back to its area of interest; one
with neither has no place. Scenes that share an edge say so, and whether the
train/test split runs between them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from terrashift.operators import joins
from terrashift.sources import files as listed
from terrashift.sources import geotiff
from terrashift.sources.storage import written

BAND = "B04"  # fixed value: the band whose header speaks for a scene
PLACED = 1e-6  # coordinates closer than this are one


def _part(k: int) -> Column:
    return F.regexp_extract("path", r"([^/]+)/(imgs_1_rect|imgs_1)/([^/]+)$", k)


def header_files(files: DataFrame) -> DataFrame:
    """pair_id, what (shape or place) and path: the file that says each, by name; rectified folders for the shape only."""
    named = files.select(_part(1).alias("pair_id"), _part(2).alias("folder"), _part(3).alias("name"), "path").where(F.col("pair_id") != "")
    exact, raw = F.lower("name") == f"{BAND}.tif".lower(), F.col("name").endswith(f"{BAND}.tif")
    shape = F.when((F.col("folder") == "imgs_1_rect") & exact, F.when(F.col("name") == f"{BAND}.tif", 0).otherwise(1)).when((F.col("folder") == "imgs_1") & raw, 2)
    place = F.when((F.col("folder") == "imgs_1") & raw, 0)
    both = F.array(F.struct(F.lit("shape").alias("what"), shape.alias("rank")), F.struct(F.lit("place").alias("what"), place.alias("rank")))
    ranked = named.select("pair_id", "path", F.inline(both)).where("rank is not null")
    return ranked.groupBy("pair_id", "what").agg(F.min(F.struct("rank", "path")).alias("b")).select("pair_id", "what", "b.path")


def build(files: DataFrame, pairs: DataFrame, polygons: DataFrame | None = None, dates: DataFrame | None = None, cell: float = 1.0) -> DataFrame:
    """A row for each of ``pairs`` (pair_id, split), in order of name.

    ``files`` lists paths, ``polygons`` has pair_id and geometry (GeoJSON),
    ``dates`` pair_id, date_t1 and date_t2. ``cell`` is the size of the grid on
    which neighbours meet, about that of a scene.
    """
    chosen = written(header_files(files).join(pairs.select("pair_id"), "pair_id", "left_semi"), "catalogue-files")
    heads = written(geotiff.headers(chosen.select("path").distinct()), "catalogue-headers")
    said = chosen.join(heads, "path")

    def of(what: str, *columns: str) -> DataFrame:
        return said.where((F.col("what") == what) & F.col("problem").isNull()).select("pair_id", *columns)

    size = of("shape", "height", "width")
    place = of("place", "epsg", "west", "north", "step_x", "step_y", "width", "height").where("epsg is not null and west is not null")
    east, south = F.col("west") + F.col("width") * F.col("step_x"), F.col("north") - F.col("height") * F.col("step_y")
    place = place.select("pair_id", "epsg", F.struct("west", south.alias("south"), east.alias("east"), "north").alias("native"))
    if polygons is not None:
        boxes = joins.polygon_box(polygons).select("pair_id", F.struct("west", "south", "east", "north").alias("aoi")).where("aoi.west is not null")
    else:
        boxes = pairs.select("pair_id", F.lit(None).cast("struct<west:double,south:double,east:double,north:double>").alias("aoi")).limit(0)
    seen = [F.regexp_extract("path", r"([^/]+)/pair/(img[12])\.png$", k) for k in (1, 2)]
    previews = files.select(seen[0].alias("pair_id"), seen[1].alias("_p")).where("_p <> ''").groupBy("pair_id")
    previews = previews.agg(*(F.max(F.col("_p") == f"img{t}").alias(f"preview{t}") for t in (1, 2)))
    labels = listed.label_files(files).select("pair_id", F.lit(True).alias("has_label"))
    dated = dates if dates is not None else pairs.select("pair_id", *(F.lit(None).cast("string").alias(f"date_t{t}") for t in (1, 2))).limit(0)
    out = pairs.select("pair_id", "split")
    for other in (size, place, boxes, previews, labels, dated):
        out = out.join(other, "pair_id", "left")
    source = F.when(F.col("native").isNotNull(), "native_transform").when(F.col("aoi").isNotNull(), "aoi_polygon").otherwise("none")
    note = F.when(source == "aoi_polygon", "No CRS on the native raster; falling back to the AOI polygon.")
    flags = {c: F.coalesce(c, F.lit(False)) for c in ("has_label", "preview1", "preview2")}
    zero = {c: F.coalesce(c, F.lit(0)) for c in ("height", "width")}
    scenes = out.withColumns({"bbox": F.coalesce("native", "aoi"), "bbox_source": source, "_note": note, **flags, **zero}).drop("native", "aoi")
    scenes = written(scenes, "catalogue")
    return with_neighbours(scenes, cell).orderBy("pair_id")


def with_neighbours(scenes: DataFrame, cell: float) -> DataFrame:
    """``scenes`` with notes: where their place comes from, and every scene that shares an edge with them, in order of name."""
    snapped = {c: F.round(F.col(f"bbox.{c}") / PLACED) * PLACED for c in ("west", "south", "east", "north")}
    boxes = scenes.where("bbox is not null").select("pair_id", "split", *(v.alias(k) for k, v in snapped.items()))
    met = joins.edge_adjacent(boxes, cell, "pair_id")
    both = met.unionByName(met.select(F.col("other_pair_id").alias("pair_id"), F.col("pair_id").alias("other_pair_id")))
    of = scenes.select(F.col("pair_id").alias("other_pair_id"), F.col("split").alias("other_split"))
    named = both.join(of, "other_pair_id").join(scenes.select("pair_id", "split"), "pair_id")
    across = F.when(F.col("split") != F.col("other_split"), " across the train/test split").otherwise("")
    text = F.concat(F.lit("Edge-adjacent to "), F.col("other_pair_id"), across, F.lit("."))
    beside = named.groupBy("pair_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("other_pair_id", text.alias("t")))), lambda s: s["t"]).alias("_beside"))
    joined = scenes.join(beside, "pair_id", "left")
    notes = F.array_compact(F.concat(F.array("_note"), F.coalesce("_beside", F.array().cast("array<string>"))))
    return joined.withColumn("notes", notes).drop("_note", "_beside")
