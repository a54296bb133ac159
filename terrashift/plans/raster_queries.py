"""Raster files made of the pixel view by the executors and read back: bands, headers, crops."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from terrashift.operators import ingest
from terrashift.plans import views
from terrashift.plans.registry import query
from terrashift.plans.sql import OBS, chain
from terrashift.sources import arrays, geotiff
from terrashift.sources.pixels import pair_dates

NAMES = {"blue": "B02", "green": "B03", "red": "B04", "nir": "B08", "swir": "B11"}


def blobs(spark: SparkSession, d: str) -> DataFrame:
    """scene, t, band and content: every scene, date and band of the pixel view as a file; forms change with the scene and the date."""
    rows = views.observations(spark, d)
    long = F.array(*(F.struct(F.lit(b).alias("band"), F.floor(F.col(c) * 10000.0 + 0.5).alias("value")) for c, b in NAMES.items()))
    pixels = rows.select("scene", "t", "y", "x", F.inline(long))
    s, t = F.col("scene"), F.col("t")
    layout = pixels.groupBy("scene", "t", "band").agg((F.max("y") + 1).alias("height"), (F.max("x") + 1).alias("width"))
    layout = layout.withColumns(
        {
            "west": 500000.0 + s * 1000.0 + (t - 1) * 50.0,
            "north": 5000000.0 - s * 700.0,
            "epsg": (32600 + s % 3).cast("int"),
            "big_endian": s % 2 == 0,
            "tiled": (s + t) % 3 == 0,
            "deflate": s % 4 != 3,
            "predictor": 1 + t % 2,
        }
    )
    return geotiff.written_blobs(pixels, ["scene", "t", "band"], layout)


_PAIRED = ", ".join(f"floor({c}{t} * 10000.0E0 + 0.5E0)/10000.0E0 AS {b}{t}" for t in (1, 2) for c, b in NAMES.items())


@query("geotiff_bands", chain("px", f"SELECT scene, y, x, {_PAIRED} FROM px"))
def geotiff_bands(spark, d):
    pixels = geotiff.decoded(blobs(spark, d), ["scene", "t", "band"])
    return geotiff.paired(pixels.where("value is not null"), tuple(NAMES.values()))


_FRAMES = f"""WITH {OBS},
fr AS (SELECT scene, t, CAST(max(y) + 1 AS INT) AS height, CAST(max(x) + 1 AS INT) AS width, 500000.0E0 + scene*1000.0E0 + (t - 1)*50.0E0 AS west,
         5000000.0E0 - scene*700.0E0 AS north, CAST(32600 + scene % 3 AS INT) AS epsg FROM obs GROUP BY scene, t)"""


@query(
    "geotiff_catalogue",
    f"""{_FRAMES} SELECT scene, t, CAST(5 AS BIGINT) AS n_bands, width, height, 'uint16' AS sample, epsg, west, north - height*10.0E0 AS south,
    west + width*10.0E0 AS east, north, 65535.0E0 AS nodata FROM fr""",
)
def geotiff_catalogue(spark, d):
    heads = geotiff.blob_headers(blobs(spark, d), ["scene", "t", "band"])
    grid = ["width", "height", "sample", "epsg", "west", "north", "step_x", "step_y", "nodata"]
    scenes = heads.groupBy("scene", "t", *grid).agg(F.count(F.lit(1)).alias("n_bands"))
    south, east = F.col("north") - F.col("height") * F.col("step_y"), F.col("west") + F.col("width") * F.col("step_x")
    return scenes.select("scene", "t", "n_bands", "width", "height", "sample", "epsg", "west", south.alias("south"), east.alias("east"), "north", "nodata")


_GRIDS = """
g AS (SELECT l_orderkey AS pair, CAST(l_linenumber % 2 + 1 AS INT) AS t, CAST(40 + max(l_partkey) % 30 AS INT) AS width,
        CAST(35 + max(l_suppkey) % 20 AS INT) AS height, CAST(min(l_partkey) % 90 AS DOUBLE)*10.0E0 + CASE WHEN max(l_quantity) > 45 THEN 3.0E0 ELSE 0.0E0 END AS west,
        1000.0E0 + CAST(min(l_suppkey) % 60 AS DOUBLE)*10.0E0 AS north, CASE WHEN min(l_quantity) < 2 THEN 20.0E0 ELSE 10.0E0 END AS step,
        CASE WHEN max(l_partkey) % 41 = 0 THEN NULL ELSE CAST(32631 + CASE WHEN max(l_suppkey) % 29 = 0 THEN 1 ELSE 0 END AS INT) END AS epsg,
        max(l_partkey) % 37 = 0 AS rotated FROM lineitem GROUP BY 1, 2)"""


def grids(spark: SparkSession, d: str) -> DataFrame:
    rows = views.table(spark, d, "lineitem")
    a = rows.groupBy(F.col("l_orderkey").alias("pair"), (F.col("l_linenumber") % 2 + 1).cast("int").alias("t")).agg(
        (40 + F.max("l_partkey") % 30).cast("int").alias("width"),
        (35 + F.max("l_suppkey") % 20).cast("int").alias("height"),
        ((F.min("l_partkey") % 90).cast("double") * 10.0 + F.when(F.max("l_quantity") > 45, 3.0).otherwise(0.0)).alias("west"),
        (1000.0 + (F.min("l_suppkey") % 60).cast("double") * 10.0).alias("north"),
        F.when(F.min("l_quantity") < 2, 20.0).otherwise(10.0).alias("step"),
        F.when(F.max("l_partkey") % 41 != 0, 32631 + F.when(F.max("l_suppkey") % 29 == 0, 1).otherwise(0)).cast("int").alias("epsg"),
        (F.max("l_partkey") % 37 == 0).alias("rotated"),
    )
    both = a.withColumns({"step_x": F.col("step"), "step_y": F.col("step")}).drop("step")
    names = ["width", "height", "west", "north", "step_x", "step_y", "epsg", "rotated"]
    cells = [F.max(F.when(F.col("t") == t, F.col(c))).alias(f"{c}{t}") for t in (1, 2) for c in names]
    return both.groupBy("pair").agg(*cells).where("width1 is not null and width2 is not null")


def _window_sql(t: int) -> str:
    cut = lambda length, step: f"CAST(floor(({length})/{step} + 0.5E0) AS INT)"
    return (
        f"{cut(f'north{t} - top', f'step{t}')} AS row_off{t}, {cut(f'lft - west{t}', f'step{t}')} AS col_off{t}, "
        f"{cut('top - bottom', f'step{t}')} AS rows{t}, {cut('rgt - lft', f'step{t}')} AS cols{t}"
    )


_OFFSETS = [f"{c}{t}" for t in (1, 2) for c in ("row_off", "col_off", "rows", "cols")]


@query(
    "ingest_crop_windows",
    f"""WITH {_GRIDS},
p AS (SELECT a.pair, {', '.join(f'{v}.{c} AS {c}{t}' for t, v in ((1, 'a'), (2, 'b')) for c in ('width', 'height', 'west', 'north', 'step', 'epsg', 'rotated'))}
      FROM g a JOIN g b ON a.pair = b.pair AND a.t = 1 AND b.t = 2),
q AS (SELECT *, greatest(west1, west2) AS lft, least(west1 + width1*step1, west2 + width2*step2) AS rgt, least(north1, north2) AS top,
        greatest(north1 - height1*step1, north2 - height2*step2) AS bottom FROM p),
w AS (SELECT *, {_window_sql(1)}, {_window_sql(2)} FROM q),
r AS (SELECT *, CASE WHEN epsg1 IS NULL OR epsg2 IS NULL THEN 'no coordinate system' WHEN rotated1 OR rotated2 THEN 'rotated grids are not supported'
        WHEN epsg1 <> epsg2 THEN 'the pair has two coordinate systems' WHEN rgt <= lft OR top <= bottom THEN 'the footprints don''t overlap'
        WHEN rows1 <> rows2 OR cols1 <> cols2 THEN 'the windows differ in shape' WHEN rows1 < 1 OR cols1 < 1 THEN 'less than a pixel is shared' END AS problem FROM w)
SELECT pair, problem, {', '.join(f'CASE WHEN problem IS NULL THEN {c} END AS {c}' for c in _OFFSETS)},
       CASE WHEN problem IS NULL THEN round((rgt - lft)/(width1*step1), 6) END AS shared FROM r""",
)
def ingest_crop_windows(spark, d):
    return views.rounded(ingest.crop_windows(grids(spark, d)).select("pair", "problem", *_OFFSETS, "shared"))


@query(
    "ingest_crop_pixels",
    f"""{_FRAMES},
w AS (SELECT a.scene, CAST(greatest(b.west - a.west, 0.0E0)/10.0E0 AS INT) AS off1, CAST(greatest(a.west - b.west, 0.0E0)/10.0E0 AS INT) AS off2,
        CAST((least(a.west + a.width*10.0E0, b.west + b.width*10.0E0) - greatest(a.west, b.west))/10.0E0 AS INT) AS cols, least(a.height, b.height) AS n_rows
      FROM fr a JOIN fr b ON a.scene = b.scene AND a.t = 1 AND b.t = 2),
m AS (SELECT o.scene, o.t, o.y, o.x - CASE WHEN o.t = 1 THEN w.off1 ELSE w.off2 END AS x, o.red, o.nir, w.cols, w.n_rows FROM obs o JOIN w ON w.scene = o.scene)
SELECT scene, y, CAST(x AS INT) AS x, max(CASE WHEN t = 1 THEN red END) AS red1, max(CASE WHEN t = 2 THEN red END) AS red2,
       max(CASE WHEN t = 1 THEN nir END) AS nir1, max(CASE WHEN t = 2 THEN nir END) AS nir2
FROM m WHERE x >= 0 AND x < cols AND y < n_rows GROUP BY 1, 2, 3""",
)
def ingest_crop_pixels(spark, d):
    rows = views.observations(spark, d).select("scene", "t", "y", "x", "red", "nir")
    frames = rows.groupBy("scene").agg(*(F.max(F.when(F.col("t") == t, F.col(v) + 1)).alias(f"{c}{t}") for t in (1, 2) for c, v in (("height", "y"), ("width", "x"))))
    known = {"step_x": F.lit(10.0), "step_y": F.lit(10.0), "north": F.lit(5000.0), "epsg": F.lit(32631), "rotated": F.lit(False)}
    placed = frames.withColumns({f"{c}{t}": v for t in (1, 2) for c, v in known.items()} | {"west1": F.lit(0.0), "west2": F.lit(50.0)})
    return pair_dates(ingest.cropped(rows, ingest.crop_windows(placed)), ("red", "nir")).select("scene", "y", "x", "red1", "red2", "nir1", "nir2")


@query(
    "embedding_blocks",
    """SELECT vec_id, len(embedding) AS dims, round(CAST(embedding[1] AS DOUBLE), 7) AS first, round(CAST(embedding[-1] AS DOUBLE), 7) AS last,
    round(list_sum([CAST(x AS DOUBLE) for x in embedding]), 6) AS total FROM embeddings""",
)
def embedding_blocks(spark, d):
    """The vectors as blocks of 16 by 16, written and read as NPY files."""
    rows = views.table(spark, d, "embeddings")
    dims = rows.select(F.max(F.size("embedding"))).first()[0] or 1
    at = F.col("vec_id") % 256
    cells = rows.select((F.col("vec_id") - at).alias("first_id"), F.floor(at / 16).cast("int").alias("y"), (at % 16).cast("int").alias("x"), "embedding")
    back = arrays.decoded(arrays.blobs(cells, ["first_id"], 16, 16, dims), ["first_id"], dims).where("embedding is not null")
    e = F.col("embedding").cast("array<double>")
    return views.rounded(back.select(
        (F.col("first_id") + F.col("y") * 16 + F.col("x")).alias("vec_id"), F.size(e).cast("bigint").alias("dims"), F.round(e[0], 7).alias("first"),
        F.round(F.element_at(e, -1), 7).alias("last"), F.round(F.aggregate(e, F.lit(0.0), lambda s, x: s + x), 6).alias("total"),
    ), 7)
