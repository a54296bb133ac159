"""Files that come with scenes and runs: manifests, dates, splits, tile indexes, ledgers and feature matrices.

Every schema is explicit, nothing is inferred. Broken rows of an append-only
ledger are skipped, those of any other file are an error.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from terrashift.functions.scalars import compact_date
from terrashift.sources import storage

LEDGER = (
    "tile_id string, city string, split string, label int, gate string, gate_reason string, gate_confidence double, "
    "vlm_verdict string, vlm_called boolean, cost_usd double, error string, vlm_change_type string, vlm_confidence double, "
    "batch boolean, cost_usd_synchronous double"
)
FEATURES = (
    "tile_id string, city string, split string, label int, ssim double, phash_distance int, ndvi_delta_mean double, "
    "ndbi_delta_mean double, ndwi_delta_mean double, ndvi_delta_abs_mean double, ndbi_delta_abs_mean double, "
    "ndwi_delta_abs_mean double, cva_magnitude_mean double, changed_area_percent double, ndvi_delta_p10 double, "
    "ndbi_delta_p90 double, urbanization_score double, magnitude_p95 double, magnitude_p99 double, largest_component_px int, "
    "n_components int, component_fill_ratio double, valid_observation boolean"
)
TILE = (
    "tile_id string, city string, split string, row int, col int, y0 int, x0 int, y1 int, x1 int, label int, change_fraction double"
)


def scene_manifest(files: DataFrame, splits: DataFrame, bands: tuple[str, ...]) -> DataFrame:
    """Scene pairs from a listing (path): those with every band at both dates and a known split, in order of name.

    Paths end in ``<scene>/imgs_<t>[_rect]/<band>.tif``; a rectified folder is
    preferred over a raw one, names that begin with ``_`` are skipped.
    """
    parts = F.regexp_extract("path", r"([^/]+)/imgs_([12])(_rect)?/(?:[^/]*_)?([^/_]+)\.tif$", 0)
    got = files.where(parts != "").select(
        *(
            F.regexp_extract("path", r"([^/]+)/imgs_([12])(_rect)?/(?:[^/]*_)?([^/_]+)\.tif$", k).alias(c)
            for k, c in enumerate(("pair_id", "t", "rect", "band"), 1)
        )
    )
    got = got.where(~F.col("pair_id").startswith("_")).withColumn("band", F.upper("band")).where(F.col("band").isin(*bands))
    whole = got.groupBy("pair_id", "t", "rect").agg(F.countDistinct("band").alias("n")).where(F.col("n") == len(bands))
    best = whole.groupBy("pair_id", "t").agg(F.max("rect").alias("rect"))
    pairs = best.groupBy("pair_id").agg(*(F.max(F.when(F.col("t") == t, F.concat(F.lit(f"imgs_{t}"), "rect"))).alias(f"img{t}") for t in "12"))
    return pairs.where("img1 is not null and img2 is not null").join(splits, pairs.pair_id == splits.city).select(
        "pair_id", "split", "img1", "img2"
    ).orderBy("pair_id")


def scene_dates(lines: DataFrame) -> DataFrame:
    """pair_id, date_t1, date_t2 from lines (pair_id, value) such as ``date_1: 20200115``."""
    tag, digits = F.regexp_extract("value", r"^\s*date_([12]):\s*(\S+)", 1), F.regexp_extract("value", r"^\s*date_([12]):\s*(\S+)", 2)
    dates = lines.select("pair_id", tag.alias("t"), compact_date(digits).alias("d"))
    return dates.groupBy("pair_id").agg(*(F.max(F.when(F.col("t") == str(t), F.col("d"))).alias(f"date_t{t}") for t in (1, 2)))


def list_pairs(manifest: DataFrame, split: str = "all") -> DataFrame:
    """The pairs of one split, or all; another word is an error."""
    if split not in ("train", "test", "all"):
        raise ValueError(f"split must be train, test or all, got {split!r}")
    return manifest if split == "all" else manifest.where(F.col("split") == split)


def label_files(files: DataFrame) -> DataFrame:
    """pair_id, path and encoding of each pair's label: ``cm/cm.png``, else ``cm/<pair>-cm.tif``, else ``cm/cm.tif``.

    The kind of file states its encoding; it can't be told from the pixels.
    """
    pair, name = F.regexp_extract("path", r"([^/]+)/cm/([^/]+)$", 1), F.regexp_extract("path", r"([^/]+)/cm/([^/]+)$", 2)
    rank = F.when(name == "cm.png", 0).when(name == F.concat(pair, F.lit("-cm.tif")), 1).when(name == "cm.tif", 2)
    best = files.select(pair.alias("pair_id"), rank.alias("rank"), "path").where("rank is not null").groupBy("pair_id").agg(F.min(F.struct("rank", "path")).alias("b"))
    return best.select("pair_id", "b.path", F.when(F.col("b.rank") == 0, "gt127").otherwise("eq2").alias("encoding"))


def verify_layout(manifest: DataFrame, labels: DataFrame) -> DataFrame:
    """One row: ok, and what was found (pairs by split, and how many have a label)."""
    both = manifest.join(labels.select("pair_id", F.lit(1).alias("_has")), "pair_id", "left")
    got = both.agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("split") == "train").alias("train"), F.count("_has").alias("labelled"))
    found = F.format_string("%d pairs (%d train / %d test), %d labelled", "n", "train", F.col("n") - F.col("train"), "labelled")
    return got.select((F.col("n") > 0).alias("ok"), F.when(F.col("n") > 0, found).otherwise("no pairs").alias("message"))


def save_tile_index(tiles: DataFrame, path: str, note: dict | None = None) -> str:
    """tiles (JSON lines in order of id) and summary (JSON, a row for each split) as one new version of ``path``."""
    names = [c.split()[0] for c in TILE.split(", ")]
    per_split = tiles.groupBy("split").agg(F.count_if(F.col("label") == 1).alias("positive"), F.count_if(F.col("label") == 0).alias("negative"), F.countDistinct("city").alias("cities"))
    parts = {
        "tiles": lambda folder: tiles.select(*names).orderBy("tile_id").write.json(folder),
        "summary": lambda folder: per_split.coalesce(1).write.json(folder),
    }
    return storage.publish(tiles.sparkSession, path, parts, note)


def saved_tiles(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(TILE).json(storage.current(spark, path, "tiles"), mode="FAILFAST")


def label_changed(value: Column, encoding: Column) -> Column:
    """Whether a label pixel says changed: ``gt127``, ``eq2`` (1 or 2, 0 outside the labelled area) or ``eq1`` (0 or 1); other values raise."""
    bad = F.raise_error(F.concat(F.lit("illegal label value "), value.cast("string"))).cast("boolean")
    return (
        F.when(encoding == "gt127", value > 127)
        .when((encoding == "eq2") & value.isin(0, 1, 2), value == 2)
        .when((encoding == "eq1") & value.isin(0, 1), value == 1)
        .otherwise(bad)
    )


def tile_index(spark: SparkSession, path: str) -> DataFrame:
    rows = spark.read.schema(f"tiles array<struct<{TILE.replace(' ', ':').replace(',:', ',')}>>").json(path, multiLine=True, mode="FAILFAST")
    return rows.select(F.inline("tiles"))


def ledger(spark: SparkSession, path: str) -> DataFrame:
    """Rows of an append-only JSON-lines ledger; blank and broken lines are skipped."""
    return spark.read.schema(LEDGER).json(path, mode="DROPMALFORMED").where("tile_id is not null")


def verified_calls(spark: SparkSession, path: str) -> DataFrame:
    return ledger(spark, path).where("vlm_called").orderBy("tile_id")


def feature_matrix(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(FEATURES).csv(path, header=True, mode="FAILFAST")


def write_features(features: DataFrame, path: str) -> None:
    features.write.mode("overwrite").csv(path, header=True)


def append_ledger(rows: DataFrame, path: str) -> None:
    rows.write.mode("append").json(path)


def nearest_snapshot(wanted: DataFrame, snapshots: DataFrame) -> DataFrame:
    """For each (id, at) of ``wanted`` the snapshot (taken, brightness) nearest in time, the earlier on a tie.

    A union and two running maxima instead of a cross join: each side is
    sorted once by time within its ``site``.
    """
    points = wanted.select("site", F.col("at").alias("ts"), "id", F.lit(None).cast("double").alias("brightness"), F.lit(0).alias("kind"))
    shots = snapshots.select("site", F.col("taken").alias("ts"), F.lit(None).cast(wanted.schema["id"].dataType).alias("id"), "brightness", F.lit(1).alias("kind"))
    both = points.unionByName(shots)
    shot = F.when(F.col("kind") == 1, F.struct("ts", "brightness"))
    order = W.partitionBy("site").orderBy("ts", F.desc("kind"))
    back = order.rowsBetween(W.unboundedPreceding, W.currentRow)
    ahead = order.rowsBetween(W.currentRow, W.unboundedFollowing)
    near = both.select("*", F.last(shot, True).over(back).alias("b"), F.first(shot, True).over(ahead).alias("a")).where("kind = 0")

    def gap(c: str) -> Column:
        return F.abs(F.unix_micros(F.col("ts").cast("timestamp")) - F.unix_micros(F.col(f"{c}.ts").cast("timestamp")))

    first = F.col("a").isNull() | (F.col("b").isNotNull() & (gap("b") <= gap("a")))
    chosen = F.when(first, F.col("b")).otherwise(F.col("a"))
    return near.select("id", "site", F.col("ts").alias("at"), chosen.alias("s")).select("id", "site", "at", F.col("s.ts").alias("taken"), "s.brightness")
