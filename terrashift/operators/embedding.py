"""Statistics of embedding vectors by scene: centroid, dispersion, norm, cosine probe and coverage."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from terrashift.config import EMBEDDING_FIRST_YEAR
from terrashift.functions.indices import finite
from terrashift.functions.scalars import clamp_year


def usable(vectors: DataFrame, vector: str = "embedding") -> DataFrame:
    """Rows whose vector is there and finite throughout."""
    return vectors.where(F.col(vector).isNotNull() & F.forall(vector, finite)).withColumn(vector, F.col(vector).cast("array<double>"))


def centroids(vectors: DataFrame, key: str, vector: str = "embedding", digits: int | None = None) -> DataFrame:
    """key, n and centroid. Sums by component are merged before the shuffle: a key costs one row for each task and component."""
    rows = usable(vectors, vector).select(key, F.posexplode(vector).alias("pos", "v"))
    means = rows.groupBy(key, "pos").agg(F.avg("v").alias("m"), F.count(F.lit(1)).alias("n"))
    if digits is not None:
        means = means.withColumn("m", F.round("m", digits))
    ordered = F.transform(F.array_sort(F.collect_list(F.struct("pos", "m"))), lambda s: s["m"])
    return means.groupBy(key).agg(F.max("n").alias("n"), ordered.alias("centroid"))


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def distance(a: Column, b: Column) -> Column:
    return F.sqrt(F.aggregate(F.zip_with(a, b, lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda s, x: s + x))


def cosine(a: Column, b: Column) -> Column:
    """NULL when a vector is (nearly) zero."""
    scale = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when(scale >= 1e-9, dot(a, b) / scale)


def features(vectors: DataFrame, key: str, vector: str = "embedding") -> DataFrame:
    """key, n, norm (of the mean), dispersion (mean distance from it) and distance (from the overall centroid)."""
    middle = centroids(vectors, key, vector)
    rows = usable(vectors, vector).join(middle, key)
    spread = rows.groupBy(key).agg(F.avg(distance(F.col(vector), F.col("centroid"))).alias("dispersion"))
    whole = centroids(vectors.withColumn("_all", F.lit(0)), "_all", vector).select(F.col("centroid").alias("overall"))
    got = middle.join(spread, key).crossJoin(F.broadcast(whole))  # the right side is one row by construction
    return got.select(
        key,
        "n",
        F.round(F.sqrt(dot(F.col("centroid"), F.col("centroid"))), 4).alias("norm"),
        F.round("dispersion", 4).alias("dispersion"),
        F.round(distance(F.col("centroid"), F.col("overall")), 4).alias("distance"),
    )


def change_probe(before: DataFrame, after: DataFrame, key: str, vector: str = "embedding") -> DataFrame:
    """key and probe: 1 - cosine of the mean vectors of two dates; NULL when either is missing."""
    a = centroids(before, key, vector).select(key, F.col("centroid").alias("a"))
    b = centroids(after, key, vector).select(key, F.col("centroid").alias("b"))
    return a.join(b, key, "full").select(key, F.round(1.0 - cosine(F.col("a"), F.col("b")), 4).alias("probe"))


def coverage(pairs: DataFrame, first: int = EMBEDDING_FIRST_YEAR) -> DataFrame:
    """Totals of pairs (year1, year2) whose dates lie in the covered years."""
    in1, in2 = F.coalesce(F.col("year1") >= first, F.lit(False)), F.coalesce(F.col("year2") >= first, F.lit(False))
    n = F.count(F.lit(1))
    return pairs.agg(
        n.alias("pairs"),
        F.count_if(in1).alias("before_covered"),
        F.count_if(in2).alias("after_covered"),
        F.count_if(in1 & in2).alias("both_covered"),
        F.round(F.when(n > 0, 100.0 * F.count_if(in1 & in2) / n).otherwise(0.0), 1).alias("both_percent"),
    )


def clamped(rows: DataFrame, year: str, first: int = EMBEDDING_FIRST_YEAR) -> DataFrame:
    moved, was = clamp_year(F.col(year), first)
    return rows.withColumns({"used_year": moved, "was_clamped": was})
