"""Exact quantiles of large groups by distributed selection: no task holds a group's values.

A group's values are counted in buckets by a monotone function of the value,
``2^7`` to each octave; counts are added up in the tasks and merged. Running
counts over a group's buckets (a few thousand at most) say which bucket holds
each wanted rank. Buckets that hold more than ``most`` values are cut into
linear parts between their least and greatest value, again and again, until
what is left is small or one repeated value. Only the values of those buckets
are then counted one by one, and a running count within a bucket gives the
value at a rank. A quantile between two ranks is interpolated, as NumPy and
Spark's ``percentile`` do.

Tables of cells and of results are written, so that their size is known when
they are joined with the values: small ones travel to the values, and however
many groups there are, values are never sent to their groups. Where the caller
knows that there are at most ``most`` values in all, they fit a task whatever
their groups are, and Spark's exact ``percentile`` gives the same in one step.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from terrashift.sources.storage import written

PARTS = 4096  # linear parts of a crowded bucket
MOST = 1 << 20


def bucket(value: Column) -> Column:
    """A whole number that never falls when the value grows: 128 to each octave of the distance from 0, from 2^-30 up."""
    size = F.abs(value)
    octaves = F.when(size < 1.0, F.log2(1.0 + size * float(1 << 30))).otherwise(30.0 + F.log2(size))
    far = F.floor(128.0 * octaves).cast("int")
    return F.when(value < 0, -far - 1).otherwise(far)


def _wanted(probs: list[float], n: Column) -> Column:
    """(slot, place, weight) of the two order statistics around each quantile of ``n`` values: places from 0, weight of the upper one."""

    def one(k: int, p: float) -> list[Column]:
        at = F.lit(float(p)) * (n - 1)
        low = F.floor(at)
        return [F.struct(F.lit(2 * k + up).alias("slot"), (F.ceil(at) if up else low).cast("bigint").alias("place"), (at - low).alias("weight")) for up in (0, 1)]

    return F.array(*(s for k, p in enumerate(probs) for s in one(k, p)))


def _located(counted: DataFrame, within: list[str], by: str, wanted: Column, n: Column | None = None) -> DataFrame:
    """A row for each wanted place of each group of ``counted`` (within, by, k, ...): the cell that holds it, and the place inside it.

    ``wanted`` is an array of (slot, place, weight) of the group, in terms of
    its size ``n`` where that is not a column yet. Running counts over the
    group's cells do it; nothing is joined.
    """
    group = Window.partitionBy(*within)
    upto = group.orderBy(by).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    cells = counted.withColumn("_end", F.sum("k").over(upto)).withColumn("_begin", F.col("_end") - F.col("k"))
    if n is not None:
        cells = cells.withColumn("n", n.over(group))
    here = F.filter(wanted, lambda w: (w["place"] >= F.col("_begin")) & (w["place"] < F.col("_end")))
    held = cells.select(*counted.columns, "n", "_begin", F.inline(here)) if n is not None else cells.select(*counted.columns, "_begin", F.inline(here))
    return held.withColumn("place", F.col("place") - F.col("_begin")).drop("_begin")


def kept(df: DataFrame, name: str, at_most: int | None, most: int = MOST) -> DataFrame:
    """A small table for joins: broadcast where its rows have a known bound, else written, so that its true size decides."""
    return F.broadcast(df) if at_most is not None and at_most <= most else written(df, name)


def quantiles(values: DataFrame, keys: list[str], column: str, probs: list[float], most: int = MOST, at_most: int | None = None) -> DataFrame:
    """``keys``, n and q (an array with the quantile of each of ``probs``), exact.

    ``values`` is read two or more times, so give a written table or something
    as cheap to read; ``at_most`` is a bound of its rows that is known. NULL
    and NaN don't count; groups without values are left out. Infinite values
    are not supported.
    """
    rows = values.select(*keys, F.col(column).cast("double").alias("v")).where("v is not null and not isnan(v)")
    if at_most is not None and at_most <= most:
        return F.broadcast(rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.percentile("v", F.array(*(F.lit(float(p)) for p in probs))).alias("q")))
    rows = rows.withColumn("c0", bucket(F.col("v")))
    span = [F.count(F.lit(1)).alias("k"), F.min("v").alias("lo"), F.max("v").alias("hi")]
    counted = rows.groupBy(*keys, "c0").agg(*span)
    names = ["c0"]
    cells = written(_located(counted, keys, "c0", _wanted(probs, F.col("n")), F.sum("k")), "quantile-cells")
    while cells.where((F.col("k") > most) & (F.col("lo") < F.col("hi"))).head() is not None:
        name = f"c{len(names)}"
        part = F.when(F.col("hi") > F.col("lo"), F.floor((F.col("v") - F.col("lo")) / (F.col("hi") - F.col("lo")) * PARTS)).otherwise(0)
        rows = _near(rows, cells, keys, names).withColumn(name, part.cast("int")).drop("lo", "hi", "n", "wanted")
        counted = _near(rows, cells, keys, names).groupBy(*keys, *names, name, "n", "wanted").agg(*span)
        cells = written(_located(counted, [*keys, *names], name, F.col("wanted")).drop("wanted"), "quantile-cells")
        names.append(name)
    near = _near(rows, cells, keys, names).groupBy(*keys, *names, "n", "wanted", "v").agg(F.count(F.lit(1)).alias("k"))
    found = _located(near, [*keys, *names], "v", F.col("wanted"))

    def at(slot: int) -> Column:
        return F.max(F.when(F.col("slot") == slot, F.col("v")))

    def between(k: int) -> Column:
        low, high, weight = at(2 * k), at(2 * k + 1), F.max(F.when(F.col("slot") == 2 * k, F.col("weight")))
        return F.when(low == high, low).otherwise(low * (1.0 - weight) + high * weight)

    q = F.array(*(between(k) for k in range(len(probs))))
    return written(found.groupBy(*keys, "n").agg(q.alias("q")), "quantiles")


def _near(rows: DataFrame, cells: DataFrame, keys: list[str], names: list[str]) -> DataFrame:
    """``rows`` in cells that hold a wanted place, with the cell's bounds, its group's size and the places wanted inside it."""
    wanted = F.collect_list(F.struct("slot", "place", "weight")).alias("wanted")  # two a quantile at most
    one = cells.groupBy(*keys, *names, "lo", "hi", "n").agg(wanted)
    return rows.join(one, [*keys, *names])


def medians(values: DataFrame, keys: list[str], column: str, at_most: int | None = None) -> DataFrame:
    return quantiles(values, keys, column, [0.5], at_most=at_most).select(*keys, "n", F.col("q")[0].alias("median"))
