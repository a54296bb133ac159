"""Spatial joins and comparisons of sets."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def _cells(boxes: DataFrame, cell: float, columns: list[str]) -> DataFrame:
    """Boxes repeated for the grid cells that they touch, so that a range join becomes an equi-join."""

    def span(low: str, high: str):
        return F.explode(F.sequence(F.floor(F.col(low) / cell), F.floor(F.col(high) / cell)))

    return boxes.select(*columns, span("west", "east").alias("cx"), "south", "north", "west", "east").select(
        *columns, "cx", span("south", "north").alias("cy"), "west", "south", "east", "north"
    )


def _touching(boxes: DataFrame, cell: float, key: str) -> DataFrame:
    """Each pair (key < other) of closed boxes that meet, once.

    A pair is reported only in the first cell that both share, so no
    deduplication shuffle follows.
    """
    side = ["west", "south", "east", "north"]
    left = _cells(boxes.select(key, *side), cell, [key])
    right = left.select(*(F.col(c).alias(f"other_{c}") for c in [key, *side]), "cx", "cy")
    met = left.join(right, ["cx", "cy"]).where(f"{key} < other_{key}")
    met = met.where("west <= other_east and other_west <= east and south <= other_north and other_south <= north")
    first_x = F.floor(F.greatest("west", "other_west") / cell)
    first_y = F.floor(F.greatest("south", "other_south") / cell)
    return met.where((F.col("cx") == first_x) & (F.col("cy") == first_y))


def edge_adjacent(boxes: DataFrame, cell: float, key: str = "scene") -> DataFrame:
    """Pairs of boxes that share an edge: they touch on one axis and overlap on the other."""
    met = _touching(boxes, cell, key)
    beside = "(east = other_west or other_east = west) and least(north, other_north) > greatest(south, other_south)"
    above = "(north = other_south or other_north = south) and least(east, other_east) > greatest(west, other_west)"
    return met.where(f"({beside}) or ({above})").select(key, f"other_{key}")


def intersections(boxes: DataFrame, cell: float, key: str = "scene") -> DataFrame:
    """Pairs of boxes with a common area, and that box."""
    met = _touching(boxes, cell, key)
    out = met.select(
        key,
        f"other_{key}",
        F.greatest("west", "other_west").alias("west"),
        F.greatest("south", "other_south").alias("south"),
        F.least("east", "other_east").alias("east"),
        F.least("north", "other_north").alias("north"),
    )
    return out.where("east > west and north > south")


def polygon_box(polygons: DataFrame, geometry: str = "geometry") -> DataFrame:
    """GeoJSON polygons (a STRING) with the box of their outer ring."""
    parsed = polygons.withColumn("_ring", F.from_json(geometry, "struct<coordinates:array<array<array<double>>>>")["coordinates"][0])
    xs, ys = F.transform("_ring", lambda p: p[0]), F.transform("_ring", lambda p: p[1])
    box = {"west": F.array_min(xs), "south": F.array_min(ys), "east": F.array_max(xs), "north": F.array_max(ys)}
    return parsed.withColumns(box).drop("_ring")


def set_difference(a: DataFrame, b: DataFrame, columns: list[str]) -> DataFrame:
    """The symmetric difference, with the side that each row is on."""
    x, y = a.select(*columns).distinct(), b.select(*columns).distinct()
    left = x.exceptAll(y).withColumn("side", F.lit("left"))
    return left.unionByName(y.exceptAll(x).withColumn("side", F.lit("right")))


def require_same(a: DataFrame, b: DataFrame, columns: list[str], what: str) -> None:
    """Raise with the first few differences if two sets aren't the same."""
    if found := set_difference(a, b, columns).take(5):
        raise ValueError(f"{what} differ: {[tuple(r) for r in found]}")
