"""Regions over whole scenes, whatever block they were found in."""

from __future__ import annotations

from pyspark.sql import functions as F

from terrashift.config import Settings
from terrashift.operators import regions, triage
from terrashift.plans import views
from terrashift.plans.registry import query
from terrashift.plans.sql import CLEAR_GATE, CLEAR_MASKS, QUALITY, TILE, _features, _gate, clear_chain
from terrashift.plans.views import rounded

# The opening by a cross over a scene's frame, then recursive reachability over 8 neighbours.
_OPENED = """
fr AS (SELECT scene, min(y) AS y0, max(y) AS y1, min(x) AS x0, max(x) AS x1 FROM ch GROUP BY 1),
gd AS (SELECT f.*, CAST(a.v AS INT) AS y, CAST(b.v AS INT) AS x FROM fr f, unnest(range(y0, y1 + 1)) a(v), unnest(range(x0, x1 + 1)) b(v)),
st AS (SELECT scene, y, x FROM ch WHERE changed),
di(dy, dx) AS (VALUES (0, 0), (-1, 0), (1, 0), (0, -1), (0, 1)),
er AS (SELECT g.scene, g.y, g.x FROM gd g, di LEFT JOIN st ON st.scene = g.scene AND st.y = g.y + di.dy AND st.x = g.x + di.dx
       GROUP BY 1, 2, 3 HAVING bool_and(st.y IS NOT NULL OR g.y + di.dy < g.y0 OR g.y + di.dy > g.y1 OR g.x + di.dx < g.x0 OR g.x + di.dx > g.x1)),
dt AS (SELECT DISTINCT scene, y + dy AS y, x + dx AS x FROM er, di),
op AS (SELECT ch.* EXCLUDE (changed), dt.y IS NOT NULL AS changed FROM ch LEFT JOIN dt ON dt.scene = ch.scene AND dt.y = ch.y AND dt.x = ch.x)"""


def _components(pixels: str) -> str:
    return f"""
e AS (SELECT scene, y, x, CAST(y AS BIGINT)*4294967296 + x AS id FROM {pixels} WHERE changed),
n AS (SELECT a.scene, a.id AS a, b.id AS b FROM e a JOIN e b ON a.scene = b.scene AND abs(a.y - b.y) <= 1 AND abs(a.x - b.x) <= 1),
c AS (SELECT scene, id, id AS root FROM e UNION SELECT c.scene, n.b, c.root FROM c JOIN n ON c.scene = n.scene AND c.id = n.a WHERE c.root < n.b),
m AS (SELECT c.scene, c.id, min(c.root) AS label FROM c GROUP BY 1, 2),
s AS (SELECT m.scene, m.label, count(*) AS px, min(e.y) AS y0, max(e.y) AS y1, min(e.x) AS x0, max(e.x) AS x1 FROM m JOIN e ON e.scene = m.scene AND e.id = m.id GROUP BY 1, 2)"""


@query("region_components", clear_chain("ch", f", {_components('ch')} SELECT scene, label, px, y0, y1, x0, x1, round(CAST(px AS DOUBLE)/((y1 - y0 + 1)*(x1 - x0 + 1)), 6) AS fill_ratio FROM s"))
def region_components(spark, d):
    return rounded(regions.sizes(regions.labels(views.cr(spark, d), block=TILE)))


@query(
    "region_despeckled",
    clear_chain(
        "ch",
        f""", {_OPENED}, {_components('op')} SELECT op.scene, op.y, op.x, op.valid, coalesce(s.px >= {CLEAR_GATE.min_component_size_px}, FALSE) AS changed FROM op
        LEFT JOIN m ON m.scene = op.scene AND m.id = CAST(op.y AS BIGINT)*4294967296 + op.x LEFT JOIN s ON s.scene = m.scene AND s.label = m.label""",
    ),
)
def region_despeckled(spark, d):
    pixels = views.written(views.cr(spark, d).select("scene", "y", "x", "valid", "changed"), "changed")
    return regions.despeckled(pixels, radius=CLEAR_GATE.open_radius_px, min_size=CLEAR_GATE.min_component_size_px, block=TILE)


@query(
    "region_summary",
    clear_chain(
        "ch",
        f""", {_components('ch')} SELECT f.scene, CAST(coalesce(sum(px), 0) AS BIGINT) AS changed_px, coalesce(max(px), 0) AS largest_component_px, count(px) AS n_components,
        round(coalesce(arg_max(CAST(px AS DOUBLE)/((y1 - y0 + 1)*(x1 - x0 + 1)), px*1000000 - label%4294967296 - label//4294967296*1000), 0.0E0), 6) AS component_fill_ratio
        FROM (SELECT DISTINCT scene FROM ch) f LEFT JOIN s ON s.scene = f.scene GROUP BY f.scene""",
    ),
)
def region_summary(spark, d):
    return regions.summary(views.cr(spark, d), block=TILE).withColumn("component_fill_ratio", F.round("component_fill_ratio", 6))


_SETTINGS = Settings(CLEAR_MASKS, QUALITY, CLEAR_GATE)


def _evidence(cells):
    """Similarity and registration that SQL can compute too."""
    means = cells.groupBy("scene").agg(F.coalesce(F.avg(F.when(F.col("valid"), F.col("cva"))), F.lit(0.0)).alias("m"), F.count_if("valid").alias("n"))
    return means.select("scene", F.greatest(F.lit(0.0), 1.0 - F.col("m")).alias("ssim"), (F.col("n") % 32).cast("int").alias("phash_distance"), F.lit(0.5).alias("registration_px"))


@query(
    "triage_scenes",
    clear_chain(
        "ch",
        f""", {_OPENED}, {_components('op')},
        cs AS (SELECT op.* EXCLUDE (changed, trow, tcol), 0 AS trow, 0 AS tcol, coalesce(s.px >= {CLEAR_GATE.min_component_size_px}, FALSE) AS changed FROM op
          LEFT JOIN m ON m.scene = op.scene AND m.id = CAST(op.y AS BIGINT)*4294967296 + op.x LEFT JOIN s ON s.scene = m.scene AND s.label = m.label),
        {_features('cs')},
        big AS (SELECT scene, max(px) AS px FROM s WHERE px >= {CLEAR_GATE.min_component_size_px} GROUP BY scene),
        fs AS (SELECT ft.* EXCLUDE (largest_component_px), coalesce(big.px, 0) AS largest_component_px FROM ft LEFT JOIN big ON big.scene = ft.scene), {_gate(CLEAR_GATE, 'fs')}
        SELECT scene, n_valid, largest_component_px, round(changed_area_percent, 6) AS changed_area_percent, round(ndvi_delta_p10, 6) AS ndvi_delta_p10,
          round(magnitude_p99, 6) AS magnitude_p99, round(cloud_fraction, 6) AS cloud_fraction, valid_observation, gate, gate_reason, round(gate_confidence, 4) AS gate_confidence FROM gt""",
    ),
)
def triage_scenes(spark, d):
    """Scenes from bands to decision over shadow-free, scene-wide despeckled cells; tails by distributed selection."""
    got = triage.run(views.px(spark, d), _SETTINGS, _evidence, block=TILE)
    names = "n_valid largest_component_px changed_area_percent ndvi_delta_p10 magnitude_p99 cloud_fraction valid_observation gate gate_reason"
    return rounded(got.select("scene", *names.split(), F.round("gate_confidence", 4).alias("gate_confidence")))


@query("triage_full")
def triage_full(spark, d):
    """The same with similarity and registration from the kernels, and normalisation before everything."""
    got = triage.run(views.px(spark, d), _SETTINGS, normalise=True, block=TILE)
    return got.select("scene", "registration_px", "ssim", "phash_distance", "valid_observation", "gate", "gate_reason", "gate_confidence")


@query("ab_normalisation")
def ab_normalisation(spark, d):
    pixels = views.written(views.px(spark, d), "pairs")
    labels = pixels.select("scene", (F.col("scene") % 2).alias("label")).distinct()
    return triage.ab_normalisation(pixels, labels, _SETTINGS, _evidence, block=TILE)
