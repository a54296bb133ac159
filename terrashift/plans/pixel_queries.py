"""Pixels, masks, tile statistics and the rule ladder on the pixel view."""

from __future__ import annotations

from pyspark.sql import functions as F

from terrashift.functions import indices as ix
from terrashift.operators import gate, metrics, scene, tiles
from terrashift.plans import views
from terrashift.plans.registry import query
from terrashift.plans.sql import GATE, QUALITY, TILE, chain, nd
from terrashift.plans.views import TILE_KEYS, rounded
from terrashift.sources.storage import written

CELL = ["scene", "y", "x"]


@query("idx_normalised_difference", chain("obs", f"SELECT scene, y, x, t, round({nd('nir', 'red')}, 6) AS nd FROM obs"))
def idx_normalised_difference(spark, d):
    rows = views.observations(spark, d)
    return rows.select(*CELL, "t", F.round(ix.normalised_difference(F.col("nir"), F.col("red")), 6).alias("nd"))


@query(
    "idx_four_indices",
    chain(
        "obs",
        f"""SELECT scene, y, x, t, round({nd('nir', 'red')}, 6) AS ndvi, round({nd('swir', 'nir')}, 6) AS ndbi,
        round({nd('green', 'nir')}, 6) AS ndwi, round({nd('green', 'swir')}, 6) AS ndsi FROM obs""",
    ),
)
def idx_four_indices(spark, d):
    c = F.col
    four = {"ndvi": ix.ndvi(c("nir"), c("red")), "ndbi": ix.ndbi(c("swir"), c("nir")), "ndwi": ix.ndwi(c("green"), c("nir")), "ndsi": ix.ndsi(c("green"), c("swir"))}
    return views.observations(spark, d).select(*CELL, "t", *(F.round(v, 6).alias(k) for k, v in four.items()))


@query("px_index_deltas", chain("dl", "SELECT scene, y, x, round(d_ndvi, 6) AS d_ndvi, round(d_ndbi, 6) AS d_ndbi, round(d_ndwi, 6) AS d_ndwi FROM dl"))
def px_index_deltas(spark, d):
    return rounded(scene.deltas(views.px(spark, d)).select(*CELL, "d_ndvi", "d_ndbi", "d_ndwi"))


@query("px_cva", chain("dl", "SELECT scene, y, x, round(cva, 6) AS cva FROM dl WHERE cva IS NOT NULL"))
def px_cva(spark, d):
    return rounded(scene.deltas(views.px(spark, d)).select(*CELL, "cva").where("cva is not null"))


@query("px_change_magnitude", chain("dl", "SELECT scene, y, x, water, round(magnitude, 6) AS magnitude FROM dl"))
def px_change_magnitude(spark, d):
    return rounded(views.dl(spark, d).select(*CELL, "water", "magnitude"))


FLAGS = [f"{f}{t}" for t in (1, 2) for f in ("obs", "snow", "cloud", "water", "dark", "valid")]


@query("mask_cloud_snow_water_dark", chain("mk", f"SELECT scene, y, x, {', '.join(FLAGS)} FROM mk"))
def mask_cloud_snow_water_dark(spark, d):
    return views.mk(spark, d).select(*CELL, *FLAGS)


@query("mask_combine_pair", chain("mk", "SELECT scene, y, x, cloud, snow, water, dark, valid FROM mk"))
def mask_combine_pair(spark, d):
    return views.mk(spark, d).select(*CELL, "cloud", "snow", "water", "dark", "valid")


_SHARE = ", ".join(f"round(avg(CASE WHEN {c} THEN 1.0E0 ELSE 0.0E0 END), 6) AS {c}_fraction" for c in ("cloud", "snow", "water", "dark", "valid"))


@query("mask_fractions", chain("mk", f"SELECT scene, count(*) AS n, bool_or(obs1) AND bool_or(obs2) AS assessed, {_SHARE} FROM mk GROUP BY scene"))
def mask_fractions(spark, d):
    return rounded(scene.fractions(views.mk(spark, d)))


@query(
    "quality_valid_observation",
    chain(
        "mk",
        f"""SELECT scene, cloud_fraction, valid_fraction, registration_px, coalesce(registration_px <= {QUALITY.registration_error_px_max}, TRUE)
        AND cloud_fraction <= {QUALITY.cloud_fraction_max} AND valid_fraction >= {QUALITY.min_valid_pixel_fraction} AS valid_observation
        FROM (SELECT scene, {_SHARE}, CASE WHEN scene % 3 = 0 THEN NULL ELSE scene * 0.3E0 END AS registration_px FROM mk GROUP BY scene)""",
    ),
)
def quality_valid_observation(spark, d):
    known = F.when(F.col("scene") % 3 != 0, F.col("scene") * F.lit(0.3))
    scenes = rounded(scene.fractions(views.mk(spark, d))).withColumn("registration_px", known)
    return scene.valid_observation(scenes, QUALITY).select("scene", "cloud_fraction", "valid_fraction", "registration_px", "valid_observation")


_MEANS = ["ndvi_delta_mean", "ndbi_delta_mean", "ndwi_delta_mean", "ndvi_delta_abs_mean", "ndbi_delta_abs_mean", "ndwi_delta_abs_mean", "cva_magnitude_mean"]


def _tile_sql(columns: list[str], view: str = "ft") -> str:
    doubles = ", ".join(f"round({c}, 6) AS {c}" for c in columns)
    return chain(view, f'SELECT scene, trow AS "row", tcol AS "col", {doubles} FROM {view}')


@query("stat_masked_mean", _tile_sql(_MEANS))
def stat_masked_mean(spark, d):
    return rounded(scene.tile_features(views.ch(spark, d), TILE_KEYS).select(*TILE_KEYS, *_MEANS))


@query("stat_signed_percentile", _tile_sql(["ndvi_delta_p10", "ndbi_delta_p90"]))
def stat_signed_percentile(spark, d):
    return rounded(scene.tile_features(views.ch(spark, d), TILE_KEYS).select(*TILE_KEYS, "ndvi_delta_p10", "ndbi_delta_p90"))


@query("stat_tail_p95_p99", _tile_sql(["magnitude_p95", "magnitude_p99", "urbanization_score", "changed_area_percent"]))
def stat_tail_p95_p99(spark, d):
    columns = ["magnitude_p95", "magnitude_p99", "urbanization_score", "changed_area_percent"]
    return rounded(scene.tile_features(views.ch(spark, d), TILE_KEYS).select(*TILE_KEYS, *columns))


@query("stat_scene_cut_mad", chain("ch", 'SELECT scene, round(med, 6) AS "median", round(mad, 6) AS mad, round(cut, 6) AS cut FROM cut'))
def stat_scene_cut_mad(spark, d):
    return rounded(scene.scene_cut(written(views.dl(spark, d).select("scene", "valid", "magnitude"), "magnitudes"), GATE).select("scene", "median", "mad", "cut"))


@query("px_change_mask_raw", chain("ch", "SELECT scene, y, x, valid, changed FROM ch"))
def px_change_mask_raw(spark, d):
    return views.ch(spark, d).select(*CELL, "valid", "changed")


@query(
    "px_heatmap",
    chain("ch", "SELECT scene, y, x, round(CASE WHEN changed THEN least(greatest((abs(d_ndvi) + abs(d_ndbi))/2.0E0/0.5E0, 0.0E0), 1.0E0) ELSE 0.0E0 END, 6) AS heat FROM ch"),
)
def px_heatmap(spark, d):
    return views.ch(spark, d).select(*CELL, F.round(ix.heat(F.col("d_ndvi"), F.col("d_ndbi"), F.col("changed")), 6).alias("heat"))


_LABEL = "(x * 7 + y * 3 + scene) % 97 < (CASE WHEN (scene + floor(y/8) + floor(x/8)) % 3 = 0 THEN 0 WHEN (scene + floor(y/8) + floor(x/8)) % 3 = 1 THEN 1 ELSE 40 END)"


def _truth():
    kind = (F.col("scene") + F.floor(F.col("y") / TILE) + F.floor(F.col("x") / TILE)) % 3
    level = F.when(kind == 0, 0).when(kind == 1, 1).otherwise(40)
    return (F.col("x") * 7 + F.col("y") * 3 + F.col("scene")) % 97 < level


_TILES = f"""
tl AS (SELECT scene, CAST(floor(y/{TILE}) AS INT) AS "row", CAST(floor(x/{TILE}) AS INT) AS "col",
         CAST(count(*) FILTER ({_LABEL}) AS DOUBLE)/count(*) AS change_fraction FROM px GROUP BY 1, 2, 3),
tiles AS (SELECT *, CASE WHEN change_fraction = 0 THEN 0 WHEN change_fraction >= 0.02E0 THEN 1 END AS label,
            scene || '_r' || "row" || 'c' || "col" AS tile_id FROM tl)"""


def _labelled(spark, d):
    return tiles.labelled(tiles.assign(views.px(spark, d), TILE, height=32, width=32), _truth(), min_fraction=0.02)


@query("tile_label_and_drop", chain("px", 'SELECT scene, "row", "col", tile_id, label, round(change_fraction, 6) AS change_fraction FROM tiles WHERE label IS NOT NULL', _TILES))
def tile_label_and_drop(spark, d):
    return rounded(_labelled(spark, d).select(*TILE_KEYS, "tile_id", "label", "change_fraction"))


@query(
    "tile_summary",
    chain(
        "px",
        """SELECT CASE WHEN scene <= 4 THEN 'train' ELSE 'test' END AS split, count(*) AS n, count(*) FILTER (label = 1) AS positives,
        count(DISTINCT scene) AS cities FROM tiles WHERE label IS NOT NULL GROUP BY 1""",
        _TILES,
    ),
)
def tile_summary(spark, d):
    rows = _labelled(spark, d).withColumns({"city": F.col("scene"), "split": F.when(F.col("scene") <= 4, "train").otherwise("test")})
    return tiles.summary(rows)


@query(
    "tile_sliding_stride",
    chain(
        "px",
        """SELECT px.scene, CAST(r.i AS INT) AS "row", CAST(c.i AS INT) AS "col", count(*) AS n,
        floor(CAST(sum(CAST(round(red1 * 1e9) AS BIGINT)) AS DOUBLE) / count(red1) / 1000.0E0 + 0.5E0) / 1000000.0E0 AS red
        FROM px JOIN range(0, 7) r(i) ON y >= r.i * 4 AND y < r.i * 4 + 8 JOIN range(0, 7) c(i) ON x >= c.i * 4 AND x < c.i * 4 + 8
        GROUP BY 1, 2, 3""",
    ),
)
def tile_sliding_stride(spark, d):
    covered = tiles.assign(views.px(spark, d), size=8, stride=4, height=32, width=32)
    exact = F.sum(F.round(F.col("red1") * 1e9).cast("bigint")).cast("double")  # sums of whole numbers don't depend on their order
    millionths = F.floor(exact / F.count("red1") / 1000.0 + 0.5).cast("double")
    return covered.groupBy(*TILE_KEYS).agg(F.count(F.lit(1)).alias("n"), (millionths / 1000000.0).alias("red"))


@query(
    "tile_stable_crop",
    chain(
        "ch",
        """SELECT scene, CAST(arg_max(r, u * 10000 - r * 100 - c) * 4 AS INT) AS y0, CAST(arg_max(c, u * 10000 - r * 100 - c) * 4 AS INT) AS x0, max(u) AS unchanged
        FROM (SELECT ch.scene, r.i AS r, c.i AS c, count(*) FILTER (NOT changed) AS u FROM ch
              JOIN range(0, 7) r(i) ON y >= r.i * 4 AND y < r.i * 4 + 8 JOIN range(0, 7) c(i) ON x >= c.i * 4 AND x < c.i * 4 + 8
              GROUP BY 1, 2, 3) GROUP BY scene HAVING max(u) >= 0.5E0 * 64""",
    ),
)
def tile_stable_crop(spark, d):
    return tiles.stable_crop(views.ch(spark, d), size=8, step=4, height=32, width=32, min_share=0.5)


@query(
    "tile_context_window",
    """SELECT tile, y0, x0, greatest(y0 - 8, 0) AS cy0, greatest(x0 - 8, 0) AS cx0, least(y0 + 16, 32) AS cy1, least(x0 + 16, 32) AS cx1,
    y0 - greatest(y0 - 8, 0) AS box_y, x0 - greatest(x0 - 8, 0) AS box_x
    FROM (SELECT r_regionkey AS tile, CAST(r_regionkey % 4 * 8 AS INT) AS y0, CAST(r_regionkey * 3 % 4 * 8 AS INT) AS x0 FROM region)""",
)
def tile_context_window(spark, d):
    rows = views.table(spark, d, "region").select(
        F.col("r_regionkey").alias("tile"), (F.col("r_regionkey") % 4 * 8).cast("int").alias("y0"), (F.col("r_regionkey") * 3 % 4 * 8).cast("int").alias("x0")
    )
    boxes = rows.withColumns({"y1": F.col("y0") + 8, "x1": F.col("x0") + 8, "height": F.lit(32), "width": F.lit(32)})
    return tiles.context_window(boxes).select("tile", "y0", "x0", "cy0", "cx0", "cy1", "cx1", "box_y", "box_x")


_DISPLAY = " UNION ALL ".join(f"SELECT scene, {b}{t} AS v FROM px" for b in ("red", "green", "blue") for t in (1, 2))


@query(
    "stretch_joint_p2_p98",
    chain("px", f"SELECT scene, round(quantile_cont(v, 0.02), 6) AS low, round(quantile_cont(v, 0.98), 6) AS high FROM ({_DISPLAY}) WHERE v IS NOT NULL GROUP BY scene"),
)
def stretch_joint_p2_p98(spark, d):
    return rounded(scene.joint_stretch(written(views.px(spark, d), "pairs")))


_FIT_BANDS = ("red", "nir", "swir")
_FIT = " UNION ALL ".join(f"SELECT scene, '{b}' AS band, {b}1 AS before, {b}2 AS after FROM mk WHERE valid" for b in _FIT_BANDS)


def _fit_sql(source: str, digits: int = 6) -> str:
    q = {f"{v}{int(p * 100)}": f"quantile_cont({v}, {p})" for v in ("before", "after") for p in (0.25, 0.5, 0.75)}
    cols = ", ".join(f"{e} AS {k}" for k, e in q.items())
    return f"""SELECT scene, band, n, round(gain, {digits}) AS gain, round(CASE WHEN told THEN before50 - gain * after50 ELSE 0.0E0 END, {digits}) AS "offset" FROM (
      SELECT *, CASE WHEN told THEN least(greatest((before75 - before25)/(after75 - after25), 0.5E0), 2.0E0) ELSE 1.0E0 END AS gain FROM (
      SELECT *, n >= 64 AND abs(after75 - after25) >= 1.0E-6 AS told FROM (SELECT scene, band, count(*) AS n, {cols} FROM ({source}) GROUP BY scene, band)))"""


@query("pif_robust_fit", chain("mk", _fit_sql(_FIT)))
def pif_robust_fit(spark, d):
    pairs = F.array(*(F.struct(F.lit(b).alias("band"), F.col(f"{b}1").alias("before"), F.col(f"{b}2").alias("after")) for b in _FIT_BANDS))
    return rounded(scene.robust_fit(written(views.mk(spark, d).where("valid").select("scene", F.inline(pairs)), "pairs"), min_pixels=64))


def _normalise_sql(rounds: int = 3) -> str:
    """Each round measures the distance under the fit before it, keeps the steady 60 % of a scene's cells and fits their original values."""
    bands = _FIT_BANDS
    parts = [f"v AS (SELECT scene, {', '.join(f'{b}{t}' for b in bands for t in (1, 2))} FROM mk WHERE valid AND {' AND '.join(f'{b}{t} IS NOT NULL' for b in bands for t in (1, 2))})"]
    for k in range(rounds):
        after = {b: f"({b}2 * {b}_g + {b}_o)" if k else f"{b}2" for b in bands}
        far = " + ".join(f"({after[b]} - {b}1)*({after[b]} - {b}1)" for b in bands)
        pairs = " UNION ALL ".join(f"SELECT d.scene, '{b}' AS band, {b}1 AS before, {b}2 AS after FROM d{k} d JOIN c{k} c ON c.scene = d.scene WHERE dist <= cut" for b in bands)
        wide = ", ".join(f"max(CASE WHEN band = '{b}' THEN gain END) AS {b}_g, max(CASE WHEN band = '{b}' THEN \"offset\" END) AS {b}_o" for b in bands)
        parts += [
            f"d{k} AS (SELECT v.*, sqrt({far}) AS dist FROM v {f'JOIN w{k - 1} w ON w.scene = v.scene' if k else ''})",
            f"c{k} AS (SELECT scene, quantile_cont(dist, 0.6) AS cut FROM d{k} GROUP BY scene)",
            f"f{k} AS ({_fit_sql(pairs, 12)})",
            f"w{k} AS (SELECT scene, {wide} FROM f{k} GROUP BY scene)",
        ]
    return chain("mk", f'SELECT scene, band, n, round(gain, 6) AS gain, round("offset", 6) AS "offset" FROM f{rounds - 1}', *parts)


@query("pif_normalise", _normalise_sql())
def pif_normalise(spark, d):
    return rounded(scene.normalise_to_reference(views.mk(spark, d), _FIT_BANDS, iterations=3, min_pixels=64))


@query("gate_decide", chain("gt", 'SELECT scene, trow AS "row", tcol AS "col", gate, gate_reason FROM gt'))
def gate_decide(spark, d):
    return views.gt(spark, d).select(*TILE_KEYS, "gate", "gate_reason")


@query("gate_confidence", chain("gt", 'SELECT scene, trow AS "row", tcol AS "col", gate_confidence FROM gt'))
def gate_confidence(spark, d):
    return views.gt(spark, d).select(*TILE_KEYS, "gate_confidence")


@query("gate_reason_histogram", chain("gt", "SELECT gate_reason, count(*) AS n FROM gt GROUP BY gate_reason"))
def gate_reason_histogram(spark, d):
    return views.gt(spark, d).groupBy("gate_reason").agg(F.count(F.lit(1)).alias("n"))


_COUNTS = """CAST(count(*) FILTER (label = 1 AND p) AS BIGINT) AS tp, CAST(count(*) FILTER (label = 0 AND p) AS BIGINT) AS fp,
  CAST(count(*) FILTER (label = 1 AND NOT p) AS BIGINT) AS fn, CAST(count(*) FILTER (label = 0 AND NOT p) AS BIGINT) AS tn"""


@query("gate_tier0_refusal", chain("gt", f"SELECT scene, {_COUNTS} FROM (SELECT *, gate = 'candidate_change' AS p FROM gt) WHERE gate <> 'low_quality' GROUP BY scene"))
def gate_tier0_refusal(spark, d):
    rows = views.gt(spark, d).where(F.col("gate") != gate.LOW_QUALITY)
    return metrics.counts(rows, F.col("label"), F.col("gate") == gate.CANDIDATE, ["scene"])


@query("gate_rgb_only", chain("px", """SELECT DISTINCT scene || '_r0c0' AS tile_id, 'low_quality' AS gate, 'index bands unavailable' AS gate_reason, 4 AS n_unavailable FROM px"""))
def gate_rgb_only(spark, d):
    scenes = views.px(spark, d).select("scene").distinct().select(tiles.tile_name(F.col("scene"), F.lit(0), F.lit(0)).alias("tile_id"))
    return gate.rgb_only(scenes).select("tile_id", "gate", "gate_reason", F.size("unavailable").alias("n_unavailable"))


@query(
    "metric_pixel_confusion_iou",
    chain(
        "ch",
        f"""SELECT scene, tp, fp, fn, tn, round(CASE WHEN tp + fp + fn > 0 THEN CAST(tp AS DOUBLE)/(tp + fp + fn) ELSE 0.0E0 END, 6) AS iou
        FROM (SELECT scene, {_COUNTS} FROM (SELECT ch.*, changed AS p, CASE WHEN {_LABEL} THEN 1 ELSE 0 END AS label FROM ch WHERE valid) GROUP BY scene)""",
    ),
)
def metric_pixel_confusion_iou(spark, d):
    c = metrics.counts(views.ch(spark, d).where("valid"), _truth(), F.col("changed"), ["scene"])
    return metrics.derived(c).select("scene", "tp", "fp", "fn", "tn", "iou")


@query(
    "render_diverging_ramp",
    chain(
        "dl",
        """SELECT scene, y, x, CAST(round_even((CASE WHEN v < 0 THEN 1.0E0 + v ELSE 1.0E0 END) * 255.0E0, 0) AS INT) AS r,
        CAST(round_even((1.0E0 - abs(v)) * 255.0E0, 0) AS INT) AS g, CAST(round_even((CASE WHEN v > 0 THEN 1.0E0 - v ELSE 1.0E0 END) * 255.0E0, 0) AS INT) AS b
        FROM (SELECT scene, y, x, least(greatest(d_ndvi/0.5E0, -1.0E0), 1.0E0) AS v FROM dl)""",
    ),
)
def render_diverging_ramp(spark, d):
    r, g, b = ix.diverging(F.col("d_ndvi"))
    return views.dl(spark, d).select(*CELL, r.alias("r"), g.alias("g"), b.alias("b"))


@query(
    "px_photometric_control",
    chain("obs", "SELECT scene, y, x, t, round(pow(least(greatest(least(greatest(blue*1.18E0, 0.0E0), 1.0E0)*1.05E0, 0.0E0), 1.0E0), 0.85E0), 6) AS blue, round(pow(least(greatest(red*1.18E0, 0.0E0), 1.0E0), 0.85E0), 6) AS red FROM obs"),
)
def px_photometric_control(spark, d):
    rows = views.observations(spark, d)
    return rounded(rows.select(*CELL, "t", ix.photometric(F.col("blue"), blue=True).alias("blue"), ix.photometric(F.col("red")).alias("red")))
