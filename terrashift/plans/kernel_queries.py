"""Neighbourhood kernels, learned scorers and streams: checked against brute force in the tests, not by SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from terrashift.operators import evaluation, gate, kernels, scene, scorers
from terrashift.plans import views
from terrashift.plans.registry import query
from terrashift.plans.sql import CLEAR_GATE, GATE, chain, clear_chain, components
from terrashift.plans.views import TILE_KEYS, rounded
from terrashift.sources.storage import written
from terrashift.streaming import events as streams

FEATURES = [
    "ndvi_delta_mean",
    "ndbi_delta_mean",
    "ndwi_delta_mean",
    "ndvi_delta_abs_mean",
    "ndbi_delta_abs_mean",
    "ndwi_delta_abs_mean",
    "cva_magnitude_mean",
    "changed_area_percent",
    "ndvi_delta_p10",
    "ndbi_delta_p90",
    "urbanization_score",
    "magnitude_p95",
    "magnitude_p99",
]


@query("kernel_opening", clear_chain("op", 'SELECT scene, trow AS "row", tcol AS "col", y, x, changed FROM op'))
def kernel_opening(spark, d):
    return kernels.cleaned(views.cr(spark, d), TILE_KEYS, radius=1, min_size=1)


@query(
    "kernel_components",
    chain(
        "ch",
        """SELECT t.scene, t.trow AS "row", t.tcol AS "col", CAST(coalesce(sum(px), 0) AS INT) AS changed_px, CAST(coalesce(max(px), 0) AS INT) AS largest_component_px,
        CAST(count(root) AS INT) AS n_components FROM (SELECT DISTINCT scene, trow, tcol FROM ch) t
        LEFT JOIN s ON t.scene = s.scene AND t.trow = s.trow AND t.tcol = s.tcol GROUP BY 1, 2, 3""",
        components("ch"),
    ).replace("WITH ", "WITH RECURSIVE ", 1),
)
def kernel_components(spark, d):
    got = kernels.tile_components(views.ch(spark, d), TILE_KEYS, radius=0, min_size=1)
    return got.select(*TILE_KEYS, "changed_px", "largest_component_px", "n_components")


@query("kernel_ssim_phash")
def kernel_ssim_phash(spark, d):
    return kernels.tile_similarity(views.stretched(views.px(spark, d)), TILE_KEYS)


@query("kernel_registration")
def kernel_registration(spark, d):
    return kernels.scene_registration(views.px(spark, d))


def _axis_sql(at: str, low: str, high: str, cells: int) -> str:
    size = f"({high} - {low} + 1)"
    place = f"least(greatest(({at} + 0.5E0)*{size}/{cells}.0E0 - 0.5E0, 0.0E0), {size} - 1.0E0)"
    first = f"CAST(least(floor({place}), greatest(0, {size} - 2)) AS INT)"
    return f"[{{'at': {first}, 'weight': 1.0E0 - ({place} - {first})}}, {{'at': CAST(least({first} + 1, {size} - 1) AS INT), 'weight': {place} - {first}}}]"


@query(
    "kernel_resample",
    chain(
        "px",
        """SELECT a.scene, a.i AS y, a.j AS x, round(sum(a.ys.weight*a.xs.weight*coalesce(px.red1, 0.0E0)), 9) AS red1 FROM a
        LEFT JOIN px ON px.scene = a.scene AND px.y = a.y0 + a.ys.at AND px.x = a.x0 + a.xs.at GROUP BY 1, 2, 3""",
        "fr AS (SELECT scene, min(y) AS y0, max(y) AS y1, min(x) AS x0, max(x) AS x1 FROM px GROUP BY scene)",
        "gr AS (SELECT fr.*, CAST(i.i AS INT) AS i, CAST(j.j AS INT) AS j FROM fr, range(0, 16) i(i), range(0, 16) j(j))",
        f"a0 AS (SELECT scene, y0, x0, i, j, unnest({_axis_sql('i', 'y0', 'y1', 16)}) AS ys, {_axis_sql('j', 'x0', 'x1', 16)} AS xl FROM gr)",
        "a AS (SELECT scene, y0, x0, i, j, ys, unnest(xl) AS xs FROM a0)",
    ),
)
def kernel_resample(spark, d):
    return rounded(scene.resampled(views.px(spark, d), "red1", 16, 16), 9)


@query("kernel_shadow", clear_chain("mk", "SELECT scene, y, x, shadow1 AS shadow FROM mk"))
def kernel_shadow(spark, d):
    return kernels.scene_shadow(views.mk(spark, d), 1, radius=3)


_SHARE = ", ".join(f"round(avg(CASE WHEN {c} THEN 1.0E0 ELSE 0.0E0 END), 6) AS {c}_fraction" for c in ("shadow", "valid"))


@query("mask_shadow_valid", clear_chain("mk", f"SELECT scene, count(*) AS n, {_SHARE} FROM mk GROUP BY scene"))
def mask_shadow_valid(spark, d):
    """Shadow by running maxima along the rows (the query above finds it by a kernel), and what it leaves valid."""
    share = [F.avg(F.col(c).cast("int")).alias(f"{c}_fraction") for c in ("shadow", "valid")]
    return rounded(views.mk_clear(spark, d).groupBy("scene").agg(F.count(F.lit(1)).alias("n"), *share))


@query("change_despeckled", clear_chain("cl", 'SELECT scene, trow AS "row", tcol AS "col", y, x, changed FROM cl'))
def change_despeckled(spark, d):
    return views.cl(spark, d).select(*TILE_KEYS, "y", "x", "changed")


@query(
    "gate_clear_despeckled",
    clear_chain("gt", 'SELECT scene, trow AS "row", tcol AS "col", round(changed_area_percent, 6) AS changed_area_percent, largest_component_px, gate, gate_reason FROM gt'),
)
def gate_clear_despeckled(spark, d):
    """The ladder over shadow-free cells and the despeckled mask."""
    got = gate.decide(views.fc(spark, d), CLEAR_GATE)
    return rounded(got.select(*TILE_KEYS, "changed_area_percent", "largest_component_px", "gate", "gate_reason"))


@query("gate_full_kernels")
def gate_full_kernels(spark, d):
    """The ladder with everything from the kernels: shadow, despeckled change, components, and structure of stretched bands."""
    pixels = views.mk_clear(spark, d)
    features = views.fc(spark, d).drop("ssim", "phash_distance")
    alike = kernels.tile_similarity(views.stretched(pixels), TILE_KEYS).select(*TILE_KEYS, "ssim", "phash_distance")
    joined = features.join(alike, TILE_KEYS)
    return gate.decide(joined, CLEAR_GATE).select(*TILE_KEYS, "gate", "gate_reason", "gate_confidence")


def _scorer(spark, d, kind: str):
    rows = views.ft(spark, d)
    fitted = scorers.fit(rows.where("scene <= 4"), FEATURES, kind)
    got = fitted.score(rows.where("scene > 4"), FEATURES)
    return gate.score(got, probability=F.col("p_change")).select(*TILE_KEYS, "label", "gate", "gate_confidence")


@query("ml_lr_scorer")
def ml_lr_scorer(spark, d):
    return _scorer(spark, d, "logistic")


@query("ml_gbt_scorer")
def ml_gbt_scorer(spark, d):
    return _scorer(spark, d, "boosted")


_RANKED = """
SELECT '{name}' AS scorer, positives, negatives, round(ap/positives, 6) AS average_precision, round(1.0E0 - lost/(CAST(positives AS DOUBLE)*negatives), 6) AS roc_auc,
  round(coalesce(best, 0.0E0), 6) AS precision_at_recall FROM (
  SELECT max(pos) AS positives, max(neg) AS negatives, sum(CAST(p AS DOUBLE)*tp/(tp + fp)) AS ap, sum(CAST(p AS DOUBLE)*fp - CAST(p AS DOUBLE)*n/2.0E0) AS lost,
    max(CAST(tp AS DOUBLE)/(tp + fp)) FILTER (tp >= 0.5E0*pos) AS best
  FROM (SELECT *, CAST(sum(p) OVER w AS BIGINT) AS tp, CAST(sum(n) OVER w AS BIGINT) AS fp, CAST(sum(p) OVER () AS BIGINT) AS pos, CAST(sum(n) OVER () AS BIGINT) AS neg FROM (
    SELECT {score} AS s, count(*) FILTER (label = 1) AS p, count(*) FILTER (label = 0) AS n FROM gt GROUP BY 1) WINDOW w AS (ORDER BY s DESC ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)))"""


@query("rank_features", chain("gt", "\nUNION ALL ".join(_RANKED.format(name=n, score=c) for n, c in (("area", "changed_area_percent"), ("rules", "gate_confidence"), ("vector", "cva_magnitude_mean")))))
def rank_features(spark, d):
    """The rule gate's confidence against single features: average precision, ROC AUC, precision at half of the recall."""
    rows = written(gate.decide(views.ft(spark, d), GATE), "judged")
    named = {"rules": "gate_confidence", "area": "changed_area_percent", "vector": "cva_magnitude_mean"}
    return evaluation.rank_scorers({n: rows.select("label", F.col(c).alias("score")) for n, c in named.items()}, 0.5)


@query("rank_scorers")
def rank_scorers(spark, d):
    """The rule gate and the learned scorers, fitted on scenes 1 to 4, over the other scenes."""
    rows = written(gate.decide(views.ft(spark, d), GATE), "judged")
    train, test = rows.where("scene <= 4"), rows.where("scene > 4")
    found = {"rule_gate_confidence": test.select("label", F.col("gate_confidence").alias("score"))}
    for name, kind in (("logistic_regression", "logistic"), ("gradient_boosting", "boosted")):
        got = scorers.fit(train, FEATURES, kind, rounds=20).score(test, FEATURES)
        found[name] = got.select("label", F.col("p_change").alias("score"))
    return evaluation.rank_scorers(found, 0.5)


@query("stream_event_dedupe_totals", "SELECT event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY event_type")
def stream_event_dedupe_totals(spark, d):
    stream = streams.totals(streams.deduplicated(streams.event_stream(spark, d), "40 days"))
    return streams.drain(stream, f"totals_{abs(hash(d))}")


@query(
    "stream_tumbling_counts",
    """SELECT epoch_us(date_trunc('day', ts))::BIGINT AS start_us, event_type, count(*) AS n FROM events GROUP BY 1, 2""",
)
def stream_tumbling_counts(spark, d):
    got = streams.drain(streams.tumbling(streams.event_stream(spark, d)), f"tumbling_{abs(hash(d))}")
    return got.select(F.unix_micros("start").alias("start_us"), "event_type", "n")
