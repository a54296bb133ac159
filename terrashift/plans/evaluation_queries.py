"""End-to-end evaluation: the report row, pixel agreement, baselines and controls."""

from __future__ import annotations

from pyspark.sql import functions as F

from terrashift.operators import evaluation, gate, scene, tiles
from terrashift.plans import views
from terrashift.plans.registry import query
from terrashift.plans.sql import CLEAR_GATE, GATE, MASKS, TILE, chain, clear_chain, gate_from_pixels, wilson

_TALLY = """CAST(count(*) FILTER (gate = 'candidate_change' AND label = 1) AS BIGINT) AS tp, CAST(count(*) FILTER (gate = 'candidate_change' AND label = 0) AS BIGINT) AS fp,
  CAST(count(*) FILTER (gate = 'no_change' AND label = 1) AS BIGINT) AS fn, CAST(count(*) FILTER (gate = 'no_change' AND label = 0) AS BIGINT) AS tn"""
_COUNTS = f"""count(*) AS n_tiles, count(*) FILTER (gate = 'low_quality') AS n_low_quality, count(*) FILTER (gate = 'candidate_change') AS n_candidate_change, {_TALLY}"""
_BALANCED = """round(CASE WHEN tn + fp > 0 THEN (CASE WHEN tp + fn > 0 THEN CAST(tp AS DOUBLE)/(tp + fn) ELSE 0.0E0 END + CAST(tn AS DOUBLE)/(tn + fp))/2.0E0 END, 6) AS balanced_accuracy"""
_LOW, _HIGH = wilson("tp", "(tp + fn)")


def _summary_sql() -> str:
    return clear_chain(
        "gt",
        f"""SELECT n_tiles, n_low_quality, n_tiles - n_low_quality AS n_assessable, n_candidate_change, groups, groups_scored, tp, fp, fn, tn,
        round(100.0E0*n_candidate_change/greatest(n_tiles, 1), 2) AS candidate_rate_pct, round(100.0E0*n_low_quality/greatest(n_tiles, 1), 2) AS tier0_refused_pct,
        round(100.0E0*(n_tiles - n_low_quality - n_candidate_change)/greatest(n_tiles - n_low_quality, 1), 2) AS gate_filtered_pct,
        round(100.0E0*(n_tiles - n_candidate_change)/greatest(n_tiles, 1), 2) AS total_reduction_pct, {_BALANCED}, {_LOW} AS recall_low, {_HIGH} AS recall_high
        FROM (SELECT {_COUNTS}, list_sort(list(DISTINCT scene)) AS groups, coalesce(list_sort(list(DISTINCT scene) FILTER (gate <> 'low_quality')), []) AS groups_scored FROM gt)""",
    )


@query("eval_summary", _summary_sql())
def eval_summary(spark, d):
    _, report = evaluation.evaluate(views.fc(spark, d), lambda rows: gate.decide(rows, CLEAR_GATE), group="scene")
    names = """n_tiles n_low_quality n_assessable n_candidate_change groups groups_scored tp fp fn tn candidate_rate_pct tier0_refused_pct gate_filtered_pct
        total_reduction_pct balanced_accuracy recall_low recall_high"""
    return report.select(*names.split())


@query(
    "eval_pixels",
    chain(
        "ch",
        """SELECT tp, fp, fn, tn, round(CASE WHEN tp + fp + fn > 0 THEN CAST(tp AS DOUBLE)/(tp + fp + fn) ELSE 0.0E0 END, 4) AS iou FROM (
        SELECT CAST(count(*) FILTER (changed AND truth) AS BIGINT) AS tp, CAST(count(*) FILTER (changed AND NOT truth) AS BIGINT) AS fp,
          CAST(count(*) FILTER (NOT changed AND truth) AS BIGINT) AS fn, CAST(count(*) FILTER (NOT changed AND NOT truth) AS BIGINT) AS tn
        FROM (SELECT changed, nir1 > nir2 AS truth FROM ch WHERE obs1 AND obs2))""",
    ),
)
def eval_pixels(spark, d):
    return evaluation.pixel_summary(views.ch(spark, d).withColumn("truth", F.col("nir1") > F.col("nir2")), "truth")


_JUDGES = {
    "rules": "gate",
    "all": "CASE WHEN valid_observation THEN 'candidate_change' ELSE 'low_quality' END",
    "none": "CASE WHEN valid_observation THEN 'no_change' ELSE 'low_quality' END",
    "area": "CASE WHEN NOT valid_observation THEN 'low_quality' WHEN changed_area_percent >= 10.0E0 THEN 'candidate_change' ELSE 'no_change' END",
}


def _compare_sql() -> str:
    parts = (f"SELECT '{name}' AS scorer, {_COUNTS} FROM (SELECT label, {said} AS gate FROM gt)" for name, said in _JUDGES.items())
    return clear_chain("gt", f"SELECT *, {_BALANCED} FROM (" + "\nUNION ALL ".join(parts) + ")")


@query("eval_baselines", _compare_sql())
def eval_baselines(spark, d):
    judges = {
        "rules": lambda rows: gate.decide(rows, CLEAR_GATE),
        "all": evaluation.always(True),
        "none": evaluation.always(False),
        "area": evaluation.above("changed_area_percent", 10.0),
    }
    got = evaluation.compare(views.written(views.fc(spark, d), "features"), judges, group="scene")
    return got.select("scorer", "n_tiles", "n_low_quality", "n_candidate_change", "tp", "fp", "fn", "tn", "balanced_accuracy")


def _judge(pixels):
    """Judged tiles of paired pixels under the catalogue's thresholds."""
    found = views.written(scene.with_magnitude(scene.deltas(scene.combined(scene.masks(pixels, MASKS)))), "deltas")
    changed = tiles.assign(scene.raw_change(found, scene.scene_cut(found, GATE), GATE), TILE)
    return gate.decide(views.features(changed), GATE)


def _controls_sql() -> str:
    bands = evaluation.BANDS

    def lit(b: str) -> str:
        x = f"least(greatest({b}1*1.18E0, 0.0E0), 1.0E0)"
        return f"pow({f'least(greatest({x}*1.05E0, 0.0E0), 1.0E0)' if b == 'blue' else x}, 0.85E0)"

    second = {
        "identity": ({b: f"{b}1" for b in bands}, "n_changed = 0 AND n_flagged = 0"),
        "photometric": ({b: lit(b) for b in bands}, "n_flagged = 0"),
        "real_pair_differs": ({b: f"{b}2" for b in bands}, "n_changed > 0"),
        "tier0_assessed": ({b: f"{b}2" for b in bands}, "n_seen > 0"),
    }
    parts = []
    for name, (after, passed) in second.items():
        px = f"px AS (SELECT scene, y, x, {', '.join(f'{b}1' for b in bands)}, {', '.join(f'{v} AS {b}2' for b, v in after.items())} FROM given)"
        parts.append(
            f"""SELECT '{name}' AS name, n_tiles, n_flagged, n_changed, {passed} AS passed FROM (WITH {px}, {gate_from_pixels()}
            SELECT count(*) AS n_tiles, count(*) FILTER (gate = 'candidate_change') AS n_flagged, count(*) FILTER (changed_area_percent > 0) AS n_changed,
              count(*) FILTER (n_valid > 0) AS n_seen FROM gt)"""
        )
    return chain("px", "\nUNION ALL ".join(parts), "given AS (SELECT * FROM px)")


@query("control_battery", _controls_sql())
def control_battery(spark, d):
    return evaluation.control_battery(views.px(spark, d), _judge)


@query("control_registration")
def control_registration(spark, d):
    return evaluation.registration_control(views.px(spark, d))
