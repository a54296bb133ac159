"""Metrics, funnel accounts, budgets, risk control and the sweep."""

from __future__ import annotations

from pyspark.sql import functions as F

from terrashift.config import RATES_USD_PER_MTOK
from terrashift.functions import stats
from terrashift.operators import cost, metrics, risk, selection
from terrashift.plans import views
from terrashift.plans.registry import query
from terrashift.plans.sql import GATE, SCORED, baseline_gate, chain, swept_features, wilson
from terrashift.plans.views import rounded, table

_C = """CAST(count(*) FILTER (label = 1 AND score >= 0.5E0) AS BIGINT) AS tp, CAST(count(*) FILTER (label = 0 AND score >= 0.5E0) AS BIGINT) AS fp,
  CAST(count(*) FILTER (label = 1 AND score < 0.5E0) AS BIGINT) AS fn, CAST(count(*) FILTER (label = 0 AND score < 0.5E0) AS BIGINT) AS tn"""
_CM = f"cm AS (SELECT city, {_C} FROM sc GROUP BY city)"


def _scored(body: str, *more: str) -> str:
    return "WITH " + ",\n".join([SCORED, *more]) + "\n" + body


def _cm(spark, d, where: str = "true"):
    rows = views.scored(spark, d).where(where)
    return metrics.counts(rows, F.col("label"), F.col("score") >= 0.5, ["city"])


@query("metric_confusion", _scored("SELECT * FROM cm", _CM))
def metric_confusion(spark, d):
    return _cm(spark, d)


_PL, _PH = wilson("tp", "(tp + fp)")
_RL, _RH = wilson("tp", "(tp + fn)")


@query("metric_wilson", _scored(f"SELECT city, {_PL} AS precision_low, {_PH} AS precision_high, {_RL} AS recall_low, {_RH} AS recall_high FROM cm", _CM))
def metric_wilson(spark, d):
    return metrics.derived(_cm(spark, d)).select("city", "precision_low", "precision_high", "recall_low", "recall_high")


_RATIOS = """rt AS (SELECT city, CASE WHEN fp + tn > 0 THEN CASE WHEN tp + fp > 0 THEN CAST(tp AS DOUBLE)/(tp + fp) ELSE 0.0E0 END END AS p,
  CASE WHEN tp + fn > 0 THEN CAST(tp AS DOUBLE)/(tp + fn) ELSE 0.0E0 END AS r, CASE WHEN tn + fp > 0 THEN CAST(tn AS DOUBLE)/(tn + fp) END AS s FROM cm)"""
_F1 = """SELECT city, round(p, 6) AS "precision", round(r, 6) AS recall, round(s, 6) AS specificity,
  round(CASE WHEN p IS NULL THEN NULL WHEN p + r > 0 THEN 2.0E0*p*r/(p + r) ELSE 0.0E0 END, 6) AS f1, round((r + s)/2.0E0, 6) AS balanced_accuracy FROM rt"""
_F1_COLUMNS = ["city", "precision", "recall", "specificity", "f1", "balanced_accuracy"]


@query("metric_f1_balanced", _scored(_F1, _CM, _RATIOS))
def metric_f1_balanced(spark, d):
    return metrics.derived(_cm(spark, d)).select(*_F1_COLUMNS)


@query("metric_no_negatives", _scored(_F1, f"cm AS (SELECT city, {_C} FROM sc WHERE label = 1 GROUP BY city)", _RATIOS))
def metric_no_negatives(spark, d):
    return metrics.derived(_cm(spark, d, "label = 1")).select(*_F1_COLUMNS)


@query(
    "metric_playground",
    _scored(
        """SELECT *, round(CASE WHEN tp + fp > 0 THEN CAST(tp AS DOUBLE)/(tp + fp) END, 6) AS "precision",
        round(CASE WHEN tp + fn > 0 THEN CAST(tp AS DOUBLE)/(tp + fn) END, 6) AS recall,
        round(2.0E0*tp/(2*tp + fp + fn), 6) AS f1 FROM (SELECT sum(tp)::BIGINT AS tp, sum(fp)::BIGINT AS fp, sum(fn)::BIGINT AS fn, sum(tn)::BIGINT AS tn FROM cm)""",
        _CM,
    ),
)
def metric_playground(spark, d):
    return metrics.playground(views.scored(spark, d), F.col("label"), F.col("score") >= 0.5)


_CURVE = """ds AS (SELECT score, count(*) FILTER (label = 1) AS p, count(*) FILTER (label = 0) AS n FROM sc GROUP BY score),
cv AS (SELECT score, p, n, CAST(sum(p) OVER w AS DOUBLE) AS tp, CAST(sum(n) OVER w AS DOUBLE) AS fp,
         CAST(sum(p) OVER () AS DOUBLE) AS pos, CAST(sum(n) OVER () AS DOUBLE) AS neg
       FROM ds WINDOW w AS (ORDER BY score DESC ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW))"""


@query("metric_average_precision", _scored("SELECT round(sum(p * tp/(tp + fp))/max(pos), 6) AS average_precision, CAST(max(pos) AS BIGINT) AS positives FROM cv", _CURVE))
def metric_average_precision(spark, d):
    return metrics.average_precision(views.scored(spark, d), "label", "score")


@query("metric_roc_auc", _scored("SELECT round(sum(p * (neg - fp + n/2.0E0))/(max(pos)*max(neg)), 6) AS roc_auc FROM cv", _CURVE))
def metric_roc_auc(spark, d):
    return metrics.roc_auc(views.scored(spark, d), "label", "score")


@query(
    "metric_precision_at_recall",
    _scored(
        """SELECT wanted, round(max(tp/(tp + fp)), 6) AS "precision", arg_max(score, (tp/(tp + fp), score)) AS threshold
        FROM cv JOIN (VALUES (0.25E0), (0.516E0), (0.9E0)) v(wanted) ON tp/pos >= wanted GROUP BY wanted""",
        _CURVE,
    ),
)
def metric_precision_at_recall(spark, d):
    return metrics.precision_at_recall(views.scored(spark, d), "label", "score", [0.25, 0.516, 0.9])


# --- the funnel: customers are tiles, nations are cities ------------------------

_FUNNEL = """fn AS (SELECT 'c' || c_custkey AS tile_id, c_nationkey AS city,
    CASE WHEN c_custkey % 7 = 0 THEN 'low_quality' WHEN c_acctbal >= 4000 THEN 'candidate_change' ELSE 'no_change' END AS gate,
    c_acctbal >= 4000 AND c_custkey % 7 <> 0 AND c_custkey % 3 = 0 AS vlm_called, c_custkey % 2 = 0 AS batch,
    CASE WHEN c_acctbal >= 4000 AND c_custkey % 7 <> 0 AND c_custkey % 3 = 0
         THEN CASE c_custkey % 5 WHEN 0 THEN 'uncertain' WHEN 1 THEN 'likely_artifact' ELSE 'real_change' END END AS vlm_verdict,
    CASE WHEN c_custkey % 4 = 0 THEN 0 ELSE 1 END AS label,
    CASE c_custkey % 3 WHEN 0 THEN 'claude-opus-5' WHEN 1 THEN 'claude-haiku-4-5' ELSE 'unlisted' END AS model,
    1000 + c_custkey % 500 AS input_tokens, 100 + c_custkey % 50 AS output_tokens, c_custkey % 11 * 10 AS cache_read, c_custkey % 13 * 10 AS cache_write
  FROM customer)"""
_RATES = "rates(model, i, o) AS (VALUES " + ", ".join(f"('{m}', {float(i)}E0, {float(o)}E0)" for m, (i, o) in RATES_USD_PER_MTOK.items()) + ")"
_PRICED = """pr AS (SELECT fn.*, coalesce((input_tokens + cache_read*0.1E0 + cache_write*1.25E0)*i + output_tokens*o, 0.0E0)/1000000.0E0 AS sync_usd, i IS NOT NULL AS priced,
  coalesce((input_tokens + cache_read*0.1E0 + cache_write*1.25E0)*i + output_tokens*o, 0.0E0)/1000000.0E0 * CASE WHEN batch THEN 0.5E0 ELSE 1.0E0 END AS cost_usd
  FROM fn LEFT JOIN rates ON fn.model = rates.model)"""


def _with_funnel(body: str) -> str:
    return "WITH " + ",\n".join([_FUNNEL, _RATES, _PRICED]) + "\n" + body


def _funnel(spark, d):
    c = F.col
    key = c("c_custkey")
    refused, candidate = key % 7 == 0, (c("c_acctbal") >= 4000) & (key % 7 != 0)
    called = candidate & (key % 3 == 0)
    verdict = F.when(key % 5 == 0, "uncertain").when(key % 5 == 1, "likely_artifact").otherwise("real_change")
    rows = table(spark, d, "customer").select(
        F.concat(F.lit("c"), key.cast("string")).alias("tile_id"),
        c("c_nationkey").alias("city"),
        F.when(refused, "low_quality").when(candidate, "candidate_change").otherwise("no_change").alias("gate"),
        called.alias("vlm_called"),
        (key % 2 == 0).alias("batch"),
        F.when(called, verdict).alias("vlm_verdict"),
        F.when(key % 4 == 0, 0).otherwise(1).alias("label"),
        F.when(key % 3 == 0, "claude-opus-5").when(key % 3 == 1, "claude-haiku-4-5").otherwise("unlisted").alias("model"),
        (1000 + key % 500).alias("input_tokens"),
        (100 + key % 50).alias("output_tokens"),
        (key % 11 * 10).alias("cache_read_input_tokens"),
        (key % 13 * 10).alias("cache_creation_input_tokens"),
    )
    return cost.priced(rows, cost.rates(spark))


@query(
    "funnel_reductions",
    _with_funnel(
        """SELECT n_pairs, n_tier0_refused, n_gate_filtered, n_candidates, round(100.0E0*n_tier0_refused/n_pairs, 2) AS tier0_refused_pct,
        round(100.0E0*n_gate_filtered/(n_pairs - n_tier0_refused), 2) AS gate_filtered_pct, round(100.0E0*(n_pairs - n_candidates)/n_pairs, 2) AS total_reduction_pct,
        round(100.0E0*calls/n_pairs, 2) AS vlm_call_rate_pct, calls < n_candidates AS budget_capped
        FROM (SELECT count(*) AS n_pairs, count(*) FILTER (gate = 'low_quality') AS n_tier0_refused, count(*) FILTER (gate = 'no_change') AS n_gate_filtered,
              count(*) FILTER (gate = 'candidate_change') AS n_candidates, count(*) FILTER (vlm_called) AS calls FROM pr)"""
    ),
)
def funnel_reductions(spark, d):
    names = "n_pairs n_tier0_refused n_gate_filtered n_candidates tier0_refused_pct gate_filtered_pct total_reduction_pct vlm_call_rate_pct budget_capped"
    return cost.funnel(_funnel(spark, d)).select(*names.split())


@query(
    "funnel_city_coverage",
    _with_funnel(
        """SELECT city, coalesce(candidates, 5) AS candidates, coalesce(verified, 0) AS verified FROM
        (SELECT city, count(*) AS candidates, count(*) FILTER (vlm_called) AS verified FROM pr WHERE gate = 'candidate_change' GROUP BY city)
        FULL JOIN (SELECT CAST(n_nationkey + 3 AS INT) AS city FROM nation) USING (city)"""
    ),
)
def funnel_city_coverage(spark, d):
    listed = table(spark, d, "nation").select((F.col("n_nationkey") + 3).cast("int").alias("city"), F.lit(5).cast("bigint").alias("n"))
    return cost.city_coverage(_funnel(spark, d), listed)


@query("funnel_verdict_histogram", _with_funnel("SELECT vlm_verdict, count(*) AS n FROM pr WHERE vlm_verdict IS NOT NULL GROUP BY vlm_verdict"))
def funnel_verdict_histogram(spark, d):
    return cost.verdict_histogram(_funnel(spark, d))


@query("cost_usage_rates", _with_funnel("SELECT tile_id, model, batch, priced, round(cost_usd, 8) AS cost_usd, round(sync_usd, 8) AS cost_usd_synchronous FROM pr"))
def cost_usage_rates(spark, d):
    return rounded(_funnel(spark, d).select("tile_id", "model", "batch", "priced", "cost_usd", "cost_usd_synchronous"), 8)


@query(
    "cost_projection",
    _with_funnel(
        """SELECT round(spent, 4) AS total_usd, round(per_call, 6) AS usd_per_call, round(per_call*n_pairs, 4) AS review_everything_usd,
        round(per_call*n_candidates, 4) AS projected_usd, round(per_sync*n_candidates, 4) AS projected_synchronous_usd,
        round(100.0E0*(1.0E0 - (per_call*n_candidates)/(per_call*n_pairs)), 2) AS savings_pct,
        round(100.0E0*(1.0E0 - (per_call*n_candidates)/(per_sync*n_candidates)), 2) AS batch_saving_pct
        FROM (SELECT count(*) AS n_pairs, count(*) FILTER (gate = 'candidate_change') AS n_candidates, sum(cost_usd) FILTER (vlm_called) AS spent,
              avg(cost_usd) FILTER (vlm_called) AS per_call, avg(sync_usd) FILTER (vlm_called) AS per_sync FROM pr)"""
    ),
)
def cost_projection(spark, d):
    names = "total_usd usd_per_call review_everything_usd projected_usd projected_synchronous_usd savings_pct batch_saving_pct"
    return cost.funnel(_funnel(spark, d)).select(*names.split())


@query("cost_unpriced", _with_funnel("SELECT model, count(*) AS n, bool_and(priced) AS priced, round(sum(cost_usd), 6) AS total_usd FROM pr GROUP BY model"))
def cost_unpriced(spark, d):
    return _funnel(spark, d).groupBy("model").agg(
        F.count(F.lit(1)).alias("n"), F.every(F.col("priced")).alias("priced"), F.round(F.sum("cost_usd"), 6).alias("total_usd")
    )


def _share(name: str, k: str, n: str) -> str:
    low, high = wilson(k, n)
    return f"round(CASE WHEN {n} > 0 THEN CAST({k} AS DOUBLE)/{n} ELSE 0.0E0 END, 6) AS {name}, {low} AS {name}_low, {high} AS {name}_high"


@query(
    "tier2_gate_vs_verifier",
    _with_funnel(
        f"""SELECT n, {_share('gate_alone', 'changes', 'n')}, {_share('gate_plus_verifier', 'fc', 'fw')}, {_share('errors_rejected', 're', 'errors')},
        {_share('changes_retained', 'fc', 'changes')} FROM (SELECT count(*) AS n, count(*) FILTER (label = 1) AS changes, count(*) FILTER (label = 0) AS errors,
        count(*) FILTER (vlm_verdict = 'real_change') AS fw, count(*) FILTER (vlm_verdict = 'real_change' AND label = 1) AS fc,
        count(*) FILTER (vlm_verdict <> 'real_change' AND label = 0) AS re FROM pr WHERE vlm_called)"""
    ),
)
def tier2_gate_vs_verifier(spark, d):
    return cost.second_tier(_funnel(spark, d).where("vlm_called"))


@query(
    "verdict_review_rule",
    _with_funnel("SELECT tile_id, vlm_verdict, vlm_confidence, vlm_verdict = 'uncertain' OR vlm_confidence < 0.5E0 AS human_review FROM (SELECT *, input_tokens % 10 / 10.0E0 AS vlm_confidence FROM pr WHERE vlm_called)"),
)
def verdict_review_rule(spark, d):
    rows = _funnel(spark, d).where("vlm_called").withColumn("vlm_confidence", (F.col("input_tokens") % 10).cast("double") / 10.0)
    return cost.needs_review(rows).select("tile_id", "vlm_verdict", "vlm_confidence", "human_review")


# --- budgets ------------------------------------------------------------------

_CUM = """cu AS (SELECT score, CAST(sum(count(*)) OVER w AS BIGINT) AS flagged, CAST(sum(count(*) FILTER (label = 1)) OVER w AS BIGINT) AS hits
  FROM sc GROUP BY score WINDOW w AS (ORDER BY score DESC ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW))"""


@query(
    "budget_threshold_ties",
    _scored("SELECT k, min(score) AS threshold, coalesce(max(flagged), 0) AS flagged FROM (SELECT unnest(range(0, 60)) AS k) LEFT JOIN cu ON flagged <= k GROUP BY k", _CUM),
)
def budget_threshold_ties(spark, d):
    return selection.thresholds_for_calls(views.scored(spark, d), spark.range(60).withColumnRenamed("id", "k"), "score")


_BUDGETS = [0.0, 0.05, 0.25, 1.0, 2.0, 1000.0]


@query(
    "budget_curve",
    _scored(
        """SELECT budget, calls, threshold, flagged, calls - flagged AS unused_calls, round(CAST(hits AS DOUBLE)/positives, 6) AS recall,
        round(CASE WHEN flagged > 0 THEN CAST(hits AS DOUBLE)/flagged END, 6) AS "precision", round(flagged*0.004689E0, 6) AS spend FROM (
        SELECT budget, calls, positives, arg_max(score, flagged) AS threshold, coalesce(max(flagged), 0) AS flagged, coalesce(arg_max(hits, flagged), 0) AS hits
        FROM (SELECT budget, CAST(least(floor(budget/0.004689E0), n) AS BIGINT) AS calls, positives FROM (VALUES (0.0E0), (0.05E0), (0.25E0), (1.0E0), (2.0E0), (1000.0E0)) b(budget),
              (SELECT count(*) AS n, count(*) FILTER (label = 1) AS positives FROM sc)) LEFT JOIN cu ON flagged <= calls GROUP BY budget, calls, positives)""",
        _CUM,
    ),
)
def budget_curve(spark, d):
    return selection.operating_points(views.scored(spark, d), _BUDGETS, 0.004689, "score", "label")


def _candidates(spark, d):
    return _funnel(spark, d).where("gate = 'candidate_change'").select("city", "tile_id")


@query("select_sequential", _with_funnel("SELECT city, tile_id FROM pr WHERE gate = 'candidate_change' ORDER BY city, tile_id LIMIT 40"))
def select_sequential(spark, d):
    return selection.select_candidates(_candidates(spark, d), 40, "sequential")


@query(
    "select_stratified_alloc",
    "WITH " + ",\n".join(
        [
            _FUNNEL,
            "s AS (SELECT city, count(*) AS n FROM fn WHERE gate = 'candidate_change' GROUP BY city)",
            """a AS (SELECT city, n, 200.0E0*n/sum(n) OVER () AS fair, least(n, greatest(1, CAST(floor(200.0E0*n/sum(n) OVER ()) AS BIGINT))) AS base FROM s)""",
            "r AS (SELECT *, row_number() OVER (ORDER BY fair - base DESC, city DESC) AS rk, 200 - sum(base) OVER () AS left_over FROM a)",
        ]
    )
    + """ SELECT city, n, CAST(CASE WHEN sum(n) OVER () <= 200 THEN n ELSE base + CASE WHEN rk <= left_over THEN 1 ELSE 0 END END AS BIGINT) AS calls FROM r""",
)
def select_stratified_alloc(spark, d):
    """At this budget no floor overshoots, so the remainders decide and SQL can say it."""
    return selection.allocation(_candidates(spark, d), 200)


_ALLOC = [
    _FUNNEL,
    "s AS (SELECT city, count(*) AS n FROM fn WHERE gate = 'candidate_change' GROUP BY city)",
    "a AS (SELECT city, n, 200.0E0*n/sum(n) OVER () AS fair, least(n, greatest(1, CAST(floor(200.0E0*n/sum(n) OVER ()) AS BIGINT))) AS base FROM s)",
    "r AS (SELECT *, row_number() OVER (ORDER BY fair - base DESC, city DESC) AS rk, 200 - sum(base) OVER () AS left_over FROM a)",
    "k AS (SELECT city, CASE WHEN sum(n) OVER () <= 200 THEN n ELSE base + CASE WHEN rk <= left_over THEN 1 ELSE 0 END END AS calls FROM r)",
    "o AS (SELECT city, tile_id, row_number() OVER (PARTITION BY city ORDER BY md5('42:' || tile_id), tile_id) AS place FROM fn WHERE gate = 'candidate_change')",
]


@query("select_stratified_draw", "WITH " + ",\n".join(_ALLOC) + " SELECT o.city, o.tile_id FROM o JOIN k ON k.city = o.city WHERE o.place <= k.calls")
def select_stratified_draw(spark, d):
    return selection.select_candidates(_candidates(spark, d), 200, "stratified")


@query("sample_tiles_seeded", f"WITH {_FUNNEL} SELECT tile_id, city FROM fn ORDER BY md5('42:' || tile_id), tile_id LIMIT 100")
def sample_tiles_seeded(spark, d):
    return selection.sample_tiles(_funnel(spark, d).select("tile_id", "city"), 100)


# --- risk -----------------------------------------------------------------------

_ALPHA, _DELTA = 0.3, 0.1


@query(
    "conformal_lambda",
    _scored(
        f"""SELECT max(lam) FILTER (bound <= {_ALPHA}) AS lambda, round(arg_max(fnr, lam) FILTER (bound <= {_ALPHA}), 6) AS fnr,
        round(arg_max(bound, lam) FILTER (bound <= {_ALPHA}), 6) AS bound, max(n) AS n_pos, count(*) FILTER (bound <= {_ALPHA}) > 0 AS controlled
        FROM (SELECT lam, n, fnr, CASE WHEN n > 0 THEN least(1.0E0, fnr + sqrt(ln(1.0E0/{_DELTA})/(2.0E0*n))) ELSE 1.0E0 END AS bound FROM (
          SELECT i/200.0E0 AS lam, count(*) AS n, CAST(count(*) FILTER (score < i/200.0E0) AS DOUBLE)/count(*) AS fnr FROM range(0, 201) g(i), sc WHERE label = 1 GROUP BY i))"""
    ),
)
def conformal_lambda(spark, d):
    return risk.calibrate(views.scored(spark, d), "label", "score", _ALPHA, _DELTA)


@query(
    "conformal_by_group",
    _scored(
        """SELECT city, n_pos, missed, flagged, round(CASE WHEN n_pos > 0 THEN CAST(missed AS DOUBLE)/n_pos END, 6) AS fnr,
        CASE WHEN n_pos > 0 THEN CAST(missed AS DOUBLE)/n_pos <= 0.3E0 END AS held FROM (SELECT city, count(*) FILTER (label = 1) AS n_pos,
        count(*) FILTER (label = 1 AND score < 0.3E0) AS missed, count(*) FILTER (score >= 0.3E0) AS flagged FROM sc GROUP BY city)"""
    ),
)
def conformal_by_group(spark, d):
    return risk.by_group(views.scored(spark, d), "label", "score", "city", 0.3, 0.3)


@query("split_disjoint", _scored("SELECT city FROM sc WHERE doc_id % 2 = 0 INTERSECT SELECT city FROM sc WHERE label = 0"))
def split_disjoint(spark, d):
    rows = views.scored(spark, d)
    return risk.overlap(rows.where("doc_id % 2 = 0"), rows.where("label = 0"), "city")


@query(
    "split_calibration",
    _scored(
        """SELECT city, CASE WHEN place <= least(n - 1, greatest(1, CAST(floor(n*0.3E0 + 0.5E0) AS BIGINT))) THEN 'calibration' ELSE 'fit' END AS side
        FROM (SELECT city, row_number() OVER (ORDER BY md5('42:' || city), city) AS place, count(*) OVER () AS n FROM (SELECT DISTINCT city FROM sc))"""
    ),
)
def split_calibration(spark, d):
    return risk.split_rows(views.scored(spark, d), "city")


# The default axes in number and length, at values that split these tables.
_AXES = {
    "background_sigma": [0.0, 0.5, 1.0, 2.0],
    "min_changed_area_percent": [2.0, 4.0, 6.0, 10.0, 20.0],
    "ndvi_strong_min": [0.26, 0.28, 0.3, 0.34],
    "ndbi_strong_min": [0.26, 0.28, 0.3, 0.34],
    "ndvi_delta_mean_min": [0.2, 0.22, 0.24],
    "ndbi_delta_mean_min": [0.2, 0.22, 0.24],
    "urbanization_score_min": [0.02, 0.06, 0.1],
}


def _sweep_sql(body: str) -> str:
    g = GATE
    axes = list(_AXES.items())[1:]
    grid = ", ".join(f"(VALUES {', '.join(f'({i}, {v}E0)' for i, v in enumerate(values))}) a{k}(i{k}, v{k})" for k, (_, values) in enumerate(axes, 1))
    combo = "i0"
    for k, (_, values) in enumerate(axes, 1):
        combo = f"({combo})*{len(values)} + i{k}"
    hit = f"""(ndvi_delta_abs_mean >= v2 OR ndbi_delta_abs_mean >= v3
      OR ((ndvi_delta_abs_mean >= v4 OR ndbi_delta_abs_mean >= v5) AND changed_area_percent >= v1)
      OR (urbanization_score >= v6 AND changed_area_percent >= v1)
      OR (magnitude_p95 >= {g.magnitude_p95_min} AND largest_component_px >= {g.min_largest_component_px})
      OR (changed_area_percent >= v1 AND (ssim < {g.ssim_no_change_min} OR phash_distance > {g.phash_no_change_max}) AND cva_magnitude_mean >= {g.cva_magnitude_mean_min})
      OR (ndwi_delta_abs_mean >= {g.ndwi_delta_mean_min} AND changed_area_percent >= v1))"""
    tally = """CAST(count(*) FILTER (label = 1 AND hit) AS BIGINT) AS tp, CAST(count(*) FILTER (label = 0 AND hit) AS BIGINT) AS fp,
      CAST(count(*) FILTER (label = 1 AND NOT hit) AS BIGINT) AS fn, CAST(count(*) FILTER (label = 0 AND NOT hit) AS BIGINT) AS tn"""
    score = """round(CASE WHEN tn + fp > 0 THEN (CASE WHEN tp + fn > 0 THEN CAST(tp AS DOUBLE)/(tp + fn) ELSE 0.0E0 END + CAST(tn AS DOUBLE)/(tn + fp))/2.0E0
        ELSE 0.0E0 END, 6) AS score"""
    return chain(
        "dl",
        body,
        swept_features(_AXES["background_sigma"]),
        f"gr AS (SELECT * FROM (SELECT CAST(range AS INT) AS i0 FROM range(0, {len(_AXES['background_sigma'])})), {grid})",
        f"jd AS (SELECT CAST({combo.replace('i0', 'gr.i0')} AS INT) AS combo, label, {hit} AS hit FROM gr LEFT JOIN fs ON fs.i0 = gr.i0 AND valid_observation)",
        f"sw AS (SELECT combo, tp, fp, fn, tn, {score} FROM (SELECT combo, {tally} FROM jd GROUP BY combo))",
        f"""bl AS (SELECT tp, fp, fn, tn, {score} FROM (SELECT {tally} FROM (SELECT label, gate = 'candidate_change' AS hit FROM
          (WITH {baseline_gate()} SELECT label, gate FROM gt WHERE valid_observation))))""",
    )


def _best_sql() -> str:
    names = list(_AXES)
    at, left = {}, "combo"
    for n in reversed(names):
        values = _AXES[n]
        at[n] = f"[{', '.join(f'{v}E0' for v in values)}][{left} % {len(values)} + 1]"
        left = f"({left} // {len(values)})"
    best = ", ".join(f"{at[n]} AS {n}" for n in names)
    held = ", ".join(f"CAST({getattr(GATE, n)} AS DOUBLE) AS {n}" for n in names)
    return _sweep_sql(
        f"""SELECT 'best' AS which, {best}, tp, fp, fn, tn, score, 8640 AS n_evaluated FROM (SELECT * FROM sw ORDER BY score DESC, combo LIMIT 1)
        UNION ALL SELECT 'baseline', {held}, tp, fp, fn, tn, score, 8640 FROM bl"""
    )


@query("sweep_argmax", _sweep_sql("SELECT combo, tp, fp, fn, tn, score FROM sw"))
def sweep_argmax(spark, d):
    return risk.sweep_sigmas(views.swept(spark, d, _AXES["background_sigma"]), _AXES, GATE)


@query("sweep_best", _best_sql())
def sweep_best(spark, d):
    return risk.best_and_baseline(views.swept(spark, d, [*_AXES["background_sigma"], GATE.background_sigma]), _AXES, GATE)


@query("stat_hoeffding_bound", """SELECT r_regionkey AS k, round(least(1.0E0, r_regionkey/10.0E0 + sqrt(ln(10.0E0)/(2.0E0*(r_regionkey*10 + 5)))), 6) AS bound FROM region""")
def stat_hoeffding_bound(spark, d):
    k = F.col("r_regionkey")
    bound = stats.hoeffding_ucb(k.cast("double") / 10.0, k * 10 + 5, 0.1)
    return table(spark, d, "region").select(k.alias("k"), F.round(bound, 6).alias("bound"))
