"""Shared pieces of the oracle SQL: the pixel view and what is built on it, as chained CTEs."""

from __future__ import annotations

from dataclasses import replace

from terrashift.config import GateThresholds, MaskThresholds, QualityThresholds
from terrashift.operators.kernels import ellipse_rows

# The pixel view's values aren't physical reflectances, so the catalogue runs the operators under thresholds that
# split them; the shipped values are the defaults of the operators.
MASKS = MaskThresholds(
    cloud_brightness=0.62,
    cloud_ndvi_max=0.2,
    snow_ndsi_min=0.25,
    snow_nir_min=0.3,
    water_ndwi_min=0.2,
    shadow_nir_max=0.25,
    shadow_brightness_max=0.5,
)
QUALITY = QualityThresholds(cloud_fraction_max=0.22, min_valid_pixel_fraction=0.5)
GATE = GateThresholds(
    min_absolute_delta=0.1,
    max_absolute_delta=0.9,
    cva_magnitude_threshold=0.9,
    min_changed_area_percent=4.0,
    ndvi_delta_mean_min=0.22,
    ndbi_delta_mean_min=0.22,
    ndwi_delta_mean_min=0.2,
    ndvi_strong_min=0.3,
    ndbi_strong_min=0.3,
    urbanization_score_min=0.06,
    magnitude_p95_min=0.8,
    min_largest_component_px=6,
    cva_magnitude_mean_min=0.4,
    ssim_no_change_min=0.6,
    phash_no_change_max=20,
    min_component_size_px=1,
    open_radius_px=0,
)
# The same with shadow taken out and the change mask despeckled; the cut is the median, so that regions outlive the opening.
CLEAR_MASKS = replace(MASKS, shadow_search_radius_px=3)
CLEAR_GATE = replace(GATE, background_sigma=0.0, cva_magnitude_threshold=0.5, open_radius_px=1, min_component_size_px=6)
TILE = 8

OBS = """
obs AS (
  SELECT CAST(l_linenumber AS INT) AS scene, CAST(l_suppkey % 32 AS INT) AS y, CAST(l_partkey % 32 AS INT) AS x,
         CASE WHEN l_shipdate < TIMESTAMP '1998-06-01 00:00:00' THEN 1 ELSE 2 END AS t,
         CAST(SUM(CAST(l_orderkey % 100 AS BIGINT)) AS DOUBLE)/COUNT(*)/100.0E0 AS blue,
         CAST(SUM(CAST(ROUND(l_tax*100) AS BIGINT)) AS DOUBLE)/COUNT(*)/8.0E0 AS green,
         CAST(SUM(CAST(l_quantity AS BIGINT)) AS DOUBLE)/COUNT(*)/50.0E0 AS red,
         CAST(SUM(CAST(ROUND(l_extendedprice) AS BIGINT)) AS DOUBLE)/COUNT(*)/100000.0E0 AS nir,
         CAST(SUM(CAST(ROUND(l_discount*100) AS BIGINT)) AS DOUBLE)/COUNT(*)/10.0E0 AS swir
  FROM lineitem GROUP BY 1,2,3,4)"""


def nd(a: str, b: str) -> str:
    return f"(CASE WHEN {a} IS NOT NULL AND {b} IS NOT NULL AND {a}+{b} > 0.02E0 THEN ({a}-{b})/({a}+{b}) ELSE 0.0E0 END)"


def _pair() -> str:
    cols = ", ".join(f"MAX(CASE WHEN t={t} THEN {b} END) AS {b}{t}" for t in (1, 2) for b in ("blue", "green", "red", "nir", "swir"))
    return f"px AS (SELECT scene, y, x, {cols} FROM obs GROUP BY scene, y, x)"


def _masks(m: MaskThresholds, shadow: bool = False) -> str:
    steps = []
    for t in (1, 2):
        bright = f"(blue{t}+green{t}+red{t})/3.0E0"
        steps.append(
            f"""
        (blue{t} IS NOT NULL AND green{t} IS NOT NULL AND red{t} IS NOT NULL AND nir{t} IS NOT NULL AND swir{t} IS NOT NULL) AS obs{t},
        coalesce({nd(f'green{t}', f'swir{t}')} > {m.snow_ndsi_min} AND nir{t} > {m.snow_nir_min}, FALSE) AS snow{t},
        coalesce({bright} > {m.cloud_brightness} AND {nd(f'nir{t}', f'red{t}')} < {m.cloud_ndvi_max}
          AND NOT ({nd(f'green{t}', f'swir{t}')} > {m.snow_ndsi_min} AND nir{t} > {m.snow_nir_min}), FALSE) AS cloud{t},
        coalesce({nd(f'green{t}', f'nir{t}')} > {m.water_ndwi_min} AND nir{t} IS NOT NULL, FALSE) AS water{t},
        coalesce(nir{t} < {m.shadow_nir_max} AND {bright} < {m.shadow_brightness_max}, FALSE) AS dark{t}"""
        )
    near = " OR ".join(f"(b.y - a.y = {dy} AND abs(b.x - a.x) <= {half})" for dy, half in ellipse_rows(m.shadow_search_radius_px)) if shadow else "FALSE"
    shaded = ", ".join(f"dark{t} AND EXISTS (SELECT 1 FROM mk0 b WHERE b.scene = a.scene AND b.cloud{t} AND ({near})) AS shadow{t}" for t in (1, 2))
    return f"""
mk0 AS (SELECT px.*, {', '.join(steps)} FROM px),
mk1 AS (SELECT a.*, {shaded if shadow else 'FALSE AS shadow1, FALSE AS shadow2'} FROM mk0 a),
mk2 AS (SELECT mk1.*, (obs1 AND NOT cloud1 AND NOT snow1 AND NOT shadow1) AS valid1, (obs2 AND NOT cloud2 AND NOT snow2 AND NOT shadow2) AS valid2 FROM mk1),
mk AS (SELECT mk2.*, (cloud1 OR cloud2) AS cloud, (snow1 OR snow2) AS snow, (water1 OR water2) AS water, (dark1 OR dark2) AS dark,
         (shadow1 OR shadow2) AS shadow, (valid1 AND valid2) AS valid FROM mk2)"""


DELTAS = f"""
dl0 AS (SELECT mk.*, {nd('nir2', 'red2')} - {nd('nir1', 'red1')} AS d_ndvi, {nd('swir2', 'nir2')} - {nd('swir1', 'nir1')} AS d_ndbi,
          {nd('green2', 'nir2')} - {nd('green1', 'nir1')} AS d_ndwi,
          sqrt((blue2-blue1)*(blue2-blue1) + (green2-green1)*(green2-green1) + (red2-red1)*(red2-red1) + (nir2-nir1)*(nir2-nir1)) AS cva
        FROM mk),
dl AS (SELECT dl0.*, CASE WHEN water THEN abs(d_ndwi) ELSE greatest(abs(d_ndvi), abs(d_ndbi)) END AS magnitude FROM dl0)"""


def _cut(g: GateThresholds) -> str:
    return f"""
pool AS (SELECT scene, magnitude FROM (SELECT dl.*, bool_or(valid) OVER (PARTITION BY scene) AS any_valid FROM dl) WHERE valid OR NOT any_valid),
med AS (SELECT scene, median(magnitude) AS med FROM pool GROUP BY scene),
cut AS (SELECT p.scene, m.med, median(abs(p.magnitude - m.med)) AS mad,
          least(greatest(m.med + {g.background_sigma}*1.4826E0*median(abs(p.magnitude - m.med)), {g.min_absolute_delta}), {g.max_absolute_delta}) AS cut
        FROM pool p JOIN med m ON p.scene = m.scene GROUP BY p.scene, m.med),
ch AS (SELECT dl.*, cut.cut, coalesce(magnitude > cut.cut OR cva > {g.cva_magnitude_threshold}, FALSE) AND valid AS changed,
         CAST(floor(y/{TILE}) AS INT) AS trow, CAST(floor(x/{TILE}) AS INT) AS tcol
       FROM dl JOIN cut ON dl.scene = cut.scene)"""


def _features(pixels: str = "ch") -> str:
    def z(x: str) -> str:
        return f"coalesce({x}, 0.0E0)"

    means = ", ".join(
        f"{z(f'avg(d_{i}) FILTER (valid)')} AS {i}_delta_mean, {z(f'avg(abs(d_{i})) FILTER (valid)')} AS {i}_delta_abs_mean" for i in ("ndvi", "ndbi", "ndwi")
    )
    return f"""
ft0 AS (SELECT scene, trow, tcol, {means}, {z('avg(cva) FILTER (valid)')} AS cva_magnitude_mean,
          CASE WHEN count(*) FILTER (valid) > 0 THEN 100.0E0*count(*) FILTER (changed)/count(*) FILTER (valid) ELSE 0.0E0 END AS changed_area_percent,
          {z('quantile_cont(d_ndvi, 0.1) FILTER (valid)')} AS ndvi_delta_p10, {z('quantile_cont(d_ndbi, 0.9) FILTER (valid)')} AS ndbi_delta_p90,
          {z('quantile_cont(magnitude, 0.95) FILTER (valid)')} AS magnitude_p95, {z('quantile_cont(magnitude, 0.99) FILTER (valid)')} AS magnitude_p99,
          count(*) FILTER (valid) AS n_valid, CAST(count(*) FILTER (changed) AS INT) AS largest_component_px,
          avg(CASE WHEN cloud THEN 1.0E0 ELSE 0.0E0 END) AS cloud_fraction, avg(CASE WHEN valid THEN 1.0E0 ELSE 0.0E0 END) AS valid_fraction
        FROM {pixels} GROUP BY scene, trow, tcol),
ft AS (SELECT ft0.*, ndbi_delta_mean - ndvi_delta_mean AS urbanization_score,
         greatest(0.0E0, 1.0E0 - cva_magnitude_mean) AS ssim, CAST(n_valid % 32 AS INT) AS phash_distance,
         (cloud_fraction <= {QUALITY.cloud_fraction_max} AND valid_fraction >= {QUALITY.min_valid_pixel_fraction}) AS valid_observation,
         CASE WHEN (trow + tcol + scene) % 2 = 0 THEN 1 ELSE 0 END AS label FROM ft0)"""


def _gate(g: GateThresholds, features: str = "ft") -> str:
    def ramp(v: str, lo: float, hi: float) -> str:
        return f"least(greatest(({v} - {lo!r})/{hi - lo!r}, 0.0E0), 1.0E0)"

    spectral = "greatest(ndvi_delta_abs_mean, ndbi_delta_abs_mean)"
    area = f"changed_area_percent >= {g.min_changed_area_percent}"
    confidence = " + ".join(
        f"{w}*{r}"
        for w, r in (
            ("0.35E0", ramp(spectral, 0.5 * g.ndvi_delta_mean_min, g.ndvi_strong_min)),
            ("0.20E0", ramp("changed_area_percent", 0.0, 2 * g.min_changed_area_percent)),
            ("0.15E0", ramp("cva_magnitude_mean", 0.0, 2 * g.cva_magnitude_mean_min)),
            ("0.10E0", ramp("(1.0E0 - ssim)", 0.0, 1 - g.ssim_no_change_min)),
            ("0.12E0", ramp("urbanization_score", 0.0, 2 * g.urbanization_score_min)),
            ("0.08E0", ramp("magnitude_p95", 0.0, 2 * g.magnitude_p95_min)),
        )
    )
    return f"""
gt0 AS (SELECT {features}.*, CASE
    WHEN NOT valid_observation THEN 'failed Tier 0 quality checks'
    WHEN ndvi_delta_abs_mean >= {g.ndvi_strong_min} OR ndbi_delta_abs_mean >= {g.ndbi_strong_min} THEN 'strong landcover index change'
    WHEN (ndvi_delta_abs_mean >= {g.ndvi_delta_mean_min} OR ndbi_delta_abs_mean >= {g.ndbi_delta_mean_min}) AND {area}
      THEN 'moderate landcover change over a large area'
    WHEN urbanization_score >= {g.urbanization_score_min} AND {area} THEN 'built-up gain with vegetation loss'
    WHEN magnitude_p95 >= {g.magnitude_p95_min} AND largest_component_px >= {g.min_largest_component_px}
      THEN 'concentrated high-magnitude change region'
    WHEN {area} AND (ssim < {g.ssim_no_change_min} OR phash_distance > {g.phash_no_change_max}) AND cva_magnitude_mean >= {g.cva_magnitude_mean_min}
      THEN 'structural break with multi-band change vector'
    WHEN ndwi_delta_abs_mean >= {g.ndwi_delta_mean_min} AND {area} THEN 'water extent change over a large area'
    ELSE 'insufficient change evidence' END AS gate_reason,
    CASE WHEN valid_observation THEN round(least(greatest({confidence}, 0.0E0), 1.0E0), 4) ELSE 0.0E0 END AS gate_confidence FROM {features}),
gt AS (SELECT gt0.*, CASE gate_reason WHEN 'failed Tier 0 quality checks' THEN 'low_quality' WHEN 'insufficient change evidence' THEN 'no_change'
         ELSE 'candidate_change' END AS gate FROM gt0)"""


_CHAIN = [OBS, _pair(), _masks(MASKS), DELTAS, _cut(GATE), _features(), _gate(GATE)]
_UP_TO = {"obs": 1, "px": 2, "mk": 3, "dl": 4, "ch": 5, "ft": 6, "gt": 7}


def chain(last: str, body: str, *more: str) -> str:
    """WITH everything up to the view ``last``, then ``more`` CTEs, then ``body``."""
    return "WITH " + ",\n".join([*_CHAIN[: _UP_TO[last]], *more]) + "\n" + body


def swept_features(sigmas: list[float]) -> str:
    """fs: the tile features under each background sigma, with its place in the list."""
    parts = (
        f"SELECT * FROM (WITH {_cut(replace(GATE, background_sigma=s))},\n{_features()} SELECT {k} AS i0, ft.* FROM ft)" for k, s in enumerate(sigmas)
    )
    return "fs AS (" + "\nUNION ALL ".join(parts) + ")"


def baseline_gate() -> str:
    """The views from the cut to the ladder, for use over ``dl``."""
    return ",\n".join([_cut(GATE), _features(), _gate(GATE)])


def gate_from_pixels() -> str:
    """The views from the masks to the ladder, for use over another ``px``."""
    return ",\n".join([_masks(MASKS), DELTAS, baseline_gate()])


# Opening by a cross within a tile's frame, beyond which everything counts as set; then small components go.
OPENED = """
fr AS (SELECT scene, trow, tcol, min(y) AS y0, max(y) AS y1, min(x) AS x0, max(x) AS x1 FROM ch GROUP BY 1, 2, 3),
gd AS (SELECT f.*, CAST(a.v AS INT) AS y, CAST(b.v AS INT) AS x FROM fr f, unnest(range(y0, y1 + 1)) a(v), unnest(range(x0, x1 + 1)) b(v)),
st AS (SELECT scene, trow, tcol, y, x FROM ch WHERE changed),
di(dy, dx) AS (VALUES (0, 0), (-1, 0), (1, 0), (0, -1), (0, 1)),
er AS (SELECT g.scene, g.trow, g.tcol, g.y, g.x FROM gd g, di
         LEFT JOIN st ON st.scene = g.scene AND st.trow = g.trow AND st.tcol = g.tcol AND st.y = g.y + di.dy AND st.x = g.x + di.dx
       GROUP BY 1, 2, 3, 4, 5
       HAVING bool_and(st.y IS NOT NULL OR g.y + di.dy < g.y0 OR g.y + di.dy > g.y1 OR g.x + di.dx < g.x0 OR g.x + di.dx > g.x1)),
dt AS (SELECT DISTINCT scene, trow, tcol, y + dy AS y, x + dx AS x FROM er, di),
op AS (SELECT ch.* EXCLUDE (changed), dt.y IS NOT NULL AS changed FROM ch LEFT JOIN dt ON dt.scene = ch.scene AND dt.trow = ch.trow AND dt.tcol = ch.tcol
         AND dt.y = ch.y AND dt.x = ch.x)"""


def components(pixels: str) -> str:
    """m: each changed pixel of a tile with the root of its 8-connected component; s: the components' sizes."""
    return f"""
e AS (SELECT scene, trow, tcol, y, x, y*32 + x AS id FROM {pixels} WHERE changed),
n AS (SELECT a.scene, a.trow, a.tcol, a.id AS a, b.id AS b FROM e a JOIN e b ON a.scene = b.scene AND a.trow = b.trow AND a.tcol = b.tcol
        AND abs(a.y - b.y) <= 1 AND abs(a.x - b.x) <= 1),
c AS (SELECT scene, trow, tcol, id, id AS root FROM e UNION SELECT c.scene, c.trow, c.tcol, n.b, c.root FROM c JOIN n ON c.scene = n.scene AND c.trow = n.trow
        AND c.tcol = n.tcol AND c.id = n.a WHERE c.root < n.b),
m AS (SELECT scene, trow, tcol, id, min(root) AS root FROM c GROUP BY 1, 2, 3, 4),
s AS (SELECT scene, trow, tcol, root, count(*) AS px FROM m GROUP BY 1, 2, 3, 4)"""


_KEPT = f"""
cl AS (SELECT op.* EXCLUDE (changed), coalesce(s.px >= {CLEAR_GATE.min_component_size_px}, FALSE) AS changed FROM op
       LEFT JOIN m ON m.scene = op.scene AND m.trow = op.trow AND m.tcol = op.tcol AND m.id = op.y*32 + op.x
       LEFT JOIN s ON s.scene = m.scene AND s.trow = m.trow AND s.tcol = m.tcol AND s.root = m.root)"""
_LARGEST = f"""
big AS (SELECT scene, trow, tcol, CAST(max(px) AS INT) AS px FROM s WHERE px >= {CLEAR_GATE.min_component_size_px} GROUP BY 1, 2, 3),
fc AS (SELECT ft.* EXCLUDE (largest_component_px), coalesce(big.px, 0) AS largest_component_px FROM ft
       LEFT JOIN big ON big.scene = ft.scene AND big.trow = ft.trow AND big.tcol = ft.tcol)"""
_CLEAR = [OBS, _pair(), _masks(CLEAR_MASKS, True), DELTAS, _cut(CLEAR_GATE), OPENED, components("op"), _KEPT, _features("cl"), _LARGEST, _gate(CLEAR_GATE, "fc")]
_CLEAR_UP_TO = _UP_TO | {"op": 6, "cl": 8, "fc": 10, "gt": 11}


def clear_chain(last: str, body: str) -> str:
    """As ``chain``, with shadow taken out of the valid cells and the change mask opened (op) and despeckled (cl)."""
    return "WITH RECURSIVE " + ",\n".join(_CLEAR[: _CLEAR_UP_TO[last]]) + "\n" + body


def wilson(k: str, n: str) -> tuple[str, str]:
    z = "1.959963984540054E0"
    p = f"(CAST({k} AS DOUBLE)/CAST({n} AS DOUBLE))"
    d = f"CAST({n} AS DOUBLE)"
    centre = f"({p} + {z}*{z}/(2.0E0*{d}))/(1.0E0 + {z}*{z}/{d})"
    half = f"{z}*sqrt({p}*(1.0E0-{p})/{d} + {z}*{z}/(4.0E0*{d}*{d}))/(1.0E0 + {z}*{z}/{d})"
    low = f"round(CASE WHEN {n} > 0 THEN greatest(0.0E0, {centre} - {half}) ELSE 0.0E0 END, 6)"
    high = f"round(CASE WHEN {n} > 0 THEN least(1.0E0, {centre} + {half}) ELSE 1.0E0 END, 6)"
    return low, high


# Scored rows: labelled documents, a score with real ties and the source as the group.
SCORED = """
sc AS (SELECT d.doc_id, d.source AS city, l.quality AS label, l.toxic,
         CAST((d.n_chars * 7 + d.doc_id * 3 + l.quality * 30) % 101 AS DOUBLE)/100.0E0 AS score
       FROM documents d JOIN labels l ON d.doc_id = l.doc_id)"""
