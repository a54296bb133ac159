"""Map algebra over paired pixels: masks, deltas, scene statistics, tile features.

The input is one row for each cell with its bands at both dates. Everything
but the scene-wide statistics is a projection; those are one aggregation per
scene that is joined back.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from terrashift.config import GateThresholds, MaskThresholds, QualityThresholds
from terrashift.functions import indices as ix
from terrashift.operators import quantiles
from terrashift.operators.kernels import ellipse_rows
from terrashift.sources.storage import written


def masks(pixels: DataFrame, m: MaskThresholds | None = None) -> DataFrame:
    """obs, snow, cloud, water, dark and valid of both dates, as columns with 1 or 2 behind the name.

    A cell is valid if it was observed and is neither cloud nor snow; ``dark``
    is a shadow only near a cloud, which ``with_shadow`` finds and takes out of
    valid. Water stays valid.
    """
    m = m or MaskThresholds()
    out: dict[str, Column] = {}
    for t in (1, 2):
        blue, green, red, nir, swir = (F.col(f"{b}{t}") for b in ("blue", "green", "red", "nir", "swir"))
        seen = ix.all_finite(blue, green, red, nir, swir)
        bright = ix.brightness(blue, green, red)
        snow = seen & (ix.ndsi(green, swir) > m.snow_ndsi_min) & (nir > m.snow_nir_min)
        cloud = seen & (bright > m.cloud_brightness) & (ix.ndvi(nir, red) < m.cloud_ndvi_max) & ~snow
        out |= {
            f"obs{t}": seen,
            f"snow{t}": F.coalesce(snow, F.lit(False)),
            f"cloud{t}": F.coalesce(cloud, F.lit(False)),
            f"water{t}": F.coalesce(seen & (ix.ndwi(green, nir) > m.water_ndwi_min), F.lit(False)),
            f"dark{t}": F.coalesce(seen & (nir < m.shadow_nir_max) & (bright < m.shadow_brightness_max), F.lit(False)),
        }
    flagged = pixels.withColumns(out)
    return flagged.withColumns({f"valid{t}": F.expr(f"obs{t} and not cloud{t} and not snow{t}") for t in (1, 2)})


def with_shadow(flagged: DataFrame, radius: int = 30) -> DataFrame:
    """shadow1 and shadow2: dark cells within an elliptic radius of a cloud of their date; valid1 and valid2 lose them.

    Clouds fold into runs along a row, and a run shades one interval in each
    row of the ellipse. A dark cell is shaded if an interval that begins at or
    before it reaches it, which is a running maximum along the row: pixels are
    never joined with clouds, and a task holds a row and not a scene.
    """
    at = ["scene", "t", "y"]
    dates = (F.struct(F.lit(t).alias("t"), F.col(f"dark{t}").alias("dark"), F.col(f"cloud{t}").alias("cloud")) for t in (1, 2))
    cells = flagged.select("scene", "y", "x", F.inline(F.array(*dates)))
    clouds = cells.where("cloud").withColumn("run", F.col("x") - F.dense_rank().over(Window.partitionBy(*at).orderBy("x")))
    runs = clouds.groupBy(*at, "run").agg(F.min("x").alias("low"), F.max("x").alias("high"))
    rows = ellipse_rows(radius) if radius > 0 else []
    spread = F.array(*(F.struct(F.lit(dy).alias("dy"), F.lit(half).alias("half")) for dy, half in rows))
    spans = runs.select(*at, "low", "high", F.inline(spread)) if rows else runs.selectExpr(*at, "low", "high", "0 as dy", "0 as half").where("false")
    begins = spans.selectExpr("scene", "t", "y + dy as y", "low - half as x", "high + half as reach", "false as cell")
    events = begins.unionByName(cells.where("dark").selectExpr(*at, "x", "cast(null as int) as reach", "true as cell"))
    reached = F.max("reach").over(Window.partitionBy(*at).orderBy("x", "cell"))
    shaded = events.withColumn("reached", reached).where("cell and reached >= x")
    shaded = shaded.groupBy("scene", "y", "x").agg(*(F.max(F.col("t") == t).alias(f"shadow{t}") for t in (1, 2)))
    got = flagged.join(shaded, ["scene", "y", "x"], "left")
    got = got.withColumns({f"shadow{t}": F.coalesce(f"shadow{t}", F.lit(False)) for t in (1, 2)})
    return got.withColumns({f"valid{t}": F.col(f"valid{t}") & ~F.col(f"shadow{t}") for t in (1, 2)})


def combined(flagged: DataFrame) -> DataFrame:
    """The union of the defects of both dates, and the cells valid at both."""
    defects = [c for c in ("cloud", "snow", "water", "dark", "shadow") if f"{c}1" in flagged.columns]
    either = {c: F.col(f"{c}1") | F.col(f"{c}2") for c in defects}
    return flagged.withColumns(either | {"valid": F.col("valid1") & F.col("valid2")})


def deltas(pixels: DataFrame) -> DataFrame:
    """d_ndvi, d_ndbi, d_ndwi (after minus before) and the change vector's length."""

    def c(name: str) -> Column:
        return F.col(name)

    return pixels.withColumns(
        {
            "d_ndvi": ix.ndvi(c("nir2"), c("red2")) - ix.ndvi(c("nir1"), c("red1")),
            "d_ndbi": ix.ndbi(c("swir2"), c("nir2")) - ix.ndbi(c("swir1"), c("nir1")),
            "d_ndwi": ix.ndwi(c("green2"), c("nir2")) - ix.ndwi(c("green1"), c("nir1")),
            "cva": ix.cva([(c(f"{b}1"), c(f"{b}2")) for b in ("blue", "green", "red", "nir")]),
        }
    )


def with_magnitude(pixels: DataFrame, over_water: bool = True) -> DataFrame:
    water = F.col("water") if over_water else None
    return pixels.withColumn("magnitude", ix.change_magnitude(F.col("d_ndvi"), F.col("d_ndbi"), F.col("d_ndwi"), water))


def scene_spread(pixels: DataFrame) -> DataFrame:
    """scene, median and mad (the median distance from the median) of the change magnitude, exact.

    The pool is the valid cells, or all cells where a scene has no valid one.
    ``pixels`` is read several times: give a written table.
    """
    n = pixels.count()
    groups = quantiles.medians(pixels, ["scene", "valid"], "magnitude", n)
    pool = groups.groupBy("scene").agg(F.max(F.struct("valid", "median")).alias("p")).select("scene", "p.valid", "p.median")
    pool = quantiles.kept(pool, "scene-medians", n)
    apart = pixels.join(pool, ["scene", "valid"]).select("scene", F.abs(F.col("magnitude") - F.col("median")).alias("apart"))
    mad = quantiles.medians(apart, ["scene"], "apart", n)
    return pool.select("scene", "median").join(mad.select("scene", F.col("median").alias("mad")), "scene")


def cut_at(sigma: float | Column, g: GateThresholds) -> Column:
    """median + sigma * 1.4826 * MAD between the floor and the ceiling, or the fixed threshold."""
    if not g.adaptive_threshold:
        return F.lit(g.index_delta_small)
    return ix.clip(F.col("median") + sigma * 1.4826 * F.col("mad"), g.min_absolute_delta, g.max_absolute_delta)


def scene_cut(pixels: DataFrame, g: GateThresholds | None = None) -> DataFrame:
    """scene, median, mad and cut, in a written table; ``pixels`` is read several times."""
    g = g or GateThresholds()
    return written(scene_spread(pixels).withColumn("cut", cut_at(g.background_sigma, g)), "scene-cuts")


def raw_change(pixels: DataFrame, cuts: DataFrame, g: GateThresholds | None = None) -> DataFrame:
    """``changed``: above the scene's cut, or a long change vector, on a valid cell."""
    g = g or GateThresholds()
    hit = (F.col("magnitude") > F.col("cut")) | (F.col("cva") > g.cva_magnitude_threshold)
    return pixels.join(cuts.select("scene", "cut"), "scene").withColumn("changed", F.coalesce(hit, F.lit(False)) & F.col("valid"))


def fractions(flagged: DataFrame) -> DataFrame:
    """scene and the share of cells with each flag; over the whole frame, and NULL where nothing was observed."""
    assessed = F.max(F.col("obs1")) & F.max(F.col("obs2"))
    share = {c: F.avg(F.col(c).cast("int")) for c in ("cloud", "snow", "water", "dark", "valid")}
    got = flagged.groupBy("scene").agg(F.count(F.lit(1)).alias("n"), assessed.alias("assessed"), *(v.alias(k) for k, v in share.items()))
    return got.select("scene", "n", "assessed", *(F.when(F.col("assessed"), F.col(c)).alias(f"{c}_fraction") for c in share))


def valid_observation(scenes: DataFrame, q: QualityThresholds | None = None) -> DataFrame:
    """Whether a scene may be judged. Unknown fractions leave only the registration error to decide."""
    q = q or QualityThresholds()
    registered = F.col("registration_px").isNull() | (F.col("registration_px") <= q.registration_error_px_max)
    clear = (F.col("cloud_fraction") <= q.cloud_fraction_max) & (F.col("valid_fraction") >= q.min_valid_pixel_fraction)
    return scenes.withColumn("valid_observation", registered & F.when(F.col("assessed"), clear).otherwise(F.lit(True)))


def _over(c: str) -> Column:
    return F.when(F.col("valid") & ix.finite(F.col(c)), F.col(c))


def _or_zero(c: Column) -> Column:
    return F.coalesce(c, F.lit(0.0))


def mean_features() -> dict[str, Column]:
    """Means and changed area over valid cells: aggregates that add up across tasks, for groups of any size."""
    n = F.count_if("valid")
    agg = {f"{i}_delta_mean": _or_zero(F.avg(_over(f"d_{i}"))) for i in ("ndvi", "ndbi", "ndwi")}
    agg |= {f"{i}_delta_abs_mean": _or_zero(F.avg(F.abs(_over(f"d_{i}")))) for i in ("ndvi", "ndbi", "ndwi")}
    return agg | {
        "cva_magnitude_mean": _or_zero(F.avg(F.when(F.col("valid"), F.col("cva")))),
        "changed_area_percent": F.when(n > 0, 100.0 * F.count_if("changed") / n).otherwise(F.lit(0.0)),
        "n_valid": n,
    }


def tile_features(pixels: DataFrame, keys: list[str], more: dict[str, Column] | None = None) -> DataFrame:
    """Means, signed percentiles, tails and changed area of each tile in one aggregation, with ``more`` aggregates of the caller's."""
    agg = mean_features() | {
        "ndvi_delta_p10": _or_zero(F.percentile(_over("d_ndvi"), 0.1)),
        "ndbi_delta_p90": _or_zero(F.percentile(_over("d_ndbi"), 0.9)),
        "magnitude_p95": _or_zero(F.percentile(_over("magnitude"), 0.95)),
        "magnitude_p99": _or_zero(F.percentile(_over("magnitude"), 0.99)),
    } | (more or {})
    got = pixels.groupBy(*keys).agg(*(v.alias(k) for k, v in agg.items()))
    return got.withColumn("urbanization_score", F.col("ndbi_delta_mean") - F.col("ndvi_delta_mean"))


def features_by_sigma(
    pixels: DataFrame, keys: list[str], sigmas: list[float], g: GateThresholds | None = None, more: dict[str, Column] | None = None
) -> DataFrame:
    """The tile features once for each background sigma, with its place in the list (outer) and changed_px, from one aggregation.

    ``pixels`` has median and mad of its scene (``scene_spread``). A sigma only
    moves the cut, so it only moves what is counted as changed.
    """
    g = g or GateThresholds()
    hits = [F.coalesce((F.col("magnitude") > cut_at(s, g)) | (F.col("cva") > g.cva_magnitude_threshold), F.lit(False)) & F.col("valid") for s in sigmas]
    counts = {f"_changed{k}": F.count_if(h) for k, h in enumerate(hits)}
    got = tile_features(pixels.withColumn("changed", F.lit(False)), keys, (more or {}) | counts)

    def of(k: int) -> Column:
        area = F.when(F.col("n_valid") > 0, 100.0 * F.col(f"_changed{k}") / F.col("n_valid")).otherwise(F.lit(0.0))
        return F.struct(F.lit(k).alias("outer"), area.alias("changed_area_percent"), F.col(f"_changed{k}").alias("changed_px"))

    kept = [c for c in got.columns if c not in counts and c != "changed_area_percent"]
    return got.select(*kept, F.inline(F.array(*(of(k) for k in range(len(sigmas))))))


def joint_stretch(pixels: DataFrame, bands: tuple[str, ...] = ("red", "green", "blue")) -> DataFrame:
    """scene, low and high: the 2nd and 98th percentile of both dates' finite display bands together; ``pixels`` is read several times."""
    shown = F.array(*(F.col(f"{b}{t}") for b in bands for t in (1, 2)))
    spread = pixels.select("scene", F.explode(shown).alias("v")).where(ix.finite(F.col("v")))
    got = quantiles.quantiles(spread, ["scene"], "v", [0.02, 0.98])
    return got.select("scene", F.col("q")[0].alias("low"), F.col("q")[1].alias("high"))


def resampled(pixels: DataFrame, column: str, height: int, width: int) -> DataFrame:
    """scene, y, x and ``column`` on another grid over the scene's frame, bilinear with pixel centres at halves; cells without a value count as 0.

    Each new cell asks for its four neighbours and their weighted values are
    added up, so a scene is spread over all tasks.
    """
    frame = pixels.groupBy("scene").agg(F.min("y").alias("y0"), F.max("y").alias("y1"), F.min("x").alias("x0"), F.max("x").alias("x1"))
    grid = frame.select("*", F.explode(F.sequence(F.lit(0), F.lit(height - 1))).alias("i")).select("*", F.explode(F.sequence(F.lit(0), F.lit(width - 1))).alias("j"))

    def axis(at: str, size: Column, cells: int) -> Column:
        """The two neighbours along an axis, counted from the frame, with their weights."""
        place = ix.clip((F.col(at) + 0.5) * size / cells - 0.5, 0.0, size - 1)
        low = F.least(F.floor(place), F.greatest(F.lit(0), size - 2)).cast("int")
        both = ((low, 1.0 - (place - low)), (F.least(low + 1, size - 1).cast("int"), place - low))
        return F.array(*(F.struct(k.alias("at"), w.alias("weight")) for k, w in both))

    rows = grid.withColumns({"ys": axis("i", F.col("y1") - F.col("y0") + 1, height), "xs": axis("j", F.col("x1") - F.col("x0") + 1, width)})
    asked = rows.select("scene", "y0", "x0", "i", "j", F.explode("ys").alias("ya"), "xs").select("*", F.explode("xs").alias("xa"))
    asked = asked.select("scene", "i", "j", (F.col("ya.at") + F.col("y0")).alias("y"), (F.col("xa.at") + F.col("x0")).alias("x"), (F.col("ya.weight") * F.col("xa.weight")).alias("weight"))
    known = F.when(ix.finite(F.col(column)), F.col(column)).otherwise(0.0)
    met = asked.join(pixels.select("scene", "y", "x", known.alias("_v")), ["scene", "y", "x"], "left")
    total = met.groupBy("scene", "i", "j").agg(F.sum(F.col("weight") * F.coalesce("_v", F.lit(0.0))).alias(column))
    return total.select("scene", F.col("i").alias("y"), F.col("j").alias("x"), column)


def robust_fit(pixels: DataFrame, min_pixels: int = 256, at_most: int | None = None) -> DataFrame:
    """band, gain and offset that map ``after`` onto ``before`` through the quartiles; (1, 0) where it can't be told.

    ``pixels`` has scene, band, before and after; gains are kept in [0.5, 2].
    It is read several times: give a written table. ``at_most`` is a bound of
    its rows that is known.
    """
    sides = F.array(F.struct(F.lit("y").alias("side"), F.col("before").alias("v")), F.struct(F.lit("x").alias("side"), F.col("after").alias("v")))
    both = quantiles.quantiles(pixels.select("scene", "band", F.inline(sides)), ["scene", "band", "side"], "v", [0.25, 0.5, 0.75], at_most=at_most and 2 * at_most)
    got = both.groupBy("scene", "band").agg(F.max("n").alias("n"), *(F.max(F.when(F.col("side") == s, F.col("q"))).alias(s) for s in ("x", "y")))
    spread = F.col("x")[2] - F.col("x")[0]
    told = (F.col("n") >= min_pixels) & (F.abs(spread) >= 1e-6)
    gain = F.when(told, ix.clip((F.col("y")[2] - F.col("y")[0]) / spread, 0.5, 2.0)).otherwise(F.lit(1.0))
    got = got.withColumn("gain", gain)
    offset = F.when(told, F.col("y")[1] - F.col("gain") * F.col("x")[1]).otherwise(F.lit(0.0))
    return got.select("scene", "band", "n", "gain", offset.alias("offset"))


def normalise_to_reference(
    pixels: DataFrame, bands: tuple[str, ...], iterations: int = 3, percentile: float = 0.6, min_pixels: int = 256
) -> DataFrame:
    """scene, band, gain, offset after refitting on the cells that changed least.

    Each round ranks the valid cells by spectral distance under the present
    fit and refits from the original second date, so gains don't compound. The
    valid cells are written once; a round reads them and writes what its fit
    needs, and a scene is never gathered.
    """
    valid = pixels.where(F.col("valid") & ix.all_finite(*(F.col(f"{b}{t}") for b in bands for t in (1, 2))))
    valid = written(valid.select("scene", *(f"{b}{t}" for b in bands for t in (1, 2))), "normalise-valid")
    n = valid.count()
    held = None
    for _ in range(iterations):
        after = {b: F.col(f"{b}2") for b in bands}
        rows = valid
        if held is not None:
            wide = held.groupBy("scene").agg(*(F.max(F.when(F.col("band") == b, F.struct("gain", "offset"))).alias(f"_{b}") for b in bands))
            rows = valid.join(written(wide, "normalise-fit"), "scene")
            after = {b: F.col(f"{b}2") * F.col(f"_{b}.gain") + F.col(f"_{b}.offset") for b in bands}
        rows = rows.withColumn("_d", ix.cva([(F.col(f"{b}1"), after[b]) for b in bands]))
        rows = written(rows.select(*valid.columns, "_d"), "normalise-distance")
        cut = quantiles.quantiles(rows, ["scene"], "_d", [percentile], at_most=n).select("scene", F.col("q")[0].alias("_cut"))
        steady = rows.join(cut, "scene").where("_d <= _cut")
        pairs = F.array(*(F.struct(F.lit(b).alias("band"), F.col(f"{b}1").alias("before"), F.col(f"{b}2").alias("after")) for b in bands))
        held = robust_fit(written(steady.select("scene", F.inline(pairs)), "normalise-steady"), min_pixels, len(bands) * n)
    return held
