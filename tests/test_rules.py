import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from terrashift import config
from terrashift.config import GateThresholds, Settings, classify_overrides
from terrashift.functions import indices as ix
from terrashift.functions import scalars, stats
from terrashift.operators import cost, embedding, evaluation, gate, ingest, joins, ledger, metrics, reports, risk, scene, selection, triage
from terrashift.sources import files, storage
from terrashift.sources.pixels import pair_dates, scene_arrays
from terrashift.sources.storage import written

FEATURE = {
    "tile_id": "t",
    "ssim": 0.9,
    "phash_distance": 0,
    "ndvi_delta_abs_mean": 0.0,
    "ndbi_delta_abs_mean": 0.0,
    "ndwi_delta_abs_mean": 0.0,
    "cva_magnitude_mean": 0.0,
    "changed_area_percent": 0.0,
    "urbanization_score": 0.0,
    "magnitude_p95": 0.0,
    "largest_component_px": 0,
    "valid_observation": True,
}


def rows(spark, values, schema=None):
    return spark.createDataFrame(values, schema)


def decide(spark, **changes):
    return gate.decide(rows(spark, [FEATURE | changes])).first()


@pytest.mark.parametrize(
    "changes, reason",
    [
        ({"valid_observation": False, "ndvi_delta_abs_mean": 0.9}, "failed Tier 0 quality checks"),
        ({"ndvi_delta_abs_mean": 0.25}, "strong landcover index change"),
        ({"ndbi_delta_abs_mean": 0.02, "changed_area_percent": 2.0}, "moderate landcover change over a large area"),
        ({"urbanization_score": 0.05, "changed_area_percent": 2.0}, "built-up gain with vegetation loss"),
        ({"magnitude_p95": 0.2, "largest_component_px": 64}, "concentrated high-magnitude change region"),
        ({"changed_area_percent": 2.0, "ssim": 0.6, "cva_magnitude_mean": 0.28}, "structural break with multi-band change vector"),
        ({"ndwi_delta_abs_mean": 0.15, "changed_area_percent": 2.0}, "water extent change over a large area"),
        ({}, "insufficient change evidence"),
    ],
)
def test_ladder_order_and_reasons(spark, changes, reason):
    got = decide(spark, **changes)
    assert got.gate_reason == reason
    assert got.gate == {"failed Tier 0 quality checks": "low_quality", "insufficient change evidence": "no_change"}.get(reason, "candidate_change")


@pytest.mark.parametrize("term", ["ndvi_delta_abs_mean", "changed_area_percent", "cva_magnitude_mean", "urbanization_score", "magnitude_p95"])
def test_confidence_never_falls_with_evidence(spark, term):
    values = [FEATURE | {term: x / 20} for x in range(0, 60)]
    got = [r.gate_confidence for r in gate.decide(rows(spark, values)).orderBy(term).collect()]
    assert got == sorted(got) and 0 <= got[0] and got[-1] <= 1


def test_refused_tile_has_no_confidence(spark):
    assert decide(spark, valid_observation=False, ndvi_delta_abs_mean=0.9).gate_confidence == 0


def test_nan_and_null_are_not_observed(spark):
    df = rows(spark, [(0.5, 0.1), (float("nan"), 0.1), (None, 0.1), (0.01, 0.005), (float("inf"), 0.1)], "a double, b double")
    got = [r.v for r in df.select(ix.normalised_difference(F.col("a"), F.col("b")).alias("v")).collect()]
    assert got == [pytest.approx(2 / 3), 0.0, 0.0, 0.0, 0.0]


@pytest.mark.parametrize("scores, k, want", [([0.5] * 10, 3, None), ([0.9, 0.8, 0.5, 0.5], 4, 0.5), ([0.9, 0.8, 0.5, 0.5], 2, 0.8), ([0.9, 0.9, 0.1], 1, None)])
def test_budget_ties(spark, scores, k, want):
    df = rows(spark, [(s,) for s in scores], "score double")
    got = selection.thresholds_for_calls(df, rows(spark, [(k,)], "k bigint"), "score").first()
    assert got.threshold == want and got.flagged <= k


def test_zero_budget_flags_nothing(spark):
    df = rows(spark, [(0.9, 1), (0.1, 0)], "score double, label int")
    got = selection.operating_points(df, [0.0], 1.0, "score", "label").first()
    assert got.threshold is None and got.flagged == 0 and got.recall == 0.0 and got.precision is None


def walked(cities, budget):
    """Shares by the sequential walk: one call moves at a time."""
    total, size = sum(n for _, n in cities), dict(cities)
    if budget >= total:
        return size
    if budget <= 0:
        return dict.fromkeys(size, 0)
    if budget < len(cities):
        largest = sorted(cities, key=lambda x: (-x[1], x[0]))[:budget]
        return {c: int((c, n) in largest) for c, n in cities}
    fair = {c: budget * n / total for c, n in cities}
    calls = {c: min(n, max(1, int(fair[c]))) for c, n in cities}
    while left := budget - sum(calls.values()):
        step = 1 if left > 0 else -1
        free = [c for c in calls if (calls[c] < size[c] if step > 0 else calls[c] > 1)]
        calls[(max if step > 0 else min)(free, key=lambda c: (fair[c] - calls[c], c))] += step
    return calls


@pytest.mark.parametrize("cities", [[("a", 100), ("b", 3), ("c", 2), ("d", 1)], [(f"c{k:02d}", 1 + k % 2) for k in range(30)] + [("big", 400), ("other", 300)], [(f"c{k}", 7) for k in range(9)], [("one", 5)]])
def test_budget_always_wins(spark, cities):
    df = rows(spark, [(c, f"{c}-{i}") for c, n in cities for i in range(n)], "city string, tile_id string")
    total = sum(n for _, n in cities)
    for budget in sorted({0, 1, 2, len(cities) - 1, len(cities), len(cities) + 1, total // 3, total // 2, total - 1, total, total + 9}):
        calls = {r.city: r.calls for r in selection.allocation(df, budget).collect()}
        assert calls == walked(cities, budget), budget
        assert sum(calls.values()) == min(budget, total)


def test_a_city_is_cut_before_it_is_gathered(spark):
    df = rows(spark, [("a", f"a{i}") for i in range(50)], "city string, tile_id string")
    plan = selection.stratified(df, 7)._jdf.queryExecution().executedPlan().toString()
    assert "WindowGroupLimit" in plan


def test_selection_strategies(spark):
    df = rows(spark, [(c, f"{c}{i:02d}") for c, n in (("a", 30), ("b", 5)) for i in range(n)], "city string, tile_id string")
    assert [r.tile_id for r in selection.select_candidates(df, 3, "sequential").collect()] == ["a00", "a01", "a02"]
    drawn = selection.select_candidates(df, 7).collect()
    assert len(drawn) == 7 and {r.city for r in drawn} == {"a", "b"}
    assert drawn == selection.select_candidates(df, 7).collect()
    with pytest.raises(ValueError):
        selection.select_candidates(df, 7, "other")


def test_confusion_and_null_rules(spark):
    df = rows(spark, [(1, 1), (0, 1), (1, 0), (0, 0)], "y int, p int")
    got = metrics.derived(metrics.counts(df, F.col("y"), F.col("p"))).first()
    assert (got.tp, got.fp, got.fn, got.tn) == (1, 1, 1, 1) and got.f1 == 0.5
    only = metrics.derived(metrics.counts(df.where("y = 1"), F.col("y"), F.col("p"))).first()
    assert only.precision is None and only.f1 is None and only.balanced_accuracy is None and only.recall == 0.5


def test_wilson(spark):
    low, high = stats.wilson(F.col("k"), F.col("n"))
    got = rows(spark, [(0, 0), (7, 11)], "k int, n int").select(low.alias("l"), high.alias("h")).collect()
    assert (got[0].l, got[0].h) == (0.0, 1.0)
    assert got[1].h - got[1].l > 0.3


def test_conformal_boundaries(spark):
    few = rows(spark, [(0.9, 1), (0.1, 0), (0.8, 1), (0.2, 0)], "score double, label int")
    got = risk.calibrate(few, "label", "score", 0.01, 0.01).first()
    assert got["lambda"] is None and not got.controlled
    rng = np.random.default_rng(1)
    y = rng.integers(0, 2, 3000)
    s = np.clip(np.where(y == 1, rng.normal(0.68, 0.16, 3000), rng.normal(0.32, 0.16, 3000)), 0, 1)
    df = rows(spark, [(float(a), int(b)) for a, b in zip(s, y)], "score double, label int")
    got = risk.calibrate(df, "label", "score", 0.2, 0.1).first()
    grid = [i / 200 for i in range(201)]
    pos = s[y == 1]
    ok = [g for g in grid if min(1, (pos < g).mean() + math.sqrt(math.log(10) / (2 * len(pos)))) <= 0.2]
    assert got["lambda"] == max(ok) and got.controlled
    missed = {r.step: r.missed for r in risk.misses(df, "label", "score").collect()}
    assert all(missed[i] == int((pos < g).sum()) for i, g in enumerate(grid))


def test_disjointness(spark):
    a, b = rows(spark, [("x",), ("y",)], "city string"), rows(spark, [("z",)], "city string")
    risk.assert_disjoint({"a": a, "b": b}, "city")
    with pytest.raises(ValueError):
        risk.assert_disjoint({"a": a, "b": b, "c": rows(spark, [("y",)], "city string")}, "city")
    cal, fit = risk.split_groups([f"c{i}" for i in range(10)])
    assert len(cal) == 3 and not set(cal) & set(fit)
    with pytest.raises(ValueError):
        risk.split_groups(["one"])


def test_sweep_takes_the_first_of_equals(spark):
    df = rows(spark, [FEATURE | {"label": 1, "ndvi_delta_abs_mean": 0.5}, FEATURE | {"label": 0}])
    best = risk.sweep(df, risk.product_grid({"ndvi_strong_min": [0.3, 0.2, 0.6]})).first()
    assert best.combo == 0 and best.score == 1.0


def test_sweep_equals_the_ladder_under_every_combination(spark):
    values = [FEATURE | {"ndvi_delta_abs_mean": k / 40, "changed_area_percent": k % 7 * 1.0, "urbanization_score": k % 5 / 20, "label": k % 3 % 2, "valid_observation": k % 11 > 0} for k in range(60)]
    df = rows(spark, values)
    grid = risk.product_grid({"ndvi_strong_min": [0.3, 1.1], "min_changed_area_percent": [1.0, 5.0], "ndbi_strong_min": [0.9], "urbanization_score_min": [0.05, 0.2]})
    got = {r.combo: (r.tp, r.fp, r.fn, r.tn) for r in risk.sweep(df, grid).collect()}
    assert len(got) == len(grid) == 8
    for k, changed in enumerate(grid):
        judged = gate.decide(df, GateThresholds(**changed)).where("valid_observation")
        c = metrics.counts(judged, F.col("label"), F.col("gate") == "candidate_change").first()
        assert got[k] == (c.tp, c.fp, c.fn, c.tn)


def test_sweep_refuses_what_changes_the_mask(spark):
    with pytest.raises(ValueError, match="background_sigma"):
        risk.sweep(rows(spark, [FEATURE | {"label": 1}]), [{"background_sigma": 3.0}])


def test_default_sweep_has_its_full_size():
    assert len(risk.product_grid(risk.SWEEP_AXES)) == 8640


def scenes():
    """Two 64 x 64 scenes: one with vegetation turned into buildings, one unchanged."""
    rng = np.random.default_rng(20260810)
    surface = {"vegetation": (0.030, 0.060, 0.035, 0.320, 0.150), "built": (0.120, 0.130, 0.150, 0.180, 0.240)}
    out = {}
    for name in ("changed", "stable"):
        out[name] = {}
        for t in (1, 2):
            kind = np.zeros((64, 64), int)
            if name == "changed" and t == 2:
                kind[16:48, 16:48] = 1
            base = np.array([surface["vegetation"], surface["built"]])[kind]
            noisy = np.clip(base + rng.normal(0, 0.004, base.shape), 0, 1.5)
            out[name][t] = dict(zip(("blue", "green", "red", "nir", "swir"), np.moveaxis(noisy, 2, 0)))
    return out


def test_scenes_end_to_end(spark):
    pixels = scene.with_magnitude(scene.deltas(scene.combined(scene.masks(pair_dates(scene_arrays(spark, scenes()))))))
    changed = scene.raw_change(pixels, scene.scene_cut(pixels))
    features = scene.tile_features(changed, ["scene"]).withColumns(
        {"ssim": F.lit(0.9), "phash_distance": F.lit(0), "largest_component_px": F.lit(0), "valid_observation": F.lit(True)}
    )
    got = {r.scene: r.gate for r in gate.decide(features).collect()}
    assert got == {"changed": "candidate_change", "stable": "no_change"}


def test_cut_is_robust_and_floored(spark):
    def cut(values):
        df = rows(spark, [("s", True, float(v)) for v in values], "scene string, valid boolean, magnitude double")
        return scene.scene_cut(df).first().cut

    assert cut([0.5] * 300 + [0.0] * 700) < 0.5
    assert cut(np.abs(np.random.default_rng(0).normal(0, 0.002, 500))) == GateThresholds().min_absolute_delta


def test_pool_falls_back_to_all_cells(spark):
    df = rows(spark, [("s", False, 0.2), ("s", False, 0.2)], "scene string, valid boolean, magnitude double")
    assert scene.scene_cut(df).first().cut == pytest.approx(0.2)


def test_unassessed_scene_has_no_fractions(spark):
    cells = [("s", y, 0, *[None] * 10) for y in range(4)]
    names = "scene string, y int, x int, " + ", ".join(f"{b}{t} double" for t in (1, 2) for b in ("blue", "green", "red", "nir", "swir"))
    got = scene.fractions(scene.combined(scene.masks(rows(spark, cells, names)))).first()
    assert got.assessed is False and got.cloud_fraction is None


def test_normalisation_recovers_gain_and_offset(spark):
    rng = np.random.default_rng(2)
    before = rng.uniform(0.1, 0.6, (2, 900))
    after = (before - 0.05) / 1.25
    cells = [("s", i, 0, True, *map(float, (before[0, i], after[0, i], before[1, i], after[1, i]))) for i in range(900)]
    df = rows(spark, cells, "scene string, y int, x int, valid boolean, red1 double, red2 double, nir1 double, nir2 double")
    for r in scene.normalise_to_reference(df, ("red", "nir")).collect():
        assert r.gain == pytest.approx(1.25, abs=0.02) and r.offset == pytest.approx(0.05, abs=0.01)


def test_ledger_rules(spark):
    df = rows(spark, [("a", 1, True, 0.1), ("a", 2, False, 0.2), ("b", 1, True, None)], "tile_id string, seq int, vlm_called boolean, cost_usd double")
    assert {(r.tile_id, r.seq) for r in ledger.last_wins(df, "tile_id", ["seq"]).collect()} == {("a", 2), ("b", 1)}
    with pytest.raises(RuntimeError):
        ledger.refuse_to_discard(df)
    ledger.refuse_to_discard(df, overwrite=True)
    assert ledger.remaining_budget(10, 12) == 0 and ledger.remaining_budget(None, 3) is None


def test_spend_ledger():
    book = ledger.SpendLedger(1.0)
    q = book.quote("f", 600_000, now=0)
    with pytest.raises(PermissionError):
        book.reserve(q, "other", now=1)
    r = book.reserve(q, "f", now=1)
    with pytest.raises(PermissionError):
        book.reserve(q, "f", now=2)
    with pytest.raises(PermissionError):
        book.reserve(book.quote("g", 400_001, 2), "g", now=2)
    with pytest.raises(PermissionError):
        book.reserve(book.quote("h", 1, 2), "h", now=400)
    book.uncertain(r, 3)
    assert book.used() == 600_000
    book.settle(r, 100_000, 4)
    assert book.used() == 100_000
    with pytest.raises(ValueError):
        book.release(r, 5)


def test_unknown_model_is_free_and_says_so(spark):
    usage = rows(spark, [("no-such", 10, 10, 0, 0, False), ("claude-opus-5", 1_000_000, 0, 0, 0, True)], "model string, input_tokens bigint, output_tokens bigint, cache_read_input_tokens bigint, cache_creation_input_tokens bigint, batch boolean")
    got = {r.model: r for r in cost.priced(usage, cost.rates(spark)).collect()}
    assert got["no-such"].cost_usd == 0 and not got["no-such"].priced
    assert got["claude-opus-5"].cost_usd == 2.5 and got["claude-opus-5"].cost_usd_synchronous == 5.0


def test_scalars(spark):
    df = rows(spark, [("B04=1,B03=2",), (None,)], "t string")
    assert [r.m for r in df.select(scalars.band_map(F.col("t")).alias("m")).collect()] == [{"B04": 1, "B03": 2}, None]
    with pytest.raises(Exception, match="bad band map"):
        rows(spark, [("B04=x",)], "t string").select(scalars.band_map(F.col("t"))).collect()


def test_files(spark, tmp_path):
    listing = [(f"/d/{s}/imgs_{t}{r}/{b}.tif",) for s in ("one", "_skip", "part") for t in (1, 2) for r in ("", "_rect") for b in ("B02", "B03")]
    listing = [p for p in listing if not ("part" in p[0] and "imgs_2" in p[0])]
    got = files.scene_manifest(rows(spark, listing, "path string"), rows(spark, [("one", "train"), ("part", "test")], "city string, split string"), ("B02", "B03")).collect()
    assert [(r.pair_id, r.split, r.img1, r.img2) for r in got] == [("one", "train", "imgs_1_rect", "imgs_2_rect")]
    dates = files.scene_dates(rows(spark, [("one", "date_1: 20200115"), ("one", "date_2: nonsense")], "pair_id string, value string")).first()
    assert str(dates.date_t1) == "2020-01-15" and dates.date_t2 is None
    (tmp_path / "l.jsonl").write_text('{"tile_id": "a", "vlm_called": true}\n\nbroken\n{"tile_id": "b", "vlm_called": false}\n')
    assert files.ledger(spark, str(tmp_path / "l.jsonl")).count() == 2
    (tmp_path / "t.json").write_text('{"tiles": [{"tile_id": "x_r0c0", "city": "x", "row": 0, "label": 1}]}')
    assert files.tile_index(spark, str(tmp_path / "t.json")).first().tile_id == "x_r0c0"
    labels = rows(spark, [(255, "gt127"), (2, "eq2"), (0, "eq1")], "v int, e string")
    assert [r.c for r in labels.select(files.label_changed(F.col("v"), F.col("e")).alias("c")).collect()] == [True, True, False]
    with pytest.raises(Exception, match="illegal label"):
        rows(spark, [(7, "eq2")], "v int, e string").select(files.label_changed(F.col("v"), F.col("e"))).collect()


def test_overrides_and_settings():
    usable, stale = classify_overrides({"ndvi_strong_min": 0.3, "background_sigma": 3.0})
    assert usable == {"ndvi_strong_min": 0.3} and stale == {"background_sigma": 3.0}
    with pytest.raises(ValueError):
        classify_overrides({"nonsense": 1})
    with pytest.raises(TypeError):
        Settings.from_dict({"gate": {"nonsense": 1}})
    assert Settings().sha() != Settings.from_dict({"gate": {"ndvi_strong_min": 0.3}}).sha()


def test_vectors_and_boxes(spark):
    v = rows(spark, [(1, [1.0, 0.0]), (1, [1.0, 2.0]), (2, [float("nan"), 1.0]), (2, [0.0, 1.0])], "k int, embedding array<float>")
    got = {r.k: r.centroid for r in embedding.centroids(v, "k").collect()}
    assert got == {1: [1.0, 1.0], 2: [0.0, 1.0]}
    geo = rows(spark, [('{"type": "Polygon", "coordinates": [[[1, 2], [5, 2], [5, 7], [1, 7]]]}',)], "geometry string")
    box = joins.polygon_box(geo).first()
    assert (box.west, box.south, box.east, box.north) == (1, 2, 5, 7)
    with pytest.raises(ValueError):
        joins.require_same(rows(spark, [("a",)], "b string"), rows(spark, [("c",)], "b string"), ["b"], "bands")
    pixels = ingest.rescaled(rows(spark, [(5, ), (0, )], "red int"), ["red"], 10.0, 0.0, nodata=0)
    assert [r.red for r in pixels.collect()] == [0.5, None]


def test_refused_tiles_are_no_negatives_and_the_report_is_published(spark, tmp_path):
    values = [FEATURE | {"city": c, "label": y, "ndvi_delta_abs_mean": v, "valid_observation": ok} for c, y, v, ok in [("a", 1, 0.9, True), ("a", 0, 0.0, True), ("b", 1, 0.9, False), ("a", 1, 0.0, True)]]
    judged, report = evaluation.evaluate(rows(spark, values))
    got = report.first()
    assert (got.n_tiles, got.n_low_quality, got.tp, got.fp, got.fn, got.tn) == (4, 1, 1, 0, 1, 1)
    assert got.groups == ["a", "b"] and got.groups_scored == ["a"] and got.tier0_refused_pct == 25.0
    evaluation.publish(judged, report, str(tmp_path), "test")
    at = storage.current(spark, str(tmp_path))
    text = [r.value for r in spark.read.text(f"{at}/report").collect()]
    assert text[0] == "# Gate evaluation: test" and any(line.startswith("| recall | 0.5 | [") for line in text)
    assert spark.read.json(f"{at}/summary").first().n_tiles == 4 and spark.read.csv(f"{at}/features", header=True).count() == 4


def test_report_of_no_tiles(spark):
    got = evaluation.summary(gate.decide(rows(spark, [FEATURE | {"city": "a", "label": 1}]).where("false"))).first()
    assert got.n_tiles == 0 and got.total_reduction_pct == 0.0 and got.groups == []


def test_running_sums_equal_a_plain_loop(spark):
    values = [((k * 37 % 1000) / 7.0, k % 3, k % 5) for k in range(1000)]
    got = metrics.running_down(rows(spark, values, "score double, p long, n long"), {"tp": "p", "fp": "n"}).collect()
    tp = fp = 0
    for r in sorted(got, key=lambda r: -r.score):
        tp, fp = tp + r.p, fp + r.n
        assert (r.tp, r.fp) == (tp, fp)
    assert len(got) == 1000


def textured():
    """The scenes with a texture that both dates share, so that their registration can be measured."""
    held = scenes()
    texture = np.random.default_rng(4).normal(0, 0.02, (64, 64))
    return {name: {t: {b: np.clip(v * (1 + 4 * texture), 0, 1.5) for b, v in bands.items()} for t, bands in dates.items()} for name, dates in held.items()}


def test_whole_scenes_in_one_call(spark, tmp_path):
    pixels = written(pair_dates(scene_arrays(spark, textured())), "scenes")
    results = triage.run(pixels, block=16)
    got = {r.scene: r for r in results.collect()}
    assert {k: r.gate for k, r in got.items()} == {"changed": "candidate_change", "stable": "no_change"}
    changed = got["changed"]
    assert 900 <= changed.largest_component_px <= 1024 and changed.n_components == 1 and changed.changed_area_percent == pytest.approx(100 * changed.largest_component_px / 4096)
    assert changed.registration_px < 1.5 and changed.valid_observation and got["stable"].largest_component_px == 0
    cells = triage.changed_cells(pixels, block=16)
    for r in cells.where("scene = 'changed'").groupBy("scene").agg(F.percentile("magnitude", 0.99).alias("p99"), F.percentile("d_ndvi", 0.1).alias("p10")).collect():
        assert changed.magnitude_p99 == pytest.approx(r.p99) and changed.ndvi_delta_p10 == pytest.approx(r.p10)
    folder = triage.publish(results, str(tmp_path / "run"))
    assert spark.read.json(f"{folder}/result").count() == 2 and storage.marker(spark, str(tmp_path / "run"))["config_sha"] == changed.config_sha


def test_normalisation_is_undone_by_its_fit(spark):
    """A stable scene in another light: matched again, it has no change, and the A/B report says what that did."""
    held = textured()
    for b in held["stable"][2]:
        held["stable"][2][b] = held["stable"][2][b] * 1.4 + 0.02
    pixels = written(pair_dates(scene_arrays(spark, held)), "scenes")
    matched = triage.normalised(pixels).where("scene = 'stable'")
    assert matched.agg(F.max(F.abs(F.col("nir1") - F.col("nir2")))).first()[0] < 0.05
    labels = rows(spark, [("changed", 1), ("stable", 0)], "scene string, label int")
    given = rows(spark, [("changed", 0.9, 0, 0.1), ("stable", 0.9, 0, 0.1)], "scene string, ssim double, phash_distance int, registration_px double")
    sides = {r.side: r for r in triage.ab_normalisation(pixels, labels, evidence=lambda _: given, block=32).collect()}
    assert set(sides) == {"off", "on", "delta"} and (sides["on"].tp, sides["on"].fp) == (1, 0)
    assert sides["delta"].fp == sides["on"].fp - sides["off"].fp


def test_ranking_equals_a_plain_loop(spark):
    values = [((k * 7919 % 50) / 50.0, int((k * 31 % 17) < 6)) for k in range(400)]
    got = evaluation.ranking(rows(spark, values, "score double, label int"), 0.4).first()
    pos, neg = [s for s, y in values if y], [s for s, y in values if not y]
    auc = sum((p > n) + (p == n) / 2 for p in pos for n in neg) / len(pos) / len(neg)
    ap, best = 0.0, 0.0
    for cut in sorted({s for s, _ in values}, reverse=True):
        tp, fp = sum(s >= cut for s in pos), sum(s >= cut for s in neg)
        ap += sum(s == cut for s in pos) / len(pos) * tp / (tp + fp)
        best = max(best, tp / (tp + fp)) if tp >= 0.4 * len(pos) else best
    assert (got.roc_auc, got.average_precision, got.precision_at_recall) == (round(auc, 6), round(ap, 6), round(best, 6))
    assert (got.positives, got.negatives) == (len(pos), len(neg))


def test_reports_and_tuned_thresholds(spark, tmp_path):
    points = rows(spark, [(1.0, 3, None, ["a", "b"]), (2.0, 5, 0.5, [])], "budget double, calls int, recall double, cities array<string>")
    folder = reports.publish(str(tmp_path / "points"), {"points": points}, "Operating points")
    lines = [r.value for r in spark.read.text(f"{folder}/points-report").collect()]
    assert lines == ["# Operating points: points", "", "| budget | calls | recall | cities |", "|---|---|---|---|", "| 1.0 | 3 | not assessed | a, b |", "| 2.0 | 5 | 0.5 |  |"]
    assert spark.read.json(f"{folder}/points").count() == 2
    best = rows(spark, [("best", 3.0, 0.25, 9), ("baseline", 2.0, 0.2, 7)], "which string, background_sigma double, ndvi_strong_min double, tp int")
    folder = reports.publish_tuning(best, str(tmp_path / "tuned"), ["ndvi_strong_min", "background_sigma"], "train")
    text = "\n".join(r.value for r in spark.read.text(f"{folder}/thresholds").collect())
    assert text == "# In-sample fit on split train\ngate:\n  background_sigma: 3.0\n  ndvi_strong_min: 0.25"
    read = config.from_yaml(text)
    assert (read.gate.background_sigma, read.gate.ndvi_strong_min) == (3.0, 0.25) and read.masks == config.Settings().masks
    for bad in ("gate:\n  unknown: 1", "other:\n  a: 1", "  a: 1", "gate: 3", "gate:\n  background_sigma"):
        with pytest.raises((ValueError, TypeError)):
            config.from_yaml(bad)


def test_groups_are_split_by_a_seeded_hash(spark):
    df = rows(spark, [(f"g{k % 10}", k) for k in range(100)], "city string, k int")
    got = {r.city: r.side for r in risk.split_rows(df, "city").collect()}
    assert len(got) == 10 and sum(v == "calibration" for v in got.values()) == 3
    assert got == {r.city: r.side for r in risk.split_rows(df.repartition(7), "city").collect()}
    assert got != {r.city: r.side for r in risk.split_rows(df, "city", seed=2).collect()}
    assert {r.side for r in risk.split_rows(df.where("k < 2"), "city", share=0.0).collect()} == {"calibration", "fit"}
    with pytest.raises(ValueError):
        risk.split_rows(df.where("k < 1"), "city")
