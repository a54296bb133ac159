"""Exact distributed quantiles, scene-wide regions and atomic publishing."""

import json
import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from terrashift.operators import kernels, quantiles, regions
from terrashift.sources import storage

# --- quantiles


def numbers(kind, n, rng):
    return {
        "uniform": lambda: rng.random(n),
        "signed": lambda: rng.normal(size=n) * 10.0 ** rng.integers(-12, 12, n),
        "ties": lambda: rng.choice([0.0, -0.0, 0.25, 1.0], n),
        "one": lambda: np.full(n, 0.125),
        "close": lambda: 0.3 + rng.random(n) * 1e-9,
        "huge": lambda: rng.choice([-1e300, 1e300, 5e-324, -5e-324, 1.0], n),
    }[kind]()


@pytest.mark.parametrize("most", [1 << 20, 7])
def test_quantiles_are_exact(spark, most):
    rng = np.random.default_rng(5)
    groups = {f"{kind}-{n}": numbers(kind, n, rng) for kind in ("uniform", "signed", "ties", "one", "close", "huge") for n in (1, 2, 5, 300)}
    rows = [(g, float(v)) for g, vs in groups.items() for v in vs] + [("uniform-5", None), ("uniform-5", float("nan")), ("empty", None)]
    probs = [0.0, 0.02, 0.25, 0.5, 0.6, 0.98, 1.0]
    got = quantiles.quantiles(spark.createDataFrame(rows, "g string, v double").repartition(5), ["g"], "v", probs, most=most).collect()
    assert {r.g for r in got} == set(groups)
    for r in got:
        want = np.percentile(groups[r.g], [100 * p for p in probs])
        assert r.n == len(groups[r.g]) and np.allclose(r.q, want, rtol=1e-12, atol=0), (r.g, r.q, want)


def test_quantiles_of_nothing(spark):
    empty = spark.createDataFrame([], "a int, b int, v float")
    assert quantiles.quantiles(empty, ["a", "b"], "v", [0.5]).count() == 0
    assert quantiles.medians(spark.createDataFrame([(1, 2, 3.0)], "a int, b int, v float"), ["a", "b"], "v").first().median == 3.0


def test_buckets_never_fall(spark):
    v = np.sort(np.concatenate([numbers("signed", 3000, np.random.default_rng(1)), numbers("uniform", 3000, np.random.default_rng(2)), [0.0]]))
    held = spark.createDataFrame([(k, float(x)) for k, x in enumerate(v)], "k int, v double").withColumn("b", quantiles.bucket(F.col("v"))).orderBy("k").collect()
    assert all(a.b <= b.b for a, b in zip(held, held[1:]))


def test_a_group_meets_no_single_task(spark, tmp_path):
    """Behind the first partial count no exchange carries one row for each value."""
    n = 40_000
    rows = spark.range(n, numPartitions=4).select(F.lit("s").alias("g"), (F.pmod(F.col("id") * 7919, F.lit(n)) / float(n)).alias("v"))
    path = str(tmp_path / "v")
    rows.write.parquet(path)
    held = spark.read.parquet(path)
    assert quantiles.quantiles(held, ["g"], "v", [0.5]).first().q[0] == pytest.approx((n - 1) / 2 / n)
    cells = held.withColumn("c", quantiles.bucket(F.col("v"))).groupBy("c").count()
    assert cells.agg(F.max("count")).first()[0] < n / 50


# --- regions


def table(spark, scenes):
    rows = [(s, int(y), int(x), bool(m[y, x])) for s, m in scenes.items() for y in range(m.shape[0]) for x in range(m.shape[1])]
    return spark.createDataFrame(rows, "scene string, y int, x int, changed boolean").repartition(4)


def scenes():
    rng = np.random.default_rng(9)
    out = {f"noise{k}": rng.random((23, 31)) < p for k, p in enumerate((0.15, 0.4, 0.6, 0.97))}
    spiral = np.zeros((24, 24), bool)
    for k in range(0, 12, 2):
        spiral[k, k : 24 - k] = spiral[k : 24 - k, 23 - k] = spiral[23 - k, k : 24 - k] = spiral[k + 2 : 24 - k, k] = True
        if k + 2 < 12:
            spiral[k + 2, k : k + 3] = True
    diagonal = np.eye(25, dtype=bool)
    return out | {"spiral": spiral, "diagonal": diagonal, "none": np.zeros((9, 9), bool), "all": np.ones((17, 9), bool)}


@pytest.mark.parametrize("block", [4, 7, 64])
def test_labels_equal_those_of_the_whole_scene(spark, block):
    held = scenes()
    got = regions.labels(table(spark, held), block=block).collect()
    for name, mask in held.items():
        whole = kernels.components(mask)
        first = {k: min(y * regions.WIDE + x for y, x in zip(*np.nonzero(whole == k))) for k in range(1, whole.max() + 1)}
        assert {(r.y, r.x): r.label for r in got if r.scene == name} == {(y, x): first[whole[y, x]] for y, x in zip(*map(list, np.nonzero(mask)))}
    summary = {r.scene: r for r in regions.summary(table(spark, held), block=block).collect()}
    for name, mask in held.items():
        largest, n, fill = kernels.component_stats(mask)
        assert (summary[name].largest_component_px, summary[name].n_components, summary[name].changed_px) == (largest, n, mask.sum())
        assert summary[name].component_fill_ratio == pytest.approx(fill)


@pytest.mark.parametrize("radius, min_size, block", [(0, 5, 4), (1, 6, 4), (1, 1, 9), (2, 20, 8), (3, 40, 16)])
def test_despeckling_equals_the_whole_scene(spark, radius, min_size, block):
    held = scenes()
    got = regions.despeckled(table(spark, held), radius=radius, min_size=min_size, block=block).collect()
    for name, mask in held.items():
        want = kernels.despeckle(mask, radius, min_size)
        assert {(r.y, r.x) for r in got if r.scene == name and r.changed} == set(zip(*map(list, np.nonzero(want))))
    assert len(got) == sum(m.size for m in held.values())


def test_a_block_holds_its_surroundings(spark):
    with pytest.raises(ValueError, match="four radii"):
        regions.opened(table(spark, {"a": np.ones((4, 4), bool)}), radius=3, block=8)


# --- publishing


def test_a_failure_leaves_the_former_result(spark, tmp_path):
    path = str(tmp_path / "run")
    with pytest.raises(FileNotFoundError):
        storage.current(spark, path)

    def rows(n):
        return lambda folder: spark.range(n).write.parquet(folder)

    def broken(folder):
        raise RuntimeError("lost")

    storage.publish(spark, path, {"a": rows(3), "b": rows(4)}, {"sha": "one"})
    assert storage.marker(spark, path) == {"parts": ["a", "b"], "sha": "one"}
    for parts in ({"a": broken}, {"a": rows(9), "b": broken}):
        with pytest.raises(RuntimeError, match="lost"):
            storage.publish(spark, path, parts)
        assert spark.read.parquet(storage.current(spark, path, "a")).count() == 3
    assert [d for d in os.listdir(path) if d.startswith("_staging")] == []


def test_a_version_without_its_marker_is_never_read(spark, tmp_path, monkeypatch):
    path = str(tmp_path / "run")
    first = storage.publish(spark, path, {"a": lambda f: spark.range(1).write.parquet(f)})
    second = storage.publish(spark, path, {"a": lambda f: spark.range(2).write.parquet(f)})
    assert storage.current(spark, path) == second
    os.remove(f"{second}/COMPLETE")  # as if the writer had died between the rename and the marker
    assert storage.current(spark, path) == first and storage.versions(spark, path) == [first.rsplit("/", 1)[1]]
    third = storage.publish(spark, path, {"a": lambda f: spark.range(5).write.parquet(f)}, keep=1)
    assert storage.current(spark, path) == third and len(os.listdir(path)) == 1
    assert json.load(open(f"{third}/COMPLETE"))["parts"] == ["a"]
