"""Cached blocks, labels, layout, tile indexes and times."""

import io

import numpy as np
import pytest
from pyspark.sql import functions as F

from terrashift.functions import scalars
from terrashift.sources import arrays, files, storage


def saved(values):
    out = io.BytesIO()
    np.save(out, values)
    return out.getvalue()


@pytest.mark.parametrize("kind, order", [("<f4", "C"), (">f4", "C"), ("<f8", "F")])
def test_blocks_are_read_as_numpy_wrote_them(kind, order):
    values = np.asarray(np.random.default_rng(1).normal(size=(5, 4, 3)), kind, order=order)
    data = memoryview(saved(values))
    got = np.stack([row for _, row in arrays.pixels(data, "x", 3)])
    assert np.array_equal(got, values.astype(np.float32))
    assert np.array_equal(np.load(io.BytesIO(arrays.encoded(got))), got)
    small = np.stack([row for _, row in arrays.pixels(data, "x", 3, 3, 2)])
    assert np.array_equal(small, values.astype(np.float32)[[0, 2, 4]][:, [0, 3]])


def test_blocks_of_another_shape_are_errors():
    for bad in (np.zeros((4, 4), np.float32), np.zeros((4, 4, 2), np.float32), np.zeros((4, 4, 3), np.int32)):
        with pytest.raises(ValueError, match="paris 2018"):
            list(arrays.pixels(memoryview(saved(bad)), "paris 2018", 3))
    with pytest.raises(ValueError, match="NPY"):
        arrays.header(memoryview(b"something else"))


def test_cached_blocks(spark, tmp_path):
    rng = np.random.default_rng(2)
    held = {("paris", 2018): rng.normal(size=(6, 5, 4)).astype(np.float32), ("rome", 2020): rng.normal(size=(12, 10, 4)).astype(np.float32)}
    held["paris", 2018][2, 3, 1] = np.nan
    for (city, year), block in held.items():
        (tmp_path / f"{city}_{year}.npy").write_bytes(saved(block))
    (tmp_path / "other_2018.npy").write_bytes(b"never asked for")
    wanted = spark.createDataFrame([("paris", 2018, 6, 5), ("rome", 2020, 6, 5), ("oslo", 2019, 6, 5)], "city string, year int, height int, width int")
    got = arrays.cached_blocks(spark, str(tmp_path), wanted, dims=4).collect()
    assert sum(r.city == "oslo" for r in got) == 1 and all(r.y is None and r.embedding is None for r in got if r.city == "oslo")
    for r in got:
        if r.city == "paris":
            want = held["paris", 2018][r.y, r.x]
            assert (r.embedding is None) if (r.y, r.x) == (2, 3) else np.array_equal(np.float32(r.embedding), want)
        if r.city == "rome":
            ys, xs = np.rint(np.linspace(0, 11, 6)).astype(int), np.rint(np.linspace(0, 9, 5)).astype(int)
            assert np.array_equal(np.float32(r.embedding), held["rome", 2020][ys[r.y], xs[r.x]])
    assert len(got) == 61


def test_labels_and_layout(spark):
    paths = ["/d/a/cm/cm.png", "/d/a/cm/a-cm.tif", "/d/b/cm/b-cm.tif", "/d/b/cm/cm.tif", "/d/c/cm/cm.tif", "/d/e/cm/a-cm.tif", "/d/f/other/cm.png"]
    labels = files.label_files(spark.createDataFrame([(p,) for p in paths], "path string"))
    assert sorted(tuple(r) for r in labels.collect()) == [("a", "/d/a/cm/cm.png", "gt127"), ("b", "/d/b/cm/b-cm.tif", "eq2"), ("c", "/d/c/cm/cm.tif", "eq2")]
    manifest = spark.createDataFrame([("a", "train"), ("b", "test"), ("e", "train")], "pair_id string, split string")
    assert tuple(files.verify_layout(manifest, labels).first()) == (True, "3 pairs (2 train / 1 test), 2 labelled")
    assert tuple(files.verify_layout(manifest.limit(0), labels).first()) == (False, "no pairs")
    assert files.list_pairs(manifest, "test").count() == 1 and files.list_pairs(manifest).count() == 3
    with pytest.raises(ValueError, match="train, test or all"):
        files.list_pairs(manifest, "validation")


def test_tile_index_is_published_and_read(spark, tmp_path):
    tiles = spark.createDataFrame([(f"t{k}", "abc"[k % 3], "train" if k % 3 else "test", k, 0, 0, 0, 64, 64, k % 2, 0.5) for k in range(9)], files.TILE)
    files.save_tile_index(tiles, str(tmp_path), {"sha": "x"})
    assert sorted(tuple(r) for r in files.saved_tiles(spark, str(tmp_path)).collect()) == sorted(tuple(r) for r in tiles.collect())
    summary = {r.split: (r.positive, r.negative, r.cities) for r in spark.read.json(storage.current(spark, str(tmp_path), "summary")).collect()}
    assert summary == {"train": (3, 3, 2), "test": (1, 2, 1)} and storage.marker(spark, str(tmp_path))["sha"] == "x"


@pytest.mark.parametrize("text, seconds", [
    ("2020-01-02T03:04:05Z", 1577934245), ("2020-01-02t03:04:05z", 1577934245), ("2020-01-02 03:04:05", 1577934245), ("2020-01-02T05:04:05+02:00", 1577934245),
    ("2020-01-02T05:04:05+0200", 1577934245), ("2020-01-02T05:04:05+02", 1577934245), ("2020-01-01T21:34:05.250-05:30", 1577934245), ("2020-01-02", 1577923200), ("2020-01-02T03:04", 1577934240),
    ("2020-13-02", None), ("2020-01-02T25:00:00Z", None), ("yesterday", None), ("", None), (None, None), ("2020-1-2", None),
])
def test_instants(spark, text, seconds):
    before = spark.conf.get("spark.sql.session.timeZone")
    spark.conf.set("spark.sql.session.timeZone", "America/New_York")  # the session's zone must not matter
    try:
        got = spark.createDataFrame([(text,)], "t string").select(F.unix_seconds(scalars.instant(F.col("t")))).first()[0]
    finally:
        spark.conf.set("spark.sql.session.timeZone", before)
    assert got == seconds
