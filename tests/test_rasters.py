"""Raster files: every form decoded, headers from few bytes, listing rules, windows, crops."""

import struct
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from terrashift.operators import ingest
from terrashift.plans import views
from terrashift.sources import catalogue, files, geotiff


def made(cells, rows=8, cols=None, order="<", deflate=True, predictor=1, **place):
    """A file with the cells (h, w) or (h, w, samples)."""
    cells = cells[:, :, None] if cells.ndim == 2 else cells
    h, w, s = cells.shape
    parts = []
    for y in range(0, h, rows):
        for x in range(0, w, cols or w):
            block = cells[y : y + rows, x : x + (cols or w)]
            if cols:
                block = np.pad(block, ((0, rows - block.shape[0]), (0, cols - block.shape[1]), (0, 0)))
            parts.append(geotiff.encoded_block(block, order, deflate, predictor))
    return geotiff.assembled(parts, h, w, cells.dtype, rows, cols, order, deflate, predictor, s, **place)


def from_bytes(data):
    return lambda at, n: data[at : at + n]


def pieced(data, window=None, band=1, shape=(37, 29)):
    out = np.full(shape, np.nan)
    for y, x, block in geotiff.blocks(from_bytes(data), window, band):
        assert np.isnan(out[y : y + block.shape[0], x : x + block.shape[1]]).all()
        out[y : y + block.shape[0], x : x + block.shape[1]] = block
    return out


@pytest.mark.parametrize("kind", ["uint8", "uint16", "int16", "int32", "float32", "float64"])
@pytest.mark.parametrize("order, cols, deflate, predictor", [("<", None, True, 1), (">", None, False, 2), ("<", 16, True, 2), (">", 16, True, 1), ("<", 16, False, 1)])
def test_every_form_is_decoded(kind, order, cols, deflate, predictor):
    if kind.startswith("float"):
        predictor = 1
    rng = np.random.default_rng(3)
    cells = rng.integers(0, 200, (37, 29, 2)).astype(kind)
    data = made(cells, 16 if cols else 5, cols, order, deflate, predictor)
    for band in (1, 2):
        assert np.array_equal(pieced(data, band=band), cells[:, :, band - 1])
    window = (6, 3, 20, 17)
    want = np.full((37, 29), np.nan)
    want[6:26, 3:20] = cells[6:26, 3:20, 0]
    assert np.array_equal(pieced(data, window), want, equal_nan=True)
    assert np.isnan(pieced(data, (50, 50, 5, 5))).all()


def test_a_window_inflates_only_its_blocks():
    data = made(np.arange(64 * 64, dtype=np.uint16).reshape(64, 64), 16, 16)
    tags = geotiff.read_tiff(from_bytes(data), geotiff.GRID_TAGS | geotiff.BLOCK_TAGS).tags
    asked = []

    def read(at, n):
        asked.append(at)
        return data[at : at + n]

    list(geotiff.blocks(read, (17, 1, 10, 20)))
    places = tags[geotiff.TILE_OFFSETS]
    assert {p for p in places if p in asked} == {places[4], places[5]}


def test_float_predictor_and_separate_planes():
    cells = np.random.default_rng(0).normal(size=(4, 6)).astype(np.float32)
    planes = np.ascontiguousarray(cells.astype(">f4")[:, :, None]).view(np.uint8).reshape(4, 6, 4).transpose(0, 2, 1).reshape(4, 24)
    raw = np.diff(planes, axis=1, prepend=np.zeros((4, 1), np.uint8)).astype(np.uint8).tobytes()
    data = geotiff.assembled([zlib.compress(raw)], 4, 6, np.dtype(np.float32), 4, predictor=3)
    assert np.array_equal(pieced(data, shape=(4, 6)), cells.astype(float))
    two = np.random.default_rng(1).integers(0, 9, (2, 5, 3)).astype(np.uint8)
    data = geotiff.assembled([zlib.compress(p.tobytes()) for p in two], 5, 3, np.dtype(np.uint8), 5, samples=2)
    at = data.index(struct.pack("<HHI", geotiff.PLANAR, 3, 1))
    data = data[: at + 8] + struct.pack("<H", 2) + data[at + 10 :]
    assert all(np.array_equal(pieced(data, band=b + 1, shape=(5, 3)), two[b]) for b in (0, 1))


def test_big_tiff_and_matrix_transform():
    entries = [(256, 3, 1, struct.pack("<H", 2)), (257, 3, 1, struct.pack("<H", 1)), (258, 3, 1, struct.pack("<H", 8)), (273, 16, 1, struct.pack("<Q", 400)), (279, 16, 1, struct.pack("<Q", 2)), (34264, 12, 16, struct.pack("<Q", 500))]
    head = struct.pack("<2sHHHQ", b"II", 43, 8, 0, 16) + struct.pack("<Q", len(entries)) + b"".join(struct.pack("<HHQ8s", a, b, c, d.ljust(8, b"\0")) for a, b, c, d in entries) + bytes(8)
    matrix = struct.pack("<16d", 10, 1, 0, 300, 0, -10, 0, 900, *[0] * 8)
    data = head.ljust(400, b"\0") + b"\x07\x09" + bytes(98) + matrix
    assert pieced(data, shape=(1, 2)).tolist() == [[7, 9]]
    grid = geotiff.read_tiff(from_bytes(data)).grid()
    assert (grid["west"], grid["north"], grid["step_x"], grid["step_y"], grid["rotated"]) == (300, 900, 10, 10, True)


def test_what_is_not_supported_is_an_error():
    with pytest.raises(ValueError, match="not a TIFF"):
        geotiff.read_tiff(from_bytes(b"PNG and so on, of some length"))
    data = made(np.zeros((4, 4), np.uint8))
    at = data.index(struct.pack("<HHI", geotiff.COMPRESSION, 3, 1))
    lzw = data[: at + 8] + struct.pack("<H", 5) + data[at + 10 :]
    with pytest.raises(ValueError, match="compression 5"):
        list(geotiff.blocks(from_bytes(lzw)))
    with pytest.raises(ValueError, match="band 2"):
        list(geotiff.blocks(from_bytes(data), band=2))


@pytest.fixture
def root(tmp_path):
    rng = np.random.default_rng(4)
    held = {}
    for scene, folder in (("alpha", "imgs_{}_rect"), ("beta", "imgs_{}")):
        for t in (1, 2):
            for band in ("B02", "B04"):
                name = {"alpha": f"{band}.tif", "beta": f"S2A_2020_{band}.tif"}[scene]
                if (scene, t, band) == ("alpha", 2, "B04"):
                    name = "b04.tif"
                cells = rng.integers(1, 12000, (20, 23)).astype(np.uint16)
                cells[0, 0] = 0
                held[scene, t, band] = cells
                path = tmp_path / scene / folder.format(t) / name
                path.parent.mkdir(parents=True, exist_ok=True)
                path.write_bytes(made(cells, 8, west=500.0, north=9000.0, epsg=32631, nodata=0))
    (tmp_path / "alpha" / "imgs_1").mkdir()
    (tmp_path / "alpha" / "imgs_1" / "X_B02.tif").write_bytes(b"never opened")
    (tmp_path / "alpha" / "imgs_1_rect" / "B08.tif").write_bytes(b"never opened")
    return tmp_path, held


def test_bands_of_scenes(spark, root):
    path, held = root
    got = geotiff.read_bands(spark, str(path), ("B02", "B04")).collect()
    assert len(got) == 2 * 20 * 23
    for r in got:
        for t in (1, 2):
            for b in ("B02", "B04"):
                raw = int(held[r.scene, t, b][r.y, r.x])
                assert r[f"{b}{t}"] == (None if raw == 0 else raw / 10000.0)
    part = geotiff.read_bands(spark, str(path), ("B04",), window=(5, 6, 3, 4)).collect()
    assert {(r.y, r.x) for r in part} == {(y, x) for y in range(5, 8) for x in range(6, 10)} and len(part) == 24
    with pytest.raises(FileNotFoundError, match="alpha"):
        geotiff.read_bands(spark, str(path), ("B02", "B08"))
    with pytest.raises(ValueError, match="unknown"):
        geotiff.read_bands(spark, str(path), ("red",))


def test_headers_read_few_bytes(spark, tmp_path):
    big = np.random.default_rng(0).integers(0, 60000, (700, 900)).astype(np.uint16)
    (tmp_path / "big.tif").write_bytes(made(big, 16, west=100.0, north=700.0, epsg=32631, nodata=0))
    (tmp_path / "tiny.tif").write_bytes(made(big[:3, :3], 3))
    (tmp_path / "bad.tif").write_bytes(b"not a raster at all, whatever its name")
    listed = spark.read.format("binaryFile").load(str(tmp_path)).select("path", "length")
    got = {r.path.rsplit("/", 1)[1]: r for r in geotiff.headers(listed).collect()}
    assert (got["big.tif"].width, got["big.tif"].height, got["big.tif"].epsg, got["big.tif"].west, got["big.tif"].nodata) == (900, 700, 32631, 100.0, 0.0)
    assert (tmp_path / "big.tif").stat().st_size > 1_000_000 and got["big.tif"].bytes_read < 1024
    assert got["tiny.tif"].west is None and got["tiny.tif"].epsg is None and not got["tiny.tif"].rotated
    assert got["bad.tif"].problem == "not a TIFF file" and got["bad.tif"].width is None


def test_several_bands_of_one_file(spark):
    cells = np.random.default_rng(7).integers(0, 255, (9, 7, 3)).astype(np.uint8)
    data = made(cells, 4)
    rows = spark.createDataFrame([("s", 3, bytearray(data)), ("s", 1, bytearray(data))], "scene string, band int, content binary")
    got = geotiff.decoded(rows, ["scene", "band"], scale=255.0, band="band").collect()
    assert len(got) == 2 * 63 and all(r.value == cells[r.y, r.x, r.band - 1] / 255.0 for r in got)


def pair(**changed):
    base = {f"{c}{t}": v for t in (1, 2) for c, v in {"width": 10, "height": 8, "west": 0.0, "north": 80.0, "step_x": 10.0, "step_y": 10.0, "epsg": 32631, "rotated": False}.items()}
    return base | changed


SCHEMA = ", ".join(f"{c}{t} {k}" for t in (1, 2) for c, k in {"width": "int", "height": "int", "west": "double", "north": "double", "step_x": "double", "step_y": "double", "epsg": "int", "rotated": "boolean"}.items())


def test_crop_windows(spark):
    cases = [
        (pair(), None, (0, 0, 8, 10, 0, 0, 8, 10)),
        (pair(west2=20.0, north2=70.0), None, (1, 2, 7, 8, 0, 0, 7, 8)),
        (pair(west2=-34.0), None, (0, 0, 8, 7, 0, 3, 8, 7)),
        (pair(epsg2=32632), "the pair has two coordinate systems", None),
        (pair(epsg1=None), "no coordinate system", None),
        (pair(rotated2=True), "rotated grids are not supported", None),
        (pair(west2=100.0), "the footprints don't overlap", None),
        (pair(step_x2=20.0), "the windows differ in shape", None),
        (pair(west2=97.0), "less than a pixel is shared", None),
    ]
    rows = spark.createDataFrame([tuple(c[0][n.split()[0]] for n in SCHEMA.split(", ")) for c in cases], SCHEMA)
    got = ingest.crop_windows(rows.coalesce(1)).collect()
    for r, (_, problem, window) in zip(got, cases):
        held = tuple(r[f"{c}{t}"] for t in (1, 2) for c in ("row_off", "col_off", "rows", "cols"))
        assert r.problem == problem and held == (window or (None,) * 8), r


def test_label_outside_the_labelled_area_is_unchanged(spark):
    rows = spark.createDataFrame([(0, "eq2"), (1, "eq2"), (2, "eq2")], "v int, e string")
    assert [r[0] for r in rows.coalesce(1).select(files.label_changed(F.col("v"), F.col("e"))).collect()] == [False, False, True]


def test_catalogue_by_headers(spark, tmp_path):
    def put(pair, where, cells, **place):
        path = tmp_path / pair / where
        path.parent.mkdir(parents=True, exist_ok=True)
        path.write_bytes(made(cells, 8, **place))

    small, large = np.zeros((20, 30), np.uint16), np.zeros((200, 300), np.uint16)
    put("saclay_e", "imgs_1_rect/B04.tif", large)
    put("saclay_e", "imgs_1/S2_B04.tif", small, west=2.0, north=49.0, step=0.01, epsg=4326)
    put("saclay_w", "imgs_1/S2_B04.tif", small, west=1.7, north=49.0, step=0.01, epsg=4326)
    put("paris", "imgs_1_rect/b04.tif", small)
    put("paris", "imgs_1/X_B04.tif", small)
    put("alone", "imgs_1_rect/B03.tif", small)
    for extra in ("saclay_e/cm/cm.png", "saclay_e/pair/img1.png", "paris/cm/paris-cm.tif"):
        (tmp_path / extra).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / extra).write_bytes(b"x")
    listing = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(str(tmp_path)).select("path")
    pairs = spark.createDataFrame([("saclay_e", "train"), ("saclay_w", "test"), ("paris", "train"), ("alone", "test")], "pair_id string, split string")
    polygons = spark.createDataFrame([("paris", '{"coordinates": [[[2.5, 48.8], [2.6, 48.8], [2.6, 48.9], [2.5, 48.8]]]}'), ("alone", "broken")], "pair_id string, geometry string")
    dates = spark.createDataFrame([("paris", "2016-01-01", "2018-02-02")], "pair_id string, date_t1 string, date_t2 string")
    got = {r.pair_id: r for r in catalogue.build(listing, pairs, polygons, dates).collect()}
    assert list(got) == ["alone", "paris", "saclay_e", "saclay_w"]
    e, w, p, a = got["saclay_e"], got["saclay_w"], got["paris"], got["alone"]
    assert (e.height, e.width, e.epsg, e.bbox_source, e.has_label, e.preview1, e.preview2) == (200, 300, 4326, "native_transform", True, True, False)
    assert tuple(round(v, 9) for v in e.bbox) == (2.0, 48.8, 2.3, 49.0) and (w.height, w.width) == (20, 30)
    assert e.notes == ["Edge-adjacent to saclay_w across the train/test split."] and w.notes == ["Edge-adjacent to saclay_e across the train/test split."]
    assert (p.bbox_source, p.epsg, tuple(p.bbox), p.date_t2, p.has_label) == ("aoi_polygon", None, (2.5, 48.8, 2.6, 48.9), "2018-02-02", True)
    assert p.notes == ["No CRS on the native raster; falling back to the AOI polygon."] and (p.height, p.width) == (20, 30)
    assert (a.height, a.width, a.bbox, a.bbox_source, a.notes) == (0, 0, None, "none", [])


def test_doubles_are_rounded_as_in_sql(spark, duck):
    """All parts of 640, of which many are a half in the seventh place, and what has no neighbour to be rounded to."""
    rows = [(k, k / 640.0 if k < 640 else (k - 640) / -640.0) for k in range(1280)] + [(1280, float("nan")), (1281, float("inf")), (1282, 1e305), (1283, None)]
    got = {r.k: r.x for r in views.rounded(spark.createDataFrame(rows, "k int, x double")).collect()}
    want = dict(duck.sql("SELECT k, round(CASE WHEN k < 640 THEN k/640.0E0 ELSE (k - 640)/-640.0E0 END, 6) FROM range(1280) t(k)").fetchall())
    assert {k: got[k] + 0.0 for k in want} == {k: x + 0.0 for k, x in want.items()}
    assert got[1280] != got[1280] and got[1281] == float("inf") and got[1282] == 1e305 and got[1283] is None
