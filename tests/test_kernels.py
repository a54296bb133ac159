import numpy as np
import pytest
from pyspark.sql import functions as F

from terrashift.operators import kernels as k
from terrashift.operators import scene


def flood(mask):
    seen, out = np.zeros_like(mask, bool), []
    for y, x in zip(*np.nonzero(mask)):
        if seen[y, x]:
            continue
        stack, cells = [(y, x)], []
        seen[y, x] = True
        while stack:
            a, b = stack.pop()
            cells.append((a, b))
            for dy in (-1, 0, 1):
                for dx in (-1, 0, 1):
                    p, q = a + dy, b + dx
                    if 0 <= p < mask.shape[0] and 0 <= q < mask.shape[1] and mask[p, q] and not seen[p, q]:
                        seen[p, q] = True
                        stack.append((p, q))
        out.append(cells)
    return out


@pytest.mark.parametrize("seed", range(8))
def test_components_equal_a_flood_fill(seed):
    rng = np.random.default_rng(seed)
    mask = rng.random((17, 23)) < (0.2, 0.4, 0.6, 0.9)[seed % 4]
    labels = k.components(mask)
    want = flood(mask)
    assert labels.max() == len(want)
    for cells in want:
        assert len({labels[c] for c in cells}) == 1
    assert (labels[~mask] == 0).all()


def test_speckle_goes_and_block_stays():
    mask = np.zeros((64, 64), bool)
    mask[10, 10] = True
    mask[30:44, 30:44] = True
    clean = k.despeckle(mask, 1, 32)
    assert not clean[10, 10] and clean[31:43, 31:43].all()


def test_component_stats_of_nothing_and_of_a_rectangle():
    assert k.component_stats(np.zeros((5, 5), bool)) == (0, 0, 0.0)
    mask = np.zeros((9, 9), bool)
    mask[2:5, 3:7] = True
    assert k.component_stats(mask) == (12, 1, 1.0)


@pytest.mark.parametrize("radius", [1, 2, 3, 5])
def test_dilation_equals_brute_force(radius):
    rng = np.random.default_rng(radius)
    mask = rng.random((15, 19)) < 0.05
    want = np.zeros_like(mask)
    rows = dict(k.ellipse_rows(radius))
    for y, x in zip(*np.nonzero(mask)):
        for dy, half in rows.items():
            if 0 <= y + dy < 15:
                want[y + dy, max(0, x - half) : x + half + 1] = True
    assert (k.dilate(mask, radius) == want).all()


def test_shadow_needs_a_cloud_and_a_radius():
    dark, cloud = np.zeros((20, 20), bool), np.zeros((20, 20), bool)
    dark[10, 10] = dark[0, 0] = True
    assert not k.shadow(dark, cloud, 5).any()
    cloud[10, 13] = True
    assert k.shadow(dark, cloud, 5)[10, 10] and not k.shadow(dark, cloud, 5)[0, 0]
    assert not k.shadow(dark, cloud, 0).any()


def test_ssim_of_equal_images_is_one_and_falls_with_noise():
    rng = np.random.default_rng(0)
    a = rng.random((64, 64, 3))
    assert k.ssim(a, a) == pytest.approx(1.0)
    little, much = (k.ssim(a, np.clip(a + rng.normal(0, s, a.shape), 0, 1)) for s in (0.02, 0.3))
    assert 1 > little > much


def test_phash_ignores_brightness_and_sees_structure():
    x = np.mgrid[0:64, 0:64][1]
    a = 100 + 60 * np.sin(x / 5.0) + np.random.default_rng(0).normal(0, 10, (64, 64))
    assert k.phash(a) == k.phash(a + 20)
    assert (k.phash(a) ^ k.phash(a.T)).bit_count() > 10
    assert k.phash(a) & 1 == 0


@pytest.mark.parametrize("shift", [(0, 0), (3, -2), (0.5, 1.3), (-4.2, 0.7)])
def test_registration_finds_a_known_shift(shift):
    rng = np.random.default_rng(5)
    spectrum = np.fft.fft2(rng.random((64, 64)))
    fy, fx = np.fft.fftfreq(64)[:, None], np.fft.fftfreq(64)[None]
    a = np.real(np.fft.ifft2(spectrum))
    b = np.real(np.fft.ifft2(spectrum * np.exp(-2j * np.pi * (fy * shift[0] + fx * shift[1]))))
    dy, dx = k.registration(a, b, 10)
    assert abs(dy + shift[0]) <= 0.1 and abs(dx + shift[1]) <= 0.1


def test_bilinear_keeps_a_plane_and_identity():
    y, x = np.mgrid[0:8, 0:8].astype(float)
    plane = 2 * y + 3 * x
    assert np.allclose(k.bilinear(plane, 8, 8), plane)
    half = k.bilinear(plane, 4, 4)
    assert np.allclose(half, 2 * (2 * np.mgrid[0:4, 0:4][0] + 0.5) + 3 * (2 * np.mgrid[0:4, 0:4][1] + 0.5))
    assert np.allclose(k.subpixel_shift(plane, 0, 0), plane)
    assert (k.nearest(plane, 8, 8) == plane).all()


@pytest.mark.parametrize("radius", [0, 1, 4])
def test_shadow_by_running_maxima_equals_the_kernel(spark, radius):
    rng = np.random.default_rng(radius)
    grid = [(s, y, x, *(bool(rng.random() < p) for p in (0.4, 0.03, 0.3, 0.02))) for s in (1, 2) for y in range(25) for x in range(30) if rng.random() < 0.95]
    cells = spark.createDataFrame(grid, "scene int, y int, x int, dark1 boolean, cloud1 boolean, dark2 boolean, cloud2 boolean").withColumns({"valid1": F.lit(True), "valid2": F.lit(True)})
    got = scene.with_shadow(cells, radius).toPandas().set_index(["scene", "y", "x"]).sort_index()
    assert len(got) == len(grid) and (got.valid1 == ~got.shadow1).all() and (got.valid2 == ~got.shadow2).all()
    for t in (1, 2):
        want = k.scene_shadow(cells, t, radius).toPandas().set_index(["scene", "y", "x"]).sort_index()
        assert (got[f"shadow{t}"] == want.shadow).all() and (radius == 0 or want.shadow.any())


def test_resampling_of_a_spread_scene_equals_the_dense_one(spark):
    rng = np.random.default_rng(6)
    for h, w, height, width in ((7, 9, 4, 4), (5, 5, 5, 5), (3, 4, 8, 9), (1, 6, 3, 2)):
        image = rng.random((h, w))
        rows = [("s", y + 10, x - 3, float(image[y, x])) for y in range(h) for x in range(w)]
        got = scene.resampled(spark.createDataFrame(rows, "scene string, y int, x int, v double"), "v", height, width).collect()
        want = k.bilinear(image, height, width)
        assert len(got) == height * width and all(abs(r.v - want[r.y, r.x]) < 1e-12 for r in got)
