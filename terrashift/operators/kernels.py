"""Neighbourhood operators that Catalyst has no expression for: NumPy over one tile or one scene at a time.

A group is a tile (bounded by the tile size) or, for what needs the whole
frame, a scene. Pixels are packed into dense arrays inside the group, so the
plan carries the long table and nothing is gathered on the driver.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

# --- NumPy --------------------------------------------------------------------


def ellipse_rows(radius: int) -> list[tuple[int, int]]:
    """(dy, half width) of the rows of a filled ellipse; radius 1 is a cross."""
    if radius <= 0:
        return [(0, 0)]
    return [(dy, int(round(radius * np.sqrt(max(0.0, 1.0 - (dy / radius) ** 2))))) for dy in range(-radius, radius + 1)]


def _moved(mask: np.ndarray, dy: int) -> np.ndarray:
    out = np.zeros_like(mask)
    h = len(mask)
    if abs(dy) < h:
        out[max(0, dy) : h + min(0, dy)] = mask[max(0, -dy) : h - max(0, dy)]
    return out


def dilate(mask: np.ndarray, radius: int) -> np.ndarray:
    """By an ellipse; each of its rows is a running sum, so the cost doesn't grow with the row's width."""
    out = np.zeros_like(mask, dtype=bool)
    w = mask.shape[1]
    for dy, half in ellipse_rows(radius):
        sums = np.concatenate([np.zeros((len(mask), 1), int), np.cumsum(_moved(mask.astype(bool), dy), axis=1)], axis=1)
        x = np.arange(w)
        out |= sums[:, np.minimum(w, x + half + 1)] > sums[:, np.maximum(0, x - half)]
    return out


def erode(mask: np.ndarray, radius: int) -> np.ndarray:
    """Beyond the frame counts as set, so a region isn't eaten from the border."""
    return ~dilate(~mask.astype(bool), radius)


def opening(mask: np.ndarray, radius: int) -> np.ndarray:
    return mask.astype(bool) if radius <= 0 else dilate(erode(mask, radius), radius)


def components(mask: np.ndarray) -> np.ndarray:
    """8-connected labels, 1, 2, ... in raster order of their first pixel; 0 is background. Pointer jumping over pixel pairs."""
    h, w = mask.shape
    index = np.arange(h * w).reshape(h, w)
    a, b = [], []
    for dy, dx in ((0, 1), (1, 0), (1, 1), (1, -1)):
        one = (slice(0, h - dy), slice(max(0, -dx), w - max(0, dx)))
        two = (slice(dy, h), slice(max(0, dx), w - max(0, -dx)))
        both = mask[one] & mask[two]
        a.append(index[one][both])
        b.append(index[two][both])
    a, b = np.concatenate(a), np.concatenate(b)
    root = index.ravel().copy()
    while True:
        low = np.minimum(root[a], root[b])
        before = root.copy()
        np.minimum.at(root, root[a], low)
        np.minimum.at(root, root[b], low)
        while not np.array_equal(up := root[root], root):
            root = up
        if np.array_equal(root, before):
            break
    out = np.zeros(h * w, int)
    flat = mask.ravel()
    out[flat] = np.unique(root[flat], return_inverse=True)[1] + 1 if flat.any() else 0
    return out.reshape(h, w)


def despeckle(mask: np.ndarray, radius: int = 1, min_size: int = 32) -> np.ndarray:
    """Opening, then components of fewer than ``min_size`` pixels go."""
    out = opening(mask, radius)
    if min_size > 1 and out.any():
        labels = components(out)
        sizes = np.bincount(labels.ravel())
        sizes[0] = 0
        out = (sizes >= min_size)[labels]
    return out


def component_stats(mask: np.ndarray) -> tuple[int, int, float]:
    """(pixels of the largest component, number of components, its share of its bounding box); the first wins a tie."""
    labels = components(mask.astype(bool))
    sizes = np.bincount(labels.ravel())[1:]
    if not len(sizes):
        return 0, 0, 0.0
    ys, xs = np.nonzero(labels == int(np.argmax(sizes)) + 1)
    box = (ys.max() - ys.min() + 1) * (xs.max() - xs.min() + 1)
    return int(sizes.max()), len(sizes), float(sizes.max() / box)


def shadow(dark: np.ndarray, cloud: np.ndarray, radius: int) -> np.ndarray:
    """Dark pixels within an elliptic radius of a cloud."""
    if radius <= 0 or not cloud.any():
        return np.zeros_like(dark, dtype=bool)
    return dark.astype(bool) & dilate(cloud, radius)


def _gauss(image: np.ndarray, sigma: float = 1.5, radius: int = 5) -> np.ndarray:
    k = np.exp(-0.5 * (np.arange(-radius, radius + 1) / sigma) ** 2)
    k /= k.sum()
    for axis in (0, 1):
        pad = [(radius, radius) if a == axis else (0, 0) for a in (0, 1)]
        padded = np.pad(image, pad, mode="symmetric")
        image = np.apply_along_axis(np.convolve, axis, padded, k, "valid")
    return image


def ssim(a: np.ndarray, b: np.ndarray) -> float:
    """Structural similarity of (h, w, channels) images in [0, 1], Gaussian window of 11, averaged over channels."""
    side = min(11, *(n if n % 2 else n - 1 for n in a.shape[:2]))
    crop = (max(3, side) - 1) // 2
    c1, c2 = 0.01**2, 0.03**2
    out = []
    for c in range(a.shape[2]):
        x, y = a[:, :, c].astype(float), b[:, :, c].astype(float)
        mx, my = _gauss(x), _gauss(y)
        vx, vy, cov = _gauss(x * x) - mx * mx, _gauss(y * y) - my * my, _gauss(x * y) - mx * my
        s = ((2 * mx * my + c1) * (2 * cov + c2)) / ((mx * mx + my * my + c1) * (vx + vy + c2))
        inner = s[crop:-crop, crop:-crop] if min(s.shape) > 2 * crop else s
        out.append(inner.mean())
    return float(np.mean(out))


def _area_weights(n: int, m: int) -> np.ndarray:
    """(m, n) weights: each of m cells is the mean of the stretch of n pixels that it covers."""
    edges = np.linspace(0, n, m + 1)
    low = np.maximum(edges[:-1, None], np.arange(n)[None])
    high = np.minimum(edges[1:, None], np.arange(n)[None] + 1)
    return np.maximum(0, high - low) / (n / m)


def phash(gray: np.ndarray, side: int = 32, low: int = 8) -> int:
    """64 bits: the low block of a cosine transform against the median of its 63 alternating terms."""
    small = _area_weights(gray.shape[0], side) @ gray.astype(float) @ _area_weights(gray.shape[1], side).T
    k = np.arange(side)
    basis = np.sqrt(2 / side) * np.cos(np.pi * (k[None] + 0.5) * k[:, None] / side)
    basis[0] /= np.sqrt(2)
    block = (basis @ small @ basis.T)[:low, :low].ravel()
    bits = block > np.median(block[1:])
    bits[0] = False
    return int(sum(1 << int(i) for i in np.flatnonzero(bits)))


def bilinear(image: np.ndarray, height: int, width: int) -> np.ndarray:
    """Resampling with pixel centres at halves."""

    def axis(n: int, m: int):
        at = np.clip((np.arange(m) + 0.5) * n / m - 0.5, 0, n - 1)
        low = np.minimum(np.floor(at).astype(int), max(0, n - 2))
        return low, np.minimum(low + 1, n - 1), at - low

    y0, y1, fy = axis(image.shape[0], height)
    x0, x1, fx = axis(image.shape[1], width)
    top = image[y0][:, x0] * (1 - fx) + image[y0][:, x1] * fx
    bottom = image[y1][:, x0] * (1 - fx) + image[y1][:, x1] * fx
    return top * (1 - fy)[:, None] + bottom * fy[:, None]


def nearest(image: np.ndarray, height: int, width: int) -> np.ndarray:
    ys = np.rint(np.linspace(0, image.shape[0] - 1, height)).astype(int)
    xs = np.rint(np.linspace(0, image.shape[1] - 1, width)).astype(int)
    return image[ys][:, xs]


def subpixel_shift(image: np.ndarray, dy: float, dx: float) -> np.ndarray:
    """The image moved by (dy, dx), bilinear, the border repeated."""
    h, w = image.shape
    ys, xs = np.clip(np.arange(h) - dy, 0, h - 1), np.clip(np.arange(w) - dx, 0, w - 1)
    y0, x0 = np.floor(ys).astype(int), np.floor(xs).astype(int)
    y1, x1 = np.minimum(y0 + 1, h - 1), np.minimum(x0 + 1, w - 1)
    fy, fx = (ys - y0)[:, None], (xs - x0)[None]
    return (image[y0][:, x0] * (1 - fx) + image[y0][:, x1] * fx) * (1 - fy) + (image[y1][:, x0] * (1 - fx) + image[y1][:, x1] * fx) * fy


def registration(a: np.ndarray, b: np.ndarray, upsample: int = 10) -> tuple[float, float]:
    """(dy, dx) that registers ``b`` onto ``a``: phase correlation, the peak refined by a matrix Fourier transform around it."""
    a, b = np.nan_to_num(a), np.nan_to_num(b)
    cross = np.fft.fft2(a) * np.conj(np.fft.fft2(b))
    cross /= np.maximum(np.abs(cross), 100 * np.finfo(float).eps)
    peak = np.unravel_index(np.argmax(np.abs(np.fft.ifft2(cross))), a.shape)
    shift = np.array([p - n if p > n // 2 else p for p, n in zip(peak, a.shape)], float)
    size = int(np.ceil(upsample * 1.5))
    grid = [shift[k] + (np.arange(size) - size // 2) / upsample for k in (0, 1)]
    waves = [np.exp(2j * np.pi * g[:, None] * np.fft.fftfreq(n)[None]) for g, n in zip(grid, a.shape)]
    fine = np.abs(waves[0] @ cross @ waves[1].T)
    i, j = np.unravel_index(np.argmax(fine), fine.shape)
    return float(grid[0][i]), float(grid[1][j])


# --- DataFrame ------------------------------------------------------------------


def _dense(rows: pd.DataFrame, column: str, y0: int, x0: int, h: int, w: int, empty: float = np.nan) -> np.ndarray:
    out = np.full((h, w), empty, float)
    out[rows["y"].to_numpy() - y0, rows["x"].to_numpy() - x0] = rows[column].to_numpy(dtype=float)
    return out


def _frame(rows: pd.DataFrame) -> tuple[int, int, int, int]:
    y0, x0 = int(rows["y"].min()), int(rows["x"].min())
    return y0, x0, int(rows["y"].max()) - y0 + 1, int(rows["x"].max()) - x0 + 1


def _grouped(pixels: DataFrame, keys: list[str], columns: Iterable[str], one: Callable[[pd.DataFrame], dict], schema: str) -> DataFrame:
    """One row for each group: its keys and what ``one`` says of it."""

    def run(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame([dict(zip(keys, key)) | one(rows)])

    kinds = ", ".join(f"{k} {pixels.schema[k].dataType.simpleString()}" for k in keys)
    return pixels.select(*keys, "y", "x", *columns).groupBy(*keys).applyInPandas(run, f"{kinds}, {schema}")


def tile_components(pixels: DataFrame, keys: list[str], mask: str = "changed", radius: int = 1, min_size: int = 32) -> DataFrame:
    """keys, changed_px, largest_component_px, n_components and component_fill_ratio of each tile's cleaned mask."""

    def one(rows: pd.DataFrame) -> dict:
        y0, x0, h, w = _frame(rows)
        clean = despeckle(_dense(rows, mask, y0, x0, h, w, 0.0) > 0, radius, min_size)
        largest, n, fill = component_stats(clean)
        return {"changed_px": int(clean.sum()), "largest_component_px": largest, "n_components": n, "component_fill_ratio": fill}

    schema = "changed_px int, largest_component_px int, n_components int, component_fill_ratio double"
    return _grouped(pixels, keys, [mask], one, schema)


def cleaned(
    pixels: DataFrame, keys: list[str], mask: str = "changed", radius: int = 1, min_size: int = 32, carry: Iterable[str] = ()
) -> DataFrame:
    """keys, y, x, ``mask`` after despeckling within each group, and the columns of ``carry`` as they are."""

    def run(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        y0, x0, h, w = _frame(rows)
        clean = despeckle(_dense(rows, mask, y0, x0, h, w, 0.0) > 0, radius, min_size)
        return rows.assign(**{mask: clean[rows["y"].to_numpy() - y0, rows["x"].to_numpy() - x0]})

    wanted = pixels.select(*keys, "y", "x", mask, *carry)
    return wanted.groupBy(*keys).applyInPandas(run, wanted.schema)


def scene_shadow(flagged: DataFrame, t: int, radius: int = 30) -> DataFrame:
    """scene, y, x and shadow of one date."""

    def run(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        y0, x0, h, w = _frame(rows)
        cast = shadow(_dense(rows, f"dark{t}", y0, x0, h, w, 0.0) > 0, _dense(rows, f"cloud{t}", y0, x0, h, w, 0.0) > 0, radius)
        return rows[["scene", "y", "x"]].assign(shadow=cast[rows["y"].to_numpy() - y0, rows["x"].to_numpy() - x0])

    kind = flagged.schema["scene"].dataType.simpleString()
    wanted = flagged.select("scene", "y", "x", f"dark{t}", f"cloud{t}")
    return wanted.groupBy("scene").applyInPandas(run, f"scene {kind}, y int, x int, shadow boolean")


def _image(rows: pd.DataFrame, t: int, bands: tuple[str, ...], frame: tuple[int, int, int, int]) -> np.ndarray:
    return np.nan_to_num(np.stack([_dense(rows, f"{b}{t}", *frame) for b in bands], axis=2))


def tile_similarity(pixels: DataFrame, keys: list[str], bands: tuple[str, ...] = ("red", "green", "blue")) -> DataFrame:
    """keys, ssim and phash_distance of the two dates, over bands that are stretched to [0, 1] already."""
    columns = [f"{b}{t}" for t in (1, 2) for b in bands]

    def one(rows: pd.DataFrame) -> dict:
        frame = _frame(rows)
        a, b = (np.clip(_image(rows, t, bands, frame), 0, 1) for t in (1, 2))
        hashes = [phash(np.rint(i.mean(axis=2) * 255)) for i in (a, b)]
        signed = [h - (1 << 64) if h >> 63 else h for h in hashes]
        return {"ssim": ssim(a, b), "phash1": signed[0], "phash2": signed[1]}

    got = _grouped(pixels, keys, columns, one, "ssim double, phash1 bigint, phash2 bigint")
    return got.selectExpr(*keys, "ssim", "phash1", "phash2", "bit_count(phash1 ^ phash2) as phash_distance")


def scene_registration(pixels: DataFrame, band: str = "red", upsample: int = 10) -> DataFrame:
    """scene, dy, dx and registration_px."""

    def one(rows: pd.DataFrame) -> dict:
        frame = _frame(rows)
        dy, dx = registration(_dense(rows, f"{band}1", *frame), _dense(rows, f"{band}2", *frame), upsample)
        return {"dy": dy, "dx": dx, "registration_px": float(np.hypot(dy, dx))}

    return _grouped(pixels, ["scene"], [f"{band}1", f"{band}2"], one, "dy double, dx double, registration_px double")


def scene_resample(pixels: DataFrame, column: str, height: int, width: int, how: str = "bilinear") -> DataFrame:
    """scene, y, x and the column on another grid."""
    method = {"bilinear": bilinear, "nearest": nearest}[how]

    def run(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        frame = _frame(rows)
        out = method(np.nan_to_num(_dense(rows, column, *frame)), height, width)
        ys, xs = np.mgrid[0:height, 0:width]
        return pd.DataFrame({"scene": key[0], "y": ys.ravel(), "x": xs.ravel(), column: out.ravel()})

    kind = pixels.schema["scene"].dataType.simpleString()
    return pixels.select("scene", "y", "x", column).groupBy("scene").applyInPandas(run, f"scene {kind}, y int, x int, {column} double")
