"""Spectral indices and per-pixel change measures.

A value that is NULL, NaN or infinite is not observed. Spark orders NaN above
every number, so each comparison here is guarded by ``finite``.
"""

from __future__ import annotations

from functools import reduce
from operator import and_

from pyspark.sql import Column
from pyspark.sql import functions as F

LOW_DENOMINATOR = 0.02  # fixed value: below it an index is 0


def finite(c: Column) -> Column:
    return c.isNotNull() & ~F.isnan(c) & (F.abs(c) < F.lit(float("inf")))


def all_finite(*cs: Column) -> Column:
    return reduce(and_, map(finite, cs))


def normalised_difference(a: Column, b: Column) -> Column:
    """(a - b) / (a + b); 0 where either isn't observed or the sum is too small."""
    return F.when(all_finite(a, b) & (a + b > LOW_DENOMINATOR), (a - b) / (a + b)).otherwise(F.lit(0.0))


def ndvi(nir: Column, red: Column) -> Column:
    return normalised_difference(nir, red)


def ndbi(swir: Column, nir: Column) -> Column:
    return normalised_difference(swir, nir)


def ndwi(green: Column, nir: Column) -> Column:
    return normalised_difference(green, nir)


def ndsi(green: Column, swir: Column) -> Column:
    return normalised_difference(green, swir)


def cva(pairs: list[tuple[Column, Column]]) -> Column:
    """Length of the change vector over (before, after) bands."""
    return F.sqrt(sum(((after - before) * (after - before) for before, after in pairs), F.lit(0.0)))


def change_magnitude(d_ndvi: Column, d_ndbi: Column, d_ndwi: Column, water: Column | None = None) -> Column:
    """The larger land index change; over water, where land indices are noise, the water index change."""
    land = F.greatest(F.abs(d_ndvi), F.abs(d_ndbi))
    return land if water is None else F.when(water, F.abs(d_ndwi)).otherwise(land)


def brightness(blue: Column, green: Column, red: Column) -> Column:
    return (blue + green + red) / 3.0


def clip(c: Column, low: float, high: float) -> Column:
    return F.least(F.greatest(c, F.lit(low)), F.lit(high))


def ramp(v: Column, low: float, high: float) -> Column:
    """0 to 1 between two levels; a step at ``high`` when they coincide."""
    if high <= low:
        return F.when(v >= high, 1.0).otherwise(0.0)
    return clip((v - low) / (high - low), 0.0, 1.0)


def heat(d_ndvi: Column, d_ndbi: Column, changed: Column, full_scale: float = 0.5) -> Column:
    """Change intensity on a fixed physical scale; 0 off the mask."""
    mean = (F.abs(d_ndvi) + F.abs(d_ndbi)) / 2.0
    return F.when(changed & finite(mean), clip(mean / full_scale, 0.0, 1.0)).otherwise(F.lit(0.0))


def to_uint8(c: Column) -> Column:
    """Half-even rounding onto 0..255."""
    return F.rint(clip(c, 0.0, 1.0) * 255.0).cast("int")


def linear_rescale(raw: Column, scale: float, offset: float) -> Column:
    return (raw - offset) / scale


def photometric(c: Column, blue: bool = False, gain: float = 1.18, blue_gain: float = 1.05, gamma: float = 0.85) -> Column:
    """A brightness change that is no change on the ground: the control for robustness."""
    lit = clip(c * gain, 0.0, 1.0)
    return F.pow(clip(lit * blue_gain, 0.0, 1.0) if blue else lit, F.lit(gamma))


def diverging(v: Column, span: float = 0.5) -> tuple[Column, Column, Column]:
    """Red, green and blue of a fixed-range ramp from blue over white to red."""
    x = clip(v / span, -1.0, 1.0)
    red = F.when(x < 0, 1.0 + x).otherwise(1.0)
    blue = F.when(x > 0, 1.0 - x).otherwise(1.0)
    return to_uint8(red), to_uint8(1.0 - F.abs(x)), to_uint8(blue)
