"""Dates, identifiers, fingerprints, maps, JSON and geography."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

EARTH_RADIUS = 6378137.0  # fixed value: metres, the sphere of web maps


def season_delta(a: Column, b: Column) -> Column:
    """Days between two dates within the year, the short way round; NULL if either is unknown."""
    d = F.abs(F.dayofyear(a) - F.dayofyear(b))
    return F.least(d, 365 - d)


def compact_date(text: Column) -> Column:
    """YYYYMMDD to a DATE; NULL if it isn't one."""
    return F.when(text.rlike(r"^\d{8}$"), F.try_to_date(text, "yyyyMMdd"))


def leading_year(text: Column) -> Column:
    return F.substring(text, 1, 4).try_cast("int")


def clamp_year(year: Column, first: int) -> tuple[Column, Column]:
    """(the year moved into the covered range, whether it was moved)."""
    return F.greatest(year, F.lit(first)), year < first


def fingerprint(text: Column, digits: int = 32) -> Column:
    return F.substring(F.sha2(text, 256), 1, digits)


def valid_identifier(text: Column, pattern: str = r"^[a-z0-9][a-z0-9_\-]{0,63}$") -> Column:
    return F.coalesce(text.rlike(pattern), F.lit(False))


def band_map(text: Column) -> Column:
    """``B04=1,B03=2`` to a MAP; a bad token raises."""
    good = text.rlike(r"^[A-Z0-9]+=\d+(,[A-Z0-9]+=\d+)*$")
    parts = F.transform_values(F.str_to_map(text, F.lit(","), F.lit("=")), lambda _, v: v.cast("int"))
    return F.when(good, parts).when(text.isNotNull(), F.raise_error(F.concat(F.lit("bad band map: "), text)).cast("map<string,int>"))


def or_not_assessed(c: Column) -> Column:
    return F.coalesce(c.cast("string"), F.lit("not assessed"))


def mercator_y(latitude: Column) -> Column:
    return EARTH_RADIUS * F.log(F.tan(F.lit(math.pi / 4) + F.radians(latitude) / 2.0))


def pixel_lonlat(x: Column, y: Column, width: Column, height: Column, west: Column, south: Column, east: Column, north: Column) -> tuple[Column, Column]:
    """The centre of a pixel by linear interpolation in a box."""
    lon = west + (x.cast("double") + 0.5) / width.cast("double") * (east - west)
    lat = north - (y.cast("double") + 0.5) / height.cast("double") * (north - south)
    return lon, lat


def instant(text: Column) -> Column:
    """A TIMESTAMP of an ISO 8601 text: Z or an offset counts, a text without either is UTC, a date is its midnight; else NULL."""
    plain = F.trim(text)
    zoned = plain.rlike(r"(?i)(z|[+\-]\d{2}(:?\d{2})?)$") & plain.contains(":")
    whole = plain.rlike(r"(?i)^\d{4}-\d{2}-\d{2}([t ]\d{2}:\d{2}(:\d{2}(\.\d{1,6})?)?(z|[+\-]\d{2}(:?\d{2})?)?)?$")
    timed = F.when(plain.contains(":"), plain).otherwise(F.concat(plain, F.lit("T00:00:00")))
    upper = F.regexp_replace(F.upper(F.when(zoned, timed).otherwise(F.concat(timed, F.lit("Z")))), r"([+\-]\d{2}):?(\d{2})?$", "$1:$2")
    fixed = F.regexp_replace(upper, r"([+\-]\d{2}):$", "$1:00")
    seconds = F.regexp_replace(fixed, r"([T ]\d{2}:\d{2})(Z|[+\-])", "$1:00$2")
    return F.when(whole, F.try_to_timestamp(seconds))
