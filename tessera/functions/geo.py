"""Distances, bearings, coordinate checks and classes as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

EARTH_M = 6371000.0
#: The sixteen points of the compass.
COMPASS = ("N", "NNE", "NE", "ENE", "E", "ESE", "SE", "SSE", "S", "SSW", "SW", "WSW", "W", "WNW", "NW", "NNW")


def haversine_m(lat1: Column, lng1: Column, lat2: Column, lng2: Column) -> Column:
    """Metres along the sphere."""
    dlat, dlng = F.radians(lat2 - lat1) / 2, F.radians(lng2 - lng1) / 2
    a = F.pow(F.sin(dlat), 2) + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.pow(F.sin(dlng), 2)
    return 2 * EARTH_M * F.atan2(F.sqrt(a), F.sqrt(1 - a))


def bearing(lat1: Column, lng1: Column, lat2: Column, lng2: Column) -> Column:
    """Degrees from north, 0 to 360."""
    p1, p2, d = F.radians(lat1), F.radians(lat2), F.radians(lng2 - lng1)
    y, x = F.sin(d) * F.cos(p2), F.cos(p1) * F.sin(p2) - F.sin(p1) * F.cos(p2) * F.cos(d)
    return F.pmod(F.degrees(F.atan2(y, x)) + 360.0, F.lit(360.0))


def compass(degrees: Column) -> Column:
    return F.get(F.array(*[F.lit(p) for p in COMPASS]), F.floor(degrees / 22.5 + 0.5).cast("int") % 16)


def dms_parts(degrees: Column) -> tuple[Column, Column, Column]:
    """Whole degrees, whole minutes and seconds (two places) of a coordinate's size."""
    size = F.abs(degrees)
    d = F.floor(size)
    m = F.floor((size - d) * 60)
    return d.cast("long"), m.cast("long"), F.round(((size - d) * 60 - m) * 60, 2)


def dms(value: Column, positive: str, negative: str) -> Column:
    """Degrees, minutes and seconds with the letter of the half."""
    d, m, s = (x.cast("string") for x in dms_parts(value))
    return F.concat(d, F.lit("° "), m, F.lit("' "), s, F.lit('" '), F.when(value >= 0, positive).otherwise(negative))


def accuracy_class(metres: Column, limits: tuple[int, int, int, int] = (20, 50, 100, 500)) -> Column:
    names = ("excellent", "good", "fair", "poor")
    out = F.lit("unreliable")
    for limit, name in reversed(list(zip(limits, names, strict=True))):
        out = F.when(metres <= limit, name).otherwise(out)
    return F.when(metres.isNull() | (metres <= 0), "unknown").otherwise(out)


def valid_fix(lat: Column, lng: Column, accuracy: Column, most: float = 30) -> Column:
    """In range, not at (0, 0), and accurate to ``most`` metres."""
    ok = lat.between(-90, 90) & lng.between(-180, 180) & ~((lat == 0) & (lng == 0)) & (accuracy > 0) & (accuracy <= most)
    return F.coalesce(ok, F.lit(False))


def kmh(metres: Column, seconds: Column) -> Column:
    return F.when(seconds > 0, metres / seconds * 3.6)
