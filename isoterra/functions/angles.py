"""Angles, coordinate pairs and boxes written as text, as column functions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Characters that mark degree-minute-second text, characters that separate its parts.
DMS_MARKS = "[°d'\"NSEW]"
DMS_SEPARATORS = "[°d'\"ms]"

_NUMBER = r"^[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?$"


def _plain_number(text: Column) -> Column:
    """A decimal number or NULL; words such as NaN or Infinity are no numbers here."""
    text = F.regexp_replace(text, r"^[ \t\n\r]+|[ \t\n\r]+$", "")
    return F.when(F.regexp_like(text, F.lit(_NUMBER)), text.try_cast("double"))


def _dms(text: Column) -> Column:
    trimmed = F.regexp_replace(text, r"^[ \t\n\r]+|[ \t\n\r]+$", "")
    hemisphere = F.upper(F.regexp_extract(trimmed, "([NSEWnsew])$", 1))
    body = F.regexp_replace(trimmed, "[NSEWnsew]$", "")
    parts = F.split(F.trim(F.regexp_replace(F.regexp_replace(body, DMS_SEPARATORS, " "), r"[ \t\n\r]+", " ")), " ")
    degrees = _plain_number(F.get(parts, F.lit(0)))
    # A missing or unreadable minute ends the reading; seconds count only after good minutes.
    minute_read = _plain_number(F.get(parts, F.lit(1)))
    minutes = F.coalesce(minute_read, F.lit(0.0))
    seconds = F.when(minute_read.isNotNull(), F.coalesce(_plain_number(F.get(parts, F.lit(2))), F.lit(0.0))).otherwise(
        0.0
    )
    size = F.abs(degrees) + minutes / 60.0 + seconds / 3600.0
    negative = F.when(hemisphere.isin("S", "W"), True).when(hemisphere.isin("N", "E"), False).otherwise(degrees < 0)
    good = (minutes >= 0) & (minutes < 60) & (seconds >= 0) & (seconds < 60)
    return F.when(good, F.when(negative, -size).otherwise(size))


def _angle(text: Column, limit: float) -> Column:
    value = F.when(F.regexp_like(text, F.lit(DMS_MARKS)), _dms(text)).otherwise(_plain_number(text))
    return F.when(value.between(-limit, limit), value)


def parse_latitude(text: Column) -> Column:
    """Decimal or DMS latitude in [-90, 90]; NULL when the text is bad."""
    return _angle(text, 90.0)


def parse_longitude(text: Column) -> Column:
    """Decimal or DMS longitude in [-180, 180]; NULL when the text is bad."""
    return _angle(text, 180.0)


def parse_pair(text: Column, lenient: bool = False) -> Column:
    """`lat,lon` to struct(lat, lon), NULL when either half is bad.

    The strict form splits at the first comma and reads each half as above. The lenient form wants
    exactly two decimal halves after dropping the degree sign, N and E and turning S and W into `-`.
    """
    if lenient:
        cleaned = F.regexp_replace(F.regexp_replace(text, "[°NE]", ""), "[SW]", "-")
        halves = F.split(cleaned, ",", -1)
        lat, lon = _plain_number(F.get(halves, F.lit(0))), _plain_number(F.get(halves, F.lit(1)))
        good = (F.size(halves) == 2) & lat.between(-90.0, 90.0) & lon.between(-180.0, 180.0)
    else:
        halves = F.split(text, ",", 2)
        lat, lon = parse_latitude(F.get(halves, F.lit(0))), parse_longitude(F.get(halves, F.lit(1)))
        good = lat.isNotNull() & lon.isNotNull()
    return F.when(good, F.struct(lat.alias("lat"), lon.alias("lon")))


def valid_box(upper_left: Column, lower_right: Column) -> Column:
    """True when the first corner lies north-west of the second; False also when one is missing."""
    north = upper_left["lat"] > lower_right["lat"]
    west = upper_left["lon"] < lower_right["lon"]
    return F.coalesce(north & west, F.lit(False))
