"""Distances and pixel lengths written as text, and their conversion, as column functions.

The parsing functions return a struct whose `error` field is NULL when the text was good; a bad
text never stops a job.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Unit names (lower case), metres per unit, millimetres per inch.
UNIT_NAMES = {
    "m": "m",
    "meters": "m",
    "km": "km",
    "kilometers": "km",
    "ft": "ft",
    "feet": "ft",
    "mi": "mi",
    "miles": "mi",
    "mm": "mm",
    "millimeters": "mm",
    "in": "in",
    "inches": "in",
    '"': "in",
    "px": "px",
    "pixels": "px",
}
METRES = {"m": 1.0, "km": 1000.0, "ft": 0.3048, "mi": 1609.34, "mm": 0.001, "in": 0.0254}
MM_PER_INCH = 25.4

_DISTANCE = r'^[ \t\n\r]*([+-]?[0-9]+\.?[0-9]*)[ \t]*(.*?)[ \t\n\r]*$'


def _map(entries: dict) -> Column:
    return F.create_map(*[F.lit(v) for pair in entries.items() for v in pair])


def _metres(unit: Column | str) -> Column:
    """Metres per unit; NULL for px and unknown units."""
    if isinstance(unit, str):
        return F.lit(METRES.get(unit))
    return F.try_element_at(_map(METRES), unit)


def convert_distance(value: Column, source: Column | str, target: Column | str) -> Column:
    """Convert by way of metres; NULL where a unit has no length (px)."""
    source_unit = F.lit(source) if isinstance(source, str) else source
    target_unit = F.lit(target) if isinstance(target, str) else target
    converted = value * _metres(source) / _metres(target)
    return F.when(source_unit == target_unit, value).otherwise(converted)


def _number_and_unit(text: Column) -> tuple[Column, Column]:
    number = F.regexp_extract(text, _DISTANCE, 1).try_cast("double")
    return number, F.lower(F.regexp_extract(text, _DISTANCE, 2))


def _parsed(text: Column, default: str, to_target) -> Column:
    number, written = _number_and_unit(text)
    explicit = written != ""
    unit = F.when(explicit, F.try_element_at(_map(UNIT_NAMES), written)).otherwise(F.lit(default))
    value = to_target(number, unit)
    error = (
        F.when(F.coalesce(F.trim(text), F.lit("")) == "", "empty")
        .when(number.isNull(), "no number")
        .when(unit.isNull(), "unknown unit")
        .when(value.isNull(), "unit has no length")
    )
    return F.struct(
        F.when(error.isNull(), value).alias("value"),
        F.when(error.isNull(), unit).alias("unit"),
        F.when(error.isNull(), explicit).alias("explicit"),
        error.alias("error"),
    )


def parse_distance(text: Column, default: str = "m", canonical: str = "m") -> Column:
    """Text such as `150ft`, ` 2.5 KM` or `10"` to struct(value in canonical, unit, explicit, error)."""
    return _parsed(text, default, lambda number, unit: convert_distance(number, unit, canonical))


def px_to_mm(px: Column, dpi: Column | float) -> Column:
    """Pixels to millimetres; NULL unless dpi is positive."""
    dpi = dpi if isinstance(dpi, Column) else F.lit(float(dpi))
    return F.when(dpi > 0, px * MM_PER_INCH / dpi)


def mm_to_px(mm: Column, dpi: Column | float) -> Column:
    """Millimetres to pixels; NULL unless dpi is positive."""
    dpi = dpi if isinstance(dpi, Column) else F.lit(float(dpi))
    return F.when(dpi > 0, mm * dpi / MM_PER_INCH)


def parse_stroke(text: Column, dpi: Column | float) -> Column:
    """Stroke width text to struct(value in mm, unit, explicit, error); no unit means pixels."""
    return _parsed(
        text,
        "px",
        lambda number, unit: F.when(unit == "px", px_to_mm(number, dpi)).otherwise(
            convert_distance(number, unit, "mm")
        ),
    )
