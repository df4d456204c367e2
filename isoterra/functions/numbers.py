"""Numbers as text, rounded from their exact binary value as C and DuckDB print them.

Java formats the shortest decimal text of a double, half up, so 0.25 with one decimal would become
0.3 and 0.15 become 0.2. Here the exact value decides and a true tie goes to even: the rounding error
of value * 10^digits is recovered exactly and consulted when the product looks like a tie.
"""

from __future__ import annotations

from collections.abc import Sequence
from decimal import Decimal

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Splits a double into two halves whose products with integers up to 2^27 are exact.
_SPLIT = 134217729.0


def _whole(size: Column, scale: Column, scaled: Column) -> Column:
    """size * scale as a whole number, rounded from the exact product."""
    part = scaled % 1.0
    high = size * _SPLIT - (size * _SPLIT - size)
    rest = (high * scale - scaled) + (size - high) * scale
    tie_up = (rest > 0) | ((rest == 0) & (scaled.cast("long") % 2 == 1))
    return scaled.cast("long") + F.when((part > 0.5) | ((part == 0.5) & tie_up), 1).otherwise(0)


def _written(value: Column, whole: Column, places: Column, scaled: Column, beyond: int) -> Column:
    """Sign, digits and decimal point; values beyond exact whole numbers use the Java format with `beyond` decimals."""
    number = F.lpad(whole.cast("string"), F.greatest(F.length(whole.cast("string")), places + 1), "0")
    back = F.when(places > 0, F.concat(F.lit("."), F.right(number, places))).otherwise("")
    text = F.concat(F.when(value < 0, "-").otherwise(""), F.left(number, F.length(number) - places), back)
    return F.when(scaled < 2.0**52, text).otherwise(F.format_string(f"%.{beyond}f", value))


def _written_fixed(value: Column, whole: Column, digits: int, scaled: Column) -> Column:
    """As `_written` for a given count of decimals, by whole division: the fraction is shown behind a leading one."""
    unit = F.lit(10**digits).cast("long")
    back = F.concat(F.lit("."), F.substring((unit + whole % unit).cast("string"), 2, digits)) if digits else F.lit("")
    text = F.concat(F.when(value < 0, "-").otherwise(""), F.call_function("div", whole, unit).cast("string"), back)
    return F.when(scaled < 2.0**52, text).otherwise(F.format_string(f"%.{digits}f", value))


def fixed(value: Column, digits: int) -> Column:
    """Number with a fixed count of decimals (0 to 8)."""
    value, scale = value.cast("double"), F.lit(float(10**digits))
    scaled = F.abs(value) * scale
    # An exact decimal product writes the digits, so the rounded number is named only once.
    whole = _whole(F.abs(value), scale, scaled).cast("decimal(20,0)")
    number = whole if digits == 0 else whole * F.lit(Decimal(1).scaleb(-digits))
    text = F.concat(F.when(value < 0, "-").otherwise(""), number.cast("string"))
    return F.when(scaled < 2.0**52, text).otherwise(F.format_string(f"%.{digits}f", value))


def _significant_places(size: Column) -> Column:
    places = F.when(size >= 100000, 0).when(size >= 10000, 1).when(size >= 1000, 2).when(size >= 100, 3)
    return places.when(size >= 10, 4).when(size >= 1, 5).when(size >= 0.1, 6).when(size >= 0.01, 7).otherwise(8)


def with_text(df: DataFrame, columns: Sequence[str], digits: int | None = None) -> DataFrame:
    """Add `{column}_text` for number columns: `digits` decimals, or six significant digits.

    The same as `fixed`, computed in steps of plain columns so that the expressions stay small. Six
    significant digits come without trailing zeros, as plain stream output shows them.
    """

    def staged(name: str, make) -> dict[str, Column]:
        return {f"_{c}_{name}": make(c) for c in columns}

    def col(c: str, name: str) -> Column:
        return F.col(f"_{c}_{name}")

    sized = df.withColumns(staged("size", lambda c: F.abs(F.col(c).cast("double"))))
    places = (lambda c: F.lit(digits)) if digits is not None else (lambda c: _significant_places(col(c, "size")))
    placed = sized.withColumns(staged("places", places))
    scale = (lambda c: F.lit(float(10**digits))) if digits is not None else (lambda c: F.pow(F.lit(10.0), col(c, "places")))
    scaled = placed.withColumns(staged("scale", scale)).withColumns(
        staged("scaled", lambda c: col(c, "size") * col(c, "scale"))
    )
    whole = scaled.withColumns(staged("whole", lambda c: _whole(col(c, "size"), col(c, "scale"), col(c, "scaled"))))

    def text(c: str) -> Column:
        if digits is not None:
            return _written_fixed(F.col(c), col(c, "whole"), digits, col(c, "scaled"))
        written = _written(F.col(c), col(c, "whole"), col(c, "places"), col(c, "scaled"), 0)
        return F.regexp_replace(F.regexp_replace(written, r"(\.\d*?)0+$", "$1"), r"\.$", "")

    return whole.select(*df.columns, *[text(c).alias(f"{c}_text") for c in columns])
