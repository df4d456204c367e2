"""Elevation colours as column functions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Colour stops (position, red, green, blue) in single precision, all in [0, 1].
SCHEMES = {
    "terrain": [(0.0, 0.4, 0.2, 0.1), (0.3, 0.2, 0.6, 0.1), (0.7, 0.8, 0.8, 0.6), (1.0, 1.0, 1.0, 1.0)],
    "rainbow": [
        (0.0, 0.5, 0.0, 1.0),
        (0.2, 0.0, 0.0, 1.0),
        (0.4, 0.0, 1.0, 1.0),
        (0.6, 0.0, 1.0, 0.0),
        (0.8, 1.0, 1.0, 0.0),
        (1.0, 1.0, 0.0, 0.0),
    ],
    "grayscale": [(0.0, 0.0, 0.0, 0.0), (1.0, 1.0, 1.0, 1.0)],
}
# Colour of a bad hex text, material factors, fill opacities.
BAD_HEX = (255, 0, 0)
AMBIENT, SPECULAR, SHININESS = 0.3, 0.1, 10.0
FILL_OPACITY = {"full_color": 0.85, "grayscale": 0.7}


def _float(value: float) -> Column:
    return F.lit(value).cast("float")


def unit_rgb(elev: Column, lo: Column, hi: Column, scheme: str | list[tuple] = "terrain") -> Column:
    """Colour struct(r, g, b) in single precision in [0, 1], linear between the stops of a scheme.

    A list of (position, r, g, b) is a custom scheme. In a range without height everything below it
    gets the first colour and the rest the last.
    """
    if isinstance(scheme, str):
        if scheme not in SCHEMES:
            raise ValueError(f"no colour stops for scheme {scheme!r}")
        stops = SCHEMES[scheme]
    else:
        stops = sorted(scheme)
    inner = F.least(F.greatest(F.try_divide(elev - lo, hi - lo), F.lit(0.0)), F.lit(1.0))
    at = F.when(hi != lo, inner).when(elev < lo, 0.0).otherwise(1.0)

    def channel(k: int) -> Column:
        chain = None
        for left, right in zip(stops, stops[1:]):
            t = (at - left[0]) / (right[0] - left[0])
            mixed = (_float(left[k]).cast("double") * (1.0 - t) + _float(right[k]).cast("double") * t).cast("float")
            inside = at.between(left[0], right[0])
            chain = F.when(inside, mixed) if chain is None else chain.when(inside, mixed)
        first = at <= stops[0][0]
        chain = F.when(first, _float(stops[0][k])) if chain is None else chain.when(first, _float(stops[0][k]))
        return chain.otherwise(_float(stops[-1][k]))

    return F.struct(channel(1).alias("r"), channel(2).alias("g"), channel(3).alias("b"))


def to_bytes(unit: Column) -> Column:
    """Unit colour to 8-bit channels by truncation."""
    return F.struct(*[(unit[c] * _float(255.0)).cast("int").alias(c) for c in "rgb"])


def color_rgb(elev: Column, lo: Column, hi: Column, scheme: str | list[tuple] = "terrain") -> Column:
    """8-bit colour struct(r, g, b) of an elevation."""
    return to_bytes(unit_rgb(elev, lo, hi, scheme))


def hex_pair(number: Column) -> Column:
    """Two lower-case hexadecimal digits."""
    return F.lower(F.lpad(F.hex(number.cast("long")), 2, "0"))


def hex_from_bytes(rgb: Column) -> Column:
    """8-bit struct to `#rrggbb`."""
    return F.concat(F.lit("#"), hex_pair(rgb["r"]), hex_pair(rgb["g"]), hex_pair(rgb["b"]))


def to_hex(r: Column, g: Column, b: Column) -> Column:
    """Unit channels to `#rrggbb`, truncating."""
    return F.concat(F.lit("#"), *[hex_pair((c.cast("float") * _float(255.0)).cast("int")) for c in (r, g, b)])


def parse_hex(text: Column) -> Column:
    """`#RRGGBB` (the sign may be missing) to 8-bit struct(r, g, b); bad text gives red."""
    digits = F.regexp_replace(text, "^#", "")
    good = F.regexp_like(digits, F.lit("^[0-9A-Fa-f]{6}$"))

    def channel(at: int, bad: int) -> Column:
        value = F.conv(F.substring(digits, at, 2), 16, 10).cast("int")
        return F.when(good, value).otherwise(F.lit(bad))

    return F.struct(
        channel(1, BAD_HEX[0]).alias("r"), channel(3, BAD_HEX[1]).alias("g"), channel(5, BAD_HEX[2]).alias("b")
    )


def band_of(value: Column, lo: Column, hi: Column, n: int) -> Column:
    """Index of the material band of an elevation: int(position * (n - 1)), clamped."""
    if n <= 1:
        return F.lit(0)
    at = F.least(F.greatest(F.coalesce(F.try_divide(value - lo, hi - lo), F.lit(0.0)), F.lit(0.0)), F.lit(1.0))
    return F.least((at * (n - 1)).cast("int"), F.lit(n - 1))


def ramp(value: Column, lo: Column, hi: Column) -> Column:
    """Vertex colour from green (low) to red (high): r = int(255 p), g = 255 - r, b = 0."""
    at = F.least(F.greatest(F.coalesce(F.try_divide(value - lo, hi - lo), F.lit(0.0)), F.lit(0.0)), F.lit(1.0))
    red = (at * 255).cast("int")
    return F.struct(red.alias("r"), (255 - red).alias("g"), F.lit(0).alias("b"))
