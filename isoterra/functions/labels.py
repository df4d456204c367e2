"""Label, file-name and coordinate text, as column functions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from isoterra.functions.numbers import fixed

# Feet per metre, millimetres per inch.
FEET_PER_METRE = 3.28084
MM_PER_INCH = 25.4

# Stands for an escaped percent sign while a template is filled in.
_ESCAPED = "\x01"


def whole(value: Column) -> Column:
    """Nearest whole number (half away from zero) as text."""
    return F.round(value).cast("int").cast("string")


def two_digits(number: Column) -> Column:
    """Number padded with zeros to at least two characters."""
    text = number.cast("string")
    return F.when(F.length(text) < 2, F.lpad(text, 2, "0")).otherwise(text)


def fill(template: Column, values: dict[str, Column]) -> Column:
    """Replace `%{name}` by its value; unknown or NULL names stay as written.

    `%%{` keeps a pattern from being filled in; it comes out as `%{{`, as users of such templates
    are used to.
    """
    text = F.replace(template, F.lit("%%{"), F.lit(_ESCAPED))
    # Values could contain pattern text themselves, so names first become unique marks.
    for i, name in enumerate(values):
        text = F.replace(text, F.lit(f"%{{{name}}}"), F.lit(f"\x02{i}\x03"))
    for i, (name, value) in enumerate(values.items()):
        text = F.replace(text, F.lit(f"\x02{i}\x03"), F.coalesce(value, F.lit(f"%{{{name}}}")))
    return F.replace(text, F.lit(_ESCAPED), F.lit("%{{"))


def to_dms(angle: Column) -> Column:
    """Angle without sign as struct(degrees, minutes, seconds)."""
    size = F.abs(angle)
    degrees = F.floor(size).cast("int")
    rest = (size - degrees) * 60.0
    minutes = F.floor(rest).cast("int")
    return F.struct(degrees.alias("degrees"), minutes.alias("minutes"), ((rest - minutes) * 60.0).alias("seconds"))


def format_coord(lat: Column, lon: Column, imperial: bool = False) -> Column:
    """`63.0690°, -151.0070°`, or degrees, minutes and seconds in imperial style."""
    if not imperial:
        return F.concat(fixed(lat, 4), F.lit("°, "), fixed(lon, 4), F.lit("°"))

    def half(angle: Column, plus: str, minus: str) -> Column:
        dms = to_dms(angle)
        return F.concat(
            dms["degrees"].cast("string"),
            F.lit("°"),
            dms["minutes"].cast("string"),
            F.lit("'"),
            fixed(dms["seconds"], 1),
            F.lit('"'),
            F.when(angle >= 0, plus).otherwise(minus),
        )

    return F.concat(half(lat, "N", "S"), F.lit(", "), half(lon, "E", "W"))


def format_distance(metres: Column, unit: str = "m") -> Column:
    """Distance with one decimal in m, ft, mm or in."""
    factors = {"m": metres, "ft": metres * FEET_PER_METRE, "mm": metres * 1000.0, "in": metres * 1000.0 / MM_PER_INCH}
    return F.concat(fixed(factors[unit], 1), F.lit(unit))


def render_label(
    template: Column,
    *,
    scale_ratio: Column,
    contour_height: Column,
    layer: Column,
    elevation: Column,
    min_x: Column,
    min_y: Column,
    max_x: Column,
    max_y: Column,
    substrate_mm: Column,
    imperial: bool = False,
    land_unit: str = "m",
    print_unit: str = "mm",
) -> Column:
    """Fill a label template for one layer row; w and h are the raw spans of the box."""
    center_x, center_y = (min_x + max_x) / 2.0, (min_y + max_y) / 2.0
    substrate = F.when(substrate_mm > 0, format_distance(substrate_mm / 1000.0, print_unit))
    return fill(
        template,
        {
            "s": fixed(scale_ratio, 0),
            "c": format_distance(contour_height, land_unit),
            "n": F.when(layer > 0, layer.cast("string")),
            "l": two_digits(layer),
            "e": whole(elevation),
            "x": fixed(center_x, 4),
            "y": fixed(center_y, 4),
            "w": format_distance(max_x - min_x, land_unit),
            "h": format_distance(max_y - min_y, land_unit),
            "W": substrate,
            "H": substrate,
            "C": format_coord(center_y, center_x, imperial),
            "UL": format_coord(max_y, min_x, imperial),
            "UR": format_coord(max_y, max_x, imperial),
            "LL": format_coord(min_y, min_x, imperial),
            "LR": format_coord(min_y, max_x, imperial),
        },
    )


def render_filename(base: Column, layer: Column, elevation: Column, template: Column | None = None) -> Column:
    """File name without extension; default `{base}_layer_{02}_elev_{m}m`."""
    if template is None:
        return F.concat(base, F.lit("_layer_"), two_digits(layer), F.lit("_elev_"), whole(elevation), F.lit("m"))
    number = two_digits(layer)
    return fill(template, {"b": base, "l": number, "e": whole(elevation), "n": number})


def layer_id(layer: Column, elevation: Column) -> Column:
    """Identifier of a drawn layer, `layer_{02}_elev_{m}`."""
    return F.concat(F.lit("layer_"), two_digits(layer), F.lit("_elev_"), whole(elevation))
