"""Names and numbers of elevation tiles and web-map tiles, and geocoder URLs, as column functions."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

from isoterra.functions.numbers import fixed

# Tile file suffix, smallest and largest size of a good tile file, geocoder address.
TILE_SUFFIX = ".hgt.gz"
TILE_MIN_BYTES, TILE_MAX_BYTES = 5_000_000, 50_000_000
GEOCODER = "https://nominatim.openstreetmap.org"


def _padded(number: Column, width: int) -> Column:
    return F.lpad(F.abs(number).cast("int").cast("string"), width, "0")


def tile_id(lat: Column, lon: Column) -> Column:
    """Name of the one-degree tile that holds a point, without suffix, such as `N63W152`."""
    south, west = F.floor(lat), F.floor(lon)
    return F.concat(
        F.when(south >= 0, "N").otherwise("S"),
        _padded(south, 2),
        F.when(west >= 0, "E").otherwise("W"),
        _padded(west, 3),
    )


def tile_name(lat: Column, lon: Column) -> Column:
    """File name of the tile that holds a point."""
    return F.concat(tile_id(lat, lon), F.lit(TILE_SUFFIX))


def tile_prefix(name: Column) -> Column:
    """Folder of a tile file: the first three characters of its name."""
    return F.substring(name, 1, 3)


def slippy_tile(lat: Column, lon: Column, zoom: Column | int) -> Column:
    """Web-map tile (x, y) of a point in spherical Mercator, clamped to the map."""
    zoom = zoom if isinstance(zoom, Column) else F.lit(zoom)
    n = F.pow(F.lit(2.0), zoom)
    x = F.floor((lon + 180.0) / 360.0 * n)
    y = F.floor((1.0 - F.asinh(F.tan(F.radians(lat))) / math.pi) / 2.0 * n)

    def clamp(v: Column) -> Column:
        return F.least(F.greatest(v.cast("double"), F.lit(0.0)), n - 1).cast("int")

    return F.struct(clamp(x).alias("x"), clamp(y).alias("y"))


def slippy_corner(zoom: Column | int, x: Column, y: Column) -> Column:
    """North-west corner (lat, lon) of a web-map tile."""
    zoom = zoom if isinstance(zoom, Column) else F.lit(zoom)
    n = F.pow(F.lit(2.0), zoom)
    lat = F.degrees(F.atan(F.sinh(math.pi * (1.0 - 2.0 * y / n))))
    return F.struct(lat.alias("lat"), (x / n * 360.0 - 180.0).alias("lon"))


def tile_url(template: Column | str, zoom: Column, x: Column, y: Column) -> Column:
    """Fill `{z}`, `{x}` and `{y}` of a URL template."""
    url = F.lit(template) if isinstance(template, str) else template
    for name, value in (("{z}", zoom), ("{x}", x), ("{y}", y)):
        url = F.replace(url, F.lit(name), value.cast("int").cast("string"))
    return url


def percent_encode(text: Column) -> Column:
    """Percent-encode all but letters, digits and `-_.~`; a space becomes `+`."""
    return F.replace(F.replace(F.url_encode(text), F.lit("*"), F.lit("%2A")), F.lit("%7E"), F.lit("~"))


def search_url(
    query: Column, limit: int = 1, bounds: bool = True, language: str = "en", server: str = GEOCODER
) -> Column:
    """Geocoder search request for a place name."""
    tail = f"&format=json&limit={limit}" + ("&bounded=1&polygon_text=1" if bounds else "")
    tail += f"&accept-language={language}" if language else ""
    return F.concat(F.lit(f"{server}/search?q="), percent_encode(query), F.lit(tail))


def reverse_url(lat: Column, lon: Column, language: str = "en", server: str = GEOCODER) -> Column:
    """Geocoder reverse request for a point, eight decimals."""
    tail = "&format=json" + (f"&accept-language={language}" if language else "")
    return F.concat(F.lit(f"{server}/reverse?lat="), fixed(lat, 8), F.lit("&lon="), fixed(lon, 8), F.lit(tail))
