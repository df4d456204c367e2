"""Places from stored geocoder and map-feature responses, and when their labels show."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Smallest zoom and base size per kind, limits and reference of the label size.
MIN_ZOOM = {"peak": 12, "city": 8, "village": 11, "water": 10, "other": 13}
BASE_SIZE = {"peak": 9.0, "city": 12.0, "village": 9.0, "water": 9.0, "other": 8.0}
SMALLEST, LARGEST = 2.0, 18.0
REFERENCE_ALTITUDE_M = 150000.0
EARTH_CIRCUMFERENCE_M, TILE_PIXELS = 40075000.0, 256.0

GEOCODER_SCHEMA = (
    "array<struct<display_name string, lat string, lon string, boundingbox array<string>, osm_type string, "
    "class string, type string, importance double>>"
)
FEATURE_SCHEMA = (
    "struct<elements array<struct<lat double, lon double, "
    "tags struct<name string, ref string, `natural` string, place string>>>>"
)


def parse_geocoder(responses: DataFrame, first_only: bool = False, body: str = "body") -> DataFrame:
    """One row per place of a stored response, keeping the other columns; bad JSON gives no row.

    `position` counts from 0; the box arrives as south, north, west, east. Reading stops before the
    first place whose numbers are bad, as everything after it is not trusted.
    """
    keys = [c for c in responses.columns if c != body]
    # Postpone the parse until after the shape check: anything but an array yields no places.
    places = F.when(F.trim(F.col(body)).startswith("["), F.from_json(F.col(body), GEOCODER_SCHEMA))

    def number(text: Column) -> Column:
        return F.coalesce(text, F.lit("0.0")).try_cast("double")

    def box(p: Column, i: int) -> Column:
        return F.when(F.size(p["boundingbox"]) >= 4, F.get(p["boundingbox"], F.lit(i)).try_cast("double"))

    def bad(p: Column) -> Column:
        boxed = F.size(p["boundingbox"]) >= 4
        corners = F.exists(F.slice(p["boundingbox"], 1, 4), lambda t: t.try_cast("double").isNull())
        return number(p["lat"]).isNull() | number(p["lon"]).isNull() | F.coalesce(boxed & corners, F.lit(False))

    rows = responses.select(*keys, places.alias("_places")).withColumn(
        "_end", F.array_position(F.transform("_places", bad), F.lit(True)).cast("int")
    )
    good = F.when(F.col("_end") > 0, F.slice("_places", F.lit(1), F.col("_end") - 1)).otherwise(F.col("_places"))
    listed = rows.select(*keys, F.posexplode(good).alias("position", "_p"))
    if first_only:
        listed = listed.where("position = 0")
    p = F.col("_p")
    return listed.select(
        *keys,
        "position",
        F.coalesce(p["display_name"], F.lit("")).alias("name"),
        number(p["lat"]).alias("lat"),
        number(p["lon"]).alias("lon"),
        box(p, 0).alias("min_lat"),
        box(p, 1).alias("max_lat"),
        box(p, 2).alias("min_lon"),
        box(p, 3).alias("max_lon"),
        F.coalesce(p["osm_type"], F.lit("")).alias("osm_type"),
        F.coalesce(p["class"], F.lit("")).alias("class"),
        F.coalesce(p["type"], F.lit("")).alias("type"),
        F.coalesce(p["importance"], F.lit(0.0)).alias("importance"),
    )


def parse_pois(responses: DataFrame, body: str = "body") -> DataFrame:
    """Named points of interest of a stored response, keeping the other columns.

    The name falls back to the reference number; features with neither are dropped.
    """
    keys = [c for c in responses.columns if c != body]
    features = responses.select(*keys, F.explode(F.from_json(F.col(body), FEATURE_SCHEMA)["elements"]).alias("_e"))
    tags = F.col("_e.tags")
    natural, place = tags["natural"], tags["place"]
    kind = (
        F.when(natural == "peak", "peak")
        .when(place.isin("city", "town"), "city")
        .when(place == "village", "village")
        .when(natural == "water", "water")
        .otherwise("other")
    )
    name = F.coalesce(F.nullif(tags["name"], F.lit("")), F.nullif(tags["ref"], F.lit("")))
    return features.select(
        *keys,
        name.alias("name"),
        kind.alias("kind"),
        F.coalesce(F.col("_e.lat"), F.lit(0.0)).alias("lat"),
        F.coalesce(F.col("_e.lon"), F.lit(0.0)).alias("lon"),
    ).where(F.col("name").isNotNull())


def _by_kind(values: dict) -> Column:
    chain = F
    for kind, value in values.items():
        chain = chain.when(F.col("kind") == kind, F.lit(value))
    return chain


def poi_visibility(pois: DataFrame, zooms: Sequence[int]) -> DataFrame:
    """Label size and visibility of every point at each of the given zoom levels.

    The size grows by half its base per halving of the viewing height and is clamped to 2..18.
    """
    leveled = pois.withColumn("zoom", F.explode(F.array(*[F.lit(z) for z in zooms])))
    altitude = EARTH_CIRCUMFERENCE_M / (F.lit(TILE_PIXELS) * F.pow(F.lit(2.0), F.col("zoom")))
    size = _by_kind(BASE_SIZE) * (F.log2(F.lit(REFERENCE_ALTITUDE_M) / altitude) / 2.0 + 1.0)
    clamped = F.least(F.greatest(size, F.lit(SMALLEST)), F.lit(LARGEST))
    return leveled.withColumn("label_size", clamped).withColumn(
        "visible", (F.col("zoom") >= _by_kind(MIN_ZOOM)) & (F.col("label_size") >= SMALLEST)
    )
