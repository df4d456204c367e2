"""GeoJSON feature collections, one document per grid and layer."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from isoterra.functions.numbers import fixed, with_text
from isoterra.operators.polygons import POLYGON, polygon_metrics
from isoterra.sinks.text import FIRST, LAST, ring_parts, write_lines
from isoterra.spread import attach

# Coordinate decimals and style properties of a feature.
PRECISION = 6
STYLE = '"stroke": "#0033ff", "stroke-width": 2, "fill": "#0099ff", "fill-opacity": 0.3'
ORDER = ["polygon_id", "ring_id", "part"]
# Sorting bound of the last line of a collection over all layers.
LAST_LAYER = 2**31 - 1


def to_geojson(
    ring_points: DataFrame,
    layers: DataFrame,
    holes: bool = True,
    area: bool = False,
    style: bool = False,
    crs: str | None = None,
    precision: int = PRECISION,
) -> DataFrame:
    """Lines (grid_id, layer, polygon_id, ring_id, part, value) of one FeatureCollection per layer.

    `layers` carries layer, elevation and layer_number. Rings are closed once. Line breaks fall
    between points and rings, where JSON allows them.
    """
    return _lines(ring_points, layers, ["grid_id", "layer"], holes, area, style, crs, precision)


def to_collection(
    ring_points: DataFrame,
    layers: DataFrame,
    holes: bool = True,
    area: bool = False,
    style: bool = False,
    crs: str | None = None,
    precision: int = PRECISION,
) -> DataFrame:
    """Lines as of `to_geojson`, but one FeatureCollection per grid with the features of all its layers.

    In the order of layer and the columns of ORDER they make up the document: its first line has layer
    FIRST, its last one LAST_LAYER. Which feature goes without a comma is known from one minimum per grid.
    """
    return _lines(ring_points, layers, ["grid_id"], holes, area, style, crs, precision)


def _lines(
    ring_points: DataFrame, layers: DataFrame, document: list[str], holes: bool, area: bool, style: bool, crs: str | None, precision: int
) -> DataFrame:
    points = ring_points if holes else ring_points.where("ring_id = 0")
    written = with_text(points, ["x", "y"], precision)
    pair = F.concat(F.lit("["), F.col("x_text"), F.lit(", "), F.col("y_text"), F.lit("]"))
    opening = F.when(F.col("ring_id") == 0, "[").otherwise(",[")
    coordinates = ring_parts(written, pair, ", ", opening, F.concat(F.lit(", "), pair, F.lit("]")))

    features = points.where("ring_id = 0 and seq = 0").select(*POLYGON)
    first = features.groupBy(*document).agg(F.min(F.struct("layer", "polygon_id")).alias("_first"))
    named = layers.select("grid_id", "layer", "elevation", "layer_number")
    shown = attach(features, named.join(first, document), ["grid_id", "layer"], ["polygon_id"])
    properties = [
        F.lit('"elevation": '),
        fixed(F.col("elevation"), precision),
        F.lit(', "layer": '),
        F.col("layer_number").cast("string"),
    ]
    if area:
        sizes = polygon_metrics(points).select(*POLYGON, "exterior_area")
        shown = shown.join(sizes, POLYGON)
        properties += [F.lit(', "area": '), fixed(F.col("exterior_area"), precision)]
    if style:
        properties.append(F.lit(f", {STYLE}"))
    start = shown.select(
        *POLYGON,
        F.lit(FIRST).cast("long").alias("ring_id"),
        F.lit(0).cast("long").alias("part"),
        F.concat(
            F.when(F.struct("layer", "polygon_id") == F.col("_first"), "").otherwise(","),
            F.lit('{"type": "Feature","properties": {'),
            *properties,
            F.lit('},"geometry": {"type": "Polygon","coordinates": ['),
        ).alias("value"),
    )
    end = features.select(
        *POLYGON, F.lit(LAST).cast("long").alias("ring_id"), F.lit(0).cast("long").alias("part"), F.lit("]}}").alias("value")
    )
    reference = f'"crs": {{"type": "name","properties": {{"name": "{crs}"}}}},' if crs else ""

    def frame(at: int, text: str) -> DataFrame:
        ids = [F.lit(at).cast("long").alias(c) for c in ORDER]
        layer = F.col("layer") if "layer" in document else F.lit(min(at, LAST_LAYER)).cast("int").alias("layer")
        return first.select("grid_id", layer, *ids, F.lit(text).alias("value"))

    head = frame(FIRST, f'{{"type": "FeatureCollection",{reference}"features": [')
    parts = [start, coordinates, end, head, frame(LAST, "]}")]
    lines = parts[0]
    for part in parts[1:]:
        lines = lines.unionByName(part.select(*lines.columns))
    return lines


def write_geojson(ring_points: DataFrame, layers: DataFrame, path: str, **options) -> None:
    """Write one folder of part files per grid and layer."""
    write_lines(to_geojson(ring_points, layers, **options), path, ORDER, ["grid_id", "layer"])
