"""Polygon features as a table with attributes and a table with WKT geometry."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from isoterra.functions.numbers import with_text
from isoterra.operators.polygons import POLYGON, RING, polygon_metrics
from isoterra.sinks.text import FIRST, LAST
from isoterra.spread import BLOCK, attach

PART = ["ring_id", "part"]


def feature_geometry(ring_points: DataFrame) -> DataFrame:
    """WKT of every polygon in pieces (polygon columns, ring_id, part, value).

    In order of ring and part the values, put together, are the whole text, however many points a
    polygon has; no row holds more than a block of a ring. The first ring of a polygon is its exterior, and
    the first point of a ring closes it, whatever their numbers. Points without coordinates are left out.
    """
    points = ring_points.withColumn("part", F.expr(f"seq div {BLOCK}"))
    pair = F.concat(F.col("x_text"), F.lit(" "), F.col("y_text"))
    placed = F.col("x").isNotNull() & F.col("y").isNotNull()
    point = F.when(placed, F.struct("seq", pair.alias("text")))
    told = with_text(points, ["x", "y"]).select(*RING, "part", point.alias("_point"))
    # One more row for every ring, which meets the first block of the ring and says how the ring begins.
    rings = points.where(placed).groupBy(*RING).agg(F.min("part").alias("part"))
    nth = F.row_number().over(Window.partitionBy(*POLYGON).orderBy("ring_id"))
    begun = rings.withColumn("_opening", F.when(nth == 1, "POLYGON ((").otherwise(", ("))
    blocks = told.unionByName(begun, allowMissingColumns=True).groupBy(*RING, "part").agg(
        F.array_sort(F.collect_list("_point")).alias("_points"), F.max("_opening").alias("_opening")
    )
    opening, first = F.col("_opening"), F.get("_points", F.lit(0))["text"]
    body = F.concat(F.when(opening.isNull(), ", ").otherwise(""), F.array_join(F.col("_points.text"), ", "))

    def piece(value: Column, part: Column, ring: Column = F.col("ring_id")) -> Column:
        return F.struct(ring.alias("ring_id"), part.alias("part"), value.alias("value"))

    last = F.lit(LAST).cast("long")
    pieces = F.array(
        piece(opening, F.lit(FIRST).cast("long")),
        piece(F.when(F.size("_points") > 0, body).otherwise(""), F.col("part")),
        piece(F.when(opening.isNotNull(), F.concat(F.lit(", "), first, F.lit(")"))), last),
        piece(F.when(opening == "POLYGON ((", ")"), last, last),
    )
    return blocks.select(*POLYGON, F.inline(pieces)).where("value is not null")


def whole_geometry(pieces: DataFrame) -> DataFrame:
    """One row per polygon with its whole WKT (polygon columns, wkt), from the pieces of `feature_geometry`.

    A text is one value, which the engine limits to 2 GB. A polygon without any coordinates has none.
    """
    text = F.expr("listagg(value, '') within group (order by ring_id, part)")
    return pieces.groupBy(*POLYGON).agg(F.nullif(text, F.lit("")).alias("wkt"))


def feature_table(ring_points: DataFrame, layers: DataFrame) -> DataFrame:
    """One row per polygon: elevation (12,2), layer number, exterior area and perimeter (16,4).

    Its geometry is in `feature_geometry` under the same polygon columns.
    """
    named = layers.select("grid_id", "layer", "elevation", "layer_number")
    placed = attach(polygon_metrics(ring_points), named, ["grid_id", "layer"], ["polygon_id"])
    return placed.select(
        "grid_id",
        "layer",
        "polygon_id",
        F.col("elevation").cast("decimal(12,2)").alias("elevation"),
        F.col("layer_number").cast("int").alias("layer_number"),
        F.col("exterior_area").cast("decimal(16,4)").alias("area"),
        F.col("perimeter").cast("decimal(16,4)").alias("perimeter"),
    )


def write_features(ring_points: DataFrame, layers: DataFrame, path: str) -> None:
    """Write both tables as Parquet, `features` and `geometry`, below a folder."""
    feature_table(ring_points, layers).write.parquet(f"{path}/features")
    ordered = feature_geometry(ring_points).repartitionByRange(*POLYGON, *PART).sortWithinPartitions(*POLYGON, *PART)
    ordered.write.parquet(f"{path}/geometry")
