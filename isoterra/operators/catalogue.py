"""Which elevation tiles a box needs, and which of them are at hand.

Boxes are `(box_id, min_lat, max_lat, min_lon, max_lon)`.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from isoterra.functions.tiles import TILE_MAX_BYTES, TILE_MIN_BYTES, tile_name
from isoterra.spread import lookup


def split_antimeridian(boxes: DataFrame) -> DataFrame:
    """Boxes with min_lon > max_lon become two parts, up to 180 and from -180; `part` numbers them."""
    crosses = F.col("min_lon") > F.col("max_lon")

    def part(number: int, west, east):
        return F.struct(F.lit(number).alias("part"), west.alias("min_lon"), east.alias("max_lon"))

    parts = F.when(
        crosses,
        F.array(part(1, F.col("min_lon"), F.lit(180.0)), part(2, F.lit(-180.0), F.col("max_lon"))),
    ).otherwise(F.array(part(1, F.col("min_lon"), F.col("max_lon"))))
    return boxes.select("box_id", "min_lat", "max_lat", F.explode(parts).alias("_p")).select(
        "box_id", "_p.part", "min_lat", "max_lat", "_p.min_lon", "_p.max_lon"
    )


def tiles_for_bbox(boxes: DataFrame) -> DataFrame:
    """One row per box and covering tile: every whole degree from floor(min) to floor(max), both included."""
    degrees = boxes.withColumn(
        "tile_lat", F.explode(F.sequence(F.floor("min_lat").cast("int"), F.floor("max_lat").cast("int")))
    ).withColumn("tile_lon", F.explode(F.sequence(F.floor("min_lon").cast("int"), F.floor("max_lon").cast("int"))))
    return degrees.select("box_id", "tile_lat", "tile_lon", tile_name(F.col("tile_lat"), F.col("tile_lon")).alias("tile"))


def needed_tiles(boxes: DataFrame) -> DataFrame:
    """Distinct tiles of every box, antimeridian handled."""
    return tiles_for_bbox(split_antimeridian(boxes)).select("box_id", "tile").distinct()


def _cached(inventory: DataFrame) -> DataFrame:
    """Tiles whose file size is that of a whole tile."""
    good = F.col("bytes").between(TILE_MIN_BYTES, TILE_MAX_BYTES)
    return inventory.where(good).select("tile").distinct()


def tile_coverage(boxes: DataFrame, inventory: DataFrame) -> DataFrame:
    """Needed, cached and missing tile counts per box; `inventory` is (tile, bytes)."""
    # One tile may lie in most boxes; the planner splits the partitions of such tiles.
    marked = lookup(needed_tiles(boxes), _cached(inventory).withColumn("_have", F.lit(True)), ["tile"], "left")
    return marked.groupBy("box_id").agg(
        F.count(F.lit(1)).alias("needed"),
        F.count("_have").alias("cached"),
        F.count_if(F.col("_have").isNull()).alias("missing"),
    )


def missing_tiles(boxes: DataFrame, inventory: DataFrame) -> DataFrame:
    """Distinct tiles some box needs and no good file holds."""
    return needed_tiles(boxes).select("tile").distinct().join(_cached(inventory), "tile", "left_anti")
