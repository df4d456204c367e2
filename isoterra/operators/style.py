"""Colours attached to bands, polygons and vertices."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from isoterra.functions.color import (
    AMBIENT,
    FILL_OPACITY,
    SHININESS,
    SPECULAR,
    band_of,
    color_rgb,
    hex_from_bytes,
    hex_pair,
    ramp,
    unit_rgb,
)
from isoterra.operators.mesh import Mesh, mesh_extents, with_corners
from isoterra.spread import attach


def band_materials(ranges: DataFrame, n: int, scheme: str | list[tuple] = "terrain", key: str = "grid_id") -> DataFrame:
    """n materials per range row (key, min_elev, max_elev), endpoints included; one row per band."""
    lo, hi = F.col("min_elev"), F.col("max_elev")
    bands = ranges.withColumn("band", F.explode(F.sequence(F.lit(0), F.lit(n - 1))))
    step = F.col("band") / F.lit(float(n - 1)) if n > 1 else F.lit(0.0)
    colored = bands.withColumn("elevation", lo + (hi - lo) * step).withColumn(
        "_c", unit_rgb(F.col("elevation"), lo, hi, scheme)
    )
    dark = F.lit(AMBIENT).cast("float")
    return colored.select(
        key,
        "band",
        "elevation",
        F.concat(F.lit("elevation_"), F.col("elevation").cast("int").cast("string"), F.lit("m")).alias("name"),
        *[F.col(f"_c.{c}").alias(f"diffuse_{c}") for c in "rgb"],
        *[(F.col(f"_c.{c}") * dark).alias(f"ambient_{c}") for c in "rgb"],
        F.lit(SPECULAR).alias("specular"),
        F.lit(SHININESS).alias("shininess"),
    )


def triangle_band(mesh: Mesh, n: int) -> DataFrame:
    """Material band of every triangle: its mean height within the mesh's height range."""
    box = mesh_extents(mesh).select("mesh_id", "min_z", "max_z")
    mean = with_corners(mesh).select(
        "mesh_id", "tid", ((F.col("z0") + F.col("z1") + F.col("z2")) / 3.0).alias("mean_z")
    )
    return attach(mean, box, ["mesh_id"], ["tid"]).select(
        "mesh_id", "tid", "mean_z", band_of(F.col("mean_z"), F.col("min_z"), F.col("max_z"), n).alias("band")
    )


def vertex_ramp(mesh: Mesh) -> DataFrame:
    """Vertices with 8-bit green-to-red colours by height within their mesh."""
    box = mesh_extents(mesh).select("mesh_id", "min_z", "max_z")
    colored = attach(mesh.vertices, box, ["mesh_id"], ["vid"]).withColumn(
        "_c", ramp(F.col("z"), F.col("min_z"), F.col("max_z"))
    )
    return colored.select(*mesh.vertices.columns, F.col("_c.r").alias("r"), F.col("_c.g").alias("g"), F.col("_c.b").alias("b"))


def polygon_style(layers: DataFrame, mode: str = "full_color", scheme: str | list[tuple] = "terrain") -> DataFrame:
    """Fill, fill opacity and stroke per layer.

    The stroke runs from red to blue by the layer's index; monochrome layers are not filled.
    """
    order = Window.partitionBy("grid_id").orderBy("elevation")
    whole = Window.partitionBy("grid_id")
    lo, hi = F.min("elevation").over(whole), F.max("elevation").over(whole)
    t = (F.row_number().over(order) - 1) / F.greatest(F.count(F.lit(1)).over(whole) - 1, F.lit(1)).cast("double")
    ranged = layers.select("*", t.alias("_t"), lo.alias("_lo"), hi.alias("_hi"))
    stroke = F.concat(
        F.lit("#"), hex_pair(((1.0 - F.col("_t")) * 255).cast("int")), F.lit("00"), hex_pair((F.col("_t") * 255).cast("int"))
    )
    if mode == "monochrome":
        fill, opacity = F.lit("none"), F.lit(1.0)
    elif mode in FILL_OPACITY:
        fill = hex_from_bytes(color_rgb(F.col("elevation"), F.col("_lo"), F.col("_hi"), scheme))
        opacity = F.lit(FILL_OPACITY[mode])
    else:
        raise ValueError(f"unknown render mode {mode!r}")
    return ranged.select(
        *layers.columns, fill.alias("fill"), opacity.alias("fill_opacity"), stroke.alias("stroke")
    )
