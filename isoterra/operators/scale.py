"""Print scale (mm per metre), bed fit and job checks over a table of jobs.

A job row has: xy_extent, z_extent (metres, z may be NULL), num_layers, layer_thickness_mm,
substrate_size_mm, substrate_depth_mm, bed_size_mm, bed_x_mm, bed_y_mm, method_2d, method_3d,
explicit_2d, explicit_3d, use_3d_for_2d, use_2d_for_3d. Everything is column arithmetic on that row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Share of the bed that is used, slack of the depth check, method names.
BED_SHARE = 0.9
DEPTH_SLACK_MM = 0.01
AUTO, BED, THICKNESS, LAYERS, EXPLICIT, HEIGHT, UNIFORM = (
    "AUTO",
    "BED_SIZE",
    "MATERIAL_THICKNESS",
    "LAYERS",
    "EXPLICIT",
    "PRINT_HEIGHT",
    "UNIFORM_XYZ",
)


def bed_size() -> Column:
    """Single bed size, else the smaller side, else the substrate size."""
    sides = F.when(
        F.col("bed_x_mm").isNotNull() & F.col("bed_y_mm").isNotNull(), F.least(F.col("bed_x_mm"), F.col("bed_y_mm"))
    )
    return F.coalesce(F.col("bed_size_mm"), sides, F.col("substrate_size_mm")).cast("double")


def _method_2d(z_known: Column) -> Column:
    """The method that is really used for flat output."""
    asked, depth = F.col("method_2d"), F.col("substrate_depth_mm").isNotNull()
    by_layers = F.when(depth, LAYERS).otherwise(THICKNESS)
    automatic = (
        F.when(F.col("explicit_2d").isNotNull(), EXPLICIT).when(z_known, by_layers).otherwise(BED)
    )
    return (
        F.when(asked == AUTO, automatic)
        .when(asked == EXPLICIT, EXPLICIT)
        .when((asked == THICKNESS) & z_known, THICKNESS)
        .when((asked == LAYERS) & z_known, by_layers)
        .otherwise(BED)
    )


def _method_3d() -> Column:
    """The method that is really used for solid output."""
    asked, depth = F.col("method_3d"), F.col("substrate_depth_mm").isNotNull()
    automatic = F.when(F.col("explicit_3d").isNotNull(), EXPLICIT).when(depth, HEIGHT).otherwise(BED)
    return (
        F.when(asked == AUTO, automatic)
        .when(asked == EXPLICIT, EXPLICIT)
        .when(asked.isin(HEIGHT, UNIFORM, LAYERS) & depth, HEIGHT)
        .otherwise(BED)
    )


def _factor(method: Column, explicit: str, z: Column) -> Column:
    """Millimetres per metre of a method; an explicit method without a factor stops the job."""
    given = F.when(
        F.col(explicit).isNull(), F.raise_error(F.lit(f"method EXPLICIT needs {explicit}")).cast("double")
    ).otherwise(F.col(explicit).cast("double"))
    return (
        F.when(method == EXPLICIT, given)
        .when(method.isin(LAYERS, HEIGHT), F.try_divide(F.col("substrate_depth_mm").cast("double"), z))
        .when(method == THICKNESS, F.try_divide((F.col("num_layers") * F.col("layer_thickness_mm")).cast("double"), z))
        .otherwise(F.try_divide(bed_size() * BED_SHARE, F.col("xy_extent")))
    )


def _flat(z: Column) -> tuple[Column, Column]:
    method = _method_2d(z.isNotNull())
    return method, _factor(method, "explicit_2d", z)


def _solid(z: Column) -> tuple[Column, Column]:
    method = _method_3d()
    return method, _factor(method, "explicit_3d", z)


def _both_ways() -> Column:
    return F.coalesce(F.col("use_3d_for_2d") & F.col("use_2d_for_3d"), F.lit(False))


def _with_scale(jobs: DataFrame, own, other, other_asked: str) -> DataFrame:
    swap = F.coalesce(F.col(other_asked), F.lit(False))
    circular = F.raise_error(F.lit("2-D and 3-D scaling refer to each other"))
    method = F.when(_both_ways(), circular.cast("string")).when(swap, other[0]).otherwise(own[0])
    scale = F.when(_both_ways(), circular.cast("double")).when(swap, other[1]).otherwise(own[1])
    return jobs.withColumn("method", method).withColumn("mm_per_m", scale)


def scale_2d(jobs: DataFrame) -> DataFrame:
    """Add `method` and `mm_per_m` for flat output."""
    z = F.col("z_extent").cast("double")
    return _with_scale(jobs, _flat(z), _solid(F.coalesce(z, F.lit(0.0))), "use_3d_for_2d")


def scale_3d(jobs: DataFrame) -> DataFrame:
    """Add `method` and `mm_per_m` for solid output."""
    z = F.col("z_extent").cast("double")
    return _with_scale(jobs, _solid(z), _flat(z), "use_2d_for_3d")


def bed_fit(scaled: DataFrame) -> DataFrame:
    """Add the bed size, the printed extent and whether it fits, to jobs with `mm_per_m`."""
    printed = F.col("xy_extent") * F.col("mm_per_m")
    return (
        scaled.withColumn("bed_mm", bed_size())
        .withColumn("printed_mm", printed)
        .withColumn("fits", F.col("printed_mm") <= F.col("bed_mm"))
    )


def validate_jobs(jobs: DataFrame) -> DataFrame:
    """Jobs whose layers are thicker than the substrate, with three ways out."""
    total = F.col("num_layers") * F.col("layer_thickness_mm").cast("double")
    depth = F.col("substrate_depth_mm").cast("double")
    return jobs.where(total > depth + DEPTH_SLACK_MM).withColumns(
        {
            "total_mm": total,
            "suggested_layers": F.try_divide(depth, F.col("layer_thickness_mm")).cast("int"),
            "suggested_thickness_mm": F.try_divide(depth, F.col("num_layers")),
            "suggested_depth_mm": total,
        }
    )
