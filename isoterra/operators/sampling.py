"""Elevation at points: bilinear lookup, regular sampling, sphere normalisation."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from isoterra.operators.grid import CELL, GEOMETRY
from isoterra.spread import attach, lookup

# Samples per side of the sampling presets, share of the size the sphere may fill.
PRESETS = {"draft": 50, "medium": 100, "high": 200, "ultra": 400}
SPHERE_SHARE = 0.9


def _corner_values(base: DataFrame, grid: DataFrame) -> DataFrame:
    """Elevations z00, z01, z10, z11 (row, column offsets) of distinct base cells."""
    offsets = F.array(*[F.struct(F.lit(r).alias("r"), F.lit(c).alias("c")) for r in (0, 1) for c in (0, 1)])
    asked = base.select("grid_id", "base_row", "base_col", F.explode(offsets).alias("_o")).select(
        "grid_id",
        "base_row",
        "base_col",
        (F.col("base_row") + F.col("_o.r")).alias("grid_row"),
        (F.col("base_col") + F.col("_o.c")).alias("grid_col"),
    )
    found = attach(grid.where(F.col("elev").isNotNull()), asked, CELL, None)

    def corner(r: int, c: int):
        here = (F.col("grid_row") - F.col("base_row") == r) & (F.col("grid_col") - F.col("base_col") == c)
        return F.max(F.when(here, F.col("elev").cast("double"))).alias(f"z{r}{c}")

    return found.groupBy("grid_id", "base_row", "base_col").agg(*[corner(r, c) for r in (0, 1) for c in (0, 1)])


def sample_bilinear(points: DataFrame, grid: DataFrame, grids: DataFrame) -> DataFrame:
    """Add `elev` to points `(grid_id, x, y, ...)`.

    Inside four valid cells the value is bilinear; with a void corner it is the nearest cell's; a
    point outside the raster has none. The distinct cells the points fall in are looked up once, and
    the four values are then joined back with hot cells salted, however many points share a cell.
    """
    frame = grids.select("grid_id", *GEOMETRY, "width", "height")
    own = points.columns
    placed = (
        attach(points, frame, ["grid_id"], ["x", "y"], "left")
        .withColumn("_px", (F.col("x") - F.col("x0")) / F.col("dx"))
        .withColumn("_py", (F.col("y") - F.col("y0")) / F.col("dy"))
    )
    inside = (
        (F.col("_px") >= 0)
        & (F.col("_px") < F.col("width") - 1)
        & (F.col("_py") >= 0)
        & (F.col("_py") < F.col("height") - 1)
    )
    based = placed.select(
        *own,
        "_px",
        "_py",
        F.when(inside, F.floor("_py")).cast("int").alias("base_row"),
        F.when(inside, F.floor("_px")).cast("int").alias("base_col"),
    )
    base = based.where(F.col("base_row").isNotNull()).select("grid_id", "base_row", "base_col").distinct()
    corners = _corner_values(base, grid)
    valued = lookup(based, corners, ["grid_id", "base_row", "base_col"], "left")
    fx, fy = F.col("_px") - F.col("base_col"), F.col("_py") - F.col("base_row")
    bilinear = (
        F.col("z00") * (1 - fx) * (1 - fy)
        + F.col("z01") * fx * (1 - fy)
        + F.col("z10") * (1 - fx) * fy
        + F.col("z11") * fx * fy
    )
    # Rounding half away from zero: a fraction of one half belongs to the next cell.
    nearest = F.when(fy >= 0.5, F.when(fx >= 0.5, F.col("z11")).otherwise(F.col("z10"))).otherwise(
        F.when(fx >= 0.5, F.col("z01")).otherwise(F.col("z00"))
    )
    return valued.select(*own, F.coalesce(bilinear, nearest).alias("elev"))


def sample_points(
    grids: DataFrame, min_x: float, min_y: float, max_x: float, max_y: float, nx: int, ny: int
) -> DataFrame:
    """Regular points from the minimum corner, the far edges excluded.

    Rows are spread over the cluster before the columns are made, so a fine lattice is no single task.
    """
    rows = grids.select("grid_id", F.explode(F.sequence(F.lit(0), F.lit(ny - 1))).alias("iy"))
    if nx * ny > 1_000_000:
        rows = rows.repartition("grid_id", "iy")
    lattice = rows.withColumn("ix", F.explode(F.sequence(F.lit(0), F.lit(nx - 1))))
    return lattice.select(
        "grid_id",
        "ix",
        "iy",
        (F.lit(float(min_x)) + F.col("ix") * ((max_x - min_x) / nx)).alias("x"),
        (F.lit(float(min_y)) + F.col("iy") * ((max_y - min_y) / ny)).alias("y"),
    )


def sample_grid(
    grid: DataFrame, grids: DataFrame, bbox: tuple[float, float, float, float], nx: int, ny: int | None = None
) -> DataFrame:
    """Elevations on a regular lattice over a box (min_x, min_y, max_x, max_y); voids are dropped."""
    points = sample_points(grids, *bbox, nx, ny or nx)
    return sample_bilinear(points, grid, grids).where(F.col("elev").isNotNull())


def fit_bounding_sphere(
    points: DataFrame, size_mm: float, min_elev: float | None = None, max_elev: float | None = None
) -> DataFrame:
    """Keep points in the elevation window and scale each grid to a sphere of 0.9 size_mm.

    Centred in x and y on the box, lowest point at z = 0, millimetres out.
    """
    kept = points
    if min_elev is not None:
        kept = kept.where(F.col("z") >= min_elev)
    if max_elev is not None:
        kept = kept.where(F.col("z") <= max_elev)
    spans = [F.max(c) - F.min(c) for c in "xyz"]
    diagonal = F.sqrt(sum((s * s for s in spans[1:]), spans[0] * spans[0]))
    frame = kept.groupBy("grid_id").agg(
        F.try_divide(F.lit(SPHERE_SHARE * size_mm / 1000.0), diagonal).alias("_scale"),
        ((F.min("x") + F.max("x")) / 2.0).alias("_cx"),
        ((F.min("y") + F.max("y")) / 2.0).alias("_cy"),
        F.min("z").alias("_z0"),
    )
    moved = attach(kept, frame, ["grid_id"], ["x", "y"])
    factor = F.col("_scale") * 1000.0
    return moved.withColumns(
        {
            "x": (F.col("x") - F.col("_cx")) * factor,
            "y": (F.col("y") - F.col("_cy")) * factor,
            "z": (F.col("z") - F.col("_z0")) * factor,
        }
    ).drop("_scale", "_cx", "_cy", "_z0")
