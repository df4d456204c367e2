"""Elevation grids as tables: import, mosaic, clip, cleaning, statistics, resampling, projection.

A grid table has one row per cell, `(grid_id, grid_row, grid_col, elev)`, voids being NULL. The
geometry table has one row per grid, `(grid_id, x0, dx, rx, y0, ry, dy, width, height)`, with
x = x0 + col*dx + row*rx and y = y0 + col*ry + row*dy.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from isoterra.spread import attach, cut

CELL = ["grid_id", "grid_row", "grid_col"]
GEOMETRY = ["x0", "dx", "rx", "y0", "ry", "dy"]

# Void marker limit, plausible elevation range, metres per degree.
VOID_LIMIT = -30000.0
LOWEST_ELEV, HIGHEST_ELEV = -500.0, 9000.0
EXTREME_ELEV = 10000.0
METRES_PER_DEGREE_LON, METRES_PER_DEGREE_LAT = 111320.0, 110540.0


def _finite(c: Column) -> Column:
    return ~F.isnan(c) & (F.abs(c) != F.lit(float("inf")))


def grid_from_table(
    df: DataFrame, row: str, col: str, elev: str, grid: str | Column = "grid_id", nodata: float = VOID_LIMIT
) -> DataFrame:
    """Any table with row, column and elevation as a grid; void markers and NaN become NULL."""
    value = F.col(elev).cast("float")
    return df.select(
        (F.col(grid) if isinstance(grid, str) else grid).alias("grid_id"),
        F.col(row).cast("int").alias("grid_row"),
        F.col(col).cast("int").alias("grid_col"),
        F.when((value > F.lit(nodata)) & ~F.isnan(value), value).alias("elev"),
    )


def clean_nonfinite(grid: DataFrame) -> DataFrame:
    """NaN and infinite elevations become voids."""
    return grid.withColumn("elev", F.when(_finite(F.col("elev")), F.col("elev")))


def _placed(grids: DataFrame) -> DataFrame:
    """Rectangles of tiles in a mosaic (grid_id, tile_order, _dr, _dc, _rows, _cols), counted in cells from its corner."""
    spans = [F.min("x0").alias("_west"), F.max("y0").alias("_north"), F.max("dx").alias("_dx"), F.max("dy").alias("_dy")]
    placed = attach(grids.withColumn("_all", F.lit(1)), grids.agg(*spans).withColumn("_all", F.lit(1)), ["_all"], ["grid_id"])

    def steps(distance: Column, size: str) -> Column:
        """Whole cells from the corner; tiles of other cell size or between the cells stop the job."""
        exact = distance / F.col(size)
        fits = (F.abs(F.col(size) - F.col(f"_{size}")) <= F.abs(F.col(size)) * 1e-6) & (F.abs(exact - F.round(exact)) <= 1e-3)
        return F.when(fits, F.round(exact).cast("int")).otherwise(F.raise_error(F.lit("tiles of a mosaic differ in cell size or alignment")))

    return placed.select(
        "grid_id",
        "tile_order",
        steps(F.col("y0") - F.col("_north"), "dy").alias("_dr"),
        steps(F.col("x0") - F.col("_west"), "dx").alias("_dc"),
        F.col("height").alias("_rows"),
        F.col("width").alias("_cols"),
    )


def seams(placed: DataFrame) -> DataFrame:
    """Per tile the rectangles, in its own rows and columns, that it shares with other tiles.

    Tiles meet in squares as large as the largest tile, of which each touches at most four, so no tile
    is compared with all others.
    """
    side = placed.agg(F.max(F.greatest("_rows", "_cols", F.lit(1))).alias("_side")).withColumn("_all", F.lit(1))
    sized = attach(placed.withColumn("_all", F.lit(1)), side, ["_all"], ["grid_id"]).drop("_all")

    def squares(first: str, size: str) -> Column:
        last = F.col(first) + F.greatest(F.col(size), F.lit(1)) - 1
        return F.sequence(F.floor(F.col(first) / F.col("_side")), F.floor(last / F.col("_side")))

    spread = sized.withColumn("_bin_r", F.explode(squares("_dr", "_rows"))).withColumn("_bin_c", F.explode(squares("_dc", "_cols"))).drop("_side")
    other = spread.select("_bin_r", "_bin_c", *[F.col(c).alias(f"o{c}") for c in ("grid_id", "_dr", "_dc", "_rows", "_cols")])
    top, left = F.greatest("_dr", "o_dr"), F.greatest("_dc", "o_dc")
    bottom, right = F.least(F.col("_dr") + F.col("_rows"), F.col("o_dr") + F.col("o_rows")), F.least(F.col("_dc") + F.col("_cols"), F.col("o_dc") + F.col("o_cols"))
    shared = spread.join(other, ["_bin_r", "_bin_c"]).where((F.col("grid_id") != F.col("ogrid_id")) & (top < bottom) & (left < right))
    sides = [("top", top - F.col("_dr")), ("bottom", bottom - F.col("_dr")), ("left", left - F.col("_dc")), ("right", right - F.col("_dc"))]
    return shared.groupBy("grid_id").agg(F.collect_set(F.struct(*[c.alias(n) for n, c in sides])).alias("_seams"))


def mosaic(grid: DataFrame, grids: DataFrame, mosaic_id: str = "mosaic") -> DataFrame:
    """Put tiles into one grid; on overlap the tile with the greatest `tile_order` wins, voids never do.

    `grids` carries `tile_order` besides the geometry. All tiles must share cell size and alignment, else an
    error is raised; the mosaic starts at the north-west corner of all tiles.

    Only cells in the rectangles that tiles share, and any outside their tile, are shuffled and compared;
    all others keep their value and only move. The grid is read twice for this.
    """
    # One row per tile, read by the cells of both kinds.
    placed = _placed(grids)
    tiles = cut(placed.join(seams(placed).hint("merge"), "grid_id", "left"))
    cells = attach(grid, tiles, ["grid_id"], ["grid_row", "grid_col"])
    row, col = F.col("grid_row"), F.col("grid_col")
    inside = (row >= 0) & (row < F.col("_rows")) & (col >= 0) & (col < F.col("_cols"))
    in_seam = F.exists("_seams", lambda s: (row >= s["top"]) & (row < s["bottom"]) & (col >= s["left"]) & (col < s["right"]))
    # One expression that names the cell's own columns outside the function, so that it stays above the join.
    alone = F.when(inside, ~F.coalesce(in_seam, F.lit(False))).otherwise(F.lit(False))
    moved = [(row + F.col("_dr")).alias("grid_row"), (col + F.col("_dc")).alias("grid_col")]
    own = cells.where(alone).select(F.lit(mosaic_id).alias("grid_id"), *moved, "elev")
    # max_by skips rows whose ordering is NULL, so a void never covers a valid cell.
    winner = F.max_by("elev", F.when(F.col("elev").isNotNull(), F.col("tile_order"))).alias("elev")
    shared = cells.where(~alone).groupBy(*moved).agg(winner).select(F.lit(mosaic_id).alias("grid_id"), "grid_row", "grid_col", "elev")
    return own.unionByName(shared)


def mosaic_geometry(grids: DataFrame, mosaic_id: str = "mosaic") -> DataFrame:
    """Geometry row of the grid that `mosaic` produces."""
    west, north = F.min("x0"), F.max("y0")
    east = F.max(F.col("x0") + F.col("width") * F.col("dx"))
    south = F.min(F.col("y0") + F.col("height") * F.col("dy"))
    return grids.agg(
        west.alias("x0"),
        F.max("dx").alias("dx"),
        F.lit(0.0).alias("rx"),
        north.alias("y0"),
        F.lit(0.0).alias("ry"),
        F.max("dy").alias("dy"),
        F.round((east - west) / F.max("dx")).cast("int").alias("width"),
        F.round((south - north) / F.max("dy")).cast("int").alias("height"),
    ).select(F.lit(mosaic_id).alias("grid_id"), *GEOMETRY, "width", "height")


def clip_window(grids: DataFrame, min_x: float, min_y: float, max_x: float, max_y: float) -> DataFrame:
    """Pixel window of a box per grid: offsets clamp at 0, sizes at the raster; empty windows disappear."""
    left = (F.lit(min_x) - F.col("x0")) / F.col("dx")
    right = (F.lit(max_x) - F.col("x0")) / F.col("dx")
    top = (F.lit(max_y) - F.col("y0")) / F.col("dy")
    bottom = (F.lit(min_y) - F.col("y0")) / F.col("dy")
    col_off = F.greatest(F.lit(0), F.floor(F.least(left, right)).cast("int"))
    row_off = F.greatest(F.lit(0), F.floor(F.least(top, bottom)).cast("int"))
    windows = grids.select(
        "*",
        col_off.alias("col_off"),
        row_off.alias("row_off"),
        F.ceil(F.greatest(left, right)).cast("int").alias("_col_end"),
        F.ceil(F.greatest(top, bottom)).cast("int").alias("_row_end"),
    )
    return (
        windows.withColumn("col_count", F.least(F.col("_col_end"), F.col("width")) - F.col("col_off"))
        .withColumn("row_count", F.least(F.col("_row_end"), F.col("height")) - F.col("row_off"))
        .drop("_col_end", "_row_end")
        .where("col_count > 0 and row_count > 0")
    )


def clip(grid: DataFrame, grids: DataFrame, min_x: float, min_y: float, max_x: float, max_y: float) -> DataFrame:
    """Cells of the pixel window that covers a box, renumbered from 0; a filter and a projection only.

    The windows are computed first, from the one row per grid; their common range is a literal filter
    that reaches the scan, so a small box reads little of a large grid.
    """
    window = clip_window(grids, min_x, min_y, max_x, max_y).select(
        "grid_id", "col_off", "row_off", "col_count", "row_count"
    )
    ends = {"_top": F.min("row_off"), "_bottom": F.max(F.col("row_off") + F.col("row_count")), "_left": F.min("col_off"), "_right": F.max(F.col("col_off") + F.col("col_count"))}
    common = window.agg(*[c.alias(n) for n, c in ends.items()]).first()
    if common["_top"] is None:
        near = grid.where(F.lit(False))
    else:
        near = grid.where(F.col("grid_row").between(common["_top"], common["_bottom"] - 1) & F.col("grid_col").between(common["_left"], common["_right"] - 1))
    cells = attach(near, window, ["grid_id"], ["grid_row", "grid_col"])
    row, col = F.col("grid_row") - F.col("row_off"), F.col("grid_col") - F.col("col_off")
    return cells.where((row >= 0) & (row < F.col("row_count")) & (col >= 0) & (col < F.col("col_count"))).select(
        "grid_id", row.alias("grid_row"), col.alias("grid_col"), "elev"
    )


def clip_geometry(grids: DataFrame, min_x: float, min_y: float, max_x: float, max_y: float) -> DataFrame:
    """Geometry of the clipped grids: the origin moves to the window corner."""
    window = clip_window(grids, min_x, min_y, max_x, max_y)
    return window.select(
        "grid_id",
        (F.col("x0") + F.col("col_off") * F.col("dx") + F.col("row_off") * F.col("rx")).alias("x0"),
        "dx",
        "rx",
        (F.col("y0") + F.col("col_off") * F.col("ry") + F.col("row_off") * F.col("dy")).alias("y0"),
        "ry",
        "dy",
        F.col("col_count").alias("width"),
        F.col("row_count").alias("height"),
    )


def repair_outliers(grid: DataFrame, lo: float = LOWEST_ELEV, hi: float = HIGHEST_ELEV) -> DataFrame:
    """Replace values outside [lo, hi] by the median of the eight neighbours.

    Every value is read from the grid before any repair. A result outside the range, or a cell with
    no valid neighbour, becomes a void. Each outlier asks its eight neighbours by one equi-join, so
    only the outliers are multiplied; while they are few the grid is not even shuffled.
    """
    # Read three times, and filters would repeat the expressions of its elevations many times over: written once.
    grid = cut(grid)
    elev = F.col("elev").cast("double")
    outlier = elev.isNotNull() & ((elev < lo) | (elev > hi))
    offsets = F.array(
        *[F.struct(F.lit(r).alias("r"), F.lit(c).alias("c")) for r in (-1, 0, 1) for c in (-1, 0, 1) if r or c]
    )
    asked = (
        grid.where(outlier)
        .select("grid_id", F.col("grid_row").alias("_row"), F.col("grid_col").alias("_col"), F.explode(offsets).alias("_o"))
        .select(
            "grid_id",
            "_row",
            "_col",
            (F.col("_row") + F.col("_o.r")).alias("grid_row"),
            (F.col("_col") + F.col("_o.c")).alias("grid_col"),
        )
    )
    medians = (
        attach(grid.where(F.col("elev").isNotNull()), asked, CELL, None)
        .groupBy("grid_id", F.col("_row").alias("grid_row"), F.col("_col").alias("grid_col"))
        .agg(F.median(F.col("elev").cast("double")).alias("_median"))
        .where(F.col("_median").between(lo, hi))
    )
    return attach(grid, medians, CELL, None, "left").select(
        *CELL, F.when(outlier, F.col("_median").cast("float")).otherwise(F.col("elev")).alias("elev")
    )


def quality_report(raw: DataFrame, repaired: DataFrame, lo: float = LOWEST_ELEV, hi: float = HIGHEST_ELEV) -> DataFrame:
    """Cell counts and percentages per grid before and after repair; the gate fails above 50 % invalid.

    `raw` is the grid as scanned (NaN and infinity allowed), `repaired` the cleaned one.
    """
    value = F.col("elev").cast("double")
    good = value.isNotNull() & _finite(value)
    before = raw.groupBy("grid_id").agg(
        F.count(F.lit(1)).alias("total"),
        F.count_if(~F.coalesce(good, F.lit(False))).alias("invalid"),
        F.count_if(good & ((value < lo) | (value > hi))).alias("extreme"),
        F.count_if(good & value.between(lo, hi)).alias("_plausible"),
    )
    after = repaired.groupBy("grid_id").agg(F.count("elev").alias("_kept"))

    def share(c: str) -> Column:
        return F.round(F.col(c) * 100.0 / F.col("total"), 6)

    return (
        before.join(after, "grid_id", "left")
        .withColumn("repaired", F.coalesce(F.col("_kept"), F.lit(0)) - F.col("_plausible"))
        .select(
            "grid_id",
            "total",
            "invalid",
            "extreme",
            "repaired",
            share("invalid").alias("invalid_pct"),
            share("extreme").alias("extreme_pct"),
            share("repaired").alias("repaired_pct"),
            (share("invalid") <= 50.0).alias("usable"),
        )
    )


def elevation_range(grid: DataFrame) -> DataFrame:
    """Lowest and highest valid elevation per grid, (0, 0) when no cell is valid."""
    return grid.groupBy("grid_id").agg(
        F.coalesce(F.min("elev").cast("double"), F.lit(0.0)).alias("min_elev"),
        F.coalesce(F.max("elev").cast("double"), F.lit(0.0)).alias("max_elev"),
    )


def grid_diagnostics(grid: DataFrame) -> DataFrame:
    """Valid, void and extreme cell counts with the span of valid elevations, per grid."""
    value = F.col("elev").cast("double")
    return grid.groupBy("grid_id").agg(
        F.count("elev").alias("valid"),
        F.count_if(F.col("elev").isNull()).alias("voids"),
        F.count_if((value < -EXTREME_ELEV) | (value > EXTREME_ELEV)).alias("extreme"),
        F.min(value).alias("min_elev"),
        F.max(value).alias("max_elev"),
        (F.max(value) - F.min(value)).alias("span"),
    )


def level_diagnostics(grid: DataFrame, levels: DataFrame) -> DataFrame:
    """Per level: below, in or above the data range, and the number of valid cells under it.

    Cells are first counted per band between levels (one pass, partially aggregated); the counts
    under each level are a running sum over the few bands of a grid.
    """
    from isoterra.operators.levels import band_histogram

    # Read twice and usually derived from a grid: a few rows written spare a scan of it.
    levels = cut(levels)
    under = Window.partitionBy("grid_id").orderBy("level_index").rowsBetween(Window.unboundedPreceding, 0)
    spans = grid_diagnostics(grid).select("grid_id", "min_elev", "max_elev")
    # Band b lies directly under level b, so the bands 0..i hold the cells under level i.
    bands = band_histogram(grid, levels).withColumnRenamed("band", "level_index")
    counted = (
        levels.select("grid_id", "level_index", F.col("lower").alias("level"))
        .join(bands, ["grid_id", "level_index"], "full")
        .withColumn("cells_under", F.coalesce(F.sum("cells").over(under), F.lit(0)))
    )
    position = (
        F.when(F.col("level") < F.col("min_elev"), "below").when(F.col("level") > F.col("max_elev"), "above").otherwise("in")
    )
    return (
        counted.where(F.col("level").isNotNull())
        .join(spans, "grid_id", "left")
        .select("grid_id", "level_index", "level", position.alias("position"), "cells_under")
    )


def downsample(grid: DataFrame, grids: DataFrame, n: int) -> DataFrame:
    """Mean of the valid cells of every n x n block; incomplete blocks at the far edges are dropped."""
    sizes = grids.select("grid_id", F.expr(f"width div {n}").alias("_w"), F.expr(f"height div {n}").alias("_h"))
    row, col = F.expr(f"cast(grid_row div {n} as int)"), F.expr(f"cast(grid_col div {n} as int)")
    cells = attach(grid, sizes, ["grid_id"], ["grid_row", "grid_col"])
    return (
        cells.where((row < F.col("_h")) & (col < F.col("_w")))
        .groupBy("grid_id", row.alias("grid_row"), col.alias("grid_col"))
        .agg(F.avg(F.col("elev").cast("double")).cast("float").alias("elev"))
    )


def downsample_geometry(grids: DataFrame, n: int) -> DataFrame:
    """Geometry of the downsampled grids: sizes divided, steps multiplied by n."""
    steps = [(F.col(c) * n).alias(c) for c in ("dx", "rx")]
    return grids.select(
        "grid_id",
        "x0",
        *steps,
        "y0",
        (F.col("ry") * n).alias("ry"),
        (F.col("dy") * n).alias("dy"),
        F.expr(f"cast(width div {n} as int)").alias("width"),
        F.expr(f"cast(height div {n} as int)").alias("height"),
    )


def with_coords(df: DataFrame, grids: DataFrame, center: bool = False, row: str = "grid_row", col: str = "grid_col") -> DataFrame:
    """Add x, y of the cell corner, or of the cell centre."""
    placed = attach(df, grids.select("grid_id", *GEOMETRY), ["grid_id"], [row, col])
    half = 0.5 if center else 0.0
    r, c = F.col(row) + F.lit(half), F.col(col) + F.lit(half)
    return (
        placed.withColumn("x", F.col("x0") + c * F.col("dx") + r * F.col("rx"))
        .withColumn("y", F.col("y0") + c * F.col("ry") + r * F.col("dy"))
        .drop(*GEOMETRY)
    )


def beyond_degrees(x: Column, y: Column) -> Column:
    """Whether a position cannot be one in degrees."""
    return (F.abs(x) > 360.0) | (F.abs(y) > 180.0)


def local_metres(x: Column, y: Column, lon0: Column, lat0: Column) -> tuple[Column, Column]:
    """Metres east and north of a centre, from degrees."""
    return (x - lon0) * METRES_PER_DEGREE_LON * F.cos(F.radians(lat0)), (y - lat0) * METRES_PER_DEGREE_LAT


def project_local(
    df: DataFrame, lon0: Column | float, lat0: Column | float, x: str = "x", y: str = "y", by: Sequence[str] = ()
) -> DataFrame:
    """Degrees to metres about a centre, decided once for every set of rows with equal `by` columns.

    A set with any row that is no degrees (|x| > 360 or |y| > 180) is projected already and stays as it is,
    its rows near the origin included. The sets are told apart by one aggregate with a row per set.
    """
    lon0 = lon0 if isinstance(lon0, Column) else F.lit(lon0)
    lat0 = lat0 if isinstance(lat0, Column) else F.lit(lat0)
    beyond = F.max(beyond_degrees(F.col(x), F.col(y))).alias("_projected")
    keys = list(by) or ["_all"]
    rows = df if by else df.withColumn("_all", F.lit(1))
    marked = attach(rows, rows.groupBy(*keys).agg(beyond), keys, [x, y])
    east, north = local_metres(F.col(x), F.col(y), lon0, lat0)
    moved = marked.withColumns({x: F.when(F.col("_projected"), F.col(x)).otherwise(east), y: F.when(F.col("_projected"), F.col(y)).otherwise(north)})
    return moved.select(*df.columns)
