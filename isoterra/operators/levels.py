"""Contour levels and cumulative layer membership.

`levels` is `(grid_id, level_index, lower, upper)`: one row per layer, ascending; `upper` of the
last row is the top level, which bounds no layer. Layers are cumulative: a cell belongs to every
layer whose lower level it reaches.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from isoterra.operators.grid import CELL
from isoterra.spread import attach, cut

# Fallback half range, tolerance of an inserted level, smallest layer area.
FALLBACK_HALF_RANGE = 50.0
SAME_LEVEL = 1e-6
EMPTY_AREA = 1e-12
STRATEGIES = ("uniform", "logarithmic", "exponential")


def _spaced(lo: Column, hi: Column, count: Column, i: Column, strategy: str) -> Column:
    """The i-th of count+1 levels between lo and hi."""
    if strategy == "uniform":
        return lo + i * ((hi - lo) / count)
    if strategy == "logarithmic":
        start, end = F.ln(F.greatest(lo, F.lit(1.0))), F.ln(F.greatest(hi, lo + 1.0))
        return F.exp(start + i * ((end - start) / count))
    if strategy == "exponential":
        return lo + (F.exp(i / count * 2.0) - 1.0) / (F.exp(F.lit(2.0)) - 1.0) * (hi - lo)
    raise ValueError(f"strategy must be one of {STRATEGIES}, got {strategy!r}")


def _as_layers(points: DataFrame) -> DataFrame:
    """Sorted level values (grid_id, value) to rows (grid_id, level_index, lower, upper)."""
    order = Window.partitionBy("grid_id").orderBy("value")
    return (
        points.select(
            "grid_id",
            (F.row_number().over(order) - 1).alias("level_index"),
            F.col("value").alias("lower"),
            F.lead("value").over(order).alias("upper"),
        )
        .where(F.col("upper").isNotNull())
    )


def contour_level_values(
    ranges: DataFrame,
    n: int | None = None,
    interval: float | None = None,
    strategy: str = "uniform",
    min_elev: float | None = None,
    max_elev: float | None = None,
    threshold: float = 0.0,
    fixed: float | None = None,
) -> DataFrame:
    """Level values (grid_id, value) for the elevation range of every grid.

    The range is narrowed by min/max elevation and by the threshold (positive: up from the lowest
    point, negative: down from the highest). An empty range becomes the middle +- 50. The count is n,
    or as many steps of `interval` as the range needs.
    """
    low, high = F.col("min_elev"), F.col("max_elev")
    lo = low if min_elev is None else F.greatest(low, F.lit(float(min_elev)))
    hi = high if max_elev is None else F.least(high, F.lit(float(max_elev)))
    if threshold > 0:
        hi = F.least(hi, low + threshold)
    elif threshold < 0:
        lo = F.greatest(lo, high + threshold)
    middle = (low + high) / 2.0
    empty = lo >= hi
    bounds = ranges.select(
        "grid_id",
        F.when(empty, middle - FALLBACK_HALF_RANGE).otherwise(lo).alias("_lo"),
        F.when(empty, middle + FALLBACK_HALF_RANGE).otherwise(hi).alias("_hi"),
    )
    if n is not None and n > 0:
        count = F.lit(n)
    elif interval is not None and interval > 0:
        count = F.ceil((F.col("_hi") - F.col("_lo")) / F.lit(float(interval))).cast("int")
    else:
        raise ValueError("give a layer count n or a positive interval")
    steps = bounds.withColumn("_n", count).withColumn("_i", F.explode(F.sequence(F.lit(0), F.col("_n"))))
    values = steps.select(
        "grid_id", _spaced(F.col("_lo"), F.col("_hi"), F.col("_n"), F.col("_i"), strategy).alias("value")
    )
    if fixed is None:
        return values
    # The fixed level is added once per grid unless some level is already within the tolerance.
    near = F.abs(F.col("value") - F.lit(float(fixed))) < SAME_LEVEL
    missing = values.groupBy("grid_id").agg(F.count_if(near).alias("_near")).where("_near = 0")
    return values.unionByName(missing.select("grid_id", F.lit(float(fixed)).alias("value")))


def contour_levels(ranges: DataFrame, n: int | None = None, interval: float | None = None, **options) -> DataFrame:
    """Layers (grid_id, level_index, lower, upper); options as in `contour_level_values`."""
    return _as_layers(contour_level_values(ranges, n, interval, **options))


def plain_levels(ranges: DataFrame, n: int, strategy: str = "uniform") -> DataFrame:
    """Level values (grid_id, level_index, value) over the plain range; a flat grid has one level."""
    low, high = F.col("min_elev"), F.col("max_elev")
    steps = ranges.withColumn("level_index", F.explode(F.sequence(F.lit(0), F.when(low == high, 0).otherwise(n))))
    spaced = _spaced(low, high, F.lit(n), F.col("level_index"), strategy)
    return steps.select("grid_id", "level_index", F.when(low == high, low).otherwise(spaced).alias("value"))


def _floors(levels: DataFrame) -> DataFrame:
    """(grid_id, _floors): the lower bounds of a grid with their layers, ascending; as many as the grid has levels."""
    return levels.groupBy("grid_id").agg(F.array_sort(F.collect_list(F.struct("lower", F.col("level_index").alias("layer")))).alias("_floors"))


def reached(elev: Column, floors: Column) -> Column:
    """How many of the ascending `floors` (structs with `lower`) an elevation reaches, by bisection."""

    def halve(state: Column, _: Column) -> Column:
        low, high = state["low"], state["high"]
        middle = F.floor((low + high) / 2).cast("int")
        over = (low < high) & (F.get(floors, middle)["lower"] <= state["elev"])
        return F.struct(
            F.when(over, middle + 1).otherwise(low).alias("low"),
            F.when(over | (low >= high), high).otherwise(middle).alias("high"),
            state["elev"].alias("elev"),
        )

    # The elevation is part of the state: the optimizer does not see columns that only the function names, and
    # would move a filter on the result to the side of a join that lacks it.
    start = F.struct(F.lit(0).alias("low"), F.size(floors).alias("high"), elev.alias("elev"))
    rounds = F.sequence(F.lit(0), F.ceil(F.log2(F.size(floors) + F.lit(1))).cast("int"))
    return F.aggregate(rounds, start, halve, lambda s: s["low"])


def banded_cells(grid: DataFrame, levels: DataFrame) -> DataFrame:
    """Each valid finite cell with its band = number of layers it belongs to (one output row per cell).

    The levels of a grid come along as one sorted array, in which a cell finds its band by bisection, so
    a thousand levels cost a few steps more than seven.
    """
    elev = F.col("elev").cast("double")
    cells = grid.where(F.col("elev").isNotNull() & ~F.isnan("elev") & (elev < float("inf")))
    found = attach(cells, _floors(levels), ["grid_id"], ["grid_row", "grid_col"])
    return found.withColumn("band", reached(elev, F.col("_floors"))).drop("_floors")


def band_histogram(grid: DataFrame, levels: DataFrame) -> DataFrame:
    """Valid cells per band, the partially aggregated heart of every per-layer count."""
    return banded_cells(grid, levels).groupBy("grid_id", "band").agg(F.count(F.lit(1)).alias("cells"))


def layer_cells(grid: DataFrame, levels: DataFrame) -> DataFrame:
    """Membership rows (grid_id, layer, grid_row, grid_col); layer i holds every cell with elev >= level i."""
    elev = F.col("elev").cast("double")
    found = attach(grid.where(F.col("elev").isNotNull()), _floors(levels), ["grid_id"], ["grid_row", "grid_col"])
    layers = F.slice("_floors", F.lit(1), reached(elev, F.col("_floors")))
    return found.select("grid_id", F.explode(layers["layer"]).alias("layer"), "grid_row", "grid_col")


def layer_counts(grid: DataFrame, levels: DataFrame) -> DataFrame:
    """Cells and share of valid cells at or above each level.

    One pass over the grid: cells are counted per disjoint band, then summed from the top over the
    few bands of a grid, instead of one scan or one exploded copy per layer.
    """
    # Read twice and usually derived from the grid itself: a few rows written spare a scan of it.
    levels = cut(levels)
    return counted_layers(levels, band_histogram(grid, levels))


def counted_layers(levels: DataFrame, counts: DataFrame) -> DataFrame:
    """Cells and share at or above each level from the cells per band (grid_id, band, cells)."""
    rows = levels.select("grid_id", (F.col("level_index") + 1).alias("band"), "lower").join(
        counts, ["grid_id", "band"], "full"
    )
    from_top = Window.partitionBy("grid_id").orderBy(F.desc("band"))
    whole = Window.partitionBy("grid_id")
    cells = F.coalesce(F.col("cells"), F.lit(0))
    return (
        rows.select("grid_id", "band", "lower", F.sum(cells).over(from_top).alias("cells"), F.sum(cells).over(whole).alias("_all"))
        .where("band > 0")
        .select(
            "grid_id",
            (F.col("band") - 1).alias("layer"),
            F.col("lower").alias("elevation"),
            "cells",
            F.round(F.try_divide(F.col("cells"), F.col("_all")), 6).alias("share"),
        )
    )


def drop_empty(layers: DataFrame) -> DataFrame:
    """Keep layers with a polygon and an area, numbered 1.. from the lowest per grid."""
    order = Window.partitionBy("grid_id").orderBy("elevation")
    kept = layers.where((F.col("polygons") > 0) & (F.col("area") >= EMPTY_AREA))
    return kept.withColumn("layer_number", F.row_number().over(order))


def parse_layer_list(text: Column) -> Column:
    """`3,4,5-7,11` to a sorted array of distinct numbers; parts that are no number or range are skipped."""

    def numbers(part: Column) -> Column:
        part = F.trim(part)
        first = F.regexp_extract(part, r"^\s*([+-]?\d+)", 1).try_cast("int")
        dash = F.regexp_extract(part, r"^\s*(\d+)[^-]*-", 1).try_cast("int")
        end = F.regexp_extract(part, r"^[^-]*-\s*([+-]?\d+)", 1).try_cast("int")
        # A part with a dash is a range, so a leading minus makes it a bad one.
        is_range = F.contains(part, F.lit("-"))
        span = F.when(dash <= end, F.sequence(dash, end))
        single = F.when(first.isNotNull(), F.array(first))
        return F.coalesce(F.when(is_range, span).otherwise(single), F.array().cast("array<int>"))

    return F.array_sort(F.array_distinct(F.flatten(F.transform(F.split(text, ","), numbers))))


def select_layers(layers: DataFrame, wanted: str, number: str = "layer_number") -> DataFrame:
    """Keep the listed layers; the whole range stays in `range_min`, `range_max` for colouring."""
    whole = Window.partitionBy("grid_id")
    return (
        layers.withColumn("range_min", F.min("elevation").over(whole))
        .withColumn("range_max", F.max("elevation").over(whole))
        .where(F.array_contains(parse_layer_list(F.lit(wanted)), F.col(number)))
    )


def layer_slabs(layers: DataFrame, min_elev: float | Column, max_elev: float | Column, laser_mm: float | None = None) -> DataFrame:
    """Bottom and top of every layer's solid.

    Terrain mode: from the layer's own height over `min_elev` to the next layer's, the last one
    range/count high; a slab that would be flat gets 0.1. Laser mode: equal sheets of `laser_mm`.
    """
    order = Window.partitionBy("grid_id").orderBy("elevation")
    index = F.row_number().over(order) - 1
    if laser_mm is not None:
        return layers.withColumn("_i", index).select(
            *layers.columns, (F.col("_i") * laser_mm).alias("z_base"), ((F.col("_i") + 1) * laser_mm).alias("z_top")
        )
    lo = min_elev if isinstance(min_elev, Column) else F.lit(float(min_elev))
    hi = max_elev if isinstance(max_elev, Column) else F.lit(float(max_elev))
    base = F.col("elevation") - lo
    count = F.count(F.lit(1)).over(Window.partitionBy("grid_id"))
    top = F.coalesce(F.lead("elevation").over(order) - lo, base + (hi - lo) / count)
    spans = layers.select("*", base.alias("z_base"), top.alias("_top"))
    return spans.withColumn(
        "z_top", F.when(F.col("_top") <= F.col("z_base"), F.col("z_base") + 0.1).otherwise(F.col("_top"))
    ).drop("_top")

