"""Rings and polygons: metrics, statistics, bounds, thinning, canvas fitting.

`ring_points` is (grid_id, layer, polygon_id, ring_id, seq, x, y) with seq 0..n-1 per ring and no
repeated closing point; ring 0 is the exterior. One ring may hold a large part of all points, so
nothing here gathers a ring in one task: rings are cut into blocks of consecutive points.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from isoterra.spread import BLOCK, attach, cut, discard

POLYGON = ["grid_id", "layer", "polygon_id"]
RING = [*POLYGON, "ring_id"]

# Smallest ring, smallest span of a box and its padding, limits of the complexity gate.
MIN_RING = 3
MIN_SPAN, PADDING = 1e-6, 0.5
WARN_VERTICES, REJECT_VERTICES = 1_000_000, 10_000_000


def with_next(points: DataFrame, block: int = BLOCK) -> DataFrame:
    """Add next_x, next_y of every point, the last one meeting the first.

    The first point of a block also goes to the block before it, the first of a ring also behind its
    last, so a window over one block is enough.
    """
    own = F.expr(f"seq div {block}")
    first_of_block = (F.col("seq") % block == 0) & (F.col("seq") > 0)
    blocks = F.when(first_of_block, F.array(own, own - 1)).otherwise(F.array(own))
    columns = points.columns
    inner = points.withColumn("_block", F.explode(blocks)).withColumn("_own", F.col("_block") == own)
    sizes = points.groupBy(*RING).agg(F.count(F.lit(1)).alias("_n"))
    closing = (
        points.where("seq = 0")
        .join(sizes, RING)
        .withColumns({"seq": F.col("_n"), "_block": F.expr(f"(_n - 1) div {block}"), "_own": F.lit(False)})
        .drop("_n")
    )
    along = Window.partitionBy(*RING, "_block").orderBy("seq")
    return (
        inner.unionByName(closing)
        .withColumns({"next_x": F.lead("x").over(along), "next_y": F.lead("y").over(along)})
        .where("_own")
        .select(*columns, "next_x", "next_y")
    )


def renumber(points: DataFrame, smallest: int = MIN_RING, block: int = BLOCK) -> DataFrame:
    """Close the gaps in seq and drop rings with fewer than `smallest` points.

    Only the point counts per block are summed along a ring; points are numbered inside their block.
    """
    blocked = points.withColumn("_block", F.expr(f"seq div {block}"))
    ring = Window.partitionBy(*RING)
    before = ring.orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    counts = blocked.groupBy(*RING, "_block").agg(F.count(F.lit(1)).alias("_n"))
    offsets = counts.select(
        *RING, "_block", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_offset"), F.sum("_n").over(ring).alias("_all")
    ).where(F.col("_all") >= smallest)
    inside = Window.partitionBy(*RING, "_block").orderBy("seq")
    return (
        blocked.join(offsets, [*RING, "_block"])
        .withColumn("seq", F.col("_offset") + F.row_number().over(inside) - 1)
        .select(*points.columns)
    )


def dedup_ring(points: DataFrame, tol: float) -> DataFrame:
    """Drop points closer than tol to the next point of the original ring, and rings that get too small."""
    dx, dy = F.col("next_x") - F.col("x"), F.col("next_y") - F.col("y")
    kept = with_next(points).where(dx * dx + dy * dy >= tol * tol)
    return renumber(kept.select(*points.columns))


# Points looked at one by one before the search goes on in growing stretches.
_NEAR = 8


def _walk(x: np.ndarray, y: np.ndarray, tol: float, ax: float, ay: float) -> tuple[np.ndarray, float, float]:
    """Keep points at least tol from the last kept one; (ax, ay) is the last kept before, NaN = none.

    From a kept point the next one is sought ahead: the first few points one by one, then stretches that
    double, each compared at once. So dense points cost a vector operation and not a step each.
    """
    keep = np.zeros(len(x), dtype=bool)
    limit, count, at = tol * tol, len(x), 0
    near_x, near_y = x.tolist(), y.tolist()
    while at < count:
        found, stop = -1, min(at + _NEAR, count)
        for i in range(at, stop):
            dx, dy = near_x[i] - ax, near_y[i] - ay
            # Written so that a missing anchor (NaN) keeps the point.
            if not dx * dx + dy * dy < limit:
                found = i
                break
        size = 4 * _NEAR
        while found < 0 and stop < count:
            dx, dy = x[stop : stop + size] - ax, y[stop : stop + size] - ay
            far = ~(dx * dx + dy * dy < limit)
            first = int(far.argmax())
            if far[first]:
                found = stop + first
            stop, size = stop + size, size * 2
        if found < 0:
            break
        keep[found], ax, ay = True, near_x[found], near_y[found]
        at = found + 1
    return keep, ax, ay


def _whole_blocks(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[tuple[pa.Table, np.ndarray]]:
    """Sorted rows as tables of whole blocks with the place where each block starts, and the end; a block is never divided."""

    def starts_of(table: pa.Table) -> np.ndarray:
        differs = np.zeros(max(0, table.num_rows - 1), dtype=bool)
        for key in keys:
            column = table.column(key).combine_chunks()
            differs |= pc.not_equal(column[1:], column[:-1]).fill_null(True).to_numpy(zero_copy_only=False)
        return np.r_[0, np.flatnonzero(differs) + 1]

    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        table = pa.Table.from_batches([*held, batch])
        starts = starts_of(table)
        # The last block may go on in the next batch.
        if len(starts) > 1:
            yield table.slice(0, int(starts[-1])), starts
        held = table.slice(int(starts[-1])).combine_chunks().to_batches()
    if held:
        table = pa.Table.from_batches(held)
        yield table, np.array([0, table.num_rows])


def _block_arrays(table: pa.Table, starts: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, float, float]]:
    """Points and entry (x, y, ax, ay) of every block."""
    x, y, ax, ay = (table.column(c).to_numpy() for c in ("x", "y", "_ax", "_ay"))
    for begin, end in zip(starts[:-1].tolist(), starts[1:].tolist()):
        yield x[begin:end], y[begin:end], float(ax[begin]), float(ay[begin])


def decimate_ring(points: DataFrame, tol: float, block: int = BLOCK) -> DataFrame:
    """Walk every ring and keep a point when it is at least tol from the last kept one.

    The walk depends on what was kept before, so blocks of a long ring first guess that nothing was,
    then take the last kept point of the block before them until no such point changes. A round walks
    only the blocks whose entry has changed; the exits of all others stand. Block 0 is right at once and
    every round settles at least one more block, so the result is exact; usually blocks agree after a
    round or two.
    """
    keys = [*RING, "_block"]
    columns = points.columns
    blocked = cut(points.withColumn("_block", F.expr(f"seq div {block}")))
    key_type = ", ".join(f"{c} {blocked.schema[c].dataType.simpleString()}" for c in keys)
    schema = ", ".join(f"{c} {points.schema[c].dataType.simpleString()}" for c in columns)
    nothing = F.lit(float("nan"))

    def in_blocks(rows: DataFrame, walk, result: str) -> DataFrame:
        # Blocks lie one after the other in sorted partitions: small rings cost no group of their own.
        return rows.repartition(*keys).sortWithinPartitions(*keys, "seq").mapInArrow(walk, result)

    def walk_ends(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table, starts in _whole_blocks(batches, keys):
            ends = [_walk(x, y, tol, ax, ay)[1:] for x, y, ax, ay in _block_arrays(table, starts)]
            firsts = table.select(keys).take(pa.array(starts[:-1]))
            found = firsts.append_column("_ex", pa.array([e[0] for e in ends], pa.float64()))
            yield from found.append_column("_ey", pa.array([e[1] for e in ends], pa.float64())).to_batches()

    def walk_all(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table, starts in _whole_blocks(batches, keys):
            keep = np.concatenate([_walk(x, y, tol, ax, ay)[0] for x, y, ax, ay in _block_arrays(table, starts)])
            yield from table.select(columns).filter(pa.array(keep)).to_batches()

    several = blocked.where("_block > 0").select(*RING).distinct()
    if several.limit(1).count():
        # Rings of one block are right already; only the others take part in the rounds.
        long_rings = cut(blocked.join(several, RING, "left_semi"))
        # Entry (_ax, _ay) and exit (_ex, _ey) of every block; a new entry has to be walked.
        states = cut(
            long_rings.select(*keys).distinct().select(*keys, *[nothing.alias(c) for c in ("_ax", "_ay", "_ex", "_ey")], F.lit(True).alias("_new"))
        )
        while True:
            changed = states.where("_new").select(*keys, "_ax", "_ay")
            walked = in_blocks(long_rings.join(changed, keys), walk_ends, f"{key_type}, _ex double, _ey double")
            ended = states.drop("_ex", "_ey", "_new").join(
                walked.unionByName(states.where("not _new").select(*keys, "_ex", "_ey")), keys
            )
            ended = cut(ended)
            handed = ended.select(*RING, (F.col("_block") + 1).alias("_block"), F.col("_ex").alias("_bx"), F.col("_ey").alias("_by"))
            # NaN equals NaN in Spark, so a block that still has no anchor counts as settled.
            moved = F.coalesce((F.col("_bx") != F.col("_ax")) | (F.col("_by") != F.col("_ay")), F.lit(False))
            updated = cut(
                ended.join(handed, keys, "left").select(
                    *keys, F.coalesce("_bx", "_ax").alias("_ax"), F.coalesce("_by", "_ay").alias("_ay"), "_ex", "_ey", moved.alias("_new")
                )
            )
            settled = not updated.where("_new").limit(1).count()
            discard(states)
            discard(ended)
            states = updated
            if settled:
                break
        entered = blocked.join(states.select(*keys, "_ax", "_ay"), keys, "left").fillna(float("nan"), ["_ax", "_ay"])
    else:
        entered = blocked.select("*", nothing.alias("_ax"), nothing.alias("_ay"))
    return renumber(in_blocks(entered, walk_all, schema))


def ring_metrics(points: DataFrame) -> DataFrame:
    """Signed doubled area, length and point count per ring, combined from its edges before the shuffle."""
    x, y, nx, ny = (F.col(c) for c in ("x", "y", "next_x", "next_y"))
    dx, dy = nx - x, ny - y
    return with_next(points).groupBy(*RING).agg(
        F.sum(x * ny - nx * y).alias("twice_area"),
        F.sum(F.sqrt(dx * dx + dy * dy)).alias("length"),
        F.count(F.lit(1)).alias("points"),
    )


def polygon_metrics(points: DataFrame) -> DataFrame:
    """Area without holes, exterior area and perimeter, vertex and hole counts per polygon.

    Vertex counts include the repeated closing point of each ring, as exported rings have it.
    """
    exterior = F.col("ring_id") == 0
    size = F.abs(F.col("twice_area")) / 2.0
    return ring_metrics(points).groupBy(*POLYGON).agg(
        (F.sum(F.when(exterior, size).otherwise(0.0)) - F.sum(F.when(exterior, 0.0).otherwise(size))).alias("area"),
        F.sum(F.when(exterior, size).otherwise(0.0)).alias("exterior_area"),
        F.sum(F.when(exterior, F.col("length")).otherwise(0.0)).alias("perimeter"),
        F.sum(F.col("points") + 1).alias("vertices"),
        F.sum(F.when(exterior, F.col("points") + 1).otherwise(0)).alias("exterior_vertices"),
        F.count_if(~exterior).alias("holes"),
    )


def layer_stats(metrics: DataFrame) -> DataFrame:
    """Polygon statistics per layer and, with layer NULL, per grid; input is `polygon_metrics`."""
    return (
        metrics.rollup("grid_id", "layer")
        .agg(
            F.count(F.lit(1)).alias("polygons"),
            F.sum("vertices").alias("vertices"),
            F.sum("holes").alias("holes"),
            F.sum("area").alias("area"),
            F.min("exterior_vertices").alias("min_vertices"),
            F.max("exterior_vertices").alias("max_vertices"),
            F.floor(F.avg("exterior_vertices")).alias("avg_vertices"),
            F.count_if(F.col("exterior_vertices") < MIN_RING).alias("degenerate"),
        )
        .where("grid_id is not null")
    )


def layer_table(metrics: DataFrame, levels: DataFrame) -> DataFrame:
    """Layers with elevation, polygon count and area, the input of numbering, slabs and styles."""
    sums = metrics.groupBy("grid_id", "layer").agg(
        F.count(F.lit(1)).alias("polygons"), F.sum("area").alias("area"), F.sum("vertices").alias("vertices")
    )
    heights = levels.select("grid_id", F.col("level_index").alias("layer"), F.col("lower").alias("elevation"))
    return heights.join(sums, ["grid_id", "layer"], "left").fillna({"polygons": 0, "area": 0.0, "vertices": 0})


def complexity_gate(points: DataFrame) -> DataFrame:
    """Total ring vertices per grid and whether they pass, warn or are rejected."""
    per_ring = points.groupBy(*RING).agg((F.count(F.lit(1)) + 1).alias("_n"))
    total = per_ring.groupBy("grid_id").agg(F.sum("_n").alias("vertices"))
    verdict = F.when(F.col("vertices") > REJECT_VERTICES, "reject").when(F.col("vertices") > WARN_VERTICES, "warn")
    return total.withColumn("verdict", verdict.otherwise("pass"))


def polygon_bounds(points: DataFrame, keys: list[str]) -> DataFrame:
    """Box of all rings per key; a side shorter than 1e-6 is padded by 0.5 both ways."""
    box = points.groupBy(*keys).agg(
        F.min("x").alias("_x0"), F.min("y").alias("_y0"), F.max("x").alias("_x1"), F.max("y").alias("_y1")
    )

    def padded(low: str, high: str) -> tuple[Column, Column]:
        narrow = F.col(high) - F.col(low) < MIN_SPAN
        grow = F.when(narrow, PADDING).otherwise(0.0)
        return F.col(low) - grow, F.col(high) + grow

    (x0, x1), (y0, y1) = padded("_x0", "_x1"), padded("_y0", "_y1")
    return box.select(*keys, x0.alias("min_x"), y0.alias("min_y"), x1.alias("max_x"), y1.alias("max_y"))


def largest_polygon(metrics: DataFrame) -> DataFrame:
    """Polygon with the largest exterior area per layer; the lowest id wins ties."""
    best = F.max_by("polygon_id", F.struct("exterior_area", -F.col("polygon_id")))
    return metrics.groupBy("grid_id", "layer").agg(
        best.alias("polygon_id"), F.max("exterior_area").alias("exterior_area")
    )


def canvas(bounds: DataFrame, width_mm: float, margin_mm: float, center: bool = True) -> DataFrame:
    """Canvas of a box: height from its aspect, scale = the tighter axis, offsets of the content."""
    wide, high = F.col("max_x") - F.col("min_x"), F.col("max_y") - F.col("min_y")
    room = width_mm - 2 * margin_mm
    sized = bounds.withColumn("height_mm", F.lit(room) * (high / wide) + 2 * margin_mm).withColumn("width_mm", F.lit(width_mm))
    scaled = sized.withColumn("scale", F.least(F.lit(room) / wide, (F.col("height_mm") - 2 * margin_mm) / high))
    if center:
        offsets = (F.col("width_mm") - wide * F.col("scale")) / 2.0, (F.col("height_mm") - high * F.col("scale")) / 2.0
    else:
        offsets = F.lit(margin_mm), F.lit(margin_mm)
    return scaled.withColumns({"offset_x": offsets[0], "offset_y": offsets[1]})


def fit_canvas(
    points: DataFrame, bounds: DataFrame, width_mm: float, margin_mm: float, center: bool = True, key: str = "grid_id"
) -> DataFrame:
    """Ring points in canvas millimetres, y downwards; the box of `bounds` fits inside the margins."""
    frame = canvas(bounds, width_mm, margin_mm, center).select(
        key, F.col("min_x").alias("_x"), F.col("min_y").alias("_y"), "height_mm", "scale", "offset_x", "offset_y"
    )
    placed = attach(points, frame, [key], ["polygon_id", "seq"])
    x = (F.col("x") - F.col("_x")) * F.col("scale") + F.col("offset_x")
    y = F.col("height_mm") - ((F.col("y") - F.col("_y")) * F.col("scale") + F.col("offset_y"))
    return placed.withColumns({"x": x, "y": y}).select(*points.columns)
