"""Pixels from layers: frames, coordinate conversion, filling, outlines.

A frame is one row per grid: (grid_id, width_px, height_px, margin_px, min_x, min_y, max_x, max_y,
origin_x, origin_y, pixel_w, pixel_h).
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from isoterra.functions.color import color_rgb
from isoterra.operators.grid import GEOMETRY
from isoterra.operators.polygons import with_next
from isoterra.spread import attach, lookup

# Fixed value: metres per degree used for the aspect of an image.
METRES_PER_DEGREE = 111000.0
BOX = ["min_x", "min_y", "max_x", "max_y"]


def raster_frame(bounds: DataFrame, width_px: int, margin_px: int = 0, height_px: int | None = None) -> DataFrame:
    """Image size and pixel geometry of a box; the height follows the aspect at the middle latitude."""
    wide, high = F.col("max_x") - F.col("min_x"), F.col("max_y") - F.col("min_y")
    middle = (F.col("min_y") + F.col("max_y")) / 2.0
    aspect = (high * METRES_PER_DEGREE) / (wide * METRES_PER_DEGREE * F.cos(F.radians(middle)))
    height = F.lit(height_px) if height_px else (F.lit(width_px) * aspect).cast("int")
    sized = bounds.withColumns(
        {"width_px": F.lit(width_px), "height_px": height.cast("int"), "margin_px": F.lit(margin_px)}
    ).withColumns({"pixel_w": wide / (width_px - 2 * margin_px), "pixel_h": high / (F.col("height_px") - 2 * margin_px)})
    return sized.withColumns(
        {
            "origin_x": F.col("min_x") - margin_px * F.col("pixel_w"),
            "origin_y": F.col("max_y") + margin_px * F.col("pixel_h"),
        }
    )


def _pixel(x: Column, y: Column) -> tuple[Column, Column]:
    inner_w = F.col("width_px") - 2 * F.col("margin_px")
    inner_h = F.col("height_px") - 2 * F.col("margin_px")
    across = (x - F.col("min_x")) / (F.col("max_x") - F.col("min_x"))
    up = (y - F.col("min_y")) / (F.col("max_y") - F.col("min_y"))
    px = (F.col("margin_px") + across * inner_w).cast("int")
    py = (F.col("margin_px") + (1.0 - up) * inner_h).cast("int")
    zero = F.lit(0)
    return (
        F.greatest(zero, F.least(F.col("width_px") - 1, px)),
        F.greatest(zero, F.least(F.col("height_px") - 1, py)),
    )


def geo_to_pixel(df: DataFrame, frame: DataFrame, x: str = "x", y: str = "y", key: str = "grid_id") -> DataFrame:
    """Add px, py of map coordinates: normalised, inside the margin, y flipped, truncated, clamped."""
    size = ["width_px", "height_px", "margin_px"]
    placed = attach(df, frame.select(key, *BOX, *size), [key], [x, y])
    px, py = _pixel(F.col(x), F.col(y))
    return placed.withColumns({"px": px, "py": py}).drop(*BOX, *size)


def box_to_pixel(boxes: DataFrame, frame: DataFrame, key: str = "grid_id") -> DataFrame:
    """Add the pixel corners of boxes (min_x..max_y): px0, py0 top left, px1, py1 bottom right."""
    named = boxes.select(*[F.col(c).alias(f"_{c}") if c in BOX else F.col(c) for c in boxes.columns])
    size = ["width_px", "height_px", "margin_px"]
    placed = attach(named, frame.select(key, *BOX, *size), [key], ["_min_x", "_min_y"])
    left, top = _pixel(F.col("_min_x"), F.col("_max_y"))
    right, bottom = _pixel(F.col("_max_x"), F.col("_min_y"))
    others = [c for c in boxes.columns if c not in BOX]
    return placed.select(
        *others,
        *[F.col(f"_{c}").alias(c) for c in BOX],
        left.alias("px0"),
        top.alias("py0"),
        right.alias("px1"),
        bottom.alias("py1"),
    )


def filled_cells(ring_points: DataFrame, grids: DataFrame) -> DataFrame:
    """Cells inside the exterior rings, enclosed holes included, (grid_id, layer, grid_row, grid_col).

    Each row of cells is swept along the upright ring edges that cross it: an edge going up opens a
    stretch, one going down closes it. A sweep group is one row of one layer.
    """
    edges = attach(
        with_next(ring_points.where("ring_id = 0")), grids.select("grid_id", *GEOMETRY), ["grid_id"], ["polygon_id", "seq"]
    )
    size = F.col("dx") * F.col("dy") - F.col("rx") * F.col("ry")

    def place(x: str, y: str) -> tuple[Column, Column]:
        ex, ey = F.col(x) - F.col("x0"), F.col(y) - F.col("y0")
        row = (ey * F.col("dx") - ex * F.col("ry")) / size
        col = (ex * F.col("dy") - ey * F.col("rx")) / size
        return F.round(row).cast("int"), F.round(col).cast("int")

    (row, col), (next_row, next_col) = place("x", "y"), place("next_x", "next_y")
    upright = edges.select(
        "grid_id", "layer", row.alias("_r0"), next_row.alias("_r1"), col.alias("_c"), next_col.alias("_c1")
    ).where("_c = _c1 and _r0 != _r1")
    crossings = (
        upright.withColumn("grid_row", F.explode(F.sequence(F.least("_r0", "_r1"), F.greatest("_r0", "_r1") - 1)))
        .groupBy("grid_id", "layer", "grid_row", "_c")
        .agg(F.sum(F.when(F.col("_r1") < F.col("_r0"), 1).otherwise(-1)).alias("_turn"))
    )
    sweep = Window.partitionBy("grid_id", "layer", "grid_row").orderBy("_c")
    return (
        crossings.withColumns({"_depth": F.sum("_turn").over(sweep), "_end": F.lead("_c").over(sweep)})
        .where("_depth > 0")
        .select("grid_id", "layer", "grid_row", F.explode(F.sequence(F.col("_c"), F.col("_end") - 1)).alias("grid_col"))
    )


def _cell_of() -> tuple[Column, Column]:
    """Row and column of the cell that holds the centre of pixel (px, py), from frame and grid geometry in the row."""
    ex = F.col("origin_x") + (F.col("px") + 0.5) * F.col("pixel_w") - F.col("x0")
    ey = F.col("origin_y") - (F.col("py") + 0.5) * F.col("pixel_h") - F.col("y0")
    size = F.col("dx") * F.col("dy") - F.col("rx") * F.col("ry")
    # A grid that is not turned divides once: products would round a centre on a border into the cell before.
    turned = (F.col("rx") != 0) | (F.col("ry") != 0)
    row = F.when(turned, (ey * F.col("dx") - ex * F.col("ry")) / size).otherwise(ey / F.col("dy"))
    col = F.when(turned, (ex * F.col("dy") - ey * F.col("rx")) / size).otherwise(ex / F.col("dx"))
    return F.floor(row), F.floor(col)


def cell_pixels(cells: DataFrame, grids: DataFrame, frame: DataFrame) -> DataFrame:
    """The cells with the pixels (px, py) whose centres they hold; a pixel has at most one cell of a grid.

    Every cell computes the rectangle of pixels around its own corners; most cells of a fine grid hold
    no pixel centre and end there. Nothing is shuffled, and no pixel asks for its cell.
    """
    of_frame = ["width_px", "height_px", "origin_x", "origin_y", "pixel_w", "pixel_h"]
    geometry = grids.select("grid_id", *GEOMETRY).join(frame.select("grid_id", *of_frame), "grid_id")
    placed = attach(cells, geometry, ["grid_id"], ["grid_row", "grid_col"])
    corners = [(F.col("grid_row") + r, F.col("grid_col") + c) for r in (0, 1) for c in (0, 1)]
    across = [(F.col("x0") + c * F.col("dx") + r * F.col("rx") - F.col("origin_x")) / F.col("pixel_w") - 0.5 for r, c in corners]
    down = [(F.col("origin_y") - F.col("y0") - c * F.col("ry") - r * F.col("dy")) / F.col("pixel_h") - 0.5 for r, c in corners]

    def span(ends: list[Column], size: str) -> Column:
        # A little wider than the cell; the exact test follows.
        first = F.greatest(F.ceil(F.least(*ends) - 1e-6), F.lit(0)).cast("int")
        last = F.least(F.floor(F.greatest(*ends) + 1e-6), F.col(size) - 1).cast("int")
        return F.when(first <= last, F.sequence(first, last)).otherwise(F.array().cast("array<int>"))

    near = placed.withColumn("px", F.explode(span(across, "width_px"))).withColumn("py", F.explode(span(down, "height_px")))
    row, col = _cell_of()
    return near.where((row == F.col("grid_row")) & (col == F.col("grid_col"))).select(*cells.columns, "px", "py")


def _pixels(frame: DataFrame, *carried: str) -> DataFrame:
    """All pixels of the frames; rows of pixels are spread over the cluster before columns are made."""
    rows = frame.withColumn("py", F.explode(F.sequence(F.lit(0), F.col("height_px") - 1)))
    spread = rows.repartition("grid_id", *carried, "py").withColumn("px", F.explode(F.sequence(F.lit(0), F.col("width_px") - 1)))
    return spread.select("grid_id", *carried, "px", "py")


def layer_colors(layers: DataFrame, scheme: str | list[tuple] = "terrain") -> DataFrame:
    """(grid_id, layer, _c): the colour of every layer in the range of all given layers of its grid."""
    whole = layers.groupBy("grid_id").agg(F.min("elevation").alias("_lo"), F.max("elevation").alias("_hi"))
    ranged = layers.select("grid_id", "layer", "elevation").join(whole, "grid_id")
    return ranged.select("grid_id", "layer", color_rgb(F.col("elevation"), F.col("_lo"), F.col("_hi"), scheme).alias("_c"))


def _painted(background: tuple[int, int, int, int]) -> list[Column]:
    channels = [F.coalesce(F.col(f"_c.{c}"), F.lit(v)).alias(c) for c, v in zip("rgb", background)]
    return [*channels, F.when(F.col("_c").isNotNull(), 255).otherwise(F.lit(background[3])).alias("a")]


def rasterize(
    cells: DataFrame,
    layers: DataFrame,
    grids: DataFrame,
    frame: DataFrame,
    scheme: str | list[tuple] = "terrain",
    mode: str = "full_color",
    background: tuple[int, int, int, int] = (255, 255, 255, 255),
) -> DataFrame:
    """Pixels (grid_id, px, py, r, g, b, a): the highest layer under each pixel centre, else background.

    `cells` are layer members (see `filled_cells` for layers without holes) or, one row per cell, those of
    `banded_cells`, whose highest layer is their band less one. Cells are turned into pixels where they are;
    only those are shuffled. The colour range is that of all given layers. A monochrome image is background only.
    """
    pixels = _pixels(frame)
    if mode == "monochrome":
        return pixels.select("grid_id", "px", "py", *[F.lit(v).alias(c) for c, v in zip("rgba", background)])
    if "band" in cells.columns:
        cells = cells.where("band > 0").withColumn("layer", F.col("band") - 1)
    held = cell_pixels(cells.select("grid_id", "grid_row", "grid_col", "layer"), grids, frame)
    top = held.groupBy("grid_id", "px", "py").agg(F.max("layer").alias("layer"))
    found = lookup(pixels, top, ["grid_id", "px", "py"], "left")
    painted = attach(found, layer_colors(layers, scheme), ["grid_id", "layer"], ["px", "py"], "left")
    return painted.select("grid_id", "px", "py", *_painted(background))


def layer_images(
    cells: DataFrame,
    layers: DataFrame,
    grids: DataFrame,
    frame: DataFrame,
    scheme: str | list[tuple] = "terrain",
    background: tuple[int, int, int, int] = (255, 255, 255, 255),
    outlines: DataFrame | None = None,
    stroke: tuple[int, int, int] = (0, 0, 0),
) -> DataFrame:
    """One image per layer, pixels (grid_id, layer, px, py, r, g, b, a): the layer's cells in its colour, else background.

    Colours come from the range of all layers, so the images match each other. `cells` are as in
    `rasterize`; rows of `outline_pixels` are drawn on top in the colour of the stroke.
    """
    if "band" in cells.columns:
        held = cell_pixels(cells.where("band > 0").select("grid_id", "grid_row", "grid_col", "band"), grids, frame)
        # A pixel belongs to all layers up to its band; only pixels are multiplied.
        held = held.select("grid_id", F.explode(F.sequence(F.lit(0), F.col("band") - 1)).alias("layer"), "px", "py")
    else:
        held = cell_pixels(cells.select("grid_id", "grid_row", "grid_col", "layer"), grids, frame).select("grid_id", "layer", "px", "py")
    colors = layer_colors(layers, scheme)
    sheets = frame.join(colors.select("grid_id", "layer"), "grid_id")
    marked = held.withColumn("_held", F.lit(True))
    found = lookup(_pixels(sheets, "layer"), marked, ["grid_id", "layer", "px", "py"], "left")
    painted = attach(found, colors, ["grid_id", "layer"], ["px", "py"], "left")
    painted = painted.withColumn("_c", F.when(F.col("_held"), F.col("_c")))
    if outlines is not None:
        drawn = outlines.select("grid_id", "layer", "px", "py").distinct().withColumn("_drawn", F.lit(True))
        ink = F.struct(*[F.lit(v).cast("int").alias(c) for c, v in zip("rgb", stroke)])
        kept = [F.col(f"_c.{c}").cast("int").alias(c) for c in "rgb"]
        painted = lookup(painted, drawn, ["grid_id", "layer", "px", "py"], "left")
        painted = painted.withColumn("_c", F.when(F.col("_drawn"), ink).when(F.col("_c").isNotNull(), F.struct(*kept)))
    return painted.select("grid_id", "layer", "px", "py", *_painted(background))


def _lines(pdf: pd.DataFrame) -> pd.DataFrame:
    """All pixels of the lines (px, py) - (qx, qy), every line advanced one step at a time."""
    x, y, ex, ey = (pdf[c].to_numpy().astype(np.int64) for c in ("px", "py", "qx", "qy"))
    row = np.arange(len(pdf))
    dx, dy = np.abs(ex - x), np.abs(ey - y)
    sx, sy = np.where(x < ex, 1, -1), np.where(y < ey, 1, -1)
    error = dx - dy
    picked = []
    while len(row):
        picked.append((row, x, y))
        going = (x != ex) | (y != ey)
        row, x, y, ex, ey, dx, dy, sx, sy, error = (
            v[going] for v in (row, x, y, ex, ey, dx, dy, sx, sy, error)
        )
        across, down = 2 * error > -dy, 2 * error < dx
        error = error - np.where(across, dy, 0) + np.where(down, dx, 0)
        x, y = x + np.where(across, sx, 0), y + np.where(down, sy, 0)
    index, px, py = (np.concatenate([p[i] for p in picked]) for i in range(3))
    drawn = pdf.iloc[index][["grid_id", "layer", "width_px", "height_px"]]
    return drawn.assign(px=px.astype(np.int32), py=py.astype(np.int32))


# Lines drawn together by one task; bounds its memory.
LINES_AT_ONCE = 2000


def _draw(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in frames:
        for at in range(0, len(pdf), LINES_AT_ONCE):
            yield _lines(pdf.iloc[at : at + LINES_AT_ONCE]).drop_duplicates()


# Rows of pixels that are painted together; a task holds one such band of one image.
BAND = 256
_OUTLINE = "grid_id string, layer int, px int, py int"


def _widened(marked: np.ndarray, reach: int, axis: int) -> np.ndarray:
    """Marks spread by `reach` both ways along an axis; the result lacks the frame of `reach` at both ends."""
    size = marked.shape[axis] - 2 * reach
    spread = [np.take(marked, range(k, k + size), axis) for k in range(2 * reach + 1)]
    return np.logical_or.reduce(spread)


def _painter(reach: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Paints rows sorted by (grid_id, layer, band): pixels are marked in the image of their band as they come."""

    def finished(key: tuple, marked: np.ndarray, height: int) -> pa.RecordBatch:
        grid, layer, band = key
        rows, px = np.nonzero(_widened(_widened(marked, reach, 0), reach, 1))
        inside = rows + band * BAND < height
        rows, px = rows[inside], px[inside]
        columns = [pa.repeat(pa.scalar(grid, pa.string()), len(px)), pa.repeat(pa.scalar(layer, pa.int32()), len(px))]
        columns += [pa.array(px.astype(np.int32)), pa.array((rows + band * BAND).astype(np.int32))]
        return pa.RecordBatch.from_arrays(columns, names=["grid_id", "layer", "px", "py"])

    def paint(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, marked, height = None, None, 0
        for batch in batches:
            if not batch.num_rows:
                continue
            layer, band, px, py = (batch.column(c).to_numpy() for c in ("layer", "band", "px", "py"))
            grid = batch.column("grid_id")
            other = pc.not_equal(grid[1:], grid[:-1]).to_numpy(zero_copy_only=False).astype(bool)
            starts = np.r_[0, np.flatnonzero(other | (np.diff(layer) != 0) | (np.diff(band) != 0)) + 1, len(px)]
            for begin, end in zip(starts[:-1].tolist(), starts[1:].tolist()):
                here = grid[begin].as_py(), int(layer[begin]), int(band[begin])
                if here != key:
                    if key is not None:
                        yield finished(key, marked, height)
                    key, height = here, batch.column("height_px")[begin].as_py()
                    marked = np.zeros((BAND + 2 * reach, batch.column("width_px")[begin].as_py() + 2 * reach), dtype=bool)
                marked[py[begin:end] - here[2] * BAND + reach, px[begin:end] + reach] = True
        if key is not None:
            yield finished(key, marked, height)

    return paint


def outline_pixels(ring_points: DataFrame, frame: DataFrame, width: float = 1.0) -> DataFrame:
    """Distinct pixels (grid_id, layer, px, py) of all exterior ring edges, drawn with a square brush.

    The brush reaches int(width / 2) pixels each way; pixels outside the image are dropped.
    """
    edges = with_next(ring_points.where("ring_id = 0"))
    starts = geo_to_pixel(edges, frame)
    size = ["width_px", "height_px", "margin_px"]
    placed = attach(starts, frame.select("grid_id", *BOX, *size), ["grid_id"], ["px", "py"])
    qx, qy = _pixel(F.col("next_x"), F.col("next_y"))
    lines = placed.select(
        "grid_id", F.col("layer").cast("int").alias("layer"), "width_px", "height_px", "px", "py", qx.alias("qx"), qy.alias("qy")
    )
    # Many edges of a fine outline fall on the same pixels; draw each line once.
    drawn = lines.distinct().mapInPandas(_draw, "grid_id string, layer int, width_px int, height_px int, px int, py int")
    reach = int(width / 2.0)
    # A pixel goes to the band of rows it lies in and to those its brush reaches into; nothing is multiplied by the brush.
    bands = F.sequence(F.expr(f"greatest(py - {reach}, 0) div {BAND}"), F.expr(f"least(py + {reach}, height_px - 1) div {BAND}"))
    dealt = drawn.withColumn("band", F.explode(bands)).repartition("grid_id", "layer", "band")
    return dealt.sortWithinPartitions("grid_id", "layer", "band").mapInArrow(_painter(reach), _OUTLINE)
