"""Masks of layers: boundary sides, inset between layers, connected areas.

A mask is `(grid_id, layer, grid_row, grid_col)`, one row per member cell.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from isoterra.operators.levels import banded_cells
from isoterra.spread import attach, cut, discard, lookup

MASK = ["grid_id", "layer", "grid_row", "grid_col"]
# Cells per side of a chunk that one task labels; a chunk never holds more than CHUNK * CHUNK cells.
CHUNK = 256
# Links between chunk areas up to this count are merged by one task per layer; above, by rounds of joins.
FINISH_ROWS = 500_000
# A cell as one number that sorts by row, then column.
_CODE = 1 << 31

# Fixed value: metres per degree used to turn an inset into pixels.
INSET_METRES_PER_DEGREE = 111000.0


def _open_sides(cells: DataFrame, line: str, along: str, before: str, after: str, block: int) -> DataFrame:
    """Mark for every cell whether its neighbours before and after it on a line are missing.

    A line is cut into blocks with one cell of overlap, so no window group outgrows a block.
    """
    own = F.expr(f"cast({along} div {block} as int)")
    spread = (
        F.when((F.col(along) % block == 0) & (F.col(along) > 0), F.array(own, own - 1))
        .when(F.col(along) % block == block - 1, F.array(own, own + 1))
        .otherwise(F.array(own))
    )
    order = Window.partitionBy("grid_id", "layer", line, "_block").orderBy(along)
    return (
        cells.withColumn("_block", F.explode(spread))
        .withColumns(
            {
                before: F.coalesce(F.lag(along).over(order) != F.col(along) - 1, F.lit(True)),
                after: F.coalesce(F.lead(along).over(order) != F.col(along) + 1, F.lit(True)),
            }
        )
        .where(F.col("_block") == own)
        .drop("_block")
    )


def boundary_sides(cells: DataFrame, block: int = 4096) -> DataFrame:
    """Sides of member cells that face no member; `side` is 0 north, 1 east, 2 south, 3 west.

    Keeps all columns. Two shuffles of the mask, one by row and one by column, whatever its shape.
    """
    across = _open_sides(cells, "grid_row", "grid_col", "_w", "_e", block)
    both = _open_sides(across, "grid_col", "grid_row", "_n", "_s", block)
    sides = F.filter(
        F.array(*[F.when(F.col(c), F.lit(k)) for k, c in enumerate(("_n", "_e", "_s", "_w"))]), lambda s: s.isNotNull()
    )
    return both.where("_n or _e or _s or _w").withColumn("side", F.explode(sides)).drop("_n", "_e", "_s", "_w")


def inset_radius(offset_mm: float) -> Column:
    """Inset in whole pixels, at least one, from the column step in degrees."""
    pixel_m = F.abs(F.col("dx")) * INSET_METRES_PER_DEGREE
    return F.greatest(F.lit(1), F.ceil(F.lit(offset_mm / 1000.0) / pixel_m).cast("int"))


def _reached_by_disc(pdf: pd.DataFrame) -> np.ndarray:
    """Whether each own cell of a chunk survives the erosion of the chunk's other cells, which come with a margin of the radius."""
    own = pdf["_own"].to_numpy()
    stays = np.zeros(len(pdf), dtype=bool)
    if own.all() or not own.any():
        return stays
    row, col = (pdf[c].to_numpy().astype(np.int64) for c in ("grid_row", "grid_col"))
    r, width, height = (int(pdf[c].to_numpy()[~own][0]) for c in ("_r", "width", "height"))
    top, left = row[own].min() - r, col[own].min() - r
    rows, cols = row[own].max() - top + 1 + r, col[own].max() - left + 1 + r
    free = np.ones((rows, cols), dtype=np.int32)
    near = ~own & (row >= top) & (row < top + rows) & (col >= left) & (col < left + cols)
    free[row[near] - top, col[near] - left] = 0
    # Free cells to the left of every place: a row of the disc holds none if two of these sums agree.
    before = np.pad(np.cumsum(free, axis=1), ((0, 0), (1, 0)))
    inner_rows, inner_cols = rows - 2 * r, cols - 2 * r
    hit = np.zeros((inner_rows, inner_cols), dtype=bool)
    for step in range(-r, r + 1):
        half = math.isqrt(r * r - step * step)
        line = before[r + step : r + step + inner_rows]
        hit |= line[:, r + half + 1 : r + half + 1 + inner_cols] != line[:, r - half : r - half + inner_cols]
    y, x = row[own], col[own]
    whole = (y >= r) & (y + r < height) & (x >= r) & (x + r < width)
    stays[own] = whole & ~hit[y - top - r, x - left - r]
    return stays


def _covered(cells: DataFrame, grids: DataFrame, offset_mm: float, above: int, covered: bool) -> DataFrame:
    """Cells that the erosion of the layer `above` theirs holds (`covered`), or those that it does not.

    One shuffle: a chunk gets its own cells, and the eroded layer's with a margin of the radius.
    """
    frame = grids.select("grid_id", inset_radius(offset_mm).alias("_r"), "width", "height")
    mask = cells.select(*MASK)
    chunk_of = [F.expr(f"cast(floor({c} / {CHUNK}) as int)") for c in ("grid_row", "grid_col")]
    own = mask.select(*MASK, *[c.alias(n) for c, n in zip(chunk_of, ("cr", "cc"))], F.lit(True).alias("_own"))
    own = own.withColumns({c: F.lit(0) for c in ("_r", "width", "height")})
    around = attach(mask, frame, ["grid_id"], ["grid_row", "grid_col"])
    for c, name in (("grid_row", "cr"), ("grid_col", "cc")):
        around = around.withColumn(name, F.explode(F.expr(f"sequence(cast(floor(({c} - _r) / {CHUNK}) as int), cast(floor(({c} + _r) / {CHUNK}) as int))")))
    around = around.withColumns({"layer": (F.col("layer") - above).cast(cells.schema["layer"].dataType), "_own": F.lit(False)})

    def chosen(pdf: pd.DataFrame) -> pd.DataFrame:
        stays = _reached_by_disc(pdf)
        return pdf.loc[pdf["_own"].to_numpy() & (stays if covered else ~stays), MASK]

    schema = ", ".join(f"{c} {cells.schema[c].dataType.simpleString()}" for c in MASK)
    return own.unionByName(around.select(*own.columns)).groupBy("grid_id", "layer", "cr", "cc").applyInPandas(chosen, schema)


def erode(cells: DataFrame, grids: DataFrame, offset_mm: float) -> DataFrame:
    """Members with no non-member within the inset radius and whose radius square stays on the raster."""
    return _covered(cells, grids, offset_mm, 0, True)


def inset_layers(cells: DataFrame, grids: DataFrame, offset_mm: float) -> DataFrame:
    """Each layer without the eroded layer above it; layers that lose every cell disappear."""
    return _covered(cells, grids, offset_mm, 1, False)


def _least_labels(mask: np.ndarray) -> np.ndarray:
    """8-connected labels of a 2-D mask: the least linear index of each area, -1 outside."""
    rows, cols = mask.shape
    none = rows * cols
    label = np.full((rows + 2, cols + 2), none, dtype=np.int64)
    inner = label[1:-1, 1:-1]
    inner[mask] = np.flatnonzero(mask)
    parent = np.arange(none + 1)
    members = np.flatnonzero(mask)
    while True:
        across = np.minimum(np.minimum(label[:, :-2], label[:, 1:-1]), label[:, 2:])
        around = np.minimum(np.minimum(across[:-2], across[1:-1]), across[2:])
        current = inner[mask]
        least = around[mask]
        if np.array_equal(current, least):
            break
        np.minimum.at(parent, current, least)
        while True:
            jumped = parent[parent]
            if np.array_equal(jumped, parent):
                break
            parent = jumped
        inner[mask] = parent[current]
    labels = np.full(none, -1, dtype=np.int64)
    labels[members] = inner[mask]
    return labels.reshape(rows, cols)


_RUNS = "grid_id string, layer int, grid_row int, c0 int, c1 int, local long, side int"
_RUN_COLUMNS = [c.split()[0] for c in _RUNS.split(", ")]
# `side` of a run of members; other runs are cells whose side 0 north, 1 east, 2 south, 3 west is open.
MEMBERS = -1


def _stretches(marked: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row, first and last column of every unbroken stretch of a row."""
    starts = marked & ~np.pad(marked, ((0, 0), (1, 0)))[:, :-1]
    ends = marked & ~np.pad(marked, ((0, 0), (0, 1)))[:, 1:]
    row, first = np.nonzero(starts)
    return row, first, np.nonzero(ends)[1]


def _runs_of(mask: np.ndarray, top: int, left: int) -> pd.DataFrame:
    """Runs of members and of open sides, with their area label, of a mask inside a one-cell frame."""
    inner = mask[1:-1, 1:-1]
    labels, width = _least_labels(inner), inner.shape[1]
    found = [(MEMBERS, *_stretches(inner))]
    for side, facing in ((0, mask[:-2, 1:-1]), (2, mask[2:, 1:-1])):
        found.append((side, *_stretches(inner & ~facing)))
    for side, facing in ((1, mask[1:-1, 2:]), (3, mask[1:-1, :-2])):
        row, col = np.nonzero(inner & ~facing)
        found.append((side, row, col, col))
    side = np.repeat([f[0] for f in found], [len(f[1]) for f in found])
    row, c0, c1 = (np.concatenate([f[i] for f in found]) for i in (1, 2, 3))
    # A stretch of one row lies in one area, so its first cell tells the label.
    label = labels[row, c0]
    local = (label // width + top).astype(np.int64) * _CODE + label % width + left
    return pd.DataFrame({"grid_row": row + top, "c0": c0 + left, "c1": c1 + left, "local": local, "side": side})


def _label_chunk(pdf: pd.DataFrame) -> pd.DataFrame:
    """Runs of one chunk for every layer its cells reach; `band` layers from `layer` upwards."""
    own = pdf["own"].to_numpy()
    if not own.any():
        return pd.DataFrame({c: pd.Series([], dtype=object) for c in _RUN_COLUMNS})
    row, col, band = (pdf[c].to_numpy() for c in ("grid_row", "grid_col", "band"))
    top, left = row[own].min(), col[own].min()
    reach = np.zeros((row[own].max() - top + 3, col[own].max() - left + 3), dtype=np.int32)
    # Frame cells beyond the own cells by more than one touch nothing of this chunk.
    near = (row >= top - 1) & (row - top + 1 < reach.shape[0]) & (col >= left - 1) & (col - left + 1 < reach.shape[1])
    reach[row[near] - top + 1, col[near] - left + 1] = band[near]
    base = int(pdf["layer"].iloc[0])
    parts = []
    for k in range(int(band[own].max())):
        parts.append(_runs_of(reach > k, top, left).assign(layer=base + k))
    return pd.concat(parts).assign(grid_id=pdf["grid_id"].iloc[0])[_RUN_COLUMNS]


def _chunked(banded: DataFrame, chunk: int) -> DataFrame:
    """Cells with their chunk; cells on a chunk border are also sent, as frame, to the side neighbours."""
    row, col = F.col("grid_row"), F.col("grid_col")
    cr, cc = F.expr(f"grid_row div {chunk}"), F.expr(f"grid_col div {chunk}")

    def beyond(c: Column) -> Column:
        at = c % chunk
        return F.when(at == 0, -1).when(at == chunk - 1, 1)

    def place(r: Column, c: Column, own: bool) -> Column:
        return F.struct(r.alias("r"), c.alias("c"), F.lit(own).alias("own"))

    up, across = beyond(row), beyond(col)
    targets = F.array(
        place(cr, cc, True),
        F.when(cr + up >= 0, place(cr + up, cc, False)),
        F.when(cc + across >= 0, place(cr, cc + across, False)),
    )
    placed = banded.withColumn("_k", F.explode(F.filter(targets, lambda t: t.isNotNull())))
    return placed.select("grid_id", "layer", "grid_row", "grid_col", "band", "_k.r", "_k.c", "_k.own")


def _links(runs: DataFrame, chunk: int) -> DataFrame:
    """Pairs of chunk areas that touch across a chunk border, (grid_id, layer, a, b) with a < b."""
    row, col = F.col("grid_row"), F.col("grid_col")
    border_row = (row % chunk).isin(0, chunk - 1)
    touches = border_row | (F.col("c0") % chunk == 0) | (F.col("c1") % chunk == chunk - 1)
    rim = (
        runs.where((F.col("side") == MEMBERS) & touches)
        .select("grid_id", "layer", "grid_row", "local", F.explode(F.sequence("c0", "c1")).alias("grid_col"))
        .where(border_row | (col % chunk).isin(0, chunk - 1))
    )
    ahead = F.array(*[F.struct(F.lit(r).alias("r"), F.lit(c).alias("c")) for r, c in ((0, 1), (1, -1), (1, 0), (1, 1))])

    def chunk_of(c: Column) -> Column:
        return F.floor(c / chunk)

    asked = (
        rim.withColumn("_o", F.explode(ahead))
        .where(
            (chunk_of(row + F.col("_o.r")) != chunk_of(row)) | (chunk_of(col + F.col("_o.c")) != chunk_of(col))
        )
        .select(
            "grid_id",
            "layer",
            (row + F.col("_o.r")).alias("grid_row"),
            (col + F.col("_o.c")).alias("grid_col"),
            F.col("local").alias("_from"),
        )
    )
    return (
        asked.join(rim, MASK)
        .select("grid_id", "layer", F.least("_from", "local").alias("a"), F.greatest("_from", "local").alias("b"))
        .distinct()
    )


_MERGED = "grid_id string, layer int, local long, root long"


def _merge_links(pdf: pd.DataFrame) -> pd.DataFrame:
    """Least member of every linked set of one layer; only for a checked number of links."""
    nodes, ends = np.unique(pdf[["a", "b"]].to_numpy().ravel(), return_inverse=True)
    a, b = ends.reshape(-1, 2).T
    parent = np.arange(len(nodes))
    while True:
        least = np.minimum(parent[a], parent[b])
        before = parent.copy()
        for end in (a, b):
            np.minimum.at(parent, before[end], least)
            np.minimum.at(parent, end, least)
        while True:
            jumped = parent[parent]
            if np.array_equal(jumped, parent):
                break
            parent = jumped
        if np.array_equal(before, parent):
            break
    return pd.DataFrame(
        {"grid_id": pdf["grid_id"].iloc[0], "layer": pdf["layer"].iloc[0], "local": nodes, "root": nodes[parent]}
    )


def _contract(links: DataFrame) -> DataFrame:
    """One round: every area hooks on its least neighbour, and chains of hooks are followed to their end."""
    both = links.select("grid_id", "layer", F.col("a").alias("local"), F.col("b").alias("_other")).unionByName(
        links.select("grid_id", "layer", F.col("b").alias("local"), F.col("a").alias("_other"))
    )
    hooked = both.groupBy("grid_id", "layer", "local").agg(F.least(F.min("local"), F.min("_other")).alias("root"))
    hooked = cut(hooked)
    while True:
        above = hooked.select("grid_id", "layer", F.col("local").alias("root"), F.col("root").alias("_next"))
        # Many areas may hook on one; the planner splits the partitions of hot roots.
        jumped = lookup(hooked, above, ["grid_id", "layer", "root"]).select(
            "grid_id", "layer", "local", F.col("_next").alias("root"), (F.col("_next") != F.col("root")).alias("_moved")
        )
        jumped = cut(jumped)
        moved = jumped.where("_moved").limit(1).count()
        discard(hooked)
        hooked = jumped.drop("_moved")
        if not moved:
            return hooked


def link_roots(links: DataFrame, finish_rows: int = FINISH_ROWS) -> DataFrame:
    """Least member (root) of every set of linked areas, (grid_id, layer, local, root).

    Rounds of hooking shrink the links at least by half each until they are few enough for one task per
    layer. Every round is written to the shared folder.
    """
    links = cut(links)
    rounds: list[DataFrame] = []
    while links.limit(finish_rows + 1).count() > finish_rows:
        roots = _contract(links)
        rounds.append(roots)
        ends = links
        for end in ("a", "b"):
            to = roots.select("grid_id", "layer", F.col("local").alias(end), F.col("root").alias(f"_{end}"))
            ends = lookup(ends, to, ["grid_id", "layer", end])
        smaller = cut(
            ends.where("_a != _b")
            .select("grid_id", "layer", F.least("_a", "_b").alias("a"), F.greatest("_a", "_b").alias("b"))
            .distinct()
        )
        discard(links)
        links = smaller
    result = links.groupBy("grid_id", "layer").applyInPandas(_merge_links, _MERGED)
    for roots in reversed(rounds):
        later = result.select("grid_id", "layer", F.col("local").alias("root"), F.col("root").alias("_later"))
        result = lookup(roots, later, ["grid_id", "layer", "root"], "left").select(
            "grid_id", "layer", "local", F.coalesce("_later", "root").alias("root")
        )
    return result


def _areas(runs: DataFrame, grids: DataFrame, chunk: int, finish_rows: int) -> DataFrame:
    """Merge chunk areas that touch: runs with `component_id`."""
    # Used three times below and made by Python workers: kept in the shared folder.
    runs = cut(runs)
    roots = link_roots(_links(runs, chunk), finish_rows)
    # A chunk area has at most chunk^2 runs, so no key of this join is hot.
    named = attach(runs, roots, ["grid_id", "layer", "local"], None, "left")
    placed = attach(named, grids.select("grid_id", "width"), ["grid_id"], ["grid_row", "c0"])
    root = F.coalesce("root", "local")
    number = F.floor(root / _CODE) * F.col("width") + root % _CODE
    return placed.select(*[c for c in _RUN_COLUMNS if c != "local"], number.alias("component_id"))


def label_areas(cells: DataFrame, grids: DataFrame, chunk: int = CHUNK, finish_rows: int = FINISH_ROWS) -> DataFrame:
    """8-connected areas of any mask as row runs (grid_id, layer, grid_row, c0, c1, side, component_id).

    A run with `side` = MEMBERS holds the cells c0..c1 of one row inside a chunk, the others are
    cells whose side 0 north, 1 east, 2 south, 3 west faces no member. Chunks are labelled in
    parallel, areas that touch across chunk borders are linked by an equi-join of the border cells
    only. The result does not depend on partitioning.
    """
    mask = cells.select(
        "grid_id", F.col("layer").cast("int").alias("layer"), "grid_row", "grid_col", F.lit(1).alias("band")
    )
    runs = _chunked(mask, chunk).groupBy("grid_id", "layer", "r", "c").applyInPandas(_label_chunk, _RUNS)
    return _areas(runs, grids, chunk, finish_rows)


def label_layers(
    grid: DataFrame, levels: DataFrame, grids: DataFrame, chunk: int = CHUNK, finish_rows: int = FINISH_ROWS
) -> DataFrame:
    """The same for all cumulative layers of a grid, which is shuffled once and not once per layer.

    A cell travels with the number of layers it reaches, and a chunk labels every layer in turn.
    """
    banded = banded_cells(grid, levels).where("band > 0")
    # `layer` is the lowest one; layers are numbered from 0 without gaps.
    cells = banded.select("grid_id", F.lit(0).alias("layer"), "grid_row", "grid_col", F.col("band").cast("int").alias("band"))
    runs = _chunked(cells, chunk).groupBy("grid_id", "r", "c").applyInPandas(_label_chunk, _RUNS)
    return _areas(runs, grids, chunk, finish_rows)


def area_cells(areas: DataFrame) -> DataFrame:
    """Cells of labelled runs, (grid_id, layer, grid_row, grid_col, component_id)."""
    members = areas.where(F.col("side") == MEMBERS)
    return members.select(
        "grid_id", "layer", "grid_row", F.explode(F.sequence("c0", "c1")).alias("grid_col"), "component_id"
    )


def area_sides(areas: DataFrame) -> DataFrame:
    """Sides of labelled runs that face no member, like `boundary_sides` with `component_id`."""
    return areas.where(F.col("side") != MEMBERS).select(
        "grid_id", "layer", "grid_row", F.explode(F.sequence("c0", "c1")).alias("grid_col"), "component_id", "side"
    )


def components(cells: DataFrame, grids: DataFrame, chunk: int = CHUNK, finish_rows: int = FINISH_ROWS) -> DataFrame:
    """8-connected areas of every layer: the mask with `component_id` = least row * width + col."""
    return area_cells(label_areas(cells, grids, chunk, finish_rows))
