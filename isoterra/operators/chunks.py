"""Elevation grids as packed squares: one row per chunk instead of one per cell.

A chunk is (grid_id, chunk_row, chunk_col, elevs): `side` x `side` elevations, row after row, as an array
of floats; NaN stands for voids and for cells beyond the grid. Four bytes a cell travel where a cell
table needs some forty. In a stencil each chunk sends its border cells to its eight neighbours and meets
theirs by one join of packed rows; no cell is shuffled by itself. Results are those of the cell operators.
"""

from __future__ import annotations

import warnings
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, FloatType, LongType

from isoterra.operators.components import _RUN_COLUMNS, _RUNS, FINISH_ROWS, _areas, _runs_of
from isoterra.operators.grid import HIGHEST_ELEV, LOWEST_ELEV
from isoterra.operators.levels import _floors, counted_layers
from isoterra.spread import attach, cut

SIDE = 128
KEY = ["grid_id", "chunk_row", "chunk_col"]
# Where a neighbour lies, and the name of the strip that comes from it.
HALO = {(-1, -1): "nw", (-1, 0): "n", (-1, 1): "ne", (0, -1): "w", (0, 1): "e", (1, -1): "sw", (1, 0): "s", (1, 1): "se"}


def pack(grid: DataFrame, side: int = SIDE) -> DataFrame:
    """Chunks of a cell table. Cells are packed before the one shuffle by chunk; a chunk is bounded by its side."""
    row, col = F.col("grid_row"), F.col("grid_col")
    cells = grid.select(
        "grid_id",
        F.floor(row / side).cast("int").alias("chunk_row"),
        F.floor(col / side).cast("int").alias("chunk_col"),
        (F.pmod(row, F.lit(side)) * side + F.pmod(col, F.lit(side))).cast("int").alias("_at"),
        F.coalesce(F.col("elev").cast("float"), F.lit(float("nan")).cast("float")).alias("_elev"),
    )

    def fill(at: pd.Series, elev: pd.Series) -> pd.Series:
        out = np.full((len(at), side * side), np.nan, np.float32)
        for values, a, e in zip(out, at, elev):
            values[a] = e
        return pd.Series(list(out))

    # Neither list skips a row, so places and values of a cell stay side by side.
    lists = cells.groupBy(*KEY).agg(F.collect_list("_at").alias("_at"), F.collect_list("_elev").alias("_elev"))
    return lists.select(*KEY, F.pandas_udf(fill, ArrayType(FloatType()))("_at", "_elev").alias("elevs"))


def unpack(chunks: DataFrame, grids: DataFrame, side: int = SIDE) -> DataFrame:
    """The cell table of chunks: all cells within the extent of their grid, NaN as NULL."""
    placed = attach(chunks, grids.select("grid_id", "width", "height"), ["grid_id"], ["chunk_row", "chunk_col"])
    cells = placed.select("*", F.posexplode("elevs").alias("_at", "_e")).select(
        "grid_id",
        (F.col("chunk_row") * side + F.expr(f"cast(_at div {side} as int)")).alias("grid_row"),
        (F.col("chunk_col") * side + F.col("_at") % side).alias("grid_col"),
        F.when(~F.isnan("_e"), F.col("_e")).alias("elev"),
        "width",
        "height",
    )
    return cells.where((F.col("grid_row") < F.col("height")) & (F.col("grid_col") < F.col("width"))).drop("width", "height")


def with_halo(chunks: DataFrame, side: int = SIDE, strips: tuple[str, ...] = tuple(HALO.values())) -> DataFrame:
    """Chunks with the border cells of their neighbours as columns n, ne, e, ...; NULL where there is no neighbour.

    The strips are shuffled to their chunks, and the chunks, packed, meet them by their key.
    """
    elevs = F.col("elevs")

    def border(dr: int, dc: int) -> Column:
        """The cells of a chunk that touch its neighbour at (dr, dc)."""
        top, left = (0 if dr < 0 else side - 1), (0 if dc < 0 else side - 1)
        if dr and dc:
            return F.array(F.get(elevs, F.lit(top * side + left)))
        if dr:
            return F.slice(elevs, top * side + 1, side)
        return F.transform(F.sequence(F.lit(0), F.lit(side - 1)), lambda i: F.get(elevs, i * side + left))

    # A chunk's south border is the strip that the chunk to the south has from its north.
    sent = [(dr, dc, HALO[-dr, -dc]) for dr, dc in HALO if HALO[-dr, -dc] in strips]
    listed = F.array(
        *[
            F.struct(F.lit(name).alias("from"), (F.col("chunk_row") + dr).alias("r"), (F.col("chunk_col") + dc).alias("c"), border(dr, dc).alias("cells"))
            for dr, dc, name in sent
        ]
    )
    posted = chunks.select("grid_id", F.explode(listed).alias("_s")).select(
        "grid_id", F.col("_s.r").alias("chunk_row"), F.col("_s.c").alias("chunk_col"), F.col("_s.from").alias("_from"), F.col("_s.cells").alias("_cells")
    )
    met = posted.groupBy(*KEY).agg(*[F.any_value(F.when(F.col("_from") == n, F.col("_cells")), True).alias(n) for n in strips])
    return chunks.join(met.hint("merge"), KEY, "left")


def padded(elevs: np.ndarray, side: int, strips: dict[str, np.ndarray | None]) -> np.ndarray:
    """One chunk inside a frame of its neighbours' cells, NaN where there are none."""
    out = np.full((side + 2, side + 2), np.nan, np.float32)
    out[1:-1, 1:-1] = np.asarray(elevs).reshape(side, side)
    places = {"n": np.s_[0, 1:-1], "s": np.s_[-1, 1:-1], "w": np.s_[1:-1, 0], "e": np.s_[1:-1, -1], "nw": np.s_[0, 0], "ne": np.s_[0, -1], "sw": np.s_[-1, 0], "se": np.s_[-1, -1]}
    for name, cells in strips.items():
        if cells is not None:
            out[places[name]] = cells if len(name) == 1 else cells[0]
    return out


def repair_chunks(chunks: DataFrame, side: int = SIDE, lo: float = LOWEST_ELEV, hi: float = HIGHEST_ELEV) -> DataFrame:
    """Non-finite cells become voids and values outside [lo, hi] the median of their eight neighbours, as of the cell operators."""

    def repair(elevs: pd.Series, *strips: pd.Series) -> pd.Series:
        out = []
        for cells, *own in zip(elevs, *strips):
            frame = padded(cells, side, dict(zip(HALO.values(), own)))
            frame[~np.isfinite(frame)] = np.nan
            inner = frame[1:-1, 1:-1].copy()
            row, col = np.nonzero((inner < lo) | (inner > hi))
            if len(row):
                around = np.stack([frame[row + 1 + dr, col + 1 + dc] for dr, dc in HALO]).astype(np.float64)
                with warnings.catch_warnings():
                    warnings.simplefilter("ignore", RuntimeWarning)  # no valid neighbour: NaN
                    median = np.nanmedian(around, axis=0)
                inner[row, col] = np.where((median >= lo) & (median <= hi), median, np.nan)
            out.append(inner.ravel())
        return pd.Series(out)

    repaired = F.pandas_udf(repair, ArrayType(FloatType()))("elevs", *HALO.values())
    return with_halo(chunks, side).select(*KEY, repaired.alias("elevs"))


def chunk_range(chunks: DataFrame) -> DataFrame:
    """Lowest and highest valid elevation per grid, (0, 0) when no cell is valid."""

    def ends(elevs: pd.Series) -> pd.DataFrame:
        found = [e[~np.isnan(e)] for e in elevs]
        return pd.DataFrame({"lo": [e.min() if len(e) else None for e in found], "hi": [e.max() if len(e) else None for e in found]}, dtype="float64")

    spans = chunks.select("grid_id", F.pandas_udf(ends, "lo double, hi double")("elevs").alias("_s"))

    def told(c: Column) -> Column:
        return F.coalesce(F.when(~F.isnan(c), c), F.lit(0.0))

    # Chunks without a valid cell are NaN or NULL and count for nothing.
    return spans.groupBy("grid_id").agg(
        told(F.min(F.when(~F.isnan("_s.lo"), F.col("_s.lo")))).alias("min_elev"), told(F.max(F.when(~F.isnan("_s.hi"), F.col("_s.hi")))).alias("max_elev")
    )


def chunk_histogram(chunks: DataFrame, levels: DataFrame) -> DataFrame:
    """Valid cells per band (grid_id, band, cells): each chunk counts its own bands by binary search."""

    def count(elevs: pd.Series, floors: pd.Series) -> pd.Series:
        out = []
        for cells, lower in zip(elevs, floors):
            valid = cells[np.isfinite(cells)].astype(np.float64)
            out.append(np.bincount(np.searchsorted(lower, valid, "right"), minlength=len(lower) + 1))
        return pd.Series(out)

    floors = _floors(levels).select("grid_id", F.transform("_floors", lambda f: f["lower"].cast("double")).alias("_lower"))
    placed = attach(chunks, floors, ["grid_id"], ["chunk_row", "chunk_col"])
    counts = placed.select("grid_id", F.posexplode(F.pandas_udf(count, ArrayType(LongType()))("elevs", "_lower")).alias("band", "_n"))
    return counts.where("_n > 0").groupBy("grid_id", "band").agg(F.sum("_n").alias("cells"))


def chunk_layer_counts(chunks: DataFrame, levels: DataFrame) -> DataFrame:
    """Cells and share of valid cells at or above each level, as `layer_counts`."""
    levels = cut(levels)
    return counted_layers(levels, chunk_histogram(chunks, levels))


def chunk_quads(chunks: DataFrame, side: int = SIDE) -> DataFrame:
    """All 2 x 2 groups of valid cells, as `quads`; only the strips from east, south and south-east are shuffled."""
    names = ["e", "s", "se"]

    def find(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for grid_id, r, c, cells, *own in zip(*[pdf[k] for k in (*KEY, "elevs", *names)]):
                z = padded(cells, side, dict(zip(names, own)))[1:, 1:].astype(np.float64)
                corners = {"z00": z[:-1, :-1], "z10": z[:-1, 1:], "z01": z[1:, :-1], "z11": z[1:, 1:]}
                row, col = np.nonzero(~np.isnan(sum(corners.values())))
                found = {k: v[row, col] for k, v in corners.items()}
                yield pd.DataFrame({"grid_id": grid_id, "row": row + r * side, "col": col + c * side} | found)

    schema = "grid_id string, row int, col int, z00 double, z10 double, z01 double, z11 double"
    return with_halo(chunks, side, tuple(names)).mapInPandas(find, schema)


def label_chunk_layers(chunks: DataFrame, levels: DataFrame, grids: DataFrame, side: int = SIDE, finish_rows: int = FINISH_ROWS) -> DataFrame:
    """8-connected areas of all cumulative layers as row runs, as `label_layers`; no cell is shuffled."""
    names = ["n", "e", "s", "w"]

    def label(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for grid_id, r, c, cells, lower, *own in zip(*[pdf[k] for k in (*KEY, "elevs", "_lower", *names)]):
                frame = padded(cells, side, dict(zip(names, own))).astype(np.float64)
                reach = np.searchsorted(lower, np.where(np.isfinite(frame), frame, -np.inf), "right")
                for k in range(int(reach[1:-1, 1:-1].max())):
                    yield _runs_of(reach > k, r * side, c * side).assign(layer=k, grid_id=grid_id)[_RUN_COLUMNS]

    floors = _floors(levels).select("grid_id", F.transform("_floors", lambda f: f["lower"].cast("double")).alias("_lower"))
    placed = attach(with_halo(chunks, side, tuple(names)), floors, ["grid_id"], ["chunk_row", "chunk_col"])
    return _areas(placed.mapInPandas(label, _RUNS), grids, side, finish_rows)


def downsample_chunks(chunks: DataFrame, grids: DataFrame, n: int, side: int = SIDE) -> DataFrame:
    """Mean of the valid cells of every n x n block, as `downsample`: chunks sum their parts of blocks, few of which lie in two."""

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for grid_id, r, c, cells in zip(*[batch.column(k).to_pylist() for k in KEY], batch.column("elevs")):
                z = cells.values.to_numpy(zero_copy_only=False).reshape(side, side).astype(np.float64)
                ends = [(np.arange(side) + at * side) // n for at in (r, c)]
                rows, cols = ends[0][-1] - ends[0][0] + 1, ends[1][-1] - ends[1][0] + 1
                block = ((ends[0] - ends[0][0])[:, None] * cols + (ends[1] - ends[1][0])[None, :]).ravel()
                valid = ~np.isnan(z.ravel())
                number = np.bincount(block, minlength=rows * cols)
                total = np.bincount(block, np.where(valid, z.ravel(), 0.0), minlength=rows * cols)
                kept = np.bincount(block, valid, minlength=rows * cols).astype(np.int64)
                at = np.flatnonzero(number)
                columns = [at // cols + ends[0][0], at % cols + ends[1][0], total[at], kept[at]]
                arrays = [pa.array(v, k) for v, k in zip(columns, (pa.int32(), pa.int32(), pa.float64(), pa.int64()))]
                yield pa.RecordBatch.from_arrays([pa.array([grid_id] * len(at)), *arrays], names=["grid_id", "grid_row", "grid_col", "_sum", "_n"])

    parts = chunks.mapInArrow(sums, "grid_id string, grid_row int, grid_col int, _sum double, _n long")
    sizes = grids.select("grid_id", F.expr(f"width div {n}").alias("_w"), F.expr(f"height div {n}").alias("_h"))
    placed = attach(parts, sizes, ["grid_id"], ["grid_row", "grid_col"]).where((F.col("grid_row") < F.col("_h")) & (F.col("grid_col") < F.col("_w")))
    mean = F.try_divide(F.sum("_sum"), F.sum("_n")).cast("float")
    return placed.groupBy("grid_id", "grid_row", "grid_col").agg(mean.alias("elev"))
