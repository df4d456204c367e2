"""Outlines of connected areas as ordered rings of points.

`ring_points` is (grid_id, layer, polygon_id, ring_id, seq, x, y); seq runs 0..n-1 without gaps and
the closing point is not repeated. Ring 0 is the exterior, other ids are holes.

Every side of a member cell that faces a non-member is a directed step from corner to corner with
the member on its right. Where two members touch only at a corner, a ring turns left there, into the
other cell, since both belong to one area.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from isoterra.operators.components import CHUNK, FINISH_ROWS, area_sides, boundary_sides
from isoterra.operators.grid import GEOMETRY
from isoterra.spread import attach, cut

# Row and column step of a side's direction: 0 east (north side), 1 south, 2 west, 3 north.
_STEP_ROW = np.array([0, 1, 0, -1])
_STEP_COL = np.array([1, 0, -1, 0])
# Corner of the cell where the step of each side starts.
_START_ROW = [0, 0, 1, 1]
_START_COL = [0, 1, 1, 0]
_FAR = np.iinfo(np.int64).max

_TRACED = (
    "grid_id string, layer int, polygon_id long, vrow int, vcol int, code long, kept boolean, piece long, pos long, "
    "closed boolean, length long, twice_area long, least long, least_at long, "
    "exit_row int, exit_col int, exit_side int, is_head boolean"
)


def _steps(sides: DataFrame) -> DataFrame:
    """Directed steps (vrow, vcol = start corner, side = direction) of boundary sides."""
    at = F.col("side")
    row = F.col("grid_row") + F.get(F.array(*[F.lit(v) for v in _START_ROW]), at)
    col = F.col("grid_col") + F.get(F.array(*[F.lit(v) for v in _START_COL]), at)
    return sides.select(
        "grid_id", "layer", F.col("component_id").alias("polygon_id"), row.alias("vrow"), col.alias("vcol"), "side"
    )


def _code(row: np.ndarray, col: np.ndarray, side: np.ndarray) -> np.ndarray:
    """A step as one number that sorts by corner row, corner column, direction."""
    return (row.astype(np.int64) << 32) | (col.astype(np.int64) << 2) | side


def _trace_chunk(pdf: pd.DataFrame, compact: bool) -> pd.DataFrame:
    """Join the steps that start in one chunk of corners into pieces of rings.

    Steps that come in from another chunk are included to know the direction before a piece.
    A piece is closed (a whole ring) or leaves the chunk at `exit`. With `compact` only corners
    where the direction changes are kept and counted.
    """
    row, col, side = (pdf[c].to_numpy().astype(np.int64) for c in ("vrow", "vcol", "side"))
    own = pdf["own"].to_numpy()
    code = _code(row, col, side)
    order = np.argsort(np.where(own, code, _FAR), kind="stable")
    row, col, side, own, code = (v[order] for v in (row, col, side, own, code))
    count = int(own.sum())
    codes = code[:count]

    def find(wanted: np.ndarray) -> np.ndarray:
        at = np.minimum(np.searchsorted(codes, wanted), count - 1)
        return np.where(codes[at] == wanted, at, -1)

    end_row, end_col = row + _STEP_ROW[side], col + _STEP_COL[side]
    following = np.full(len(code), -1)
    # Left first, then straight on, then right; only a corner of two touching cells offers two.
    for turn in (3, 0, 1):
        next_side = (side + turn) % 4
        here = find(_code(end_row, end_col, next_side))
        following = np.where(following < 0, here, following)
    came = np.full(count, -1)
    before = np.full(count, -1)
    known = following >= 0
    came[following[known]] = side[known]
    inside = known & own
    before[following[inside]] = np.flatnonzero(inside)
    kept = (came != side[:count]) if compact else np.ones(count, dtype=bool)

    # Follow the pieces backwards by pointer doubling: the head of an open piece, or any step of a ring.
    head = np.where(before < 0, np.arange(count), before)
    least = codes.copy()
    for _ in range(max(1, int(np.ceil(np.log2(count + 1))))):
        least = np.minimum(least, least[head])
        head = head[head]
    closed = before[head] >= 0
    first = np.where(closed, np.searchsorted(codes, least), head)
    # Rank inside a ring: cut it at its least step and double once more.
    prior = np.where((np.arange(count) == first) | (before < 0), np.arange(count), before)
    rank = np.where(prior == np.arange(count), 0, 1)
    for _ in range(max(1, int(np.ceil(np.log2(count + 1))))):
        rank = rank + rank[prior]
        prior = prior[prior]

    by = np.lexsort((rank, first))
    group_start = np.flatnonzero(np.r_[True, first[by][1:] != first[by][:-1]])
    group = np.repeat(np.arange(len(group_start)), np.diff(np.r_[group_start, count]))
    kept_by = kept[by].astype(np.int64)
    running = np.cumsum(kept_by) - kept_by
    pos = running - running[group_start][group]
    length = np.add.reduceat(kept_by, group_start)
    erow, ecol = end_row[:count][by], end_col[:count][by]
    cross = col[:count][by] * erow - ecol * row[:count][by]
    twice_area = np.add.reduceat(cross, group_start)
    kept_codes = np.where(kept[by], codes[by], _FAR)
    low = np.minimum.reduceat(kept_codes, group_start)
    at_low = np.where((kept_codes == low[group]) & kept[by], pos, 0)
    low_at = np.add.reduceat(at_low, group_start)
    last = np.r_[group_start[1:], count] - 1
    return pd.DataFrame(
        {
            "grid_id": pdf["grid_id"].iloc[0],
            "layer": pdf["layer"].iloc[0],
            "polygon_id": pdf["polygon_id"].to_numpy()[order][:count][by],
            "vrow": row[:count][by],
            "vcol": col[:count][by],
            "code": codes[by],
            "kept": kept[by],
            "piece": codes[first[by]],
            "pos": pos,
            "closed": closed[by],
            "length": length[group],
            "twice_area": twice_area[group],
            "least": low[group],
            "least_at": low_at[group],
            "exit_row": erow[last][group],
            "exit_col": ecol[last][group],
            "exit_side": side[:count][by][last][group],
            "is_head": np.arange(count) == group_start[group],
        }
    )


def _pieces(traced: DataFrame) -> DataFrame:
    """Open pieces with the piece that follows each, (grid_id, layer, piece, next, length, ...)."""
    heads = traced.where("is_head and not closed")
    corner = ["grid_id", "layer", "vrow", "vcol"]
    # At most two pieces start at one corner.
    starts = heads.groupBy(*corner).agg(
        F.collect_list(F.struct((F.col("code") % 4).cast("int").alias("side"), F.col("piece").alias("piece"))).alias("_starts")
    )
    exits = heads.select(
        "grid_id",
        "layer",
        F.col("exit_row").alias("vrow"),
        F.col("exit_col").alias("vcol"),
        "piece",
        "exit_side",
        "length",
        "twice_area",
        "least",
        "least_at",
    )
    left = F.filter("_starts", lambda s: s["side"] == (F.col("exit_side") + 3) % 4)
    chosen = F.when(F.size("_starts") == 1, F.get("_starts", F.lit(0))).otherwise(F.get(left, F.lit(0)))
    return exits.join(starts, corner).select(
        "grid_id", "layer", "piece", chosen["piece"].alias("next"), "length", "twice_area", "least", "least_at"
    )


_STITCHED = "grid_id string, layer int, piece long, ring long, ahead long"


def _stitch_group(pdf: pd.DataFrame) -> pd.DataFrame:
    """Least step of every ring and how many points lie ahead of it; only for a checked number of pieces."""
    ids = np.sort(pdf["piece"].to_numpy())
    pdf = pdf.set_index("piece").loc[ids]
    to = np.searchsorted(ids, pdf["next"].to_numpy())
    least, ahead, span = (pdf[c].to_numpy().copy() for c in ("least", "least_at", "length"))
    for _ in range(int(np.ceil(np.log2(len(ids) + 1))) + 1):
        other = least[to] < least
        ahead = np.where(other, span + ahead[to], ahead)
        least = np.minimum(least, least[to])
        span = span + span[to]
        to = to[to]
    return pd.DataFrame(
        {"grid_id": pdf["grid_id"].iloc[0], "layer": pdf["layer"].iloc[0], "piece": ids, "ring": least, "ahead": ahead}
    )


def _stitch_rounds(pieces: DataFrame) -> DataFrame:
    """The same by pointer doubling over the whole table: every round is one equi-join on unique keys.

    A round that lowers no piece's least step means that all pieces of every ring agree.
    """
    state = cut(
        pieces.select(
            "grid_id",
            "layer",
            "piece",
            "next",
            F.col("least").alias("ring"),
            F.col("least_at").alias("ahead"),
            F.col("length").alias("_span"),
        )
    )
    while True:
        there = state.select(
            "grid_id",
            "layer",
            F.col("piece").alias("next"),
            F.col("next").alias("_next"),
            F.col("ring").alias("_ring"),
            F.col("ahead").alias("_ahead"),
            F.col("_span").alias("_span2"),
        )
        lower = F.col("_ring") < F.col("ring")
        state = cut(
            state.join(there, ["grid_id", "layer", "next"]).select(
                "grid_id",
                "layer",
                "piece",
                F.col("_next").alias("next"),
                F.least("ring", "_ring").alias("ring"),
                F.when(lower, F.col("_span") + F.col("_ahead")).otherwise(F.col("ahead")).alias("ahead"),
                (F.col("_span") + F.col("_span2")).alias("_span"),
                lower.alias("_lowered"),
            )
        )
        if not state.where("_lowered").limit(1).count():
            return state.select("grid_id", "layer", "piece", "ring", "ahead")
        state = state.drop("_lowered")


def rings(cells: DataFrame, grids: DataFrame, **options) -> DataFrame:
    """Rings of labelled cells (the output of `components`); options as in `side_rings`."""
    return side_rings(boundary_sides(cells), grids, **options)


def area_rings(areas: DataFrame, grids: DataFrame, **options) -> DataFrame:
    """Rings of labelled runs (the output of `label_areas`), whose open sides are known already."""
    return side_rings(area_sides(areas), grids, **options)


def side_rings(
    sides: DataFrame,
    grids: DataFrame,
    remove_holes: bool = True,
    compact: bool = True,
    chunk: int = CHUNK,
    finish_rows: int = FINISH_ROWS,
) -> DataFrame:
    """Rings of boundary sides with their component, starting at their least corner.

    Chunks of corners are traced in parallel; only the pieces that leave a chunk are stitched
    together, by pointer doubling. `compact` drops corners on straight lines.
    """
    steps = _steps(sides)
    row, col, side = F.col("vrow"), F.col("vcol"), F.col("side")
    start = F.struct(F.expr(f"vrow div {chunk}").alias("r"), F.expr(f"vcol div {chunk}").alias("c"), F.lit(True).alias("own"))
    end_row = row + F.when(side == 1, 1).when(side == 3, -1).otherwise(0)
    end_col = col + F.when(side == 0, 1).when(side == 2, -1).otherwise(0)
    end = F.struct(
        F.floor(end_row / chunk).cast("long").alias("r"), F.floor(end_col / chunk).cast("long").alias("c"), F.lit(False).alias("own")
    )
    leaves = (start["r"] != end["r"]) | (start["c"] != end["c"])
    spread = steps.withColumn("_k", F.explode(F.when(leaves, F.array(start, end)).otherwise(F.array(start))))

    def trace(pdf: pd.DataFrame) -> pd.DataFrame:
        if not pdf["own"].any():
            return pd.DataFrame({c.split()[0]: pd.Series([], dtype=object) for c in _TRACED.split(", ")})
        return _trace_chunk(pdf, compact)

    traced = cut(
        spread.select("grid_id", "layer", "polygon_id", "vrow", "vcol", "side", F.col("_k.own").alias("own"), "_k.r", "_k.c")
        .groupBy("grid_id", "layer", "r", "c")
        .applyInPandas(trace, _TRACED)
    )
    pieces = cut(_pieces(traced))
    if pieces.limit(finish_rows + 1).count() <= finish_rows:
        stitched = pieces.groupBy("grid_id", "layer").applyInPandas(_stitch_group, _STITCHED)
    else:
        stitched = _stitch_rounds(pieces)
    placed = stitched.join(pieces.select("grid_id", "layer", "piece", "length", "twice_area"), ["grid_id", "layer", "piece"])
    whole = placed.groupBy("grid_id", "layer", "ring").agg(
        F.sum("length").alias("_points"), F.sum("twice_area").alias("_area")
    )
    # One row per piece, at most CHUNK^2 * 4 steps each, so this join has no hot key.
    located = placed.join(whole, ["grid_id", "layer", "ring"]).select(
        "grid_id", "layer", "piece", "ring", "ahead", "_points", "_area"
    )
    points = traced.where("kept").join(located, ["grid_id", "layer", "piece"], "left")
    open_piece = ~F.col("closed")
    ring = F.when(open_piece, F.col("ring")).otherwise(F.col("least"))
    total = F.when(open_piece, F.col("_points")).otherwise(F.col("length"))
    ahead = F.when(open_piece, F.col("ahead")).otherwise(F.col("least_at"))
    area = F.when(open_piece, F.col("_area")).otherwise(F.col("twice_area"))
    listed = points.select(
        "grid_id",
        "layer",
        "polygon_id",
        # Steps keep the area on their right, so an exterior has positive area with rows downwards.
        F.when(area > 0, F.lit(0).cast("long")).otherwise(ring).alias("ring_id"),
        F.pmod(F.col("pos") - ahead, total).alias("seq"),
        "vrow",
        "vcol",
    )
    if remove_holes:
        listed = listed.where("ring_id = 0")
    located_points = attach(listed, grids.select("grid_id", *GEOMETRY), ["grid_id"], ["vrow", "vcol"])
    return located_points.select(
        "grid_id",
        "layer",
        "polygon_id",
        "ring_id",
        "seq",
        (F.col("x0") + F.col("vcol") * F.col("dx") + F.col("vrow") * F.col("rx")).alias("x"),
        (F.col("y0") + F.col("vcol") * F.col("ry") + F.col("vrow") * F.col("dy")).alias("y"),
    )
