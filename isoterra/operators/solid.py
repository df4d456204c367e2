"""Solids from layer masks: every layer becomes a closed body between two heights."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from isoterra.operators.components import MASK, _open_sides
from isoterra.operators.grid import GEOMETRY, beyond_degrees, local_metres
from isoterra.operators.mesh import Mesh, corner_columns, cornered_mesh
from isoterra.spread import attach, cut

_SIDES = ("_n", "_e", "_s", "_w")


def _corner_position(row: Column, col: Column) -> tuple[Column, Column]:
    return F.col("x0") + col * F.col("dx") + row * F.col("rx"), F.col("y0") + col * F.col("ry") + row * F.col("dy")


def _centres(cells: DataFrame, grids: DataFrame) -> DataFrame:
    """(grid_id, _lon, _lat, _projected): the middle of every grid, and whether a corner of its cells cannot be in degrees."""
    placed = attach(cells, grids.select("grid_id", *GEOMETRY), ["grid_id"], ["grid_row", "grid_col"])
    corners = [_corner_position(F.col("grid_row") + r, F.col("grid_col") + c) for r in (0, 1) for c in (0, 1)]
    beyond = corners[0][0].isNull()
    for x, y in corners:
        beyond = beyond | beyond_degrees(x, y)
    told = placed.groupBy("grid_id").agg(F.max(beyond).alias("_projected"))
    lon = F.col("x0") + F.col("dx") * F.col("width") / 2.0
    lat = F.col("y0") + F.col("dy") * F.col("height") / 2.0
    return grids.select("grid_id", lon.alias("_lon"), lat.alias("_lat")).join(told, "grid_id")


def extrude_layers(cells: DataFrame, slabs: DataFrame, grids: DataFrame, block: int = 4096, metres: bool = False) -> Mesh:
    """One closed mesh per layer (`grid#layer`) from its mask and slab (grid_id, layer, z_base, z_top).

    Two triangles on top and below every cell, two on every side that faces no member; holes of the
    mask get their own walls (use `filled_cells` first for layers without holes). All of it follows
    from one cell and its open sides, so after two windows no further shuffle is needed. Where two cells
    touch only at a corner each keeps its own copy of that corner, so no edge has four triangles.

    With `metres` corners in degrees become metres about the middle of their grid, decided once per grid,
    where they are computed; a grid with corners that cannot be in degrees stays as it is.
    """
    open_sides = _open_sides(cells.select(*MASK), "grid_row", "grid_col", "_w", "_e", block)
    open_sides = _open_sides(open_sides, "grid_col", "grid_row", "_n", "_s", block)
    # Vertices and triangles are two tables of the same cells: the windows run once.
    open_sides = cut(open_sides)
    slab = slabs.select("grid_id", "layer", "z_base", "z_top")
    placed = attach(open_sides, slab, ["grid_id", "layer"], ["grid_row", "grid_col"])
    placed = attach(placed, grids.select("grid_id", *GEOMETRY, "width"), ["grid_id"], ["grid_row", "grid_col"])
    if metres:
        # One row per grid, from the cells that are written already.
        placed = attach(placed, cut(_centres(open_sides, grids)), ["grid_id"], ["grid_row", "grid_col"])
    placed = placed.withColumn("mesh_id", F.concat("grid_id", F.lit("#"), F.col("layer").cast("string")))

    # Corners NW, NE, SE, SW; side k runs from corner k to corner k + 1 with the cell on its right.
    steps = [(0, 0), (0, 1), (1, 1), (1, 0)]

    def corner(k: int) -> tuple[Column, Column]:
        return F.col("grid_row") + steps[k][0], F.col("grid_col") + steps[k][1]

    def corner_id(k: int) -> Column:
        row, col = corner(k)
        # A corner between two open sides is shared with no side-neighbour, so it may be the cell's own.
        alone = F.col(_SIDES[k - 1]) & F.col(_SIDES[k])
        place = row.cast("long") * (F.col("width") + 1) + col
        return place * 5 + F.when(alone, k + 1).otherwise(0)

    def point(k: int, upper: bool) -> tuple[Column, Column, Column, Column]:
        x, y = _corner_position(*corner(k))
        if metres:
            east, north = local_metres(x, y, F.col("_lon"), F.col("_lat"))
            x, y = (F.when(F.col("_projected"), a).otherwise(b) for a, b in ((x, east), (y, north)))
        return corner_id(k) * 2 + int(upper), x, y, F.col("z_top" if upper else "z_base").cast("double")

    top, low = [point(k, True) for k in range(4)], [point(k, False) for k in range(4)]
    nw, ne, se, sw = range(4)
    # Faces name their corners by place in `top + low`, and the open side they need as one bit (0: always there).
    faces = [(nw, sw, ne, 0), (ne, sw, se, 0), (nw + 4, ne + 4, sw + 4, 0), (ne + 4, se + 4, sw + 4, 0)]
    for k in range(4):
        start, end = k, (k + 1) % 4
        faces += [(start, end, start + 4, 1 << k), (end, end + 4, start + 4, 1 << k)]
    cell = (F.col("grid_row").cast("long") * F.col("width") + F.col("grid_col")) * len(faces)
    bits = sum((F.when(F.col(side), 1 << k).otherwise(0) for k, side in enumerate(_SIDES)), F.lit(0))
    # Corners are computed once per cell and a face only picks three of them by place: an array of whole faces,
    # filtered by a function, is beyond Spark's code generation and every term of all faces would be interpreted.
    values = [F.array(*[p[i] for p in top + low]).alias(f"_{c}") for i, c in enumerate(("vid", "x", "y", "z"))]
    placed = placed.select("mesh_id", cell.alias("_cell"), bits.alias("_bits"), *values)

    def picked(at: Column) -> tuple[Column, Column, Column, Column]:
        return F.get("_vid", at), F.get("_x", at), F.get("_y", at), F.get("_z", at)

    listed = F.array(*[F.struct(*[F.lit(v).alias(c) for c, v in zip(("k", "a", "b", "c", "side"), (k, *f))]) for k, f in enumerate(faces)])
    cornered = (
        placed.withColumn("_f", F.explode(listed))
        .where(F.col("_bits").bitwiseAND(F.col("_f.side")) == F.col("_f.side"))
        .select("mesh_id", (F.col("_cell") + F.col("_f.k")).alias("tid"), *corner_columns([picked(F.col(f"_f.{c}")) for c in "abc"]))
    )
    vertices = (
        placed.withColumn("_at", F.explode(F.array(*[F.lit(k) for k in range(len(top + low))])))
        .select("mesh_id", *[v.alias(c) for c, v in zip(("vid", "x", "y", "z"), picked(F.col("_at")))])
        .groupBy("mesh_id", "vid")
        .agg(*[F.any_value(c).alias(c) for c in "xyz"])
    )
    return cornered_mesh(vertices, cornered)
