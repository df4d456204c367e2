"""Meshes straight from an elevation grid: surface, slab layers, base platform, side walls.

Corner ids are the linear cell number, so neighbouring cells share their corners. With n cells in
a grid, base corners are n + cell and flat wall tops 2n + cell; the triangles of base and walls
follow those of the surface, so the parts of one solid can simply be put together.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from isoterra.operators.grid import GEOMETRY, elevation_range
from isoterra.operators.mesh import Mesh, corner_columns, cornered_mesh
from isoterra.spread import attach

# Columns per block of the row pairs: bounds one window group, however wide the grid is.
PAIR_BLOCK = 1024


def quads(grid: DataFrame) -> DataFrame:
    """All 2 x 2 groups of valid cells, (grid_id, row, col, z00, z10, z01, z11), z in double.

    z10 is the next column, z01 the next row. Every cell goes to the row pair above and below it
    (and a block border cell also to the block on its left); after this one shuffle by row pair and
    block, meeting the cell below and the cell to the right needs no further exchange.
    """
    roles = F.array(
        F.struct(F.col("grid_row").alias("row"), F.lit(True).alias("upper")),
        F.struct((F.col("grid_row") - 1).alias("row"), F.lit(False).alias("upper")),
    )
    own = F.expr(f"cast(grid_col div {PAIR_BLOCK} as int)")
    on_border = (F.col("grid_col") % PAIR_BLOCK == 0) & (F.col("grid_col") > 0)
    blocks = F.when(on_border, F.array(own, own - 1)).otherwise(F.array(own))
    paired = (
        grid.where(F.col("elev").isNotNull())
        .select("grid_id", F.explode(roles).alias("_r"), "grid_col", F.col("elev").cast("double").alias("_z"))
        .where("_r.row >= 0")
        .select(
            "grid_id",
            F.col("_r.row").alias("row"),
            F.explode(blocks).alias("_block"),
            F.col("grid_col").alias("col"),
            F.when(F.col("_r.upper"), F.col("_z")).alias("_upper"),
            F.when(~F.col("_r.upper"), F.col("_z")).alias("_lower"),
        )
        .repartition("grid_id", "row", "_block")
    )
    columns = paired.groupBy("grid_id", "row", "_block", "col").agg(
        F.max("_upper").alias("z00"), F.max("_lower").alias("z01")
    )
    along = Window.partitionBy("grid_id", "row", "_block").orderBy("col")
    return (
        columns.withColumns(
            {
                "_next": F.lead("col").over(along),
                "z10": F.lead("z00").over(along),
                "z11": F.lead("z01").over(along),
            }
        )
        .where((F.col("_next") == F.col("col") + 1) & F.expr("z00 + z01 + z10 + z11 is not null"))
        .select("grid_id", "row", "col", "z00", "z10", "z01", "z11")
    )


def _id(row: Column, col: Column) -> Column:
    return row.cast("long") * F.col("width") + col


# A corner as (vid, x, y, z).
Point = tuple[Column, Column, Column, Column]


def _two_triangles(first: Column, a: Point, b: Point, c: Point, d: Point, reverse: bool) -> Column:
    """Triangles, with their corners, of a quad with corners a (here), b (next column), c (next row), d (both)."""
    faces = [(a, b, c), (b, d, c)] if not reverse else [(a, c, b), (b, c, d)]
    return F.array(*[F.struct((first + k).alias("tid"), *corner_columns(list(f))) for k, f in enumerate(faces)])


def _position(row: Column, col: Column) -> tuple[Column, Column]:
    """x and y of a cell."""
    return F.col("x0") + col * F.col("dx") + row * F.col("rx"), F.col("y0") + col * F.col("ry") + row * F.col("dy")


def _vertex(point: Point) -> Column:
    return F.struct(*[v.alias(c) for c, v in zip(("vid", "x", "y", "z"), point)])


def _surface(cells: DataFrame, grids: DataFrame, mode: str, flip: bool, vscale: float) -> Mesh:
    """Mesh of quads that carry mesh_id and the bounds `_lo`, `_hi` (NULL = open)."""
    z = [F.col(c) for c in ("z00", "z10", "z01", "z11")]
    low, high = F.least(*z), F.greatest(*z)
    above = F.coalesce(high >= F.col("_lo"), F.lit(True))
    below = F.coalesce(low <= F.col("_hi"), F.lit(True))
    placed = attach(cells, grids.select("grid_id", *GEOMETRY, "width"), ["grid_id"], ["row", "col"])
    row, col = F.col("row"), F.col("col")
    corners = [(row, col), (row, col + 1), (row + 1, col), (row + 1, col + 1)]
    cell = _id(row, col)
    if mode == "terrain":
        kept = placed.where(above & below)
        # greatest and least skip NULL, so an open bound clamps nothing.
        heights = [F.least(F.greatest(v, F.col("_lo")), F.col("_hi")) * vscale for v in z]
        ids = [_id(r, c) for r, c in corners]
    elif mode == "flat":
        kept = placed.where(above)
        heights = [F.coalesce(F.col("_hi"), high) * vscale] * 4
        # Flat cells differ in height, so every cell has its own four corners.
        ids = [cell * 4 + k for k in range(4)]
    else:
        raise ValueError(f"mode must be 'terrain' or 'flat', got {mode!r}")
    points = [(i, *_position(r, c), h) for i, (r, c), h in zip(ids, corners, heights)]
    cornered = kept.select("mesh_id", F.explode(_two_triangles(cell * 2, *points, reverse=flip)).alias("_t")).select("mesh_id", "_t.*")
    vertices = kept.select("mesh_id", F.explode(F.array(*map(_vertex, points))).alias("_v")).select("mesh_id", "_v.*")
    if mode == "terrain":
        vertices = vertices.groupBy("mesh_id", "vid").agg(*[F.any_value(c).alias(c) for c in "xyz"])
    return cornered_mesh(vertices, cornered)


def heightmap_triangles(
    grid: DataFrame,
    grids: DataFrame,
    mode: str = "terrain",
    min_elev: float | None = None,
    max_elev: float | None = None,
    flip: bool = False,
    vscale: float = 1.0,
    groups: DataFrame | None = None,
) -> Mesh:
    """Two triangles per 2 x 2 group without a void, one mesh per grid.

    `groups` are the 2 x 2 groups of the grid where they are known already, as from packed chunks.

    Terrain mode skips groups wholly outside the bounds and clamps the rest to them. Flat mode skips
    groups below min_elev and puts all four corners at max_elev, or at the group's highest cell.
    """
    def bound(v: float | None) -> Column:
        return F.lit(v).cast("double")

    cells = (quads(grid) if groups is None else groups).select(
        "*", F.col("grid_id").alias("mesh_id"), bound(min_elev).alias("_lo"), bound(max_elev).alias("_hi")
    )
    return _surface(cells, grids, mode, flip, vscale)


def heightmap_layers(
    grid: DataFrame, grids: DataFrame, n: int, mode: str = "terrain", flip: bool = False, vscale: float = 1.0
) -> Mesh:
    """n meshes per grid, one for each equal slab of its elevation range; mesh_id is `grid#slab`."""
    step = (F.col("max_elev") - F.col("min_elev")) / n
    slabs = (
        elevation_range(grid)
        .withColumn("_i", F.explode(F.sequence(F.lit(0), F.lit(n - 1))))
        .select(
            "grid_id",
            F.concat("grid_id", F.lit("#"), F.col("_i").cast("string")).alias("mesh_id"),
            (F.col("min_elev") + F.col("_i") * step).alias("_lo"),
            (F.col("min_elev") + (F.col("_i") + 1) * step).alias("_hi"),
        )
    )
    cells = attach(quads(grid), slabs, ["grid_id"], ["row", "col"])
    return _surface(cells, grids, mode, flip, vscale)


def _all_groups(grids: DataFrame) -> DataFrame:
    """Every 2 x 2 group position of a grid; rows are spread over the cluster before columns are made."""
    rows = grids.withColumn("row", F.explode(F.sequence(F.lit(0), F.col("height") - 2)))
    return rows.repartition("grid_id", "row").withColumn(
        "col", F.explode(F.sequence(F.lit(0), F.col("width") - 2))
    )


def _cells_of() -> Column:
    return F.col("width").cast("long") * F.col("height")


def base_platform(grids: DataFrame, base_z: float, flip: bool = False) -> Mesh:
    """Two downward triangles at base_z under every 2 x 2 group, voids included."""
    sized = grids.where("width > 1 and height > 1")
    groups = _all_groups(sized)
    row, col, n = F.col("row"), F.col("col"), _cells_of()
    corners = [(row, col), (row, col + 1), (row + 1, col), (row + 1, col + 1)]
    level = F.lit(float(base_z))
    quad = [(n + _id(r, c), *_position(r, c), level) for r, c in corners]
    first = n * 2 + _id(row, col) * 2
    cornered = groups.select(
        F.col("grid_id").alias("mesh_id"), F.explode(_two_triangles(first, *quad, reverse=not flip)).alias("_t")
    ).select("mesh_id", "_t.*")
    points = (
        sized.withColumn("row", F.explode(F.sequence(F.lit(0), F.col("height") - 1)))
        .repartition("grid_id", "row")
        .withColumn("col", F.explode(F.sequence(F.lit(0), F.col("width") - 1)))
    )
    x, y = _position(row, col)
    vertices = points.select(
        F.col("grid_id").alias("mesh_id"), (n + _id(row, col)).alias("vid"), x.alias("x"), y.alias("y"), level.alias("z")
    )
    return cornered_mesh(vertices, cornered)


def side_walls(grid: DataFrame, grids: DataFrame, base_z: float, mode: str = "terrain", vscale: float = 1.0) -> Mesh:
    """Two triangles down to base_z per pair of neighbouring border cells, skipped when one is void.

    In flat mode all wall tops lie at the highest cell of the grid.
    """
    geometry = attach(
        grid.where(F.col("elev").isNotNull()),
        grids.select("grid_id", *GEOMETRY, "width", "height"),
        ["grid_id"],
        ["grid_row", "grid_col"],
    )
    row, col = F.col("grid_row"), F.col("grid_col")
    last_row, last_col = F.col("height") - 1, F.col("width") - 1
    # Sides 0 left, 1 right, 2 top, 3 bottom; `at` runs along the side.
    sides = F.filter(
        F.array(
            F.struct(F.lit(0).alias("side"), row.alias("at"), (col == 0).alias("on")),
            F.struct(F.lit(1).alias("side"), row.alias("at"), (col == last_col).alias("on")),
            F.struct(F.lit(2).alias("side"), col.alias("at"), (row == 0).alias("on")),
            F.struct(F.lit(3).alias("side"), col.alias("at"), (row == last_row).alias("on")),
        ),
        lambda s: s["on"],
    )
    border = (row == 0) | (row == last_row) | (col == 0) | (col == last_col)
    on_side = geometry.where(border).select("*", F.explode(sides).alias("_s"))
    # Each border cell starts one pair and ends the one before it.
    ends = F.array(
        F.struct(F.col("_s.at").alias("at"), F.lit(0).alias("end")),
        F.struct((F.col("_s.at") - 1).alias("at"), F.lit(1).alias("end")),
    )
    z = F.col("elev").cast("double") * vscale

    def end(k: int, value: Column) -> Column:
        return F.max(F.when(F.col("_e.end") == k, value))

    frame = [*GEOMETRY, "width", "height"]
    pairs = (
        on_side.withColumn("_z", z)
        .withColumn("_e", F.explode(ends))
        .where("_e.at >= 0")
        .groupBy("grid_id", F.col("_s.side").alias("side"), F.col("_e.at").alias("at"))
        .agg(
            end(0, F.col("_z")).alias("_z0"),
            end(1, F.col("_z")).alias("_z1"),
            *[F.any_value(c).alias(c) for c in frame],
        )
        .where(F.col("_z0").isNotNull() & F.col("_z1").isNotNull())
    )
    n = _cells_of()
    if mode == "flat":
        tops = elevation_range(grid).select("grid_id", (F.col("max_elev") * vscale).alias("_top"))
        pairs = attach(pairs, tops, ["grid_id"], ["side", "at"]).withColumns({"_z0": F.col("_top"), "_z1": F.col("_top")})
        top_shift = n * 2
    elif mode == "terrain":
        top_shift = F.lit(0).cast("long")
    else:
        raise ValueError(f"mode must be 'terrain' or 'flat', got {mode!r}")
    upright = F.col("side") < 2

    def corner(step: int) -> tuple[Column, Column]:
        along = F.col("at") + step
        r = F.when(upright, along).when(F.col("side") == 2, F.lit(0)).otherwise(last_row)
        c = F.when(~upright, along).when(F.col("side") == 0, F.lit(0)).otherwise(last_col)
        return r, c

    cells = [_id(*corner(0)), _id(*corner(1))]
    top0, top1 = (top_shift + c for c in cells)
    base0, base1 = (n + c for c in cells)
    # Left and bottom walls run one way round, right and top walls the other.
    outward = F.col("side").isin(0, 3)
    longest = F.greatest("width", "height").cast("long")
    first = n * 4 + (F.col("side") * longest + F.col("at")) * 2

    base = F.lit(float(base_z))
    start, end_ = (_position(*corner(k)) for k in (0, 1))
    tops = [(top0, *start, F.col("_z0")), (top1, *end_, F.col("_z1"))]
    bases = [(base0, *start, base), (base1, *end_, base)]

    def face(k: int, one: tuple, other: tuple) -> Column:
        picked = [tuple(F.when(outward, u).otherwise(v) for u, v in zip(a, b)) for a, b in zip(one, other)]
        return F.struct((first + k).alias("tid"), *corner_columns(picked))

    faces = F.array(
        face(0, (tops[0], bases[0], tops[1]), (tops[0], tops[1], bases[0])),
        face(1, (bases[0], bases[1], tops[1]), (bases[0], tops[1], bases[1])),
    )
    cornered = pairs.select(F.col("grid_id").alias("mesh_id"), F.explode(faces).alias("_t")).select("mesh_id", "_t.*")
    vertices = (
        pairs.select(F.col("grid_id").alias("mesh_id"), F.explode(F.array(*map(_vertex, tops + bases))).alias("_v"))
        .select("mesh_id", "_v.*")
        .groupBy("mesh_id", "vid")
        .agg(*[F.any_value(c).alias(c) for c in "xyz"])
    )
    return cornered_mesh(vertices, cornered)


def join_parts(*parts: Mesh) -> Mesh:
    """Surface, base and walls of the same grids as one mesh; shared corners are kept once."""
    vertices, triangles, cornered = parts[0].vertices, parts[0].triangles, parts[0].cornered
    for part in parts[1:]:
        vertices, triangles = vertices.unionByName(part.vertices), triangles.unionByName(part.triangles)
        cornered = None if cornered is None or part.cornered is None else cornered.unionByName(part.cornered)
    unique = vertices.groupBy("mesh_id", "vid").agg(*[F.any_value(c).alias(c) for c in "xyz"])
    return Mesh(unique, triangles) if cornered is None else cornered_mesh(unique, cornered)


def triangulation_stats(grid: DataFrame, grids: DataFrame, base: bool = True, walls: bool = True) -> DataFrame:
    """Triangle counts by part, 2 x 2 groups skipped for a void, elevation range and size, per grid.

    Counted from the groups themselves; no triangle is made for it.
    """
    surface = quads(grid).groupBy("grid_id").agg(F.count(F.lit(1)).alias("_groups"))
    sized = grids.select("grid_id", "width", "height").join(surface, "grid_id", "left")
    possible = (F.col("width") - 1).cast("long") * (F.col("height") - 1)
    kept = F.coalesce(F.col("_groups"), F.lit(0))
    if walls:
        wall = side_walls(grid, grids, 0.0).triangles.groupBy(F.col("mesh_id").alias("grid_id")).agg(
            F.count(F.lit(1)).alias("_walls")
        )
        sized = sized.join(wall, "grid_id", "left")
    return sized.join(elevation_range(grid), "grid_id", "left").select(
        "grid_id",
        (kept * 2).alias("surface_triangles"),
        (possible * 2 if base else F.lit(0).cast("long")).alias("base_triangles"),
        (F.coalesce(F.col("_walls"), F.lit(0)) if walls else F.lit(0).cast("long")).alias("wall_triangles"),
        (possible - kept).alias("skipped_voids"),
        F.coalesce("min_elev", F.lit(0.0)).alias("min_elev"),
        F.coalesce("max_elev", F.lit(0.0)).alias("max_elev"),
        "width",
        "height",
    )
