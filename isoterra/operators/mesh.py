"""Triangle meshes as tables: checks, geometry, topology, repair, stacking, lookup, print transform.

`vertices` is (mesh_id, vid, x, y, z), `triangles` is (mesh_id, tid, v0, v1, v2). Meshes made from cells also
carry `cornered`, the triangles with the coordinates of their corners (x0..z2), which are at hand where a
triangle is born; nothing then looks a corner up.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from isoterra.spread import attach, cut, lookup

# Vertex tolerance, smallest area, height of an elevation band, share of the bed used.
VERTEX_TOLERANCE = 1e-6
DEGENERATE_AREA = 1e-12
BAND_HEIGHT = 10.0
BED_SHARE = 0.9

TRIANGLE = ["mesh_id", "tid"]
CORNERS = ["v0", "v1", "v2"]


COORDINATES = [f"{c}{k}" for k in range(3) for c in "xyz"]


@dataclass(frozen=True)
class Mesh:
    vertices: DataFrame
    triangles: DataFrame
    cornered: DataFrame | None = None


def cornered_mesh(vertices: DataFrame, cornered: DataFrame) -> Mesh:
    """A mesh of triangles that carry the coordinates of their corners."""
    return Mesh(vertices, cornered.select(*TRIANGLE, *CORNERS), cornered.select(*TRIANGLE, *CORNERS, *COORDINATES))


def corner_columns(points: list[tuple[Column, Column, Column, Column]]) -> list[Column]:
    """Columns v0..v2 and x0..z2 of three corners (vid, x, y, z)."""
    ids = [p[0].alias(f"v{k}") for k, p in enumerate(points)]
    return ids + [v.cast("double").alias(f"{c}{k}") for k, p in enumerate(points) for c, v in zip("xyz", p[1:])]


def settled(mesh: Mesh) -> Mesh:
    """The mesh written once; triangles and their corners are one table if the corners are known."""
    if mesh.cornered is None:
        return Mesh(cut(mesh.vertices), cut(mesh.triangles))
    return cornered_mesh(cut(mesh.vertices), cut(mesh.cornered))


def _by_corner(triangles: DataFrame) -> DataFrame:
    """Three rows (mesh_id, tid, corner, vid) per triangle."""
    return triangles.select(*TRIANGLE, F.posexplode(F.array(*CORNERS)).alias("corner", "vid"))


def _regroup(cornered: DataFrame, values: dict[str, Column]) -> DataFrame:
    """One row per triangle again; value `v` of corner k becomes column `v{k}`."""
    picks = [
        F.max(F.when(F.col("corner") == k, value)).alias(f"{name}{k}") for k in range(3) for name, value in values.items()
    ]
    return cornered.groupBy(*TRIANGLE).agg(*picks)


def with_corners(mesh: Mesh) -> DataFrame:
    """Triangles with the coordinates of their corners (x0..z2), NULL where a vertex is missing.

    Where the mesh does not carry them, all three corners are looked up in one join, so the vertex table
    is shuffled once.
    """
    if mesh.cornered is not None:
        return mesh.cornered
    found = lookup(_by_corner(mesh.triangles), mesh.vertices, ["mesh_id", "vid"], "left")
    return _regroup(found, {"v": F.col("vid"), "x": F.col("x"), "y": F.col("y"), "z": F.col("z")})


def dedup_vertices(mesh: Mesh, tol: float = VERTEX_TOLERANCE) -> Mesh:
    """Merge vertices that round to the same multiple of tol; the lowest vid stays."""
    places = {f"_k{c}": F.round(F.col(c) / tol).cast("long") for c in "xyz"}
    keyed = mesh.vertices.withColumns(places)
    keys = ["mesh_id", *places]
    # The lowest vid per place is combined before the shuffle, so many copies of one point stay cheap.
    first = keyed.groupBy(*keys).agg(F.min("vid").alias("_first"))
    renamed = lookup(keyed, first, keys).select(*mesh.vertices.columns, "_first")
    kept = renamed.where(F.col("vid") == F.col("_first")).drop("_first")
    mapping = renamed.select("mesh_id", "vid", "_first")
    moved = lookup(_by_corner(mesh.triangles), mapping, ["mesh_id", "vid"])
    triangles = _regroup(moved, {"v": F.col("_first")})
    return Mesh(kept, triangles.select(*TRIANGLE, *CORNERS))


def _vector(a: int, b: int) -> list[Column]:
    return [F.col(f"{c}{b}") - F.col(f"{c}{a}") for c in "xyz"]


def _square(v: list[Column]) -> Column:
    return v[0] * v[0] + v[1] * v[1] + v[2] * v[2]


def _valid(tol: float) -> Column:
    distinct = (F.col("v0") != F.col("v1")) & (F.col("v1") != F.col("v2")) & (F.col("v2") != F.col("v0"))
    apart = [_square(_vector(a, b)) >= tol * tol for a, b in ((0, 1), (1, 2), (2, 0))]
    # A missing vertex has NULL coordinates and so fails the distance tests.
    return F.coalesce(distinct & apart[0] & apart[1] & apart[2], F.lit(False))


def valid_triangles(mesh: Mesh, tol: float = VERTEX_TOLERANCE) -> DataFrame:
    """Triangles whose vertices exist, have distinct ids and lie at least tol apart."""
    return with_corners(mesh).where(_valid(tol)).select(*TRIANGLE, *CORNERS)


def corner_geometry(mesh: Mesh, tol: float = VERTEX_TOLERANCE) -> DataFrame:
    """Triangles with their corners' coordinates, unit normal, area and validity; an invalid one gets (0, 0, 1) and 0."""
    a, b = _vector(0, 1), _vector(0, 2)
    crossed = with_corners(mesh).withColumns(
        {
            "_valid": _valid(tol),
            "_cx": a[1] * b[2] - a[2] * b[1],
            "_cy": a[2] * b[0] - a[0] * b[2],
            "_cz": a[0] * b[1] - a[1] * b[0],
        }
    )
    sized = crossed.withColumn("_length", F.sqrt(_square([F.col("_cx"), F.col("_cy"), F.col("_cz")])))

    def unit(c: str, flat: float) -> Column:
        # A valid triangle without area has no direction; its normal is the zero vector.
        along = F.when(F.col("_length") > 0, F.col(c) / F.col("_length")).otherwise(0.0)
        return F.when(F.col("_valid"), along).otherwise(F.lit(flat))

    return sized.select(
        *TRIANGLE,
        *CORNERS,
        *COORDINATES,
        unit("_cx", 0.0).alias("nx"),
        unit("_cy", 0.0).alias("ny"),
        unit("_cz", 1.0).alias("nz"),
        F.when(F.col("_valid"), F.col("_length") / 2.0).otherwise(0.0).alias("area"),
        F.col("_valid").alias("valid"),
    )


def triangle_geometry(mesh: Mesh, tol: float = VERTEX_TOLERANCE) -> DataFrame:
    """Unit normal and area per triangle; an invalid one gets (0, 0, 1) and 0."""
    return corner_geometry(mesh, tol).drop(*COORDINATES)


def edge_triangles(triangles: DataFrame) -> DataFrame:
    """Long form (mesh_id, lo, hi, tid): every triangle of every undirected edge."""
    sides = F.array(*[F.struct(F.col(a).alias("a"), F.col(b).alias("b")) for a, b in (("v0", "v1"), ("v1", "v2"), ("v2", "v0"))])
    return triangles.select(*TRIANGLE, F.explode(sides).alias("_e")).select(
        "mesh_id", F.least("_e.a", "_e.b").alias("lo"), F.greatest("_e.a", "_e.b").alias("hi"), "tid"
    )


def mesh_edges(mesh: Mesh) -> DataFrame:
    """Undirected edges with the number of triangles on them, the first and the last.

    `edge_triangles` lists all triangles of an edge; no edge is gathered into one array here.
    """
    return (
        edge_triangles(mesh.triangles)
        .groupBy("mesh_id", "lo", "hi")
        .agg(F.count(F.lit(1)).alias("triangles"), F.min("tid").alias("first_tid"), F.max("tid").alias("last_tid"))
        .withColumn("boundary", F.col("triangles") == 1)
        .withColumn("manifold", F.col("triangles") <= 2)
    )


def validate_mesh(mesh: Mesh, tol: float = VERTEX_TOLERANCE) -> DataFrame:
    """Topology report per mesh; valid means manifold, watertight and without degenerate triangles."""
    edges = mesh_edges(mesh).groupBy("mesh_id").agg(
        F.count(F.lit(1)).alias("edges"),
        F.count_if("boundary").alias("boundary_edges"),
        F.count_if(~F.col("manifold")).alias("excess_edges"),
    )
    flat = (F.col("area") < DEGENERATE_AREA) | ~F.col("valid")
    faces = triangle_geometry(mesh, tol).groupBy("mesh_id").agg(
        F.count(F.lit(1)).alias("triangles"), F.count_if(flat).alias("degenerate")
    )
    manifold = F.col("excess_edges") == 0
    watertight = manifold & (F.col("boundary_edges") == 0)
    return edges.join(faces, "mesh_id").select(
        "mesh_id",
        "triangles",
        "edges",
        "boundary_edges",
        "excess_edges",
        "degenerate",
        manifold.alias("manifold"),
        watertight.alias("watertight"),
        (manifold & watertight & (F.col("degenerate") == 0)).alias("valid"),
    )


def repair_mesh(mesh: Mesh) -> Mesh:
    """Drop triangles without area; the edges follow from the triangles."""
    return cornered_mesh(mesh.vertices, corner_geometry(mesh).where(F.col("area") >= DEGENERATE_AREA))


def mesh_extents(mesh: Mesh, overall: bool = False) -> DataFrame:
    """Box, xy extent (larger side) and z extent per mesh, or over all meshes."""
    groups = [] if overall else ["mesh_id"]
    box = mesh.vertices.groupBy(*groups).agg(
        *[f(c).alias(f"{n}_{c}") for n, f in (("min", F.min), ("max", F.max)) for c in "xyz"]
    )
    return box.withColumns(
        {
            "xy_extent": F.greatest(F.col("max_x") - F.col("min_x"), F.col("max_y") - F.col("min_y")),
            "z_extent": F.col("max_z") - F.col("min_z"),
        }
    )


def stack_meshes(mesh: Mesh, stacked_id: str = "stacked") -> Mesh:
    """All meshes as one, in the order of mesh_id, vertex and triangle ids shifted apart."""
    before = Window.orderBy("mesh_id").rowsBetween(Window.unboundedPreceding, -1)

    def offsets(df: DataFrame, column: str) -> DataFrame:
        # One row per mesh; the window runs over meshes, never over their rows.
        sizes = df.groupBy("mesh_id").agg((F.max(column) + 1).alias("_size"))
        return sizes.select("mesh_id", F.coalesce(F.sum("_size").over(before), F.lit(0)).alias(f"_shift_{column}"))

    v_shift, t_shift = offsets(mesh.vertices, "vid"), offsets(mesh.triangles, "tid")
    vertices = attach(mesh.vertices, v_shift, ["mesh_id"], ["vid"])
    shifts = v_shift.join(t_shift, "mesh_id")
    own = F.lit(stacked_id).alias("mesh_id")

    def shifted(triangles: DataFrame, *more: str) -> DataFrame:
        moved = attach(triangles, shifts, ["mesh_id"], ["tid"])
        corners = [(F.col(c) + F.col("_shift_vid")).alias(c) for c in CORNERS]
        return moved.select(own, (F.col("tid") + F.col("_shift_tid")).alias("tid"), *corners, *more)

    points = vertices.select(own, (F.col("vid") + F.col("_shift_vid")).alias("vid"), "x", "y", "z")
    if mesh.cornered is not None:
        return cornered_mesh(points, shifted(mesh.cornered, *COORDINATES))
    return Mesh(points, shifted(mesh.triangles))


def band_index(mesh: Mesh, height: float = BAND_HEIGHT) -> DataFrame:
    """Rows (mesh_id, band, band_min, band_max, tid): each triangle in every elevation band it touches.

    Bands start at the lowest height of the mesh; a flat mesh has no index.
    """
    spans = with_corners(mesh).select(
        *TRIANGLE, F.least("z0", "z1", "z2").alias("_low"), F.greatest("z0", "z1", "z2").alias("_high")
    )
    frame = spans.groupBy("mesh_id").agg(F.min("_low").alias("_min"), F.max("_high").alias("_max"))
    frame = frame.where("_min < _max").withColumn("_bands", F.ceil((F.col("_max") - F.col("_min")) / height) + 1)
    placed = attach(spans, frame, ["mesh_id"], ["tid"])
    first = F.floor((F.col("_low") - F.col("_min")) / height).cast("int")
    last = F.floor(F.least((F.col("_bands") - 1).cast("double"), (F.col("_high") - F.col("_min")) / height)).cast("int")
    banded = placed.withColumn("band", F.explode(F.sequence(first, last)))
    return banded.select(
        "mesh_id",
        "band",
        (F.col("_min") + F.col("band") * height).alias("band_min"),
        (F.col("_min") + (F.col("band") + 1) * height).alias("band_max"),
        "tid",
    )


def near_elevation(index: DataFrame, elevation: float, tol: float) -> DataFrame:
    """Distinct triangles of all bands that overlap [elevation - tol, elevation + tol]; a coarse answer."""
    touched = (F.col("band_min") <= elevation + tol) & (F.col("band_max") > elevation - tol)
    return index.where(touched).select(*TRIANGLE).distinct()


def print_frame(mesh: Mesh, factor: float | None = None, bed_mm: float | None = None) -> DataFrame:
    """(mesh_id, _scale, _mid_x, _mid_y, _mid_z) of every mesh: the print transform as one row."""
    if (factor is None) == (bed_mm is None):
        raise ValueError("give either factor or bed_mm")
    if factor is not None:
        scale = F.lit(float(factor))
    else:
        scale = F.when(F.col("xy_extent") > 0, F.lit(bed_mm * BED_SHARE) / F.col("xy_extent")).otherwise(1.0)
    middles = [((F.col(f"min_{c}") + F.col(f"max_{c}")) / 2.0).alias(f"_mid_{c}") for c in "xyz"]
    return mesh_extents(mesh).select("mesh_id", scale.alias("_scale"), *middles)


def printed(column: str) -> Column:
    """A coordinate column (x, y, z, x0, ...) of rows with a `print_frame`, moved and scaled."""
    return ((F.col(column) - F.col(f"_mid_{column[0]}")) * F.col("_scale")).alias(column)


def print_transform(mesh: Mesh, factor: float | None = None, bed_mm: float | None = None) -> Mesh:
    """Centre every mesh on its box and scale all axes alike.

    Either by a factor, or to 0.9 of the bed (1.0 for a mesh without extent).
    """
    frame = print_frame(mesh, factor, bed_mm)
    vertices = attach(mesh.vertices, frame, ["mesh_id"], ["vid"]).select("mesh_id", "vid", *[printed(c) for c in "xyz"])
    if mesh.cornered is None:
        return Mesh(vertices, mesh.triangles)
    cornered = attach(mesh.cornered, frame, ["mesh_id"], ["tid"])
    return cornered_mesh(vertices, cornered.select(*TRIANGLE, *CORNERS, *[printed(c) for c in COORDINATES]))
