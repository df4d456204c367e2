"""Mesh files as lines: ASCII STL, OBJ with materials, ASCII PLY."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from isoterra.functions.numbers import with_text
from isoterra.operators.mesh import (
    COORDINATES,
    CORNERS,
    Mesh,
    corner_geometry,
    mesh_extents,
    print_frame,
    printed,
    valid_triangles,
)
from isoterra.operators.style import band_materials, triangle_band, vertex_ramp
from isoterra.sinks.text import write_lines
from isoterra.spread import BLOCK, attach, cut, dense_ids, lookup

# Decimals of coordinates and colours, name of a solid, normal written for vertices.
DIGITS, COLOR_DIGITS = 6, 3
SOLID = "topographic_model"
VERTEX_NORMAL = (0.0, 0.0, 1.0)
ORDER = ["mesh_id", "section", "line"]


def _texts(*columns: str) -> Column:
    return F.concat_ws(" ", *[F.col(f"{c}_text") for c in columns])


def _lines(df: DataFrame, section: int, line: Column, value: Column) -> DataFrame:
    return df.select("mesh_id", F.lit(section).alias("section"), line.cast("long").alias("line"), value.alias("value"))


def _union(first: DataFrame, *rest: DataFrame) -> DataFrame:
    for df in rest:
        first = first.unionByName(df)
    return first


def stl_lines(mesh: Mesh, factor: float | None = None, bed_mm: float | None = None, solid: str = SOLID) -> DataFrame:
    """Lines of one ASCII STL document per mesh, printed at a factor or fitted to a bed.

    Normals are those of the mesh before scaling. Every facet is one row of seven text lines.
    """
    # One row per mesh, written once: it moves the facets and names the documents.
    frame = cut(print_frame(mesh, factor, bed_mm))
    facets = attach(corner_geometry(mesh), frame, ["mesh_id"], ["tid"])
    facets = facets.select("mesh_id", "tid", "nx", "ny", "nz", *[printed(c) for c in COORDINATES])
    places = [[f"{c}{k}" for c in "xyz"] for k in range(3)]
    facets = with_text(facets, [*COORDINATES, "nx", "ny", "nz"], DIGITS)
    corners = [F.concat(F.lit("      vertex "), _texts(*p)) for p in places]
    facet = F.concat_ws(
        "\n",
        F.concat(F.lit("  facet normal "), _texts("nx", "ny", "nz")),
        F.lit("    outer loop"),
        *corners,
        F.lit("    endloop"),
        F.lit("  endfacet"),
    )
    whole = facets.where(" and ".join(f"x{k} is not null" for k in range(3)))
    meshes = frame.select("mesh_id")
    return _union(
        _lines(meshes, 0, F.lit(0), F.lit(f"solid {solid}")),
        _lines(whole, 1, F.col("tid"), facet),
        _lines(meshes, 2, F.lit(0), F.lit(f"endsolid {solid}")),
    )


def _dense_mesh(mesh: Mesh, tol: float) -> tuple[DataFrame, DataFrame]:
    """Vertices with `n` and valid triangles with `n0..n2`, numbered 0.. over all meshes in order."""
    vertices = dense_ids(mesh.vertices, ["mesh_id", "vid"], "n")
    faces = valid_triangles(mesh, tol)
    by_corner = faces.select("mesh_id", "tid", F.posexplode(F.array(*CORNERS)).alias("_k", "vid"))
    numbered = lookup(by_corner, vertices.select("mesh_id", "vid", "n"), ["mesh_id", "vid"])
    picks = [F.max(F.when(F.col("_k") == k, F.col("n"))).alias(f"n{k}") for k in range(3)]
    return vertices, numbered.groupBy("mesh_id", "tid").agg(*picks)


def _material_changes(faces: DataFrame, block: int = BLOCK) -> DataFrame:
    """Faces (mesh_id, face, band, ...) with `changed`: the band differs from the face before.

    `face` counts without gaps, so a window over one block plus the last face of the block before
    is enough.
    """
    own = F.expr(f"face div {block}")
    ends_block = F.col("face") % block == block - 1
    spread = faces.withColumn("_block", F.explode(F.when(ends_block, F.array(own, own + 1)).otherwise(F.array(own))))
    along = Window.partitionBy("_block").orderBy("face")
    same = (F.lag("band").over(along) == F.col("band")) & (F.lag("mesh_id").over(along) == F.col("mesh_id"))
    return spread.withColumn("changed", ~F.coalesce(same, F.lit(False))).where(F.col("_block") == own).drop("_block")


def obj_lines(mesh: Mesh, bands: int = 0, normals: bool = True, scheme: str | list[tuple] = "terrain", tol: float = 1e-6) -> DataFrame:
    """Lines of one OBJ document: every mesh a group, vertices numbered 1.. over all groups.

    With `bands` faces name the material of their elevation band whenever it changes.
    """
    vertices, faces = _dense_mesh(mesh, tol)
    meshes = mesh.vertices.select("mesh_id").distinct()
    at = [F.concat(F.col(f"n{k}") + 1, F.lit("//"), F.col(f"n{k}") + 1) if normals else F.col(f"n{k}") + 1 for k in range(3)]
    text = F.concat(F.lit("f "), F.concat_ws(" ", *[c.cast("string") for c in at]))
    if bands:
        box = mesh_extents(mesh).select("mesh_id", F.col("min_z").alias("min_elev"), F.col("max_z").alias("max_elev"))
        names = band_materials(box, bands, scheme, "mesh_id").select("mesh_id", "band", "name")
        banded = faces.join(triangle_band(mesh, bands).select("mesh_id", "tid", "band"), ["mesh_id", "tid"])
        marked = _material_changes(dense_ids(banded, ["mesh_id", "tid"], "face"))
        faces = attach(marked, names, ["mesh_id", "band"], ["tid"])
        text = F.concat(F.when(F.col("changed"), F.concat(F.lit("usemtl "), F.col("name"), F.lit("\n"))).otherwise(""), text)
    group = F.concat(F.lit("g "), F.col("mesh_id"), F.lit("\no "), F.col("mesh_id"))
    parts = [
        _lines(meshes, 1, F.lit(0), group),
        _lines(with_text(vertices, ["x", "y", "z"], DIGITS), 2, F.col("n"), F.concat(F.lit("v "), _texts("x", "y", "z"))),
        _lines(faces, 4, F.col("tid"), text),
    ]
    if normals:
        up = "vn " + " ".join(f"{v:.{DIGITS}f}" for v in VERTEX_NORMAL)
        parts.append(_lines(vertices, 3, F.col("n"), F.lit(up)))
    return _union(*parts)


def mtl_lines(materials: DataFrame) -> DataFrame:
    """Lines of the material library of `band_materials` rows keyed by mesh_id; one row per material."""

    def colors(kind: str) -> Column:
        return _texts(*[f"{kind}_{c}" for c in "rgb"])

    numbers = [f"{kind}_{c}" for kind in ("ambient", "diffuse") for c in "rgb"] + ["specular", "shininess"]
    materials = with_text(materials, numbers, COLOR_DIGITS)
    specular = F.col("specular_text")
    value = F.concat_ws(
        "\n",
        F.concat(F.lit("newmtl "), F.col("name")),
        F.concat(F.lit("Ka "), colors("ambient")),
        F.concat(F.lit("Kd "), colors("diffuse")),
        F.concat(F.lit("Ks "), F.concat_ws(" ", specular, specular, specular)),
        F.concat(F.lit("Ns "), F.col("shininess_text")),
        F.lit(""),
    )
    return _lines(materials, 0, F.col("band"), value)


def ply_lines(mesh: Mesh, colors: bool = True, normals: bool = True, tol: float = 1e-6) -> DataFrame:
    """Lines of one ASCII PLY document per mesh, vertices numbered 0.. per document."""
    colored = Mesh(vertex_ramp(mesh), mesh.triangles, mesh.cornered)
    vertices, faces = _dense_mesh(colored, tol)
    starts = vertices.groupBy("mesh_id").agg(F.min("n").alias("_start"), F.count(F.lit(1)).alias("_vertices"))
    counts = starts.join(faces.groupBy("mesh_id").agg(F.count(F.lit(1)).alias("_faces")), "mesh_id", "left")
    listed = attach(faces, starts.select("mesh_id", "_start"), ["mesh_id"], ["tid"])
    properties = [f"property float {c}" for c in "xyz"]
    written = [_texts("x", "y", "z")]
    if normals:
        properties += [f"property float n{c}" for c in "xyz"]
        written.append(F.lit(" ".join(f"{v:.{DIGITS}f}" for v in VERTEX_NORMAL)))
    if colors:
        properties += [f"property uchar {c}" for c in ("red", "green", "blue")]
        written.append(F.concat_ws(" ", *[F.col(c).cast("string") for c in "rgb"]))
    head = F.concat(
        F.lit("ply\nformat ascii 1.0\nelement vertex "),
        F.col("_vertices"),
        F.lit("\n" + "\n".join(properties) + "\nelement face "),
        F.coalesce("_faces", F.lit(0)),
        F.lit("\nproperty list uchar int vertex_indices\nend_header"),
    )
    corners = [(F.col(f"n{k}") - F.col("_start")).cast("string") for k in range(3)]
    return _union(
        _lines(counts, 0, F.lit(0), head),
        _lines(with_text(vertices, ["x", "y", "z"], DIGITS), 1, F.col("n"), F.concat_ws(" ", *written)),
        _lines(listed, 2, F.col("tid"), F.concat_ws(" ", F.lit("3"), *corners)),
    )


def write_mesh(lines: DataFrame, path: str, per_mesh: bool = True) -> None:
    """Write mesh lines in order, one folder per mesh or one document for all (OBJ)."""
    if per_mesh:
        write_lines(lines, path, ["section", "line"], ["mesh_id"])
    else:
        write_lines(lines, path, ORDER)
