"""Meshes: closed solids, consistent winding, heightmaps with base and walls."""

import pytest
from pyspark.sql import functions as F

from checks import fixtures
from isoterra.operators import heightmap, mesh
from isoterra.operators.components import components
from isoterra.operators.raster import filled_cells
from isoterra.operators.rings import rings
from isoterra.operators.solid import extrude_layers
from tests.helpers import grid_of, mask_of, masks_of, random_mask
from tests.test_areas import SHAPES


def slabs(spark, names=("g",)):
    return spark.createDataFrame([(n, 0, 1.0, 3.0) for n in names], "grid_id string, layer int, z_base double, z_top double")


def by_mesh(df):
    found = {}
    for row in df.collect():
        found.setdefault(row.mesh_id, []).append(row)
    return found


def directed(triangles):
    edges = []
    for t in triangles:
        edges += [(t.v0, t.v1), (t.v1, t.v2), (t.v2, t.v0)]
    return edges


def volume(vertices, triangles):
    at = {v.vid: (v.x, v.y, v.z) for v in vertices}
    total = 0.0
    for t in triangles:
        (ax, ay, az), (bx, by, bz), (cx, cy, cz) = at[t.v0], at[t.v1], at[t.v2]
        total += ax * (by * cz - bz * cy) + ay * (bz * cx - bx * cz) + az * (bx * cy - by * cx)
    return total / 6


def test_extrusion_is_closed_and_wound_outwards(spark):
    mask, grids = masks_of(spark, SHAPES)
    solid = extrude_layers(mask, slabs(spark, SHAPES), grids, block=8)
    reports = {r.mesh_id: r for r in mesh.validate_mesh(solid).collect()}
    vertices, triangles = by_mesh(solid.vertices), by_mesh(solid.triangles)
    for name, lines in SHAPES.items():
        mesh_id = f"{name}#0"
        assert reports[mesh_id].valid, reports[mesh_id]
        edges = directed(triangles[mesh_id])
        assert len(set(edges)) == len(edges) and {(b, a) for a, b in edges} == set(edges)
        assert volume(vertices[mesh_id], triangles[mesh_id]) == pytest.approx(2.0 * sum(r.count("#") for r in lines))


def inside_of(lines):
    """Cells the outside cannot reach by side steps."""
    height, width = len(lines), len(lines[0])
    outside, stack = set(), [(-1, -1)]
    while stack:
        r, c = stack.pop()
        if (r, c) in outside or not (-1 <= r <= height and -1 <= c <= width):
            continue
        if 0 <= r < height and 0 <= c < width and lines[r][c] == "#":
            continue
        outside.add((r, c))
        stack += [(r + 1, c), (r - 1, c), (r, c + 1), (r, c - 1)]
    return {(r, c) for r in range(height) for c in range(width)} - outside


def test_filled_cells(spark):
    mask, grids = masks_of(spark, SHAPES)
    got = {}
    for r in filled_cells(rings(components(mask, grids), grids), grids).collect():
        got.setdefault(r.grid_id, set()).add((r.grid_row, r.grid_col))
    assert got == {name: inside_of(lines) for name, lines in SHAPES.items()}


@pytest.mark.parametrize("mode", ["terrain", "flat"])
def test_heightmap_with_base_and_walls(spark, mode):
    values = [[(r * 7 + c * 3) % 5 + 10 for c in range(6)] for r in range(5)]
    grid, grids = grid_of(spark, values)
    surface = heightmap.heightmap_triangles(grid, grids, mode)
    solid = heightmap.join_parts(
        surface, heightmap.base_platform(grids, 0.0), heightmap.side_walls(grid, grids, 0.0, mode)
    )
    counts = solid.triangles.agg(F.count("tid"), F.countDistinct("tid")).collect()[0]
    assert counts[0] == counts[1] == 2 * 20 * 2 + 2 * (2 * 5 + 2 * 4)
    report = mesh.validate_mesh(solid).collect()[0]
    # Flat cells stand apart, so only the terrain surface closes.
    assert report.watertight == (mode == "terrain")


def test_wide_rows_cross_pair_blocks(spark, monkeypatch):
    monkeypatch.setattr(heightmap, "PAIR_BLOCK", 3)
    values = [[r * 10 + c if (r, c) != (1, 4) else None for c in range(10)] for r in range(3)]
    grid, _ = grid_of(spark, values)
    got = {(q.row, q.col): (q.z00, q.z10, q.z01, q.z11) for q in heightmap.quads(grid).collect()}
    want = {}
    for r in range(2):
        for c in range(9):
            z = (values[r][c], values[r][c + 1], values[r + 1][c], values[r + 1][c + 1])
            if None not in z:
                want[(r, c)] = z
    assert got == want


def test_stack_and_repair(spark):
    mask, grids = mask_of(spark, random_mask(6, 6, 0.5, 8))
    upper = mask.unionByName(mask.withColumn("layer", F.lit(1)))
    both = slabs(spark).unionByName(slabs(spark).withColumn("layer", F.lit(1)))
    solids = extrude_layers(upper, both, grids)
    stacked = mesh.stack_meshes(solids)
    report = mesh.validate_mesh(stacked).collect()
    assert len(report) == 1 and report[0].valid
    assert report[0].triangles == solids.triangles.count() == mesh.repair_mesh(solids).triangles.count()


@pytest.mark.parametrize("kind", ["surface", "flat", "layers", "base", "walls", "solid", "stacked", "printed", "repaired"])
def test_corners_from_birth_are_those_of_the_vertices(spark, kind):
    cells = [("g", r, c, None if (r, c) == (1, 2) else float((r * 7 + c * 5) % 11)) for r in range(5) for c in range(6)]
    grid = spark.createDataFrame(cells, "grid_id string, grid_row int, grid_col int, elev float")
    grids = spark.createDataFrame([("g", 10.0, 0.5, 0.0, 40.0, 0.0, -0.5, 6, 5)], "grid_id string, x0 double, dx double, rx double, y0 double, ry double, dy double, width int, height int")
    layered = grid.where("elev >= 4").select("grid_id", F.lit(0).alias("layer"), "grid_row", "grid_col")
    slabs = spark.createDataFrame([("g", 0, 1.0, 2.0)], "grid_id string, layer int, z_base double, z_top double")
    surface = heightmap.heightmap_triangles(grid, grids)
    made = {
        "surface": lambda: surface,
        "flat": lambda: heightmap.heightmap_triangles(grid, grids, "flat"),
        "layers": lambda: heightmap.heightmap_layers(grid, grids, 3),
        "base": lambda: heightmap.base_platform(grids, -1.0),
        "walls": lambda: heightmap.join_parts(surface, heightmap.base_platform(grids, -1.0), heightmap.side_walls(grid, grids, -1.0)),
        "solid": lambda: extrude_layers(layered, slabs, grids),
        "stacked": lambda: mesh.stack_meshes(heightmap.heightmap_layers(grid, grids, 3)),
        "printed": lambda: mesh.print_transform(surface, bed_mm=100.0),
        "repaired": lambda: mesh.repair_mesh(surface),
    }[kind]()
    looked_up = mesh.with_corners(mesh.Mesh(made.vertices, made.triangles)).select(*made.cornered.columns)
    assert made.cornered.count() > 0
    assert sorted(map(tuple, made.cornered.collect())) == sorted(map(tuple, looked_up.collect()))


# Java leaves longer methods (in bytes of code) to its interpreter, which is tens of times slower.
COMPILED_BYTES = 8000


def longest_method(spark, df):
    """Size of the longest method that Spark generates for a frame, without running it."""
    adaptive = spark.conf.get("spark.sql.adaptive.enabled")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        found = df.select("*")._jdf.queryExecution().debug().codegenToSeq()
        return max(found.apply(i)._3().maxMethodCodeSize() for i in range(found.size()))
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", adaptive)


def test_faces_of_solids_run_as_compiled_code(spark):
    mask, grids = mask_of(spark, random_mask(6, 6, 0.5, 8))
    solid = extrude_layers(mask, slabs(spark), grids, metres=True)
    for df in (mesh.mesh_edges(solid), mesh.triangle_geometry(solid), solid.cornered, solid.vertices):
        assert 0 < longest_method(spark, df) < COMPILED_BYTES
        # Functions over arrays are interpreted together with all that they are given.
        assert "lambda" not in df._jdf.queryExecution().optimizedPlan().toString()


def test_elevations_of_clean_grids_are_computed_once(spark):
    assert 0 < longest_method(spark, fixtures.clean(spark, "/root/testdata/sf0.001")) < COMPILED_BYTES
