"""Sources, sinks and whole products on tiny grids."""

import gzip
import json
import xml.etree.ElementTree as ET
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F

from checks import fixtures, layer_queries
from isoterra.operators.heightmap import heightmap_triangles
from isoterra.operators.raster import outline_pixels, raster_frame
from isoterra.plans.products import Job, contour_product, layered_solid, terrain_mesh
from isoterra.sinks import features, geojson, meshtext, svg
from isoterra.sources.hgt import hgt_geometry, scan_hgt
from tests.helpers import grid_of

PYRAMID = [[1, 1, 1, 1, 1], [1, 2, 2, 2, 1], [1, 2, 3, 2, 1], [1, 2, 2, 2, 1], [1, 1, 1, 1, 1]]
CRATER = [[1] * 7, [1, 5, 5, 5, 5, 5, 1], [1, 5, 1, 1, 1, 5, 1], [1, 5, 1, 5, 1, 5, 1], [1, 5, 1, 1, 1, 5, 1], [1, 5, 5, 5, 5, 5, 1], [1] * 7]


def document(folder):
    """Part files in name order make up the document."""
    return "".join(p.read_text() for p in sorted(Path(folder).glob("part-*")))


def test_hgt_scan(spark, tmp_path):
    values = np.arange(121, dtype=">i2").reshape(11, 11)
    values[2, 3] = -32768
    (tmp_path / "N63").mkdir()
    (tmp_path / "N63" / "N63W152.hgt.gz").write_bytes(gzip.compress(values.tobytes()))
    (tmp_path / "S01E007.hgt").write_bytes((values + 1).astype(">i2").tobytes())
    rows = scan_hgt(spark, str(tmp_path)).collect()
    assert len(rows) == 242 and scan_hgt(spark, str(tmp_path), ["N63W152", "N01E001"]).count() == 121
    found = {(r.grid_id, r.grid_row, r.grid_col): r.elev for r in rows}
    assert found[("N63W152", 2, 3)] is None and found[("N63W152", 10, 10)] == 120.0 and found[("S01E007", 0, 1)] == 2.0
    frame = {r.grid_id: r for r in hgt_geometry(spark, str(tmp_path)).collect()}
    assert frame["N63W152"].x0 == pytest.approx(-152.05) and frame["S01E007"].y0 == pytest.approx(0.05)


def test_pyramid_layers(spark):
    grid, grids = grid_of(spark, PYRAMID)
    product = contour_product(grid, grids, Job(layers=2))
    layers = sorted(product.layers.collect(), key=lambda r: r.layer)
    # Levels 1 and 2: the whole square and the inner 3 x 3.
    assert [(r.layer_number, r.elevation, r.polygons, r.area, r.vertices) for r in layers] == [
        (1, 1.0, 1, 25.0, 5), (2, 2.0, 1, 9.0, 5),
    ]
    assert product.gate.collect()[0].verdict == "pass"
    only = contour_product(grid, grids, Job(layers=2, only_layers="2"))
    assert [(r.layer_number, r.range_min) for r in only.layers.collect()] == [(2, 1.0)]
    inset = contour_product(grid, grids, Job(layers=2, inset_mm=1.0, remove_holes=False))
    # The centre of the upper layer survives erosion and is cut out of the lower one.
    assert sorted(r.area for r in inset.layers.collect()) == [9.0, 24.0]


def test_plateau_and_void(spark):
    grid, grids = grid_of(spark, [[4, 4], [4, 4]])
    assert contour_product(grid, grids, Job(layers=2)).levels.agg(F.min("lower"), F.max("upper")).collect()[0][:] == (-46.0, 54.0)
    empty, frame = grid_of(spark, [[None, None], [None, None]])
    product = contour_product(empty, frame, Job(layers=2))
    assert product.layers.count() == 0 and product.quality.collect()[0].usable is False


def test_geojson_and_features(spark, tmp_path):
    grid, grids = grid_of(spark, CRATER)
    product = contour_product(grid, grids, Job(layers=2, remove_holes=False))
    out = str(tmp_path / "geo")
    geojson.write_geojson(product.ring_points, product.layers, out, area=True, style=True, crs="EPSG:4326")
    upper = json.loads(document(f"{out}/grid_id=g/layer=1"))
    assert upper["type"] == "FeatureCollection" and len(upper["features"]) == 2
    ring, centre = upper["features"]
    assert len(ring["geometry"]["coordinates"]) == 2 and len(centre["geometry"]["coordinates"]) == 1
    assert ring["geometry"]["coordinates"][0][0] == ring["geometry"]["coordinates"][0][-1] == [1.0, 6.0]
    assert ring["properties"]["layer"] == 2 and ring["properties"]["area"] == 25.0
    features.write_features(product.ring_points, product.layers, str(tmp_path / "features"))
    table = spark.read.parquet(str(tmp_path / "features" / "features")).where("layer = 1").orderBy("polygon_id").collect()
    assert float(table[0].area) == 25.0
    parts = spark.read.parquet(str(tmp_path / "features" / "geometry")).where("layer = 1").orderBy("polygon_id", "ring_id", "part").collect()
    texts = ["".join(p.value for p in parts if p.polygon_id == row.polygon_id) for row in table]
    assert texts[1] == "POLYGON ((3 4, 4 4, 4 3, 3 3, 3 4))"
    assert texts[0].startswith("POLYGON ((1 6, 6 6, 6 1, 1 1, 1 6), (") and texts[0].endswith("))")


def test_svg(spark, tmp_path):
    grid, grids = grid_of(spark, CRATER)
    product = contour_product(grid, grids, Job(layers=2))
    out = str(tmp_path / "svg")
    svg.write_svg(product.ring_points, product.layers, out, width_mm=90.0, margin_mm=10.0)
    root = ET.fromstring(document(f"{out}/grid_id=g/layer=0"))
    paths = root.findall(".//{http://www.w3.org/2000/svg}path")
    assert [" ".join(p.get("d").split()) for p in paths][1:] == ["M 10 10 L 80 10 L 80 80 L 10 80 Z"]
    assert len(ET.fromstring(document(f"{out}/grid_id=g/layer=1")).findall(".//{http://www.w3.org/2000/svg}path")) == 3


def test_mesh_documents(spark, tmp_path):
    grid, grids = grid_of(spark, PYRAMID)
    surface = heightmap_triangles(grid, grids)
    meshtext.write_mesh(meshtext.stl_lines(surface, bed_mm=100.0), str(tmp_path / "stl"))
    stl = document(tmp_path / "stl" / "mesh_id=g").splitlines()
    assert stl[0].startswith("solid ") and stl[-1].startswith("endsolid ") and sum("facet normal" in x for x in stl) == 32
    corners = [list(map(float, x.split()[1:])) for x in stl if "vertex" in x]
    assert min(c[0] for c in corners) == -45.0 and max(c[0] for c in corners) == 45.0
    meshtext.write_mesh(meshtext.obj_lines(surface, bands=3), str(tmp_path / "obj"), per_mesh=False)
    obj = document(tmp_path / "obj").splitlines()
    assert sum(x.startswith("v ") for x in obj) == sum(x.startswith("vn ") for x in obj) == 25
    faces = [x for x in obj if x.startswith("f ")]
    assert len(faces) == 32 and faces[0] == "f 1//1 2//2 6//6"
    used, last, changes = [], None, 0
    for x in obj:
        if x.startswith("usemtl"):
            assert x != last
            last, changes = x, changes + 1
            used.append(x)
    assert changes > 1
    meshtext.write_mesh(meshtext.ply_lines(surface), str(tmp_path / "ply"))
    ply = document(tmp_path / "ply" / "mesh_id=g").splitlines()
    end = ply.index("end_header")
    assert "element vertex 25" in ply and "element face 32" in ply and len(ply) == end + 1 + 25 + 32
    assert ply[end + 1] == "0.000000 5.000000 1.000000 0.000000 0.000000 1.000000 0 255 0" and ply[-32].startswith("3 ")


def test_terrain_and_solid(spark):
    grid, grids = grid_of(spark, PYRAMID)
    job = [("j", 200.0, None, 7, 3.0, None, None, None, "AUTO", "AUTO", None, None, False, False)]
    jobs = spark.createDataFrame(
        job,
        "job_id string, substrate_size_mm double, substrate_depth_mm double, num_layers int, layer_thickness_mm double, "
        "bed_size_mm double, bed_x_mm double, bed_y_mm double, method_2d string, method_3d string, explicit_2d double, "
        "explicit_3d double, use_3d_for_2d boolean, use_2d_for_3d boolean",
    )
    terrain = terrain_mesh(grid, grids, Job(base_mm=0.0), jobs)
    assert terrain.scaled_jobs.collect()[0].mm_per_m == pytest.approx(200 * 0.9 / 4)
    assert terrain_mesh(grid, grids, Job(slabs=2)).extents.count() == 2
    solid = layered_solid(grid, grids, Job(layers=2, stacked=True))
    assert all(r.valid for r in solid.report.collect()) and solid.report.count() == 2
    heights = {(r.layer, r.z_base, r.z_top) for r in solid.slabs.collect()}
    assert heights == {(0, 0.0, 1.0), (1, 1.0, 2.0)}


def test_outline_of_a_square(spark):
    points = spark.createDataFrame(
        [("g", 0, 1, 0, i, x, y) for i, (x, y) in enumerate([(0.0, 10.0), (10.0, 10.0), (10.0, 0.0), (0.0, 0.0)])],
        "grid_id string, layer int, polygon_id long, ring_id long, seq long, x double, y double",
    )
    box = spark.createDataFrame([("g", 0.0, 0.0, 10.0, 10.0)], "grid_id string, min_x double, min_y double, max_x double, max_y double")
    frame = raster_frame(box, 11, 0, height_px=11)
    got = {(r.px, r.py) for r in outline_pixels(points, frame).collect()}
    assert got == {(x, y) for x in range(11) for y in range(11) if x in (0, 10) or y in (0, 10)}
    thick = {(r.px, r.py) for r in outline_pixels(points, frame, 2.0).collect()}
    assert thick == {(x, y) for x in range(11) for y in range(11) if min(x, y, 10 - x, 10 - y) <= 1}


def test_mosaic_of_different_tiles_is_refused(spark):
    from isoterra.operators.grid import mosaic

    columns = "grid_id string, x0 double, dx double, rx double, y0 double, ry double, dy double, width int, height int, tile_order string"
    cells = spark.createDataFrame([("a", 0, 0, 1.0), ("b", 0, 0, 2.0)], "grid_id string, grid_row int, grid_col int, elev float")
    for other in [(1.0, 2.0), (0.5, 1.0)]:
        grids = spark.createDataFrame([("a", 0.0, 1.0, 0.0, 5.0, 0.0, -1.0, 1, 1, "a"), ("b", other[0], other[1], 0.0, 5.0, 0.0, -1.0, 1, 1, "b")], columns)
        with pytest.raises(Exception, match="differ in cell size or alignment"):
            mosaic(cells, grids).collect()


RING_POINTS = "grid_id string, layer int, polygon_id long, ring_id long, seq long, x double, y double"


def test_whole_geometry(spark):
    long = [(n % 90 / 8, n % 70 / 4) for n in range(20_000)]
    rings = {
        # An exterior of three blocks with two holes, the points given backwards.
        (1, 0): list(enumerate(long)), (1, 1): list(enumerate([(1, 1), (2, 1), (2, 2.5)])), (1, 2): [(0, (3, 3)), (1, (4, 3))],
        # No point 0, then no point of the first block, then no ring 0.
        (2, 0): [(5, (0, 0)), (6, (1, 0)), (9, (1, 1))], (2, 1): [(9_000, (7, 7)), (9_001, (8, 7))], (3, 4): [(0, (6, 6)), (1, (7, 6))],
        # A point that comes twice, a point without a coordinate, and none with both.
        (4, 0): [(0, (1, 2)), (0, (1, 2)), (1, (3, None)), (2, (4, 5))], (5, 0): [(0, (None, 1)), (1, (2, None))],
    }
    rows = [("g", 0, p, r, s, *(None if v is None else float(v) for v in point)) for (p, r), told in rings.items() for s, point in told]
    pieces = features.feature_geometry(spark.createDataFrame(rows[::-1], RING_POINTS).repartition(5))
    texts = features.whole_geometry(pieces)
    assert texts.columns == ["grid_id", "layer", "polygon_id", "wkt"]
    found = {r.polygon_id: r.wkt for r in texts.collect()}
    outer = ", ".join(f"{x:.6g} {y:.6g}" for x, y in [*long, long[0]])
    assert found == {
        1: f"POLYGON (({outer}), (1 1, 2 1, 2 2.5, 1 1), (3 3, 4 3, 3 3))",
        2: "POLYGON ((0 0, 1 0, 1 1, 0 0), (7 7, 8 7, 7 7))",
        3: "POLYGON ((6 6, 7 6, 6 6))",
        4: "POLYGON ((1 2, 1 2, 4 5, 1 2))",
        5: None,
    }
    assert max(len(r.value) for r in pieces.collect()) < len(outer) / 2  # pieces stay blocks of a ring


def test_feature_wkt_query(spark, tmp_path):
    """One row per polygon of the fixture, each with its whole text."""
    keys = [(k,) for k in range(1, 30_000) if k % 7 != 5] + [(8,), (9,), (None,)]
    spark.createDataFrame(keys, "o_orderkey long").write.parquet(str(tmp_path / "orders.parquet"))
    want = {}
    for r in sorted(layer_queries.loops(spark, str(tmp_path)).where("seq is not null").collect(), key=lambda r: (r.ring_id, r.seq)):
        want.setdefault((r.layer, r.polygon_id), {}).setdefault(r.ring_id, []).append(f"{r.x:.6g} {r.y:.6g}")
    whole = {key: f"POLYGON ({', '.join(f'({", ".join([*p, p[0]])})' for p in rings.values())})" for key, rings in want.items()}
    got = fixtures.QUERIES["k2_feature_wkt"](spark, str(tmp_path))
    assert got.columns == ["grid_id", "layer", "polygon_id", "wkt"]
    assert sorted((r.layer, r.polygon_id) for r in got.where("wkt is not null").collect()) == sorted(whole)
    assert {(r.layer, r.polygon_id): r.wkt for r in got.collect()} == whole | {(None, None): None}
