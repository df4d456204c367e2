import json
import math
import random
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from isoterra.operators.grid import mosaic, seams, _placed
from isoterra.operators.levels import banded_cells, layer_cells
from isoterra.plans.area import BoxJob, covering_tiles, load_area, make_area
from isoterra.plans.products import Job
from isoterra.sinks.tiles import write_hgt
from isoterra.sources.hgt import scan_hgt
from isoterra.spread import cut

CELLS = "grid_id string, grid_row int, grid_col int, elev float"
SIDE = 9


def height(lat, lon):
    """Height in whole metres of a position on the lattice of eighth degrees."""
    return 100 + round(40 * math.sin(lat * 3) + 25 * math.cos(lon * 2)) + int(lon * 8) % 3


def tiles(spark, folder, names, void=lambda lat, lon: False):
    rows = []
    for name in names:
        south, west = int(name[1:3]) * (-1 if name[0] == "S" else 1), int(name[4:7]) * (-1 if name[3] == "W" else 1)
        for r in range(SIDE):
            for c in range(SIDE):
                lat, lon = south + 1 - r / (SIDE - 1), west + c / (SIDE - 1)
                rows.append((name, r, c, None if void(lat, lon) else float(height(lat, lon))))
    return write_hgt(spark.createDataFrame(rows, CELLS), str(folder), SIDE).collect()


def positions(area):
    frame = area.grids.first()
    return {
        (round(frame.y0 + (r.grid_row + 0.5) * frame.dy, 6), round(frame.x0 + (r.grid_col + 0.5) * frame.dx, 6)): r.elev
        for r in area.grid.collect()
    }


def test_written_tiles_come_back(spark, tmp_path):
    rows = [("N10E010", 0, 0, 1.4), ("N10E010", 2, 1, -32000.0), ("N10E010", 1, 2, None), ("N10E010", 0, 3, 7.0), ("N10E010", 2, 2, 40000.0)]
    rows += [("S01W001", 1, 1, 12.6)]
    written = write_hgt(spark.createDataFrame(rows, CELLS), str(tmp_path), 3).collect()
    assert {r.tile for r in written} == {"N10E010", "S01W001"} and all(Path(r.path).stat().st_size == r.bytes for r in written)
    back = {(r.grid_id, r.grid_row, r.grid_col): r.elev for r in scan_hgt(spark, str(tmp_path)).where("elev is not null").collect()}
    assert back == {("N10E010", 0, 0): 1.0, ("N10E010", 2, 1): -32000.0, ("S01W001", 1, 1): 13.0}
    assert not [p for p in tmp_path.iterdir() if p.name.startswith(".N")]


def test_box_is_cut_out_of_covering_tiles_only(spark, tmp_path):
    names = [f"N{lat:02d}E{lon:03d}" for lat in (44, 45, 46) for lon in (7, 8, 9, 10)]
    tiles(spark, tmp_path, [n for n in names if n != "N46E009"])
    job = BoxJob(45.3, 46.2, 8.3, 9.7)
    assert covering_tiles(spark, job) == ["N45E008", "N45E009", "N46E008", "N46E009"]
    area = load_area(spark, str(tmp_path), job)
    assert area.tiles == ["N45E008", "N45E009", "N46E008"] and area.missing == ["N46E009"]
    opened = {f.rsplit("/", 1)[1] for f in scan_hgt(spark, str(tmp_path), area.tiles).inputFiles()}
    assert opened == {f"{n}.hgt.gz" for n in area.tiles}
    # Cells whose square touches the box; the missing tile leaves no cell of its own.
    step = 1 / (SIDE - 1)
    lattice = [(46 + 1 - r * step, 8 + c * step) for r in range(2 * SIDE - 1) for c in range(2 * SIDE - 1)]
    want = {}
    for lat, lon in lattice:
        inside = lat - step / 2 < 46.2 and lat + step / 2 > 45.3 and lon - step / 2 < 9.7 and lon + step / 2 > 8.3
        if inside and (lat <= 46 or lon <= 9):
            want[round(lat, 6), round(lon, 6)] = float(height(lat, lon))
    assert positions(area) == want
    # The decoder itself gives little more than the box.
    box = (8.3, 45.3, 9.7, 46.2)
    around = scan_hgt(spark, str(tmp_path), area.tiles, box).count()
    assert len(want) <= around < 2 * len(want) + 40


def test_box_over_the_antimeridian(spark, tmp_path):
    tiles(spark, tmp_path, ["S11E179", "S11W180", "S11W179", "S11E000"])
    area = load_area(spark, str(tmp_path), BoxJob(-10.8, -10.3, 179.4, -179.4))
    assert area.tiles == ["S11E179", "S11W180"]
    found = positions(area)
    assert {lon > 180 for _, lon in found} == {True, False}
    for (lat, lon), elev in found.items():
        assert elev in (height(lat, lon), height(lat, lon - 360))
    assert len({lon for _, lon in found}) == 11


def test_errors(spark, tmp_path):
    tiles(spark, tmp_path, ["N45E008"], void=lambda lat, lon: lat > 45.2)
    with pytest.raises(ValueError, match="no elevation tile"):
        load_area(spark, str(tmp_path), BoxJob(10.1, 10.2, 8.1, 8.2))
    with pytest.raises(ValueError, match="unknown formats: gif"):
        make_area(spark, str(tmp_path), BoxJob(45.1, 45.9, 8.1, 8.9, ("svg", "gif")), str(tmp_path / "a"))
    with pytest.raises(ValueError, match="are invalid"):
        make_area(spark, str(tmp_path), BoxJob(45.1, 45.9, 8.1, 8.9, ("stl",)), str(tmp_path / "b"))
    assert not (tmp_path / "a").exists() and not (tmp_path / "b").exists()
    assert make_area(spark, str(tmp_path), BoxJob(45.1, 45.9, 8.1, 8.9, ("stl",), gate=False), str(tmp_path / "c"))


def document(folder, file):
    parts = sorted((Path(folder) / f"file={file}").glob("part-*"))
    return "".join(p.read_text() for p in parts)


def test_every_format_in_one_call(spark, tmp_path):
    tiles(spark, tmp_path / "tiles", ["N45E008", "N45E009"])
    job = BoxJob(45.2, 45.8, 8.5, 9.4, ("geojson", "svg", "features", "stl", "obj", "ply"), base="alp", job=Job(layers=3))
    written = make_area(spark, str(tmp_path / "tiles"), job, str(tmp_path / "out"))
    assert sorted(written) == ["features", "geojson", "mtl", "obj", "ply", "stl", "svg"]
    layers = sorted(p.name for p in Path(written["geojson"]).glob("file=*"))
    assert len(layers) == 3 and layers[0].startswith("file=alp_layer_01_elev_") and layers[0].endswith("m.geojson")
    for name in layers:
        read = json.loads(document(written["geojson"], name[5:]))
        assert read["type"] == "FeatureCollection" and read["features"]
        assert document(written["svg"], name[5:].replace("geojson", "svg")).rstrip().endswith("</svg>")
    stl = document(written["stl"], "alp.stl").splitlines()
    assert stl[0].startswith("solid") and stl[-1].startswith("endsolid") and stl[1].startswith("  facet normal") and len(stl) % 7 == 2
    ply = document(written["ply"], "alp.ply").splitlines()
    vertices, faces = (int(line.split()[-1]) for line in ply if line.startswith("element"))
    assert len(ply) == ply.index("end_header") + 1 + vertices + faces and faces == (len(stl) - 2) // 7
    obj = document(written["obj"], "alp.obj")
    assert obj.count("\nf ") == faces and set(spark.read.text(written["mtl"]).where("value like 'newmtl%'").toPandas()["value"].str[7:]) >= {
        line[7:] for line in obj.splitlines() if line.startswith("usemtl")
    }
    assert spark.read.parquet(written["features"] + "/attributes").count() == sum(
        len(json.loads(document(written["geojson"], n[5:]))["features"]) for n in layers
    )


def test_one_document_and_a_solid(spark, tmp_path):
    tiles(spark, tmp_path / "tiles", ["N45E008"])
    job = BoxJob(45.2, 45.8, 8.2, 8.8, ("geojson", "stl"), job=Job(layers=3, repair=True, near=1e-9), solid=True, separate_layers=False)
    written = make_area(spark, str(tmp_path / "tiles"), job, str(tmp_path / "out"))
    read = json.loads(document(written["geojson"], "area.geojson"))
    numbers = [f["properties"]["layer"] for f in read["features"]]
    assert numbers == sorted(numbers) and set(numbers) == {1, 2, 3}
    assert sorted(p.name for p in Path(written["stl"]).glob("file=*")) == [f"file=area_{n}.stl" for n in range(3)]


@pytest.mark.parametrize("seed", [1, 2])
def test_mosaic_against_cell_by_cell(spark, seed):
    draw = random.Random(seed)
    frames, cells, want = [], [], {}
    for n in range(7):
        r0, c0, rows, cols = draw.randrange(12), draw.randrange(12), draw.randint(1, 8), draw.randint(1, 8)
        frames.append((f"t{n}", 10.0 + c0 * 0.5, 0.5, 0.0, 50.0 - r0 * 0.5, 0.0, -0.5, cols, rows, draw.randrange(100)))
        for r in range(rows):
            for c in range(cols):
                elev = None if draw.random() < 0.3 else float(draw.randrange(1000))
                cells.append((f"t{n}", r, c, elev))
                want.setdefault((r0 + r, c0 + c), []).append((elev is not None, frames[-1][-1], elev))
    top, left = min(k[0] for k in want), min(k[1] for k in want)
    best = {(r - top, c - left): max(v, key=lambda t: t[:2])[2] for (r, c), v in want.items()}
    schema = "grid_id string, x0 double, dx double, rx double, y0 double, ry double, dy double, width int, height int, tile_order int"
    grids = spark.createDataFrame(frames, schema)
    if len({f[-1] for f in frames}) < len(frames):
        pytest.skip("orders must differ")
    got = {(r.grid_row, r.grid_col): r.elev for r in mosaic(spark.createDataFrame(cells, CELLS), grids).collect()}
    assert got == best
    # Rectangles hold exactly the cells that more than one tile has.
    held = {}
    for r in seams(_placed(grids)).collect():
        for s in r._seams:
            held.setdefault(r.grid_id, set()).update((a, b) for a in range(s.top, s.bottom) for b in range(s.left, s.right))
    shared = {}
    offsets = {f[0]: (round((50.0 - f[4]) / 0.5), round((f[1] - 10.0) / 0.5)) for f in frames}
    for name, r, c, _ in cells:
        if len(want[r + offsets[name][0], c + offsets[name][1]]) > 1:
            shared.setdefault(name, set()).add((r, c))
    assert held == shared


def test_levels_are_found_by_bisection(spark):
    draw = random.Random(4)
    floors = {"a": sorted(draw.uniform(0, 100) for _ in range(37)), "b": [50.0], "c": [10.0, 10.0, 20.0]}
    levels = [(g, n, v, v + 1) for g, values in floors.items() for n, v in enumerate(values)]
    cells = [(g, n, 0, draw.choice([None, draw.uniform(-5, 105), draw.choice(floors[g])])) for g in floors for n in range(60)]
    cells += [("a", 900, 0, float("nan")), ("a", 901, 0, float("inf")), ("none", 0, 0, 5.0)]
    grid = spark.createDataFrame(cells, "grid_id string, grid_row int, grid_col int, elev double")
    table = spark.createDataFrame(levels, "grid_id string, level_index int, lower double, upper double")
    band = {(r.grid_id, r.grid_row): r.band for r in banded_cells(grid, table).collect()}
    assert band == {(g, n): sum(v <= e for v in floors[g]) for g, n, _, e in cells if g in floors and e is not None and e < math.inf}
    # A filter on the band must not move below the join, with stored grids either.
    stored = banded_cells(cut(grid), table.withColumn("lower", F.explode(F.array("lower")))).where("band > 3")
    assert {(r.grid_id, r.grid_row) for r in stored.collect()} == {k for k, b in band.items() if b > 3}
    member = {(r.grid_id, r.layer, r.grid_row) for r in layer_cells(grid, table).collect()}
    assert member == {
        (g, k, n) for g, n, _, e in cells if g in floors and e is not None for k, v in enumerate(floors[g]) if e >= v or math.isnan(e)
    }
    plan = layer_cells(grid, table)._jdf.queryExecution().optimizedPlan().toString()
    assert not [line for line in plan.splitlines() if "Join" in line and ("lower" in line or "elev" in line)]
