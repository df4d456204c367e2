import math
import random

import pytest
from pyspark.sql import functions as F

from isoterra.operators.raster import cell_pixels, layer_images, outline_pixels, rasterize, raster_frame
from tests.helpers import GEOMETRY_SCHEMA

GEOMETRIES = {"plain": (10.0, 0.5, 0.0, 50.0, 0.0, -0.4), "turned": (10.0, 0.5, 0.2, 50.0, -0.15, -0.4), "upward": (10.0, 0.3, 0.0, 40.0, 0.0, 0.25)}
ROWS, COLS = 9, 11


@pytest.fixture(scope="module")
def scene(spark):
    """Three grids, each in a frame that is a little larger and one that is finer than its cells."""
    draw = random.Random(2)
    grids = spark.createDataFrame([(g, *v, COLS, ROWS) for g, v in GEOMETRIES.items()], GEOMETRY_SCHEMA)
    bands = {(g, r, c): draw.randrange(5) for g in GEOMETRIES for r in range(ROWS) for c in range(COLS)}
    cells = spark.createDataFrame([(*k, b) for k, b in bands.items()], "grid_id string, grid_row int, grid_col int, band int")
    boxes = []
    for g, (x0, dx, rx, y0, ry, dy) in GEOMETRIES.items():
        xs = [x0 + c * dx + r * rx for r in (0, ROWS) for c in (0, COLS)]
        ys = [y0 + c * ry + r * dy for r in (0, ROWS) for c in (0, COLS)]
        boxes.append((g, min(xs) - 0.3, min(ys) - 0.1, max(xs) + 0.2, max(ys) + 0.1))
    bounds = spark.createDataFrame(boxes, "grid_id string, min_x double, min_y double, max_x double, max_y double")
    layers = spark.createDataFrame([(g, k, 100.0 + 50 * k) for g in GEOMETRIES for k in range(4)], "grid_id string, layer int, elevation double")
    return grids, cells, bands, bounds, layers


def cell_under(frame, geometry, px, py):
    x0, dx, rx, y0, ry, dy = geometry
    ex = frame.origin_x + (px + 0.5) * frame.pixel_w - x0
    ey = frame.origin_y - (py + 0.5) * frame.pixel_h - y0
    size = dx * dy - rx * ry
    return math.floor((ey * dx - ex * ry) / size), math.floor((ex * dy - ey * rx) / size)


@pytest.mark.parametrize("width, margin", [(7, 0), (40, 3)])
def test_every_pixel_finds_its_cell(scene, width, margin):
    grids, cells, bands, bounds, layers = scene
    frame = raster_frame(bounds, width, margin).cache()
    frames = {f.grid_id: f for f in frame.collect()}
    want = {}
    for g, f in frames.items():
        for px in range(f.width_px):
            for py in range(f.height_px):
                want[g, px, py] = bands.get((g, *cell_under(f, GEOMETRIES[g], px, py)))
    held = {(r.grid_id, r.px, r.py): r.band for r in cell_pixels(cells, grids, frame).collect()}
    assert held == {k: b for k, b in want.items() if b is not None}
    tops = {(r.grid_id, r.px, r.py): tuple(r)[3:] for r in rasterize(cells, layers, grids, frame).collect()}
    # Members per layer give the same image as bands.
    members = cells.withColumn("layer", F.explode(F.sequence(F.lit(0), F.lit(3)))).where("layer < band").drop("band")
    assert tops == {(r.grid_id, r.px, r.py): tuple(r)[3:] for r in rasterize(members, layers, grids, frame).collect()}
    assert set(tops) == set(want)
    colors = {}
    for k, b in want.items():
        colors.setdefault(b or 0, set()).add(tops[k])
    assert colors[0] == {(255, 255, 255, 255)} and all(len(c) == 1 for c in colors.values())


def test_a_centre_on_a_border_belongs_to_the_cell_after_it(spark):
    # The middle of the second pixel is exactly 60 degrees below the top, where row 6,000 begins.
    grids = spark.createDataFrame([("g", -151.0, 0.01, 0.0, 63.0, 0.0, -0.01, 1, 6002)], GEOMETRY_SCHEMA)
    frame = spark.createDataFrame(
        [("g", 1, 2, -151.0, 63.0, 0.01, 40.0)],
        "grid_id string, width_px int, height_px int, origin_x double, origin_y double, pixel_w double, pixel_h double",
    )
    cells = spark.createDataFrame([("g", r, 0) for r in range(6002)], "grid_id string, grid_row int, grid_col int")
    held = {r.py: r.grid_row for r in cell_pixels(cells, grids, frame).collect()}
    assert held == {0: 2000, 1: 6000}


def test_layer_images_share_their_colours_and_carry_outlines(spark, scene):
    grids, cells, bands, bounds, layers = scene
    frame = raster_frame(bounds, 30, 2).cache()
    tops = {(r.grid_id, r.px, r.py): tuple(r)[3:] for r in rasterize(cells, layers, grids, frame).collect()}
    held = {(r.grid_id, r.px, r.py): r.band for r in cell_pixels(cells, grids, frame).collect()}
    color = {b: tops[k] for k, b in held.items()}
    images = {(r.grid_id, r.layer, r.px, r.py): tuple(r)[4:] for r in layer_images(cells, layers, grids, frame).collect()}
    assert len(images) == 4 * len(tops)
    for (g, layer, px, py), shown in images.items():
        assert shown == (color[layer + 1] if held.get((g, px, py), 0) > layer else (255, 255, 255, 255))
    ring = [("plain", 1, 0, 0, n, x, y) for n, (x, y) in enumerate([(11.0, 49.0), (13.0, 49.0), (13.0, 47.5), (11.0, 47.5)])]
    points = spark.createDataFrame(ring, "grid_id string, layer int, polygon_id long, ring_id long, seq long, x double, y double")
    lines = outline_pixels(points, frame, 1.0)
    drawn = {(r.grid_id, r.layer, r.px, r.py) for r in lines.collect()}
    outlined = {(r.grid_id, r.layer, r.px, r.py): tuple(r)[4:] for r in layer_images(cells, layers, grids, frame, outlines=lines, stroke=(1, 2, 3)).collect()}
    assert drawn and outlined == {k: (1, 2, 3, 255) if k in drawn else v for k, v in images.items()}


def test_the_brush_reaches_across_bands_without_multiplying_pixels(spark):
    frame = spark.createDataFrame(
        [("g", 30, 600, 0, 0.0, 0.0, 30.0, 600.0)],
        "grid_id string, width_px int, height_px int, margin_px int, min_x double, min_y double, max_x double, max_y double",
    )
    corners = {1: [(0.5, 599.5), (29.5, 599.5), (29.5, 0.5), (0.5, 0.5)], 2: [(5.5, 344.5), (20.5, 344.5), (20.5, 343.5), (5.5, 343.5)]}
    points = spark.createDataFrame(
        [("g", layer, 0, 0, n, x, y) for layer, ring in corners.items() for n, (x, y) in enumerate(ring)],
        "grid_id string, layer int, polygon_id long, ring_id long, seq long, x double, y double",
    )
    thin = {(r.layer, r.px, r.py) for r in outline_pixels(points, frame, 1.0).collect()}
    want = {(k, x + i, y + j) for k, x, y in thin for i in (-2, -1, 0, 1, 2) for j in (-2, -1, 0, 1, 2) if 0 <= x + i < 30 and 0 <= y + j < 600}
    thick = outline_pixels(points, frame, 4.0)
    got = [(r.layer, r.px, r.py) for r in thick.collect()]
    assert {y for k, _, y in thin if k == 2} == {255, 256}
    assert len(got) == len(set(got)) and set(got) == want
    assert thick._jdf.queryExecution().optimizedPlan().toString().count("Generate explode") <= 2
