"""Connected areas and rings against flood fill and side walking, in one chunk and across chunks."""

import numpy as np
import pytest

from isoterra.operators.components import (
    area_cells,
    area_sides,
    boundary_sides,
    components,
    erode,
    inset_layers,
    label_areas,
    label_layers,
)
from isoterra.operators.grid import elevation_range
from isoterra.operators.levels import contour_levels, layer_cells
from isoterra.operators.rings import area_rings
from tests.helpers import flood_components, grid_of, mask_of, masks_of, random_mask, walk_rings

SHAPES = {
    "one cell": ["...", ".#.", "..."],
    "saddle": ["#.", ".#"],
    "hole": ["###", "#.#", "###"],
    "corner joined": ["##...", "##...", "..##.", "..##."],
    "two areas": ["##..#", "##..#", "....#"],
    "hole touching outside": ["####", "#.##", "##.#", "###."],
    "random": random_mask(23, 31, 0.55, 1),
    "dense": random_mask(17, 40, 0.8, 2),
    "full": ["#" * 9] * 9,
}


CHUNKINGS = [(256, 500_000), (4, 500_000), (3, 0)]


@pytest.mark.parametrize("chunk,finish", CHUNKINGS)
def test_components(spark, chunk, finish):
    """All shapes at once; small chunks cross borders, finish 0 merges by rounds of joins."""
    mask, grids = masks_of(spark, SHAPES)
    got = {}
    for r in components(mask, grids, chunk=chunk, finish_rows=finish).collect():
        got.setdefault(r.grid_id, {})[(r.grid_row, r.grid_col)] = r.component_id
    assert got == {name: flood_components(lines) for name, lines in SHAPES.items()}


def test_layers_in_one_pass(spark):
    """Labelling all layers of a grid at once gives what labelling their members gives."""
    rows = [[(r * r + 3 * c * c + r * c) % 11 for c in range(13)] for r in range(9)]
    grid, grids = grid_of(spark, rows)
    levels = contour_levels(elevation_range(grid), 4)
    once = area_cells(label_layers(grid, levels, grids, chunk=5)).collect()
    apart = components(layer_cells(grid, levels), grids).collect()
    assert sorted(map(tuple, once)) == sorted(map(tuple, apart)) and {r.layer for r in once} == {0, 1, 2, 3}


@pytest.mark.parametrize("chunk", [256, 4])
def test_sides_of_runs(spark, chunk):
    mask, grids = masks_of(spark, SHAPES)
    areas = label_areas(mask, grids, chunk=chunk)
    got = area_sides(areas).drop("component_id").collect()
    want = boundary_sides(mask, block=3).select("grid_id", "layer", "grid_row", "grid_col", "side").collect()
    assert sorted(map(tuple, got)) == sorted(map(tuple, want))


@pytest.mark.parametrize("chunk,finish", CHUNKINGS)
def test_rings(spark, chunk, finish):
    mask, grids = masks_of(spark, SHAPES)
    found = {}
    areas = label_areas(mask, grids)
    points = area_rings(areas, grids, remove_holes=False, chunk=chunk, finish_rows=finish).collect()
    for p in sorted(points, key=lambda p: p.seq):
        ring = found.setdefault(p.grid_id, {}).setdefault((p.polygon_id, p.ring_id), [])
        assert p.seq == len(ring)
        ring.append((len(SHAPES[p.grid_id]) - p.y, p.x))
    for name, lines in SHAPES.items():
        got = found[name]
        assert sorted((k[0], v) for k, v in got.items()) == sorted((k[0], v) for k, v in walk_rings(lines).items())
        assert sorted(k[0] for k in got if k[1] == 0) == sorted({k[0] for k in got})


def test_inset_across_chunks_takes_one_shuffle(spark):
    # 270 rows and columns lie in four chunks; the radius is three.
    lines = random_mask(270, 270, 0.985, 5)
    mask, grids = mask_of(spark, lines)
    upper, r = mask.withColumn("layer", mask.layer + 1), 3
    full = np.array([[v == "#" for v in line] for line in lines])
    stays = np.zeros_like(full)
    stays[r:-r, r:-r] = True
    for dr in range(-r, r + 1):
        for dc in range(-r, r + 1):
            if dr * dr + dc * dc <= r * r:
                stays[r:-r, r:-r] &= full[r + dr : 270 - r + dr, r + dc : 270 - r + dc]
    inset = inset_layers(mask.unionByName(upper), grids, 2.5 * 111000.0 * 1000.0)
    got = {(c.layer, c.grid_row, c.grid_col) for c in inset.collect()}
    assert stays.any() and got == {(0, *map(int, c)) for c in np.argwhere(full & ~stays)} | {(1, *map(int, c)) for c in np.argwhere(full)}
    assert "Join LeftAnti" not in inset._jdf.queryExecution().optimizedPlan().toString()


def test_erosion_matches_neighbour_scan(spark):
    lines = random_mask(20, 24, 0.9, 3)
    mask, grids = mask_of(spark, lines)
    radius = 2
    # One degree per cell, so the offset that needs two pixels is just over one pixel.
    offset = 1.5 * 111000.0 * 1000.0
    members = {(r, c) for r, line in enumerate(lines) for c, v in enumerate(line) if v == "#"}

    def stays(r, c):
        for dr in range(-radius, radius + 1):
            for dc in range(-radius, radius + 1):
                n = (r + dr, c + dc)
                if not (0 <= n[0] < 20 and 0 <= n[1] < 24):
                    return False
                if n not in members and dr * dr + dc * dc <= radius * radius:
                    return False
        return True

    got = {(r.grid_row, r.grid_col) for r in erode(mask, grids, offset).collect()}
    assert got == {m for m in members if stays(*m)}
    upper = mask.withColumn("layer", mask.layer + 1)
    both = inset_layers(mask.unionByName(upper), grids, offset).collect()
    assert {(r.grid_row, r.grid_col) for r in both if r.layer == 0} == members - got
    assert {(r.grid_row, r.grid_col) for r in both if r.layer == 1} == members
