import gzip
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from isoterra.operators import chunks
from isoterra.operators.components import MEMBERS, label_layers
from isoterra.operators.grid import clean_nonfinite, downsample, elevation_range, repair_outliers
from isoterra.operators.heightmap import quads
from isoterra.operators.levels import contour_levels, layer_counts
from isoterra.sources.hgt import scan_chunks, scan_hgt
from isoterra.spread import cut
from tests.helpers import GEOMETRY_SCHEMA, GRID_SCHEMA

SHAPES = {"a": (13, 9), "b": (4, 4), "c": (1, 17), "d": (11, 5)}


@pytest.fixture(scope="module")
def grids(spark):
    rows = [(g, 0.0, 1.0, 0.0, 0.0, 0.0, -1.0, w, h) for g, (h, w) in SHAPES.items()]
    return spark.createDataFrame(rows, GEOMETRY_SCHEMA)


@pytest.fixture(scope="module")
def grid(spark):
    """Several grids with voids, outliers, infinities and a grid without any valid cell."""
    draw, rows = random.Random(11), []
    for g, (height, width) in SHAPES.items():
        for r in range(height):
            for c in range(width):
                elev = draw.choice([None, float("nan"), float("inf"), 12000.0, -900.0, *[float(draw.randrange(40)) for _ in range(9)]])
                rows.append((g, r, c, None if g == "d" else elev))
    return spark.createDataFrame(rows, GRID_SCHEMA)


def as_set(df, *columns):
    found = [tuple(r) for r in df.select(*columns).collect()]
    assert len(found) == len(set(found))
    return set(found)


@pytest.fixture(scope="module", params=[3, 4, 16])
def pair(request, grid):
    side = request.param
    return side, repair_outliers(clean_nonfinite(grid)), chunks.repair_chunks(chunks.pack(grid, side), side)


def test_packed_cells_come_back(spark, grid, grids):
    cells = as_set(clean_nonfinite(grid), "grid_id", "grid_row", "grid_col", "elev")
    back = chunks.unpack(chunks.pack(clean_nonfinite(grid), 4), grids, 4)
    assert as_set(back, "grid_id", "grid_row", "grid_col", "elev") == cells
    assert chunks.pack(grid.limit(0), 4).count() == 0


def test_halo_holds_the_neighbours_cells(spark):
    rows = [("g", r, c, float(r * 10 + c)) for r in range(9) for c in range(6)]
    found = {(r.chunk_row, r.chunk_col): r for r in chunks.with_halo(chunks.pack(spark.createDataFrame(rows, GRID_SCHEMA), 3), 3).collect()}
    middle = found[1, 0]
    assert middle.n == [20.0, 21.0, 22.0] and middle.s == [60.0, 61.0, 62.0] and middle.e == [33.0, 43.0, 53.0] and middle.w is None
    assert middle.ne == [23.0] and middle.se == [63.0] and middle.nw is None and found[0, 1].sw == [32.0]


def test_repair_as_on_cells(pair, grids):
    side, cells, packed = pair
    columns = ["grid_id", "grid_row", "grid_col", "elev"]
    assert as_set(chunks.unpack(packed, grids, side), *columns) == as_set(cells, *columns)


def test_statistics_as_on_cells(pair, grids):
    side, cells, packed = pair
    assert as_set(chunks.chunk_range(packed), "grid_id", "min_elev", "max_elev") == as_set(elevation_range(cells), "grid_id", "min_elev", "max_elev")
    levels = contour_levels(elevation_range(cells), 5)
    columns = ["grid_id", "layer", "elevation", "cells", "share"]
    assert as_set(chunks.chunk_layer_counts(packed, levels), *columns) == as_set(layer_counts(cells, levels), *columns)
    for n in (1, 2, 5):
        small = ["grid_id", "grid_row", "grid_col", "elev"]
        assert as_set(chunks.downsample_chunks(packed, grids, n, side), *small) == as_set(downsample(cells, grids, n), *small)


def test_groups_and_areas_as_on_cells(pair, grids):
    side, cells, packed = pair
    columns = ["grid_id", "row", "col", "z00", "z10", "z01", "z11"]
    assert as_set(chunks.chunk_quads(packed, side), *columns) == as_set(quads(cells), *columns)
    levels = contour_levels(elevation_range(cells), 4)

    def flat(areas):
        return as_set(
            areas.select("grid_id", "layer", "grid_row", F.explode(F.sequence("c0", "c1")).alias("col"), "component_id", "side"),
            "grid_id", "layer", "grid_row", "col", "component_id", "side",
        )

    assert flat(chunks.label_chunk_layers(packed, levels, grids, side)) == flat(label_layers(cells, levels, grids))
    assert MEMBERS == -1


def test_tiles_are_decoded_to_chunks(spark, tmp_path):
    values = np.arange(49, dtype=">i2").reshape(7, 7) - 3
    values[2, 3] = -32768
    (tmp_path / "N10E020.hgt.gz").write_bytes(gzip.compress(values.tobytes()))
    grids = spark.createDataFrame([("N10E020", 0.0, 1.0, 0.0, 0.0, 0.0, -1.0, 7, 7)], GEOMETRY_SCHEMA)
    packed = scan_chunks(spark, str(tmp_path), 4)
    columns = ["grid_id", "grid_row", "grid_col", "elev"]
    assert packed.count() == 4 and as_set(chunks.unpack(packed, grids, 4), *columns) == as_set(scan_hgt(spark, str(tmp_path)), *columns)


def test_a_stencil_shuffles_packed_rows_only(spark, grid):
    packed = cut(chunks.pack(grid, 4))
    plan = chunks.repair_chunks(packed, 4)._jdf.queryExecution().executedPlan().toString()
    # The chunks, and their strips: of two sides and two rows and four corners each.
    assert len([line for line in plan.splitlines() if "Exchange hashpartitioning" in line]) == 2
    assert "grid_row" not in plan
