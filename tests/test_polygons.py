"""Ring operators across block borders, against plain loops over each ring."""

import math
import random

import pytest
from pyspark.sql import functions as F

from isoterra.operators import polygons

SCHEMA = "grid_id string, layer int, polygon_id long, ring_id long, seq long, x double, y double"


def make(spark, rings):
    rows = [("g", 0, p, r, i, float(x), float(y)) for (p, r), ring in rings.items() for i, (x, y) in enumerate(ring)]
    return spark.createDataFrame(rows, SCHEMA)


def gather(df):
    found = {}
    for row in sorted(df.collect(), key=lambda r: r.seq):
        ring = found.setdefault((row.polygon_id, row.ring_id), [])
        assert row.seq == len(ring)
        ring.append((row.x, row.y))
    return found


def wander(n, seed):
    rng = random.Random(seed)
    x = y = 0.0
    points = []
    for _ in range(n):
        x, y = x + rng.uniform(-1, 1), y + rng.uniform(-1, 1)
        points.append((x, y))
    return points


@pytest.fixture(scope="module")
def rings():
    return {(1, 0): wander(57, 1), (1, 9): wander(10, 2), (2, 0): wander(20, 3), (3, 0): [(0, 0), (1, 0), (1, 1)], (4, 0): wander(11, 4)}


@pytest.mark.parametrize("block", [1, 5, 10, 8192])
def test_with_next(spark, rings, block):
    got = {(r.polygon_id, r.ring_id, r.seq): (r.next_x, r.next_y) for r in polygons.with_next(make(spark, rings), block).collect()}
    want = {(*k, i): tuple(map(float, ring[(i + 1) % len(ring)])) for k, ring in rings.items() for i in range(len(ring))}
    assert got == want


def test_dedup(spark, rings):
    tol = 0.7
    want = {}
    for key, ring in rings.items():
        kept = [p for i, p in enumerate(ring) if math.dist(p, ring[(i + 1) % len(ring)]) >= tol]
        if len(kept) >= 3:
            want[key] = [tuple(map(float, p)) for p in kept]
    assert gather(polygons.dedup_ring(make(spark, rings), tol)) == want


@pytest.mark.parametrize("block", [4, 8192])
@pytest.mark.parametrize("tol", [0.9, 2.5, 50.0])
def test_decimate(spark, rings, block, tol):
    want = {}
    for key, ring in rings.items():
        kept = [ring[0]]
        for p in ring[1:]:
            if math.dist(p, kept[-1]) >= tol:
                kept.append(p)
        if len(kept) >= 3:
            want[key] = [tuple(map(float, p)) for p in kept]
    assert gather(polygons.decimate_ring(make(spark, rings), tol, block)) == want


def test_many_small_rings_are_no_groups_of_their_own(spark):
    rings = {(n, 0): wander(1 + n % 23, n) for n in range(60)} | {(99, 0): wander(300, 99)}
    want = {}
    for key, ring in rings.items():
        kept = [ring[0]]
        for p in ring[1:]:
            if math.dist(p, kept[-1]) >= 0.8:
                kept.append(p)
        if len(kept) >= 3:
            want[key] = kept
    size = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(size)
    # Batches end inside blocks.
    spark.conf.set(size, 7)
    try:
        thinned = polygons.decimate_ring(make(spark, rings), 0.8, 10)
        assert gather(thinned) == want
    finally:
        spark.conf.set(size, before)
    assert "InPandas" not in thinned._jdf.queryExecution().optimizedPlan().toString()


def test_renumber_across_blocks(spark, rings):
    thinned = make(spark, rings).where(F.col("seq") % 3 != 1)
    got = gather(polygons.renumber(thinned, block=4))
    want = {k: [tuple(map(float, p)) for i, p in enumerate(r) if i % 3 != 1] for k, r in rings.items()}
    assert got == {k: r for k, r in want.items() if len(r) >= 3}


def test_metrics_of_a_square_with_hole(spark):
    square = {(1, 0): [(0, 0), (4, 0), (4, 4), (0, 4)], (1, 5): [(1, 1), (1, 2), (2, 2), (2, 1)]}
    row = polygons.polygon_metrics(make(spark, square)).collect()[0]
    assert (row.area, row.exterior_area, row.perimeter) == (15.0, 16.0, 16.0)
    assert (row.vertices, row.exterior_vertices, row.holes) == (10, 5, 1)


def test_bounds_pad_a_line(spark):
    row = polygons.polygon_bounds(make(spark, {(1, 0): [(0, 3), (2, 3), (5, 3)]}), ["grid_id"]).collect()[0]
    assert tuple(row)[1:] == (0.0, 2.5, 5.0, 3.5)
