import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from isoterra.llm.facets import Tree, alike_facets, best, first_copies, split
from isoterra.operators.mesh import Mesh, triangle_geometry

SCHEMA = "tid long, direction array<double>"


def brute(rows, asked, k=20):
    whole = [(t, [math.floor(64 * x) for x in v]) for t, v in rows if v is not None and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    for n, (t, v) in enumerate(whole):
        if t is not None and asked(t):
            scored = [(-sum(a * b for a, b in zip(v, w)), u is None, u or 0) for m, (u, w) in enumerate(whole) if m != n and len(w) == len(v)]
            out += [(t, r, None if missing else u, -s) for r, (s, missing, u) in enumerate(sorted(scored)[:k], 1)]
    return sorted(out, key=str)


def found(spark, rows, **more):
    got = alike_facets(spark.createDataFrame(rows, SCHEMA), F.col("tid") % 5 == 0, ["tid"], **more)
    return sorted([tuple(r) for r in got.select("asked_tid", "rank", "tid", "score").collect()], key=str)


@pytest.mark.parametrize("dims, shard, block, leaf, k", [(1, 10, 3, 4, 3), (3, 64, 8, 4, 5), (8, 40, 1000, 8, 20), (3, 10**6, 10**6, 64, 500)])
def test_against_brute_force(spark, dims, shard, block, leaf, k):
    draw = random.Random(dims)
    rows = [(t, [draw.gauss(0, 1) for _ in range(dims)]) for t in range(200)]
    got = found(spark, rows, k=k, shard_rows=shard, block_rows=block, leaf_rows=leaf)
    assert got == brute(rows, lambda t: t % 5 == 0, k)


def test_awkward_rows(spark):
    nan, inf = float("nan"), float("inf")
    same = [0.5, -0.25]
    rows = [(t, same) for t in range(60)] + [(7, same), (5, [1.0, 1.0]), (5, [1.0, 1.0]), (None, [3.0, 3.0]), (None, same)]
    rows += [(100, None), (105, [nan, 1.0]), (110, [inf, 0.0]), (115, [None, 1.0]), (120, []), (121, []), (125, [1.0]), (130, [1e-9, -1e-9])]
    assert found(spark, rows, shard_rows=16, block_rows=4) == brute(rows, lambda t: t % 5 == 0)
    assert found(spark, []) == [] and found(spark, [(5, [1.0])]) == []
    clash = spark.createDataFrame([(5, [1.0], 1, 2), (6, [2.0], 3, 4)], SCHEMA + ", score int, number int")
    assert [tuple(r) for r in alike_facets(clash, F.col("tid") == 5, ["tid"]).collect()] == [(5, 1, 6, 64 * 128)]


def test_scores_beyond_doubles(spark):
    big = float(1 << 24)
    rows = [(5, [big, 1.0]), (6, [big, 2.0]), (7, [big, 1.0]), (8, [-big, 0.0])]
    assert found(spark, rows) == brute(rows, lambda t: t % 5 == 0)
    with pytest.raises(Exception, match="long"):
        found(spark, [(5, [1e30]), (6, [1e30])])


def test_tree():
    draw = np.random.default_rng(3)
    vectors = draw.integers(-9, 9, (300, 4))
    leaves = list(split(vectors, 10))
    assert sorted(np.concatenate([r for _, r in leaves])) == list(range(300)) and all(len(r) <= 10 for _, r in leaves)
    tree = Tree([n for n, _ in leaves], [vectors[r] for _, r in leaves], [r for _, r in leaves])
    asked = draw.integers(-9, 9, (20, 4))
    for node, rows in leaves:
        while node:
            assert (tree.bounds(node, asked) >= (asked @ vectors[rows].T).max(axis=1)).all()
            node >>= 1
    # A floor from elsewhere leaves out branches but no answer that reaches it.
    exact = np.sort(asked @ vectors.T, axis=1)[:, ::-1]
    floor = exact[:, 4]
    row, number, score = best(asked, np.full(20, -1), floor, tree, 5)
    assert all(sorted(score[row == n], reverse=True) == exact[n, :5].tolist() for n in range(20))
    assert len(tree.reachable(asked[:1], exact[:1, 0])[0]) < len(leaves)
    assert list(split(np.ones((50, 3), np.int64), 4))[0][1].tolist() == list(range(50))


def test_copies_beyond_the_answers_go():
    vectors, numbers = np.array([[1], [2], [1], [1], [2]]), np.array([9, 1, 4, 6, 3])
    assert sorted(numbers[first_copies(vectors, numbers, 2)]) == [1, 3, 4, 6]


def test_on_mesh_facets(spark):
    corners = [(0, 0, 0), (1, 0, 0), (0, 1, 0), (0, 0, 1), (1, 1, 0)]
    vertices = spark.createDataFrame([("m", n, *map(float, c)) for n, c in enumerate(corners)], "mesh_id string, vid long, x double, y double, z double")
    triangles = spark.createDataFrame(
        [("m", 0, 0, 1, 2), ("m", 1, 1, 4, 2), ("m", 2, 0, 2, 1), ("m", 3, 0, 1, 3)], "mesh_id string, tid long, v0 long, v1 long, v2 long"
    )
    facets = triangle_geometry(Mesh(vertices, triangles)).withColumn("direction", F.array("nx", "ny", "nz"))
    got = alike_facets(facets, F.col("tid") == 0, k=2).collect()
    assert [(r.asked_mesh_id, r.asked_tid, r["rank"], r.tid, r.score) for r in got] == [("m", 0, 1, 1, 4096), ("m", 0, 2, 3, 0)]
