"""Joins and running totals on the paths that large or skewed data takes."""

import pytest
from pyspark.sql import functions as F

from checks import fixtures, grid_queries, layer_queries, mesh_queries, text_queries  # noqa: F401
from checks.compare import compare, connect
from isoterra import spread

SF = "/root/testdata/sf0.001"


@pytest.fixture
def forced(monkeypatch):
    """Nothing counts as small."""
    monkeypatch.setattr(spread, "proven_small", lambda df: False)
    monkeypatch.setattr(spread, "BROADCAST_ROWS", 0)


def facts(spark):
    """Key 0 holds half of all rows; key 99 is in no table."""
    return spark.range(200).select(
        F.col("id").alias("n"), F.when(F.col("id") % 2 == 0, 0).when(F.col("id") == 7, 99).otherwise(F.col("id") % 10).alias("k")
    )


def table(spark):
    return spark.range(10).select(F.col("id").alias("k"), (F.col("id") * 10).alias("v"))


@pytest.mark.parametrize("how", ["inner", "left"])
def test_salted_joins_keep_every_row(spark, forced, how):
    plain = facts(spark).join(table(spark), "k", how).select("n", "k", "v")
    want = sorted(map(tuple, plain.collect()), key=repr)
    for joined in (
        spread.attach(facts(spark), table(spark), ["k"], ["n"], how),
        spread.attach(facts(spark), table(spark), ["k"], None, how),
        spread.lookup(facts(spark), table(spark), ["k"], how),
    ):
        assert sorted(map(tuple, joined.select("n", "k", "v").collect()), key=repr) == want


def test_generated_rows_prove_no_size(spark):
    few = spark.range(3)
    many = few.select(F.explode(F.sequence(F.lit(0), F.lit(10**6))).alias("id"))
    assert spread.proven_small(few) and not spread.proven_small(many)
    assert not spread.proven_small(few.mapInPandas(lambda frames: frames, few.schema))
    plan = spread.attach(many.select("id"), many.selectExpr("id", "1 v"), ["id"], None)._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" not in plan and "SortMergeJoin" in plan


def test_running_total_splits_equal_keys(spark):
    rows = spark.range(1000).select((F.col("id") % 3).alias("day"), F.col("id"), (F.col("id") % 7).alias("size"))
    got = spread.running_total(rows, ["day", "id"], F.col("size"), "before").collect()
    total = 0
    for row in sorted(got, key=lambda r: (r.day, r.id)):
        assert row.before == total
        total += row["size"]


def test_dense_ids(spark):
    got = spread.dense_ids(spark.range(500).select((F.col("id") * 37 % 500).alias("k")), ["k"], "n").collect()
    assert all(r.k == r.n for r in got) and len(got) == 500


SKEWED = [
    "a6_tile_coverage", "a7_mosaic", "b2_repair_outliers", "b9_sample_bilinear", "c3_layer_counts", "c6_ring_sums",
    "d6_rasterize", "e3_triangle_band", "f2_heightmap_layers", "f7_dedup_vertices", "f14_stack_meshes", "f15_band_index",
    "j6_eviction_plan",
]


@pytest.mark.parametrize("name", SKEWED)
def test_queries_agree_on_the_skew_paths(spark, forced, name):
    problem = compare(spark, connect(SF), name, fixtures.QUERIES[name], fixtures.ORACLES[name], SF)
    assert problem is None or problem == "no rows"
