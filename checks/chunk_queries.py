"""The same results from packed chunks: every query has the SQL of its counterpart on cells."""

from __future__ import annotations

from pyspark.sql import functions as F

from checks import grid_queries, layer_queries, mesh_queries  # noqa: F401 - their SQL is used here
from checks.area_queries import packed
from checks.fixtures import ORACLES, big, clean, dem, derived, grids, levels, oracle, query, rounded
from isoterra.operators import chunks, heightmap
from isoterra.operators.components import area_cells
from isoterra.sources.hgt import scan_chunks

# Small chunks, so that fixtures have many of them.
SIDE = 16


def packed_clean(spark, sf):
    return chunks.repair_chunks(chunks.pack(dem(spark, sf), SIDE), SIDE)


@query(
    "a1_scan_chunks",
    oracle("lattice")
    + """, tile as (select cast(a as int) a, cast(b as int) b from range(0, 10000) t(a), range(0, 32) u(b) where a * 32 <= (select max(r) from lattice where c < 1025)
  and exists (select 1 from lattice where r between a * 32 and a * 32 + 32 and c between b * 32 and b * 32 + 32 and elev is not null) and a in (select distinct greatest(0, cast(r as int) // 32) from lattice union select greatest(0, cast(r as int) // 32 - 1) from lattice where r % 32 = 0))
select 'N' || lpad(cast(79 - a as varchar), 2, '0') || 'E' || lpad(cast(10 + b as varchar), 3, '0') grid_id, count(elev) valid, sum(cast(elev as double)) total
from tile join lattice on r between a * 32 and a * 32 + 32 and c between b * 32 and b * 32 + 32 group by all""",
)
def a1_chunks(spark, sf):
    """Valid cells and sum of heights per tile, from chunks that are decoded straight from the files."""
    found = scan_chunks(spark, packed(spark, sf), SIDE).select("grid_id", F.explode("elevs").alias("elev")).where(~F.isnan("elev"))
    return found.groupBy("grid_id").agg(F.count("elev").alias("valid"), F.sum(F.col("elev").cast("double")).alias("total"))


@query("b2_repair_chunks", ORACLES["b2_repair_outliers"])
def b2_chunks(spark, sf):
    return chunks.unpack(packed_clean(spark, sf), grids(spark, sf), SIDE)


@query("b4_chunk_range", ORACLES["b4_elevation_range"])
def b4_chunks(spark, sf):
    return chunks.chunk_range(packed_clean(spark, sf))


@query("b6_downsample_chunks", ORACLES["b6_downsample"])
def b6_chunks(spark, sf):
    return chunks.downsample_chunks(chunks.pack(big(spark, sf), SIDE), derived(spark, sf, "big_grids"), 3, SIDE)


@query("c3_chunk_layer_counts", ORACLES["c3_layer_counts"])
def c3_chunks(spark, sf):
    return rounded(chunks.chunk_layer_counts(packed_clean(spark, sf), levels(spark, sf)), "elevation")


@query("c5_chunk_areas", ORACLES["c5_components"])
def c5_chunks(spark, sf):
    return area_cells(chunks.label_chunk_layers(packed_clean(spark, sf), levels(spark, sf), grids(spark, sf), SIDE))


@query("f1_chunk_triangles", ORACLES["f1_heightmap_triangles"])
def f1_chunks(spark, sf):
    groups = chunks.chunk_quads(packed_clean(spark, sf), SIDE)
    return heightmap.heightmap_triangles(clean(spark, sf), grids(spark, sf), "terrain", 400.0, 1200.0, vscale=2.0, groups=groups).triangles


@query("f1_chunk_vertices", ORACLES["f1_heightmap_vertices"])
def f1_chunk_vertices(spark, sf):
    groups = chunks.chunk_quads(packed_clean(spark, sf), SIDE)
    made = heightmap.heightmap_triangles(clean(spark, sf), grids(spark, sf), "terrain", 400.0, 1200.0, vscale=2.0, groups=groups)
    return rounded(made.vertices, "x", "y", "z")
