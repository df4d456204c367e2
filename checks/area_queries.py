"""Queries from a box in degrees to files and back: tiles are packed, those of the box read, products written and read again."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from checks.fixtures import derived, oracle, query
from checks.mesh_queries import facet_sql
from isoterra.functions.tiles import tile_id
from isoterra.plans.area import BoxJob, make_area
from isoterra.plans.products import Job
from isoterra.sinks.tiles import write_hgt
from isoterra.spread import shared_folder

# A tile has 33 cells a side; neighbours share their border cells. The box needs 4 of 32 tiles in a row, and 5 that do not exist.
SIDE, STEPS, NORTH, WEST = 33, 32, 80, 10
BOX = {"min_lat": 79.6, "max_lat": 80.2, "min_lon": 12.3, "max_lon": 15.7}


def packed(spark: SparkSession, sf: str) -> str:
    """Folder of the tile files of the lattice fixture."""
    cells = derived(spark, sf, "lattice")

    def homes(at: str):
        own = F.col(at).cast("int") - F.pmod(F.col(at).cast("int"), F.lit(STEPS))
        return F.explode(F.when((F.col(at) % STEPS == 0) & (F.col(at) > 0), F.array(own, own - STEPS)).otherwise(F.array(own)))

    tiled = cells.withColumn("_top", homes("r")).withColumn("_left", homes("c")).where(F.col("_left") < 1024)
    name = tile_id(NORTH - 1 - F.col("_top") / STEPS, WEST + F.col("_left") / STEPS)
    grid = tiled.select(name.alias("grid_id"), (F.col("r") - F.col("_top")).alias("grid_row"), (F.col("c") - F.col("_left")).alias("grid_col"), "elev")
    folder = f"{shared_folder(spark)}/tiles-{uuid.uuid4().hex}"
    write_hgt(grid, folder, SIDE).count()
    return folder


def made(spark: SparkSession, sf: str, kind: str, **options) -> DataFrame:
    """Lines of the documents that a job writes in one format, with their file names."""
    out = f"{shared_folder(spark)}/products-{uuid.uuid4().hex}"
    job = BoxJob(**BOX, formats=(kind,), gate=False, **options)
    return spark.read.text(make_area(spark, packed(spark, sf), job, out)[kind])


BOX_SQL = """, box as (
  select cast(r as int) r, cast(c as int) - 74 c, cast(elev as double) z from lattice where r <= 13 and c between 74 and 182)"""
BOX_PAIRS = """, quad as (
  select a.r, a.c, a.z z00, b.z z10, d.z z01, e.z z11 from box a join box b on b.r = a.r and b.c = a.c + 1
  join box d on d.r = a.r + 1 and d.c = a.c join box e on e.r = a.r + 1 and e.c = a.c + 1
  where a.z + b.z + d.z + e.z is not null)"""


@query(
    "p2_box_to_stl",
    oracle("lattice") + BOX_SQL + BOX_PAIRS
    + facet_sql("quad", "12.0::double - (1.0::double / 32) / 2 + 10 * (1.0::double / 32)", "1.0::double / 32", "80.0::double + (1.0::double / 32) / 2", "-(1.0::double / 32)")
    + """ select 'area.stl' file, unnest(string_split(value, chr(10))) as value from facet
union all select 'area.stl', 'solid topographic_model' union all select 'area.stl', 'endsolid topographic_model'""",
)
def box_stl(spark, sf):
    return made(spark, sf, "stl")


@query(
    "p1_box_to_geojson",
    oracle("lattice") + BOX_SQL
    + """, span as (select min(z) lo, max(z) hi from box), lev as (select i layer, lo + i * ((hi - lo) / 4) lower_ from span, range(0, 4) t(i)),
member as (select layer, r, c from box, lev where z >= lower_),
run as (select layer, r, min(c) c0, max(c) c1, min(r * 200 + c) run from (select *, c - row_number() over (partition by layer, r order by c) k from member) t group by layer, r, k),
touch as (select a.layer, a.run a, b.run b from run a join run b on a.layer = b.layer and abs(a.r - b.r) = 1 and b.c0 <= a.c1 + 1 and b.c1 >= a.c0 - 1),
reach as (select layer, run a, run b from run union select reach.layer, reach.a, touch.b from reach join touch on touch.layer = reach.layer and touch.a = reach.b),
root as (select layer, b run, min(a) root from reach group by all)
select 'area.geojson' file, format('{:.6f}', lower_) elevation, cast(l.layer + 1 as varchar) layer_number, count(distinct root) features
from root join lev l using (layer) group by all""",
)
def box_geojson(spark, sf):
    lines = made(spark, sf, "geojson", job=Job(layers=4), separate_layers=False)
    told = '"elevation": ([0-9.]+), "layer": ([0-9]+)'
    shown = lines.where(F.col("value").contains('"Feature"'))
    parts = [F.regexp_extract("value", told, n) for n in (1, 2)]
    return shown.groupBy("file", parts[0].alias("elevation"), parts[1].alias("layer_number")).agg(F.count(F.lit(1)).alias("features"))
