"""Queries for tiles, grids, sampling and levels."""

from __future__ import annotations

import gzip

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from checks.fixtures import big, clean, dem, derived, grids, levels, members, oracle, query, rounded
from isoterra.functions.tiles import slippy_corner, slippy_tile, tile_name, tile_prefix, tile_url
from isoterra.operators import catalogue, grid, levels as lv, sampling
from isoterra.sources.hgt import decode_tiles

# Cells per side of the small tiles that the scan query packs from a table.
TILE_SIDE = 32


def pack_tile(pdf: pd.DataFrame) -> pd.DataFrame:
    """One bounded tile of numbers as a compressed raster file."""
    tile = int(pdf["tile"].iloc[0])
    values = np.full(TILE_SIDE * TILE_SIDE, -32768, dtype=">i2")
    values[pdf["at"].to_numpy()] = pdf["height"].to_numpy()
    path = f"/tiles/N{tile // 180 % 90:02d}E{tile % 180:03d}.hgt.gz"
    return pd.DataFrame({"path": [path], "content": [gzip.compress(values.tobytes(), mtime=0)]})


@query(
    "a1_scan_hgt",
    """select 'N' || lpad(cast(o_orderkey // 1024 // 180 % 90 as varchar), 2, '0') || 'E' || lpad(cast(o_orderkey // 1024 % 180 as varchar), 3, '0') as grid_id,
cast(o_orderkey % 1024 // 32 as int) as grid_row, cast(o_orderkey % 32 as int) as grid_col, cast(o_custkey % 3000 as float) as elev
from orders where o_orderkey % 997 <> 3""",
)
def scan(spark, sf):
    orders = spark.read.parquet(f"{sf}/orders.parquet")
    cells = orders.select(
        F.expr("o_orderkey div 1024").alias("tile"),
        (F.col("o_orderkey") % 1024).cast("int").alias("at"),
        F.when(F.col("o_orderkey") % 997 == 3, -32768).otherwise(F.col("o_custkey") % 3000).cast("short").alias("height"),
    )
    files = cells.groupBy("tile").applyInPandas(pack_tile, "path string, content binary")
    return decode_tiles(files).where(F.col("elev").isNotNull())


@query("a2_grid_from_table", oracle("dem") + "select grid_id, grid_row, grid_col, elev from dem")
def a2(spark, sf):
    return dem(spark, sf)


NAME_SQL = """case when floor({lat}) >= 0 then 'N' else 'S' end || lpad(cast(cast(abs(floor({lat})) as int) as varchar), 2, '0')
|| case when floor({lon}) >= 0 then 'E' else 'W' end || lpad(cast(cast(abs(floor({lon})) as int) as varchar), 3, '0') || '.hgt.gz'"""


@query(
    "a3_tile_name",
    oracle("locations")
    + f"select loc_id, tile, substr(tile, 1, 3) as prefix from (select loc_id, {NAME_SQL.format(lat='lat', lon='lon')} tile from locations) t",
)
def a3(spark, sf):
    tile = tile_name(F.col("lat"), F.col("lon"))
    return derived(spark, sf, "locations").select("loc_id", tile.alias("tile"), tile_prefix(tile).alias("prefix"))


PARTS_SQL = """parts as (
select box_id, 1 part, min_lat, max_lat, min_lon, case when min_lon > max_lon then 180.0 else max_lon end max_lon from boxes
union all select box_id, 2, min_lat, max_lat, -180.0, max_lon from boxes where min_lon > max_lon)"""
COVER_SQL = """cover as (
select distinct box_id, {name} tile from (
  select box_id, a lat, o lon from parts, range(-90, 91) x(a), range(-180, 181) y(o)
  where a between floor(min_lat) and floor(max_lat) and o between floor(min_lon) and floor(max_lon)) t)""".format(
    name=NAME_SQL.format(lat="lat", lon="lon")
)
STOCK_SQL = """stock as (
select tile, (hash_no % 4) * 4000000 + 2000000 bytes from (
  select tile, cast(substr(tile, 2, 2) as int) + cast(substr(tile, 5, 3) as int) hash_no from (select distinct tile from cover) u) t)"""


@query(
    "a4_tiles_for_bbox",
    oracle("boxes") + ", " + PARTS_SQL + ", " + COVER_SQL + " select box_id, tile from cover",
)
def a4(spark, sf):
    return catalogue.needed_tiles(derived(spark, sf, "boxes"))


@query(
    "a5_split_antimeridian",
    oracle("boxes") + ", " + PARTS_SQL + " select box_id, cast(part as int) as part, min_lat, max_lat, min_lon, max_lon from parts",
)
def a5(spark, sf):
    return catalogue.split_antimeridian(derived(spark, sf, "boxes"))


def stock(spark, sf):
    """An inventory with good, too small and too large files for the tiles in use."""
    tiles = catalogue.needed_tiles(derived(spark, sf, "boxes")).select("tile").distinct()
    number = F.substring("tile", 2, 2).cast("int") + F.substring("tile", 5, 3).cast("int")
    return tiles.select("tile", (number % 4 * 4000000 + 2000000).alias("bytes"))


@query(
    "a6_tile_coverage",
    oracle("boxes") + ", " + ", ".join([PARTS_SQL, COVER_SQL, STOCK_SQL])
    + """ select box_id, count(*) as needed, count(bytes) as cached, count(*) filter (bytes is null) as missing
from cover left join (select * from stock where bytes between 5000000 and 50000000) s using (tile) group by box_id""",
)
def a6(spark, sf):
    return catalogue.tile_coverage(derived(spark, sf, "boxes"), stock(spark, sf))


@query(
    "a6_missing_tiles",
    oracle("boxes") + ", " + ", ".join([PARTS_SQL, COVER_SQL, STOCK_SQL])
    + " select tile from stock where bytes not between 5000000 and 50000000",
)
def a6_missing(spark, sf):
    return catalogue.missing_tiles(derived(spark, sf, "boxes"), stock(spark, sf))


def tiles_of(spark, sf):
    """The fixture grid twice: as it is, and shifted by 7 columns and 5 rows as a later tile."""
    first = dem(spark, sf)
    second = first.withColumns({"grid_id": F.lit("g9"), "elev": (F.col("elev") + 1).cast("float")})
    frames = grids(spark, sf).withColumn("tile_order", F.lit(1))
    shifted = frames.withColumns(
        {"grid_id": F.lit("g9"), "x0": F.col("x0") + 0.07, "y0": F.col("y0") - 0.05, "tile_order": F.lit(2)}
    )
    return first.unionByName(second), frames.unionByName(shifted)


@query(
    "a7_mosaic",
    oracle("dem")
    + """, placed as (select grid_row, grid_col, elev, 1 o from dem
union all select grid_row + 5, grid_col + 7, cast(elev + 1 as float), 2 from dem)
select 'mosaic' as grid_id, grid_row, grid_col, max_by(elev, o) filter (elev is not null) as elev from placed group by grid_row, grid_col""",
)
def a7(spark, sf):
    return grid.mosaic(*tiles_of(spark, sf))


@query(
    "a7_mosaic_geometry",
    oracle("grids") + "select 'mosaic' as grid_id, round(x0, 6) as x0, round(y0, 6) as y0, dx, dy, cast(width + 7 as int) as width, cast(height + 5 as int) as height from grids",
)
def a7_geometry(spark, sf):
    frame = grid.mosaic_geometry(tiles_of(spark, sf)[1])
    return rounded(frame, "x0", "y0").select("grid_id", "x0", "y0", "dx", "dy", "width", "height")


CLIP = (-150.895, 62.755, -150.625, 62.955)


@query(
    "a8_clip",
    oracle("dem")
    + """select grid_id, cast(grid_row - 4 as int) as grid_row, cast(grid_col - 10 as int) as grid_col, elev from dem
where grid_row >= 4 and grid_row < least(25, (select max(grid_row) + 1 from dem)) and grid_col >= 10 and grid_col < 38""",
)
def a8(spark, sf):
    return grid.clip(dem(spark, sf), grids(spark, sf), *CLIP)


@query(
    "a8_clip_geometry",
    oracle("grids")
    + """select grid_id, round(x0 + 0.1, 6) as x0, round(y0 - 0.04, 6) as y0, 28 as width, cast(least(25, height) - 4 as int) as height
from grids where height > 4""",
)
def a8_geometry(spark, sf):
    frame = grid.clip_geometry(grids(spark, sf), *CLIP)
    return rounded(frame, "x0", "y0").select("grid_id", "x0", "y0", "width", "height")


@query(
    "a9_slippy_tile",
    oracle("locations")
    + """select loc_id, x, y, 'https://tile.example.org/11/' || x || '/' || y || '.png' as url,
round(degrees(atan((exp(pi() * (1.0 - 2.0 * y / 2048)) - exp(-pi() * (1.0 - 2.0 * y / 2048))) / 2)), 6) as nw_lat, round(x / 2048.0 * 360.0 - 180.0, 6) as nw_lon from (
select loc_id, cast(least(greatest(floor((lon + 180.0) / 360.0 * 2048), 0), 2047) as int) x,
  cast(least(greatest(floor((1.0 - asinh(tan(radians(lat))) / pi()) / 2.0 * 2048), 0), 2047) as int) y from locations) t""",
)
def a9(spark, sf):
    tiled = derived(spark, sf, "locations").withColumn("_t", slippy_tile(F.col("lat"), F.col("lon"), 11))
    x, y = F.col("_t.x"), F.col("_t.y")
    corner = slippy_corner(11, x, y)
    return tiled.select(
        "loc_id",
        x.alias("x"),
        y.alias("y"),
        tile_url("https://tile.example.org/{z}/{x}/{y}.png", F.lit(11), x, y).alias("url"),
        F.round(corner["lat"], 6).alias("nw_lat"),
        F.round(corner["lon"], 6).alias("nw_lon"),
    )


BAD_SQL = """bad as (select grid_id, grid_row, grid_col,
case when (grid_row * 50 + grid_col) % 83 = 4 then 'nan'::float when (grid_row * 50 + grid_col) % 89 = 6 then 'inf'::float else elev end elev from dem)"""


def bad(spark, sf):
    at = F.col("grid_row") * 50 + F.col("grid_col")
    spoilt = F.when(at % 83 == 4, float("nan")).when(at % 89 == 6, float("inf")).otherwise(F.col("elev"))
    return dem(spark, sf).withColumn("elev", spoilt.cast("float"))


@query(
    "b1_clean_nonfinite",
    oracle("dem") + ", " + BAD_SQL + " select grid_id, grid_row, grid_col, case when isfinite(elev) then elev end as elev from bad",
)
def b1(spark, sf):
    return grid.clean_nonfinite(bad(spark, sf))


@query("b2_repair_outliers", oracle("clean") + "select grid_id, grid_row, grid_col, elev from clean")
def b2(spark, sf):
    return clean(spark, sf)


@query(
    "b3_quality_report",
    oracle("dem", "clean")
    + """, counts as (select grid_id, count(*) total, count(*) filter (elev is null) invalid,
  count(*) filter (elev < -500 or elev > 9000) extreme, count(*) filter (elev between -500 and 9000) plausible from dem group by grid_id),
kept as (select grid_id, count(elev) kept from clean group by grid_id)
select grid_id, total, invalid, extreme, kept - plausible as repaired, round(invalid * 100.0 / total, 6) as invalid_pct,
  round(extreme * 100.0 / total, 6) as extreme_pct, round((kept - plausible) * 100.0 / total, 6) as repaired_pct,
  invalid * 100.0 / total <= 50.0 as usable from counts join kept using (grid_id)""",
)
def b3(spark, sf):
    return grid.quality_report(dem(spark, sf), clean(spark, sf))


@query("b4_elevation_range", oracle("span") + "select * from span")
def b4(spark, sf):
    return grid.elevation_range(clean(spark, sf))


@query(
    "b5_grid_diagnostics",
    oracle("dem")
    + """select grid_id, count(elev) as valid, count(*) filter (elev is null) as voids,
count(*) filter (elev < -10000 or elev > 10000) as extreme, min(cast(elev as double)) as min_elev, max(cast(elev as double)) as max_elev,
max(cast(elev as double)) - min(cast(elev as double)) as span from dem group by grid_id""",
)
def b5(spark, sf):
    return grid.grid_diagnostics(dem(spark, sf))


@query(
    "b5_level_diagnostics",
    oracle("levels", "dem")
    + """, ends as (select grid_id, min(cast(elev as double)) lo, max(cast(elev as double)) hi from dem group by grid_id)
select l.grid_id, l.level_index, round(l.lower_, 6) as level, case when l.lower_ < e.lo then 'below' when l.lower_ > e.hi then 'above' else 'in' end as position,
  (select count(*) from dem d where d.grid_id = l.grid_id and cast(d.elev as double) < l.lower_) as cells_under
from levels l join ends e using (grid_id)""",
)
def b5_levels(spark, sf):
    return rounded(grid.level_diagnostics(dem(spark, sf), levels(spark, sf)), "level")


@query(
    "b6_downsample",
    oracle("big", "big_grids")
    + """select b.grid_id, cast(grid_row // 3 as int) as grid_row, cast(grid_col // 3 as int) as grid_col, cast(avg(cast(elev as double)) as float) as elev
from big b join big_grids g using (grid_id) where grid_row // 3 < height // 3 and grid_col // 3 < width // 3 group by all""",
)
def b6(spark, sf):
    return grid.downsample(big(spark, sf), derived(spark, sf, "big_grids"), 3)


@query(
    "b6_downsample_geometry",
    oracle("grids")
    + """select grid_id, x0, round(dx * 3, 6) as dx, y0, round(dy * 3, 6) as dy, cast(width // 3 as int) as width, cast(height // 3 as int) as height from grids""",
)
def b6_geometry(spark, sf):
    frame = grid.downsample_geometry(grids(spark, sf), 3)
    return rounded(frame, "dx", "dy").select("grid_id", "x0", "dx", "y0", "dy", "width", "height")


@query(
    "b7_with_coords",
    oracle("dem")
    + """select grid_id, grid_row, grid_col, elev, round(cast(-151.0 + (grid_col + 0.5) * 0.01 as double), 6) as x, round(cast(63.0 - (grid_row + 0.5) * 0.01 as double), 6) as y from dem""",
)
def b7(spark, sf):
    return rounded(grid.with_coords(dem(spark, sf), grids(spark, sf), center=True), "x", "y")


@query(
    "b8_project_local",
    oracle("locations")
    + """select 'degrees' grid_id, loc_id, round((lon - 10.0) * 111320.0 * cos(radians(45.0)), 6) as lon, round((lat - 45.0) * 110540.0, 6) as lat from locations
union all select 'metres' grid_id, loc_id, round(lon * 37, 6) as lon, round(lat * 53, 6) as lat from locations""",
)
def b8(spark, sf):
    """A grid in degrees, and one in metres around the origin that has points within 360 and 180 of it."""
    degrees = derived(spark, sf, "locations").withColumn("grid_id", F.lit("degrees"))
    metres = degrees.withColumns({"grid_id": F.lit("metres"), "lon": F.col("lon") * 37, "lat": F.col("lat") * 53})
    both = degrees.unionByName(metres)
    return rounded(grid.project_local(both, 10.0, 45.0, "lon", "lat", by=["grid_id"]), "lon", "lat").select("grid_id", "loc_id", "lon", "lat")


SAMPLE_SQL = """placed as (select {keys}, (x - -151.0) / 0.01 px, (y - 63.0) / -0.01 py, x, y from {points}),
based as (select *, case when px >= 0 and px < 49 and py >= 0 and py < (select max(height) - 1 from grids) then cast(floor(py) as int) end r,
  case when px >= 0 and px < 49 and py >= 0 and py < (select max(height) - 1 from grids) then cast(floor(px) as int) end c from placed),
valued as (select p.*, a.elev::double z00, b.elev::double z01, d.elev::double z10, e.elev::double z11, px - c fx, py - r fy from based p
  left join clean a on a.grid_row = r and a.grid_col = c left join clean b on b.grid_row = r and b.grid_col = c + 1
  left join clean d on d.grid_row = r + 1 and d.grid_col = c left join clean e on e.grid_row = r + 1 and e.grid_col = c + 1),
sampled as (select {keys}, x, y, coalesce(z00*(1-fx)*(1-fy) + z01*fx*(1-fy) + z10*(1-fx)*fy + z11*fx*fy,
  case when fy >= 0.5 then case when fx >= 0.5 then z11 else z10 end else case when fx >= 0.5 then z01 else z00 end end) elev from valued)"""


@query(
    "b9_sample_bilinear",
    oracle("points", "clean", "grids") + ", " + SAMPLE_SQL.format(keys="point_id", points="points")
    + " select point_id, round(elev, 6) as elev from sampled",
)
def b9(spark, sf):
    sampled = sampling.sample_bilinear(derived(spark, sf, "points"), clean(spark, sf), grids(spark, sf))
    return rounded(sampled, "elev").select("point_id", "elev")


@query(
    "b10_sample_grid",
    oracle("clean", "grids")
    + """, lattice as (select cast(i as int) ix, cast(j as int) iy, -150.95::double + i * ((-150.55::double - -150.95::double) / 50) x, 62.65::double + j * ((62.95::double - 62.65::double) / 50) y from range(0, 50) a(i), range(0, 50) b(j)), """
    + SAMPLE_SQL.format(keys="ix, iy", points="lattice")
    + " select ix, iy, round(elev, 5) as elev from sampled where elev is not null",
)
def b10(spark, sf):
    box = (-150.95, 62.65, -150.55, 62.95)
    sampled = sampling.sample_grid(clean(spark, sf), grids(spark, sf), box, sampling.PRESETS["draft"])
    return rounded(sampled, "elev", digits=5).select("ix", "iy", "elev")


@query(
    "b11_fit_bounding_sphere",
    oracle("clean")
    + """, pts as (select grid_id, grid_row, grid_col, grid_col * 30.0 x, grid_row * 30.0 y, elev::double z from clean where elev between 300 and 1500),
f as (select grid_id, 0.9 * 200 / 1000 / sqrt(pow(max(x) - min(x), 2) + pow(max(y) - min(y), 2) + pow(max(z) - min(z), 2)) s,
  (min(x) + max(x)) / 2 cx, (min(y) + max(y)) / 2 cy, min(z) z0 from pts group by grid_id)
select p.grid_id, grid_row, grid_col, round((x - cx) * s * 1000, 6) as x, round((y - cy) * s * 1000, 6) as y, round((z - z0) * s * 1000, 6) as z
from pts p join f using (grid_id)""",
)
def b11(spark, sf):
    points = clean(spark, sf).where(F.col("elev").isNotNull()).select(
        "grid_id",
        "grid_row",
        "grid_col",
        (F.col("grid_col") * 30.0).alias("x"),
        (F.col("grid_row") * 30.0).alias("y"),
        F.col("elev").cast("double").alias("z"),
    )
    return rounded(sampling.fit_bounding_sphere(points, 200.0, 300.0, 1500.0), "x", "y", "z")


def level_sql(body: str) -> str:
    return oracle("span") + body


@query(
    "c1_contour_levels",
    level_sql("select grid_id, cast(i as int) as level_index, round(min_elev + i * ((max_elev - min_elev) / 7), 6) as lower, round(min_elev + (i + 1) * ((max_elev - min_elev) / 7), 6) as upper from span, range(0, 7) t(i)"),
)
def c1(spark, sf):
    return rounded(levels(spark, sf), "lower", "upper")


@query(
    "c1_levels_logarithmic",
    level_sql(""", b as (select grid_id, least(max_elev, 1100.0) hi, greatest(min_elev, 250.0) lo from span)
select grid_id, cast(row_number() over (partition by grid_id order by v) - 1 as int) as level_index, round(v, 6) as lower from (
  select grid_id, exp(ln(greatest(lo, 1.0)) + i * ((ln(greatest(hi, lo + 1.0)) - ln(greatest(lo, 1.0))) / 6)) v from b, range(0, 7) t(i)
  union all select grid_id, 500.0 from b) u qualify lead(v) over (partition by grid_id order by v) is not null"""),
)
def c1_log(spark, sf):
    ranges = grid.elevation_range(clean(spark, sf))
    made = lv.contour_levels(ranges, 6, strategy="logarithmic", min_elev=250.0, max_elev=1100.0, fixed=500.0)
    return rounded(made.drop("upper"), "lower")


@query(
    "c1_levels_interval_threshold",
    level_sql(""", b as (select grid_id, min_elev lo, least(max_elev, min_elev + 430.0) hi from span),
n as (select *, cast(ceil((hi - lo) / 100) as int) n from b)
select grid_id, cast(i as int) as level_index, round(lo + (exp(i::double / n * 2.0) - 1.0) / (exp(2.0) - 1.0) * (hi - lo), 6) as lower
from n, range(0, 100) t(i) where i < n"""),
)
def c1_interval(spark, sf):
    ranges = grid.elevation_range(clean(spark, sf))
    made = lv.contour_levels(ranges, interval=100.0, strategy="exponential", threshold=430.0)
    return rounded(made.drop("upper"), "lower")


@query(
    "c2_plain_levels",
    level_sql("select grid_id, cast(i as int) as level_index, round(min_elev + i * ((max_elev - min_elev) / 5), 6) as value from span, range(0, 6) t(i) where min_elev < max_elev union all select grid_id, 0, min_elev from span where min_elev = max_elev"),
)
def c2(spark, sf):
    return rounded(lv.plain_levels(grid.elevation_range(clean(spark, sf)), 5), "value")


@query("c3_layer_cells", oracle("members") + "select grid_id, layer, grid_row, grid_col from members")
def c3_cells(spark, sf):
    return members(spark, sf)


@query(
    "c3_layer_counts",
    oracle("levels", "clean")
    + """select l.grid_id, l.level_index as layer, round(l.lower_, 6) as elevation,
  count(*) filter (cast(c.elev as double) >= l.lower_) as cells,
  round(count(*) filter (cast(c.elev as double) >= l.lower_) / count(c.elev)::double, 6) as share
from levels l join clean c using (grid_id) group by l.grid_id, l.level_index, l.lower_""",
)
def c3_counts(spark, sf):
    return rounded(lv.layer_counts(clean(spark, sf), levels(spark, sf)), "elevation")
