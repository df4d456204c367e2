"""Terrain-like inputs derived from the given tables by the same expression in Spark and in the oracle."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from isoterra.operators.grid import clean_nonfinite, elevation_range, grid_from_table, repair_outliers
from isoterra.operators.levels import contour_levels, layer_cells
from isoterra.operators.mesh import Mesh
from isoterra.spread import cut

# One template per fixture; {div} is whole division and {text} the text type of the engine.
TEMPLATES = {
    "dem_raw": """
select 'g0' grid_id, cast(p_partkey {div} 50 as int) grid_row, cast(p_partkey % 50 as int) grid_col,
  cast(case when p_partkey % 97 = 13 then -32768 when p_partkey % 131 = 5 then 12000
            when p_partkey % 211 = 7 then -900
            else 200 + 20 * p_size + greatest(0, 900 - 25 * (abs(p_partkey {div} 50 - 20) + abs(p_partkey % 50 - 25)))
       end as float) elev
from part""",
    "big_raw": """
select 'g1' grid_id, cast(o_orderkey {div} 100 as int) grid_row, cast(o_orderkey % 100 as int) grid_col,
  cast(case when o_orderkey % 997 = 3 then -32768 else floor(o_totalprice / 100) end as float) elev
from orders""",
    "grids": """
select 'g0' grid_id, cast(-151.0 as double) x0, cast(0.01 as double) dx, cast(0 as double) rx, cast(63.0 as double) y0,
  cast(0 as double) ry, cast(-0.01 as double) dy, 50 width, cast(count(*) {div} 50 as int) height
from part""",
    "big_grids": """
select 'g1' grid_id, cast(0 as double) x0, cast(1 as double) dx, cast(0 as double) rx, cast(0 as double) y0,
  cast(0 as double) ry, cast(-1 as double) dy, 100 width, cast(count(*) {div} 100 as int) height
from orders""",
    # Heights along 1,025 columns, the corners of 32 tiles of 33 cells a side.
    "lattice": """
select o_orderkey {div} 1025 r, o_orderkey % 1025 c,
  cast(case when o_orderkey % 977 = 5 then null
       else 300 + 10 * abs((o_orderkey % 1025) % 40 - 20) + 5 * abs((o_orderkey {div} 1025) % 30 - 15) + o_custkey % 3 end as float) elev
from orders""",
    "points": """
select event_id point_id, 'g0' grid_id,
  -151.0 + (cast((user_id * 37 + event_id) % 4700 as double) / 100 + 0.25) * 0.01 x,
  63.0 - (cast((user_id * 53 + event_id * 7) % 3700 as double) / 100 + 0.25) * 0.01 y
from events""",
    "locations": """
select c_custkey loc_id, cast((c_custkey * 7919) % 17000 as double) / 100 - 85 lat,
  cast((c_custkey * 104729) % 36000 as double) / 100 - 180 lon
from customer""",
    "boxes": """
select s_suppkey box_id, cast((s_suppkey * 13) % 120 - 60 as double) + 0.25 min_lat,
  cast((s_suppkey * 13) % 120 - 60 as double) + 0.25 + s_suppkey % 3 max_lat,
  case when s_suppkey % 10 = 9 then cast(178.5 as double)
       else cast((s_suppkey * 29) % 340 - 170 as double) + 0.5 end min_lon,
  case when s_suppkey % 10 = 9 then cast(-178.5 as double)
       else cast((s_suppkey * 29) % 340 - 170 as double) + 0.5 + s_suppkey % 4 end max_lon
from supplier""",
    "unit_text": """
select p_partkey id, concat(cast(p_size as {text}), case p_partkey % 8 when 0 then 'm' when 1 then ' km'
  when 2 then 'ft' when 3 then ' MI' when 4 then 'mm' when 5 then 'in' when 6 then '' else 'xyz' end) txt
from part""",
    "cache_log": """
select event_id, ts, concat('https://tile.example.org/', cast(user_id % 19 as {text}), '/',
  cast(user_id as {text}), '.png') url, event_type in ('view', 'click', 'purchase') hit, value ms
from events""",
    "cache_entries": """
select cast(user_id as {text}) cache_key, max(ts) cache_time, count(*) * 1000 bytes, user_id % 7 <> 3 present
from events group by user_id""",
    "angle_text": """
select c_custkey id, case c_custkey % 9
  when 0 then concat(cast(c_custkey % 80 as {text}), '°', cast(c_custkey % 60 as {text}), '''', cast(c_custkey % 50 as {text}), '"N')
  when 1 then concat(cast(c_custkey % 80 as {text}), 'd', cast(c_custkey % 60 as {text}), 'm', cast(c_custkey % 50 as {text}), 'sS')
  when 2 then concat('-', cast(c_custkey % 80 as {text}), '.25')
  when 3 then concat(' ', cast(c_custkey % 100 as {text}), ' ')
  when 4 then concat(cast(c_custkey % 80 as {text}), 'd', cast(c_custkey % 70 as {text}), 'W')
  when 5 then concat('-', cast(c_custkey % 80 as {text}), 'd30')
  when 6 then concat('-', cast(c_custkey % 80 as {text}), 'd30mE')
  when 7 then 'abc'
  else '' end txt
from customer""",
    "jobs": """
select c_custkey job_id, cast(1000 + c_custkey % 50 * 10 as double) xy_extent,
  case when c_custkey % 5 = 0 then null else cast(100 + c_custkey % 7 * 10 as double) end z_extent,
  cast(3 + c_custkey % 6 as int) num_layers, cast(3 + c_custkey % 4 as double) / 2 layer_thickness_mm,
  cast(200 as double) substrate_size_mm,
  case when c_custkey % 3 = 0 then cast(12 + c_custkey % 5 as double) end substrate_depth_mm,
  case when c_custkey % 4 = 0 then cast(250 as double) end bed_size_mm,
  case when c_custkey % 2 = 0 then cast(300 as double) end bed_x_mm,
  case when c_custkey % 2 = 0 then cast(220 as double) end bed_y_mm,
  case c_custkey % 7 when 0 then 'AUTO' when 1 then 'BED_SIZE' when 2 then 'MATERIAL_THICKNESS' when 3 then 'LAYERS'
    when 4 then 'EXPLICIT' when 5 then 'PRINT_HEIGHT' else 'UNIFORM_XYZ' end method_2d,
  case c_custkey % 7 when 1 then 'AUTO' when 2 then 'BED_SIZE' when 3 then 'MATERIAL_THICKNESS' when 5 then 'LAYERS'
    when 4 then 'EXPLICIT' when 6 then 'PRINT_HEIGHT' else 'UNIFORM_XYZ' end method_3d,
  case when c_custkey % 7 = 4 or c_custkey % 11 = 0 then cast(0.15 as double) end explicit_2d,
  case when c_custkey % 7 = 4 or c_custkey % 11 = 1 then cast(0.25 as double) end explicit_3d,
  c_custkey % 13 = 0 use_3d_for_2d, c_custkey % 13 = 1 use_2d_for_3d
from customer""",
    # A third of all points form one ring; the rest are polygons with an exterior and one hole.
    "loops": """
select 'g0' grid_id, cast(case when k % 3 = 0 then 0 else 1 + (j {div} 40) % 5 end as int) layer,
  case when k % 3 = 0 then cast(0 as bigint) else 1 + j {div} 40 end polygon_id,
  case when k % 3 = 0 then cast(0 as bigint) else (j {div} 20) % 2 end ring_id,
  case when k % 3 = 0 then k {div} 3 else j % 20 end seq,
  cast((k * 37) % 1000 as double) / 8 x, cast((k * 91 + k {div} 7) % 1000 as double) / 8 y
from (select o_orderkey k, o_orderkey - o_orderkey {div} 3 - 1 j from orders) t""",
    "soup_vertices": """
select concat('m', cast(p_size % 3 as {text})) mesh_id, 3 * p_partkey + c vid,
  cast((p_partkey * 7 + c * 13) % 10 as double) x, cast((p_partkey * 11 + c * c * 5) % 10 as double) y,
  cast(p_size % 5 + c as double) z
from part cross join (select 0 c union all select 1 union all select 2) corners""",
    "soup_triangles": """
select concat('m', cast(p_size % 3 as {text})) mesh_id, p_partkey tid, 3 * p_partkey v0,
  case when p_partkey % 60 = 11 then 3 * p_partkey else 3 * p_partkey + 1 end v1,
  case when p_partkey % 50 = 7 then cast(-1 as bigint) else 3 * p_partkey + 2 end v2
from part""",
    "places_text": """
select c_custkey id, case when c_custkey % 20 = 19 then 'not json'
  when c_custkey % 20 = 18 then '[]'
  else concat('[{{"display_name":"', c_name, '","lat":"', cast(c_custkey % 90 as {text}), '.5","lon":"-', cast(c_custkey % 180 as {text}),
    '.25","boundingbox":["1.5","2.5","3.5","4.5"],"osm_type":"node","class":"place","type":"', lower(c_mktsegment),
    '","importance":0.5}},{{"display_name":"second","lat":"10.0","lon":"20.0"}}]') end body
from customer""",
    "poi_text": """
select c_custkey id, case when c_custkey % 20 = 19 then 'not json'
  else concat('{{"elements":[{{"lat":', cast(c_custkey % 90 as {text}), '.5,"lon":-', cast(c_custkey % 180 as {text}),
    '.25,"tags":{{', case c_custkey % 6 when 0 then '"natural":"peak"' when 1 then '"place":"city"' when 2 then '"place":"town"'
      when 3 then '"place":"village"' when 4 then '"natural":"water"' else '"amenity":"cafe"' end,
    case c_custkey % 4 when 3 then '' when 2 then ',"ref":"R7"' else concat(',"name":"', c_name, '"') end,
    '}}}},{{"lat":1.5,"lon":2.5,"tags":{{"name":"fixed","natural":"peak"}}}}]}}') end body
from customer""",
    "run_files": """
select o_custkey % 50 run_id, o_orderstatus <> 'P' ok, o_orderkey * 10 bytes from orders""",
    "run_stages": """
select user_id % 50 run_id, event_type stage, ts start_time, event_id % 9 <> 4 completed,
  event_id % 100 took_ms, event_id
from events""",
}

SOURCES = {
    "dem_raw": "part", "big_raw": "orders", "grids": "part", "big_grids": "orders", "lattice": "orders", "points": "events",
    "locations": "customer", "boxes": "supplier", "unit_text": "part", "cache_log": "events", "cache_entries": "events",
    "angle_text": "customer", "jobs": "customer", "loops": "orders", "soup_vertices": "part", "soup_triangles": "part",
    "places_text": "customer", "poi_text": "customer", "run_files": "orders", "run_stages": "events",
}


def derived(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A fixture as a Spark frame over the whole source table."""
    source = SOURCES[name]
    view = f"isoterra_{source}"
    spark.read.parquet(f"{sf_dir}/{source}.parquet").createOrReplaceTempView(view)
    sql = TEMPLATES[name].format(div="div", text="varchar(64)")
    return spark.sql(sql.replace(f"from {source}", f"from {view}"))


def oracle(*names: str) -> str:
    """`with a as (...), b as (...)` of fixtures and derived steps for the oracle's dialect."""
    needed: list[str] = []

    def add(name: str) -> None:
        for other in DEPENDS.get(name, ()):
            add(other)
        if name not in needed:
            needed.append(name)

    for name in names:
        add(name)
    texts = {n: t.format(div="//", text="varchar") for n, t in TEMPLATES.items()} | STEPS
    parts = [f"{n} as ({texts[n].strip()})" for n in needed]
    return "with recursive " + ",\n".join(parts) + "\n"


# Cleaning and slicing of the fixture grid, written for the oracle.
STEPS = {
    "dem": """
select grid_id, grid_row, grid_col, case when elev > -30000 then elev end elev from dem_raw""",
    "big": """
select grid_id, grid_row, grid_col, case when elev > -30000 then elev end elev from big_raw""",
    "medians": """
select o.grid_id, o.grid_row, o.grid_col, median(cast(n.elev as double)) med
from dem o join dem n on n.grid_id = o.grid_id and abs(n.grid_row - o.grid_row) <= 1 and abs(n.grid_col - o.grid_col) <= 1
  and not (n.grid_row = o.grid_row and n.grid_col = o.grid_col)
where (o.elev < -500 or o.elev > 9000) and n.elev is not null
group by all having med between -500 and 9000""",
    "clean": """
select d.grid_id, d.grid_row, d.grid_col,
  case when d.elev < -500 or d.elev > 9000 then cast(m.med as float) else d.elev end elev
from dem d left join medians m using (grid_id, grid_row, grid_col)""",
    "span": """
select grid_id, coalesce(min(cast(elev as double)), 0.0) min_elev, coalesce(max(cast(elev as double)), 0.0) max_elev
from clean group by grid_id""",
    "levels": """
select grid_id, cast(i as int) level_index, min_elev + i * ((max_elev - min_elev) / 7) lower_,
  min_elev + (i + 1) * ((max_elev - min_elev) / 7) upper_
from span, range(0, 7) t(i)""",
    "members": """
select c.grid_id, l.level_index layer, c.grid_row, c.grid_col
from clean c join levels l on l.grid_id = c.grid_id and cast(c.elev as double) >= l.lower_""",
    "pairs": """
select a.grid_id, a.grid_row r, a.grid_col c, cast(a.elev as double) z00, cast(b.elev as double) z10,
  cast(d.elev as double) z01, cast(e.elev as double) z11
from clean a
join clean b on b.grid_id = a.grid_id and b.grid_row = a.grid_row and b.grid_col = a.grid_col + 1
join clean d on d.grid_id = a.grid_id and d.grid_row = a.grid_row + 1 and d.grid_col = a.grid_col
join clean e on e.grid_id = a.grid_id and e.grid_row = a.grid_row + 1 and e.grid_col = a.grid_col + 1
where a.elev is not null and b.elev is not null and d.elev is not null and e.elev is not null""",
    "runs": """
select layer, grid_row r, min(grid_col) c0, max(grid_col) c1, min(grid_row * 50 + grid_col) run
from (select *, grid_col - row_number() over (partition by layer, grid_row order by grid_col) k from members) t
group by layer, grid_row, k""",
    "touching": """
select a.layer, a.run a, b.run b from runs a join runs b
on a.layer = b.layer and abs(a.r - b.r) = 1 and b.c0 <= a.c1 + 1 and b.c1 >= a.c0 - 1""",
    "reach": """
select layer, run a, run b from runs
union select reach.layer, reach.a, touching.b from reach join touching on touching.layer = reach.layer and touching.a = reach.b""",
    "roots": """
select layer, b run, min(a) root from reach group by all""",
    "areas": """
select m.grid_id, m.layer, m.grid_row, m.grid_col, q.root component_id
from members m join runs r on r.layer = m.layer and r.r = m.grid_row and m.grid_col between r.c0 and r.c1
join roots q on q.layer = r.layer and q.run = r.run""",
    "corners": """
select t.mesh_id, t.tid, t.v0, t.v1, t.v2, a.x x0, a.y y0, a.z z0, b.x x1, b.y y1, b.z z1, c.x x2, c.y y2, c.z z2
from soup_triangles t
left join soup_vertices a on a.mesh_id = t.mesh_id and a.vid = t.v0
left join soup_vertices b on b.mesh_id = t.mesh_id and b.vid = t.v1
left join soup_vertices c on c.mesh_id = t.mesh_id and c.vid = t.v2""",
    "faces": """
select *, coalesce(v0 <> v1 and v1 <> v2 and v2 <> v0
  and (x1-x0)*(x1-x0)+(y1-y0)*(y1-y0)+(z1-z0)*(z1-z0) >= 1e-12
  and (x2-x1)*(x2-x1)+(y2-y1)*(y2-y1)+(z2-z1)*(z2-z1) >= 1e-12
  and (x0-x2)*(x0-x2)+(y0-y2)*(y0-y2)+(z0-z2)*(z0-z2) >= 1e-12, false) valid,
  (y1-y0)*(z2-z0) - (z1-z0)*(y2-y0) cx, (z1-z0)*(x2-x0) - (x1-x0)*(z2-z0) cy, (x1-x0)*(y2-y0) - (y1-y0)*(x2-x0) cz
from corners""",
    "geometry": """
select *, sqrt(cx*cx + cy*cy + cz*cz) len, case when valid then sqrt(cx*cx + cy*cy + cz*cz) / 2 else 0.0 end area from faces""",
    "edges": """
select mesh_id, least(a, b) lo, greatest(a, b) hi, tid from (
  select mesh_id, tid, v0 a, v1 b from soup_triangles union all select mesh_id, tid, v1, v2 from soup_triangles
  union all select mesh_id, tid, v2, v0 from soup_triangles) t""",
    "loop_edges": """
select *, coalesce(lead(x) over w, first_value(x) over v) next_x, coalesce(lead(y) over w, first_value(y) over v) next_y
from loops
window w as (partition by grid_id, layer, polygon_id, ring_id order by seq),
  v as (partition by grid_id, layer, polygon_id, ring_id order by seq rows between unbounded preceding and unbounded following)""",
    "loop_rings": """
select grid_id, layer, polygon_id, ring_id, abs(sum(x * next_y - next_x * y)) / 2 size,
  sum(sqrt((next_x - x) * (next_x - x) + (next_y - y) * (next_y - y))) len, count(*) + 1 vertices
from loop_edges group by all""",
    "loop_metrics": """
select grid_id, layer, polygon_id, sum(case when ring_id = 0 then size else -size end) area,
  sum(case when ring_id = 0 then size else 0 end) exterior_area, sum(case when ring_id = 0 then len else 0 end) perimeter,
  cast(sum(vertices) as bigint) vertices, cast(sum(case when ring_id = 0 then vertices else 0 end) as bigint) exterior_vertices,
  count(*) filter (ring_id <> 0) holes
from loop_rings group by all""",
}

DEPENDS = {
    "dem": ["dem_raw"], "big": ["big_raw"], "medians": ["dem"], "clean": ["dem", "medians"], "span": ["clean"],
    "levels": ["span"], "members": ["clean", "levels"], "pairs": ["clean"], "runs": ["members"], "touching": ["runs"],
    "reach": ["runs", "touching"], "roots": ["reach"], "areas": ["members", "runs", "roots"],
    "corners": ["soup_vertices", "soup_triangles"], "faces": ["corners"], "geometry": ["faces"], "edges": ["soup_triangles"],
    "loop_edges": ["loops"], "loop_rings": ["loop_edges"], "loop_metrics": ["loop_rings"],
}


def dem(spark: SparkSession, sf: str) -> DataFrame:
    return grid_from_table(derived(spark, sf, "dem_raw"), "grid_row", "grid_col", "elev")


def big(spark: SparkSession, sf: str) -> DataFrame:
    return grid_from_table(derived(spark, sf, "big_raw"), "grid_row", "grid_col", "elev")


def clean(spark: SparkSession, sf: str) -> DataFrame:
    return repair_outliers(clean_nonfinite(dem(spark, sf)))


def grids(spark: SparkSession, sf: str) -> DataFrame:
    return derived(spark, sf, "grids")


def levels(spark: SparkSession, sf: str, n: int = 7) -> DataFrame:
    return contour_levels(elevation_range(clean(spark, sf)), n)


def levelled(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    """The clean grid and its levels, each written once for all their readers."""
    grid = cut(clean(spark, sf))
    return grid, cut(contour_levels(elevation_range(grid), 7))


def members(spark: SparkSession, sf: str) -> DataFrame:
    return layer_cells(*levelled(spark, sf))


def soup(spark: SparkSession, sf: str) -> Mesh:
    return Mesh(derived(spark, sf, "soup_vertices"), derived(spark, sf, "soup_triangles"))


Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    """Register a query and, when SQL can say the same, its oracle."""

    def register(function: Query) -> Query:
        QUERIES[name] = function
        if sql is not None:
            ORACLES[name] = sql
        return function

    return register


def rounded(df: DataFrame, *columns: str, digits: int = 6) -> DataFrame:
    """Round computed decimals, as the oracle does."""
    return df.withColumns({c: F.round(F.col(c), digits) for c in columns})
