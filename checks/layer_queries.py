"""Queries for layers, areas, rings, pixels, colours, sinks and whole products."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from checks.fixtures import big, clean, dem, derived, grids, levelled, levels, members, oracle, query, rounded
from checks.mesh_queries import PLAIN, color_sql, facet_sql
from isoterra.functions.color import color_rgb, parse_hex, to_hex
from isoterra.operators import components as areas
from isoterra.operators import levels as lv
from isoterra.operators import polygons, raster, rings, solid, style
from isoterra.operators.grid import elevation_range
from isoterra.operators.mesh import validate_mesh
from isoterra.plans import products
from isoterra.sinks import features, geojson, meshtext, svg

INSET_MM = 1.2e6


@query(
    "c4_inset_layers",
    oracle("members", "grids")
    + """, eroded as (select m.* from members m, grids g where m.grid_row between 2 and g.height - 3 and m.grid_col between 2 and g.width - 3
  and (select count(*) from members n where n.layer = m.layer and (n.grid_row - m.grid_row) * (n.grid_row - m.grid_row) + (n.grid_col - m.grid_col) * (n.grid_col - m.grid_col) <= 4) = 13)
select m.grid_id, m.layer, m.grid_row, m.grid_col from members m anti join eroded e on e.layer = m.layer + 1 and e.grid_row = m.grid_row and e.grid_col = m.grid_col""",
)
def c4(spark, sf):
    return areas.inset_layers(members(spark, sf), grids(spark, sf), INSET_MM)


@query("c5_components", oracle("areas") + "select grid_id, layer, grid_row, grid_col, cast(component_id as bigint) as component_id from areas")
def c5(spark, sf):
    return areas.components(members(spark, sf), grids(spark, sf))


@query("c5_components_chunked", oracle("areas") + "select grid_id, layer, grid_row, grid_col, cast(component_id as bigint) as component_id from areas")
def c5_chunked(spark, sf):
    return areas.components(members(spark, sf), grids(spark, sf), chunk=16)


RING_SQL = """, sides as (select a.layer, a.component_id, count(*) n from areas a, (values (-1, 0), (0, 1), (1, 0), (0, -1)) s(dr, dc)
where not exists (select 1 from areas b where b.layer = a.layer and b.grid_row = a.grid_row + dr and b.grid_col = a.grid_col + dc) group by all),
sizes as (select layer, component_id, count(*) cells from areas group by all)
select layer, cast(component_id as bigint) as polygon_id, round(cells * 0.01 * 0.01, 6) as area, round(n * 0.01, 6) as boundary from sizes join sides using (layer, component_id)"""


@query("c6_ring_sums", oracle("areas") + RING_SQL)
def c6_sums(spark, sf):
    """Area and boundary length of the rings must be those of the cells they enclose."""
    cells = areas.components(members(spark, sf), grids(spark, sf))
    points = rings.rings(cells, grids(spark, sf), remove_holes=False, chunk=16)
    exterior = F.col("ring_id") == 0
    size = F.abs(F.col("twice_area")) / 2
    summed = polygons.ring_metrics(points).groupBy("layer", "polygon_id").agg(
        F.round(F.sum(F.when(exterior, size).otherwise(-size)), 6).alias("area"), F.round(F.sum("length"), 6).alias("boundary")
    )
    return summed


@query("c5_layer_areas", oracle("areas") + "select grid_id, layer, grid_row, grid_col, cast(component_id as bigint) as component_id from areas")
def c5_layers(spark, sf):
    return areas.area_cells(areas.label_layers(clean(spark, sf), levels(spark, sf), grids(spark, sf)))


@query("c6_rings")
def c6(spark, sf):
    labelled = areas.label_layers(clean(spark, sf), levels(spark, sf), grids(spark, sf))
    return rounded(rings.area_rings(labelled, grids(spark, sf), remove_holes=False), "x", "y")


def loops(spark, sf):
    return derived(spark, sf, "loops")


def loop_metrics(spark, sf):
    return polygons.polygon_metrics(loops(spark, sf))


@query(
    "c7_polygon_metrics",
    oracle("loop_metrics")
    + "select grid_id, layer, polygon_id, round(area, 5) as area, round(exterior_area, 5) as exterior_area, round(perimeter, 5) as perimeter, vertices, exterior_vertices, holes from loop_metrics",
)
def c7(spark, sf):
    return rounded(loop_metrics(spark, sf), "area", "exterior_area", "perimeter", digits=5)


@query(
    "c8_layer_stats",
    oracle("loop_metrics")
    + """select grid_id, layer, count(*) as polygons, cast(sum(vertices) as bigint) as vertices, cast(sum(holes) as bigint) as holes, round(sum(area), 4) as area,
min(exterior_vertices) as min_vertices, max(exterior_vertices) as max_vertices, cast(floor(avg(exterior_vertices)) as bigint) as avg_vertices,
count(*) filter (exterior_vertices < 3) as degenerate from loop_metrics group by rollup (grid_id, layer) having grid_id is not null""",
)
def c8(spark, sf):
    return rounded(polygons.layer_stats(loop_metrics(spark, sf)), "area", digits=4)


LAYER_SQL = """, heights as (select 'g0' grid_id, cast(i as int) layer, cast(100.0 + i * 50 as double) elevation from range(0, 8) t(i)),
sums as (select grid_id, layer, count(*) polygons, sum(area) area, cast(sum(vertices) as bigint) vertices from loop_metrics group by all),
tabled as (select h.grid_id, h.layer, h.elevation, coalesce(polygons, 0) polygons, coalesce(area, 0.0) area, coalesce(vertices, 0) vertices from heights h left join sums using (grid_id, layer)),
numbered as (select *, cast(row_number() over (partition by grid_id order by elevation) as int) layer_number from tabled where polygons > 0 and abs(area) >= 1e-12 and area >= 1e-12)"""


def layer_table(spark, sf):
    steps = grids(spark, sf).select("grid_id", F.explode(F.sequence(F.lit(0), F.lit(7))).alias("level_index"))
    heights = steps.withColumn("lower", F.lit(100.0) + F.col("level_index") * 50)
    return polygons.layer_table(loop_metrics(spark, sf), heights)


@query(
    "c9_drop_empty",
    oracle("loop_metrics") + LAYER_SQL
    + " select grid_id, layer, elevation, polygons, round(area, 4) as area, vertices, layer_number from numbered",
)
def c9(spark, sf):
    return rounded(lv.drop_empty(layer_table(spark, sf)), "area", digits=4)


@query(
    "c10_parse_layer_list",
    """with t as (select c_custkey id, c_custkey % 7 a, c_custkey % 7 + c_custkey % 5 b, c_custkey % 4 x from customer),
w as (select id, a - 1 lo, a - 1 hi from t union all select id, a, b from t union all select id, 40, 40 from t where x = 1 union all select id, 9, 9 from t)
select id, string_agg(distinct cast(n as varchar), ',' order by n) as layers from (select distinct id, n from w, range(-1, 50) r(n) where n between lo and hi) u
group by id""".replace("string_agg(distinct cast(n as varchar), ',' order by n)", "string_agg(cast(n as varchar), ',' order by n)").replace(
        "a - 1 lo, a - 1 hi from t union", "a - 1 lo, a - 1 hi from t where a > 0 union"
    ),
)
def c10(spark, sf):
    """Lists such as ` 3, 4-6,x,40,9`: a part below zero is a bad range, words are skipped."""
    customers = spark.read.parquet(f"{sf}/customer.parquet")
    a, b = F.col("c_custkey") % 7, F.col("c_custkey") % 7 + F.col("c_custkey") % 5
    more = F.when(F.col("c_custkey") % 4 == 1, ",40").otherwise(",x,7-2")
    text = F.concat(F.lit(" "), a - 1, F.lit(", "), a, F.lit("-"), b, more, F.lit(",9"))
    return customers.select(
        F.col("c_custkey").alias("id"), F.array_join(lv.parse_layer_list(text).cast("array<string>"), ",").alias("layers")
    )


@query(
    "c10_select_layers",
    oracle("loop_metrics") + LAYER_SQL
    + """ select layer, layer_number, min_ as range_min, max_ as range_max from (select *, min(elevation) over () min_, max(elevation) over () max_ from numbered) t where layer_number in (1, 3, 4)""",
)
def c10_select(spark, sf):
    kept = lv.select_layers(lv.drop_empty(layer_table(spark, sf)), "1,3-4")
    return kept.select("layer", "layer_number", "range_min", "range_max")


@query(
    "c11_layer_slabs",
    oracle("levels")
    + """, base as (select grid_id, level_index layer, lower_ - min(lower_) over () z_base, lead(lower_) over (order by lower_) - min(lower_) over () nxt,
  (max(upper_) over () - min(lower_) over ()) / count(*) over () step from levels)
select layer, round(z_base, 6) as z_base, round(case when coalesce(nxt, z_base + step) <= z_base then z_base + 0.1 else coalesce(nxt, z_base + step) end, 6) as z_top from base""",
)
def c11(spark, sf):
    made = levels(spark, sf)
    span = made.groupBy("grid_id").agg(F.min("lower").alias("lo"), F.max("upper").alias("hi"))
    rows = made.select("grid_id", F.col("level_index").alias("layer"), F.col("lower").alias("elevation")).join(span, "grid_id")
    return rounded(lv.layer_slabs(rows, F.col("lo"), F.col("hi")), "z_base", "z_top").select("layer", "z_base", "z_top")


@query(
    "c11_laser_slabs",
    oracle("levels") + "select level_index as layer, round(cast(level_index * 3.2 as double), 6) as z_base, round(cast((level_index + 1) * 3.2 as double), 6) as z_top from levels",
)
def c11_laser(spark, sf):
    rows = levels(spark, sf).select("grid_id", F.col("level_index").alias("layer"), F.col("lower").alias("elevation"))
    return rounded(lv.layer_slabs(rows, 0.0, 0.0, laser_mm=3.2), "z_base", "z_top").select("layer", "z_base", "z_top")


@query(
    "c12_complexity_gate",
    oracle("loop_rings")
    + """select grid_id, cast(sum(vertices) as bigint) as vertices, case when sum(vertices) > 10000000 then 'reject' when sum(vertices) > 1000000 then 'warn' else 'pass' end as verdict from loop_rings group by grid_id""",
)
def c12(spark, sf):
    return polygons.complexity_gate(loops(spark, sf))


@query(
    "c13_polygon_bounds",
    oracle("loops")
    + """select layer, polygon_id, min(x) - case when max(x) - min(x) < 1e-6 then 0.5 else 0 end as min_x, min(y) - case when max(y) - min(y) < 1e-6 then 0.5 else 0 end as min_y,
max(x) + case when max(x) - min(x) < 1e-6 then 0.5 else 0 end as max_x, max(y) + case when max(y) - min(y) < 1e-6 then 0.5 else 0 end as max_y from loops group by layer, polygon_id""",
)
def c13(spark, sf):
    return polygons.polygon_bounds(loops(spark, sf), ["layer", "polygon_id"])


@query(
    "c14_largest_polygon",
    oracle("loop_metrics")
    + """select grid_id, layer, polygon_id, round(exterior_area, 4) as exterior_area from loop_metrics
qualify row_number() over (partition by grid_id, layer order by round(exterior_area, 7) desc, polygon_id) = 1""",
)
def c14(spark, sf):
    return rounded(polygons.largest_polygon(loop_metrics(spark, sf)), "exterior_area", digits=4)


@query(
    "d1_dedup_ring",
    oracle("loop_edges")
    + """, kept as (select * from loop_edges where (next_x - x) * (next_x - x) + (next_y - y) * (next_y - y) >= 60.0 * 60.0),
n as (select *, row_number() over (partition by layer, polygon_id, ring_id order by seq) - 1 s, count(*) over (partition by layer, polygon_id, ring_id) c from kept)
select layer, polygon_id, ring_id, s as seq, x, y from n where c >= 3""",
)
def d1(spark, sf):
    return polygons.dedup_ring(loops(spark, sf), 60.0).select("layer", "polygon_id", "ring_id", "seq", "x", "y")


@query(
    "d2_decimate_ring",
    oracle("loops")
    + """, walk as (
  select grid_id, layer, polygon_id, ring_id, seq, x, y, x ax, y ay, true kept from loops where seq = 0
  union all
  select l.grid_id, l.layer, l.polygon_id, l.ring_id, l.seq, l.x, l.y,
    case when (l.x - ax) * (l.x - ax) + (l.y - ay) * (l.y - ay) < 1600.0 then ax else l.x end,
    case when (l.x - ax) * (l.x - ax) + (l.y - ay) * (l.y - ay) < 1600.0 then ay else l.y end,
    not (l.x - ax) * (l.x - ax) + (l.y - ay) * (l.y - ay) < 1600.0
  from walk w join loops l on l.grid_id = w.grid_id and l.layer = w.layer and l.polygon_id = w.polygon_id and l.ring_id = w.ring_id and l.seq = w.seq + 1),
ordered as (
  select *, row_number() over (partition by grid_id, layer, polygon_id, ring_id order by seq) - 1 n,
    count(*) over (partition by grid_id, layer, polygon_id, ring_id) size from walk where kept)
select grid_id, layer, polygon_id, ring_id, n as seq, x, y from ordered where size >= 3""",
)
def d2(spark, sf):
    return polygons.decimate_ring(loops(spark, sf), 40.0, block=512)


@query(
    "d3_fit_canvas",
    oracle("loops")
    + """, b as (select min(x) x0, max(x) x1, min(y) y0, max(y) y1 from loops),
f as (select *, 180.0 * ((y1 - y0) / (x1 - x0)) + 20.0 h, 180.0 / (x1 - x0) s from b)
select layer, polygon_id, ring_id, seq, round((x - x0) * s + (200.0 - (x1 - x0) * s) / 2, 6) as x, round(h - ((y - y0) * s + (h - (y1 - y0) * s) / 2), 6) as y from loops, f""",
)
def d3(spark, sf):
    points = loops(spark, sf)
    fitted = polygons.fit_canvas(points, polygons.polygon_bounds(points, ["grid_id"]), 200.0, 10.0)
    return rounded(fitted, "x", "y").drop("grid_id")


def frame(spark, sf, width=160, margin=8):
    box = grids(spark, sf).select(
        "grid_id",
        F.col("x0").alias("min_x"),
        (F.col("y0") + F.col("height") * F.col("dy")).alias("min_y"),
        (F.col("x0") + F.col("width") * F.col("dx")).alias("max_x"),
        F.col("y0").alias("max_y"),
    )
    return raster.raster_frame(box, width, margin)


FRAME_SQL = """, box as (select grid_id, x0 min_x, y0 + height * dy min_y, x0 + width * dx max_x, y0 max_y from grids),
sized as (select *, cast(trunc(160 * (((max_y - min_y) * 111000.0) / ((max_x - min_x) * 111000.0 * cos(radians((min_y + max_y) / 2))))) as int) h from box),
frame as (select *, (max_x - min_x) / 144 pw, (max_y - min_y) / (h - 16) ph from sized)"""


@query(
    "d4_geo_to_pixel",
    oracle("grids", "points") + FRAME_SQL
    + """ select point_id, cast(greatest(0, least(159, trunc(8 + (x - min_x) / (max_x - min_x) * 144))) as int) as px,
cast(greatest(0, least(h - 1, trunc(8 + (1.0 - (y - min_y) / (max_y - min_y)) * (h - 16)))) as int) as py from points join frame using (grid_id)""",
)
def d4(spark, sf):
    return raster.geo_to_pixel(derived(spark, sf, "points"), frame(spark, sf)).select("point_id", "px", "py")


@query(
    "d5_raster_frame",
    oracle("grids") + FRAME_SQL
    + """ select grid_id, 160 as width_px, h as height_px, round(pw, 9) as pixel_w, round(ph, 9) as pixel_h, round(min_x - 8 * pw, 6) as origin_x, round(max_y + 8 * ph, 6) as origin_y from frame""",
)
def d5(spark, sf):
    made = rounded(rounded(frame(spark, sf), "pixel_w", "pixel_h", digits=9), "origin_x", "origin_y")
    return made.select("grid_id", "width_px", "height_px", "pixel_w", "pixel_h", "origin_x", "origin_y")


def named_heights(found):
    return found.select("grid_id", F.col("level_index").alias("layer"), F.col("lower").alias("elevation"))


def heights(spark, sf):
    return named_heights(levels(spark, sf))


@query(
    "d6_rasterize",
    oracle("members", "grids") + FRAME_SQL
    + """, px as (select px, py, cast(floor((max_y + 8 * ph - (py + 0.5) * ph - 63.0) / -0.01) as int) r, cast(floor((min_x - 8 * pw + (px + 0.5) * pw - -151.0) / 0.01) as int) c
  from frame, range(0, 160) a(px), range(0, 100000) b(py) where py < h),
top as (select grid_row r, grid_col c, max(layer) layer from members group by all),
pos as (select px, py, t.layer, (l.lower_ - (select min(lower_) from levels)) / ((select max(lower_) from levels) - (select min(lower_) from levels)) at_
  from px left join top t using (r, c) left join levels l on l.level_index = t.layer)
select cast(px as int) as px, cast(py as int) as py, """
    + ", ".join(
        f"case when layer is null then 255 else cast(trunc({color_sql('at_', k)} * 255::float) as int) end as {c}"
        for k, c in ((1, "r"), (2, "g"), (3, "b"))
    )
    + ", 255 as a from pos",
)
def d6(spark, sf):
    banded = lv.banded_cells(clean(spark, sf), levels(spark, sf))
    return raster.rasterize(banded, heights(spark, sf), grids(spark, sf), frame(spark, sf)).drop("grid_id")


@query(
    "d6_layer_images",
    oracle("members", "grids") + FRAME_SQL
    + """, px as (select px, py, cast(floor((max_y + 8 * ph - (py + 0.5) * ph - 63.0) / -0.01) as int) r, cast(floor((min_x - 8 * pw + (px + 0.5) * pw - -151.0) / 0.01) as int) c
  from frame, range(0, 160) a(px), range(0, 100000) b(py) where py < h),
hue as (select level_index layer, (lower_ - (select min(lower_) from levels)) / ((select max(lower_) from levels) - (select min(lower_) from levels)) at_ from levels)
select l.layer, cast(px as int) as px, cast(py as int) as py, """
    + ", ".join(
        f"case when m.layer is null then 255 else cast(trunc({color_sql('at_', k)} * 255::float) as int) end as {c}"
        for k, c in ((1, "r"), (2, "g"), (3, "b"))
    )
    + ", 255 as a from px cross join hue l left join members m on m.layer = l.layer and m.grid_row = px.r and m.grid_col = px.c",
)
def d6_images(spark, sf):
    banded = lv.banded_cells(clean(spark, sf), levels(spark, sf))
    return raster.layer_images(banded, heights(spark, sf), grids(spark, sf), frame(spark, sf)).drop("grid_id")


def ring_points(spark, sf, **options):
    cells = areas.components(members(spark, sf), grids(spark, sf))
    return rings.rings(cells, grids(spark, sf), **options)


# Cells that no path over free cells and sides joins to the outside of the grid.
FILLED_SQL = """, free as (
  select l.layer, r, c from (select distinct layer from {members}) l, range(-1, (select max(grid_row) + 2 from dem)) a(r), range(-1, 51) b(c)
  except select layer, grid_row, grid_col from {members}),
outside as (
  select layer, r, c from free where r = -1
  union select f.layer, f.r, f.c from outside o join free f on f.layer = o.layer and abs(f.r - o.r) + abs(f.c - o.c) = 1
    and f.r between o.r - 1 and o.r + 1 and f.c between o.c - 1 and o.c + 1),
filled as (
  select 'g0' grid_id, l.layer, r grid_row, c grid_col
  from (select distinct layer from {members}) l, range(0, (select max(grid_row) + 1 from dem)) a(r), range(0, 50) b(c)
  except select 'g0', layer, r, c from outside)"""


@query(
    "d6_filled_cells",
    oracle("members") + FILLED_SQL.format(members="members")
    + " select grid_id, cast(layer as int) as layer, cast(grid_row as int) as grid_row, cast(grid_col as int) as grid_col from filled",
)
def d6_filled(spark, sf):
    return raster.filled_cells(ring_points(spark, sf), grids(spark, sf))


@query("d7_outline_pixels")
def d7(spark, sf):
    return raster.outline_pixels(ring_points(spark, sf), frame(spark, sf), 2.0)


@query(
    "e1_color_rgb",
    oracle("clean")
    + "select grid_row, grid_col, "
    + ", ".join(f"cast(trunc({color_sql('at_', k, 'rainbow')} * 255::float) as int) as {c}" for k, c in ((1, "r"), (2, "g"), (3, "b")))
    + " from (select grid_row, grid_col, least(greatest((elev::double - 300.0) / (1500.0 - 300.0), 0.0), 1.0) at_ from clean where elev is not null) t",
)
def e1(spark, sf):
    color = color_rgb(F.col("elev").cast("double"), F.lit(300.0), F.lit(1500.0), "rainbow")
    cells = clean(spark, sf).where(F.col("elev").isNotNull())
    return cells.select("grid_row", "grid_col", color.alias("_c")).select("grid_row", "grid_col", "_c.*")


@query(
    "e2_band_materials",
    oracle("span")
    + "select grid_id, band, round(elevation, 6) as elevation, 'elevation_' || cast(trunc(elevation) as int) || 'm' as name, "
    + ", ".join(f"round(cast({color_sql('at_', k)} as double), 5) as diffuse_{c}" for k, c in ((1, "r"), (2, "g"), (3, "b")))
    + ", round(cast("
    + color_sql("at_", 1)
    + " * 0.3::float as double), 5) as ambient_r, 0.1::double as specular, 10.0::double as shininess from (select grid_id, cast(i as int) band, min_elev + (max_elev - min_elev) * (i / 11.0) elevation, least(greatest((min_elev + (max_elev - min_elev) * (i / 11.0) - min_elev) / (max_elev - min_elev), 0.0), 1.0) at_ from span, range(0, 12) t(i)) u",
)
def e2(spark, sf):
    made = style.band_materials(elevation_range(clean(spark, sf)), 12)
    shown = made.select(
        "grid_id", "band", "elevation", "name", *[F.col(c).cast("double").alias(c) for c in ("diffuse_r", "diffuse_g", "diffuse_b", "ambient_r")],
        "specular", "shininess",
    )
    return rounded(rounded(shown, "elevation"), "diffuse_r", "diffuse_g", "diffuse_b", "ambient_r", digits=5)


@query(
    "e5_hex_colors",
    """with t as (select p_partkey id, case when p_partkey % 10 = 3 then '#12345' when p_partkey % 10 = 7 then 'zzzzzz'
  else (case when p_partkey % 2 = 0 then '#' else '' end) || lpad(printf('%x', p_partkey * 7919 % 16777216), 6, '0') end txt, (p_partkey % 101) / 100.0 u from part)
select id, case when id % 10 in (3, 7) then 255 else id * 7919 % 16777216 // 65536 end as r, case when id % 10 in (3, 7) then 0 else id * 7919 % 65536 // 256 end as g,
  case when id % 10 in (3, 7) then 0 else id * 7919 % 256 end as b, '#' || repeat(lpad(printf('%x', cast(trunc(cast(u as float) * 255::float) as bigint)), 2, '0'), 3) as gray from t""",
)
def e5(spark, sf):
    key = F.col("p_partkey")
    digits = F.lower(F.lpad(F.hex(key * 7919 % 16777216), 6, "0"))
    text = F.when(key % 10 == 3, "#12345").when(key % 10 == 7, "zzzzzz").otherwise(F.concat(F.when(key % 2 == 0, "#").otherwise(""), digits))
    unit = (key % 101) / F.lit(100.0)
    rgb = spark.read.parquet(f"{sf}/part.parquet").select(
        key.alias("id"), parse_hex(text).alias("_c"), to_hex(unit, unit, unit).alias("gray")
    )
    return rgb.select("id", *[F.col(f"_c.{c}").cast("long").alias(c) for c in "rgb"], "gray")


@query(
    "e6_polygon_style",
    oracle("levels")
    + """, t as (select *, (row_number() over (order by lower_) - 1) / greatest(count(*) over () - 1, 1)::double t, (lower_ - min(lower_) over ()) / (max(lower_) over () - min(lower_) over ()) at_ from levels)
select level_index as layer, '#' || """
    + " || ".join(f"lpad(printf('%x', cast(trunc({color_sql('at_', k)} * 255::float) as bigint)), 2, '0')" for k in (1, 2, 3))
    + """ as fill, 0.85::double as fill_opacity, '#' || lpad(printf('%x', cast(trunc((1.0 - t) * 255) as bigint)), 2, '0') || '00' || lpad(printf('%x', cast(trunc(t * 255) as bigint)), 2, '0') as stroke from t""",
)
def e6(spark, sf):
    return style.polygon_style(heights(spark, sf)).select("layer", "fill", "fill_opacity", "stroke")


SOLID_SQL = """, sides as (
  select m.layer, count(*) n from members m cross join (values (0, 1), (0, -1), (1, 0), (-1, 0)) d(r, c)
  left join members o on o.layer = m.layer and o.grid_row = m.grid_row + r and o.grid_col = m.grid_col + c
  where o.layer is null group by m.layer),
counted as (select layer, 4 * count(*) + 2 * any_value(s.n) n from members join sides s using (layer) group by layer)
select 'g0#' || layer mesh_id, cast(n as bigint) triangles, cast(n * 3 // 2 as bigint) edges, 0::bigint boundary_edges,
  0::bigint excess_edges, 0::bigint degenerate, true manifold, true watertight, true as valid from counted"""


@query("f6_extrude_layers", oracle("members") + SOLID_SQL)
def f6(spark, sf):
    grid, found = levelled(spark, sf)
    slabs = lv.layer_slabs(named_heights(found), 0.0, 2000.0)
    return validate_mesh(solid.extrude_layers(lv.layer_cells(grid, found), slabs, grids(spark, sf)))


def numbered(spark, sf):
    product = products.contour_product(dem(spark, sf), grids(spark, sf), products.Job(remove_holes=False))
    return product.ring_points, product.layers


@query("k1_geojson")
def k1(spark, sf):
    return geojson.to_geojson(*numbered(spark, sf), area=True, style=True)


@query(
    "k2_feature_table",
    oracle("loop_metrics")
    + """select polygon_id, cast(round(elevation, 2) as decimal(12,2)) as elevation, layer_number, round(cast(cast(exterior_area as decimal(16,4)) as double), 3) as area, round(cast(cast(perimeter as decimal(16,4)) as double), 3) as perimeter
from (select grid_id, layer, polygon_id, 100.0 + layer * 50 elevation, cast(dense_rank() over (order by layer) as int) layer_number, exterior_area, perimeter from loop_metrics) t""",
)
def k2(spark, sf):
    points = loops(spark, sf)
    shown = points.select("grid_id", "layer").distinct()
    layers = shown.withColumn("elevation", F.lit(100.0) + F.col("layer") * 50).withColumn(
        "layer_number", F.dense_rank().over(Window.partitionBy("grid_id").orderBy("layer"))
    )
    table = features.feature_table(points, layers)
    # The table rounds to four decimals; three are compared so that sums in another order still agree.
    return table.select(
        "polygon_id", "elevation", "layer_number",
        F.round(F.col("area").cast("double"), 3).alias("area"), F.round(F.col("perimeter").cast("double"), 3).alias("perimeter"),
    )


@query(
    "k2_feature_wkt",
    oracle("loops")
    + """, told as (select *, format('{:.6g} {:.6g}', x, y) p from loops),
rings as (select grid_id, layer, polygon_id, ring_id, '(' || string_agg(p, ', ' order by seq) || ', ' || first(p order by seq) || ')' r from told group by all)
select grid_id, layer, polygon_id, 'POLYGON (' || string_agg(r, ', ' order by ring_id) || ')' wkt from rings group by all""",
)
def k2_wkt(spark, sf):
    return features.whole_geometry(features.feature_geometry(loops(spark, sf)))


GEOJSON_SQL = """, named as (
  select *, 100.0 + layer * 50 elevation, cast(dense_rank() over (order by layer) as int) layer_number,
    min(polygon_id) over (partition by grid_id, layer) head from loop_metrics),
pts as (select *, '[' || format('{:.6f}', x) || ', ' || format('{:.6f}', y) || ']' p from loops)
select grid_id, layer, polygon_id, ring_id, cast(-1 as bigint) part, case when ring_id = 0 then '[' else ',[' end as value from pts where seq = 0
union all select grid_id, layer, polygon_id, ring_id, 4611686018427387904, ', ' || p || ']' from pts where seq = 0
union all select grid_id, layer, polygon_id, ring_id, cast(seq // 8192 as bigint),
  case when seq // 8192 > 0 then ', ' else '' end || string_agg(p, ', ' order by seq) from pts group by grid_id, layer, polygon_id, ring_id, seq // 8192
union all select grid_id, layer, polygon_id, -1, 0, case when polygon_id = head then '' else ',' end || '{"type": "Feature","properties": {"elevation": '
  || format('{:.6f}', elevation) || ', "layer": ' || layer_number || ', "area": ' || format('{:.6f}', exterior_area)
  || ', STYLE},"geometry": {"type": "Polygon","coordinates": [' from named
union all select grid_id, layer, polygon_id, 4611686018427387904, 0, ']}}' from named
union all select distinct grid_id, layer, -1, -1, -1, '{"type": "FeatureCollection","features": [' from named
union all select distinct grid_id, layer, 4611686018427387904, 4611686018427387904, 4611686018427387904, ']}' from named"""


@query("k1_geojson_loops", oracle("loop_metrics") + GEOJSON_SQL.replace("STYLE", geojson.STYLE))
def k1_loops(spark, sf):
    points = loops(spark, sf)
    order = Window.partitionBy("grid_id").orderBy("layer")
    layers = points.select("grid_id", "layer").distinct().withColumns(
        {"elevation": F.lit(100.0) + F.col("layer") * 50, "layer_number": F.dense_rank().over(order)}
    )
    return geojson.to_geojson(points, layers, area=True, style=True)


@query("k3_svg")
def k3(spark, sf):
    return svg.svg_lines(*numbered(spark, sf), holes=True)


def surface(spark, sf):
    return products.terrain_mesh(dem(spark, sf), grids(spark, sf)).mesh


STL_SQL = facet_sql("quad", "-151.0::double", "0.01::double", "63.0::double", "-0.01::double")


@query(
    "k4_stl",
    oracle("pairs") + ", quad as (select * from pairs)" + STL_SQL
    + """ select 'g0' as mesh_id, 1 as section, cast((r * 50 + c) * 2 + n as bigint) as line, value from facet
union all select 'g0', 0, 0, 'solid topographic_model' union all select 'g0', 2, 0, 'endsolid topographic_model'""",
)
def k4(spark, sf):
    return meshtext.stl_lines(surface(spark, sf), bed_mm=200.0)


TEXT_SQL = """, vertex as (select r, c, z, row_number() over (order by r, c) - 1 n, format('{:.6f}', -151.0::double + c * 0.01::double) || ' '
  || format('{:.6f}', 63.0::double + r * -0.01::double) || ' ' || format('{:.6f}', z) p from corner),
box as (select min(z) lo, max(z) hi from vertex),
face as (select (r * 50 + c) * 2 + k tid, r, c, k, (z10 + z01 + case when k = 0 then z00 else z11 end) total, case when k = 0 then z00 + z10 + z01 else z10 + z11 + z01 end / 3.0 mean from pairs, range(0, 2) t(k)),
told as (select f.tid, f.mean, v0.n n0, v1.n n1, v2.n n2 from face f
  join vertex v0 on v0.r = f.r and v0.c = f.c + k
  join vertex v1 on v1.r = f.r + k and v1.c = f.c + 1
  join vertex v2 on v2.r = f.r + 1 and v2.c = f.c)"""


@query(
    "k5_obj",
    oracle("pairs") + ", " + PLAIN + TEXT_SQL
    + """, banded as (select *, cast(trunc(least(greatest((mean - lo) / (hi - lo), 0.0), 1.0) * 9) as int) band, lo + (hi - lo) * (cast(trunc(least(greatest((mean - lo) / (hi - lo), 0.0), 1.0) * 9) as int) / 9.0) elevation from told, box),
marked as (select *, coalesce(lag(band) over (order by tid) <> band, true) changed from banded)
select 'g0' as mesh_id, 1 as section, cast(0 as bigint) as line, 'g g0' || chr(10) || 'o g0' as value
union all select 'g0', 2, n, 'v ' || p from vertex union all select 'g0', 3, n, 'vn 0.000000 0.000000 1.000000' from vertex
union all select 'g0', 4, tid, case when changed then 'usemtl elevation_' || cast(trunc(elevation) as int) || 'm' || chr(10) else '' end
  || 'f ' || (n0 + 1) || '//' || (n0 + 1) || ' ' || (n1 + 1) || '//' || (n1 + 1) || ' ' || (n2 + 1) || '//' || (n2 + 1) from marked""",
)
def k5(spark, sf):
    return meshtext.obj_lines(surface(spark, sf), bands=10)


def _mtl_sql() -> str:
    channels = [f"cast({color_sql('at_', k)} as float)" for k in (1, 2, 3)]
    dark = " || ' ' || ".join(f"format('{{:.3f}}', cast({c} * 0.3::float as double))" for c in channels)
    full = " || ' ' || ".join(f"format('{{:.3f}}', cast({c} as double))" for c in channels)
    line = "chr(10)"
    return f"""select grid_id mesh_id, 0 section, band as line, 'newmtl elevation_' || cast(trunc(elevation) as int) || 'm' || {line} ||
  'Ka ' || {dark} || {line} || 'Kd ' || {full} || {line} || 'Ks 0.100 0.100 0.100' || {line} || 'Ns 10.000' || {line} as value
from (select grid_id, i band, min_elev + (max_elev - min_elev) * (i / 9.0) elevation,
  least(greatest((min_elev + (max_elev - min_elev) * (i / 9.0) - min_elev) / (max_elev - min_elev), 0.0), 1.0) at_ from span, range(0, 10) t(i)) u"""


@query("k5_mtl", oracle("span") + _mtl_sql())
def k5_mtl(spark, sf):
    ranges = elevation_range(clean(spark, sf)).withColumnRenamed("grid_id", "mesh_id")
    return meshtext.mtl_lines(style.band_materials(ranges, 10, key="mesh_id"))


@query(
    "k6_ply",
    oracle("pairs") + ", " + PLAIN + TEXT_SQL
    + """ select 'g0' as mesh_id, 0 as section, cast(0 as bigint) as line, 'ply' || chr(10) || 'format ascii 1.0' || chr(10) || 'element vertex ' || (select count(*) from vertex) || chr(10)
  || array_to_string(list_transform(['x', 'y', 'z', 'nx', 'ny', 'nz'], lambda p: 'property float ' || p || chr(10)), '')
  || array_to_string(list_transform(['red', 'green', 'blue'], lambda p: 'property uchar ' || p || chr(10)), '')
  || 'element face ' || (select count(*) from told) || chr(10) || 'property list uchar int vertex_indices' || chr(10) || 'end_header' as value
union all select 'g0', 1, n, p || ' 0.000000 0.000000 1.000000 ' || cast(trunc(255 * (z - lo) / (hi - lo)) as int) || ' ' || (255 - cast(trunc(255 * (z - lo) / (hi - lo)) as int)) || ' 0' from vertex, box
union all select 'g0', 2, tid, '3 ' || n0 || ' ' || n1 || ' ' || n2 from told""",
)
def k6(spark, sf):
    return meshtext.ply_lines(surface(spark, sf))


@query("p1_contour_product")
def p1(spark, sf):
    product = products.contour_product(big(spark, sf), derived(spark, sf, "big_grids"), products.Job(layers=5))
    return rounded(product.layers, "area", "elevation")


@query(
    "p2_terrain_mesh",
    oracle("pairs") + ", " + PLAIN
    + """ select 'g0' as mesh_id, (select count(*) from tri) as triangles, (select count(*) from vert) as vertices, round(min(z), 6) as min_z, round(max(z), 6) as max_z from vert""",
)
def p2(spark, sf):
    product = products.terrain_mesh(dem(spark, sf), grids(spark, sf))
    counts = product.mesh.triangles.groupBy("mesh_id").agg(F.count(F.lit(1)).alias("triangles"))
    corners = product.mesh.vertices.groupBy("mesh_id").agg(F.count(F.lit(1)).alias("vertices"))
    return rounded(counts.join(corners, "mesh_id").join(product.extents, "mesh_id"), "min_z", "max_z").select(
        "mesh_id", "triangles", "vertices", "min_z", "max_z"
    )


@query(
    "p3_layered_solid",
    oracle("clean", "span")
    + """, five as (select i layer, min_elev + i * ((max_elev - min_elev) / 5) lower_ from span, range(0, 5) t(i)),
held as (select layer, grid_row, grid_col from clean, five where cast(elev as double) >= lower_)"""
    + FILLED_SQL.format(members="held") + SOLID_SQL.replace("members", "filled"),
)
def p3(spark, sf):
    return products.layered_solid(dem(spark, sf), grids(spark, sf), products.Job(layers=5)).report

