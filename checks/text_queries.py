"""Queries for text functions, print scale, places and logs."""

from __future__ import annotations

from pyspark.sql import functions as F

from checks.fixtures import derived, oracle, query, rounded
from isoterra.functions import angles, labels, tiles, units
from isoterra.operators import logs, places, scale

FACTOR_SQL = "case {u} when 'm' then 1.0 when 'km' then 1000.0 when 'ft' then 0.3048 when 'mi' then 1609.34 when 'mm' then 0.001 when 'in' then 0.0254 end"


@query(
    "s1_parse_distance",
    oracle("unit_text")
    + """, p as (select id, txt, cast(regexp_extract(txt, '^\\s*([0-9]+)', 1) as double) n, lower(trim(regexp_extract(txt, '^\\s*[0-9]+(.*)$', 1))) u from unit_text),
q as (select *, case when u = '' then 'm' when u in ('m', 'km', 'ft', 'mi', 'mm', 'in') then u end unit from p)
select id, round(n * """
    + FACTOR_SQL.format(u="unit")
    + """, 6) as value, unit, case when unit is not null then u <> '' end as explicit, case when unit is null then 'unknown unit' end as error from q""",
)
def s1(spark, sf):
    parsed = derived(spark, sf, "unit_text").select("id", units.parse_distance(F.col("txt")).alias("_p")).select("id", "_p.*")
    return rounded(parsed, "value")


@query(
    "s2_convert_distance",
    "select p_partkey as id, round(p_retailprice * 0.3048 / 0.0254, 6) as inches, round(p_retailprice * 1609.34 / 1000.0, 6) as km, p_retailprice as same from part",
)
def s2(spark, sf):
    price = F.col("p_retailprice")
    return spark.read.parquet(f"{sf}/part.parquet").select(
        F.col("p_partkey").alias("id"),
        F.round(units.convert_distance(price, "ft", "in"), 6).alias("inches"),
        F.round(units.convert_distance(price, "mi", "km"), 6).alias("km"),
        units.convert_distance(price, "px", "px").alias("same"),
    )


ANGLE_SQL = """, k as (select id, id % 80 d, id % 60 m, id % 50 s, id % 9 kind from angle_text),
v as (select id, case kind when 0 then d + m / 60.0 + s / 3600.0 when 1 then -(d + m / 60.0 + s / 3600.0) when 2 then -(d + 0.25)
  when 3 then id % 100 when 4 then case when id % 70 < 60 then -(d + id % 70 / 60.0) end when 5 then -(d + 0.5)
  when 6 then d + 0.5 end::double v from k)"""


@query(
    "s3_parse_angle",
    oracle("angle_text") + ANGLE_SQL
    + """, w as (select id, case when id % 9 = 5 and id % 80 = 0 then 0.5 else v end v from v)
select id, round(case when v between -90 and 90 then v end, 6) as lat, round(case when v between -180 and 180 then v end, 6) as lon from w""",
)
def s3(spark, sf):
    rows = derived(spark, sf, "angle_text")
    text = F.col("txt")
    # Minus zero degrees has no sign, as in decimal parsing of the degrees alone.
    return rows.select(
        "id", F.round(angles.parse_latitude(text), 6).alias("lat"), F.round(angles.parse_longitude(text), 6).alias("lon")
    )


@query(
    "s4_parse_pair",
    """with c as (select c_custkey id, c_custkey % 80 a, c_custkey % 170 b, c_custkey % 4 k from customer)
select id, case k when 0 then a + 0.5 when 1 then a + 0.5 when 2 then -(a + 0.5) end::double as lat, case k when 0 then -(b + 0.25) when 1 then -(b + 0.25) when 2 then b + 0.25 end::double as lon,
  coalesce(case k when 0 then a + 0.5 when 1 then a + 0.5 when 2 then -(a + 0.5) end > 20 and case k when 0 then -(b + 0.25) when 1 then -(b + 0.25) when 2 then b + 0.25 end < 30, false) as box_ok,
  case k when 0 then a + 0.5 when 1 then a + 0.5 when 2 then -(a + 0.5) end::double as lenient_lat from c""",
)
def s4(spark, sf):
    key = F.col("c_custkey")
    a, b, k = (key % 80).cast("string"), (key % 170).cast("string"), key % 4
    lat, lon = F.concat(a, F.lit(".5")), F.concat(b, F.lit(".25"))
    strict = (
        F.when(k == 0, F.concat(lat, F.lit(",-"), lon))
        .when(k == 1, F.concat(lat, F.lit("N, "), lon, F.lit("W")))
        .when(k == 2, F.concat(F.lit("-"), lat, F.lit(","), lon))
        .otherwise("nowhere")
    )
    loose = (
        F.when(k == 0, F.concat(lat, F.lit("°,-"), lon))
        .when(k == 1, F.concat(F.lit("N"), lat, F.lit(", W"), lon))
        .when(k == 2, F.concat(F.lit("S"), lat, F.lit(",E"), lon))
        .otherwise("1,2,3")
    )
    corner = F.struct(F.lit(20.0).alias("lat"), F.lit(30.0).alias("lon"))
    parsed = spark.read.parquet(f"{sf}/customer.parquet").select(
        key.alias("id"), angles.parse_pair(strict).alias("_p"), angles.parse_pair(loose, lenient=True).alias("_q")
    )
    return parsed.select(
        "id", "_p.lat", "_p.lon", angles.valid_box(F.col("_p"), corner).alias("box_ok"), F.col("_q.lat").alias("lenient_lat")
    )


@query(
    "s5_stroke",
    """with t as (select p_partkey id, p_size n, p_partkey % 3 k from part)
select id, round(case k when 0 then n * 25.4 / 300.0 when 1 then n::double else n * 0.0254 / 0.001 end, 6) as mm, round(n * 300.0 / 25.4, 6) as px, case k when 0 then 'px' when 1 then 'mm' else 'in' end as unit from t""",
)
def s5(spark, sf):
    n, k = F.col("p_size"), F.col("p_partkey") % 3
    text = F.concat(n, F.when(k == 0, "").when(k == 1, "mm").otherwise('"'))
    return spark.read.parquet(f"{sf}/part.parquet").select(
        F.col("p_partkey").alias("id"), units.parse_stroke(text, 300.0).alias("_s"), F.round(units.mm_to_px(n, 300.0), 6).alias("px")
    ).select("id", F.round("_s.value", 6).alias("mm"), "px", F.col("_s.unit").alias("unit"))


TEMPLATE = "%{n}/%{l} e=%{e} c=%{c} at %{C} ul %{UL} w=%{w} W=%{W} s=1:%{s} %%{x} %{zz}"


@query(
    "s6_render_label",
    """with t as (select s_suppkey id, s_suppkey % 12 layer, s_suppkey * 7 + 0.5 elevation, s_suppkey % 100 * 0.25 x0, s_suppkey % 80 * 0.5 y0, s_suppkey % 3 * 100.0 sub from supplier)
select id, case when layer > 0 then cast(layer as varchar) else '%{n}' end || '/' || lpad(cast(layer as varchar), 2, '0') || ' e=' || cast(cast(floor(elevation + 0.5) as int) as varchar) || ' c=25.0m at '
|| printf('%.4f', y0 + 0.5) || '°, ' || printf('%.4f', x0 + 1.0) || '° ul ' || printf('%.4f', y0 + 1.0) || '°, ' || printf('%.4f', x0) || '° w=2.0m W=' || case when sub > 0 then printf('%.1f', sub) || 'mm' else '%{W}' end
|| ' s=1:25000 %{{x} %{zz}' as label from t""",
)
def s6(spark, sf):
    key = F.col("s_suppkey")
    rows = spark.read.parquet(f"{sf}/supplier.parquet").select(
        key.alias("id"), (key % 12).cast("int").alias("layer"), (key * 7 + 0.5).alias("elevation"),
        (key % 100 * 0.25).alias("x"), (key % 80 * 0.5).alias("y"), (key % 3 * 100.0).alias("sub"),
    )
    label = labels.render_label(
        F.lit(TEMPLATE), scale_ratio=F.lit(25000.0), contour_height=F.lit(25.0), layer=F.col("layer"), elevation=F.col("elevation"),
        min_x=F.col("x"), min_y=F.col("y"), max_x=F.col("x") + 2.0, max_y=F.col("y") + 1.0, substrate_mm=F.col("sub"),
    )
    return rows.select("id", label.alias("label"))


@query(
    "s7_format_coord",
    oracle("locations")
    + """, d as (select *, cast(floor(abs(lat)) as int) ad, (abs(lat) - floor(abs(lat))) * 60 ar, cast(floor(abs(lon)) as int) od, (abs(lon) - floor(abs(lon))) * 60 orr from locations)
select loc_id, printf('%.4f', lat) || '°, ' || printf('%.4f', lon) || '°' as metric,
  ad as lat_d, cast(floor(ar) as int) as lat_m, round((ar - floor(ar)) * 60, 4) as lat_s, case when lat >= 0 then 'N' else 'S' end || case when lon >= 0 then 'E' else 'W' end as sides,
  printf('%.1f', round(abs(lat) * 64) / 64 * 8) || 'm' as metres from d""",
)
def s7(spark, sf):
    lat, lon = F.col("lat"), F.col("lon")
    imperial = labels.format_coord(lat, lon, imperial=True)
    dms = labels.to_dms(lat)
    return derived(spark, sf, "locations").select(
        "loc_id",
        labels.format_coord(lat, lon).alias("metric"),
        dms["degrees"].alias("lat_d"),
        dms["minutes"].alias("lat_m"),
        F.round(dms["seconds"], 4).alias("lat_s"),
        F.regexp_replace(imperial, "[^NSEW]", "").alias("sides"),
        labels.format_distance(F.round(F.abs(lat) * 64) / 64 * 8).alias("metres"),
    )


@query(
    "s8_render_filename",
    """select p_partkey as id, 'hill_layer_' || case when p_size < 10 then '0' else '' end || p_size || '_elev_' || cast(floor(p_retailprice + 0.5) as int) || 'm' as plain,
'hill-' || case when p_size < 10 then '0' else '' end || p_size || '@' || cast(floor(p_retailprice + 0.5) as int) || '%{q}' as custom, 'layer_' || case when p_size < 10 then '0' else '' end || p_size || '_elev_' || cast(floor(p_retailprice + 0.5) as int) as layer_id from part""",
)
def s8(spark, sf):
    size, price, base = F.col("p_size"), F.col("p_retailprice"), F.lit("hill")
    return spark.read.parquet(f"{sf}/part.parquet").select(
        F.col("p_partkey").alias("id"),
        labels.render_filename(base, size, price).alias("plain"),
        labels.render_filename(base, size, price, F.lit("%{b}-%{l}@%{e}%{q}")).alias("custom"),
        labels.layer_id(size, price).alias("layer_id"),
    )


@query(
    "s9_urls",
    oracle("locations")
    + """select loc_id, 'https://nominatim.openstreetmap.org/search?q=peak+%23' || loc_id || '+%C3%A9~%2A&format=json&limit=1&bounded=1&polygon_text=1&accept-language=en' as search,
'https://nominatim.openstreetmap.org/reverse?lat=' || printf('%.8f', lat) || '&lon=' || printf('%.8f', lon) || '&format=json&accept-language=en' as reverse from locations""",
)
def s9(spark, sf):
    text = F.concat(F.lit("peak #"), F.col("loc_id"), F.lit(" é~*"))
    return derived(spark, sf, "locations").select(
        "loc_id", tiles.search_url(text).alias("search"), tiles.reverse_url(F.col("lat"), F.col("lon")).alias("reverse")
    )


BED_SQL = """, j as (select *, coalesce(bed_size_mm, case when bed_x_mm is not null and bed_y_mm is not null then least(bed_x_mm, bed_y_mm) end, substrate_size_mm) bed,
  substrate_depth_mm is not null dep, z_extent is not null zk from jobs),
m as (select *, case when method_2d = 'AUTO' then case when explicit_2d is not null then 'EXPLICIT' when zk and dep then 'LAYERS' when zk then 'MATERIAL_THICKNESS' else 'BED_SIZE' end
   when method_2d = 'EXPLICIT' then 'EXPLICIT' when method_2d = 'MATERIAL_THICKNESS' and zk then 'MATERIAL_THICKNESS'
   when method_2d = 'LAYERS' and zk then case when dep then 'LAYERS' else 'MATERIAL_THICKNESS' end else 'BED_SIZE' end m2,
  case when method_3d = 'AUTO' then case when explicit_3d is not null then 'EXPLICIT' when dep then 'PRINT_HEIGHT' else 'BED_SIZE' end
   when method_3d = 'EXPLICIT' then 'EXPLICIT' when method_3d in ('PRINT_HEIGHT', 'UNIFORM_XYZ', 'LAYERS') and dep then 'PRINT_HEIGHT' else 'BED_SIZE' end m3 from j),
s as (select *, case m2 when 'EXPLICIT' then explicit_2d when 'LAYERS' then substrate_depth_mm / z_extent when 'MATERIAL_THICKNESS' then num_layers * layer_thickness_mm / z_extent else bed * 0.9 / xy_extent end s2,
  case m3 when 'EXPLICIT' then explicit_3d when 'PRINT_HEIGHT' then substrate_depth_mm / z_extent else bed * 0.9 / xy_extent end s3 from m)"""


@query(
    "g1_scale_2d",
    oracle("jobs") + BED_SQL
    + " select job_id, case when use_3d_for_2d then m3 else m2 end as method, round(case when use_3d_for_2d then s3 else s2 end, 6) as mm_per_m from s",
)
def g1(spark, sf):
    return rounded(scale.scale_2d(derived(spark, sf, "jobs")), "mm_per_m").select("job_id", "method", "mm_per_m")


@query(
    "g2_scale_3d",
    oracle("jobs") + BED_SQL
    + " select job_id, case when use_2d_for_3d then m2 else m3 end as method, round(case when use_2d_for_3d then s2 else s3 end, 6) as mm_per_m from s",
)
def g2(spark, sf):
    return rounded(scale.scale_3d(derived(spark, sf, "jobs")), "mm_per_m").select("job_id", "method", "mm_per_m")


@query(
    "g3_bed_fit",
    oracle("jobs") + BED_SQL
    + """ select job_id, bed as bed_mm, round(xy_extent * case when use_2d_for_3d then s2 else s3 end, 6) as printed_mm, xy_extent * case when use_2d_for_3d then s2 else s3 end <= bed as fits from s""",
)
def g3(spark, sf):
    fitted = scale.bed_fit(scale.scale_3d(derived(spark, sf, "jobs")))
    return rounded(fitted, "printed_mm").select("job_id", "bed_mm", "printed_mm", "fits")


@query(
    "g4_validate_jobs",
    oracle("jobs")
    + """select job_id, num_layers * layer_thickness_mm as total_mm, cast(trunc(substrate_depth_mm / layer_thickness_mm) as int) as suggested_layers,
round(substrate_depth_mm / num_layers, 6) as suggested_thickness_mm, num_layers * layer_thickness_mm as suggested_depth_mm from jobs where num_layers * layer_thickness_mm > substrate_depth_mm + 0.01""",
)
def g4(spark, sf):
    found = rounded(scale.validate_jobs(derived(spark, sf, "jobs")), "suggested_thickness_mm")
    return found.select("job_id", "total_mm", "suggested_layers", "suggested_thickness_mm", "suggested_depth_mm")


@query(
    "j1_parse_geocoder",
    oracle("places_text")
    + """, good as (select id, c_name, c_mktsegment from places_text join customer on c_custkey = id where id % 20 < 18)
select id, 0 as position, c_name as name, id % 90 + 0.5::double as lat, -(id % 180 + 0.25::double) as lon, 1.5::double as min_lat, 2.5::double as max_lat, 3.5::double as min_lon, 4.5::double as max_lon,
  'node' as osm_type, 'place' as class, lower(c_mktsegment) as type, 0.5::double as importance from good
union all select id, 1, 'second', 10.0, 20.0, null, null, null, null, '', '', '', 0.0 from good""",
)
def j1(spark, sf):
    return places.parse_geocoder(derived(spark, sf, "places_text"))


POI_SQL = """, pois as (select id, case id % 4 when 2 then 'R7' else c_name end as name, case id % 6 when 0 then 'peak' when 1 then 'city' when 2 then 'city' when 3 then 'village' when 4 then 'water' else 'other' end as kind,
id % 90 + 0.5::double as lat, -(id % 180 + 0.25::double) as lon from poi_text join customer on c_custkey = id where id % 20 < 19 and id % 4 <> 3
union all select id, 'fixed', 'peak', 1.5, 2.5 from poi_text where id % 20 < 19)"""


@query("j2_parse_pois", oracle("poi_text") + POI_SQL + " select * from pois")
def j2(spark, sf):
    return places.parse_pois(derived(spark, sf, "poi_text"))


@query(
    "j3_poi_visibility",
    oracle("poi_text") + POI_SQL
    + """, z as (select *, cast(i as int) zoom, least(greatest(case kind when 'city' then 12.0 when 'other' then 8.0 else 9.0 end * (log2(150000.0 / (40075000.0 / (256.0 * pow(2, i)))) / 2 + 1), 2.0), 18.0) label_size
  from pois, range(4, 16) t(i))
select id, name, kind, zoom, round(label_size, 6) as label_size, zoom >= case kind when 'peak' then 12 when 'city' then 8 when 'village' then 11 when 'water' then 10 else 13 end and label_size >= 2 as visible from z""",
)
def j3(spark, sf):
    shown = places.poi_visibility(places.parse_pois(derived(spark, sf, "poi_text")), range(4, 16))
    return rounded(shown, "label_size").drop("lat", "lon")


@query(
    "j4_cache_stats",
    oracle("cache_log")
    + """select count(*) as requests, count(*) filter (hit) as hits, count(*) filter (not hit) as misses, count(ms) filter (not hit) as downloads,
round(count(*) filter (hit) / count(*)::double, 6) as hit_rate, round(sum(ms) filter (not hit) / count(ms) filter (not hit), 6) as mean_download_ms from cache_log""",
)
def j4(spark, sf):
    return rounded(logs.cache_stats(derived(spark, sf, "cache_log")), "hit_rate", "mean_download_ms")


@query(
    "j5_expired",
    oracle("cache_entries")
    + """select cache_key, md5(cache_key) as key, substr(md5(cache_key), 1, 2) || '/' || md5(cache_key) || '.tile' as path from cache_entries
where (select max(cache_time) from cache_entries) + interval 12 hours > cache_time + interval 24 hours or not present""",
)
def j5(spark, sf):
    entries = derived(spark, sf, "cache_entries")
    latest = entries.agg(F.max("cache_time").alias("_latest"))
    timed = entries.join(F.broadcast(latest), F.lit(True))
    gone = logs.expired(timed, F.col("_latest") + F.expr("interval 12 hours"))
    return gone.select("cache_key", logs.cache_key(F.col("cache_key")).alias("key"), logs.cache_path(F.col("cache_key")).alias("path"))


@query(
    "j6_eviction_plan",
    oracle("cache_entries")
    + """, r as (select *, coalesce(sum(bytes) over (order by cache_time, cache_key rows between unbounded preceding and 1 preceding), 0) freed from cache_entries)
select cache_key, bytes, cast(freed as bigint) as freed_before from r where (select sum(bytes) from cache_entries) - freed > 600000""",
)
def j6(spark, sf):
    plan = logs.eviction_plan(derived(spark, sf, "cache_entries"), 600_000)
    return plan.select("cache_key", "bytes", "freed_before")


@query(
    "j7_run_summary",
    oracle("run_files", "run_stages")
    + """, f as (select run_id, count(*) filter (ok) files_ok, count(*) files_total, coalesce(sum(bytes) filter (ok), 0) bytes from run_files group by run_id),
s as (select run_id, count(*) filter (completed) stages_complete, count(*) stages_total, coalesce(sum(took_ms) filter (completed), 0) stage_ms,
  (max_by(struct_pack(c := completed, st := stage), struct_pack(a := start_time, b := stage))) last from run_stages group by run_id)
select run_id, coalesce(files_ok, 0) as files_ok, coalesce(files_total, 0) as files_total, cast(coalesce(bytes, 0) as bigint) as bytes, coalesce(stages_complete, 0) as stages_complete,
  coalesce(stages_total, 0) as stages_total, cast(coalesce(stage_ms, 0) as bigint) as stage_ms, case when not last.c then last.st end as current_stage from f full join s using (run_id)""",
)
def j7(spark, sf):
    stages = derived(spark, sf, "run_stages").withColumn(
        "end_time", F.col("start_time") + F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), F.col("took_ms") / 1000)
    )
    return logs.run_summary(derived(spark, sf, "run_files"), stages)
