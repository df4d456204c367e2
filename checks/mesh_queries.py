"""Queries for heightmaps and meshes."""

from __future__ import annotations

from pyspark.sql import functions as F

from checks.fixtures import clean, derived, grids, oracle, query, rounded, soup
from isoterra.functions.color import SCHEMES
from isoterra.operators import heightmap, mesh, style

SURFACE_SQL = """kept as (select *, least(z00, z10, z01, z11) lo, greatest(z00, z10, z01, z11) hi from pairs),
tri as (select grid_id mesh_id, (r * 50 + c) * 2 tid, r * 50 + c v0, r * 50 + c + 1 v1, (r + 1) * 50 + c v2 from kept where {keep}
union all select grid_id, (r * 50 + c) * 2 + 1, r * 50 + c + 1, (r + 1) * 50 + c + 1, (r + 1) * 50 + c from kept where {keep}),
corner as (select grid_id mesh_id, r, c, z00 z from kept where {keep} union select grid_id, r, c + 1, z10 from kept where {keep}
union select grid_id, r + 1, c, z01 from kept where {keep} union select grid_id, r + 1, c + 1, z11 from kept where {keep}),
vert as (select mesh_id, r * 50 + c vid, -151.0 + c * 0.01 x, 63.0 - r * 0.01 y, {z} z from corner)"""
WINDOWED = SURFACE_SQL.format(keep="hi >= 400 and lo <= 1200", z="least(greatest(z, 400.0), 1200.0) * 2.0")
PLAIN = SURFACE_SQL.format(keep="true", z="z")
TRIANGLE_SQL = " select mesh_id, cast(tid as bigint) as tid, cast(v0 as bigint) as v0, cast(v1 as bigint) as v1, cast(v2 as bigint) as v2 from "


def facet_sql(quads: str, x0: str, dx: str, y0: str, dy: str, bed: float = 200.0) -> str:
    """CTEs `corner3` and `facet` (tid, value): the STL text of two triangles per quad (r, c, z00, z10, z01, z11), fitted to a bed."""

    def at(corner: str, k: int) -> str:
        row, col = ("r + 1" if corner in "cd" else "r"), ("c + 1" if corner in "bd" else "c")
        z = {"a": "z00", "b": "z10", "c": "z01", "d": "z11"}[corner]
        return f"({x0}) + ({col}) * ({dx}) x{k}, ({y0}) + ({row}) * ({dy}) y{k}, {z} z{k}"

    def triangle(n: int, corners: str) -> str:
        return f"select r, c, {n} n, {', '.join(at(p, k) for k, p in enumerate(corners))} from {quads}"

    def text(*values: str) -> str:
        return " || ' ' || ".join(f"format('{{:.6f}}', {v} + 0.0)" for v in values)

    spans = ", ".join(f"min({c}) lo_{c}, max({c}) hi_{c}" for c in "xyz")
    points = " union all ".join(f"select x{k} x, y{k} y, z{k} z from corner3" for k in range(3))
    cross = [("y", "z"), ("z", "x"), ("x", "y")]
    normal = ", ".join(
        f"({a}1 - {a}0) * ({b}2 - {b}0) - ({b}1 - {b}0) * ({a}2 - {a}0) n{c}" for c, (a, b) in zip("xyz", cross)
    )
    vertices = " || chr(10) || ".join(
        "'      vertex ' || " + text(*[f"({c}{k} - (lo_{c} + hi_{c}) / 2.0) * scale" for c in "xyz"]) for k in range(3)
    )
    return f""", corner3 as ({triangle(0, "abc")} union all {triangle(1, "bdc")}),
extent as (select {spans} from ({points}) t),
sized as (select *, {bed * 0.9} / greatest(hi_x - lo_x, hi_y - lo_y) scale from extent),
crossed as (select *, {normal} from corner3, sized),
facet as (select r, c, n, '  facet normal ' || {text(*[f"n{c} / sqrt(nx * nx + ny * ny + nz * nz)" for c in "xyz"])} || chr(10) || '    outer loop' || chr(10)
  || {vertices} || chr(10) || '    endloop' || chr(10) || '  endfacet' as value from crossed)"""


def surface(spark, sf):
    return heightmap.heightmap_triangles(clean(spark, sf), grids(spark, sf), "terrain", 400.0, 1200.0, vscale=2.0)


def plain_surface(spark, sf):
    return heightmap.heightmap_triangles(clean(spark, sf), grids(spark, sf))


@query("f1_heightmap_triangles", oracle("pairs") + ", " + WINDOWED + TRIANGLE_SQL + "tri")
def f1(spark, sf):
    return surface(spark, sf).triangles


@query(
    "f1_heightmap_vertices",
    oracle("pairs") + ", " + WINDOWED
    + " select mesh_id, cast(vid as bigint) as vid, round(cast(x as double), 6) as x, round(cast(y as double), 6) as y, round(z, 6) as z from vert",
)
def f1_vertices(spark, sf):
    return rounded(surface(spark, sf).vertices, "x", "y", "z")


@query(
    "f1_heightmap_flat",
    oracle("pairs")
    + """select grid_id as mesh_id, cast((r * 50 + c) * 4 + k as bigint) as vid, round(cast(-151.0 + (c + k % 2) * 0.01 as double), 6) as x,
round(cast(63.0 - (r + k // 2) * 0.01 as double), 6) as y, greatest(z00, z10, z01, z11) as z from pairs, range(0, 4) t(k) where greatest(z00, z10, z01, z11) >= 600""",
)
def f1_flat(spark, sf):
    made = heightmap.heightmap_triangles(clean(spark, sf), grids(spark, sf), "flat", min_elev=600.0)
    return rounded(made.vertices, "x", "y")


@query(
    "f2_heightmap_layers",
    oracle("pairs", "span")
    + """, slab as (select grid_id, i, min_elev + i * ((max_elev - min_elev) / 4) lo_, min_elev + (i + 1) * ((max_elev - min_elev) / 4) hi_ from span, range(0, 4) t(i))
select p.grid_id || '#' || i as mesh_id, cast(count(*) * 2 as bigint) as triangles from pairs p join slab s using (grid_id)
where greatest(z00, z10, z01, z11) >= lo_ and least(z00, z10, z01, z11) <= hi_ group by p.grid_id, i""",
)
def f2(spark, sf):
    made = heightmap.heightmap_layers(clean(spark, sf), grids(spark, sf), 4)
    return made.triangles.groupBy("mesh_id").agg(F.count(F.lit(1)).alias("triangles"))


@query(
    "f3_base_platform",
    oracle("grids")
    + """, cell as (select grid_id, width * height n, r, c, (r * 50 + c) a from grids, range(0, 100000) t(r), range(0, 49) u(c) where r < height - 1)
select grid_id as mesh_id, cast(n * 2 + a * 2 as bigint) as tid, cast(n + a as bigint) as v0, cast(n + a + 50 as bigint) as v1, cast(n + a + 1 as bigint) as v2 from cell
union all select grid_id, n * 2 + a * 2 + 1, n + a + 1, n + a + 50, n + a + 51 from cell""",
)
def f3(spark, sf):
    return heightmap.base_platform(grids(spark, sf), -10.0).triangles


@query(
    "f4_side_walls",
    oracle("clean", "grids")
    + """, border as (
select 0 side, grid_row pos, grid_row, grid_col, elev from clean where grid_col = 0
union all select 1, grid_row, grid_row, grid_col, elev from clean where grid_col = 49
union all select 2, grid_col, grid_row, grid_col, elev from clean where grid_row = 0
union all select 3, grid_col, grid_row, grid_col, elev from clean where grid_row = (select height - 1 from grids)),
pair as (select a.side, a.pos, a.grid_row * 50 + a.grid_col t0, b.grid_row * 50 + b.grid_col t1, (select width * height from grids) n,
  (select greatest(width, height) from grids) m from border a join border b on a.side = b.side and b.pos = a.pos + 1
  where a.elev is not null and b.elev is not null)
select 'g0' as mesh_id, cast(n * 4 + (side * m + pos) * 2 as bigint) as tid, cast(t0 as bigint) as v0,
  cast(case when side in (0, 3) then n + t0 else t1 end as bigint) as v1, cast(case when side in (0, 3) then t1 else n + t0 end as bigint) as v2 from pair
union all select 'g0', n * 4 + (side * m + pos) * 2 + 1, n + t0, case when side in (0, 3) then n + t1 else t1 end, case when side in (0, 3) then t1 else n + t1 end from pair""",
)
def f4(spark, sf):
    return heightmap.side_walls(clean(spark, sf), grids(spark, sf), -10.0).triangles


@query(
    "f5_triangulation_stats",
    oracle("pairs", "grids", "span")
    + """, border as (
select 0 side, grid_row pos, elev from clean where grid_col = 0 union all select 1, grid_row, elev from clean where grid_col = 49
union all select 2, grid_col, elev from clean where grid_row = 0 union all select 3, grid_col, elev from clean where grid_row = (select height - 1 from grids))
select g.grid_id, cast((select count(*) from pairs) * 2 as bigint) as surface_triangles, cast(2 * 49 * (height - 1) as bigint) as base_triangles,
cast(2 * (select count(*) from border a join border b on a.side = b.side and b.pos = a.pos + 1 where a.elev is not null and b.elev is not null) as bigint) as wall_triangles,
cast(49 * (height - 1) - (select count(*) from pairs) as bigint) as skipped_voids, min_elev, max_elev, width, height from grids g join span using (grid_id)""",
)
def f5(spark, sf):
    return heightmap.triangulation_stats(clean(spark, sf), grids(spark, sf))


@query(
    "f7_dedup_vertices",
    oracle("soup_vertices", "soup_triangles")
    + """, firsts as (select *, min(vid) over (partition by mesh_id, round(x / 1e-6), round(y / 1e-6), round(z / 1e-6)) f from soup_vertices)
select t.mesh_id, t.tid, a.f as v0, b.f as v1, c.f as v2 from soup_triangles t
left join firsts a on a.mesh_id = t.mesh_id and a.vid = t.v0 left join firsts b on b.mesh_id = t.mesh_id and b.vid = t.v1
left join firsts c on c.mesh_id = t.mesh_id and c.vid = t.v2""",
)
def f7(spark, sf):
    return mesh.dedup_vertices(soup(spark, sf)).triangles


@query(
    "f7_kept_vertices",
    oracle("soup_vertices") + "select mesh_id, min(vid) as vid, x, y, z from soup_vertices group by mesh_id, x, y, z",
)
def f7_vertices(spark, sf):
    return mesh.dedup_vertices(soup(spark, sf)).vertices.select("mesh_id", "vid", "x", "y", "z")


@query("f8_valid_triangles", oracle("faces") + "select mesh_id, tid, v0, v1, v2 from faces where valid")
def f8(spark, sf):
    return mesh.valid_triangles(soup(spark, sf))


@query(
    "f9_triangle_geometry",
    oracle("geometry")
    + """select mesh_id, tid, round(case when valid then case when len > 0 then cx / len else 0.0 end else 0.0 end, 6) as nx,
round(case when valid then case when len > 0 then cy / len else 0.0 end else 0.0 end, 6) as ny,
round(case when valid then case when len > 0 then cz / len else 0.0 end else 1.0 end, 6) as nz, round(area, 6) as area from geometry""",
)
def f9(spark, sf):
    found = mesh.triangle_geometry(soup(spark, sf))
    # Adding zero turns a negative zero into zero.
    return found.select("mesh_id", "tid", *[(F.round(c, 6) + 0.0).alias(c) for c in ("nx", "ny", "nz", "area")])


@query(
    "f10_mesh_edges",
    oracle("edges")
    + """select mesh_id, lo, hi, count(*) as triangles, min(tid) as first_tid, max(tid) as last_tid, count(*) = 1 as boundary, count(*) <= 2 as manifold
from edges group by mesh_id, lo, hi""",
)
def f10(spark, sf):
    return mesh.mesh_edges(soup(spark, sf))


REPORT_SQL = """, e as (select mesh_id, count(*) edges, count(*) filter (n = 1) b, count(*) filter (n > 2) x from (select mesh_id, count(*) n from edges group by mesh_id, lo, hi) t group by mesh_id),
f as (select mesh_id, count(*) triangles, count(*) filter (area < 1e-12 or not valid) d from geometry group by mesh_id)
select mesh_id, triangles, edges, b as boundary_edges, x as excess_edges, d as degenerate, x = 0 as manifold, x = 0 and b = 0 as watertight, x = 0 and b = 0 and d = 0 as valid
from e join f using (mesh_id)"""


@query("f11_validate_mesh", oracle("edges", "geometry") + REPORT_SQL)
def f11(spark, sf):
    return mesh.validate_mesh(soup(spark, sf))


@query("f12_repair_mesh", oracle("geometry") + "select mesh_id, tid, v0, v1, v2 from geometry where area >= 1e-12")
def f12(spark, sf):
    return mesh.repair_mesh(soup(spark, sf)).triangles


@query(
    "f13_mesh_extents",
    oracle("soup_vertices")
    + """select mesh_id, min(x) as min_x, min(y) as min_y, min(z) as min_z, max(x) as max_x, max(y) as max_y, max(z) as max_z,
greatest(max(x) - min(x), max(y) - min(y)) as xy_extent, max(z) - min(z) as z_extent from soup_vertices group by mesh_id""",
)
def f13(spark, sf):
    return mesh.mesh_extents(soup(spark, sf))


STACK_SQL = """, vs as (select mesh_id, coalesce(sum(s) over (order by mesh_id rows between unbounded preceding and 1 preceding), 0) o from (select mesh_id, max(vid) + 1 s from soup_vertices group by mesh_id) a),
ts as (select mesh_id, coalesce(sum(s) over (order by mesh_id rows between unbounded preceding and 1 preceding), 0) o from (select mesh_id, max(tid) + 1 s from soup_triangles group by mesh_id) a)"""


@query(
    "f14_stack_meshes",
    oracle("soup_vertices", "soup_triangles") + STACK_SQL
    + """ select 'stacked' as mesh_id, cast(t.tid + ts.o as bigint) as tid, cast(v0 + vs.o as bigint) as v0, cast(v1 + vs.o as bigint) as v1, cast(v2 + vs.o as bigint) as v2
from soup_triangles t join vs using (mesh_id) join ts using (mesh_id)""",
)
def f14(spark, sf):
    return mesh.stack_meshes(soup(spark, sf)).triangles


BAND_SQL = """, s as (select mesh_id, tid, least(z0, z1, z2) lo, greatest(z0, z1, z2) hi from corners),
m as (select mesh_id, min(lo) mn, max(hi) mx, ceil((max(hi) - min(lo)) / 2.0) + 1 n from s group by mesh_id),
ix as (select s.mesh_id, cast(b as int) band, mn + b * 2.0 band_min, mn + (b + 1) * 2.0 band_max, tid from s join m using (mesh_id), range(0, 1000) t(b)
where b between floor((lo - mn) / 2.0) and floor(least(n - 1, (hi - mn) / 2.0)))"""


@query("f15_band_index", oracle("corners") + BAND_SQL + " select mesh_id, band, band_min, band_max, tid from ix")
def f15(spark, sf):
    return mesh.band_index(soup(spark, sf), 2.0)


@query(
    "f15_near_elevation",
    oracle("corners") + BAND_SQL + " select distinct mesh_id, tid from ix where band_min <= 3.5 and band_max > 2.5",
)
def f15_near(spark, sf):
    return mesh.near_elevation(mesh.band_index(soup(spark, sf), 2.0), 3.0, 0.5)


@query(
    "f16_print_transform",
    oracle("soup_vertices")
    + """, b as (select mesh_id, 200.0 * 0.9 / greatest(max(x) - min(x), max(y) - min(y)) f, (min(x) + max(x)) / 2 cx, (min(y) + max(y)) / 2 cy, (min(z) + max(z)) / 2 cz from soup_vertices group by mesh_id)
select mesh_id, vid, round((x - cx) * f, 6) as x, round((y - cy) * f, 6) as y, round((z - cz) * f, 6) as z from soup_vertices join b using (mesh_id)""",
)
def f16(spark, sf):
    return rounded(mesh.print_transform(soup(spark, sf), bed_mm=200.0).vertices, "x", "y", "z")


MEAN_SQL = """, box as (select mesh_id, min(z) lo, max(z) hi from vert group by mesh_id),
mean as (select t.mesh_id, t.tid, (a.z + b.z + c.z) / 3.0 m from tri t join vert a on a.mesh_id = t.mesh_id and a.vid = t.v0
join vert b on b.mesh_id = t.mesh_id and b.vid = t.v1 join vert c on c.mesh_id = t.mesh_id and c.vid = t.v2)"""


@query(
    "e3_triangle_band",
    oracle("pairs") + ", " + PLAIN + MEAN_SQL
    + """ select mesh_id, cast(tid as bigint) as tid, round(m, 6) as mean_z, cast(trunc(least(greatest((m - lo) / (hi - lo), 0.0), 1.0) * 9) as int) as band from mean join box using (mesh_id)""",
)
def e3(spark, sf):
    return rounded(style.triangle_band(plain_surface(spark, sf), 10), "mean_z")


@query(
    "e4_vertex_ramp",
    oracle("pairs") + ", " + PLAIN
    + """ select mesh_id, cast(vid as bigint) as vid, cast(trunc(255 * (z - lo) / (hi - lo)) as int) as r, cast(255 - trunc(255 * (z - lo) / (hi - lo)) as int) as g, 0 as b
from vert join (select min(z) lo, max(z) hi from vert) box on true""",
)
def e4(spark, sf):
    return style.vertex_ramp(plain_surface(spark, sf)).select("mesh_id", "vid", "r", "g", "b")


def color_sql(at: str, channel: int, scheme: str = "terrain") -> str:
    """Unit channel of a colour scheme in single precision, for the oracle."""
    stops = SCHEMES[scheme]
    chain = " ".join(
        f"when {at} between {a[0]} and {b[0]} then cast(cast({a[channel]}::float as double) * (1.0 - ({at} - {a[0]}) / ({b[0]} - {a[0]})) "
        f"+ cast({b[channel]}::float as double) * (({at} - {a[0]}) / ({b[0]} - {a[0]})) as float)"
        for a, b in zip(stops, stops[1:])
    )
    return f"case {chain} else {stops[-1][channel]}::float end"


__all__ = ["color_sql", "derived"]
