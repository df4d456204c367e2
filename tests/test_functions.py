"""Column functions on hand-picked and random values."""

import random

from pyspark.sql import functions as F

from isoterra.functions import angles, color, labels, numbers, tiles, units
from isoterra.operators.levels import parse_layer_list


def values(spark, column, schema="v string", items=()):
    rows = spark.createDataFrame([(i,) for i in items], schema)
    return [r[0] for r in rows.select(column).collect()]


def test_fixed_rounds_exact_values(spark):
    rng = random.Random(1)
    items = [0.25, 0.15, 0.35, 1.005, 2.5, -0.00001, 123456.5, 0.0, 99.99996, 1e15] + [rng.uniform(-1000, 1000) for _ in range(500)]
    items += [rng.randint(-(10**6), 10**6) / 64 for _ in range(500)]
    rows = spark.createDataFrame([(i,) for i in items], "v double")
    for digits in (0, 1, 4, 8):
        got = rows.select("v", numbers.fixed(F.col("v"), digits).alias("t")).collect()
        assert all(r.t == f"{r.v:.{digits}f}" for r in got)
    staged = numbers.with_text(rows, ["v"], 3).collect()
    assert all(r.v_text == f"{r.v:.3f}" for r in staged if abs(r.v) < 1e12)
    short = numbers.with_text(rows, ["v"]).collect()
    assert all(r.v_text == f"{r.v:.6g}" for r in short if 0.01 < abs(r.v) < 999999)


def test_parse_distance(spark):
    items = ["150ft", " 2.5 KM ", '10"', "7", "-3 m", "1.2.3m", "abc", "", "5 px", "5 parsec", "+4 Meters"]
    got = values(spark, units.parse_distance(F.col("v"), "mm", "m"), items=items)
    assert [(None if g.value is None else round(g.value, 6), g.unit, g.error) for g in got] == [
        (45.72, "ft", None), (2500.0, "km", None), (0.254, "in", None), (0.007, "mm", None), (-3.0, "m", None),
        (None, None, "unknown unit"), (None, None, "no number"), (None, None, "empty"), (None, None, "unit has no length"),
        (None, None, "unknown unit"), (4.0, "m", None),
    ]


def test_angles(spark):
    items = ["63d07m29sN", "63°07'29\"N", "151d11m05sW", "-12.5", " 45 ", "91", "10d60m", "N63", "5x", "12d30", "-0d30", "180.0", "1e1"]
    lat = values(spark, angles.parse_latitude(F.col("v")), items=items)
    lon = values(spark, angles.parse_longitude(F.col("v")), items=items)
    north = 63 + 7 / 60 + 29 / 3600
    assert [None if v is None else round(v, 9) for v in lat] == [
        round(north, 9), round(north, 9), None, -12.5, 45.0, None, None, None, None, 12.5, 0.5, None, 10.0,
    ]
    assert round(lon[2], 9) == -round(151 + 11 / 60 + 5 / 3600, 9) and lon[11] == 180.0


def test_pairs(spark):
    strict = values(spark, angles.parse_pair(F.col("v")), items=["63.1, -151.2", "63d07m29sN,151d11m05sW", "63.1", "1,2,3", "95,0"])
    assert [None if p is None else (round(p.lat, 3), round(p.lon, 3)) for p in strict] == [
        (63.1, -151.2), (63.125, -151.185), None, None, None,
    ]
    lenient = values(spark, angles.parse_pair(F.col("v"), True), items=["63.069°N, 151.007°W", "N63.069, W151.007", "1,2,3", "S5,E7"])
    assert [None if p is None else tuple(p) for p in lenient] == [None, (63.069, -151.007), None, (-5.0, 7.0)]


def test_label_escapes_and_unknown_names(spark):
    text = labels.fill(F.col("v"), {"a": F.lit("%{b}"), "b": F.lit("2"), "n": F.lit(None).cast("string")})
    assert values(spark, text, items=["%{a}-%{b}", "%%{a}", "%{zz} %{n}", "50%"]) == ["%{b}-2", "%{{a}", "%{zz} %{n}", "50%"]


def test_coordinates_as_text(spark):
    both = labels.format_coord(F.lit(63.0691), F.lit(-151.0063), True)
    assert values(spark, both, items=["x"]) == ["63°4'8.8\"N, 151°0'22.7\"W"]
    assert values(spark, labels.format_distance(F.lit(100.0), "ft"), items=["x"]) == ["328.1ft"]


def test_layer_lists(spark):
    items = ["3,4,5-7,11", " 2 , 2,1-3", "x,-3,9-7,4y,", "7-", ""]
    assert values(spark, parse_layer_list(F.col("v")), items=items) == [[3, 4, 5, 6, 7, 11], [1, 2, 3], [4], [], []]


def test_tiles(spark):
    rows = spark.createDataFrame([(63.1, -151.2), (-0.5, 0.5), (0.0, 179.9), (-90.0, -180.0)], "lat double, lon double")
    assert [r[0] for r in rows.select(tiles.tile_name(F.col("lat"), F.col("lon"))).collect()] == [
        "N63W152.hgt.gz", "S01E000.hgt.gz", "N00E179.hgt.gz", "S90W180.hgt.gz",
    ]
    tile = rows.select("lat", "lon", tiles.slippy_tile(F.col("lat"), F.col("lon"), 9).alias("t"))
    corner = tile.select("lat", "lon", tiles.slippy_corner(9, F.col("t.x"), F.col("t.y")).alias("c"), "t").collect()
    for r in corner[:3]:
        assert r.c.lon <= r.lon < r.c.lon + 360 / 512 and r.c.lat >= r.lat
    assert (corner[3].t.x, corner[3].t.y) == (0, 511)


def test_colors(spark):
    assert [tuple(c) for c in values(spark, color.parse_hex(F.col("v")), items=["#0a10FF", "00ff00", "#12", "#gggggg", ""])] == [
        (10, 16, 255), (0, 255, 0), (255, 0, 0), (255, 0, 0), (255, 0, 0),
    ]
    flat = color.color_rgb(F.col("v"), F.lit(5.0), F.lit(5.0), "terrain")
    assert [tuple(c) for c in values(spark, flat, "v double", [5.0])] == [(255, 255, 255)]
    custom = color.color_rgb(F.col("v"), F.lit(0.0), F.lit(1.0), [(0.8, 0.0, 0.0, 1.0), (0.2, 1.0, 0.0, 0.0)])
    assert [tuple(c) for c in values(spark, custom, "v double", [0.0, 0.5, 1.0])] == [(255, 0, 0), (127, 0, 127), (0, 0, 255)]
