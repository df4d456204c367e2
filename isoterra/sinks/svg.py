"""SVG drawings, one document per grid and layer."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from isoterra.functions.labels import layer_id
from isoterra.functions.numbers import with_text
from isoterra.operators.polygons import POLYGON, canvas, fit_canvas, polygon_bounds
from isoterra.operators.style import polygon_style
from isoterra.sinks.text import FIRST, LAST, ring_parts, write_lines
from isoterra.spread import attach

# Canvas, stroke widths, background.
WIDTH_MM, MARGIN_MM = 200.0, 10.0
CUT_STROKE_MM = 0.1
BACKGROUND = "white"
CUT_COLOR = "#ff0000"
ORDER = ["polygon_id", "ring_id", "part"]


def svg_paths(canvas_points: DataFrame, holes: bool = False) -> DataFrame:
    """Path text `M x y L ... Z` of every polygon in pieces; holes are appended on request."""
    points = canvas_points if holes else canvas_points.where("ring_id = 0")
    pair = F.concat(F.col("x_text"), F.lit(" "), F.col("y_text"))
    opening = F.when(F.col("ring_id") == 0, "M ").otherwise(" M ")
    return ring_parts(with_text(points, ["x", "y"]), pair, " L ", opening, F.lit(" Z"))


def _line(*parts: str | Column) -> Column:
    return F.concat(*[F.lit(p) if isinstance(p, str) else p for p in parts])


def svg_lines(
    ring_points: DataFrame,
    layers: DataFrame,
    width_mm: float = WIDTH_MM,
    margin_mm: float = MARGIN_MM,
    mode: str = "full_color",
    scheme: str | list[tuple] = "terrain",
    holes: bool = False,
    stroke: str = CUT_COLOR,
    stroke_mm: float = CUT_STROKE_MM,
) -> DataFrame:
    """Lines (grid_id, layer, polygon_id, ring_id, part, value) of one drawing per layer.

    All layers of a grid share one canvas, so the sheets fit on each other. A path may run over
    several lines, which SVG allows.
    """
    bounds = polygon_bounds(ring_points, ["grid_id"])
    drawn = fit_canvas(ring_points, bounds, width_mm, margin_mm)
    paths = svg_paths(drawn, holes)
    styled = polygon_style(layers, mode, scheme).withColumn("_id", layer_id(F.col("layer_number"), F.col("elevation")))
    styled = with_text(styled, ["elevation"])
    size = with_text(canvas(bounds, width_mm, margin_mm).select("grid_id", "height_mm"), ["height_mm"])
    present = ring_points.where("ring_id = 0 and seq = 0").select(*POLYGON)
    look = styled.select("grid_id", "layer", "elevation_text", "fill", "fill_opacity", "_id")
    sheets = present.select("grid_id", "layer").distinct().join(look, ["grid_id", "layer"]).join(size, "grid_id")
    width, height = f"{width_mm:g}", F.col("height_mm_text")
    head = _line(
        f'<svg xmlns="http://www.w3.org/2000/svg" viewBox="0 0 {width} ', height, f'" width="{width}mm" height="', height,
        f'mm">\n<path d="M 0 0 H {width} V ', height, f' H 0 Z" fill="{BACKGROUND}"/>\n<g id="', F.col("_id"),
        f'" stroke="{stroke}" stroke-width="{stroke_mm:g}">\n<desc>', F.col("elevation_text"), " m</desc>",
    )

    def frame(at: int, value: Column) -> DataFrame:
        ids = [F.lit(at).cast("long").alias(c) for c in ORDER]
        return sheets.select("grid_id", "layer", *ids, value.alias("value"))

    polygons = attach(present, look, ["grid_id", "layer"], ["polygon_id"])
    opacity = F.when(F.col("fill") != "none", _line(' fill-opacity="', F.col("fill_opacity").cast("string"), '"'))
    tail = _line('" fill="', F.col("fill"), '"', F.coalesce(opacity, F.lit("")), "/>")

    def around(ring: int, value: Column) -> DataFrame:
        ids = [F.lit(ring).cast("long").alias("ring_id"), F.lit(0).cast("long").alias("part")]
        return polygons.select(*POLYGON, *ids, value.alias("value"))

    lines = paths
    for part in (
        around(FIRST, F.lit('<path d="')),
        around(LAST, tail),
        frame(FIRST, head),
        frame(LAST, F.lit("</g>\n</svg>")),
    ):
        lines = lines.unionByName(part.select(*lines.columns))
    return lines


def write_svg(ring_points: DataFrame, layers: DataFrame, path: str, **options) -> None:
    """Write one folder of part files per grid and layer."""
    write_lines(svg_lines(ring_points, layers, **options), path, ORDER, ["grid_id", "layer"])
