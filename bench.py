"""Time the headline queries: prints one JSON line.

BENCH_SF_DIR names the table folder (default /root/testdata/sf0.1), BENCH_CPUS the local cores.
"""

from __future__ import annotations

import json
import os
import time
from pathlib import Path

from checks import fixtures, grid_queries, layer_queries  # noqa: F401
from checks.compare import session
from isoterra.operators.components import area_cells, label_layers
from isoterra.operators.grid import elevation_range, repair_outliers
from isoterra.operators.heightmap import heightmap_triangles
from isoterra.operators.levels import contour_levels, layer_cells, layer_counts
from isoterra.operators.mesh import validate_mesh
from isoterra.operators.rings import area_rings
from isoterra.plans.products import Job, contour_product, layered_solid, terrain_mesh
from isoterra.sinks.geojson import to_geojson
from isoterra.sinks.meshtext import stl_lines
from isoterra.spread import cut


_stored: dict[str, object] = {}


def load(spark, sf):
    """Store the large rough fixture grid once, as a scan of tiles would."""
    _stored["grid"] = cut(fixtures.big(spark, sf))
    return _stored["grid"]


def big(spark, sf):
    """The stored grid with its geometry and levels."""
    grid, frame = _stored["grid"], fixtures.derived(spark, sf, "big_grids")
    levels = contour_levels(elevation_range(grid), 7)
    return grid, frame, levels


def big_members(spark, sf):
    grid, frame, levels = big(spark, sf)
    return layer_cells(grid, levels), frame


def big_counts(spark, sf):
    grid, _, levels = big(spark, sf)
    return layer_counts(grid, levels)


def big_areas(spark, sf):
    grid, frame, levels = big(spark, sf)
    return label_layers(grid, levels, frame), frame


def big_components(spark, sf):
    return area_cells(big_areas(spark, sf)[0])


def big_rings(spark, sf):
    return area_rings(*big_areas(spark, sf))


def big_surface(spark, sf):
    grid, frame, _ = big(spark, sf)
    return heightmap_triangles(grid, frame)


def big_geojson(spark, sf):
    product = contour_product(*big(spark, sf)[:2], Job(layers=3))
    return to_geojson(product.ring_points, product.layers, area=True)


HEADLINES = {
    "load_grid": load,
    "repair_outliers": lambda spark, sf: repair_outliers(big(spark, sf)[0]),
    "layer_counts": big_counts,
    "layer_cells": lambda spark, sf: big_members(spark, sf)[0],
    "components": big_components,
    "rings": big_rings,
    "heightmap_triangles": lambda spark, sf: big_surface(spark, sf).triangles,
    "validate_mesh": lambda spark, sf: validate_mesh(big_surface(spark, sf)),
    "sample_bilinear": fixtures.QUERIES["b9_sample_bilinear"],
    "rasterize": fixtures.QUERIES["d6_rasterize"],
    "polygon_metrics": fixtures.QUERIES["c7_polygon_metrics"],
    "contour_product": lambda spark, sf: contour_product(*big(spark, sf)[:2], Job(layers=7)).layers,
    "terrain_mesh": lambda spark, sf: terrain_mesh(*big(spark, sf)[:2]).extents,
    "stl_export": lambda spark, sf: stl_lines(big_surface(spark, sf), bed_mm=200.0),
    "geojson_export": big_geojson,
    "layered_solid": lambda spark, sf: layered_solid(*big(spark, sf)[:2], Job(layers=7)).report,
}


def main() -> None:
    sf = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    spark = session(os.environ.get("BENCH_CPUS", "8"))
    timings = {}
    for name, query in HEADLINES.items():
        start = time.perf_counter()
        query(spark, sf).write.format("noop").mode("overwrite").save()
        timings[name] = round(time.perf_counter() - start, 3)
    spark.stop()
    total = round(sum(timings.values()), 3)
    print(json.dumps({"metric": "headline_total", "value": total, "unit": "sec", "queries": timings, "sf": Path(sf).name}))


if __name__ == "__main__":
    main()
