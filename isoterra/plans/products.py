"""End-to-end products: contour layers, terrain mesh, layered solid.

A plan only composes operators. Nothing runs but the lineage cuts of the iterative steps; the
returned frames are written with the sinks, or queried further.
"""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from isoterra.operators import components as areas
from isoterra.operators.grid import (
    clean_nonfinite,
    elevation_range,
    quality_report,
    repair_outliers,
)
from isoterra.operators.heightmap import base_platform, heightmap_layers, heightmap_triangles, join_parts, side_walls
from isoterra.operators.levels import contour_levels, drop_empty, layer_cells, layer_slabs, select_layers
from isoterra.operators.mesh import Mesh, mesh_extents, repair_mesh, settled, stack_meshes, validate_mesh
from isoterra.operators.polygons import complexity_gate, dedup_ring, layer_table, polygon_metrics
from isoterra.operators.raster import filled_cells
from isoterra.operators.rings import area_rings
from isoterra.operators.scale import scale_3d
from isoterra.operators.solid import extrude_layers
from isoterra.spread import attach, cut


@dataclass(frozen=True)
class Job:
    """What to make. Lengths in metres for terrain, millimetres for print.

    `near` drops ring points closer than that to the next one, in the units of the grid; `repair` drops
    triangles without area; with `gate` a grid with more than half of its cells invalid raises an error.
    """

    layers: int = 7
    interval: float | None = None
    strategy: str = "uniform"
    min_elev: float | None = None
    max_elev: float | None = None
    threshold: float = 0.0
    fixed: float | None = None
    remove_holes: bool = True
    inset_mm: float | None = None
    only_layers: str | None = None
    base_mm: float | None = None
    vscale: float = 1.0
    surface: str = "terrain"
    slabs: int | None = None
    laser_mm: float | None = None
    stacked: bool = False
    gate: bool = False
    near: float | None = None
    repair: bool = False


@dataclass(frozen=True)
class ContourProduct:
    quality: DataFrame
    levels: DataFrame
    layers: DataFrame
    cells: DataFrame
    ring_points: DataFrame
    gate: DataFrame


def _checked(grid: DataFrame, job: Job) -> tuple[DataFrame, DataFrame]:
    """The cleaned grid, written once, and its quality; with the gate a grid that is mostly invalid stops the job."""
    repaired = cut(repair_outliers(clean_nonfinite(grid)))
    quality = quality_report(grid, repaired)
    if job.gate:
        quality = cut(quality)
        refused = quality.where("not usable").orderBy("grid_id").limit(1).collect()
        if refused:
            raise ValueError(f"grid {refused[0]['grid_id']}: {refused[0]['invalid_pct']:g} % of the elevations are invalid")
    return repaired, quality


def contour_product(grid: DataFrame, grids: DataFrame, job: Job = Job()) -> ContourProduct:
    """Clean a grid, choose levels, slice it, outline the areas of every layer."""
    # Read by the range, the membership and the statistics: repaired once.
    repaired, quality = _checked(grid, job)
    levels = cut(
        contour_levels(
            elevation_range(repaired),
            None if job.interval else job.layers,
            job.interval,
            strategy=job.strategy,
            min_elev=job.min_elev,
            max_elev=job.max_elev,
            threshold=job.threshold,
            fixed=job.fixed,
        )
    )
    if job.inset_mm is None:
        labelled = areas.label_layers(repaired, levels, grids)
    else:
        labelled = areas.label_areas(areas.inset_layers(layer_cells(repaired, levels), grids, job.inset_mm), grids)
    labelled = cut(labelled)
    cells = areas.area_cells(labelled)
    points = cut(area_rings(labelled, grids, remove_holes=job.remove_holes))
    if job.near is not None:
        points = cut(dedup_ring(points, job.near))
    # A few rows from windows over all ring points; every sink reads them several times.
    layers = cut(drop_empty(layer_table(polygon_metrics(points), levels)))
    if job.only_layers:
        layers = select_layers(layers, job.only_layers)
        kept = layers.select("grid_id", "layer", F.lit(True).alias("_kept"))
        points = attach(points, kept, ["grid_id", "layer"], ["polygon_id", "seq"]).drop("_kept")
        cells = attach(cells, kept, ["grid_id", "layer"], ["grid_row", "grid_col"]).drop("_kept")
    return ContourProduct(quality, levels, layers, cells, points, complexity_gate(points))


@dataclass(frozen=True)
class MeshProduct:
    mesh: Mesh
    extents: DataFrame
    scaled_jobs: DataFrame | None


def _scaled(mesh: Mesh, jobs: DataFrame | None) -> MeshProduct:
    extents = mesh_extents(mesh)
    if jobs is None:
        return MeshProduct(mesh, extents, None)
    # One scale for all meshes of a product, from their common extent.
    common = mesh_extents(mesh, overall=True).select("xy_extent", "z_extent")
    return MeshProduct(mesh, extents, scale_3d(jobs.drop("xy_extent", "z_extent").join(F.broadcast(common), F.lit(True))))


def terrain_mesh(grid: DataFrame, grids: DataFrame, job: Job = Job(), jobs: DataFrame | None = None) -> MeshProduct:
    """Clean a grid and triangulate it: one surface, with base and walls on request, or equal slabs."""
    repaired, _ = _checked(grid, job)
    if job.slabs:
        mesh = heightmap_layers(repaired, grids, job.slabs, job.surface, vscale=job.vscale)
    else:
        mesh = heightmap_triangles(repaired, grids, job.surface, job.min_elev, job.max_elev, vscale=job.vscale)
        if job.base_mm is not None:
            base = base_platform(grids, job.base_mm)
            walls = side_walls(repaired, grids, job.base_mm, job.surface, job.vscale)
            mesh = join_parts(mesh, base, walls)
    # Vertices and triangles are two tables of the same cells, and every sink reads both.
    return _scaled(settled(repair_mesh(mesh) if job.repair else mesh), jobs)


@dataclass(frozen=True)
class SolidProduct:
    contours: ContourProduct
    slabs: DataFrame
    mesh: Mesh
    report: DataFrame
    scaled_jobs: DataFrame | None


def layered_solid(grid: DataFrame, grids: DataFrame, job: Job = Job(), jobs: DataFrame | None = None) -> SolidProduct:
    """Contour layers extruded to closed bodies in metres, with their topology report.

    Bodies are made of the cells inside the rings, whose corners never lie close together, so rings keep
    all their points here. With `repair` triangles without area go after the report.
    """
    contours = contour_product(grid, grids, replace(job, near=None))
    spans = contours.levels.groupBy("grid_id").agg(F.min("lower").alias("_lo"), F.max("upper").alias("_hi"))
    ranged = contours.layers.join(spans, "grid_id")
    slabs = layer_slabs(ranged, F.col("_lo"), F.col("_hi"), job.laser_mm).drop("_lo", "_hi")
    cells = filled_cells(contours.ring_points, grids) if job.remove_holes else contours.cells
    # Written once: the report, the extents and every sink read it.
    mesh = settled(extrude_layers(cells, slabs, grids, metres=True))
    report = validate_mesh(mesh)
    if job.repair:
        mesh = repair_mesh(mesh)
    if job.stacked:
        mesh = stack_meshes(mesh)
    return SolidProduct(contours, slabs, mesh, report, _scaled(mesh, jobs).scaled_jobs)
