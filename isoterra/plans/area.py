"""From a box in degrees to files: covering tiles, mosaic, clip, product, documents."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from isoterra.functions.labels import render_filename
from isoterra.operators.catalogue import needed_tiles
from isoterra.operators.grid import clip, clip_geometry, mosaic, mosaic_geometry
from isoterra.operators.mesh import Mesh, mesh_extents
from isoterra.operators.style import band_materials
from isoterra.plans.products import ContourProduct, Job, contour_product, layered_solid, terrain_mesh
from isoterra.sinks import geojson, meshtext, svg
from isoterra.sinks.features import feature_geometry, feature_table
from isoterra.sinks.text import write_lines
from isoterra.sources.hgt import hgt_geometry, scan_hgt
from isoterra.spread import attach, cut

VECTOR_FORMATS, MESH_FORMATS = ("geojson", "svg", "features"), ("stl", "obj", "ply")


@dataclass(frozen=True)
class BoxJob:
    """A box in degrees (min_lon > max_lon crosses the antimeridian), what to make of it and how to name the files."""

    min_lat: float
    max_lat: float
    min_lon: float
    max_lon: float
    formats: tuple[str, ...] = ("geojson",)
    base: str = "area"
    job: Job = Job()
    solid: bool = False
    separate_layers: bool = True
    bed_mm: float | None = 200.0
    gate: bool = True


@dataclass(frozen=True)
class Area:
    """The cells of a box, numbered from its corner, their geometry, and the tiles that were read or not found."""

    grid: DataFrame
    grids: DataFrame
    tiles: list[str]
    missing: list[str]


def covering_tiles(spark: SparkSession, job: BoxJob) -> list[str]:
    """Names of the one-degree tiles of a box, at most those of the globe."""
    box = spark.createDataFrame([(0, job.min_lat, job.max_lat, job.min_lon, job.max_lon)], "box_id int, min_lat double, max_lat double, min_lon double, max_lon double")
    return sorted(r[0].split(".")[0] for r in needed_tiles(box).select("tile").collect())


def load_area(spark: SparkSession, folder: str, job: BoxJob) -> Area:
    """Read the tiles that a box needs and cut the box out of their mosaic.

    Only files of covering tiles are opened, and of these only the cells around the box leave the
    decoder. Tiles that are not in the folder leave voids where another tile reaches, and are listed;
    without any tile, and where no cell lies in the box, an error is raised.
    """
    names = covering_tiles(spark, job)
    frames = cut(hgt_geometry(spark, folder, names))
    found = sorted(r[0] for r in frames.select("grid_id").collect())
    if not found:
        raise ValueError(f"no elevation tile for the box below {folder}")
    east = job.max_lon + 360.0 if job.min_lon > job.max_lon else job.max_lon
    box = (job.min_lon, job.min_lat, east, job.max_lat)
    # Beyond the antimeridian the tiles of the west follow those of the east.
    wraps = F.lit(east > job.max_lon) & (F.col("x0") + F.col("width") * F.col("dx") < job.min_lon)
    frames = frames.withColumn("x0", F.when(wraps, F.col("x0") + 360.0).otherwise(F.col("x0")))
    cells = cut(scan_hgt(spark, folder, found, box))
    whole, geometry = mosaic(cells, frames, job.base), mosaic_geometry(frames, job.base)
    grids = cut(clip_geometry(geometry, *box))
    if grids.isEmpty():
        raise ValueError("no cell of the tiles lies in the box")
    return Area(cut(clip(whole, geometry, *box)), grids, found, sorted(set(names) - set(found)))


def _named(layers: DataFrame, base: str, suffix: str) -> DataFrame:
    """(grid_id, layer, file): file names of the layers."""
    name = render_filename(F.lit(base), F.col("layer_number"), F.col("elevation"))
    return layers.select("grid_id", "layer", F.concat(name, F.lit(f".{suffix}")).alias("file"))


def _write_layers(lines: DataFrame, layers: DataFrame, base: str, suffix: str, path: str) -> None:
    named = attach(lines, _named(layers, base, suffix), ["grid_id", "layer"], geojson.ORDER)
    write_lines(named, path, geojson.ORDER, ["file"])


def write_contours(product: ContourProduct, formats: Sequence[str], base: str, out: str, separate: bool = True) -> dict[str, str]:
    """Write contour layers in the vector formats; returns the folder of each.

    Layers are separate documents named after number and height, or for GeoJSON one document for all.
    """
    written = {}
    if "svg" in formats:
        written["svg"] = f"{out}/svg"
        _write_layers(svg.svg_lines(product.ring_points, product.layers, holes=True), product.layers, base, "svg", written["svg"])
    if "geojson" in formats:
        written["geojson"] = f"{out}/geojson"
        if separate:
            lines = geojson.to_geojson(product.ring_points, product.layers, area=True)
            _write_layers(lines, product.layers, base, "geojson", written["geojson"])
        else:
            lines = geojson.to_collection(product.ring_points, product.layers, area=True)
            write_lines(lines.withColumn("file", F.lit(f"{base}.geojson")), written["geojson"], ["grid_id", "layer", *geojson.ORDER], ["file"])
    if "features" in formats:
        written["features"] = f"{out}/features"
        feature_table(product.ring_points, product.layers).write.parquet(f"{out}/features/attributes")
        feature_geometry(product.ring_points).write.parquet(f"{out}/features/geometry")
    return written


def write_meshes(mesh: Mesh, formats: Sequence[str], base: str, out: str, bed_mm: float | None, bands: int = 10) -> dict[str, str]:
    """Write meshes in the mesh formats, printed at the size of a bed or as they are; returns the folder of each."""
    written = {}
    file = F.concat(F.lit(base), F.when(F.col("mesh_id") == base, "").otherwise(F.concat(F.lit("_"), F.regexp_replace("mesh_id", "^.*#", ""))))
    for kind in [f for f in MESH_FORMATS if f in formats]:
        written[kind] = f"{out}/{kind}"
        if kind == "stl":
            lines = meshtext.stl_lines(mesh, *((None, bed_mm) if bed_mm is not None else (1.0, None)))
        elif kind == "ply":
            lines = meshtext.ply_lines(mesh)
        else:
            lines = meshtext.obj_lines(mesh, bands=bands)
            box = mesh_extents(mesh).select("mesh_id", F.col("min_z").alias("min_elev"), F.col("max_z").alias("max_elev"))
            library = meshtext.mtl_lines(band_materials(box, bands, key="mesh_id"))
            write_lines(library.withColumn("file", F.lit(f"{base}.mtl")), f"{out}/mtl", meshtext.ORDER, ["file"])
            written["mtl"] = f"{out}/mtl"
        name = F.lit(f"{base}.obj") if kind == "obj" else F.concat(file, F.lit(f".{kind}"))
        write_lines(lines.withColumn("file", name), written[kind], meshtext.ORDER, ["file"])
    return written


def make_area(spark: SparkSession, folder: str, job: BoxJob, out: str) -> dict[str, str]:
    """Box to files: load, check, slice or triangulate, write; returns the folder of every format.

    Vector formats slice the area; mesh formats triangulate its surface or, for a solid, extrude the
    layers. A document is a folder `file=NAME` whose part files in name order are its text. With the gate
    an area with more than half of its cells invalid raises an error before anything is made.
    """
    unknown = sorted(set(job.formats) - {*VECTOR_FORMATS, *MESH_FORMATS})
    if unknown or not job.formats:
        raise ValueError(f"unknown formats: {', '.join(unknown) or 'none given'}")
    area = load_area(spark, folder, job)
    meshes = [f for f in job.formats if f in MESH_FORMATS]
    vectors = [f for f in job.formats if f in VECTOR_FORMATS]
    written, contours = {}, None
    making = replace(job.job, gate=job.gate)
    if meshes and job.solid:
        product = layered_solid(area.grid, area.grids, making)
        contours = product.contours
        written |= write_meshes(product.mesh, meshes, job.base, out, job.bed_mm)
    elif meshes:
        written |= write_meshes(terrain_mesh(area.grid, area.grids, making).mesh, meshes, job.base, out, job.bed_mm)
    if vectors:
        contours = contours or contour_product(area.grid, area.grids, making)
        written |= write_contours(contours, vectors, job.base, out, job.separate_layers)
    return written
