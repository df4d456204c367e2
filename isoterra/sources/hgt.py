"""Elevation tile files: gzip-compressed square rasters of big-endian 16-bit integers, north up."""

from __future__ import annotations

import gzip
import math
import re
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Void marker of the file format, name pattern of a tile.
VOID = -32768
TILE_NAME = r"([NS])(\d{2})([EW])(\d{3})\.hgt(\.gz)?$"
# Rows of cells handed to Arrow at once.
ROWS_AT_ONCE = 64

_CHUNKS = "grid_id string, grid_row int, first_col int, elevs array<float>"
SPAN = 256
# West, south, east, north in degrees.
Box = tuple[float, float, float, float]


def _tile(content: bytes, path: str) -> np.ndarray:
    raw = gzip.decompress(content) if content[:2] == b"\x1f\x8b" else content
    side = math.isqrt(len(raw) // 2)
    if side * side * 2 != len(raw):
        raise ValueError(f"{path}: not a square raster of 16-bit values")
    values = np.frombuffer(raw, dtype=">i2").reshape(side, side).astype(np.float32)
    values[values == VOID] = np.nan
    return values


def _window(name: str, side: int, box: Box | None) -> tuple[int, int, int, int]:
    """First and end row, first and end column of the cells of a tile that a box touches, one more on each side."""
    if box is None:
        return 0, side, 0, side
    south = int(name[1:3]) * (-1 if name[0] == "S" else 1)
    west = int(name[4:7]) * (-1 if name[3] == "W" else 1)
    step = 1.0 / (side - 1) if side > 1 else 1.0
    # A box over the antimeridian goes on beyond 180 degrees.
    west += 360 if west + 1 < box[0] else 0
    rows = (south + 1 - box[3]) / step, (south + 1 - box[1]) / step
    columns = (box[0] - west) / step, (box[2] - west) / step
    ends = [(max(0, math.floor(a) - 1), min(side, math.ceil(b) + 2)) for a, b in (rows, columns)]
    return *ends[0], *ends[1]


def _reader(box: Box | None):
    def read(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            for path, content in zip(pdf["path"], pdf["content"]):
                values = _tile(content, path)
                name = re.search(TILE_NAME, path).group(0).split(".")[0]
                first, end, left, right = _window(name, len(values), box)
                for top in range(first, end, ROWS_AT_ONCE):
                    spans = [
                        (name, r, c, values[r, c : min(c + SPAN, right)])
                        for r in range(top, min(top + ROWS_AT_ONCE, end))
                        for c in range(left, right, SPAN)
                    ]
                    yield pd.DataFrame(spans, columns=["grid_id", "grid_row", "first_col", "elevs"])

    return read


def _files(spark: SparkSession, path: str, tiles: Sequence[str] | None = None) -> DataFrame:
    """Tile files below a folder; with a list of tile names, such as those that cover a box, only these are read."""
    named = "{" + ",".join(tiles) + "}" if tiles else "*"
    files = spark.read.format("binaryFile").option("pathGlobFilter", f"{named}.hgt*").option("recursiveFileLookup", "true").load(path)
    return files.where(F.regexp_like("path", F.lit(TILE_NAME)))


def decode_tiles(files: DataFrame, box: Box | None = None) -> DataFrame:
    """Grid table of tile files given as rows (path, content); the grid is named after the tile.

    A tile is one file of bounded size and one unit of work; it leaves the worker as spans of 256
    cells, which are exploded on the JVM side. With a box only the cells that it touches, and a margin
    of one or two around them, leave the worker.
    """
    spans = files.select("path", "content").mapInPandas(_reader(box), _CHUNKS)
    return spans.select("grid_id", "grid_row", "first_col", F.posexplode("elevs").alias("_i", "_e")).select(
        "grid_id",
        "grid_row",
        (F.col("first_col") + F.col("_i")).alias("grid_col"),
        F.when(~F.isnan("_e"), F.col("_e")).alias("elev"),
    )


_PACKED = "grid_id string, chunk_row int, chunk_col int, elevs array<float>"


def decode_chunks(files: DataFrame, side: int) -> DataFrame:
    """Packed chunks (grid_id, chunk_row, chunk_col, elevs) of tile files (path, content): no cell leaves the decoder alone.

    Chunks are squares of `side` cells, row after row, filled up with NaN at the far edges.
    """

    def read(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            for path, content in zip(pdf["path"], pdf["content"]):
                values, name = _tile(content, path), re.search(TILE_NAME, path).group(0).split(".")[0]
                count = -(-len(values) // side)
                for r in range(count):
                    band = np.full((side, count * side), np.nan, np.float32)
                    own = values[r * side : (r + 1) * side]
                    band[: len(own), : own.shape[1]] = own
                    chunks = [band[:, c * side : (c + 1) * side].ravel() for c in range(count)]
                    yield pd.DataFrame({"grid_id": name, "chunk_row": r, "chunk_col": range(count), "elevs": chunks})

    return files.select("path", "content").mapInPandas(read, _PACKED)


def scan_chunks(spark: SparkSession, path: str, side: int, tiles: Sequence[str] | None = None) -> DataFrame:
    """Packed chunks of the tiles below a folder, all or only those named."""
    return decode_chunks(_files(spark, path, tiles), side)


def scan_hgt(spark: SparkSession, path: str, tiles: Sequence[str] | None = None, box: Box | None = None) -> DataFrame:
    """Grid table of the tiles below a folder, all or only those named, whole or only around a box."""
    return decode_tiles(_files(spark, path, tiles), box)


def _raster_bytes() -> Column:
    """Size of the raster: the file's own, or what a compressed file notes in its last four bytes, lowest first."""
    digits = F.concat(*[F.hex(F.substring(F.col("content"), n, 1)) for n in (-1, -2, -3, -4)])
    return F.when(F.endswith("path", F.lit(".gz")), F.conv(digits, 16, 10).cast("long")).otherwise(F.col("length"))


def hgt_geometry(spark: SparkSession, path: str, tiles: Sequence[str] | None = None) -> DataFrame:
    """Geometry of the tiles below a folder, from their names and the sizes of their rasters.

    Cells are centred on whole arc steps, so the raster starts half a cell outside the tile corner.
    Tiles are ordered by name; on overlap the later one wins in a mosaic.
    """
    side = F.sqrt(_raster_bytes() / 2).cast("int")
    step = 1.0 / (side - 1)
    name = F.regexp_extract("path", TILE_NAME, 0)
    south = F.regexp_extract("path", TILE_NAME, 2).cast("int") * F.when(F.regexp_extract("path", TILE_NAME, 1) == "S", -1).otherwise(1)
    west = F.regexp_extract("path", TILE_NAME, 4).cast("int") * F.when(F.regexp_extract("path", TILE_NAME, 3) == "W", -1).otherwise(1)
    return _files(spark, path, tiles).select(
        F.substring_index(name, ".", 1).alias("grid_id"),
        (west - step / 2).alias("x0"),
        step.alias("dx"),
        F.lit(0.0).alias("rx"),
        (south + 1 + step / 2).alias("y0"),
        F.lit(0.0).alias("ry"),
        (-step).alias("dy"),
        side.alias("width"),
        side.alias("height"),
        F.substring_index(name, ".", 1).alias("tile_order"),
    )
