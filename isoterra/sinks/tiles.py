"""Elevation tile files from a grid table, the counterpart of the tile scan."""

from __future__ import annotations

import gzip
import uuid

import numpy as np
import pandas as pd
from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from isoterra.sources.hgt import VOID
from isoterra.spread import cut

# Fixed value: elevations beyond this are no 16-bit integers.
LARGEST = 32767


def tile_content(rows: pd.DataFrame, side: int) -> bytes:
    """Compressed raster of rows (grid_row, cols, elevs) of one tile; cells without a value are void."""
    values = np.full((side, side), VOID, ">i2")
    for row, cols, elevs in zip(rows["grid_row"], rows["cols"], rows["elevs"]):
        values[row, np.asarray(cols, np.int64)] = np.rint(np.asarray(elevs, np.float64)).astype(">i2")
    return gzip.compress(values.tobytes(), mtime=0)


def write_hgt(grid: DataFrame, folder: str, side: int) -> DataFrame:
    """Write every grid, named like its tile, as `name.hgt.gz` below a folder that all executors see; returns (tile, path, bytes).

    A tile is square with `side` cells; cells outside it, voids and elevations that 16 bits do not hold are
    left void, fractions are rounded. Rows are packed on the JVM side first, so the task that writes a tile
    holds its rows, not its cells one by one. A repeated task writes under another name before it replaces the file.
    """
    inside = F.col("grid_row").between(0, side - 1) & F.col("grid_col").between(0, side - 1)
    held = grid.where(inside & F.col("elev").isNotNull() & (F.abs("elev") <= LARGEST))
    packed = held.groupBy("grid_id", "grid_row").agg(F.collect_list(F.struct("grid_col", "elev")).alias("_cells"))
    rows = packed.select("grid_id", "grid_row", F.col("_cells.grid_col").alias("cols"), F.col("_cells.elev").alias("elevs"))

    def write(rows: pd.DataFrame) -> pd.DataFrame:
        store, root = fs.FileSystem.from_uri(folder)
        tile, content = rows["grid_id"].iloc[0], tile_content(rows, side)
        store.create_dir(root, recursive=True)
        draft, path = f"{root}/.{tile}-{uuid.uuid4().hex}", f"{root}/{tile}.hgt.gz"
        with store.open_output_stream(draft, compression=None) as out:
            out.write(content)
        store.move(draft, path)
        return pd.DataFrame({"tile": [tile], "path": [path], "bytes": [len(content)]})

    return cut(rows.groupBy("grid_id").applyInPandas(write, "tile string, path string, bytes long"))
