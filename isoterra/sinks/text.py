"""Text output: number formats, ring text in bounded pieces, ordered writing.

Every document is a table of lines with ordering columns. Written with `write_lines`, the part files
in name order make up the document; no task and no row holds a whole document or a whole ring.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from isoterra.operators.polygons import RING
from isoterra.spread import BLOCK

# Sorting bounds of lines before and after the numbered ones.
FIRST, LAST = -1, 2**62


def ring_parts(
    points: DataFrame, point: Column, separator: str, opening: Column, closing: Column, block: int = BLOCK
) -> DataFrame:
    """Text of rings in pieces (ring columns, part, value) of at most `block` points.

    `opening` and `closing` are written before and after the points of a ring and may use the
    columns of its first point. The pieces of a ring in order of `part` give its text.
    """
    columns = points.columns
    told = points.withColumn("_text", point).withColumn("part", F.expr(f"seq div {block}"))
    inner = told.groupBy(*RING, "part").agg(
        F.array_sort(F.collect_list(F.struct("seq", "_text"))).alias("_points")
    )
    joined = F.array_join(F.transform("_points", lambda p: p["_text"]), separator)
    body = inner.select(
        *RING, "part", F.concat(F.when(F.col("part") > 0, separator).otherwise(""), joined).alias("value")
    )
    first = points.where("seq = 0").select(*columns)
    start = first.select(*RING, F.lit(FIRST).cast("long").alias("part"), opening.alias("value"))
    end = first.select(*RING, F.lit(LAST).cast("long").alias("part"), closing.alias("value"))
    return start.unionByName(body).unionByName(end)


def write_lines(lines: DataFrame, path: str, order: Sequence[str], by: Sequence[str] = ()) -> None:
    """Write the `value` column as text in the given order, optionally in one folder per `by` value.

    Lines are range-partitioned, so a large document is written by many tasks; the part files of a
    folder, in name order, are the document.
    """
    keys = [*by, *order]
    ordered = lines.repartitionByRange(*keys).sortWithinPartitions(*keys).select(*by, "value")
    writer = ordered.write.partitionBy(*by) if by else ordered.write
    writer.text(path)
