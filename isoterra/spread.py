"""How rows are spread over the cluster: size-checked joins, global order, lineage.

Every operator that joins a large table with a small one, or needs a running total over a whole
table, goes through this module so the scale decisions live in one place.
"""

from __future__ import annotations

import uuid
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

# A side is broadcast only below these bounds; beyond them the join is salted instead.
BROADCAST_BYTES = 8 * 1024 * 1024
BROADCAST_ROWS = 200_000
SALTS = 64
# Rows per block wherever an ordered group is cut into bounded pieces.
BLOCK = 8192


def shared_folder(spark: SparkSession) -> str:
    """The folder the cluster names in spark.checkpoint.dir.

    Where that is unset, as in tests, a folder below the warehouse serves, which every executor sees; it
    is never a machine-local temporary folder.
    """
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        folder = spark.conf.get("spark.checkpoint.dir", None)
        context.setCheckpointDir(folder or f"{spark.conf.get('spark.sql.warehouse.dir')}/isoterra-checkpoints")
    return context.getCheckpointDir()


def cut(df: DataFrame) -> DataFrame:
    """Write a frame to the shared folder and go on from there.

    Lineage ends here, so a lost executor costs no recomputation of earlier steps. Unlike a row
    checkpoint the Parquet copy has real size statistics and can be read column by column.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/isoterra-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def discard(copy: DataFrame) -> None:
    """Delete the files of a `cut` that no frame reads any more, so rounds of a loop do not pile up."""
    context = copy.sparkSession.sparkContext
    for folder in {file.rsplit("/", 1)[0] for file in copy.inputFiles()}:
        if "/isoterra-" in folder:
            path = context._jvm.org.apache.hadoop.fs.Path(folder)
            path.getFileSystem(context._jsc.hadoopConfiguration()).delete(path, True)


def proven_small(df: DataFrame, limit: int = BROADCAST_BYTES) -> bool:
    """Whether Catalyst's size estimate, which starts no job, bounds a frame.

    The estimate ignores how far `explode` and Python functions multiply rows, so a plan that has them
    proves nothing.
    """
    plan = df._jdf.queryExecution().optimizedPlan()
    multiplies = any(node in plan.toString() for node in ("Generate", "InPandas", "InArrow"))
    return not multiplies and int(str(plan.stats().sizeInBytes())) <= limit


def attach(
    big: DataFrame,
    small: DataFrame,
    on: Sequence[str],
    spread_by: Sequence[str] | None,
    how: str = "inner",
) -> DataFrame:
    """Join a large frame with another one.

    With `spread_by` (columns of the large frame) the other side has one or few rows per grid, mesh or
    layer. It is broadcast if its size is proven: by the estimate of a plan that generates no rows or,
    failing that, by counting its materialised rows. Else both sides are shuffled on the key plus a salt,
    so that a grid with a third of all rows lands on many tasks. Without `spread_by` the keys are (nearly)
    unique on both sides, whose sizes are alike: a shuffled join, never a broadcast.
    """
    if spread_by is None:
        return big.join(small.hint("merge"), list(on), how)
    if proven_small(small):
        return big.join(F.broadcast(small), list(on), how)
    small = cut(small)
    if small.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS:
        return big.join(F.broadcast(small), list(on), how)
    return salted_join(big, small, on, spread_by, how)


def salted_join(
    big: DataFrame, small: DataFrame, on: Sequence[str], spread_by: Sequence[str], how: str = "inner"
) -> DataFrame:
    """Equi-join with the big side salted over SALTS values and the small side repeated for each."""
    salted = big.withColumn("_salt", F.pmod(F.xxhash64(*spread_by), F.lit(SALTS)))
    repeated = small.withColumn("_salt", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SALTS - 1).cast("long"))))
    return salted.join(repeated, [*on, "_salt"], how).drop("_salt")


def lookup(facts: DataFrame, table: DataFrame, on: Sequence[str], how: str = "inner") -> DataFrame:
    """Join facts to a table that is unique on `on`, where single keys of the facts may be hot.

    A shuffled join without a hint of size: the table is as large as the grid or mesh it belongs to, and
    the adaptive planner splits the partitions of the facts that turn out to be skewed.
    """
    return facts.join(table.hint("merge"), list(on), how)


def in_order(df: DataFrame, order: Sequence[Column | str]) -> DataFrame:
    """Range-partition on a total order and remember the partition as `_part`.

    The result is written out: the partition numbers are used twice (totals, then rows) and must
    not change if a task is repeated. A value shared by a third of the rows is still split, provided
    the order ends in a unique column.
    """
    ranged = df.repartitionByRange(*[F.col(c) if isinstance(c, str) else c for c in order])
    return cut(ranged.withColumn("_part", F.spark_partition_id()))


def running_total(
    df: DataFrame, order: Sequence[Column | str], value: Column, name: str, ranged: bool = False
) -> DataFrame:
    """Add `name` = total of `value` over all earlier rows (exclusive) in the given total order.

    Totals per range partition are tiny (one row per partition) and give the offsets; inside a
    partition an ordinary window runs, so no task ever sees the whole table.
    """
    parts = df if ranged else in_order(df, order)
    totals = parts.groupBy("_part").agg(F.sum(value).alias("_total"))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select("_part", F.coalesce(F.sum("_total").over(before), F.lit(0)).alias("_offset"))
    inside = Window.partitionBy("_part").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    return (
        attach(parts, offsets, ["_part"], ["_part"])
        .withColumn(name, F.col("_offset") + F.coalesce(F.sum(value).over(inside), F.lit(0)))
        .drop("_part", "_offset")
    )


def dense_ids(df: DataFrame, order: Sequence[Column | str], name: str) -> DataFrame:
    """Number all rows 0..n-1 in a total order without a single-partition window."""
    return running_total(df, order, F.lit(1).cast("long"), name)
