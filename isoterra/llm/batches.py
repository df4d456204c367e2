"""Running a plain function on bounded batches of rows inside Spark tasks."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

Lists = dict[str, list]
# Bytes of rows that a function gets at once; a longer row is alone.
SLICE_BYTES = 2 << 20


def slices(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """An Arrow batch in parts of about SLICE_BYTES, since lists of words take many times a text's memory."""
    if batch.num_rows:
        rows = max(1, batch.num_rows * SLICE_BYTES // max(1, batch.nbytes))
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)


def in_batches(
    rows: DataFrame, function: Callable[[Lists], Lists], schema: StructType | str, carried: Sequence[str] = ()
) -> DataFrame:
    """Apply `function` (lists by column in, lists by column out) to parts of `rows`.

    The `carried` columns do not pass through the function: they stay as they are in front of its
    result, which must then have a row for each row of its input. Nothing is kept between parts, so a
    task needs the memory of one Arrow batch and one part however many rows its partition has.
    """
    new = StructType.fromDDL(schema) if isinstance(schema, str) else schema
    kinds = to_arrow_schema(new)
    fields = [rows.schema[c] for c in carried]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                given = part.drop_columns(carried).to_pydict() if carried else part.to_pydict()
                made = pa.RecordBatch.from_pydict(function(given), schema=kinds)
                kept = [part.column(c) for c in carried]
                yield pa.RecordBatch.from_arrays([*kept, *made.columns], names=[*carried, *made.schema.names])

    return rows.mapInArrow(run, StructType([*fields, *new.fields]))


def named(rows: DataFrame, **columns: str) -> DataFrame:
    """Only the named columns of a table, under the given names; other columns cannot clash with results."""
    return rows.select(*[rows[source].alias(name) for name, source in columns.items()])


def per_worker(name: str, make: Callable[[], object]) -> object:
    """An object that a Python worker keeps from task to task, such as a loaded vocabulary.

    Functions travel to workers by value and bring fresh module globals with every task, so the
    object hangs on an imported module, which a worker loads only once.
    """
    held = pa.__dict__.setdefault("_isoterra_held", {})
    if name not in held:
        held[name] = make()
    return held[name]
