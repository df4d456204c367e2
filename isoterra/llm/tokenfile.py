"""Token ids of place names as seekable binary files.

Works on the library's places (place_id, name): stored geocoder and map-feature responses, one text
per place. A text may be as long as a whole response.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from isoterra.llm.batches import named, slices
from isoterra.llm.frames import new_folder, one_task_each, open_file, write_files
from isoterra.llm.tokens import encoder
from isoterra.spread import cut

END_ID = 0


@dataclass
class TokenFiles:
    """A folder of token files and the table of its files (folder_part, seq, file, records) in order of the keys."""

    folder: str
    files: DataFrame
    id_bytes: int


def write_token_files(places: DataFrame, vocabulary: str, key: str = "place_id", name: str = "name", end_id: int = END_ID) -> TokenFiles:
    """Encode every whole name, append `end_id`, and write the ids in ascending order of the key.

    Rows are range-partitioned by key; every task writes its range as files of independent Zstandard
    frames with checksums and a seek table. Ids take two bytes where the vocabulary is small enough,
    else four. A null or empty name has only the end id. Rows that repeat a key are all written, in
    order of their texts; rows without a key come first, under the smallest number. An empty table
    gives no file.
    """
    spark = places.sparkSession
    folder = new_folder(spark, "tokens")
    id_bytes = 2 if _largest_id(vocabulary) < 1 << 16 and end_id < 1 << 16 else 4
    width = f"<u{id_bytes}"

    def records(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, bytes]]:
        for batch in (part for whole in batches for part in slices(whole)):
            keys, texts = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            for k, ids in zip(keys, encoder(vocabulary).encode(texts)):
                yield _NULL_KEY if k is None else k, np.append(np.frombuffer(ids, "<u4"), end_id).astype(width).tobytes()

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part = TaskContext.get().partitionId()
        for seq, (file, count, _) in enumerate(write_files(folder, records(batches), ".ids.zst")):
            yield pa.RecordBatch.from_pydict({"folder_part": [part], "seq": [seq], "file": [file], "records": [count]})

    ordered = named(places, key=key, name=name).repartitionByRange("key").sortWithinPartitions("key", "name")
    files = cut(ordered.mapInArrow(write, "folder_part long, seq long, file string, records long"))
    return TokenFiles(folder, files, id_bytes)


_NULL_KEY = -(2**63)


def _largest_id(vocabulary: str) -> int:
    from tokenizers import Tokenizer

    return Tokenizer.from_file(vocabulary).get_vocab_size(with_added_tokens=True) - 1


def read_token_files(files: TokenFiles, key: str = "place_id") -> DataFrame:
    """What the files hold, per name: key, start (ids before it), n_tokens with the end id, ids_crc32.

    Tasks read files, not rows: each fetches a file's seek table and then frame after frame. Only one
    row per file meets in the window that gives the first position of every file.
    """
    folder, width = files.folder, f"<u{files.id_bytes}"

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, seq, file in zip(*[batch.column(c).to_pylist() for c in ("folder_part", "seq", "file")]):
                keys, counts, sums = [], [], []
                for k, data in open_file(folder, file).records():
                    ids = np.frombuffer(data, width)
                    keys.append(None if k == _NULL_KEY else k)
                    counts.append(len(ids))
                    sums.append(zlib.crc32(ids.astype("<u4").tobytes()))
                starts = np.concatenate([[0], np.cumsum(counts)[:-1]]).astype(np.int64)
                n = len(keys)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([part] * n, pa.int64()), pa.array([seq] * n, pa.int64()), pa.array(keys, pa.int64()), pa.array(starts), pa.array(counts, pa.int64()), pa.array(sums, pa.int64())],
                    names=["folder_part", "seq", key, "start_in_file", "n_tokens", "ids_crc32"],
                )

    schema = f"folder_part long, seq long, `{key}` long, start_in_file long, n_tokens long, ids_crc32 long"
    listed = one_task_each(files.files)
    rows = cut(listed.mapInArrow(read, schema))
    lengths = rows.groupBy("folder_part", "seq").agg(F.sum("n_tokens").alias("_ids"))
    before = Window.orderBy("folder_part", "seq").rowsBetween(Window.unboundedPreceding, -1)
    offsets = lengths.select("folder_part", "seq", F.coalesce(F.sum("_ids").over(before), F.lit(0)).alias("_before"))
    placed = rows.join(offsets, ["folder_part", "seq"])
    return placed.select(key, (F.col("start_in_file") + F.col("_before")).alias("start"), "n_tokens", "ids_crc32")


def read_names(files: TokenFiles, keys: list[int]) -> dict[int, list[np.ndarray]]:
    """Ids of a few named places, fetched from the frames that hold them."""
    found: dict[int, list[np.ndarray]] = {k: [] for k in keys}
    for row in files.files.orderBy("folder_part", "seq").toLocalIterator():
        for k, data in open_file(files.folder, row["file"]).records(keys):
            found[k].append(np.frombuffer(data, f"<u{files.id_bytes}").astype(np.uint32))
    return found
