"""Seekable Zstandard files: independent frames, a record index and a seek table at the end.

A file is a row of ordinary Zstandard frames, so any decompressor reads it from front to back. Two
skippable frames end it: the record index of this package, and the public seek table with compressed
size, size and checksum of every frame. A reader fetches the end of the file once and then only the
frames that hold the records it wants.
"""

from __future__ import annotations

import struct
import uuid
from collections.abc import Iterable, Iterator, Sequence

import numpy as np
import xxhash
import zstandard
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession

from isoterra.spread import shared_folder

# Fixed values of the public seekable format: magic numbers of skippable frames and of the footer.
INDEX_MAGIC, TABLE_MAGIC, FOOTER_MAGIC = 0x184D2A50, 0x184D2A5E, 0x8F92EAB1
HAS_CHECKSUMS = 0x80
INDEX_TYPE = np.dtype([("key", "<i8"), ("frame", "<u4"), ("offset", "<u4"), ("size", "<u8")])
# Bytes of records after which a frame ends, and compressed bytes after which a file ends.
FRAME_BYTES, FILE_BYTES = 1 << 20, 128 << 20
# Records after which a file ends too: short and alike records, such as revisits, pack so well that the index would outgrow memory.
FILE_RECORDS = 1 << 18
LEVEL = 3
# Most tasks that read files at the same time; with more files a task reads several.
READING_TASKS = 20_000


def new_folder(spark: SparkSession, kind: str) -> str:
    """A new folder below the shared one that the cluster names."""
    return f"{shared_folder(spark)}/isoterra-{kind}-{uuid.uuid4().hex}"


def one_task_each(files: DataFrame) -> DataFrame:
    """A table of files dealt to as many tasks as it has files, at most READING_TASKS; the planner does not join them again."""
    return files.repartition(max(1, min(files.count(), READING_TASKS)), "file")


class FrameWriter:
    """Writes records of one file; `finish` adds index and seek table."""

    def __init__(self, out, frame_bytes: int = FRAME_BYTES, level: int = LEVEL):
        self.out, self.frame_bytes, self.packer = out, frame_bytes, zstandard.ZstdCompressor(level=level)
        self.held, self.held_bytes, self.index, self.table, self.written = [], 0, [], [], 0

    def add(self, key: int, record: bytes) -> None:
        """Append one record; a record never spans two frames, so a long one has a frame of its own."""
        if self.held and self.held_bytes + len(record) > self.frame_bytes:
            self._end_frame()
        self.index.append((key, len(self.table), self.held_bytes, len(record)))
        self.held.append(record)
        self.held_bytes += len(record)

    def _end_frame(self) -> None:
        data = b"".join(self.held)
        packed = self.packer.compress(data)
        self.out.write(packed)
        self.table.append((len(packed), len(data), xxhash.xxh64_intdigest(data) & 0xFFFFFFFF))
        self.written += len(packed)
        self.held, self.held_bytes = [], 0

    def finish(self) -> None:
        if self.held:
            self._end_frame()
        index = self.packer.compress(np.array(self.index, INDEX_TYPE).tobytes())
        self.out.write(struct.pack("<II", INDEX_MAGIC, len(index)) + index)
        table = b"".join(struct.pack("<III", *entry) for entry in self.table)
        footer = struct.pack("<IBI", len(self.table), HAS_CHECKSUMS, FOOTER_MAGIC)
        self.out.write(struct.pack("<II", TABLE_MAGIC, len(table) + len(footer)) + table + footer)
        self.out.close()


class FrameReader:
    """Random access to the records of one file."""

    def __init__(self, file):
        self.file, self.unpacker = file, zstandard.ZstdDecompressor()
        size = file.size()
        count, _, magic = struct.unpack("<IBI", self._at(size - 9, 9))
        if magic != FOOTER_MAGIC:
            raise ValueError("the file has no seek table")
        entries = np.frombuffer(self._at(size - 9 - 12 * count, 12 * count), "<u4").reshape(count, 3).astype(np.int64)
        self.packed, self.sizes, self.checksums = entries.T
        self.starts = np.concatenate([[0], np.cumsum(self.packed)]).astype(np.int64)
        # The index lies between the last frame and the seek table.
        begin = int(self.starts[-1])
        magic, length = struct.unpack("<II", self._at(begin, 8))
        if magic != INDEX_MAGIC:
            raise ValueError("the file has no record index")
        self.index = np.frombuffer(self.unpacker.decompress(self._at(begin + 8, length)), INDEX_TYPE)
        self.last = (-1, b"")

    def _at(self, start: int, length: int) -> bytes:
        self.file.seek(start)
        return self.file.read(length)

    def frame(self, number: int) -> bytes:
        """One frame, checked against its checksum; the latest one is kept."""
        if self.last[0] != number:
            data = self.unpacker.decompress(
                self._at(int(self.starts[number]), int(self.packed[number])), max_output_size=int(self.sizes[number])
            )
            if xxhash.xxh64_intdigest(data) & 0xFFFFFFFF != int(self.checksums[number]):
                raise ValueError(f"checksum of frame {number} is wrong")
            self.last = (number, data)
        return self.last[1]

    def records(self, keys: Sequence[int] | None = None) -> Iterator[tuple[int, bytes]]:
        """All records in file order, or only those with the given keys; other frames stay untouched."""
        index = self.index if keys is None else self.index[np.isin(self.index["key"], list(keys))]
        for key, frame, offset, size in index.tolist():
            yield key, self.frame(frame)[offset : offset + size]


def write_files(folder: str, records: Iterable[tuple[int, bytes]], suffix: str) -> Iterator[tuple[str, int, int]]:
    """Write one task's records to files of bounded size; gives (name, records, first key).

    Names are new in every attempt of a task and only the names that the successful attempt returns
    are ever read, so a repeated task leaves no half-written file in the way.
    """
    store, root = fs.FileSystem.from_uri(folder)
    writer, name = None, ""
    for key, record in records:
        if writer is None:
            store.create_dir(root, recursive=True)
            name = f"{uuid.uuid4().hex}{suffix}"
            writer = FrameWriter(store.open_output_stream(f"{root}/{name}", compression=None))
        writer.add(key, record)
        if writer.written >= FILE_BYTES or len(writer.index) >= FILE_RECORDS:
            writer.finish()
            yield name, len(writer.index), writer.index[0][0]
            writer = None
    if writer is not None:
        writer.finish()
        yield name, len(writer.index), writer.index[0][0]


def open_file(folder: str, name: str) -> FrameReader:
    store, root = fs.FileSystem.from_uri(folder)
    return FrameReader(store.open_input_file(f"{root}/{name}"))
