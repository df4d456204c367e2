"""Stored web responses as WARC records in seekable Zstandard bundles.

Works on the library's stored responses (response_id, url, body), as the tile and geocoder caches
keep them. Of responses with equal bodies one is archived in full, the others as revisits of it.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterable, Iterator
from itertools import batched
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from isoterra.llm.batches import named, slices
from isoterra.llm.frames import new_folder, one_task_each, open_file, write_files
from isoterra.spread import cut

# Fixed values of the archive format.
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
RECORD_NAME = "urn:isoterra:response:"
_NONE = -(2**63)
# Records that a reader hands on at once.
READ_ROWS = 10_000


@dataclass
class Archive:
    """A folder of bundles and the table (file, records) of those that belong to it."""

    folder: str
    files: DataFrame


def payload_digest(body: bytes) -> str:
    """Base32 SHA-1 of a payload."""
    return base64.b32encode(hashlib.sha1(body).digest()).decode()


def _header_text(value: str) -> str:
    return " ".join(value.split())


def record(response_id: int, url: str | None, body: bytes, refers_to: int | None, date: str, keep_body: bool) -> bytes:
    """One WARC record: the HTTP header with the length of the payload, and the payload unless it is a revisit."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(body)}\r\n\r\n".encode()
    block = http + body if keep_body else http
    lines = [
        "WARC/1.1",
        f"WARC-Type: {'response' if keep_body else 'revisit'}",
        f"WARC-Record-ID: <{RECORD_NAME}{response_id}>",
        f"WARC-Date: {date}",
        f"WARC-Payload-Digest: sha1:{payload_digest(body)}",
        "Content-Type: application/http; msgtype=response",
        f"Content-Length: {len(block)}",
    ]
    if url:
        lines.insert(4, f"WARC-Target-URI: {_header_text(url)}")
    if not keep_body:
        lines += [f"WARC-Refers-To: <{RECORD_NAME}{refers_to}>", f"WARC-Profile: {PROFILE}"]
    return "\r\n".join([*lines, "", ""]).encode() + block + b"\r\n\r\n"


def parse_record(data: bytes) -> dict:
    """Headers and block of one record, with the fields of its HTTP header below `http`."""
    head, _, rest = data.partition(b"\r\n\r\n")
    version, *lines = head.decode().split("\r\n")
    if version != "WARC/1.1":
        raise ValueError("not a WARC record")
    fields = {k.lower(): v for k, _, v in (line.partition(": ") for line in lines)}
    block = rest[: int(fields["content-length"])]
    http, _, payload = block.partition(b"\r\n\r\n")
    fields["http"] = {k.lower(): v for k, _, v in (line.partition(": ") for line in http.decode().split("\r\n")[1:])}
    fields["payload"] = payload
    return fields


def records_of(batches: Iterable[pa.RecordBatch], date: str, least_bytes: int) -> Iterator[tuple[int, bytes]]:
    """Records with their keys from batches (id, url, body, keeper); Python values are made of one part of a batch at a time."""
    for batch in (part for whole in batches for part in slices(whole)):
        for i, address, text, keeper in zip(*[c.to_pylist() for c in batch.columns]):
            data = (text or "").encode()
            full = i is None or i == keeper or len(data) < least_bytes
            name = _NONE if i is None else i
            yield name, record(name, address, data, keeper, date, full)


def write_archive(
    responses: DataFrame, date: str, least_bytes: int = 0, response_id: str = "response_id", url: str = "url", body: str = "body"
) -> Archive:
    """Write one record per response into bundles.

    Bodies are UTF-8 (null: empty). Of responses with equal bodies of at least `least_bytes` bytes the
    one with the largest id is a full response and the others revisit it; smaller bodies are all
    written in full. Rows that repeat an id with the same body are one response written twice, so both
    are full or both revisits; a row without an id is always written in full. An empty table gives no
    bundle. Only digests and ids are grouped; a digest shared by many responses is summed before the
    shuffle and its side of the join is one row, so Spark can split the other side.
    """
    folder = new_folder(responses.sparkSession, "archive")
    rows = named(responses, id=response_id, url=url, body=body).withColumn("_digest", F.sha1(F.coalesce("body", F.lit("")).cast("binary")))
    keepers = rows.groupBy("_digest").agg(F.max("id").alias("_keeper"))
    marked = rows.join(keepers, "_digest").select("id", "url", "body", "_keeper")

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for file, count, _ in write_files(folder, records_of(batches, date, least_bytes), ".warc.zst"):
            yield pa.RecordBatch.from_pydict({"file": [file], "records": [count]})

    return Archive(folder, cut(marked.mapInArrow(write, "file string, records long")))


def _number(name: str | None) -> int | None:
    value = None if name is None else int(name.strip("<>").removeprefix(RECORD_NAME))
    return None if value == _NONE else value


def _told(records: Iterable[tuple[int, bytes]], file: str) -> Iterator[tuple]:
    """What every record says: id, payload bytes and digest, type, and the record it refers to."""
    for _, data in records:
        fields = parse_record(data)
        digest = fields["warc-payload-digest"].removeprefix("sha1:")
        if fields["warc-type"] == "response" and payload_digest(fields["payload"]) != digest:
            raise ValueError(f"digest of record {fields['warc-record-id']} in {file} is wrong")
        size = int(fields["http"]["content-length"])
        yield _number(fields["warc-record-id"]), size, digest, fields["warc-type"], _number(fields.get("warc-refers-to"))


def read_archive(archive: Archive, response_id: str = "response_id") -> DataFrame:
    """What the bundles hold, per record: id, payload_bytes, payload_digest, record_type, refers_to.

    The payload of every full response is hashed again and compared with its header.
    """
    folder = archive.folder

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for file in batch.column("file").to_pylist():
                for rows in batched(_told(open_file(folder, file).records(), file), READ_ROWS):
                    columns = [pa.array(c, kind) for c, kind in zip(zip(*rows), kinds)]
                    yield pa.RecordBatch.from_arrays(columns, names=names)

    names = [response_id, "payload_bytes", "payload_digest", "record_type", "refers_to"]
    kinds = (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64())
    schema = f"`{response_id}` long, payload_bytes long, payload_digest string, record_type string, refers_to long"
    return one_task_each(archive.files).mapInArrow(read, schema)


def fetch(archive: Archive, ids: list[int]) -> dict[int, dict]:
    """Records of a few responses, decompressing only the frames that hold them."""
    found: dict[int, dict] = {}
    for row in archive.files.toLocalIterator():
        for key, data in open_file(archive.folder, row["file"]).records(ids):
            found[key] = parse_record(data)
    return found
