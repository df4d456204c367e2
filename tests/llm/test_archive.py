import base64
import hashlib

import tracemalloc

import pyarrow as pa

from isoterra.llm import frames
from isoterra.llm.archive import fetch, parse_record, read_archive, record, records_of, write_archive

SCHEMA = "response_id long, url string, body string"
ROWS = [
    (1, "http://a.example/1", "same"), (2, None, "same"), (9, "http://a.example/9\r\nX: y", "same"), (3, "u", None), (4, "u", ""),
    (5, "u", "größe " * 5000), (6, "u", "WARC/1.1\r\n\r\nlooks like a record\r\n\r\n"), (None, "u", "same"), (9, "u", "same"),
]


def digest(body):
    return base64.b32encode(hashlib.sha1((body or "").encode()).digest()).decode()


def brute(rows, least=0):
    out = []
    for key, _, body in rows:
        data = (body or "").encode()
        keeper = max((k for k, _, b in rows if (b or "") == (body or "") and k is not None), default=None)
        full = key is None or key == keeper or len(data) < least
        out.append((key, len(data), digest(body), "response" if full else "revisit", None if full else keeper))
    return sorted(out, key=repr)


def test_archive(spark):
    frame = spark.createDataFrame(ROWS, SCHEMA).selectExpr("response_id", "url", "body", "1 id", "2 file", "3 payload_bytes")
    archive = write_archive(frame.repartition(2), "2024-01-01T00:00:00Z")
    found = read_archive(archive)
    assert found.columns == ["response_id", "payload_bytes", "payload_digest", "record_type", "refers_to"]
    assert sorted(map(tuple, found.collect()), key=repr) == brute(ROWS)
    got = fetch(archive, [5, 1])
    assert got[5]["payload"] == ("größe " * 5000).encode() and got[1]["payload"] == b""
    assert got[1]["warc-refers-to"] == "<urn:isoterra:response:9>"


def test_least_bytes(spark):
    archive = write_archive(spark.createDataFrame(ROWS, SCHEMA), "2024-01-01T00:00:00Z", least_bytes=5)
    assert sorted(map(tuple, read_archive(archive).collect()), key=repr) == brute(ROWS, 5)


def test_record():
    fields = parse_record(record(7, "http://a.example/\nb", b"x\r\n\r\ny", None, "2024-01-01T00:00:00Z", True))
    assert fields["payload"] == b"x\r\n\r\ny" and fields["warc-target-uri"] == "http://a.example/ b"


def test_empty(spark):
    assert read_archive(write_archive(spark.createDataFrame([], SCHEMA), "2024-01-01T00:00:00Z")).count() == 0


def test_a_large_batch_is_not_held_as_python_values():
    bodies = ["ж" * 8000 + str(n) for n in range(3000)]
    batch = pa.RecordBatch.from_pydict({"id": list(range(3000)), "url": ["u"] * 3000, "body": bodies, "keeper": list(range(3000))})
    del bodies
    tracemalloc.start()
    made = sum(1 for _ in records_of([batch], "2024-01-01T00:00:00Z", 0))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert made == 3000 and peak < 8 << 20


def test_short_records_end_a_file_too(tmp_path, monkeypatch):
    monkeypatch.setattr(frames, "FILE_RECORDS", 100)
    files = list(frames.write_files(f"file://{tmp_path}", ((n, b"alike") for n in range(250)), ".zst"))
    assert [f[1:] for f in files] == [(100, 0), (100, 100), (50, 200)]
    assert [k for f in files for k, _ in frames.open_file(f"file://{tmp_path}", f[0]).records()] == list(range(250))
