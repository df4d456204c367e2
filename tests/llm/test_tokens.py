import random
import zlib
from pathlib import Path

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from isoterra.llm.frames import FrameReader, FrameWriter
from isoterra.llm.packing import allowed_ends, best_cuts, pack_places
from isoterra.llm.tokenfile import read_names, read_token_files, write_token_files
from isoterra.llm.tokens import Encoder

WORDS, BYTES = (public_tokenizers.path(n) for n in ("word_bpe_49k.json", "byte_bpe_50k.json"))
SCHEMA = "place_id long, name string"
NAMES = [
    "Denali", "Mount McKinley, Alaska", "  two  spaces", "tab\tand\nline \n mixed", "don't we'll 'S THE", "<|endoftext|> a<|endoftext|>b",
    "日本語 テキスト です", "ΣΑΣ İstanbul ſ", "e ́b ̧́", "Ünïcode, Größe; señor: wow!! ok...", "x\x1cy \x85 z a\xa0b", "", " ", "\n", "a" * 300 + " b",
    "🙂 👩‍👩‍👧 peak", "1,234.5m 12% #1", "trailing ", " leading",
]


@pytest.mark.parametrize("path", [WORDS, BYTES])
def test_encoder_equals_the_library(path):
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(path)
    library.encode_special_tokens = True
    draw = random.Random(1)
    texts = NAMES + [" ".join(draw.choice(NAMES) for _ in range(5)) for _ in range(60)] + ["".join(draw.choice(" \n.aÄ'1é") for _ in range(30)) for _ in range(200)]
    # A tiny memory makes generations change all the time.
    encoder = Encoder(path, kept=20)
    for at in range(0, len(texts), 7):
        for text, ids in zip(texts[at : at + 7], encoder.encode(texts[at : at + 7])):
            assert np.frombuffer(ids, "<u4").tolist() == library.encode(text, add_special_tokens=False).ids, repr(text)
    assert encoder.encode([None]) == [b""]


def library_ids(path, text, end):
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(path)
    library.encode_special_tokens = True
    return np.array([*library.encode(text or "", add_special_tokens=False).ids, end], "<u4")


def places(spark):
    rows = [(i * 3 % 50, n) for i, n in enumerate(NAMES)] + [(60, None), (61, "Gipfel und See. " * 3000), (None, "no id"), (7, "repeated"), (7, "repeated"), (7, "other")]
    return rows, spark.createDataFrame(rows, SCHEMA).selectExpr("place_id", "name", "1 key", "2 start", "'x' file")


def in_order(rows):
    return sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] is not None, (r[1] or "").encode()))


def test_token_files(spark):
    rows, frame = places(spark)
    files = write_token_files(frame.repartition(3), BYTES)
    found = read_token_files(files)
    assert found.columns == ["place_id", "start", "n_tokens", "ids_crc32"]
    want, start = [], 0
    for key, name in in_order(rows):
        ids = library_ids(BYTES, name, 0)
        want.append((key, start, len(ids), zlib.crc32(ids.tobytes())))
        start += len(ids)
    assert [tuple(r) for r in found.orderBy("start").collect()] == want
    fetched = read_names(files, [61, 7])
    assert [a.tolist() for a in fetched[61]] == [library_ids(BYTES, "Gipfel und See. " * 3000, 0).tolist()]
    assert len(fetched[7]) == 3
    empty = write_token_files(spark.createDataFrame([], SCHEMA), BYTES)
    assert read_token_files(empty).count() == 0


def test_frames(tmp_path: Path):
    import zstandard
    from pyarrow import fs

    store, path = fs.LocalFileSystem(), str(tmp_path / "x.zst")
    records = [(i, bytes([i]) * (i * 100)) for i in range(20)] + [(5, b"again")]
    writer = FrameWriter(store.open_output_stream(path, compression=None), frame_bytes=1000)
    for record in records:
        writer.add(*record)
    writer.finish()
    reader = FrameReader(store.open_input_file(path))
    assert list(reader.records()) == records and list(reader.records([5, 19])) == [records[5], records[19], records[20]]
    assert len(reader.sizes) > 5
    # Any decompressor reads the whole file as the records in a row.
    plain = zstandard.ZstdDecompressor().stream_reader(open(path, "rb"), read_across_frames=True).read()
    assert plain == b"".join(r for _, r in records)
    damaged = bytearray(Path(path).read_bytes())
    damaged[reader.starts[2] + 12] ^= 255
    Path(path).write_bytes(damaged)
    broken = FrameReader(store.open_input_file(path))
    assert next(broken.records())[0] == 0
    with pytest.raises((ValueError, zstandard.ZstdError)):
        list(broken.records())


def brute_cost(ends, penalties, length):
    best = {0: 0}
    for e, p in zip(ends, penalties):
        best[e] = min(best[b] + length - (e - b) + p for b in best if b < e and e - b <= length)
    return best[ends[-1]]


def test_best_cuts():
    draw = random.Random(4)
    for _ in range(200):
        length = draw.randint(3, 30)
        ends = [0]
        for _ in range(draw.randint(1, 40)):
            ends.append(ends[-1] + draw.randint(1, length))
        ends = ends[1:]
        penalties = [draw.choice([0, 3, 9]) for _ in ends]
        cuts = best_cuts(ends, penalties, length)
        told = dict(zip(ends, penalties))
        assert cuts[-1] == ends[-1] and all(0 < b - a <= length for a, b in zip([0, *cuts], cuts))
        cost = sum(length - (b - a) + told[b] for a, b in zip([0, *cuts], cuts))
        assert cost == brute_cost(ends, penalties, length)
    assert allowed_ends(np.zeros(10, np.uint32), np.array([10]), np.array([9]), 4, 10)[0] == [4, 8, 10]


@pytest.mark.parametrize("length", [16, 4096])
def test_packing(spark, length):
    rows, frame = places(spark)
    packed = pack_places(frame.repartition(3), WORDS, length)
    assert packed.columns == ["place_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]
    pieces = packed.orderBy("sequence_id", "offset").collect()
    want = [(key, library_ids(WORDS, name, 2)) for key, name in in_order(rows)]
    at, used = 0, 0
    filled = {}
    for p in pieces:
        key, ids = want[at]
        assert (p["place_id"], p["start"], p["doc_tokens"]) == (key, used, len(ids))
        assert p["ids_crc32"] == zlib.crc32(ids[used : used + p["length"]].tobytes())
        assert p["offset"] == filled.get(p["sequence_id"], 0)
        filled[p["sequence_id"]] = p["offset"] + p["length"]
        used += p["length"]
        if used == len(ids):
            at, used = at + 1, 0
    assert at == len(want) and max(filled.values()) <= length
    if length == 16:
        padding = sum(length - f for f in filled.values())
        assert padding < 0.3 * length * len(filled)
    assert pack_places(spark.createDataFrame([], SCHEMA), WORDS).count() == 0


def test_packing_across_plans(spark, monkeypatch):
    from isoterra.llm import packing

    monkeypatch.setattr(packing, "PLAN_IDS", 300)
    rows = [(i, "peak ridge lake. " * (i % 40)) for i in range(60)]
    packed = pack_places(spark.createDataFrame(rows, SCHEMA).repartition(2), WORDS, 64)
    totals = packed.groupBy("sequence_id").agg(F.sum("length").alias("n")).agg(F.max("n"), F.sum("n"), F.count("n")).first()
    ids = sum(len(library_ids(WORDS, n, 2)) for _, n in rows)
    assert totals[0] <= 64 and totals[1] == ids and totals[2] <= 1.15 * ids / 64 + 10
