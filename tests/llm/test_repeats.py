import hashlib
import random

import numpy as np
import pytest

from isoterra.llm import induced
from isoterra.llm.induced import Space, piece_ranks, rising, suffix_array
from isoterra.llm.repeats import anchors, repeated_runs, repeated_strings

SCHEMA = "export_id long, value string"


def brute_suffixes(text):
    return sorted(range(len(text)), key=lambda i: text[i:])


@pytest.mark.parametrize("batch", [1, 7, 1 << 20])
@pytest.mark.parametrize("in_memory", [0, 1 << 20])
def test_suffix_array(monkeypatch, batch, in_memory):
    monkeypatch.setattr(induced, "BATCH", batch)
    draw = random.Random(batch)
    for n in range(60):
        text = [draw.randint(1, 1 + n % 4) for _ in range(draw.randint(0, 50))]
        if n % 3 == 0:
            text = text[:4] * 9
        text.append(0)
        with Space(in_memory) as space:
            assert suffix_array(np.array(text), max(text) + 1, space).tolist() == brute_suffixes(text)


def test_types_and_pieces():
    text = np.array([2, 1, 1, 3, 3, 2, 0])
    assert rising(text).tolist() == [False, True, True, False, False, False, True]
    # Pieces 1 1 3 3 2 0 and 0.
    assert piece_ranks(text, np.array([1, 6]), 4).tolist() == [1, 0]


def brute(rows, length=100):
    """Removed bytes judged string by string in order of id (none first) and start."""
    seen, out = set(), []
    for key, text in rows:
        data = (text or "").encode()
        covered = bytearray(len(data))
        for i in range(len(data) - length + 1):
            string = data[i : i + length]
            if string in seen:
                covered[i : i + length] = b"\1" * length
            seen.add(string)
        kept = bytes(b for b, c in zip(data, covered) if not c)
        spans = sum(1 for i, c in enumerate(covered) if c and not (i and covered[i - 1]))
        out.append((key, len(data), sum(covered), spans, hashlib.sha256(kept).hexdigest(), kept))
    return out


def exports():
    draw = random.Random(3)
    words = ["contour", "grid", "tile", "Höhe", "peak", "río", "vertex", "face"]
    long = " ".join(draw.choice(words) for _ in range(60))
    rows = [(None, long), (0, None), (1, ""), (2, "x" * 99), (3, "y" * 100), (4, "y" * 101), (5, "ab" * 300)]
    for i in range(10, 60):
        text = " ".join(draw.choice(words) for _ in range(draw.randint(1, 80)))
        if i % 3 == 0:
            text = text + "\n" + long[draw.randint(0, 50) : draw.randint(150, 400)]
        if i % 7 == 0:
            text = long
        if i % 11 == 0:
            text = text * 2
        rows.append((i, text))
    rows.append((70, "line of a mesh file 1.25 2.5 3.75\n" * 400))
    return rows


def test_repeated_runs(spark):
    rows = exports()
    shuffled = list(rows)
    random.Random(1).shuffle(shuffled)
    frame = spark.createDataFrame(shuffled, SCHEMA).selectExpr("export_id", "value", "1 id", "2 mark", "'t' text", "3 spans")
    found = repeated_runs(frame, shard_bytes=2000)
    assert found.columns == ["export_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"]
    got = sorted(((*r[:5], bytes(r[5])) for r in found.collect()), key=lambda r: (r[0] is not None, r[0] or 0))
    assert got == brute(rows)


def test_repeated_rows_and_empty(spark):
    text = "a text of one export that is listed twice under its id, once more under another id, and long enough. " * 2
    found = repeated_runs(spark.createDataFrame([(1, text), (1, text), (2, text)], SCHEMA)).orderBy("export_id").collect()
    # The rows of id 1 are one document; its own second half repeats the first.
    assert [r["n_removed"] for r in found] == [brute([(1, text)])[0][2]] * 2 + [len(text)]
    assert repeated_runs(spark.createDataFrame([], SCHEMA)).count() == 0


def test_strings_on_disk():
    draw = random.Random(5)
    base = bytes(draw.randrange(97, 100) for _ in range(400))
    contexts = [base[i : i + 139] for i in draw.sample(range(250), 60)] + [base[:139]] * 3
    owned, rank = np.array([len(c) - 99 for c in contexts]), np.array(draw.sample(range(len(contexts)), len(contexts)))
    strings = sorted((int(rank[c]), o, contexts[c][o : o + 100], c) for c in range(len(contexts)) for o in range(owned[c]))
    seen, want = set(), set()
    for _, offset, string, context in strings:
        if string in seen:
            want.add((context, offset))
        seen.add(string)
    for in_memory in (0, None):
        got = repeated_strings(contexts, owned, rank, in_memory=in_memory)
        assert set(zip(*[a.tolist() for a in got])) == want


def test_anchors_follow_the_string():
    draw = random.Random(6)
    string = bytes(draw.randrange(256) for _ in range(300))
    texts = [b"ab" + string, string[50:] + b"!", b"short", b"", string]
    number, hashes, context, first, count = anchors(texts)
    owner = {}
    for n, h, f, c in zip(number.tolist(), hashes.tolist(), first.tolist(), count.tolist()):
        for start in range(f, f + c):
            owner.setdefault(texts[n][start : start + 100], set()).add(h)
    assert all(len(h) == 1 for h in owner.values())
    # Equal contexts have equal digests, others have others.
    bytes_of = [texts[n][f : f + c + 99] for n, f, c in zip(number.tolist(), first.tolist(), count.tolist())]
    assert len(set(bytes_of)) == len(set(context.tolist())) == len(set(zip(bytes_of, context.tolist())))
    assert sum(count.tolist()) == sum(max(0, len(t) - 99) for t in texts)
