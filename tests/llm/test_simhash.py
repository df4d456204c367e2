import random

import pytest

from isoterra.llm.links import smallest_reachable
from isoterra.llm.simhash import _ball, _layout, fingerprint, near_copies, near_fingerprints

SCHEMA = "response_id long, body string"


def brute_fingerprint(body):
    import xxhash

    words = [w for w in "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in body or "").encode().split()]
    if not words:
        return 0
    size = min(4, len(words))
    hashes = [xxhash.xxh64(b" ".join(words[i : i + size]), 42).intdigest() for i in range(len(words) - size + 1)]
    return sum(1 << bit for bit in range(64) if 2 * sum(h >> bit & 1 for h in hashes) > len(hashes))


def brute_components(rows):
    prints = [brute_fingerprint(t) for _, t in rows]
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if (prints[i] ^ prints[j]).bit_count() <= 4:
                root[find(i)] = find(j)
    groups = {}
    for i, (key, _) in enumerate(rows):
        groups.setdefault(find(i), []).append(key)
    return [(key, f"{prints[i]:016x}", min((k for k in groups[find(i)] if k is not None), default=None)) for i, (key, _) in enumerate(rows)]


def test_fingerprint():
    texts = [None, "", " \n\t", "One", "one two", "One  two\nthree FOUR", "ÄÖ straße ÄÖ x y z", "a b c d " * 50, "a\x1cb \x0bc"]
    for text in texts:
        assert fingerprint(text) == brute_fingerprint(text)


def test_layout_finds_every_pair():
    for segments in (2, 3, 4, 5, 6):
        layout = _layout(segments, 4)
        assert sum(bits for _, bits, _ in layout) == 64
        # Pigeonhole: if every segment had more than its radius, there would be more than four bits.
        assert sum(radius + 1 for _, _, radius in layout) > 4
    assert len(_ball(22, 1)) == 23 and len(_ball(10, 2)) == 56


@pytest.mark.parametrize("segments", [2, 3, 4, 6])
def test_near_fingerprints(spark, segments):
    draw = random.Random(segments)
    values = set()
    for _ in range(60):
        base = draw.getrandbits(64)
        values |= {base} | {base ^ sum(1 << b for b in draw.sample(range(64), draw.randint(1, 6))) for _ in range(4)}
    values |= {0, 1, 3, 2**64 - 1, 2**64 - 2}
    signed = [v - 2**64 if v >> 63 else v for v in values]
    found = near_fingerprints(spark.createDataFrame([(v,) for v in signed], "fingerprint long"), segments=segments).collect()
    want = {(a, b) for a in signed for b in signed if a < b and ((a ^ b) & (2**64 - 1)).bit_count() <= 4}
    assert {tuple(r) for r in found} == want and len(found) == len(want)


def test_links(spark):
    draw = random.Random(1)
    chain = [(i, i + 1) for i in range(1000, 1060)]
    star = [(5, i) for i in range(200, 260)]
    pairs = chain + star + [(draw.randint(0, 90), draw.randint(0, 90)) for _ in range(60)] + [(7, 7), (1001, 1000)]
    near = {}
    for a, b in pairs:
        near.setdefault(a, set()).add(b)
        near.setdefault(b, set()).add(a)
    found = {r["node"]: r["root"] for r in smallest_reachable(spark.createDataFrame(pairs, "a long, b long")).collect()}
    for node in near:
        seen, todo = {node}, [node]
        while todo:
            todo += [n for n in near[todo.pop()] if n not in seen and not seen.add(n)]
        assert found.get(node, node) == min(seen)
    assert smallest_reachable(spark.createDataFrame([], "a long, b long")).count() == 0


def test_near_copies(spark):
    draw = random.Random(2)
    vocabulary = ["lake", "peak", "Ridge", "valley", "über", "río", "north", "south", "tile", "contour"]
    rows = []
    for i in range(40):
        words = [draw.choice(vocabulary) for _ in range(draw.choice([1, 3, 5, 80, 300]))]
        rows.append((i, " ".join(words)))
        for n in range(draw.randint(0, 3)):
            other = list(words)
            other[draw.randrange(len(other))] = "changed"
            rows.append((100 + 10 * i + n, " ".join(other)))
    rows += [(900, None), (901, ""), (902, " \n"), (3, "repeated id"), (3, "repeated id"), (None, rows[0][1]), (None, "alone without an id at all"), (950, "word " * 20000)]
    frame = spark.createDataFrame(rows, SCHEMA).selectExpr("response_id", "body", "1 fingerprint", "2 component_id", "'x' node")
    found = near_copies(frame)
    assert found.columns == ["response_id", "fingerprint", "component_id"]
    assert sorted(map(tuple, found.collect()), key=repr) == sorted(brute_components(rows), key=repr)


def test_empty(spark):
    assert near_copies(spark.createDataFrame([], SCHEMA)).count() == 0
