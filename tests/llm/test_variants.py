import json
import random
import zlib
from collections import Counter

import numpy as np
import pytest

from isoterra.llm.variants import Points, near_words, single_edits, spelling_variants
from isoterra.operators.places import parse_geocoder


def letters(text):
    run, out = "", []
    for c in (text or "") + "\n":
        if "A" <= c <= "Z" or "a" <= c <= "z" or "À" <= c <= "ÿ":
            run += chr(ord(c) + 32) if "A" <= c <= "Z" else c
        elif run:
            out.append(run)
            run = ""
    return out


def edit_one(a, b):
    """Whether one edit makes b of a, by trying all places."""
    if a == b:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    short, long = sorted((a, b), key=len)
    return len(long) == len(short) + 1 and any(long[:i] + long[i + 1 :] == short for i in range(len(long)))


def brute(rows, every=97, length=5, count=3):
    seen = Counter()
    for key, text in rows:
        for word in letters(text):
            crc = zlib.crc32(f"{key}:{word}".encode())
            if crc % every == 0:
                word = word[: crc % len(word)] + word[crc % len(word) + 1 :]
            seen[word] += 1
    n = {w: c for w, c in seen.items() if c >= count and len(w) >= length}
    out = {}
    for w in n:
        near = [v for v in n if edit_one(w, v)]
        best = min(near, key=lambda v: (-n[v], v), default=None)
        out[w] = [best if best is not None and n[best] >= 2 * n[w] else None, n[w], len(near)]
    result = set()
    for w, (form, own, near) in out.items():
        root = w
        while out[root][0] is not None:
            root = out[root][0]
        result.add((w, form, root, own, near, n[form] if form else None))
    return result


def found(df):
    return [tuple(r) for r in df.select("word", "form", "root", "n", "n_near", "form_n").collect()]


def names(draw, size):
    base = ["".join(draw.choices("abcé", k=draw.randint(4, 9))) for _ in range(25)]
    rows = []
    for key in range(size):
        words = []
        for _ in range(draw.randint(0, 30)):
            w = draw.choice(base)
            if draw.random() < 0.3:
                i = draw.randrange(len(w) + 1)
                w = draw.choice([w[:i] + w[i + 1 :], w[:i] + draw.choice("abcéZ") + w[i:], w[:i] + draw.choice("abcA") + w[i + 1 :]])
            words.append(draw.choice([w, w.upper() if w.isascii() else w]))
        rows.append((key, draw.choice([" ", ", ", "\n", "-"]).join(words)))
    return rows


@pytest.mark.parametrize("seed, tile", [(1, 128), (2, 2), (3, 5)])
def test_against_brute_force(spark, seed, tile):
    rows = names(random.Random(seed), 60)
    got = found(spelling_variants(spark.createDataFrame(rows, "place_id long, name string"), ["place_id"], slip_every=7, tile=tile))
    want = brute(rows, 7)
    assert len(got) == len(set(got)) and set(got) == want
    assert any(form for _, form, *_ in want) and len(want) > 20


def test_awkward_rows(spark):
    huge = "x" * 200_000
    rows = [(None, "Hamlet Hamlet Hamlet"), (1, None), (2, ""), (2, " \n0 9"), (3, "HAMLETT hamlets hamlet"), (3, "HAMLETT hamlets hamlet")]
    rows += [(4, huge), (5, huge), (6, huge + "y"), (7, huge), (8, "ÀÉÿab " * 3), (9, "×÷×÷× " * 3)]
    rows += [(10, "hamletx " * 3 + "Hamletx"), (11, "Ābcdef " * 5)]
    table = spark.createDataFrame([(k, t, "clash", 1) for k, t in rows], "place_id long, name string, word string, n int")
    got = found(spelling_variants(table, ["place_id"]))
    want = brute([("" if k is None else k, t) for k, t in rows])
    assert set(got) == want and len(got) == len(want)
    assert found(spelling_variants(table.limit(0), ["place_id"])) == []


def test_ties_and_chains(spark):
    # aaaab is near to two words of equal counts; chains lead on to the most frequent word.
    text = ["aaaaab"] * 3 + ["aaaab"] * 6 + ["aaaabd"] * 12 + ["aaaabc"] * 12 + ["aabc"] * 40 + ["aaabc"] * 24 + ["aaaac"] * 6
    rows = [(n, w) for n, w in enumerate(text)]
    got = {r[0]: r for r in found(spelling_variants(spark.createDataFrame(rows, "place_id long, name string"), ["place_id"], slip_every=10**9))}
    assert set(got.values()) == brute(rows, 10**9)
    assert got["aaaab"][1] == "aaaabc" and got["aaaaab"][2] == "aaabc"


def test_hot_keys_meet_in_blocks(spark):
    # All words share front and length: blocks of one key meet pairwise, and each pair once.
    words = sorted({f"same{a}{b}{c}" for a in "abcdef" for b in "abcdef" for c in "abcdefg"})
    pairs = [tuple(r) for r in near_words(spark.createDataFrame([(w,) for w in words], "word string"), 16).collect()]
    want = {(a, b) for a in words for b in words if a < b and edit_one(a, b)}
    assert len(pairs) == len(want) and {tuple(sorted(p)) for p in pairs} == want


def test_matrix_of_single_edits():
    draw = random.Random(5)
    for longer in range(1, 7):
        words = sorted({"".join(draw.choices("ab\U0001f600", k=draw.choice([longer, max(0, longer - 1)]))) for _ in range(60)})
        size = np.array([len(w) for w in words])
        i, j, _ = single_edits(Points(words, longer), np.flatnonzero(size == longer), np.arange(len(words)), longer)
        want = {(a, b) for a in words for b in words if len(a) == longer and edit_one(a, b)}
        assert {(words[a], words[b]) for a, b in zip(i, j)} == want and len(i) == len(want)


def test_on_geocoder_places(spark):
    def body(*texts):
        return json.dumps([{"display_name": t, "lat": "1", "lon": "2"} for t in texts])

    rows = [("a", body("Sankt Gallen", "St. Gallen", "Gallen")), ("b", body("Sankt Galen, Gallen")), ("c", body("Galen Galen Gallen Gallen Gallen"))]
    responses = spark.createDataFrame(rows, "response_id string, body string")
    places = parse_geocoder(responses)
    got = {r[0]: r for r in found(spelling_variants(places, slip_every=10**9))}
    assert got["galen"] == ("galen", "gallen", "gallen", 3, 1, 7)
