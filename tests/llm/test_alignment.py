import hashlib
import json
import random
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers as tokens
import pytest

from isoterra.llm.alignment import PAIR, aligned_names, bits_of, indexed_names, pair_counts, postings
from isoterra.operators.places import parse_geocoder

FIRST, SECOND = tokens.path("byte_bpe_50k.json"), tokens.path("piece_bpe_32k.model")
COLUMNS = ["place_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]


@pytest.fixture(scope="module")
def libraries():
    import sentencepiece
    from tokenizers import Tokenizer

    first = Tokenizer.from_file(FIRST)
    first.encode_special_tokens = True
    second = sentencepiece.SentencePieceProcessor(model_file=SECOND)
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    written = {chr(b): b for b in shown} | {chr(256 + n): b for n, b in enumerate(b for b in range(256) if b not in shown)}
    spelt = {n: bytes(written.get(c, 0) for c in e) for e, n in first.get_vocab().items()}

    def piece(n):
        p = second.id_to_piece(n)
        return bytes([int(p[3:5], 16)]) if second.is_byte(n) else p.replace("▁", " ").encode()

    return first, second, spelt, piece


def brute(rows, libraries):
    """Whole texts by the libraries, all pairs of tokens compared by their byte ranges."""
    first, second, spelt, piece = libraries
    held, links, count = [], [], Counter()
    for key, text in rows:
        a = first.encode(" " + text, add_special_tokens=False).ids if text else []
        b = second.encode(text) if text else []
        parts = [[spelt[n] for n in a], [piece(n) for n in b]]
        if not text or any(b"".join(p) != b" " + text.encode() for p in parts):
            held.append((key, 0, 0, 0, 0, ""))
            links.append([])
            continue
        ends = [np.cumsum([len(x) for x in p]).tolist() for p in parts]
        begins = [[0, *e[:-1]] for e in ends]
        both = sorted(set(ends[0]) & set(ends[1]))
        groups, at = [], [0, 0]
        for stop in both:
            sides = []
            for n, ids in enumerate((a, b)):
                to = ends[n].index(stop) + 1
                sides.append(",".join(map(str, ids[at[n] : to])))
                at[n] = to
            groups.append("|".join(sides))
        own, low = [], 0
        for s, e, n in zip(begins[0], ends[0], a):
            while ends[1][low] <= s:
                low += 1
            j = low
            while j < len(b) and begins[1][j] < e:
                own.append((n, b[j]))
                j += 1
        links.append(own)
        count.update(own)
        held.append((key, len(a), len(b), len(groups), len(own), hashlib.sha256(";".join(groups).encode()).hexdigest()))
    most = defaultdict(int)
    for (_, b), n in count.items():
        most[b] = max(most[b], n)
    told = [(*h[:5], sum(count[p] == most[p[1]] for p in own), sum(count[p] for p in own), h[5]) for h, own in zip(held, links)]
    return told, count, links


def found(df):
    return sorted([tuple(r) for r in df.select(*COLUMNS).collect()], key=str)


def odd_texts():
    return [
        None, "", " ", "  ", "\n", "a", " a", "a ", "a  b", "a \n b", "\ta b\t", "one two three", "<|endoftext|> <s> </s> <0x41> x", "a▁b c",
        "▁", "naïve café 中文 рус \U0001f600 x", "word" * 400, "x" * 5000 + " y", " " * 900, "\x00 \x1c \x85 z",
        "don't they're 123456 $%^&", "ﬁ é ​ ﻿ end",
    ]


def test_odd_texts(spark, libraries):
    rows = list(enumerate(odd_texts())) + [(3, "  "), (None, "a b"), (None, None), (5, "a")]
    table = spark.createDataFrame([(k, t, 1, 2) for k, t in rows], "place_id long, name string, pair int, n_a int")
    want, _, _ = brute(rows, libraries)
    assert found(aligned_names(table, FIRST, SECOND, ["place_id"])) == sorted(want, key=str)
    assert found(aligned_names(table.limit(0), FIRST, SECOND, ["place_id"])) == []


def test_random_texts(spark, libraries):
    draw = random.Random(7)
    words = ["the", "Berg", "river", "strasse", "über", "Tür", "a", "42", "x,y", "中", "end.\n", "\tq", "", "nord-west"]
    rows = [(n, " ".join(draw.choices(words, k=draw.randint(0, 60)))) for n in range(120)]
    rows += [(n + 1000, rows[3][1]) for n in range(40)]
    table = spark.createDataFrame(rows, "place_id long, name string").repartition(5)
    want, count, links = brute(rows, libraries)
    assert found(aligned_names(table, FIRST, SECOND, ["place_id"])) == sorted(want, key=str)
    pairs = {(r.first_id, r.second_id): (r.names, r.links) for r in pair_counts(indexed_names(table, FIRST, SECOND, ["place_id"])).collect()}
    holds = Counter(p for own in links for p in set(own))
    assert pairs == {p: (holds[p], n) for p, n in count.items()}


def test_bitmaps():
    draw = np.random.default_rng(1)
    entries = sorted({(int(p), int(n)) for p, n in zip(draw.integers(0, 6, 900) ** 2, draw.integers(0, 200, 900))})
    pair, name = np.array([e[0] for e in entries]), np.array([e[1] for e in entries])
    count = draw.choice([1, 1, 2, 3, 8, 9, 1000], len(entries))
    back, forms = Counter(), set()
    for keys, planes, form, data in postings(name, pair, count, 200):
        row, place = bits_of(form, data)
        forms.add(form)
        for r, p in zip(row, place):
            back[int(keys[r]), int(p)] += 1 << max(0, int(planes[r]) - 1)
    assert back == dict(zip(entries, count.tolist())) and forms == {0, 1}


def test_on_geocoder_places(spark, libraries):
    texts = [["Lago Maggiore, Ticino", "Maggiore"], ["Lago di Como"]]
    bodies = [(f"r{n}", json.dumps([{"display_name": t, "lat": "1", "lon": "2"} for t in some])) for n, some in enumerate(texts)]
    places = parse_geocoder(spark.createDataFrame(bodies, "response_id string, body string"))
    rows = [((f"r{n}", m), t) for n, some in enumerate(texts) for m, t in enumerate(some)]
    got = aligned_names(places, FIRST, SECOND).collect()
    want, _, _ = brute(rows, libraries)
    assert sorted(((r.response_id, r.position), *r[2:]) for r in got) == sorted(want)
    assert PAIR > 2**16
