import hashlib
import random
import re

from isoterra.llm.contamination import automaton, find_contamination, matches, normal_words, windows

SCHEMA, ITEMS = "response_id long, body string", "item_id long, text string"


def words(text):
    lower = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower)


def brute(bodies, items, size=10):
    out = []
    for key, body in bodies:
        own, hit, met = words(body), set(), set()
        for item, text in items:
            their = words(text)
            parts = [their] if 0 < len(their) < size else [their[i : i + size] for i in range(len(their) - size + 1)]
            for part in parts:
                for i in range(len(own) - len(part) + 1):
                    if own[i : i + len(part)] == part:
                        hit |= set(range(i, i + len(part)))
                        met.add(str(item))
        ids = hashlib.sha256(",".join(sorted(met)).encode()).hexdigest()
        out.append((key, len(own), len(hit), len(met), ids, bool(hit)))
    return sorted(out, key=repr)


def tables():
    draw = random.Random(1)
    vocabulary = ["lake", "Peak", "río", "über", "a", "b1", "2", "north", "NORTH"]
    items = [(n, " ".join(draw.choice(vocabulary) for _ in range(draw.choice([1, 4, 9, 10, 11, 30])))) for n in range(12)]
    items += [(100, None), (101, "?!"), (102, "unique only here"), (3, items[3][1]), (None, "an item without any id at all")]
    bodies = [(1, None), (2, ""), (3, " -- "), (4, "Unique—only? here: no"), (5, "unique; ONLY,\nhere!"), (9, "an item without any id at all")]
    for n in range(10, 60):
        text = " ".join(draw.choice(vocabulary) for _ in range(draw.randint(0, 60)))
        bodies.append((n, f"{text}... {draw.choice(items)[1]}!" if n % 2 else text))
    bodies += [(10, "repeated id"), (None, "unique only here"), (70, "x " * 50000 + "unique only here")]
    return bodies, items


def test_find_contamination(spark):
    bodies, items = tables()
    frame = spark.createDataFrame(bodies, SCHEMA).selectExpr("response_id", "body", "1 id", "2 text", "3 item_id")
    held = spark.createDataFrame(items, ITEMS).selectExpr("item_id", "text", "1 item", "2 body")
    want = brute(bodies, items)
    for limit in (16_000_000, 60):
        found = find_contamination(frame.repartition(2), held, automaton_chars=limit)
        assert found.columns == ["response_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated", "spans"]
        rows = found.collect()
        assert sorted((tuple(r)[:6] for r in rows), key=repr) == want


def test_spans_are_places_of_the_original(spark):
    body = "Über—größe: SEE, the   Peak; of (north) and then some"
    items = spark.createDataFrame([(1, "see the peak of north")], ITEMS)
    row = find_contamination(spark.createDataFrame([(1, body)], SCHEMA), items).first()
    assert [body[s["start"] : s["end"]] for s in row["spans"]] == ["SEE, the   Peak; of (north"]


def test_empty(spark):
    bodies, items = spark.createDataFrame([(1, "a b")], SCHEMA), spark.createDataFrame([(1, "a b")], ITEMS)
    assert find_contamination(bodies.limit(0), items).count() == 0
    assert tuple(find_contamination(bodies, items.limit(0)).first())[1:4] == (2, 0, 0)


def test_overlapping_windows():
    found = automaton([(1, "a b c"), (2, "b c"), (3, "c")])
    assert sorted(matches(found, normal_words("A b. c"))) == [(0, 3, (1,)), (1, 3, (2,)), (2, 3, (3,))]
    assert windows([b"a"] * 12) == [b" ".join([b"a"] * 10)] * 3
