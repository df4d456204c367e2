import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from isoterra.llm.language import LONGEST, UNKNOWN, Judge, Network, held_out, identify_language, train, words_of

SCHEMA = "place_id long, name string, lang string"
WORDS = {"de": "der die und See Höhe Berg große Straße über Tal".split(), "es": "el la río peña sierra año monte señor valle y".split(), "en": "the of lake mountain ridge north creek hill valley and".split()}


def names(n, start=0):
    draw = random.Random(start)
    return [(start + i, " ".join(draw.choice(WORDS[lang]) for _ in range(draw.randint(3, 15))), lang) for i in range(n) for lang in [draw.choice(list(WORDS))]]


def test_gradients():
    network = Network.new(["a", "b", "c"], hidden=3)
    network.weights = {k: w.astype(np.float64) for k, w in network.weights.items()}
    data, targets = np.array([[97, 98, 97, 200], [1, 98, 3, 97]], np.uint8), np.array([2, 0])
    # Central differences in double precision against backpropagation through time.
    _, grads = network.gradients(data, targets)
    for name, weight in network.weights.items():
        flat = [tuple(i) for i in np.argwhere(np.abs(grads[name]) > 1e-7)[:12]]
        assert flat
        for place in flat:
            old, step = weight[place], 1e-3
            weight[place] = old + step
            up = network.gradients(data, targets)[0]
            weight[place] = old - step
            down = network.gradients(data, targets)[0]
            weight[place] = old
            assert grads[name][place] == pytest.approx((up - down) / (2 * step), rel=2e-3, abs=2e-5)


def test_accuracy(spark):
    taught, asked = names(400), names(120, 1000)
    asked += [(1, None, "de"), (2, "", "de"), (3, " 12 -- 3", None), (4, "über " * 30000, "x"), (4, "the lake", None), (None, "la sierra", None)]
    labelled = spark.createDataFrame([*taught, (9, None, "de"), (10, "xx", None)], SCHEMA)
    places = spark.createDataFrame(asked, SCHEMA).selectExpr("place_id", "name", "1 key", "2 score", "'zz' lang_pred")
    found = identify_language(places.repartition(2), labelled, steps=200)
    assert found.columns == ["place_id", "lang_pred", "score"]
    rows = found.collect()
    assert len(rows) == len(asked) and all(0 <= r["score"] <= 1 for r in rows)
    told = {k: lang for k, _, lang in asked if k and k >= 1000}
    right = sum(r["lang_pred"] == told[r["place_id"]] for r in rows if r["place_id"] in told)
    assert right >= 0.97 * len(told)
    assert {(r["place_id"], r["lang_pred"], r["score"]) for r in rows if r["place_id"] in (1, 2, 3)} == {(n, UNKNOWN, 0.0) for n in (1, 2, 3)}
    assert ("de" in [r["lang_pred"] for r in rows if r["place_id"] == 4]) and len([r for r in rows if r["place_id"] == 4]) == 2


def test_carried_columns_and_small_parts(spark, monkeypatch):
    from isoterra.llm import batches

    monkeypatch.setattr(batches, "SLICE_BYTES", 40)
    asked = names(30, 500)
    frame = spark.createDataFrame(asked, SCHEMA).selectExpr("place_id", "name", "lang", "place_id * 2 as score", "name as key")
    found = identify_language(frame, spark.createDataFrame(names(60), SCHEMA), steps=20, carried=["name", "lang"])
    assert found.columns == ["name", "lang", "place_id", "lang_pred", "score"]
    assert sorted((r["place_id"], r["name"], r["lang"]) for r in found.collect()) == sorted(asked)


def test_nothing_to_learn_from_and_empty(spark):
    frame = spark.createDataFrame([(1, "a name", None)], SCHEMA)
    assert tuple(identify_language(frame, frame).first()) == (1, UNKNOWN, 0.0)
    assert identify_language(frame.limit(0), frame).count() == 0


def test_pooling_covers_whole_names():
    network = train([(lang, w.lower(), 1) for lang, words in WORDS.items() for w in words], steps=60)
    judge, long = Judge(network, kept=2), "x" * (3 * LONGEST + 5)
    for name in ["Der See", long, f"{long} der der", "ä" * 40]:
        total, size = 0, 0
        for word in words_of(name):
            data = word.encode()
            for at in range(0, len(data), LONGEST):
                part = np.frombuffer(data[at : at + LONGEST], np.uint8)[None]
                total, size = total + network.label(part).sum(axis=(0, 1)), size + part.shape[1]
        lang, score = judge.pool([name])[0]
        assert lang == network.languages[int(np.argmax(total))] and score == pytest.approx(total.max() / size, rel=1e-4)


def test_held_out(spark):
    import zlib

    rows = spark.range(50).select("id", held_out(F.col("id")).alias("h")).collect()
    assert all(r["h"] == (zlib.crc32(str(r["id"]).encode()) % 4 == 2) for r in rows)
