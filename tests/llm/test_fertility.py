import math
import random
import re
from collections import Counter

import public_tokenizers
import pytest

from isoterra.llm.fertility import BANDS, Band, duplicate_lines, judge_names, repeated_words, script_of

VOCABULARY = public_tokenizers.path("piece_bpe_32k.model")
SCHEMA = "place_id long, name string"


def brute(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    runs = Counter(tuple(words[i : i + 5]) for i in range(len(words) - 4))
    inside = {j for i in range(len(words) - 4) if runs[tuple(words[i : i + 5])] > 1 for j in range(i, i + 5)}
    lines, again = [], 0
    for line in text.split("\n"):
        again += bool(re.search(r"[^\x20\x09-\x0D]", line)) and line in lines
        lines.append(line)
    failed = len(words) < 10 or 100 * len(inside) > 20 * len(words)
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), again, len(inside), failed


def texts():
    draw = random.Random(1)
    out = [None, "", " \n\n", "one", "a b c d e a b c d e", "x " * 300, "x\x1cy \x0b z\xa0w", "日本語 の テキスト", "a\n\n\nb\na\n a\nb", "#*$%&|<> ##"]
    for _ in range(40):
        words = [draw.choice(["peak", "lake", "Höhe", "río", "of", "the"]) for _ in range(draw.randint(1, 60))]
        out.append("".join(w + draw.choice([" ", " ", "\n", "  "]) for w in words))
    return [*out, "the long way up to the summit of the mountain " * 4000]


def test_counts(spark):
    import sentencepiece

    rows = list(enumerate(texts())) + [(3, "repeated id"), (None, "no id")]
    frame = spark.createDataFrame(rows, SCHEMA).selectExpr("place_id", "name", "1 key", "2 kept", "3 n_words")
    found = judge_names(frame.repartition(2), VOCABULARY).collect()
    assert len(found) == len(rows)
    want = Counter((key, *brute(text)) for key, text in rows)
    assert Counter((r["place_id"], *tuple(r)[1:7]) for r in found) == want
    pieces = sentencepiece.SentencePieceProcessor(model_file=VOCABULARY)
    told = dict(rows[:40])
    for r in found:
        if r["place_id"] in told and r["place_id"] not in (3, None):
            words = re.findall(r"[^\x20\x09-\x0D]+", told[r["place_id"]] or "")
            ids = [i for w in words for i in pieces.encode(w)]
            shares = [c / len(ids) for c in Counter(ids).values()]
            assert r["n_tokens"] == len(ids)
            assert r["token_entropy"] == pytest.approx(-sum(s * math.log2(s) for s in shares))
            assert r["byte_share"] == pytest.approx(sum(pieces.is_byte(i) for i in ids) / max(1, len(ids)))
    assert all(not (r["base_failed"] and r["kept"]) for r in found)


def test_bands(spark):
    prose = "The summit lies north of the lake and is reached by a long ridge above the glacier. "
    noise = " ".join(chr(0xE000 + i) * 3 for i in range(40))
    frame = spark.createDataFrame([(1, prose), (2, noise), (3, prose + prose[::-1])], SCHEMA)
    kept = {r["place_id"]: r["kept"] for r in judge_names(frame, VOCABULARY).collect()}
    assert kept[1] and kept[3]
    strict = {**BANDS, "other": Band(1.0, 8.0, 0.1, 0.0), "latin": Band(50.0, 80.0, 0.1, 0.0)}
    assert not any(r["kept"] for r in judge_names(frame, VOCABULARY, bands=strict).collect())


def test_pieces():
    assert repeated_words([]) == repeated_words([b"a"] * 5) == 0 and repeated_words([b"a"] * 6) == 6
    assert duplicate_lines("a\na\n\n\na") == 2
    assert [script_of(t) for t in ("", "12", "abc", "Größe", "гора", "βουνό", "日本", "한국", "جبل")] == ["other", "other", "latin", "latin", "cyrillic", "greek", "cjk", "cjk", "arabic"]


def test_empty(spark):
    assert judge_names(spark.createDataFrame([], SCHEMA), VOCABULARY).count() == 0
