"""The registered queries on the smallest tables: against their SQL, or against brute force."""

import zlib

import public_tokenizers
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from checks.compare import compare, connect
from isoterra.llm.queries import ORACLES, QUERIES, SURROGATE_KEY
from isoterra.llm.surrogates import mentions
from tests.llm.test_fertility import brute as brute_counts
from tests.llm.test_repeats import brute as brute_repeats
from tests.llm.test_simhash import brute_components
from tests.llm.test_tokens import BYTES, WORDS, library_ids

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def documents(spark):
    return [tuple(r) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").orderBy("doc_id").collect()]


@pytest.mark.parametrize("name", ORACLES)
def test_sql(spark, name):
    assert compare(spark, connect(SF), name, QUERIES[name], ORACLES[name], SF) is None


def test_near_copies(spark, documents):
    found = QUERIES["op1_simhash"](spark, SF).select("doc_id", "fingerprint", "component_id").collect()
    assert sorted(map(tuple, found)) == sorted(brute_components(documents))


def test_repeats(spark, documents):
    found = QUERIES["op3_repeats"](spark, SF).orderBy("doc_id").collect()
    assert [tuple(r) for r in found] == [r[:5] for r in brute_repeats(documents)]


def test_fertility(spark, documents):
    found = QUERIES["op4_fertility"](spark, SF).orderBy("doc_id").collect()
    assert [tuple(r)[:7] for r in found] == [(k, *brute_counts(t)) for k, t in documents]
    quality = dict(map(tuple, spark.read.parquet(f"{SF}/labels.parquet").select("doc_id", "quality").collect()))
    good = [r for r in found if quality.get(r["doc_id"]) == 1 and not r["base_failed"]]
    assert good and all(r["kept"] for r in good)


def test_surrogates(spark, documents):
    found = {r["doc_id"]: r for r in QUERIES["op5_surrogates"](spark, SF).collect()}
    originals = {(m.kind, m.canonical) for _, t in documents for m in mentions(t or "")}
    assert len(found) == len(documents) and len(originals) > 5 and SURROGATE_KEY
    for key, text in documents:
        own, new = mentions(text or ""), mentions(found[key]["text"] or "")
        assert found[key]["n_entities"] == len(own)
        assert own or found[key]["text"] == text
        assert not originals & {(m.kind, m.canonical) for m in new}


def test_token_files(spark, documents):
    start, want = 0, []
    for key, text in documents:
        ids = library_ids(BYTES, text, 0)
        want.append((key, start, len(ids), zlib.crc32(ids.tobytes())))
        start += len(ids)
    assert [tuple(r) for r in QUERIES["op9_token_files"](spark, SF).orderBy("doc_id").collect()] == want


def check_pieces(documents, pieces):
    ids = {k: library_ids(WORDS, t, 2) for k, t in documents}
    given = dict.fromkeys(ids, 0)
    filled = {}
    for p in pieces:
        own = ids[p["doc_id"]]
        assert p["start"] == given[p["doc_id"]] and p["doc_tokens"] == len(own)
        assert p["ids_crc32"] == zlib.crc32(own[p["start"] : p["start"] + p["length"]].tobytes())
        assert p["offset"] == filled.get(p["sequence_id"], 0)
        given[p["doc_id"]] += p["length"]
        filled[p["sequence_id"]] = p["offset"] + p["length"]
    assert given == {k: len(i) for k, i in ids.items()} and max(filled.values()) <= 4096


def test_packing(spark, documents):
    check_pieces(documents, QUERIES["op8_packing"](spark, SF).orderBy("sequence_id", "offset").collect())


def test_language(spark, documents):
    found = QUERIES["op10_language"](spark, SF).collect()
    assert len(found) == len(documents) and public_tokenizers
    lang = dict(map(tuple, spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "lang").collect()))
    held = [r for r in found if r["held_out"]]
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2) for r in found)
    assert sum(r["lang_pred"] == lang[r["doc_id"]] for r in held) >= 0.95 * len(held)


def test_pipeline(spark, documents):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns, results = docs.columns, {}
    folder = f"{SF}"
    for name, stage in corpus_pipeline.STAGES:
        docs = corpus_pipeline.cut(stage(spark, docs, folder))
        results[name] = docs
    assert all(results[n].columns == columns for n in list(results)[:-1])
    rows = {n: dict(map(tuple, results[n].select("doc_id", "text").collect())) for n in list(results)[:-1]}
    told = dict(documents)
    assert set(rows["language"]) <= set(told) and len(rows["language"]) >= 0.97 * len(told)
    groups = brute_components(list(rows["language"].items()))
    assert set(rows["near_duplicates"]) == {k for k, _, c in groups if k == c}
    bad = {r["doc_id"] for r in QUERIES["op2_decontamination"](spark, SF).where("contaminated").collect()}
    assert set(rows["decontamination"]) == set(rows["near_duplicates"]) - bad
    spans = {r["doc_id"]: r["spans"] for r in QUERIES["op6_secrets"](spark, SF).collect()}
    for key, text in rows["secrets"].items():
        assert ("[secret]" in text) == bool(spans[key]) and (spans[key] or text == told[key])
    assert set(rows["secrets"]) == set(rows["decontamination"])
    check_pieces(list(rows["secrets"].items()), results["packing"].orderBy("sequence_id", "offset").collect())
    whole = corpus_pipeline.run(spark, SF)
    assert whole.agg(F.sum("length")).first() == results["packing"].agg(F.sum("length")).first()


def test_pipeline_on_awkward_rows(spark, tmp_path):
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    rows = [(1, None, None, None, None), (2, "", "en", "s", 0), (None, "the lake and the ridge of the north " * 5, None, None, 3), (3, "token = abcdef123 the lake", "en", "s", 9), (3, "token = abcdef123 the lake", "en", "s", 9)]
    spark.createDataFrame(rows, schema).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    pieces = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert sorted([p["doc_id"] for p in pieces], key=str) == [3, None]
    empty = tmp_path / "empty"
    spark.createDataFrame([], schema).write.parquet(f"{empty}/documents.parquet")
    spark.createDataFrame([], "item_id long, text string").write.parquet(f"{empty}/benchmark.parquet")
    assert corpus_pipeline.run(spark, str(empty)).count() == 0


def test_pipeline_decides_by_row(spark, tmp_path):
    columns = "doc_id long, text string, lang string, source string, n_chars long"
    item = "which of the four lakes lies between the two highest peaks of the range"
    clean, other = "rain fell on every roof of the quiet town that night", "a short note about boats and their painted sails"
    rows = [(7, f"see: {item}, he asked", "en", "s", 1), (7, clean, "en", "s", 2), (None, other, "en", "s", 3), (None, item, "en", "s", 4), (8, clean, None, "t", 5), (8, clean, None, "t", 5)]
    docs = spark.createDataFrame(rows, columns)
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")

    def left(stage, given):
        return sorted(map(tuple, stage(spark, given, str(tmp_path)).collect()), key=str)

    assert left(corpus_pipeline.decontamination, docs) == sorted([r for r in rows if item not in r[1]], key=str)
    assert left(corpus_pipeline.near_duplicates, docs) == sorted(rows[:4], key=str)
    assert left(corpus_pipeline.near_duplicates, docs.where("doc_id = 8")) == [rows[4]]
