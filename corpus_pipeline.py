"""A training corpus from documents: five stages, each one of the numbered operators.

`run` writes every stage's result to the shared folder and reads it again as the next one's input.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from isoterra.llm.contamination import find_contamination
from isoterra.llm.language import UNKNOWN, held_out, identify_language
from isoterra.llm.packing import pack_places
from isoterra.llm.queries import as_log, as_places, as_responses, table
from isoterra.llm.secrets import find_secrets, masked
from isoterra.llm.simhash import near_copies
from isoterra.spread import cut

# Below this mean probability the language of a document counts as unknown.
LEAST_SCORE = 0.3


def _numbered(docs: DataFrame) -> DataFrame:
    """The documents, each row with a number of its own; written, so that the number is the same in every use.

    Stages decide by row: rows may share an id or have none, and each is kept or dropped on its own.
    """
    return cut(docs.withColumn("_row", F.monotonically_increasing_id()))


def _only(rows: DataFrame, chosen: DataFrame) -> DataFrame:
    """The numbered documents whose number is chosen, once each."""
    return rows.join(chosen.select("_row"), "_row", "left_semi").drop("_row")


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep documents whose language can be told; the network learns from the labelled ones not held out.

    Texts that are null, empty or without a letter go; rows are judged one by one; an empty table stays empty.
    """
    places = as_places(docs).select("place_id", "name", "lang", "source", "n_chars")
    labelled = places.where(~held_out(F.col("place_id")))
    judged = identify_language(places, labelled, carried=["name", "lang", "source", "n_chars"])
    sure = judged.where((F.col("lang_pred") != UNKNOWN) & (F.col("score") >= LEAST_SCORE))
    return sure.select(F.col("place_id").alias("doc_id"), F.col("name").alias("text"), "lang", "source", "n_chars")


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep of each group of near copies the document with the smallest id, a row without an id after all others.

    Null and empty texts are copies of each other, equal rows too, so one of them stays; an empty table stays empty.
    """
    rows = _numbered(docs)
    groups = near_copies(as_responses(rows.select(F.col("_row").alias("doc_id"), "text"))).withColumnRenamed("response_id", "_row")
    placed = rows.select("_row", "doc_id").join(groups.select("_row", "component_id"), "_row")
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "_row")).alias("first")
    return _only(rows, placed.groupBy("component_id").agg(first).select("first._row"))


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents with a passage of a benchmark item; null and empty texts, and all where there are no items, stay."""
    rows = _numbered(docs)
    bodies = as_responses(rows.select(F.col("_row").alias("doc_id"), "text"))
    found = find_contamination(bodies, table(spark, sf_dir, "benchmark", "item_id", "text"))
    return _only(rows, found.where("not contaminated").withColumnRenamed("response_id", "_row"))


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replace secrets inside the texts by a mask; the documents stay, those with null or empty texts unchanged."""
    found = find_secrets(as_log(docs))
    clean = masked(F.col("line"), F.col("secrets"))
    changed = F.size("secrets") > 0
    return found.select(
        F.col("entry_id").alias("doc_id"), F.when(changed, clean).otherwise(F.col("line")).alias("text"), "lang", "source",
        F.when(changed, F.char_length(clean).cast("long")).otherwise(F.col("n_chars")).alias("n_chars"),
    )


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sequences of at most 4096 tokens, as pieces of documents; a null or empty text has its end token only."""
    places = as_places(docs.select("doc_id", "text"))
    return pack_places(places, public_tokenizers.path("word_bpe_49k.json")).withColumnRenamed("place_id", "doc_id")


STAGES = [
    ("language", language),
    ("near_duplicates", near_duplicates),
    ("decontamination", decontamination),
    ("secrets", secrets),
    ("packing", packing),
]
# Neither the recurrent network, the fingerprints nor the tokens can be said in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents table."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES:
        docs = cut(stage(spark, docs, sf_dir))
    return docs
