"""The numbered operators applied to the given tables, with SQL where SQL can say the same.

Every query only maps a given table to an operator's columns and its results back.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from isoterra.llm.alignment import aligned_names
from isoterra.llm.archive import read_archive, write_archive
from isoterra.llm.contamination import find_contamination
from isoterra.llm.facets import alike_facets
from isoterra.llm.fertility import judge_names
from isoterra.llm.language import held_out, identify_language
from isoterra.llm.packing import pack_places
from isoterra.llm.repeats import repeated_runs
from isoterra.llm.secrets import BASE, RULES, find_secrets, span_text
from isoterra.llm.simhash import near_copies
from isoterra.llm.surrogates import replace_personal
from isoterra.llm.tokenfile import read_token_files, write_token_files
from isoterra.llm.variants import spelling_variants

# Key of the surrogates in these queries; a user keeps an own one secret.
SURROGATE_KEY = b"isoterra example key"
ARCHIVE_DATE = "2024-01-01T00:00:00Z"


def table(spark: SparkSession, sf: str, name: str, *columns: str | Column) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet").select(*columns)


def as_places(documents: DataFrame) -> DataFrame:
    """Documents as places: the text is the name."""
    return documents.withColumnsRenamed({"doc_id": "place_id", "text": "name"})


def as_responses(documents: DataFrame) -> DataFrame:
    """Documents as stored responses: the text is the body."""
    return documents.withColumnsRenamed({"doc_id": "response_id", "text": "body"})


def as_log(documents: DataFrame) -> DataFrame:
    """Documents as log entries: the text is the line."""
    return documents.withColumnsRenamed({"doc_id": "entry_id", "text": "line"})


def op1_simhash(spark: SparkSession, sf: str) -> DataFrame:
    found = near_copies(as_responses(table(spark, sf, "documents", "doc_id", "text")))
    return found.withColumnRenamed("response_id", "doc_id")


def op2_decontamination(spark: SparkSession, sf: str) -> DataFrame:
    bodies = as_responses(table(spark, sf, "documents", "doc_id", "text"))
    found = find_contamination(bodies, table(spark, sf, "benchmark", "item_id", "text"))
    return found.drop("spans").withColumnRenamed("response_id", "doc_id")


OP2_SQL = r"""
with doc as (
  select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') w from documents),
item as (
  select item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') w from benchmark),
win as (
  select distinct item_id, least(len(w), 10) size, array_to_string(w[i:i + least(len(w), 10) - 1], ' ') key
  from item, unnest(range(1, greatest(len(w) - 9, 1) + 1)) t(i) where len(w) > 0),
sizes as (select distinct size from win),
places as (
  select doc_id, i, size, array_to_string(w[i:i + size - 1], ' ') key
  from doc, sizes, unnest(range(1, len(w) - size + 2)) t(i)),
met as (select p.doc_id, p.i, p.size, x.item_id from places p join win x on x.key = p.key and x.size = p.size),
hit as (select doc_id, count(distinct j) n from met, unnest(range(i, i + size)) t(j) group by doc_id),
named as (
  select doc_id, count(*) n, string_agg(item_text, ',' order by item_text) ids
  from (select distinct doc_id, cast(item_id as varchar) item_text from met) t group by doc_id)
select d.doc_id, cast(len(d.w) as bigint) n_words, cast(coalesce(h.n, 0) as bigint) n_hit,
  cast(coalesce(n.n, 0) as bigint) n_items, sha256(coalesce(n.ids, '')) items_sha256, coalesce(h.n, 0) > 0 contaminated
from doc d left join hit h on h.doc_id = d.doc_id left join named n on n.doc_id = d.doc_id"""


def op3_repeats(spark: SparkSession, sf: str) -> DataFrame:
    exports = table(spark, sf, "documents", F.col("doc_id").alias("export_id"), F.col("text").alias("value"))
    return repeated_runs(exports).drop("kept").withColumnRenamed("export_id", "doc_id")


def op4_fertility(spark: SparkSession, sf: str) -> DataFrame:
    places = as_places(table(spark, sf, "documents", "doc_id", "text"))
    judged = judge_names(places, public_tokenizers.path("piece_bpe_32k.model"))
    return judged.withColumnRenamed("place_id", "doc_id")


def op5_surrogates(spark: SparkSession, sf: str) -> DataFrame:
    bodies = as_responses(table(spark, sf, "documents", "doc_id", "text"))
    replaced = replace_personal(bodies, SURROGATE_KEY)
    counts = {f"n_{k}": F.coalesce(F.element_at("entities", F.lit(k)), F.lit(0)) for k in ("email", "ip", "phone", "card")}
    total = F.aggregate(F.map_values("entities"), F.lit(0).cast("long"), lambda a, b: a + b)
    return replaced.select(F.col("response_id").alias("doc_id"), F.col("body").alias("text"), total.alias("n_entities"), *[c.alias(n) for n, c in counts.items()])


def op6_secrets(spark: SparkSession, sf: str) -> DataFrame:
    found = find_secrets(as_log(table(spark, sf, "documents", "doc_id", "text")))
    base = F.filter("secrets", lambda s: s["number"] < len(BASE))

    def count(number: int) -> Column:
        return F.size(F.filter("secrets", lambda s: s["number"] == number)).cast("long").alias(f"n_{RULES[number].kind}")

    digest = F.sha2(span_text(base), 256).alias("base_sha256")
    return found.select(F.col("entry_id").alias("doc_id"), *map(count, range(len(BASE))), digest, span_text(F.col("secrets")).alias("spans"))


def _op6_sql() -> str:
    """Pieces between matches and matches alternate, so sums of their lengths are the places."""
    parts = []
    for n, rule in enumerate(RULES):
        quoted = rule.pattern.replace("'", "''")
        parts.append(
            f"select doc_id, {n} number, '{rule.kind}' kind, {rule.least} least, regexp_extract_all(t, '{quoted}', 0) m, "
            f"regexp_extract_all(t, '{quoted}', {rule.group}) g, regexp_split_to_array(t, '{quoted}') b from doc"
        )
    return f"""
with doc as (select doc_id, coalesce(text, '') t from documents),
listed as ({" union all ".join(parts)}),
cells as (
  select doc_id, number, kind, least, i, length(b[i]) before, length(m[i]) size, length(g[i]) told
  from listed, unnest(range(1, len(m) + 1)) t(i) where len(m) > 0),
placed as (
  select *, cast(sum(before + size) over (partition by doc_id, number order by i) as bigint) stop from cells),
kept as (select doc_id, number, kind, stop - size start, stop, concat(kind, ':', stop - size, ':', stop) span from placed where told >= least),
told as (
  select doc_id, count(*) filter (number = 0) n_assign, count(*) filter (number = 1) n_access, count(*) filter (number = 2) n_hex,
    coalesce(string_agg(span, ',' order by start, number) filter (number < {len(BASE)}), '') base,
    string_agg(span, ',' order by start, number) spans
  from kept group by doc_id)
select d.doc_id, coalesce(n_assign, 0) n_assign, coalesce(n_access, 0) n_access, coalesce(n_hex, 0) n_hex,
  sha256(coalesce(base, '')) base_sha256, coalesce(spans, '') spans
from doc d left join told t on t.doc_id = d.doc_id"""


def op7_archive(spark: SparkSession, sf: str) -> DataFrame:
    pages = table(spark, sf, "pages", F.col("page_id").alias("response_id"), "url", F.col("html").alias("body"))
    return read_archive(write_archive(pages, ARCHIVE_DATE)).withColumnRenamed("response_id", "page_id")


def _op7_sql() -> str:
    """Base32 of the 160-bit digest: 32 groups of five bits."""
    letters = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
    return f"""
with page as (select page_id, coalesce(html, '') h, sha1(coalesce(html, '')) d from pages),
bits as (
  select page_id, h, d, array_to_string(list_transform(range(1, 41), lambda i:
    right(bin(cast(concat('0x', substr(d, i, 1)) as int) + 16), 4)), '') b from page),
keeper as (select d, max(page_id) page_id from page group by d)
select p.page_id, cast(strlen(h) as bigint) payload_bytes,
  array_to_string(list_transform(range(0, 32), lambda i: substr('{letters}', 1 + cast(
    16 * cast(substr(b, 5 * i + 1, 1) as int) + 8 * cast(substr(b, 5 * i + 2, 1) as int) + 4 * cast(substr(b, 5 * i + 3, 1) as int)
    + 2 * cast(substr(b, 5 * i + 4, 1) as int) + cast(substr(b, 5 * i + 5, 1) as int) as int), 1)), '') payload_digest,
  case when k.page_id = p.page_id then 'response' else 'revisit' end record_type,
  case when k.page_id <> p.page_id then k.page_id end refers_to
from bits p join keeper k on k.d = p.d"""


def op8_packing(spark: SparkSession, sf: str) -> DataFrame:
    places = as_places(table(spark, sf, "documents", "doc_id", "text"))
    return pack_places(places, public_tokenizers.path("word_bpe_49k.json")).withColumnRenamed("place_id", "doc_id")


def op9_token_files(spark: SparkSession, sf: str) -> DataFrame:
    places = as_places(table(spark, sf, "documents", "doc_id", "text"))
    written = write_token_files(places, public_tokenizers.path("byte_bpe_50k.json"))
    return read_token_files(written).withColumnRenamed("place_id", "doc_id")


def op10_language(spark: SparkSession, sf: str) -> DataFrame:
    places = as_places(table(spark, sf, "documents", "doc_id", "text", "lang"))
    labelled = places.where(~held_out(F.col("place_id")))
    judged = identify_language(places.select("place_id", "name"), labelled)
    return judged.select(F.col("place_id").alias("doc_id"), held_out(F.col("place_id")).alias("held_out"), "lang_pred", "score")


def op11_alike_vectors(spark: SparkSession, sf: str) -> DataFrame:
    facets = table(spark, sf, "embeddings", F.col("vec_id").alias("tid"), F.col("embedding").alias("direction"))
    found = alike_facets(facets, F.col("tid") % 20 == 0, ["tid"])
    return found.withColumnsRenamed({"asked_tid": "query_id", "tid": "vec_id"})


OP11_SQL = """
with vec as (
  select vec_id, list_transform(embedding, lambda x: cast(floor(64 * cast(x as double)) as bigint)) v from embeddings
  where embedding is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
scored as (
  select q.vec_id query_id, c.vec_id, cast(list_sum(list_transform(range(1, len(q.v) + 1), lambda i: q.v[i] * c.v[i])) as bigint) score
  from vec q join vec c on q.vec_id % 20 = 0 and c.vec_id <> q.vec_id and len(q.v) = len(c.v)),
ranked as (select *, cast(row_number() over (partition by query_id order by score desc, vec_id) as int) rank from scored)
select query_id, rank, vec_id, score from ranked where rank <= 20"""


def op12_token_alignment(spark: SparkSession, sf: str) -> DataFrame:
    places = as_places(table(spark, sf, "documents", "doc_id", "text"))
    vocabularies = (public_tokenizers.path(v) for v in ("byte_bpe_50k.json", "piece_bpe_32k.model"))
    return aligned_names(places, *vocabularies, keys=["place_id"]).withColumnRenamed("place_id", "doc_id")


def op13_spelling_variants(spark: SparkSession, sf: str) -> DataFrame:
    return spelling_variants(as_places(table(spark, sf, "documents", "doc_id", "text")), ["place_id"])


# The checksum is folded byte by byte over a table derived from its polynomial; words at one edit share what is left without one letter.
OP13_SQL = r"""
with recursive
crc_table as (
  select list(c order by i) t from (
    select i, list_reduce(range(8), lambda c, s: case when c % 2 = 1 then xor(c // 2, 3988292384) else c // 2 end, i) c
    from range(256) r(i)) x),
run as (
  select doc_id, translate(r, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') w, count(*) n
  from (select doc_id, unnest(regexp_extract_all(coalesce(text, ''), '[A-Za-z\x{C0}-\x{FF}]+')) r from documents) x
  group by all),
coded as (
  select w, n, xor(list_reduce(
    list_transform(regexp_extract_all(hex(encode(concat(coalesce(cast(doc_id as varchar), ''), ':', w))), '..'), lambda x: cast(concat('0x', x) as bigint)),
    lambda c, x: xor(c // 256, t[cast(xor(c % 256, x) as bigint) + 1]), 4294967295::bigint), 4294967295) h
  from run, crc_table),
word as (
  select word, cast(sum(n) as bigint) n from (
    select case when h % 97 = 0 then concat(left(w, cast(h % length(w) as int)), substr(w, cast(h % length(w) as int) + 2)) else w end word, n
    from coded) x
  where length(word) >= 5 group by word having sum(n) >= 3),
cutout as (select word, n, i, concat(left(word, i - 1), substr(word, i + 1)) part from (select word, n, unnest(range(1, length(word) + 1)) i from word) x),
link as (
  select a.word, b.word other, b.n from cutout a join cutout b on a.part = b.part and a.i = b.i where a.word <> b.word
  union
  select a.word, b.word, b.n from cutout a join word b on a.part = b.word
  union
  select b.word, a.word, a.n from cutout a join word b on a.part = b.word),
best as (select word, count(*) n_near, arg_min(other, (-n, other)) form, max(n) form_n from (select distinct * from link) x group by word),
judged as (
  select w.word, w.n, coalesce(n_near, 0) n_near, case when form_n >= 2 * w.n then form end form, case when form_n >= 2 * w.n then form_n end form_n
  from word w left join best b on b.word = w.word),
chain as (
  select word, word root, form nxt from judged
  union all
  select c.word, j.word, j.form from chain c join judged j on j.word = c.nxt)
select j.word, j.form, c.root, j.n, j.n_near, j.form_n from judged j join chain c on c.word = j.word and c.nxt is null"""


QUERIES = {
    f.__name__: f
    for f in (
        op1_simhash, op2_decontamination, op3_repeats, op4_fertility, op5_surrogates, op6_secrets, op7_archive, op8_packing,
        op9_token_files, op10_language, op11_alike_vectors, op12_token_alignment, op13_spelling_variants,
    )
}
ORACLES = {
    "op2_decontamination": OP2_SQL, "op6_secrets": _op6_sql(), "op7_archive": _op7_sql(), "op11_alike_vectors": OP11_SQL,
    "op13_spelling_variants": OP13_SQL,
}
