"""The registered queries of the text operators and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridloom.llm.work import crc32_bucket, read


def vocabulary() -> str:
    """The place of the public byte-level vocabulary file; every machine has it at the same path."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def op1_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    from gridloom.llm.simhash import near_duplicates

    return near_duplicates(read(spark, sf_dir, "documents"))


def op2_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    from gridloom.llm.topk import top_k

    return top_k(read(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0)


def op8_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    from gridloom.llm.decontam import contamination

    return contamination(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark")).drop("items")


def op3_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    from gridloom.llm.secret_scan import scan

    return scan(read(spark, sf_dir, "documents"))


def op4_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from gridloom.llm.line_dedup import dedup_lines

    return dedup_lines(read(spark, sf_dir, "documents"), counts=True).select("doc_id", "text", "n_lines", "n_removed")


def op5_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    from gridloom.llm.quality import classify

    return classify(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))


def op6_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    from gridloom.llm.langid import identify

    docs = read(spark, sf_dir, "documents")
    found = identify(docs, crc32_bucket("doc_id", 4) != 2)
    return found.select("doc_id", (crc32_bucket("doc_id", 4) == 2).alias("held_out"), "lang_pred", "score")


def op7_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from gridloom.llm.packing import pack

    return pack(read(spark, sf_dir, "documents"), vocabulary())


def op9_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    from gridloom.llm.token_files import round_trip

    return round_trip(read(spark, sf_dir, "documents"), vocabulary())


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from gridloom.llm.toxicity import score

    found = score(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"), crc32_bucket("doc_id", 3) != 1)
    return found.select("doc_id", (crc32_bucket("doc_id", 3) == 1).alias("held_out"), "score", (F.col("score") >= 0.7).cast("int").alias("predicted"))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


QUERIES = {f.__name__: f for f in (op1_simhash, op2_topk, op3_secrets, op4_line_dedup, op5_quality, op6_langid, op7_packing, op8_decontaminate, op9_token_files, op10_toxicity, pipeline)}

#: op1, 3 to 7, 9, 10 and the pipeline need XXH64, tokenizers or fitted models, which SQL lacks; tests/llm holds them against brute force.
SQL: dict[str, str] = {
    "op2_topk": """
with v as (select vec_id, list_transform(embedding, lambda x: floor(1024 * x::double)) as x from embeddings
  where vec_id is not null and embedding is not null and len(embedding) > 0 and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
s as (select q.vec_id as query_id, c.vec_id, cast(list_inner_product(q.x, c.x) as bigint) as score from v q join v c on q.vec_id <> c.vec_id and len(q.x) = len(c.x) where q.vec_id % 100 = 0),
r as (select query_id, cast(row_number() over (partition by query_id order by score desc, vec_id) as int) as rank, vec_id, score from s)
select query_id, rank, vec_id, score from r where rank <= 10""",
    "op8_decontaminate": r"""
with d as (select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as w from documents),
b as (select item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as w from benchmark),
wins as (select item_id, least(len(w), 13) as n, unnest(list_transform(range(1, len(w) - least(len(w), 13) + 2), lambda i: array_to_string(w[i : i + least(len(w), 13) - 1], ' '))) as g from b where len(w) > 0),
sizes as (select distinct n from wins),
grams as (select doc_id, n, unnest(range(1, len(w) - n + 2)) as pos, unnest(list_transform(range(1, len(w) - n + 2), lambda i: array_to_string(w[i : i + n - 1], ' '))) as g from d, sizes where len(w) >= n),
hits as (select grams.doc_id, grams.pos, grams.n, wins.item_id from grams join wins on grams.n = wins.n and grams.g = wins.g),
covered as (select doc_id, count(distinct p) as n_hit from (select doc_id, unnest(range(pos, pos + n)) as p from (select distinct doc_id, pos, n from hits)) group by doc_id),
items as (select doc_id, count(distinct item_id) as n_items, string_agg(distinct item_id::varchar, ',' order by item_id::varchar) as names from hits group by doc_id)
select d.doc_id, cast(len(d.w) as bigint) as n_words, cast(coalesce(n_hit, 0) as bigint) as n_hit, cast(coalesce(n_items, 0) as bigint) as n_items, sha256(coalesce(names, '')) as items_sha256,
  coalesce(n_hit, 0) > 0 and 20 * coalesce(n_hit, 0) >= len(d.w) as contaminated
from d left join covered on d.doc_id = covered.doc_id left join items on d.doc_id = items.doc_id""",
}
