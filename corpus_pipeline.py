"""The corpus pipeline: quality, line and near-duplicates, decontamination, packing.

Each stage takes (spark, docs, sf_dir) and works on all that the one before it
kept; between stages the rows are written as Parquet and read again. All but the
last return the columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridloom.llm.decontam import decontaminate
from gridloom.llm.line_dedup import dedup_lines
from gridloom.llm.packing import pack
from gridloom.llm.quality import keep_good
from gridloom.llm.queries import vocabulary
from gridloom.llm.simhash import near_duplicates
from gridloom.llm.work import Work, read


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the co-trained classifier does not reject."""
    return keep_good(docs, read(spark, sf_dir, "labels"))


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, one line of each group of alike lines left in their texts; ``n_chars`` follows the text."""
    return _with_length(dedup_lines(docs), docs)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document of the smallest id of each group of near-duplicates; of rows that repeat its id, the one of the least text.

    Rows without an id cannot be told apart from each other by id; they stay.
    """
    groups = near_duplicates(docs).where("doc_id = component_id").select("doc_id").distinct()
    kept = docs.join(groups, "doc_id", "left_semi")
    # the least row as a whole, so that the choice does not hang on the order of tasks
    least = F.min(F.struct("text", *[c for c in docs.columns if c not in ("doc_id", "text")])).alias("_row")
    kept = kept.groupBy("doc_id").agg(least).select("doc_id", "_row.*")
    return kept.select(*docs.columns).unionByName(docs.where("doc_id is null"))


def benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that are not contaminated by the benchmark."""
    return decontaminate(docs, read(spark, sf_dir, "benchmark"))


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents, packed into sequences of at most 1024 tokens."""
    return pack(docs, vocabulary())


def _with_length(after: DataFrame, before: DataFrame) -> DataFrame:
    if "n_chars" not in before.columns:
        return after
    kind = before.schema["n_chars"].dataType
    return after.withColumn("n_chars", F.when(F.col("text").isNull(), F.col("n_chars")).otherwise(F.char_length("text").cast(kind))).select(*before.columns)


STAGES = [("quality", quality), ("line_dedup", lines), ("near_dedup", near), ("decontamination", benchmark), ("packing", packing)]

#: SQL has neither the classifier nor XXH64 nor the tokenizer; tests/llm/test_pipeline.py holds the stages against plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, the tables between them in the shared folder."""
    work, now = Work(spark, "pipeline"), read(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES):
        now = work.table(stage(spark, now, sf_dir), name)
        if k:
            work.drop(STAGES[k - 1][0])
    return now
