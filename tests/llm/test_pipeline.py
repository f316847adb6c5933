import corpus_pipeline
from pyspark.sql import functions as F

from gridloom.llm import queries

SF = "/root/testdata/sf0.001"


def test_stages_follow_each_other(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    now, counts = docs, [docs.count()]
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, now, SF).write.parquet(str(tmp_path / name))
        now, before = spark.read.parquet(str(tmp_path / name)), now
        counts.append(now.count())
        if name == "packing":
            break
        assert now.columns == docs.columns and [f.dataType for f in now.schema] == [f.dataType for f in docs.schema]
        assert now.select("doc_id").subtract(before.select("doc_id")).isEmpty()
        if name == "line_dedup":
            assert counts[-1] == counts[-2]
        else:
            assert counts[-1] < counts[-2]
            # rows that stay stay as they were
            assert now.subtract(before).isEmpty()
        if name == "near_dedup":
            from gridloom.llm.simhash import near_duplicates

            assert near_duplicates(now).groupBy("component_id").count().where(F.col("count") > 1).isEmpty()
            assert near_duplicates(before).select("component_id").distinct().count() == counts[-1]
        if name == "decontamination":
            from gridloom.llm.decontam import contamination

            bad = contamination(before, spark.read.parquet(f"{SF}/benchmark.parquet")).where("contaminated").count()
            assert counts[-1] == counts[-2] - bad
    assert now.agg(F.countDistinct("doc_id")).first()[0] == counts[-2]
    assert now.groupBy("sequence_id").agg(F.sum("length").alias("n"), F.max(F.col("offset") + F.col("length")).alias("m")).where("n <> m or n > 1024").isEmpty()


def test_run_and_registry(spark):
    assert corpus_pipeline.run(spark, SF).count() > 0
    assert corpus_pipeline.ORACLE_SQL is None
    assert sorted(queries.QUERIES)[-1] == "pipeline" and len(queries.QUERIES) == 11
