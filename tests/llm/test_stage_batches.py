import pyarrow as pa
import pytest
from pyspark.sql import SparkSession
from pyspark.sql import functions as F

import corpus_pipeline
from cuadra.storage import few_rows_a_batch

ROWS = "spark.sql.execution.arrow.maxRecordsPerBatch"


def sizes(docs, *_, **__):
    def run(batches):
        for batch in batches:
            yield pa.RecordBatch.from_pydict({"n": pa.array([batch.num_rows])})

    return docs.mapInArrow(run, "n long")


@pytest.fixture
def docs(spark):
    return spark.range(100).select(F.col("id").alias("doc_id"), F.lit("a b").alias("text"), F.lit("en").alias("lang"), F.lit("s").alias("source"), F.lit(3).alias("n_chars")).coalesce(1)


def test_a_stage_written_by_its_caller_hands_few_texts(spark, docs, monkeypatch):
    monkeypatch.setattr(corpus_pipeline, "TEXTS_A_BATCH", 30)
    monkeypatch.setattr(corpus_pipeline.pieces, "encode", sizes)
    out = dict(corpus_pipeline.STAGES)["SentencePiece"](spark, docs, "").withColumn("more", F.lit(1))
    assert sorted(r.n for r in out.collect()) == [10, 30, 30, 30]


def test_the_caller_keeps_its_session(spark, docs, monkeypatch):
    before = spark.conf.get(ROWS)
    monkeypatch.setattr(corpus_pipeline, "TEXTS_A_BATCH", 30)
    for name in ("language ID", "n-gram Jaccard join", "suffix-array dedup", "SentencePiece"):
        out = dict(corpus_pipeline.STAGES)[name](spark, docs, "")
        assert out.sparkSession.conf.get(ROWS) == "30", name
        assert spark.conf.get(ROWS) == before
        assert SparkSession.getActiveSession()._jsparkSession.equals(spark._jsparkSession)


def test_other_settings_and_rows_are_the_callers(spark, docs):
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "3")
    try:
        own = few_rows_a_batch(docs, 10**6)
        assert own.sparkSession.conf.get("spark.sql.shuffle.partitions") == "3"
        assert own.sparkSession.conf.get(ROWS) == spark.conf.get(ROWS)
        assert own.schema == docs.schema and own.collect() == docs.collect()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
