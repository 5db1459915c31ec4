import corpus_pipeline
from cuadra.llm import suffixes
from cuadra.storage import rows_a_batch

ROWS = "spark.sql.execution.arrow.maxRecordsPerBatch"


def test_words_are_hashed_by_the_worker_that_searches_them(spark, monkeypatch):
    passage = " ".join(f"word{k}" for k in range(60))
    docs = spark.createDataFrame([(1, 1, f"one {passage}"), (2, 2, f"{passage} two"), (3, 3, "x " * 200), (4, 4, "")], "key long, doc_id long, text string")
    plans, cut = [], suffixes.cut

    def seen(frame):
        plans.append(frame._jdf.queryExecution().optimizedPlan().toString())
        return cut(frame)

    monkeypatch.setattr(suffixes, "cut", seen)
    covered = {}
    for key, _, start, end in suffixes.word_spans(docs, 51).collect():
        covered.setdefault(key, set()).update(range(start, end))
    assert covered == {1: set(range(1, 61)), 2: set(range(60)), 3: set(range(200))}
    assert plans and all(p.count("MapInArrow") == 1 for p in plans)


def test_stages_hand_few_texts_at_a_time(spark, tmp_path, monkeypatch):
    seen, before = [], spark.conf.get(ROWS)

    def stage(spark, docs, sf_dir):
        seen.append(int(spark.conf.get(ROWS)))
        return docs

    spark.createDataFrame([(1, "a")], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    monkeypatch.setattr(corpus_pipeline, "STAGES", [("one", stage), ("two", stage)])
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 1
    assert seen == [corpus_pipeline.TEXTS_A_BATCH] * 2 and spark.conf.get(ROWS) == before


def test_a_smaller_bound_stays(spark):
    before = spark.conf.get(ROWS)
    spark.conf.set(ROWS, "7")
    try:
        with rows_a_batch(spark, 1000):
            assert spark.conf.get(ROWS) == "7"
        assert spark.conf.get(ROWS) == "7"
    finally:
        spark.conf.set(ROWS, before)
