import sentencepiece
from pyspark.sql import functions as F

from cuadra.llm import pieces


def test_edges_meet_tables_of_masks_and_no_comparator(spark):
    edges = F.array(F.col("id") + 2**21)
    frame = spark.range(1).select(pieces._merge_bits(F.col("id").cast("int") + 1, edges).alias("x"))
    plan = frame._jdf.queryExecution().optimizedPlan().toString()
    assert "array_sort" not in plan and "split(" not in plan


def test_units_around_the_longest_short_one(spark):
    model = pieces.Pieces.load()
    sp = sentencepiece.SentencePieceProcessor(model_file=pieces.MODEL_FILE)
    texts = [(w * 40)[:k] for w in ("theand", "zqxjé", "aaaa", "日本語x") for k in (1, 2, 30, 60, 61, 62, 63, 64)] + ["a b the the ☃ xé☃the", "", None]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = dict(pieces.encode(docs, model).collect())
    for k, text in enumerate(texts):
        assert got[k] == (sp.encode(text) if text else []), text


def test_fixed_tables_need_no_workers(spark):
    model = pieces.Pieces.load()
    units = spark.createDataFrame([("the",), ("☃" * 3,)], "unit string").checkpoint()
    for make in (pieces.lattice, pieces.long_lattice):
        plan = make(units, model, 2)._jdf.queryExecution().optimizedPlan().toString()
        # the only rows from a job are the units' own
        assert plan.count("LogicalRDD") == 1 + (make is pieces.long_lattice), plan[:2000]
