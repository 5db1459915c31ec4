import random

from pyspark.sql import functions as F

from cuadra.llm import pieces


def shuffled(spark):
    spark._jsc.sc().listenerBus().waitUntilEmpty(30_000)
    return spark._jsc.sc().statusStore().executorSummary("driver").totalShuffleWrite()


def test_units_beyond_what_is_broadcast_are_joined_without_the_others(spark, tmp_path):
    rng = random.Random(3)
    common = ["".join(rng.choice("aeiourstlnm") for _ in range(rng.randint(2, 9))) for _ in range(300)]
    # each text has many common words and five of its own
    texts = [" ".join([*rng.choices(common, k=600), *("".join(rng.choice("bcdfgxzy") for _ in range(11)) for _ in range(5))]) for _ in range(300)]
    odd = [None, "", " ", "  two  blanks ", "\U0001f999\U0001f999 bare bytes", "▁ mark ▁", "a\nb\tc", texts[0], texts[0], "x" * 70]
    rows = [(None if k % 50 == 7 else k, t) for k, t in enumerate([*texts, *odd, *odd])]
    spark.createDataFrame(rows, "doc_id long, text string").repartition(5).write.parquet(f"{tmp_path}/docs")
    docs = spark.read.parquet(f"{tmp_path}/docs")
    model = pieces.Pieces.load()
    key = F.xxhash64("doc_id", "text")
    want = sorted(map(repr, pieces.encode(docs.withColumn("key", key), model, ("key", "doc_id"), decoded=True).collect()))
    for most in (20_000, 5_000, 0):
        before = shuffled(spark)
        got = pieces.encode(docs.withColumn("key", key), model, ("key", "doc_id"), most, decoded=True).collect()
        written = shuffled(spark) - before
        assert sorted(map(repr, got)) == want
        if most == 20_000:
            # about half of the encodings; every unit of every text was shuffled before
            assert written < sum(len((t or "").encode()) for _, t in rows), written


def test_what_is_broadcast_are_the_units_with_most_places(spark):
    docs = spark.createDataFrame([(f"the and the and rare{chr(97 + k)}x{k}",) for k in range(20)], "_text string").repartition(3)
    model = pieces.Pieces.load()
    seen = docs.select(F.explode(pieces.words_of(F.col("_text"))).alias("w")).distinct().select(F.explode(pieces.units_of(F.col("w"), model)).alias("unit")).distinct().localCheckpoint()
    coded = pieces.encode_units(seen, model, seen.count()).select("unit", F.unhex(F.expr("array_join(transform(ids, x -> lpad(hex(x), 4, '0')), '')")).alias("ids")).localCheckpoint()
    size = coded.agg(F.sum(F.octet_length("ids") + 12)).first()[0]
    hashes = {r[0]: r[1] for r in coded.select(F.xxhash64("unit"), "unit").collect()}
    # all texts are counted where all encodings but one byte fit
    kept = {hashes[h] for h in pieces._often(docs, seen, coded, model, size, size - 1).column("h").to_pylist()}
    assert {"▁the", "▁and"} <= kept and len(kept) < len(hashes)
    assert pieces._often(docs, seen, coded, model, size, 0).num_rows == 0
