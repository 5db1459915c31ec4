"""A corpus from raw documents to piece ids, in five stages; each is written as Parquet and read again."""

from __future__ import annotations

import uuid
from collections.abc import Callable
from functools import wraps

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cuadra.llm import jaccard, language, mixing, pieces, suffixes
from cuadra.llm._common import columns, cut, few, shared_dir
from cuadra.storage import delete, few_rows_a_batch, rows_a_batch

#: Texts whose main language is less certain than this go, as do those without a letter; other languages in them don't count.
LEAST_CERTAIN = 0.2
#: Passages of so many words in a row that occur twice are taken out, as are repeated strings of op9's length.
PASSAGE_WORDS = 51
#: Texts that a worker is handed at a time in any stage: heaps and workers of earlier stages are held beside them.
TEXTS_A_BATCH = 1000
DOCUMENTS = {"doc_id": "long", "text": "string", "lang": "string", "source": "string", "n_chars": "long"}


def _documents(docs: DataFrame) -> DataFrame:
    return columns(docs, **DOCUMENTS)


def _few_texts(stage: Callable) -> Callable:
    """A stage whose frame hands workers few texts at a time, also where it is written after the stage has returned."""

    @wraps(stage)
    def bounded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        out = stage(spark, few_rows_a_batch(docs, TEXTS_A_BATCH), sf_dir)
        spark.createDataFrame([], "none int")  # makes the caller's session the active one again
        return out

    return bounded


@_few_texts
def language_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep documents in a language that is recognized, learned from the labels of those not held out; `lang` becomes it.

    Null, empty and letterless texts go. Null ids, null labels and repeated rows stay as they are; an empty
    table gives none. Columns other than those of documents are dropped here and in every stage.
    """
    docs = _documents(docs)
    model = language.fit(docs.where(~language.held_out() & F.col("doc_id").isNotNull()))
    found = language.detect(docs, model, carry=tuple(c for c in DOCUMENTS if c != "doc_id"), with_certainty=True)
    kept = found.where((F.col("lang_pred") != "und") & (F.col("certainty") >= LEAST_CERTAIN))
    return _documents(kept.drop("lang").withColumnRenamed("lang_pred", "lang"))


@_few_texts
def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents that links of five-word shingles at 0.8 join, the one with the smallest id stays (null ids last).

    Rows with a null id, or an id that other rows have too, count as documents of their own by their text, so
    that a clash of ids removes nothing; of rows that are equal in id and text one stays. Null and wordless
    texts are linked with nothing. An empty table gives none.
    """
    docs = _documents(docs)
    clashing = cut(docs.groupBy("doc_id").count().where("count > 1 OR doc_id IS NULL").select("doc_id"))
    several = clashing.count() > 0
    keyed = docs.withColumn("key", F.col("doc_id"))
    if several:
        known = few(clashing.where("doc_id IS NOT NULL").select(F.col("doc_id").alias("of"), F.lit(True).alias("clash")))
        own = F.when(F.col("clash") | F.col("doc_id").isNull(), F.xxhash64("doc_id", "text")).otherwise(F.col("doc_id"))
        keyed = docs.join(known, F.col("doc_id") == F.col("of"), "left").withColumn("key", own).drop("of", "clash")
    linked = jaccard.link(keyed.select(F.col("key").alias("doc_id"), "text"), n=5, num=80, den=100)
    groups = cut(linked.select("doc_id", "component_id").withColumnsRenamed({"doc_id": "key", "component_id": "group"}).distinct())
    large = cut(groups.groupBy("group").count().where("count > 1").select(F.col("group").alias("of")))
    inside = groups.join(few(large), F.col("group") == F.col("of"), "left_semi")
    if several:
        # keys of clashing ids are hashes: the ids themselves decide
        ids = keyed.select(F.col("key").alias("k"), "doc_id").distinct()
        inside = inside.join(ids, F.col("key") == F.col("k"))
    else:
        inside = inside.withColumn("doc_id", F.col("key"))
    order = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "key")
    inside = cut(inside.select("group", order.alias("o")))
    first = few(cut(inside.groupBy("group").agg(F.min("o.key").alias("same"), F.min("o").alias("o")).select(F.col("o.key").alias("stays"))))
    gone = few(cut(inside.select(F.col("o.key").alias("gone")).distinct().join(first, F.col("gone") == F.col("stays"), "left_anti")))
    kept = keyed.join(gone, F.col("key") == F.col("gone"), "left_anti")
    if several:
        # rows that are equal in id and text have one key; only these are shuffled whole
        twice = kept.join(known.withColumn("null_too", F.lit(1)), F.col("doc_id") == F.col("of"), "left")
        again = F.col("clash") | F.col("doc_id").isNull()
        kept = twice.where(~F.coalesce(again, F.lit(False))).select(*DOCUMENTS).union(twice.where(again).dropDuplicates(["key"]).select(*DOCUMENTS))
    return _documents(kept)


@_few_texts
def repeats_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Take repeated passages out of every text; a document of which nothing is left goes.

    A null or blank text loses nothing and stays. Rows with equal ids, or none, are documents of their own, so
    repeated rows take each other's passages out. An empty table gives none.
    """
    found = suffixes.dedup(_documents(docs), with_text=True, carry=("lang", "source"), words=PASSAGE_WORDS)
    kept = found.where((F.col("n_removed") == 0) | (F.trim("clean_text") != ""))
    return _documents(kept.select("doc_id", F.col("clean_text").alias("text"), "lang", "source", F.length("clean_text").alias("n_chars")))


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Emit each document as often as its source's target asks for.

    A null source is a source; null and wordless texts have size 0 and aren't emitted. Repeated rows draw
    alike. An empty table gives none.
    """
    return mixing.emit(_documents(docs))


@_few_texts
def pieces_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The piece ids of every document: doc_id, lang, source, ids. A null or empty text has no ids; rows stay as many."""
    return pieces.encode(_documents(docs), pieces.Pieces.load(), ("doc_id", "lang", "source"))


STAGES = [
    ("language ID", language_stage),
    ("n-gram Jaccard join", near_duplicate_stage),
    ("suffix-array dedup", repeats_stage),
    ("mixing sources", mixing_stage),
    ("SentencePiece", pieces_stage),
]

#: The stages learn a model, sort suffixes and segment words, which SQL can't express.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply the stages to `documents`; each result is written to the shared folder and read again.

    A stage's files are deleted when the next stage's are there. Those that the returned frame reads stay, under
    `corpus-<uuid>` in that folder, for the caller to delete.
    """
    folder = f"{shared_dir(spark)}/corpus-{uuid.uuid4().hex}"
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (_, stage) in enumerate(STAGES):
        with rows_a_batch(spark, TEXTS_A_BATCH):
            docs = stage(spark, docs, sf_dir)
            if k < len(STAGES) - 1:
                docs.write.parquet(f"{folder}/{k}")
        if k < len(STAGES) - 1:
            docs = spark.read.parquet(f"{folder}/{k}")
            if k:
                delete(spark, f"{folder}/{k - 1}")
    return docs

