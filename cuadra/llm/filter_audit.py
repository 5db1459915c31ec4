"""How filters interact: what each removes after every choice of filters before it, for each part of a corpus.

Tasks pack their rows into bitsets: one for each filter (a bit is set where a row fails), one for each label, and
for the parts one run of bytes each, for rows are laid out part by part. AND-NOT over the filters of a subset
leaves the rows that it keeps; popcounts of those and the next filter say what that removes. All orders of the
filters that begin with the same subset share its counts, so 2 ** filters subsets answer for factorially many
orders. Counts are added up over the tasks, and orders are joined to them by subset and filter.
"""

from __future__ import annotations

import hashlib
from itertools import permutations
from math import factorial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ._common import UPPER, columns, cut, table

FILTERS = "ABCDE"
#: Limits of the filters: words, per cent of distinct words, per cent of capitals.
LEAST_WORDS, LEAST_DISTINCT, MOST_CAPITALS = 200, 50, 2
#: Parts whose sums a task holds before it hands them on.
HELD = 4096

_CAPITALS, _SIGNS, _CONTINUED = UPPER.encode(), b"#$%&*|", bytes(range(0x80, 0xC0))


def fails(docs: DataFrame) -> DataFrame:
    """(doc_id, part, fails, same) of every document: bits of the filters A to E that it fails, and a hash of its text."""

    def judge(batches):
        for batch in batches:
            masks, digests = [], []
            for text in batch.column("text"):
                text = text.as_py()
                words = text.split()
                n = len(words)
                capitals, chars = len(text) - len(text.translate(None, _CAPITALS)), len(text.translate(None, _CONTINUED))
                mask = (n < LEAST_WORDS) | (100 * len(set(words)) < LEAST_DISTINCT * n) << 1 | (100 * capitals > MOST_CAPITALS * chars) << 2
                masks.append(mask | (len(text.translate(None, _SIGNS)) < len(text)) << 3)
                digests.append(hashlib.sha256(text).digest())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("part"), pa.array(masks, pa.int32()), pa.array(digests, pa.binary())], names=["doc_id", "part", "fails", "same"])

    narrow = columns(docs, doc_id="long", source="string", text="string")
    narrow = narrow.select("doc_id", F.coalesce("source", F.lit("")).alias("part"), F.coalesce("text", F.lit("")).cast("binary").alias("text"))
    judged = cut(narrow.mapInArrow(judge, "doc_id long, part string, fails int, same binary"))
    # E: the smallest id of each text that occurs again; both sides are written, so that Spark can split a frequent text
    first = cut(judged.groupBy("same").agg(F.min("doc_id").alias("first"), F.count("*").alias("n")).where("n > 1").select(F.col("same").alias("of"), "first"))
    copied = F.coalesce(F.col("doc_id") > F.col("first"), F.lit(False)).cast("int") * 16
    return judged.join(first, F.col("same") == F.col("of"), "left").select("doc_id", "part", (F.col("fails") + copied).alias("fails"))


class Index:
    """Packed bitsets of some rows; a part is a run of whole bytes."""

    def __init__(self, part: pa.Array, masks: np.ndarray, labels: list[np.ndarray], filters: int):
        coded = part.dictionary_encode()
        self.parts, codes = coded.dictionary.to_pylist(), coded.indices.to_numpy(False)
        sizes = np.bincount(codes, minlength=len(self.parts))
        held = (sizes + 7) // 8
        self.starts = np.cumsum(held) - held
        order = np.argsort(codes, kind="stable")
        place = np.empty(len(codes), np.int64)
        place[order] = np.arange(len(codes)) + np.repeat(8 * self.starts - (np.cumsum(sizes) - sizes), sizes)

        def packed(flags: np.ndarray) -> np.ndarray:
            bits = np.zeros(8 * int(held.sum()), bool)
            bits[place[flags]] = True
            return np.packbits(bits)

        self.rows = packed(np.ones(len(codes), bool))
        self.fails = [packed((masks >> f & 1).astype(bool)) for f in range(filters)]
        self.labels = [packed(x) for x in labels]

    def count(self, bits: np.ndarray) -> np.ndarray:
        """Set bits of each part."""
        return np.add.reduceat(np.bitwise_count(bits), self.starts, dtype=np.int64)

    def sums(self) -> np.ndarray:
        """Counts by part, subset, next filter, and (kept, removed, removed with each label)."""
        n = len(self.fails)
        out = np.zeros((len(self.parts), 2**n, n, 2 + len(self.labels)), np.int64)
        left = [self.rows]
        for s in range(1, 2**n):
            low = (s & -s).bit_length() - 1
            left.append(left[s & (s - 1)] & ~self.fails[low])
        kept = [self.count(x) for x in left]
        for s in range(2**n):
            for f in (f for f in range(n) if not s >> f & 1):
                gone = left[s] & self.fails[f]
                out[:, s, f, 0], out[:, s, f, 1] = kept[s | 1 << f], self.count(gone)
                for k, label in enumerate(self.labels):
                    out[:, s, f, 2 + k] = self.count(gone & label)
        return out


def interactions(flags: DataFrame, filters: str, labels: list[str]) -> DataFrame:
    """(part, before, filter, kept, removed, ...labels) from rows (part, fails, ...labels): counts for every subset
    `before` of the filters (bits) and every next filter (a number) outside it."""
    n, most = len(filters), HELD
    names = ["part", "before", "filter", "kept", "removed", *labels]
    # every subset and the filters outside it
    subset, last = np.array([(s, f) for s in range(2**n) for f in range(n) if not s >> f & 1]).T

    def handed(held: dict[str, np.ndarray]):
        for part, sums in held.items():
            columns_ = sums[subset, last].T
            yield pa.RecordBatch.from_arrays([pa.array([part] * len(subset)), pa.array(subset, pa.int32()), pa.array(last, pa.int32()), *(pa.array(c, pa.int64()) for c in columns_)], names=names)

    def count(batches):
        held: dict[str, np.ndarray] = {}
        for batch in batches:
            if not batch.num_rows:
                continue
            index = Index(batch.column("part"), batch.column("fails").to_numpy(False), [batch.column(x).to_numpy(False) for x in labels], n)
            for part, sums in zip(index.parts, index.sums(), strict=True):
                held[part] = held[part] + sums if part in held else sums
            if len(held) > most:
                yield from handed(held)
                held = {}
        yield from handed(held)

    ddl = "part string, before int, filter int, " + ", ".join(f"{x} long" for x in names[3:])
    counted = flags.select("part", "fails", *labels).mapInArrow(count, ddl)
    return counted.groupBy("part", "before", "filter").agg(*(F.sum(x).alias(x) for x in names[3:]))


def by_order(sums: DataFrame, filters: str, labels: list[str]) -> DataFrame:
    """One row for each part, order of the filters and step."""
    n, spark = len(filters), sums.sparkSession
    last = Window.partitionBy("part", "filter")
    fails = F.max(F.when(F.col("before") == 0, F.col("removed"))).over(last)
    only = F.max(F.when(F.bit_count("before") == n - 1, F.col("removed"))).over(last)
    # the orders that have just this subset before the filter
    times = F.lit(0)
    for k in range(n):
        times = F.when(F.bit_count("before") == k, F.lit(factorial(k) * factorial(n - 1 - k))).otherwise(times)
    full = sums.select("*", (fails - F.col("removed")).alias("redundant"), only.alias("unique_fails"), F.sum(F.col("removed") * times).over(last).alias("shapley"))
    steps = [("".join(filters[f] for f in order), k + 1, sum(1 << f for f in order[:k]), f) for order in permutations(range(n)) for k, f in enumerate(order)]
    # factorial(filters) * filters rows, whatever the corpus
    orders = F.broadcast(spark.createDataFrame(steps, "filter_order string, step int, o_before int, o_filter int"))
    joined = full.join(orders, (F.col("before") == F.col("o_before")) & (F.col("filter") == F.col("o_filter")))
    return joined.select("part", "filter_order", "step", "kept", "removed", "redundant", "unique_fails", *labels, "shapley")


def audit(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The filters A to E over whole texts, in every order, for each source.

    A null text is empty, a null source is the part ''. E compares texts by SHA-256; repeated rows with one id
    aren't copies of each other, and a null id neither is a copy nor makes one. A document has a label where any
    row of `labels` with its id says so; rows of `labels` without an id or with null labels say nothing. An
    empty table gives no rows. Other columns are left out.
    """
    said = columns(labels, doc_id="long", quality="int", toxic="int").where("doc_id IS NOT NULL").groupBy("doc_id")
    said = cut(said.agg(F.max(F.col("quality") == 1).alias("good_lost"), F.max(F.col("toxic") == 1).alias("toxic_lost")).withColumnRenamed("doc_id", "labelled"))
    names = ["good_lost", "toxic_lost"]
    flags = fails(docs).join(said, F.col("doc_id") == F.col("labelled"), "left")
    flags = flags.select("part", "fails", *(F.coalesce(x, F.lit(False)).alias(x) for x in names))
    return by_order(interactions(flags, FILTERS, names), FILTERS, names)


def op11_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


OP11_SQL = rf"""
WITH firsts AS (SELECT coalesce(text, '') AS text, min(doc_id) AS first FROM documents GROUP BY 1),
said AS (SELECT doc_id, max(quality = 1) AS good, max(toxic = 1) AS toxic FROM labels WHERE doc_id IS NOT NULL GROUP BY doc_id),
docs AS (
  SELECT d.doc_id, coalesce(source, '') AS part, coalesce(d.text, '') AS text, regexp_extract_all(coalesce(d.text, ''), '[^\x20\x09-\x0D]+') AS words,
         length(regexp_replace(coalesce(d.text, ''), '[^A-Z]+', '', 'g')) AS capitals, coalesce(d.doc_id > first, false) AS copied
  FROM documents d LEFT JOIN firsts f ON coalesce(d.text, '') = f.text),
flagged AS (
  SELECT part, (len(words) < {LEAST_WORDS})::INT + 2 * (100 * len(list_distinct(words)) < {LEAST_DISTINCT} * len(words))::INT
               + 4 * (100 * capitals > {MOST_CAPITALS} * length(text))::INT + 8 * regexp_matches(text, '[#$%&*|]')::INT + 16 * copied::INT AS fails,
         coalesce(good, false) AS good, coalesce(toxic, false) AS toxic
  FROM docs LEFT JOIN said ON docs.doc_id = said.doc_id),
counted AS (SELECT part, fails, count(*) AS n, count(*) FILTER (WHERE good) AS good, count(*) FILTER (WHERE toxic) AS toxic FROM flagged GROUP BY ALL),
letters AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS l),
orders AS (
  SELECT a.l || b.l || c.l || d.l || e.l AS filter_order FROM letters a, letters b, letters c, letters d, letters e
  WHERE len(list_distinct([a.l, b.l, c.l, d.l, e.l])) = 5),
steps AS (
  SELECT filter_order, step, 1 << (strpos('ABCDE', substr(filter_order, step, 1)) - 1) AS bit,
         coalesce(list_sum(list_transform(range(1, step), lambda i: 1 << (strpos('ABCDE', substr(filter_order, i, 1)) - 1))), 0)::INT AS earlier
  FROM orders, (SELECT unnest(range(1, 6))::INT AS step)),
summed AS (
  SELECT part, filter_order, step, bit,
         coalesce(sum(n) FILTER (WHERE fails & (earlier | bit) = 0), 0)::BIGINT AS kept,
         coalesce(sum(n) FILTER (WHERE fails & earlier = 0 AND fails & bit <> 0), 0)::BIGINT AS removed,
         coalesce(sum(n) FILTER (WHERE fails & earlier <> 0 AND fails & bit <> 0), 0)::BIGINT AS redundant,
         coalesce(sum(n) FILTER (WHERE fails = bit), 0)::BIGINT AS unique_fails,
         coalesce(sum(good) FILTER (WHERE fails & earlier = 0 AND fails & bit <> 0), 0)::BIGINT AS good_lost,
         coalesce(sum(toxic) FILTER (WHERE fails & earlier = 0 AND fails & bit <> 0), 0)::BIGINT AS toxic_lost
  FROM counted, steps GROUP BY ALL)
SELECT part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost,
       (sum(removed) OVER (PARTITION BY part, bit))::BIGINT AS shapley
FROM summed
"""
