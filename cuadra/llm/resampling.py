"""Resampling of documents towards a target distribution by importance weights over hashed word runs.

Both the corpus and the target are counted in the same buckets. A bucket's gain is the log of how much likelier
the target makes it; a document's weight is the mean gain of its runs, looked up in one array. Hashed Gumbel
noise is added, which makes the highest scores a draw without replacement. Scores are integers in a narrow
range, so their exact histogram is small: its suffix sums say how many documents stand before each score and
where the cutoff lies, and only documents at or above it are put in order, each score on its own.
"""

from __future__ import annotations

import hashlib
import math
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ._common import columns, cut, table

#: Words of the longest run, number of buckets, words of a document that may be drawn, per cent drawn.
RUNS, BUCKETS, LEAST_WORDS, PERCENT = 1, 10_000, 20, 10
SEED = "2024"
#: Buckets of words that a task remembers, and repeats of a row that are numbered at a time.
REMEMBERED, CHUNK = 200_000, 100_000

#: A-Z in lower case; what is neither a letter or digit of ASCII nor beyond ASCII is a blank.
_WORDS = bytes(b + 32 if 65 <= b <= 90 else b if b >= 128 or 48 <= b <= 57 or 97 <= b <= 122 else 32 for b in range(256))


def features(text: bytes | None, runs: int) -> list[bytes]:
    """All runs of 1 to `runs` words; the single words come first."""
    words = (text or b"").translate(_WORDS).split()
    out = list(words) if runs > 1 else words
    for n in range(2, runs + 1):
        out.extend(b" ".join(words[i : i + n]) for i in range(len(words) - n + 1))
    return out


class Buckets(dict):
    """Bucket of a feature, remembered for `most` short ones."""

    def __init__(self, size: int, most: int):
        super().__init__()
        self.size, self.most = size, most

    def __missing__(self, feature: bytes) -> int:
        at = zlib.crc32(feature) % self.size
        if len(feature) <= 64:
            if len(self) >= self.most:
                self.clear()
            self[feature] = at
        return at

    def of(self, found: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, found), np.int64, len(found))


def counts(texts: DataFrame, runs: int, buckets: int) -> np.ndarray:
    """Features of all texts by bucket; no more than a number for each bucket reaches the driver."""
    most = REMEMBERED

    def count(batches):
        of, sums = Buckets(buckets, most), np.zeros(buckets, np.int64)
        for batch in batches:
            for text in batch.column("text"):
                sums += np.bincount(of.of(features(text.as_py(), runs)), minlength=buckets)
        at = np.flatnonzero(sums)
        yield pa.RecordBatch.from_pydict({"bucket": pa.array(at, pa.int32()), "n": pa.array(sums[at], pa.int64())})

    summed = texts.select(F.col("text").cast("string").cast("binary").alias("text")).mapInArrow(count, "bucket int, n long").groupBy("bucket").agg(F.sum("n").alias("n"))
    out = np.zeros(buckets, np.int64)
    for r in summed.collect():
        out[r["bucket"]] = r["n"]
    return out


def gains(source: np.ndarray, target: np.ndarray) -> np.ndarray:
    """floor(1000 ln) of the smoothed share in the target over that in the source, for each bucket."""
    size, s_all, t_all = len(source), int(source.sum()), int(target.sum())
    return np.array([math.floor(1000 * math.log(float(t + 1) * float(s_all + size) / (float(s + 1) * float(t_all + size)))) for s, t in zip(source.tolist(), target.tolist(), strict=True)], np.int64)


def noise(doc_id: int | None, seed: str) -> int:
    """Gumbel noise times 1000 from a hash of the id; a null id is hashed as an empty one."""
    h = int(hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()[:8], 16)
    return math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))


def scored(docs: DataFrame, gain: np.ndarray, runs: int = RUNS, seed: str = SEED) -> DataFrame:
    """(doc_id, n_features, n_words, weight, score) of every document."""
    shared, most = docs.sparkSession.sparkContext.broadcast(gain), REMEMBERED

    def score(batches):
        gain = shared.value
        of = Buckets(len(gain), most)
        for batch in batches:
            rows = []
            for doc_id, text in zip(batch.column("doc_id").to_pylist(), batch.column("text"), strict=True):
                found = features(text.as_py(), runs)
                n = len(found)
                weight = int(gain[of.of(found)].sum()) // n if n else 0
                # with n words there are n + (n - 1) + ... runs
                words = n if runs == 1 else len((text.as_py() or b"").translate(_WORDS).split())
                rows.append((n, words, weight, weight + noise(doc_id, seed)))
            cols = [pa.array(c, pa.int64()) for c in zip(*rows, strict=True)] or [pa.array([], pa.int64())] * 4
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *cols], names=["doc_id", "n_features", "n_words", "weight", "score"])

    narrow = columns(docs, doc_id="long", text="string")
    return narrow.select("doc_id", F.col("text").cast("binary").alias("text")).mapInArrow(score, "doc_id long, n_features long, n_words long, weight long, score long")


def ranked(scores: DataFrame, least_words: int = LEAST_WORDS, percent: int = PERCENT) -> DataFrame:
    """Add `rank` to (doc_id, n_features, n_words, weight, score), a frame that is written: null for what isn't drawn.

    A score lies within some 250,000 integers whatever the input (gains are at most 1000 ln of a ratio of
    counts, noise between -3,200 and 22,900), so the histogram and its sums are small. Hashed noise gives a single
    score less than 0.04 % of the documents of one weight; rows that are alike are counted before they meet,
    and get their ranks in chunks.
    """
    fit = F.col("n_words") >= least_words
    histogram = cut(scores.where(fit).groupBy("score").agg(F.count("*").alias("n")))
    take = (histogram.agg(F.sum("n")).first()[0] or 0) * percent // 100
    # one row a score: those before a score are in higher ones
    before = (F.sum("n").over(Window.orderBy(F.desc("score"))) - F.col("n")).alias("before")
    offsets = cut(histogram.select(F.col("score").alias("of"), before).where(F.col("before") < take))
    cutoff = offsets.agg(F.min("of")).first()[0]
    kept = ["doc_id", "n_features", "weight", "score"]
    if cutoff is None:
        return scores.select(*kept, F.lit(None).cast("long").alias("rank"))
    drawn = fit & (F.col("score") >= cutoff)
    alike = scores.where(drawn).groupBy(*kept).agg(F.count("*").alias("n")).join(F.broadcast(offsets), F.col("score") == F.col("of"))
    # row_number by doc_id within each score, of rows that may stand for several
    order = Window.partitionBy("score").orderBy(F.col("doc_id").asc_nulls_last(), "n_features", "weight").rowsBetween(Window.unboundedPreceding, 0)
    last = alike.withColumn("last", F.col("before") + F.sum("n").over(order))
    first = F.col("last") - F.col("n") + 1
    chunks = last.select(*kept, "last", F.explode(F.sequence(first, F.col("last"), F.lit(CHUNK).cast("long"))).alias("from")).repartition("doc_id", "from")
    each = chunks.select(*kept, F.explode(F.sequence(F.col("from"), F.least(F.col("last"), F.col("from") + CHUNK - 1))).alias("rank"))
    each = each.withColumn("rank", F.when(F.col("rank") <= take, F.col("rank")))
    return each.unionByName(scores.where(~drawn).select(*kept, F.lit(None).cast("long").alias("rank")))


def resample(docs: DataFrame, target: DataFrame, runs: int = RUNS, buckets: int = BUCKETS, least_words: int = LEAST_WORDS, percent: int = PERCENT, seed: str = SEED) -> DataFrame:
    """(doc_id, n_features, weight, score, rank) of every document of `docs`; `target` has a column text.

    Words are runs of ASCII letters and digits and of all characters beyond ASCII, A-Z in lower case, whole
    texts, null without any. Of the documents with `least_words` words, `percent` per cent (rounded down) with
    the highest scores are ranked, ties to the smaller doc_id, null last. A text without words has weight 0.
    Repeated rows are documents of their own; those alike in every column take neighbouring ranks. An empty
    corpus gives no rows, an empty target makes rare words worth more. Other columns are left out.
    """
    gain = gains(counts(docs, runs, buckets), counts(target, runs, buckets))
    return ranked(cut(scored(docs, gain, runs, seed)), least_words, percent)


def op12_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


#: crc32 is written out over the bytes of each distinct word.
OP12_SQL = rf"""
WITH steps AS (
  SELECT list_transform(range(256), lambda i: list_reduce(range(8), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, i)) AS t),
docs AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(lower_ascii, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS words
  FROM (SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS lower_ascii FROM documents)),
targets AS (SELECT unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')) AS word FROM benchmark),
uses AS (SELECT r, word, count(*)::BIGINT AS n FROM (SELECT r, unnest(words) AS word FROM docs) GROUP BY ALL),
known AS (
  SELECT word, xor(list_reduce(list_transform(range(strlen(word)), lambda i: ('0x' || substr(hex(word), 2 * i + 1, 2))::BIGINT),
                               lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1]), 4294967295::BIGINT), 4294967295) % {BUCKETS} AS bucket
  FROM (SELECT word FROM uses UNION SELECT word FROM targets), steps),
s AS (SELECT bucket, sum(n)::BIGINT AS s FROM uses JOIN known USING (word) GROUP BY bucket),
t AS (SELECT bucket, count(*)::BIGINT AS t FROM targets JOIN known USING (word) GROUP BY bucket),
gained AS (
  SELECT bucket, floor(1000 * ln((coalesce(t, 0) + 1)::DOUBLE * ((SELECT sum(s) FROM s) + {BUCKETS})::DOUBLE
                                 / ((s + 1)::DOUBLE * (coalesce((SELECT sum(t) FROM t), 0) + {BUCKETS})::DOUBLE)))::BIGINT AS gain
  FROM s LEFT JOIN t USING (bucket)),
weighed AS (SELECT r, floor(sum(n * gain)::DOUBLE / sum(n)::DOUBLE)::BIGINT AS weight FROM uses JOIN known USING (word) JOIN gained USING (bucket) GROUP BY r),
scored AS (
  SELECT d.r, doc_id, len(words)::BIGINT AS n_features, coalesce(weight, 0) AS weight,
         coalesce(weight, 0) + floor(-1000 * ln(-ln((('0x' || substr(sha256('{SEED}:' || coalesce(doc_id::VARCHAR, '')), 1, 8))::BIGINT + 0.5::DOUBLE) / 4294967296::DOUBLE)))::BIGINT AS score
  FROM docs d LEFT JOIN weighed w ON d.r = w.r),
placed AS (
  SELECT r, row_number() OVER (ORDER BY score DESC, doc_id NULLS LAST, n_features, weight) AS place, count(*) OVER () * {PERCENT} // 100 AS take
  FROM scored WHERE n_features >= {LEAST_WORDS})
SELECT doc_id, n_features, weight, score, CASE WHEN place <= take THEN place END AS rank FROM scored LEFT JOIN placed USING (r)
"""
