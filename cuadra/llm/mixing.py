"""Mixing sources to target weights, in DataFrame functions only.

Words are added up per source, targets give each source a repetition rate, and every document is taken
floor(rate) times plus once more where a hash of it, read as a number in [0, 1), is below the fraction. Each
document has DRAWS such numbers; of these a source uses the one that brings its words nearest to its target.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ._common import columns, count_words, cut, few, table

#: No source is taken more often than this.
MOST = 3
SEED = "mix-1"
#: Draws of which a source takes the best: 12 hexadecimal digits of a document's hash each, from the first, second, ... on.
DRAWS = 20


def _hash(doc_id: Column, text: Column) -> Column:
    seen = F.concat_ws("|", F.lit(SEED), F.coalesce(doc_id.cast("long").cast("string"), F.lit("-")), F.md5(F.encode(F.coalesce(text.cast("string"), F.lit("")), "UTF-8")))
    return F.md5(F.encode(seen, "UTF-8"))


def _unit(hashed: Column, draw: int | Column) -> Column:
    return F.conv(F.substring(hashed, draw, 12 if isinstance(draw, int) else F.lit(12)), 16, 10).cast("long") / F.lit(float(2**48))


def _sized(docs: DataFrame) -> DataFrame:
    narrow = columns(docs, doc_id="long", source="string", text="string")
    return narrow.select("doc_id", "source", count_words(F.col("text")).alias("size"), _hash(F.col("doc_id"), F.col("text")).alias("hashed"))


def targets(sized: DataFrame, most: int = MOST) -> DataFrame:
    """For each source its size and target: weights 1, 2, 3, 1, ... by code point, null last.

    The total is shared by weight; a target stops at `most` times the source's size and the excess is
    shared again among the others. With sources in the order of most * size / weight, those that stop are
    the first ones, so the level at which the others stand follows from running sums over the sources.
    """
    by = sized.groupBy("source").agg(F.sum("size").alias("source_size"))
    # one row a source from here on
    rank = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    by = by.withColumn("weight", (rank % 3 + 1).cast("long")).withColumn("cap", F.col("source_size") * most)
    rising = Window.orderBy(F.col("cap") / F.col("weight"), F.col("source").asc_nulls_last())
    before = rising.rowsBetween(Window.unboundedPreceding, -1)
    every = Window.partitionBy()
    by = by.withColumns(
        {
            "left": F.sum("source_size").over(every) - F.coalesce(F.sum("cap").over(before), F.lit(0)),
            "weights": F.sum("weight").over(every) - F.coalesce(F.sum("weight").over(before), F.lit(0)),
        }
    )
    stops = F.col("cap") * F.col("weights") <= F.col("left") * F.col("weight")
    by = by.withColumn("stops", stops)
    # the first source that does not stop has what is left for it and all after it
    open_ = F.min(F.when(~F.col("stops"), F.struct(F.col("cap") / F.col("weight"), F.coalesce(F.col("source"), F.lit("")), F.col("left"), F.col("weights")))).over(every)
    level = F.col("weight") * open_["left"] / open_["weights"]
    return by.select("source", "source_size", F.when(F.col("stops"), F.col("cap").cast("double")).otherwise(level).alias("target"))


def rates(sized: DataFrame, most: int = MOST) -> DataFrame:
    """For each source its size, target, rate and best draw (the first of the best): one row a source."""
    by = cut(targets(sized, most).withColumn("rate", F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))))
    each = sized.join(few(by.select(F.col("source").alias("of"), (F.col("rate") - F.floor("rate")).alias("part"))), F.col("source").eqNullSafe(F.col("of")))
    sums = each.groupBy("of").agg(*(F.sum(F.when(_unit(F.col("hashed"), k) < F.col("part"), F.col("size")).otherwise(0)).alias(f"d{k}") for k in range(1, DRAWS + 1)))
    off = lambda k: F.abs(F.floor("rate") * F.col("source_size") + F.col(f"d{k}") - F.col("target"))
    best = F.array_min(F.array(*(F.struct(off(k).alias("off"), F.lit(k).alias("draw")) for k in range(1, DRAWS + 1))))
    return cut(by.join(few(cut(sums)), F.col("source").eqNullSafe(F.col("of"))).select(F.col("source").alias("of"), "source_size", "target", "rate", best["draw"].alias("draw")))


def _copies(most: int) -> Column:
    copies = F.floor("rate") + F.when(_unit(F.col("hashed"), F.col("draw")) < F.col("rate") - F.floor("rate"), 1).otherwise(0)
    return F.least(copies.cast("long"), F.lit(most).cast("long"))


def mix(docs: DataFrame, most: int = MOST) -> DataFrame:
    """How many words the mix takes of every document, repeats counted.

    A null text has size 0, so nothing is taken of it; null sources form one source, ordered last. Rows that
    are equal in id and text are taken alike. Sources without words have target 0. An empty table gives no
    rows. `copies` says how often the document is to be emitted.
    """
    sized = cut(_sized(docs))
    mixed = sized.join(few(rates(sized, most)), F.col("source").eqNullSafe(F.col("of"))).withColumn("copies", _copies(most))
    return mixed.select("doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"), "copies")


def emit(docs: DataFrame, most: int = MOST) -> DataFrame:
    """The mixed corpus itself: every document of `docs` as often as the mix takes it, with all its columns."""
    by = few(rates(cut(_sized(docs)), most))
    inside = docs.select(F.struct("*").alias("row"), docs["source"].cast("string").alias("source"), _hash(docs["doc_id"], docs["text"]).alias("hashed"), count_words(docs["text"]).alias("size"))
    times = F.when(F.col("size") > 0, _copies(most)).otherwise(0).cast("int")
    mixed = inside.join(by, F.col("source").eqNullSafe(F.col("of"))).where(times > 0)
    return mixed.select(F.explode(F.array_repeat(F.col("row"), times)).alias("row")).select("row.*")


def op7_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(table(spark, sf_dir, "documents"))


#: The same in SQL: the targets by rounds of stopping, written as running sums.
OP7_SQL = rf"""
WITH sized AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size,
         md5('{SEED}|' || coalesce(doc_id::VARCHAR, '-') || '|' || md5(coalesce(text, ''))) AS hashed
  FROM documents),
by_source AS (SELECT source, sum(size)::BIGINT AS source_size FROM sized GROUP BY source),
weighed AS (SELECT *, ((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1)::BIGINT AS weight, source_size * {MOST} AS cap FROM by_source),
summed AS (
  SELECT *, (sum(source_size) OVER ()
             - coalesce(sum(cap) OVER (ORDER BY cap::DOUBLE / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))::BIGINT AS rest,
         (sum(weight) OVER ()
             - coalesce(sum(weight) OVER (ORDER BY cap::DOUBLE / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))::BIGINT AS weights
  FROM weighed),
stopped AS (SELECT *, cap * weights <= rest * weight AS stops FROM summed),
level AS (SELECT rest, weights FROM stopped WHERE NOT stops ORDER BY cap::DOUBLE / weight, source NULLS LAST LIMIT 1),
goal AS (
  SELECT source, source_size,
         CASE WHEN stops THEN cap::DOUBLE ELSE (weight * (SELECT rest FROM level))::DOUBLE / (SELECT weights FROM level)::DOUBLE END AS target
  FROM stopped),
rated AS (SELECT *, CASE WHEN source_size > 0 THEN target / source_size::DOUBLE ELSE 0.0::DOUBLE END AS rate FROM goal),
drawn AS (
  SELECT source, k, sum(CASE WHEN ('0x' || substr(hashed, k, 12))::BIGINT / 281474976710656.0::DOUBLE < rate - floor(rate) THEN size ELSE 0 END) AS words
  FROM (SELECT s.source, s.hashed, s.size, r.rate, unnest(range(1, {DRAWS} + 1)) AS k FROM sized s JOIN rated r ON s.source IS NOT DISTINCT FROM r.source) GROUP BY ALL),
best AS (
  SELECT r.source, arg_min(d.k, struct_pack(off := abs(floor(r.rate) * r.source_size + d.words - r.target), k := d.k)) AS draw
  FROM rated r JOIN drawn d ON r.source IS NOT DISTINCT FROM d.source GROUP BY r.source)
SELECT doc_id, size, source_size, target, copies * size AS taken, copies
FROM (
  SELECT doc_id, size, source_size, target,
         least((floor(rate) + CASE WHEN ('0x' || substr(hashed, draw, 12))::BIGINT / 281474976710656.0::DOUBLE < rate - floor(rate) THEN 1 ELSE 0 END)::BIGINT, {MOST}) AS copies
  FROM sized JOIN rated ON sized.source IS NOT DISTINCT FROM rated.source JOIN best ON sized.source IS NOT DISTINCT FROM best.source)
"""
