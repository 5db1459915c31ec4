"""Sharding by sampled splitters, in DataFrame functions only.

Records are put in the order of a key that equal texts share, a size-weighted sample of the keys gives
quantile boundaries, and what the boundaries part is range-partitioned. Ranges that are still too full
(one key with very many records) are subdivided by a hash of the record. Ranges are then laid end to end
over the shards, so that shards hold nearly the same number of bytes. All of this follows from ids, sizes and
checksums; only among rows that are equal in all three does the place in the input decide.
"""

from __future__ import annotations

import bisect
import math
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ._common import columns, cut, few, table

#: Ranges for each shard: a shard's size is off by half a range at most.
RANGES_PER_SHARD = 256
#: Sampled keys for each range (expected); bounds what the driver gets.
SAMPLES_PER_RANGE = 16
SCHEMA = "doc_id long, size long, text_crc32 long, law string, shard int, slot long, grown_shard int"


IDENTITY = ["doc_id", "size", "text_crc32"]


def _measured(docs: DataFrame) -> DataFrame:
    """Add size, text_crc32 and place, dropping columns of these names."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    sized = docs.drop("size", "text_crc32", "place").withColumns({"size": (F.octet_length(text) + 1).cast("long"), "text_crc32": F.crc32(F.encode(text, "UTF-8"))})
    return sized.withColumn("place", F.monotonically_increasing_id())


def _range_of(splitters: list[int]):
    """How many splitters are <= the key: binary search over a padded literal array."""
    steps = max(1, math.ceil(math.log2(len(splitters) + 1)))
    padded = splitters + [2**62] * (2**steps - len(splitters))
    array = F.array(*[F.lit(x).cast("long") for x in padded])

    def step(at, jump):
        return F.when(F.get(array, at + jump - 1) <= F.col("text_crc32"), at + jump).otherwise(at)

    return F.aggregate(F.array(*[F.lit(2**k) for k in reversed(range(steps))]), F.lit(0), step)


@dataclass
class Plan:
    """Boundaries of the ranges, parts of those that were too full, and the shard of each part with its first slot."""

    splitters: list[int]
    cuts: dict[int, int]
    laid: list[tuple[int, int, int, int]]
    #: (t_id, t_size, t_crc) of rows that occur again, or None where none does
    twice: DataFrame | None


def _parted(records: DataFrame, splitters: list[int], cuts: dict[int, int], twice: DataFrame | None) -> DataFrame:
    ranged = records.withColumn("range", _range_of(splitters))
    parts = F.coalesce(F.create_map(*[F.lit(x) for kv in cuts.items() for x in kv])[F.col("range")], F.lit(1)) if cuts else F.lit(1)
    tie = F.lit(0).cast("long")
    if twice is not None and cuts:
        again = F.col("doc_id").eqNullSafe(F.col("t_id")) & (F.col("size") == F.col("t_size")) & (F.col("text_crc32") == F.col("t_crc"))
        ranged = ranged.join(twice, again, "left")
        tie = F.when(F.col("t_size").isNotNull(), F.col("place")).otherwise(tie)
    part = F.pmod(F.xxhash64(*IDENTITY, tie, F.lit("part")), parts).cast("int")
    return ranged.withColumn("part", part).drop("t_id", "t_size", "t_crc")


def plan(records: DataFrame, n_shards: int) -> Plan | None:
    """The plan for measured and written records; None where there are none. A few numbers for each range reach the driver."""
    alike = cut(records.groupBy(*IDENTITY).agg(F.count("*").alias("n")))
    total = alike.agg(F.sum(F.col("size") * F.col("n"))).first()[0]
    if not total:
        return None
    twice = alike.where("n > 1").select(F.col("doc_id").alias("t_id"), F.col("size").alias("t_size"), F.col("text_crc32").alias("t_crc"))
    twice = None if twice.isEmpty() else few(cut(twice))
    wanted = n_shards * RANGES_PER_SHARD
    rate = min(1.0, wanted * SAMPLES_PER_RANGE / total)
    # a key is drawn with the probability bytes * rate, decided by its hash; a draw above 1 weighs more
    keys = alike.groupBy("text_crc32").agg(F.sum(F.col("size") * F.col("n")).alias("bytes"))
    unit = F.pmod(F.xxhash64("text_crc32", F.lit("draw")), F.lit(2**30)) / F.lit(float(2**30))
    drawn = keys.where(unit < F.col("bytes") * rate).select("text_crc32", F.greatest(F.col("bytes") * rate, F.lit(1.0)).alias("weight"))
    sample = sorted((r[0], r[1]) for r in drawn.collect())
    ends, run = [], 0.0
    for _, weight in sample:
        ends.append(run := run + weight)
    picked = sorted({sample[min(bisect.bisect_left(ends, run * k / wanted), len(sample) - 1)][0] for k in range(1, wanted)}) if sample else []
    # subdivide what holds more than its share twice over
    share = max(1.0, total / wanted)
    full = records.withColumn("range", _range_of(picked)).groupBy("range").agg(F.sum("size").alias("bytes")).collect()
    cuts = {r["range"]: math.ceil(r["bytes"] / share) for r in full if r["bytes"] > 2 * share}
    # lay the ranges end to end over the shards
    laid, before, slots = [], 0, [0] * n_shards
    parted = _parted(records, picked, cuts, twice)
    for r in sorted(parted.groupBy("range", "part").agg(F.sum("size").alias("bytes"), F.count("*").alias("n")).collect()):
        to = min(n_shards - 1, int((before + r["bytes"] / 2) * n_shards / total))
        laid.append((r["range"], r["part"], to, slots[to]))
        before, slots[to] = before + r["bytes"], slots[to] + r["n"]
    return Plan(picked, cuts, laid, twice)


def _placed(records: DataFrame, made: Plan) -> DataFrame:
    # at most a few rows for each range, whatever the input: small enough to broadcast
    places = F.broadcast(records.sparkSession.createDataFrame(made.laid, "range int, part int, shard int, first_slot long"))
    return _parted(records, made.splitters, made.cuts, made.twice).join(places, ["range", "part"])


def shard(docs: DataFrame, n_shards: int = 8) -> DataFrame:
    """Put every record into one of `n_shards` shards of nearly equal bytes (law `bytes`).

    Size is the UTF-8 length of the text plus 1; a null text counts as empty. Equal texts share a key and
    so lie together unless a boundary or a subdivided range parts them. Neither the order of the input nor how it is
    cut into files matters, but for records that are equal in id, size and checksum: these get different slots, and where
    very many of them fill a range they are dealt out by their place. Null ids are records like others. An empty table
    gives no rows. Extra columns are not carried. `slot` counts from 0 within a shard without gaps.
    """
    # places are written with the records, so that retries agree
    records = cut(_measured(columns(docs, doc_id="long", text="string")).drop("text"))
    made = plan(records, n_shards)
    if made is None:
        return docs.sparkSession.createDataFrame([], SCHEMA)
    order = Window.partitionBy("range", "part").orderBy("text_crc32", F.xxhash64(*IDENTITY), "doc_id", "size")
    return _placed(records, made).select(
        *IDENTITY,
        F.lit("bytes").alias("law"),
        "shard",
        (F.col("first_slot") + F.row_number().over(order) - 1).alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"),
    )


def write_shards(docs: DataFrame, path: str, n_shards: int = 8) -> None:
    """Write whole documents as one folder for each shard, several files each where a shard is large.

    Every row is written once, with null or repeated ids too, in the shard that `shard` gives it; rows that are equal in
    id, size and checksum are interchangeable there. Columns named shard, size, text_crc32, place, range, part or first_slot
    are left out. An empty table writes nothing but the folder.
    """
    made = plan(cut(_measured(columns(docs, doc_id="long", text="string")).drop("text")), n_shards)
    rest = docs.drop("shard", "range", "part", "first_slot")
    if made is None:
        rest.withColumn("shard", F.lit(0)).drop("size", "text_crc32", "place").write.partitionBy("shard").parquet(path)
        return
    placed = _placed(_measured(rest.withColumn("doc_id", F.col("doc_id").cast("long"))), made)
    placed.drop("range", "part", "first_slot", "size", "text_crc32", "place").write.partitionBy("shard").parquet(path)


def op10_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shard(table(spark, sf_dir, "documents"))
