"""Filter audit, resampling and line dedup against brute force, with odd inputs."""

import collections
import hashlib
import itertools
import math
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from cuadra.llm import filter_audit, line_dedup, pieces, resampling, sharding

from .test_operators import ODD, docs, words

BLANKS = " \t\n\v\f\r"


def lower(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text)


def test_filter_audit_equals_brute_force(spark):
    rng = random.Random(5)
    vocabulary = [f"w{k}" for k in range(400)]
    rows = [*ODD, (None, "some text without an id"), (7, "another"), (3, "same"), (9, "same"), (8, "same"), (8, "same"), (None, "same")]
    for k in range(60):
        text = " ".join(rng.choices(vocabulary[: rng.choice([20, 400])], k=rng.randint(150, 300))) + rng.choice(["", " #", " |x"])
        rows.append((20 + k, text.upper() if k % 4 == 0 else text))
    labels = [(i, rng.choice([None, 0, 1]), rng.choice([None, 0, 1])) for i in [*range(5, 50), 8, 8, 8]] + [(None, 1, 1)]
    frame = docs(spark, rows).withColumn("part", F.lit("clash")).withColumn("source", F.when(F.col("doc_id") % 5 == 0, F.lit("")).otherwise(F.col("source"))).repartition(5)
    got = filter_audit.audit(frame, spark.createDataFrame(labels, "doc_id long, quality int, toxic int").withColumn("part", F.lit(1))).collect()
    held = collections.defaultdict(list)
    for i, text in rows:
        text, ws = text or "", words(text)
        n = len(ws)
        fail = {"A": n < 200, "B": 100 * len(set(ws)) < 50 * n, "C": 100 * len(re.findall("[A-Z]", text)) > 2 * len(text), "D": bool(re.search("[#$%&*|]", text))}
        fail["E"] = i is not None and any((t or "") == text and j is not None and j < i for j, t in rows)
        source = "" if i is None or i % 5 == 0 else "s1" if i % 2 == 0 else None
        mine = [x for x in labels if x[0] == i and i is not None]
        held[source or ""].append((fail, any(x[1] == 1 for x in mine), any(x[2] == 1 for x in mine)))
    want, shapley = {}, collections.Counter()
    for part, members in held.items():
        for order in map("".join, itertools.permutations("ABCDE")):
            for step, f in enumerate(order, start=1):
                early = lambda m: any(m[0][x] for x in order[: step - 1])  # noqa: B023, E731
                gone = [m for m in members if m[0][f] and not early(m)]
                shapley[part, f] += len(gone)
                kept = sum(not any(m[0][x] for x in order[:step]) for m in members)
                only = sum(m[0][f] and sum(m[0].values()) == 1 for m in members)
                want[part, order, step] = (kept, len(gone), sum(m[0][f] and early(m) for m in members), only, sum(m[1] for m in gone), sum(m[2] for m in gone))
    assert len(got) == len(want) == 600 * len(held)
    for r in got:
        key = (r["part"], r["filter_order"], r["step"])
        assert (r["kept"], r["removed"], r["redundant"], r["unique_fails"], r["good_lost"], r["toxic_lost"]) == want[key]
        assert r["shapley"] == shapley[r["part"], r["filter_order"][r["step"] - 1]]
    assert filter_audit.audit(docs(spark, []), spark.createDataFrame([], "doc_id long, quality int, toxic int")).count() == 0


def test_interactions_of_more_parts_than_are_held(spark, monkeypatch):
    monkeypatch.setattr(filter_audit, "HELD", 3)
    flags = spark.range(200).select((F.col("id") % 17).cast("string").alias("part"), (F.col("id") % 8).cast("int").alias("fails"), (F.col("id") % 3 == 0).alias("x"))
    got = {(r["part"], r["before"], r["filter"]): r for r in filter_audit.interactions(flags, "PQR", ["x"]).collect()}
    assert len(got) == 17 * 12
    for (part, before, f), r in got.items():
        own = [k for k in range(200) if str(k % 17) == part]
        gone = [k for k in own if not k % 8 & before and k % 8 >> f & 1]
        assert (r["removed"], r["x"], r["kept"]) == (len(gone), sum(k % 3 == 0 for k in gone), sum(not k % 8 & (before | 1 << f) for k in own))


@pytest.mark.parametrize(("runs", "percent"), [(1, 10), (2, 35), (1, 100), (1, 0)])
def test_resampling_equals_brute_force(spark, monkeypatch, runs, percent):
    monkeypatch.setattr(resampling, "CHUNK", 2)
    monkeypatch.setattr(resampling, "REMEMBERED", 7)
    rng = random.Random(6)
    vocabulary = ["alpha", "Beta", "naïve", "x1", "été", "日本", "z" * 80, "q-r", "k"]
    rows = [*ODD, *((10 + k, " ".join(rng.choices(vocabulary, k=rng.randint(10, 60)))) for k in range(60)), *[(200, "alpha beta " * 30)] * 7, *[(None, "alpha k " * 30)] * 2]
    target = [(1, "alpha alpha naïve"), (2, None), (3, "unseen words")]
    buckets = 50

    def runs_of(text):
        ws = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower(text or ""))
        return ws, [" ".join(ws[i : i + n]) for n in range(1, runs + 1) for i in range(len(ws) - n + 1)]

    bucket = lambda f: zlib.crc32(f.encode()) % buckets
    s = collections.Counter(bucket(f) for _, t in rows for f in runs_of(t)[1])
    t = collections.Counter(bucket(f) for _, x in target for f in runs_of(x)[1])
    gain = [math.floor(1000 * math.log((t[b] + 1) * (s.total() + buckets) / ((s[b] + 1) * (t.total() + buckets)))) for b in range(buckets)]
    want = []
    for i, text in rows:
        ws, found = runs_of(text)
        weight = sum(gain[bucket(f)] for f in found) // len(found) if found else 0
        h = int(hashlib.sha256(f"2024:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        want.append((i, len(found), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), len(ws) >= 20))
    drawn = sorted((x for x in want if x[4]), key=lambda x: (-x[3], math.inf if x[0] is None else x[0], x[1], x[2]))[: sum(x[4] for x in want) * percent // 100]
    ranks = collections.defaultdict(list)
    for k, x in enumerate(drawn, start=1):
        ranks[x[:4]].append(k)
    got = resampling.resample(docs(spark, rows).repartition(4), spark.createDataFrame(target, "item_id long, text string"), runs=runs, buckets=buckets, percent=percent).collect()
    assert collections.Counter(tuple(r)[:4] for r in got) == collections.Counter(x[:4] for x in want)
    mine = collections.defaultdict(list)
    for r in got:
        if r["rank"] is not None:
            mine[tuple(r)[:4]].append(r["rank"])
    assert {k: sorted(v) for k, v in mine.items()} == ranks


def test_resampling_of_nothing(spark):
    empty = spark.createDataFrame([], "item_id long, text string")
    assert resampling.resample(docs(spark, []), empty).count() == 0
    got = resampling.resample(docs(spark, [(1, "one two " * 20), (2, None)]), empty, percent=100).collect()
    assert {r["doc_id"]: (r["n_features"], r["rank"]) for r in got} == {1: (40, 1), 2: (0, None)}


def dedup_brute(rows, least_docs=3, least_chars=20):
    keys = [[lower(x.strip(BLANKS)) for x in (t or "").split("\n")] for _, t in rows]
    holders = collections.defaultdict(list)
    for (i, _), own in zip(rows, keys, strict=True):
        for k in set(own):
            if len(k) >= least_chars:
                holders[k].append(-math.inf if i is None else i)
    gone = {k: max(v) for k, v in holders.items() if len(v) >= least_docs}
    out = []
    for (i, t), own in zip(rows, keys, strict=True):
        lines = (t or "").split("\n")
        lost = [k in gone and gone[k] != (-math.inf if i is None else i) for k in own]
        out.append((i, len(lines), sum(lost), "\n".join(x for x, z in zip(lines, lost, strict=True) if not z).encode()))
    return sorted(out, key=repr)


@pytest.mark.parametrize("most", [1_000_000, 0])
def test_line_dedup_equals_brute_force(spark, monkeypatch, most):
    monkeypatch.setattr(line_dedup, "CHUNK", 5)
    rng = random.Random(7)
    pool = [f"this is line number {k} of the pool" for k in range(12)] + ["exactly twenty chars", "nineteen characters", "ééééééééééééééééééée", "ééééééééééééééééééé", "日" * 20, "", "x"]
    dress = [lambda x: x, lambda x: f"\t {x}\r", lambda x: x.upper() if x.isascii() else x]
    rows = [*ODD, (None, "a line that only nameless rows hold"), (None, "a line that only nameless rows hold"), (None, "A LINE that only nameless rows hold\nx")]
    for k in range(50):
        rows.append((30 + k // 2 * (k % 3), "\n".join(rng.choice(dress)(rng.choice(pool)) for _ in range(rng.randint(1, 9))) + rng.choice(["", "\n", f"\nand an own line of document {k}"])))
    frame = docs(spark, rows).withColumn("kept", F.lit(1)).withColumn("last", F.lit(2)).repartition(4)
    got = sorted(((r[0], r[1], r[2], bytes(r[3])) for r in line_dedup.dedup(frame, most=most).collect()), key=repr)
    assert got == dedup_brute(rows) and sum(x[2] for x in got) > 20
    assert line_dedup.dedup(docs(spark, [])).count() == 0


def test_filters_miss_no_repeat_and_alarm_seldom(spark):
    rows = [(k, f"a line of its own, number {k}\nshared by ten documents: {k // 10}\nin two of them only: {k // 2}") for k in range(3000)]
    frame = docs(spark, rows, extra=False).repartition(7)
    twice = line_dedup.seen_twice(frame, 20, line_dedup.filter_bits(frame))
    hits = {bytes(r["key"]) for r in line_dedup.suspects(frame, twice, 20).collect()}
    digest = lambda x: hashlib.blake2b(x.encode(), digest_size=16).digest()
    assert all(digest(f"shared by ten documents: {k}") in hits for k in range(300)) and all(digest(f"in two of them only: {k}") in hits for k in range(1500))
    assert sum(digest(f"a line of its own, number {k}") in hits for k in range(3000)) < 30


def test_a_full_filter_only_costs_rows(spark, monkeypatch):
    monkeypatch.setattr(line_dedup, "MOST_BITS", 2**12)
    rows = [(k, f"a line of its own, number {k}\na line that everyone has in common") for k in range(4000)]
    got = line_dedup.dedup(docs(spark, rows, extra=False).repartition(3)).groupBy("n_dropped").count().collect()
    assert {r[0]: r[1] for r in got} == {1: 3999, 0: 1}


def test_confirmed_keys_that_share_half_their_hash():
    import pyarrow as pa

    halves = [np.array(x, np.uint64).tobytes() for x in ((5, 1), (5, 3), (5, 9), (7, 2))]
    known = line_dedup.Confirmed(pa.table({"key": pa.array(halves, pa.binary()), "last": pa.array([1, 2, None, 4])}))
    asked = [*halves, np.array((5, 4), np.uint64).tobytes(), np.array((9, 9), np.uint64).tobytes()]
    drops = lambda i, none: known.drops(asked, np.full(6, i), np.full(6, none)).tolist()
    assert drops(2, False) == [True, False, True, True, False, False]
    assert drops(0, True) == [True, True, False, True, False, False]


def shards_of(spark, frame):
    return sorted(map(tuple, sharding.shard(frame).collect()), key=repr)


@pytest.mark.parametrize("sizes", [(256, 16), (2, 1)])
def test_shards_are_the_same_under_any_layout(spark, monkeypatch, sizes):
    # with few ranges and samples, as large tables have, boundaries follow from a sparse draw
    monkeypatch.setattr(sharding, "RANGES_PER_SHARD", sizes[0])
    monkeypatch.setattr(sharding, "SAMPLES_PER_RANGE", sizes[1])
    rng = random.Random(8)
    rows = [(k if k % 50 else None, rng.choice(["x", "longer text "]) * rng.randint(0, 30) + str(k % 400)) for k in range(1500)]
    three, five = (shards_of(spark, docs(spark, r).repartition(n)) for n, r in ((3, rows), (5, rows[::-1])))
    assert three == five
    by = collections.defaultdict(list)
    for doc_id, size, crc, law, shard, slot, grown in three:
        by[shard].append((slot, size))
    assert sorted(by) == list(range(8)) and all(sorted(s for s, _ in v) == list(range(len(v))) for v in by.values())
    want = sorted((i, len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for i, t in rows if i is not None)
    assert sorted(r[:3] for r in three if r[0] is not None) == want
    if sizes[0] == 256:
        total = sum(size for v in by.values() for _, size in v)
        assert all(abs(sum(size for _, size in v) - total / 8) < total / 50 for v in by.values())
    # keys of a shard lie between those of its neighbours, but for ranges that were subdivided
    keys = {s: sorted(r[2] for r in three if r[4] == s) for s in by}
    assert sum(keys[s][-1] > keys[s + 1][0] for s in range(7)) <= (0 if sizes[0] == 256 else 7)


def test_whole_documents_are_written_to_their_shards(spark, tmp_path):
    rows = [*ODD, (None, "again"), (None, "again"), (7, "a text " * 50), *[(8, "copy")] * 900]
    frame = docs(spark, rows).withColumn("shard", F.lit("clash")).withColumn("own", F.length("text"))
    sharding.write_shards(frame, str(tmp_path / "s"))
    back = spark.read.parquet(str(tmp_path / "s"))
    got = sorted(((r["doc_id"], r["text"]) for r in back.collect()), key=repr)
    assert got == sorted(rows, key=repr) and {"own", "key", "shard"} <= set(back.columns)
    sizes = [r["b"] for r in back.groupBy("shard").agg(F.sum(F.coalesce(F.octet_length("text"), F.lit(0)) + 1).alias("b")).collect()]
    assert len(sizes) == 8 or max(sizes) > 20_000
    sharding.write_shards(docs(spark, []), str(tmp_path / "e"))
    assert (tmp_path / "e").exists()


def test_long_units_take_steps_as_they_have_characters(spark):
    import time

    import sentencepiece

    library = sentencepiece.SentencePieceProcessor(model_file=pieces.MODEL_FILE)
    rng = random.Random(9)
    letters = "".join(rng.choice("abcdefghij") for _ in range(5000))
    rows = [(1, "the" * 66_667), (2, letters), (3, "x" * 63 + "日本" * 40), (4, "".join(rng.choice("ACGT") for _ in range(20_000))), (5, "short words here"), (6, "\U0001f999" * 100)]
    model = pieces.Pieces.load()
    began = time.time()
    got = {r["doc_id"]: r["ids"] for r in pieces.encode(docs(spark, rows), model).collect()}
    took = time.time() - began
    assert all(got[i] == library.encode(t) for i, t in rows)
    assert took < 120
