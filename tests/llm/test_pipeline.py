import random
import re

from pyspark.sql import functions as F

import corpus_pipeline as pipeline


def documents(spark):
    rng = random.Random(1)
    vocab = {"aa": ["tion", "the", "ing", "and"], "bb": ["chen", "der", "ung", "ich"]}
    text = lambda l, n: " ".join(rng.choice(vocab[l]) + rng.choice(vocab[l]) for _ in range(n))
    rows = [(k, text(l, 120), l, f"s{k % 3}") for k, l in enumerate(rng.choice("ab") * 2 for _ in range(60))]
    passage = text("aa", 90)
    rows += [(100, rows[0][1], "aa", "s0"), (101, rows[1][1] + " x", "bb", "s1"), (102, None, "aa", None), (103, "12 34", "aa", "s0"), (104, passage + " " + text("aa", 60), "aa", "s1"), (105, text("aa", 60) + " " + passage, "aa", "s2")]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").withColumn("n_chars", F.length("text").cast("long"))


def test_stages_in_order(spark, tmp_path):
    docs = documents(spark)
    seen = {}
    for k, (name, stage) in enumerate(pipeline.STAGES):
        stage(spark, docs, str(tmp_path)).write.parquet(str(tmp_path / str(k)))
        docs = spark.read.parquet(str(tmp_path / str(k)))
        seen[name] = docs.collect()
        if k < 4:
            assert docs.columns == list(pipeline.DOCUMENTS)
    ids = {name: {r["doc_id"] for r in rows} for name, rows in seen.items()}
    assert ids["language ID"] == set(range(60)) | {100, 101, 104, 105}
    assert ids["n-gram Jaccard join"] == set(range(60)) | {104, 105}
    texts = {r["doc_id"]: r["text"] for r in seen["suffix-array dedup"]}
    before = {r["doc_id"]: r["text"] for r in seen["n-gram Jaccard join"]}
    assert all(texts[k] == before[k] for k in range(60)) and all(len(texts[k]) < len(before[k]) / 2 for k in (104, 105))
    assert ids["mixing sources"] <= ids["suffix-array dedup"]
    assert len(seen["SentencePiece"]) == len(seen["mixing sources"]) and all(r["ids"] for r in seen["SentencePiece"])


def test_clashing_and_null_ids_are_documents_of_their_own(spark, tmp_path):
    rng = random.Random(5)
    text = lambda: " ".join("".join(rng.choice("abcdef") for _ in range(5)) for _ in range(80))
    a, b, c, d = (text() for _ in range(4))
    near = a.split()
    near[40] = "other"
    near = " ".join(near)
    rows = [(1, a), (1, b), (2, near), (None, a), (None, c), (None, c), (3, d), (3, d), (4, d), (5, None), (5, None), (6, ""), (7, "few words"), (8, "few words")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumns({"lang": F.lit("aa"), "source": F.lit("s"), "n_chars": F.length("text").cast("long"), "key": F.lit("clash"), "rep": F.lit(0)})
    got = sorted(((r["doc_id"], r["text"]) for r in pipeline.near_duplicate_stage(spark, docs, str(tmp_path)).collect()), key=str)
    # of a and near: the row with the smallest id; rows without an id stay if nothing is like them; equal rows are one
    assert got == sorted([(1, a), (1, b), (None, c), (3, d), (5, None), (6, ""), (7, "few words")], key=str)


def test_every_stage_takes_an_empty_table_and_odd_rows(spark, tmp_path):
    odd = [(None, "word one two three"), (1, None), (2, ""), (3, "same text of words"), (3, "same text of words"), (4, "x" * 3000), (5, " \n ")]
    frame = spark.createDataFrame(odd, "doc_id long, text string").withColumns({"lang": F.when(F.col("doc_id") > 1, F.lit("aa")), "source": F.lit(None).cast("string"), "n_chars": F.length("text").cast("long"), "ids": F.lit(1), "n_words": F.lit("x")})
    for docs in (frame, frame.where("false")):
        for k, (_, stage) in enumerate(pipeline.STAGES):
            got = stage(spark, docs, str(tmp_path)).collect()
            assert len(got) <= 3 * len(odd) and (docs is frame or not got)


def test_near_duplicates_and_repeats_equal_brute_force(spark, tmp_path):
    rng = random.Random(6)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(rng.randint(2, 6)))
    base = [[word() for _ in range(rng.randint(60, 140))] for _ in range(8)]
    passage = [word() for _ in range(58)]
    rows = []
    for k in range(40):
        ws = list(rng.choice(base))
        for _ in range(rng.choice([0, 1, 2, 8])):
            ws[rng.randrange(len(ws))] = word()
        rows.append((k, " ".join(ws[:20] + passage + ws[20:] if k % 7 == 0 else ws)))
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumns({"lang": F.lit("aa"), "source": F.lit("s"), "n_chars": F.length("text").cast("long")})
    sets = {i: set(zip(*(t.split()[j:] for j in range(5)), strict=False)) for i, t in rows}
    root = {i: i for i in sets}
    for _ in sets:
        for a in sets:
            for b in sets:
                if len(sets[a] & sets[b]) * 10 >= 8 * len(sets[a] | sets[b]):
                    root[a] = root[b] = min(root[a], root[b])
    kept = pipeline.near_duplicate_stage(spark, docs, str(tmp_path))
    left = {i: t for i, t in rows if root[i] == i}
    assert {r["doc_id"]: r["text"] for r in kept.collect()} == left and 8 < len(left) < 30
    places = {}
    for i, t in left.items():
        ws = t.split()
        for p in range(len(ws) - 50):
            places.setdefault(tuple(ws[p : p + 51]), []).append((i, p))
    raw = {i: t.encode() for i, t in left.items()}
    strings = {}
    for i, t in raw.items():
        for p in range(len(t) - 399):
            strings.setdefault(t[p : p + 400], []).append((i, p))
    gone = {(i, q) for at in strings.values() if len(at) > 1 for i, p in at for q in range(p, p + 400)}
    for at in places.values():
        for i, p in at if len(at) > 1 else ():
            ends = [m.span() for m in re.finditer(r"\S+", left[i])]
            gone |= {(i, q) for q in range(ends[p][0], ends[p + 50][1])}
    want = {i: bytes(x for q, x in enumerate(t) if (i, q) not in gone).decode() for i, t in raw.items()}
    got = {r["doc_id"]: r["text"] for r in pipeline.repeats_stage(spark, kept, str(tmp_path)).collect()}
    assert got == {i: t for i, t in want.items() if t.strip()} and any(want[i] != left[i] for i in left)


def test_run_reads_documents(spark, tmp_path):
    documents(spark).write.parquet(str(tmp_path / "documents.parquet"))
    assert pipeline.run(spark, str(tmp_path)).count() > 0


def test_repeats_of_51_short_words_go(spark, tmp_path):
    rng = random.Random(2)
    word = lambda n: "".join(rng.choice("abcdefghij") for _ in range(n))
    text = lambda n, size: " ".join(word(size) for _ in range(n))
    short, letters, longer, near, run = text(51, 4), text(60, 1), text(60, 5), text(50, 5), word(450)
    shared = [(short, short), (letters, letters), (longer, longer.replace(" ", "\n", 9)), (near, near), (run, run)]
    rows = [(2 * k + side, f"{text(30, 6)} {part} {text(30, 6)}") for k, pair in enumerate(shared) for side, part in enumerate(pair)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumns({"lang": F.lit("aa"), "source": F.lit("s"), "n_chars": F.length("text").cast("long")})
    got = {r["doc_id"]: r["text"] for r in pipeline.repeats_stage(spark, docs, str(tmp_path)).collect()}
    for k, pair in enumerate(shared):
        for side, part in enumerate(pair):
            i = 2 * k + side
            if part is run:
                # one word of over 400 bytes is a repeated string, which may reach into its neighbours
                assert 300 < len(got[i]) < 450
            else:
                assert got[i].split() == (dict(rows)[i] if part is near else dict(rows)[i].replace(part, "")).split(), i


def test_texts_in_several_languages_stay(spark, tmp_path):
    rng = random.Random(3)
    vocab = {l: ["".join(rng.choice("abcdefghijklmnop") for _ in range(4)) for _ in range(8)] for l in ("aa", "bb", "cc", "dd", "ee", "ff")}
    text = lambda l, n: " ".join(rng.choice(vocab[l]) + rng.choice(vocab[l]) for _ in range(n))
    rows = [(k, text(l, 60), l) for k, l in enumerate(l for l in vocab for _ in range(12))]
    # more letters in aa, more words in bb
    both = [(1000 + k, text("aa", 30) + " " + " ".join(rng.choice(vocab["bb"]) for _ in range(50)), None) for k in range(40)]
    several = [(2000, " ".join(text(l, 20) for l in vocab), None)]
    frame = spark.createDataFrame([*rows, *both, *several, (3000, "12 34", None)], "doc_id long, text string, lang string").withColumns({"source": F.lit("s"), "n_chars": F.length("text").cast("long")})
    got = {r["doc_id"]: r["lang"] for r in pipeline.language_stage(spark, frame, str(tmp_path)).collect()}
    assert set(got) == {r[0] for r in [*rows, *both, *several]}
    assert all(got[i] == l for i, _, l in rows) and {got[i] for i, _, _ in both} == {"aa"}
