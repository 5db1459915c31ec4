"""Suffix-array dedup: find every string of `length` bytes that occurs twice, by a distributed merge sort.

A window of `length` bytes is stood for by its anchor, the `gram` bytes in it whose hash is smallest. Equal
windows have equal anchors at equal places, so only suffixes that start at anchors are sorted, and of those
only the ones whose anchor occurs twice in the corpus (a filter of bounded size says which may).

Each task sorts the suffixes of its documents and sends them front-coded: the length of the prefix that a
suffix shares with the one before it, and the rest. The sorted runs that meet in a range of anchors are
merged by a loser tree that carries the known common prefixes along and only ever compares what lies beyond
them. The merged order with its common prefixes, and the bytes before each anchor, tell which windows occur
twice.

No group grows with the number of copies. Suffixes of a run that are equal in all that windows need of them
are repeated as they are: their spans are known in the run, and one of them goes on to be merged for the sake of
other runs. Suffixes at an anchor that occurs very often are ranged by more of the bytes around it: windows are
parted by how far before the anchor they start, and each part is keyed by the bytes that all its windows have.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ._bytes import utf8, word_edges, word_hashes
from ._common import columns, cut, freed, slices, table

LENGTH, GRAM = 400, 128
#: Bytes from which on a repeated passage is reported by op9 (fewer than nearly all 51 words of prose have), and of its anchors.
PASSAGE, PASSAGE_GRAM = 240, 64
#: Bytes that stand for a word where windows are counted in words, and words of such a window's anchor (at most).
TOKEN, GRAM_WORDS = 8, 16
#: Bytes of a text that are hashed at a time, and bytes of suffixes that a task sorts as one run.
CHUNK, RUN = 2**20, 32 * 2**20
#: Anchors that occur more often have their windows ranged in so many parts.
HOT, PARTS = 20_000, 16
#: Bytes of suffixes that meet in one range of anchors (expected).
RANGE_BYTES = 12 * 2**20
#: Bounds of the filter of repeated anchors, in bits as powers of two.
FILTER_BITS = (20, 28)
#: Merged spans (40 bytes or so each) up to which they are broadcast to the texts.
BROADCAST_SPANS = 500_000
_BASE = 0xD1342543DE82EF95
_M = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9)]
_powers: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def _power(base: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """base^i and base^-i modulo 2^64 for i < n."""
    if base not in _powers or len(_powers[base][0]) < n:
        size = max(n, CHUNK + 1024)
        up, down = (np.cumprod(np.concatenate([np.ones(1, np.uint64), np.full(size - 1, x, np.uint64)]), dtype=np.uint64) for x in (base, pow(base, -1, 2**64)))
        _powers[base] = up, down
    return _powers[base]


def _hash_grams(data: np.ndarray, width: int, base: int = _BASE) -> np.ndarray:
    """Hash of the `width` bytes from each position on."""
    up, down = _power(base, len(data) + 1)
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum((data.astype(np.uint64) + np.uint64(1)) * up[: len(data)], dtype=np.uint64)])
    h = (sums[width:] - sums[:-width]) * down[: len(data) - width + 1]
    h ^= h >> np.uint64(32)
    h *= _M[0]
    return h ^ (h >> np.uint64(29))


def _sliding_min(values: np.ndarray, width: int) -> np.ndarray:
    n = len(values)
    blocks = -(-n // width)
    padded = np.full(blocks * width, np.uint64(2**64 - 1))
    padded[:n] = values
    grid = padded.reshape(blocks, width)
    ahead = np.minimum.accumulate(grid, axis=1).ravel()
    behind = np.minimum.accumulate(grid[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(behind[: n - width + 1], ahead[width - 1 : n])


def anchors(data: np.ndarray, length: int, gram: int):
    """For a chunk of a text: (hash, anchor, first window, last window) of each run of windows with one anchor."""
    h = _hash_grams(data, gram)
    # of equal hashes the leftmost wins
    packed = (h & np.uint64(2**64 - 2**24)) | np.arange(len(h), dtype=np.uint64)
    at = (_sliding_min(packed, length - gram + 1) & np.uint64(2**24 - 1)).astype(np.int64)
    first = np.concatenate([[0], np.nonzero(np.diff(at))[0] + 1])
    last = np.concatenate([first[1:] - 1, [len(at) - 1]])
    # anchors have small hashes; mixed again they spread over all ranges
    name = h[at[first]]
    name = (name ^ (name >> np.uint64(31))) * _M[1]
    return name ^ (name >> np.uint64(33)), at[first], first, last


def _chunks(raw: bytes, length: int, chunk: int):
    for start in range(0, len(raw) - length + 1, chunk):
        yield start, np.frombuffer(raw, np.uint8, min(chunk + length - 1, len(raw) - start), start)


def tokens(text: bytes) -> bytes:
    """`TOKEN` bytes for each word, a hash of it."""
    return word_hashes(text).astype(">u8").tobytes()


def common(x: bytes, y: bytes, known: int = 0) -> int:
    """Length of the common prefix, of which `known` bytes are known."""
    n = min(len(x), len(y))
    x, y = x[known:n], y[known:n]
    if x == y:
        return n
    different = int.from_bytes(x, "big") ^ int.from_bytes(y, "big")
    return n - (different.bit_length() + 7) // 8


def front_code(strings: list[bytes]):
    """(shared prefix, rest) of each of some sorted strings."""
    before = b""
    for s in strings:
        shared = common(before, s)
        yield shared, s[shared:]
        before = s


def merge(runs: list[list[tuple[bytes, int, object]]]):
    """Merge sorted runs of (string, prefix shared with the one before in its run, payload).

    Yields (string, prefix shared with the one before in the output, payload). A loser tree: each inner
    node keeps the loser of its match and how much of the last winner's prefix it shares. Two contestants
    with different shares are told apart without looking at them; with equal ones, from there on.
    """
    size = 1
    while size < len(runs):
        size *= 2
    heads: list[bytes | None] = [r[0][0] if r else None for r in runs] + [None] * (size - len(runs))
    shared, at = [0] * size, [0] * size

    def play(i: int, j: int) -> tuple[int, int]:
        x, y = heads[i], heads[j]
        if x is None or y is None:
            return (j, i) if x is None else (i, j)
        if shared[i] != shared[j]:
            return (i, j) if shared[i] > shared[j] else (j, i)
        h = common(x, y, shared[i])
        if h == len(x) == len(y):
            first = i < j
        else:
            first = h == len(x) or (h < len(y) and x[h] < y[h])
        winner, loser = (i, j) if first else (j, i)
        shared[loser] = h
        return winner, loser

    losers = [0] * size

    def build(node: int) -> int:
        if node >= size:
            return node - size
        winner, losers[node] = play(build(2 * node), build(2 * node + 1))
        return winner

    top = build(1)
    while heads[top] is not None:
        run = runs[top]
        yield heads[top], shared[top], run[at[top]][2]
        at[top] += 1
        heads[top], shared[top] = run[at[top]][:2] if at[top] < len(run) else (None, 0)
        node = (top + size) // 2
        while node:
            top, losers[node] = play(top, losers[node])
            node //= 2


def repeated_windows(forward: list[int], lengths: list[int], backs: list[bytes], length: int) -> list[list[tuple[int, int]]]:
    """For suffixes of one anchor, in order: the runs (lowest, highest) of offsets whose windows occur twice.

    forward: prefix shared with the one before; lengths: bytes from the anchor on; backs: bytes before the
    anchor, backwards. The window at offset o has o bytes before the anchor and length - o from it on.
    """
    n = len(forward)
    out: list[list[tuple[int, int]]] = [[] for _ in range(n)]
    if n <= 8:
        for i in range(n):
            f = 1 << 60
            for j in range(i + 1, n):
                f = min(f, forward[j])
                low, high = max(0, length - f), common(backs[i], backs[j])
                if low <= high:
                    out[i].append((low, high))
                    out[j].append((low, high))
        return out
    f, ahead, behind = np.array(forward), np.array(lengths), np.array([len(b) for b in backs])
    order = np.array(sorted(range(n), key=backs.__getitem__))
    b = np.array([0, *(common(backs[order[i - 1]], backs[order[i]]) for i in range(1, n))])
    f[0] = 0
    points = np.unique(np.concatenate([[0], length - f, length - ahead, b + 1, behind + 1]))
    points = points[(points >= 0) & (points <= behind.max())]
    twice = np.zeros((len(points), n), bool)
    for k, o in enumerate(points):
        by_back = np.empty(n, np.int64)
        by_back[order] = np.cumsum(b < o)
        ok = np.nonzero((ahead >= length - o) & (behind >= o))[0]
        key = (np.cumsum(f < length - o) * np.int64(n + 1) + by_back)[ok]
        _, inverse, count = np.unique(key, return_inverse=True, return_counts=True)
        twice[k, ok] = count[inverse] > 1
    ends = np.append(points[1:] - 1, behind.max())
    for i in np.nonzero(twice.any(0))[0]:
        row = np.concatenate([[0], twice[:, i].astype(np.int8), [0]])
        for k, m in zip(np.nonzero(np.diff(row) == 1)[0], np.nonzero(np.diff(row) == -1)[0], strict=True):
            out[i].append((int(points[k]), int(min(ends[m - 1], behind[i]))))
    return out


def _filter(anchors_: DataFrame, n: int) -> np.ndarray:
    """A bit for each hash of `anchors_`: at most 2^28 bits, 32 MB, however many there are."""
    bits = min(max(FILTER_BITS[0], int(np.ceil(np.log2(max(1, n) * 16)))), FILTER_BITS[1])
    slot = F.shiftrightunsigned("h", 64 - bits)
    words = anchors_.select(F.shiftright(slot, 6).cast("int").alias("w"), F.expr(f"shiftleft(1L, cast(shiftrightunsigned(h, {64 - bits}) & 63 as int))").alias("b"))
    out = np.zeros(2**bits // 64, np.uint64)
    # by way of Arrow: up to 2^22 words, which as rows would be Python objects on the driver
    for batch in words.groupBy("w").agg(F.bit_or("b").alias("b")).toArrow().to_batches():
        out[batch.column("w").to_numpy()] = batch.column("b").to_numpy().view(np.uint64)
    return out


def _has(bits: np.ndarray, h: np.ndarray) -> np.ndarray:
    slot = h >> np.uint64(64 - int(len(bits) * 64).bit_length() + 1)
    return (bits[(slot >> np.uint64(6)).astype(np.int64)] >> (slot & np.uint64(63)) & np.uint64(1)).astype(bool)


def spans(docs: DataFrame, length: int = LENGTH, gram: int = GRAM, hot: int = HOT, passage: int = 0, run: int = RUN, chunk: int = CHUNK, read: Callable = utf8) -> DataFrame:
    """(key, doc_id, start, end, shorter): byte ranges of documents covered by strings that occur elsewhere too.

    `docs` has key, doc_id and text (a string or its bytes); rows with an equal key are equal. With `passage`, a
    smaller length, strings of that many bytes are found by the way; their ranges have `shorter`. `read` makes the
    bytes to search of a text, in the worker that searches them.
    """
    spark = docs.sparkSession
    least = passage or length

    def count(batches):
        for batch in batches:
            found = [anchors(data, least, gram)[0] for few_ in slices([batch]) for t in few_.column("text").to_pylist() if t for _, data in _chunks(read(t), least, chunk)]
            h, n = np.unique(np.concatenate(found), return_counts=True) if found else (np.zeros(0, np.uint64), np.zeros(0, np.int64))
            yield pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), pa.array(n)], names=["h", "n"])

    seen = docs.select("text").mapInArrow(freed(count), "h long, n long").groupBy("h").agg(F.sum("n").alias("n")).where("n > 1")
    seen = cut(seen)
    n_kinds, n_all, n_hot = seen.agg(F.count("*"), F.coalesce(F.sum("n"), F.lit(0)), F.coalesce(F.sum((F.col("n") > hot).cast("int")), F.lit(0))).first()
    empty = "key long, doc_id long, start long, end long, shorter boolean"
    if not n_kinds:
        return spark.createDataFrame([], empty)
    wanted = spark.sparkContext.broadcast(_filter(seen.select("h"), n_kinds))
    often = spark.sparkContext.broadcast(_filter(seen.where(F.col("n") > hot).select("h"), n_hot)) if n_hot else None
    parts = max(1, min(2**20, -(-n_all * (length + 150) // RANGE_BYTES)))

    def occurrences(batches):
        """(row, bytes, hash, whether it is hot, anchor, first window, last window) in whole texts."""
        for batch in slices(batches):
            ids = zip(batch.column("key").to_pylist(), batch.column("doc_id").to_pylist(), batch.column("text").to_pylist(), strict=True)
            for key, doc_id, text in ids:
                raw, held = read(text), None
                for start, data in _chunks(raw, least, chunk):
                    h, at, first, last = anchors(data, least, gram)
                    pick = np.nonzero(_has(wanted.value, h))[0]
                    many = _has(often.value, h[pick]) if often is not None else np.zeros(len(pick), bool)
                    for i, warm in zip(pick, many, strict=True):
                        # windows on both sides of a border of chunks may have one anchor
                        if held and held[4] == start + int(at[i]):
                            held = *held[:6], start + int(last[i])
                            continue
                        if held:
                            yield held
                        held = (key, doc_id), raw, int(h[i]), warm, start + int(at[i]), start + int(first[i]), start + int(last[i])
                if held:
                    yield held

    step = -(-(least - gram + 1) // PARTS)

    def suffixes_of(raw, h, warm, at, first, last):
        """(suffix behind its key, bytes before it backwards): what windows at some offsets before the anchor need."""
        low, high = at - last, at - first
        if not warm:
            yield h.to_bytes(8, "big") + raw[at : at + length - low], raw[first:at][::-1]
            return
        for begin in range(low // step * step, high + 1, step):
            end = min(begin + step - 1, least - gram)
            a, b = max(low, begin), min(high, end)
            around = b"%d %d " % (h, begin) + raw[at - begin : at + least - end]
            yield hashlib.blake2b(around, digest_size=8).digest() + raw[at : at + length - a], raw[at - b : at][::-1]

    kinds = [("part", pa.int32()), ("run", pa.int64()), ("seq", pa.int32()), ("shared", pa.int32()), ("rest", pa.binary()), ("b_shared", pa.int32()), ("b_rest", pa.binary()), ("key", pa.int64()), ("doc_id", pa.int64()), ("at", pa.int64())]
    schema = pa.schema(kinds)

    def sort(batches):
        from pyspark import TaskContext

        task, n_runs = TaskContext.get().partitionId(), 0
        held, size = [], 0

        def batch_of(rows):
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, (_, k) in zip(zip(*rows, strict=True), kinds, strict=True)], schema=schema)

        def flush():
            held.sort(key=lambda r: r[:2])
            rows, before, part_before, seq = [], (b"", b""), None, 0
            for i, (s, back, key, doc_id, at) in enumerate(held):
                again = i > 0 and held[i - 1][0] == s and held[i - 1][1] == back
                if again or (i + 1 < len(held) and held[i + 1][0] == s and held[i + 1][1] == back):
                    # repeated within the run: its spans travel by themselves, dealt out by place
                    for size in (length, passage) if passage else (length,):
                        if len(s) - 8 + len(back) >= size:
                            rows.append(((key ^ at) % parts, 0, len(s) - 8 + len(back), -1, b"", int(size < length), b"", key, doc_id, at - len(back)))
                if not again:
                    part = (int.from_bytes(s[:3], "big") * parts) >> 24
                    if part != part_before:
                        before, part_before = (b"", b""), part
                    shared = common(before[0], s)
                    b_shared = common(before[1], back)
                    rows.append((part, task * 2**20 + n_runs, seq, shared, s[shared:], b_shared, back[b_shared:], key, doc_id, at))
                    before, seq = (s, back), seq + 1
                if len(rows) >= 5000:
                    yield batch_of(rows)
                    rows = []
            if rows:
                yield batch_of(rows)

        for (key, doc_id), raw, h, warm, at, first, last in occurrences(batches):
            for s, back in suffixes_of(raw, h, warm, at, first, last):
                held.append((s, back, key, doc_id, at))
                size += len(s) + len(back)
            if size > run:
                yield from flush()
                held, size, n_runs = [], 0, n_runs + 1
        if held:
            yield from flush()

    def combine(pdf: pd.DataFrame) -> pd.DataFrame:
        known = pdf["shared"] < 0
        done, pdf = pdf[known], pdf[~known].sort_values(["run", "seq"])
        runs: list[list] = []
        last_run, s, back = None, b"", b""
        for run_, shared, rest, b_shared, b_rest, key, doc_id, at in zip(*(pdf[c].to_list() for c in ("run", "shared", "rest", "b_shared", "b_rest", "key", "doc_id", "at")), strict=True):
            if run_ != last_run:
                runs.append([])
                last_run, s, back = run_, b"", b""
            s, back = s[:shared] + rest, back[:b_shared] + b_rest
            runs[-1].append((s, shared, (back, key, doc_id, at)))
        found: list[tuple] = []
        group: list[tuple] = []

        def resolve():
            for size in ((length, passage) if passage else (length,)) if len(group) > 1 else ():
                windows = repeated_windows([g[1] - 8 for g in group], [len(g[0]) - 8 for g in group], [g[2][0] for g in group], size)
                for (_, _, (_, key, doc_id, at)), offsets in zip(group, windows, strict=True):
                    for low, high in offsets:
                        found.append((key, doc_id, at - high, at - low + size, size < length))

        for item in merge(runs):
            if item[1] < 8 + gram:
                resolve()
                group = []
            group.append(item)
        resolve()
        out = pd.DataFrame(found, columns=["key", "doc_id", "start", "end", "shorter"])
        known = pd.DataFrame({"key": done["key"], "doc_id": done["doc_id"], "start": done["at"], "end": done["at"] + done["seq"], "shorter": done["b_shared"] > 0})
        out = pd.concat([x for x in (out, known) if len(x)] or [out])
        return out.astype({"key": "int64", "doc_id": "Int64", "start": "int64", "end": "int64", "shorter": "bool"}).drop_duplicates()

    runs = docs.select("key", "doc_id", "text").mapInArrow(freed(sort), "part int, run long, seq int, shared int, rest binary, b_shared int, b_rest binary, key long, doc_id long, at long")
    return runs.groupBy("part").applyInPandas(combine, empty)


def word_spans(docs: DataFrame, words: int, hot: int = HOT) -> DataFrame:
    """(key, doc_id, start, end): ranges of words covered by `words` words in a row that occur elsewhere too.

    The same search over one token a word; of the windows it finds, those that start where a word does count.
    """

    length = TOKEN * words
    rows = docs.select("key", "doc_id", "text").where(F.octet_length("text") >= 2 * words - 1)
    # read where they are searched: a worker of its own would hold memory beside each
    found = spans(rows, length, TOKEN * min(GRAM_WORDS, words), hot, read=lambda text: tokens(utf8(text)))
    first, last = F.ceil(F.col("start") / TOKEN), F.floor((F.col("end") - length) / TOKEN)
    return found.select("key", "doc_id", first.cast("long").alias("start"), (last + words).cast("long").alias("end")).where(F.col("end") - F.col("start") >= words)


def _merged(spans: Column) -> Column:
    """Sorted spans (kind, start, end) of a document, with those that overlap or touch made one."""

    def step(done, x):
        last = F.try_element_at(done, F.lit(-1))
        longer = F.struct(last["kind"].alias("kind"), last["start"].alias("start"), F.greatest(last["end"], x["end"]).alias("end"))
        joins = (last["kind"] == x["kind"]) & (x["start"] <= last["end"])
        return F.when(joins, F.concat(F.slice(done, F.lit(1), F.greatest(F.size(done) - 1, F.lit(0))), F.array(longer))).otherwise(F.concat(done, F.array(x)))

    return F.aggregate(spans, F.array().cast("array<struct<kind:int,start:bigint,end:bigint>>"), step)


def dedup(docs: DataFrame, length: int = LENGTH, gram: int = GRAM, hot: int = HOT, with_text: bool = False, carry: tuple[str, ...] = (), words: int = 0, passage: int = 0, run: int = RUN, chunk: int = CHUNK) -> DataFrame:
    """Remove every byte covered by a string of `length` bytes that starts anywhere else too.

    With `words`, so goes every passage of that many words in a row, however short, that starts anywhere else too;
    what separates the words may differ. With `passage`, a smaller length, a column `n_repeated` counts the bytes
    covered by strings of that many bytes that start anywhere else too; they aren't removed for it.

    Matches never cross documents and are judged on the input. A null text counts as empty: 0 bytes, nothing
    removed. Rows that are equal in id and text are places of their own, so both lose what they share. Null
    ids are rows like others. An empty table gives no rows; of other columns those in `carry` come along. With
    `with_text` a column `clean_text` holds what is left as a string (null stays null); bytes of characters that a cut
    has split are left out of it.
    """
    if not 0 < gram <= (passage or length) or passage >= length:
        raise ValueError("gram must be between 1 and the lengths, and passage below length")
    kinds_of = {f.name: f.dataType.simpleString() for f in docs.schema if f.name in carry}
    narrow = columns(docs, doc_id="long", text="string", **kinds_of).withColumn("key", F.xxhash64("doc_id", "text"))
    long_ones = narrow.select("key", "doc_id", "text").where(F.octet_length("text") >= (passage or length))
    # of a range: 0 in bytes, 1 in words, 2 in bytes and only counted
    found = cut(spans(long_ones, length, gram, hot, passage, run, chunk)).withColumn("kind", F.when(F.col("shorter"), F.lit(2)).otherwise(F.lit(0))).drop("shorter")
    if words:
        found = found.unionByName(cut(word_spans(narrow, words, hot)).withColumn("kind", F.lit(1)))
    by = found.groupBy("key", "doc_id").agg(F.sort_array(F.collect_set(F.struct("kind", "start", "end"))).alias("spans"))
    by = cut(by.select(F.col("key").alias("of"), F.col("doc_id").alias("of_id"), _merged(F.col("spans")).alias("spans")))
    # texts stay where they are as long as the spans are few; beyond that they meet by a shuffle
    few_spans = by.agg(F.coalesce(F.sum(F.size("spans") + 1), F.lit(0))).first()[0] <= BROADCAST_SPANS
    by = F.broadcast(by) if few_spans else by
    joined = narrow.join(by, (F.col("key") == F.col("of")) & F.col("doc_id").eqNullSafe(F.col("of_id")), "left")
    ddl = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string" + ", n_repeated long" * bool(passage) + ", clean_text string" * with_text + "".join(f", `{c}` {kind}" for c, kind in kinds_of.items())

    def apply(batches):
        for batch in slices(batches):
            rows = []
            for text, cuts in zip(batch.column("text").to_pylist(), batch.column("spans").to_pylist(), strict=True):
                raw = (text or "").encode("utf-8", "surrogatepass")
                repeated, upto = 0, 0
                for c in sorted((c for c in cuts or () if c["kind"] != 1), key=lambda c: c["start"]) if passage else ():
                    repeated += max(0, c["end"] - max(c["start"], upto))
                    upto = max(upto, c["end"])
                cuts = [c for c in cuts or () if c["kind"] < 2]
                if any(c["kind"] == 1 for c in cuts):
                    starts, ends = word_edges(raw)
                    cuts = [{"start": int(starts[c["start"]]), "end": int(ends[c["end"] - 1])} if c["kind"] == 1 else c for c in cuts]
                    cuts.sort(key=lambda c: (c["start"], c["end"]))
                kept, at, n = [], 0, 0
                end = -1
                for c in cuts:
                    if c["start"] > end:
                        n += 1
                    if c["start"] > at:
                        kept.append(raw[at : c["start"]])
                    at = end = max(at, end, c["end"])
                left = b"".join([*kept, raw[at:]]) if cuts else raw
                rows.append((len(raw), len(raw) - len(left), n, hashlib.sha256(left).hexdigest(), *([repeated] if passage else []), *([None if text is None else text if not cuts else left.decode("utf-8", "ignore")] if with_text else [])))
            kinds = [pa.int64()] * 3 + [pa.string()] + [pa.int64()] * bool(passage) + [pa.string()] * with_text
            names = ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"] + ["n_repeated"] * bool(passage) + ["clean_text"] * with_text
            cols = [pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *cols, *(batch.column(c) for c in kinds_of)], names=[*names, *kinds_of])

    return joined.select("doc_id", "text", "spans", *kinds_of).mapInArrow(freed(apply), ddl)


def op9_suffixes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup(table(spark, sf_dir, "documents"), gram=PASSAGE_GRAM, passage=PASSAGE)
