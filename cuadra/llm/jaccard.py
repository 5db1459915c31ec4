"""N-gram Jaccard join by partitioning the universe of shingles.

Shingles are hashed into segments by size band. By the pigeonhole principle two linked sets agree on a
segment, or differ by one shingle in one whose one-deletion neighbourhood is indexed too. How many segments
a band gets, and how many of these with deletions, is what costs least given the number of documents that
the band's index holds, which is counted first. There are some segments more than needed, and a set leaves
as many of its empty ones out, since these agree with those of unrelated sets. Documents that meet in an
index entry are candidates. They are verified on their words, exactly.

Documents with equal sets form one class, and classes take part by their smallest id. Each is first verified
against the smallest member of an entry. The entries that still hold several components are searched by
parity sketches, whose distance never exceeds the true difference: what is near by sketch ends in one
cluster, around members that are near to many, and is verified against these. What is still apart in a cluster
is compared by its texts in blocks, each text sent once a block: exact differences
come from bit sets over the block's shingles, and what they say links is checked on words. So no link between
components is missed, no pair is compared twice by its words, and of a group no more pairs than members come out.
"""

from __future__ import annotations

import math
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators.graph import components
from ._bytes import utf8, word_hashes
from ._common import columns, count_words, cut, few, freed, table

#: Bits of a parity sketch, at least, and for each difference that a linked set may have: unrelated sets stay apart at any size.
SKETCH, SKETCH_EACH = 2048, 8
#: Each size band reaches up to so many times its start.
BAND = 1.5
#: What a candidate by chance costs, in index entries; how likely an unrelated document of a band has a given shingle.
CANDIDATE_COST, CHANCE = 10.0, 0.001
#: Members of an entry whose sketches are compared in one block, and texts that are verified with one hub at a time.
BLOCK, BUCKET = 4096, 256
#: Members of a block that tell how many each is near to; any choice gives the same components.
PROBES = 64
#: Shingles (with repeats) in a block of texts.
BLOCK_SHINGLES = 300_000
#: Entries of so many members aren't gathered to find the smallest one; a sample of documents tells which these may be.
HOT, SAMPLE = 50_000, 512
_M = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB)]


def lower(text: str | None) -> bytes:
    """UTF-8 with A-Z in lower case and every other byte as it is."""
    return utf8(text).lower()


def shingle_set(text: str | None, n: int) -> set:
    """Distinct n-word shingles; with fewer words the whole sequence is one; without words none."""
    found = lower(text).split()
    if not found:
        return set()
    return set(zip(*(found[i:] for i in range(n)), strict=False)) if len(found) >= n else {tuple(found)}


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * _M[1]
    x = (x ^ (x >> np.uint64(27))) * _M[2]
    return x ^ (x >> np.uint64(31))


def hashes(text: str | None, n: int) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the shingles of a text."""
    h = word_hashes(lower(text))
    if not len(h):
        return h
    width = min(n, len(h))
    out = np.full(len(h) - width + 1, np.uint64(width))
    for i in range(width):
        out = _mix(out * _M[0] + h[i : len(h) - width + 1 + i])
    return np.unique(out)


def most_different(size: int, num: int, den: int) -> int:
    """The largest symmetric difference of two sets with this many elements together and Jaccard >= num / den."""
    return size * (den - num) // (den + num)


def band_of(n: int) -> int:
    """Bands are numbered from 0; each starts at BAND times the start of the one before, or one above it."""
    k = 0
    while band_start(k + 1) <= n:
        k += 1
    return k


@lru_cache(maxsize=None)
def band_start(k: int) -> int:
    return 1 if not k else max(band_start(k - 1) + 1, math.ceil(band_start(k - 1) * BAND))


def widest(n: int, top: int, num: int, den: int) -> int:
    """The largest difference of a set of n with a linked one of at most `top`."""
    return most_different(n + min(top, n * den // num), num, den)


def _tail(mean: float, above: int) -> float:
    """Probability that a Poisson variable exceeds `above`."""
    term = total = math.exp(-mean)
    for i in range(1, above + 1):
        term *= mean / i
        total += term
    return max(0.0, 1.0 - total)


def cost(low: int, top: int, num: int, den: int, others: float, segments: int, deletions: int) -> float:
    """Entries of a set in a band, and candidates by chance among `others` sets.

    Unrelated sets agree on a segment that is empty in both, or holds only what they happen to share. Empty
    segments count only where a set has more of them than it may leave out. A segment with deletions agrees
    by chance if both have at most one shingle there.
    """
    share, plain = low / segments, segments - deletions
    empty = plain * math.exp(-share)
    spare = segments + deletions - 1 - widest(low, top, num, den)
    blank = (_tail(empty, spare) * max(empty, spare + 1)) ** 2 / max(plain, 1)
    # one with shingles: all of them shared, and nothing else in the other
    alike = plain * (math.exp(-share * (1 - CHANCE)) - math.exp(-share)) * math.exp(-share)
    slight = deletions * ((1 + share) * math.exp(-share)) ** 2
    return segments + deletions * share + CANDIDATE_COST * others * (blank + alike + slight)


def allocate(band: int, num: int, den: int, others: float) -> tuple[int, int]:
    """(segments, how many of them get one-deletion neighbourhoods) for the sets that a band's index holds.

    A segment that must agree covers one difference more than none, one with deletions two; together they
    must cover more than the largest difference. Of the ways to do so, the one that costs least is taken.
    """
    low, top = band_start(band), band_start(band + 1) - 1
    need = most_different(2 * top, num, den) + 1
    best = None
    for deletions in sorted({need * i // 32 for i in range(17)}):
        least = max(need - deletions, deletions, 1)
        for segments in sorted({least + math.ceil(least * x / 100) for x in (0, 1, 3, 5, 10, 15, 20, 30, 50, 100, 200)}):
            found = cost(low, top, num, den, others, segments, deletions)
            if best is None or found < best[0]:
                best = (found, segments, deletions)
    return best[1], best[2]


def allocation(docs: DataFrame, n: int, num: int, den: int) -> list[dict]:
    """For each band up to that of the longest text: band, low, top, others (sets in its index), segments, deletions.

    `others` comes from the words of all texts, whose shingles are no more than their words.
    """
    size = F.greatest(count_words(F.col("text")) - (n - 1), F.lit(1))
    # bands are at least so wide that a sixteenth of a power of two lies in one or two
    counted = docs.select(F.floor(F.log2(size.cast("double")) * 16).cast("int").alias("k")).groupBy("k").agg(F.count("*").alias("n")).collect()
    held: dict[int, float] = {}
    for k, many in sorted((r["k"], r["n"]) for r in counted if r["k"] is not None):
        low = max(1, math.ceil(2 ** (k / 16)))
        for band in range(band_of(low), band_of(low * den // num) + 1):
            held[band] = held.get(band, 0) + many
    out = []
    for band in range(max(held, default=-1) + 3):
        segments, deletions = allocate(band, num, den, held.get(band, 0))
        out.append({"band": band, "low": band_start(band), "top": band_start(band + 1) - 1, "others": int(held.get(band, 0)), "segments": segments, "deletions": deletions})
    return out


def signatures(h: np.ndarray, num: int, den: int, plan: list[tuple[int, int]]) -> np.ndarray:
    """Index entries of a set: of its own size band, and of every further one that holds larger partners.

    plan: (segments, deletions) of each band. Segments that are empty have no entry, if those that remain
    still cover every difference that a linked set can have; a set whose don't has entries for all.
    """
    n = len(h)
    if not n:
        return np.zeros(0, np.uint64)
    out, mixed = [], _mix(h + _M[0])
    for band in range(band_of(n), band_of(n * den // num) + 1):
        segments, deletions = plan[band]
        at = ((h >> np.uint64(11)) % np.uint64(segments)).astype(np.uint16 if segments < 2**16 else np.int64)
        filled = np.bincount(at, minlength=segments)
        order = np.argsort(at, kind="stable")
        run = np.concatenate([np.zeros(1, np.uint64), np.cumsum(mixed[order], dtype=np.uint64)])
        edge = np.concatenate([[0], np.cumsum(filled)])
        sums = run[edge[1:]] - run[edge[:-1]]
        salt = _mix(np.arange(segments, dtype=np.uint64) + np.uint64(band << 32))
        empty = filled == 0
        empty[:deletions] = False
        leave = empty.sum() <= segments + deletions - 1 - widest(n, band_start(band + 1) - 1, num, den)
        out.append(_mix(sums + salt)[~empty] if leave else _mix(sums + salt))
        if deletions:
            some = at < deletions
            out.append(_mix(sums[at[some]] - mixed[some] + salt[at[some]]))
    return np.unique(np.concatenate(out))


def _sketch(h: np.ndarray, num: int, den: int) -> bytes:
    """Parities of a set's shingles over a power of two of bins, more for larger sets."""
    bins = SKETCH
    while bins < SKETCH_EACH * most_different(2 * len(h), num, den):
        bins *= 2
    return np.packbits(np.bincount((_mix(h + _M[1]) & np.uint64(bins - 1)).view(np.int64), minlength=bins) & 1).tobytes()


def _folded(sketches: list[bytes], size: int) -> np.ndarray:
    """Sketches as rows of `size` bytes: a longer one's parts are added up, which gives the sketch with fewer bins."""
    out = np.empty((len(sketches), size), np.uint8)
    lens = np.array([len(x) for x in sketches])
    for n in np.unique(lens):
        at = np.nonzero(lens == n)[0]
        parts = np.frombuffer(b"".join(sketches[i] for i in at), np.uint8).reshape(len(at), n // size, size)
        out[at] = np.bitwise_xor.reduce(parts, axis=1)
    return out.view(np.uint64)


def summarize(docs: DataFrame, n: int, num: int, den: int, plan: list[tuple[int, int]]) -> DataFrame:
    """For each document: set size, two hashes that name the set, its index entries, its parity sketch."""
    kinds = [("doc_id", pa.int64()), ("n_shingles", pa.int64()), ("f1", pa.int64()), ("f2", pa.int64()), ("entries", pa.list_(pa.int64())), ("sketch", pa.binary())]
    schema = pa.schema(kinds)

    def one(text):
        h = hashes(text, n)
        f1, f2 = (int(_mix(h * m + m).sum(dtype=np.uint64).astype(np.int64)) for m in (_M[0], _M[2]))
        return len(h), f1, f2, signatures(h, num, den, plan).astype(np.int64), _sketch(h, num, den)

    def run(batches):
        for batch in batches:
            ids, texts = batch.column("doc_id"), batch.column("text")
            for start in range(0, len(ids), 1000):
                got = [one(t) for t in texts.slice(start, 1000).to_pylist()]
                lists = pa.ListArray.from_arrays(np.cumsum([0, *(len(g[3]) for g in got)]).astype(np.int32), np.concatenate([g[3] for g in got]))
                cols = [ids.slice(start, 1000), *(pa.array([g[i] for g in got], pa.int64()) for i in range(3)), lists, pa.array([g[4] for g in got], pa.binary())]
                yield pa.RecordBatch.from_arrays(cols, schema=schema)

    ddl = "doc_id long, n_shingles long, f1 long, f2 long, entries array<long>, sketch binary"
    return docs.mapInArrow(freed(run), ddl)


def _linked(x: set, y: set, num: int, den: int) -> bool:
    both = len(x & y)
    return both > 0 and den * both >= num * (len(x) + len(y) - both)


def by_runs(frame: DataFrame, keys: list[str], order: list[str], solve, schema: pa.Schema) -> DataFrame:
    """Bring the rows of each key together, sorted, and give each run of them to `solve` as a table.

    Groups are small (blocks of bounded size), so a task goes through very many; this spares Spark a call for each.
    """

    def run(batches):
        held, last = [], None
        for batch in batches:
            if not batch.num_rows:
                continue
            names = [batch.column(k).to_numpy(zero_copy_only=False) for k in keys]
            turns = np.nonzero(np.logical_or.reduce([x[1:] != x[:-1] for x in names]))[0] + 1
            for a, b in zip([0, *turns], [*turns, batch.num_rows], strict=True):
                key = tuple(x[a] for x in names)
                if held and key != last:
                    yield from solve(pa.Table.from_batches(held)).to_batches()
                    held = []
                held.append(batch.slice(a, b - a))
                last = key
        if held:
            yield from solve(pa.Table.from_batches(held)).to_batches()

    ddl = ", ".join(f"{f.name} {'long' if f.type == pa.int64() else 'boolean'}" for f in schema)
    parts = int(frame.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return frame.repartition(parts, *keys).sortWithinPartitions(*keys, *order).mapInArrow(freed(run), ddl)


_EDGES = pa.schema([("a", pa.int64()), ("b", pa.int64())])


def _edges(a: list, b: list) -> pa.Table:
    return pa.table([pa.array(np.array(x, np.int64)) for x in (a, b)], schema=_EDGES)


def verify_stars(pairs: DataFrame, texts: DataFrame, n: int, num: int, den: int) -> DataFrame:
    """Those of the pairs (a, b) that link, as their words say; each b is in one or a few.

    A hub's partners are dealt into buckets, so that its text travels once a bucket, and each other text once.
    """
    sizes = pairs.groupBy("a").agg(F.ceil(F.count("*") / BUCKET).cast("int").alias("buckets"))
    large = few(cut(sizes.where("buckets > 1").withColumnRenamed("a", "hub")))
    bucket = F.pmod(F.xxhash64("b"), F.coalesce("buckets", F.lit(1)))
    dealt = cut(pairs.join(large, F.col("a") == F.col("hub"), "left").select("a", "b", bucket.alias("bucket")))
    members = dealt.select("a", "bucket", F.col("b").alias("id"))
    hubs = dealt.select("a", "bucket", F.col("a").alias("id")).distinct()
    rows = hubs.union(members).join(texts, F.col("id") == F.col("doc_id")).select("a", "bucket", "id", "text")

    def solve(table: pa.Table) -> pa.Table:
        hub = table.column("a")[0].as_py()
        ids, got = table.column("id").to_pylist(), table.column("text").to_pylist()
        own = [shingle_set(t, n) for i, t in zip(ids, got, strict=True) if i == hub]
        hits = [i for i, t in zip(ids, got, strict=True) if i != hub and any(_linked(x, shingle_set(t, n), num, den) for x in own)]
        return _edges([hub] * len(hits), hits)

    return by_runs(rows, ["a", "bucket"], ["id"], solve, _EDGES)


def _far(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    return np.bitwise_count(left ^ right).sum(-1)


def _near_pairs(pairs: DataFrame, sets: DataFrame, num: int, den: int) -> DataFrame:
    """Pairs whose sizes and sketches allow a link."""

    def run(batches):
        for batch in batches:
            n = [batch.column(c).to_numpy() for c in ("l_n", "r_n")]
            s = [batch.column(c).to_pylist() for c in ("l_sketch", "r_sketch")]
            least = np.array([min(len(x), len(y)) for x, y in zip(*s, strict=True)])
            far = np.zeros(len(least), np.int64)
            for size in np.unique(least):
                at = np.nonzero(least == size)[0]
                far[at] = _far(*(_folded([x[i] for i in at], size) for x in s))
            ok = (far <= (n[0] + n[1]) * (den - num) // (den + num)) & (np.minimum(*n) * den >= np.maximum(*n) * num)
            yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b")], names=["a", "b"]).filter(pa.array(ok))

    left, right = (sets.select(F.col("rep").alias(f"{k}_id"), F.col("n_shingles").alias(f"{k}_n"), F.col("sketch").alias(f"{k}_sketch")) for k in "lr")
    both = pairs.join(left, F.col("a") == F.col("l_id")).join(right, F.col("b") == F.col("r_id"))
    return both.select("a", "b", "l_n", "r_n", "l_sketch", "r_sketch").mapInArrow(freed(run), "a long, b long")


def cells(members: DataFrame, weight: str, most: float) -> DataFrame:
    """Deal the members (group, rep, root) of groups into blocks (group, x, y) in which all pairs of different roots meet.

    Members of a group's commonest root are parted by themselves and meet the others only. `weight` is an
    expression whose sum bounds a part by about `most`. A row is repeated once for each block of its part.
    """
    roots = members.groupBy("group", "root").agg(F.expr(f"sum({weight})").alias("w"))
    # w of a group's heaviest root (ties to the smaller one), and of all the others together
    of = roots.groupBy("group").agg(F.max(F.struct("w", (-F.col("root")).alias("r"))).alias("top"), F.sum("w").alias("all"), F.count("*").alias("n")).where("n > 1")
    parts = lambda w: F.ceil(w / most).cast("int")
    of = of.select(F.col("group").alias("of"), (-F.col("top.r")).alias("main"), parts(F.col("top.w")).alias("n_main"), parts(F.col("all") - F.col("top.w")).alias("n_rest"))
    dealt = members.join(of, F.col("group") == F.col("of")).withColumn("is_main", F.col("root") == F.col("main"))
    part = F.pmod(F.xxhash64("rep"), F.when(F.col("is_main"), F.col("n_main")).otherwise(F.col("n_rest"))).cast("int")
    # parts of the others are 0 .. n_rest - 1, those of the main root come behind
    dealt = dealt.withColumn("part", F.when(F.col("is_main"), F.col("n_rest") + part).otherwise(part))
    last = F.when(F.col("is_main"), F.col("n_rest")).otherwise(F.col("n_rest") + F.col("n_main"))
    dealt = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), last - 1)))
    # a block of two parts of the main root isn't needed; one of a part with itself serves the others only
    return dealt.select("group", F.least("part", "other").alias("x"), F.greatest("part", "other").alias("y"), "rep", "root", "part")


def _forest(rep: np.ndarray, root: np.ndarray, n: np.ndarray, part: np.ndarray, cross: bool, bits: np.ndarray, lone: np.ndarray, num: int, den: int, accept) -> tuple[list, list]:
    """Edges that join the roots of a block: pairs whose bits and sizes allow a link and that `accept` takes.

    bits: a row of words for each member, whose distance, with what each has alone, never exceeds the true
    difference. cross: pairs of different parts only. An edge is looked for only between roots that aren't
    joined yet.
    """
    _, label = np.unique(root, return_inverse=True)
    a, b = [], []
    rows = np.arange(len(rep))
    heavy = np.bincount(label).argmax()
    # each pair has one that isn't of the commonest root; those that are near to many come first
    rows = rows[label != heavy]
    degree = np.zeros(len(rows), np.int64)
    for j in np.linspace(0, len(rep) - 1, min(PROBES, len(rep))).astype(int):
        degree += _far(bits[rows], bits[j]) + lone[rows] + lone[j] <= (n[rows] + n[j]) * (den - num) // (den + num)
    for i in rows[np.argsort(-degree, kind="stable")]:
        ok = (label != label[i]) & (np.minimum(n, n[i]) * den >= np.maximum(n, n[i]) * num)
        if cross:
            ok &= part != part[i]
        at = np.nonzero(ok)[0]
        if not len(at):
            continue
        far = _far(bits[at], bits[i]) + lone[at] + lone[i]
        near = far <= (n[at] + n[i]) * (den - num) // (den + num)
        at, far = at[near], far[near]
        for j in at[np.argsort(far, kind="stable")]:
            if label[j] != label[i] and accept(i, j):
                a.append(rep[i])
                b.append(rep[j])
                label[label == label[j]] = label[i]
    return a, b


def near_edges(members: DataFrame, sets: DataFrame, num: int, den: int) -> DataFrame:
    """Edges (a, b) that join whatever members of a group are near by sketch, directly or over others."""
    keyed = sets.select(F.col("rep").alias("of"), "n_shingles", "sketch")
    rows = cells(members, "1", BLOCK).join(keyed, F.col("rep") == F.col("of")).drop("of")

    def solve(table: pa.Table) -> pa.Table:
        rep, root, n, part = (table.column(c).to_numpy() for c in ("rep", "root", "n_shingles", "part"))
        sketches = table.column("sketch").to_pylist()
        bits = _folded(sketches, min(map(len, sketches)))
        return _edges(*_forest(rep, root, n, part, table.column("x")[0] != table.column("y")[0], bits, np.zeros(len(rep), np.int64), num, den, lambda i, j: True))

    return by_runs(rows, ["group", "x", "y"], ["rep"], solve, _EDGES).distinct()


def true_edges(members: DataFrame, sets: DataFrame, texts: DataFrame, n: int, num: int, den: int) -> DataFrame:
    """Links (a, b) that join whatever members of a group are linked, directly or over others."""
    size = sets.select(F.col("rep").alias("of"), "n_shingles")
    weighted = members.join(size, F.col("rep") == F.col("of")).drop("of")
    rows = cells(weighted, "n_shingles", BLOCK_SHINGLES).join(texts, F.col("rep") == F.col("doc_id")).drop("doc_id")

    def solve(table: pa.Table) -> pa.Table:
        rep, root, part = (table.column(c).to_numpy() for c in ("rep", "root", "part"))
        cross = table.column("x")[0] != table.column("y")[0]
        column = table.column("text")
        found = [hashes(t.as_py(), n) for t in column]
        size = np.array([len(h) for h in found])
        # a bit for each shingle that two members or more have; each other one counts by itself
        _, code, count = np.unique(np.concatenate(found), return_inverse=True, return_counts=True)
        slot = np.cumsum(count > 1) - 1
        width = -(-max(int((count > 1).sum()), 1) // 64)
        bits = np.zeros((len(found), width * 8), np.uint8)
        owner = np.repeat(np.arange(len(found)), size)
        keep = count[code] > 1
        at = slot[code[keep]]
        np.bitwise_or.at(bits, (owner[keep], at >> 3), (1 << (at & 7)).astype(np.uint8))
        kept = lru_cache(maxsize=4)(lambda i: shingle_set(column[i].as_py(), n))
        accept = lambda i, j: _linked(kept(int(i)), kept(int(j)), num, den)
        lone = size - np.bincount(owner[keep], minlength=len(found))
        return _edges(*_forest(rep, root, size, part, cross, bits.view(np.uint64), lone, num, den, accept))

    return by_runs(rows, ["group", "x", "y"], ["rep"], solve, _EDGES)


def shared_entries(own: DataFrame) -> DataFrame:
    """(entry, rep, low) of the entries that have two members or more; low is the smallest member.

    The members of an entry meet in a window. Entries that hold very many, as far as a sample of the documents
    shows, are found by a sum that combines before it shuffles instead, and their members stay where they are.
    """
    listed = own.select(F.explode("entries").alias("entry"), "rep")
    part = own.where(F.pmod(F.xxhash64("rep"), F.lit(SAMPLE)) == 0).select(F.explode("entries").alias("hot"))
    hot = cut(part.groupBy("hot").count().where(F.col("count") >= max(2, HOT // SAMPLE)).select("hot"))
    together = Window.partitionBy("entry")
    cold = listed if hot.isEmpty() else listed.join(few(hot), F.col("entry") == F.col("hot"), "left_anti")
    shared = cold.select("entry", "rep", F.min("rep").over(together).alias("low"), F.max("rep").over(together).alias("high"))
    shared = shared.where("low < high").drop("high")
    if not hot.isEmpty():
        full = listed.join(few(hot), F.col("entry") == F.col("hot"), "left_semi")
        lows = few(cut(full.groupBy("entry").agg(F.min("rep").alias("low"), F.max("rep").alias("high")).where("low < high").withColumnRenamed("entry", "of")))
        shared = shared.union(full.join(lows, F.col("entry") == F.col("of")).select("entry", "rep", "low"))
    return cut(shared)


def _rooted(frame: DataFrame, roots: DataFrame, name: str) -> DataFrame:
    """Add `name`, the root of each rep."""
    known = few(roots.select(F.col("node").alias("of"), F.col("root").alias("to")))
    return frame.join(known, F.col("rep") == F.col("of"), "left").withColumn(name, F.coalesce("to", "rep")).drop("of", "to")


def link(docs: DataFrame, n: int = 5, num: int = 80, den: int = 100) -> DataFrame:
    """Components of documents whose sets of n-word shingles have a Jaccard similarity of num / den or more.

    Returns doc_id, n_shingles, class_id (smallest id with an equal set) and component_id (smallest id that
    links reach). A null or wordless text has an empty set and is linked with nothing. A null id takes no
    part: its row comes back with null class and component. Rows that share an id count as one node; where
    their texts differ, the size and sketch of the smaller one decide what is compared, so give rows ids of
    their own (the pipeline does). An empty table gives no rows; extra columns are not carried.
    """
    narrow = columns(docs, doc_id="long", text="string")
    plan = [(b["segments"], b["deletions"]) for b in allocation(narrow, n, num, den)]
    every = cut(summarize(narrow, n, num, den, plan))
    named = every.where("doc_id IS NOT NULL AND n_shingles > 0")
    classes = cut(named.groupBy("f1", "f2", "n_shingles").agg(F.min("doc_id").alias("rep")))
    keys = classes.select(F.col("f1").alias("g1"), F.col("f2").alias("g2"), F.col("rep"))
    # a class stands by its smallest id; ids alone are sent around, the entries stay where they are
    chosen = few(cut(classes.select("rep").distinct()))
    own = named.join(chosen, F.col("doc_id") == F.col("rep"), "left_semi").withColumnRenamed("doc_id", "rep")
    shared = shared_entries(own)
    sets = own.select("rep", "n_shingles", "sketch").join(few(cut(shared.select("rep").distinct())), "rep", "left_semi")
    sets = cut(sets.groupBy("rep").agg(F.min(F.struct("n_shingles", "sketch")).alias("x")).select("rep", "x.*"))
    # of the smallest members that it meets, each document is verified against the one it shares most entries with
    stars = shared.where("low < rep").groupBy("low", "rep").agg(F.count("*").alias("n"))
    stars = stars.groupBy("rep").agg(F.max(F.struct("n", (-F.col("low")).alias("low"))).alias("best"))
    stars = cut(_near_pairs(stars.select((-F.col("best.low")).alias("a"), F.col("rep").alias("b")), sets, num, den))
    texts = narrow.where("doc_id IS NOT NULL")

    def verified(pairs: DataFrame) -> DataFrame:
        met = cut(pairs.select(F.col("a").alias("id")).union(pairs.select(F.col("b").alias("id"))).distinct())
        return cut(verify_stars(pairs, texts.join(few(met), F.col("doc_id") == F.col("id"), "left_semi"), n, num, den))

    links = verified(stars)
    near = components(links)
    # entries with several components: first the largest one of each document, then what these leave apart
    joined = links
    for largest in (True, False):
        marked = _rooted(shared.select("entry", "rep"), near, "root")
        by = marked.groupBy("entry").agg(F.count("*").alias("n"), F.min("root").alias("low"), F.max("root").alias("high"), F.expr("sum(cast(xxhash64(rep) as decimal(38,0)))").alias("who"))
        # entries with the same members are looked at once
        by = cut(by.where("low < high").groupBy("n", "who").agg(F.min("entry").alias("group")))
        if by.isEmpty():
            break
        members = marked.join(few(by), F.col("entry") == F.col("group")).select("group", "n", "rep", "root")
        if largest:
            best = cut(members.groupBy("rep").agg(F.max(F.struct("n", "group")).alias("m")).select(F.col("m.group").alias("of")).distinct())
            members = members.join(few(best), F.col("group") == F.col("of"), "left_semi")
        found = cut(near_edges(members.select("group", "rep", "root"), sets, num, den))
        if found.isEmpty():
            continue
        links = links.union(verified(found))
        joined = joined.union(found)
        near = components(joined)
    links = cut(links)
    roots = components(links)
    # clusters of what is near by sketch and not known to be linked
    clusters = _rooted(_rooted(sets.select("rep"), near, "group"), roots, "root")
    open_ = cut(clusters.groupBy("group").agg(F.min("root").alias("low"), F.max("root").alias("high")).where("low < high").select(F.col("group").alias("of")))
    if not open_.isEmpty():
        members = cut(clusters.join(few(open_), F.col("group") == F.col("of"), "left_semi").select("group", "rep", "root"))
        inside = texts.join(few(members.select(F.col("rep").alias("id"))), F.col("doc_id") == F.col("id"), "left_semi")
        roots = components(links.union(true_edges(members, sets, inside, n, num, den)))
    own = every.select("doc_id", "n_shingles", "f1", "f2").join(keys, (F.col("f1") == F.col("g1")) & (F.col("f2") == F.col("g2")) & (F.col("n_shingles") > 0), "left")
    own = own.select("doc_id", "n_shingles", F.when(F.col("doc_id").isNotNull(), F.coalesce("rep", "doc_id")).alias("class_id"))
    own = own.join(roots, F.col("class_id") == F.col("node"), "left")
    return own.select("doc_id", "n_shingles", "class_id", F.coalesce("root", "class_id").alias("component_id"))


def op8_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return link(table(spark, sf_dir, "documents"), n=3, num=90, den=100)


OP8_SQL = r"""
WITH RECURSIVE t AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws FROM documents),
s AS (
  SELECT DISTINCT doc_id, ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2] AS g FROM t, unnest(range(1, len(ws) - 1)) u(i) WHERE len(ws) >= 3
  UNION ALL SELECT doc_id, array_to_string(ws, ' ') FROM t WHERE len(ws) BETWEEN 1 AND 2),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS k FROM s a JOIN s b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY ALL),
e AS (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * k >= 90 * (x.n + y.n - k)),
r(doc_id, other) AS (SELECT doc_id, doc_id FROM t UNION SELECT r.doc_id, e.b FROM r JOIN e ON e.a = r.other),
c AS (SELECT doc_id, min(other) AS component_id FROM r GROUP BY doc_id),
f AS (SELECT doc_id, md5(string_agg(g, chr(10) ORDER BY g)) AS h FROM s GROUP BY doc_id),
k AS (SELECT doc_id, min(doc_id) OVER (PARTITION BY h) AS class_id FROM f)
SELECT t.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, coalesce(k.class_id, t.doc_id) AS class_id, c.component_id
FROM t LEFT JOIN n USING (doc_id) LEFT JOIN k USING (doc_id) JOIN c USING (doc_id)
"""
