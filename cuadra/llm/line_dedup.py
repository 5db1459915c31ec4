"""Line dedup: lines that many documents hold go from all of them but one.

Every task notes the hashes of its lines in two Bloom filters, one for hashes seen once and one for hashes seen
twice. Filters are merged in pieces: what two tasks have both seen once counts as seen twice. Only lines whose
hash the merged second filter holds are shuffled, by hash and without their text, to count their documents and
find the one that keeps them. A filter never misses a repeat; a false alarm costs a shuffled row and no more.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._common import LOWER, UPPER, columns, cut, table

#: A key needs so many code points, and so many documents, for its lines to go.
LEAST_CHARS, LEAST_DOCS = 20, 3
#: Bits of a filter for each line, most bits of a filter (64 MB), and hashes a line sets.
BITS_PER_LINE, MOST_BITS, HASHES = 8, 2**29, 3
#: Most bits of a piece by which filters are merged, and lines noted at a time.
PIECE, CHUNK = 2**19, 100_000
#: Most confirmed keys (24 bytes each) that are broadcast; beyond that they are joined.
BROADCAST = 1_000_000

_LOWER = bytes.maketrans(UPPER.encode(), LOWER.encode())
_BLANKS = b" \t\n\v\f\r"
_CONTINUED = bytes(range(0x80, 0xC0))


def keyed_lines(text: bytes, least: int) -> Iterator[tuple[int, bytes]]:
    """(place of a line, 16 bytes of its key's hash) for the lines whose keys are long enough."""
    for k, line in enumerate(text.translate(_LOWER).split(b"\n")):
        key = line.strip(_BLANKS)
        if len(key) >= least and (key.isascii() or len(key.translate(None, _CONTINUED)) >= least):
            yield k, hashlib.blake2b(key, digest_size=16).digest()


def _halves(digests) -> np.ndarray:
    """Two 64-bit numbers of each digest."""
    return np.frombuffer(b"".join(digests), np.uint64).reshape(-1, 2)


def _places(halves: np.ndarray, bits: int) -> np.ndarray:
    step = halves[:, 1] | np.uint64(1)
    return np.stack([(halves[:, 0] + np.uint64(j) * step) & np.uint64(bits - 1) for j in range(HASHES)])


def _holds(filter_: np.ndarray, places: np.ndarray) -> np.ndarray:
    return ((filter_[places >> np.uint64(6)] >> (places & np.uint64(63))) & np.uint64(1)).all(0)


def _set(filter_: np.ndarray, places: np.ndarray) -> None:
    np.bitwise_or.at(filter_, places.ravel() >> np.uint64(6), np.uint64(1) << (places.ravel() & np.uint64(63)))


class Seen:
    """The two filters of one task."""

    def __init__(self, bits: int):
        self.bits, self.once, self.twice = bits, np.zeros(bits // 64, np.uint64), np.zeros(bits // 64, np.uint64)

    def add(self, digests: list[bytes]) -> None:
        halves = _halves(digests)
        _, first, counts = np.unique(halves[:, 0], return_index=True, return_counts=True)
        places = _places(halves[first], self.bits)
        _set(self.twice, places[:, (counts > 1) | _holds(self.once, places)])
        _set(self.once, places)


def filter_bits(docs: DataFrame) -> int:
    """A power of two that follows the number of lines, up to MOST_BITS."""
    breaks = docs.agg(F.sum(F.length("text") - F.length(F.replace(F.col("text"), F.lit("\n"), F.lit(""))) + 1)).first()[0] or 0
    return min(MOST_BITS, 1 << max(16, int(breaks * BITS_PER_LINE - 1).bit_length()))


def seen_twice(docs: DataFrame, least: int, bits: int) -> np.ndarray:
    """The merged filter of hashes that two documents may hold; at most MOST_BITS reach the driver."""
    spark = docs.sparkSession
    piece, chunk = max(2**12, min(PIECE, bits // 256)), CHUNK

    def note(batches):
        seen, waiting = Seen(bits), []
        for batch in batches:
            for text in batch.column("text"):
                # a key counts once a document
                waiting.extend({d for _, d in keyed_lines(text.as_py() or b"", least)})
                if len(waiting) >= chunk:
                    seen.add(waiting)
                    waiting = []
        if waiting:
            seen.add(waiting)
        once, twice = seen.once.reshape(-1, piece // 64), seen.twice.reshape(-1, piece // 64)
        for k in np.flatnonzero(once.any(1)).tolist():
            yield pa.RecordBatch.from_pydict({"piece": pa.array([k], pa.int32()), "once": pa.array([zlib.compress(once[k].tobytes(), 1)]), "twice": pa.array([zlib.compress(twice[k].tobytes(), 1)])})

    def merge(batches):
        kept: dict[int, list[np.ndarray]] = {}
        for batch in batches:
            for k, *both in zip(*(batch.column(c).to_pylist() for c in ("piece", "once", "twice")), strict=True):
                once, twice = (np.frombuffer(zlib.decompress(x), np.uint64) for x in both)
                if k not in kept:
                    kept[k] = [once.copy(), twice.copy()]
                    continue
                mine = kept[k]
                mine[1] |= twice
                mine[1] |= mine[0] & once
                mine[0] |= once
        for k, (_, twice) in kept.items():
            if twice.any():
                yield pa.RecordBatch.from_pydict({"piece": pa.array([k], pa.int32()), "twice": pa.array([zlib.compress(twice.tobytes(), 1)])})

    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    noted = docs.select(F.col("text").cast("binary").alias("text")).mapInArrow(note, "piece int, once binary, twice binary")
    out = np.zeros((bits // piece, piece // 64), np.uint64)
    for r in noted.repartition(parts, "piece").mapInArrow(merge, "piece int, twice binary").collect():
        out[r["piece"]] = np.frombuffer(zlib.decompress(bytes(r["twice"])), np.uint64)
    return out.ravel()


def suspects(docs: DataFrame, twice: np.ndarray, least: int, *carry: str) -> DataFrame:
    """(key, ...carry) for every document and every key of it that the filter holds."""
    shared, bits, chunk = docs.sparkSession.sparkContext.broadcast(twice), len(twice) * 64, CHUNK
    kinds = {f.name: f.dataType.simpleString() for f in docs.schema if f.name in carry}

    def find(batches):
        twice = shared.value
        for batch in batches:
            digests: list[bytes] = []
            owner: list[int] = []
            for at, text in enumerate(batch.column("text")):
                own = {d for _, d in keyed_lines(text.as_py() or b"", least)}
                digests.extend(own)
                owner.extend([at] * len(own))
                if digests and (len(digests) >= chunk or at == batch.num_rows - 1):
                    yield hit(batch, digests, owner, twice)
                    digests, owner = [], []
            if digests:
                yield hit(batch, digests, owner, twice)

    def hit(batch, digests, owner, twice):
        at = np.flatnonzero(_holds(twice, _places(_halves(digests), bits)))
        rows = pa.array(np.array(owner, np.int64)[at])
        return pa.RecordBatch.from_arrays([pa.array([digests[k] for k in at.tolist()], pa.binary()), *(batch.column(c).take(rows) for c in kinds)], names=["key", *kinds])

    ddl = ", ".join(["key binary", *(f"{c} {kind}" for c, kind in kinds.items())])
    return docs.select(F.col("text").cast("binary").alias("text"), *kinds).mapInArrow(find, ddl)


def _without(text: bytes, lost: set[int]) -> bytes:
    return b"\n".join(line for k, line in enumerate(text.split(b"\n")) if k not in lost) if lost else text


class Confirmed:
    """Confirmed keys with the document that keeps each, sorted for search."""

    def __init__(self, rows: pa.Table):
        halves = _halves(rows.column("key").to_pylist())
        order = np.lexsort((halves[:, 1], halves[:, 0]))
        self.first, self.second = halves[order, 0].copy(), halves[order, 1].copy()
        last = rows.column("last").combine_chunks()
        self.none, self.last = last.is_null().to_numpy(False)[order], last.fill_null(0).to_numpy(False)[order]

    def drops(self, digests: list[bytes], ids: np.ndarray, no_id: np.ndarray) -> np.ndarray:
        """Whether each line goes; ids, no_id: of the line's document."""
        if not len(self.first) or not digests:
            return np.zeros(len(digests), bool)
        halves, end = _halves(digests), len(self.first) - 1
        at = np.minimum(np.searchsorted(self.first, halves[:, 0]), end)
        while (on := (self.first[at] == halves[:, 0]) & (self.second[at] < halves[:, 1]) & (at < end)).any():
            at = at + on
        known = (self.first[at] == halves[:, 0]) & (self.second[at] == halves[:, 1])
        keeps = np.where(no_id, self.none[at], ~self.none[at] & (self.last[at] == ids))
        return known & ~keeps


def dedup(docs: DataFrame, least_docs: int = LEAST_DOCS, least_chars: int = LEAST_CHARS, most: int | None = None) -> DataFrame:
    """(doc_id, n_lines, n_dropped, kept) of every document; `kept` is what stays of its text, as bytes.

    A line's key is the line without blanks at both ends and with A-Z in lower case. Keys of `least_chars` code
    points that `least_docs` documents hold lose their lines except in the largest doc_id that holds them, where
    every one of them stays. A null or empty text is one empty line. Each row is a document of its own: repeated
    rows count apart, and those that share the largest id all keep the line. A null id is below every other, and
    keeps a line where no holder has an id. An empty table gives no rows; other columns are left out.
    """
    docs = columns(docs, doc_id="long", text="string").withColumn("text", F.coalesce("text", F.lit("")))
    spark, most = docs.sparkSession, BROADCAST if most is None else most
    twice = seen_twice(docs, least_chars, filter_bits(docs))
    counted = suspects(docs, twice, least_chars, "doc_id").groupBy("key").agg(F.count("*").alias("n"), F.max("doc_id").alias("last"))
    confirmed = cut(counted.where(F.col("n") >= least_docs).select("key", "last"))
    ddl = "doc_id long, n_lines long, n_dropped long, kept binary"
    schema = pa.schema([("doc_id", pa.int64()), ("n_lines", pa.int64()), ("n_dropped", pa.int64()), ("kept", pa.binary())])
    if confirmed.limit(most + 1).count() > most:
        return _joined(docs, twice, confirmed, least_chars, ddl, schema)
    shared, chunk = spark.sparkContext.broadcast(Confirmed(confirmed.toArrow())), CHUNK

    def apply(batches):
        known = shared.value
        for batch in batches:
            ids = batch.column("doc_id")
            no_id, of = ids.is_null().to_numpy(False), ids.fill_null(0).to_numpy(False)
            texts: list[bytes] = []
            at: list[int] = []
            start = 0
            lines: list[tuple[int, bytes]] = []
            for k, text in enumerate(batch.column("text")):
                texts.append(text.as_py())
                found = list(keyed_lines(texts[-1], least_chars))
                lines.extend(found)
                at.extend([k] * len(found))
                if len(lines) >= chunk or k == batch.num_rows - 1:
                    owner = np.array(at, np.int64)
                    gone: dict[int, set[int]] = {}
                    for i in np.flatnonzero(known.drops([d for _, d in lines], of[owner], no_id[owner])).tolist():
                        gone.setdefault(at[i], set()).add(lines[i][0])
                    lost = [gone.get(start + i, set()) for i in range(len(texts))]
                    yield rows_of(ids.slice(start, len(texts)), texts, lost)
                    texts, at, start, lines = [], [], k + 1, []

    def rows_of(ids, texts, lost):
        return pa.RecordBatch.from_arrays([ids, pa.array([t.count(b"\n") + 1 for t in texts], pa.int64()), pa.array([len(x) for x in lost], pa.int64()), pa.array([_without(t, x) for t, x in zip(texts, lost, strict=True)], pa.binary())], schema=schema)

    return docs.select("doc_id", F.col("text").cast("binary").alias("text")).mapInArrow(apply, ddl)


def _joined(docs: DataFrame, twice: np.ndarray, confirmed: DataFrame, least: int, ddl: str, schema: pa.Schema) -> DataFrame:
    """The same for any number of confirmed keys: the keys that a text loses are joined to it by a hash of id and text."""
    docs = docs.withColumn("row", F.unhex(F.sha2(F.concat_ws("|", F.coalesce(F.col("doc_id").cast("string"), F.lit("-")), F.col("text")), 256)))
    held = suspects(docs, twice, least, "doc_id", "row").join(confirmed.withColumnRenamed("key", "known"), F.col("key") == F.col("known"))
    lost = held.where(~F.col("doc_id").eqNullSafe(F.col("last"))).groupBy("row").agg(F.collect_set("key").alias("keys")).withColumnRenamed("row", "of")

    def apply(batches):
        for batch in batches:
            texts, lost = [x.as_py() for x in batch.column("text")], []
            for text, keys in zip(texts, batch.column("keys").to_pylist(), strict=True):
                keys = set(keys or ())
                lost.append({k for k, d in keyed_lines(text, least) if d in keys} if keys else set())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array([t.count(b"\n") + 1 for t in texts], pa.int64()), pa.array([len(x) for x in lost], pa.int64()), pa.array([_without(t, x) for t, x in zip(texts, lost, strict=True)], pa.binary())], schema=schema)

    both = docs.join(lost, F.col("row") == F.col("of"), "left")
    return both.select("doc_id", F.col("text").cast("binary").alias("text"), "keys").mapInArrow(apply, ddl)


def op13_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = dedup(table(spark, sf_dir, "documents"))
    return kept.select("doc_id", "n_lines", "n_dropped", F.sha2("kept", 256).alias("kept_sha256"))


OP13_SQL = f"""
WITH docs AS (SELECT row_number() OVER () AS r, doc_id, string_split(coalesce(text, ''), chr(10)) AS lines FROM documents),
lines AS (SELECT r, doc_id, unnest(lines) AS line, generate_subscripts(lines, 1) AS k FROM docs),
keyed AS (
  SELECT *, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), '{UPPER}', '{LOWER}') AS key FROM lines),
known AS (SELECT key, max(doc_id) AS last FROM keyed WHERE length(key) >= {LEAST_CHARS} GROUP BY key HAVING count(DISTINCT r) >= {LEAST_DOCS}),
judged AS (
  SELECT l.r, l.doc_id, l.line, l.k, n.key IS NOT NULL AND l.doc_id IS DISTINCT FROM n.last AS gone
  FROM keyed l LEFT JOIN known n ON l.key = n.key)
SELECT any_value(doc_id) AS doc_id, count(*)::BIGINT AS n_lines, (count(*) FILTER (WHERE gone))::BIGINT AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY k) FILTER (WHERE NOT gone), '')) AS kept_sha256
FROM judged GROUP BY r
"""
