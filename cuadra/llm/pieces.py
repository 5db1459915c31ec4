"""SentencePiece encoding and decoding over a relational lattice.

A text is cut into units between which no piece reaches: runs of blanks with what follows, parted where the
model has no piece with two such characters side by side (letters and digits, say). Every distinct unit is encoded once: its substrings of bounded length are exploded and equi-joined to the
piece table, the edges that come back are grouped by unit, and a Spark higher-order aggregate folds them.

For a unigram model the fold is Viterbi's: the path with the highest sum of scores. A BPE model's scores are
merge ranks and no sum of them gives its segmentation, so for such a model the fold goes once through the
edges in the order of their ranks and applies each that joins two neighbouring symbols. Once is enough where
every piece is two symbols when the pieces of lower rank have been applied to it, as is checked when a model
is loaded: what merges within a stretch that no symbol leaves is what merges there alone. Characters without
a piece become their bytes.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable
from dataclasses import dataclass, field
from itertools import islice

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..storage import tidy
from ._common import columns, cut, freed, let, slices, table

MODEL_FILE = "/opt/tokenizers/piece_bpe_32k.model"
BLANK = "▁"
#: Characters up to which a unit's symbols are bits of one number; of longer units, characters whose substrings are made at a time.
SHORT, BLOCK = 62, 128
#: Distinct units whose lattice one task makes, roughly.
UNITS_A_TASK = 25_000
#: Encodings of the distinct units are broadcast to the tasks up to so many bytes.
BROADCAST_BYTES = 96 * 2**20
#: Bytes of the digest that names a text where its rare units are joined.
DIGEST = 12
#: Words whose encodings a worker keeps at hand.
KEPT_WORDS = 120_000
WORDS = f"{BLANK}*[^{BLANK}]+|{BLANK}+"
# an edge of a short unit in one number: rank, end, length, id; those of single characters come last
_END, _LEN, _ID = 6, 5, 16
_SINGLE = 2**16 - 1


@dataclass
class Pieces:
    """rows: (piece, id, score) of the ordinary pieces; bytes_: id of each byte; bpe: scores are merge ranks."""

    rows: list[tuple[str, int, float]]
    bytes_: list[int]
    bpe: bool = True
    ranks: dict[float, int] = field(init=False)

    def __post_init__(self):
        self.ranks = {s: k for k, s in enumerate(sorted({r[2] for r in self.rows}, reverse=True))}
        self.longest = max(len(r[0]) for r in self.rows)
        if self.longest >= 2**_LEN or max(r[1] for r in self.rows) >= 2**_ID or len(self.ranks) >= 2**16:
            raise ValueError("pieces are too long or too many")
        if any(BLANK in r[0].lstrip(BLANK) for r in self.rows):
            raise ValueError("pieces with a blank behind another character aren't supported")
        if self.bpe and (odd := [p for p, _, _ in self.rows if len(p) > 1 and not self._closed(p)]):
            raise ValueError(f"pieces that lower ranks don't make of two: {odd[:5]}")
        self.units = self._units()

    def _closed(self, piece: str) -> bool:
        """Whether the pieces of lower rank leave two symbols of this one, or it is a run of one character of the last rank.

        Such runs grow from the left: the edges of one rank are in the order of their ends, shorter ones first.
        """
        rank = self._rank_of = getattr(self, "_rank_of", None) or {p: self.ranks[s] for p, _, s in self.rows}
        if rank[piece] == len(self.ranks) - 1:
            return piece == piece[0] * len(piece)
        symbols = list(piece)
        while True:
            pairs = [(rank[a + b], k) for k, (a, b) in enumerate(zip(symbols, symbols[1:], strict=False)) if rank.get(a + b, rank[piece]) < rank[piece]]
            if not pairs:
                return len(symbols) == 2
            k = min(pairs)[1]
            symbols[k : k + 2] = [symbols[k] + symbols[k + 1]]

    def _units(self) -> str:
        """A pattern of units: blanks with characters that pieces connect, else single characters.

        Characters are connected if they stand side by side in a piece, or are connected with one that both are
        connected with. So each piece lies within a unit.
        """
        top: dict[str, str] = {}

        def find(c: str) -> str:
            while top.setdefault(c, c) != c:
                top[c] = top[top[c]]
                c = top[c]
            return c

        for piece, _, _ in self.rows:
            bare = piece.lstrip(BLANK)
            for a, b in zip(bare, bare[1:], strict=False):
                top[find(a)] = find(b)
            if bare != piece and bare:
                find(bare[0])
        kinds: dict[str, set[str]] = {}
        for c in list(top):
            kinds.setdefault(find(c), set()).add(c)

        def ranges(chars: set[str]) -> str:
            points, out = sorted(map(ord, chars)), []
            for x in points:
                if out and out[-1][1] + 1 == x:
                    out[-1][1] = x
                else:
                    out.append([x, x])
            shown = lambda x: ("" if chr(x).isalnum() or x > 127 else "\\") + chr(x)
            return "".join(shown(a) if a == b else f"{shown(a)}-{shown(b)}" for a, b in out)

        ordered = sorted(kinds.values(), key=lambda k: (-len(k), min(k)))
        # characters that follow blanks only, each for itself, in one class
        single = {c for k in ordered if len(k) == 1 for c in k}
        parts = [f"{BLANK}*+[{ranges(k)}]+" for k in ordered if len(k) > 1] + ([f"{BLANK}*+[{ranges(single)}]"] if single else [])
        return "(?s)" + "|".join([*parts, f"{BLANK}+", "."])

    @classmethod
    def load(cls, path: str = MODEL_FILE, bpe: bool = True) -> Pieces:
        """Read a model file on the driver; it is never copied, and tasks get the table only."""
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=path)
        n = sp.get_piece_size()
        plain = [i for i in range(n) if not (sp.is_byte(i) or sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i))]
        return cls([(sp.id_to_piece(i), i, sp.get_score(i)) for i in plain], [sp.piece_to_id(f"<0x{b:02X}>") for b in range(256)], bpe)


def words_of(text: Column) -> Column:
    """A text's words without the first of the blanks that each stands behind; null and empty texts have none."""
    blank = F.lit(BLANK)
    several = F.startswith(text, F.lit(" ")) | F.endswith(text, F.lit(" ")) | F.contains(text, F.lit("  ")) | F.contains(text, blank)
    # most texts have single blanks only, which need no pattern
    marked = F.concat(blank, F.replace(text, F.lit(" "), blank))
    found = F.transform(F.regexp_extract_all(marked, F.lit(WORDS), F.lit(0)), lambda w: F.substr(w, F.lit(2)))
    return F.when(F.coalesce(text, F.lit("")) == "", F.array().cast("array<string>")).when(several, found).otherwise(F.split(text, " "))


def units_of(word: Column, pieces: Pieces) -> Column:
    """The units of a word behind its blank, in order."""
    return F.regexp_extract_all(F.concat(F.lit(BLANK), word), F.lit(pieces.units), F.lit(0))


def _grouped(units: DataFrame, parts: int) -> DataFrame:
    """Units dealt out so that what comes of them can be grouped by unit without another shuffle."""
    return units.repartition(parts, "unit")


def _fixed(spark: SparkSession, rows: list[tuple], **kinds: pa.DataType) -> DataFrame:
    """A small table, by way of Arrow: of rows as a list Spark makes a job with workers of its own, which live on."""
    columns_ = zip(zip(*rows, strict=True), kinds.items(), strict=True)
    return spark.createDataFrame(pa.table({name: pa.array(c, kind) for c, (name, kind) in columns_}))


def lattice(units: DataFrame, pieces: Pieces, parts: int) -> DataFrame:
    """(unit, edges): the pieces that each unit of up to SHORT characters holds, as packed numbers in the order of
    ranks, by explode, equi-join and group."""
    spark = units.sparkSession
    # fixed tables: at most 2^16 pieces, and the substrings of each length
    rows = [(p, len(p), ((pieces.ranks[s] if len(p) > 1 else _SINGLE) << _END + _LEN + _ID) | (len(p) << _ID) | i) for p, i, s in pieces.rows]
    known = F.broadcast(_fixed(spark, rows, piece=pa.string(), size=pa.int32(), packed=pa.int64()).withColumn("h", F.xxhash64("piece")))
    cuts = [(size, [i << _LEN | n for i in range(size) for n in range(1, min(pieces.longest, size - i) + 1)]) for size in range(1, SHORT + 1)]
    spans = F.broadcast(_fixed(spark, cuts, size=pa.int32(), cuts=pa.list_(pa.int32())))
    each = _grouped(units, parts).join(spans, F.length("unit") == F.col("size")).select("unit", F.explode("cuts").alias("cut"))
    subs = each.select("unit", F.expr(f"shiftright(cut, {_LEN}) + (cut & {2**_LEN - 1})").alias("e"), F.expr(f"substring(unit, shiftright(cut, {_LEN}) + 1, cut & {2**_LEN - 1})").alias("sub"))
    # a join on numbers is several times faster than one on strings; equal hashes are checked
    edges = subs.join(known, (F.xxhash64("sub") == F.col("h")) & F.startswith("sub", "piece") & (F.length("sub") <= F.col("size")))
    edge = F.col("packed").bitwiseOR(F.shiftleft(F.col("e").cast("long"), _LEN + _ID))
    return edges.select("unit", edge.alias("edge")).groupBy("unit").agg(F.sort_array(F.collect_list("edge")).alias("edges"))


def long_lattice(units: DataFrame, pieces: Pieces, parts: int) -> DataFrame:
    """The same for units of any length; an edge is (rank, e, size, s, id). Substrings are made block by block, and a unit
    is a number until its edges are together."""
    spark = units.sparkSession
    rows = [(p, pieces.ranks[s] if len(p) > 1 else _SINGLE, len(p), i) for p, i, s in pieces.rows]
    known = F.broadcast(_fixed(spark, rows, piece=pa.string(), rank=pa.int32(), size=pa.int32(), id=pa.int32()))
    keyed = cut(units.select("unit", F.monotonically_increasing_id().alias("uid")))
    bases = F.sequence(F.lit(0), F.floor((F.length("unit") - 1) / BLOCK).cast("int"))
    blocks = keyed.select("uid", F.transform(bases, lambda b: F.struct((b * BLOCK).alias("base"), F.substring(F.col("unit"), b * BLOCK + 1, F.lit(BLOCK + pieces.longest - 1)).alias("t"))).alias("blocks"))
    blocks = blocks.select("uid", F.explode("blocks").alias("block")).select("uid", "block.*").repartition(parts, "uid", "base")

    def subs(t: Column) -> Column:
        starts = F.sequence(F.lit(0), F.least(F.lit(BLOCK), F.length(t)) - 1)
        return F.flatten(F.transform(starts, lambda i: F.transform(F.sequence(F.lit(1), F.least(F.lit(pieces.longest), F.length(t) - i)), lambda n: F.struct(i.alias("i"), F.substring(t, i + 1, n).alias("sub")))))

    found = blocks.select("uid", "base", F.explode(subs(F.col("t"))).alias("s"))
    edges = found.join(known, F.col("s.sub") == F.col("piece")).withColumn("s", F.col("base") + F.col("s.i"))
    edge = F.struct("rank", (F.col("s") + F.col("size")).alias("e"), "size", "s", "id")
    return keyed.join(edges.groupBy("uid").agg(F.sort_array(F.collect_list(edge)).alias("edges")), "uid").select("unit", "edges")


def _open(edge: Column) -> Column:
    end = F.shiftright(edge, _LEN + _ID).bitwiseAND(F.lit(2**_END - 1)).cast("int")
    size = F.shiftright(edge, _ID).bitwiseAND(F.lit(2**_LEN - 1)).cast("int")
    return F.struct((end - size).alias("s"), end.alias("e"), edge.bitwiseAND(F.lit(2**_ID - 1)).cast("int").alias("id"))


def _masks() -> list[Column]:
    """By end << 5 | size of an edge: its two ends as bits, those and all bits between, and all bits but those between.

    Written as texts, which Spark turns into arrays once.
    """
    ends, whole, rest = ([0] * 2 ** (_END + _LEN) for _ in range(3))
    for end in range(1, SHORT + 1):
        for size in range(1, min(end, 2**_LEN - 1) + 1):
            low, high, k = 1 << end - size, 1 << end, end << _LEN | size
            ends[k], whole[k], rest[k] = low | high, 2 * high - low, ~(high - 2 * low)
    return [F.split(F.lit(",".join(map(str, numbers))), ",").cast("array<bigint>") for numbers in (ends, whole, rest)]


def _merge_bits(n: Column, edges: Column) -> Column:
    """End, size and id (as in an edge) of the symbols of a short unit, in order, where each has a piece; else null.

    The state is a number whose bit i says that a symbol starts (or the unit ends) at i. An edge applies if its
    ends are set and exactly one bit between them is; that bit goes. What this costs is the number of expressions
    an edge passes, so masks come from tables and the test that most edges fail is first.
    """
    tables = dict(zip(("ends", "whole", "rest"), _masks(), strict=True))

    def masks(edge):
        place = F.shiftright(edge, _ID).bitwiseAND(F.lit(2 ** (_END + _LEN) - 1)).cast("int")
        return let(place, lambda k: F.struct(*(F.get(t, k).alias(name) for name, t in tables.items()), edge.bitwiseAND(F.lit(2 ** (_END + _LEN + _ID) - 1)).alias("out")))

    def holds(state, x, bits):
        return (F.bit_count(state.bitwiseAND(x["whole"])) == bits) & (state.bitwiseAND(x["ends"]) == x["ends"])

    def step(state, x):
        return F.when(holds(state, x, 3), state.bitwiseAND(x["rest"])).otherwise(state)

    def symbols(edges):
        def left(state):
            # one edge a symbol at most: pieces differ
            return let(F.filter(edges, lambda x: holds(state, x, 2)), lambda y: F.when(F.size(y) == F.bit_count(state) - 1, F.sort_array(F.transform(y, lambda x: x["out"]))))

        # a bit for each character and the end; a power of two less one would overflow for the longest
        return let(F.aggregate(edges, F.bitwise_not(F.call_function("shiftleft", F.lit(-1).cast("long"), n + 1)), step), left)

    return let(F.transform(edges, masks), symbols)


def _merge_short(n: Column, edges: Column) -> Column:
    """End of the symbol at each position, 0 where none starts, of a short unit with characters that have no piece.

    The state is the ends as an array, which each merge writes anew.
    """

    def step(ends, x):
        mid = F.get(ends, x["s"])
        fits = (mid > 0) & (mid < x["e"]) & (F.get(ends, mid) == x["e"])
        return F.when(fits, F.transform(ends, lambda old, i: F.when(i == x["s"], x["e"]).when(i == mid, F.lit(0)).otherwise(old))).otherwise(ends)

    return F.aggregate(F.filter(edges, lambda x: x["e"] > x["s"] + 1), F.transform(F.sequence(F.lit(1), n), lambda i: i), step)


def _walk_long(unit: str, start: np.ndarray, end: np.ndarray, ids: np.ndarray, bytes_: list[int]) -> list[int]:
    """Piece ids of a long unit: its edges in order of ranks, each joined if it parts two neighbouring symbols.

    The ends of symbols are one list that is written in place, so a unit takes steps as it has edges. Spark's arrays can't
    be written in place; a fold over them would copy all n symbols for each edge.
    """
    ends = list(range(1, len(unit) + 1))
    joins = np.flatnonzero(end > start + 1)
    for s, e in zip(start[joins].tolist(), end[joins].tolist(), strict=True):
        mid = ends[s]
        if 0 < mid < e and ends[mid] == e:
            ends[s], ends[mid] = e, 0
    left = np.array(ends, np.int64)
    whole = left[start] == end
    known = dict(zip(start[whole].tolist(), ids[whole].tolist(), strict=True))
    out: list[int] = []
    for s in np.flatnonzero(left).tolist():
        if s in known:
            out.append(known[s])
        else:
            out.extend(bytes_[b] for b in unit[s : s + 1].encode())
    return out


def _encode_long(lattices: DataFrame, pieces: Pieces) -> DataFrame:
    """(unit, ids) of long units from their edges."""
    own = pieces.bytes_

    def run(batches):
        for batch in slices(batches, 1):
            unit, edges = batch.column("unit")[0].as_py(), batch.column("edges").flatten()
            end, start, ids = (edges.field(k).to_numpy(zero_copy_only=False) for k in ("e", "s", "id"))
            yield pa.RecordBatch.from_arrays([batch.column("unit"), pa.array([_walk_long(unit, start, end, ids, own)], pa.list_(pa.int32()))], names=["unit", "ids"])

    return lattices.mapInArrow(run, "unit string, ids array<int>")


def _viterbi_fold(n: Column, edges: Column, scores: Column, missing: float) -> Column:
    """The same for the path with the highest sum of scores, ties to the longer last piece."""
    best = F.struct(F.lit(0.0).alias("score"), F.array().cast("array<int>").alias("ends"))

    def step(paths, j):
        here = F.transform(F.filter(edges, lambda x: x["e"] == j), lambda x: let(F.get(paths, x["s"]), lambda p: F.struct((p["score"] + F.get(scores, x["id"])).alias("score"), F.concat(p["ends"], F.array_repeat(F.lit(0), x["e"] - x["s"] - 1), F.array(j)).alias("ends"), x["s"].alias("s"))))
        unknown = let(F.get(paths, j - 1), lambda p: F.array(F.struct((p["score"] + F.lit(missing)).alias("score"), F.concat(p["ends"], F.array(j)).alias("ends"), (j - 1).alias("s"))))
        options = F.when(F.exists(edges, lambda x: (x["e"] == j) & (x["s"] == j - 1)), here).otherwise(F.concat(here, unknown))
        top = F.aggregate(options, F.get(options, F.lit(0)), lambda a, x: F.when((x["score"] > a["score"]) | ((x["score"] == a["score"]) & (x["s"] < a["s"])), x).otherwise(a))
        return F.concat(paths, F.array(let(top, lambda t: F.struct(t["score"].alias("score"), t["ends"].alias("ends")))))

    last = F.aggregate(F.sequence(F.lit(1), n), F.array(best), step, lambda p: F.element_at(p, -1)["ends"])
    # zeros stand before an end; move each end to its symbol's start
    return let(last, lambda z: F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.when((i == 0) | (F.get(z, i - 1) > 0), F.get(F.filter(F.slice(z, i + 1, n - i), lambda x: x > 0), F.lit(0))).otherwise(F.lit(0))))


def _ids(unit: Column, ends: Column, edges: Column, bytes_: Column) -> Column:
    def one(i: Column) -> Column:
        hit = F.get(F.filter(edges, lambda x: (x["s"] == i) & (x["e"] == F.get(ends, i))), F.lit(0))["id"]
        code = F.hex(F.encode(F.substring(unit, i + 1, F.lit(1)), "UTF-8"))
        raw = F.transform(F.sequence(F.lit(1), F.length(code), F.lit(2)), lambda k: F.get(bytes_, F.conv(F.substring(code, k, F.lit(2)), 16, 10).cast("int")))
        return F.when(hit.isNotNull(), F.array(hit)).otherwise(raw)

    starts = F.filter(F.sequence(F.lit(0), F.size(ends) - 1), lambda i: F.get(ends, i) > 0)
    return F.flatten(F.transform(starts, one))


def encode_units(units: DataFrame, pieces: Pieces, n_units: int) -> DataFrame:
    """(unit, ids) of distinct units, about `n_units`; those that hold no piece at all have no row and are their bytes."""
    bytes_ = F.array(*[F.lit(i) for i in pieces.bytes_])
    parts = max(int(units.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-n_units // UNITS_A_TASK))
    n = F.length("unit")
    short = lattice(units.where(n <= SHORT), pieces, parts)
    long = units.where(n > SHORT)
    full = None if long.isEmpty() else long_lattice(long, pieces, parts)
    if not pieces.bpe:
        scores = [0.0] * (max(r[1] for r in pieces.rows) + 1)
        for _, i, s in pieces.rows:
            scores[i] = s

    def solve(edges: Column) -> Column:
        ends = _merge_short(n, edges) if pieces.bpe else _viterbi_fold(n, edges, F.array(*[F.lit(float(s)) for s in scores]), min(scores) - 10.0)
        return let(ends, lambda z: _ids(F.col("unit"), z, edges, bytes_))

    opened = F.transform("edges", _open)
    if pieces.bpe:
        own = F.transform(_merge_bits(n, F.col("edges")), lambda x: x.bitwiseAND(F.lit(2**_ID - 1)).cast("int"))
        # a unit with a character that has no piece takes the general way
        done = short.select("unit", F.coalesce(own, let(opened, solve)).alias("ids"))
    else:
        done = short.select("unit", let(opened, solve).alias("ids"))
    if full is None:
        return done
    return done.union(_encode_long(full, pieces) if pieces.bpe else full.select("unit", solve(F.col("edges")).alias("ids")))


def _flat(chunk: pa.Array) -> memoryview:
    """The bytes of a binary array, one value after the other."""
    ends = np.frombuffer(chunk.buffers()[1], np.int32, len(chunk) + 1, chunk.offset * 4)
    return memoryview(chunk.buffers()[2])[int(ends[0]) : int(ends[-1])] if ends[-1] > ends[0] else memoryview(b"")


def _words(text: str | None, pattern: re.Pattern) -> list[str]:
    """The same as `words_of`."""
    if not text:
        return []
    if "  " in text or text[0] == " " or text[-1] == " " or BLANK in text:
        return [w[1:] for w in pattern.findall(BLANK + text.replace(" ", BLANK))]
    return text.split(" ")


def _bare(unit: str, bytes_: list[int]) -> bytes:
    """The ids of a unit that holds no piece, two bytes each."""
    return np.array([bytes_[b] for b in unit.encode()], ">u2").tobytes()


def _shared(spark: SparkSession, got: pa.Table):
    """Hashes (sorted), ends and ids, two bytes each, of a table (h, ids), for the workers."""
    chunks = [c for c in got.column("ids").chunks if len(c)]
    lens = np.concatenate([pc.binary_length(c).to_numpy(zero_copy_only=False) for c in chunks] or [np.zeros(0, np.int64)]).astype(np.int64) // 2
    return spark.sparkContext.broadcast((got.column("h").to_numpy(), np.concatenate([[0], np.cumsum(lens)]).astype(np.uint32), b"".join(_flat(c) for c in chunks)))


def _looking(table: tuple, find: re.Pattern) -> Callable:
    """A function for workers: the units of each of some words, and the encodings of all of them in turn, None where the
    table has none; those of all words are found in one search."""
    keys, ends, values = table

    def look(new: list[str]) -> tuple[list[list[str]], list[bytes | None]]:
        split = [find.findall(BLANK + w) for w in new]
        # nearly all units are words of their own, so they aren't made distinct
        units = [u for parts in split for u in parts]
        hashed = np.array([xxhash.xxh64_intdigest(u.encode(), seed=42) for u in units], np.uint64).view(np.int64)
        at = np.minimum(np.searchsorted(keys, hashed), max(len(keys) - 1, 0))
        there = keys[at] == hashed if len(keys) else np.zeros(len(at), bool)
        first, last = (2 * ends[k].astype(np.int64) if len(keys) else at for k in (at, at + 1))
        return split, [values[a:b] if ok else None for a, b, ok in zip(first.tolist(), last.tolist(), there.tolist(), strict=True)]

    return look


def _opened(split: list[list[str]], look: Callable, kept: dict[str, bytes]) -> dict[str, list[tuple[str, bytes | None]]]:
    """See that `kept` has the words of some texts; those with a unit that the table lacks are returned by units instead."""
    new = list({w for words in split for w in words}.difference(kept))
    if len(kept) + len(new) > KEPT_WORDS:
        still = {w: kept[w] for words in split for w in words if w in kept}
        kept.clear()
        kept.update(still)
    parts, codes = look(new)
    each, odd = iter(codes), {}
    for w, units in zip(new, parts, strict=True):
        if len(units) == 1 and (code := next(each)) is not None:
            kept[w] = code
            continue
        mine = [None] if len(units) == 1 else list(islice(each, len(units)))
        if None in mine:
            odd[w] = list(zip(units, mine, strict=True))
        else:
            kept[w] = b"".join(mine)
    return odd


def _rare(words: list[str], odd: dict[str, list[tuple[str, bytes | None]]]) -> tuple[set[str], list[str]]:
    """The words of a text that aren't kept, and the units in them that the table lacks, in an order of their own."""
    own = odd.keys() & words
    return own, sorted({u for w in own for u, code in odd[w] if code is None})


def _batch(part: pa.RecordBatch, carry: tuple[str, ...], lists: list[bytes]) -> pa.RecordBatch:
    flat = np.frombuffer(b"".join(lists), ">u2").astype(np.int32)
    ids = pa.ListArray.from_arrays(np.concatenate([[0], np.cumsum([len(x) // 2 for x in lists])]).astype(np.int32), flat)
    return pa.RecordBatch.from_arrays([*(part.column(c) for c in carry), ids], names=[*carry, "ids"])


def _digest(raw: bytes) -> bytes:
    return hashlib.blake2b(raw, digest_size=DIGEST).digest()


def _often(rows: DataFrame, seen: DataFrame, coded: DataFrame, pieces: Pieces, bytes_: int, most: int) -> pa.Table:
    """(h, ids) of the units that have most places, in `most` of the `bytes_` that all encodings take.

    Places are counted in a share of the texts, drawn by hash. Which units these are decides where an encoding is found,
    never what it is. A unit that shares its hash with another isn't among them.
    """
    # a share of the texts has that share of the units or more
    drawn = rows.where(F.pmod(F.xxhash64("_text"), F.lit(10**6)) < int(min(1.0, most / bytes_) * 10**6))
    words = drawn.select(F.explode(words_of(F.col("_text"))).alias("word")).groupBy("word").agg(F.count("*").alias("n"))
    units = words.select(F.explode(units_of(F.col("word"), pieces)).alias("unit"), "n").groupBy("unit").agg(F.sum("n").alias("n"))
    h = F.xxhash64("unit")
    alone = seen.groupBy(h.alias("h")).count().where("count = 1").select("h")
    found = cut(coded.join(units, "unit").select(h.alias("h"), "ids", F.least("n", F.lit(1000)).alias("n")).join(alone, "h", "left_semi"))
    left, least, part = most, 0, 0
    for n, size in sorted(map(tuple, found.groupBy("n").agg(F.sum(F.octet_length("ids") + 12)).collect()), reverse=True):
        if size > left:
            # of the last ones as many as there is room for, by hash
            least, part = n, 950 * left // size
            break
        left -= size
    return found.where((F.col("n") > least) | (F.pmod("h", F.lit(1000)) < part) & (F.col("n") == least)).select("h", "ids").sort("h").toArrow()


def encode(docs: DataFrame, pieces: Pieces, carry: tuple[str, ...] = ("doc_id",), broadcast_bytes: int = BROADCAST_BYTES, decoded: bool = False) -> DataFrame:
    """Add `ids`, the piece ids of every whole text, to the columns in `carry`.

    Blanks are spaces; a text is encoded behind one more space. A null or empty text has no ids. A text that
    holds the mark U+2581 itself decodes to a space there. Null ids and repeated rows are encoded like
    others, an empty table gives no rows, columns that aren't carried are dropped.

    With `decoded`, the texts that the ids stand for come along (see `decode`), made by the same workers.

    The encodings of all distinct units are broadcast where they take at most `broadcast_bytes` and their
    hashes differ. Beyond that those of frequent units are, in half as many bytes, which most places of a text have; what else a text has is
    joined to the encodings and gathered by text, and meets the text, which travels compressed. A unit that
    can't be parted takes steps as it has characters; its edges, some ten a character, are one row.
    """
    spark = docs.sparkSession
    rows = docs.select(*carry, docs["text"].cast("string").alias("_text"))
    # words first: they are fewer than places, and the pattern of units is costly
    seen = rows.select(F.explode(words_of(F.col("_text"))).alias("word")).distinct()
    seen = cut(seen.select(F.explode(units_of(F.col("word"), pieces)).alias("unit")).distinct())
    packed = F.expr("unhex(array_join(transform(ids, x -> lpad(hex(x), 4, '0')), ''))")
    coded = cut(encode_units(seen, pieces, seen.count()).select("unit", packed.alias("ids")))
    n, size = coded.agg(F.count("*"), F.coalesce(F.sum(F.octet_length("ids")), F.lit(0))).first()
    own, words, find = pieces.bytes_, re.compile(WORDS), re.compile(pieces.units)
    ddl = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.drop("_text").schema)
    back = _decoder(spark, pieces) if decoded else iter
    out = f"{ddl}, ids array<int>" + ", decoded string" * decoded
    # a hash of 8 bytes and an end of 4 for each unit
    if 12 * n + size <= broadcast_bytes:
        got = coded.select(F.xxhash64("unit").alias("h"), "ids").sort("h").toArrow()
        h = got.column("h").to_numpy()
        if len(h) < 2 or (h[1:] != h[:-1]).all():
            shared = _shared(spark, got)
            del got

            def run(batches):
                look = _looking(shared.value, find)
                # encodings of words, each without the first of its blanks
                kept: dict[str, bytes] = {}
                for part in slices(batches):
                    split = [_words(t, words) for t in part.column("_text").to_pylist()]
                    for w, units in _opened(split, look, kept).items():
                        kept[w] = b"".join(_bare(u, own) if code is None else code for u, code in units)
                    yield _batch(part, carry, [b"".join(map(kept.__getitem__, ws)) for ws in split])

            return rows.mapInArrow(lambda batches: back(run(batches)), out)
    # what the steps before have shuffled isn't held beside what comes
    tidy(spark)
    # half, as workers hold texts and what is joined to them too
    often = _shared(spark, _often(rows, seen, coded, pieces, 12 * n + size, broadcast_bytes // 2))
    del seen
    tidy(spark)

    def rare(batches):
        """(place, unit) of the units that aren't broadcast; a place is a text's digest and a number."""
        look, kept, told = _looking(often.value, find), {}, set()
        for part in slices(batches):
            texts = list({t for t in part.column("_text").to_pylist() if t})
            split = [_words(t, words) for t in texts]
            odd, places, units = _opened(split, look, kept), [], []
            for t, ws in zip(texts, split, strict=True):
                few_ = _rare(ws, odd)[1]
                if few_ and (key := _digest(t.encode())) not in told:
                    # copies of a text ask once a worker
                    told.add(key)
                    places += [key + k.to_bytes(4, "big") for k in range(len(few_))]
                    units += few_
            if units:
                yield pa.RecordBatch.from_arrays([pa.array(places, pa.binary()), pa.array(units, pa.string())], names=["place", "unit"])

    met = rows.select("_text").mapInArrow(freed(rare), "place binary, unit string").join(coded, "unit")
    code = F.concat(F.substring("place", DIGEST + 1, 4), F.col("ids")).alias("code")
    # dealt out before they are gathered: sets of the few that a task has would take more than these
    gathered = cut(met.select(F.substring("place", 1, DIGEST).alias("_of"), code).repartition("_of").groupBy("_of").agg(F.collect_set("code").alias("_coded")))
    del coded, met
    tidy(spark)

    def pack(batches):
        codec = pa.Codec("zstd", compression_level=1)
        for part in slices(batches):
            raw = [t.encode() if t else None for t in part.column("_text").to_pylist()]
            made = [pa.array([t and _digest(t) for t in raw], pa.binary()), pa.array([t and len(t) for t in raw], pa.int64()), pa.array([t and codec.compress(t, asbytes=True) for t in raw], pa.binary())]
            yield pa.RecordBatch.from_arrays([*(part.column(c) for c in carry), *made], names=[*carry, "_key", "_size", "_zipped"])

    def run_joined(batches):
        look, kept, codec = _looking(often.value, find), {}, pa.Codec("zstd")
        for part in slices(batches):
            split = [_words(codec.decompress(z, size, asbytes=True).decode() if size else None, words) for z, size in zip(part.column("_zipped").to_pylist(), part.column("_size").to_pylist(), strict=True)]
            odd, lists = _opened(split, look, kept), []
            for ws, coded_ in zip(split, part.column("_coded").to_pylist(), strict=True):
                mine, few_ = _rare(ws, odd)
                by = {int.from_bytes(c[:4], "big"): c[4:] for c in coded_ or ()}
                codes = {u: by[k] if k in by else _bare(u, own) for k, u in enumerate(few_)}
                # kept while this text is put together
                kept.update({w: b"".join(codes[u] if c is None else c for u, c in odd[w]) for w in mine})
                lists.append(b"".join(map(kept.__getitem__, ws)))
                for w in mine:
                    del kept[w]
            yield _batch(part, carry, lists)

    zipped = rows.mapInArrow(freed(pack), f"{ddl}, _key binary, _size long, _zipped binary")
    joined = zipped.join(gathered, F.col("_key") == F.col("_of"), "left").select(*carry, "_size", "_zipped", "_coded")
    return joined.mapInArrow(freed(lambda batches: back(run_joined(batches))), out)


def _decoder(spark: SparkSession, pieces: Pieces):
    """A function that adds `decoded` to batches with `ids`."""
    raw = {i: p.replace(BLANK, " ").encode() for p, i, _ in pieces.rows} | {i: bytes([b]) for b, i in enumerate(pieces.bytes_)}
    top = max(raw) + 1
    each = [raw.get(i, b"\xef\xbf\xbd") for i in range(top + 1)]
    sizes = np.array([len(x) for x in each])
    shared = spark.sparkContext.broadcast((np.frombuffer(b"".join(each), np.uint8), sizes, np.cumsum(sizes) - sizes))

    def run(batches):
        blob, sizes, starts = shared.value
        for batch in batches:
            for begin in range(0, batch.num_rows, 500):
                part = batch.slice(begin, 500)
                lists = part.column("ids")
                ids = np.asarray(lists.flatten().fill_null(top), dtype=np.int64)
                ids = np.where((ids < 0) | (ids > top), top, ids)
                # every byte of every piece, by its place in the blob
                n = sizes[ids]
                ends = np.cumsum(n)
                place = np.arange(ends[-1] if len(ends) else 0) + np.repeat(starts[ids] - (ends - n), n)
                out = blob[place].tobytes()
                edge = np.concatenate([[0], np.cumsum(lists.value_lengths().fill_null(0).to_numpy(zero_copy_only=False))]).astype(np.int64)
                at = np.concatenate([[0], ends])[edge]
                texts = [None if null else out[a:b].decode("utf-8", "replace")[1:] for a, b, null in zip(at, at[1:], lists.is_null().to_pylist(), strict=False)]
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(texts, pa.string())], names=[*part.schema.names, "decoded"])

    return run


def decode(encoded: DataFrame, pieces: Pieces) -> DataFrame:
    """Add `decoded`, the text that `ids` stands for; null ids give null, no ids an empty text.

    Ids that aren't in the table, and bytes that aren't UTF-8, become U+FFFD.
    """
    ddl = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in encoded.schema)
    return encoded.mapInArrow(_decoder(encoded.sparkSession, pieces), f"{ddl}, decoded string")


def op6_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = columns(table(spark, sf_dir, "documents"), doc_id="long", text="string")
    back = encode(docs.withColumn("crc", F.crc32(F.encode(F.coalesce("text", F.lit("")), "UTF-8"))), Pieces.load(), ("doc_id", "crc"), decoded=True)
    exact = F.crc32(F.encode("decoded", "UTF-8")) == F.col("crc")
    return back.select("doc_id", F.size("ids").cast("long").alias("n_ids"), "ids", exact.alias("exact"))
