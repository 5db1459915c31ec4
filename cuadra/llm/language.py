"""Language identification: scripts narrow the candidates, Viterbi over word scores labels spans.

A word's score for a language is the log probability of its character 1- to 4-grams and of the word itself,
all hashed into a fixed number of buckets. A path through the languages, one per word, pays a penalty for
each switch. Training counts are added up by Spark over a bounded sample of labelled documents.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._common import columns, freed, slices, table

#: Labelled documents of each language that are used for training (expected; the sample is drawn by hash).
DOCS_PER_LANG = 1500
#: The model (languages x buckets x 4 bytes) is kept within this size: buckets are halved until it fits.
MODEL_BYTES, MOST_BUCKETS = 32 * 2**20, 2**16
#: What a switch of language costs, in nats.
SWITCH = 12.0
#: Grams of four lengths overlap, so their sum is divided; and no word speaks against a language by more than this.
OVERLAP, LOUDEST = 4.0, 8.0
SMOOTHING = 0.3
#: A share of the training words from which on a script counts as used by a language.
SCRIPT_SHARE = 0.02
#: Words whose scores a worker keeps.
KEPT_WORDS = 400_000
LETTERS = regex.compile(r"\p{L}[\p{L}\p{M}]*")
#: First code points of script blocks (fixed values), each up to the next; blocks named alike are one script.
SCRIPTS = [
    (0x0000, "latin"), (0x0370, "greek"), (0x0400, "cyrillic"), (0x0530, "armenian"), (0x0590, "hebrew"), (0x0600, "arabic"), (0x0700, "other"),
    (0x0750, "arabic"), (0x0780, "other"), (0x0900, "devanagari"), (0x0980, "bengali"), (0x0A00, "gurmukhi"), (0x0A80, "gujarati"), (0x0B00, "oriya"),
    (0x0B80, "tamil"), (0x0C00, "telugu"), (0x0C80, "kannada"), (0x0D00, "malayalam"), (0x0D80, "sinhala"), (0x0E00, "thai"), (0x0E80, "lao"),
    (0x0F00, "tibetan"), (0x1000, "myanmar"), (0x10A0, "georgian"), (0x1100, "hangul"), (0x1200, "ethiopic"), (0x13A0, "other"), (0x1780, "khmer"),
    (0x1800, "mongolian"), (0x18B0, "other"), (0x1E00, "latin"), (0x1F00, "greek"), (0x2000, "other"), (0x2C60, "latin"), (0x2C80, "other"),
    (0x3040, "kana"), (0x3100, "han"), (0x3130, "hangul"), (0x3190, "han"), (0xA000, "other"), (0xAC00, "hangul"), (0xD7B0, "other"), (0xF900, "han"),
    (0xFB00, "latin"), (0xFB1D, "hebrew"), (0xFB50, "arabic"), (0xFE00, "other"), (0xFE70, "arabic"), (0xFF00, "latin"), (0xFF66, "kana"),
    (0xFFA0, "hangul"), (0xFFE0, "other"), (0x20000, "han"), (0x323B0, "other"),
]
_STARTS = np.array([s for s, _ in SCRIPTS])
NAMES = sorted({n for _, n in SCRIPTS})
_SCRIPT = np.array([NAMES.index(n) for _, n in SCRIPTS])


@dataclass
class Model:
    """scores: languages x buckets, log probabilities; uses: languages x scripts; prior: log share of each language."""

    langs: list[str]
    scores: np.ndarray
    uses: np.ndarray
    prior: np.ndarray


def features(found: list[str], buckets: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(bucket of each feature, first feature of each word, script of each word); no word may be empty."""
    framed = [f"\x02{w}\x03" for w in found]
    code = np.frombuffer("".join(framed).encode("utf-32-le", "surrogatepass"), dtype=np.uint32).astype(np.uint64)
    lens = np.fromiter(map(len, framed), dtype=np.int64, count=len(framed))
    starts = np.cumsum(lens) - lens
    ends = np.repeat(starts + lens, lens)
    at = np.arange(len(code))
    mult, parts, places = np.uint64(0x9E3779B97F4A7C15), [], []
    h = np.zeros(len(code), dtype=np.uint64)
    for n in range(1, 5):
        shifted = np.zeros_like(code)
        shifted[: len(code) - n + 1] = code[n - 1 :]
        h = (h + shifted + np.uint64(n)) * mult
        h ^= h >> np.uint64(29)
        ok = at + n <= ends
        parts.append(h[ok])
        places.append(at[ok])
    # the whole word, as the sum of its mixed characters and their places
    own = (code + (at - np.repeat(starts, lens)).astype(np.uint64) * np.uint64(0x100000001B3)) * mult
    own ^= own >> np.uint64(31)
    parts.append(np.add.reduceat(own * mult, starts))
    places.append(starts)
    hashed, place = np.concatenate(parts), np.concatenate(places)
    hashed = (hashed * np.uint64(0xBF58476D1CE4E5B9)) >> np.uint64(32)
    order = np.argsort(place, kind="stable")
    first = np.searchsorted(place[order], starts)
    script = _SCRIPT[np.searchsorted(_STARTS, code[starts + 1], side="right") - 1]
    return (hashed[order] & np.uint64(buckets - 1)).astype(np.int64), first, script


def held_out():
    """crc32 of the id as text, modulo 5, is 0."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("long").cast("string").cast("binary")) % 5 == 0, F.lit(False))


def fit(labelled: DataFrame, per_lang: int = DOCS_PER_LANG) -> Model:
    """Learn from the columns text and lang of labelled documents; rows without either are passed over.

    The sample is drawn by a hash of the text, `per_lang` documents of each language (expected).
    """
    rows = columns(labelled, text="string", lang="string").where("text IS NOT NULL AND lang IS NOT NULL")
    sizes = {r[0]: r[1] for r in rows.groupBy("lang").count().collect()}
    langs = sorted(sizes)
    if not langs:
        return Model([], np.zeros((0, 1), np.float32), np.zeros((0, len(NAMES)), bool), np.zeros(0))
    buckets = MOST_BUCKETS
    while buckets > 1024 and buckets * 4 * len(langs) > MODEL_BYTES:
        buckets //= 2
    shares = F.create_map(*[F.lit(x) for k in langs for x in (k, min(1.0, per_lang / sizes[k]))])
    drawn = rows.where(F.pmod(F.xxhash64("text"), F.lit(2**30)) < shares[F.col("lang")] * 2**30)
    index = {k: i for i, k in enumerate(langs)}
    width = buckets + len(NAMES)

    def count(batches):
        sums = np.zeros((len(index), width), dtype=np.int64)
        for batch in batches:
            for text, lang in zip(batch.column("text").to_pylist(), batch.column("lang").to_pylist(), strict=True):
                if found := LETTERS.findall(text.lower()):
                    bucket, _, script = features(found, buckets)
                    sums[index[lang]] += np.bincount(np.concatenate([bucket, buckets + script]), minlength=width)
        lang, at = np.nonzero(sums)
        yield pa.RecordBatch.from_pydict({"lang": pa.array(lang, pa.int32()), "at": pa.array(at, pa.int32()), "n": pa.array(sums[lang, at], pa.int64())})

    # at most languages x buckets rows, within MODEL_BYTES
    got = drawn.mapInArrow(freed(count), "lang int, at int, n long").groupBy("lang", "at").agg(F.sum("n").alias("n")).toPandas()
    sums = np.zeros((len(langs), width))
    sums[got["lang"].to_numpy(), got["at"].to_numpy()] = got["n"].to_numpy()
    grams, scripts = sums[:, :buckets] + SMOOTHING, sums[:, buckets:]
    scores = np.log(grams / grams.sum(1, keepdims=True)).astype(np.float32)
    uses = scripts >= SCRIPT_SHARE * np.maximum(scripts.sum(1, keepdims=True), 1)
    prior = np.log(np.array([sizes[k] for k in langs]) / sum(sizes.values()))
    return Model(langs, scores, uses, prior)


class Scorer:
    """Scores of words, kept from one text to the next."""

    def __init__(self, model: Model):
        self.model = model
        self.table = np.ascontiguousarray(model.scores.T)
        self.clear()

    def clear(self) -> None:
        self.ids: dict[str, int] = {}
        self.rows = np.zeros((0, len(self.model.langs)), np.float32)

    def of(self, found: list[str]) -> np.ndarray:
        ids = self.ids
        if new := [w for w in dict.fromkeys(found) if w not in ids]:
            if len(ids) + len(new) > KEPT_WORDS and ids:
                self.clear()
                return self.of(found)
            rows = np.concatenate([self._score(new[i : i + 20_000]) for i in range(0, len(new), 20_000)])
            base = len(ids)
            ids.update(zip(new, range(base, base + len(new)), strict=True))
            if len(ids) > len(self.rows):
                self.rows = np.concatenate([self.rows[:base], rows, np.zeros((max(1000, len(ids) // 2), rows.shape[1]), np.float32)])
            else:
                self.rows[base : len(ids)] = rows
        return self.rows[np.fromiter(map(ids.__getitem__, found), np.int64, len(found))]

    def _score(self, new: list[str]) -> np.ndarray:
        bucket, first, script = features(new, self.table.shape[0])
        sums = np.add.reduceat(self.table[bucket], first, axis=0)
        # languages that don't use the word's script are no candidates; where none does, all are alike
        uses = self.model.uses[:, script].T
        none = ~uses.any(1)
        sums = np.where(uses, sums / OVERLAP, -np.inf)
        sums[none] = 0
        sums = np.maximum(sums, sums.max(1, keepdims=True) - np.where(uses, LOUDEST, 4 * LOUDEST))
        return sums.astype(np.float32)


def viterbi(scores: np.ndarray, prior: np.ndarray, switch: float = SWITCH) -> np.ndarray:
    """The best language of each word: the path with the highest sum of scores less `switch` for each change.

    The step-by-step search is left out where the best single language must be the best path. A stretch in
    other languages pays a switch for each of its runs, and one more where it lies inside; so no path through
    the best language gains anything if no run gains more than a switch. A path around it altogether pays one
    switch less than it has runs, of which the first and the last lie at the ends of the text.
    """
    scores = scores.astype(np.float64)
    total = scores.sum(0) + prior
    best = int(total.argmax())
    gain = scores - scores[:, [best]]
    gain[0] += prior - prior[best]
    run = np.cumsum(gain, axis=0)
    low = np.minimum(np.minimum.accumulate(run, axis=0), 0.0)
    most = max((run[1:] - low[:-1]).max(initial=0.0), run[0].max())
    ends = run.max() + (run[-1] - np.minimum(run.min(0), 0.0)).max()
    if most <= switch and ends <= switch:
        return np.full(len(scores), best)
    # few languages: plain lists are faster than arrays of a handful of numbers
    rows = scores.tolist()
    states = [(prior + scores[0]).tolist()]
    for row in rows[1:]:
        least = max(states[-1]) - switch
        states.append([(v if v >= least else least) + x for v, x in zip(states[-1], row, strict=True)])
    at = states[-1].index(max(states[-1]))
    path = [at]
    for state in reversed(states[:-1]):
        top = max(state)
        if state[at] < top - switch:
            at = state.index(top)
        path.append(at)
    return np.array(path[::-1])


def detect(docs: DataFrame, model: Model, with_spans: bool = False, carry: tuple[str, ...] = (), with_certainty: bool = False) -> DataFrame:
    """Language of every whole text: the one with the most letters in the best path.

    `score` is its share of the letters times the certainty over the second language in the words that the path
    gives to it, so other languages in a text lower the share alone. A null text, or one
    without a letter, is `und` with score 0, as is every text where no language was learned. With
    `with_spans` a column `spans` lists (start, end, lang) in characters, with `with_certainty` a column
    `certainty` has the second factor. Null ids and repeated rows are
    judged like others, an empty table gives no rows; of other columns those in `carry` come along unseen.
    """
    kinds_of = {f.name: f.dataType.simpleString() for f in docs.schema if f.name in carry}
    shared = docs.sparkSession.sparkContext.broadcast(model)
    fields = [("doc_id", pa.int64()), ("lang_pred", pa.string()), ("score", pa.float64())]
    ddl = "doc_id long, lang_pred string, score double"
    if with_spans:
        fields.append(("spans", pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("lang", pa.string())]))))
        ddl += ", spans array<struct<start:int,end:int,lang:string>>"
    if with_certainty:
        fields.append(("certainty", pa.float64()))
        ddl += ", certainty double"
    schema = pa.schema(fields)
    ddl += "".join(f", `{c}` {kind}" for c, kind in kinds_of.items())

    def judge(batches):
        model = shared.value
        scorer = Scorer(model)

        def one(text):
            hits = [] if not text or not model.langs else list(LETTERS.finditer(text)) if with_spans else LETTERS.findall(text.lower())
            if not hits:
                return "und", 0.0, [], 0.0
            found = [h[0].lower() for h in hits] if with_spans else hits
            scores = scorer.of(found)
            path = viterbi(scores, model.prior)
            letters = np.bincount(path, np.fromiter(map(len, found), np.int64, len(found)), minlength=len(model.langs))
            best = int(letters.argmax())
            own = path == best
            total = scores[own].sum(0, dtype=np.float64)
            if own[0]:
                total += model.prior
            others = np.delete(total, best)
            margin = float(total[best] - others.max()) if len(others) else 50.0
            spans = []
            if with_spans:
                edges = [0, *(np.nonzero(np.diff(path))[0] + 1), len(path)]
                spans = [{"start": hits[a].start(), "end": hits[b - 1].end(), "lang": model.langs[path[a]]} for a, b in zip(edges, edges[1:], strict=False)]
            doubt = 1 + math.exp(-max(-50.0, min(50.0, margin)))
            return model.langs[best], float(letters[best] / letters.sum()) / doubt, spans, 1 / doubt

        for batch in slices(batches):
            got = [one(x) for x in batch.column("text").to_pylist()]
            cols = [batch.column("doc_id"), pa.array([g[0] for g in got], pa.string()), pa.array([g[1] for g in got], pa.float64())]
            if with_spans:
                cols.append(pa.array([g[2] for g in got], schema.field("spans").type))
            if with_certainty:
                cols.append(pa.array([g[3] for g in got], pa.float64()))
            yield pa.RecordBatch.from_arrays([*cols, *(batch.column(c) for c in kinds_of)], names=[*schema.names, *kinds_of])

    return columns(docs, **({"doc_id": "long", "text": "string"} | kinds_of)).mapInArrow(freed(judge), ddl)


def op3_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    known = F.crc32(F.col("doc_id").cast("long").cast("string").cast("binary")) % 5 != 0
    found = detect(docs, fit(docs.where(known)))
    return found.select("doc_id", held_out().alias("held_out"), "lang_pred", "score")
