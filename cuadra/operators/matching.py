"""Two-phase one-to-one matching.

Phase 1 joins on the normalized reference. With unique expected ids it needs no loop: where several
expected rows share a reference nothing is ever consumed; where one has it, the transaction with the
smallest id and an equal amount takes it, and those before it see a different amount.

Phase 2 looks for expected rows of equal amount with a bound on the days between. All transactions of an amount and
day see the same expected rows, and what is left of these only shrinks. So a day takes at most one: with two
or more left its transactions are ambiguous, the first that finds one left takes it, and those after it find none.
An expected row that shares its day with another is never taken, for no window holds it alone. That leaves one row for
each amount and day to decide, however many transactions it has. Where no day's count can fall to one, the smallest
first transaction of the days around an expected row takes it. Islands (days within the window of the next) with a
day that may fall to one go through their takes in order of id; when such a day has many transactions, the
one that comes next is asked for by a join, and the islands that asked go another round.

Candidates are never listed by transaction: those of a reference, or of a day after so many takes, are a set with
a name, kept once and joined where they are reported.

Expected ids that occur twice tie rows of different references and amounts together. Rows that can influence one
another then form components of shared ids, references and islands; those that hold such an id are walked
through in order, each on its own.
"""

from __future__ import annotations

import heapq
from bisect import bisect_left, bisect_right

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..config import Config
from ..storage import cut
from .graph import components

#: Transactions of an amount and day up to which an island holds their ids; those of larger days are asked for.
LISTED = 64
#: Ids of expected rows that a list of one amount and day holds at most.
HELD = 4096
#: Partitions of rows that list candidates, for each of a shuffle's.
SPREAD = 4


def flat_bank(bank: DataFrame, *more: str) -> DataFrame:
    """The columns that matching reads, after those of `more`."""
    return bank.select(
        *more,
        F.col("id").alias("tx_id"),
        F.col("fecha_operacion.valor").alias("tx_fecha"),
        F.col("monto.valor").alias("tx_monto"),
        F.coalesce(F.col("monto_texto"), F.col("monto.valor").cast("string")).alias("tx_monto_texto"),
        F.col("referencia.valor").alias("tx_ref"),
        F.struct(
            "bloquea_autoconcilia",
            "motivo_bloqueo_autoconcilia",
            F.col("fecha_operacion.confianza.score").alias("fecha"),
            F.col("monto.confianza.score").alias("monto"),
            F.col("descripcion.confianza.score").alias("descripcion"),
            F.col("referencia.confianza.score").alias("referencia"),
        ).alias("tx_conf"),
    )


def flat_expected(expected: DataFrame, *more: str) -> DataFrame:
    return expected.select(
        *more,
        F.col("id").alias("exp_id"),
        F.col("fecha.valor").alias("exp_fecha"),
        F.col("monto.valor").alias("exp_monto"),
        F.coalesce(F.col("monto_texto"), F.col("monto.valor").cast("string")).alias("exp_monto_texto"),
        F.col("referencia.valor").alias("exp_ref"),
        F.struct(
            F.col("fecha.confianza.score").alias("fecha"),
            F.col("monto.confianza.score").alias("monto"),
            F.col("descripcion.confianza.score").alias("descripcion"),
            F.col("referencia.confianza.score").alias("referencia"),
        ).alias("exp_conf"),
    )


def blocking_reason(cfg: Config | Column, tx: str = "tx_conf", exp: str = "exp_conf") -> Column:
    """Why a pair may not settle by itself: the first check that fails, or null. cfg: or the least confidence of fields."""
    least = F.lit(float(cfg.umbral_confianza_campos)) if isinstance(cfg, Config) else cfg
    checks = [F.when(F.col(f"{tx}.bloquea_autoconcilia"), F.coalesce(F.nullif(F.col(f"{tx}.motivo_bloqueo_autoconcilia"), F.lit("")), F.lit("Bloqueado por politica de confianza.")))]
    for name, text in (("fecha", "fecha_operacion"), ("monto", "monto"), ("descripcion", "descripcion"), ("referencia", "referencia")):
        checks.append(F.when(F.col(f"{tx}.{name}") < least, F.lit(f"Confianza insuficiente en {text} (banco).")))
    for name in ("fecha", "monto", "descripcion", "referencia"):
        checks.append(F.when(F.col(f"{exp}.{name}") < least, F.lit(f"Confianza insuficiente en {name} (esperado).")))
    return F.coalesce(*checks)


def by_reference(tx: DataFrame, exp: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Phase 1 outcome of each transaction with a reference that some expected row has, and candidate sets.

    outcome: match, monto_difiere or ambigua; ambiguous ones name their set in `conjunto`. Expected ids are unique.
    """
    held, asked = exp.where(F.coalesce("exp_ref", F.lit("")) != ""), tx.where(F.coalesce("tx_ref", F.lit("")) != "")
    by = held.groupBy("exp_ref").agg(F.count("*").alias("n"), F.min(F.struct("exp_id", "exp_monto", "exp_monto_texto", "exp_conf")).alias("exp"))
    # the smallest transaction of each reference and amount, combined before any shuffle
    firsts = asked.groupBy(F.col("tx_ref").alias("w_ref"), F.col("tx_monto").alias("w_monto")).agg(F.min("tx_id").alias("winner"))
    # written, so that Spark can split a frequent reference in the join with all transactions
    by = cut(by.join(firsts, (F.col("n") == 1) & (F.col("exp_ref") == F.col("w_ref")) & (F.col("exp.exp_monto") == F.col("w_monto")), "left").drop("w_ref", "w_monto"))
    outcome = (
        F.when(F.col("n") > 1, F.lit("ambigua"))
        .when(F.col("tx_id") == F.col("winner"), F.lit("match"))
        .when(F.col("winner").isNull() | (F.col("tx_id") < F.col("winner")), F.lit("monto_difiere"))
    )
    judged = asked.join(by, F.col("tx_ref") == F.col("exp_ref")).select("*", outcome.alias("outcome")).where(F.col("outcome").isNotNull())
    judged = judged.withColumn("conjunto", F.when(F.col("outcome") == "ambigua", F.concat(F.lit("R|"), F.col("tx_ref"))))
    shared = by.where("n > 1").select(F.col("exp_ref").alias("s_ref"))
    used = firsts.select(F.col("w_ref").alias("u_ref")).distinct()
    sets = held.join(shared, F.col("exp_ref") == F.col("s_ref"), "left_semi").join(used, F.col("exp_ref") == F.col("u_ref"), "left_semi")
    sets = sets.groupBy(F.concat(F.lit("R|"), F.col("exp_ref")).alias("conjunto")).agg(F.sort_array(F.collect_list("exp_id")).alias("candidatos"))
    return judged.select("tx_id", "tx_ref", "tx_monto_texto", "tx_conf", "outcome", "conjunto", "exp"), sets


def by_set(vague: DataFrame, spread: int = SPREAD) -> DataFrame:
    """Ambiguous outcomes dealt by their sets to many partitions that aren't put together again (a join after it keeps as
    many as a shuffle has).

    What is written from one of these repeats few different lists, and Parquet keeps each once.
    """
    return vague.repartition(spread * int(vague.sparkSession.conf.get("spark.sql.shuffle.partitions")), "conjunto")


def listed(found: DataFrame, sets: DataFrame) -> DataFrame:
    """Outcomes with the candidates themselves, in whatever form `sets` has them, in place of `conjunto`."""
    return found.join(sets.withColumnRenamed("conjunto", "c_"), F.col("conjunto") == F.col("c_"), "left").drop("conjunto", "c_")


def date_islands(tx: DataFrame, exp: DataFrame, window: int) -> DataFrame:
    """(monto, fecha, isla): days of an amount, a new island where the gap to the day before exceeds the window."""
    days = tx.select(F.col("tx_monto").alias("monto"), F.col("tx_fecha").alias("fecha")).union(exp.select("exp_monto", "exp_fecha")).distinct()
    order = Window.partitionBy("monto").orderBy("fecha")
    fresh = F.coalesce(F.datediff("fecha", F.lag("fecha").over(order)) > window, F.lit(True))
    return days.select("monto", "fecha", F.sum(fresh.cast("int")).over(order).alias("isla"))


def band_candidates(tx: DataFrame, exp: DataFrame, window: int, most: int = HELD) -> DataFrame:
    """Pairs of equal amount whose dates lie within the window: the columns of `tx`, exp_id, exp_monto, exp_fecha, delta.

    Days are cut into spans of the window's width, so what lies within it is in the same span or the next to
    either side: an equi-join on amount and span, however many dates an amount has. Expected rows of an amount and day
    are joined as one list, or several of at most `most` ids, so a transaction meets days and not their rows; lists are
    opened once they have met.
    """
    width = max(1, window)
    span = lambda day: F.floor(F.datediff(day, F.lit("1970-01-01")) / width)
    left = tx.withColumn("tx_span", span("tx_fecha"))
    place = F.row_number().over(Window.partitionBy("exp_monto", "exp_fecha").orderBy("exp_id"))
    known = exp.where("exp_monto IS NOT NULL AND exp_fecha IS NOT NULL").select("exp_id", "exp_monto", "exp_fecha", F.floor((place - 1) / most).alias("parte"))
    days = known.groupBy("exp_monto", "exp_fecha", "parte").agg(F.collect_list("exp_id").alias("exp_ids"))
    right = days.withColumn("exp_span", F.explode(F.transform(F.array(F.lit(-1), F.lit(0), F.lit(1)), lambda i: span("exp_fecha") + i)))
    close = F.abs(F.datediff("tx_fecha", "exp_fecha"))
    met = left.join(right, (F.col("tx_monto") == F.col("exp_monto")) & (F.col("tx_span") == F.col("exp_span")) & (close <= window))
    return met.select(*tx.columns, "exp_monto", "exp_fecha", close.alias("delta"), F.explode("exp_ids").alias("exp_id"))


def with_islands(rows: DataFrame, islands: DataFrame) -> DataFrame:
    """Add `isla` to rows (monto, fecha, ...)."""
    i = islands.withColumnsRenamed({"monto": "i_monto", "fecha": "i_fecha"})
    return rows.join(i, (F.col("monto") == F.col("i_monto")) & (F.col("fecha") == F.col("i_fecha"))).drop("i_monto", "i_fecha")


def by_day(tx: DataFrame, exp: DataFrame, window: int) -> DataFrame:
    """One row for each amount and day with what lies within the window of it.

    n_tx, primera: transactions and the smallest of them; n_exp, unico: expected rows and the smallest of them; cerca:
    expected rows within the window, x_dia and x_id one of them; fijo: some of these share a day; isla, abierta: its
    island and whether that has a day whose count may fall to one. An amount has at most one row a day.
    """
    epoch = F.lit("1970-01-01")
    left = tx.where("tx_monto IS NOT NULL AND tx_fecha IS NOT NULL").select(F.col("tx_monto").alias("monto"), F.datediff("tx_fecha", epoch).alias("dia"), F.col("tx_id").alias("t"), F.lit(None).cast("string").alias("e"))
    right = exp.where("exp_monto IS NOT NULL AND exp_fecha IS NOT NULL").select(F.col("exp_monto").alias("monto"), F.datediff("exp_fecha", epoch).alias("dia"), F.lit(None).cast("string").alias("t"), F.col("exp_id").alias("e"))
    days = left.union(right).groupBy("monto", "dia").agg(F.count("t").alias("n_tx"), F.min("t").alias("primera"), F.count("e").alias("n_exp"), F.min("e").alias("unico"))
    order = Window.partitionBy("monto").orderBy("dia")
    near, island = order.rangeBetween(-window, window), Window.partitionBy("monto", "isla")
    fresh = F.coalesce(F.col("dia") - F.lag("dia").over(order) > window, F.lit(True))
    x = F.min(F.when(F.col("n_exp") > 0, F.struct("dia", "unico"))).over(near)
    days = days.select("*", F.sum("n_exp").over(near).alias("cerca"), (F.max("n_exp").over(near) > 1).alias("fijo"), x["dia"].alias("x_dia"), x["unico"].alias("x_id"), fresh.alias("nueva"))
    days = days.withColumn("isla", F.sum(F.col("nueva").cast("int")).over(order)).drop("nueva")
    days = days.withColumn("puede", (F.col("n_tx") > 0) & (F.col("cerca") > 1) & ~F.col("fijo"))
    return days.withColumn("abierta", F.max("puede").over(island))


def _takes_of_island(window: int):
    """Takes of an island in order of id, or the first unknown transaction that they depend on."""

    def walk(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("dia")
        monto, isla = rows["monto"].iat[0], rows["isla"].iat[0]
        held = rows[rows["n_exp"] > 0]
        free = dict(zip(held["dia"].tolist(), held["unico"], strict=True))
        txs = rows[(rows["n_tx"] > 0) & (rows["cerca"] > 0)]
        days, left, fixed = txs["dia"].tolist(), txs["cerca"].tolist(), txs["fijo"].tolist()
        # a day with one expected row in reach starts with its first transaction
        queue = [(first, k) for k, (first, n) in enumerate(zip(txs["primera"], left, strict=True)) if n == 1]
        heapq.heapify(queue)
        names = ["monto", "isla", "x_dia", "exp_id", "tx_id", "tx_dia", "pide"]
        takes: list[tuple] = []
        while queue:
            now, k = heapq.heappop(queue)
            if left[k] != 1:
                continue
            x = next(d for d in range(days[k] - window, days[k] + window + 1) if d in free)
            takes.append((monto, isla, x, free.pop(x), now, days[k], False))
            for j in range(bisect_left(days, x - window), bisect_right(days, x + window)):
                left[j] -= 1
                if left[j] != 1 or fixed[j]:
                    continue
                row = txs.iloc[j]
                if row["desde"] == now:
                    after = row["sigue"]
                elif row["n_tx"] == 1:
                    after = row["primera"] if row["primera"] > now else None
                elif row["ids"] is not None:
                    at = bisect_right(row["ids"], now)
                    after = row["ids"][at] if at < len(row["ids"]) else None
                else:
                    return pd.DataFrame([(monto, isla, None, None, now, days[j], True)], columns=names).astype({"x_dia": "Int32"})
                if after is not None:
                    heapq.heappush(queue, (after, j))
        return pd.DataFrame(takes, columns=names).astype({"x_dia": "Int32"})

    return walk


def takes(tx: DataFrame, days: DataFrame, window: int, most: int = LISTED) -> tuple[DataFrame, int]:
    """(monto, x_dia, exp_id, tx_id, tx_dia) of every take by amount, and the rounds that open islands needed.

    days: the written result of `by_day`. An island is given one row a day, never its transactions.
    """
    kept = ["monto", "x_dia", "exp_id", "tx_id", "tx_dia"]
    alone = days.where("NOT abierta AND n_tx > 0 AND cerca = 1").groupBy("monto", "x_dia").agg(F.min(F.struct("primera", "dia", "x_id")).alias("f"))
    out = alone.select("monto", "x_dia", F.col("f.x_id").alias("exp_id"), F.col("f.primera").alias("tx_id"), F.col("f.dia").alias("tx_dia"))
    open_ = days.where("abierta AND (n_exp > 0 OR cerca > 0)")
    told = tx.select(F.col("tx_monto").alias("monto"), F.datediff("tx_fecha", F.lit("1970-01-01")).alias("dia"), "tx_id")
    some = open_.where((F.col("n_tx") > 1) & (F.col("n_tx") <= most) & F.col("puede")).select("monto", "dia")
    ids = told.join(some, ["monto", "dia"], "left_semi").groupBy("monto", "dia").agg(F.sort_array(F.collect_list("tx_id")).alias("ids"))
    base = cut(open_.select("monto", "isla", "dia", "n_tx", "primera", "n_exp", "unico", "cerca", "fijo").join(ids, ["monto", "dia"], "left"))
    none = F.lit(None).cast("string")
    rows, answers, rounds = base.select("*", none.alias("desde"), none.alias("sigue")), None, 0
    ddl = f"monto {dict(days.dtypes)['monto']}, isla long, x_dia int, exp_id string, tx_id string, tx_dia int, pide boolean"
    while True:
        rounds += 1
        walked = cut(rows.groupBy("monto", "isla").applyInPandas(_takes_of_island(window), ddl))
        out = out.unionByName(walked.where("NOT pide").select(kept))
        asked = walked.where("pide").select("monto", "isla", F.col("tx_dia").alias("dia"), F.col("tx_id").alias("desde"))
        if asked.isEmpty():
            return out, rounds
        # the next transaction of each day that was asked for, null where there is none; a day is asked for once
        next_ = told.join(asked, ["monto", "dia"]).where(F.col("tx_id") > F.col("desde")).groupBy("monto", "dia").agg(F.min("tx_id").alias("sigue"))
        new = asked.drop("isla").join(next_, ["monto", "dia"], "left")
        answers = cut(new if answers is None else answers.unionByName(new))
        # from the first rows each time: sizes that Spark guesses for joins of joins would grow without bound
        rows = base.join(asked.select("monto", "isla"), ["monto", "isla"], "left_semi").join(answers, ["monto", "dia"], "left")


def by_amount(tx: DataFrame, exp: DataFrame, window: int, most: int = LISTED) -> tuple[DataFrame, DataFrame]:
    """Phase 2 outcome of each transaction with a candidate, and candidate sets.

    Adds to the columns of `tx`: outcome (match or ambigua), conjunto, exp_id, delta. Ids of both sides are unique.
    """
    days = cut(by_day(tx, exp, window))
    taken, _ = takes(tx, days, window, most)
    taken = taken.select(F.col("monto").alias("k_monto"), F.col("x_dia").alias("k_dia"), F.struct("tx_id", "exp_id", "x_dia").alias("toma"))
    near = Window.partitionBy("monto").orderBy("dia").rangeBetween(-window, window)
    seen = days.select("monto", "dia", "n_tx", "cerca").join(taken, (F.col("monto") == F.col("k_monto")) & (F.col("dia") == F.col("k_dia")), "left")
    # what is taken around a day, in order: at most one a day
    seen = seen.withColumn("tomas", F.sort_array(F.collect_list("toma").over(near))).where("n_tx > 0 AND cerca > 0")
    seen = cut(seen.select("monto", "dia", "cerca", "tomas"))
    day = F.datediff("tx_fecha", F.lit("1970-01-01"))
    both = tx.join(seen, (F.col("tx_monto") == F.col("monto")) & (day == F.col("dia")))
    own = F.get(F.filter("tomas", lambda t: t["tx_id"] == F.col("tx_id")), F.lit(0))
    before = F.size(F.filter("tomas", lambda t: t["tx_id"] < F.col("tx_id")))
    both = both.select("*", own.alias("propia"), before.alias("antes"))
    outcome = F.when(F.col("propia").isNotNull(), F.lit("match")).when(F.col("cerca") - F.col("antes") > 1, F.lit("ambigua"))
    name = F.concat_ws("|", F.lit("D"), F.col("monto").cast("string"), F.col("dia").cast("string"), F.col("antes").cast("string"))
    judged = both.withColumn("outcome", outcome).where("outcome IS NOT NULL")
    judged = judged.withColumns({"conjunto": F.when(F.col("outcome") == "ambigua", name), "exp_id": F.col("propia.exp_id"), "delta": F.abs(F.col("propia.x_dia") - F.col("dia"))})
    asked = judged.where("outcome = 'ambigua'").select("conjunto", "monto", "dia", "antes").distinct()
    asked = asked.join(seen.select("monto", "dia", "tomas"), ["monto", "dia"])
    asked = asked.select("conjunto", F.col("monto").alias("tx_monto"), F.date_add(F.lit("1970-01-01").cast("date"), F.col("dia")).alias("tx_fecha"), F.transform(F.slice("tomas", F.lit(1), F.col("antes")), lambda t: t["exp_id"]).alias("idos"))
    pairs = band_candidates(asked, exp.select("exp_id", "exp_monto", "exp_fecha"), window).where(~F.array_contains("idos", F.col("exp_id")))
    sets = pairs.groupBy("conjunto").agg(F.sort_array(F.collect_list("exp_id")).alias("candidatos"))
    return judged.select(*tx.columns, "outcome", "conjunto", "exp_id", "delta"), sets


def repeated_ids(expected: DataFrame) -> DataFrame:
    return expected.groupBy("exp_id").count().where("count > 1")


def tied(tx: DataFrame, exp: DataFrame, window: int) -> tuple[DataFrame, DataFrame]:
    """(tx_id, grupo) and (exp_id, grupo) of the rows whose component of shared ids, references and islands holds a
    repeated expected id."""
    key = lambda kind, *c: F.xxhash64(F.lit(kind), *c)
    islands = cut(date_islands(tx, exp, window))
    sides = []
    for frame, side in ((tx, "tx"), (exp, "exp")):
        rows = frame.select(key(side, F.col(f"{side}_id")).alias("a"), F.col(f"{side}_ref").alias("ref"), F.col(f"{side}_monto").alias("monto"), F.col(f"{side}_fecha").alias("fecha"))
        sides.append(rows.where("coalesce(ref, '') <> ''").select("a", key("ref", F.col("ref")).alias("b")))
        sides.append(with_islands(rows, islands).select("a", key("isla", F.col("monto"), F.col("isla")).alias("b")))
    edges = sides[0].union(sides[1]).union(sides[2]).union(sides[3])
    roots = components(edges)
    twice = repeated_ids(exp).select(key("exp", F.col("exp_id")).alias("n"))
    hit = cut(roots.join(twice, F.col("node") == F.col("n")).select(F.col("root").alias("hit")).distinct())
    within = cut(roots.join(hit, F.col("root") == F.col("hit"), "left_semi"))
    out = []
    for frame, side in ((tx, "tx"), (exp, "exp")):
        ids = frame.select(f"{side}_id").distinct()
        out.append(cut(ids.join(within, key(side, F.col(f"{side}_id")) == F.col("node")).select(f"{side}_id", F.col("root").alias("grupo"))))
    return out[0], out[1]


def in_order(tx: DataFrame, exp: DataFrame, window: int) -> DataFrame:
    """Both phases for expected rows that share ids, by one exact pass in order over each `grupo` (see `tied`).

    Returns (tx_id, fase, outcome, candidatos, exp_id, exp_monto_texto, exp_conf, delta).
    """
    left = tx.select("grupo", "tx_id", F.to_json(F.struct("tx_ref", F.col("tx_monto").cast("string").alias("m"), F.datediff("tx_fecha", F.lit("1970-01-01")).alias("d"))).alias("body"))
    conf = F.to_json(F.struct("exp_ref", F.col("exp_monto").cast("string").alias("m"), F.datediff("exp_fecha", F.lit("1970-01-01")).alias("d"), F.col("exp_monto_texto").alias("t"), F.to_json("exp_conf").alias("c")))
    right = exp.select("grupo", "exp_id", conf.alias("body"))
    out = "tx_id string, fase int, outcome string, candidatos array<string>, exp_id string, exp_monto_texto string, exp_conf string, delta int"

    def walk(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        import json

        txs = sorted((i, json.loads(x)) for i, x in zip(a["tx_id"], a["body"], strict=True))
        exps = [(i, json.loads(x)) for i, x in sorted(zip(b["exp_id"], b["body"], strict=True))]
        by_ref: dict = {}
        by_amount_: dict = {}
        for i, e in exps:
            if e.get("exp_ref"):
                by_ref.setdefault(e["exp_ref"], []).append((i, e))
            by_amount_.setdefault(e["m"], []).append((i, e))
        used, done, rows = set(), set(), []
        for i, t in txs:
            cands = [c for c in by_ref.get(t.get("tx_ref") or None, []) if c[0] not in used]
            if len(cands) > 1:
                rows.append((i, 1, "ambigua", [c[0] for c in cands], None, None, None, None))
            elif cands:
                e_id, e = cands[0]
                kind = "match" if e["m"] == t["m"] else "monto_difiere"
                rows.append((i, 1, kind, [e_id], e_id, e["t"], e["c"], None))
                if kind == "match":
                    used.add(e_id)
                    done.add(i)
        for i, t in txs:
            if i in done:
                continue
            cands = [c for c in by_amount_.get(t["m"], []) if c[0] not in used and abs(c[1]["d"] - t["d"]) <= window]
            if len(cands) > 1:
                rows.append((i, 2, "ambigua", [c[0] for c in cands], None, None, None, None))
            elif cands:
                e_id, e = cands[0]
                rows.append((i, 2, "match", [e_id], e_id, e["t"], e["c"], abs(e["d"] - t["d"])))
                used.add(e_id)
        return pd.DataFrame(rows, columns=[c.split()[0] for c in out.split(", ")]).astype({"delta": "Int32", "fase": "int32"})

    return left.groupBy("grupo").cogroup(right.groupBy("grupo")).applyInPandas(walk, out)
