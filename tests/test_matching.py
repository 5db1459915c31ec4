"""Both phases against a sequential model, written for the test."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from cuadra.config import Config
from cuadra.operators import matching, model
from cuadra.operators import reconcile as rec

DAY = dt.date(2026, 1, 1)


def frames(spark, txs, exps, score=0.9, blocked=()):
    def field(value, kind):
        return F.when(F.col(value).isNotNull(), F.struct(F.col(value).cast(kind).alias("valor"), F.struct(F.lit(score).alias("score"), F.lit("alta").alias("nivel"), F.lit("csv").alias("origen"), F.lit(None).cast("string").alias("notas")).alias("confianza")))

    t = spark.createDataFrame([(i, r, m, DAY + dt.timedelta(days=d)) for i, r, m, d in txs], "id string, ref string, m long, d date")
    e = spark.createDataFrame([(i, r, m, DAY + dt.timedelta(days=d)) for i, r, m, d in exps], "id string, ref string, m long, d date")
    b = F.col("id").isin(*blocked) if blocked else F.lit(False)
    bank = t.select("id", F.lit(None).alias("cuenta_mask"), F.lit(None).alias("banco"), b.alias("bloquea_autoconcilia"), F.when(b, F.lit("motivo")).alias("motivo_bloqueo_autoconcilia"), field("d", "date").alias("fecha_operacion"), F.lit(None).alias("fecha_contable"), field("m", "decimal(38,0)").alias("monto"), F.col("m").cast("string").alias("monto_texto"), F.lit("CLP").alias("moneda"), F.struct(F.lit("x").alias("valor"), model.confidence("csv").alias("confianza")).alias("descripcion"), field("ref", "string").alias("referencia"), F.lit("f").alias("archivo_origen"), F.lit("csv").alias("origen"), F.lit(1).alias("fila_origen"))
    exp = e.select("id", field("d", "date").alias("fecha"), field("m", "decimal(38,0)").alias("monto"), F.col("m").cast("string").alias("monto_texto"), F.lit("CLP").alias("moneda"), F.struct(F.lit("x").alias("valor"), model.confidence("csv").alias("confianza")).alias("descripcion"), field("ref", "string").alias("referencia"), F.lit(None).alias("tercero"))
    return model.plain(bank, model.BANK), model.plain(exp, model.EXPECTED)


def sequential(txs, exps, window):
    used_t, used_e, out = set(), set(), []
    for i, r, m, _ in sorted(txs):
        cands = [e for e in sorted(exps, key=lambda e: e[0]) if r and e[1] == r and e[0] not in used_e]
        if len(cands) > 1:
            out.append((i, 1, "ambigua", [c[0] for c in cands]))
        elif cands and cands[0][2] != m:
            out.append((i, 1, "monto_difiere", [cands[0][0]]))
        elif cands:
            out.append((i, 1, "match", [cands[0][0]]))
            used_t.add(i)
            used_e.add(cands[0][0])
    for i, _, m, d in sorted(txs):
        if i in used_t:
            continue
        cands = [e for e in sorted(exps, key=lambda e: e[0]) if e[0] not in used_e and e[2] == m and abs(e[3] - d) <= window]
        if len(cands) > 1:
            out.append((i, 2, "ambigua", [c[0] for c in cands]))
        elif cands:
            out.append((i, 2, "match", [cands[0][0]]))
            used_e.add(cands[0][0])
    return sorted(out)


def random_case(seed, repeated=False):
    rng = random.Random(seed)
    refs = [None, "A", "B", "C", "D", "E", "F"]
    txs = [(f"T{rng.randint(0, 10**6):07d}-{k}", rng.choice(refs), rng.randint(1, 4), rng.randint(0, 25)) for k in range(40)]
    exps = [(f"E{k % 25 if repeated else k:03d}", rng.choice(refs + list("GHIJKL")), rng.randint(1, 4), rng.randint(0, 25)) for k in range(30)]
    return txs, exps


@pytest.mark.parametrize(("seed", "repeated"), [(1, False), (2, False), (3, True)])
def test_outcomes_equal_the_sequential_model(spark, seed, repeated):
    txs, exps = random_case(seed, repeated)
    bank, expected = frames(spark, txs, exps)
    got = sorted((r["tx_id"], r["fase"], r["outcome"], [r["exp_id"]] if r["outcome"] != "ambigua" else r["candidatos"]) for r in rec.outcomes(bank, expected, Config("c")).collect())
    assert got == sequential(txs, exps, 3)


def test_repeated_ids_tie_only_what_they_reach(spark):
    # three worlds that share no reference, amount or id; ids are repeated in one
    txs, exps = [], []
    for w, repeated in enumerate((True, False, False)):
        t, e = random_case(10 + w, repeated)
        txs += [(f"{w}{i}", r and f"{w}{r}", m + 100 * w, d) for i, r, m, d in t]
        exps += [(f"{w}{i}", r and f"{w}{r}", m + 100 * w, d) for i, r, m, d in e]
    bank, expected = frames(spark, txs, exps)
    got = sorted((r["tx_id"], r["fase"], r["outcome"], [r["exp_id"]] if r["outcome"] != "ambigua" else r["candidatos"]) for r in rec.outcomes(bank, expected, Config("c")).collect())
    assert got == sequential(txs, exps, 3)
    in_tx, in_exp = matching.tied(matching.flat_bank(bank), matching.flat_expected(expected), 3)
    assert {r["tx_id"][0] for r in in_tx.collect()} == {r["exp_id"][0] for r in in_exp.collect()} == {"0"}


def test_events_are_numbered_over_partitions(spark):
    rows = [(k % 3, f"{(k * 7919) % 1000:04d}", "t", str(k), "{}") for k in range(1000)]
    events = spark.createDataFrame(rows, "orden int, clave string, tipo string, mensaje string, detalles string").repartition(7)
    got = rec.numbered(events, 5).orderBy("seq").collect()
    assert [r["seq"] for r in got] == list(range(5, 1005))
    assert [r["mensaje"] for r in got] == [r[3] for r in sorted(rows)]


def hot_case(seed, amounts, days, n_tx, n_exp):
    """Frequent amounts on consecutive days: mostly single expected rows, so that takes set off others."""
    rng = random.Random(seed)
    txs = [(f"T{rng.randint(0, 10**6):07d}-{k}", None, rng.randint(1, amounts), rng.randint(0, days)) for k in range(n_tx)]
    exps = [(f"E{k:04d}", None, rng.randint(1, amounts), rng.randint(0, days)) for k in range(n_exp)]
    return txs, exps


@pytest.mark.parametrize(("case", "most"), [((1, 2, 60, 120, 60), 64), ((2, 1, 80, 500, 40), 1), ((3, 3, 40, 300, 12), 1), ((4, 1, 30, 400, 60), 0), ((5, 2, 120, 500, 120), 2)])
def test_hot_islands_equal_the_sequential_fold(spark, case, most):
    txs, exps = hot_case(*case)
    bank, expected = frames(spark, txs, exps)
    found, sets = matching.by_amount(matching.flat_bank(bank), matching.flat_expected(expected), 3, most)
    got = sorted((r["tx_id"], 2, r["outcome"], [r["exp_id"]] if r["outcome"] == "match" else r["candidatos"]) for r in matching.listed(found, sets).collect())
    assert got == sequential(txs, exps, 3)


def test_rounds_and_rows_of_islands(spark):
    # expected rows three days apart: each take leaves the next days one row, in turn
    txs = [(f"T{k:05d}", None, 7, 2 * (k % 40)) for k in range(2000)]
    exps = [(f"E{k:03d}", None, 7, 4 * k) for k in range(20)]
    bank, expected = frames(spark, txs, exps)
    tx, exp = matching.flat_bank(bank), matching.flat_expected(expected)
    days = matching.cut(matching.by_day(tx, exp, 3))
    assert days.count() == 40 and days.where("abierta").count() == 40
    few, one = matching.takes(tx, days, 3)
    many, rounds = matching.takes(tx, days, 3, most=0)
    assert sorted(map(tuple, few.collect())) == sorted(map(tuple, many.collect()))
    # a day is asked for once at most
    assert one == 1 and 1 < rounds <= 41


def test_a_frequent_reference_keeps_its_candidates_once(spark):
    txs = [(f"T{k:04d}", "SIN-REF", 1 + k % 5, k % 9) for k in range(300)]
    exps = [(f"E{k:04d}", "SIN-REF", 1 + k % 7, k % 9) for k in range(200)]
    bank, expected = frames(spark, txs, exps)
    found, sets = matching.by_reference(matching.flat_bank(bank), matching.flat_expected(expected))
    assert found.count() == 300 and "candidatos" not in found.columns
    assert [(r["conjunto"], len(r["candidatos"])) for r in sets.collect()] == [("R|SIN-REF", 200)]
    got = sorted((r["tx_id"], r["fase"], r["outcome"], [r["exp_id"]] if r["outcome"] != "ambigua" else r["candidatos"]) for r in rec.outcomes(bank, expected, Config("c")).collect())
    assert got == sequential(txs, exps, 3)


def test_states_findings_and_audit(spark):
    txs = [("T1", "A", 10, 0), ("T2", None, 20, 1), ("T3", None, 30, 2), ("T4", "X", 99, 0), ("T5", "B", 40, 0)]
    exps = [("E1", "A", 10, 9), ("E2", None, 20, 1), ("E3", None, 30, 0), ("E4", "B", 41, 0)]
    result = rec.reconcile(*frames(spark, txs, exps), Config("c"), "run")
    got = {r["transacciones_bancarias"][0]: (r["regla"], r["score"], r["estado"]) for r in result.matches.collect()}
    assert got == {"T1": ("ref_exacta", 1.0, "conciliado"), "T2": ("monto_fecha", 0.9, "conciliado"), "T3": ("monto_fecha", 0.8, "sugerido")}
    kinds = sorted((r["tipo"], r["entidad_id"]) for r in result.findings.collect())
    assert kinds == sorted([("tx_con_match", t) for t in ("T1", "T2", "T3")] + [("pendiente_banco", "T4"), ("pendiente_banco", "T5"), ("pendiente_esperado", "E4"), ("referencia_coincide_monto_difiere", "T5")])
    audit = rec.numbered(result.audit).orderBy("seq").collect()
    assert [r["seq"] for r in audit] == list(range(len(audit)))
    assert [r["tipo"] for r in audit] == ["match", "hallazgo", "match", "match", "hallazgo", "hallazgo", "hallazgo", "matching"]
    assert rec.invariant_violations(result.matches).count() == 0


def test_low_confidence_and_blocks(spark):
    pair = [("T1", "A", 10, 0)], [("E1", "A", 10, 0)]
    low = rec.reconcile(*frames(spark, *pair, score=0.6), Config("c"), "run").matches.first()
    assert (low["estado"], low["bloqueado_por_confianza"]) == ("pendiente", True)
    assert low["explicacion"].endswith("BLOQUEADO: Confianza insuficiente en fecha_operacion (banco).")
    blocked = rec.reconcile(*frames(spark, *pair, blocked=["T1"]), Config("c"), "run").matches.first()
    assert blocked["explicacion"].endswith("BLOQUEADO: motivo")


def test_empty_sides(spark):
    result = rec.reconcile(*frames(spark, [], []), Config("c"), "run")
    assert result.matches.count() == 0 and result.findings.count() == 0
    assert [r["tipo"] for r in rec.numbered(result.audit).collect()] == ["matching"]


def test_no_nested_loop_join(spark):
    bank, expected = frames(spark, *random_case(5))
    edges = matching.band_candidates(matching.flat_bank(bank), matching.flat_expected(expected), 3)
    plan = edges._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan
