"""Many clients in one job: every key is led by its run, and what a run decides by comes from a row of its own.

Runs are numbered. Ids and references take their run's number in front and amounts carry it beside them, so that
references, islands, components and candidate sets never cross runs, and the order of ids within a run stays. Windows of
days are constants of the plan: runs that share one are matched together, one pass for each different window.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..config import Config
from ..functions.identity import json_list
from ..storage import cut
from . import matching
from . import reconcile as rec

#: Digits of a run's number.
WIDTH = 8


@dataclass
class Run:
    """A client's run; `cliente` is the value of that column in both relations."""

    cliente: str
    run_id: str
    cfg: Config


def _led(c: Column) -> Column:
    return F.when(F.coalesce(c, F.lit("")) == "", c).otherwise(F.concat(F.lpad(F.col("numero").cast("string"), WIDTH, "0"), c))


def _own(c: Column | str) -> Column:
    """Without the run's number."""
    c = F.col(c) if isinstance(c, str) else c
    return F.substring(c, WIDTH + 1, 2**31 - 1 - WIDTH)


def _flat(frame: DataFrame, runs: DataFrame, side: str) -> DataFrame:
    flat = matching.flat_bank if side == "tx" else matching.flat_expected
    led = frame.join(runs, "cliente")
    rows = flat(led, "numero", "dias")
    amount = F.when(F.col(f"{side}_monto").isNotNull(), F.struct("numero", F.col(f"{side}_monto").alias("monto")))
    return rows.withColumns({f"{side}_id": _led(F.col(f"{side}_id")), f"{side}_ref": _led(F.col(f"{side}_ref")), f"{side}_monto": amount}).drop("numero")


def reconcile(bank: DataFrame, expected: DataFrame, runs: list[Run]) -> rec.Result:
    """All runs at once; each frame of the result is led by `run_id`.

    bank, expected: normalized rows with a column `cliente`. Rows of clients without a run are left out. Clients and
    run ids are unique. The table of runs has a row for each client.
    """
    spark = bank.sparkSession
    for values in ([r.cliente for r in runs], [r.run_id for r in runs]):
        if len(set(values)) < len(values):
            raise ValueError("a client or run id stands in several runs")
    rows = [(r.cliente, k, r.run_id, r.cfg.ventana_dias_monto_fecha, float(r.cfg.umbral_autoconcilia), float(r.cfg.umbral_confianza_campos)) for k, r in enumerate(runs)]
    table = spark.createDataFrame(rows, "cliente string, numero int, run_id string, dias int, umbral double, campos double")
    keys = table.select("cliente", "numero", "dias")
    tx, exp = cut(_flat(bank, keys, "tx")), cut(_flat(expected, keys, "exp"))
    parts = [rec.paired(tx.where(F.col("dias") == d).drop("dias"), exp.where(F.col("dias") == d).drop("dias"), d) for d in sorted({r.cfg.ventana_dias_monto_fecha for r in runs})]
    if not parts:
        parts = [rec.paired(tx.drop("dias"), exp.drop("dias"), 0)]
    found, sets = (reduce(DataFrame.unionByName, side) for side in zip(*parts, strict=True))
    number = F.substring("tx_id", 1, WIDTH).cast("int")
    found = found.withColumn("de", number).join(table.drop("cliente"), F.col("de") == F.col("numero"))
    found = found.withColumn("motivo", matching.blocking_reason(F.col("campos"))).drop("tx_conf", "exp_conf", "de", "numero", "campos")
    found = cut(found.withColumns({c: _own(c) for c in ("tx_id", "exp_id", "tx_ref")}))
    by = ("run_id",)
    terms = rec.Terms(F.col("run_id"), F.col("dias"), F.col("umbral"), by)
    named = table.select("cliente", "run_id")
    b, e = bank.join(named, "cliente"), expected.join(named, "cliente")
    made = rec.matches_of(found, terms)

    def seen() -> DataFrame:
        return rec.findings_of(found, cut(sets.select("conjunto", json_list(F.transform("candidatos", _own)).alias("cands"))), b, e, terms)

    return rec.Result(made.drop("delta"), seen, lambda findings, counts: rec.audit_of(made, findings, b, e, counts, by, table.select("run_id")))
