"""What the readers write and hand to workers: one narrow copy of a read, one file at a time."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from cuadra.config import Config
from cuadra.functions import parse
from cuadra.sources import tabular, xml

BATCH = "spark.sql.execution.arrow.maxRecordsPerBatch"


@pytest.mark.parametrize("kind", ["csv", "esperados", "xml"])
def test_a_read_is_written_once_without_ids_and_confidences(spark, tmp_path, monkeypatch, kind):
    body = '<cartola banco="b" cuenta="12345"><movimiento><fecha_operacion>05/01/2026</fecha_operacion><monto>1.000</monto><descripcion>x</descripcion></movimiento></cartola>'
    for k in range(3):
        (tmp_path / f"{k}.{kind}").write_text(body if kind == "xml" else "id,fecha,monto,descripcion\n,05/01/2026,-0,x\n")
    copies, before = [], spark.conf.get(BATCH)

    def recorded(frame, real=tabular.cut):
        copies.append((frame.columns, spark.conf.get(BATCH)))
        return real(frame)

    for module in (tabular, xml):
        monkeypatch.setattr(module, "cut", recorded)
    read = {"csv": lambda *a: tabular.read_bank(*a, "csv"), "esperados": lambda *a: tabular.read_expected(*a, "csv"), "xml": xml.read_bank}[kind]
    rows = read(spark, str(tmp_path), Config("A"))
    [(columns, batch)] = copies
    assert "id" not in columns and "monto" not in columns and "text" in columns
    assert batch == "1" and spark.conf.get(BATCH) == before
    assert [(r["monto_texto"], int(r["monto"]["valor"])) for r in rows.collect()] == [("1000", 1000) if kind == "xml" else ("-0", 0)] * 3


def test_workers_get_one_file_at_a_time(spark, tmp_path, monkeypatch):
    for k in range(6):
        (tmp_path / f"{k}.csv").write_text("fecha,monto,descripcion\n05/01/2026,1,x\n")
    sizes = spark.sparkContext.accumulator(0)

    def seen(real):
        def run(batches):
            def each():
                for batch in batches:
                    sizes.add(batch.num_rows**2)
                    yield batch

            yield from real(each())

        return run

    monkeypatch.setattr(tabular, "freed", seen)
    assert tabular.read_bank(spark, str(tmp_path), Config("A"), "csv").count() == 6
    # six batches of a row each
    assert sizes.value == 6


def test_amounts_and_dates_in_one_go(spark):
    amounts = ["-0", "0", "-.0,4", "-5", "9" * 18, "-" + "9" * 19, "0" * 30 + "7", "9" * 29, "1.5,5", "x", "", None, "--1", "-"]
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(amounts)], "i int, v string").select("i", parse.amounts(F.col("v")).alias("a"), parse.amount(F.col("v")).alias("n"), parse.amount_text(F.col("v")).alias("t"))
    got = [(None if r["n"] is None else int(r["n"]), r["t"]) for r in rows.where("a.valor <=> n AND a.texto <=> t").orderBy("i").collect()]
    want = [0, 0, 0, -5, int("9" * 18), -int("9" * 19), 7, None, 16, None, None, None, None, None]
    assert got == [(n, "-0" if k in (0, 2) else None if n is None else str(n)) for k, n in enumerate(want)]
    days = ["31/04/2026", "1/1/0099", "2026-02-29", "2024-2-29", "1-1-9999", "13/13/13", " 1/2/2003 ", "1/2/2003/4", "2026-01/05"]
    found = [r[0] for r in spark.createDataFrame([(i, v) for i, v in enumerate(days)], "i int, v string").orderBy("i").select(parse.date(F.col("v"))).collect()]
    assert found == [None, dt.date(2099, 1, 1), None, dt.date(2024, 2, 29), dt.date(9999, 1, 1), None, dt.date(2003, 2, 1), None, None]
