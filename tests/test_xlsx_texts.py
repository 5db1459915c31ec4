"""Shared texts of sheets: those a task has room for and those it hasn't."""

import datetime as dt

from cuadra.config import Config
from cuadra.plans.queries import _workbook
from cuadra.sources import tabular, xlsx

from .test_readers import books

ROWS = [[dt.date(2026, 1, 5), k, f"Pago {k % 7}", f"f-{k}"] for k in range(40)]
HEADER = ["fecha", "monto", "glosa", "folio"]
REQUIRED = [["fecha"], ["monto"], ["glosa"]]


def test_texts_within_the_room_go_into_their_cells():
    book = _workbook(HEADER, ROWS)
    for room, asks in ((xlsx.HELD, False), (0, True), (10 * xlsx.ADDED, True)):
        found = list(xlsx.records(book, REQUIRED, "banco", tabular.header_key, {}, 10**6, room))
        texts = dict(x for x in found if len(x) == 2)
        rows = [x for x in found if len(x) == 4]
        assert any(numbers for _, _, numbers, _ in rows) == bool(texts) == asks
        whole = [(k, cells | {key: texts[n] for key, n in numbers.items()}) for k, cells, numbers, _ in rows]
        assert whole == [(k, {"fecha": "2026-01-05", "monto": str(r[1]), "glosa": r[2], "folio": r[3]}) for k, r in enumerate(ROWS, 2)]


def test_sheets_read_the_same_with_and_without_room(spark, tmp_path):
    files = spark.read.format("binaryFile").load(books(spark, tmp_path, _workbook(HEADER, ROWS)))
    whole, parted = (xlsx.raw_table(files, str(tmp_path), "banco", REQUIRED, tabular.header_key, Config("A"), room) for room in (xlsx.HELD, 0))
    rows = [{(r["fila"], tuple(sorted(r["celdas"].items())), r["n"], r["error"], r["nota"]) for r in f.collect()} for f in (whole, parted)]
    assert rows[0] == rows[1] and len(rows[0]) == len(ROWS) + 1
