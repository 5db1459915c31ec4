"""Readers: ranges of large files, streams of sheets and documents, encodings, names, caps."""

import io
import random
import tracemalloc
import zipfile

import pytest
from pyspark.sql import functions as F

from cuadra.config import Config, Limits
from cuadra.errors import IngestionError
from cuadra.plans.queries import _workbook
from cuadra.sources import delimited, detector, limits, paths, tabular, xlsx, xml

HUGE = 2**40


def csv_text(seed, n, delimiter=",", ends=("\n",)):
    """Records with quoted line feeds, delimiters and quotes; blank and short and long records between them."""
    rng = random.Random(seed)
    odd = ["a\nb", 'say ""x""', f"q{delimiter}r", "", "x\r\ny", 'a""', "\n\n", "ñandú"]
    lines = ["fecha,monto,glosa,folio,Folio".replace(",", delimiter)]
    for k in range(n):
        cells = [f"{1 + k % 28:02d}/01/2026", str(k)]
        cells += [f'"{rng.choice(odd)}"' if rng.random() < 0.5 else f'pla"in {k}' for _ in range(rng.choice([2, 3, 3, 3, 4]))]
        lines.append(delimiter.join(cells))
        if rng.random() < 0.1:
            lines.append(rng.choice(["", delimiter * 3, " "]))
    return "".join(x + rng.choice(ends) for x in lines)


@pytest.fixture
def small_ranges(spark):
    before = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    spark.conf.set("spark.sql.files.maxPartitionBytes", "700")
    spark.conf.set("spark.sql.files.openCostInBytes", "1")
    yield
    for k, v in before.items():
        spark.conf.set(k, v)


def rows_of(raw):
    return sorted(((r["archivo"], r["fila"], tuple(sorted(r["celdas"].items())), r["n"], r["error"], r["nota"]) for r in raw.collect()), key=repr)


def test_ranges_equal_one_task(spark, tmp_path, small_ranges):
    (tmp_path / "a").mkdir()
    texts = [csv_text(1, 120), csv_text(2, 90, ";", ("\r\n",)), csv_text(3, 150, "|", ("\n", "\r\n", "\r")), csv_text(4, 60) + '01/01/2026,1,"open to the end\nand on', 'fecha,monto,glosa\n01/01/2026,1,"' + "long\n" * 900 + '"\n02/01/2026,2,x\n', "fecha,monto\n" + "1,2\n" * 400, "\n" + csv_text(5, 40)]
    for k, text in enumerate(texts):
        (tmp_path / "a" / f"f{k}.csv").write_bytes(text.encode() + (b"\xe9\xff,1,\xe9\n" if k < 3 else b""))
    read = lambda ranged: tabular.csv_table(spark, str(tmp_path / "a"), "banco", tabular.BANK_ALIASES, Config("A"), ranged)
    whole, ranged = rows_of(read(HUGE)), rows_of(read(0))
    assert whole == ranged and len(whole) > 400
    assert {r[4] for r in whole if r[4]} == {"CSV banco sin columnas requeridas: descripcion", "CSV sin encabezados (fieldnames vacios)"}
    lines = spark.read.option("lineSep", "\n").text(str(tmp_path / "a" / "f0.csv"))
    assert lines.select(F.col("_metadata.file_block_start")).distinct().count() > 5


@pytest.mark.parametrize(("caps", "text"), [(Limits(max_tabular_rows=70), "max_tabular_rows"), (Limits(max_tabular_cells=333), "max_tabular_cells"), (Limits(max_tabular_rows=70, max_tabular_cells=330), "max_tabular")])
def test_caps_of_ranges_equal_those_of_one_task(spark, tmp_path, small_ranges, caps, text):
    (tmp_path / "b.csv").write_text(csv_text(6, 200), encoding="utf-8")
    cfg, found = Config("A", limites_ingesta=caps), []
    for ranged in (HUGE, 0):
        raw = tabular.csv_table(spark, str(tmp_path / "b.csv"), "banco", tabular.BANK_ALIASES, cfg, ranged)
        with pytest.raises(IngestionError, match=text) as e:
            limits.check(raw, cfg, "CSV banco")
        found.append(e.value.args[0])
    assert found[0] == found[1]


def test_open_quotes_follow_the_rules_of_csv():
    after = lambda t, q=False: delimited.quoted_after(t, q, b",")
    assert [after(b'a,"b\n'), after(b'a"b\n'), after(b'"a""b\n'), after(b'"a"b"c\n'), after(b'"a","\n'), after(b'x"y\n', True), after(b'x",\n', True), after(b'"",a\n', True), after(b'x",",\n', True)] == [True, False, True, False, True, False, False, True, True]
    assert delimited.pieces(b"a\rb\r") == [b"a\r", b"b\r\n"] and delimited.pieces(b"a\r\r") == [b"a\r", b"\r\n"]


def test_bytes_of_another_encoding_are_replaced(spark, tmp_path):
    path = tmp_path / "b.csv"
    path.write_bytes("fecha;monto;glosa\n05/01/2026;1;Señal\n".encode("cp1252"))
    assert detector.read_bank(spark, str(path), Config("A")).first()["descripcion"]["valor"] == "Se�al"


def test_equal_files_of_two_folders_have_their_own_ids(spark, tmp_path):
    for d in "ab":
        (tmp_path / d).mkdir()
        (tmp_path / d / "x.csv").write_text("fecha,monto,glosa\n05/01/2026,1,x\n", encoding="utf-8")
    rows = tabular.read_bank(spark, f"{tmp_path}/*/x.csv", Config("A"), "csv").collect()
    assert len({r["id"] for r in rows}) == 2 and {r["archivo_origen"] for r in rows} == {"a/x.csv", "b/x.csv"}
    alone = detector.read_bank(spark, f"{tmp_path}/a/x.csv", Config("A")).first()
    assert alone["archivo_origen"] == "x.csv"
    assert paths.relative("file:///d/e", "file:/d/e/f/g.csv") == "f/g.csv" and paths.relative("/d/e f", "file:///d/e%20f/g.csv", True) == "g.csv" and paths.relative("viewfs://s/in/a.csv", "viewfs://s/in/a.csv") == "a.csv"


def books(spark, tmp_path, content):
    (tmp_path / "b.xlsx").write_bytes(content)
    return str(tmp_path / "b.xlsx")


def test_sheets_with_shared_texts(spark, tmp_path):
    import datetime as dt

    rows = [[dt.date(2026, 1, 5), 150000, "Pago", "f-1"], [" ", " ", "", "\t"], ["06/01/2026", "1.000", "Pago", " "], [dt.date(2026, 1, 7), -3, "Otro", "f-1"]]
    path = books(spark, tmp_path, _workbook(["Fecha", "importe", "glosa", "folio"], rows))
    got = detector.read_bank(spark, path, Config("A")).orderBy("fila_origen").collect()
    assert [(r["fila_origen"], str(r["fecha_operacion"]["valor"]), int(r["monto"]["valor"]), r["descripcion"]["valor"], r["referencia"] and r["referencia"]["valor"]) for r in got] == [(2, "2026-01-05", 150000, "Pago", "F-1"), (4, "2026-01-06", 1000, "Pago", None), (5, "2026-01-07", -3, "Otro", "F-1")]
    with pytest.raises(IngestionError, match="max_tabular_rows.*3 > 2"):
        detector.read_bank(spark, path, Config("A", limites_ingesta=Limits(max_tabular_rows=2)))
    with pytest.raises(IngestionError, match="sin hoja con columnas requeridas"):
        detector.read_expected(spark, books(spark, tmp_path, _workbook(["Fecha", "nada"], rows)), Config("A"))


def test_expected_sheets(spark, tmp_path):
    path = books(spark, tmp_path, _workbook(["id", "fecha", "valor", "concepto", "proveedor"], [["E1", "05/01/2026", 20, "Factura", "Uno"]]))
    row = detector.read_expected(spark, path, Config("A")).first()
    assert (row["id"], int(row["monto"]["valor"]), row["tercero"]["valor"]) == ("E1", 20, "Uno")


def test_memory_of_a_sheet_is_bounded_and_a_cap_stops_it():
    header, n = ["fecha", "monto", "glosa"], 60_000
    book = _workbook(header, [["05/01/2026", k, f"{k} " + "un texto bastante largo que se repite " * 12] for k in range(n)])
    with zipfile.ZipFile(io.BytesIO(book)) as z:
        inflated = sum(i.file_size for i in z.infolist())
    required = [["fecha"], ["monto"], ["glosa"]]
    tracemalloc.start()
    found = sum(len(x) == 4 for x in xlsx.records(book, required, "banco", tabular.header_key, {}, 10**6))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert found == n and inflated > 30e6 and peak < 4e6
    rows = xlsx.records(book, required, "banco", tabular.header_key, {}, 1000)
    with pytest.raises(limits.Exceeded):
        list(rows)


def test_types_of_documents_are_refused_in_any_encoding(spark, tmp_path):
    body = '<r banco="B"><movimiento><fecha_operacion>05/01/2026</fecha_operacion><monto>{}</monto><descripcion>a</descripcion></movimiento></r>'
    dtd = '<!DOCTYPE r [<!ENTITY m "150000">]>'
    path = tmp_path / "b.xml"
    for encoding in ("utf-8", "utf-16", "utf-16-le", "utf-16-be"):
        head = f'<?xml version="1.0" encoding="{encoding[:6]}"?>'
        bom = "﻿" if encoding[6:] else ""
        path.write_bytes((bom + head + dtd + body.format("&m;")).encode(encoding))
        with pytest.raises(IngestionError, match="DOCTYPE"):
            detector.read_bank(spark, str(path), Config("A"))
        path.write_bytes((bom + head + body.format("77")).encode(encoding))
        assert int(detector.read_bank(spark, str(path), Config("A")).first()["monto"]["valor"]) == 77
    shared = io.BytesIO()
    with zipfile.ZipFile(io.BytesIO(_workbook(["fecha", "monto", "glosa"], [["05/01/2026", 1, "x"]]))) as old, zipfile.ZipFile(shared, "w") as new:
        for name in old.namelist():
            text = old.read(name).decode()
            new.writestr(name, ("﻿" + dtd.replace("r ", "sst ") + text).encode("utf-16-le") if name.endswith("sharedStrings.xml") else text)
    with pytest.raises(IngestionError, match="DOCTYPE"):
        detector.read_bank(spark, books(spark, tmp_path, shared.getvalue()), Config("A"))


def test_movements_are_read_as_a_tree_would():
    from xml.etree import ElementTree as ET

    text = """<movimiento banco="b" cuenta="c"><x><movimiento><monto>1<i>no</i>2</monto><monto>3</monto><descripcion/><movimiento><monto>9</monto></movimiento>
    <referencia> r &amp; s <![CDATA[<t>]]></referencia><g><fecha_operacion>no</fecha_operacion></g></movimiento></x><n:movimiento xmlns:n="u"><monto>5</monto></n:movimiento><movimiento/></movimiento>"""
    got = sorted(xml.movements(text.encode()), key=lambda m: m[2])
    root = ET.fromstring(text)
    want = [("b", "c", k, {f: (e.text or "") if (e := node.find(f)) is not None else "" for f in xml.FIELDS}) for k, node in enumerate(root.findall(".//movimiento"), start=1)]
    assert got == want and len(got) == 3


def test_a_cap_ends_a_document_early():
    def parts():
        yield b"<r>"
        for _ in range(10**6):
            yield b"<movimiento><monto>1</monto></movimiento>"

    class Stream:
        def __init__(self):
            self.parts, self.taken = parts(), 0

        def read(self, n):
            out = b"".join(next(self.parts) for _ in range(1000))
            self.taken += len(out)
            return out

    stream = Stream()
    from cuadra.sources import sax

    seen = []
    for _ in sax.feed(stream, lambda name, a: seen.append(name), lambda name: None, lambda t: None):
        if len(seen) > 3000:
            break
    assert stream.taken < 200_000


def test_pages_are_counted_while_they_are_extracted(spark, tmp_path):
    (tmp_path / "b.pdf").write_bytes(b"%PDF")

    def endless(content):
        while True:
            yield "05/01/2026 Transferencia FAC-1001 $ 150.000\n"

    with pytest.raises(IngestionError, match="max_pdf_pages"):
        detector.read_bank(spark, str(tmp_path / "b.pdf"), Config("A", limites_ingesta=Limits(max_pdf_pages=5)), extract=endless)
