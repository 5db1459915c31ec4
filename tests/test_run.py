"""Sources, artifacts, contract and command line over files made here."""

import json
import zipfile

import pytest

from cuadra import cli
from cuadra.config import Config, Limits
from cuadra.errors import ContractError, IngestionError, UserInputError
from cuadra.plans import contract, report
from cuadra.plans import run as plans
from cuadra.sources import detector, tabular

BANK = "fecha operacion;Importe;moneda;glosa;ref;cuenta\n05/01/2026;$ 150.000;clp;=cmd  x; fac-1001 ;12345678\n;;;;;\n2026-01-06;-20000;;Pago;;\n"
EXPECTED = "id,fecha,monto,descripcion,referencia,tercero\nE1,05/01/2026,150000,Factura,FAC-1001,  \n,06-01-26,-20000,Cargo,,Banco\n"
XML = '<r banco=" B " cuenta="123456"><g><movimiento><fecha_operacion>05/01/2026</fecha_operacion><monto>150000</monto><moneda>clp</moneda><descripcion> a  b </descripcion><referencia>FAC-1001</referencia></movimiento></g></r>'


@pytest.fixture
def inputs(tmp_path):
    paths = {"config": tmp_path / "c.yaml", "bank": tmp_path / "banco.csv", "expected": tmp_path / "esp.csv"}
    for path, text in zip(paths.values(), ("cliente: A\n", BANK, EXPECTED), strict=True):
        path.write_text(text, encoding="utf-8")
    return paths


def test_run_is_repeatable_and_explains(spark, inputs, tmp_path):
    out = tmp_path / "out"
    document = plans.run(spark, **inputs, out=out)
    assert [(m["regla"], m["estado"]) for m in sorted(document["matches"], key=lambda m: m["regla"])] == [("monto_fecha", "conciliado"), ("ref_exacta", "conciliado")]
    first = (out / "run.json").read_bytes()
    assert plans.run(spark, **inputs, out=out) == document and (out / "run.json").read_bytes() == first
    events = [json.loads(x) for x in (out / "audit.jsonl").read_text().splitlines()]
    assert {e["run_id"] for e in events} == {document["run_id"]}
    assert [e["seq"] for e in events] == [*range(len(events) // 2)] * 2
    assert [(e["tipo"], e["mensaje"], e["detalles"]) for e in events[:2]] == [("ingestion", "Detectado delimitador CSV", {"archivo": "banco.csv", "delimiter": ";"}), ("ingestion", "Detectado delimitador CSV (esperados)", {"archivo": "esp.csv", "delimiter": ","})]
    assert plans.explain(out, document["matches"][0]["id"]) == document["matches"][0]
    with pytest.raises(UserInputError):
        plans.explain(out, "M-none")
    with zipfile.ZipFile(out / "reporte_conciliacion.xlsx") as book:
        sheets = "".join(book.read(n).decode() for n in book.namelist())
    assert "'=cmd x" in sheets and "12345678" not in sheets and "Hallazgos" in sheets


def test_csv_rows(spark, inputs):
    rows = detector.read_bank(spark, str(inputs["bank"]), Config("A")).orderBy("fila_origen").collect()
    assert [(r["fila_origen"], int(r["monto"]["valor"]), r["moneda"], r["referencia"] and r["referencia"]["valor"], r["cuenta_mask"]) for r in rows] == [(2, 150000, "CLP", "FAC-1001", "****5678"), (4, -20000, "CLP", None, None)]


@pytest.mark.parametrize(("text", "message"), [("fecha,monto\n1,2\n", "descripcion"), ("fecha,monto,glosa\nayer,2,x\n", "Fila 2"), ("fecha,monto,glosa\n05/01/2026,x,x\n", "monto invalido"), ("﻿fecha,monto,glosa\n05/01/2026,1,x\n", "fecha_operacion")])
def test_bad_csv_fails(spark, tmp_path, text, message):
    path = tmp_path / "b.csv"
    path.write_text(text, encoding="utf-8")
    with pytest.raises(IngestionError, match=message):
        detector.read_bank(spark, str(path), Config("A")).count()


def test_limits(spark, inputs):
    for caps, name in ((Limits(max_tabular_rows=1), "max-tabular-rows"), (Limits(max_tabular_cells=5), "max-tabular-cells"), (Limits(max_input_bytes=10), "max-input-bytes")):
        with pytest.raises(IngestionError, match=name):
            detector.read_bank(spark, str(inputs["bank"]), Config("A", limites_ingesta=caps))


def test_xml(spark, tmp_path):
    path = tmp_path / "b.xml"
    path.write_text(XML, encoding="utf-8")
    row = detector.read_bank(spark, str(path), Config("A")).first()
    assert (row["banco"], row["cuenta_mask"], row["descripcion"]["valor"], row["fila_origen"], row["monto"]["confianza"]["score"]) == ("B", "**3456", "a b", 1, 0.95)
    for bad in ("<r><movimiento></r>", "<!DOCTYPE r []>" + XML):
        path.write_text(bad, encoding="utf-8")
        with pytest.raises(IngestionError):
            detector.read_bank(spark, str(path), Config("A"))


def test_xlsx_takes_the_first_sheet_that_fits(spark, tmp_path):
    path = tmp_path / "b.xlsx"
    first = spark.createDataFrame([("x",)], "nota string")
    second = spark.createDataFrame([("05/01/2026", "150.000", "Pago", "F-1")], "fecha string, monto string, glosa string, folio string")
    report.write_workbook(path, {"Notas": first, "Banco": second})
    row = detector.read_bank(spark, str(path), Config("A")).first()
    assert (int(row["monto"]["valor"]), row["referencia"]["valor"], row["origen"], row["fila_origen"]) == (150000, "F-1", "xlsx", 2)


def test_pdf_text_and_scans(spark, tmp_path):
    path = tmp_path / "b.pdf"
    path.write_bytes(b"%PDF")
    text = lambda content: ["Cartola de prueba larga\n05/01/2026 Transferencia FAC-1001 $ 150.000\n"]
    row = detector.read_bank(spark, str(path), Config("A"), extract=text).first()
    assert (int(row["monto"]["valor"]), row["descripcion"]["valor"], row["referencia"]["valor"], row["monto"]["confianza"]["nivel"]) == (150000, "Transferencia FAC-1001", "FAC-1001", "media")
    blank = lambda content: [""]
    with pytest.raises(IngestionError, match="OCR"):
        detector.read_bank(spark, str(path), Config("A"), extract=blank)
    scan = detector.read_bank(spark, str(path), Config("A", permitir_ocr=True), extract=blank, recognize=lambda content: ["05/01/2026 Pago 150000"]).first()
    assert (scan["bloquea_autoconcilia"], int(scan["monto"]["valor"]), scan["descripcion"]["valor"]) == (True, 150000, "Pago 150000")
    with pytest.raises(IngestionError):
        detector.read_bank(spark, str(path), Config("A"))


def test_contract():
    good = {"schema_version": "1.0.0", "run_id": "r", "fingerprint": {"config_sha256": "a", "bank_sha256": "a", "expected_sha256": "a", "mask": True, "permitir_ocr": False, "modelo_interno_version": "2", "version": "0"}, "matches": [{"id": "M", "estado": "x", "score": 1.0, "regla": "r", "explicacion": "e", "transacciones_bancarias": ["t"], "movimientos_esperados": ["e"], "bloqueado_por_confianza": False}], "hallazgos": []}
    assert contract.validate(good)["matches"][0]["bloqueado_por_confianza"] is False
    for bad in ({**good, "extra": 1}, {**good, "schema_version": "1.1.0"}, {**good, "matches": [*good["matches"], {**good["matches"][0], "id": "N"}]}):
        with pytest.raises(ValueError):
            contract.validate(bad)
    assert contract.validate_for_reader({**good, "extra": 1, "schema_version": "1.9.0"})
    with pytest.raises(ValueError):
        contract.validate_for_reader({**good, "schema_version": "2.0.0"})


def test_command_line(spark, inputs, tmp_path, capsys):
    flags = [x for k, v in inputs.items() for x in (f"--{k}", str(v))]
    assert cli.main(["validate", *flags]) == 0
    assert cli.main(["run", *flags, "--out", str(tmp_path / "o"), "--dry-run", "--max-tabular-rows", "1"]) == 4
    failed = json.loads((tmp_path / "o" / "audit.jsonl").read_text().splitlines()[-1])
    assert (failed["tipo"], failed["mensaje"], failed["detalles"]["command"], failed["detalles"]["category"], failed["detalles"]["exit_code"]) == ("cli_error", "Ejecucion CLI fallida", "run", "ingestion", 4)
    inputs["config"].write_text("nada: 1\n")
    assert cli.main(["validate", *flags]) == 3
    assert cli.main(["explain", "--run-dir", str(tmp_path), "M-1"]) == 5
    assert cli.main(["init", "--out-dir", str(tmp_path / "t")]) == 0
    capsys.readouterr()


def test_events_of_readers(spark, tmp_path):
    seen = []
    audit = lambda kind, message, details: seen.append((kind, message, details))
    (tmp_path / "b.xml").write_text(XML, encoding="utf-8")
    (tmp_path / "b.pdf").write_bytes(b"%PDF")
    report.write_workbook(tmp_path / "b.xlsx", {"Banco": spark.createDataFrame([("05/01/2026", "1", "Pago")], "fecha string, monto string, glosa string")})
    text = lambda content: ["Cartola de prueba larga\n05/01/2026 Transferencia FAC-1001 $ 150.000\n"]
    cfg = Config("A", permitir_ocr=True)
    detector.read_bank(spark, str(tmp_path / "b.xml"), cfg, audit=audit)
    detector.read_bank(spark, str(tmp_path / "b.xlsx"), cfg, audit=audit)
    detector.read_bank(spark, str(tmp_path / "b.pdf"), cfg, extract=text, audit=audit)
    detector.read_bank(spark, str(tmp_path / "b.pdf"), cfg, extract=lambda content: ["a text without any movement"], audit=audit)
    detector.read_bank(spark, str(tmp_path / "b.pdf"), cfg, extract=lambda content: [""], recognize=lambda content: ["05/01/2026 Pago 150000"], audit=audit)
    with pytest.raises(IngestionError):
        detector.read_expected(spark, str(tmp_path / "e.txt"), cfg, audit)
    pdf = {"archivo": "b.pdf"}
    assert seen == [
        ("ingestion", "XML cartola cargado", {"archivo": "b.xml", "movimientos": 1}),
        ("ingestion", "XLSX banco cargado", {"archivo": "b.xlsx", "hoja": "Banco"}),
        ("ingestion", "PDF texto extraido", {**pdf, "lineas": 2}),
        ("ingestion", "PDF texto extraido", {**pdf, "lineas": 1}),
        ("ingestion", "PDF texto procesado sin transacciones detectadas (heuristica no encontro lineas)", pdf),
        ("ingestion", "PDF sin texto extraible (posible escaneado)", pdf),
        ("ingestion", "OCR iniciado", pdf),
        ("ingestion", "OCR finalizado", {**pdf, "txs": 1}),
        ("ingestion", "Formato de movimientos esperados no soportado", {"archivo": "e.txt"}),
    ]


def test_a_read_ends_at_its_cap_and_names_the_file(spark, tmp_path):
    (tmp_path / "b.csv").write_text("fecha,monto,glosa\n" + "05/01/2026,1,x\n" * 50, encoding="utf-8")
    (tmp_path / "b.xml").write_text("<r>" + XML[XML.index("<g>") : -4] * 5 + "</r>", encoding="utf-8")
    (tmp_path / "b.pdf").write_bytes(b"%PDF")
    for name, caps, limit, value in (("b.csv", {"max_tabular_rows": 7}, "max_tabular_rows", 8), ("b.csv", {"max_tabular_cells": 10}, "max_tabular_cells", 12), ("b.xml", {"max_xml_movimientos": 3}, "max_xml_movimientos", 4), ("b.pdf", {"max_pdf_pages": 2}, "max_pdf_pages", 3), ("b.pdf", {"max_pdf_text_chars": 9}, "max_pdf_text_chars", 12)):
        with pytest.raises(IngestionError) as error:
            detector.read_bank(spark, str(tmp_path / name), Config("A", limites_ingesta=Limits(**caps)), extract=lambda content: ["text"] * 9)
        assert (error.value.details["archivo"], error.value.details["limit"], error.value.details["value"]) == (name, limit, value)


def test_delimiters_and_headers():
    assert [tabular.delimiter_of(t) for t in ("a;b\n1;2\n", "a\tb\n1\t2\n", "x")] == [";", "\t", ","]
    assert tabular.header_key("  Fecha  Operacion ") == "fecha_operacion"
    assert issubclass(ContractError, Exception)
