"""The report: five tables, masked and safe for spreadsheets, and a writer for them.

The tables are DataFrames and scale as such. A workbook is one file by its nature; its rows stream through
the driver, one at a time.
"""

from __future__ import annotations

import zipfile
from pathlib import Path
from xml.sax.saxutils import escape

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..config import Config
from ..functions.mask import report_cell

FIXED_TIME = (2000, 1, 1, 0, 0, 0)


def tables(bank: DataFrame, expected: DataFrame, matches: DataFrame, findings: DataFrame, cfg: Config, run_id: str, mask: bool, known: list[int] | None = None) -> dict[str, DataFrame]:
    """Name to table. known: how many rows the four frames have, where that is known.

    Rows come in no order: a workbook puts its own in order of id (`in_order`), and tables at scale hold texts that list
    every candidate, which a sort would move.
    """
    cell = lambda c: report_cell(c.cast("string"), mask)
    text = lambda c: F.coalesce(c.cast("string"), F.lit(""))
    c = F.col
    counts = [("Transacciones (banco)", bank), ("Movimientos (esperados)", expected), ("Matches", matches), ("Hallazgos", findings)]
    told = [(k, name, str(n)) for k, ((name, _), n) in enumerate(zip(counts, known, strict=True), start=3)] if known else []
    summary = bank.sparkSession.createDataFrame([(1, "Run ID", run_id), (2, "Cliente", cfg.cliente), (7, "Mask", str(mask)), *told], "k int, Campo string, Valor string")
    for k, (name, frame) in enumerate(() if known else counts, start=3):
        summary = summary.unionByName(frame.agg(F.count("*").cast("string").alias("Valor")).select(F.lit(k).alias("k"), F.lit(name).alias("Campo"), "Valor"))
    return {
        "Resumen": summary.orderBy("k").select("Campo", cell(c("Valor")).alias("Valor")),
        "Transacciones": bank.select(
            c("id").alias("tx_id"), text(c("fecha_operacion.valor")).alias("fecha_operacion"), text(c("fecha_contable.valor")).alias("fecha_contable"), F.coalesce("monto_texto", c("monto.valor").cast("string")).alias("monto"), "moneda",
            cell(c("descripcion.valor")).alias("descripcion"), cell(c("referencia.valor")).alias("referencia"), "origen", cell(c("archivo_origen")).alias("archivo_origen"), text(c("fila_origen")).alias("fila_origen"),
            cell(c("cuenta_mask")).alias("cuenta_mask"), cell(c("banco")).alias("banco"), "bloquea_autoconcilia", cell(c("motivo_bloqueo_autoconcilia")).alias("motivo_bloqueo"),
        ),
        "Esperados": expected.select(
            c("id").alias("exp_id"), text(c("fecha.valor")).alias("fecha"), F.coalesce("monto_texto", c("monto.valor").cast("string")).alias("monto"), "moneda", cell(c("descripcion.valor")).alias("descripcion"), cell(c("referencia.valor")).alias("referencia"), cell(c("tercero.valor")).alias("tercero"),
        ),
        "Matches": matches.select(
            c("id").alias("match_id"), "estado", "score", "regla", F.array_join("transacciones_bancarias", ",").alias("tx_ids"), F.array_join("movimientos_esperados", ",").alias("exp_ids"), "bloqueado_por_confianza", cell(c("explicacion")).alias("explicacion"),
        ),
        "Hallazgos": findings.select(c("id").alias("hallazgo_id"), "severidad", "tipo", cell(c("mensaje")).alias("mensaje"), "entidad", text(c("entidad_id")).alias("entidad_id"), cell(c("detalles")).alias("detalles_json")),
    }


def in_order(sheets: dict[str, DataFrame]) -> dict[str, DataFrame]:
    """The tables as a workbook shows them: each in order of id, its first column."""
    return {name: frame if name == "Resumen" else frame.orderBy(frame.columns[0]) for name, frame in sheets.items()}


def _column(k: int) -> str:
    name = ""
    k += 1
    while k:
        k, r = divmod(k - 1, 26)
        name = chr(65 + r) + name
    return name


def _xml_text(value: str) -> str:
    return escape("".join(ch for ch in value if ch in "\t\n\r" or ch >= " "))


def _cells(row: int, values, bold: bool = False):
    for k, v in enumerate(values):
        at, style = f"{_column(k)}{row}", ' s="1"' if bold else ""
        if isinstance(v, bool):
            yield f'<c r="{at}" t="b"{style}><v>{int(v)}</v></c>'
        elif isinstance(v, int | float):
            yield f'<c r="{at}"{style}><v>{v!r}</v></c>'
        else:
            yield f'<c r="{at}" t="inlineStr"{style}><is><t xml:space="preserve">{_xml_text(v or "")}</t></is></c>'


def write_workbook(path: str | Path, sheets: dict[str, DataFrame]) -> None:
    """Bold headers, first row frozen, filters on; the same bytes for the same tables."""
    head = '<?xml version="1.0" encoding="UTF-8" standalone="yes"?>\n'
    main = "http://schemas.openxmlformats.org/spreadsheetml/2006/main"
    rel = "http://schemas.openxmlformats.org/officeDocument/2006/relationships"
    names = list(sheets)
    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as book:

        def put(name: str, body: str) -> None:
            book.writestr(zipfile.ZipInfo(name, FIXED_TIME), head + body, zipfile.ZIP_DEFLATED)

        kinds = "".join(f'<Override PartName="/xl/worksheets/sheet{k}.xml" ContentType="application/vnd.openxmlformats-officedocument.spreadsheetml.worksheet+xml"/>' for k in range(1, len(names) + 1))
        put("[Content_Types].xml", '<Types xmlns="http://schemas.openxmlformats.org/package/2006/content-types"><Default Extension="rels" ContentType="application/vnd.openxmlformats-package.relationships+xml"/><Default Extension="xml" ContentType="application/xml"/><Override PartName="/xl/workbook.xml" ContentType="application/vnd.openxmlformats-officedocument.spreadsheetml.sheet.main+xml"/><Override PartName="/xl/styles.xml" ContentType="application/vnd.openxmlformats-officedocument.spreadsheetml.styles+xml"/>' + kinds + "</Types>")
        put("_rels/.rels", f'<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships"><Relationship Id="rId1" Type="{rel}/officeDocument" Target="xl/workbook.xml"/></Relationships>')
        put("xl/workbook.xml", f'<workbook xmlns="{main}" xmlns:r="{rel}"><sheets>' + "".join(f'<sheet name="{escape(n)}" sheetId="{k}" r:id="rId{k}"/>' for k, n in enumerate(names, 1)) + "</sheets></workbook>")
        put("xl/_rels/workbook.xml.rels", '<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships">' + "".join(f'<Relationship Id="rId{k}" Type="{rel}/worksheet" Target="worksheets/sheet{k}.xml"/>' for k in range(1, len(names) + 1)) + f'<Relationship Id="rId{len(names) + 1}" Type="{rel}/styles" Target="styles.xml"/></Relationships>')
        put("xl/styles.xml", f'<styleSheet xmlns="{main}"><fonts count="2"><font><sz val="11"/><name val="Calibri"/></font><font><b/><sz val="11"/><name val="Calibri"/></font></fonts><fills count="1"><fill><patternFill patternType="none"/></fill></fills><borders count="1"><border/></borders><cellStyleXfs count="1"><xf/></cellStyleXfs><cellXfs count="2"><xf fontId="0"/><xf fontId="1" applyFont="1"/></cellXfs></styleSheet>')
        for k, frame in enumerate(sheets.values(), 1):
            with book.open(zipfile.ZipInfo(f"xl/worksheets/sheet{k}.xml", FIXED_TIME), "w", force_zip64=True) as out:
                out.write(f'{head}<worksheet xmlns="{main}"><sheetViews><sheetView workbookViewId="0"><pane ySplit="1" topLeftCell="A2" state="frozen"/></sheetView></sheetViews><sheetData>'.encode())
                out.write(f'<row r="1">{"".join(_cells(1, frame.columns, True))}</row>'.encode())
                last = 1
                for last, row in enumerate(frame.toLocalIterator(), 2):
                    out.write(f'<row r="{last}">{"".join(_cells(last, row))}</row>'.encode())
                out.write(f'</sheetData><autoFilter ref="A1:{_column(len(frame.columns) - 1)}{last}"/></worksheet>'.encode())
