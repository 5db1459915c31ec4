"""Every operator as a query over the driver's tables, with its SQL.

Both sides come from `orders` by arithmetic on the key: expected rows with blank, shared and own references,
and bank rows with dropped rows, shifted dates, changed amounts and blank references.
"""

from __future__ import annotations

import datetime as dt
import io
import uuid
import zipfile
from xml.sax.saxutils import escape

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import Config
from ..functions import identity, mask, parse
from ..operators import many, matching, model
from ..operators import reconcile as rec
from ..sources import notes, pdf, tabular, xml
from ..storage import delete, shared_dir
from . import report

CFG, RUN = Config(cliente="Cliente"), "r0"
# These texts are read by both engines.
_REF = "CASE WHEN o_orderkey % 5 = 0 THEN NULL WHEN o_orderkey % 7 = 0 THEN 'FAC-' || CAST(o_orderkey % 97 AS STRING) ELSE 'FAC-' || CAST(o_orderkey AS STRING) END"
_EXP = f"""SELECT 'EXP-' || lpad(CAST(o_orderkey AS STRING), 8, '0') AS exp_id, CAST(o_orderdate AS DATE) AS exp_fecha,
  CAST(floor(o_totalprice / 1000) AS BIGINT) AS exp_monto, {_REF} AS exp_ref, o_orderkey AS k FROM orders"""
_TX = f"""SELECT 'TX-' || lpad(CAST(o_orderkey AS STRING), 8, '0') AS tx_id, CAST(o_orderdate AS DATE) + CAST(o_orderkey % 6 AS INT) AS tx_fecha,
  CAST(floor(o_totalprice / 1000) AS BIGINT) + CASE WHEN o_orderkey % 11 = 0 THEN 1 ELSE 0 END AS tx_monto,
  CASE WHEN o_orderkey % 3 = 0 THEN NULL ELSE {_REF} END AS tx_ref, o_orderkey AS k FROM orders WHERE o_orderkey % 13 <> 0"""
_ORIGIN = "CASE k % 10 WHEN 1 THEN 'pdf_texto' WHEN 2 THEN 'pdf_ocr' WHEN 3 THEN 'xml' ELSE 'csv' END"
_BASE = "CASE k % 10 WHEN 1 THEN 0.6 WHEN 2 THEN 0.3 WHEN 3 THEN 0.95 ELSE 0.9 END"
_N = "CAST(floor(o_totalprice) AS BIGINT)"
_DOTS = f"CAST(CAST(floor({_N} / 1000) AS BIGINT) AS STRING) || '.' || lpad(CAST({_N} % 1000 AS STRING), 3, '0')"
_AMOUNT = f"""CASE o_orderkey % 8 WHEN 0 THEN CAST({_N} AS STRING) WHEN 1 THEN '$ ' || {_DOTS} WHEN 2 THEN '-' || CAST({_N} AS STRING)
  WHEN 3 THEN replace({_DOTS}, '.', ',') WHEN 4 THEN {_DOTS} || ',50' WHEN 5 THEN CAST({_N} AS STRING) || '.5' WHEN 6 THEN 'sin monto' ELSE '(' || {_DOTS} || ')' END"""
_D = "CAST(o_orderdate AS DATE)"
_DD, _MM, _YY = f"lpad(CAST(day({_D}) AS STRING), 2, '0')", f"lpad(CAST(month({_D}) AS STRING), 2, '0')", f"CAST(year({_D}) AS STRING)"
_DATE = f"""CASE o_orderkey % 8 WHEN 0 THEN {_DD} || '-' || {_MM} || '-' || {_YY} WHEN 1 THEN {_DD} || '/' || {_MM} || '/' || {_YY} WHEN 2 THEN {_YY} || '-' || {_MM} || '-' || {_DD}
  WHEN 3 THEN {_DD} || '/' || {_MM} || '/' || substr({_YY}, 3, 2) WHEN 4 THEN ' ' || {_DD} || '-' || {_MM} || '-' || substr({_YY}, 3, 2) || ' ' WHEN 5 THEN '31/02/' || {_YY} WHEN 6 THEN {_DD} || '/' || {_MM} || '-' || {_YY} ELSE 'ayer' END"""
_LINE = f"""CASE WHEN o_orderkey % 7 = 0 THEN 'Saldo anterior' ELSE {_DD} || '/' || {_MM} || '/' || {_YY} || ' Pago  cliente ' || CASE WHEN o_orderkey % 2 = 0 THEN 'fac-' || CAST(o_orderkey + 10 AS STRING) || ' ' ELSE '' END || '$ ' || {_DOTS} END"""
_WS = r"[\s\x0b\x1c-\x1f\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]+"


def _sql(spark: SparkSession, sf_dir: str, text: str, table: str = "orders") -> DataFrame:
    return spark.sql(text.replace(f"FROM {table}", "FROM {t}"), t=spark.read.parquet(f"{sf_dir}/{table}.parquet"))


def relations(spark: SparkSession, sf_dir: str, mixed: bool = False) -> tuple[DataFrame, DataFrame]:
    """Both relations; with `mixed` origins whose confidence differs, and blocked rows."""
    t, e = _sql(spark, sf_dir, _TX), _sql(spark, sf_dir, _EXP)

    def field(value: str, kind: str, score=None):
        c = F.col(value).cast(kind)
        conf = F.struct((F.expr(_BASE).cast("double") if mixed else F.lit(0.9)).alias("score"), F.lit("alta").alias("nivel"), F.lit("csv").alias("origen"), F.lit(None).cast("string").alias("notas"))
        return F.when(c.isNotNull(), F.struct(c.alias("valor"), conf.alias("confianza")))

    blocked = (F.col("k") % 10 == 2) if mixed else F.lit(False)
    bank = t.select(
        F.col("tx_id").alias("id"), F.lit(None).alias("cuenta_mask"), F.lit(None).alias("banco"), blocked.alias("bloquea_autoconcilia"), F.when(blocked, F.lit(pdf.BLOCKED)).alias("motivo_bloqueo_autoconcilia"),
        field("tx_fecha", "date").alias("fecha_operacion"), F.lit(None).alias("fecha_contable"), field("tx_monto", "decimal(38,0)").alias("monto"), F.col("tx_monto").cast("string").alias("monto_texto"), F.lit("CLP").alias("moneda"),
        F.struct(F.lit("Pago").alias("valor"), model.confidence("csv").alias("confianza")).alias("descripcion"), field("tx_ref", "string").alias("referencia"), F.lit("orders").alias("archivo_origen"), F.lit("csv").alias("origen"), F.col("k").alias("fila_origen"),
    )
    ninety = lambda c: F.when(F.col(c).isNotNull(), F.struct(F.col(c).alias("valor"), model.confidence("csv").alias("confianza")))
    e = e.withColumn("exp_monto", F.col("exp_monto").cast("decimal(38,0)"))
    expected = e.select(
        F.col("exp_id").alias("id"), ninety("exp_fecha").alias("fecha"), ninety("exp_monto").alias("monto"), F.col("exp_monto").cast("string").alias("monto_texto"), F.lit("CLP").alias("moneda"),
        F.struct(F.lit("Factura").alias("valor"), model.confidence("csv").alias("confianza")).alias("descripcion"), ninety("exp_ref").alias("referencia"), F.lit(None).alias("tercero"),
    )
    return model.plain(bank, model.BANK), model.plain(expected, model.EXPECTED)


def _flat(spark, sf_dir):
    b, e = relations(spark, sf_dir)
    return matching.flat_bank(b), matching.flat_expected(e)


def _outcomes(spark, sf_dir, mixed=False):
    b, e = relations(spark, sf_dir, mixed)
    return rec.outcomes(b, e, CFG)


def _result(spark, sf_dir, mixed=False):
    b, e = relations(spark, sf_dir, mixed)
    return rec.reconcile(b, e, CFG, RUN)


def _join(column: str):
    return F.array_join(column, ",").alias(column)


def match_ref_exacta(spark, sf_dir):
    return matching.by_reference(*_flat(spark, sf_dir))[0].where("outcome = 'match'").select("tx_id", F.col("exp.exp_id").alias("exp_id"), F.col("tx_ref").alias("ref"))


def finding_amb_ref(spark, sf_dir):
    found, sets = matching.by_reference(*_flat(spark, sf_dir))
    # a set's text is made once, before it meets the rows that list it
    told = matching.listed(matching.by_set(found.where("outcome = 'ambigua'").select("tx_id", "tx_ref", "conjunto")), sets.select("conjunto", _join("candidatos")))
    return told.select("tx_id", F.col("tx_ref").alias("ref"), "candidatos")


def finding_monto_difiere(spark, sf_dir):
    return matching.by_reference(*_flat(spark, sf_dir))[0].where("outcome = 'monto_difiere'").select("tx_id", F.col("exp.exp_id").alias("exp_id"), F.col("tx_monto_texto").alias("monto_tx"), F.col("exp.exp_monto_texto").alias("monto_exp"))


def band_candidates(spark, sf_dir):
    return matching.band_candidates(*_flat(spark, sf_dir), CFG.ventana_dias_monto_fecha).select("tx_id", "exp_id", F.col("delta").cast("long").alias("delta"))


def date_islands(spark, sf_dir):
    return matching.date_islands(*_flat(spark, sf_dir), CFG.ventana_dias_monto_fecha).select(F.col("monto").cast("long").alias("monto"), "fecha", F.col("isla").cast("long").alias("isla"))


def match_monto_fecha(spark, sf_dir):
    return _outcomes(spark, sf_dir).where("fase = 2 AND outcome = 'match'").select("tx_id", "exp_id", F.col("delta").cast("long").alias("delta"))


def finding_amb_monto_fecha(spark, sf_dir):
    return _outcomes(spark, sf_dir).where("fase = 2 AND outcome = 'ambigua'").select("tx_id", _join("candidatos"))


def many_clients(spark, sf_dir):
    """Two clients with the same ids in one plan; one asks for more before it settles."""
    runs = [many.Run("uno", RUN, CFG), many.Run("dos", "r1", Config(cliente="Otro", umbral_autoconcilia=0.95))]
    sides = [x.withColumn("cliente", F.explode(F.array(*(F.lit(r.cliente) for r in runs)))) for x in relations(spark, sf_dir)]
    made = many.reconcile(*sides, runs).matches
    return made.select("run_id", F.get("transacciones_bancarias", F.lit(0)).alias("tx_id"), F.get("movimientos_esperados", F.lit(0)).alias("exp_id"), "regla", "estado")


def _kind(kind: str):
    def query(spark, sf_dir):
        return _result(spark, sf_dir).findings.where(F.col("tipo") == kind).select("id", "entidad_id", "severidad")

    return query


def reconcile_all(spark, sf_dir):
    return _result(spark, sf_dir).matches.select("id", "estado", "score", "regla", "explicacion", F.array_join("transacciones_bancarias", ",").alias("tx_ids"), F.array_join("movimientos_esperados", ",").alias("exp_ids"), "bloqueado_por_confianza")


def findings_all(spark, sf_dir):
    return _result(spark, sf_dir).findings


def summary_counts(spark, sf_dir):
    b, e = relations(spark, sf_dir)
    r = rec.reconcile(b, e, CFG, RUN)
    out = None
    for name, frame in (("txs", b), ("exps", e), ("matches", r.matches), ("hallazgos", r.findings)):
        one = frame.agg(F.count("*").alias("n")).select(F.lit(name).alias("nombre"), "n")
        out = one if out is None else out.unionByName(one)
    return out


def blocking_reason(spark, sf_dir):
    return _outcomes(spark, sf_dir, True).where("outcome = 'match'").select("tx_id", "exp_id", "motivo")


def estado_decision(spark, sf_dir):
    found = _outcomes(spark, sf_dir, True)
    return rec.matches_of(found, rec.Terms.of(CFG, RUN)).select(F.get("transacciones_bancarias", F.lit(0)).alias("tx_id"), "regla", "score", "estado", "bloqueado_por_confianza")


def parse_monto(spark, sf_dir):
    return _sql(spark, sf_dir, f"SELECT o_orderkey, {_AMOUNT} AS texto FROM orders").select("o_orderkey", "texto", parse.amount(F.col("texto")).cast("long").alias("monto"))


def parse_fecha(spark, sf_dir):
    return _sql(spark, sf_dir, f"SELECT o_orderkey, {_DATE} AS texto FROM orders").select("o_orderkey", "texto", parse.date(F.col("texto")).alias("fecha"))


def norm_texto(spark, sf_dir):
    raw = F.concat(F.lit(" \t\u00a0"), "text", F.lit("\u2003\n"))
    return spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", parse.norm_text(raw).alias("texto"))


def norm_ref(spark, sf_dir):
    raw = F.concat(F.lower("c_name"), F.lit("\t-\u00a0"), F.lower("c_mktsegment"))
    return spark.read.parquet(f"{sf_dir}/customer.parquet").select("c_custkey", parse.norm_reference(raw).alias("referencia"))


def norm_moneda(spark, sf_dir):
    raw = F.when(F.col("c_custkey") % 4 == 0, F.lit("  ")).when(F.col("c_custkey") % 4 == 1, F.lit(" clp ")).when(F.col("c_custkey") % 4 == 2, F.lit("usd")).otherwise(F.col("c_mktsegment"))
    return spark.read.parquet(f"{sf_dir}/customer.parquet").select("c_custkey", parse.norm_currency(raw, "CLP").alias("moneda"))


_ACCOUNT = "' ' || CAST(c_custkey * 7919 AS STRING) || ' ' || CAST(c_custkey % 1000 AS STRING)"


def mask_cuenta(spark, sf_dir):
    return _sql(spark, sf_dir, f"SELECT c_custkey, {_ACCOUNT} AS cuenta FROM customer", "customer").select("c_custkey", mask.mask_account(F.col("cuenta")).alias("cuenta"))


def mask_rut(spark, sf_dir):
    return _sql(spark, sf_dir, "SELECT c_custkey, ' ' || CAST(c_custkey AS STRING) || '-k ' AS rut FROM customer", "customer").select("c_custkey", mask.mask_rut(F.col("rut")).alias("rut"))


def mask_texto(spark, sf_dir):
    extra = F.concat_ws(" ", F.lit(" cta"), (F.col("doc_id") * 7919 + 10**11).cast("string"), F.lit("rut"), F.concat((F.col("doc_id") + 10**7).cast("string"), F.lit("-K")), F.lit("5"))
    return spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", mask.mask_text(F.concat("text", extra)).alias("texto"))


_CELL = "substr('=+-@x', CAST(c_custkey % 5 AS INT) + 1, 1) || c_name"


def csv_injection(spark, sf_dir):
    return _sql(spark, sf_dir, f"SELECT c_custkey, {_CELL} AS celda FROM customer", "customer").select("c_custkey", mask.safe_cell(F.col("celda")).alias("celda"))


def tx_id_hash(spark, sf_dir):
    t = _sql(spark, sf_dir, _TX)
    js = identity.json_string
    data = identity.json_object(fecha_operacion=js(F.col("tx_fecha").cast("string")), fecha_contable=F.lit("null"), monto=js(F.col("tx_monto").cast("string")), moneda=js(F.lit("CLP")), descripcion=js(F.lit("Pago")), referencia=js(F.col("tx_ref")))
    return t.select("tx_id", identity.row_id("TX-", F.lit("banco.csv"), data, row=F.col("k")).alias("id"))


def match_id_hash(spark, sf_dir):
    return _result(spark, sf_dir).matches.select("id", F.get("transacciones_bancarias", F.lit(0)).alias("tx_id"))


def finding_id_hash(spark, sf_dir):
    return _result(spark, sf_dir).findings.select("id", "tipo", "entidad_id")


def confidence_fields(spark, sf_dir):
    t = _sql(spark, sf_dir, _TX).withColumn("origen", F.expr(_ORIGIN))
    c = F.lit(None)
    for origin in ("csv", "xml", "pdf_texto", "pdf_ocr"):
        c = F.when(F.col("origen") == origin, model.confidence(origin, F.when(F.col("k") % 2 == 0, 0.10).otherwise(0.0))).otherwise(c)
    return t.withColumn("c", c).select("tx_id", "origen", F.round("c.score", 6).alias("score"), F.col("c.nivel").alias("nivel"))


def alias_resolve(spark, sf_dir):
    t = _sql(spark, sf_dir, _TX).withColumn("celdas", F.expr("CASE WHEN k % 3 = 0 THEN map('importe', 'a', 'valor', 'b') WHEN k % 3 = 1 THEN map('valor', 'b', 'glosa', 'c') ELSE map('monto', '', 'importe', 'a') END"))
    return t.select("tx_id", tabular.pick("monto", tabular.BANK_ALIASES).alias("monto"), tabular.pick("descripcion", tabular.BANK_ALIASES).alias("descripcion"))


def invariant_violations(spark, sf_dir):
    return rec.invariant_violations(_result(spark, sf_dir).matches)


def invariant_violations_seeded(spark, sf_dir):
    m = _result(spark, sf_dir).matches
    return rec.invariant_violations(m.union(m.where("regla = 'ref_exacta'")))


def audit_sequence(spark, sf_dir):
    return rec.numbered(_result(spark, sf_dir).audit)


def explain_lookup(spark, sf_dir):
    r = _result(spark, sf_dir)
    return rec.lookup(r.matches, r.findings, r.findings.where("tipo = 'pendiente_banco'").agg(F.min("id")).first()[0])


def report_matches(spark, sf_dir):
    b, e = relations(spark, sf_dir)
    r = rec.reconcile(b, e, CFG, RUN)
    return report.tables(b, e, r.matches, r.findings, CFG, RUN, True)["Matches"]


def _sheet(name: str):
    def query(spark, sf_dir):
        b, e = relations(spark, sf_dir)
        r = rec.reconcile(b, e, CFG, RUN)
        return report.tables(b, e, r.matches, r.findings, CFG, RUN, True)[name]

    return query


# A table written as files of a format and read back; readers keep a copy of what they parse, so the files can go.
#: Rows of a file, well under the readers' caps.
_A_FILE = 50_000
# the texts above without those that can't be read
_GOOD_DATE, _GOOD_AMOUNT = (t.replace("o_orderkey % 8", "o_orderkey % 5") for t in (_DATE, _AMOUNT))


def _files(spark: SparkSession) -> str:
    return f"{shared_dir(spark)}/files-{uuid.uuid4().hex}"


def csv_bank(spark, sf_dir):
    cells = _sql(spark, sf_dir, f"SELECT {_GOOD_DATE} AS `Fecha Operacion`, {_GOOD_AMOUNT} AS importe, CASE WHEN o_orderkey % 3 = 0 THEN '' ELSE ' clp ' END AS moneda, '  Pago,  cliente ; ' || CAST(o_orderkey AS STRING) AS glosa, CASE WHEN o_orderkey % 5 = 0 THEN '' ELSE ' fac-' || CAST(o_orderkey AS STRING) || ' ' END AS folio, CASE WHEN o_orderkey % 2 = 0 THEN CAST(o_orderkey + 10000000 AS STRING) ELSE '' END AS cuenta FROM orders")
    folder = _files(spark)
    cells.write.option("maxRecordsPerFile", _A_FILE).csv(folder, header=True, sep=";", emptyValue="", ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False)
    rows = model.normalize_bank(tabular.read_bank(spark, folder, CFG, "csv"))
    delete(spark, folder)
    return rows.select(F.col("fecha_operacion.valor").alias("fecha"), F.col("monto.valor").cast("long").alias("monto"), "moneda", F.col("descripcion.valor").alias("descripcion"), F.col("referencia.valor").alias("referencia"), "cuenta_mask", "origen", F.col("monto.confianza.score").alias("score"))


def csv_expected(spark, sf_dir):
    cells = _sql(spark, sf_dir, _EXP).selectExpr("exp_id AS id", "date_format(exp_fecha, 'dd/MM/yyyy') AS fecha", "CAST(exp_monto AS STRING) AS monto", "'usd' AS moneda", "'Factura   de ' || k AS descripcion", "lower(exp_ref) AS referencia", "CASE WHEN k % 4 = 0 THEN '' ELSE '  Cliente  ' || k END AS tercero")
    folder = _files(spark)
    cells.write.option("maxRecordsPerFile", _A_FILE).csv(folder, header=True, emptyValue="", nullValue="", ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False)
    rows = model.normalize_expected(tabular.read_expected(spark, folder, CFG, "csv"))
    delete(spark, folder)
    return rows.select("id", F.col("fecha.valor").alias("fecha"), F.col("monto.valor").cast("long").alias("monto"), "moneda", F.col("descripcion.valor").alias("descripcion"), F.col("referencia.valor").alias("referencia"), F.col("tercero.valor").alias("tercero"), F.round("tercero.confianza.score", 6).alias("score"))


def xml_bank(spark, sf_dir):
    node = f"'<movimiento><fecha_operacion>' || {_DD} || '/' || {_MM} || '/' || {_YY} || '</fecha_operacion><monto>' || {_DOTS} || '</monto><descripcion> Pago  ' || CAST(o_orderkey AS STRING) || '</descripcion><referencia>fac-' || CAST(o_orderkey AS STRING) || '</referencia></movimiento>'"
    nodes = _sql(spark, sf_dir, f"SELECT o_orderkey % 8 AS cuenta, floor(o_orderkey / 8000) AS archivo, {node} AS nodo FROM orders")
    # files of up to a thousand movements of an account
    files = nodes.groupBy("cuenta", "archivo").agg(F.array_join(F.collect_list("nodo"), "").alias("t"))
    folder = _files(spark)
    text = F.concat(F.lit('<cartola banco=" Uno " cuenta="9000'), F.col("cuenta").cast("string"), F.lit('">'), "t", F.lit("</cartola>"))
    files.select(text.alias("value")).write.option("maxRecordsPerFile", 1).text(folder)
    rows = model.normalize_bank(xml.read_bank(spark, folder, CFG))
    delete(spark, folder)
    return rows.select("banco", "cuenta_mask", F.col("fecha_operacion.valor").alias("fecha"), F.col("monto.valor").cast("long").alias("monto"), "moneda", F.col("descripcion.valor").alias("descripcion"), F.col("referencia.valor").alias("referencia"), F.col("monto.confianza.score").alias("score"))


def _workbook(header: list[str], rows: list[list]) -> bytes:
    """A workbook whose second sheet holds the rows: texts shared, numbers as they are, days as styled numbers."""
    ns = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"'
    rel = "http://schemas.openxmlformats.org/officeDocument/2006/relationships"
    texts: dict[str, int] = {}

    def cell(v) -> str:
        if isinstance(v, dt.date):
            return f'<c s="1"><v>{(v - dt.date(1899, 12, 30)).days}</v></c>'
        return f"<c><v>{v}</v></c>" if isinstance(v, int) else f'<c t="s"><v>{texts.setdefault(v, len(texts))}</v></c>'

    sheet = lambda lines: f"<worksheet {ns}><sheetData>" + "".join(f'<row r="{k}">{"".join(map(cell, r))}</row>' for k, r in enumerate(lines, 1)) + "</sheetData></worksheet>"
    parts = {
        "xl/workbook.xml": f'<workbook {ns} xmlns:r="{rel}"><sheets><sheet name="Notas" r:id="a"/><sheet name="Datos" r:id="b"/></sheets></workbook>',
        "xl/_rels/workbook.xml.rels": '<Relationships><Relationship Id="a" Target="worksheets/sheet1.xml"/><Relationship Id="b" Target="/xl/worksheets/sheet2.xml"/></Relationships>',
        "xl/styles.xml": f'<styleSheet {ns}><cellXfs><xf numFmtId="0"/><xf numFmtId="14"/></cellXfs></styleSheet>',
        "xl/worksheets/sheet1.xml": sheet([["nota", "fecha"], ["x", "y"]]),
        "xl/worksheets/sheet2.xml": sheet([header, *rows]),
    }
    parts["xl/sharedStrings.xml"] = f"<sst {ns}>" + "".join(f"<si><t>{escape(t)}</t></si>" for t in texts) + "</sst>"
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as book:
        for name, body in parts.items():
            book.writestr(name, body)
    return out.getvalue()


def _workbooks(cells: DataFrame, header: list[str]) -> DataFrame:
    """(path, content): a workbook for each value of `libro`, a bounded number of rows, in order of `k`."""

    def build(pdf):
        rows = pdf.sort_values("k")[header].values.tolist()
        return pd.DataFrame({"path": [f"libros/{pdf['libro'].iat[0]}.xlsx"], "content": [_workbook(header, rows)]})

    return cells.groupBy("libro").applyInPandas(build, "path string, content binary")


_BOOK = "CAST(floor(o_orderkey / 4000) AS BIGINT)"


def xlsx_bank(spark, sf_dir):
    cells = _sql(spark, sf_dir, f"SELECT {_BOOK} AS libro, o_orderkey AS k, {_D} AS fecha, {_N} AS importe, 'Pago  ' || CAST(o_orderkey % 50 AS STRING) AS glosa, CASE WHEN o_orderkey % 5 = 0 THEN ' ' ELSE ' fac-' || CAST(o_orderkey AS STRING) END AS folio, 'usd' AS moneda FROM orders")
    books = _workbooks(cells, ["fecha", "importe", "glosa", "folio", "moneda"])
    rows = model.normalize_bank(tabular.bank_of(tabular.xlsx_table(books, "libros", "banco", tabular.BANK_ALIASES, CFG), CFG, "xlsx"))
    return rows.select(F.col("archivo_origen").alias("archivo"), F.col("fila_origen").alias("fila"), F.col("fecha_operacion.valor").alias("fecha"), F.col("monto.valor").cast("long").alias("monto"), "moneda", F.col("descripcion.valor").alias("descripcion"), F.col("referencia.valor").alias("referencia"), "origen", F.col("monto.confianza.score").alias("score"))


def xlsx_expected(spark, sf_dir):
    cells = _sql(spark, sf_dir, f"SELECT {_BOOK} AS libro, o_orderkey AS k, 'E' || CAST(o_orderkey AS STRING) AS id, {_DD} || '/' || {_MM} || '/' || {_YY} AS fecha, {_DOTS} AS monto, 'Factura' AS detalle, CASE WHEN o_orderkey % 5 = 0 THEN '' ELSE 'fac-' || CAST(o_orderkey % 97 AS STRING) END AS referencia, CASE WHEN o_orderkey % 4 = 0 THEN ' ' ELSE 'Cliente ' || CAST(o_orderkey % 9 AS STRING) END AS cliente FROM orders")
    books = _workbooks(cells, ["id", "fecha", "monto", "detalle", "referencia", "cliente"])
    rows = model.normalize_expected(tabular.expected_of(tabular.xlsx_table(books, "libros", "esperados", tabular.EXPECTED_ALIASES, CFG), CFG, "xlsx"))
    return rows.select("id", F.col("fecha.valor").alias("fecha"), F.col("monto.valor").cast("long").alias("monto"), "moneda", F.col("descripcion.valor").alias("descripcion"), F.col("referencia.valor").alias("referencia"), F.col("tercero.valor").alias("tercero"), F.round("tercero.confianza.score", 6).alias("score"))


def ingestion_events(spark, sf_dir):
    folder = _files(spark)
    cells = _sql(spark, sf_dir, "SELECT c_nationkey, '05/01/2026' AS fecha, CAST(c_custkey AS STRING) AS monto, c_name AS glosa FROM customer", "customer")
    cells.repartition(1).write.partitionBy("c_nationkey").csv(folder, header=True, sep="\t")
    raw = tabular.raw_table(spark, f"{folder}/*/part-*", "csv", "banco", tabular.BANK_ALIASES, CFG)
    delete(spark, folder)
    seen = notes.events(raw, notes.MESSAGES["csv", "banco"])
    return seen.select("mensaje", F.get_json_object("detalles", "$.delimiter").alias("delimiter")).groupBy("mensaje", "delimiter").agg(F.count("*").alias("archivos"))


def pdf_line_parse(spark, sf_dir):
    lines = _sql(spark, sf_dir, f"SELECT 'orders' AS archivo, o_orderkey AS linea, {_LINE} AS texto FROM orders")
    rows = pdf.parse_text_lines(lines.withColumn("texto", parse.norm_text(F.col("texto"))))
    return rows.select("linea", "fecha", F.col("monto").cast("long").alias("monto"), "descripcion", "referencia")


_DAYS = CFG.ventana_dias_monto_fecha
_P1 = f"""exp AS ({_EXP}), tx AS ({_TX}),
cnt AS (SELECT exp_ref, count(*) AS n, min(exp_id) AS one, min(exp_monto) AS m, list(exp_id ORDER BY exp_id) AS cands FROM exp WHERE exp_ref IS NOT NULL GROUP BY exp_ref),
j AS (SELECT tx.*, n, one, m, cands, min(CASE WHEN n = 1 AND tx_monto = m THEN tx_id END) OVER (PARTITION BY tx_ref) AS winner FROM tx JOIN cnt ON tx_ref = exp_ref),
p1 AS (SELECT *, CASE WHEN n > 1 THEN 'ambigua' WHEN tx_id = winner THEN 'match' WHEN winner IS NULL OR tx_id < winner THEN 'monto_difiere' END AS outcome FROM j),
tl AS (SELECT * FROM tx WHERE tx_id NOT IN (SELECT tx_id FROM p1 WHERE outcome = 'match')),
el AS (SELECT * FROM exp WHERE exp_id NOT IN (SELECT one FROM p1 WHERE outcome = 'match'))"""
_P2 = f"""{_P1},
cand AS (SELECT tx_id, tx_monto, list(exp_id ORDER BY exp_id) AS cands FROM tl JOIN el ON tx_monto = exp_monto AND abs(date_diff('day', tx_fecha, exp_fecha)) <= {_DAYS} GROUP BY ALL),
rk AS (SELECT *, row_number() OVER (PARTITION BY tx_monto ORDER BY tx_id) AS rn FROM cand),
fold(tx_monto, rn, used, tx_id, avail) AS (
  SELECT DISTINCT tx_monto, 0::BIGINT, []::VARCHAR[], NULL::VARCHAR, []::VARCHAR[] FROM rk
  UNION ALL
  SELECT tx_monto, rn, CASE WHEN len(av) = 1 THEN list_append(used, av[1]) ELSE used END, tx_id, av
  FROM (SELECT f.used, r.tx_monto, r.rn, r.tx_id, list_filter(r.cands, lambda x: NOT list_contains(f.used, x)) AS av FROM fold f JOIN rk r ON r.tx_monto = f.tx_monto AND r.rn = f.rn + 1)),
p2 AS (SELECT tx_id, avail FROM fold WHERE len(avail) > 0),
m2 AS (SELECT p2.tx_id, avail[1] AS exp_id, abs(date_diff('day', tx_fecha, exp_fecha)) AS delta FROM p2 JOIN tx ON tx.tx_id = p2.tx_id JOIN exp ON exp_id = avail[1] WHERE len(avail) = 1),
found AS (
  SELECT tx_id, one AS exp_id, 1 AS fase, NULL::BIGINT AS delta, tx_ref FROM p1 WHERE outcome = 'match'
  UNION ALL SELECT tx_id, exp_id, 2, delta, NULL::VARCHAR FROM m2),
mat AS (
  SELECT tx_id, exp_id, fase, delta, CASE WHEN fase = 1 THEN 'ref_exacta' ELSE 'monto_fecha' END AS regla,
         CASE WHEN fase = 1 THEN 1.0 WHEN delta = 0 THEN 0.9 ELSE 0.8 END::DOUBLE AS score,
         CASE WHEN fase = 1 THEN 'Match por referencia exacta (' || tx_ref || ') y monto exacto.' ELSE 'Match por monto exacto y ventana temporal (+/-{_DAYS} dias). Delta dias: ' || delta || '.' END AS texto,
         CASE WHEN fase = 1 OR delta = 0 THEN 'conciliado' ELSE 'sugerido' END AS estado,
         'M-' || substr(sha256('{{"exp":["' || exp_id || '"],"r":"' || CASE WHEN fase = 1 THEN 'ref_exacta' ELSE 'monto_fecha' END || '","run_id":"{RUN}","tx":["' || tx_id || '"]}}'), 1, 14) AS id
  FROM found),
raw AS (
  SELECT 'ambiguedad_referencia' AS tipo, 'banco' AS entidad, tx_id AS entidad_id, '{{"cands":["' || array_to_string(cands, '","') || '"],"ref":"' || tx_ref || '"}}' AS x,
         '{{"candidatos":["' || array_to_string(cands, '","') || '"],"referencia":"' || tx_ref || '","tx_id":"' || tx_id || '"}}' AS detalles, 1 AS orden FROM p1 WHERE outcome = 'ambigua'
  UNION ALL SELECT 'referencia_coincide_monto_difiere', 'banco', tx_id, '{{"exp_id":"' || one || '","m_exp":"' || m || '","m_tx":"' || tx_monto || '","ref":"' || tx_ref || '"}}',
         '{{"exp_id":"' || one || '","monto_exp":"' || m || '","monto_tx":"' || tx_monto || '","referencia":"' || tx_ref || '","tx_id":"' || tx_id || '"}}', 1 FROM p1 WHERE outcome = 'monto_difiere'
  UNION ALL SELECT 'ambiguedad_monto_fecha', 'banco', tx_id, '{{"cands":["' || array_to_string(avail, '","') || '"]}}', '{{"candidatos":["' || array_to_string(avail, '","') || '"],"tx_id":"' || tx_id || '"}}', 2 FROM p2 WHERE len(avail) > 1
  UNION ALL SELECT CASE WHEN tx_id IN (SELECT tx_id FROM found) THEN 'tx_con_match' ELSE 'pendiente_banco' END, 'banco', tx_id, '{{}}', '{{}}', 3 FROM tx
  UNION ALL SELECT 'pendiente_esperado', 'esperado', exp_id, '{{}}', '{{}}', 4 FROM exp WHERE exp_id NOT IN (SELECT exp_id FROM found)),
finding AS (
  SELECT 'H-' || substr(sha256('{{"ent":"' || entidad || '","id":"' || entidad_id || '","run_id":"{RUN}","tipo":"' || tipo || '","x":' || x || '}}'), 1, 14) AS id, tipo, entidad, entidad_id, detalles, orden,
         CASE tipo {" ".join(f"WHEN '{k}' THEN '{v[0]}'" for k, v in rec.MESSAGES.items())} END AS severidad, CASE tipo {" ".join(f"WHEN '{k}' THEN '{v[1]}'" for k, v in rec.MESSAGES.items())} END AS mensaje
  FROM raw)"""
_MOTIVO = f"""CASE WHEN k % 10 = 2 THEN '{pdf.BLOCKED}' WHEN k % 10 = 1 THEN 'Confianza insuficiente en fecha_operacion (banco).' END"""
_FIXED = "SELECT id, estado, score, regla, texto AS explicacion, tx_id AS tx_ids, exp_id AS exp_ids, FALSE AS bloqueado_por_confianza FROM mat"


def _with(body: str, select: str) -> str:
    return f"WITH RECURSIVE {body} {select}"


_STARS = "regexp_replace(text || ' cta ' || (doc_id * 7919 + 100000000000) || ' rut ' || (doc_id + 10000000) || '-K 5', '\\b[0-9]{6,11}([0-9]-[0-9kK])\\b', '***\\1', 'g')"
for _n in range(20, 9, -1):
    _STARS = f"regexp_replace({_STARS}, '\\b[0-9]{{{_n - 4}}}([0-9]{{4}})\\b', '{'*' * (_n - 4)}\\1', 'g')"
_ISLAND = f"""d AS (SELECT tx_monto AS monto, tx_fecha AS fecha FROM ({_TX}) UNION SELECT exp_monto, exp_fecha FROM ({_EXP})),
g AS (SELECT *, CASE WHEN date_diff('day', lag(fecha) OVER (PARTITION BY monto ORDER BY fecha), fecha) <= {_DAYS} THEN 0 ELSE 1 END AS f FROM d)"""
_AUDIT = """ev AS (
  SELECT orden, entidad_id AS clave, 'hallazgo' AS tipo,
         CASE f.tipo WHEN 'ambiguedad_referencia' THEN 'Ambiguedad por referencia' WHEN 'referencia_coincide_monto_difiere' THEN 'Referencia coincide pero monto difiere' WHEN 'pendiente_banco' THEN 'Pendiente banco' ELSE 'Pendiente esperado' END AS mensaje,
         CASE f.tipo WHEN 'ambiguedad_referencia' THEN '{"hallazgo_id":"' || id || '","ref":"' || json_extract_string(detalles, '$.referencia') || '","tx_id":"' || entidad_id || '"}'
           WHEN 'referencia_coincide_monto_difiere' THEN '{"exp_id":"' || json_extract_string(detalles, '$.exp_id') || '","hallazgo_id":"' || id || '","ref":"' || json_extract_string(detalles, '$.referencia') || '","tx_id":"' || entidad_id || '"}'
           WHEN 'pendiente_banco' THEN '{"hallazgo_id":"' || id || '","tx_id":"' || entidad_id || '"}' ELSE '{"exp_id":"' || entidad_id || '","hallazgo_id":"' || id || '"}' END AS detalles
  FROM finding f WHERE f.tipo NOT IN ('ambiguedad_monto_fecha', 'tx_con_match')
  UNION ALL SELECT fase, tx_id, 'match', 'Match creado', '{"bloqueado_por_confianza":false,' || CASE WHEN fase = 2 THEN '"delta_dias":' || delta || ',' ELSE '' END || '"estado":"' || estado || '","exp_ids":["' || exp_id || '"],"match_id":"' || id || '","regla":"' || regla || '","score":' || score || ',"tx_ids":["' || tx_id || '"]}' FROM mat
  UNION ALL SELECT 5, '', 'matching', 'Matching completado', '{"exps":' || (SELECT count(*) FROM exp) || ',"hallazgos":' || (SELECT count(*) FROM finding) || ',"matches":' || (SELECT count(*) FROM mat) || ',"txs":' || (SELECT count(*) FROM tx) || '}')"""

_T = "regexp_replace(texto, '[^0-9,\\\\.\\-]', '', 'g')"
QUERIES = {
    "match_ref_exacta": (match_ref_exacta, f"WITH {_P1} SELECT tx_id, one AS exp_id, tx_ref AS ref FROM p1 WHERE outcome = 'match'"),
    "finding_amb_ref": (finding_amb_ref, f"WITH {_P1} SELECT tx_id, tx_ref AS ref, array_to_string(cands, ',') AS candidatos FROM p1 WHERE outcome = 'ambigua'"),
    "finding_monto_difiere": (finding_monto_difiere, f"WITH {_P1} SELECT tx_id, one AS exp_id, tx_monto::VARCHAR AS monto_tx, m::VARCHAR AS monto_exp FROM p1 WHERE outcome = 'monto_difiere'"),
    "band_candidates": (band_candidates, f"SELECT tx_id, exp_id, abs(date_diff('day', tx_fecha, exp_fecha))::BIGINT AS delta FROM ({_TX}) JOIN ({_EXP}) ON tx_monto = exp_monto AND abs(date_diff('day', tx_fecha, exp_fecha)) <= {_DAYS}"),
    "date_islands": (date_islands, f"WITH {_ISLAND} SELECT monto, fecha, sum(f) OVER (PARTITION BY monto ORDER BY fecha)::BIGINT AS isla FROM g"),
    "match_monto_fecha": (match_monto_fecha, _with(_P2, "SELECT tx_id, exp_id, delta::BIGINT AS delta FROM m2")),
    "finding_amb_monto_fecha": (finding_amb_monto_fecha, _with(_P2, "SELECT tx_id, array_to_string(avail, ',') AS candidatos FROM p2 WHERE len(avail) > 1")),
    **{k: (_kind(k), _with(_P2, f"SELECT id, entidad_id, severidad FROM finding WHERE tipo = '{k}'")) for k in ("tx_con_match", "pendiente_banco", "pendiente_esperado")},
    "reconcile_all": (reconcile_all, _with(_P2, _FIXED)),
    "findings_all": (findings_all, _with(_P2, "SELECT id, severidad, tipo, mensaje, entidad, entidad_id, detalles FROM finding")),
    "summary_counts": (summary_counts, _with(_P2, "SELECT 'txs' AS nombre, count(*) AS n FROM tx UNION ALL SELECT 'exps', count(*) FROM exp UNION ALL SELECT 'matches', count(*) FROM mat UNION ALL SELECT 'hallazgos', count(*) FROM finding")),
    "blocking_reason": (blocking_reason, _with(_P2, f"SELECT found.tx_id, exp_id, {_MOTIVO} AS motivo FROM found JOIN tx ON tx.tx_id = found.tx_id")),
    "estado_decision": (estado_decision, _with(_P2, f"SELECT mat.tx_id, regla, score, CASE WHEN {_MOTIVO} IS NOT NULL THEN 'pendiente' ELSE estado END AS estado, {_MOTIVO} IS NOT NULL AS bloqueado_por_confianza FROM mat JOIN tx ON tx.tx_id = mat.tx_id")),
    "parse_monto": (parse_monto, f"SELECT o_orderkey, texto, round_even(TRY_CAST(CASE WHEN contains({_T}, ',') AND contains({_T}, '.') THEN replace(replace({_T}, '.', ''), ',', '.') ELSE replace(replace({_T}, '.', ''), ',', '') END AS DOUBLE), 0)::BIGINT AS monto FROM (SELECT o_orderkey, {_AMOUNT} AS texto FROM orders)"),
    "parse_fecha": (parse_fecha, f"SELECT o_orderkey, texto, CASE WHEN regexp_matches(trim(texto), '[0-9]{{4}}') THEN try_strptime(trim(texto), ['%d-%m-%Y', '%d/%m/%Y', '%Y-%m-%d']) ELSE try_strptime(trim(texto), ['%d-%m-%y', '%d/%m/%y']) END::DATE AS fecha FROM (SELECT o_orderkey, {_DATE} AS texto FROM orders)"),
    "norm_texto": (norm_texto, rf"SELECT doc_id, trim(regexp_replace(' ' || chr(9) || chr(160) || text || chr(8195) || chr(10), '{_WS}', ' ', 'g'), ' ') AS texto FROM documents"),
    "norm_ref": (norm_ref, rf"SELECT c_custkey, upper(regexp_replace(lower(c_name) || chr(9) || '-' || chr(160) || lower(c_mktsegment), '{_WS}', '', 'g')) AS referencia FROM customer"),
    "norm_moneda": (norm_moneda, "SELECT c_custkey, CASE c_custkey % 4 WHEN 0 THEN 'CLP' WHEN 1 THEN 'CLP' WHEN 2 THEN 'USD' ELSE CASE WHEN regexp_full_match(upper(c_mktsegment), '[A-Z]{3}') THEN upper(c_mktsegment) END END AS moneda FROM customer"),
    "mask_cuenta": (mask_cuenta, f"SELECT c_custkey, CASE WHEN len(t) <= 4 THEN '****' ELSE repeat('*', len(t) - 4) || right(t, 4) END AS cuenta FROM (SELECT c_custkey, replace({_ACCOUNT}, ' ', '') AS t FROM customer)"),
    "mask_rut": (mask_rut, "SELECT c_custkey, CASE WHEN len(t) <= 3 THEN '***' ELSE '***' || right(t, 3) END AS rut FROM (SELECT c_custkey, c_custkey || '-k' AS t FROM customer)"),
    "mask_texto": (mask_texto, f"SELECT doc_id, {_STARS} AS texto FROM documents"),
    "csv_injection": (csv_injection, f"SELECT c_custkey, CASE WHEN left(t, 1) IN ('=', '+', '-', '@') THEN chr(39) || t ELSE t END AS celda FROM (SELECT c_custkey, {_CELL} AS t FROM customer)"),
    "tx_id_hash": (tx_id_hash, f"""SELECT tx_id, 'TX-' || substr(sha256('{{"data":{{"descripcion":"Pago","fecha_contable":null,"fecha_operacion":"' || tx_fecha || '","moneda":"CLP","monto":"' || tx_monto || '","referencia":' || coalesce('"' || tx_ref || '"', 'null') || '}},"file":"banco.csv","row":' || k || '}}'), 1, 12) AS id FROM ({_TX})"""),
    "many_clients": (many_clients, _with(_P2, "SELECT run_id, tx_id, exp_id, regla, CASE WHEN score >= u THEN 'conciliado' WHEN regla = 'ref_exacta' THEN 'pendiente' ELSE 'sugerido' END AS estado FROM mat, (VALUES ('r0', 0.85::DOUBLE), ('r1', 0.95::DOUBLE)) v(run_id, u)")),
    "match_id_hash": (match_id_hash, _with(_P2, "SELECT id, tx_id FROM mat")),
    "finding_id_hash": (finding_id_hash, _with(_P2, "SELECT id, tipo, entidad_id FROM finding")),
    "confidence_fields": (confidence_fields, f"""SELECT tx_id, o AS origen, s AS score, CASE WHEN o = 'xml' THEN 'alta' WHEN o = 'pdf_ocr' THEN 'baja' WHEN o = 'csv' AND s >= 0.85 THEN 'alta' WHEN s >= 0.55 THEN 'media' ELSE 'baja' END AS nivel
      FROM (SELECT tx_id, {_ORIGIN} AS o, round((({_BASE})::DOUBLE - CASE WHEN k % 2 = 0 THEN 0.1 ELSE 0 END)::DOUBLE, 6) AS s FROM ({_TX}))"""),
    "alias_resolve": (alias_resolve, f"SELECT tx_id, CASE k % 3 WHEN 0 THEN 'a' WHEN 1 THEN 'b' ELSE '' END AS monto, CASE WHEN k % 3 = 1 THEN 'c' ELSE '' END AS descripcion FROM ({_TX})"),
    "invariant_violations": (invariant_violations, "SELECT NULL::VARCHAR AS lado, NULL::VARCHAR AS entidad_id, NULL::BIGINT AS n WHERE FALSE"),
    "invariant_violations_seeded": (invariant_violations_seeded, f"WITH {_P1} SELECT 'banco' AS lado, tx_id AS entidad_id, 2::BIGINT AS n FROM p1 WHERE outcome = 'match' UNION ALL SELECT 'esperado', one, 2 FROM p1 WHERE outcome = 'match'"),
    "audit_sequence": (audit_sequence, _with(f"{_P2}, {_AUDIT}", "SELECT row_number() OVER (ORDER BY orden, clave, tipo) - 1 AS seq, tipo, mensaje, detalles FROM ev")),
    "explain_lookup": (explain_lookup, _with(_P2, "SELECT 'hallazgo' AS clase, id, tipo, mensaje AS texto FROM finding WHERE tipo = 'pendiente_banco' ORDER BY id LIMIT 1")),
    "report_matches": (report_matches, _with(_P2, "SELECT id AS match_id, estado, score, regla, tx_id AS tx_ids, exp_id AS exp_ids, FALSE AS bloqueado_por_confianza, texto AS explicacion FROM mat")),
    "report_resumen": (_sheet("Resumen"), _with(_P2, f"""SELECT 'Run ID' AS Campo, '{RUN}' AS Valor UNION ALL SELECT 'Cliente', '{CFG.cliente}' UNION ALL SELECT 'Mask', 'True' UNION ALL SELECT 'Transacciones (banco)', count(*)::VARCHAR FROM tx
      UNION ALL SELECT 'Movimientos (esperados)', count(*)::VARCHAR FROM exp UNION ALL SELECT 'Matches', count(*)::VARCHAR FROM mat UNION ALL SELECT 'Hallazgos', count(*)::VARCHAR FROM finding""")),
    "report_transacciones": (_sheet("Transacciones"), f"""SELECT tx_id, tx_fecha::VARCHAR AS fecha_operacion, '' AS fecha_contable, tx_monto::VARCHAR AS monto, 'CLP' AS moneda, 'Pago' AS descripcion, coalesce(tx_ref, '') AS referencia, 'csv' AS origen, 'orders' AS archivo_origen,
      k::VARCHAR AS fila_origen, '' AS cuenta_mask, '' AS banco, FALSE AS bloquea_autoconcilia, '' AS motivo_bloqueo FROM ({_TX})"""),
    "report_esperados": (_sheet("Esperados"), f"SELECT exp_id, exp_fecha::VARCHAR AS fecha, exp_monto::VARCHAR AS monto, 'CLP' AS moneda, 'Factura' AS descripcion, coalesce(exp_ref, '') AS referencia, '' AS tercero FROM ({_EXP})"),
    "report_hallazgos": (_sheet("Hallazgos"), _with(_P2, "SELECT id AS hallazgo_id, severidad, tipo, mensaje, entidad, entidad_id, detalles AS detalles_json FROM finding")),
    "csv_bank": (csv_bank, f"""SELECT p.fecha, m.monto, 'CLP' AS moneda, 'Pago, cliente ; ' || o_orderkey AS descripcion, CASE WHEN o_orderkey % 5 <> 0 THEN 'FAC-' || o_orderkey END AS referencia,
      CASE WHEN o_orderkey % 2 = 0 THEN '****' || right((o_orderkey + 10000000)::VARCHAR, 4) END AS cuenta_mask, 'csv' AS origen, 0.9::DOUBLE AS score
      FROM (__FECHA__) p JOIN (__MONTO__) m USING (o_orderkey)"""),
    "csv_expected": (csv_expected, f"""SELECT exp_id AS id, exp_fecha AS fecha, exp_monto AS monto, 'USD' AS moneda, 'Factura de ' || k AS descripcion, upper(exp_ref) AS referencia, CASE WHEN k % 4 <> 0 THEN 'Cliente ' || k END AS tercero,
      CASE WHEN k % 4 <> 0 THEN 0.7::DOUBLE END AS score FROM ({_EXP})"""),
    "xlsx_bank": (xlsx_bank, f"""SELECT {_BOOK} || '.xlsx' AS archivo, (row_number() OVER (PARTITION BY {_BOOK} ORDER BY o_orderkey) + 1)::BIGINT AS fila, {_D} AS fecha, {_N} AS monto, 'USD' AS moneda, 'Pago ' || (o_orderkey % 50) AS descripcion,
      CASE WHEN o_orderkey % 5 <> 0 THEN 'FAC-' || o_orderkey END AS referencia, 'xlsx' AS origen, 0.9::DOUBLE AS score FROM orders"""),
    "xlsx_expected": (xlsx_expected, f"""SELECT 'E' || o_orderkey AS id, {_D} AS fecha, {_N} AS monto, 'CLP' AS moneda, 'Factura' AS descripcion, CASE WHEN o_orderkey % 5 <> 0 THEN 'FAC-' || (o_orderkey % 97) END AS referencia,
      CASE WHEN o_orderkey % 4 <> 0 THEN 'Cliente ' || (o_orderkey % 9) END AS tercero, CASE WHEN o_orderkey % 4 <> 0 THEN 0.7::DOUBLE END AS score FROM orders"""),
    "xml_bank": (xml_bank, f"SELECT 'Uno' AS banco, {_D} AS fecha, {_N} AS monto, 'CLP' AS moneda, 'Pago ' || o_orderkey AS descripcion, 'FAC-' || o_orderkey AS referencia, 0.95::DOUBLE AS score, '*' || '000' || (o_orderkey % 8) AS cuenta_mask FROM orders"),
    "ingestion_events": (ingestion_events, "SELECT 'Detectado delimitador CSV' AS mensaje, chr(9) AS delimiter, count(DISTINCT c_nationkey) AS archivos FROM customer"),
    "pdf_line_parse": (pdf_line_parse, f"""SELECT o_orderkey AS linea, {_D} AS fecha, {_N} AS monto, 'Pago cliente' || CASE WHEN o_orderkey % 2 = 0 THEN ' fac-' || (o_orderkey + 10) ELSE '' END AS descripcion,
      CASE WHEN o_orderkey % 2 = 0 THEN 'FAC-' || (o_orderkey + 10) END AS referencia FROM orders WHERE o_orderkey % 7 <> 0"""),
}
# a file's cells are read like the texts of these two queries
_PARSED = {"__FECHA__": QUERIES["parse_fecha"][1].replace(_DATE, _GOOD_DATE), "__MONTO__": QUERIES["parse_monto"][1].replace(_AMOUNT, _GOOD_AMOUNT)}
for _name, (_query, _text) in list(QUERIES.items()):
    for _mark, _inner in _PARSED.items():
        _text = _text.replace(_mark, _inner)
    QUERIES[_name] = (_query, _text)
