"""CSV and XLSX tables: one row per record with its number and its cells by normalized header.

A path may name one file, a folder or a pattern; files are read in parallel, delimited ones over RANGED bytes in ranges.
"""

from __future__ import annotations

import csv
import io
import json
import re

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import Config
from ..errors import IngestionError
from ..functions import parse
from ..functions.identity import json_object, json_string, row_id
from ..functions.mask import mask_account
from ..operators.model import BANK, EXPECTED, plain, with_confidence
from ..storage import cut, freed, one_file_a_batch
from . import delimited, limits, notes, paths, xlsx
from .delimited import delimiter_of

#: Header aliases by field, in order of priority (fixed values).
BANK_ALIASES = {
    "fecha_operacion": ["fecha_operacion", "fecha", "fecha_movimiento"],
    "fecha_contable": ["fecha_contable", "fecha_valor", "fecha_proceso"],
    "monto": ["monto", "importe", "valor"],
    "moneda": ["moneda", "currency"],
    "descripcion": ["descripcion", "glosa", "detalle", "concepto"],
    "referencia": ["referencia", "ref", "comprobante", "folio", "nro_referencia"],
    "cuenta": ["cuenta", "nro_cuenta", "cuenta_origen"],
}
EXPECTED_ALIASES = {
    "id": ["id", "id_externo"],
    "fecha": ["fecha", "fecha_documento"],
    "monto": ["monto", "importe", "valor"],
    "moneda": ["moneda", "currency"],
    "descripcion": ["descripcion", "glosa", "detalle", "concepto"],
    "referencia": ["referencia", "ref", "folio", "nro_referencia"],
    "tercero": ["tercero", "proveedor", "cliente"],
}
REQUIRED = {"banco": ["fecha_operacion", "monto", "descripcion"], "esperados": ["fecha", "monto", "descripcion"]}
RAW = "archivo string, fila long, celdas map<string,string>, n long, error string, nota string"
#: Bytes above which a delimited file is read in ranges, by many tasks.
RANGED = 64 * 2**20
_SPACES = re.compile(r"\s+")


def header_key(text: str | None) -> str:
    """White space collapsed, lower case, spaces as underscores."""
    return _SPACES.sub(" ", (text or "").strip()).lower().replace(" ", "_")


def csv_records(content: bytes, required: list[list[str]], kind: str, note: dict):
    """(row number, cells, how many) of a CSV file, the header being row 1; records without any text are left out.

    Bytes that aren't UTF-8 become replacement characters.
    """
    text = content.decode("utf-8", "replace")
    note["delimiter"] = delimiter_of(text)
    reader = csv.reader(io.StringIO(text, newline=""), delimiter=note["delimiter"])
    header = delimited.Header(next(reader, []), required, kind, header_key)
    for k, record in enumerate((r for r in reader if r), start=2):
        if row := header.cells(record):
            yield k, *row


def csv_table(spark: SparkSession, path: str, kind: str, aliases: dict[str, list[str]], cfg: Config, ranged: int | None = None, written: bool = True) -> DataFrame:
    """Records of every delimited file under a path, parsed once and written, or for the caller to write.

    A file that can't be read gives a row with its error; one that goes over a cap is left there. What the
    reader noticed about a file is a row of its own with `nota`.
    """
    ranged = RANGED if ranged is None else ranged
    required = [aliases[name] for name in REQUIRED[kind]]
    schema = pa.schema([("archivo", pa.string()), ("fila", pa.int64()), ("celdas", pa.map_(pa.string(), pa.string())), ("n", pa.int64()), ("error", pa.string()), ("nota", pa.string())])
    most = limits.caps(cfg, "max_tabular_rows", "max_tabular_cells")

    def batch_of(rows):
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)

    def read(batches):
        for batch in batches:
            for file, content in zip(batch.column("path").to_pylist(), batch.column("content"), strict=True):
                name, rows, note, counter = paths.relative(path, file), [], {}, limits.Counter(**most)
                try:
                    for k, cells, n in csv_records(content.as_py(), required, kind, note):
                        counter.add(max_tabular_rows=1, max_tabular_cells=n)
                        rows.append((name, k, cells, n, None, None))
                        if len(rows) == 5000:
                            yield batch_of(rows)
                            rows = []
                except Exception as e:
                    rows.append((name, 0, [], 0, str(e) or type(e).__name__, None))
                if note:
                    rows.append((name, 0, [], 0, None, json.dumps(note, separators=(",", ":"))))
                if rows:
                    yield batch_of(rows)

    files = spark.read.format("binaryFile").load(path)
    small = files.where(F.col("length") <= ranged).select("path", "content").mapInArrow(freed(read), RAW)
    if written:
        with one_file_a_batch(spark):
            small = cut(small)
    if files.where(F.col("length") > ranged).select("length").isEmpty():
        return small
    return small.unionByName(delimited.raw_table(spark, path, kind, required, header_key, cfg, ranged))


def raw_table(spark: SparkSession, path: str, format_: str, kind: str, aliases: dict[str, list[str]], cfg: Config, written: bool = True) -> DataFrame:
    """Records of CSV or XLSX files."""
    if format_ == "csv":
        return csv_table(spark, path, kind, aliases, cfg, written=written)
    return xlsx_table(spark.read.format("binaryFile").load(path), path, kind, aliases, cfg)


def xlsx_table(files: DataFrame, root: str, kind: str, aliases: dict[str, list[str]], cfg: Config) -> DataFrame:
    """Records of workbooks given as (path, content)."""
    return xlsx.raw_table(files, root, kind, [aliases[name] for name in REQUIRED[kind]], header_key, cfg)


def pick(name: str, aliases: dict[str, list[str]]) -> Column:
    """The cell of the first alias that the file has, even if it is blank; empty where it has none."""
    out = F.lit("")
    for alias in reversed(aliases[name]):
        out = F.when(F.map_contains_key("celdas", alias), F.coalesce(F.col("celdas")[alias], F.lit(""))).otherwise(out)
    return out


def first_error(frame: DataFrame, label: str) -> None:
    """Fail with the first bad row of the first file, in one action."""
    bad = frame.where(F.col("error").isNotNull()).agg(F.min(F.struct("archivo", "fila", "error"))).first()[0]
    if bad is not None:
        raise IngestionError(f"{bad['error']}" if not bad["fila"] else f"{label} {bad['fila']}: {bad['error']}", {"archivo": bad["archivo"]})


def bank_cells(raw: DataFrame, cfg: Config, strict_second_date: bool) -> DataFrame:
    """What the cells of bank rows say, with an `error` column."""
    # each cell is looked up once, and each value read once for itself and for the error
    t = raw.select("archivo", "fila", "n", F.col("error").alias("own"), "nota", *(pick(name, BANK_ALIASES).alias(name) for name in BANK_ALIASES))
    c = F.col
    t = t.select(
        "archivo", "fila", "n", "own", "nota", parse.date(c("fecha_operacion")).alias("day"), parse.date(c("fecha_contable")).alias("second"), (parse.strip(c("fecha_contable")) != "").alias("dated"), parse.amounts(c("monto")).alias("amounts"),
        parse.norm_currency(c("moneda"), cfg.moneda_default).alias("currency"), parse.norm_text(c("descripcion")).alias("descr"), F.nullif(parse.norm_reference(c("referencia")), F.lit("")).alias("ref"), parse.norm_text(c("cuenta")).alias("account"),
    )
    error = F.coalesce(
        c("own"),
        F.when(c("day").isNull(), F.lit("fecha_operacion invalida")),
        F.when(F.lit(strict_second_date) & c("second").isNull() & c("dated"), F.lit("fecha_contable invalida")),
        F.when(c("amounts.valor").isNull(), F.lit("monto invalido")),
        F.when(c("currency").isNull(), F.lit("moneda invalida")),
    )
    return t.select("archivo", "fila", "n", "nota", F.when(c("nota").isNull(), error).alias("error"), "day", "second", c("amounts.valor").alias("value"), c("amounts.texto").alias("text"), "currency", "descr", "ref", "account")


def bank_rows(t: DataFrame, origin: str) -> DataFrame:
    """Typed bank rows of their cells."""
    js = json_string
    data = json_object(fecha_operacion=js(F.col("day").cast("string")), fecha_contable=js(F.col("second").cast("string")), monto=js(F.col("text")), moneda=js(F.col("currency")), descripcion=js(F.col("descr")), referencia=js(F.col("ref")))
    return t.select(
        row_id("TX-", F.col("archivo"), data, row=F.col("fila")).alias("id"),
        F.when(F.col("account") != "", mask_account(F.col("account"))).alias("cuenta_mask"),
        F.lit(None).cast("string").alias("banco"),
        F.lit(False).alias("bloquea_autoconcilia"),
        F.lit(None).cast("string").alias("motivo_bloqueo_autoconcilia"),
        with_confidence(F.col("day"), origin).alias("fecha_operacion"),
        with_confidence(F.col("second"), origin, 0.10).alias("fecha_contable"),
        with_confidence(F.col("value"), origin).alias("monto"),
        F.col("text").alias("monto_texto"),
        F.col("currency").alias("moneda"),
        with_confidence(F.col("descr"), origin).alias("descripcion"),
        with_confidence(F.col("ref"), origin).alias("referencia"),
        F.col("archivo").alias("archivo_origen"),
        F.lit(origin).alias("origen"),
        F.col("fila").alias("fila_origen"),
    )


def expected_cells(raw: DataFrame, cfg: Config) -> DataFrame:
    """What the cells of expected rows say, with an `error` column."""
    t = raw.select("archivo", "fila", "n", F.col("error").alias("own_error"), "nota", *(pick(name, EXPECTED_ALIASES).alias(name) for name in EXPECTED_ALIASES))
    c = F.col
    t = t.select(
        "archivo", "fila", "n", "own_error", "nota", parse.date(c("fecha")).alias("day"), parse.amounts(c("monto")).alias("amounts"), parse.norm_currency(c("moneda"), cfg.moneda_default).alias("currency"), parse.norm_text(c("descripcion")).alias("descr"),
        F.nullif(parse.norm_reference(c("referencia")), F.lit("")).alias("ref"), F.nullif(parse.norm_text(c("tercero")), F.lit("")).alias("third"), parse.norm_text(c("id")).alias("own"),
    )
    error = F.coalesce(c("own_error"), F.when(c("day").isNull(), F.lit("fecha invalida")), F.when(c("amounts.valor").isNull(), F.lit("monto invalido")), F.when(c("currency").isNull(), F.lit("moneda invalida")))
    return t.select("archivo", "fila", "n", "nota", F.when(c("nota").isNull(), error).alias("error"), "day", c("amounts.valor").alias("value"), c("amounts.texto").alias("text"), "currency", "descr", "ref", "third", "own")


def expected_rows(t: DataFrame, origin: str) -> DataFrame:
    """Typed expected rows of their cells."""
    js = json_string
    data = json_object(fecha=js(F.col("day").cast("string")), monto=js(F.col("text")), moneda=js(F.col("currency")), descripcion=js(F.col("descr")), referencia=js(F.col("ref")), tercero=js(F.col("third")))
    return t.select(
        F.when(F.col("own") != "", F.col("own")).otherwise(row_id("EXP-", F.col("archivo"), data, row=F.col("fila"))).alias("id"),
        with_confidence(F.col("day"), origin).alias("fecha"),
        with_confidence(F.col("value"), origin).alias("monto"),
        F.col("text").alias("monto_texto"),
        F.col("currency").alias("moneda"),
        with_confidence(F.col("descr"), origin).alias("descripcion"),
        with_confidence(F.col("ref"), origin).alias("referencia"),
        with_confidence(F.col("third"), origin, 0.20).alias("tercero"),
    )


def _checked(cells: DataFrame, cfg: Config, kind: str, side: str, audit: notes.Audit | None) -> DataFrame:
    """The cells, written once, before confidences and ids widen them; the first bad row fails the read."""
    with one_file_a_batch(cells.sparkSession):
        cells = cut(cells)
    notes.tell(cells, notes.MESSAGES[kind, side], audit)
    limits.check(cells, cfg, f"{kind.upper()} {side}")
    rows = cells.where("nota IS NULL")
    first_error(rows, "Fila")
    return rows


def bank_of(raw: DataFrame, cfg: Config, kind: str, audit: notes.Audit | None = None) -> DataFrame:
    """Bank rows of raw records; the first bad row fails the read."""
    return plain(bank_rows(_checked(bank_cells(raw, cfg, strict_second_date=kind == "xlsx"), cfg, kind, "banco", audit), kind), BANK)


def expected_of(raw: DataFrame, cfg: Config, kind: str, audit: notes.Audit | None = None) -> DataFrame:
    return plain(expected_rows(_checked(expected_cells(raw, cfg), cfg, kind, "esperados", audit), kind), EXPECTED)


def read_bank(spark: SparkSession, path: str, cfg: Config, kind: str, audit: notes.Audit | None = None) -> DataFrame:
    """Bank rows of CSV or XLSX files."""
    return bank_of(raw_table(spark, path, kind, "banco", BANK_ALIASES, cfg, written=False), cfg, kind, audit)


def read_expected(spark: SparkSession, path: str, cfg: Config, kind: str, audit: notes.Audit | None = None) -> DataFrame:
    return expected_of(raw_table(spark, path, kind, "esperados", EXPECTED_ALIASES, cfg, written=False), cfg, kind, audit)
