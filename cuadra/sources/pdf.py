"""PDF statements by lines of text. Getting text out of a file is pluggable; without an extractor reads fail."""

from __future__ import annotations

from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..config import Config
from ..errors import IngestionError
from ..functions import parse
from ..functions.identity import json_object, json_string, row_id
from ..operators.model import BANK, plain, with_confidence
from ..storage import cut
from . import limits, notes

#: bytes of a file -> text of each page
Extractor = Callable[[bytes], list[str]]
DATE = r"[0-9]{1,2}[/-][0-9]{1,2}[/-][0-9]{2,4}"
AMOUNT = r"[-+]?\$?(?U:\s)*[0-9]{1,3}(?:[.,][0-9]{3})*(?:[.,][0-9]{1,2})?|[-+]?[0-9]+"
REFERENCE = r"[A-Z]{2,5}-[0-9]{2,10}"
#: Fewer characters than this look like a scan.
LEAST_TEXT = 20
BLOCKED = "Transaccion proviene de PDF escaneado procesado por OCR: requiere revision humana."


def default_extractor(content: bytes) -> list[str]:
    """Text by pypdf, where that is installed."""
    import io

    try:
        from pypdf import PdfReader
    except ImportError as e:
        raise ValueError("extraccion de texto PDF no disponible (instale pypdf o entregue un extractor)") from e
    # page by page, so that a cap ends the extraction
    return (p.extract_text() or "" for p in PdfReader(io.BytesIO(content)).pages)


def pages(spark: SparkSession, path: str, extract: Extractor, caps: dict[str, int] | None = None) -> DataFrame:
    """(archivo, pagina, texto, error); the text of whole files, page by page. A file over a cap has its error only."""
    ddl = "archivo string, pagina int, texto string, error string"
    caps = caps or {}

    def read(batches):
        for batch in batches:
            for name, content in zip(batch.column("path").to_pylist(), batch.column("content").to_pylist(), strict=True):
                name, rows, counter = name.rsplit("/", 1)[-1], [], limits.Counter(**caps)
                try:
                    for k, t in enumerate(extract(content), start=1):
                        counter.add(**{n: x for n, x in (("max_pdf_pages", 1), ("max_pdf_text_chars", len(t))) if n in caps})
                        rows.append((name, k, t, None))
                except Exception as e:
                    rows = [(name, 0, None, str(e))]
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (pa.string(), pa.int32(), pa.string(), pa.string()), strict=True)], names=["archivo", "pagina", "texto", "error"])

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInArrow(read, ddl)


def lines_of(pages_: DataFrame) -> DataFrame:
    """(archivo, linea, texto): the lines of a file in order, with white space collapsed, blank ones left out."""
    whole = pages_.groupBy("archivo").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("pagina", "texto"))), lambda p: p["texto"]), "\n").alias("t"))
    each = whole.select("archivo", F.posexplode(F.split("t", r"\r\n|[\n\r\x0B\x0C\x1C-\x1E\x{85}\x{2028}\x{2029}]")).alias("linea", "raw"))
    return each.select("archivo", "linea", parse.norm_text(F.col("raw")).alias("texto")).where("texto <> ''")


def parse_text_lines(lines: DataFrame) -> DataFrame:
    """Add fecha, monto, monto_texto, descripcion and referencia; lines without a date or an amount are left out.

    The last amount of a line counts, and every occurrence of its text is taken out of the description.
    """
    line = F.col("texto")
    day_text = F.regexp_extract(line, DATE, 0)
    last = F.element_at(F.regexp_extract_all(line, F.lit(AMOUNT), F.lit(0)), -1)
    rows = lines.withColumns({"dia": day_text, "cifra": F.when(F.regexp_count(line, F.lit(AMOUNT)) > 0, last)}).where("dia <> '' AND cifra IS NOT NULL")
    descr = parse.norm_text(F.replace(F.replace(line, F.col("dia"), F.lit("")), F.col("cifra"), F.lit("")))
    rows = rows.withColumns({"fecha": parse.date(F.col("dia")), "monto": parse.amount(F.col("cifra")), "monto_texto": parse.amount_text(F.col("cifra")), "descripcion": descr, "referencia": F.nullif(F.regexp_extract(F.upper(line), REFERENCE, 0), F.lit(""))})
    return rows.where("fecha IS NOT NULL AND monto IS NOT NULL").drop("dia", "cifra")


def parse_ocr_lines(lines: DataFrame) -> DataFrame:
    """As above for recognized text: the first token is the date, the last one that is an amount the amount."""
    tokens = F.split("texto", " ")
    good = F.filter(tokens, lambda t: parse.amount(t).isNotNull())
    rows = lines.where(F.size(tokens) >= 2).withColumns({"dia": F.get(tokens, F.lit(0)), "cifra": F.try_element_at(good, F.lit(-1))})
    descr = parse.norm_text(F.expr("substring(texto, length(dia) + 1)"))
    rows = rows.withColumns({"fecha": parse.date(F.col("dia")), "monto": parse.amount(F.col("cifra")), "monto_texto": parse.amount_text(F.col("cifra")), "descripcion": descr})
    return rows.where("fecha IS NOT NULL AND monto IS NOT NULL").drop("dia", "cifra")


def _typed(rows: DataFrame, cfg: Config, origin: str, data: Column, ref: Column, degrade: Column | float, ref_degrade: float, notes: str | None) -> DataFrame:
    numbered = rows.withColumn("idx", F.row_number().over(Window.partitionBy("archivo").orderBy("linea")).cast("long"))
    scan = origin == "pdf_ocr"
    out = numbered.select(
        row_id("TX-", F.col("archivo"), data, idx=F.col("idx")).alias("id"),
        F.lit(None).cast("string").alias("cuenta_mask"),
        F.lit(None).cast("string").alias("banco"),
        F.lit(scan).alias("bloquea_autoconcilia"),
        F.lit(BLOCKED if scan else None).cast("string").alias("motivo_bloqueo_autoconcilia"),
        with_confidence(F.col("fecha"), origin, notes=notes).alias("fecha_operacion"),
        F.lit(None).alias("fecha_contable"),
        with_confidence(F.col("monto"), origin, notes=notes).alias("monto"),
        "monto_texto",
        F.lit(cfg.moneda_default).alias("moneda"),
        with_confidence(F.col("descripcion"), origin, degrade, notes).alias("descripcion"),
        with_confidence(ref, origin, ref_degrade).alias("referencia"),
        F.col("archivo").alias("archivo_origen"),
        F.lit(origin).alias("origen"),
        F.col("idx").alias("fila_origen"),
    )
    return plain(out, BANK)


def _checked(spark: SparkSession, path: str, cfg: Config, extract: Extractor, label: str) -> DataFrame:
    got = cut(pages(spark, path, extract, limits.caps(cfg, "max_pdf_pages", "max_pdf_text_chars")))
    limits.check(got, cfg, label)
    bad = got.where("error IS NOT NULL").agg(F.min("error")).first()[0]
    if bad is not None:
        raise IngestionError(f"{label}: {bad}")
    return got


def _noted(files: DataFrame, counts: DataFrame, name: str) -> DataFrame:
    """A note with a count, which may be 0, for each file."""
    by = counts.groupBy("archivo").agg(F.count("*").alias("n")).withColumnRenamed("archivo", "of")
    found = files.select("archivo").distinct().join(by, F.col("archivo") == F.col("of"), "left")
    return found.select("archivo", F.concat(F.lit(f'{{"{name}":'), F.coalesce("n", F.lit(0)).cast("string"), F.lit("}")).alias("nota"))


def read_text(spark: SparkSession, path: str, cfg: Config, extract: Extractor = default_extractor, audit: notes.Audit | None = None) -> tuple[DataFrame, bool]:
    """(bank rows, whether the file looks like a scan)"""
    got = _checked(spark, path, cfg, extract, "PDF banco")
    chars = got.agg(F.coalesce(F.sum(F.length(parse.strip(F.col("texto")))), F.lit(0))).first()[0]
    files = got.select("archivo", F.lit("{}").alias("nota")).distinct()
    lines = lines_of(got)
    rows = parse_text_lines(lines)
    if audit is not None:
        if chars < LEAST_TEXT:
            notes.tell(files, notes.SCANNED, audit)
        else:
            notes.tell(_noted(files, lines, "lineas"), notes.EXTRACTED, audit)
            notes.tell(files.join(rows.select("archivo"), "archivo", "left_anti"), notes.NOTHING, audit)
    js = json_string
    data = json_object(fecha_operacion=js(F.col("fecha").cast("string")), monto=js(F.col("monto_texto")), descripcion=js(F.col("descripcion")), ref=js(F.col("referencia")))
    degrade = F.when(F.col("descripcion") == "", 0.10).otherwise(0.0)
    typed = _typed(rows, cfg, "pdf_texto", data, F.col("referencia"), degrade, 0.20, None)
    return (typed.where("false"), True) if chars < LEAST_TEXT else (typed, False)


def read_ocr(spark: SparkSession, path: str, cfg: Config, recognize: Extractor | None, audit: notes.Audit | None = None) -> DataFrame:
    """Rows of a scan; every one is blocked from settling by itself, and none at all is an error."""
    if recognize is None:
        raise IngestionError("OCR no disponible: entregue un reconocedor de texto.")
    name = F.element_at(F.split("path", "/"), -1)
    files = spark.read.format("binaryFile").load(path).select(name.alias("archivo"), F.lit("{}").alias("nota"))
    notes.tell(files, notes.OCR_BEGUN, audit)
    rows = parse_ocr_lines(lines_of(_checked(spark, path, cfg, recognize, "PDF banco (OCR)")))
    notes.tell(_noted(files, rows, "txs"), notes.OCR_ENDED, audit)
    js = json_string
    data = json_object(fecha_operacion=js(F.col("fecha").cast("string")), monto=js(F.col("monto_texto")), descripcion=js(F.col("descripcion")))
    typed = _typed(rows, cfg, "pdf_ocr", data, F.lit(None).cast("string"), 0.05, 0.0, "OCR")
    if typed.isEmpty():
        raise IngestionError("OCR completado pero no se detectaron transacciones (heuristica).")
    return typed
