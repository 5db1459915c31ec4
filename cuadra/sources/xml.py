"""XML statements: `movimiento` elements at any depth under the root, whose attributes name bank and account."""

from __future__ import annotations

import io
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import Config
from ..functions import parse
from ..functions.identity import json_object, json_string, row_id
from ..functions.mask import mask_account
from ..operators.model import BANK, plain, with_confidence
from ..storage import cut, freed, one_file_a_batch
from . import limits, notes, paths, sax
from .tabular import first_error

FIELDS = ["fecha_operacion", "fecha_contable", "monto", "moneda", "descripcion", "referencia"]


def movements(content: bytes) -> Iterator[tuple[str, str, int, dict[str, str]]]:
    """(bank, account, index from 1, texts by field), while the file is read; document types and entities are refused.

    A movement's fields are its own children; of several of one name the first counts, up to its first child.
    """
    root: dict[str, str] = {}
    done: list[tuple[int, dict[str, list[str]]]] = []
    # of the innermost open movement: its depth (0: none is open), number and texts, the depth of the field that is open
    # and where its text goes; of those around it, the same
    own = k = at = depth = seen = 0
    texts: dict[str, list[str]] = {}
    sink: list[str] | None = None
    around: list[tuple] = []

    def start(name, attributes):
        nonlocal own, k, at, depth, seen, texts, sink
        if not depth:
            root.update(attributes)
        elif own:
            if at == depth:
                # text is taken up to the first child
                sink = None
            elif own == depth and name in FIELDS and name not in texts:
                texts[name] = sink = []
                at = depth + 1
        depth += 1
        if name == "movimiento" and depth > 1:
            seen += 1
            around.append((own, k, at, texts, sink))
            own, k, at, texts, sink = depth, seen, 0, {}, None

    def end(name):
        nonlocal own, k, at, depth, texts, sink
        if own:
            if at == depth:
                at, sink = 0, None
            elif own == depth:
                done.append((k, texts))
                own, k, at, texts, sink = around.pop()
        depth -= 1

    def text(t):
        if sink is not None and at == depth:
            sink.append(t)

    for _ in sax.feed(io.BytesIO(content), start, end, text):
        for number, own_texts in done:
            yield root.get("banco", ""), root.get("cuenta", ""), number, {f: "".join(own_texts.get(f, ())) for f in FIELDS}
        done.clear()


def read_bank(spark: SparkSession, path: str, cfg: Config, audit: notes.Audit | None = None) -> DataFrame:
    """Rows of XML statements, parsed once and written; a file over its cap is left there."""
    names = ["archivo", "fila", "banco", "cuenta", *FIELDS, "error", "nota"]
    most = limits.caps(cfg, "max_xml_movimientos")
    ddl = ", ".join(f"{n} {'long' if n == 'fila' else 'string'}" for n in names)

    def batch_of(rows):
        return pa.RecordBatch.from_arrays([pa.array(c, pa.int64() if n == "fila" else pa.string()) for n, c in zip(names, zip(*rows, strict=True), strict=True)], names=names)

    def read(batches):
        for batch in batches:
            for file, content in zip(batch.column("path").to_pylist(), batch.column("content"), strict=True):
                name, rows, counter = paths.relative(path, file), [], limits.Counter(**most)
                try:
                    for bank, account, k, texts in movements(content.as_py()):
                        counter.add(max_xml_movimientos=1)
                        rows.append((name, k, bank, account, *texts.values(), None, None))
                        if len(rows) == 5000:
                            yield batch_of(rows)
                            rows = []
                    rows.append((name, 0, *[None] * 9, f'{{"movimientos":{counter.seen["max_xml_movimientos"]}}}'))
                except (ValueError, limits.Exceeded) as e:
                    rows.append((name, 0, *[None] * 8, str(e), None))
                yield batch_of(rows)

    c = F.col
    raw = spark.read.format("binaryFile").load(path).select("path", "content").mapInArrow(freed(read), ddl)
    # each value is read once, for itself and for the error
    t = raw.withColumnRenamed("error", "own").withColumn("second_text", parse.norm_text(c("fecha_contable"))).select(
        "archivo", "fila", "own", "nota", "second_text", parse.date(c("fecha_operacion")).alias("day"), parse.date(c("second_text")).alias("second"), parse.amounts(c("monto")).alias("amounts"), parse.norm_currency(c("moneda"), cfg.moneda_default).alias("currency"),
        parse.norm_text(c("descripcion")).alias("descr"), F.nullif(parse.norm_reference(c("referencia")), F.lit("")).alias("ref"), parse.norm_text(c("banco")).alias("bank"), parse.norm_text(c("cuenta")).alias("account"),
    )
    bad = c("day").isNull() | c("amounts.valor").isNull() | (c("second").isNull() & (c("second_text") != ""))
    error = F.coalesce(c("own"), F.when(bad, F.lit("parseo invalido")), F.when(c("currency").isNull(), F.lit("moneda invalida")))
    t = t.select("archivo", "fila", "nota", F.when(c("nota").isNull(), error).alias("error"), "day", "second", c("amounts.valor").alias("value"), c("amounts.texto").alias("text"), "currency", "descr", "ref", "bank", "account")
    # written once, before confidences and ids widen it
    with one_file_a_batch(spark):
        t = cut(t)
    notes.tell(t, notes.MESSAGES["xml", "banco"], audit)
    limits.check(t, cfg, "XML banco")
    t = t.where("nota IS NULL")
    first_error(t, "Movimiento XML")
    js = json_string
    data = json_object(fecha_operacion=js(c("day").cast("string")), fecha_contable=js(c("second").cast("string")), monto=js(c("text")), moneda=js(c("currency")), descripcion=js(c("descr")), referencia=js(c("ref")))
    typed = t.select(
        row_id("TX-", c("archivo"), data, idx=c("fila")).alias("id"),
        F.when(c("account") != "", mask_account(c("account"))).alias("cuenta_mask"),
        F.nullif(c("bank"), F.lit("")).alias("banco"),
        F.lit(False).alias("bloquea_autoconcilia"),
        F.lit(None).cast("string").alias("motivo_bloqueo_autoconcilia"),
        with_confidence(c("day"), "xml").alias("fecha_operacion"),
        with_confidence(c("second"), "xml").alias("fecha_contable"),
        with_confidence(c("value"), "xml").alias("monto"),
        c("text").alias("monto_texto"),
        c("currency").alias("moneda"),
        with_confidence(c("descr"), "xml").alias("descripcion"),
        with_confidence(c("ref"), "xml").alias("referencia"),
        c("archivo").alias("archivo_origen"),
        F.lit("xml").alias("origen"),
        c("fila").alias("fila_origen"),
    )
    return plain(typed, BANK)
