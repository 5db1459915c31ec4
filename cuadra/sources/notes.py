"""Events of the readers: what each noticed about a file, for the audit trail."""

from __future__ import annotations

import json
from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: kind, message, details of an event
Audit = Callable[[str, str, dict], None]
#: Messages by reader and side (fixed values).
MESSAGES = {
    ("csv", "banco"): "Detectado delimitador CSV",
    ("csv", "esperados"): "Detectado delimitador CSV (esperados)",
    ("xlsx", "banco"): "XLSX banco cargado",
    ("xlsx", "esperados"): "XLSX esperados cargado",
    ("xml", "banco"): "XML cartola cargado",
}
SCANNED = "PDF sin texto extraible (posible escaneado)"
EXTRACTED = "PDF texto extraido"
NOTHING = "PDF texto procesado sin transacciones detectadas (heuristica no encontro lineas)"
OCR_BEGUN, OCR_ENDED = "OCR iniciado", "OCR finalizado"
UNSUPPORTED = "Formato de movimientos esperados no soportado"


def events(raw: DataFrame, message: str) -> DataFrame:
    """(archivo, mensaje, detalles) of rows with a note, which is a JSON object; one for each file."""
    whole = F.when(F.col("nota") == "{}", F.lit("}")).otherwise(F.concat(F.lit(","), F.expr("substring(nota, 2)")))
    return raw.where("nota IS NOT NULL").select("archivo", F.lit(message).alias("mensaje"), F.concat(F.lit('{"archivo":'), F.to_json(F.struct("archivo")).substr(F.lit(12), F.length(F.to_json(F.struct("archivo"))) - 12), whole).alias("detalles"))


def tell(raw: DataFrame, message: str, audit: Audit | None) -> None:
    """Write the events of all files in order of name, one at a time."""
    if audit is not None:
        for r in events(raw, message).orderBy("archivo").toLocalIterator():
            audit("ingestion", r["mensaje"], json.loads(r["detalles"]))
