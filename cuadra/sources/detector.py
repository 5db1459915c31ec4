"""Choice of a reader by suffix."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import Config
from ..errors import IngestionError
from ..storage import is_folder
from . import limits, notes, pdf, tabular, xml

BANK_SUFFIXES, EXPECTED_SUFFIXES = {".csv", ".xlsx", ".xml", ".pdf"}, {".csv", ".xlsx"}


def suffix_of(path: str) -> str:
    name = str(path).rsplit("/", 1)[-1]
    return "." + name.rsplit(".", 1)[-1].lower() if "." in name else ""


def kind_of(spark: SparkSession, path: str, known: set[str]) -> str:
    """The suffix of a file, or the one that all files of a folder share; a folder of several kinds has none."""
    suffix = suffix_of(path)
    if suffix in known or not is_folder(spark, path):
        return suffix
    name = F.element_at(F.split("path", "/"), -1)
    found = spark.read.format("binaryFile").load(path).select(F.lower(F.regexp_extract(name, r"\.[^.]*$", 0)).alias("s")).distinct().limit(2).collect()
    return found[0]["s"] if len(found) == 1 else ""


def read_bank(spark: SparkSession, path: str, cfg: Config, extract: pdf.Extractor = pdf.default_extractor, recognize: pdf.Extractor | None = None, audit: notes.Audit | None = None) -> DataFrame:
    """A statement of any supported format. A PDF without text is recognized only if the configuration allows it."""
    suffix = kind_of(spark, path, BANK_SUFFIXES)
    if suffix not in BANK_SUFFIXES:
        raise IngestionError(f"Formato banco no soportado: {suffix or '(sin sufijo)'}")
    limits.check_size(spark, path, cfg, f"{suffix[1:].upper()} banco")
    if suffix == ".xml":
        return xml.read_bank(spark, path, cfg, audit)
    if suffix != ".pdf":
        return tabular.read_bank(spark, path, cfg, suffix[1:], audit)
    rows, scanned = pdf.read_text(spark, path, cfg, extract, audit)
    if not scanned:
        return rows
    if not cfg.permitir_ocr:
        raise IngestionError("PDF sin texto extraible y OCR no habilitado.")
    return pdf.read_ocr(spark, path, cfg, recognize, audit)


def read_expected(spark: SparkSession, path: str, cfg: Config, audit: notes.Audit | None = None) -> DataFrame:
    suffix = kind_of(spark, path, EXPECTED_SUFFIXES)
    if suffix not in EXPECTED_SUFFIXES:
        if audit is not None:
            audit("ingestion", notes.UNSUPPORTED, {"archivo": path.rsplit("/", 1)[-1]})
        raise IngestionError(f"Formato esperados no soportado: {suffix or '(sin sufijo)'}")
    limits.check_size(spark, path, cfg, f"{suffix[1:].upper()} esperados")
    return tabular.read_expected(spark, path, cfg, suffix[1:], audit)
