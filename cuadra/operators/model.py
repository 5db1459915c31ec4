"""Relations, fields with confidence, and normalization."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..config import Config
from ..functions import parse

#: Base confidence by origin (fixed values).
BASE = {"xml": 0.95, "csv": 0.90, "xlsx": 0.90, "pdf_texto": 0.60, "pdf_ocr": 0.30, "manual": 0.50}
CONFIDENCE = "struct<score:double,nivel:string,origen:string,notas:string>"


def _field(kind: str) -> str:
    return f"struct<valor:{kind},confianza:{CONFIDENCE}>"


BANK = (
    "id string, cuenta_mask string, banco string, bloquea_autoconcilia boolean, motivo_bloqueo_autoconcilia string, "
    f"fecha_operacion {_field('date')}, fecha_contable {_field('date')}, monto {_field('decimal(38,0)')}, monto_texto string, moneda string, "
    f"descripcion {_field('string')}, referencia {_field('string')}, archivo_origen string, origen string, fila_origen long"
)
EXPECTED = f"id string, fecha {_field('date')}, monto {_field('decimal(38,0)')}, monto_texto string, moneda string, descripcion {_field('string')}, referencia {_field('string')}, tercero {_field('string')}"


def confidence(origin: str, degrade: Column | float = 0.0, notes: str | None = None) -> Column:
    """Score (base less what degrades it, within 0 and 1), level, origin and notes of a field."""
    degrade = degrade if isinstance(degrade, Column) else F.lit(float(degrade))
    score = F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.lit(BASE.get(origin, 0.50)) - degrade))
    if origin == "xml":
        level = F.lit("alta")
    elif origin == "pdf_ocr":
        level = F.lit("baja")
    elif origin == "pdf_texto":
        level = F.when(score >= 0.55, F.lit("media")).otherwise(F.lit("baja"))
    else:
        level = F.when(score >= 0.85, F.lit("alta")).when(score >= 0.55, F.lit("media")).otherwise(F.lit("baja"))
    return F.struct(score.alias("score"), level.alias("nivel"), F.lit(origin).alias("origen"), F.lit(notes).cast("string").alias("notas"))


def with_confidence(value: Column, origin: str, degrade: Column | float = 0.0, notes: str | None = None) -> Column:
    """A value with its confidence; a null value has none."""
    return F.when(value.isNotNull(), F.struct(value.alias("valor"), confidence(origin, degrade, notes).alias("confianza")))


def _rewrite(name: str, body) -> Column:
    """Change a field's value and keep its confidence; a value that becomes empty takes the field away."""
    value = body(F.col(f"{name}.valor"))
    return F.when(F.col(name).isNotNull() & (value != ""), F.col(name).withField("valor", value))


def _currency() -> Column:
    code = parse.norm_currency(F.col("moneda"))
    return F.coalesce(code, F.raise_error(F.concat(F.lit("Moneda invalida: "), F.coalesce(F.col("moneda"), F.lit("")))).cast("string"))


def normalize_bank(bank: DataFrame) -> DataFrame:
    return bank.withColumns({"moneda": _currency(), "descripcion": F.col("descripcion").withField("valor", parse.norm_text(F.col("descripcion.valor"))), "referencia": _rewrite("referencia", parse.norm_reference)})


def normalize_expected(expected: DataFrame) -> DataFrame:
    return expected.withColumns(
        {
            "moneda": _currency(),
            "descripcion": F.col("descripcion").withField("valor", parse.norm_text(F.col("descripcion.valor"))),
            "referencia": _rewrite("referencia", parse.norm_reference),
            "tercero": _rewrite("tercero", parse.norm_text),
        }
    )


def violations(bank: DataFrame, cfg: Config) -> DataFrame:
    """Rows that break the model: a block without a reason, a score outside 0..1, a bad currency."""
    fields = ["fecha_operacion", "fecha_contable", "monto", "descripcion", "referencia"]
    outside = F.lit(False)
    for f in fields:
        outside = outside | F.coalesce(~F.col(f"{f}.confianza.score").between(0.0, 1.0), F.lit(False))
    reason = F.when(F.col("bloquea_autoconcilia") & (F.coalesce(F.col("motivo_bloqueo_autoconcilia"), F.lit("")) == ""), F.lit("bloqueo sin motivo"))
    reason = F.coalesce(reason, F.when(outside, F.lit("confianza fuera de rango")), F.when(~F.col("moneda").rlike(r"\A[A-Z]{3}\z"), F.lit("moneda invalida")))
    return bank.select("id", reason.alias("motivo")).where(F.col("motivo").isNotNull())


def plain(frame: DataFrame, schema: str) -> DataFrame:
    """Cast a frame to one of the relations' schemas."""
    kinds = T._parse_datatype_string(schema)
    return frame.select(*(F.col(f.name).cast(f.dataType).alias(f.name) for f in kinds))
