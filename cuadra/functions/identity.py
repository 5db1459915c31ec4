"""Content identities: SHA-256 over JSON with sorted keys, ASCII only and no spaces."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def json_string(c: Column) -> Column:
    """A JSON string literal in ASCII; null is `null`."""

    def unit(ch: Column) -> Column:
        wide = F.lower(F.hex(F.encode(ch, "UTF-16BE")))
        escaped = F.when(F.length(wide) == 4, F.concat(F.lit("\\u"), wide)).otherwise(F.concat(F.lit("\\u"), F.substring(wide, 1, 4), F.lit("\\u"), F.substring(wide, 5, 4)))
        for raw, text in (('"', '\\"'), ("\\", "\\\\"), ("\n", "\\n"), ("\r", "\\r"), ("\t", "\\t"), ("\b", "\\b"), ("\f", "\\f")):
            escaped = F.when(ch == raw, F.lit(text)).otherwise(escaped)
        return F.when(ch.rlike(r'\A[ !#-\[\]-~]\z'), ch).otherwise(escaped)

    plain = c.rlike(r'\A[ !#-\[\]-~]*\z')
    body = F.when(plain, c).otherwise(F.array_join(F.transform(F.split(c, ""), unit), ""))
    return F.when(c.isNull(), F.lit("null")).otherwise(F.concat(F.lit('"'), body, F.lit('"')))


def json_list(c: Column) -> Column:
    """An array of strings as a JSON list."""
    return F.concat(F.lit("["), F.array_join(F.transform(c, json_string), ","), F.lit("]"))


def json_object(**values: Column) -> Column:
    """A JSON object of values that are JSON already; keys are put in order."""
    parts: list[Column] = []
    for k, key in enumerate(sorted(values)):
        parts += [F.lit(f'{"," if k else "{"}"{key}":'), values[key]]
    return F.concat(*parts, F.lit("}")) if parts else F.lit("{}")


def short_hash(prefix: str, length: int, body: Column) -> Column:
    return F.concat(F.lit(prefix), F.substring(F.sha2(body, 256), 1, length))


def match_id(run_id: Column, tx: Column, exp: Column, rule: Column) -> Column:
    body = json_object(run_id=json_string(run_id), tx=json_list(F.array_sort(tx)), exp=json_list(F.array_sort(exp)), r=json_string(rule))
    return short_hash("M-", 14, body)


def finding_id(run_id: Column, kind: Column, entity: Column, entity_id: Column, extra: Column) -> Column:
    """`extra` is a JSON object."""
    body = json_object(run_id=json_string(run_id), tipo=json_string(kind), ent=json_string(entity), id=json_string(entity_id), x=extra)
    return short_hash("H-", 14, body)


def row_id(prefix: str, file: Column, data: Column, *, row: Column | None = None, idx: Column | None = None) -> Column:
    """Identity of a source row: file name, place (`row` in tables, `idx` elsewhere) and JSON of what it holds."""
    place = {"row": row.cast("string")} if row is not None else {"idx": idx.cast("string")}
    return short_hash(prefix, 12, json_object(file=json_string(file), data=data, **place))
