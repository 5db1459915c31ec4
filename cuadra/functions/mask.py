"""Masks and spreadsheet safety as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .parse import WS, strip


def mask_rut(c: Column) -> Column:
    """Three stars and the last three characters."""
    t = strip(c)
    return F.when(F.length(t) <= 3, F.lit("***")).otherwise(F.concat(F.lit("***"), F.substring(t, -3, 3)))


def mask_account(c: Column) -> Column:
    """Stars for all but the last four characters, white space left out."""
    t = F.regexp_replace(F.coalesce(c, F.lit("")), f"{WS}+", "")
    return F.when(F.length(t) <= 4, F.lit("****")).otherwise(F.concat(F.repeat(F.lit("*"), F.length(t) - 4), F.substring(t, -4, 4)))


def mask_text(c: Column) -> Column:
    """Mask national ids (7 to 12 digits, dash, check digit), then runs of 10 to 20 digits but for their last four."""
    out = F.regexp_replace(c, r"\b[0-9]{6,11}([0-9]-[0-9kK])\b", "***$1")
    # one short pattern for each length of run that the text has; most texts have none
    found = F.regexp_extract_all(out, F.lit(r"\b[0-9]{10,20}\b"), F.lit(0))
    starred = lambda t, n: F.regexp_replace(t, F.concat(F.lit(r"\b[0-9]{"), n.cast("string"), F.lit(r"}([0-9]{4})\b")), F.concat(F.repeat(F.lit("*"), n), F.lit("$1")))
    return F.aggregate(F.array_distinct(F.transform(found, lambda r: F.length(r) - 4)), out, starred)


def safe_cell(c: Column) -> Column:
    """An apostrophe before what a spreadsheet would take for a formula."""
    return F.when(F.substring(c, 1, 1).isin("=", "+", "-", "@"), F.concat(F.lit("'"), c)).otherwise(F.coalesce(c, F.lit("")))


def report_cell(c: Column, mask: bool) -> Column:
    """A text cell of the report: masked if asked for, always safe; null is empty."""
    c = F.coalesce(c, F.lit(""))
    return safe_cell(mask_text(c) if mask else c)
