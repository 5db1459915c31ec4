"""Amounts, dates, texts, references and currencies as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: White space: Unicode's, and the four separators U+001C to U+001F.
WS = r"(?U)[\s\x{1C}-\x{1F}]"


def _let(value: Column, body) -> Column:
    """Evaluate `value` once per row for a body that uses it several times."""
    return F.transform(F.array(value), body)[0]


def strip(c: Column) -> Column:
    """Without white space at either end; null counts as empty."""
    # most cells have none at all
    return F.when(c.rlike(r"\A[!-~]*\z"), c).otherwise(F.regexp_replace(F.coalesce(c, F.lit("")), rf"{WS}+\z|\A{WS}+", ""))


def norm_text(c: Column) -> Column:
    """Stripped, and runs of white space as one space."""
    return F.trim(F.regexp_replace(F.coalesce(c, F.lit("")), f"{WS}+", " "))


def norm_reference(c: Column) -> Column:
    """Without any white space, in capitals."""
    return F.upper(F.regexp_replace(F.coalesce(c, F.lit("")), f"{WS}+", ""))


def norm_currency(c: Column, default: str | None = None) -> Column:
    """Stripped, in capitals; blank takes the default. Anything but three capital letters is null."""

    def checked(code: Column) -> Column:
        return F.when(code.rlike(r"\A[A-Z]{3}\z"), code)

    def chosen(code: Column) -> Column:
        return F.when(code == "", checked(F.lit(default))).otherwise(checked(code)) if default else checked(code)

    return _let(F.upper(norm_text(c)), chosen)


def _amount_digits(c: Column) -> Column:
    """The amount as sign, digits and at most one point, or null. Of two kinds of separators the comma is
    the decimal one; one kind alone separates thousands. A backslash is kept, and then is no number."""
    number = r"\A-?(?:[0-9]+(?:\.[0-9]*)?|\.[0-9]+)\z"

    def joined(t: Column) -> Column:
        both = F.contains(t, F.lit(",")) & F.contains(t, F.lit("."))
        return F.when(both, F.translate(t, ",.", ".")).otherwise(F.translate(t, ",.", ""))

    kept = F.regexp_replace(strip(c), r"[^0-9,\\.\-]", "")
    return _let(_let(kept, joined), lambda t: F.when(t.rlike(number), t))


def _value(t: Column) -> Column:
    """The whole amount of what `_amount_digits` leaves."""
    rest = F.regexp_extract(t, r"\.([0-9]*)\z", 1)

    def signed(whole: Column) -> Column:
        n = F.when(whole == "", F.lit("0")).otherwise(whole).try_cast("decimal(38,0)")
        odd = F.substring(whole, -1, 1).isin("1", "3", "5", "7", "9")
        up = rest.rlike(r"\A(?:[6-9]|5[0-9]*[1-9])") | (rest.rlike(r"\A50*\z") & odd)
        n = n + F.when(up, 1).otherwise(0)
        n = n * F.when(F.startswith(t, F.lit("-")), -1).otherwise(1)
        return F.when(F.length(whole) <= 28, n.cast("decimal(38,0)"))

    # most amounts are whole and fit a long
    small = F.when(t.rlike(r"\A-?[0-9]{1,18}\z"), t.try_cast("long").cast("decimal(38,0)"))
    return F.coalesce(small, _let(F.regexp_extract(t, r"\A-?0*([0-9]*)", 1), signed))


def amounts(c: Column) -> Column:
    """`amount` and `amount_text` of a cell as one struct, (valor, texto), worked out together."""

    def both(t: Column) -> Column:
        return _let(_value(t), lambda n: F.struct(n.alias("valor"), F.when((n == 0) & F.startswith(t, F.lit("-")), F.lit("-0")).otherwise(n.cast("string")).alias("texto")))

    return _let(_amount_digits(c), both)


def amount(c: Column) -> Column:
    """Text to a whole amount, halves to even; null if it is none or has more than 28 digits."""
    return _let(_amount_digits(c), _value)


def amount_text(c: Column) -> Column:
    """The amount as it enters identities: like `amount`, but a negative zero keeps its sign."""
    return amounts(c)["texto"]


def date(c: Column) -> Column:
    """dd-mm-yyyy, dd/mm/yyyy, yyyy-mm-dd, dd-mm-yy or dd/mm/yy; null if it is none of them.

    Two-digit years from 69 on are of the last century. Years below 100 written with four digits are of this one.
    """
    dmy, ymd = r"\A([0-9]{1,2})([-/])([0-9]{1,2})\2([0-9]{4}|[0-9]{2})\z", r"\A([0-9]{4})-([0-9]{1,2})-([0-9]{1,2})\z"

    def parts(t: Column) -> Column:
        # day, month, year
        return F.when(t.rlike(dmy), F.split(t, "[-/]")).when(t.rlike(ymd), F.reverse(F.split(t, "-")))

    def built(p: Column) -> Column:
        own = F.get(p, F.lit(2))
        n = own.try_cast("int")
        year = F.when(F.length(own) == 2, n + F.when(n >= 69, 1900).otherwise(2000)).when(n == 0, F.lit(None)).when(n < 100, n + 2000).otherwise(n)
        # always of the form yyyy-mm-dd, for which a cast is several times cheaper than a format
        return F.concat(F.lpad(year.cast("string"), 4, "0"), F.lit("-"), F.lpad(F.get(p, F.lit(1)), 2, "0"), F.lit("-"), F.lpad(F.get(p, F.lit(0)), 2, "0")).try_cast("date")

    return _let(_let(strip(c), parts), lambda p: F.when(p.isNotNull(), built(p)))
