import datetime as dt
import hashlib
import json
import random
import re

import pytest
from pyspark.sql import functions as F

from cuadra.functions import identity, mask, parse


def column(spark, values, expr):
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v string")
    return [r[0] for r in rows.orderBy("i").select(expr(F.col("v"))).collect()]


AMOUNTS = [
    ("150000", 150000), ("150.000", 150000), ("$ 150.000", 150000), ("-250000", -250000), ("1,234,567", 1234567), ("1.234.567", 1234567), ("1.234,00", 1234),
    ("150.5", 1505), ("1,5", 15), ("1,234.56", 1), ("(1.000)", 1000), ("1\\0", None), ("", None), (None, None), ("abc", None), ("1-2", None),
    ("1.0,5", 10), ("1.1,5", 12), ("1.2,51", 13), ("-1.0,5", -10), ("9" * 28, int("9" * 28)), ("9" * 29, None), ("1.2,3,4", None),
]


def test_amounts(spark):
    assert [None if x is None else int(x) for x in column(spark, [a for a, _ in AMOUNTS], parse.amount)] == [b for _, b in AMOUNTS]


def test_negative_zero_keeps_its_sign_in_text(spark):
    assert column(spark, ["-0", "0", "-.0,4", "-5"], parse.amount_text) == ["-0", "0", "-0", "-5"]


DATES = ["05/01/2026", "05-01-2026", "2026-01-05", "05/01/26", "5-1-26", "01/01/69", "31/12/68", "01/01/0026", "31/02/2026", "05/01-2026", "", " 05/01/2026 ", "01/01/99", "29/02/2024", "00/01/2024", "1/13/2024", "01/01/0000"]


def test_dates(spark):
    def want(t):
        for f in ("%d-%m-%Y", "%d/%m/%Y", "%Y-%m-%d", "%d-%m-%y", "%d/%m/%y"):
            try:
                d = dt.datetime.strptime(t.strip(), f)
                return dt.date(d.year + 2000 if d.year < 100 else d.year, d.month, d.day)
            except ValueError:
                pass
        return None

    assert column(spark, DATES, parse.date) == [want(t) for t in DATES]


def test_texts_references_currencies(spark):
    raw = ["  a \t b  c\x1cd ", None, "", "fac - 1\n"]
    assert column(spark, raw, parse.norm_text) == ["a b c d", "", "", "fac - 1"]
    assert column(spark, raw, parse.norm_reference) == ["ABCD", "", "", "FAC-1"]
    assert column(spark, [" clp ", "", "US", "usd1", None], lambda c: parse.norm_currency(c, "CLP")) == ["CLP", "CLP", None, None, "CLP"]


def test_masks(spark):
    rng = random.Random(1)
    texts = ["".join(rng.choice(["12", "3456789", "-", "k", "K", " ", "x", "0123456789", "7", "."]) for _ in range(12)) for _ in range(300)]

    def want(t):
        t = re.sub(r"\b\d{7,12}-[0-9kK]\b", lambda m: "***" + m[0][-3:], t)
        return re.sub(r"\b\d{10,20}\b", lambda m: "*" * (len(m[0]) - 4) + m[0][-4:], t)

    assert column(spark, texts, mask.mask_text) == [want(t) for t in texts]
    assert column(spark, ["1 234 567", "123", None], mask.mask_account) == ["***4567", "****", "****"]
    assert column(spark, ["12345-6", "12", None], mask.mask_rut) == ["***5-6", "***", "***"]
    assert column(spark, ["=1", "+1", "-1", "@a", "a", "", None], mask.safe_cell) == ["'=1", "'+1", "'-1", "'@a", "a", "", ""]


def test_json_strings_and_ids(spark):
    values = ["plain", 'q"\\', "á\u007f\x01", "🦙\n\t", None, ""]
    assert column(spark, values, identity.json_string) == [json.dumps(v) for v in values]
    body = {"run_id": "r", "tx": ["a"], "exp": ["é"], "r": "ref_exacta"}
    want = "M-" + hashlib.sha256(json.dumps(body, sort_keys=True, separators=(",", ":")).encode()).hexdigest()[:14]
    row = spark.range(1).select(identity.match_id(F.lit("r"), F.array(F.lit("a")), F.array(F.lit("é")), F.lit("ref_exacta"))).first()
    assert row[0] == want


@pytest.mark.parametrize("value", ["0", "-1", "x"])
def test_config_is_checked(tmp_path, value):
    from cuadra.config import load
    from cuadra.errors import ConfigError

    path = tmp_path / "c.yaml"
    path.write_text(f"cliente: A\nlimites_ingesta:\n  max_pdf_pages: {value}\n")
    with pytest.raises(ConfigError):
        load(path)
