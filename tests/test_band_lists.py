"""Pairs by amount and days: transactions meet lists of expected rows, whatever their length."""

import datetime as dt
import random
from decimal import Decimal

import pytest

from cuadra.operators import matching


@pytest.mark.parametrize("window", [0, 3])
@pytest.mark.parametrize("most", [2, 4096])
def test_pairs_come_from_lists_of_a_day(spark, window, most):
    rng = random.Random(7)
    day = lambda: rng.choice([None, *(dt.date(2026, 1, 1) + dt.timedelta(k) for k in range(9))])
    side = lambda n: [(f"{k % (n - 3):03d}", rng.choice([None, Decimal(5), Decimal(5), Decimal(7)]), day(), k) for k in range(n)]
    txs, exps = side(90), side(80)
    tx = spark.createDataFrame(txs, "tx_id string, tx_monto decimal(38,0), tx_fecha date, otra int")
    exp = spark.createDataFrame(exps, "exp_id string, exp_monto decimal(38,0), exp_fecha date, nada int")
    pairs = matching.band_candidates(tx, exp, window, most)
    want = sorted((t[3], e[0], abs((t[2] - e[2]).days)) for t in txs for e in exps if t[1] and t[1] == e[1] and t[2] and e[2] and abs((t[2] - e[2]).days) <= window)
    assert sorted((r["otra"], r["exp_id"], r["delta"]) for r in pairs.collect()) == want
    assert all(r["tx_monto"] == r["exp_monto"] for r in pairs.collect())
    # ids are opened after the join, which meets a list of them at a time
    plan = str(pairs._jdf.queryExecution().optimizedPlan())
    assert plan.index("explode(exp_ids") < plan.index("Join")
