"""Many clients in one plan against one run for each."""

import pytest
from pyspark.sql import functions as F

from cuadra.config import Config
from cuadra.operators import many
from cuadra.operators import reconcile as rec

from .test_matching import frames, random_case


def test_clients_in_one_plan_equal_runs_of_their_own(spark):
    # the same ids, references and amounts, other rows, windows and thresholds; the third repeats expected ids
    configs = [Config("a"), Config("b", ventana_dias_monto_fecha=1, umbral_autoconcilia=0.95), Config("c", umbral_confianza_campos=0.92)]
    cases = [random_case(31), random_case(32), random_case(33, True)]
    runs = [many.Run(f"client {k}", f"run{k}", cfg) for k, cfg in enumerate(configs)]
    sides = [frames(spark, *case) for case in cases]
    joined = [None, None]
    for run, pair in zip(runs, sides, strict=True):
        for i, frame in enumerate(pair):
            one = frame.withColumn("cliente", F.lit(run.cliente))
            joined[i] = one if joined[i] is None else joined[i].unionByName(one)
    # a client without a run is left out
    joined[0] = joined[0].unionByName(sides[0][0].withColumn("cliente", F.lit("nobody")))
    got = many.reconcile(*joined, runs)
    numbered = rec.numbered(got.audit, by=("run_id",)).collect()
    found = {name: [r.asDict(recursive=True) for r in getattr(got, name).collect()] for name in ("matches", "findings")}
    for run, pair in zip(runs, sides, strict=True):
        alone = rec.reconcile(*pair, run.cfg, run.run_id)
        for name in ("matches", "findings"):
            mine = [{k: v for k, v in r.items() if k != "run_id"} for r in found[name] if r["run_id"] == run.run_id]
            assert sorted(map(repr, mine)) == sorted(repr(r.asDict(recursive=True)) for r in getattr(alone, name).collect()) and mine
        events = sorted((r["seq"], r["tipo"], r["mensaje"], r["detalles"]) for r in numbered if r["run_id"] == run.run_id)
        assert events == sorted(map(tuple, rec.numbered(alone.audit).select("seq", "tipo", "mensaje", "detalles").collect()))
    assert rec.invariant_violations(got.matches, "run_id").count() == 0
    with pytest.raises(ValueError, match="several runs"):
        many.reconcile(*joined, [runs[0], runs[0]])
