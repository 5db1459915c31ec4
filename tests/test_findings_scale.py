"""What findings, audit and report cost: checked on plans, not on clocks."""

from pyspark.sql import functions as F

from cuadra.config import Config
from cuadra.operators import matching
from cuadra.operators import reconcile as rec
from cuadra.plans import report

from .test_matching import frames, random_case


def _plan(frame) -> str:
    return frame._jdf.queryExecution().optimizedPlan().toString()


def test_sets_are_made_for_findings_alone_and_details_are_not_parsed(spark):
    bank, expected = frames(spark, *random_case(41))
    cfg = Config("a")
    result = rec.reconcile(bank, expected, cfg, "r0")
    assert result.matches.count() and "_seen" not in vars(result)
    # references and expected ids of events come from columns, ids of ambiguous findings from what was written
    assert "get_json_object" not in _plan(result.audit) and result.findings.columns[-1] == "detalles"
    told = {r["entidad_id"]: r["id"] for r in result.findings.where("tipo = 'ambiguedad_referencia'").collect()}
    events = result.audit.where("mensaje = 'Ambiguedad por referencia'").select("clave", F.get_json_object("detalles", "$.hallazgo_id").alias("id"))
    assert {r["clave"]: r["id"] for r in events.collect()} == told
    tables = report.tables(bank, expected, result.matches, result.findings, cfg, "r0", True)
    assert "Sort" not in _plan(tables["Hallazgos"]) and "Sort" in _plan(report.in_order(tables)["Hallazgos"])


def test_rows_of_a_set_lie_together_in_many_partitions(spark):
    rows = spark.range(4000).select((F.col("id") % 8).cast("string").alias("conjunto"), "id")
    spread = matching.by_set(rows)
    assert spread.rdd.getNumPartitions() == matching.SPREAD * 4
    places = spread.select("conjunto", F.spark_partition_id().alias("p")).distinct()
    assert places.count() == 8


def test_ambiguous_findings_are_not_put_together_in_one_task(spark):
    tx = [(f"TX-{k:03}", f"REF-{k % 20}", 100 + k % 20, 0) for k in range(60)]
    exp = [(f"EX-{k:03}", f"REF-{k % 20}", 100 + k % 20, 100) for k in range(60)]
    result = rec.reconcile(*frames(spark, tx, exp), Config("a"), "r0")
    vague = result.findings.where("tipo = 'ambiguedad_referencia'")
    assert vague.count() == 60
    assert vague.select(F.spark_partition_id().alias("p"), "id").groupBy("p").count().count() == 4
