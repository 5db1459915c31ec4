"""Artifacts put together from parts, digests of folders, runs over folders and other stores."""

import hashlib
import json

import pytest
from pyspark.sql import functions as F

from cuadra.config import Config
from cuadra.errors import ContractError, IngestionError
from cuadra.operators import reconcile as rec
from cuadra.operators.hooks import Hooks
from cuadra.plans import contract, store
from cuadra.plans import run as plans
from cuadra.sources import detector

from .test_matching import frames, random_case
from .test_run import BANK, EXPECTED


def written(spark, tmp_path, seed):
    bank, expected = frames(spark, *random_case(seed))
    result = rec.reconcile(bank, expected, Config("c"), "r")
    head = {"schema_version": "1.0.0", "run_id": "r", "fingerprint": {"config_sha256": "a", "bank_sha256": "a", "expected_sha256": "a", "mask": True, "permitir_ocr": False, "modelo_interno_version": "2", "version": "0"}}
    pieces, folders, counts = plans.document_parts(result.matches, result.findings, head)
    store.Files(spark).put(tmp_path / "run.json", pieces)
    return result, head, folders, counts


def test_the_document_is_what_the_driver_would_write(spark, tmp_path):
    result, head, _, counts = written(spark, tmp_path, 21)
    matches = [r.asDict(recursive=True) for r in result.matches.orderBy("id").collect()]
    findings = [r.asDict() | {"detalles": json.loads(r["detalles"])} for r in result.findings.orderBy("id").collect()]
    whole = contract.canonical(contract.validate(head | {"matches": matches, "hallazgos": findings}))
    assert (tmp_path / "run.json").read_bytes() == whole.encode()
    assert counts == {"matches": len(matches), "hallazgos": len(findings)} and matches and findings
    assert [p.name for p in tmp_path.iterdir()] == ["run.json"]
    assert contract.faults(result.matches, result.findings) == 0
    bad = result.findings.withColumn("entidad", F.when(F.col("tipo") == "pendiente_banco", F.lit("otra")).otherwise(F.col("entidad")))
    assert contract.faults(result.matches.withColumn("estado", F.lit("")), bad) == len(matches) + bad.where("entidad = 'otra'").count()


def test_empty_lists_and_parts(spark, tmp_path):
    bank, expected = frames(spark, [], [])
    result = rec.reconcile(bank, expected, Config("c"), "r")
    head = {"schema_version": "1.0.0", "run_id": "r", "fingerprint": {"config_sha256": "a", "bank_sha256": "a", "expected_sha256": "a", "mask": True, "permitir_ocr": False, "modelo_interno_version": "2", "version": "0"}}
    pieces, _, counts = plans.document_parts(result.matches, result.findings, head)
    store.Files(spark).put(tmp_path / "run.json", pieces)
    assert contract.validate(json.loads((tmp_path / "run.json").read_text()))["matches"] == [] and counts == {"matches": 0, "hallazgos": 0}


@pytest.fixture
def small_parts(spark):
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    yield
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def test_lines_stand_in_order_over_many_parts(spark, tmp_path, small_parts):
    frame = spark.range(5000).select((F.col("id") * 7919 % 5000).alias("k"), F.col("id").cast("string").alias("t")).repartition(6)
    folder, n = store.ordered_parts(frame.select("k", F.concat("t", F.lit(":"), F.col("k").cast("string")).alias("v")), "v", "k", separator="\n")
    files = store.Files(spark)
    files.put(tmp_path / "x", ["begin\n"])
    files.put(tmp_path / "x", [(folder, 1)], keep=True)
    begin, *rest = (tmp_path / "x").read_text().split("\n")
    assert (begin, n, len(files.parts(folder)) > 1) == ("begin", 5000, True) and [int(x.split(":")[1]) for x in rest] == list(range(5000))


def test_a_failed_job_leaves_what_was_there(spark, tmp_path):
    files = store.Files(spark)
    files.put(tmp_path / "x", ["old"])
    broken = spark.range(100).select(F.col("id").alias("k"), F.expr("CASE WHEN id = 77 THEN raise_error('no') ELSE 'v' END").cast("string").alias("v"))
    with pytest.raises(Exception, match="no"):
        store.ordered_parts(broken, "v", "k", separator="\n")
    with pytest.raises(Exception, match="none"):
        files.put(tmp_path / "x", ["new", (str(tmp_path / "none"), 0)])
    assert (tmp_path / "x").read_text() == "old" and [p.name for p in tmp_path.iterdir()] == ["x"]


@pytest.fixture
def inputs(tmp_path):
    (tmp_path / "c.yaml").write_text("cliente: A\n", encoding="utf-8")
    (tmp_path / "bank").mkdir()
    for k in range(50):
        (tmp_path / "bank" / f"b{k:02d}.csv").write_text(BANK.replace("fac-1001", f"fac-{1001 + k}"), encoding="utf-8")
    (tmp_path / "e.csv").write_text(EXPECTED, encoding="utf-8")
    return {"config": tmp_path / "c.yaml", "bank": f"file://{tmp_path}/bank", "expected": f"file://{tmp_path}/e.csv"}


def test_a_run_over_a_folder_of_files(spark, inputs, tmp_path):
    out = f"file://{tmp_path}/out"
    document = plans.run(spark, **inputs, out=out, index=True, dry_run=True)
    assert document.counts["matches"] == len(document["matches"]) >= 1
    assert contract.validate(dict(document)) == json.loads((tmp_path / "out" / "run.json").read_text())
    events = [json.loads(x) for x in (tmp_path / "out" / "audit.jsonl").read_text().splitlines()]
    assert [e["seq"] for e in events] == list(range(len(events))) and sum(e["mensaje"] == "Detectado delimitador CSV" for e in events) == 50
    assert events[-1]["detalles"] == {"txs": 100, "exps": 2, "matches": document.counts["matches"], "hallazgos": document.counts["hallazgos"]}
    wanted = document["hallazgos"][3]
    assert plans.explain(out, wanted["id"], spark) == plans.explain(tmp_path / "out", wanted["id"]) == wanted
    (tmp_path / "bank" / "x.xml").write_text("<r/>")
    with pytest.raises(IngestionError, match="no soportado"):
        detector.read_bank(spark, str(tmp_path / "bank"), Config("A"))


def test_a_lookup_reads_what_may_hold_its_id(spark, tmp_path, small_parts):
    ids = spark.range(20_000).select(F.sha2(F.col("id").cast("string"), 256).alias("id"))
    matches = ids.select("id", F.lit("e").alias("estado"), F.lit(1.0).alias("score"), F.lit("r").alias("regla"), F.lit("x").alias("explicacion"), F.array("id").alias("transacciones_bancarias"), F.array("id").alias("movimientos_esperados"), F.lit(False).alias("bloqueado_por_confianza"))
    findings = ids.limit(0).select("id", *(F.lit("x").alias(c) for c in ("severidad", "tipo", "mensaje", "entidad", "entidad_id")), F.lit("{}").alias("detalles"))
    plans.write_index(matches, findings, str(tmp_path / "i"))
    wanted = ids.first()["id"]
    table = spark.read.parquet(str(tmp_path / "i"))
    spans = table.groupBy(F.input_file_name()).agg(F.min("id").alias("a"), F.max("id").alias("b")).collect()
    # ranges don't overlap, so statistics leave one file for an id
    assert len(spans) == 4 and sum(s["a"] <= wanted <= s["b"] for s in spans) == 1
    found = table.where(F.col("id") == wanted)
    assert "PushedFilters: [IsNotNull(id), EqualTo(id," in found._jdf.queryExecution().executedPlan().toString()
    assert found.count() == 1


def test_digests(spark, tmp_path):
    (tmp_path / "d" / "s").mkdir(parents=True)
    for k in range(1, 41):
        (tmp_path / "d" / ("s" if k % 3 else "") / f"f{k}").write_bytes(bytes([k]) * k)
    one = tmp_path / "d" / "f3"
    assert store.digest(spark, one) == hashlib.sha256(one.read_bytes()).hexdigest() == plans.file_hash(one)
    root = store.digest(spark, tmp_path / "d")
    each = spark.createDataFrame([(str(p.relative_to(tmp_path / "d")), hashlib.sha256(p.read_bytes()).hexdigest()) for p in (tmp_path / "d").rglob("f*")], "name string, sha string")
    assert root == store.tree(each.repartition(7)) == store.tree(each.coalesce(1)) == store.digest(spark, f"file://{tmp_path}/d/")
    # what has no bytes isn't read and doesn't count
    (tmp_path / "d" / "empty").touch()
    assert store.digest(spark, tmp_path / "d") == root and store.digest(spark, tmp_path / "d" / "empty") == hashlib.sha256(b"").hexdigest()
    one.write_bytes(b"other")
    assert store.digest(spark, tmp_path / "d") != root
    with pytest.raises(FileNotFoundError):
        store.digest(spark, tmp_path / "nothing")


def test_hooks_change_cells_and_nothing_else(spark, inputs, tmp_path):
    seen = []
    known = F.col("referencia").isNotNull()
    same = lambda b: b.withColumn("referencia", F.when(known, F.col("referencia").withField("valor", F.lit("FAC-1001"))))
    inputs |= {"bank": tmp_path / "bank" / "b07.csv"}
    run = lambda hooks, out="o": plans.run(spark, **inputs, out=tmp_path / out, dry_run=True, hooks=hooks)
    plain, hooked = run(Hooks(), "p"), run(Hooks(bank=same, finished=seen.append))
    assert [m["regla"] for m in plain["matches"]].count("ref_exacta") == 0 and [m["regla"] for m in hooked["matches"]].count("ref_exacta") == 1
    assert seen == [str(tmp_path / "o")]
    for bad, text in ((lambda b: b.drop("banco"), "columnas"), (lambda b: b.limit(1), "filas"), (lambda b: b.union(b), "filas")):
        with pytest.raises(ContractError, match=text):
            run(Hooks(bank=bad))
