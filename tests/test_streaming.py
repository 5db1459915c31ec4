from cuadra.config import Config
from cuadra.operators.model import BANK
from cuadra.streaming.arrivals import reconcile_arrivals

from .test_matching import frames


def test_each_batch_is_a_run(spark, tmp_path):
    bank, expected = frames(spark, [("T1", "A", 10, 0)], [("E1", "A", 10, 0)])
    bank.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(BANK).parquet(str(tmp_path / "in"))
    reconcile_arrivals(stream, expected, Config("c"), "r", str(tmp_path / "out"), str(tmp_path / "ck")).awaitTermination()
    assert spark.read.parquet(str(tmp_path / "out/matches")).count() == 1
    events = spark.read.parquet(str(tmp_path / "out/auditoria")).orderBy("seq").collect()
    assert [(r["seq"], r["tipo"]) for r in events] == [(0, "match"), (1, "matching")]
