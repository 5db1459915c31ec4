"""Reconcile each micro-batch of bank rows as a run of its own.

Greedy order is global within a run, so batches are never matched incrementally: each batch is a whole run
against the expected rows, with the batch in its run id. A batch that breaks an invariant fails before it writes.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from ..config import Config
from ..errors import ContractError
from ..operators.reconcile import invariant_violations, numbered, reconcile


def reconcile_arrivals(bank: DataFrame, expected: DataFrame, cfg: Config, run_id: str, out: str, checkpoint: str) -> StreamingQuery:
    """Write matches, findings and numbered audit events of every batch as Parquet under `out`, once each."""

    def one(batch: DataFrame, k: int) -> None:
        batch = batch.persist()
        try:
            result = reconcile(batch, expected, cfg, f"{run_id}-{k}")
            if not invariant_violations(result.matches).isEmpty():
                raise ContractError("Invariante violada: id repetido en matches.", {"batch": k})
            result.matches.write.mode("overwrite").parquet(f"{out}/matches/batch={k}")
            result.findings.write.mode("overwrite").parquet(f"{out}/hallazgos/batch={k}")
            numbered(result.audit).write.mode("overwrite").parquet(f"{out}/auditoria/batch={k}")
        finally:
            batch.unpersist()

    return bank.writeStream.foreachBatch(one).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
