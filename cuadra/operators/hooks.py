"""Optional transforms of a run's relations, off by default: normalization by bank, hints in references, and the like.

A hook is a function from DataFrame to DataFrame. It may change what rows hold but neither their columns nor which rows
there are; a run fails closed where one does. Hooks run after normalization and before matching.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..errors import ContractError
from ..storage import cut

Hook = Callable[[DataFrame], DataFrame]


@dataclass(frozen=True)
class Hooks:
    bank: Hook | None = None
    expected: Hook | None = None
    #: called with the folder of a finished run, for reports of one's own
    finished: Callable[[str], None] | None = None


def applied(frame: DataFrame, hook: Hook | None, side: str) -> DataFrame:
    """The frame after its hook, written; ids and columns must be what they were."""
    if hook is None:
        return frame
    after = frame.transform(hook)
    if [(f.name, f.dataType.simpleString()) for f in after.schema] != [(f.name, f.dataType.simpleString()) for f in frame.schema]:
        raise ContractError(f"El hook de {side} cambia las columnas.")
    after = cut(after)
    counted = frame.groupBy("id").agg(F.count("*").alias("n")).join(after.groupBy(F.col("id").alias("id_")).agg(F.count("*").alias("n_")), F.col("id") == F.col("id_"), "full")
    if not counted.where(~F.col("n").eqNullSafe(F.col("n_"))).isEmpty():
        raise ContractError(f"El hook de {side} agrega o quita filas.")
    return after
