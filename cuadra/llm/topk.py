"""Exact top-k search as a Voronoi kNN join.

Vectors are grouped by their nearest pivot. From each group's size and radius follow bounds on every score
in it, so a query is sent only to groups that may hold one of its k best, and only data that some query
needs is copied. Groups and queries are cut into blocks of bounded size; each pair of blocks is solved on
its own and the partial lists are merged.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ._common import columns, cut, few, table

#: Pivots: the square root of the rows, so that groups and their number grow alike, within these bounds.
PIVOTS = (64, 1024)
#: Rows of a data block and of a query block.
BLOCK, QUERY_BLOCK = 8192, 2048
SCALE = 256


def _matrix(lists, dim: int) -> np.ndarray:
    flat = np.concatenate([np.asarray(x, dtype=np.int64) for x in lists]) if len(lists) else np.zeros(0, np.int64)
    return flat.reshape(-1, dim)


def _products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact integer products: by floating point where every partial sum fits 53 bits; what no long holds is the nearest long."""
    most = float(np.abs(a.astype(np.float64)).max(initial=0)) * float(np.abs(b.astype(np.float64)).max(initial=0)) * a.shape[1]
    if most < 2**53:
        return (a.astype(np.float64) @ b.astype(np.float64).T).astype(np.int64)
    if most < 2**62:
        return a @ b.T
    return np.clip(a.astype(object) @ b.T.astype(object), -(2**63), 2**63 - 1).astype(np.int64)


def best(scores: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Positions of the k highest scores, ties to the smaller id; ids ascend."""
    if len(scores) > 4 * k:
        at = np.nonzero(scores >= np.partition(scores, len(scores) - k)[len(scores) - k])[0]
        return at[np.argsort(-scores[at], kind="stable")[:k]]
    return np.argsort(-scores, kind="stable")[:k]


def quantized(vectors: DataFrame, scale: int = SCALE) -> DataFrame:
    """vec_id and v = floor(scale * x), for rows with an id whose components are all finite; what no long holds is the nearest long."""
    x = columns(vectors, vec_id="long", embedding="array<double>")
    fine = F.forall("embedding", lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < F.lit(float("inf"))))
    x = x.where(F.col("vec_id").isNotNull() & F.col("embedding").isNotNull()).where(fine & (F.size("embedding") > 0))
    return x.select("vec_id", F.transform("embedding", lambda c: F.floor(c * scale)).alias("v"))


def search(vectors: DataFrame, is_query, k: int = 5, pivots: int | None = None) -> DataFrame:
    """The k rows with the highest inner product for each query, which is a row where `is_query` holds.

    `vectors` has vec_id and v (array<long>), no nulls. Candidates are all rows with another id. Vectors
    shorter than the longest count as filled up with zeros. Of several rows with one id that is a query,
    the smallest vector asks; as candidates each counts. Without queries or candidates there are no rows.
    Scores that no long holds become the nearest long and tie there. `pivots` is the square root of the
    number of rows unless given.
    """
    spark = vectors.sparkSession
    out = "query_id long, vec_id long, score long"
    dim, n = vectors.agg(F.max(F.size("v")), F.count("*")).first()
    if dim is None:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    full = vectors.select("vec_id", F.concat("v", F.array_repeat(F.lit(0).cast("long"), F.lit(dim) - F.size("v"))).alias("v"))
    pivots = pivots or min(max(PIVOTS[0], math.isqrt(n)), PIVOTS[1])
    # bounded: `pivots` rows, those with the lowest hashes of a sample of about 32 times as many
    hashed = full.select("v", F.xxhash64("v").alias("h"))
    drawn = hashed.where(F.pmod("h", F.lit(2**40)) < F.lit(int(2**40 * min(1.0, 32 * pivots / n))))
    lowest = drawn.dropDuplicates(["h"]).orderBy(F.pmod("h", F.lit(2**40)), "h").limit(pivots).collect()
    # very few distinct vectors may leave the sample empty; any row serves then
    centre = _matrix([r[0] for r in lowest or hashed.limit(1).collect()], dim).astype(np.float64)

    def assign(batches):
        norm = (centre**2).sum(1)
        for batch in batches:
            v = np.asarray(batch.column("v").flatten()).reshape(-1, dim).astype(np.float64)
            near = np.argmin(norm - 2 * (v @ centre.T), axis=1)
            far = np.sqrt(((v - centre[near]) ** 2).sum(1))
            yield pa.RecordBatch.from_arrays([batch.column("vec_id"), batch.column("v"), pa.array(near.astype(np.int32)), pa.array(far)], names=["vec_id", "v", "cell", "far"])

    placed = cut(full.mapInArrow(assign, "vec_id long, v array<long>, cell int, far double"))
    cells = {r["cell"]: (r["n"], r["radius"]) for r in placed.groupBy("cell").agg(F.count("*").alias("n"), F.max("far").alias("radius")).collect()}
    # `own`: rows with a query's id, none of which is a candidate
    queries = placed.groupBy("vec_id").agg(F.min(F.when(is_query, F.col("v"))).alias("v"), F.count("*").alias("own")).where("v IS NOT NULL")
    n_queries = queries.count()
    order = sorted(cells)
    sizes, radii = np.array([cells[c][0] for c in order]), np.array([cells[c][1] for c in order]) * (1 + 1e-9) + 1e-6
    points = centre[order]

    def route(batches):
        for batch in batches:
            q = np.asarray(batch.column("v").flatten()).reshape(-1, dim).astype(np.float64)
            mid, reach = q @ points.T, np.linalg.norm(q, axis=1, keepdims=True) * radii
            slack = 1e-9 * (np.abs(mid) + reach) + 1e-6
            low, high = mid - reach - slack, mid + reach + slack
            by = np.argsort(-low, axis=1)
            # k rows besides those that may be the query's own score at least this
            need = k + batch.column("own").to_numpy()
            enough = (np.cumsum(sizes[by], axis=1) >= need[:, None]).argmax(1)
            bound = np.where(sizes.sum() >= need, np.take_along_axis(low, by, 1)[np.arange(len(q)), enough], -np.inf)
            row, cell = np.nonzero(high >= bound[:, None])
            yield pa.RecordBatch.from_arrays([batch.column("vec_id").take(pa.array(row)), batch.column("v").take(pa.array(row)), pa.array(np.array(order, np.int32)[cell])], names=["query_id", "q", "cell"])

    # one number for each of at most `pivots` cells
    blocks = F.create_map(*[F.lit(x) for c in order for x in (c, -(-cells[c][0] // BLOCK))])
    q_blocks = max(1, -(-n_queries // QUERY_BLOCK))
    asked = queries.mapInArrow(route, "query_id long, q array<long>, cell int").withColumn("q_block", F.pmod(F.xxhash64("query_id"), F.lit(q_blocks)).cast("int"))
    asked = cut(asked)
    # a row for each cell and block of queries: a hot cell is not shuffled as long as these are few
    needed = few(cut(asked.select(F.col("cell").alias("needed_cell"), F.col("q_block").alias("needed_by")).distinct()))
    asked = asked.withColumn("block", F.explode(F.sequence(F.lit(0), blocks[F.col("cell")] - 1)))
    data = placed.select("vec_id", "v", "cell", F.pmod(F.xxhash64("vec_id", "v"), blocks[F.col("cell")]).cast("int").alias("part"))
    data = data.join(needed, F.col("cell") == F.col("needed_cell")).drop("cell")

    def solve(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        if not len(left) or not len(right):
            return pd.DataFrame({"query_id": [], "vec_id": [], "score": []}, dtype=np.int64)
        right = right.sort_values("vec_id", kind="stable")
        ids, x = right["vec_id"].to_numpy(), _matrix(right["v"].to_list(), dim)
        asks, q = left["query_id"].to_numpy(), _matrix(left["q"].to_list(), dim)
        found = []
        for start in range(0, len(q), 256):
            scores = _products(q[start : start + 256], x)
            for i, row in enumerate(scores):
                own = ids != asks[start + i]
                at = np.nonzero(own)[0][best(row[own], ids[own], k)]
                found.append((np.full(len(at), asks[start + i]), ids[at], row[at]))
        return pd.DataFrame({name: np.concatenate([f[j] for f in found]) for j, name in enumerate(("query_id", "vec_id", "score"))})

    asked_by = asked.groupBy("cell", "block", "q_block")
    partial = asked_by.cogroup(data.groupBy("needed_cell", "part", "needed_by")).applyInPandas(solve, out)
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return partial.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


def op5_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search(quantized(table(spark, sf_dir, "embeddings")), F.col("vec_id") % 50 == 0)


OP5_SQL = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)::BIGINT) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
e AS (SELECT vec_id, i, v[i] AS x FROM v, unnest(range(1, len(v) + 1)) t(i)),
s AS (
  SELECT q.vec_id AS query_id, c.vec_id, sum(q.x * c.x)::BIGINT AS score FROM e q JOIN e c ON q.i = c.i
  WHERE q.vec_id % 50 = 0 AND c.vec_id <> q.vec_id GROUP BY ALL),
r AS (SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INTEGER AS rank, vec_id, score FROM s)
SELECT * FROM r WHERE rank <= 5
"""
