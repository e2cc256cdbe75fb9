"""Vector columns: which rows take part, repeated vectors, numpy blocks, and exact scores of query slabs."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def usable(rows: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """(vec_id, vector) of rows with an id and a vector of finite components; the type of the components is kept.

    Only vectors of the most frequent length take part (of equally frequent lengths, the larger).
    """
    good = rows.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).alias("vector"))
    good = good.where("vec_id IS NOT NULL AND vector IS NOT NULL AND size(vector) > 0").where(~F.exists("vector", lambda x: x.isNull() | F.isnan(x.cast("double")) | (F.abs(x.cast("double")) == float("inf"))))
    size = good.groupBy(F.size("vector").alias("d")).count().orderBy(F.desc("count"), F.desc("d")).first()
    return good.where(F.size("vector") == (size["d"] if size else 0))


def candidates(good: DataFrame, k: int) -> DataFrame:
    """vec_id, vector: each (id, vector) once, and of each vector only the k + 1 least ids.

    No other id with that vector can be among the k best of any query, since ties go to the smaller id. So a vector that
    a third of all rows share becomes k + 1 candidates; the window's limit drops the rest before the shuffle.
    """
    least = Window.partitionBy("vector").orderBy("vec_id")
    kept = good.withColumn("_rank", F.dense_rank().over(least)).where(F.col("_rank") <= k + 1).drop("_rank")
    return kept.dropDuplicates(["vector", "vec_id"])


def queries(good: DataFrame, is_query: Column) -> DataFrame:
    """vec_id, vector of the queries, repeated rows once."""
    return good.where(is_query).dropDuplicates(["vec_id", "vector"])


def block(column: pa.Array | pa.ChunkedArray) -> np.ndarray:
    """A column of equally long arrays as a matrix."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
        column = pa.concat_arrays(column.chunks) if isinstance(column, pa.ChunkedArray) else column
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(column), -1) if len(column) else flat.reshape(0, 0)


def ranked(pairs: DataFrame, k: int) -> DataFrame:
    """The best k of each query by (score down, vec_id up) with their ranks; an id counts with its best score.

    One exchange by query serves both the grouping and the ranks.
    """
    pairs = pairs.repartition("query_id").groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return pairs.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


def best_of(scores_of, ids: np.ndarray, rough: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Places and exact scores of one query's best k by (score down, id up); `rough` has errors below 1e-9 of the largest."""
    held = np.flatnonzero(rough > -np.inf)
    if len(held) > k:
        kth = np.partition(rough[held], len(held) - k)[len(held) - k]
        held = held[rough[held] >= kth - 1e-9 * max(1.0, float(np.abs(rough[held]).max()))]
    exact = scores_of(held)
    order = np.lexsort((ids[held], -exact))[:k]
    return held[order], exact[order]


def _compared(shared, k: int):
    def run(batches):
        query_ids, q = shared.value
        for batch in batches:
            ids, column = batch.column("vec_id").to_numpy(), batch.column("vector")
            for i in range(0, len(ids), 4096):
                x, own = block(column.slice(i, 4096)).astype(np.float64), ids[i : i + 4096]
                for j in range(0, len(q), 512):
                    rough = q[j : j + 512] @ x.T
                    rough[own[None, :] == query_ids[j : j + 512, None]] = -np.inf
                    at, scores = zip(*[best_of(lambda c: (x[c] * y).sum(axis=1), own, r, k) for y, r in zip(q[j : j + 512], rough)])  # noqa: B023
                    n = [len(a) for a in at]
                    yield pa.RecordBatch.from_arrays([pa.array(np.repeat(query_ids[j : j + 512], n)), pa.array(own[np.concatenate(at)]), pa.array(np.concatenate(scores))], names=["query_id", "vec_id", "score"])

    return run


def exact(rows: DataFrame, slab: pa.Table, k: int) -> DataFrame:
    """query_id, vec_id, score: exact k best of each block of rows for the queries of a bounded `slab`."""
    shared = rows.sparkSession.sparkContext.broadcast((slab.column("vec_id").to_numpy(), block(slab.column("vector")).astype(np.float64)))
    return rows.mapInArrow(_compared(shared, k), "query_id long, vec_id long, score double")
