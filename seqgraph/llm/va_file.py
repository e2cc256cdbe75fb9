"""Exact top-k by vector-approximation files.

Components are the integers floor(256 * x). The file of cells has one row for each block of vectors: ids and
approximations (one byte a component: the cell of a uniform grid between the component's least and greatest value over
all rows). The exact vectors are a column of their own, which the scan doesn't read.

1. scan    the cells give every inner product an upper and a lower bound; a task keeps what may still be among the k
           best of its blocks, and the k-th best lower bound over all tasks then leaves few candidates a query;
2. read    only their exact vectors, in the order of their upper bounds, until the k-th best score of the block is above
           every bound that is left.

Bounds are widened by their rounding error and scores are exact integers of any size, so the result is exact.

Queries come in slabs of at most about `slab_bytes` bytes, dealt by a hash: a slab is broadcast (its size is that
parameter's, whatever the table's), and each slab is one scan of the cells in blocks.

Defined results: vectors that are null or hold null or non-finite components, rows with a null id, and vectors whose
length isn't the most frequent one take no part. A score of a returned row beyond a long is an error.
Rows that repeat an id and its vector are one candidate; an id with several vectors counts with its best score, as
candidate and as query. Ties go to the smaller id; fewer candidates than k give fewer rows; an empty table gives none.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import vectors as v
from .common import staged
from .vectors import block

K, BLOCK, SLAB_BYTES, CELLS = 5, 4096, 32 << 20, 256
#: Queries that are compared with a block at a time.
STRIPE = 512
_RESULT = "query_id long, rank int, vec_id long, score long"
_FILE = "block long, ids binary, cells binary, exact binary"
_MAY = "query int, query_id long, vec_id long, block long, place int, bound double, slack double"


def integers(x: np.ndarray, scale: float = 256.0) -> np.ndarray:
    """floor(scale * x) as doubles, which hold these integers exactly."""
    return np.floor(scale * x.astype(np.float64))


def products(x: np.ndarray, y: np.ndarray) -> list[int] | np.ndarray:
    """Exact inner products of paired rows of whole doubles: in longs where no sum can leave them, else in Python's integers."""
    if float((np.abs(x) * np.abs(y)).sum(axis=1).max(initial=0.0)) < 2.0**62 and max(np.abs(x).max(initial=0.0), np.abs(y).max(initial=0.0)) < 2.0**62:
        return np.einsum("ij,ij->i", x.astype(np.int64), y.astype(np.int64))
    return [sum(int(a) * int(b) for a, b in zip(r, s)) for r, s in zip(x, y)]


class Grid:
    """Uniform cells between each component's least and greatest value; inner products have bounds by the cells' middles."""

    def __init__(self, least: np.ndarray, greatest: np.ndarray, cells: int):
        self.least, self.count = least, cells
        self.width = np.maximum(np.ceil((greatest - least + 1) / cells), 1.0)
        # beyond 2^53 neither widths nor middles are exact: a little more than half a cell covers that
        self.size = np.maximum(np.abs(least), np.abs(greatest)) + self.width
        self.half = self.width * (0.5 + 1e-9) + self.size * 1e-12

    def cells(self, x: np.ndarray) -> np.ndarray:
        return np.clip((x - self.least) // self.width, 0, self.count - 1).astype(np.uint8)

    def middle(self, cells: np.ndarray) -> np.ndarray:
        return self.least + cells * self.width + (self.width - 1) / 2

    def slack(self, queries: np.ndarray) -> np.ndarray:
        """How far an inner product can be from that with the middle of the cell, rounding included."""
        return np.abs(queries) @ (self.half + self.size * 1e-12)


def _file(grid: Grid, size: int):
    def run(batches):
        part, seq = TaskContext.get().partitionId(), 0
        for batch in batches:
            ids, column = batch.column("vec_id").to_numpy(), batch.column("vector")
            for i in range(0, len(ids), size):
                x = block(column.slice(i, size))
                blobs = (ids[i : i + size].astype("<i8").tobytes(), grid.cells(integers(x)).tobytes(), x.tobytes())
                yield pa.RecordBatch.from_arrays([pa.array([(part << 32) | seq], pa.int64()), *[pa.array([b], pa.binary()) for b in blobs]], names=["block", "ids", "cells", "exact"])
                seq += 1

    return run


class _Kept:
    """For each query, what may still be among the k best of the blocks seen so far."""

    def __init__(self, n: int, k: int):
        self.kth = np.full((n, k), -np.inf)
        self.found: list[np.ndarray] = []
        self.rows = 0

    def add(self, first: int, middle: np.ndarray, slack: np.ndarray, ids: np.ndarray, number: int) -> None:
        """`middle`: inner products with the cells' middles for the queries from `first` on; -inf takes no part."""
        k, n = self.kth.shape[1], len(middle)
        top = np.partition(middle, middle.shape[1] - k, axis=1)[:, -k:] if middle.shape[1] > k else middle
        mine = np.concatenate([self.kth[first : first + n], top], axis=1)
        mine = np.partition(mine, mine.shape[1] - k, axis=1)[:, -k:]
        self.kth[first : first + n] = mine
        q, place = np.nonzero(middle >= (mine.min(axis=1) - 2 * slack)[:, None])
        q, place = q[middle[q, place] > -np.inf], place[middle[q, place] > -np.inf]
        out = np.empty(len(q), [("q", "<i4"), ("id", "<i8"), ("block", "<i8"), ("place", "<i4"), ("middle", "<f8")])
        out["q"], out["id"], out["block"], out["place"], out["middle"] = q + first, ids[place], number, place, middle[q, place]
        self.found.append(out)
        self.rows += len(out)

    def pruned(self, slack: np.ndarray) -> np.ndarray:
        out = np.concatenate(self.found) if self.found else np.empty(0, [("q", "<i4"), ("id", "<i8"), ("block", "<i8"), ("place", "<i4"), ("middle", "<f8")])
        out = out[out["middle"] >= self.kth.min(axis=1)[out["q"]] - 2 * slack[out["q"]]]
        self.found, self.rows = [out], len(out)
        return out


def _scanned(shared, grid: Grid, k: int):
    def run(batches):
        query_ids, q = shared.value
        slack, kept, limit = grid.slack(q), _Kept(len(q), k), 1 << 20
        for batch in batches:
            for row in range(len(batch)):
                ids = np.frombuffer(batch.column("ids")[row].as_buffer(), "<i8")
                middle = grid.middle(np.frombuffer(batch.column("cells")[row].as_buffer(), np.uint8).reshape(len(ids), -1))
                for i in range(0, len(q), STRIPE):
                    near = q[i : i + STRIPE] @ middle.T
                    near[query_ids[i : i + STRIPE, None] == ids[None, :]] = -np.inf
                    kept.add(i, near, slack[i : i + STRIPE], ids, batch.column("block")[row].as_py())
                if kept.rows > limit:
                    kept.pruned(slack)
                    limit = max(1 << 20, 2 * kept.rows)
        out = kept.pruned(slack)
        for i in range(0, len(out), 1 << 16):
            o = out[i : i + (1 << 16)]
            yield pa.RecordBatch.from_arrays([pa.array(o["q"]), pa.array(query_ids[o["q"]]), pa.array(o["id"]), pa.array(o["block"]), pa.array(o["place"]), pa.array(o["middle"] + slack[o["q"]]), pa.array(slack[o["q"]])], names=["query", "query_id", "vec_id", "block", "place", "bound", "slack"])

    return run


def _read(shared, k: int, kind: str):
    """One block: exact scores of its candidates in the order of their bounds, and how many vectors were read."""

    def run(blocks: pa.Table, may: pa.Table) -> pa.Table:
        query_ids, vec_ids, scores, reads = [], [], [], []
        if len(blocks) and len(may):
            queries = shared.value[1]
            x = np.frombuffer(blocks.column("exact")[0].as_buffer(), kind).reshape(-1, queries.shape[1])
            may = may.sort_by([("query", "ascending"), ("bound", "descending")])
            query, query_id, vec_id, place, bound = (may.column(c).to_numpy() for c in ("query", "query_id", "vec_id", "place", "bound"))
            at = np.flatnonzero(np.concatenate([[True], query[1:] != query[:-1]]))
            for i, j in zip(at, np.append(at[1:], len(query))):
                s, mine, kth = i, [], -np.inf
                while s < j and bound[s] >= kth - abs(kth) * 1e-12:
                    e = min(j, s + max(k, s - i))  # k at first, then as many again as were read
                    mine += map(int, products(np.broadcast_to(queries[query[i]], (e - s, x.shape[1])), integers(x[place[s:e]])))
                    s = e
                    if len(mine) >= k:
                        kth = float(sorted(mine)[-k])
                query_ids.append(query_id[i:s])
                vec_ids.append(vec_id[i:s])
                scores += map(str, mine)
                reads += [s - i] + [0] * (s - i - 1)
        empty = np.empty(0, np.int64)
        return pa.table({"query_id": np.concatenate([empty, *query_ids]), "vec_id": np.concatenate([empty, *vec_ids]), "score": pa.array(scores, pa.string()), "read": pa.array(reads, pa.int64())})

    return run


def search(
    rows: DataFrame, is_query: Column, *, id_col: str = "vec_id", vector_col: str = "embedding", k: int = K, slab_bytes: int = SLAB_BYTES, size: int = BLOCK, cells: int = CELLS, with_reads: bool = False,
) -> DataFrame:
    """query_id, rank, vec_id, score (integer inner product) of the k best of each row for which `is_query` holds.

    `with_reads` adds read, the number of exact vectors that were read for the query.
    """
    spark = rows.sparkSession
    result = _RESULT + ", read long" * with_reads
    good = v.usable(rows, id_col, vector_col)
    pool, queries = staged(v.candidates(good, k), "pool"), staged(v.queries(good, is_query), "queries")
    first = pool.select("vector").first()
    asked = queries.count()
    if first is None or not asked:
        return spark.createDataFrame([], result)
    dim, kind = len(first[0]), {"float": "<f4", "double": "<f8"}.get(pool.schema["vector"].dataType.elementType.typeName(), "<f8")
    if kind == "<f8":
        pool = pool.withColumn("vector", F.col("vector").cast("array<double>"))
    ends = pool.agg(F.max(F.lit(0)), *[f(F.lit(256.0) * F.col("vector")[i].cast("double")) for f in (F.min, F.max) for i in range(dim)]).first()
    grid = Grid(*np.floor(np.array(list(ends)[1:], np.float64)).reshape(2, -1), cells)
    # an id with m vectors may take m of the best places: so many times k vectors hold the k best ids
    k_vectors = k * pool.groupBy("vec_id").count().agg(F.max("count")).first()[0]
    file = staged(pool.mapInArrow(_file(grid, size), _FILE), "vafile")
    slabs = math.ceil(asked * dim * 8 / slab_bytes)
    found = None
    for s in range(slabs):
        part = queries.where(F.pmod(F.xxhash64("vec_id", "vector"), F.lit(slabs)) == s).toArrow()
        if not len(part):
            continue
        shared = spark.sparkContext.broadcast((part.column("vec_id").to_numpy(), integers(block(part.column("vector")))))
        may = file.select("block", "ids", "cells").mapInArrow(_scanned(shared, grid, k_vectors), _MAY)
        group = Window.partitionBy("query")
        may = may.withColumn("_rank", F.row_number().over(group.orderBy(F.desc("bound"))))
        may = may.withColumn("_kth", F.when(F.max("_rank").over(group) >= k_vectors, F.min(F.when(F.col("_rank") <= k_vectors, F.col("bound"))).over(group)))
        may = may.where(F.col("_kth").isNull() | (F.col("bound") >= F.col("_kth") - 2 * F.col("slack"))).drop("_rank", "_kth", "slack")
        pairs = file.select("block", "exact").groupBy("block").cogroup(may.groupBy("block")).applyInArrow(_read(shared, k_vectors, kind), "query_id long, vec_id long, score string, read long")
        found = pairs if found is None else found.unionByName(pairs)
    found = staged(found.withColumn("score", F.col("score").cast("decimal(38,0)")), "scores")
    exact = F.when(F.abs("score") > F.lit((1 << 63) - 1), F.raise_error(F.lit("a score is beyond a long")).cast("long")).otherwise(F.col("score").cast("long"))
    best = v.ranked(found, k).withColumn("score", exact)
    if with_reads:
        best = best.join(found.groupBy("query_id").agg(F.sum("read").alias("read")), "query_id").select("query_id", "rank", "vec_id", "score", "read")
    return best
