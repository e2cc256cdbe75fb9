"""Approximate largest inner products by cross-polytope hashing.

Vectors become unit vectors by one more component, sqrt(longest^2 - norm^2), divided by the longest norm; then the
order of inner products with a query is the order of cosines. A hash is a tuple of `depth` signed axes: each comes from
three rounds of random signs and a fast Hadamard transform, and is the axis nearest to the rotated vector. A query is as
close to a cell as the sum of its own components on the cell's axes; it probes, in each table, all cells that are at
least `reach` close, however many they are. What it meets there is ranked by exact inner products in double precision.

`reach` is one number for the whole index. It is fitted on at most `sample` queries (those with the least hash of their
id): a pass over all rows finds their exact nearest ones, and `reach` is the largest number that meets a share of
`recall` of them. The rule is the same at every size; as neighbours get closer, it probes a smaller share of the cells.

Every row is indexed and nothing is capped. A table is dealt by ranges of the first axis, and large ranges by hash, to
parts of about `slice_rows` rows; a part that no cell of which can be close enough never gets the query. Queries are
dealt to slices of the same size. A query that meets fewer candidates than k is answered by an exact pass.

Defined results: vectors that are null, of zero norm, or hold null or non-finite components, rows with a null id, and
vectors whose length isn't the most frequent one take no part. Rows that repeat an id and its vector are one candidate;
an id with several vectors counts with its best score, as candidate and as query. Ties go to the smaller id. An empty
table gives an empty result.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import vectors as v
from .common import shuffle_partitions, staged
from .vectors import block

TABLES, DEPTH, K = 2, 4, 20
#: The share of the sampled queries' exact neighbours that the fitted reach meets.
RECALL, SAMPLE = 0.95, 256
SLICE_ROWS = 32768
_RESULT = "query_id long, rank int, vec_id long, score double"


def hadamard(x: np.ndarray) -> np.ndarray:
    """The fast Walsh-Hadamard transform of each row (a power of two long), orthonormal."""
    rows, n = x.shape
    half = 1
    while half < n:
        x = x.reshape(rows, n // (2 * half), 2, half)
        x = np.stack([x[:, :, 0] + x[:, :, 1], x[:, :, 0] - x[:, :, 1]], axis=2)
        half *= 2
    return x.reshape(rows, n) / x.dtype.type(math.sqrt(n))


def rotated(x: np.ndarray, rotation: int, seed: int) -> np.ndarray:
    """Closeness of each unit row to the 2n signed axes after a pseudo-random rotation."""
    n = 1 << (x.shape[1] - 1).bit_length()
    y = np.zeros((len(x), n), x.dtype)
    y[:, : x.shape[1]] = x
    signs = np.random.default_rng((seed, rotation, 0)).choice([-1.0, 1.0], (3, n)).astype(x.dtype)
    for s in signs:
        y = hadamard(y * s)
    return np.concatenate([y, -y], axis=1)


class Hashing:
    """The rotations of all tables, for vectors of `dim` components that are at most `longest` long."""

    def __init__(self, dim: int, longest: float, tables: int, depth: int, seed: int):
        self.longest, self.tables, self.depth, self.seed = longest, tables, depth, seed
        self.axes = 2 * (1 << dim.bit_length())

    def unit(self, x: np.ndarray) -> np.ndarray:
        x = x.astype(np.float64)
        rest = np.sqrt(np.maximum(0.0, self.longest * self.longest - (x * x).sum(axis=1)))
        return (np.concatenate([x, rest[:, None]], axis=1) / self.longest).astype(np.float32)

    def close(self, unit: np.ndarray, table: int) -> np.ndarray:
        """depth x rows x axes: closeness of the rows to each axis of a table's rotations."""
        return np.stack([rotated(unit, table * self.depth + j, self.seed) for j in range(self.depth)])

    def cells(self, unit: np.ndarray, table: int) -> np.ndarray:
        """depth x rows: the axes of each row's cell."""
        return np.stack([rotated(unit, table * self.depth + j, self.seed).argmax(axis=1) for j in range(self.depth)])


def _indexed(h: Hashing, per_part: int):
    """Each row once in each table, with its cell and the part of the table that holds it."""

    def run(batches):
        for batch in batches:
            ids, column = batch.column("vec_id"), batch.column("vector")
            for i in range(0, len(ids), 2048):
                unit = h.unit(block(column.slice(i, 2048)))
                for t in range(h.tables):
                    cells = h.cells(unit, t)
                    packed = np.ascontiguousarray(cells.T.astype("<u2"))
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(np.full(len(unit), t, np.int32)), pa.array((cells[0] // per_part).astype(np.int32)), pa.array([r.tobytes() for r in packed], pa.binary()), ids.slice(i, 2048), column.slice(i, 2048)],
                        names=["table", "part", "cell", "vec_id", "vector"],
                    )

    return run


def _probing(h: Hashing, reach: float, per_part: int):
    """A query row once for each part with a first axis that can be close enough."""

    def run(batches):
        for batch in batches:
            ids, column = batch.column("vec_id"), batch.column("vector")
            for i in range(0, len(ids), 2048):
                unit = h.unit(block(column.slice(i, 2048)))
                for t in range(h.tables):
                    y = h.close(unit, t)
                    most = y[0].reshape(len(unit), -1, per_part).max(axis=2) + y[1:].max(axis=2).sum(axis=0)[:, None]
                    who, parts = np.nonzero(most >= reach - 1e-5)
                    take = pa.array(who + i)
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(who), t, np.int32)), pa.array(parts.astype(np.int32)), ids.take(take), column.take(take)], names=["table", "part", "vec_id", "vector"])

    return run


def _met(h: Hashing, reach: float, k: int):
    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        out_q, out_v, out_s = [np.empty(0, np.int64)], [np.empty(0, np.int64)], [np.empty(0)]
        if len(left) and len(right):
            table, ids = left.column("table")[0].as_py(), left.column("vec_id").to_numpy()
            x = block(left.column("vector"))
            cells = np.frombuffer(b"".join(left.column("cell").to_pylist()), "<u2").reshape(len(ids), h.depth).T.astype(np.int64)
            query_ids, qx = right.column("vec_id").to_numpy(), block(right.column("vector"))
            for i in range(0, len(query_ids), 64):
                q = qx[i : i + 64]
                y = h.close(h.unit(q), table)
                near = y[0].take(cells[0], axis=1)
                for j in range(1, h.depth):
                    near += y[j].take(cells[j], axis=1)
                met = (near >= reach) & (ids[None, :] != query_ids[i : i + 64, None])
                for r in range(len(q)):
                    at = np.flatnonzero(met[r])
                    mine, one = x[at].astype(np.float64), q[r].astype(np.float64)
                    found, exact = v.best_of(lambda c: (mine[c] * one).sum(axis=1), ids[at], mine @ one, k)  # noqa: B023
                    out_q.append(np.full(len(found), query_ids[i + r]))
                    out_v.append(ids[at[found]])
                    out_s.append(exact)
        return pa.table({"query_id": np.concatenate(out_q), "vec_id": np.concatenate(out_v), "score": np.concatenate(out_s)})

    return run


def fitted_reach(h: Hashing, neighbours: pa.Table, queries: pa.Table, recall: float) -> float:
    """The largest closeness that a share `recall` of the (query, neighbour) pairs has in one table or another."""
    if not len(neighbours):
        return -float("inf")
    place = {q: i for i, q in enumerate(queries.column("vec_id").to_pylist())}
    rows = np.array([place[q] for q in neighbours.column("query_id").to_pylist()])
    x, q = h.unit(block(neighbours.column("vector"))), h.unit(block(queries.column("vector")))
    best = np.full(len(rows), -np.inf, np.float32)
    for t in range(h.tables):
        y, cells = h.close(q, t), h.cells(x, t)
        near = y[0][rows, cells[0]]
        for j in range(1, h.depth):
            near = near + y[j][rows, cells[j]]
        best = np.maximum(best, near)
    best = np.sort(best)[::-1]
    return float(best[max(0, math.ceil(recall * len(best)) - 1)])


def search(
    rows: DataFrame, is_query: Column, *, id_col: str = "vec_id", vector_col: str = "embedding", k: int = K, tables: int = TABLES, depth: int = DEPTH,
    recall: float = RECALL, sample: int = SAMPLE, seed: int = 17, slice_rows: int = SLICE_ROWS,
) -> DataFrame:
    """query_id, rank, vec_id, score: the k nearest found of each row for which `is_query` holds (a condition on vec_id)."""
    spark = rows.sparkSession
    good = v.usable(rows, id_col, vector_col)
    norm = F.aggregate("vector", F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double"))
    good = good.withColumn("_norm", norm).where("_norm > 0").drop("_norm")
    pool = staged(v.candidates(good, k), "pool")
    queries = staged(v.queries(good, is_query), "queries")
    size = pool.agg(F.count(F.lit(1)).alias("n"), F.max(norm).alias("m"), F.max(F.size("vector")).alias("d"), F.count_distinct("vec_id").alias("ids")).first()
    asked = queries.count()
    if not size["n"] or not asked:
        return spark.createDataFrame([], _RESULT)
    h = Hashing(size["d"], math.sqrt(max(size["m"], queries.agg(F.max(norm)).first()[0])), tables, depth, seed)
    # the sample: one vector of each of at most `sample` query ids
    some = queries.orderBy(F.xxhash64("vec_id"), "vec_id", "vector").limit(sample).toArrow()
    some = some.take(pa.array(np.unique(some.column("vec_id").to_numpy(), return_index=True)[1]))
    nearest = v.ranked(v.exact(pool, some, k), k).select("query_id", "vec_id").toArrow()
    wanted = spark.createDataFrame(nearest.select(["vec_id"])).distinct()  # at most `sample` times k ids
    found = pool.join(F.broadcast(wanted), "vec_id").groupBy("vec_id").agg(F.min("vector").alias("vector")).toArrow()
    place = dict(zip(found.column("vec_id").to_pylist(), range(len(found))))
    nearest = nearest.append_column("vector", found.column("vector").combine_chunks().take(pa.array([place[i] for i in nearest.column("vec_id").to_pylist()])))
    reach = fitted_reach(h, nearest, some, recall)

    # how the tables are dealt is a matter of sizes alone: what is met doesn't depend on it
    per_part = min(h.axes, 1 << max(0, math.floor(math.log2(max(1.0, h.axes * slice_rows / 4 / size["n"])))))
    slices, query_slices = math.ceil(size["n"] * per_part / h.axes / slice_rows), math.ceil(asked / slice_rows)
    kind = pool.schema["vector"].dataType.simpleString()
    index = pool.mapInArrow(_indexed(h, per_part), f"table int, part int, cell binary, vec_id long, vector {kind}")
    index = index.withColumn("slice", F.pmod(F.xxhash64("vec_id", "vector"), F.lit(slices)).cast("int")).withColumn("asked", F.explode(F.sequence(F.lit(0), F.lit(query_slices - 1))))
    probes = queries.mapInArrow(_probing(h, reach, per_part), f"table int, part int, vec_id long, vector {kind}")
    probes = probes.withColumn("asked", F.pmod(F.xxhash64("vec_id"), F.lit(query_slices)).cast("int")).withColumn("slice", F.explode(F.sequence(F.lit(0), F.lit(slices - 1))))
    keys, n = ["table", "part", "slice", "asked"], shuffle_partitions(spark)
    pairs = index.repartition(n, *keys).groupBy(*keys).cogroup(probes.repartition(n, *keys).groupBy(*keys)).applyInArrow(_met(h, reach, k), "query_id long, vec_id long, score double")
    found = staged(v.ranked(pairs, k), "found")

    # queries with short lists: an exact pass, in slabs of `sample` queries
    enough = found.groupBy("query_id").count().where(F.col("count") >= min(k, size["ids"] - 1))
    short = staged(queries.join(enough, queries["vec_id"] == enough["query_id"], "left_anti"), "short")
    slabs = math.ceil(short.count() / sample)
    for s in range(slabs):
        slab = short.where(F.pmod(F.xxhash64("vec_id"), F.lit(slabs)) == s).toArrow()
        if len(slab):
            more = v.ranked(v.exact(pool, slab, k), k)
            found = found.join(more.select("query_id").distinct(), "query_id", "left_anti").unionByName(more)
    return found
