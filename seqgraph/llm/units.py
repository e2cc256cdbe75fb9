"""Documents as compressed chunks that are read several times, and the exchange of hash buckets between them.

A chunk is a row with one compressed record batch of a bounded size; a unit is a run of up to `UNIT` chunks that one
task wrote. What a unit has to say about the values of a bucket travels as one row for each bucket that it has values
for, so the number of rows is bounded by units times buckets and by the number of values.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession

from .common import new_path, slices, trim

CHUNK_BYTES = 4 << 20
UNIT = 8
_STORED = "unit long, chunk int, blob binary"
_KINDS = {"int": pa.int32(), "long": pa.int64(), "binary": pa.binary(), "double": pa.float64(), "string": pa.string()}


def pack(batch: pa.RecordBatch) -> bytes:
    sink = pa.BufferOutputStream()
    options = pa.ipc.IpcWriteOptions(compression=pa.Codec("zstd", compression_level=3))
    with pa.ipc.new_stream(sink, batch.schema, options=options) as writer:
        writer.write_batch(batch)
    return sink.getvalue().to_pybytes()


def unpack(blob) -> pa.RecordBatch:
    with pa.ipc.open_stream(blob if isinstance(blob, pa.Buffer) else pa.py_buffer(blob)) as reader:
        return reader.read_next_batch()


def _written(size: int, ids: str | None):
    def run(batches):
        part = TaskContext.get().partitionId()
        held, seq, total = [], 0, 0

        def flush():
            nonlocal held, seq, total
            whole = pa.Table.from_batches(held).combine_chunks().to_batches()
            unit, chunk = (part << 32) | (seq // UNIT), seq % UNIT
            row = pa.RecordBatch.from_arrays([pa.array([unit], pa.int64()), pa.array([chunk], pa.int32()), pa.array([pack(whole[0])], pa.binary())], names=["unit", "chunk", "blob"])
            if ids:
                row = row.append_column("ids", pa.array([whole[0].column(ids).to_pylist()], pa.list_(pa.int64())))
            held, seq, total = [], seq + 1, 0
            return row

        for batch in batches:
            for i, j in slices(batch.column("text"), size):
                piece = batch.slice(i, j - i)
                n = pc.sum(pc.binary_length(piece.column("text"))).as_py() or 0
                if held and total + n > size:
                    yield flush()
                held.append(piece)
                total += n + 16 * len(piece)
        if held:
            yield flush()
        trim()

    return run


def stored(docs: DataFrame, chunk_bytes: int = CHUNK_BYTES, ids: str | None = None) -> DataFrame:
    """unit, chunk (its number within the unit), blob, and with `ids` that column's values; written to the shared folder."""
    spark: SparkSession = docs.sparkSession
    path = new_path(spark, "chunks")
    ddl = _STORED + ", ids array<long>" * bool(ids)
    docs.mapInArrow(_written(chunk_bytes, ids), ddl).write.option("compression", "uncompressed").parquet(path)
    return spark.read.schema(ddl).parquet(path)


def schema(ddl: str) -> pa.Schema:
    return pa.schema([(name, _KINDS[kind]) for name, kind in (x.split() for x in ddl.split(", "))])


def batches(rows: list[tuple], ddl: str, size: int = 64):
    """Row tuples as record batches of `size` rows; one empty batch if there are none."""
    fields = schema(ddl)
    for i in range(0, max(1, len(rows)), size):
        part = rows[i : i + size]
        yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in part], f.type) for k, f in enumerate(fields)], schema=fields)


def as_table(rows: list[tuple], ddl: str) -> pa.Table:
    return pa.Table.from_batches(list(batches(rows, ddl)), schema=schema(ddl))


def flat(column: pa.ChunkedArray | pa.Array, kind) -> tuple[np.ndarray, np.ndarray]:
    """All values of a binary column one after another, and how many each row has; nulls have none."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks() if column.num_chunks != 1 else column.chunk(0)
    column = column.cast(pa.large_binary()).fill_null(b"")
    _, offsets, data = column.buffers()
    bounds = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    width = np.dtype(kind).itemsize
    raw = np.frombuffer(data, np.uint8)[bounds[0] : bounds[-1]] if data is not None and len(bounds) else np.empty(0, np.uint8)
    return (raw.view(kind) if raw.ctypes.data % max(1, np.dtype(kind).alignment) == 0 else np.frombuffer(raw.tobytes(), kind)), np.diff(bounds) // width


def bucket(values: np.ndarray, bits: int) -> np.ndarray:
    return (values >> np.uint64(64 - bits)).astype(np.int64) if bits else np.zeros(len(values), np.int64)


def residual(values: np.ndarray, bits: int) -> np.ndarray:
    """The 32 bits after the bucket's: values sorted as a whole are sorted by bucket and then by these."""
    return ((values << np.uint64(bits)) >> np.uint64(32)).astype(np.uint32)


def groups(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of sorted keys: the distinct ones, and the bounds of their runs."""
    if not len(keys):
        return keys, np.zeros(1, np.int64)
    at = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
    return keys[at], np.append(at, len(keys))


def squeeze(values: np.ndarray) -> bytes:
    """Sorted uint32 values as byte planes of their differences, after a byte with the number of planes."""
    if not len(values):
        return b""
    deltas = np.diff(values.astype(np.uint32), prepend=np.uint32(0)).astype("<u4").view(np.uint8).reshape(-1, 4).T
    planes = 4 if deltas[3].any() else 3 if deltas[2].any() else 2
    return bytes([planes]) + np.ascontiguousarray(deltas[:planes]).tobytes()


def expand(blob) -> np.ndarray:
    raw = np.frombuffer(blob, np.uint8)
    if not len(raw):
        return np.empty(0, np.uint32)
    planes = int(raw[0])
    rows = raw[1:].reshape(planes, -1)
    out = np.zeros((rows.shape[1], 4), np.uint8)
    out[:, :planes] = rows.T
    return np.cumsum(out.view("<u4").ravel(), dtype=np.uint32)


class Parts:
    """Values of several chunks, grouped by bucket and, within a bucket, by chunk in order."""

    def __init__(self, values: list[np.ndarray], buckets: list[np.ndarray]):
        counts = [len(b) for b in buckets]
        flat_, which = np.concatenate(buckets) if buckets else np.empty(0, np.int64), np.repeat(np.arange(len(buckets)), counts)
        order = np.argsort(flat_, kind="stable")
        self.values = (np.concatenate(values) if values else np.empty(0))[order]
        self.keys, self.bounds = groups(flat_[order])
        self.which, self.chunks = which[order], len(buckets)

    def __iter__(self):
        """(bucket, its values as bytes, the number of values of each chunk as bytes)."""
        for k, key in enumerate(self.keys):
            i, j = self.bounds[k], self.bounds[k + 1]
            yield int(key), self.values[i:j].tobytes(), np.bincount(self.which[i:j], minlength=self.chunks).astype("<u4").tobytes()


class Replies:
    """One flag a value, as the buckets sent them back for one unit; read chunk by chunk.

    `table` has the columns bucket, first (the number of the first chunk that a row speaks about), `flags` and `sizes`.
    """

    def __init__(self, table: pa.Table, flags: str, sizes: str):
        table = table.filter(pc.is_valid(table.column(sizes)))
        self.first = table.column("first").to_numpy().astype(np.int64)
        self.buckets = table.column("bucket").to_numpy().astype(np.int64)
        self.flags, lengths = flat(table.column(flags), np.uint8) if len(table) else (np.empty(0, np.uint8), np.empty(0, np.int64))
        self.at = np.cumsum(lengths) - lengths
        sizes_, widths = flat(table.column(sizes), "<u4") if len(table) else (np.empty(0, np.uint32), np.empty(0, np.int64))
        self.sizes = np.zeros((len(table), int(widths.max()) if len(widths) else 0), np.int64)
        if len(table):
            at = np.cumsum(widths) - widths
            self.sizes[np.repeat(np.arange(len(widths)), widths), np.arange(len(sizes_)) - np.repeat(at, widths)] = sizes_

    def of(self, chunk: int, buckets: np.ndarray) -> np.ndarray:
        """The flags of a chunk's values, in the chunk's own order; `buckets` are its values' buckets."""
        out = np.zeros(len(buckets), np.uint8)
        if not len(self.first) or not len(buckets):
            return out
        place = chunk - self.first
        rows = np.flatnonzero((place >= 0) & (place < self.sizes.shape[1]))
        place = place[rows]
        n = self.sizes[rows, place]
        ahead = np.cumsum(self.sizes[rows], axis=1)[np.arange(len(rows)), place] - n
        keep = n > 0
        rows, n, start = rows[keep], n[keep], (self.at[rows] + ahead)[keep]
        order = np.argsort(self.buckets[rows], kind="stable")
        n, start = n[order], start[order]
        take = np.repeat(start - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))
        out[np.argsort(buckets, kind="stable")] = self.flags[take]
        return out
