"""Shared folders, staged tables and vectorised word handling for the training-data operators."""

from __future__ import annotations

import ctypes
import uuid

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession

from ..operators.graph import shared_dir

try:
    _libc = ctypes.CDLL("libc.so.6")
    _libc.malloc_trim  # noqa: B018
except (OSError, AttributeError):  # another C library
    _libc = None

#: The ASCII white space that separates words everywhere in this subpackage: \x20 and \x09-\x0D.
SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def new_path(spark: SparkSession, label: str) -> str:
    """A path in this application's part of the shared folder, which `operators.graph.clean` removes."""
    return f"{shared_dir(spark)}/seqgraph/{spark.sparkContext.applicationId}/{label}-{uuid.uuid4().hex}"


def staged(df: DataFrame, label: str, **options: str) -> DataFrame:
    """`df` written to the shared folder and read back: lost executors recompute nothing above it."""
    spark = df.sparkSession
    path = new_path(spark, label)
    df.write.options(**options).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def unstage(df: DataFrame) -> None:
    """Removes the files of a staged table that no later plan reads."""
    spark = df.sparkSession
    for f in {name.rsplit("/", 1)[0] for name in df.inputFiles()}:
        path = spark._jvm.org.apache.hadoop.fs.Path(f)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def trim() -> None:
    """Gives freed memory back to the system: Python workers live on between tasks, beside the executor's heap."""
    pa.default_memory_pool().release_unused()
    if _libc is not None:
        _libc.malloc_trim(0)


# --- words of whole Arrow columns ------------------------------------------------------------------------------------

_MASK = (1 << 64) - 1


def _splitmix(n: int, seed: int) -> np.ndarray:
    x = np.arange(1, n + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(seed)
    return mix64(x)


def mix64(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (xor-shift-multiply): every input bit reaches every output bit."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class Powers:
    """Powers of an odd base modulo 2^64, and of its inverse, grown on demand."""

    def __init__(self, base: int):
        self.base, self.inverse = base | 1, pow(base | 1, -1, 1 << 64)
        self.up = np.ones(1, np.uint64)
        self.down = np.ones(1, np.uint64)

    def _grown(self, have: np.ndarray, n: int, base: int) -> np.ndarray:
        if len(have) >= n:
            return have
        n = max(n, 2 * len(have), 1 << 12)
        out = np.full(n, np.uint64(base), np.uint64)
        out[0] = 1
        return np.cumprod(out, dtype=np.uint64)

    def ups(self, n: int) -> np.ndarray:
        self.up = self._grown(self.up, n, self.base)
        return self.up[:n]

    def downs(self, n: int) -> np.ndarray:
        self.down = self._grown(self.down, n, self.inverse)
        return self.down[:n]


class Hash:
    """One family of 64-bit polynomial hashes: of words from their bytes, of word windows from word hashes."""

    def __init__(self, seed: int, spaces: bool = False):
        self.bytes = _splitmix(256, seed) | np.uint64(1)
        if not spaces:
            self.bytes[SPACE] = 0  # what lies between words adds nothing
        self.within = Powers(0x9E3779B97F4A7C15 ^ (seed << 1))
        self.across = Powers(0xD6E8FEB86659FD93 ^ (seed << 1))

    def words(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray, block: int = 1 << 20) -> np.ndarray:
        """Hashes of data[starts[i]:ends[i]], in blocks of about `block` bytes so that memory stays flat."""
        out = np.empty(len(starts), np.uint64)
        i = 0
        while i < len(starts):
            j = max(i + 1, int(np.searchsorted(starts, starts[i] + block)))
            s0, s = starts[i], starts[i:j] - starts[i]
            seg = data[s0 : ends[j - 1]]
            first = np.zeros(len(seg), np.int32)
            first[s] = s
            at = np.arange(len(seg), dtype=np.int32) - np.maximum.accumulate(first)
            top = int(at.max()) + 1
            value = self.bytes[seg] * self.within.ups(top)[at]
            out[i:j] = np.add.reduceat(value, s)
            i = j
        return mix64(out ^ (ends - starts).astype(np.uint64))

    def windows(self, words: np.ndarray, size: int) -> np.ndarray:
        """Hashes of every run of `size` consecutive entries."""
        n = len(words)
        if n < size:
            return np.empty(0, np.uint64)
        sums = np.zeros(n + 1, np.uint64)
        np.cumsum(words * self.across.ups(n), out=sums[1:])
        return mix64((sums[size:] - sums[:-size]) * self.across.downs(n - size + 1))


class Texts:
    """A text column as one byte buffer with document and word bounds; null texts count as empty."""

    def __init__(self, column: pa.Array):
        column = column.cast(pa.large_string()).fill_null("")
        n = len(column)
        _, offsets, data = column.buffers()
        self.offsets = np.frombuffer(offsets, np.int64)[column.offset : column.offset + n + 1]
        base, end = int(self.offsets[0]), int(self.offsets[-1])
        self.data = np.frombuffer(data, np.uint8)[base:end] if data is not None else np.empty(0, np.uint8)
        self.offsets = self.offsets - base
        word = ~SPACE[self.data]
        edge = np.zeros(len(self.data) + 1, bool)
        edge[self.offsets] = True
        before = np.empty(len(word), bool)
        before[:1] = False
        before[1:] = word[:-1]
        after = np.empty(len(word), bool)
        after[-1:] = False
        after[:-1] = word[1:]
        self.starts = np.flatnonzero(word & (~before | edge[:-1]))
        self.ends = np.flatnonzero(word & (~after | edge[1:])) + 1
        #: words of document d are first[d]:first[d + 1]
        self.first = np.searchsorted(self.starts, self.offsets)

    def __len__(self) -> int:
        return len(self.offsets) - 1

    def raw(self, d: int) -> bytes:
        return self.data[self.offsets[d] : self.offsets[d + 1]].tobytes()


def slices(column: pa.Array, most: int = 4 << 20):
    """Row ranges [i, j) of a text column of at most `most` bytes each, or of a single longer text."""
    sizes = pc.fill_null(pc.binary_length(column.cast(pa.large_string())), 0).to_numpy(zero_copy_only=False)
    i, total = 0, 0
    for j, size in enumerate(sizes):
        if j > i and total + size > most:
            yield i, j
            i, total = j, 0
        total += int(size)
    if i < len(sizes):
        yield i, len(sizes)
