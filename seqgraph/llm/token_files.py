"""Token ids of whole documents in ORC files.

Documents are range-partitioned and sorted by doc_id, so files hold ascending, disjoint id ranges. Columns: doc_id,
shard (the file's place in order), local_start (ids before the document within its shard), tokens (array of int). ORC
keeps integers in run-length encoding version 2; the writer sets stripe size, row index stride and Bloom filters on
doc_id, so readers split files by stripes, and a filter on doc_id skips stripes and row groups by their metadata.

Defined results: null and empty texts hold the end id alone; a null doc_id comes first; repeated rows are documents of
their own, ordered by text; an empty table writes no rows. Further columns of the input are not written.
"""

from __future__ import annotations

import os
import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import Texts, new_path, shuffle_partitions, slices
from .unit_coder import UnitCoder

END_ID = 2
#: With more files than this their offsets (16 bytes a file) are joined by a shuffle.
MOST_FILES = 1_000_000
OPTIONS = {
    "orc.compress": "ZSTD",
    "orc.stripe.size": str(64 << 20),
    "orc.row.index.stride": "1000",
    "orc.create.index": "true",
    "orc.bloom.filter.columns": "doc_id",
    "orc.bloom.filter.fpp": "0.01",
    "orc.encoding.strategy": "SPEED",
}
_STORED = "doc_id long, shard int, local_start long, tokens array<int>"
_coders: dict[str, UnitCoder] = {}


def _coder(definition: str) -> UnitCoder:
    """One coder for each tokenizer and worker process; words that ASCII white space separates are its units."""
    key = f"{len(definition)}:{zlib.crc32(definition.encode())}"
    if key not in _coders:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        tokenizer = Tokenizer.from_str(definition)
        encode = getattr(tokenizer, "encode_batch_fast", tokenizer.encode_batch)
        _coders[key] = UnitCoder(lambda units: [e.ids for e in encode([u.decode() for u, _ in units], add_special_tokens=False)])
    return _coders[key]


def _encoded(definition, end_id: int):
    def run(batches):
        coder, shard, start = _coder(definition.value), TaskContext.get().partitionId(), 0
        for batch in batches:
            for i, j in slices(batch.column("text")):
                texts = Texts(batch.column("text").slice(i, j - i))
                ids, bounds = coder(texts.data, texts.starts, texts.ends, None, texts.first, end_id)
                n = j - i
                tokens = pa.ListArray.from_arrays(pa.array(bounds.astype(np.int32)), pa.array(ids))
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(i, n), pa.array(np.full(n, shard, np.int32)), pa.array(start + bounds[:-1]), tokens], names=["doc_id", "shard", "local_start", "tokens"])
                start += int(bounds[-1])

    return run


def splits_by_space(definition: str) -> bool:
    """Whether a tokenizer of the `tokenizers` library gives the same ids word by word: white space is dropped before any merge."""
    import json

    def parts(x):
        return [] if x is None else [p for y in x.get("pretokenizers", x.get("normalizers", [])) for p in parts(y)] if x["type"] == "Sequence" else [x]

    spec = json.loads(definition)
    first = next(iter(parts(spec["pre_tokenizer"])), {})
    return first.get("type") in ("Whitespace", "WhitespaceSplit", "BertPreTokenizer") or first.get("behavior") == "Removed" and bool(first.get("invert")) and r"^\s" in first["pattern"].get("Regex", "") and r"\s+" not in first["pattern"]["Regex"]


def write_tokens(docs: DataFrame, tokenizer_path: str, path: str, *, end_id: int = END_ID, partitions: int | None = None) -> None:
    """Encodes every text (no special tokens), appends `end_id` and writes ORC files in ascending doc_id order.

    The tokenizer file is read on the driver and sent to the executors once.
    """
    spark = docs.sparkSession
    with open(tokenizer_path, encoding="utf-8") as f:
        definition = f.read()
    if not splits_by_space(definition):
        raise ValueError("this tokenizer keeps white space; its texts can't be encoded word by word")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    rows = rows.repartitionByRange(partitions or shuffle_partitions(spark), F.col("doc_id").asc_nulls_first())
    rows = rows.sortWithinPartitions(F.col("doc_id").asc_nulls_first(), "text")
    encoded = rows.mapInArrow(_encoded(spark.sparkContext.broadcast(definition), end_id), _STORED)
    encoded.write.options(**OPTIONS).orc(path)


def read_tokens(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, start (ids of all documents before it), tokens; filters on doc_id reach the files' indexes."""
    stored = spark.read.schema(_STORED).orc(path)
    shards = stored.groupBy("shard").agg(F.sum(F.size("tokens").cast("long")).alias("n"))
    # one row for each file: the running sum over them is the only ordered step
    before = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    shards = shards.select(F.col("shard").alias("_shard"), F.coalesce(F.sum("n").over(before), F.lit(0)).alias("_base"))
    # one row a written file; files of a table are listed by the driver anyway, so their number has a bound there
    shards = F.broadcast(shards) if len(stored.inputFiles()) <= MOST_FILES else shards
    return stored.join(shards, stored["shard"] == F.col("_shard")).select("doc_id", (F.col("local_start") + F.col("_base")).alias("start"), "tokens")


def _checksums(batches):
    for batch in batches:
        tokens = batch.column("tokens")
        bounds, flat = tokens.offsets.to_numpy(), tokens.values.to_numpy().astype("<u4", copy=False)
        crc = [zlib.crc32(flat[i:j]) for i, j in zip(bounds[:-1], bounds[1:])]
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("start"), pa.array(np.diff(bounds).astype(np.int64)), pa.array(crc, pa.int64())], names=["doc_id", "start", "n_tokens", "ids_crc32"])


def token_digest(stored: DataFrame) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 (over the ids as little-endian unsigned 32-bit integers)."""
    return stored.mapInArrow(_checksums, "doc_id long, start long, n_tokens long, ids_crc32 long")


def encode_documents(docs: DataFrame, tokenizer_path: str, *, end_id: int = END_ID) -> DataFrame:
    """Writes the documents' ids under the shared folder and returns the digest that is read from the files."""
    path = new_path(docs.sparkSession, "tokens")
    write_tokens(docs, tokenizer_path, path, end_id=end_id)
    return token_digest(read_tokens(docs.sparkSession, path))
