"""SimHash near-duplicates found by anchor-point covering.

Fingerprints are 64-bit SimHashes of word shingles. Two fingerprints link if at most 3 bits differ. Each fingerprint is
two halves of 32 bits, so one half of a linked pair differs in at most one bit. On each half the anchors are the words
of a covering code: the [31, 26] Hamming code times one free bit, with covering radius 1. If x and y differ in at most
one bit, then the anchor within 1 of x is within 2 = radius + threshold of y; so each half is replicated to all anchors
within 2 (16.5 of 2^27 on average) and pairs are compared per anchor, over all 64 bits.
(A covering code of all 64 bits with threshold 3 would need thousands of replicas: 2,700 for two Golay codes with a
Hamming code, 8,100 for two Hamming codes; with halves it is 33.)

Only distinct fingerprints take part. Within an anchor the links leave as a spanning forest, never as all pairs; an
anchor with more than `crowded` fingerprints is first split by the bytes of the other half, one of which must agree
when at most 3 bits differ. Components follow by alternating stars.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import shuffle_partitions, staged, trim
from .components import components

SEED = 42
SHINGLE = 3
THRESHOLD = 3
CROWDED = 4096
#: Documents of one print beyond which they are dealt over SALTS parts.
HOT, SALTS = 1_000_000, 64


# --- fingerprints ----------------------------------------------------------------------------------------------------

def fingerprint(text: str | None, shingle: int = SHINGLE, block: int = 1 << 16) -> int:
    """The SimHash of one whole text: shingles with repeats, bits that are set in over half of their XXH64 values."""
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    n = max(1, len(words) - shingle + 1)
    flat = b" ".join(words)
    sizes = np.fromiter(map(len, words), np.int64, len(words))
    starts = np.concatenate([[0], np.cumsum(sizes[:-1] + 1)])
    ends = (starts + sizes)[min(shingle, len(words)) - 1 :].tolist()
    starts = starts[:n].tolist()
    digest, ones = xxhash.xxh64_intdigest, np.zeros(64, np.int64)
    for i in range(0, n, block):
        h = np.array([digest(flat[a:b], SEED) for a, b in zip(starts[i : i + block], ends[i : i + block])], np.uint64)
        ones += np.unpackbits(h.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > n, bitorder="little").view("<u8")[0])


def _fingerprints(shingle: int):
    def run(batches):
        for batch in batches:
            prints = np.fromiter((fingerprint(t.as_py(), shingle) for t in batch.column("text")), np.uint64, len(batch))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(prints.view(np.int64))], names=["doc_id", "print"])
        trim()

    return run


def fingerprints(docs: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """(doc_id, print) for each row; print is the 64-bit pattern as a signed long. Null and empty texts: 0."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(_fingerprints(shingle), "doc_id long, print long")


# --- anchors ---------------------------------------------------------------------------------------------------------

def _syndromes(x: np.ndarray) -> np.ndarray:
    """Of the 31 low bits: the xor of the positions (1 to 31) of the bits that are set; 0 for codewords."""
    out = np.zeros(len(x), np.int64)
    for bit in range(31):
        out ^= np.where((x >> bit) & 1, bit + 1, 0)
    return out


def near_anchors(halves: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row, anchor) for all anchors within 2 bits of each 32-bit half."""
    x = halves.astype(np.int64)
    s = _syndromes(x)
    bit = np.concatenate([[0], np.left_shift(np.int64(1), np.arange(31))])  # by position; position 0 flips nothing
    rows = np.arange(len(x))
    at_low = x ^ bit[s]  # the one anchor of the low 31 bits within 1
    found = [(rows, at_low), (rows, at_low ^ np.int64(1 << 31))]
    for i in range(1, 32):  # two flips at positions whose xor is the syndrome
        j = s ^ i
        ok = (s != 0) & (j > i)
        found.append((rows[ok], (x ^ bit[i] ^ bit[j])[ok]))
    return np.concatenate([r for r, _ in found]), np.concatenate([a for _, a in found])


def _replicas(batches):
    for batch in batches:
        prints = batch.column("print").to_numpy().view(np.uint64)
        for i in range(0, len(prints), 1 << 14):
            p = prints[i : i + (1 << 14)]
            for half in (0, 1):
                rows, anchors = near_anchors((p >> np.uint64(32 * half)) & np.uint64(0xFFFFFFFF))
                yield pa.RecordBatch.from_arrays([pa.array(anchors | (half << 32)), pa.array(p[rows].view(np.int64))], names=["anchor", "print"])


# --- links within a group --------------------------------------------------------------------------------------------

def forest(prints: np.ndarray, threshold: int, block: int = 2048) -> tuple[np.ndarray, np.ndarray]:
    """A spanning forest of the links among `prints`, as index pairs; distances are made a block at a time."""
    m = len(prints)
    if m <= block:
        near = np.bitwise_count(prints[:, None] ^ prints[None, :]) <= threshold
        if near.sum() == m:
            return np.empty(0, np.int64), np.empty(0, np.int64)
        row = near.__getitem__
    else:
        row = lambda i: np.bitwise_count(prints ^ prints[i]) <= threshold
    new, parents, children = np.ones(m, bool), [], []
    for root in range(m):
        if not new[root]:
            continue
        new[root], queue = False, [root]
        while queue:
            i = queue.pop()
            found = np.flatnonzero(row(i) & new)
            new[found] = False
            parents.append(np.full(len(found), i))
            children.append(found)
            queue += found.tolist()
    return np.concatenate(parents), np.concatenate(children)


def _compared(threshold: int):
    """Links of rows sorted by anchor; the last group of a batch waits for the next one."""

    def links(keys: np.ndarray, prints: np.ndarray):
        bounds = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1], [True]]))
        sizes, us, vs = np.diff(bounds), [], []
        small = np.repeat(sizes <= 8, sizes)
        for d in range(1, 8):  # pairs of small groups, all groups at a time
            if len(keys) > d:
                ok = (keys[d:] == keys[:-d]) & small[d:] & (np.bitwise_count(prints[d:] ^ prints[:-d]) <= threshold)
                us.append(prints[d:][ok])
                vs.append(prints[:-d][ok])
        for k in np.flatnonzero(sizes > 8):
            group = prints[bounds[k] : bounds[k + 1]]
            a, b = forest(group, threshold)
            us.append(group[a])
            vs.append(group[b])
        pairs = np.unique(np.stack([np.concatenate(us), np.concatenate(vs)], axis=1), axis=0) if us else np.empty((0, 2), np.uint64)
        return pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(pairs[:, k]).view(np.int64)) for k in (0, 1)], names=["u", "v"])

    def run(batches):
        keys, prints = np.empty((0,), np.int64), np.empty(0, np.uint64)
        for batch in batches:
            keys = np.concatenate([keys, batch.column("anchor").to_numpy()])
            prints = np.concatenate([prints, batch.column("print").to_numpy().view(np.uint64)])
            cut = int(np.searchsorted(keys, keys[-1])) if len(keys) else 0
            if cut:
                yield links(keys[:cut], prints[:cut])
                keys, prints = keys[cut:], prints[cut:]
        if len(keys):
            yield links(keys, prints)
        trim()

    return run


def near_links(prints: DataFrame, threshold: int = THRESHOLD, crowded: int = CROWDED) -> DataFrame:
    """(u, v) links that connect what is within `threshold` bits; `prints` has one row for each distinct print."""
    if threshold > 3:
        raise ValueError("two halves with covering radius 1 serve thresholds up to 3")
    rows = prints.mapInArrow(_replicas, "anchor long, print long")
    counts = rows.groupBy("anchor").count().where(F.col("count") > crowded).select("anchor", F.lit(True).alias("_crowded"))
    rows = rows.join(counts, "anchor", "left")
    # in a crowded anchor the other half's four bytes are keys: with 3 bits or fewer differing, one byte agrees
    other = F.when(F.col("anchor") < (1 << 32), F.shiftrightunsigned("print", 32)).otherwise(F.col("print").bitwiseAND(0xFFFFFFFF))
    byte = lambda k: F.shiftleft(F.lit(k * 256 + 1) + F.shiftrightunsigned(other, 8 * k).bitwiseAND(255), 34)
    keys = F.when(F.col("_crowded"), F.array(*[F.col("anchor").bitwiseOR(byte(k).cast("long")) for k in range(4)])).otherwise(F.array(F.col("anchor")))
    rows = rows.select(F.explode(keys).alias("anchor"), "print")
    rows = rows.repartition(shuffle_partitions(prints.sparkSession), "anchor").sortWithinPartitions("anchor")
    return rows.mapInArrow(_compared(threshold), "u long, v long")


def near_duplicates(docs: DataFrame, *, shingle: int = SHINGLE, threshold: int = THRESHOLD, hot: int = HOT) -> DataFrame:
    """One row for each row of `docs`: doc_id, print, component_id (the least doc_id of its component).

    Repeated rows stay; a null doc_id never names a component unless it has no other member. Null and empty texts
    share print 0 and link like any other. An empty table gives an empty result.
    """
    prints = staged(fingerprints(docs, shingle), "prints")
    classes = staged(prints.groupBy("print").agg(F.min("doc_id").alias("least"), F.count(F.lit(1)).alias("n")), "classes")
    roots = components(near_links(classes.select("print"), threshold))
    # print -> root print (itself without links) -> least doc_id over the root's prints
    placed = classes.join(roots, classes["print"] == roots["node"], "left").select("print", F.coalesce("root", "print").alias("root"), "least", "n")
    least = placed.groupBy("root").agg(F.min("least").alias("component_id"))
    # a print with many documents (empty ones, copies) is dealt over salts; there are at most rows / hot such prints
    crowd = classes.where(F.col("n") > hot).select("print", F.lit(True).alias("_hot"))
    salt = F.when(F.col("_hot"), F.pmod(F.xxhash64("doc_id"), F.lit(SALTS))).otherwise(F.lit(0)).cast("int")
    rows = prints.join(F.broadcast(crowd), "print", "left").withColumn("_salt", salt).drop("_hot")
    named = placed.join(least, "root").select("print", "component_id", F.explode(F.sequence(F.lit(0), F.when(F.col("n") > hot, SALTS - 1).otherwise(0))).alias("_salt"))
    return rows.join(named, ["print", "_salt"]).select("doc_id", "print", "component_id")


def keep_one(docs: DataFrame, *, shingle: int = SHINGLE, threshold: int = THRESHOLD) -> DataFrame:
    """`docs` with one row of each component: the row of its least doc_id (rows without a doc_id stay).

    Of rows that repeat that doc_id, the first by its other columns is kept.
    """
    found = near_duplicates(docs, shingle=shingle, threshold=threshold).where("doc_id = component_id").select("doc_id").distinct()
    # the join leaves the rows dealt by doc_id, so ranking repeats of an id moves no text again
    kept = docs.where("doc_id IS NOT NULL").join(found, "doc_id", "left_semi").select(F.struct(*docs.columns).alias("row"))
    rest = [F.col(f"row.`{c}`") for c in docs.columns if c != "doc_id"]
    first = kept.withColumn("rank", F.row_number().over(Window.partitionBy("row.doc_id").orderBy(*rest))).where("rank = 1").select("row.*")
    return first.unionByName(docs.where("doc_id IS NULL"))
