"""Exact substring deduplication with fixed-block anchors.

A repeat is a run of `window` words whose sequence starts at two places or more. With blocks of
`block = (window + 1) // 2` words at every multiple of `block` in each document, each window holds a whole block.
So a window can only repeat if the block it holds also occurs elsewhere as some rolling window of that size:

1. index   every document's non-overlapping blocks;
2. probe   them with every rolling window of `block` words: blocks that two or more positions share are anchors;
3. extend  anchors to the windows around them; those that repeat word for word (compared by 96-bit fingerprints)
           join into maximal exact repeats, whose words are removed.

Documents travel as chunks: rows of compressed record batches of a bounded size; units of a few chunks speak with the
hash buckets (units.py). For each bucket that it has values for, a unit sends its sorted, distinct values and those that
it has twice or more, so a passage that is shared by a third of all documents adds one value per unit, whatever its
count; no pair of occurrences is ever made. Buckets are sized from the corpus' byte count. Exact copies of a document are found in the same exchange, by a 128-bit
fingerprint; one of them stands for all in step 3.

Defined results: null text counts as empty (no words, nothing removed); repeated rows are documents of their own, so
they remove each other's windows; documents with fewer words than `window` are returned unchanged; an empty table gives
an empty result. Input columns keep their names; the columns added are n_words, n_removed, kept_sha256 and, where asked
for, a new text. A column of the input with such a name is replaced.
"""

from __future__ import annotations

import hashlib
from itertools import compress

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import units
from .common import Hash, Texts, mix64, new_path, trim
from .units import CHUNK_BYTES, Parts, Replies, bucket, flat, groups, residual

WINDOW = 35
BUCKET_WORDS = 8_000_000
#: Bytes of text that a word takes at least on average; with fewer bytes a bucket holds more words, never fewer results.
WORD_BYTES = 6

_A, _B = Hash(11), Hash(23)
_SENT = "bucket int, unit long, first int, plain binary, multi binary, blocks binary, sizes binary, docs binary, doc_sizes binary"
_BACK = "bucket int, unit long, first int, flags binary, sizes binary, doc_flags binary, doc_sizes binary"
_PRINTS = "bucket int, unit long, prints binary, twice binary, sizes binary"
_PRINT = np.dtype([("a", "<u8"), ("b", "<u4")])
_KEY = np.dtype([("a", "<u8"), ("b", "<u8")])


# --- what a chunk computes -------------------------------------------------------------------------------------------

class _Chunk:
    """Rolling hashes of the documents of a chunk that are long enough to hold a window."""

    def __init__(self, blob, window: int):
        self.batch = units.unpack(blob)
        self.texts = t = Texts(self.batch.column("text"))
        self.window, self.block = window, (window + 1) // 2
        self.counts = np.diff(t.first)
        self.long = np.flatnonzero(self.counts >= window)
        self.a = _A.words(t.data, t.starts, t.ends) if len(self.long) else None
        self._b = None

    def rolling(self, d: int, size: int, second: bool = False) -> np.ndarray:
        if second and self._b is None:  # only chunks with anchors need the second hash
            t = self.texts
            self._b = _B.words(t.data, t.starts, t.ends)
        words = (self._b if second else self.a)[self.texts.first[d] : self.texts.first[d + 1]]
        return (_B if second else _A).windows(words, size)

    def blocks(self, rolled: bool) -> tuple[np.ndarray, list[np.ndarray]]:
        """All rolling hashes (if wanted), and the aligned blocks' hashes by document."""
        every, blocks = [], []
        for d in self.long:
            r = self.rolling(d, self.block)
            blocks.append(r[:: self.block])
            if rolled:
                every.append(r)
        return np.concatenate(every) if every else np.empty(0, np.uint64), blocks

    def doc_keys(self) -> np.ndarray:
        """128-bit fingerprints of the long documents' word sequences."""
        out = np.empty(len(self.long), _KEY)
        for i, d in enumerate(self.long):
            out[i] = np.frombuffer(hashlib.blake2b(b" ".join(self.texts.raw(d).split()), digest_size=16).digest(), _KEY)[0]
        return out


def _joined(parts: list[np.ndarray], kind=np.uint64) -> np.ndarray:
    return np.concatenate(parts) if parts else np.empty(0, kind)


def _probe(bits: int, window: int):
    """Steps 1 and 2, map side: blocks and rolling windows of each run of a unit's chunks, by bucket of their hash."""

    def said(unit: int, first: int, held: list):
        every = np.concatenate([r for r, _, _ in held])
        every.sort()
        keys = every >> np.uint64(32 - bits)  # bucket and residual
        new = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if len(keys) else np.empty(0, np.int64)
        distinct, counts = keys[new], np.diff(np.append(new, len(keys)))
        multi = distinct[counts > 1]
        low = np.uint64(0xFFFFFFFF)
        out: dict[int, dict] = {}
        for name, values in (("plain", distinct), ("multi", multi)):
            found, bounds = groups((values >> np.uint64(32)).astype(np.int64))
            for k, key in enumerate(found):
                part = (values[bounds[k] : bounds[k + 1]] & low).astype("<u4")
                out.setdefault(int(key), {})[name] = units.squeeze(part) if name == "plain" else part.tobytes()
        for key, raw, sizes in Parts([residual(b, bits) for _, b, _ in held], [bucket(b, bits) for _, b, _ in held]):
            out.setdefault(key, {}).update(blocks=raw, sizes=sizes)
        for key, raw, sizes in Parts([d for _, _, d in held], [bucket(mix64(d["a"]), bits) for _, _, d in held]):
            out.setdefault(key, {}).update(docs=raw, doc_sizes=sizes)
        names = [f.name for f in units.schema(_SENT)][3:]
        yield from units.batches([(key, unit, first, *[row.get(n) for n in names]) for key, row in out.items()], _SENT)

    def run(batches):
        unit, first, held = None, 0, []
        for batch in batches:
            for row in range(len(batch)):
                here, chunk = batch.column("unit")[row].as_py(), batch.column("chunk")[row].as_py()
                if here != unit or chunk != first + len(held):
                    if held:
                        yield from said(unit, first, held)
                    unit, first, held = here, chunk, []
                c = _Chunk(batch.column("blob")[row].as_buffer(), window)
                every, blocks = c.blocks(True)
                held.append((every, _joined(blocks), c.doc_keys()))
                del c
            trim()
        if held:
            yield from said(unit, first, held)
        trim()

    return run


def _member(values: np.ndarray, found: np.ndarray) -> np.ndarray:
    """Which `values` are in the sorted array `found`."""
    if not len(found):
        return np.zeros(len(values), bool)
    return found[np.minimum(np.searchsorted(found, values), len(found) - 1)] == values


def _anchors(group: pa.Table) -> pa.Table:
    """Step 2, one bucket: which blocks occur at two positions or more; which documents are copies (1 first, 2 later)."""
    group = group.sort_by([("unit", "ascending"), ("first", "ascending")]).combine_chunks()
    plain = group.column("plain").combine_chunks()
    parts = [units.expand(plain[i].as_buffer()) for i in range(len(plain)) if plain[i].is_valid]
    values = np.sort(np.concatenate([*parts, flat(group.column("multi"), "<u4")[0]]))
    repeated = units.groups(values[1:][values[1:] == values[:-1]])[0]
    del parts, values
    blocks, n_blocks = flat(group.column("blocks"), "<u4")
    hits = _member(blocks, repeated).astype(np.uint8)
    keys, n_docs = flat(group.column("docs"), _KEY)
    _, first, inverse, counts = np.unique(keys, return_index=True, return_inverse=True, return_counts=True)
    state = np.where(counts[inverse.ravel()] > 1, 2, 0).astype(np.uint8)
    state[first[counts > 1]] = 1
    at, doc_at = np.cumsum(n_blocks) - n_blocks, np.cumsum(n_docs) - n_docs
    same = [group.column(k).to_pylist() for k in ("bucket", "unit", "first", "sizes", "doc_sizes")]
    rows = [
        (b, u, f, hits[at[i] : at[i] + n_blocks[i]].tobytes(), sizes, state[doc_at[i] : doc_at[i] + n_docs[i]].tobytes(), doc_sizes)
        for i, (b, u, f, sizes, doc_sizes) in enumerate(zip(*same))
    ]
    return units.as_table(rows, _BACK)


class _Candidates:
    """Windows of a chunk that hold an anchor, with their fingerprints."""

    def __init__(self, c: _Chunk, number: int, hits: Replies, copies: Replies, bits: int):
        w, b = c.window, c.block
        _, blocks = c.blocks(False)
        hit = hits.of(number, bucket(_joined(blocks), bits)).astype(bool)
        self.copy = copies.of(number, bucket(mix64(c.doc_keys()["a"]), bits))
        self.windows, prints, at = [], [], 0
        for i, d in enumerate(c.long):
            mine = hit[at : at + len(blocks[i])]
            at += len(mine)
            found = np.empty(0, np.int64)
            if self.copy[i] < 2 and mine.any():
                total = c.counts[d] - w + 1
                # the block that starts at or after s, and not beyond s + block - 1, lies within window s
                found = np.flatnonzero(mine[(np.arange(total) + b - 1) // b])
            self.windows.append(found)
            if len(found):
                prints.append(np.stack([c.rolling(d, w)[found], c.rolling(d, w, True)[found]], axis=1))
        self.prints = np.concatenate(prints) if prints else np.empty((0, 2), np.uint64)

    def distinct(self):
        """Distinct fingerprints in ascending order, the place of each window's, and how often each occurs."""
        if not len(self.prints):
            return self.prints, np.empty(0, np.int64), np.empty(0, np.int64)
        order = np.lexsort((self.prints[:, 1], self.prints[:, 0]))
        p = self.prints[order]
        new = np.ones(len(p), bool)
        new[1:] = (p[1:] != p[:-1]).any(axis=1)
        place = np.empty(len(p), np.int64)
        place[order] = np.cumsum(new) - 1
        return p[new], place, np.diff(np.append(np.flatnonzero(new), len(p)))


def _extend(bits: int, window: int):
    """Step 3, map side: fingerprints of the windows around anchors, by bucket."""

    def run(chunks: pa.Table, said: pa.Table) -> pa.Table:
        hits, copies = Replies(said, "flags", "sizes"), Replies(said, "doc_flags", "doc_sizes")
        chunks, values, buckets = chunks.sort_by("chunk").combine_chunks(), [], []
        packed_kind = np.dtype([*_PRINT.descr, ("twice", "u1")])
        for row in range(len(chunks)):
            c = _Chunk(chunks.column("blob")[row].as_buffer(), window)
            prints, _, counts = _Candidates(c, chunks.column("chunk")[row].as_py(), hits, copies, bits).distinct()
            packed = np.empty(len(prints), packed_kind)
            packed["a"], packed["b"], packed["twice"] = prints[:, 0], prints[:, 1] & np.uint64(0xFFFFFFFF), counts > 1
            values.append(packed)
            buckets.append(bucket(prints[:, 0], bits))
            del c
        rows = []
        for key, raw, sizes in Parts(values, buckets):
            part = np.frombuffer(raw, packed_kind)
            plain = np.empty(len(part), _PRINT)
            plain["a"], plain["b"] = part["a"], part["b"]
            rows.append((key, chunks.column("unit")[0].as_py(), plain.tobytes(), part["twice"].tobytes(), sizes))
        trim()
        return units.as_table(rows, _PRINTS)

    return run


def _confirm(group: pa.Table) -> pa.Table:
    """Step 3, one bucket: which of each unit's fingerprints start at another place too."""
    group = group.combine_chunks()
    prints, n = flat(group.column("prints"), _PRINT)
    repeated = flat(group.column("twice"), np.uint8)[0].astype(bool)
    order = np.lexsort((prints["b"], prints["a"]))
    s = prints[order]
    same = (s["a"][1:] == s["a"][:-1]) & (s["b"][1:] == s["b"][:-1])
    repeated[order[1:][same]] = True
    repeated[order[:-1][same]] = True
    flags, at = repeated.astype(np.uint8), np.cumsum(n) - n
    rows = [(b, u, 0, flags[at[i] : at[i] + n[i]].tobytes(), sizes, None, None) for i, (b, u, sizes) in enumerate(zip(*[group.column(k).to_pylist() for k in ("bucket", "unit", "sizes")]))]
    return units.as_table(rows, _BACK)


def _covered(starts: np.ndarray, n: int, window: int) -> np.ndarray:
    """Words under any of the windows that begin at `starts`: the maximal repeats."""
    step = np.zeros(n + 1, np.int32)
    np.add.at(step, starts, 1)
    np.add.at(step, starts + window, -1)
    return np.cumsum(step[:-1]) > 0


def _cut(raw: bytes, starts: np.ndarray, drop: np.ndarray) -> bytes:
    """`raw` without the dropped words and the white space after them; the rest stays byte for byte."""
    edges = np.flatnonzero(np.diff(np.concatenate([[0], drop.view(np.int8), [0]])))
    out, at = [], 0
    for i, j in edges.reshape(-1, 2):
        out.append(raw[at : starts[i]])
        at = starts[j] if j < len(starts) else len(raw)
    return b"".join([*out, raw[at:]])


def _finish(bits: int, window: int, schema: pa.Schema, new_text: bool):
    def run(chunks: pa.Table, said: pa.Table) -> pa.Table:
        confirmed = pc.is_null(said.column("doc_flags")) if len(said) else pa.array([], pa.bool_())
        second = said.filter(confirmed)
        # a row of the first exchange has document flags, if only empty ones
        said = said.filter(pc.invert(confirmed))
        hits, copies, repeats = Replies(said, "flags", "sizes"), Replies(said, "doc_flags", "doc_sizes"), Replies(second, "flags", "sizes")
        parts = []
        chunks = chunks.combine_chunks()
        for row in range(len(chunks)):
            c, number = _Chunk(chunks.column("blob")[row].as_buffer(), window), chunks.column("chunk")[row].as_py()
            t, drops = c.texts, {}
            if len(c.long):
                found = _Candidates(c, number, hits, copies, bits)
                prints, place, _ = found.distinct()
                yes = repeats.of(number, bucket(prints[:, 0], bits)).astype(bool)
                at = 0
                for i, d in enumerate(c.long):
                    here = found.windows[i]
                    starts = here[yes[place[at : at + len(here)]]]
                    at += len(here)
                    if found.copy[i]:
                        drops[int(d)] = np.ones(c.counts[d], bool)
                    elif len(starts):
                        drops[int(d)] = _covered(starts, c.counts[d], window)
            removed, digests, texts = np.zeros(len(t), np.int64), [], []
            for d in range(len(t)):
                raw, drop = t.raw(d), drops.get(d)
                words = raw.split()
                if drop is not None:
                    removed[d] = int(drop.sum())
                    words = compress(words, (~drop).tolist())
                digests.append(hashlib.sha256(b" ".join(words)).hexdigest())
                if new_text:
                    texts.append(raw if drop is None else _cut(raw, t.starts[t.first[d] : t.first[d + 1]] - t.offsets[d], drop))
            columns = {name: c.batch.column(name) for name in c.batch.schema.names}
            if new_text:
                valid = c.batch.column("text").is_valid().to_pylist()
                columns["text"] = pa.array([x.decode() if v else None for x, v in zip(texts, valid)], pa.string())
            columns |= {"n_words": pa.array(c.counts, pa.int64()), "n_removed": pa.array(removed), "kept_sha256": pa.array(digests, pa.string())}
            parts.append(pa.Table.from_pydict(columns).select(schema.names).cast(schema))
            del c, t, drops, texts
        trim()
        return pa.concat_tables(parts) if parts else schema.empty_table()

    return run


def dedup_substrings(docs: DataFrame, *, window: int = WINDOW, new_text: bool = True, bucket_words: int = BUCKET_WORDS, chunk_bytes: int = CHUNK_BYTES) -> DataFrame:
    """Every row of `docs` with its repeated passages cut out of `text` (kept as it was if not `new_text`)."""
    from pyspark.sql.pandas.types import to_arrow_schema

    spark = docs.sparkSession
    docs = docs.drop("n_words", "n_removed", "kept_sha256")
    chunks = units.stored(docs, chunk_bytes)
    total = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    bits = max(0, int(np.ceil(np.log2(max(1, total / WORD_BYTES / bucket_words)))))

    sent = chunks.mapInArrow(_probe(bits, window), _SENT)
    anchors_path = new_path(spark, "anchors")
    sent.groupBy("bucket").applyInArrow(_anchors, _BACK).write.parquet(anchors_path)
    anchors = spark.read.schema(_BACK).parquet(anchors_path)

    prints = chunks.groupBy("unit").cogroup(anchors.groupBy("unit")).applyInArrow(_extend(bits, window), _PRINTS)
    confirmed = prints.groupBy("bucket").applyInArrow(_confirm, _BACK)

    out = T.StructType([*docs.schema.fields, T.StructField("n_words", T.LongType()), T.StructField("n_removed", T.LongType()), T.StructField("kept_sha256", T.StringType())])
    if not new_text:
        out = T.StructType([f for f in out.fields if f.name != "text"])
    said = anchors.unionByName(confirmed)
    finish = _finish(bits, window, to_arrow_schema(out), new_text)
    return chunks.groupBy("unit").cogroup(said.groupBy("unit")).applyInArrow(finish, out)
