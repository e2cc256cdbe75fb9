"""Cross-entropy difference of two matched n-gram models.

Tokens are the words `[^\\x20\\x09-\\x0D]+` of a text and an end sign. Both models are bigram models over one vocabulary
(all words of all documents and the end sign) with the same smoothing, and differ in their counts alone: the target model
counts the documents named as target, the background model all others. Smoothing is a Dirichlet prior from one order to
the next: P(w | h) = (c(h w) + B P(w)) / (c(h) + B), P(w) = (c(w) + A / V) / (N + A).

A document is left out of its own model's counts when it is scored, so that no document is scored by a model that has
learnt it. Losses are means over its tokens, in bits; its score is loss(target) - loss(background): the lower, the more
it is like the target.

Counts cover every word of every document and grow with the corpus; they stay in distributed tables. Documents travel in
units of chunks (units.py): a unit sends each of its distinct n-grams once, with its counts for both models, to the bucket
of the n-gram's hash, and gets the corpus' counts back. So a pair that a third of all documents share is one entry a
unit. N-grams are told apart by 48 bits within a bucket of about `BUCKET_KEYS` entries.

Defined results: null and empty texts are one end sign; repeated rows are documents of their own; columns named like the
added ones are replaced; an empty table gives an empty result; an empty target or background model is uniform.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import units
from .common import Hash, Texts, mix64, staged, trim
from .units import bucket, groups

#: Prior weights of the vocabulary's uniform distribution (A) and of the words' distribution (B).
A, B = 1000.0, 5.0
BUCKET_KEYS = 2_000_000
#: A unit's tokens take about ten times its text in memory.
CHUNK_BYTES = 1 << 20
#: Bytes of text for each distinct n-gram of a unit, at least on average.
KEY_BYTES = 8

_WORDS = Hash(31)
_START, _END = np.uint64(0x9F1D3C5B7A860E42), np.uint64(0x51C64E6D2A9B8F37)
_START_KEY, _TOTAL_KEY = mix64(np.array([0xA5A5, 0x5A5A], np.uint64))
_SENT = "bucket int, unit long, keys binary, words binary, target binary, background binary"
_BACK = "bucket int, unit long, target binary, background binary, vocabulary long, doc_id long"
_SCORES = "doc_id long, n_tokens long, loss_target double, loss_background double, score double"


def _planes(counts: np.ndarray) -> bytes:
    """Whole numbers as byte planes after a byte with the number of planes."""
    raw = counts.astype("<u8").view(np.uint8).reshape(-1, 8).T
    n = next((i for i in range(8, 1, -1) if raw[i - 1].any()), 1)
    return bytes([n]) + np.ascontiguousarray(raw[:n]).tobytes()


def _counts(blob) -> np.ndarray:
    raw = np.frombuffer(blob, np.uint8)
    rows = raw[1:].reshape(int(raw[0]), -1)
    out = np.zeros((rows.shape[1], 8), np.uint8)
    out[:, : len(rows)] = rows.T
    return out.view("<u8").ravel().astype(np.int64)


class _Tokens:
    """The tokens of a chunk's documents: the places of their words and pairs among the chunk's distinct keys."""

    def __init__(self, blob, targets: np.ndarray):
        batch = units.unpack(blob)
        t, ids = Texts(batch.column("text")), batch.column("doc_id")
        n = len(t)
        self.ids, self.sizes = ids, np.diff(t.first) + 1
        self.starts = np.cumsum(self.sizes) - self.sizes
        self.docs = np.repeat(np.arange(n, dtype=np.int32), self.sizes)
        known = ids.is_valid().to_numpy(zero_copy_only=False)
        self.target = known & np.isin(ids.fill_null(0).to_numpy(), targets) if len(targets) else np.zeros(n, bool)
        token = np.empty(len(self.docs), np.uint64)
        word = np.ones(len(token), bool)
        word[self.starts + self.sizes - 1] = False
        token[word], token[~word] = _WORDS.words(t.data, t.starts, t.ends), _END
        before = np.empty_like(token)
        before[1:] = token[:-1]
        before[self.starts] = _START
        keys = np.concatenate([mix64(token ^ np.uint64(0xC2B2AE3D27D4EB4F)), mix64(before * np.uint64(0x9E3779B97F4A7C15) + token)])
        self.keys, places = np.unique(keys, return_inverse=True)
        self.places = places.ravel().astype(np.int32)
        m = len(token)
        self.words = np.zeros(len(self.keys), bool)
        self.words[self.places[:m]] = True
        self.all = np.bincount(self.places, minlength=len(self.keys))
        of_target = np.concatenate([self.target[self.docs]] * 2)
        self.of_target = np.bincount(self.places[of_target], minlength=len(self.keys))


class _Unit:
    """A unit's distinct keys in ascending order, and their counts in it."""

    def __init__(self, chunks: pa.Table, targets: np.ndarray):
        chunks = chunks.sort_by("chunk").combine_chunks()
        self.parts = [_Tokens(chunks.column("blob")[i].as_buffer(), targets) for i in range(len(chunks))]
        # documents and tokens, of the target and of all
        own = np.zeros((2, 2), np.int64)
        for p in self.parts:
            own += [[p.target.sum(), len(p.sizes)], [p.sizes[p.target].sum(), p.sizes.sum()]]
        self.keys, places = np.unique(np.concatenate([*[p.keys for p in self.parts], [_START_KEY, _TOTAL_KEY]]), return_inverse=True)
        places = places.ravel()
        add = lambda values: np.bincount(places, weights=np.concatenate(values), minlength=len(self.keys)).astype(np.int64)
        self.target = add([*[p.of_target for p in self.parts], own[:, 0]])
        self.background = add([*[p.all for p in self.parts], own[:, 1]]) - self.target
        self.words = add([*[p.words for p in self.parts], [0, 0]]) > 0
        self.start, self.total = places[-2], places[-1]
        bounds = np.cumsum([0, *[len(p.keys) for p in self.parts]])
        #: for each chunk, the place of its keys among the unit's
        self.place = [places[i:j].astype(np.int32) for i, j in zip(bounds[:-1], bounds[1:])]
        for p in self.parts:  # what the unit has summed
            p.keys = p.words = p.all = p.of_target = None


def _targets(table: pa.Table) -> np.ndarray:
    return table.column("doc_id").drop_null().to_numpy()


def _send(bits: int):
    def run(chunks: pa.Table, named: pa.Table) -> pa.Table:
        if not len(chunks):
            return units.as_table([], _SENT)
        u, number = _Unit(chunks, _targets(named)), chunks.column("unit")[0].as_py()
        found, bounds = groups(bucket(u.keys, bits))
        low = (u.keys << np.uint64(bits)) >> np.uint64(16)
        rows = []
        for k, key in enumerate(found):
            s = slice(bounds[k], bounds[k + 1])
            raw = np.ascontiguousarray(low[s].astype("<u8").view(np.uint8).reshape(-1, 8)[:, :6].T).tobytes()
            rows.append((int(key), number, raw, np.packbits(u.words[s]).tobytes(), _planes(u.target[s]), _planes(u.background[s])))
        del u
        trim()
        return units.as_table(rows, _SENT)

    return run


def _summed(group: pa.Table) -> pa.Table:
    """One bucket: each unit gets the corpus' counts of its own keys back, in its own order."""
    group = group.combine_chunks()
    keys, words, target, background = [], [], [], []
    for row in range(len(group)):
        raw = np.frombuffer(group.column("keys")[row].as_buffer(), np.uint8).reshape(6, -1)
        wide = np.zeros((raw.shape[1], 8), np.uint8)
        wide[:, :6] = raw.T
        keys.append(wide.view("<u8").ravel())
        words.append(np.unpackbits(np.frombuffer(group.column("words")[row].as_buffer(), np.uint8))[: raw.shape[1]].astype(bool))
        for out, name in ((target, "target"), (background, "background")):
            out.append(_counts(group.column(name)[row].as_buffer()))
    bounds = np.cumsum([0, *map(len, keys)])
    distinct, places = np.unique(np.concatenate(keys), return_inverse=True)
    places = places.ravel()
    sums = [np.bincount(places, weights=np.concatenate(c), minlength=len(distinct)).astype(np.int64) for c in (target, background)]
    vocabulary = int(np.count_nonzero(np.bincount(places[np.concatenate(words)], minlength=len(distinct))))
    rows = []
    for i, (b, u) in enumerate(zip(group.column("bucket").to_pylist(), group.column("unit").to_pylist())):
        mine = places[bounds[i] : bounds[i + 1]]
        rows.append((b, u, _planes(sums[0][mine]), _planes(sums[1][mine]), vocabulary, None))
    trim()
    return units.as_table(rows, _BACK)


def _scored(vocabulary: int):
    def run(chunks: pa.Table, said: pa.Table) -> pa.Table:
        if not len(chunks):
            return units.schema(_SCORES).empty_table()
        named = said.filter(pc.is_null(said.column("target")))
        said = said.filter(pc.is_valid(said.column("target"))).sort_by("bucket").combine_chunks()
        u = _Unit(chunks, _targets(named))
        models = [np.concatenate([_counts(said.column(name)[i].as_buffer()) for i in range(len(said))]) for name in ("target", "background")]
        del said
        out = []
        for p, place in zip(u.parts, u.place):
            m = len(p.docs)
            first = np.zeros(m, bool)
            first[p.starts] = True
            # how often each token's pair, word and context occur in its own document
            both = np.concatenate([p.docs, p.docs]).astype(np.int64) * len(place) + p.places
            _, inverse, often = np.unique(both, return_inverse=True, return_counts=True)
            often = often[inverse.ravel()]
            word, pair = place[p.places[:m]], place[p.places[m:]]
            context, own_context = np.empty_like(word), np.empty(m, np.int64)
            context[1:], own_context[1:] = word[:-1], often[: m - 1]
            context[first], own_context[first] = u.start, 1
            own = {"pair": often[m:], "word": often[:m], "context": own_context, "total": p.sizes[p.docs]}
            mine, found = p.target[p.docs], []
            for model, leave in zip(models, (mine, ~mine)):
                c = {"pair": model[pair], "word": model[word], "context": model[context], "total": model[u.total]}
                c = {name: values - leave * own[name] for name, values in c.items()}
                low = (c["word"] + A / vocabulary) / (c["total"] + A)
                loss = -np.log2((c["pair"] + B * low) / (c["context"] + B))
                found.append(np.add.reduceat(loss, p.starts) / p.sizes)
            out.append(pa.Table.from_arrays([p.ids.cast(pa.int64()), pa.array(p.sizes.astype(np.int64)), pa.array(found[0]), pa.array(found[1]), pa.array(found[0] - found[1])], schema=units.schema(_SCORES)))
        del u, models
        trim()
        return pa.concat_tables(out)

    return run


def score(docs: DataFrame, target_ids: DataFrame, *, bucket_keys: int = BUCKET_KEYS, chunk_bytes: int = CHUNK_BYTES) -> DataFrame:
    """doc_id, n_tokens, loss_target, loss_background, score of each row of `docs`; `target_ids` has the target's doc_ids."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    chunks = units.stored(rows, chunk_bytes, ids="doc_id")
    # which of a unit's documents are the target's: ids alone are joined, and texts stay where they lie
    ids = target_ids.select(F.col("doc_id").cast("long").alias("doc_id")).where("doc_id IS NOT NULL").distinct()
    named = staged(chunks.select("unit", F.explode("ids").alias("doc_id")).where("doc_id IS NOT NULL").distinct().join(ids, "doc_id", "left_semi"), "named")
    chunks = chunks.drop("ids")
    total = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    bits = max(0, int(np.ceil(np.log2(max(1.0, total / KEY_BYTES / bucket_keys)))))
    sent = chunks.groupBy("unit").cogroup(named.groupBy("unit")).applyInArrow(_send(bits), _SENT)
    back = staged(sent.groupBy("bucket").applyInArrow(_summed, _BACK), "counts")
    vocabulary = back.groupBy("bucket").agg(F.max("vocabulary").alias("n")).agg(F.sum("n")).first()[0] or 1
    empty = [F.lit(None).cast(kind).alias(name) for name, kind in (("target", "binary"), ("background", "binary"), ("vocabulary", "long"))]
    said = back.unionByName(named.select(F.lit(-1).alias("bucket"), "unit", *empty, "doc_id"))
    return chunks.groupBy("unit").cogroup(said.groupBy("unit")).applyInArrow(_scored(vocabulary), _SCORES)
