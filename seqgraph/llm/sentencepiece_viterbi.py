"""SentencePiece encoding by an Aho-Corasick automaton with a single-pass Viterbi, and exact decoding.

The automaton holds all normal pieces. It runs over a text once; at each position it reports the pieces that end there,
the longest first and then along its output links, and each relaxes the best score of its end from that of its start.
A character without a piece of its own may also be passed at the unknown score (least score - 10); it leaves as byte
pieces. The segmentation has the largest sum of the model's piece scores; of equal sums, the one with the longest last
piece. For a unigram model these are the library's ids. For a model that was trained as BPE the stored scores are
minus the merge ranks: the best sum under those scores is still what is returned, which isn't the merge order's result.

Texts are cut before each run of spaces if no piece has a space mark after another sign; such cuts can't change the
best sum, so each distinct unit is segmented once a worker.

A literal U+2581 in a text leaves as bytes, so that decode(encode(text)) == text for every text. Defined results: null
text has null ids, and decodes to null; an empty text has no ids; repeated rows are encoded alike.
"""

from __future__ import annotations

import hashlib

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Texts, slices, trim
from .unit_coder import UnitCoder

MARK = "\u2581"
UNKNOWN_PENALTY = 10.0


class Model:
    """Pieces, scores and flags of a SentencePiece model with byte pieces."""

    def __init__(self, proto: bytes):
        from sentencepiece import SentencePieceProcessor

        self.proto = proto
        sp = SentencePieceProcessor(model_proto=proto)
        n = sp.get_piece_size()
        self.pieces = [sp.id_to_piece(i) for i in range(n)]
        self.byte_ids = [-1] * 256
        self.automaton = ahocorasick.Automaton()
        normal, least = [], 0.0
        for i, piece in enumerate(self.pieces):
            if sp.is_byte(i):
                self.byte_ids[int(piece[3:5], 16)] = i
            elif not (sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i)):
                score = sp.get_score(i)
                self.automaton.add_word(piece, (i, len(piece), score))
                normal.append(piece)
                least = min(least, score)
        self.automaton.make_automaton()
        if min(self.byte_ids) < 0:
            raise ValueError("the model has no byte pieces, so decoding couldn't be exact")
        self.unknown = least - UNKNOWN_PENALTY
        self.single = {p for p in normal if len(p) == 1}
        self.longest = max(map(len, normal), default=1)
        self.cuts = not any(MARK in p.lstrip(MARK) for p in normal)
        self.bytes = [p.replace(MARK, " ").encode() if p in set_ else b"" for set_ in (set(normal),) for p in self.pieces]
        for b, i in enumerate(self.byte_ids):
            self.bytes[i] = bytes([b])

    def segment(self, text: str, block: int = 1 << 16) -> list[int]:
        """ids of a text whose spaces are marks already; long texts in blocks, so that memory stays flat.

        Each best path to a later sign passes one of the last `longest` places of a block. Where their paths meet, the
        segmentation before is settled: it leaves, and the next block begins there.
        """
        if len(text) <= block:
            return self._path(*self._relaxed(text), len(text), text)
        out, at, size = [], 0, block
        while at < len(text):
            part = text[at : at + size]
            best, back = self._relaxed(part)
            if at + size >= len(text):
                return out + self._path(best, back, len(part), part)
            ends = {p for p in range(len(part) - self.longest + 1, len(part) + 1) if best[p] > float("-inf")}
            while len(ends) > 1:
                p = max(ends)
                ends.remove(p)
                ends.add(p - back[p][1])
            met = ends.pop()
            out += self._path(best, back, met, part)
            at, size = at + met, block if met else 2 * size
        return out

    def _relaxed(self, text: str) -> tuple[list[float], list[tuple[int, int]]]:
        """The best sum up to each place, and the piece (-1: a sign without one) and length that it ends with."""
        n, single, unknown = len(text), self.single, self.unknown
        best, back, done = [0.0] + [float("-inf")] * n, [(0, 0)] * (n + 1), 0

        def pass_unknown(until: int) -> None:
            for p in range(done, until):
                if text[p] not in single and best[p] + unknown > best[p + 1]:
                    best[p + 1], back[p + 1] = best[p] + unknown, (-1, 1)

        for end, (piece, size, score) in self.automaton.iter(text):
            if end >= done:
                pass_unknown(end + 1)
                done = end + 1
            value = best[end + 1 - size] + score
            if value > best[end + 1]:
                best[end + 1], back[end + 1] = value, (piece, size)
        pass_unknown(n)
        return best, back

    def _path(self, best: list, back: list, p: int, text: str) -> list[int]:
        ids = []
        while p:
            piece, size = back[p]
            p -= size
            ids += [piece] if piece >= 0 else [self.byte_ids[b] for b in reversed(text[p].encode())]
        return ids[::-1]

    def unit(self, raw: bytes, opens: int) -> list[int]:
        """ids of a unit of a text; `opens`: it begins the text, so the model's dummy prefix comes first."""
        text = raw.decode()
        if MARK not in text:
            return self.segment((" " * opens + text).replace(" ", MARK))
        # a literal mark passes as bytes; no piece reaches across it
        mark, out = [self.byte_ids[b] for b in MARK.encode()], []
        for i, part in enumerate((" " * opens + text).split(MARK)):
            out += mark * (i > 0) + self.segment(part.replace(" ", MARK))
        return out

    def encode(self, text: str) -> list[int]:
        return self.unit(text.encode(), 1) if text else []

    def decode(self, ids) -> str:
        return b"".join(map(self.bytes.__getitem__, ids))[1:].decode()


_models: dict[int, tuple[Model, UnitCoder]] = {}


def _model(proto: bytes) -> tuple[Model, UnitCoder]:
    key = hash(proto)
    if key not in _models:
        model = Model(proto)
        _models[key] = model, UnitCoder(lambda units: [model.unit(raw, opens) for raw, opens in units], most=500_000, most_ids=4_000_000)
    return _models[key]


def _units(t: Texts, cuts: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts of the units, whether each begins its document, and the documents' bounds among them."""
    n = len(t.data)
    begins = np.zeros(n + 1, bool)
    begins[t.offsets] = True
    begins = begins[:-1]
    start = begins.copy()
    if cuts and n:
        space = t.data == 0x20
        start[1:] |= space[1:] & ~space[:-1]
    starts = np.flatnonzero(start)
    return starts, begins[starts], np.searchsorted(starts, t.offsets)


class _Decoder:
    """The bytes of each piece in one pool: a document's ids gather its text."""

    def __init__(self, model: Model):
        self.size = np.array([len(b) for b in model.bytes], np.int64)
        self.at, self.pool = np.cumsum(self.size) - self.size, np.frombuffer(b"".join(model.bytes), np.uint8)

    def __call__(self, ids: np.ndarray) -> bytes:
        """The text of one document, without the dummy prefix."""
        s = self.size[ids]
        total = int(s.sum())
        return self.pool[np.repeat(self.at[ids] - (np.cumsum(s) - s), s) + np.arange(total)].tobytes()[1:] if total else b""


def _encoded(proto, digest: bool):
    def run(batches):
        model, coder = _model(proto.value)
        decoder = _Decoder(model)
        for batch in batches:
            where = batch.schema.get_field_index("text")
            for i, j in slices(batch.column(where), 1 << 20):
                column = batch.column(where).slice(i, j - i)
                t = Texts(column)
                starts, opens, first = _units(t, model.cuts)
                ids, bounds = coder(t.data, starts, np.append(starts[1:], len(t.data))[: len(starts)], opens.astype(np.int8), first, None)
                valid = column.is_valid().to_numpy(zero_copy_only=False)
                tokens = pa.ListArray.from_arrays(pa.array(bounds.astype(np.int32)), pa.array(ids), mask=pa.array(~valid) if column.null_count else None)
                more = [tokens]
                if digest:
                    more.append(pa.array([hashlib.sha256(decoder(ids[a:b])).hexdigest() if ok else None for a, b, ok in zip(bounds[:-1], bounds[1:], valid)], pa.string()))
                rest = batch.slice(i, j - i)
                yield pa.RecordBatch.from_arrays([*rest.columns, *more], names=[*rest.schema.names, *("ids", "decoded_sha256")[: len(more)]])
        trim()

    return run


def encode(docs: DataFrame, model_path: str, *, digest: bool = False) -> DataFrame:
    """`docs` with a column ids (array of int), and with `digest` the sha256 of the text that these ids decode to.

    Columns of these names are replaced. The digest is made in the same Python worker, from the ids alone.
    """
    spark = docs.sparkSession
    with open(model_path, "rb") as f:
        proto = spark.sparkContext.broadcast(f.read())
    docs = docs.drop("ids", *["decoded_sha256"] * digest).withColumn("text", F.col("text").cast("string"))
    out = docs.withColumn("ids", F.lit(None).cast("array<int>"))
    out = out.withColumn("decoded_sha256", F.lit(None).cast("string")) if digest else out
    return docs.mapInArrow(_encoded(proto, digest), out.schema)


def _decoded(proto):
    def run(batches):
        decoder = _Decoder(_model(proto.value)[0])
        for batch in batches:
            column = batch.column(batch.schema.get_field_index("ids"))
            bounds, flat, valid = column.offsets.to_numpy(), column.values.to_numpy(), column.is_valid().to_pylist()
            texts = [decoder(flat[i:j]).decode() if ok else None for i, j, ok in zip(bounds[:-1], bounds[1:], valid)]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(texts, pa.string())], names=[*batch.schema.names, "decoded"])
        trim()

    return run


def decode(encoded: DataFrame, model_path: str) -> DataFrame:
    """`encoded` with a column decoded from its ids (one of that name is replaced)."""
    spark = encoded.sparkSession
    with open(model_path, "rb") as f:
        proto = spark.sparkContext.broadcast(f.read())
    encoded = encoded.drop("decoded")
    return encoded.mapInArrow(_decoded(proto), encoded.withColumn("decoded", F.lit(None).cast("string")).schema)
