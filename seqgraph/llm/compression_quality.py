"""A quality classifier from two zstandard dictionaries.

One dictionary is trained on labelled good texts, one on bad texts. A text is compressed in blocks with each of them;
the difference of the two sizes over the text's length is its only feature. A logistic curve, fitted on labelled rows
that the dictionaries haven't seen, turns it into the probability of label 1; the intercept is set for the share of
good rows among all labelled rows.

The fit reads at most `sample_rows` labelled rows of each class (those with the least hash of their id, texts of at
most `sample_bytes` bytes: 128 MB in all); four fifths of them train the dictionaries, one fifth the curve. Scores are
made for all rows and whole texts. Defined results: null and empty texts have feature 0; of an id with several texts the
least teaches; labels are averaged where an id has several, null
labels and null ids don't teach; with no labelled row of one class every score is the share of good rows (0.5 with no
labels at all); repeated rows score alike; an empty table gives an empty result.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

ACCEPT = 0.3
SAMPLE_ROWS, SAMPLE_BYTES = 4000, 1 << 14
BLOCK, LEVEL, DICTIONARY = 256, 3, 110 << 10
FOLDS = 5


def held_out(doc_id) -> F.Column:
    """Whether crc32 of the id as text leaves remainder 0: rows that never teach. A null id counts as held out."""
    return F.coalesce(F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(FOLDS)) == 0, F.lit(True))


def _blocks(raw: bytes) -> list[bytes]:
    return [raw[i : i + BLOCK] for i in range(0, len(raw), BLOCK)]


class Compressors:
    """Compressed sizes of a text under the good and the bad dictionary."""

    def __init__(self, good: bytes, bad: bytes):
        made = []
        for raw in (good, bad):
            d = zstandard.ZstdCompressionDict(raw)
            d.precompute_compress(level=LEVEL)
            made.append(zstandard.ZstdCompressor(level=LEVEL, dict_data=d, write_checksum=False, write_content_size=False, write_dict_id=False))
        self.good, self.bad = made

    def feature(self, text: str | None) -> float:
        raw = (text or "").encode()
        difference = sum(len(self.bad.compress(b)) - len(self.good.compress(b)) for b in _blocks(raw))
        return difference / max(1, len(raw))


def _dictionary(texts: list[str]) -> bytes:
    samples = [b for t in texts for b in _blocks(t.encode())]
    total = sum(map(len, samples))
    try:
        return zstandard.train_dictionary(max(256, min(DICTIONARY, total // 8)), samples).as_bytes()
    except zstandard.ZstdError:  # too little text to train on: the texts themselves are the dictionary
        return b"".join(samples)[-DICTIONARY:] or b"-" * 8


def _logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1e-3) -> tuple[float, float]:
    """Intercept and slope by Newton steps on a standardised feature."""
    mean, sd = x.mean(), x.std() or 1.0
    a = np.stack([np.ones(len(x)), (x - mean) / sd], axis=1)
    w = np.zeros(2)
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(a @ w, -30, 30)))
        step = np.linalg.solve((a * (p * (1 - p))[:, None]).T @ a + ridge * np.eye(2), a.T @ (y - p) - ridge * w)
        w += step
        if np.abs(step).max() < 1e-9:
            break
    return float(w[0] - w[1] * mean / sd), float(w[1] / sd)


def fit(docs: DataFrame, labels: DataFrame, *, sample_rows: int = SAMPLE_ROWS, sample_bytes: int = SAMPLE_BYTES) -> dict:
    """The two dictionaries and the curve, as plain values."""
    labels = labels.select(F.col("doc_id").alias("_doc"), "quality").where("_doc IS NOT NULL AND quality IS NOT NULL").where(~held_out(F.col("_doc")))
    labels = labels.groupBy("_doc").agg((F.avg("quality") >= 0.5).cast("int").alias("_good"))
    counts = {r["_good"]: r["count"] for r in labels.groupBy("_good").count().collect()}
    n1, n0 = counts.get(1, 0), counts.get(0, 0)
    if not n1 or not n0:
        return {"share": n1 / (n1 + n0) if n1 + n0 else 0.5}
    order = F.xxhash64("_doc")
    picked = labels.where("_good = 1").orderBy(order, "_doc").limit(sample_rows).unionByName(labels.where("_good = 0").orderBy(order, "_doc").limit(sample_rows))
    # at most 2 * sample_rows ids: small enough to broadcast by that parameter
    rows = docs.select(F.col("doc_id").alias("_doc"), F.col("text").cast("string").alias("text")).where(F.octet_length("text").between(1, sample_bytes)).join(F.broadcast(picked), "_doc")
    rows = sorted((r["_doc"], r["_good"], r["text"]) for r in rows.groupBy("_doc", "_good").agg(F.min("text").alias("text")).collect())
    texts = {c: [t for _, g, t in rows if g == c] for c in (0, 1)}
    if min(map(len, texts.values())) < 2:
        return {"share": n1 / (n1 + n0)}
    taught = {c: [t for i, t in enumerate(found) if i % FOLDS] for c, found in texts.items()}
    rest = [(t, c) for c, found in texts.items() for t in found[::FOLDS]]
    good, bad = _dictionary(taught[1]), _dictionary(taught[0])
    made = Compressors(good, bad)
    x, y = np.array([made.feature(t) for t, _ in rest]), np.array([float(c) for _, c in rest])
    intercept, slope = _logistic(x, y)
    intercept += math.log(n1 / n0) - math.log(y.sum() / (len(y) - y.sum()))
    return {"good": good, "bad": bad, "intercept": intercept, "slope": slope}


_made: dict[int, Compressors] = {}


def _scored(shared):
    def run(batches):
        model = shared.value
        for batch in batches:
            if "share" in model:
                scores = np.full(len(batch), model["share"])
            else:
                key = hash((model["good"], model["bad"]))
                if key not in _made:
                    _made.clear()
                    _made[key] = Compressors(model["good"], model["bad"])
                x = np.array([_made[key].feature(t.as_py()) for t in batch.column(batch.schema.get_field_index("text"))], float)
                scores = 1 / (1 + np.exp(-np.clip(model["intercept"] + model["slope"] * x, -700, 700)))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(scores, pa.float64())], names=[*batch.schema.names, "score"])

    return run


def score(docs: DataFrame, model: dict) -> DataFrame:
    """`docs` with a column score (one of that name is replaced)."""
    docs = docs.drop("score").withColumn("text", F.col("text").cast("string"))
    shared = docs.sparkSession.sparkContext.broadcast(model)
    return docs.mapInArrow(_scored(shared), docs.withColumn("score", F.lit(0.0)).schema)
