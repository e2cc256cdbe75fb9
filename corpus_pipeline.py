"""A training corpus from raw documents: quality, near duplicates, repeated passages, mixture, token ids.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; `run` writes it as Parquet in the shared folder and
reads it back for the next one. All stages but the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from seqgraph.llm import compression_quality, mixing, sentencepiece_viterbi, simhash_dedup, substring_dedup
from seqgraph.llm.common import staged, table
from seqgraph.llm.queries import MIX_SEED, WEIGHTS, source_domain, tokenizer_file

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")
#: Share of the tokens that the mixture may hold; no document is taken twice here.
MIX_FRACTION = 0.9


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the compression classifier accepts; empty ones score as the curve's zero."""
    model = compression_quality.fit(docs, table(spark, sf_dir, "labels"))
    return compression_quality.score(docs.select(*COLUMNS), model).where(F.col("score") >= compression_quality.ACCEPT).select(*COLUMNS)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the least id of each group of near duplicates."""
    return simhash_dedup.keep_one(docs.select(*COLUMNS))


def cut_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without the passages of 35 words or more that occur twice or more; n_chars follows the text."""
    cut = substring_dedup.dedup_substrings(docs.select(*COLUMNS))
    return cut.withColumn("n_chars", F.when(F.col("n_removed") > 0, F.length("text").cast("long")).otherwise(F.col("n_chars"))).select(*COLUMNS)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each source's prefix of its seeded order, as the weights of domains, languages and sources give it tokens."""
    docs = docs.select(*COLUMNS)
    rows = staged(mixing.sizes(docs, source_domain()), "sizes")
    planned = staged(mixing.plan(rows, budget=None, fraction=MIX_FRACTION, weights=WEIGHTS, max_epochs=1, seed=MIX_SEED), "plan")
    return mixing.select(docs, planned, source_domain(), MIX_SEED).select(*COLUMNS)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of each document, and the digest of the text that they decode to."""
    model = tokenizer_file("piece_bpe_32k.model")
    encoded = sentencepiece_viterbi.encode(docs.select(*COLUMNS), model, digest=True).drop("text")
    return encoded.withColumn("n_tokens", F.size("ids").cast("long"))


STAGES = [
    ("quality classifier", keep_good),
    ("simhash near-dedup", drop_near_duplicates),
    ("substring dedup", cut_repeats),
    ("mixing", mix),
    ("sentencepiece", encode),
]

#: Dictionaries, fingerprints and segmentations are beyond SQL; tests/llm compares the stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = staged(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return docs
