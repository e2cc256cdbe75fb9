"""The registered queries of this subpackage: each applies one operator to its whole table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import chat_format, compression_quality, cross_entropy, cross_polytope, mixing, sentencepiece_viterbi, simhash_dedup, substring_dedup, token_files, va_file
from .common import staged, table

#: Weights of the mixing query; names that aren't listed weigh 1.
WEIGHTS = {"domain": {"d0": 5.0, "d1": 3.0, "d2": 2.0}, "lang": {"en": 4.0, "de": 2.0, "fr": 2.0, "es": 1.0}, "source": {"src0": 1.0}}
MIX_SEED = 20240229


def tokenizer_file(name: str) -> str:
    import public_tokenizers

    return str(public_tokenizers.path(name))


def source_domain() -> F.Column:
    """A stand-in for a table of source domains: three domains by the source's digest."""
    digest = F.md5(F.coalesce(F.col("source"), F.lit("")).cast("binary"))
    return F.concat(F.lit("d"), F.pmod(F.conv(F.substring(digest, 1, 7), 16, 10).cast("long"), F.lit(3)).cast("string"))


def op1_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    odd = F.lit("\\### Assistant: </turn> ok")
    more = spark.range(2).select(F.lit(-7).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), odd.alias("text"))
    return chat_digest(chat_format.format_windows(turns.unionByName(more)))


def chat_digest(windows: DataFrame) -> DataFrame:
    """Per conversation, what reading the windows back gives."""
    back = chat_format.read_windows(windows)
    line = F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n")))
    parts = back.select("conv_id", F.struct("segment", "window", F.array_join(line, "").alias("turns"), F.array_join("targets", "").alias("targets")).alias("part"), F.size("turns").cast("long").alias("n"), "chars")
    whole = parts.groupBy("conv_id").agg(F.sort_array(F.collect_list("part")).alias("parts"), F.sum("n").alias("n_turns"), F.sum("chars").alias("formatted_chars"))
    turns, targets = F.array_join(F.col("parts.turns"), ""), F.array_join(F.col("parts.targets"), "")
    return whole.select(
        "conv_id", "n_turns", F.sha2(turns.cast("binary"), 256).alias("turns_sha256"), F.length(targets).cast("long").alias("loss_chars"),
        F.sha2(targets.cast("binary"), 256).alias("loss_sha256"), "formatted_chars", F.size("parts").cast("long").alias("n_windows"),
    )


def op2_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_files.encode_documents(table(spark, sf_dir, "documents").select("doc_id", "text"), tokenizer_file("word_bpe_49k.json"))


def op3_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return substring_dedup.dedup_substrings(docs, window=35, new_text=False)


def op4_cross_polytope(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cross_polytope.search(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0, k=20)


def op5_compression_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "labels")
    scored = compression_quality.score(docs, compression_quality.fit(docs, labels))
    return scored.select("doc_id", compression_quality.held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= compression_quality.ACCEPT).cast("int").alias("predicted"))


def op6_va_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    return va_file.search(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0, k=5)


def op7_simhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash_dedup.near_duplicates(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("print"), 16, "0")).alias("fingerprint"), "component_id")


def op8_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    model = tokenizer_file("piece_bpe_32k.model")
    encoded = sentencepiece_viterbi.encode(table(spark, sf_dir, "documents").select("doc_id", "text"), model, digest=True)
    return encoded.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), "ids", "decoded_sha256")


def op9_cross_entropy(spark: SparkSession, sf_dir: str) -> DataFrame:
    good = table(spark, sf_dir, "labels").where("quality = 1").select("doc_id")
    return cross_entropy.score(table(spark, sf_dir, "documents"), good)


def op10_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = staged(mixing.sizes(table(spark, sf_dir, "documents"), source_domain()), "sizes")
    planned = staged(mixing.plan(rows, budget=None, fraction=0.6, weights=WEIGHTS, max_epochs=2, seed=MIX_SEED), "plan")
    named = rows.select("doc_id", F.col("_domain").alias("domain"), F.col("_lang").alias("lang"), F.col("_source").alias("source"), F.col("_tokens").alias("n_tokens"))
    return mixing.select(named, planned, F.col("domain"), MIX_SEED).select("doc_id", "domain", "lang", "source", "n_tokens", "epoch")


def queries() -> dict:
    found = (op1_chat_format, op2_token_files, op3_substring_dedup, op4_cross_polytope, op5_compression_quality, op6_va_file, op7_simhash_dedup, op8_sentencepiece, op9_cross_entropy, op10_mixing)
    return {f.__name__: f for f in found}
