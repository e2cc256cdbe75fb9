"""Incremental move counts over arriving files of first visits, with exactly-once merges."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.sequences import outcome_counts

SCHEMA = "state string, action string, outcome int"


def move_counts(rows: DataFrame) -> DataFrame:
    return rows.groupBy("state", F.coalesce("action", F.lit("")).alias("action")).agg(F.count(F.lit(1)).alias("games"), *outcome_counts())


def ingest(spark: SparkSession, source: str, target: str, checkpoint: str) -> None:
    """Takes the files that have arrived since the last call; offsets and progress live in `checkpoint`.

    Each micro-batch adds its own counts under its batch number: a batch that runs again after a failure replaces its
    own partition, so nothing counts twice.
    """

    def add(batch: DataFrame, number: int) -> None:
        move_counts(batch).withColumn("batch", F.lit(number)).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("batch").parquet(target)

    stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(source)
    stream.writeStream.foreachBatch(add).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


def counts(spark: SparkSession, target: str) -> DataFrame:
    """The sums over all batches so far: readable while ingestion goes on."""
    rows = spark.read.parquet(target)
    return rows.groupBy("state", "action").agg(*[F.sum(c).alias(c) for c in ("games", "w", "d", "b")])


def sessions(events: DataFrame, delay: str, gap: str) -> DataFrame:
    """user_id, opened, closed, n: sessions by inactivity gap; works on streams (with a watermark) and tables alike."""
    if events.isStreaming:
        events = events.withWatermark("ts", delay)
    rows = events.groupBy("user_id", F.session_window("ts", gap).alias("s")).agg(F.count(F.lit(1)).alias("n"))
    return rows.select("user_id", F.col("s.start").alias("opened"), F.col("s.end").alias("closed"), "n")
