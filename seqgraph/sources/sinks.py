"""Keyed merges over stored tables. Each returns the merged rows; `replace` swaps the stored files for them."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def merge_add(old: DataFrame, delta: DataFrame, keys: list[str]) -> DataFrame:
    """Counters add up."""
    values = [c for c in old.columns if c not in keys]
    return old.unionByName(delta).groupBy(*keys).agg(*[F.sum(c).alias(c) for c in values])


def merge_min(old: DataFrame, delta: DataFrame, keys: list[str]) -> DataFrame:
    values = [c for c in old.columns if c not in keys]
    return old.unionByName(delta).groupBy(*keys).agg(*[F.min(c).alias(c) for c in values])


def merge_replace(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """New rows take the place of old ones with their keys."""
    return old.join(new.select(*keys).distinct(), keys, "left_anti").unionByName(new)


def insert_missing(old: DataFrame, new: DataFrame, keys: list[str]) -> tuple[DataFrame, DataFrame]:
    """(rows to insert, counts of inserted and skipped): rows whose keys exist are never overwritten."""
    order = Window.partitionBy(*keys).orderBy(*([c for c in new.columns if c not in keys] or keys))
    once = new.withColumn("_n", F.row_number().over(order))
    fresh = once.where("_n = 1").join(old.select(*keys).distinct(), keys, "left_anti").drop("_n")
    counts = new.agg(F.count(F.lit(1)).alias("offered")).crossJoin(F.broadcast(fresh.agg(F.count(F.lit(1)).alias("inserted"))))  # one row each
    return fresh, counts.withColumn("skipped", F.col("offered") - F.col("inserted"))


def replace(spark: SparkSession, rows: DataFrame, path: str) -> None:
    """Writes beside the table, then swaps by two renames: a failed job leaves the old table; between the renames readers find none and must try again."""
    hadoop = spark._jvm.org.apache.hadoop.fs
    target = hadoop.Path(path)
    fs = target.getFileSystem(spark._jsc.hadoopConfiguration())
    beside, before = f"{path}.{uuid.uuid4().hex}", f"{path}.{uuid.uuid4().hex}"
    rows.write.parquet(beside)
    if fs.exists(target):
        fs.rename(target, hadoop.Path(before))
    fs.rename(hadoop.Path(beside), target)
    fs.delete(hadoop.Path(before), True)


def overwrite_partitions(rows: DataFrame, path: str, by: str) -> None:
    """Replaces only the partitions that `rows` holds."""
    rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(by).parquet(path)
