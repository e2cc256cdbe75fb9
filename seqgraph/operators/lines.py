"""Named lines condensed to one entry per final position, their families and their mirrored twins."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.values import base_name


def condense(lines: DataFrame) -> DataFrame:
    """One row for each final state: its name, codes and aliases (sorted, joined), number of lines, games.

    Of the lines that end in one state, the name of the most played one (ties: the smaller name) is the entry's.
    """
    return lines.groupBy("state").agg(
        F.min_by("name", F.struct((-F.col("games")).alias("g"), F.col("name").alias("n"))).alias("name"), F.array_join(F.array_sort(F.collect_set("eco")), ",").alias("ecos"),
        F.array_join(F.array_sort(F.collect_set("name")), ",").alias("aliases"), F.count(F.lit(1)).alias("lines"), F.max("games").alias("games"),
    )


def families(entries: DataFrame, preferred: list[str]) -> DataFrame:
    """base, members, games, eco (least), main (the most played member), convention: families by the name before the colon."""
    rows = entries.withColumn("base", base_name(F.col("name")))
    main = F.min_by("name", F.struct((-F.col("games")).alias("g"), F.col("name").alias("n")))
    return rows.groupBy("base").agg(F.count(F.lit(1)).alias("members"), F.sum("games").alias("games"), F.min("eco").alias("eco"), main.alias("main")).withColumn("convention", F.col("base").isin(preferred))


def twins(entries: DataFrame, key: str, mirror: str) -> DataFrame:
    """Pairs whose keys are each other's mirror: id, twin. A key's twin is its most played holder (ties: smaller id)."""
    order = Window.partitionBy("_k").orderBy(F.desc("games"), "id")
    other = entries.select(F.col(key).alias("_k"), F.col("id").alias("twin"), "games", "id").withColumn("_n", F.row_number().over(order)).where("_n = 1").select("_k", "twin")
    found = entries.join(other, F.col(mirror) == F.col("_k")).where("id <> twin").select("id", "twin")
    back = found.select(F.col("id").alias("twin"), F.col("twin").alias("id"))
    return found.join(back, ["id", "twin"])


def line_divergence(line_steps: DataFrame, moves: DataFrame) -> DataFrame:
    """line, agree, first_divergence: where the corpus' most played move first differs from the line's."""
    order = Window.partitionBy("state").orderBy(F.desc("games"), "action")
    top = moves.withColumn("_n", F.row_number().over(order)).where("_n = 1").select("state", F.col("action").alias("top"))
    rows = line_steps.join(top, "state", "left")
    same = F.coalesce(F.col("top") == F.col("action"), F.lit(False))
    return rows.groupBy("line").agg(F.sum(same.cast("long")).alias("agree"), F.min(F.when(~same, F.col("ply"))).alias("first_divergence"))


def matching(entries: DataFrame, text: str, volume: str | None = None, mains: DataFrame | None = None, twins: DataFrame | None = None) -> DataFrame:
    """Entries whose name, code or aliases contain a text, of one volume if asked; only those of `mains` (name) and of `twins` (state) where these are given."""
    has = lambda c: F.contains(F.lower(c), F.lit(text.lower()))
    rows = entries.where(has(F.col("name")) | has(F.col("ecos")) | F.exists(F.split("aliases", ","), has))
    for key, kept in (("name", mains), ("state", twins)):
        rows = rows if kept is None else rows.join(kept.select(key), key, "left_semi")
    return rows.where(F.col("ecos").startswith(volume)) if volume else rows
