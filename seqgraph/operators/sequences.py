"""From ordered event logs to first-visit counts.

A sequence (game) counts once at each state, with the first action it took there. Where a sequence ends, its last state
is visited with a null action: state totals include such visits, action shares don't.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

OUTCOMES = ("w", "d", "b")


def number_steps(events: DataFrame, game: str, order: list[str], action: str, structure_actions: tuple[str, ...], last_actions: int = 0, max_ply: int | None = None) -> DataFrame:
    """game_id, ply, action, state, next_state, structure, is_last from an event log.

    state is the multiset of the actions so far (sorted, joined by '|'), or with `last_actions` the last few in order.
    Each game's rows share one shuffle and one sort. With `max_ply` the steps beyond it are dropped before any prefix is
    made; without it a state of n actions is as long as they are (`last_actions` bounds it).
    """
    if max_ply is not None:
        at = Window.partitionBy(game).orderBy(*order)
        events = events.withColumn("_ply", F.row_number().over(at)).withColumn("_last", F.lead(F.lit(1)).over(at).isNull()).where(F.col("_ply") <= max_ply)
    by_game = Window.partitionBy(game).orderBy(*order)
    past, upto = by_game.rowsBetween(Window.unboundedPreceding, -1), by_game.rowsBetween(Window.unboundedPreceding, 0)
    if last_actions:
        past, upto = by_game.rowsBetween(-last_actions, -1), by_game.rowsBetween(1 - last_actions, 0)
    order_of = (lambda c: c) if last_actions else F.array_sort
    text = lambda w: F.array_join(order_of(F.collect_list(action).over(w)), "|")
    whole = by_game.rowsBetween(Window.unboundedPreceding, -1)
    counted = F.concat_ws(",", *[F.coalesce(F.sum((F.col(action) == a).cast("int")).over(whole), F.lit(0)).cast("string") for a in structure_actions])
    after = by_game.rowsBetween(Window.unboundedPreceding, 0)
    counted_after = F.concat_ws(",", *[F.coalesce(F.sum((F.col(action) == a).cast("int")).over(after), F.lit(0)).cast("string") for a in structure_actions])
    return events.select(
        F.col(game).alias("game_id"), (F.row_number().over(by_game) - 1).alias("ply"), F.col(action).alias("action"),
        text(past).alias("state"), text(upto).alias("next_state"), counted.alias("structure"), counted_after.alias("next_structure"),
        (F.lead(F.lit(1)).over(by_game).isNull() if max_ply is None else F.col("_last")).alias("is_last"),
    )


def visits(steps: DataFrame) -> DataFrame:
    """Every state a game stood in: one row a step, and one with a null action where the game ended."""
    here = F.struct("ply", "state", "structure", "action", "next_state")
    end = F.struct((F.col("ply") + 1).alias("ply"), F.col("next_state").alias("state"), F.col("next_structure").alias("structure"), F.lit(None).cast("string").alias("action"), F.lit(None).cast("string").alias("next_state"))
    rows = F.when(F.col("is_last"), F.array(here, end)).otherwise(F.array(here))
    return steps.select("game_id", F.explode(rows).alias("v")).select("game_id", "v.*")


def first_visits(rows: DataFrame) -> DataFrame:
    """The first visit of each game to each state, with the action that left it."""
    first = Window.partitionBy("game_id", "state").orderBy("ply")
    return rows.withColumn("_n", F.row_number().over(first)).where("_n = 1").drop("_n")


def outcome_counts(suffix: str = "", where: Column | None = None) -> list[Column]:
    """w, d and b of the rows for which `where` holds."""
    held = F.lit(True) if where is None else where
    return [F.sum(((F.col("outcome") == k) & held).cast("long")).alias(f"{name}{suffix}") for k, name in enumerate(OUTCOMES)]


def count_moves(first: DataFrame) -> DataFrame:
    """Counts of every (state, action) and, under action '', of every state; all and strong games in the same pass."""
    rows = first.select("state", "outcome", "strong", F.explode(F.when(F.col("action").isNull(), F.array(F.lit(""))).otherwise(F.array(F.lit(""), F.col("action")))).alias("action"))
    return rows.groupBy("state", "action").agg(*outcome_counts(), *outcome_counts("_s", F.col("strong")))


def count_complete(first: DataFrame) -> DataFrame:
    """Counts of every (state, action), with action '' for games that ended there: a state's total is the sum of its rows."""
    return first.withColumn("action", F.coalesce("action", F.lit(""))).groupBy("state", "action").agg(*outcome_counts())


def move_table(first: DataFrame) -> DataFrame:
    """Each action's games, outcome counts, share of the state's continuing games and expected points."""
    moves = first.where("action IS NOT NULL").groupBy("state", "action").agg(F.count(F.lit(1)).alias("games"), *outcome_counts())
    total = F.sum("games").over(Window.partitionBy("state"))
    return moves.withColumn("share", F.col("games") / total).withColumn("ep", (F.col("w") + F.col("d") / 2) / F.col("games"))


def by_source(first: DataFrame) -> DataFrame:
    """Each first visit under `all` and under `expert` or `population`: alternatives to choose from, never to add up."""
    own = F.when(F.col("strong"), "expert").otherwise("population")
    return first.withColumn("source", F.explode(F.array(F.lit("all"), own)))


def edges(first: DataFrame) -> DataFrame:
    """source, parent, action, child, games, w, d, b."""
    keys = [F.col("state").alias("parent"), "action", F.col("next_state").alias("child")]
    return by_source(first).where("action IS NOT NULL").groupBy("source", *keys).agg(F.count(F.lit(1)).alias("games"), *outcome_counts())


def nodes(first: DataFrame) -> DataFrame:
    """state, min_ply, role, structure, is_entry (the root)."""
    found = first.groupBy("state").agg(F.min("ply").alias("min_ply"), F.min_by("structure", "ply").alias("structure"))
    return found.select("state", "min_ply", (F.col("min_ply") % 2).alias("role"), "structure", (F.col("min_ply") == 0).alias("is_entry"))


def position_source(first: DataFrame) -> DataFrame:
    return by_source(first).groupBy("source", "state").agg(F.count(F.lit(1)).alias("games"), *outcome_counts(), F.sum(F.col("action").isNull().cast("long")).alias("ended"))


def frequent_states(first: DataFrame, threshold: int) -> DataFrame:
    """Counts of the states that at least `threshold` games visit; the prefilter's states alone are counted by action."""
    candidates = first.groupBy("state").count().where(F.col("count") >= threshold).select("state")
    return count_moves(first.join(candidates, "state", "left_semi"))


def exclusion_reasons(rows: DataFrame, checks: list[tuple[str, Column]]) -> DataFrame:
    """Rows with `reason`: of the failing checks the last one counts; null where all hold."""
    reason = F.coalesce(*[F.when(failed, F.lit(name)) for name, failed in reversed(checks)])
    return rows.withColumn("reason", reason)
