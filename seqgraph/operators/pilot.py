"""Evaluations at several budgets, scopes of knowledge, and what a chosen set is worth as a whole."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: The depth that a remote evaluation needs, evaluated actions that a pilot needs, the weight of states without reach, destinations shown, plies of a line.
LEAST_DEPTH, LEAST_ACTIONS, LEAST_WEIGHT, DESTINATIONS, LINE_PLIES, FRONTIER_ITEMS = 30, 2, 1e-9, 12, 8, 8


def meets_threshold(source: Column, depth: Column, local: str, least: int = LEAST_DEPTH) -> Column:
    """Whether an evaluation may be used: one's own always, another's if deep enough; false where either is unknown."""
    return F.coalesce(source == local, F.lit(False)) | F.coalesce(depth >= least, F.lit(False))


def _mean_loss(rows: DataFrame, keys: list[str], weight: Column) -> DataFrame:
    """`keys`, loss: weighted mean of best - ep over `rows` (ep, best)."""
    return rows.groupBy(*keys).agg((F.sum(weight * F.greatest(F.lit(0.0), F.col("best") - F.col("ep"))) / F.sum(weight)).alias("loss"))


def budget_losses(evals: DataFrame, taught: DataFrame) -> DataFrame:
    """state, budget, loss: what taught answers (state, action) lose, all alike, in each budget's evaluations (state, budget, action, ep).

    A state without an evaluated answer at a budget isn't listed there; repeated answers count once.
    """
    best = evals.withColumn("best", F.max("ep").over(Window.partitionBy("state", "budget")))
    return _mean_loss(best.join(taught.select("state", "action").distinct(), ["state", "action"]), ["state", "budget"], F.lit(1.0))


def cached_pilot(evals: DataFrame, dist: DataFrame, least: int = LEAST_ACTIONS) -> DataFrame:
    """state, depth, actions, loss, coverage of the states whose deepest cached search values `least` actions.

    `evals` has state, source, depth, action, ep; ties in depth go to the smaller source. `dist` (state, action, p) weights
    the losses; loss and coverage are null where it knows none of the evaluated actions, or none at all.
    """
    search = F.struct(F.col("depth"), F.col("source"))
    pick = evals.groupBy("state").agg(F.min_by("source", F.struct((-F.col("depth")).alias("d"), F.col("source").alias("s"))).alias("source"))
    used = evals.where(F.col("ep").isNotNull()).join(pick, ["state", "source"])
    over = Window.partitionBy("state")
    used = used.withColumn("best", F.max("ep").over(over)).withColumn("actions", F.count(F.lit(1)).over(over)).where(F.col("actions") >= least)
    rows = used.join(dist.select("state", "action", "p"), ["state", "action"], "left")
    found = rows.groupBy("state").agg(
        F.max(search)["depth"].alias("depth"), F.max("actions").alias("actions"), F.sum(F.col("p") * (F.col("best") - F.col("ep"))).alias("_lost"), F.sum("p").alias("_known"),
    )
    found = found.join(dist.groupBy("state").agg(F.sum("p").alias("_all")), "state", "left")
    return found.select("state", "depth", "actions", F.try_divide("_lost", "_known").alias("loss"), F.try_divide(F.coalesce("_known", F.lit(0.0)), F.col("_all")).alias("coverage"))


def destinations(moves: DataFrame, most: int = DESTINATIONS) -> DataFrame:
    """family, piece, origin, target, share: the heaviest destinations of each family, as shares of all its weight."""
    rows = moves.groupBy("family", "piece", "origin", "target").agg(F.sum("weight").alias("_w")).withColumn("_all", F.sum("_w").over(Window.partitionBy("family")))
    order = Window.partitionBy("family").orderBy(F.round("_w", 9).desc(), "piece", "origin", "target")
    return rows.withColumn("_n", F.row_number().over(order)).where(F.col("_n") <= most).select("family", "piece", "origin", "target", F.try_divide("_w", "_all").alias("share"))


def representative_lines(starts: DataFrame, edges: DataFrame, plies: int = LINE_PLIES) -> DataFrame:
    """family, ply, state, action, games: from each start (family, state) always the most played edge (ties: smaller action, child).

    One join a ply with one edge a state; a line ends where a state has no edge. `plies` bounds lines through cycles.
    """
    first = Window.partitionBy("parent").orderBy(F.desc("games"), "action", "child")
    top = edges.withColumn("_n", F.row_number().over(first)).where("_n = 1").select(F.col("parent").alias("state"), "action", "games", "child")
    step = F.struct("state", "action", "games")
    lines = starts.select("family", "state").join(top, "state").select("family", F.array(step).alias("line"), F.col("child").alias("state"))
    for _ in range(plies - 1):
        lines = lines.join(top, "state", "left").select("family", F.when(F.col("action").isNull(), F.col("line")).otherwise(F.array_append("line", step)).alias("line"), F.col("child").alias("state"))
    return lines.select("family", F.posexplode("line").alias("ply", "s")).select("family", "ply", "s.*")


def plan_scope(plans: DataFrame, boards: DataFrame, known: DataFrame) -> DataFrame:
    """plan, state, reach: boards (state, family, role, reach) of a plan's family with its side to move, or either for a null side; only states of `known`."""
    side = F.col("side").isNull() | (F.col("side") == F.col("role"))
    rows = boards.join(known.select("state").distinct(), "state", "left_semi").join(plans.select("plan", "family", "side"), "family")
    return rows.where(side).select("plan", "state", F.coalesce("reach", F.lit(0.0)).alias("reach"))


def family_samples(boards: DataFrame, dist: DataFrame) -> DataFrame:
    """family, state, weight, action, p: boards (family, state, reach) with a small weight where nothing reaches them, and what is played next (null where nothing is known)."""
    weight = F.when(F.coalesce(F.col("reach"), F.lit(0.0)) == 0, F.lit(LEAST_WEIGHT)).otherwise(F.col("reach"))
    return boards.select("family", "state", weight.alias("weight")).join(dist.select("state", "action", "p"), "state", "left")


def frontier_scope(ranked: DataFrame, cells: DataFrame, most: int = FRONTIER_ITEMS) -> DataFrame:
    """state, items: which of the first `most` chosen items (item, rank) apply at each state of `cells` (item, state), in the order of the choice."""
    rows = cells.select("item", "state").distinct().join(ranked.where(F.col("rank") <= most).select("item", "rank"), "item")
    return rows.groupBy("state").agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", "item"))), lambda x: x["item"]).alias("items"))


def joined_lists(*lists: Column) -> Column:
    """Lists one after the other, each entry at its first place only; a null list is empty."""
    return F.array_distinct(F.concat(*[F.coalesce(x, F.array().cast("array<string>")) for x in lists]))


def set_summary(cells: DataFrame, boards: DataFrame, parts: DataFrame) -> DataFrame:
    """Each set's items, burden, positions, value, recovery, behaviour, behaviour_fraction and value_per_burden.

    `cells` has set, item, state, loss, explained: at a state the least loss and the best explanation of a set count.
    `parts` has set, part, weight: what a set has to be learnt of, each part once. `boards` has state, reach, loss_pop.
    """
    best = cells.groupBy("set", "state").agg(F.min("loss").alias("loss"), F.max("explained").alias("explained")).join(boards, "state")
    gained = F.col("reach") * F.greatest(F.lit(0.0), F.col("loss_pop") - F.col("loss"))
    worth = best.groupBy("set").agg(F.count(F.lit(1)).alias("positions"), F.coalesce(F.sum(gained), F.lit(0.0)).alias("value"), F.coalesce(F.sum(F.col("reach") * F.col("explained")), F.lit(0.0)).alias("behaviour"))
    burden = parts.groupBy("set", "part").agg(F.max("weight").alias("weight")).groupBy("set").agg(F.sum("weight").alias("burden"))
    items = cells.groupBy("set").agg(F.countDistinct("item").alias("items"))
    totals = boards.agg(F.sum("reach").alias("_reach"), F.sum(F.col("reach") * F.col("loss_pop")).alias("_lost"))
    rows = items.join(burden, "set", "left").join(worth, "set", "left").crossJoin(F.broadcast(totals))  # one row of totals
    return rows.select(
        "set", "items", "burden", "positions", "value", F.try_divide("value", "_lost").alias("recovery"), "behaviour",
        F.try_divide("behaviour", "_reach").alias("behaviour_fraction"), F.try_divide("value", "burden").alias("value_per_burden"),
    )
