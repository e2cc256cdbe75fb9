"""Which states deserve a deeper look: support, needed actions, reasons, tiers, and what knowledge saves."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Weights of the reasons, and the bounds that some are measured by.
REASON_WEIGHTS = {"high_reach": 1.0, "mature_template": 1.5, "behavioural_disagreement": 2.0, "decision_priority": 2.0, "deviation_priority": 1.5, "split_involvement": 1.5, "frontier_sensitivity": 2.0}
REACH, JS_BITS, PRIORITY = 0.002, 0.10, 0.0005


def supported(dist: DataFrame, experts: dict[str, int], population: str, least_games: int, least_actions: int = 2) -> DataFrame:
    """state, expert, expert_games, population_games: the first expert source with its floor of games, enough population games, and enough actions in both."""
    size = dist.groupBy("state", "source").agg(F.sum("games").alias("games"), F.count(F.lit(1)).alias("actions"))
    rank = F.coalesce(*[F.when((F.col("source") == s) & (F.col("games") >= n), F.lit(i)) for i, (s, n) in enumerate(experts.items())])
    best = size.withColumn("_rank", rank).where("_rank IS NOT NULL").groupBy("state").agg(F.min_by(F.struct("source", "games", "actions"), "_rank").alias("e"))
    others = size.where((F.col("source") == population) & (F.col("games") >= least_games) & (F.col("actions") >= least_actions)).select("state", F.col("games").alias("population_games"))
    return best.where(F.col("e.actions") >= least_actions).join(others, "state").select("state", F.col("e.source").alias("expert"), F.col("e.games").alias("expert_games"), "population_games")


def needed_actions(pairs: DataFrame, least: float, most: int) -> DataFrame:
    """state, action, combined, needed_rank, left_out: of two distributions (p, q), actions with enough combined share, at most `most` a state; `left_out` is the share of the others."""
    rows = pairs.withColumn("combined", F.col("p") + F.col("q"))
    order = Window.partitionBy("state").orderBy(F.desc(F.round("combined", 12)), "action")
    rows = rows.withColumn("needed_rank", F.row_number().over(order))
    keep = (F.round("combined", 12) >= least) & (F.col("needed_rank") <= most)
    left = F.sum(F.when(~keep, F.col("combined")).otherwise(0.0)).over(Window.partitionBy("state")) / 2
    return rows.withColumn("left_out", left).where(keep).select("state", "action", "combined", "needed_rank", "left_out")


def served_moves(actions: DataFrame, layers: dict[str, DataFrame], known: dict[str, DataFrame], first: str, second: str) -> DataFrame:
    """`actions` (state, action) with the games of each layer, in the order that they are shown.

    A layer that knows the state (`known`: its states) but never saw the action gives 0, one that doesn't know it null.
    Order: games of the `first` layer, then of the `second` (null as 0), then the action.
    """
    out = actions
    for name, rows in layers.items():
        out = out.join(rows.select("state", "action", F.col("games").alias(f"_{name}")), ["state", "action"], "left")
        out = out.join(known[name].select("state").distinct().withColumn("_known", F.lit(True)), "state", "left")
        out = out.withColumn(name, F.when(F.col("_known"), F.coalesce(f"_{name}", F.lit(0)))).drop(f"_{name}", "_known")
    order = Window.partitionBy("state").orderBy(F.coalesce(first, F.lit(0)).desc(), F.coalesce(second, F.lit(0)).desc(), "action")
    return out.withColumn("shown", F.row_number().over(order))


def taught_gain(dist: DataFrame, evals: DataFrame, taught: DataFrame) -> DataFrame:
    """state, loss_pop, loss_taught, gain, mass_covered: ordinary play against taught answers, both measured by the best evaluated action.

    `taught` has state, action, p. A state whose taught actions aren't evaluated has no loss_taught and no gain (null).
    """
    best = evals.groupBy("state").agg(F.max("ep").alias("_best"))
    loss = F.greatest(F.lit(0.0), F.col("_best") - F.col("ep"))
    valued = lambda rows: rows.where("p > 0").join(evals.select("state", "action", "ep"), ["state", "action"]).join(best, "state")
    pop = valued(dist).groupBy("state").agg((F.sum(F.col("p") * loss) / F.sum("p")).alias("loss_pop"), F.sum("p").alias("mass_covered"))
    own = valued(taught).groupBy("state").agg((F.sum(F.col("p") * loss) / F.sum("p")).alias("loss_taught"))
    return pop.join(own, "state", "left").select("state", "loss_pop", "loss_taught", (F.col("loss_pop") - F.col("loss_taught")).alias("gain"), "mass_covered")


def template_values(sample: DataFrame, gains: DataFrame) -> DataFrame:
    """family, sampled, evaluated, missing, ev_per_board, weight_evaluated: weighted mean gain over the boards of a `sample` (family, state, weight) that have one."""
    rows = sample.join(gains.select("state", "gain"), "state", "left")
    weight = F.when(F.col("gain").isNotNull(), F.col("weight"))
    return rows.groupBy("family").agg(
        F.count(F.lit(1)).alias("sampled"), F.count("gain").alias("evaluated"), (F.count(F.lit(1)) - F.count("gain")).alias("missing"),
        (F.sum(F.col("weight") * F.col("gain")) / F.sum(weight)).alias("ev_per_board"), F.coalesce(F.sum(weight), F.lit(0.0)).alias("weight_evaluated"),
    )


def reasoned(rows: DataFrame) -> DataFrame:
    """Adds reasons (in order), reason_count and score to states with reach, in_template, js, top_differs, decision, deviation, in_split, frontier_items.

    Measured reasons count by how far they pass their bound, up to three times (twice for the frontier).
    """
    zero = lambda c: F.coalesce(c, F.lit(0.0))
    held = {
        "high_reach": (F.col("reach") >= REACH, F.lit(1.0)), "mature_template": (F.col("in_template"), F.lit(1.0)),
        "behavioural_disagreement": ((F.col("js") >= JS_BITS) | F.col("top_differs"), F.least(F.lit(3.0), zero(F.col("js")) / JS_BITS)),
        "decision_priority": (F.col("decision") >= PRIORITY, F.least(F.lit(3.0), F.col("decision") / PRIORITY)),
        "deviation_priority": (F.col("deviation") >= PRIORITY, F.least(F.lit(3.0), F.col("deviation") / PRIORITY)),
        "split_involvement": (F.col("in_split"), F.lit(1.0)), "frontier_sensitivity": (F.col("frontier_items") > 0, F.least(F.lit(2.0), F.col("frontier_items") / 2.0)),
    }
    held = {name: (F.coalesce(c & F.col("js").isNotNull() if name == "behavioural_disagreement" else c, F.lit(False)), value) for name, (c, value) in held.items()}
    names = F.array_compact(F.array(*[F.when(c, F.lit(name)) for name, (c, _) in held.items()]))
    score = sum((F.when(c, F.lit(REASON_WEIGHTS[name]) * value).otherwise(0.0) for name, (c, value) in held.items()), F.lit(0.0))
    return rows.withColumn("reasons", names).withColumn("reason_count", F.size("reasons")).withColumn("score", score)


def tiers(rows: DataFrame, most_deepest: int = 25, deep_share: float = 0.12) -> DataFrame:
    """Adds rank, watch and tier: of the watched states the first `most_deepest` with three reasons are C, the rest of the first `deep_share` are B, all others A.

    The order of all states is one sorted list, as ranks are; only keys and scores take part.
    """
    order = Window.partitionBy(F.lit(0)).orderBy(F.desc(F.round("score", 9)), F.desc(F.round("reach", 9)), "state")
    strong = F.exists("reasons", lambda r: r.isin("decision_priority", "mature_template", "behavioural_disagreement"))
    rows = rows.withColumn("rank", F.row_number().over(order)).withColumn("watch", (F.col("reason_count") >= 2) & strong & (F.round("reach", 9) >= REACH))
    n = F.count(F.lit(1)).over(Window.partitionBy(F.lit(0)))
    deepest = F.col("watch") & (F.col("reason_count") >= 3)
    place = F.sum(deepest.cast("int")).over(order.rowsBetween(Window.unboundedPreceding, 0))
    tier = F.when(deepest & (place <= most_deepest), "C").when(F.col("watch") & (F.col("rank") <= F.floor(n * deep_share)), "B").otherwise("A")
    return rows.withColumn("tier", tier)


def walk_losses(steps: DataFrame, evals: DataFrame, taught: DataFrame) -> DataFrame:
    """game_id, steps, loss_played, loss_taught over the steps whose state is taught and whose action is evaluated.

    `steps` has game_id, state, action; `taught` state, action. Taught answers count alike; those without a value aren't counted.
    """
    best = evals.groupBy("state").agg(F.max("ep").alias("_best"))
    answers = taught.select("state", "action").distinct().join(evals.select("state", "action", "ep"), ["state", "action"], "left").join(best, "state")
    answers = answers.groupBy("state").agg(F.avg(F.greatest(F.lit(0.0), F.col("_best") - F.col("ep"))).alias("_taught"))
    played = steps.join(evals.select("state", "action", "ep"), ["state", "action"]).join(best, "state").join(answers, "state")
    return played.groupBy("game_id").agg(F.count(F.lit(1)).alias("steps"), F.sum(F.greatest(F.lit(0.0), F.col("_best") - F.col("ep"))).alias("loss_played"), F.sum(F.coalesce("_taught", F.lit(0.0))).alias("loss_taught"))


# --- costs -----------------------------------------------------------------------------------------------------------

def complexity(exact_moves: Column, slots: Column, conditions: Column, exceptions: Column, boards: Column) -> Column:
    """What an item costs to learn: the sum of its parts; one condition is free."""
    return exact_moves + slots + F.greatest(F.lit(0), conditions - 1) + exceptions + boards


def compression_ratio(positions: Column, cost: Column) -> Column:
    return positions / F.greatest(cost, F.lit(1.0))


def plan_burden(kinds: Column, exceptions: Column) -> Column:
    """What a plan costs by its events' kinds (an array, one entry an event): half for each event and each actionable kind, one for its board and each exception."""
    actionable = F.size(F.array_intersect(F.array_distinct(kinds), F.array(*map(F.lit, ("pawn_move", "piece_move", "castle")))))
    return 0.5 * F.size(kinds) + 0.5 * (1 + actionable) + exceptions + 1.0
