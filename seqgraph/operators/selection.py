"""Valuing knowledge items and choosing among them.

Where items overlap at a state, the best one counts, never their sum. An item without an evaluated answer has no value
(null), which isn't a value of zero.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .graph import cut
from .subsets import class_pairs as _class_pairs

#: The greedy choosers work on one (item, state, gain) table of at most this many rows, read to the driver.
MOST_CELLS = 2_000_000


def item_losses(items: DataFrame, losses: DataFrame) -> DataFrame:
    """item, state, loss: the mean loss of an item's evaluated answers at each state of its scope; null without any."""
    scope = items.select("item", F.explode("states").alias("state"), "answers")
    answers = scope.select("item", "state", F.explode("answers").alias("action"))
    valued = answers.join(losses, ["state", "action"], "left")
    return valued.groupBy("item", "state").agg(F.avg("loss").alias("loss"))


def item_values(cells: DataFrame, baseline: DataFrame) -> DataFrame:
    """item, value, states, valued: reach-weighted loss that an item saves; null if none of its states is valued."""
    rows = cells.join(baseline, "state", "left")
    gain = F.when(F.col("loss").isNotNull(), F.col("reach") * F.greatest(F.lit(0.0), F.col("base_loss") - F.col("loss")))
    return rows.groupBy("item").agg(F.sum(gain).alias("value"), F.count(F.lit(1)).alias("states"), F.count("loss").alias("valued"))


def compare_sets(cells: DataFrame, baseline: DataFrame, members: DataFrame) -> DataFrame:
    """curriculum, recovery: share of the baseline's loss that each set saves, with the best covering item at each state."""
    total = baseline.agg(F.sum(F.col("reach") * F.col("base_loss")).alias("total"))
    best = members.join(cells, "item").groupBy("curriculum", "state").agg(F.min("loss").alias("loss"))
    saved = best.join(baseline, "state").groupBy("curriculum").agg(F.sum(F.col("reach") * F.greatest(F.lit(0.0), F.col("base_loss") - F.coalesce("loss", "base_loss"))).alias("saved"))
    return saved.crossJoin(F.broadcast(total)).select("curriculum", (F.col("saved") / F.col("total")).alias("recovery"))  # total is one row


def greedy(cells: DataFrame, costs: DataFrame, steps: int, budget: float = float("inf")) -> list[dict]:
    """The frontier: at each step the item with the largest marginal gain over what is taken (ties: lower cost, then id)
    that the budget still allows.

    `cells` has item, state, gain (gain > 0). Each step depends on the last, so the pruned table goes to the driver; a
    table beyond MOST_CELLS is refused instead of being cut.
    """
    cells = cells.where("gain > 0")
    if (n := cells.count()) > MOST_CELLS:
        raise ValueError(f"{n} cells; the greedy choice takes at most {MOST_CELLS}")
    cost = {r["item"]: r["cost"] for r in costs.collect()}
    gain: dict = {}
    for r in cells.collect():
        gain.setdefault(r["item"], {})[r["state"]] = r["gain"]
    have: dict = {}
    out, total, spent = [], 0.0, 0.0
    for step in range(1, steps + 1):
        options = []
        for item, states in gain.items():
            more = sum(max(0.0, g - have.get(s, 0.0)) for s, g in states.items())
            if more > 1e-12 and spent + cost.get(item, 0.0) <= budget:
                options.append((-round(more, 12), cost.get(item, 0.0), item, more))
        if not options:
            break
        _, c, item, more = min(options, key=lambda o: o[:3])
        total, spent = total + more, spent + c
        out.append({"step": step, "item": item, "marginal": more, "cumulative": total, "cost": spent})
        for s, g in gain.pop(item).items():
            have[s] = max(have.get(s, 0.0), g)
    return out


def behavioural_reach(dist: DataFrame, taught: DataFrame, reach: DataFrame) -> DataFrame:
    """Mass at taught states that follows a taught action, and mass that deviates."""
    states = taught.select("state").distinct()
    rows = dist.join(states, "state", "left_semi").join(taught.select("state", "action", F.lit(1).alias("_t")).distinct(), ["state", "action"], "left").join(reach, "state")
    mass = F.col("reach") * F.col("p")
    return rows.agg(F.sum(F.when(F.col("_t") == 1, mass).otherwise(0.0)).alias("taught"), F.sum(F.when(F.col("_t").isNull(), mass).otherwise(0.0)).alias("deviating"))


def shared_burden(uses: DataFrame) -> DataFrame:
    """plan, own, shared, additive: what each plan's components cost alone, and when first users pay (plans by id)."""
    payer = uses.groupBy("component").agg(F.min("plan").alias("payer"), F.countDistinct("plan").alias("plans"))
    rows = uses.join(payer, "component")
    return rows.groupBy("plan").agg(F.sum("cost").alias("additive"), F.sum(F.when(F.col("payer") == F.col("plan"), F.col("cost")).otherwise(0.0)).alias("shared"), F.sum((F.col("plans") > 1).cast("long")).alias("reused"))


def schemas(uses: DataFrame, bundles: DataFrame) -> DataFrame:
    """bundle, plans, required, optional: for plans that contain a bundle, components in all of them and in half or more."""
    wanted = bundles.select("bundle", F.explode("components").alias("component"))
    sizes = bundles.select("bundle", F.size("components").alias("size"))
    held = wanted.join(uses.select("plan", "component").distinct(), "component").groupBy("bundle", "plan").agg(F.count(F.lit(1)).alias("n")).join(sizes, "bundle").where("n = size")
    plans = held.groupBy("bundle").agg(F.count(F.lit(1)).alias("plans"))
    found = held.select("bundle", "plan").join(uses.select("plan", "component").distinct(), "plan").groupBy("bundle", "component").agg(F.count(F.lit(1)).alias("n")).join(plans, "bundle")
    return found.groupBy("bundle").agg(F.max("plans").alias("plans"), F.sum((F.col("n") == F.col("plans")).cast("long")).alias("required"), F.sum(((F.col("n") < F.col("plans")) & (F.col("n") * 2 >= F.col("plans"))).cast("long")).alias("optional"))


def _classes(sets: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Each set's class (id, class), and the classes of equal sets: class, members, size, copies. Both are written out once."""
    members = F.array_sort(F.array_distinct("members"))
    held = cut(sets.select("id", F.unhex(F.sha2(F.to_json(members).cast("binary"), 256)).alias("sign"), members.alias("members")))
    classes = held.groupBy("sign").agg(F.first("members").alias("members"), F.count(F.lit(1)).alias("copies"))
    classes = cut(classes.select(F.monotonically_increasing_id().alias("class"), "sign", "members", F.size("members").alias("size"), "copies"))
    return cut(held.select("id", "sign").join(classes.select("sign", "class"), "sign").select("id", "class")), classes.drop("sign")


def containment(sets: DataFrame) -> DataFrame:
    """Strict subsets among sets: small, large.

    Equal sets are one class; only classes are compared, and their pairs are dealt out to the sets at the end. Each
    class looks among the larger ones that hold its rarest member, by bitmaps (see `subsets`).
    """
    held, classes = _classes(sets)
    pairs = _class_pairs(classes).withColumnsRenamed({"small": "_s", "large": "_l"})
    of = lambda side: held.select(F.col("class").alias(f"_{side[0]}"), F.col("id").alias(side))
    return pairs.join(of("small"), "_s").join(of("large"), "_l").select("small", "large")


def containers(sets: DataFrame) -> DataFrame:
    """id, n: in how many of the sets each set is strictly contained, 1 at least. As many as `containment` has pairs, but none is made for copies."""
    held, classes = _classes(sets)
    copies = classes.select(F.col("class").alias("large"), "copies")
    found = _class_pairs(classes).join(copies, "large").groupBy(F.col("small").alias("class")).agg(F.sum("copies").alias("n"))
    return held.join(found, "class").select("id", "n")


def first_category(rows: DataFrame, key: str, rank: str) -> DataFrame:
    """Disjoint tiers: each key under its first category."""
    return rows.groupBy(key).agg(F.min(rank).alias("tier"))


def running(rows: DataFrame, value: str, *order) -> DataFrame:
    """Cumulative value in order, its share of the total, and whether it is the first to reach 90 %."""
    w = Window.partitionBy("part").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    total = F.sum(value).over(Window.partitionBy("part"))
    rows = rows.withColumn("cumulative", F.sum(value).over(w)).withColumn("share", F.col("cumulative") / total)
    return rows.withColumn("reaches90", (F.col("share") >= 0.9) & ((F.col("cumulative") - F.col(value)) / total < 0.9))


def strata(rows: DataFrame, part: str, *order) -> DataFrame:
    """Ten strata by rank: min(9, rank * 10 // n)."""
    rank = F.row_number().over(Window.partitionBy(part).orderBy(*order)) - 1
    n = F.count(F.lit(1)).over(Window.partitionBy(part))
    return rows.withColumn("stratum", F.least(F.lit(9), F.floor(rank * 10 / n)).cast("int"))


def candidate_scores(rows: DataFrame, reasons: list[tuple[str, object, float]], most: float) -> DataFrame:
    """reasons (joined), n_reasons and score: the capped sum of the weights of all reasons that hold."""
    held = [(name, F.coalesce(condition, F.lit(False)), weight) for name, condition, weight in reasons]
    names = F.array_compact(F.array(*[F.when(c, F.lit(name)) for name, c, _ in held]))
    score = sum((F.when(c, F.lit(float(w))).otherwise(0.0) for _, c, w in held), F.lit(0.0))
    return rows.withColumn("reasons", F.array_join(names, ",")).withColumn("n_reasons", F.size(names)).withColumn("score", F.least(F.lit(most), score))
