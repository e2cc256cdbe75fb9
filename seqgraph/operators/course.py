"""Courses: which plans are the same, what a schema leaves to exact decisions, selections that don't repeat themselves, audits."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .selection import MOST_CELLS, containers, containment

#: What a learner does and what only results, by transformation.
ACTIONS, EFFECTS = ("goal", "transform", "castle", "exchange"), ("file_open", "transition")
#: Transformations that a learner can complete on a board.
CHECKABLE = ("goal", "transform", "castle")
MIN_ABSOLUTE, MIN_SHARE = 0.005, 0.20
MAX_EXPLAINED, MIN_DEVIATION_SHARE, MIN_DEVIATION_REACH = 0.50, 0.30, 1e-4


def transformation_class(kind):
    """learner_action, outcome_effect, or null for a kind that is neither."""
    return F.when(kind.isin(*ACTIONS), "learner_action").when(kind.isin(*EFFECTS), "outcome_effect")


def same_prescriptions(rows: DataFrame) -> DataFrame:
    """plan, same_as: plans that prescribe alike (`rows`: plan, state, answers) under the least of them; plans that prescribe nothing aren't listed."""
    pairs = F.array_sort(F.collect_set(F.struct("state", F.array_sort("answers").alias("answers"))))
    signs = rows.groupBy("plan").agg(F.sha2(F.to_json(pairs).cast("binary"), 256).alias("sign"))
    least = signs.groupBy("sign").agg(F.min("plan").alias("same_as"))
    return signs.join(least, "sign").select("plan", "same_as")


def admitted_decisions(decisions: DataFrame, schemas: DataFrame, boards: DataFrame, absolute: float = MIN_ABSOLUTE, share: float = MIN_SHARE) -> DataFrame:
    """item, state, residual, gained: exact decisions (item, state, loss) that save enough of what the schemas (state, loss) leave of each board's loss_pop."""
    left = boards.select("state", "loss_pop").join(schemas.groupBy("state").agg(F.min("loss").alias("_covered")), "state", "left")
    left = left.withColumn("_now", F.coalesce("_covered", "loss_pop"))
    rows = decisions.join(left, "state").withColumn("residual", F.col("loss_pop") - F.col("_now")).withColumn("gained", F.greatest(F.lit(0.0), F.col("_now") - F.col("loss")))
    # a board that no schema improves has no residual to be measured by
    keep = (F.col("residual") > 0) & (F.col("gained") >= absolute) & (F.col("gained") >= share * F.col("residual"))
    return rows.where(keep).select("item", "state", "residual", "gained")


def material_deviations(effects: DataFrame, boards: DataFrame, top: DataFrame) -> DataFrame:
    """item, state, action: strong play's first action where a chosen item doesn't explain the board, people play it, the board is reached, and it isn't among the item's answers.

    `effects` has item, state, explained, answers; `boards` state, reach; `top` state, action, share.
    """
    own = effects.groupBy("item").agg(F.array_distinct(F.flatten(F.collect_list("answers"))).alias("_own"))
    rows = effects.where(F.col("explained") < MAX_EXPLAINED).join(top.where(F.col("share") >= MIN_DEVIATION_SHARE), "state").join(boards.where(F.col("reach") >= MIN_DEVIATION_REACH).select("state"), "state", "left_semi").join(own, "item")
    return rows.where(~F.array_contains("_own", F.col("action"))).select("item", "state", "action").distinct()


def template_frontier(pool: list, coverage, distance, most: int = 10, apart: int = 3) -> list[dict]:
    """Greedy choice of structures by the coverage of the chosen set; structures nearer than `apart` to a chosen one leave the pool.

    `coverage` maps a list of structures to a number, `distance` two structures to bits. Each step depends on the last:
    the pool (the mature structures alone) is on the driver, each coverage is a distributed job of the caller's.
    """
    left, chosen, out, covered = list(pool), [], [], 0.0
    while left and len(chosen) < most:
        best = max(((coverage([*chosen, s]), -i, s) for i, s in enumerate(left)), key=lambda x: x[:2])
        if best[0] <= covered + 1e-9:
            break
        chosen.append(best[2])
        out.append({"k": len(chosen), "structure": best[2], "coverage": best[0], "marginal": best[0] - covered})
        covered = best[0]
        left = [s for s in left if s != best[2] and distance(s, best[2]) >= apart]
    return out


def knowledge_frontier(items: DataFrame, components: DataFrame, values: DataFrame, steps: int) -> list[dict]:
    """The choice by value for each unit of burden that isn't learnt yet: item, marginal value, marginal burden.

    `components` has item, component, cost; a component is paid for once. `values` has item, state, gain; at a state the
    best item counts. The tables are the candidates' own (see selection.MOST_CELLS for their bound).
    """
    for rows in (components, values):
        if (n := rows.count()) > MOST_CELLS:
            raise ValueError(f"{n} rows; the choice takes at most {MOST_CELLS}")
    needs, gains = {r["item"]: {} for r in items.select("item").collect()}, {}
    for r in components.collect():
        needs.setdefault(r["item"], {})[r["component"]] = r["cost"]
    for r in values.where("gain > 0").collect():
        gains.setdefault(r["item"], {})[r["state"]] = r["gain"]
    learnt, have, out = set(), {}, []
    for step in range(1, steps + 1):
        options = []
        for item in needs:
            value = sum(max(0.0, g - have.get(s, 0.0)) for s, g in gains.get(item, {}).items())
            burden = sum(c for k, c in needs[item].items() if k not in learnt)
            if value > 1e-12:
                options.append((-round(value / max(burden, 1e-9), 9), item, value, burden))
        if not options:
            break
        _, item, value, burden = min(options)
        out.append({"step": step, "item": item, "value": value, "burden": burden})
        learnt |= set(needs.pop(item))
        for s, g in gains.get(item, {}).items():
            have[s] = max(have.get(s, 0.0), g)
    return out


def audit(items: DataFrame, required: DataFrame, exceptions: DataFrame) -> DataFrame:
    """budget, finding, subject: what is wrong with courses; a schema within others is told once for each of them.

    `items` has budget, item, kind (schema, decision, orientation), title, reach, contained_in, retained_because,
    flexibility, lift, moves; `required` budget, item, component, kind; `exceptions` budget, item, modifies, moves.
    """
    return _union(_findings(items, required, exceptions, lambda sets: containment(sets).select(F.col("small").alias("id"), F.lit(1).cast("long").alias("n")))).drop("n")


def audit_counts(items: DataFrame, required: DataFrame, exceptions: DataFrame) -> DataFrame:
    """budget, finding, n: how often `audit` tells each finding. Pairs of schemas of equal sets are counted, not made."""
    parts = _findings(items, required, exceptions, containers)
    return _union([p.groupBy("budget", "finding").agg(F.sum("n").alias("n")) for p in parts]).groupBy("budget", "finding").agg(F.sum("n").alias("n"))


def _union(parts: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, parts)


def _findings(items: DataFrame, required: DataFrame, exceptions: DataFrame, within) -> list[DataFrame]:
    """Tables of budget, finding, subject, n (times). `within` maps sets (id, members) to rows of id, n: the larger sets about each."""
    found = lambda rows, name, subject="title", n=F.lit(1).cast("long"): rows.select("budget", F.lit(name).alias("finding"), F.col(subject).cast("string").alias("subject"), n.alias("n"))  # noqa: B008, E731
    schemas, decisions = items.where("kind = 'schema'"), items.where("kind = 'decision'")
    sizes = required.groupBy("budget", "item").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("kind").isin(*CHECKABLE)).alias("checkable"))
    sized = schemas.join(sizes, ["budget", "item"], "left").fillna(0, ["n", "checkable"])
    parts = [found(sized.where("checkable = 0"), "cannot_be_checked")]
    # a schema within another: strict subsets of the required components, course by course
    own = required.join(schemas.select("budget", "item"), ["budget", "item"], "left_semi")
    mark = lambda c: F.concat_ws("\u0001", "budget", c)
    sets = own.groupBy(mark("item").alias("id")).agg(F.collect_list(mark("component")).alias("members"))
    part = lambda k: F.split_part("id", F.lit("\u0001"), F.lit(k))
    inside = within(sets).select(part(1).alias("budget"), part(2).alias("item"), F.col("n").alias("_times")).join(schemas, ["budget", "item"])
    declared = F.coalesce(F.col("contained_in") != "", F.lit(False)) & F.coalesce(F.col("retained_because") != "", F.lit(False))
    parts += [found(inside.where(declared), "redundant_declared", n=F.col("_times")), found(inside.where(~declared), "redundant_undeclared", n=F.col("_times"))]
    parts.append(found(items.groupBy("budget", "title").count().where("count > 1"), "duplicate_titles"))
    parts.append(found(items.where("reach < 1e-4"), "unreachable"))
    parts.append(found(items.where("kind = 'orientation' AND (lift IS NULL OR lift < 1.2)"), "uninformative_recognition"))
    parts += [found(sized.where("n >= 4"), "hard_to_parse"), found(sized.where("flexibility > 0.4 AND n > 2"), "hard_to_parse")]
    under = exceptions.where("modifies LIKE 'decision:%'").join(decisions.select("budget", F.col("item").alias("modifies"), F.col("moves").alias("taught")), ["budget", "modifies"], "left")
    parts.append(found(under.where("taught IS NULL"), "orphan_exceptions", "item"))
    parts.append(found(under.where(~F.arrays_overlap("taught", "moves")), "contradictory", "modifies"))
    rules = items.groupBy("budget").agg(F.count_if(F.col("kind").isin("schema", "decision")).alias("rules"))
    swamp = exceptions.groupBy("budget").agg(F.count(F.lit(1)).alias("n")).join(rules, "budget", "left").where("n > 5 * greatest(1, coalesce(rules, 0))")
    parts.append(found(swamp, "deviation_swamp", "n"))
    return parts
