"""Regret, divergence and agreement between action distributions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.values import deviation_class, knowledge_gap, study_priority


def distributions(edges: DataFrame) -> DataFrame:
    """source, state, action, games, p: action shares."""
    rows = edges.groupBy("source", F.col("parent").alias("state"), "action").agg(F.sum("games").alias("games"))
    return rows.withColumn("p", F.col("games") / F.sum("games").over(Window.partitionBy("source", "state")))


def prune(dist: DataFrame, least_share: float, least_games: int) -> DataFrame:
    """Drops actions that are rare in both senses; `dropped` is the state's dropped share, p is renormalised."""
    state = Window.partitionBy("source", "state")
    keep = (F.col("p") >= least_share) | (F.col("games") >= least_games)
    rows = dist.withColumn("_keep", keep).withColumn("dropped", F.sum(F.when(~F.col("_keep"), F.col("p")).otherwise(0.0)).over(state))
    return rows.where("_keep").drop("_keep").withColumn("p", F.col("p") / F.sum("p").over(state))


def expected_regret(dist: DataFrame, evals: DataFrame) -> DataFrame:
    """source, state, regret, best_ep, mass_covered, n: loss against the best evaluated action, over evaluated mass."""
    best = evals.groupBy("state").agg(F.max("ep").alias("best_ep"))
    rows = dist.join(evals.select("state", "action", "ep"), ["state", "action"]).join(best, "state")
    loss = F.greatest(F.lit(0.0), F.col("best_ep") - F.col("ep"))
    found = rows.groupBy("source", "state").agg((F.sum(F.col("p") * loss) / F.sum("p")).alias("regret"), F.max("best_ep").alias("best_ep"), F.sum("p").alias("mass_covered"), F.count(F.lit(1)).alias("n"))
    return found


def gaps(regrets: DataFrame, reach: DataFrame) -> DataFrame:
    """state, expert_regret, population_regret, gap, priority: null where a source has no evaluated action."""
    pick = lambda s: F.max(F.when(F.col("source") == s, F.col("regret")))
    both = regrets.groupBy("state").agg(pick("expert").alias("expert_regret"), pick("population").alias("population_regret"))
    both = both.withColumn("gap", knowledge_gap(F.col("population_regret"), F.col("expert_regret")))
    reach = reach.where("source = 'population'").select("state", "reach")
    return both.join(reach, "state", "left").withColumn("priority", study_priority(F.col("reach"), F.col("gap")))


def paired(dist: DataFrame, left: str, right: str) -> DataFrame:
    """state, action, p, q over the union of both sources' actions; only states that both know."""
    a = dist.where(F.col("source") == left).select("state", "action", F.col("p").alias("_p"))
    b = dist.where(F.col("source") == right).select("state", "action", F.col("p").alias("_q"))
    known = a.select("state").distinct().intersect(b.select("state").distinct())
    rows = a.join(b, ["state", "action"], "full").join(known, "state", "left_semi")
    return rows.select("state", "action", F.coalesce("_p", F.lit(0.0)).alias("p"), F.coalesce("_q", F.lit(0.0)).alias("q"))


def divergence(pairs: DataFrame) -> DataFrame:
    """state, js (bits), overlap, tv, kl (null for infinite): how far two distributions are apart."""
    p, q = F.col("p"), F.col("q")
    m = (p + q) / 2
    half = lambda x: F.when(x > 0, x * F.log2(x / m)).otherwise(0.0)
    kl = F.when(F.max(((p > 0) & (q == 0)).cast("int")) == 0, F.sum(F.when(p > 0, p * F.log2(F.when(q > 0, p / q).otherwise(1.0))).otherwise(0.0)))
    return pairs.groupBy("state").agg((F.sum(half(p) + half(q)) / 2).alias("js"), F.sum(F.least(p, q)).alias("overlap"), (F.sum(F.abs(p - q)) / 2).alias("tv"), kl.alias("kl"))


def _corr(a: str, b: str) -> Column:
    """Pearson's correlation over 3 rows or more; null where a side doesn't vary."""
    sa, sb = F.stddev_pop(a), F.stddev_pop(b)
    return F.when((F.count(F.lit(1)) >= 3) & (sa > 1e-12) & (sb > 1e-12), F.try_divide(F.covar_pop(a, b), sa * sb))


def rank_agreement(pairs: DataFrame) -> DataFrame:
    """state, n, kendall, pearson, spearman over actions that both sources know (null below 2, 3 and 3 of them)."""
    shared = pairs.where("p > 0 AND q > 0")
    state = Window.partitionBy("state")
    mean_rank = lambda c: F.rank().over(state.orderBy(c)) + (F.count(F.lit(1)).over(Window.partitionBy("state", c)) - 1) / 2
    ranked = shared.withColumn("rp", mean_rank("p")).withColumn("rq", mean_rank("q"))
    stats = ranked.groupBy("state").agg(F.count(F.lit(1)).alias("n"), _corr("p", "q").alias("pearson"), _corr("rp", "rq").alias("spearman"))
    other = shared.select("state", F.col("action").alias("action2"), F.col("p").alias("p2"), F.col("q").alias("q2"))
    signs = shared.join(other, "state").where("action < action2").groupBy("state").agg((F.sum(F.signum((F.col("p") - F.col("p2")) * (F.col("q") - F.col("q2")))) / F.count(F.lit(1))).alias("kendall"))
    return stats.join(signs, "state", "left").select("state", "n", "kendall", "pearson", "spearman")


def entropy(dist: DataFrame) -> DataFrame:
    rows = dist.where("p > 0").groupBy("source", "state").agg((-F.sum(F.col("p") * F.log2("p"))).alias("entropy"))
    return rows.withColumn("effective", F.pow(F.lit(2.0), "entropy"))


def deviations(dist: DataFrame, evals: DataFrame, reach: DataFrame, main_share: float) -> DataFrame:
    """Population actions that are not main ones of the experts: loss, class and priority."""
    experts = dist.where("source = 'expert'").select("state", "action", F.col("p").alias("expert_p"))
    rows = dist.where("source = 'population'").join(experts, ["state", "action"], "left").where(F.coalesce("expert_p", F.lit(0.0)) < main_share)
    best = evals.groupBy("state").agg(F.max("ep").alias("best_ep"))
    rows = rows.join(evals.select("state", "action", "ep"), ["state", "action"], "left").join(best, "state", "left")
    rows = rows.withColumn("loss", F.col("best_ep") - F.col("ep")).withColumn("class", deviation_class(F.col("loss")))
    rows = rows.join(reach.where("source = 'population'").select("state", "reach"), "state", "left")
    return rows.withColumn("priority", F.col("reach") * F.col("p") * F.col("loss")).select("state", "action", "p", "expert_p", "loss", "class", "priority")


def ranked_actions(evals: DataFrame) -> DataFrame:
    """state, action, rank, gap2, gap3, tier: actions by value, with the best one's gaps to the second and third."""
    order = Window.partitionBy("state").orderBy(F.desc("ep"), "action")
    rows = evals.select("state", "action", "ep", F.row_number().over(order).alias("rank"), (F.col("ep") - F.lead("ep", 1).over(order)).alias("gap2"), (F.col("ep") - F.lead("ep", 2).over(order)).alias("gap3"))
    tier = F.when((F.col("rank") == 1) & (F.col("gap3") <= 0.015), "deepest").when((F.col("rank") == 1) & (F.col("gap2") <= 0.03), "deeper").otherwise("keep")
    return rows.withColumn("tier", tier)


def top_per_group(rows: DataFrame, group: str, k: int, *order: Column | str) -> DataFrame:
    return rows.withColumn("rank", F.row_number().over(Window.partitionBy(group).orderBy(*order))).where(F.col("rank") <= k)


def zscores(rows: DataFrame, value: str, bucket: str) -> DataFrame:
    """z within each bucket of 3 members or more; 0 where the spread is 0, null in smaller buckets."""
    w = Window.partitionBy(bucket)
    z = F.when(F.count(F.lit(1)).over(w) >= 3, F.when(F.stddev_pop(value).over(w) == 0, 0.0).otherwise((F.col(value) - F.avg(value).over(w)) / F.stddev_pop(value).over(w)))
    return rows.withColumn("z", z)


def index_quantiles(rows: DataFrame, group: str, value: str) -> DataFrame:
    """Quantiles by index: sorted[n/4], sorted[3n/4], sorted[min(n-1, 0.9n)], and the usual median.

    Found by rank over a window, so no group is gathered in one row.
    """
    w = Window.partitionBy(group)
    ranked = rows.withColumn("_i", F.row_number().over(w.orderBy(value)) - 1).withColumn("_n", F.count(F.lit(1)).over(w))
    at = lambda i: F.max(F.when(F.col("_i") == i, F.col(value)))
    n = F.col("_n")
    mid = (at(F.floor((n - 1) / 2)) + at(F.floor(n / 2))) / 2
    return ranked.groupBy(group).agg(at(F.floor(n / 4)).alias("q25"), mid.alias("median"), at(F.floor(3 * n / 4)).alias("q75"), at(F.least(n - 1, F.floor(n * 9 / 10))).alias("q90"))


def concentration(rows: DataFrame, group: str, value: str) -> DataFrame:
    """Share of the positive total that the largest one and three hold."""
    order = Window.partitionBy(group).orderBy(F.desc(value))
    ranked = rows.where(F.col(value) > 0).withColumn("_n", F.row_number().over(order))
    total = F.sum(value)
    return ranked.groupBy(group).agg((F.sum(F.when(F.col("_n") == 1, F.col(value))) / total).alias("top1"), (F.sum(F.when(F.col("_n") <= 3, F.col(value))) / total).alias("top3"))


def budget_pairs(evals: DataFrame, shallow: int, deep: int) -> DataFrame:
    """The same states evaluated at two budgets: best action kept, order kept, value change."""
    rank = Window.partitionBy("state", "budget").orderBy(F.desc("ep"), "action")
    rows = evals.withColumn("_r", F.row_number().over(rank))
    a = rows.where(F.col("budget") == shallow).select("state", "action", F.col("ep").alias("ep_a"), F.col("_r").alias("r_a"))
    b = rows.where(F.col("budget") == deep).select("state", "action", F.col("ep").alias("ep_b"), F.col("_r").alias("r_b"))
    both = a.join(b, ["state", "action"])
    return both.groupBy("state").agg(F.max(((F.col("r_a") == 1) & (F.col("r_b") == 1)).cast("int")).alias("best_same"), F.min((F.col("r_a") == F.col("r_b")).cast("int")).alias("order_same"), F.max(F.abs(F.col("ep_a") - F.col("ep_b"))).alias("max_change"))
