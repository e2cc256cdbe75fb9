"""Rules: what strong play answers at the states of a family, for the side to move and under conditions.

A state's own answers are the actions with enough games and share, most played first. A rule's answer set takes the
actions that hold most of the family's mass. One action needs its mass share; several need states whose own answers are
exactly that set. A rule that isn't earned is kept for recognition only: it has no answers and can never earn value.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: The share and games that an answer needs, answers in a rule, the mass share that a rule needs, the least share of a conditioned group.
ANSWER_SHARE, ANSWER_CAP, MIN_GAMES, SUPPORT_FLOOR, MIN_GROUP_SHARE = 0.35, 2, 20, 0.60, 0.10


def state_answers(dist: DataFrame, share: float = ANSWER_SHARE, cap: int = ANSWER_CAP, min_games: int = MIN_GAMES) -> DataFrame:
    """state, answers (in the order of their shares; empty for a contested state), top (null without enough games)."""
    total = dist.withColumn("_total", F.sum("p").over(Window.partitionBy("state")))
    order = Window.partitionBy("state").orderBy(F.desc("p"), "action")
    rows = total.where(F.col("games") >= min_games).withColumn("_r", F.row_number().over(order))
    held = (F.col("_r") <= cap) & (F.col("p") / F.col("_total") >= share)
    answers = F.transform(F.array_sort(F.collect_list(F.when(held, F.struct("_r", "action")))), lambda a: a["action"])
    found = rows.groupBy("state").agg(answers.alias("answers"), F.min_by("action", "_r").alias("top"))
    return dist.select("state").distinct().join(found, "state", "left").select("state", F.coalesce("answers", F.array().cast("array<string>")).alias("answers"), "top")


def derive(boards: DataFrame, answers: DataFrame, keys: list[str], floor: float = SUPPORT_FLOOR, cap: int = ANSWER_CAP) -> DataFrame:
    """One rule for each group of `boards` (state, weight and `keys`): kind, answers, support, strict_support, coverage, boards, exceptions, exception_mass, reason."""
    rows = boards.join(answers, "state")
    size = rows.groupBy(*keys).agg(F.sum("weight").alias("coverage"), F.count(F.lit(1)).alias("boards"))
    mass = rows.select(*keys, "weight", F.explode("answers").alias("action")).groupBy(*keys, "action").agg(F.sum("weight").alias("m"))
    order = Window.partitionBy(*keys).orderBy(F.desc(F.round("m", 12)), "action")
    before = F.coalesce(F.sum("m").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    taken = mass.withColumn("_r", F.row_number().over(order)).withColumn("_before", before).where((F.col("_r") <= cap) & (F.col("_before") < floor))
    sets = taken.groupBy(*keys).agg(F.transform(F.array_sort(F.collect_list(F.struct("_r", "action"))), lambda a: a["action"]).alias("set"), F.sum("m").alias("covered"))
    # one set a group: as small as the number of groups
    judged = rows.join(sets, keys, "left").withColumn("set", F.coalesce("set", F.array().cast("array<string>")))
    strict = F.sum(F.when(F.col("answers") == F.col("set"), F.col("weight")).otherwise(0.0)).alias("strict")
    beside = F.col("top").isNotNull() & ~F.array_contains("set", F.col("top"))
    found = judged.groupBy(*keys).agg(F.first("set").alias("set"), F.first("covered").alias("covered"), strict, F.count_if(beside).alias("exceptions"), F.sum(F.when(beside, F.col("weight")).otherwise(0.0)).alias("exception_mass"))
    out = found.join(size, keys).withColumn("support", F.col("covered") / F.when(F.col("coverage") > 0, F.col("coverage"))).withColumn("strict_support", F.when(F.size("set") > 0, F.col("strict")) / F.when(F.col("coverage") > 0, F.col("coverage")))
    required = F.when(F.size("set") == 1, F.col("support")).otherwise(F.col("strict_support"))
    earned = (F.size("set") > 0) & (F.coalesce(F.round(required, 9), F.lit(0.0)) >= floor)
    reason = F.when(earned, "").when(F.size("set") == 0, "no_answer").when(F.size("set") > 1, "not_strict").otherwise("not_enough_mass")
    return out.select(
        *keys, F.when(earned, "prescriptive").otherwise("recognition_only").alias("kind"), F.when(earned, F.array_join("set", ",")).otherwise("").alias("answers"), "support", "strict_support", "coverage",
        "boards", "exceptions", "exception_mass", reason.alias("reason"),
    )


def with_fallback(boards: DataFrame, answers: DataFrame, features: list[str], least_share: float = MIN_GROUP_SHARE) -> DataFrame:
    """family, role, feature, value and the rule: a rule for each family and side; where that isn't earned, earned rules of its groups by feature.

    `boards` has family, role, state, weight and the feature columns. A group needs `least_share` of its side's mass.
    """
    base = derive(boards, answers, ["family", "role"]).withColumns({"feature": F.lit(None).cast("string"), "value": F.lit(None).cast("string")})
    open_ = base.where("kind <> 'prescriptive'").select("family", "role", F.col("coverage").alias("_total"))
    facts = F.explode(F.array(*[F.struct(F.lit(f).alias("feature"), F.col(f).cast("string").alias("value")) for f in features]))
    groups = boards.join(open_.drop("_total"), ["family", "role"], "left_semi").select("family", "role", "state", "weight", facts.alias("f")).select("family", "role", "state", "weight", "f.*").where("value IS NOT NULL")
    found = derive(groups, answers, ["family", "role", "feature", "value"]).where("kind = 'prescriptive'").join(open_, ["family", "role"])
    return base.unionByName(found.where(F.col("coverage") >= least_share * F.col("_total")).drop("_total"))


def as_items(rules: DataFrame) -> DataFrame:
    """item, type and answers of each rule: recognition earns null, never zero."""
    condition = F.concat_ws("=", "feature", "value")
    return rules.select(F.sha1(F.concat_ws("|", "family", F.col("role").cast("string"), condition).cast("binary")).alias("item"), F.when(F.col("kind") == "prescriptive", "template").otherwise("orientation").alias("type"), F.when(F.col("answers") != "", F.split("answers", ",")).alias("answers"), "family", "role", "feature", "value", "coverage")
