"""Mixing sources to target weights: hierarchical budgeting over a domain-language-source tree.

The token budget goes down the tree by the children's weights. A node can take at most `max_epochs` times the tokens
below it; what a child can't take goes to its siblings, by their weights, and leaves the parent only where all of its
children are full (a parent's own limit is the sum of its children's, so its siblings get the rest before its
ancestors do). Each level is one window over the children in the order of limit / weight: those below the water level
are filled, the others share what is left by weight. Only leaf totals take part, never documents.

A leaf that gets A tokens of its L takes floor(A / L) whole epochs and, of the next epoch, the longest prefix of at most
the remaining tokens in that epoch's seeded order, md5(seed:epoch:doc_id). The prefix is found in two steps: token sums
of 4096 ranges of the order (so a leaf with a third of all rows is dealt over 4096 groups), then the place within them.
Leaves are joined to rows by a broadcast of checked size, or salted.
It is stored as the order's last value, so selecting documents needs no shuffle of texts.

Defined results: null texts hold no tokens; null names count as the name ''; documents without tokens go with whole
epochs, and with a prefix that has room at their place; rows that repeat an id share a place in the order and are taken
together or not at all; names without a weight weigh 1; an empty table or a budget of 0 selects nothing but documents
without tokens of leaves that are taken whole.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import staged

LEVELS = ("domain", "lang", "source")
#: Leaves are broadcast up to this number (about 200 bytes each); more are joined by a shuffle over SALTS parts a leaf.
MOST_LEAVES, SALTS = 100_000, 64
_KEYS = tuple(f"_{level}" for level in LEVELS)


def word_tokens(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def _weight(column: str, weights: dict[str, float]) -> Column:
    out = F.lit(1.0)
    for name, value in sorted(weights.items()):
        out = F.when(F.col(column) == name, F.lit(float(value))).otherwise(out)
    return out


def share_out(children: DataFrame, parents: list[str], name: str) -> DataFrame:
    """Adds `allot`: each parent's `budget` over its children, given `capacity` and `weight` (water filling)."""
    full_at = F.when(F.col("weight") > 0, F.col("capacity") / F.col("weight")).otherwise(F.lit(float("inf")))
    children = children.withColumn("_full_at", full_at)
    group = Window.partitionBy(*parents) if parents else Window.partitionBy(F.lit(0))
    order = group.orderBy("_full_at", name)
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    onward = order.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    rows = children.withColumn("_before", F.coalesce(F.sum("capacity").over(before), F.lit(0))).withColumn("_onward", F.sum("weight").over(onward))
    rows = rows.withColumn("_full", (F.col("weight") > 0) & (F.col("_before") + F.col("_full_at") * F.col("_onward") <= F.col("budget")))
    taken = F.coalesce(F.sum(F.when(F.col("_full"), F.col("capacity"))).over(group), F.lit(0))
    rest = F.coalesce(F.sum(F.when(~F.col("_full"), F.col("weight"))).over(group), F.lit(0.0))
    rows = rows.withColumn("_left", F.col("budget") - taken).withColumn("_rest", rest)
    shared = F.when(F.col("_rest") > 0, F.col("_left") * F.col("weight") / F.col("_rest")).otherwise(F.lit(0.0))
    allot = F.when(F.col("_full"), F.col("capacity").cast("double")).otherwise(F.least(shared, F.col("capacity").cast("double")))
    return rows.withColumn("allot", allot).drop("_full_at", "_before", "_onward", "_full", "_left", "_rest")


def budgets(leaves: DataFrame, budget: float, weights: dict[str, dict[str, float]], max_epochs: int) -> DataFrame:
    """Adds `allot` (a long: tokens) to leaves (_domain, _lang, _source, n_tokens)."""
    leaves = leaves.withColumn("capacity", F.col("n_tokens") * max_epochs)
    above, parents = None, []
    for key, level in zip(_KEYS, LEVELS):
        here = leaves.groupBy(*parents, key).agg(F.sum("capacity").alias("capacity")).withColumn("weight", _weight(key, weights.get(level, {})))
        here = here.withColumn("budget", F.lit(float(budget))) if above is None else here.join(above, parents)
        parents = [*parents, key]
        above = share_out(here, parents[:-1], key).select(*parents, F.col("allot").alias("budget"))
    # a millionth of a token keeps whole numbers whole after the divisions
    return leaves.join(above, list(_KEYS)).withColumn("allot", F.floor(F.col("budget") + F.lit(1e-6)).cast("long")).drop("budget", "capacity")


def _place(seed: int, epoch: Column) -> Column:
    return F.md5(F.concat_ws(":", F.lit(str(seed)), epoch.cast("string"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))).cast("binary"))


def _leaf(domain: Column) -> list[Column]:
    named = (domain, F.col("lang"), F.col("source"))
    return [F.coalesce(c.cast("string"), F.lit("")).alias(k) for c, k in zip(named, _KEYS)]


def sizes(docs: DataFrame, domain: Column, tokens=word_tokens) -> DataFrame:
    """Leaf, doc_id and tokens of each row: all that planning needs."""
    return docs.select(*_leaf(domain), F.col("doc_id").cast("long").alias("doc_id"), tokens(F.col("text").cast("string")).alias("_tokens"))


def with_leaves(rows: DataFrame, leaves: DataFrame, most: int = MOST_LEAVES) -> DataFrame:
    """`rows` joined to their leaf, so that a leaf with a third of all rows isn't one task: by a broadcast of checked size, or salted."""
    if leaves.limit(most + 1).count() <= most:
        return rows.join(F.broadcast(leaves), list(_KEYS))
    salted = leaves.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return rows.withColumn("_salt", F.pmod(F.xxhash64("doc_id"), F.lit(SALTS)).cast("int")).join(salted, [*_KEYS, "_salt"]).drop("_salt")


def plan(rows: DataFrame, *, budget: float | None, fraction: float, weights: dict[str, dict[str, float]], max_epochs: int, seed: int, most_leaves: int = MOST_LEAVES) -> DataFrame:
    """For each leaf: n_tokens, allot, epochs (whole ones) and last (the place that ends the prefix; null: no prefix)."""
    leaves = rows.groupBy(*_KEYS).agg(F.sum("_tokens").alias("n_tokens"))
    if budget is None:
        budget = int((leaves.agg(F.sum("n_tokens")).first()[0] or 0) * fraction)
    leaves = budgets(leaves, budget, weights, max_epochs)
    whole = F.when(F.col("n_tokens") > 0, F.floor(F.col("allot") / F.col("n_tokens"))).otherwise(F.lit(1)).cast("int")
    leaves = leaves.withColumn("epochs", F.least(whole, F.lit(max_epochs)))
    leaves = leaves.withColumn("_room", F.when(F.col("epochs") < max_epochs, F.col("allot") - F.col("epochs") * F.col("n_tokens")))
    leaves = staged(leaves, "leaves")
    placed = with_leaves(rows, leaves.where("_room > 0").select(*_KEYS, "epochs", "_room"), most_leaves)
    placed = placed.withColumn("place", _place(seed, F.col("epochs") + 1)).withColumn("_range", F.substring("place", 1, 3))
    ranges = placed.groupBy(*_KEYS, "_range").agg(F.sum("_tokens").alias("_sum"))
    before = Window.partitionBy(*_KEYS).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    ranges = ranges.withColumn("_before", F.coalesce(F.sum("_sum").over(before), F.lit(0))).drop("_sum")
    within = Window.partitionBy(*_KEYS, "_range").orderBy("place").rangeBetween(Window.unboundedPreceding, Window.currentRow)
    upto = placed.join(ranges, [*_KEYS, "_range"]).withColumn("_upto", F.col("_before") + F.sum("_tokens").over(within))
    last = upto.where("_upto <= _room").groupBy(*_KEYS).agg(F.max("place").alias("last"))
    return leaves.join(last, list(_KEYS), "left").drop("_room")


def select(docs: DataFrame, planned: DataFrame, domain: Column, seed: int, most_leaves: int = MOST_LEAVES) -> DataFrame:
    """`docs` once for each epoch that takes the row, with a column epoch (from 1)."""
    docs = docs.drop("epoch")
    leaves = planned.select(*_KEYS, F.col("epochs").alias("_epochs"), F.col("last").alias("_last"))
    rows = with_leaves(docs.select(F.struct(*docs.columns).alias("_row"), "doc_id", *_leaf(domain)), leaves, most_leaves)
    more = F.coalesce(_place(seed, F.col("_epochs") + 1) <= F.col("_last"), F.lit(False)).cast("int")
    rows = rows.withColumn("_times", F.col("_epochs") + more).where("_times > 0")
    return rows.select("_row.*", F.explode(F.sequence(F.lit(1), F.col("_times"))).alias("epoch"))
