"""Iterative and path operators over state graphs.

Loops run a bounded number of levels. Each level is one join and one aggregation over the edge table; its result is
written to the shared folder, so neither lineage nor recomputation grows with the depth.
"""

from __future__ import annotations

import tempfile
import uuid
from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


_own: dict[str, str] = {}


def shared_dir(spark) -> str:
    """The folder all executors share, spark.checkpoint.dir; one of our own only where that is unset and all run on this machine."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if base:
        return base.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    app = spark.sparkContext.applicationId
    if app not in _own:
        _own[app] = "file://" + tempfile.mkdtemp(prefix="seqgraph-")
    return _own[app]


def clean(spark) -> None:
    """Removes what this application's loops wrote; no DataFrame that came from them can be read afterwards."""
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{shared_dir(spark)}/seqgraph/{spark.sparkContext.applicationId}")
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def cut(df: DataFrame) -> DataFrame:
    """Cuts the lineage by a table in the shared folder: one job, and lost executors recompute nothing above. `clean` removes it."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/seqgraph/{spark.sparkContext.applicationId}/cut-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


class _Levels:
    """Mass that goes along forward edges, ply by ply: `rows` has source, parent, child, p_ply, c_ply and what `send` needs."""

    def __init__(self, rows: DataFrame):
        self.rows = rows
        size = rows.agg(F.max("c_ply").alias("last"), F.max(F.col("c_ply") - F.col("p_ply")).alias("jump")).first()
        #: Edges may skip plies: what is sent waits for at most `jump` plies.
        self.plies, self.jump, self.waiting = size["last"] or 0, size["jump"] or 1, []

    def step(self, ply: int, at: DataFrame, send, take) -> DataFrame:
        """The level after `ply`: `send` maps the edges of the level joined to `at`, `take` aggregates what arrives at a state."""
        sent = send(self.rows.where(F.col("p_ply") == ply).join(at.withColumnRenamed("state", "parent"), ["source", "parent"]))
        if self.jump == 1:
            return cut(take(sent.groupBy("source", F.col("child").alias("state"))))
        self.waiting = [*self.waiting, cut(sent)][-self.jump :]
        return cut(take(_union(self.waiting).where(F.col("c_ply") == ply + 1).groupBy("source", F.col("child").alias("state"))))


def _union(parts: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, parts)


def closure(edges: DataFrame, root: str, threshold: int, max_depth: int) -> DataFrame:
    """state, depth of all states that edges with at least `threshold` games reach from the root."""
    strong = cut(edges.where(F.col("games") >= threshold).select("parent", "child").distinct())
    seen = edges.sparkSession.range(1).select(F.lit(root).alias("state"), F.lit(0).alias("depth"))
    frontier = seen
    for depth in range(1, max_depth + 1):
        new = strong.join(frontier, strong["parent"] == frontier["state"], "left_semi").select(F.col("child").alias("state")).distinct()
        frontier = cut(new.join(seen, "state", "left_anti").withColumn("depth", F.lit(depth)))
        if frontier.isEmpty():
            break
        seen = seen.unionByName(frontier)
    return seen


def links(edges: DataFrame, closed: DataFrame) -> DataFrame:
    """All edges, rare ones too, between retained states."""
    inside = closed.select("state")
    return edges.join(inside, edges["parent"] == inside["state"], "left_semi").join(inside, edges["child"] == inside["state"], "left_semi")


def forward_shares(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Edges with their share of the parent's games, and whether they lead to a larger min_ply (accepted by the flow)."""
    share = F.col("games") / F.sum("games").over(Window.partitionBy("source", "parent"))
    rows = edges.withColumn("share", share)
    p, c = nodes.select(F.col("state").alias("parent"), F.col("min_ply").alias("p_ply")), nodes.select(F.col("state").alias("child"), F.col("min_ply").alias("c_ply"))
    rows = rows.join(p, "parent").join(c, "child", "left")
    return rows.withColumn("inside", F.col("c_ply").isNotNull()).withColumn("forward", F.col("c_ply") > F.col("p_ply"))


#: Path counts stop here: beyond it a double holds no unit.
MOST_PATHS = 1 << 53


def flow(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """source, state, reach, enter, leakage, ignored_back_mass, paths of every reached node, all sources in one loop.

    Mass 1 starts at each source's entry and goes along edges by their shares, in the order of min_ply: an edge is
    accepted if its child has a larger min_ply. `enter` is the mass that comes from another structure, or starts here.
    Mass on other inside edges is recorded as ignored at the child; the share that leaves the node set is the parent's
    leakage.
    """
    rows = cut(forward_shares(edges, nodes))
    own, inner = nodes.select(F.col("state").alias("parent"), F.col("structure").alias("_from")), nodes.select(F.col("state").alias("child"), F.col("structure").alias("_to"))
    accepted = cut(rows.where("forward").join(own, "parent").join(inner, "child").select("source", "parent", "child", "share", "p_ply", "c_ply", (F.col("_from") != F.col("_to")).alias("enters")))
    sources = rows.select("source").distinct()
    # one entry row a source: the number of sources is fixed by the caller
    at = nodes.where("is_entry").select("state").crossJoin(F.broadcast(sources)).select("source", "state", F.lit(1.0).alias("reach"), F.lit(1.0).alias("enter"), F.lit(1).cast("long").alias("paths"))
    levels, parts = _Levels(accepted), [at]
    send = lambda df: df.select("source", "child", "c_ply", (F.col("reach") * F.col("share")).alias("m"), F.when(F.col("enters"), F.col("reach") * F.col("share")).otherwise(0.0).alias("e"), "paths")
    take = lambda g: g.agg(F.sum("m").alias("reach"), F.sum("e").alias("enter"), F.least(F.sum(F.col("paths").cast("decimal(38,0)")), F.lit(MOST_PATHS)).cast("long").alias("paths"))
    for ply in range(levels.plies):
        at = levels.step(ply, at, send, take)
        parts.append(at)
    reached = _union(parts)
    leak = rows.groupBy("source", F.col("parent").alias("state")).agg(F.sum(F.when(~F.col("inside"), F.col("share")).otherwise(0.0)).alias("leakage"))
    back = rows.where("inside AND NOT forward").join(reached.withColumnRenamed("state", "parent"), ["source", "parent"])
    back = back.groupBy("source", F.col("child").alias("state")).agg(F.sum(F.col("reach") * F.col("share")).alias("ignored_back_mass"))
    out = reached.join(leak, ["source", "state"], "left").join(back, ["source", "state"], "left")
    return out.select("source", "state", "reach", "enter", F.coalesce("leakage", F.lit(0.0)).alias("leakage"), F.coalesce("ignored_back_mass", F.lit(0.0)).alias("ignored_back_mass"), "paths")


def parents(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Contributing parents (with a smaller min_ply) and all parents of each state, by source."""
    rows = forward_shares(edges, nodes)
    return rows.where("inside").groupBy("source", F.col("child").alias("state")).agg(F.countDistinct(F.when(F.col("forward"), F.col("parent"))).alias("parents_in"), F.countDistinct("parent").alias("parents_all"))


def best_lines(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """The most likely line to each state by forward edges: source, state, logp, line. Ties: the smaller line."""
    rows = cut(forward_shares(edges, nodes).where("forward").withColumn("l", F.ln("share")).select("source", "parent", "action", "child", "l", "p_ply", "c_ply"))
    sources = rows.select("source").distinct()
    at = nodes.where("is_entry").select("state").crossJoin(F.broadcast(sources)).select("source", "state", F.lit(0.0).alias("logp"), F.lit("").alias("line"))
    line = F.when(F.col("line") == "", F.col("action")).otherwise(F.concat_ws(" ", "line", "action"))
    send = lambda df: df.select("source", "child", "c_ply", (F.col("logp") + F.col("l")).alias("logp"), line.alias("line"))
    best = F.min(F.struct(F.round(-F.col("logp"), 9).alias("cost"), "line", "logp")).alias("best")
    levels, parts = _Levels(rows), [at]
    for ply in range(levels.plies):
        at = levels.step(ply, at, send, lambda g: g.agg(best).select("source", "state", "best.logp", "best.line"))
        parts.append(at)
    return _union(parts)


def extend_lines(lines: DataFrame, edges: DataFrame, min_games: int, steps: int) -> DataFrame:
    """Follows the most played edge (ties: the smaller action) from each line's state while it has `min_games`."""
    order = Window.partitionBy("parent").orderBy(F.desc("games"), "action")
    best = cut(edges.where(F.col("games") >= min_games).withColumn("_n", F.row_number().over(order)).where("_n = 1").select("parent", "action", "child"))
    at = lines.select("line_id", "state", F.lit("").alias("more"), F.lit(0).alias("extended"))
    for _ in range(steps):
        at = at.join(best, at["state"] == best["parent"], "left").select(
            "line_id", F.coalesce("child", "state").alias("state"),
            F.when(F.col("child").isNull(), F.col("more")).otherwise(F.trim(F.concat_ws(" ", "more", "action"))).alias("more"),
            (F.col("extended") + F.col("child").isNotNull().cast("int")).alias("extended"),
        )
    return at


def union_coverage(edges: DataFrame, nodes: DataFrame, targets: DataFrame) -> DataFrame:
    """The mass that meets a target set, each game once: flow stops where it first enters the set."""
    rows = cut(forward_shares(edges, nodes).where("forward").select("source", "parent", "child", "share", "p_ply", "c_ply"))
    stop = targets.select("state").distinct()
    sources = rows.select("source").distinct()
    at = nodes.where("is_entry").select("state").crossJoin(F.broadcast(sources)).select("source", "state", F.lit(1.0).alias("reach"))
    send = lambda df: df.select("source", "child", "c_ply", (F.col("reach") * F.col("share")).alias("m"))
    levels, caught = _Levels(rows), [at.join(stop, "state", "left_semi").select("source", "state", "reach")]
    for ply in range(levels.plies):
        at = levels.step(ply, at.join(stop, "state", "left_anti"), send, lambda g: g.agg(F.sum("m").alias("reach")))
        caught.append(at.join(stop, "state", "left_semi").select("source", "state", "reach"))
    return _union(caught)


def _inside(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """All edges with their share of the parent's games and the structures at both ends (null: out of the node set)."""
    inner = nodes.select(F.col("state").alias("child"), F.col("structure").alias("next_structure"))
    own = nodes.select(F.col("state").alias("parent"), "structure", "min_ply")
    share = F.col("games") / F.sum("games").over(Window.partitionBy("source", "parent"))
    return cut(edges.withColumn("share", share).join(own, "parent").join(inner, "child", "left"))


def _pushed(rows: DataFrame, at: DataFrame, steps: int):
    """Mass by source, structure and state before each step, pushed along edges that stay in their structure."""
    stay = cut(rows.where("next_structure = structure").select("source", "parent", "child", "share"))
    for step in range(steps + 1):
        yield step, at
        if step < steps:
            at = at.join(stay, (at["source"] == stay["source"]) & (at["state"] == stay["parent"])).groupBy(at["source"], at["structure"], F.col("child").alias("state")).agg(F.sum(F.col("m") * F.col("share")).alias("m"))
            at = cut(at)
            if at.isEmpty():
                return


def dwell(edges: DataFrame, nodes: DataFrame, reached: DataFrame, steps: int = 20) -> DataFrame:
    """How long mass stays inside its structure, all structures and sources in one loop: source, structure, step, inside.

    What enters a structure is the flow that comes from outside it (`enter` of `reached`). Each step moves the mass along
    the shares; what leads to another structure, out of the node set, or nowhere has left. `inside` is the mass that is
    left after a step, as a share of what entered; steps after the last with any mass are not listed.
    """
    rows = _inside(edges, nodes)
    start = reached.where("enter > 0").join(nodes.select("state", "structure"), "state")
    at = cut(start.select("source", "structure", "state", (F.col("enter") / F.sum("enter").over(Window.partitionBy("source", "structure"))).alias("m")))
    out = [level.groupBy("source", "structure").agg(F.sum("m").alias("inside")).withColumn("step", F.lit(step)) for step, level in _pushed(rows, at, steps)]
    return _union(out).select("source", "structure", "step", "inside")


def dwell_stats(curve: DataFrame, steps: int = 20) -> DataFrame:
    """source, structure, mean_dwell, median_dwell, exit_first_ply, exit_within_two, retention_3 from the curve of `dwell`.

    Dwell is counted over the mass that has left within `steps` steps.
    """
    by = Window.partitionBy("source", "structure").orderBy("step")
    rows = curve.withColumn("_left", F.when(F.col("step") < steps, F.col("inside") - F.coalesce(F.lead("inside").over(by), F.lit(0.0))).otherwise(0.0))
    upto, total = F.sum("_left").over(by), F.sum("_left").over(Window.partitionBy("source", "structure"))
    rows = rows.withColumn("_total", total).withColumn("_half", F.when(F.round(upto / total, 9) >= 0.5, F.col("step") + 1))
    first = lambda n: F.sum(F.when(F.col("step") < n, F.col("_left"))) / F.max("_total")
    return rows.groupBy("source", "structure").agg(
        (F.sum((F.col("step") + 1) * F.col("_left")) / F.max("_total")).alias("mean_dwell"), F.min("_half").cast("int").alias("median_dwell"),
        first(1).alias("exit_first_ply"), first(2).alias("exit_within_two"), F.coalesce(F.max(F.when(F.col("step") == 3, F.col("inside"))), F.lit(0.0)).alias("retention_3"),
    )


def structure_edges(edges: DataFrame, nodes: DataFrame, reached: DataFrame, steps: int = 40) -> DataFrame:
    """source, structure, next_structure, action, mass, exit_ply: where the mass that enters a structure goes.

    The entering flow is pushed through the structure's own states for up to `steps` steps; each exit keeps its mass, so
    exits and leaks (null next_structure: out of the node set, or nowhere) add up to what entered. `exit_ply` is the
    mean min_ply of the states that it leaves from.
    """
    rows = _inside(edges, nodes)
    leave = cut(rows.where("next_structure IS NULL OR next_structure <> structure").select("source", "parent", "next_structure", "action", "share", "min_ply"))
    going = rows.select("source", F.col("parent").alias("state")).distinct()
    start = reached.where("enter > 0").join(nodes.select("state", "structure"), "state").select("source", "structure", "state", F.col("enter").alias("m"))
    ply = nodes.select("state", "min_ply")
    out = []
    for _, at in _pushed(rows, cut(start), steps):
        gone = at.join(leave, (at["source"] == leave["source"]) & (at["state"] == leave["parent"])).select(at["source"], at["structure"], "next_structure", "action", (F.col("m") * F.col("share")).alias("m"), "min_ply")
        ended = at.join(going, ["source", "state"], "left_anti").join(ply, "state").select("source", "structure", F.lit(None).cast("string").alias("next_structure"), F.lit(None).cast("string").alias("action"), "m", "min_ply")
        out.append(gone.unionByName(ended))
    return _union(out).groupBy("source", "structure", "next_structure", "action").agg(F.sum("m").alias("mass"), (F.sum(F.col("m") * F.col("min_ply")) / F.sum("m")).alias("exit_ply"))


def main_trajectories(edges: DataFrame, source: str, root: str, branches: int, depth: int) -> DataFrame:
    """Paths that follow each state's best `branches` edges up to `depth` steps, without visiting a state twice."""
    order = Window.partitionBy("parent").orderBy(F.desc("games"), "action")
    best = cut(edges.where(F.col("source") == source).withColumn("_n", F.row_number().over(order)).where(F.col("_n") <= branches).select("parent", "action", "child", "games"))
    at = edges.sparkSession.range(1).select(F.lit(root).alias("state"), F.array(F.lit(root)).alias("seen"), F.lit("").alias("path"), F.lit(0).alias("steps"))
    parts = [at]
    for step in range(1, depth + 1):
        at = at.join(best, at["state"] == best["parent"]).where(~F.array_contains("seen", F.col("child")))
        at = cut(at.select(F.col("child").alias("state"), F.concat("seen", F.array("child")).alias("seen"), F.trim(F.concat_ws(" ", "path", "action")).alias("path"), F.lit(step).alias("steps")))
        parts.append(at)
    return _union(parts).drop("seen")


def horizon(edges: DataFrame, nodes: DataFrame, source: str, k: int) -> DataFrame:
    """state, structure, p: where a state's games stand, by structure, k steps later (lost mass isn't counted)."""
    share = F.col("games") / F.sum("games").over(Window.partitionBy("parent"))
    rows = cut(edges.where(F.col("source") == source).withColumn("share", share).groupBy("parent", "child").agg(F.sum("share").alias("share")))
    at = nodes.select(F.col("state").alias("origin"), "state", F.lit(1.0).alias("p"))
    for _ in range(k):
        at = cut(at.join(rows, at["state"] == rows["parent"]).groupBy("origin", F.col("child").alias("state")).agg(F.sum(F.col("p") * F.col("share")).alias("p")))
    return at.join(nodes.select("state", "structure"), "state").groupBy(F.col("origin").alias("state"), "structure").agg(F.sum("p").alias("p"))


def sampled_walks(edges: DataFrame, source: str, root: str, samples: int, steps: int, seed: str) -> DataFrame:
    """sample, step, state, action: walks that draw each edge by its share with a hash of (seed, sample, step)."""
    order = Window.partitionBy("parent").orderBy("action")
    total = Window.partitionBy("parent")
    rows = edges.where(F.col("source") == source)
    upto = F.sum("games").over(order) / F.sum("games").over(total)
    rows = cut(rows.select("parent", "action", "child", (upto - F.col("games") / F.sum("games").over(total)).alias("lo"), upto.alias("hi")))
    at = edges.sparkSession.range(samples).select(F.col("id").alias("sample"), F.lit(root).alias("state"))
    parts = []
    for step in range(steps):
        u = F.conv(F.substring(F.sha2(F.concat_ws(":", F.lit(seed), F.col("sample").cast("string"), F.lit(str(step))), 256), 1, 8), 16, 10).cast("double") / 4294967296.0
        drawn = at.withColumn("u", u).join(rows, (F.col("state") == F.col("parent")) & (F.col("u") >= F.col("lo")) & (F.col("u") < F.col("hi")))
        drawn = cut(drawn.select("sample", F.lit(step).alias("step"), "state", "action", "child"))
        parts.append(drawn.select("sample", "step", "state", "action"))
        at = drawn.select("sample", F.col("child").alias("state"))
    return _union(parts)
