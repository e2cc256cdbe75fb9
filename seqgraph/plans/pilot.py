"""Budgets, scopes and summaries, on the event graph and the sales tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import graph, metrics, pilot, sequences as seq
from . import fixture as fx
from .catalog import query, rounded


def _graph(spark, d):
    first = graph.cut(fx.first_visits(spark, d))
    return first, graph.cut(seq.edges(first)), graph.cut(seq.nodes(first))


def _by_source(edges):
    rows = edges.where("source <> 'all'").groupBy("source", F.col("parent").alias("state"), "action").agg(F.sum("games").alias("n"), F.sum("w").alias("w"), F.sum("d").alias("d"))
    return rows.select("source", "state", "action", "n", ((F.col("w") + F.col("d") / 2) / F.col("n")).alias("ep"))


_BY_SOURCE = ", es AS (SELECT source, parent AS state, action, CAST(sum(games) AS BIGINT) AS n, (sum(w) + sum(d) / 2.0) / sum(games) AS ep FROM edges WHERE source <> 'all' GROUP BY ALL)"


@query("SELECT l_returnflag AS source, count(*) AS stored, count(*) FILTER (l_returnflag = 'R' OR l_quantity >= 30) AS meets FROM lineitem GROUP BY l_returnflag")
def eval_store(spark, d):
    """Evaluations by source, and how many of them may be used."""
    ok = pilot.meets_threshold(F.col("l_returnflag"), F.col("l_quantity"), "R")
    return fx.table(spark, d, "lineitem").groupBy(F.col("l_returnflag").alias("source")).agg(F.count(F.lit(1)).alias("stored"), F.count_if(ok).alias("meets"))


@query(fx.SQL + _BY_SOURCE + """, b AS (SELECT *, max(ep) OVER (PARTITION BY source, state) AS best FROM es),
    t AS (SELECT state, action FROM (SELECT *, row_number() OVER (PARTITION BY state ORDER BY p DESC, action) AS r FROM dist WHERE source = 'all') WHERE r <= 2)
    SELECT state, source AS budget, round(round(avg(best - ep), 12), 6) + 0 AS loss FROM b JOIN t USING (state, action) GROUP BY state, source""")
def budget_losses(spark, d):
    """What the two most played actions lose, by two evaluations of each state."""
    _, edges, _ = _graph(spark, d)
    taught = metrics.top_per_group(metrics.distributions(edges).where("source = 'all'"), "state", 2, F.desc("p"), "action").select("state", "action")
    return rounded(rounded(pilot.budget_losses(_by_source(edges).withColumnRenamed("source", "budget"), taught), 12))


@query(fx.SQL + _BY_SOURCE + """, c AS (SELECT *, CAST(sum(n) OVER (PARTITION BY source, state) AS BIGINT) AS depth FROM es), k AS (SELECT state, arg_min(source, {'d': -depth, 's': source}) AS source FROM c GROUP BY state),
    u AS (SELECT c.*, max(ep) OVER (PARTITION BY state) AS best, count(*) OVER (PARTITION BY state) AS actions FROM c JOIN k USING (state, source)), a AS (SELECT state, sum(p) AS t FROM dist WHERE source = 'population' GROUP BY state),
    r AS (SELECT u.state, max(depth) AS depth, max(actions) AS actions, sum(p * (best - ep)) / sum(p) AS loss, coalesce(sum(p), 0) / any_value(t) AS coverage
        FROM u LEFT JOIN dist x ON x.source = 'population' AND x.state = u.state AND x.action = u.action LEFT JOIN a ON a.state = u.state WHERE actions >= 2 GROUP BY u.state)
    SELECT state, depth, actions, round(round(loss, 12), 6) + 0 AS loss, round(round(coverage, 12), 6) + 0 AS coverage FROM r""")
def cached_pilot(spark, d):
    """What people lose by each state's deepest search."""
    _, edges, _ = _graph(spark, d)
    rows = graph.cut(_by_source(edges))
    rows = rows.join(rows.groupBy("source", "state").agg(F.sum("n").alias("depth")), ["source", "state"])
    return rounded(rounded(pilot.cached_pilot(rows, metrics.distributions(edges).where("source = 'population'")), 12))


@query(fx.SQL + """, m AS (SELECT p.role AS family, action AS piece, p.structure AS origin, c.structure AS target, sum(reach * games) AS w FROM edges e JOIN nodes p ON p.state = e.parent JOIN nodes c ON c.state = e.child
        JOIN reach r ON r.source = 'all' AND r.state = e.parent WHERE e.source = 'all' GROUP BY ALL),
    o AS (SELECT *, w / sum(w) OVER (PARTITION BY family) AS share, row_number() OVER (PARTITION BY family ORDER BY round(w, 9) DESC, piece, origin, target) AS n FROM m)
    SELECT family, piece, origin, target, round(round(share, 12), 6) AS share FROM o WHERE n <= 12""")
def destinations(spark, d):
    """The most usual destinations for either side to move."""
    _, edges, nodes = _graph(spark, d)
    reach = graph.flow(edges, nodes).where("source = 'all'").select(F.col("state").alias("parent"), "reach")
    at = lambda key, name: nodes.select(F.col("state").alias(key), F.col("structure").alias(name), *(["role"] if key == "parent" else []))
    rows = edges.where("source = 'all'").join(at("parent", "origin"), "parent").join(at("child", "target"), "child").join(reach, "parent")
    return rounded(rounded(pilot.destinations(rows.select(F.col("role").alias("family"), F.col("action").alias("piece"), "origin", "target", (F.col("reach") * F.col("games")).alias("weight"))), 12))


@query(fx.SQL + """, e AS (SELECT * FROM edges WHERE source = 'all'), top AS (SELECT parent AS state, action, games, child FROM (SELECT *, row_number() OVER (PARTITION BY parent ORDER BY games DESC, action, child) AS n FROM e) WHERE n = 1),
    walk AS (SELECT structure AS family, 0 AS ply, min(state) AS state FROM nodes WHERE state IN (SELECT state FROM top) GROUP BY structure
        UNION ALL SELECT w.family, w.ply + 1, t.child FROM walk w JOIN top t USING (state) WHERE w.ply < 7)
    SELECT family, ply, state, action, games FROM walk JOIN top USING (state)""")
def representative_lines(spark, d):
    """The most played line from each structure's first state."""
    _, edges, nodes = _graph(spark, d)
    edges = edges.where("source = 'all'")
    starts = nodes.join(edges.select(F.col("parent").alias("state")).distinct(), "state", "left_semi").groupBy(F.col("structure").alias("family")).agg(F.min("state").alias("state"))
    return pilot.representative_lines(starts, edges)


@query(fx.SQL + """, pl AS (SELECT DISTINCT structure || ':' || coalesce(CAST(side AS VARCHAR), '-') AS plan, structure AS family, side FROM nodes, (SELECT unnest([0, 1, NULL]) AS side))
    SELECT plan, n.state, round(round(coalesce(r.reach, 0), 12), 6) + 0 AS reach FROM pl JOIN nodes n ON n.structure = pl.family AND (side IS NULL OR side = n.role) LEFT JOIN reach r ON r.source = 'expert' AND r.state = n.state
    WHERE n.state IN (SELECT state FROM dist WHERE source = 'expert')""")
def plan_scope(spark, d):
    """The states at which each structure's plans apply, for one side to move or either."""
    _, edges, nodes = _graph(spark, d)
    reach = graph.flow(edges, nodes).where("source = 'expert'").select("state", "reach")
    sides = F.explode(F.array(F.lit(0), F.lit(1), F.lit(None).cast("int")))
    plans = nodes.select(F.col("structure").alias("family")).distinct().select("family", sides.alias("side")).withColumn("plan", F.concat_ws(":", "family", F.coalesce(F.col("side").cast("string"), F.lit("-"))))
    boards = nodes.join(reach, "state", "left").select("state", F.col("structure").alias("family"), "role", "reach")
    return rounded(rounded(pilot.plan_scope(plans, boards, metrics.distributions(edges).where("source = 'expert'")), 12))


@query(fx.SQL + """ SELECT n.structure AS family, n.state, round(CASE WHEN coalesce(r.reach, 0) = 0 THEN 1e-9 ELSE r.reach END, 9) AS weight, action, round(round(p, 12), 9) AS p
    FROM nodes n LEFT JOIN reach r ON r.source = 'expert' AND r.state = n.state LEFT JOIN dist x ON x.source = 'expert' AND x.state = n.state""")
def family_samples(spark, d):
    """Each structure's states as weighted samples with what experts play next."""
    _, edges, nodes = _graph(spark, d)
    reach = graph.flow(edges, nodes).where("source = 'expert'").select("state", "reach")
    boards = nodes.join(reach, "state", "left").select("state", F.col("structure").alias("family"), "reach")
    return rounded(pilot.family_samples(boards, metrics.distributions(edges).where("source = 'expert'")), 9)


@query("""WITH r AS (SELECT s_suppkey AS item, row_number() OVER (ORDER BY s_acctbal DESC, s_suppkey) AS rank FROM supplier), c AS (SELECT DISTINCT l_suppkey AS item, l_partkey AS state FROM lineitem)
    SELECT state, array_to_string(list(CAST(item AS VARCHAR) ORDER BY rank), ',') AS items FROM c JOIN r USING (item) WHERE rank <= 8 GROUP BY state""")
def frontier_scope(spark, d):
    """Where the first eight suppliers by balance apply."""
    best = fx.table(spark, d, "supplier").select(F.struct((-F.col("s_acctbal")).alias("b"), F.col("s_suppkey").alias("item")).alias("s")).sort("s").limit(pilot.FRONTIER_ITEMS)
    ranked = best.agg(F.array_sort(F.collect_list("s")).alias("s")).select(F.posexplode("s").alias("rank", "s")).select(F.col("s.item").alias("item"), (F.col("rank") + 1).alias("rank"))
    cells = fx.table(spark, d, "lineitem").select(F.col("l_suppkey").alias("item"), F.col("l_partkey").alias("state"))
    return pilot.frontier_scope(ranked, cells).select("state", F.array_join(F.transform("items", lambda x: x.cast("string")), ",").alias("items"))


@query(fx.SQL + """, l AS (SELECT state, coalesce(list(action ORDER BY p DESC, action) FILTER (source = 'expert'), []) || coalesce(list(action ORDER BY p DESC, action) FILTER (source = 'population'), []) AS xs FROM dist GROUP BY state)
    SELECT state, array_to_string(list_filter(xs, lambda x, i: list_position(xs, x) = i), ',') AS actions FROM l""")
def joined_actions(spark, d):
    """The experts' actions and then the others', each once."""
    _, edges, _ = _graph(spark, d)
    of = lambda s: F.transform(F.array_sort(F.collect_list(F.when(F.col("source") == s, F.struct((-F.col("p")).alias("q"), "action")))), lambda x: x["action"])
    rows = metrics.distributions(edges).groupBy("state").agg(of("expert").alias("a"), of("population").alias("b"))
    return rows.select("state", F.array_join(pilot.joined_lists(F.col("a"), F.col("b")), ",").alias("actions"))


@query("""WITH b AS (SELECT CAST(p_partkey AS BIGINT) AS state, p_size / 1000.0 AS reach, 0.05 AS loss_pop FROM part), c AS (SELECT l_returnflag AS set_, l_partkey AS state, min(l_discount) AS loss, max(l_tax) AS explained FROM lineitem GROUP BY ALL),
    w AS (SELECT set_, count(*) AS positions, sum(reach * greatest(0, loss_pop - loss)) AS value, sum(reach * explained) AS behaviour FROM c JOIN b USING (state) GROUP BY set_),
    i AS (SELECT l_returnflag AS set_, count(DISTINCT l_suppkey) AS items FROM lineitem GROUP BY 1), p AS (SELECT set_, sum(weight) AS burden FROM (SELECT DISTINCT l_returnflag AS set_, l_suppkey % 50 AS part, (1 + l_suppkey % 50 % 3) / 2.0 AS weight FROM lineitem) GROUP BY set_),
    t AS (SELECT sum(reach) AS tr, sum(reach * loss_pop) AS tl FROM b)
    SELECT set_ AS "set", items, CAST(burden AS DOUBLE) AS burden, positions, round(round(value, 12), 6) AS value, round(round(value / tl, 12), 6) AS recovery, round(round(behaviour, 12), 6) AS behaviour, round(round(behaviour / tr, 12), 6) AS behaviour_fraction,
    round(round(value / burden, 12), 6) AS value_per_burden FROM i JOIN p USING (set_) JOIN w USING (set_), t""")
def set_summary(spark, d):
    """What three sets of knowledge are worth and cost as a whole."""
    lines = fx.table(spark, d, "lineitem")
    boards = fx.table(spark, d, "part").select(F.col("p_partkey").alias("state"), (F.col("p_size") / 1000.0).alias("reach"), F.lit(0.05).alias("loss_pop"))
    cells = lines.select(F.col("l_returnflag").alias("set"), F.col("l_suppkey").alias("item"), F.col("l_partkey").alias("state"), F.col("l_discount").alias("loss"), F.col("l_tax").alias("explained"))
    part = F.col("l_suppkey") % 50
    parts = lines.select(F.col("l_returnflag").alias("set"), part.alias("part"), ((1 + part % 3) / 2.0).alias("weight"))
    return rounded(rounded(pilot.set_summary(cells, boards, parts), 12))
