"""Flow, lines and structures."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import values as v
from ..operators import graph, metrics, sequences as seq
from . import fixture as fx
from .catalog import query, rounded


def _graph(spark, d, last_actions=0):
    """Edges and nodes, cut once: every loop below reads them several times."""
    first = graph.cut(fx.first_visits(spark, d, last_actions))
    return graph.cut(seq.edges(first)), graph.cut(seq.nodes(first))


FLOW = """ SELECT r.source, r.state, round(r.reach, 6) AS reach, round(coalesce(e.enter, 0), 6) AS enter, r.paths,
    round(coalesce((SELECT sum(share) FROM shares s WHERE s.source = r.source AND s.parent = r.state AND s.c_ply IS NULL), 0), 6) AS leakage,
    round(coalesce((SELECT sum(s.share * q.reach) FROM shares s JOIN reach q ON q.source = s.source AND q.state = s.parent
        WHERE s.source = r.source AND s.child = r.state AND s.c_ply <= s.p_ply), 0), 6) AS ignored_back_mass FROM reach r LEFT JOIN enter e ON e.source = r.source AND e.state = r.state"""


@query(fx.SQL + FLOW)
def flow(spark, d):
    edges, nodes = _graph(spark, d)
    return rounded(graph.flow(edges, nodes))


@query(fx.SQL_CYCLIC + FLOW)
def flow_cyclic(spark, d):
    edges, nodes = _graph(spark, d, 2)
    return rounded(graph.flow(edges, nodes))


@query(fx.SQL + fx.LINES + " SELECT source, state, round(best.logp, 6) AS logp, best.line AS line FROM lines")
def viterbi_lines(spark, d):
    edges, nodes = _graph(spark, d)
    return rounded(graph.best_lines(edges, nodes))


@query(fx.SQL + fx.LINES + """, nodes_m AS (SELECT e.parent AS state, sum(e.games) AS games FROM edges e WHERE source = 'all' GROUP BY ALL)
    SELECT best.line AS line, CAST(sum(games) AS BIGINT) AS mass FROM lines JOIN nodes_m USING (state) WHERE source = 'all' GROUP BY 1""")
def development_orders(spark, d):
    """Games by the most likely line that leads to their state."""
    edges, nodes = _graph(spark, d)
    best = graph.best_lines(edges.where("source = 'all'"), nodes)
    mass = edges.where("source = 'all'").groupBy(F.col("parent").alias("state")).agg(F.sum("games").alias("games"))
    return best.join(mass, "state").groupBy("line").agg(F.sum("games").alias("mass"))


STRUCTURES = """, target AS (SELECT state FROM nodes WHERE structure = '1,1'),
    walk AS (SELECT DISTINCT source, '' AS state, 1.0::DOUBLE AS m FROM edges UNION ALL SELECT s.source, s.child, sum(w.m * s.share) FROM walk w
        JOIN shares s ON s.source = w.source AND s.parent = w.state AND s.c_ply > s.p_ply WHERE w.state NOT IN (SELECT state FROM target) GROUP BY s.source, s.child)"""


@query(fx.SQL + STRUCTURES + " SELECT source, state, round(sum(m), 6) AS reach FROM walk WHERE state IN (SELECT state FROM target) GROUP BY ALL")
def union_coverage(spark, d):
    edges, nodes = _graph(spark, d)
    return rounded(graph.union_coverage(edges, nodes, nodes.where("structure = '1,1'")))


@query(fx.SQL + STRUCTURES + " SELECT source, round(sum(m), 6) AS coverage FROM walk WHERE state IN (SELECT state FROM target) GROUP BY source")
def set_coverage(spark, d):
    """The absorbing coverage of a set of structures: mass is caught where it first enters the set."""
    edges, nodes = _graph(spark, d)
    caught = graph.union_coverage(edges, nodes, nodes.where("structure = '1,1'"))
    return rounded(caught.groupBy("source").agg(F.sum("reach").alias("coverage")))


@query(fx.SQL + """, best AS (SELECT parent, action, child, games, row_number() OVER (PARTITION BY parent ORDER BY games DESC, action) AS n FROM edges WHERE source = 'all'),
    walk AS (SELECT '' AS state, [''] AS seen, '' AS path, 0 AS steps UNION ALL SELECT child, list_append(seen, child), trim(path || ' ' || action), steps + 1
        FROM walk JOIN best ON parent = state WHERE n <= 2 AND steps < 5 AND NOT list_contains(seen, child))
    SELECT state, path, steps FROM walk""")
def main_trajectories(spark, d):
    return graph.main_trajectories(graph.cut(fx.edges(spark, d)), "all", "", 2, 5)


@query(fx.SQL + """, best AS (SELECT parent, action, child FROM (SELECT *, row_number() OVER (PARTITION BY parent ORDER BY games DESC, action) AS n FROM edges
        WHERE source = 'all' AND games >= 5) WHERE n = 1),
    starts AS (SELECT row_number() OVER (ORDER BY state) AS line_id, state FROM nodes WHERE min_ply = 2),
    walk AS (SELECT line_id, state, '' AS more, 0 AS extended FROM starts UNION ALL SELECT line_id, child, trim(more || ' ' || action), extended + 1 FROM walk JOIN best ON parent = state WHERE extended < 4)
    SELECT line_id, arg_max(state, extended) AS state, arg_max(more, extended) AS more, CAST(max(extended) AS INTEGER) AS extended FROM walk GROUP BY line_id""")
def mainline_extension(spark, d):
    edges, nodes = _graph(spark, d)
    starts = nodes.where("min_ply = 2").select(F.row_number().over(Window.orderBy("state")).alias("line_id"), "state")  # a few named lines
    return graph.extend_lines(starts, edges.where("source = 'all'"), 5, 4)


@query(fx.SQL + """, e AS (SELECT parent, child, sum(share) AS share FROM shares WHERE source = 'all' GROUP BY ALL),
    h AS (SELECT n.state AS origin, a.child AS s1 , a.share AS p1 FROM nodes n JOIN e a ON a.parent = n.state),
    h2 AS (SELECT origin, b.child AS s2, sum(p1 * b.share) AS p2 FROM h JOIN e b ON b.parent = s1 GROUP BY ALL),
    h3 AS (SELECT origin, c.child AS s3, sum(p2 * c.share) AS p3 FROM h2 JOIN e c ON c.parent = s2 GROUP BY ALL)
    SELECT origin AS state, structure, round(sum(p3), 6) AS p FROM h3 JOIN nodes n ON n.state = s3 GROUP BY ALL""")
def horizon_structures(spark, d):
    edges, nodes = _graph(spark, d)
    return rounded(graph.horizon(edges, nodes, "all", 3))


DWELL = """, spread AS (SELECT source, structure, state, enter / sum(enter) OVER (PARTITION BY source, structure) AS m FROM enter JOIN nodes USING (state) WHERE enter > 0),
    inside AS (SELECT source, structure, state, m, 0 AS step FROM spread UNION ALL SELECT i.source, i.structure, s.child, sum(i.m * s.share), i.step + 1 FROM inside i
        JOIN shares s ON s.source = i.source AND s.parent = i.state AND s.c_structure = i.structure WHERE i.step < 20 GROUP BY i.source, i.structure, s.child, i.step),
    curve AS (SELECT source, structure, step, sum(m) AS inside FROM inside GROUP BY ALL),
    gone AS (SELECT *, CASE WHEN step < 20 THEN inside - coalesce(lead(inside) OVER (PARTITION BY source, structure ORDER BY step), 0) ELSE 0 END AS left_ FROM curve),
    dw AS (SELECT source, structure, sum((step + 1) * left_) / sum(left_) AS mean_dwell, sum(left_) FILTER (step < 1) / sum(left_) AS exit1, sum(left_) FILTER (step < 2) / sum(left_) AS exit2,
        coalesce(max(inside) FILTER (step = 3), 0) AS retention3 FROM gone GROUP BY source, structure),
    half AS (SELECT source, structure, min(step) + 1 AS median_dwell FROM (SELECT *, sum(left_) OVER (PARTITION BY source, structure ORDER BY step) / sum(left_) OVER (PARTITION BY source, structure) AS upto FROM gone)
        WHERE round(upto, 9) >= 0.5 GROUP BY ALL)"""


def _dwell(spark, d):
    edges, nodes = _graph(spark, d)
    return graph.dwell(edges, nodes, graph.cut(graph.flow(edges, nodes)))


@query(fx.SQL + DWELL + " SELECT source, structure, CAST(step AS INTEGER) AS step, round(inside, 6) AS inside FROM curve")
def dwell_curve(spark, d):
    return rounded(_dwell(spark, d))


@query(fx.SQL + DWELL + """ SELECT source, structure, round(mean_dwell, 6) AS mean_dwell, CAST(median_dwell AS INTEGER) AS median_dwell, round(exit1, 6) AS exit1, round(exit2, 6) AS exit2, round(retention3, 6) AS retention3,
    CASE WHEN round(mean_dwell, 6) < 2 OR round(retention3, 6) < 0.25 THEN 'transit' WHEN round(mean_dwell, 6) >= 3 AND round(retention3, 6) >= 0.5 THEN 'strategic_attractor' ELSE 'intermediate' END AS class
    FROM dw JOIN half USING (source, structure)""")
def dwell_classes(spark, d):
    rows = rounded(graph.dwell_stats(_dwell(spark, d)))
    rows = rows.withColumn("class", v.structure_class(F.col("mean_dwell"), F.col("retention_3")))
    return rows.withColumnsRenamed({"exit_first_ply": "exit1", "exit_within_two": "exit2", "retention_3": "retention3"})


@query(fx.SQL + """, push AS (SELECT source, structure, state, enter AS m, 0 AS step FROM enter JOIN nodes USING (state) WHERE enter > 0 UNION ALL SELECT p.source, p.structure, s.child, sum(p.m * s.share), p.step + 1 FROM push p
        JOIN shares s ON s.source = p.source AND s.parent = p.state AND s.c_structure = p.structure WHERE p.step < 40 GROUP BY p.source, p.structure, s.child, p.step),
    gone AS (SELECT p.source, p.structure, s.c_structure AS next_structure, s.action, p.m * s.share AS m, s.p_ply AS ply FROM push p JOIN shares s ON s.source = p.source AND s.parent = p.state
        WHERE s.c_structure IS NULL OR s.c_structure <> p.structure UNION ALL SELECT p.source, p.structure, NULL, NULL, p.m, n.min_ply FROM push p JOIN nodes n ON n.state = p.state
        WHERE NOT EXISTS (SELECT 1 FROM shares s WHERE s.source = p.source AND s.parent = p.state))
    SELECT source, structure, next_structure, action, round(sum(m), 6) AS mass, round(sum(m * ply) / sum(m), 6) AS exit_ply FROM gone GROUP BY ALL""")
def transition_edges(spark, d):
    edges, nodes = _graph(spark, d)
    return rounded(graph.structure_edges(edges, nodes, graph.cut(graph.flow(edges, nodes))))


STATS = """, st AS (SELECT source, structure, count(*) AS states, sum(reach) AS mass, max(reach) AS peak, CAST(sum(paths) AS BIGINT) AS paths, min(min_ply) AS first_ply,
    sum(reach * min_ply) / sum(reach) AS mean_ply FROM reach JOIN nodes USING (state) GROUP BY source, structure)"""


def _structure_stats(spark, d):
    edges, nodes = _graph(spark, d)
    rows = graph.flow(edges, nodes).join(nodes, "state")
    return rows.groupBy("source", "structure").agg(F.count(F.lit(1)).alias("states"), F.sum("reach").alias("mass"), F.max("reach").alias("peak"), F.sum("paths").alias("paths"), F.min("min_ply").alias("first_ply"), (F.sum(F.col("reach") * F.col("min_ply")) / F.sum("reach")).alias("mean_ply"))


@query(fx.SQL + STATS + " SELECT source, structure, states, round(least(1, mass), 6) AS coverage, round(peak, 6) AS peak, paths, first_ply, round(mean_ply, 6) AS mean_ply FROM st")
def structure_stats(spark, d):
    return rounded(_structure_stats(spark, d).select("source", "structure", "states", F.least(F.lit(1.0), "mass").alias("coverage"), "peak", "paths", "first_ply", "mean_ply"))


@query(fx.SQL + STATS + """ SELECT source, structure, round(CASE WHEN count(*) OVER w >= 3 THEN CASE WHEN stddev_pop(mass) OVER w < 1e-12 THEN 0 ELSE (mass - avg(mass) OVER w) / stddev_pop(mass) OVER w END END, 4) AS z
    FROM st WHERE source = 'all' WINDOW w AS (PARTITION BY first_ply)""")
def maturity_zscores(spark, d):
    rows = _structure_stats(spark, d).where("source = 'all'")
    return rounded(metrics.zscores(rows, "mass", "first_ply").select("source", "structure", "z"), 4)


@query(fx.SQL + """, walked AS (SELECT p.source, n.structure, p.m * s.share AS m, s.action, CASE WHEN s.p_ply < 2 THEN 'early' WHEN s.p_ply < 4 THEN 'middle' ELSE 'late' END AS stage
    FROM (SELECT source, state, reach AS m FROM reach) p JOIN shares s ON s.source = p.source AND s.parent = p.state JOIN nodes n ON n.state = p.state)
    SELECT source, structure, stage, action, round(sum(m), 6) AS mass FROM walked GROUP BY ALL""")
def forward_transformations(spark, d):
    """What is played from each structure, by ply window and weighted by flow."""
    edges, nodes = _graph(spark, d)
    rows = graph.forward_shares(edges, nodes).join(graph.flow(edges, nodes).select("source", F.col("state").alias("parent"), "reach"), ["source", "parent"])
    rows = rows.join(nodes.select(F.col("state").alias("parent"), "structure"), "parent")
    stage = F.when(F.col("p_ply") < 2, "early").when(F.col("p_ply") < 4, "middle").otherwise("late")
    return rounded(rows.groupBy("source", "structure", stage.alias("stage"), "action").agg(F.sum(F.col("reach") * F.col("share")).alias("mass")))


@query(fx.SQL + """, e AS (SELECT parent, action, child, sum(games) OVER (PARTITION BY parent ORDER BY action) / sum(games) OVER (PARTITION BY parent) AS hi, games / sum(games) OVER (PARTITION BY parent) AS share
        FROM edges WHERE source = 'all'),
    walk AS (SELECT i AS sample, 0 AS step, '' AS state, NULL::VARCHAR AS action, 0 AS done FROM range(500) t(i) UNION ALL
        SELECT w.sample, w.step + 1, e.child, e.action, 1 FROM walk w JOIN e ON e.parent = w.state
        AND ('0x' || substr(sha256('walk:' || w.sample || ':' || w.step), 1, 8))::BIGINT / 4294967296.0 >= e.hi - e.share
        AND ('0x' || substr(sha256('walk:' || w.sample || ':' || w.step), 1, 8))::BIGINT / 4294967296.0 < e.hi WHERE w.step < 4)
    SELECT CAST(step - 1 AS INTEGER) AS step, action, count(*) AS n FROM walk WHERE step > 0 GROUP BY ALL""")
def sampled_walks(spark, d):
    """Walks that follow edge shares by seeded hashes: the counts of each step's actions."""
    return graph.sampled_walks(graph.cut(fx.edges(spark, d)), "all", "", 500, 4, "walk").groupBy("step", "action").agg(F.count(F.lit(1)).alias("n"))
