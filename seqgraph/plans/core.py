"""Sequence core, graph basics and set operations."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import graph, sequences as seq
from ..sources import pgn
from . import fixture as fx
from .catalog import query, rounded

WDB = "count(*) FILTER (outcome = 0) AS w, count(*) FILTER (outcome = 1) AS d, count(*) FILTER (outcome = 2) AS b"
WDB_S = "count(*) FILTER (outcome = 0 AND strong) AS w_s, count(*) FILTER (outcome = 1 AND strong) AS d_s, count(*) FILTER (outcome = 2 AND strong) AS b_s"


@query(fx.SQL + """ SELECT state, action, count(*) AS games, count(*) FILTER (outcome = 0) AS w, count(*) FILTER (outcome = 1) AS d,
    count(*) FILTER (outcome = 2) AS b, round(count(*) / sum(count(*)) OVER (PARTITION BY state), 6) AS share,
    round((count(*) FILTER (outcome = 0) + count(*) FILTER (outcome = 1) / 2.0) / count(*), 6) AS ep
    FROM fv WHERE action IS NOT NULL GROUP BY state, action""")
def move_table(spark, d):
    return rounded(seq.move_table(fx.first_visits(spark, d)))


@query(fx.SQL + f" SELECT state, '' AS action, {WDB}, {WDB_S} FROM fv GROUP BY state UNION ALL SELECT state, action, {WDB}, {WDB_S} FROM fv WHERE action IS NOT NULL GROUP BY state, action")
def position_totals(spark, d):
    return seq.count_moves(fx.first_visits(spark, d))


@query(fx.SQL + f" SELECT state, coalesce(action, '') AS action, {WDB} FROM fv GROUP BY ALL")
def edges_complete(spark, d):
    return seq.count_complete(fx.first_visits(spark, d))


@query(fx.SQL_CYCLIC + f" SELECT state, coalesce(action, '') AS action, {WDB} FROM fv GROUP BY ALL")
def cyclic_first_visits(spark, d):
    """States that a game meets again count once, with the first action taken there."""
    return seq.count_complete(fx.first_visits(spark, d, 2))


@query(fx.SQL + " SELECT state, count(*) AS games, count(*) FILTER (action IS NULL) AS ended, round(count(*) FILTER (action IS NULL) / count(*), 6) AS ended_share FROM fv GROUP BY state HAVING count(*) FILTER (action IS NULL) > 0")
def terminal_rows(spark, d):
    rows = fx.first_visits(spark, d).groupBy("state").agg(F.count(F.lit(1)).alias("games"), F.sum(F.col("action").isNull().cast("long")).alias("ended")).where("ended > 0")
    return rounded(rows.withColumn("ended_share", F.col("ended") / F.col("games")))


@query("""SELECT CASE WHEN c_acctbal IS NULL OR c_acctbal < 0 THEN 'low_rating' WHEN o_orderpriority LIKE '5%' THEN 'variant'
    WHEN o_orderstatus NOT IN ('F', 'O') THEN 'unknown_result' END AS reason, count(*) AS games
    FROM orders LEFT JOIN customer ON c_custkey = o_custkey GROUP BY 1""")
def exclusions(spark, d):
    """Checks in order, the last failing one is the reason; they run before anything costly."""
    rows = fx.table(spark, d, "orders").join(fx.table(spark, d, "customer"), F.col("c_custkey") == F.col("o_custkey"), "left")
    checks = [("unknown_result", ~F.col("o_orderstatus").isin("F", "O")), ("variant", F.col("o_orderpriority").startswith("5")), ("low_rating", F.coalesce(F.col("c_acctbal") < 0, F.lit(True)))]
    return seq.exclusion_reasons(rows, checks).groupBy("reason").agg(F.count(F.lit(1)).alias("games"))


@query("""SELECT CASE WHEN a IS NOT NULL AND b IS NOT NULL THEN least(a, b) >= 200 ELSE false END AS strong, o_orderstatus, count(*) AS games FROM (SELECT o_orderstatus,
    TRY_CAST(CASE WHEN c_custkey % 7 <> 0 THEN split_part(c_name, '#', 2) ELSE '?' END AS INTEGER) AS a, CAST(floor(c_acctbal) AS INTEGER) AS b FROM orders JOIN customer ON c_custkey = o_custkey) GROUP BY ALL""")
def strong_flag(spark, d):
    """The lesser of two ratings; if either can't be read, the game isn't strong."""
    rows = fx.table(spark, d, "orders").join(fx.table(spark, d, "customer"), F.col("c_custkey") == F.col("o_custkey"))
    written = F.when(F.col("c_custkey") % 7 != 0, F.split_part(F.col("c_name"), F.lit("#"), F.lit(2))).otherwise("?")
    strong = pgn.both_at_least(written.try_cast("int"), F.floor("c_acctbal").cast("int"), 200)
    return rows.select(strong.alias("strong"), "o_orderstatus").groupBy("strong", "o_orderstatus").agg(F.count(F.lit(1)).alias("games"))


@query(fx.SQL + f" SELECT state, '' AS action, {WDB}, {WDB_S} FROM fv GROUP BY state HAVING count(*) >= 20 UNION ALL SELECT state, action, {WDB}, {WDB_S} FROM fv WHERE action IS NOT NULL AND state IN (SELECT state FROM fv GROUP BY state HAVING count(*) >= 20) GROUP BY state, action")
def frequent_states(spark, d):
    return seq.frequent_states(fx.first_visits(spark, d), 20)


CLOSED = """, strong_edges AS (SELECT DISTINCT parent, child FROM edges WHERE source = 'all' AND games >= 10),
    walk AS (SELECT '' AS state, 0 AS depth UNION SELECT child, depth + 1 FROM walk JOIN strong_edges ON parent = state WHERE depth < 8),
    closed AS (SELECT state, min(depth) AS depth FROM walk GROUP BY state)"""


@query(fx.SQL + CLOSED + " SELECT * FROM closed")
def retained_closure(spark, d):
    return graph.closure(fx.edges(spark, d).where("source = 'all'"), "", 10, 8)


@query(fx.SQL_CYCLIC + CLOSED + " SELECT * FROM closed")
def retained_closure_cyclic(spark, d):
    return graph.closure(fx.edges(spark, d, 2).where("source = 'all'"), "", 10, 8)


@query(fx.SQL + CLOSED + " SELECT parent, action, child, games, w, d, b FROM edges WHERE source = 'all' AND parent IN (SELECT state FROM closed) AND child IN (SELECT state FROM closed)")
def links(spark, d):
    rows = graph.cut(fx.edges(spark, d).where("source = 'all'").drop("source"))
    return graph.links(rows, graph.closure(rows, "", 10, 8))


@query(fx.SQL + " SELECT source, parent, action, child, games, w, d, b FROM edges")
def provenance(spark, d):
    return fx.edges(spark, d)


@query(fx.SQL + " SELECT source, child AS state, count(DISTINCT parent) FILTER (c_ply > p_ply) AS parents_in, count(DISTINCT parent) AS parents_all FROM shares WHERE c_ply IS NOT NULL GROUP BY ALL")
def parents(spark, d):
    first = fx.first_visits(spark, d)
    return graph.parents(seq.edges(first), seq.nodes(first))


@query(fx.SQL_CYCLIC + " SELECT source, child AS state, count(DISTINCT parent) FILTER (c_ply > p_ply) AS parents_in, count(DISTINCT parent) AS parents_all FROM shares WHERE c_ply IS NOT NULL GROUP BY ALL")
def parents_cyclic(spark, d):
    first = fx.first_visits(spark, d, 2)
    return graph.parents(seq.edges(first), seq.nodes(first))


@query(fx.SQL + " SELECT state, min_ply, role, structure, is_entry FROM nodes")
def nodes(spark, d):
    return seq.nodes(fx.first_visits(spark, d))


COVER = """, per AS (SELECT source, state, count(*) AS games, count(*) FILTER (action IS NULL) AS ended FROM fvs GROUP BY ALL)
    SELECT s.source, n.state, CASE WHEN p.games IS NULL THEN 'absent' WHEN p.games = p.ended THEN 'zero' WHEN p.games < 10 THEN 'partial' ELSE 'complete' END AS coverage_state,
    p.games, p.games - p.ended AS continued FROM nodes n CROSS JOIN (SELECT DISTINCT source FROM fvs) s LEFT JOIN per p ON p.source = s.source AND p.state = n.state"""


@query(fx.SQL + COVER)
def position_source_coverage(spark, d):
    """Every source at every state: what isn't known is null, never zero."""
    first = fx.first_visits(spark, d)
    per = seq.position_source(first)
    names = spark.sql("SELECT explode(array('all', 'expert', 'population')) AS source")
    rows = seq.nodes(first).select("state").crossJoin(F.broadcast(names)).join(per, ["source", "state"], "left")  # three source names
    state = F.when(F.col("games").isNull(), "absent").when(F.col("games") == F.col("ended"), "zero").when(F.col("games") < 10, "partial").otherwise("complete")
    return rows.select("source", "state", state.alias("coverage_state"), "games", (F.col("games") - F.col("ended")).alias("continued"))


@query(fx.SQL + """, a AS (SELECT parent AS state, action, games FROM edges WHERE source = 'all'), e AS (SELECT parent AS state, action, games FROM edges WHERE source = 'expert'),
    known AS (SELECT DISTINCT state FROM fvs WHERE source = 'expert')
    SELECT a.state, a.action, a.games AS all_games, CASE WHEN k.state IS NOT NULL THEN coalesce(e.games, 0) END AS expert_games,
    round(a.games / sum(a.games) OVER (PARTITION BY a.state), 6) >= 0.2 AS major
    FROM a LEFT JOIN e USING (state, action) LEFT JOIN known k ON k.state = a.state""")
def overlay(spark, d):
    """Moves of one source with another laid over: null where the other doesn't know the state, 0 where it knows but never plays it."""
    rows = fx.edges(spark, d)
    pick = lambda s, name: rows.where(F.col("source") == s).select(F.col("parent").alias("state"), "action", F.col("games").alias(name))
    known = seq.by_source(fx.first_visits(spark, d)).where("source = 'expert'").select("state").distinct().withColumn("known", F.lit(True))
    out = pick("all", "all_games").join(pick("expert", "e"), ["state", "action"], "left").join(known, "state", "left")
    from pyspark.sql import Window

    share = F.round(F.col("all_games") / F.sum("all_games").over(Window.partitionBy("state")), 6)
    return out.select("state", "action", "all_games", F.when(F.col("known"), F.coalesce("e", F.lit(0))).alias("expert_games"), (share >= 0.2).alias("major"))


@query(fx.SQL + """, a AS (SELECT parent AS state, action, games FROM edges WHERE source = 'all'), f AS (SELECT parent AS state, action, games FROM edges WHERE source = 'expert' AND games >= 3)
    SELECT coalesce(a.state, f.state) AS state, coalesce(a.action, f.action) AS action, a.games AS new_games, f.games AS old_games,
    CASE WHEN f.state IS NULL THEN 'new_only' WHEN a.state IS NULL THEN 'missing' WHEN a.games < f.games THEN 'violation' ELSE 'ok' END AS status
    FROM a FULL JOIN f USING (state, action)""")
def crosscheck(spark, d):
    """Two indexes reconciled: the larger may not count less than the smaller."""
    rows = fx.edges(spark, d)
    a = rows.where("source = 'all'").select(F.col("parent").alias("state"), "action", F.col("games").alias("new_games"))
    f = rows.where("source = 'expert' AND games >= 3").select(F.col("parent").alias("state"), "action", F.col("games").alias("old_games"))
    status = F.when(F.col("old_games").isNull(), "new_only").when(F.col("new_games").isNull(), "missing").when(F.col("new_games") < F.col("old_games"), "violation").otherwise("ok")
    return a.join(f, ["state", "action"], "full").select("state", "action", "new_games", "old_games", status.alias("status"))


@query(fx.SQL + """ SELECT n.state, n.min_ply FROM nodes n WHERE NOT EXISTS (SELECT 1 FROM fvs f WHERE f.source = 'expert' AND f.state = n.state)
    AND EXISTS (SELECT 1 FROM edges e WHERE e.source = 'population' AND e.parent = n.state)""")
def enrichment_queue(spark, d):
    """States the experts don't know and the population continues from: anti and semi joins."""
    first = fx.first_visits(spark, d)
    known = seq.by_source(first).where("source = 'expert'").select("state")
    asked = seq.edges(first).where("source = 'population'").select(F.col("parent").alias("state"))
    return seq.nodes(first).select("state", "min_ply").join(known, "state", "left_anti").join(asked, "state", "left_semi").orderBy("min_ply", "state")


@query(fx.SQL + """ SELECT state, min_ply AS depth FROM nodes WHERE state NOT IN (SELECT state FROM fvs WHERE source = 'expert') OR state NOT IN (SELECT state FROM fvs WHERE source = 'population')""")
def crawl_frontier(spark, d):
    """States that one of two sources has no snapshot of, in the order that a crawl takes them: two anti joins, each state once."""
    first = graph.cut(fx.first_visits(spark, d))
    states, known = seq.nodes(first).select("state", F.col("min_ply").alias("depth")), seq.by_source(first)
    missing = lambda s: states.join(known.where(F.col("source") == s).select("state").distinct(), "state", "left_anti")
    return missing("expert").union(missing("population")).distinct().orderBy("depth", "state")


@query("""SELECT c_custkey, c_name, count(o_orderkey) AS orders, round(sum(o_totalprice), 2) AS total FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY ALL""")
def left_join_counts(spark, d):
    rows = fx.table(spark, d, "customer").join(fx.table(spark, d, "orders"), F.col("o_custkey") == F.col("c_custkey"), "left")
    return rows.groupBy("c_custkey", "c_name").agg(F.count("o_orderkey").alias("orders"), F.round(F.sum("o_totalprice"), 2).alias("total"))


@query("""SELECT r_name, n_name, count(*) AS lines, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue FROM lineitem JOIN supplier ON s_suppkey = l_suppkey
    JOIN nation ON n_nationkey = s_nationkey JOIN region ON r_regionkey = n_regionkey WHERE l_shipdate >= TIMESTAMP '1995-01-01' GROUP BY ALL""")
def star_join(spark, d):
    rows = fx.table(spark, d, "lineitem").where(F.col("l_shipdate") >= F.lit("1995-01-01").cast("timestamp"))
    rows = rows.join(fx.table(spark, d, "supplier"), F.col("s_suppkey") == F.col("l_suppkey")).join(fx.table(spark, d, "nation"), F.col("n_nationkey") == F.col("s_nationkey")).join(fx.table(spark, d, "region"), F.col("r_regionkey") == F.col("n_regionkey"))
    return rows.groupBy("r_name", "n_name").agg(F.count(F.lit(1)).alias("lines"), F.round(F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))), 2).alias("revenue"))


@query(fx.SQL + """, a AS (SELECT DISTINCT state FROM fvs WHERE source = 'expert'), b AS (SELECT DISTINCT state FROM fvs WHERE source = 'population')
    SELECT 'both' AS part, count(*) AS n FROM (SELECT * FROM a INTERSECT SELECT * FROM b) UNION ALL SELECT 'expert_only', count(*) FROM (SELECT * FROM a EXCEPT SELECT * FROM b)
    UNION ALL SELECT 'population_only', count(*) FROM (SELECT * FROM b EXCEPT SELECT * FROM a) UNION ALL SELECT 'either', count(*) FROM (SELECT * FROM a UNION SELECT * FROM b)""")
def universes(spark, d):
    rows = seq.by_source(fx.first_visits(spark, d))
    a, b = (rows.where(F.col("source") == s).select("state").distinct() for s in ("expert", "population"))
    parts = (("both", a.intersect(b)), ("expert_only", a.exceptAll(b)), ("population_only", b.exceptAll(a)), ("either", a.union(b).distinct()))
    out = [x.agg(F.count(F.lit(1)).alias("n")).select(F.lit(name).alias("part"), "n") for name, x in parts]
    return out[0].union(out[1]).union(out[2]).union(out[3])


@query("""SELECT o_orderpriority, o_orderstatus, year(o_orderdate) AS year, count(*) AS n, count(*) FILTER (c_acctbal >= 0) AS r0, count(*) FILTER (c_acctbal >= 2500) AS r1,
    count(*) FILTER (c_acctbal >= 5000) AS r2, count(*) FILTER (c_acctbal >= 7500) AS r3, count(*) FILTER (c_acctbal >= 9000) AS r4, count(*) FILTER (c_acctbal >= 9500) AS r5, CAST(grouping(o_orderpriority, o_orderstatus, year) AS BIGINT) AS level
    FROM (SELECT *, year(o_orderdate) AS year FROM orders) JOIN customer ON c_custkey = o_custkey GROUP BY GROUPING SETS ((o_orderpriority), (o_orderstatus), (year), ())""".replace("year(o_orderdate) AS year, count(*) AS n", "year, count(*) AS n", 1))
def header_audit(spark, d):
    """Counts by priority, status and year with six rating bounds, in one scan."""
    rows = fx.table(spark, d, "orders").join(fx.table(spark, d, "customer"), F.col("c_custkey") == F.col("o_custkey")).withColumn("year", F.year("o_orderdate").cast("long"))
    keys = ["o_orderpriority", "o_orderstatus", "year"]
    found = rows.groupingSets([[k] for k in keys] + [[]], *keys)
    return found.agg(F.count(F.lit(1)).alias("n"), *[F.count_if(F.col("c_acctbal") >= b).alias(f"r{i}") for i, b in enumerate((0, 2500, 5000, 7500, 9000, 9500))], F.grouping_id(*keys).alias("level"))
