"""Named lines, mining, selection and the per-game trace."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import values as v
from ..operators import graph, lines, metrics, mining, selection, sequences as seq
from . import fixture as fx
from .catalog import query, rounded

LINES = """, firsts AS (SELECT game_id, min(action) FILTER (ply = 0) AS a, min(action) FILTER (ply = 1) AS b, min(action) FILTER (ply = 2) AS c FROM steps GROUP BY game_id),
    lines AS (SELECT a || ': ' || b || '-' || c AS name, upper(substr(a, 1, 1) || substr(b, 1, 1) || substr(c, 1, 1)) AS eco, array_to_string(list_sort([a, b, c]), '|') AS state,
        a, b, c, count(*) AS games FROM firsts WHERE c IS NOT NULL GROUP BY a, b, c HAVING count(*) >= 5)"""


def _steps(spark, d):
    return seq.number_steps(fx.events(spark, d), "game", ["ts", "event_id"], "event_type", fx.STRUCTURE)


def _lines(spark, d):
    at = lambda k: F.min(F.when(F.col("ply") == k, F.col("action")))
    rows = _steps(spark, d).where("ply < 3").groupBy("game_id").agg(at(0).alias("a"), at(1).alias("b"), at(2).alias("c")).where("c IS NOT NULL")
    rows = rows.groupBy("a", "b", "c").agg(F.count(F.lit(1)).alias("games")).where("games >= 5")
    name, eco = F.concat("a", F.lit(": "), "b", F.lit("-"), "c"), F.upper(F.concat(*[F.substring(x, 1, 1) for x in "abc"]))
    return rows.select(name.alias("name"), eco.alias("eco"), F.array_join(F.array_sort(F.array("a", "b", "c")), "|").alias("state"), "a", "b", "c", "games")


@query(fx.SQL + LINES + """ SELECT state, arg_min(name, (-games, name)) AS name, array_to_string(list_sort(list(DISTINCT eco)), ',') AS ecos,
    array_to_string(list_sort(list(DISTINCT name)), ',') AS aliases, count(*) AS lines, max(games) AS games FROM lines GROUP BY state""")
def condensed_lines(spark, d):
    return lines.condense(_lines(spark, d))


@query(fx.SQL + LINES + " SELECT trim(split_part(name, ':', 1)) AS base, count(*) AS members, CAST(sum(games) AS BIGINT) AS games, min(eco) AS eco, arg_min(name, (-games, name)) AS main, trim(split_part(name, ':', 1)) IN ('view', 'click') AS convention FROM lines GROUP BY 1")
def families(spark, d):
    return lines.families(_lines(spark, d), ["view", "click"])


@query(fx.SQL + LINES + """, e AS (SELECT name AS id, a || b || c AS k, translate(a || b || c, 'aeiou', 'AEIOU') AS x, c || b || a AS m, games FROM lines),
    best AS (SELECT k, arg_min(id, (-games, id)) AS twin FROM e GROUP BY k), f AS (SELECT e.id, twin FROM e JOIN best ON best.k = e.m WHERE id <> twin)
    SELECT f.id, f.twin FROM f JOIN f g ON g.id = f.twin AND g.twin = f.id""")
def mirror_twins(spark, d):
    """Lines whose action order is each other's reverse: mutual pairs only."""
    rows = _lines(spark, d).select(F.col("name").alias("id"), F.concat("a", "b", "c").alias("k"), F.concat("c", "b", "a").alias("m"), "games")
    return lines.twins(rows, "k", "m")


@query(fx.SQL + LINES + """, ls AS (SELECT name AS line, unnest([0, 1, 2]) AS ply, unnest(['', a, array_to_string(list_sort([a, b]), '|')]) AS state, unnest([a, b, c]) AS action FROM lines),
    top AS (SELECT state, action AS top FROM (SELECT *, row_number() OVER (PARTITION BY state ORDER BY games DESC, action) AS n FROM dist WHERE source = 'all') WHERE n = 1)
    SELECT line, count(*) FILTER (top = action) AS agree, CAST(min(ply) FILTER (top IS DISTINCT FROM action) AS INTEGER) AS first_divergence FROM ls LEFT JOIN top USING (state) GROUP BY line""")
def line_divergence(spark, d):
    step = lambda k, state, a: F.struct(F.lit(k).alias("ply"), state.alias("state"), F.col(a).alias("action"))
    rows = _lines(spark, d).select(F.col("name").alias("line"), F.explode(F.array(step(0, F.lit(""), "a"), step(1, F.col("a"), "b"), step(2, F.array_join(F.array_sort(F.array("a", "b")), "|"), "c"))).alias("s")).select("line", "s.*")
    return lines.line_divergence(rows, metrics.distributions(fx.edges(spark, d)).where("source = 'all'"))


@query(fx.SQL + LINES + """, c AS (SELECT state, arg_min(name, (-games, name)) AS name, array_to_string(list_sort(list(DISTINCT eco)), ',') AS ecos, array_to_string(list_sort(list(DISTINCT name)), ',') AS aliases, max(games) AS games FROM lines GROUP BY state)
    SELECT state, name, games FROM c WHERE (contains(lower(name), 'sign') OR contains(lower(ecos), 'sign') OR contains(lower(aliases), 'sign')) AND starts_with(ecos, 'C')""")
def line_search(spark, d):
    return lines.matching(lines.condense(_lines(spark, d)), "SIGN", "C").select("state", "name", "games")


@query("SELECT o_orderkey, translate(replace(o_orderpriority, ' ', '/'), 'KQRBNPkqrbnp', 'kqrbnpKQRBNP') AS swapped, array_to_string(list_reverse(string_split(translate(replace(o_orderpriority, ' ', '/'), 'KQRBNPkqrbnp', 'kqrbnpKQRBNP'), '/')), '/') AS mirror FROM orders")
def mirror_keys(spark, d):
    key = F.replace(F.col("o_orderpriority"), F.lit(" "), F.lit("/"))
    return fx.table(spark, d, "orders").select("o_orderkey", F.translate(key, "KQRBNPkqrbnp", "kqrbnpKQRBNP").alias("swapped"), v.mirror_key(key).alias("mirror"))


# --- mining ----------------------------------------------------------------------------------------------------------

#: As the reference's permutation test: the least p is 1 / 201.
SHUFFLES = 200
BOARDS = """, boards AS (SELECT o_orderkey, o_orderpriority AS g, o_orderstatus AS y, CASE WHEN c_acctbal >= 5000 THEN 'rich' WHEN c_acctbal >= 0 THEN 'mid' ELSE 'poor' END AS f, 1.0::DOUBLE AS w
    FROM orders JOIN customer ON c_custkey = o_custkey)"""
MI = """, base AS (SELECT g, -sum(p * log2(p)) AS base FROM (SELECT g, y, sum(w) / sum(sum(w)) OVER (PARTITION BY g) AS p FROM boards GROUP BY g, y) GROUP BY g),
    given AS (SELECT g, f, -sum(p * log2(p)) AS h, sum(w) AS w FROM (SELECT g, f, y, sum(w) AS w, sum(w) / sum(sum(w)) OVER (PARTITION BY g, f) AS p FROM boards GROUP BY g, f, y) GROUP BY g, f),
    cond AS (SELECT g, sum(w * h) / sum(w) AS conditional, count(*) AS "values" FROM given GROUP BY g)"""


def _boards(spark, d):
    rows = fx.table(spark, d, "orders").join(fx.table(spark, d, "customer"), F.col("c_custkey") == F.col("o_custkey"))
    f = F.when(F.col("c_acctbal") >= 5000, "rich").when(F.col("c_acctbal") >= 0, "mid").otherwise("poor")
    return rows.select("o_orderkey", F.col("o_orderpriority").alias("g"), F.col("o_orderstatus").alias("y"), f.alias("f"), F.lit(1.0).alias("w"))


@query("WITH x AS (SELECT 1)" + BOARDS + MI + ' SELECT g, round(base, 6) AS base, round(conditional, 6) AS conditional, round(base - conditional, 6) AS mi, "values" FROM base JOIN cond USING (g)')
def mutual_information(spark, d):
    return rounded(mining.mutual_information(_boards(spark, d), "g", "y", "f", "w"))


PERMUTED = """, pm AS MATERIALIZED (SELECT b.*, i AS perm, row_number() OVER (PARTITION BY g, i ORDER BY CAST(o_orderkey AS VARCHAR)) AS at_,
        row_number() OVER (PARTITION BY g, i ORDER BY sha256(i || ':' || o_orderkey), CAST(o_orderkey AS VARCHAR)) AS drawn FROM boards b, range(1, 201) t(i)),
    sh AS (SELECT a.g, a.perm, a.f, b.y, a.w FROM pm a JOIN pm b ON a.g = b.g AND a.perm = b.perm AND a.at_ = b.drawn),
    every AS MATERIALIZED (SELECT g, perm, f, y, sum(w) AS w FROM (SELECT g, 0 AS perm, f, y, w FROM boards UNION ALL SELECT g, perm, f, y, w FROM sh) GROUP BY g, perm, f, y),
    pbase AS (SELECT g, perm, -sum(p * log2(p)) AS base FROM (SELECT g, perm, y, sum(w) / sum(sum(w)) OVER (PARTITION BY g, perm) AS p FROM every GROUP BY g, perm, y) GROUP BY g, perm),
    pgiven AS (SELECT g, perm, f, -sum(p * log2(p)) AS h, sum(w) AS w FROM (SELECT g, perm, f, y, sum(w) AS w, sum(w) / sum(sum(w)) OVER (PARTITION BY g, perm, f) AS p FROM every GROUP BY g, perm, f, y) GROUP BY g, perm, f),
    pmi AS (SELECT g, perm, base - sum(w * h) / sum(w) AS mi FROM pgiven JOIN pbase USING (g, perm) GROUP BY g, perm, base),
    tested AS (SELECT o.g, o.mi, (count(*) FILTER (n.mi >= o.mi - 1e-9) + 1) / (count(*) + 1) AS p_value FROM pmi o JOIN pmi n ON n.g = o.g AND n.perm > 0 WHERE o.perm = 0 GROUP BY o.g, o.mi)"""


@query("WITH x AS (SELECT 1)" + BOARDS + PERMUTED + """ SELECT g, round(mi, 6) AS mi, round(p_value, 6) AS p_value FROM tested""")
def permutation_test(spark, d):
    """On all boards, 200 shuffles; a label shuffle is dealt by hashes, so both engines draw the same."""
    return rounded(mining.permutation_test(_boards(spark, d), "g", "y", "f", "w", "o_orderkey", SHUFFLES))


TRAJ = """, ev2 AS (SELECT DISTINCT game_id AS traj, action AS event FROM steps), wt AS (SELECT game_id AS traj, CASE WHEN strong THEN 2.0::DOUBLE ELSE 1.0::DOUBLE END AS weight FROM games),
    tot AS (SELECT sum(weight) AS t FROM wt), t1 AS (SELECT traj, event, weight FROM ev2 JOIN wt USING (traj))"""


def _traj(spark, d):
    events = _steps(spark, d).select(F.col("game_id").alias("traj"), F.col("action").alias("event"), F.col("ply").alias("pos"))
    weights = fx.games(spark, d).select(F.col("game_id").alias("traj"), F.when(F.col("strong"), 2.0).otherwise(1.0).alias("weight"))
    return events, weights


@query(fx.SQL + TRAJ + """ SELECT items, size, round(sum(weight) / any_value(t), 6) AS support FROM (
      SELECT event AS items, 1 AS size, weight, t FROM t1, tot
      UNION ALL SELECT a.event || '+' || b.event, 2, a.weight, t FROM t1 a JOIN t1 b ON a.traj = b.traj AND a.event < b.event, tot
      UNION ALL SELECT a.event || '+' || b.event || '+' || c.event, 3, a.weight, t FROM t1 a JOIN t1 b ON a.traj = b.traj AND a.event < b.event JOIN t1 c ON c.traj = a.traj AND b.event < c.event, tot
      UNION ALL SELECT a.event || '+' || b.event || '+' || c.event || '+' || e.event, 4, a.weight, t FROM t1 a JOIN t1 b ON a.traj = b.traj AND a.event < b.event JOIN t1 c ON c.traj = a.traj AND b.event < c.event JOIN t1 e ON e.traj = a.traj AND c.event < e.event, tot
    ) GROUP BY items, size HAVING sum(weight) / any_value(t) >= 0.5""")
def frequent_sets(spark, d):
    events, weights = _traj(spark, d)
    return rounded(mining.frequent_sets(events, weights, 0.5, 4))


@query(fx.SQL + TRAJ + """, gw AS (SELECT game_id AS traj, CAST(outcome AS VARCHAR) AS grp, weight FROM games JOIN wt ON wt.traj = game_id), gt AS (SELECT grp, sum(weight) AS total FROM gw GROUP BY grp),
    e2 AS (SELECT ev2.traj, event, grp, weight FROM ev2 JOIN gw USING (traj)),
    s AS (SELECT grp, items, size, sum(weight) / any_value(total) AS support FROM (SELECT grp, event AS items, 1 AS size, weight FROM e2 UNION ALL SELECT a.grp, a.event || '+' || b.event, 2, a.weight FROM e2 a JOIN e2 b ON a.traj = b.traj AND a.event < b.event
        UNION ALL SELECT a.grp, a.event || '+' || b.event || '+' || c.event, 3, a.weight FROM e2 a JOIN e2 b ON a.traj = b.traj AND a.event < b.event JOIN e2 c ON c.traj = a.traj AND b.event < c.event) JOIN gt USING (grp) GROUP BY grp, items, size HAVING sum(weight) / any_value(total) >= 0.4)
    SELECT items, size, grp, round(support, 6) AS support FROM (SELECT *, row_number() OVER (PARTITION BY items ORDER BY round(support, 9) DESC, grp) AS n FROM s) WHERE n = 1""")
def mined_plans(spark, d):
    """Sets of events by group of games, each under the group where it is most frequent."""
    events, weights = _traj(spark, d)
    weights = weights.join(fx.games(spark, d).select(F.col("game_id").alias("traj"), F.col("outcome").cast("string").alias("grp")), "traj")
    return rounded(mining.best_group(mining.grouped_sets(events, weights, 0.4, 3)))


@query(fx.SQL + TRAJ + """, o AS (SELECT game_id AS traj, min(ply) FILTER (action = 'view') AS pa, min(ply) FILTER (action = 'click') AS pb FROM steps GROUP BY game_id)
    SELECT count(*) AS trajectories, round(sum(CASE WHEN pb < pa THEN weight ELSE 0 END) / sum(weight), 6) AS flipped,
    CASE WHEN sum(CASE WHEN pb < pa THEN weight ELSE 0 END) / sum(weight) <= 0.5 THEN 'view>click' ELSE 'click>view' END AS usual FROM o JOIN wt USING (traj) WHERE pa IS NOT NULL AND pb IS NOT NULL""")
def order_flexibility(spark, d):
    events, weights = _traj(spark, d)
    return rounded(mining.order_flexibility(events, weights, "view", "click"))


@query(fx.SQL + TRAJ + """, grp AS (SELECT game_id AS traj, CAST(outcome AS VARCHAR) AS grp FROM games), n AS (SELECT count(*) AS n FROM grp), sz AS (SELECT grp, count(*) AS size FROM grp GROUP BY grp),
    al AS (SELECT event, count(*) AS c FROM ev2 GROUP BY event), ow AS (SELECT grp, event, count(*) AS c FROM ev2 JOIN grp USING (traj) GROUP BY ALL)
    SELECT grp, event, round(ow.c / size, 6) AS support, round(al.c / n, 6) AS pooled, round((ow.c / size) / (al.c / n), 6) AS lift FROM ow JOIN sz USING (grp) JOIN al USING (event), n""")
def lift(spark, d):
    events, _ = _traj(spark, d)
    groups = fx.games(spark, d).select(F.col("game_id").alias("traj"), F.col("outcome").cast("string").alias("grp"))
    return rounded(mining.lift(events, groups))


@query(fx.SQL + TRAJ + """, grp AS (SELECT game_id AS traj, strong FROM games), f AS (SELECT event, count(*) FILTER (strong) / (SELECT count(*) FROM grp WHERE strong) AS p, count(*) FILTER (NOT strong) / (SELECT count(*) FROM grp WHERE NOT strong) AS q FROM ev2 JOIN grp USING (traj) GROUP BY event)
    SELECT event, round(p, 6) AS p, round(q, 6) AS q, round(p * log2((p + 1e-6) / (q + 1e-6)), 6) AS score FROM f""")
def distinctive_features(spark, d):
    events, _ = _traj(spark, d)
    games = fx.games(spark, d).select(F.col("game_id").alias("traj"), "strong")
    size = games.agg(F.count_if("strong").alias("s"), F.count_if(~F.col("strong")).alias("r"))
    rows = events.select("traj", "event").distinct().join(games, "traj").groupBy("event").agg(F.count_if("strong").alias("a"), F.count_if(~F.col("strong")).alias("b"))
    rows = rows.crossJoin(F.broadcast(size)).select("event", (F.col("a") / F.col("s")).alias("p"), (F.col("b") / F.col("r")).alias("q"))  # size is one row
    return rounded(rows.withColumn("score", v.information_score(F.col("p"), F.col("q"))))


@query(fx.SQL + """, ans AS (SELECT *, count(*) OVER (PARTITION BY state) AS n FROM (SELECT state, action, p, row_number() OVER (PARTITION BY state ORDER BY p DESC, action) AS r FROM dist WHERE source = 'expert') WHERE r = 1 OR (r <= 2 AND p >= 0.3)),
    bd AS (SELECT n.state, n.structure AS condition, r.reach AS weight FROM nodes n JOIN reach r ON r.state = n.state AND r.source = 'all'),
    tot AS (SELECT condition, sum(weight) AS total, count(*) AS boards FROM bd GROUP BY condition),
    found AS (SELECT condition, action, sum(weight) AS w, sum(CASE WHEN n = 1 THEN weight ELSE 0 END) AS strict, count(DISTINCT state) AS held FROM ans JOIN bd USING (state) GROUP BY ALL),
    best AS (SELECT *, row_number() OVER (PARTITION BY condition ORDER BY round(w, 9) DESC, action) AS b FROM found)
    SELECT condition, action, round(w / total, 6) AS support, round(strict / total, 6) AS strict_support, boards - held AS exceptions FROM best JOIN tot USING (condition) WHERE b = 1 AND w / total >= 0.25""")
def rules(spark, d):
    first = graph.cut(fx.first_visits(spark, d))
    edges, nodes = graph.cut(seq.edges(first)), graph.cut(seq.nodes(first))
    reach = graph.flow(edges, nodes).where("source = 'all'").select("state", F.col("reach").alias("weight"))
    boards = nodes.select("state", F.col("structure").alias("condition")).join(reach, "state")
    return rounded(mining.derive_rules(metrics.distributions(edges).where("source = 'expert'").select("state", "action", "p"), boards, 0.3, 2, 0.25))


@query("""SELECT o_orderpriority, q25, median, q75, q90 FROM (SELECT o_orderpriority, list_sort(list(o_totalprice)) AS v, count(*) AS n FROM orders GROUP BY 1),
    LATERAL (SELECT v[n // 4 + 1] AS q25, (v[(n - 1) // 2 + 1] + v[n // 2 + 1]) / 2 AS median, v[3 * n // 4 + 1] AS q75, v[least(n - 1, n * 9 // 10) + 1] AS q90)""")
def gain_quantiles(spark, d):
    return metrics.index_quantiles(fx.table(spark, d, "orders"), "o_orderpriority", "o_totalprice")


@query("""SELECT o_custkey, round(sum(o_totalprice) FILTER (n = 1) / sum(o_totalprice), 6) AS top1, round(sum(o_totalprice) FILTER (n <= 3) / sum(o_totalprice), 6) AS top3
    FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC) AS n FROM orders WHERE o_totalprice > 0) GROUP BY 1""")
def concentration(spark, d):
    return rounded(metrics.concentration(fx.table(spark, d, "orders"), "o_custkey", "o_totalprice"))


# --- selection -------------------------------------------------------------------------------------------------------

ITEMS = """, best AS (SELECT state, max(ep) AS best_ep FROM evals GROUP BY state), losses AS (SELECT state, action, best_ep - ep AS loss FROM evals JOIN best USING (state)),
    base AS (SELECT d.state, r.reach, sum(d.p * l.loss) / sum(d.p) AS base_loss FROM dist d JOIN losses l USING (state, action) JOIN reach r ON r.source = 'population' AND r.state = d.state WHERE d.source = 'population' GROUP BY d.state, r.reach),
    top AS (SELECT state, action, row_number() OVER (PARTITION BY state ORDER BY p DESC, action) AS n FROM dist WHERE source = 'expert'),
    items AS (SELECT 'S:' || n.structure AS item, n.state, t.action FROM nodes n JOIN top t ON t.state = n.state AND t.n = 1 UNION ALL SELECT 'D:' || t.state, t.state, t.action FROM top t WHERE t.n <= 2),
    cells AS (SELECT i.item, i.state, avg(l.loss) AS loss FROM items i LEFT JOIN losses l USING (state, action) GROUP BY ALL)"""


def _items(spark, d):
    """items' losses (item, state, loss), the population's baseline, the experts' top actions."""
    first = graph.cut(fx.first_visits(spark, d))
    edges, nodes = graph.cut(seq.edges(first)), graph.cut(seq.nodes(first))
    dist, evals = metrics.distributions(edges), fx.evals(edges)
    best = evals.groupBy("state").agg(F.max("ep").alias("best_ep"))
    losses = evals.join(best, "state").select("state", "action", (F.col("best_ep") - F.col("ep")).alias("loss"))
    reach = graph.flow(edges, nodes).where("source = 'population'").select("state", "reach")
    base = dist.where("source = 'population'").join(losses, ["state", "action"]).groupBy("state").agg((F.sum(F.col("p") * F.col("loss")) / F.sum("p")).alias("base_loss")).join(reach, "state")
    top = metrics.top_per_group(dist.where("source = 'expert'"), "state", 2, F.desc("p"), "action").select("state", "action", "rank")
    # answers differ by state, so each state of an item is one scope row with its own answers
    structure = nodes.join(top.where("rank = 1"), "state").select(F.concat(F.lit("S:"), "structure").alias("item"), F.array("state").alias("states"), F.array("action").alias("answers"))
    single = top.groupBy("state").agg(F.collect_list("action").alias("answers")).select(F.concat(F.lit("D:"), "state").alias("item"), F.array("state").alias("states"), "answers")
    return graph.cut(selection.item_losses(structure.unionByName(single), losses)), graph.cut(base), top, dist, reach


@query(fx.SQL + ITEMS + """ SELECT item, round(sum(CASE WHEN loss IS NOT NULL AND base_loss IS NOT NULL THEN reach * greatest(0, base_loss - loss) WHEN loss IS NOT NULL AND reach IS NOT NULL THEN 0 END), 6) AS value,
    count(*) AS states, count(loss) AS valued FROM cells LEFT JOIN base USING (state) GROUP BY item""")
def item_values(spark, d):
    cells, base, *_ = _items(spark, d)
    return rounded(selection.item_values(cells, base))


@query(fx.SQL + ITEMS + """, mem AS (SELECT DISTINCT item, CASE WHEN item LIKE 'S:%' THEN 'structures' ELSE 'decisions' END AS curriculum FROM cells UNION ALL SELECT DISTINCT item, 'everything' FROM cells),
    b AS (SELECT curriculum, state, min(loss) AS loss FROM mem JOIN cells USING (item) GROUP BY ALL)
    SELECT curriculum, round(sum(reach * greatest(0, base_loss - coalesce(loss, base_loss))) / (SELECT sum(reach * base_loss) FROM base), 6) AS recovery FROM b JOIN base USING (state) GROUP BY curriculum""")
def curricula_compare(spark, d):
    """The best covering item counts at each state, never the sum."""
    cells, base, *_ = _items(spark, d)
    kind = F.when(F.col("item").startswith("S:"), "structures").otherwise("decisions")
    members = cells.select("item", F.explode(F.array(kind, F.lit("everything"))).alias("curriculum")).distinct()
    return rounded(selection.compare_sets(cells, base, members))


@query()
def greedy_frontier(spark, d):
    """Each step depends on the last one's choice: no SQL; tests compare with brute force."""
    cells, base, *_ = _items(spark, d)
    gains = cells.join(base, "state").select("item", "state", (F.col("reach") * (F.col("base_loss") - F.col("loss"))).alias("gain"))
    costs = cells.groupBy("item").agg(F.count(F.lit(1)).cast("double").alias("cost"))
    return spark.createDataFrame(selection.greedy(gains, costs, 15), "step int, item string, marginal double, cumulative double, cost double")


@query(fx.SQL + ITEMS + """, taught AS (SELECT state, action FROM top WHERE n <= 2)
    SELECT round(sum(CASE WHEN t.action IS NOT NULL THEN reach * p ELSE 0 END), 6) AS taught, round(sum(CASE WHEN t.action IS NULL THEN reach * p ELSE 0 END), 6) AS deviating
    FROM dist d JOIN reach r ON r.source = 'population' AND r.state = d.state LEFT JOIN taught t ON t.state = d.state AND t.action = d.action WHERE d.source = 'population' AND d.state IN (SELECT state FROM taught)""")
def behavioural_reach(spark, d):
    _, _, top, dist, reach = _items(spark, d)
    return rounded(selection.behavioural_reach(dist.where("source = 'population'"), top, reach))


PLANS = "WITH uses AS (SELECT DISTINCT o_custkey AS plan, p_brand || ':' || p_size % 5 AS component FROM lineitem JOIN orders ON o_orderkey = l_orderkey JOIN part ON p_partkey = l_partkey)"


def _uses(spark, d):
    rows = fx.table(spark, d, "lineitem").join(fx.table(spark, d, "orders"), F.col("o_orderkey") == F.col("l_orderkey")).join(fx.table(spark, d, "part"), F.col("p_partkey") == F.col("l_partkey"))
    return rows.select(F.col("o_custkey").alias("plan"), F.concat_ws(":", "p_brand", (F.col("p_size") % 5).cast("string")).alias("component")).distinct()


@query(PLANS + """, pay AS (SELECT component, min(plan) AS payer, count(DISTINCT plan) AS plans FROM uses GROUP BY component)
    SELECT plan, CAST(count(*) AS DOUBLE) AS additive, CAST(count(*) FILTER (payer = plan) AS DOUBLE) AS shared, count(*) FILTER (plans > 1) AS reused FROM uses JOIN pay USING (component) GROUP BY plan""")
def shared_burden(spark, d):
    return selection.shared_burden(_uses(spark, d).withColumn("cost", F.lit(1.0)))


@query(PLANS + """, level AS (SELECT component, split_part(component, ':', 1) AS brand, 'any' AS anything, plan FROM uses)
    SELECT 'exact' AS level, component, count(DISTINCT plan) AS plans FROM level GROUP BY ALL UNION ALL SELECT 'brand', brand, count(DISTINCT plan) FROM level GROUP BY ALL UNION ALL SELECT 'any', anything, count(DISTINCT plan) FROM level GROUP BY ALL""")
def vocabulary(spark, d):
    """Components at three levels of abstraction."""
    rows = _uses(spark, d)
    pair = lambda level, c: F.struct(F.lit(level).alias("level"), c.alias("component"))
    names = F.array(pair("exact", F.col("component")), pair("brand", F.split_part("component", F.lit(":"), F.lit(1))), pair("any", F.lit("any")))
    return rows.select("plan", F.explode(names).alias("n")).select("plan", "n.*").groupBy("level", "component").agg(F.countDistinct("plan").alias("plans"))


@query(PLANS + """, b AS (SELECT 'b1' AS bundle, 'Brand#11:1' AS component UNION ALL SELECT 'b1', 'Brand#12:2' UNION ALL SELECT 'b2', 'Brand#21:0' UNION ALL SELECT 'b3', 'Brand#11:1'),
    sz AS (SELECT bundle, count(*) AS size FROM b GROUP BY bundle), held AS (SELECT bundle, plan FROM b JOIN uses USING (component) JOIN sz USING (bundle) GROUP BY bundle, plan, size HAVING count(*) = size),
    ps AS (SELECT bundle, count(*) AS plans FROM held GROUP BY bundle), f AS (SELECT bundle, component, count(*) AS n, any_value(plans) AS plans FROM held JOIN uses USING (plan) JOIN ps USING (bundle) GROUP BY bundle, component)
    SELECT bundle, max(plans) AS plans, count(*) FILTER (n = plans) AS required, count(*) FILTER (n < plans AND n * 2 >= plans) AS optional FROM f GROUP BY bundle""")
def schemas(spark, d):
    bundles = spark.sql("SELECT * FROM VALUES ('b1', array('Brand#11:1', 'Brand#12:2')), ('b2', array('Brand#21:0')), ('b3', array('Brand#11:1')) AS t(bundle, components)")
    return selection.schemas(_uses(spark, d), bundles)


@query(PLANS + """, sets AS (SELECT plan, list(DISTINCT component) AS m, count(DISTINCT component) AS n FROM uses GROUP BY plan)
    SELECT a.plan AS small, b.plan AS large FROM sets a JOIN sets b ON a.n < b.n AND list_has_all(b.m, a.m)""")
def containment(spark, d):
    """Strict subsets among all plans' whole component sets."""
    return selection.containment(_uses(spark, d).groupBy(F.col("plan").alias("id")).agg(F.collect_list("component").alias("members")))


@query("""SELECT o_orderkey, CASE WHEN bal < 0 THEN 1 WHEN o_orderstatus = 'P' THEN 2 WHEN o_totalprice > 300000 THEN 3 ELSE 4 END AS tier FROM (SELECT orders.*, c_acctbal AS bal FROM orders JOIN customer ON c_custkey = o_custkey)""")
def priority_tiers(spark, d):
    """Disjoint tiers: each order under the first category that holds it."""
    rows = fx.table(spark, d, "orders").join(fx.table(spark, d, "customer"), F.col("c_custkey") == F.col("o_custkey"))
    ranks = F.array_compact(F.array(F.when(F.col("c_acctbal") < 0, 1), F.when(F.col("o_orderstatus") == "P", 2), F.when(F.col("o_totalprice") > 300000, 3), F.lit(4)))
    return selection.first_category(rows.select("o_orderkey", F.explode(ranks).alias("rank")), "o_orderkey", "rank")


@query("""SELECT o_custkey, o_orderkey, round(c, 2) AS cumulative, round(c / t, 6) AS share, round(c / t, 9) >= 0.9 AND round((c - o_totalprice) / t, 9) < 0.9 AS reaches90
    FROM (SELECT *, sum(o_totalprice) OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey ROWS UNBOUNDED PRECEDING) AS c, sum(o_totalprice) OVER (PARTITION BY o_custkey) AS t FROM orders)""")
def queue_cumulative(spark, d):
    rows = fx.table(spark, d, "orders").select(F.col("o_custkey").alias("part"), "o_orderkey", "o_totalprice")
    rows = selection.running(rows, "o_totalprice", F.desc("o_totalprice"), "o_orderkey")
    return rows.select(F.col("part").alias("o_custkey"), "o_orderkey", F.round("cumulative", 2).alias("cumulative"), F.round("share", 6).alias("share"), ((F.round("share", 9) >= 0.9) & (F.round(F.col("share") * (1 - F.col("o_totalprice") / F.col("cumulative")), 9) < 0.9)).alias("reaches90"))


@query("SELECT o_orderkey, CAST(least(9, (row_number() OVER (PARTITION BY o_orderstatus ORDER BY o_totalprice, o_orderkey) - 1) * 10 // count(*) OVER (PARTITION BY o_orderstatus)) AS INTEGER) AS stratum FROM orders")
def strata(spark, d):
    return selection.strata(fx.table(spark, d, "orders"), "o_orderstatus", "o_totalprice", "o_orderkey").select("o_orderkey", "stratum")


@query("""SELECT c_custkey, array_to_string(list_filter([CASE WHEN c_acctbal < 0 THEN 'debt' END, CASE WHEN n >= 15 THEN 'busy' END, CASE WHEN total > 2000000 THEN 'large' END], lambda x: x IS NOT NULL), ',') AS reasons,
    CAST((CASE WHEN c_acctbal < 0 THEN 1 ELSE 0 END) + (CASE WHEN n >= 15 THEN 1 ELSE 0 END) + (CASE WHEN total > 2000000 THEN 1 ELSE 0 END) AS INTEGER) AS n_reasons,
    least(1.0::DOUBLE, (CASE WHEN c_acctbal < 0 THEN 0.5::DOUBLE ELSE 0 END) + (CASE WHEN n >= 15 THEN 0.25::DOUBLE ELSE 0 END) + (CASE WHEN total > 2000000 THEN 0.5::DOUBLE ELSE 0 END)) AS score
    FROM customer LEFT JOIN (SELECT o_custkey, count(*) AS n, sum(o_totalprice) AS total FROM orders GROUP BY 1) ON o_custkey = c_custkey""")
def candidate_scores(spark, d):
    own = fx.table(spark, d, "orders").groupBy("o_custkey").agg(F.count(F.lit(1)).alias("n"), F.sum("o_totalprice").alias("total"))
    rows = fx.table(spark, d, "customer").join(own, F.col("o_custkey") == F.col("c_custkey"), "left")
    reasons = [("debt", F.col("c_acctbal") < 0, 0.5), ("busy", F.col("n") >= 15, 0.25), ("large", F.col("total") > 2000000, 0.5)]
    return selection.candidate_scores(rows, reasons, 1.0).select("c_custkey", "reasons", "n_reasons", "score")


@query("""WITH s AS (SELECT o_orderkey, o_totalprice, row_number() OVER (ORDER BY o_totalprice DESC, o_orderkey) AS n, count(*) OVER () AS total FROM orders)
    SELECT o_orderkey, CASE WHEN n <= 25 THEN 'C' WHEN n <= total * 12 // 100 THEN 'B' ELSE 'A' END AS tier FROM s""")
def evaluation_tiers(spark, d):
    """The top 25 by value and the first 12 %, by the values at those ranks: no global sort of all rows in one task."""
    rows = fx.table(spark, d, "orders").select("o_orderkey", "o_totalprice")
    n = rows.count()
    order = [F.desc("o_totalprice"), F.asc("o_orderkey")]
    top = rows.orderBy(*order).limit(25).withColumn("_c", F.lit(True)).select("o_orderkey", "_c")
    second = rows.orderBy(*order).limit(max(1, n * 12 // 100)).withColumn("_b", F.lit(True)).select("o_orderkey", "_b")
    tier = F.when(F.col("_c"), "C").when(F.col("_b") & F.lit(n * 12 // 100 > 0), "B").otherwise("A")
    return rows.join(top, "o_orderkey", "left").join(second, "o_orderkey", "left").select("o_orderkey", tier.alias("tier"))


# --- trace and ledgers -----------------------------------------------------------------------------------------------

@query(fx.SQL + """, g AS (SELECT *, row_number() OVER (ORDER BY day_ord, game_id) - 1 AS i, count(*) OVER () AS n FROM games), c AS (SELECT max(day_ord) FILTER (i = least(n - 1, CAST(floor(n * 0.8) AS BIGINT))) AS cut FROM g)
    SELECT game_id, CASE WHEN day_ord >= cut THEN 'test' ELSE 'train' END AS split FROM g, c""")
def chrono_split(spark, d):
    """The day at the cutoff row and all later ones are the test: found from day counts, not from a sort of all games."""
    games = fx.games(spark, d)
    days = games.groupBy("day_ord").count()
    upto = days.withColumn("upto", F.sum("count").over(Window.orderBy("day_ord")))  # one row a day
    total = days.agg(F.sum("count").alias("n"))
    place = F.least(F.col("n") - 1, F.floor(F.col("n") * F.lit(0.8)))
    cut = upto.crossJoin(F.broadcast(total)).where(F.col("upto") > place).agg(F.min("day_ord").alias("cut"))
    return games.crossJoin(F.broadcast(cut)).select("game_id", F.when(F.col("day_ord") >= F.col("cut"), "test").otherwise("train").alias("split"))  # one row


@query(fx.SQL + " SELECT game_id, CASE WHEN ('0x' || substr(sha256('split:' || game_id), 1, 8))::BIGINT / 4294967296.0 < 0.2 THEN 'test' ELSE 'train' END AS split FROM games")
def hash_split(spark, d):
    return fx.games(spark, d).select("game_id", F.when(v.hash_fraction("split", F.col("game_id")) < 0.2, "test").otherwise("train").alias("split"))


WALK = """, top AS (SELECT state, action FROM (SELECT state, action, row_number() OVER (PARTITION BY state ORDER BY p DESC, action) AS n FROM dist WHERE source = 'expert') WHERE n <= 1),
    per AS (SELECT game_id, count(*) AS steps, count(t.state) AS covered, count(*) FILTER (t.action = f.action) AS played FROM fv f LEFT JOIN top t ON t.state = f.state WHERE f.action IS NOT NULL GROUP BY game_id)"""


@query(fx.SQL + WALK + """ SELECT CASE WHEN ('0x' || substr(sha256('split:' || game_id), 1, 8))::BIGINT / 4294967296.0 < 0.2 THEN 'test' ELSE 'train' END AS split, count(*) AS games,
    CAST(sum(steps) AS BIGINT) AS steps, CAST(sum(covered) AS BIGINT) AS covered, CAST(sum(played) AS BIGINT) AS played, round(sum(played) / sum(covered), 6) AS adherence FROM per GROUP BY 1""")
def walk_summary(spark, d):
    first = graph.cut(fx.first_visits(spark, d).where("action IS NOT NULL"))
    dist = metrics.distributions(seq.edges(first))
    top = metrics.top_per_group(dist.where("source = 'expert'"), "state", 1, F.desc("p"), "action").select("state", F.col("action").alias("taught"))
    per = first.join(top, "state", "left").groupBy("game_id").agg(F.count(F.lit(1)).alias("steps"), F.count("taught").alias("covered"), F.sum((F.col("taught") == F.col("action")).cast("long")).alias("played"))
    split = F.when(v.hash_fraction("split", F.col("game_id")) < 0.2, "test").otherwise("train")
    out = per.groupBy(split.alias("split")).agg(F.count(F.lit(1)).alias("games"), F.sum("steps").alias("steps"), F.sum("covered").alias("covered"), F.sum("played").alias("played"))
    return rounded(out.withColumn("adherence", F.col("played") / F.col("covered")))


BUDGET = """, budget_evals AS (SELECT parent AS state, action, bud AS budget, (sum(w) + sum(d) / 2.0) / sum(games) AS ep FROM (SELECT *, CASE source WHEN 'expert' THEN 1 WHEN 'all' THEN 4 END AS bud FROM edges WHERE source IN ('expert', 'all'))
    GROUP BY parent, action, bud), rk AS (SELECT *, row_number() OVER (PARTITION BY state, budget ORDER BY ep DESC, action) AS r FROM budget_evals)"""


@query(fx.SQL + BUDGET + """ SELECT a.state, max(CAST(a.r = 1 AND b.r = 1 AS INTEGER)) AS best_same, min(CAST(a.r = b.r AS INTEGER)) AS order_same, round(max(abs(a.ep - b.ep)), 6) AS max_change
    FROM rk a JOIN rk b ON a.state = b.state AND a.action = b.action AND a.budget = 1 AND b.budget = 4 GROUP BY a.state""")
def budget_stability(spark, d):
    rows = fx.edges(spark, d).where("source IN ('expert', 'all')")
    evals = rows.groupBy(F.col("parent").alias("state"), "action", F.when(F.col("source") == "expert", 1).otherwise(4).alias("budget")).agg(((F.sum("w") + F.sum("d") / 2) / F.sum("games")).alias("ep"))
    return rounded(metrics.budget_pairs(evals, 1, 4))


@query("""SELECT o_orderstatus AS state, count(*) AS jobs, count(*) FILTER (o_orderpriority LIKE '1%') AS urgent, round(coalesce(sum(o_totalprice) FILTER (o_orderdate >= TIMESTAMP '1997-01-01'), 0), 2) AS recent FROM orders GROUP BY 1""")
def ledger_summary(spark, d):
    recent = F.col("o_orderdate") >= F.lit("1997-01-01").cast("timestamp")
    return fx.table(spark, d, "orders").groupBy(F.col("o_orderstatus").alias("state")).agg(F.count(F.lit(1)).alias("jobs"), F.count_if(F.col("o_orderpriority").startswith("1")).alias("urgent"), F.round(F.coalesce(F.sum(F.when(recent, F.col("o_totalprice"))), F.lit(0.0)), 2).alias("recent"))


@query("""SELECT user_id, event_type, CAST(strftime(time_bucket(INTERVAL 1 HOUR, ts), '%Y%m%d%H') AS BIGINT) AS hour, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY ALL""")
def hourly_activity(spark, d):
    rows = fx.table(spark, d, "events")
    return rows.groupBy("user_id", "event_type", F.date_format(F.date_trunc("hour", "ts"), "yyyyMMddHH").cast("long").alias("hour")).agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("value"), 4).alias("total"))
