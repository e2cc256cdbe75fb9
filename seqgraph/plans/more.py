"""Domain walk, evidence, plans, courses and audits."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import values as v
from ..operators import evidence, graph, metrics, mining, selection, sequences as seq
from . import fixture as fx
from .catalog import query, rounded
from .study import BOARDS, ITEMS, MI, PERMUTED, PLANS, SHUFFLES, _boards, _items, _uses


@query(fx.SQL + """, ok AS (SELECT DISTINCT parent, child FROM edges WHERE games >= CASE source WHEN 'expert' THEN 3 WHEN 'population' THEN 8 ELSE 1000000 END),
    walk AS (SELECT '' AS state, 0 AS depth UNION SELECT child, depth + 1 FROM walk JOIN ok ON parent = state WHERE depth < 5) SELECT state, min(depth) AS depth FROM walk GROUP BY state""")
def domain_walk(spark, d):
    """Breadth first over several sources, each with its own floor."""
    floor = F.when(F.col("source") == "expert", 3).when(F.col("source") == "population", 8).otherwise(1_000_000)
    return graph.closure(fx.edges(spark, d).where(F.col("games") >= floor), "", 0, 5)


@query(fx.SQL + """ SELECT action, c_structure AS next_structure, CAST(sum(games) AS BIGINT) AS games FROM shares WHERE source = 'all' AND p_structure = '1,0' AND (c_structure IS NULL OR c_structure <> '1,0') GROUP BY ALL""")
def exit_moves(spark, d):
    """How games leave one structure, and for which."""
    first = graph.cut(fx.first_visits(spark, d))
    nodes = seq.nodes(first)
    members = nodes.where("structure = '1,0'").select("state")
    rows = seq.edges(first).where("source = 'all'").join(members.withColumnRenamed("state", "parent"), "parent", "left_semi").join(members.withColumnRenamed("state", "child"), "child", "left_anti")
    return rows.join(nodes.select(F.col("state").alias("child"), F.col("structure").alias("next_structure")), "child", "left").groupBy("action", "next_structure").agg(F.sum("games").alias("games"))


@query(fx.SQL + """ SELECT 'root_equals_games' AS finding, CAST(abs((SELECT count(*) FROM fv WHERE state = '') - (SELECT count(*) FROM games)) AS BIGINT) AS n
    UNION ALL SELECT 'moves_above_total', count(*) FROM (SELECT state, sum(CASE WHEN action IS NOT NULL THEN 1 ELSE 0 END) AS m, count(*) AS t FROM fv GROUP BY state) WHERE m > t
    UNION ALL SELECT 'child_differs', count(*) FROM edges WHERE source = 'all' AND child <> array_to_string(list_sort(list_filter(list_concat(string_split(parent, '|'), [action]), lambda x: x <> '')), '|')""")
def import_verification(spark, d):
    """The root counts every game; no state has more moves than visits; each child follows from its parent and action."""
    first = graph.cut(fx.first_visits(spark, d))
    root, games = first.where("state = ''").count(), fx.games(spark, d).count()
    above = first.groupBy("state").agg(F.count("action").alias("m"), F.count(F.lit(1)).alias("t")).where("m > t")
    made = F.array_join(F.array_sort(F.filter(F.concat(F.split("parent", r"\|"), F.array("action")), lambda x: x != "")), "|")
    differs = seq.edges(first).where("source = 'all'").where(F.col("child") != made)
    root_row = spark.range(abs(root - games))
    return evidence.findings([("root_equals_games", root_row, "error"), ("moves_above_total", above, "error"), ("child_differs", differs, "error")]).select("finding", "n")


@query(fx.SQL + """, g AS (SELECT source, state, count(*) AS games FROM fvs GROUP BY ALL), ok AS (SELECT *, CASE source WHEN 'expert' THEN 1 WHEN 'population' THEN 2 ELSE 3 END AS r FROM g
    WHERE games >= CASE source WHEN 'expert' THEN 10 WHEN 'population' THEN 20 ELSE 5 END) SELECT state, arg_min(source, r) AS source, arg_min(games, r) AS games FROM ok GROUP BY state""")
def preferred_source(spark, d):
    return evidence.preferred_source(seq.position_source(fx.first_visits(spark, d)), {"expert": 10, "population": 20, "all": 5})


EVALS = "WITH ev AS (SELECT l_partkey % 500 AS state, l_returnflag AS source, l_linenumber * 4 AS depth, CAST(l_suppkey AS VARCHAR) AS action, l_discount * 10 AS ep FROM lineitem)"


def _line_evals(spark, d):
    return fx.table(spark, d, "lineitem").select((F.col("l_partkey") % 500).alias("state"), F.col("l_returnflag").alias("source"), (F.col("l_linenumber") * 4).alias("depth"), F.col("l_suppkey").cast("string").alias("action"), (F.col("l_discount") * 10).alias("ep"))


@query(EVALS + """ SELECT state, source, depth, action, round(ep, 6) AS ep FROM (SELECT *, row_number() OVER (PARTITION BY state ORDER BY CASE source WHEN 'R' THEN 1 ELSE 2 END, depth DESC, ep DESC, action) AS n FROM ev
    WHERE depth >= 12 AND source IN ('R', 'A')) WHERE n = 1""")
def best_evals(spark, d):
    return rounded(evidence.best_evals(_line_evals(spark, d), ["R", "A"], 12).select("state", "source", "depth", "action", "ep"))


@query(EVALS + """, s AS (SELECT state, max(depth) AS depth, count(DISTINCT action) AS lines, avg(ep) / 10 AS mass FROM ev WHERE source = 'R' GROUP BY state)
    SELECT k.state, CASE WHEN depth IS NULL THEN 'missing' WHEN depth < 18 THEN 'shallow' WHEN lines < 2 THEN 'single_line' WHEN round(mass, 6) < 0.05 THEN 'uncovered_mass' ELSE 'sufficient' END AS reason
    FROM (SELECT DISTINCT state FROM ev) k LEFT JOIN s USING (state)""")
def eval_sufficiency(spark, d):
    rows = _line_evals(spark, d)
    own = rows.where("source = 'R'").groupBy("state").agg(F.max("depth").alias("depth"), F.countDistinct("action").alias("lines"), F.round(F.avg("ep") / 10, 6).alias("mass"))
    scaled = F.when(F.col("mass") < 0.05, 0.0).otherwise(1.0)
    return rows.select("state").distinct().join(own, "state", "left").select("state", evidence.sufficiency(F.col("depth"), F.col("lines"), scaled).alias("reason"))


@query(fx.SQL + """, ce AS (SELECT state, arg_max(ep, n) AS ep FROM evals WHERE n >= 10 GROUP BY state HAVING count(*) >= 1), mx AS (SELECT state, max(ep) AS ep FROM evals WHERE n >= 10 GROUP BY state),
    pe AS (SELECT state, action, ep FROM evals WHERE n >= 20)
    SELECT e.parent AS state, e.action, round(coalesce(pe.ep, 1 - mx.ep), 6) AS ep, CASE WHEN pe.ep IS NOT NULL THEN 'parent' WHEN mx.ep IS NOT NULL THEN 'child' ELSE 'none' END AS how
    FROM edges e LEFT JOIN pe ON pe.state = e.parent AND pe.action = e.action LEFT JOIN mx ON mx.state = e.child WHERE e.source = 'all'""")
def resolved_values(spark, d):
    edges = graph.cut(fx.edges(spark, d))
    evals = fx.evals(edges)
    child = evals.where("n >= 10").groupBy("state").agg(F.max("ep").alias("ep"))
    actions = edges.where("source = 'all'").select(F.col("parent").alias("state"), "action", "child")
    return rounded(evidence.resolved(actions, evals.where("n >= 20"), child))


@query(fx.SQL + """ SELECT source, state, action, round(p, 6) AS p FROM (SELECT *, row_number() OVER (PARTITION BY source, state ORDER BY p DESC, action) AS r FROM dist) WHERE source = 'expert' AND (r = 1 OR (r <= 3 AND p >= 0.25))""")
def answer_sets(spark, d):
    dist = metrics.distributions(fx.edges(spark, d)).where("source = 'expert'")
    return rounded(evidence.answer_sets(dist, 0.25, 3).select("source", "state", "action", "p"))


@query("""WITH c AS (SELECT o_orderkey, CASE WHEN o_orderkey % 11 = 0 THEN o_orderstatus ELSE o_orderstatus || ' ' || o_custkey % 40 || ' 0 1' END AS key FROM orders), dm AS (SELECT DISTINCT 'F ' || c_custkey % 30 AS state FROM customer)
    SELECT CASE WHEN len(string_split(key, ' ')) < 2 THEN 'malformed' WHEN dm.state IS NULL THEN 'outside' ELSE 'matched' END AS reason, count(*) AS n
    FROM c LEFT JOIN dm ON dm.state = array_to_string(string_split(key, ' ')[1:2], ' ') GROUP BY 1""")
def key_translation(spark, d):
    """Cached keys lose their counters and meet the domain; what doesn't match keeps its reason."""
    whole = F.concat_ws(" ", "o_orderstatus", (F.col("o_custkey") % 40).cast("string"), F.lit("0"), F.lit("1"))
    cache = fx.table(spark, d, "orders").select(F.when(F.col("o_orderkey") % 11 == 0, F.col("o_orderstatus")).otherwise(whole).alias("key"))
    domain = fx.table(spark, d, "customer").select(F.concat(F.lit("F "), (F.col("c_custkey") % 30).cast("string")).alias("state"))
    return evidence.translate_keys(cache, domain, 2).groupBy("reason").agg(F.count(F.lit(1)).alias("n"))


@query("WITH m AS (SELECT o_orderkey AS id, (o_orderkey * 2654435761 % 65536) << 20 AS w FROM orders) SELECT a.id, b.id AS id2, CAST(bit_count(xor(a.w, b.w)) AS INTEGER) AS d FROM m a JOIN m b ON a.id < b.id AND bit_count(xor(a.w, b.w)) <= 1")
def near_masks(spark, d):
    """Masks within one bit of each other, through shared halves instead of all pairs."""
    mask = F.shiftleft(F.pmod(F.col("o_orderkey") * 2654435761, F.lit(65536)), 20)
    return evidence.near_masks(fx.table(spark, d, "orders").select(F.col("o_orderkey").alias("id"), mask.alias("mask")), 1)


@query(fx.SQL + """, k AS (SELECT n.state, r.reach, (SELECT count(*) FROM fvs f WHERE f.source = 'population' AND f.state = n.state) > 5 AS pop, n.state IN (SELECT state FROM evals) AS eng, n.structure IN ('1,0', '0,1') AS scope
        FROM nodes n JOIN reach r ON r.state = n.state AND r.source = 'all')
    SELECT pop, eng, scope, count(*) AS states, round(sum(reach), 6) AS mass FROM k GROUP BY ALL""")
def joint_coverage(spark, d):
    """States by population data, evaluation and scope together: counted, and weighted by reach."""
    first = graph.cut(fx.first_visits(spark, d))
    edges, nodes = graph.cut(seq.edges(first)), graph.cut(seq.nodes(first))
    known = seq.by_source(first).where("source = 'population'").groupBy("state").count().select("state", (F.col("count") > 5).alias("_p"))
    valued = fx.evals(edges).select("state").distinct().withColumn("_e", F.lit(True))
    reach = graph.flow(edges, nodes).where("source = 'all'").select("state", "reach")
    rows = nodes.join(reach, "state").join(known, "state", "left").join(valued, "state", "left")
    flags = [F.coalesce("_p", F.lit(False)).alias("pop"), F.coalesce("_e", F.lit(False)).alias("eng"), F.col("structure").isin("1,0", "0,1").alias("scope")]
    return rounded(rows.select(*flags, "reach").groupBy("pop", "eng", "scope").agg(F.count(F.lit(1)).alias("states"), F.sum("reach").alias("mass")))


@query("""SELECT o_orderpriority, dimension, round(sum(value), 2) AS total, round(sum(value) / sum(sum(value)) OVER (PARTITION BY o_orderpriority), 6) AS share FROM (
    SELECT o_orderpriority, unnest(['price', 'quantity', 'tax']) AS dimension, unnest([l_extendedprice / 1000, l_quantity, l_tax * 100]) AS value FROM lineitem JOIN orders ON o_orderkey = l_orderkey) GROUP BY o_orderpriority, dimension""")
def pooled_burden(spark, d):
    """Several cost dimensions, unpivoted and pooled by group."""
    rows = fx.table(spark, d, "lineitem").join(fx.table(spark, d, "orders"), F.col("o_orderkey") == F.col("l_orderkey"))
    rows = rows.selectExpr("o_orderpriority", "stack(3, 'price', l_extendedprice / 1000, 'quantity', l_quantity, 'tax', l_tax * 100) AS (dimension, value)")
    rows = rows.groupBy("o_orderpriority", "dimension").agg(F.sum("value").alias("total"))
    share = F.round(F.col("total") / F.sum("total").over(Window.partitionBy("o_orderpriority")), 6)
    return rows.select("o_orderpriority", "dimension", F.round("total", 2).alias("total"), share.alias("share"))


@query("SELECT o_custkey, o_orderstatus, min(o_orderkey) AS o_orderkey FROM orders WHERE (o_custkey, o_orderstatus, o_totalprice) IN (SELECT o_custkey, o_orderstatus, max(o_totalprice) FROM orders GROUP BY 1, 2) GROUP BY 1, 2")
def keep_first_by_signature(spark, d):
    return evidence.keep_first(fx.table(spark, d, "orders").select("o_custkey", "o_orderstatus", "o_orderkey", "o_totalprice"), ["o_custkey", "o_orderstatus"], F.desc("o_totalprice"), "o_orderkey").drop("o_totalprice")


@query("WITH x AS (SELECT 1)" + BOARDS + MI + PERMUTED + """, sz AS (SELECT g, count(*) AS boards FROM boards GROUP BY g)
    SELECT g, round(base - conditional, 6) AS mi, round(p_value, 6) AS p_value, boards, CASE WHEN boards < 5 THEN 'too_few' WHEN base - conditional < 0.10 THEN 'no_information'
    WHEN p_value < 0.05 AND "values" >= 2 THEN 'split' ELSE 'chance' END AS decision FROM base JOIN cond USING (g) JOIN sz USING (g) JOIN tested USING (g)""")
def split_decisions(spark, d):
    """Information, chance (200 shuffles) and size, over all boards."""
    return split_all(_boards(spark, d))


def split_all(boards):
    mi, tests = mining.mutual_information(boards, "g", "y", "f", "w"), mining.permutation_test(boards, "g", "y", "f", "w", "o_orderkey", SHUFFLES)
    found = mining.split_decision(mi, tests, boards.groupBy("g").agg(F.count(F.lit(1)).alias("boards")), "g")
    return rounded(found.select("g", "mi", "p_value", "boards", "decision"))


@query(fx.SQL + """, st AS (SELECT *, CAST(least(9, (row_number() OVER (PARTITION BY outcome ORDER BY day_ord, game_id) - 1) * 10 // count(*) OVER (PARTITION BY outcome)) AS INTEGER) AS stratum FROM games),
    dr AS (SELECT *, row_number() OVER (PARTITION BY outcome, stratum ORDER BY -ln(greatest(('0x' || substr(sha256('pps:' || game_id), 1, 8))::BIGINT / 4294967296.0, 1e-12)) / CASE WHEN strong THEN 3.0 ELSE 1.0 END, game_id) AS n FROM st)
    SELECT outcome, stratum, game_id FROM dr WHERE n <= 4""")
def stratified_sample(spark, d):
    """Four games of each stratum, strong ones three times as likely, by seeded hashes."""
    rows = selection.strata(fx.games(spark, d), "outcome", "day_ord", "game_id").withColumn("weight", F.when(F.col("strong"), 3.0).otherwise(1.0))
    return evidence.proportional_sample(rows, "outcome", "stratum", "weight", 4, "pps", "game_id").select("outcome", "stratum", "game_id")


@query(PLANS + """, lv AS (SELECT DISTINCT plan, split_part(component, ':', 1) AS c FROM uses), p AS (SELECT a.c AS a, b.c AS b, count(*) AS plans FROM lv a JOIN lv b ON a.plan = b.plan AND a.c < b.c GROUP BY ALL HAVING count(*) >= 2)
    SELECT a, b, plans FROM p""")
def component_pairs(spark, d):
    """Bundles of two components that at least two plans share."""
    rows = _uses(spark, d).select("plan", F.split_part("component", F.lit(":"), F.lit(1)).alias("c")).distinct()
    a, b = rows.withColumnRenamed("c", "a"), rows.withColumnRenamed("c", "b")
    return a.join(b, "plan").where("a < b").groupBy("a", "b").agg(F.count(F.lit(1)).alias("plans")).where("plans >= 2")


@query(PLANS + """, pay AS (SELECT component, count(DISTINCT plan) AS plans FROM uses GROUP BY component), m(model, base, extra) AS (VALUES ('flat', 1.0, 1.0), ('shared', 1.0, 0.0), ('half', 1.0, 0.5), ('setup', 2.0, 0.25), ('linear', 0.0, 1.0))
    SELECT model, round(sum(base + extra * (plans - 1)), 4) AS burden, round(sum(plans * (base + extra)), 4) AS additive FROM pay, m GROUP BY model""")
def cost_models(spark, d):
    """Five cost models over the same uses: what sharing saves depends on the model."""
    models = spark.sql("SELECT * FROM VALUES ('flat', 1.0D, 1.0D), ('shared', 1.0D, 0.0D), ('half', 1.0D, 0.5D), ('setup', 2.0D, 0.25D), ('linear', 0.0D, 1.0D) AS m(model, base, extra)")
    pay = _uses(spark, d).groupBy("component").agg(F.countDistinct("plan").alias("plans"))
    rows = pay.crossJoin(F.broadcast(models))  # five models
    return rounded(rows.groupBy("model").agg(F.sum(F.col("base") + F.col("extra") * (F.col("plans") - 1)).alias("burden"), F.sum(F.col("plans") * (F.col("base") + F.col("extra"))).alias("additive")), 4)


@query(fx.SQL + ITEMS + """, fam AS (SELECT c.state, n.structure, c.loss, b.reach, b.base_loss FROM cells c JOIN nodes n USING (state) JOIN base b USING (state) WHERE c.item LIKE 'D:%'),
    fixed AS (SELECT c.state, n.structure, c.loss FROM cells c JOIN nodes n USING (state) WHERE c.item LIKE 'S:%'), mn AS (SELECT state, structure, min(loss) AS loss, max(reach) AS reach, max(base_loss) AS base_loss FROM fam GROUP BY ALL)
    SELECT m.structure, round(sum(reach * base_loss), 6) AS baseline, round(sum(reach * coalesce(m.loss, base_loss)), 6) AS loose, round(sum(reach * coalesce(f.loss, base_loss)), 6) AS fixed FROM mn m LEFT JOIN fixed f USING (state) GROUP BY m.structure""")
def family_bounds(spark, d):
    """What a family could at best leave: any decision at each state, or one fixed rule."""
    cells, base, *_ = _items(spark, d)
    nodes = seq.nodes(fx.first_visits(spark, d)).select("state", "structure")
    loose = cells.where("item LIKE 'D:%'").groupBy("state").agg(F.min("loss").alias("_l"))
    fixed = cells.where("item LIKE 'S:%'").groupBy("state").agg(F.max("loss").alias("_f"))
    rows = loose.join(base, "state").join(nodes, "state").join(fixed, "state", "left")
    left = lambda c: F.sum(F.col("reach") * F.coalesce(F.col(c), F.col("base_loss")))
    return rounded(rows.groupBy("structure").agg(F.sum(F.col("reach") * F.col("base_loss")).alias("baseline"), left("_l").alias("loose"), left("_f").alias("fixed")))


@query()
def course_selection(spark, d):
    """Items under a budget of states, best marginal value first: greedy, so no SQL."""
    cells, base, *_ = _items(spark, d)
    gains = cells.join(base, "state").select("item", "state", (F.col("reach") * (F.col("base_loss") - F.col("loss"))).alias("gain"))
    costs = cells.groupBy("item").agg(F.count(F.lit(1)).cast("double").alias("cost"))
    steps = selection.greedy(gains, costs, 40, budget=25.0)
    return spark.createDataFrame([(s["step"], s["item"], s["cumulative"], s["cost"]) for s in steps], "step int, item string, recovered double, burden double")


@query("""SELECT 'no_lines' AS finding, 'error' AS severity, count(*) AS n FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem)
    UNION ALL SELECT 'orphan_lines', 'error', count(*) FROM lineitem WHERE l_orderkey NOT IN (SELECT o_orderkey FROM orders)
    UNION ALL SELECT 'duplicate_numbers', 'warning', count(*) FROM (SELECT l_orderkey, l_linenumber FROM lineitem GROUP BY ALL HAVING count(*) > 1)
    UNION ALL SELECT 'free', 'warning', count(*) FROM lineitem WHERE l_extendedprice <= 0 UNION ALL SELECT 'debtor_orders', 'note', count(*) FROM orders JOIN customer ON c_custkey = o_custkey WHERE c_acctbal < 0
    UNION ALL SELECT 'late_lines', 'note', count(*) FROM lineitem JOIN orders ON o_orderkey = l_orderkey WHERE l_shipdate < o_orderdate""")
def audit(spark, d):
    """One finding class a row, with its number of cases; zero is reported, too."""
    lines, orders, customers = (fx.table(spark, d, t) for t in ("lineitem", "orders", "customer"))
    both = lines.join(orders, F.col("o_orderkey") == F.col("l_orderkey"))
    return evidence.findings([
        ("no_lines", orders.join(lines, F.col("o_orderkey") == F.col("l_orderkey"), "left_anti"), "error"),
        ("orphan_lines", lines.join(orders, F.col("o_orderkey") == F.col("l_orderkey"), "left_anti"), "error"),
        ("duplicate_numbers", lines.groupBy("l_orderkey", "l_linenumber").count().where("count > 1"), "warning"),
        ("free", lines.where("l_extendedprice <= 0"), "warning"),
        ("debtor_orders", orders.join(customers, F.col("c_custkey") == F.col("o_custkey")).where("c_acctbal < 0"), "note"),
        ("late_lines", both.where("l_shipdate < o_orderdate"), "note"),
    ])


@query("""WITH t AS (SELECT o_orderstatus AS course, width AS budget, sum(o_totalprice) AS v, count(*) AS n FROM orders, (VALUES (100000), (200000), (400000)) b(width) WHERE o_totalprice <= width GROUP BY ALL)
    SELECT a.budget, a.n AS n_a, b.n AS n_b, round(a.v / a.n - b.v / b.n, 4) AS difference FROM t a JOIN t b ON a.budget = b.budget AND a.course = 'F' AND b.course = 'O'""")
def course_compare(spark, d):
    """Two courses side by side at each budget."""
    budgets = F.explode(F.array(*[F.lit(x) for x in (100000, 200000, 400000)]))
    rows = fx.table(spark, d, "orders").select("o_orderstatus", "o_totalprice", budgets.alias("budget")).where("o_totalprice <= budget")
    rows = rows.groupBy("budget").agg(*[f.alias(n) for s, k in (("F", "a"), ("O", "b")) for f, n in ((F.count_if(F.col("o_orderstatus") == s), f"n_{k}"), (F.avg(F.when(F.col("o_orderstatus") == s, F.col("o_totalprice"))), f"m_{k}"))])
    return rounded(rows.where("n_a > 0 AND n_b > 0").select("budget", "n_a", "n_b", (F.col("m_a") - F.col("m_b")).alias("difference")), 4)


@query(fx.SQL + """, o AS (SELECT n.structure, s.action, count(*) AS c FROM steps s JOIN nodes n ON n.state = s.state GROUP BY ALL), p AS (SELECT structure, c / sum(c) OVER (PARTITION BY structure) AS p, c FROM o)
    SELECT structure, round(-sum(p * log2(p)), 6) + 0 AS ordering_entropy, CAST(sum(c) AS BIGINT) AS steps FROM p GROUP BY structure""")
def coherence(spark, d):
    """How ordered play is inside each structure: the entropy of what is played there."""
    steps = seq.number_steps(fx.events(spark, d), "game", ["ts", "event_id"], "event_type", fx.STRUCTURE).select("state", "action")
    rows = steps.join(seq.nodes(fx.first_visits(spark, d)).select("state", "structure"), "state").groupBy("structure", "action").agg(F.count(F.lit(1)).alias("c"))
    p = F.col("c") / F.sum("c").over(Window.partitionBy("structure"))
    return rounded(rows.withColumn("p", p).groupBy("structure").agg((-F.sum(F.col("p") * F.log2("p"))).alias("ordering_entropy"), F.sum("c").alias("steps")))


@query(fx.SQL + """, t AS (SELECT state, sum(games) AS games, max(p) AS top1, sum(p) FILTER (r <= 2) AS top2 FROM (SELECT *, row_number() OVER (PARTITION BY state ORDER BY p DESC, action) AS r FROM dist WHERE source = 'population') GROUP BY state)
    SELECT CASE WHEN games >= 100 THEN 'many' WHEN games >= 20 THEN 'some' ELSE 'few' END AS support, count(*) AS states, round(sum(games * top1) / sum(games), 6) AS top1, round(sum(games * top2) / sum(games), 6) AS top2 FROM t GROUP BY 1""")
def coverage_sensitivity(spark, d):
    """What the best action covers alone, and with the second."""
    dist = metrics.distributions(fx.edges(spark, d)).where("source = 'population'")
    order = Window.partitionBy("state").orderBy(F.desc("p"), "action")
    per = dist.withColumn("r", F.row_number().over(order)).groupBy("state").agg(F.sum("games").alias("games"), F.max("p").alias("t1"), F.sum(F.when(F.col("r") <= 2, F.col("p"))).alias("t2"))
    support = F.when(F.col("games") >= 100, "many").when(F.col("games") >= 20, "some").otherwise("few")
    mean = lambda c: F.sum(F.col("games") * F.col(c)) / F.sum("games")
    return rounded(per.groupBy(support.alias("support")).agg(F.count(F.lit(1)).alias("states"), mean("t1").alias("top1"), mean("t2").alias("top2")))


@query(fx.SQL + """, ab AS (SELECT state, action, arg_max(ep, games) AS ep FROM (SELECT parent AS state, action, games, (w + d / 2.0) / games AS ep FROM edges WHERE source = 'expert') GROUP BY ALL),
    al AS (SELECT parent AS state, action, (w + d / 2.0) / games AS ep FROM edges WHERE source = 'all'), ra AS (SELECT state, arg_min(action, (-round(ep, 9), action)) AS a FROM ab GROUP BY state), rl AS (SELECT state, arg_min(action, (-round(ep, 9), action)) AS a FROM al GROUP BY state)
    SELECT ra.state, ra.a AS shallow, rl.a AS deep FROM ra JOIN rl USING (state) WHERE ra.a <> rl.a""")
def unstable_states(spark, d):
    """States whose best action changes between two bodies of evidence."""
    edges = fx.edges(spark, d)
    ep = F.round((F.col("w") + F.col("d") / 2) / F.col("games"), 9)
    best = lambda s, name: edges.where(F.col("source") == s).groupBy(F.col("parent").alias("state")).agg(F.min_by("action", F.struct((-ep).alias("e"), F.col("action").alias("a"))).alias(name))
    return best("expert", "shallow").join(best("all", "deep"), "state").where("shallow <> deep")


@query(fx.SQL + """ SELECT state, dense_rank() OVER (ORDER BY state) AS id FROM nodes""")
def state_dictionary(spark, d):
    """Dense ids of states in their order: ranks within ranges of a range partitioning plus the ranges' offsets."""
    states = seq.nodes(fx.first_visits(spark, d)).select("state")
    parts = graph.cut(states.repartitionByRange(4, "state").withColumn("part", F.spark_partition_id()))
    sizes = parts.groupBy("part").count()
    before = sizes.withColumn("before", F.coalesce(F.sum("count").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("count")  # one row a range
    rank = F.row_number().over(Window.partitionBy("part").orderBy("state"))
    return parts.join(before, "part").select("state", (rank + F.col("before")).alias("id"))


@query("""SELECT event_type AS source, count(*) AS fetched, count(DISTINCT user_id) AS positions, bool_and(value >= 0) AS complete FROM events GROUP BY 1""")
def progress_status(spark, d):
    rows = fx.table(spark, d, "events")
    return rows.groupBy(F.col("event_type").alias("source")).agg(F.count(F.lit(1)).alias("fetched"), F.countDistinct("user_id").alias("positions"), F.bool_and(F.col("value") >= 0).alias("complete"))


@query("""WITH old AS (SELECT o_custkey AS key, min(o_orderkey) AS depth, sum(o_totalprice) AS total FROM orders WHERE o_orderkey % 2 = 0 GROUP BY 1), new AS (SELECT o_custkey AS key, min(o_orderkey) AS depth, sum(o_totalprice) AS total FROM orders WHERE o_orderkey % 2 = 1 GROUP BY 1)
    SELECT key, min(depth) AS depth, round(sum(total), 2) AS total FROM (SELECT * FROM old UNION ALL SELECT * FROM new) GROUP BY key""")
def merged_counts(spark, d):
    """An additive and a least-value merge of two deltas by key."""
    from ..sources import sinks

    part = lambda k: fx.table(spark, d, "orders").where(F.col("o_orderkey") % 2 == k).groupBy(F.col("o_custkey").alias("key")).agg(F.min("o_orderkey").alias("depth"), F.sum("o_totalprice").alias("total"))
    old, new = part(0), part(1)
    added = sinks.merge_add(old.select("key", "total"), new.select("key", "total"), ["key"])
    least = sinks.merge_min(old.select("key", "depth"), new.select("key", "depth"), ["key"])
    return least.join(added, "key").select("key", "depth", F.round("total", 2).alias("total"))
