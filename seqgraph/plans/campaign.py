"""Rules, candidates and what knowledge saves, on the event graph."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import values as v
from ..operators import campaign, graph, metrics, rules, sequences as seq
from . import fixture as fx
from .catalog import query, rounded
from .values import PAIRS


def _graph(spark, d):
    first = graph.cut(fx.first_visits(spark, d))
    return first, graph.cut(seq.edges(first)), graph.cut(seq.nodes(first))


def _rule_boards(nodes, reach):
    rows = nodes.join(reach.where("source = 'all'").select("state", F.col("reach").alias("weight")), "state")
    return rows.select("state", F.col("structure").alias("family"), "role", "weight", F.least(F.lit(4), "min_ply").cast("string").alias("stage"), F.when(F.contains("state", F.lit("error")), "yes").otherwise("no").alias("failed"))


ANSWERS = """, rt AS (SELECT *, sum(p) OVER (PARTITION BY state) AS t FROM dist WHERE source = 'all'), rr AS (SELECT *, row_number() OVER (PARTITION BY state ORDER BY p DESC, action) AS r FROM rt WHERE games >= 5),
    ans AS (SELECT s.state, coalesce(a.answers, []) AS answers, a.top FROM (SELECT DISTINCT state FROM rt) s LEFT JOIN
        (SELECT state, coalesce(list(action ORDER BY r) FILTER (r <= 2 AND p / t >= 0.35), []) AS answers, arg_min(action, r) AS top FROM rr GROUP BY state) a USING (state)),
    bd0 AS (SELECT n.state, n.structure AS family, n.role, r.reach AS weight, CAST(least(4, n.min_ply) AS VARCHAR) AS stage, CASE WHEN contains(n.state, 'error') THEN 'yes' ELSE 'no' END AS failed
        FROM nodes n JOIN reach r ON r.state = n.state AND r.source = 'all')"""


def _rule_sql(name: str, boards: str, keys: str) -> str:
    """Rules of the groups of `boards`, as common table expressions that begin with `name`."""
    return f""", {name}_b AS (SELECT b.*, a.answers, a.top FROM {boards} b JOIN ans a USING (state)),
    {name}_m AS (SELECT {keys}, action, sum(weight) AS m FROM (SELECT {keys}, weight, unnest(answers) AS action FROM {name}_b) GROUP BY {keys}, action),
    {name}_o AS (SELECT *, row_number() OVER w AS r, coalesce(sum(m) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before_ FROM {name}_m WINDOW w AS (PARTITION BY {keys} ORDER BY round(m, 12) DESC, action)),
    {name}_s AS (SELECT {keys}, list(action ORDER BY r) AS set_, sum(m) AS covered FROM {name}_o WHERE r <= 2 AND before_ < 0.60 GROUP BY {keys}),
    {name}_j AS (SELECT b.*, coalesce(s.set_, []) AS set_, s.covered FROM {name}_b b LEFT JOIN {name}_s s USING ({keys})),
    {name}_f AS (SELECT {keys}, any_value(set_) AS set_, any_value(covered) AS covered, sum(CASE WHEN answers = set_ THEN weight ELSE 0 END) AS strict, count(*) FILTER (top IS NOT NULL AND NOT list_contains(set_, top)) AS exceptions,
        sum(CASE WHEN top IS NOT NULL AND NOT list_contains(set_, top) THEN weight ELSE 0 END) AS exception_mass, sum(weight) AS coverage, count(*) AS boards FROM {name}_j GROUP BY {keys}),
    {name}_r AS (SELECT *, covered / nullif(coverage, 0) AS support, CASE WHEN len(set_) > 0 THEN strict END / nullif(coverage, 0) AS strict_support FROM {name}_f),
    {name} AS (SELECT *, len(set_) > 0 AND coalesce(round(CASE WHEN len(set_) = 1 THEN support ELSE strict_support END, 9), 0) >= 0.60 AS earned FROM {name}_r)"""


_RULE = """CASE WHEN earned THEN 'prescriptive' ELSE 'recognition_only' END AS kind, CASE WHEN earned THEN array_to_string(set_, ',') ELSE '' END AS answers, round(support, 6) AS support, round(strict_support, 6) AS strict_support, round(coverage, 6) AS coverage,
    boards, exceptions, round(exception_mass, 6) AS exception_mass, CASE WHEN earned THEN '' WHEN len(set_) = 0 THEN 'no_answer' WHEN len(set_) > 1 THEN 'not_strict' ELSE 'not_enough_mass' END AS reason"""


@query(fx.SQL + ANSWERS + _rule_sql("base_r", "bd0", "family, role") + """, bd1 AS (SELECT family, role, state, weight, unnest(['stage', 'failed']) AS feature, unnest([stage, failed]) AS value FROM bd0
        JOIN (SELECT family, role FROM base_r WHERE NOT earned) USING (family, role))""" + _rule_sql("cond_r", "bd1", "family, role, feature, value") + f"""
    SELECT family, role, NULL::VARCHAR AS feature, NULL::VARCHAR AS value, {_RULE} FROM base_r UNION ALL
    SELECT family, role, feature, value, {_RULE} FROM (SELECT c.*, b.coverage AS total FROM cond_r c JOIN base_r b USING (family, role)) WHERE earned AND coverage >= 0.10 * total""")
def role_rules(spark, d):
    """Rules by family and side to move; where none is earned, by the family's features."""
    _, edges, nodes = _graph(spark, d)
    dist = metrics.distributions(edges).where("source = 'all'")
    answers = graph.cut(rules.state_answers(dist.select("state", "action", "games", "p"), min_games=5))
    return rounded(rules.with_fallback(graph.cut(_rule_boards(nodes, graph.flow(edges, nodes))), answers, ["stage", "failed"]))


@query(fx.SQL + """, sz AS (SELECT state, source, sum(games) AS games, count(*) AS actions FROM dist GROUP BY state, source),
    e AS (SELECT state, games, actions FROM sz WHERE source = 'expert' AND games >= 3)
    SELECT e.state, 'expert' AS expert, CAST(e.games AS BIGINT) AS expert_games, CAST(p.games AS BIGINT) AS population_games FROM e JOIN sz p ON p.state = e.state AND p.source = 'population' WHERE e.actions >= 2 AND p.actions >= 2 AND p.games >= 6""")
def support_candidates(spark, d):
    """States that both sources know well enough."""
    _, edges, _ = _graph(spark, d)
    return campaign.supported(metrics.distributions(edges), {"expert": 3}, "population", 6)


@query(fx.SQL + PAIRS + """, c AS (SELECT state, action, p + q AS combined, row_number() OVER (PARTITION BY state ORDER BY round(p + q, 12) DESC, action) AS needed_rank FROM pairs),
    l AS (SELECT *, sum(CASE WHEN round(combined, 12) >= 0.15 AND needed_rank <= 4 THEN 0 ELSE combined END) OVER (PARTITION BY state) / 2 AS left_out FROM c)
    SELECT state, action, round(combined, 6) AS combined, CAST(needed_rank AS INTEGER) AS needed_rank, round(left_out, 6) AS left_out FROM l WHERE round(combined, 12) >= 0.15 AND needed_rank <= 4""")
def needed_actions(spark, d):
    """Actions that carry enough of both distributions to be evaluated, and what is left out."""
    _, edges, _ = _graph(spark, d)
    return rounded(campaign.needed_actions(metrics.paired(metrics.distributions(edges), "expert", "population"), 0.15, 4))


@query(fx.SQL + """, a AS (SELECT DISTINCT parent AS state, action FROM edges WHERE source = 'all'), k AS (SELECT DISTINCT source, state FROM fvs),
    g AS (SELECT source, parent AS state, action, CAST(sum(games) AS BIGINT) AS games FROM edges GROUP BY ALL),
    s AS (SELECT a.*, CASE WHEN ke.state IS NOT NULL THEN coalesce(e.games, 0) END AS expert, CASE WHEN kp.state IS NOT NULL THEN coalesce(p.games, 0) END AS population, coalesce(l.games, 0) AS everyone FROM a
        LEFT JOIN g e ON e.source = 'expert' AND e.state = a.state AND e.action = a.action LEFT JOIN k ke ON ke.source = 'expert' AND ke.state = a.state
        LEFT JOIN g p ON p.source = 'population' AND p.state = a.state AND p.action = a.action LEFT JOIN k kp ON kp.source = 'population' AND kp.state = a.state
        LEFT JOIN g l ON l.source = 'all' AND l.state = a.state AND l.action = a.action)
    SELECT *, CAST(row_number() OVER (PARTITION BY state ORDER BY coalesce(expert, 0) DESC, coalesce(population, 0) DESC, action) AS INTEGER) AS shown FROM s""")
def served_moves(spark, d):
    """The move table as it is shown: layers laid over each other, unknown apart from never played, in order."""
    first, edges, _ = _graph(spark, d)
    of = lambda s: edges.where(F.col("source") == s).groupBy(F.col("parent").alias("state"), "action").agg(F.sum("games").alias("games"))
    visits = graph.cut(seq.by_source(first).select("source", "state").distinct())
    names = {"expert": "expert", "population": "population", "everyone": "all"}
    return campaign.served_moves(of("all").select("state", "action"), {n: of(s) for n, s in names.items()}, {n: visits.where(F.col("source") == s) for n, s in names.items()}, "expert", "population")


GAIN = """, best AS (SELECT state, max(ep) AS best_ep FROM evals GROUP BY state),
    vp AS (SELECT d.state, sum(p * greatest(0, best_ep - ep)) / sum(p) AS loss_pop, sum(p) AS mass_covered FROM dist d JOIN evals USING (state, action) JOIN best USING (state) WHERE source = 'population' GROUP BY d.state),
    vt AS (SELECT d.state, sum(p * greatest(0, best_ep - ep)) / sum(p) AS loss_taught FROM dist d JOIN evals USING (state, action) JOIN best USING (state) WHERE source = 'expert' GROUP BY d.state),
    gain AS (SELECT state, loss_pop, loss_taught, loss_pop - loss_taught AS gain, mass_covered FROM vp LEFT JOIN vt USING (state))"""


def _gain(edges):
    dist = metrics.distributions(edges)
    return campaign.taught_gain(dist.where("source = 'population'"), fx.evals(edges), dist.where("source = 'expert'").select("state", "action", "p"))


@query(fx.SQL + GAIN + " SELECT state, round(round(loss_pop, 12), 6) AS loss_pop, round(round(loss_taught, 12), 6) AS loss_taught, round(round(gain, 12), 6) + 0 AS gain, round(round(mass_covered, 12), 6) AS mass_covered FROM gain")
def taught_gain(spark, d):
    """What the experts' answers save against ordinary play, by one baseline a state."""
    _, edges, _ = _graph(spark, d)
    return rounded(rounded(_gain(edges), 12))


@query(fx.SQL + GAIN + """ SELECT n.structure AS family, count(*) AS sampled, count(gain) AS evaluated, count(*) - count(gain) AS missing, round(round(sum(r.reach * gain) / sum(CASE WHEN gain IS NOT NULL THEN r.reach END), 12), 6) + 0 AS ev_per_board,
    round(round(coalesce(sum(CASE WHEN gain IS NOT NULL THEN r.reach END), 0), 12), 6) AS weight_evaluated FROM nodes n JOIN reach r ON r.state = n.state AND r.source = 'population' LEFT JOIN gain g ON g.state = n.state GROUP BY n.structure""")
def template_values(spark, d):
    """The expected saving of each structure's states; states without values are counted, not dropped."""
    _, edges, nodes = _graph(spark, d)
    reach = graph.flow(edges, nodes).where("source = 'population'")
    sample = nodes.join(reach, "state").select(F.col("structure").alias("family"), "state", F.col("reach").alias("weight"))
    return rounded(rounded(campaign.template_values(sample, _gain(edges)), 12))


@query(fx.SQL + """, best AS (SELECT state, max(ep) AS best_ep FROM evals GROUP BY state), top AS (SELECT state, action FROM (SELECT *, row_number() OVER (PARTITION BY state ORDER BY p DESC, action) AS r FROM dist WHERE source = 'expert') WHERE r <= 2),
    t AS (SELECT state, avg(greatest(0, best_ep - ep)) AS taught FROM top JOIN best USING (state) LEFT JOIN evals USING (state, action) GROUP BY state),
    w AS (SELECT s.game_id, count(*) AS steps, sum(greatest(0, best_ep - ep)) AS played, sum(coalesce(taught, 0)) AS taught FROM steps s JOIN evals USING (state, action) JOIN best USING (state) JOIN t USING (state) GROUP BY s.game_id)
    SELECT outcome, count(*) AS games, CAST(sum(steps) AS BIGINT) AS steps, round(sum(played), 5) AS loss_played, round(sum(taught), 5) AS loss_taught FROM w JOIN games USING (game_id) GROUP BY outcome""")
def walk_losses(spark, d):
    """What games lost where knowledge covers them, as played and as taught, by outcome."""
    _, edges, _ = _graph(spark, d)
    steps = seq.number_steps(fx.events(spark, d), "game", ["ts", "event_id"], "event_type", fx.STRUCTURE).select("game_id", "state", "action")
    taught = metrics.top_per_group(metrics.distributions(edges).where("source = 'expert'"), "state", 2, F.desc("p"), "action").select("state", "action")
    found = campaign.walk_losses(steps, fx.evals(edges), taught).join(fx.games(spark, d).select("game_id", "outcome"), "game_id")
    return rounded(found.groupBy("outcome").agg(F.count(F.lit(1)).alias("games"), F.sum("steps").alias("steps"), F.sum("loss_played").alias("loss_played"), F.sum("loss_taught").alias("loss_taught")), 5)


@query(fx.SQL + GAIN + PAIRS + """, jsd AS (SELECT state, sum(CASE WHEN p > 0 THEN p * log2(2 * p / (p + q)) ELSE 0 END + CASE WHEN q > 0 THEN q * log2(2 * q / (p + q)) ELSE 0 END) / 2 AS js, arg_max(action, {'p': p, 'a': action}) <> arg_max(action, {'q': q, 'a': action}) AS top_differs FROM pairs GROUP BY state),
    st AS (SELECT n.state, r.reach, n.structure IN ('1,0', '1,1') AS in_template, round(js, 9) AS js, top_differs, round(r.reach * greatest(0, gain), 9) AS decision, round(r.reach * mass_covered / 1000, 9) AS deviation, n.structure = '0,1' AS in_split, n.min_ply % 3 AS frontier_items
        FROM nodes n JOIN reach r ON r.state = n.state AND r.source = 'population' LEFT JOIN jsd ON jsd.state = n.state LEFT JOIN gain ON gain.state = n.state),
    h AS (SELECT *, list_filter(['high_reach', 'mature_template', 'behavioural_disagreement', 'decision_priority', 'deviation_priority', 'split_involvement', 'frontier_sensitivity'], lambda x, i:
        coalesce([reach >= 0.002, in_template, js IS NOT NULL AND (js >= 0.1 OR top_differs), decision >= 0.0005, deviation >= 0.0005, in_split, frontier_items > 0][i], false)) AS reasons FROM st),
    sc AS (SELECT *, len(reasons) AS reason_count, CASE WHEN list_contains(reasons, 'high_reach') THEN 1.0 ELSE 0 END + CASE WHEN list_contains(reasons, 'mature_template') THEN 1.5 ELSE 0 END + CASE WHEN list_contains(reasons, 'behavioural_disagreement') THEN 2 * least(3, js / 0.1) ELSE 0 END
        + CASE WHEN list_contains(reasons, 'decision_priority') THEN 2 * least(3, decision / 0.0005) ELSE 0 END + CASE WHEN list_contains(reasons, 'deviation_priority') THEN 1.5 * least(3, deviation / 0.0005) ELSE 0 END
        + CASE WHEN list_contains(reasons, 'split_involvement') THEN 1.5 ELSE 0 END + CASE WHEN list_contains(reasons, 'frontier_sensitivity') THEN 2 * least(2, frontier_items / 2.0) ELSE 0 END AS score FROM h),
    rk AS (SELECT *, row_number() OVER (ORDER BY round(score, 9) DESC, round(reach, 9) DESC, state) AS rank, count(*) OVER () AS n,
        reason_count >= 2 AND round(reach, 9) >= 0.002 AND list_has_any(reasons, ['decision_priority', 'mature_template', 'behavioural_disagreement']) AS watch FROM sc WHERE reason_count > 0),
    pl AS (SELECT *, sum(CASE WHEN watch AND reason_count >= 3 THEN 1 ELSE 0 END) OVER (ORDER BY rank) AS place FROM rk)
    SELECT state, array_to_string(reasons, ',') AS reasons, CAST(reason_count AS INTEGER) AS reason_count, round(score, 5) AS score, watch,
    CASE WHEN watch AND reason_count >= 3 AND place <= 25 THEN 'C' WHEN watch AND rank <= floor(n * 0.12) THEN 'B' ELSE 'A' END AS tier FROM pl""")
def campaign_tiers(spark, d):
    """All seven reasons, the score and the tiers of every state with a reason."""
    _, edges, nodes = _graph(spark, d)
    pairs = metrics.paired(metrics.distributions(edges), "expert", "population")
    tops = pairs.groupBy("state").agg((F.max_by("action", F.struct("p", "action")) != F.max_by("action", F.struct("q", "action"))).alias("top_differs"))
    reach = graph.flow(edges, nodes).where("source = 'population'").select("state", "reach")
    rows = nodes.join(reach, "state").join(metrics.divergence(pairs).select("state", F.round("js", 9).alias("js")), "state", "left").join(tops, "state", "left").join(_gain(edges), "state", "left")
    rows = rows.select(
        "state", "reach", F.col("structure").isin("1,0", "1,1").alias("in_template"), "js", "top_differs", F.round(F.col("reach") * F.greatest(F.lit(0.0), "gain"), 9).alias("decision"),
        F.round(F.col("reach") * F.col("mass_covered") / 1000, 9).alias("deviation"), (F.col("structure") == "0,1").alias("in_split"), (F.col("min_ply") % 3).alias("frontier_items"),
    )
    found = campaign.tiers(campaign.reasoned(graph.cut(rows)).where("reason_count > 0"))
    return rounded(found.select("state", F.array_join("reasons", ",").alias("reasons"), "reason_count", "score", "watch", "tier"), 5)


@query("""WITH u AS (SELECT o_custkey AS plan, l_returnflag AS f, l_linestatus AS s, o_orderkey % 3 AS k FROM lineitem JOIN orders ON o_orderkey = l_orderkey),
    p AS (SELECT plan, count(*) AS n, count(DISTINCT CASE WHEN k = 0 THEN 'pawn_move' WHEN k = 1 THEN 'castle' END) AS actionable, count(*) FILTER (f = 'R') AS exceptions FROM u GROUP BY plan)
    SELECT plan, CAST(0.5 * n + 0.5 * (1 + actionable) + exceptions + 1.0 AS DOUBLE) AS burden, n + 2 + greatest(0, exceptions - 1) + 3 + 1 AS complexity, round(n / greatest(CAST(n + 2 + greatest(0, exceptions - 1) + 3 + 1 AS DOUBLE), 1.0), 6) AS compression FROM p""")
def knowledge_costs(spark, d):
    """Burden of plans, complexity of items, and how many states a unit of it serves."""
    rows = fx.table(spark, d, "lineitem").join(fx.table(spark, d, "orders"), F.col("o_orderkey") == F.col("l_orderkey"))
    kind = F.when(F.col("o_orderkey") % 3 == 0, "pawn_move").when(F.col("o_orderkey") % 3 == 1, "castle").otherwise("capture")
    plans = rows.groupBy(F.col("o_custkey").alias("plan")).agg(F.collect_list(kind).alias("kinds"), F.count_if(F.col("l_returnflag") == "R").alias("exceptions"))
    n, cost = F.size("kinds").cast("long"), campaign.complexity(F.size("kinds").cast("long"), F.lit(2).cast("long"), F.col("exceptions"), F.lit(3).cast("long"), F.lit(1).cast("long"))
    return rounded(plans.select("plan", campaign.plan_burden(F.col("kinds"), F.col("exceptions")).alias("burden"), cost.alias("complexity"), campaign.compression_ratio(n, cost.cast("double")).alias("compression")))


@query(fx.SQL + """, st AS (SELECT source, structure, least(1, sum(enter)) AS coverage, CAST(sum(paths) AS BIGINT) AS paths FROM reach JOIN nodes USING (state) LEFT JOIN enter USING (source, state) GROUP BY source, structure)
    SELECT source, structure, round(coverage, 6) AS coverage, paths, round(coverage * 2.0 * (1 + log10(1 + paths)), 6) AS score FROM st WHERE coverage IS NOT NULL""")
def attractor_scores(spark, d):
    """Coverage, paths and the score of each structure, for a dwell of two plies."""
    _, edges, nodes = _graph(spark, d)
    rows = graph.flow(edges, nodes).join(nodes, "state").groupBy("source", "structure").agg(F.least(F.lit(1.0), F.sum("enter")).alias("coverage"), F.sum("paths").alias("paths"))
    return rounded(rows.withColumn("score", v.attractor_score(F.col("coverage"), F.lit(2.0), F.col("paths"))))
