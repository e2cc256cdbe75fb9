"""Values, divergences, scalars and bitboards."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import bitboards as bb, values as v
from ..operators import graph, metrics, sequences as seq
from . import fixture as fx
from .catalog import query, rounded


def _views(spark, d):
    edges = graph.cut(fx.edges(spark, d))
    return edges, metrics.distributions(edges), fx.evals(edges)


def _reach(spark, d):
    first = graph.cut(fx.first_visits(spark, d))
    return graph.flow(graph.cut(seq.edges(first)), graph.cut(seq.nodes(first)))


REGRET = """, best AS (SELECT state, max(ep) AS best_ep FROM evals GROUP BY state),
    regret AS (SELECT source, state, sum(p * greatest(0, best_ep - ep)) / sum(p) AS regret, max(best_ep) AS best_ep, sum(p) AS mass_covered, count(*) AS n
        FROM dist JOIN evals USING (state, action) JOIN best USING (state) GROUP BY source, state)"""


@query(fx.SQL + REGRET + " SELECT source, state, round(round(regret, 12), 6) AS regret, round(best_ep, 6) AS best_ep, round(mass_covered, 6) AS mass_covered, n FROM regret")
def expected_regret(spark, d):
    _, dist, evals = _views(spark, d)
    return rounded(rounded(metrics.expected_regret(dist, evals), 12))


@query(fx.SQL + REGRET + """, both_ AS (SELECT state, max(regret) FILTER (source = 'expert') AS e, max(regret) FILTER (source = 'population') AS p FROM regret GROUP BY state)
    SELECT b.state, round(round(e, 12), 6) AS expert_regret, round(round(p, 12), 6) AS population_regret, round(round(p - e, 12), 6) + 0 AS gap, round(round(r.reach, 12), 6) AS reach,
    round(round(r.reach * CASE WHEN p - e IS NULL THEN 0 ELSE greatest(p - e, 0) END, 12), 6) AS priority FROM both_ b LEFT JOIN reach r ON r.state = b.state AND r.source = 'population'""")
def study_priority(spark, d):
    """Population regret over the experts': a gap is null where either is unknown; then it adds no priority."""
    _, dist, evals = _views(spark, d)
    # twice rounded on both sides: a value at half a digit doesn't hang on the order of a sum
    return rounded(rounded(metrics.gaps(metrics.expected_regret(dist, evals), _reach(spark, d)), 12))


PAIRS = """, known AS (SELECT state FROM dist WHERE source = 'expert' INTERSECT SELECT state FROM dist WHERE source = 'population'),
    pairs AS (SELECT state, action, coalesce(a.p, 0) AS p, coalesce(b.p, 0) AS q FROM (SELECT * FROM dist WHERE source = 'expert') a
        FULL JOIN (SELECT * FROM dist WHERE source = 'population') b USING (state, action) WHERE state IN (SELECT state FROM known))"""


@query(fx.SQL + PAIRS + """ SELECT state, round(sum(CASE WHEN p > 0 THEN p * log2(2 * p / (p + q)) ELSE 0 END + CASE WHEN q > 0 THEN q * log2(2 * q / (p + q)) ELSE 0 END) / 2, 6) + 0 AS js,
    round(sum(least(p, q)), 6) AS overlap, round(sum(abs(p - q)) / 2, 6) AS tv,
    round(CASE WHEN count(*) FILTER (p > 0 AND q = 0) = 0 THEN sum(CASE WHEN p > 0 AND q > 0 THEN p * log2(p / q) ELSE 0 END) END, 6) + 0 AS kl FROM pairs GROUP BY state""")
def divergences(spark, d):
    _, dist, _ = _views(spark, d)
    return rounded(metrics.divergence(metrics.paired(dist, "expert", "population")))


@query(fx.SQL + PAIRS + """, sh AS (SELECT *, rank() OVER (PARTITION BY state ORDER BY p) + (count(*) OVER (PARTITION BY state, p) - 1) / 2.0 AS rp,
        rank() OVER (PARTITION BY state ORDER BY q) + (count(*) OVER (PARTITION BY state, q) - 1) / 2.0 AS rq FROM pairs WHERE p > 0 AND q > 0),
    st AS (SELECT state, count(*) AS n, corr(p, q) AS pearson, corr(rp, rq) AS spearman, stddev_pop(p) AS sp, stddev_pop(q) AS sq, stddev_pop(rp) AS srp, stddev_pop(rq) AS srq FROM sh GROUP BY state),
    kt AS (SELECT a.state, sum(sign((a.p - b.p) * (a.q - b.q))) / count(*) AS kendall FROM sh a JOIN sh b ON a.state = b.state AND a.action < b.action GROUP BY a.state)
    SELECT st.state, n, round(kendall, 4) + 0 AS kendall, CASE WHEN n >= 3 AND sp > 1e-12 AND sq > 1e-12 THEN round(pearson, 4) + 0 END AS pearson,
    CASE WHEN n >= 3 AND srp > 1e-12 AND srq > 1e-12 THEN round(spearman, 4) + 0 END AS spearman FROM st LEFT JOIN kt USING (state)""")
def rank_agreement(spark, d):
    _, dist, _ = _views(spark, d)
    return rounded(metrics.rank_agreement(metrics.paired(dist, "expert", "population")), 4)


@query(fx.SQL + " SELECT source, state, round(-sum(p * log2(p)), 6) + 0 AS entropy, round(pow(2, -sum(p * log2(p))), 6) AS effective FROM dist WHERE p > 0 GROUP BY source, state")
def entropies(spark, d):
    _, dist, _ = _views(spark, d)
    return rounded(metrics.entropy(dist))


@query(fx.SQL + """, k AS (SELECT *, p >= 0.15 OR games >= 30 AS keep FROM dist), t AS (SELECT *, coalesce(sum(p) FILTER (NOT keep) OVER w, 0) AS dropped, sum(p) FILTER (keep) OVER w AS total FROM k WINDOW w AS (PARTITION BY source, state))
    SELECT source, state, action, games, round(p / total, 6) AS p, round(dropped, 6) AS dropped FROM t WHERE keep""")
def pruned_moves(spark, d):
    """An action goes only if it is rare by share and by games; what went is told."""
    _, dist, _ = _views(spark, d)
    return rounded(metrics.prune(dist, 0.15, 30))


@query(fx.SQL + """, best AS (SELECT state, max(ep) AS best_ep FROM evals GROUP BY state), ex AS (SELECT state, action, p AS expert_p FROM dist WHERE source = 'expert'),
    dv AS (SELECT d.state, d.action, d.p, ex.expert_p, best_ep - ep AS loss, r.reach FROM dist d LEFT JOIN ex USING (state, action) LEFT JOIN evals e USING (state, action)
        LEFT JOIN best USING (state) LEFT JOIN reach r ON r.source = 'population' AND r.state = d.state WHERE d.source = 'population' AND coalesce(expert_p, 0) < 0.2)
    SELECT state, action, round(p, 6) AS p, round(expert_p, 6) AS expert_p, round(loss, 6) + 0 AS loss,
    CASE WHEN loss IS NULL THEN 'unknown' WHEN loss <= 0.02 THEN 'playable' WHEN loss <= 0.10 THEN 'inaccurate' ELSE 'punishable' END AS class, round(reach * p * loss, 6) + 0 AS priority FROM dv""")
def deviations(spark, d):
    _, dist, evals = _views(spark, d)
    return rounded(metrics.deviations(dist, evals, _reach(spark, d), 0.2))


@query(fx.SQL + """, r AS (SELECT state, action, ep, row_number() OVER w AS rank, ep - lead(ep, 1) OVER w AS gap2, ep - lead(ep, 2) OVER w AS gap3 FROM evals WINDOW w AS (PARTITION BY state ORDER BY ep DESC, action))
    SELECT state, action, round(ep, 6) AS ep, CAST(rank AS INTEGER) AS rank, round(gap2, 6) AS gap2, round(gap3, 6) AS gap3,
    CASE WHEN rank = 1 AND gap3 <= 0.015 THEN 'deepest' WHEN rank = 1 AND gap2 <= 0.03 THEN 'deeper' ELSE 'keep' END AS tier FROM r""")
def ranked_actions(spark, d):
    return rounded(metrics.ranked_actions(_views(spark, d)[2]))


@query(fx.SQL + " SELECT source, state, action, round(p, 6) AS p, CAST(rank AS INTEGER) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY source || ':' || state ORDER BY p DESC, action) AS rank FROM dist) WHERE rank <= 2")
def top_actions(spark, d):
    _, dist, _ = _views(spark, d)
    return rounded(metrics.top_per_group(dist.withColumn("g", F.concat_ws(":", "source", "state")), "g", 2, F.desc("p"), "action").select("source", "state", "action", "p", "rank"))


@query(fx.SQL + """ SELECT parent AS state, action, games, round((w / games + 1.9208 / games) / (1 + 3.8416 / games) - 1.96 * sqrt(w / games * (1 - w / games) / games + 3.8416 / (4.0 * games * games)) / (1 + 3.8416 / games), 6) + 0 AS lo,
    round((w / games + 1.9208 / games) / (1 + 3.8416 / games) + 1.96 * sqrt(w / games * (1 - w / games) / games + 3.8416 / (4.0 * games * games)) / (1 + 3.8416 / games), 6) AS hi FROM edges WHERE source = 'all'""")
def wilson_intervals(spark, d):
    rows = fx.edges(spark, d).where("source = 'all'")
    lo, hi = v.wilson(F.col("w"), F.col("games"))
    return rounded(rows.select(F.col("parent").alias("state"), "action", "games", lo.alias("lo"), hi.alias("hi")))


@query("""SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber, cp, mate, round(1 / (1 + pow(10.0, -cp / 400.0)), 6) AS ep_cp, round(CASE WHEN mate > 0 THEN 1.0 WHEN mate <= 0 THEN 0.0 ELSE 1 / (1 + pow(10.0, -cp / 400.0)) END, 6) AS ep,
    round(1 - 1 / (1 + pow(10.0, -cp / 400.0)), 6) AS flipped, CASE WHEN mate IS NOT NULL THEN '#' || mate ELSE format('{:+.2f}', cp / 100.0) END AS shown
    FROM (SELECT *, CAST(l_extendedprice AS BIGINT) % 1201 - 600 AS cp, CASE WHEN l_partkey % 17 = 0 THEN l_partkey % 9 - 4 END AS mate FROM lineitem)""")
def value_scalars(spark, d):
    rows = fx.table(spark, d, "lineitem")
    cp, mate = F.col("cp"), F.col("mate")
    rows = rows.withColumn("cp", F.bround("l_extendedprice").cast("long") % 1201 - 600).withColumn("mate", F.when(F.col("l_partkey") % 17 == 0, F.col("l_partkey") % 9 - 4))
    none = F.lit(None).cast("double")
    return rounded(rows.select("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "cp", "mate", v.ep_from_cp(cp).alias("ep_cp"), v.ep_from_score(none, mate, cp).alias("ep"), v.flip_ep(v.ep_from_cp(cp)).alias("flipped"), v.eval_text(cp, mate).alias("shown")))


@query("""SELECT o_orderkey, sha1(o_orderkey || '|' || o_orderstatus) AS stable_id, round(('0x' || substr(sha256('s1:' || o_orderkey), 1, 8))::BIGINT / 4294967296.0, 6) AS draw,
    CAST(replace(substr(strftime(o_orderdate, '%Y-%m-%d'), 1, 7), '-', '') AS INTEGER) AS month, (o_orderkey % 64) | ((o_custkey % 64) << 6) | (3 << 12) AS packed, trim(split_part(o_orderpriority || ': x', ':', 1)) AS base FROM orders""")
def key_scalars(spark, d):
    rows = fx.table(spark, d, "orders")
    move = v.pack_move(F.col("o_orderkey") % 64, F.col("o_custkey") % 64, F.lit(3).cast("long"))
    return rounded(rows.select("o_orderkey", v.stable_id(F.col("o_orderkey"), F.col("o_orderstatus")).alias("stable_id"), v.hash_fraction("s1", F.col("o_orderkey")).alias("draw"), v.month_ordinal(F.date_format("o_orderdate", "yyyy-MM-dd")).alias("month"), move.alias("packed"), v.base_name(F.concat("o_orderpriority", F.lit(": x"))).alias("base")))


MASKS = "SELECT o_orderkey AS id, ((o_orderkey * 2654435761) % 281474976710656) << 8 AS w, ((o_custkey * 40503 + o_orderkey * 97) * 2654435761 % 281474976710656) << 8 AS b FROM orders"
_file = lambda m, f: f"bit_count({m} & (72340172838076673 << {f}))" if f < 7 else f"bit_count(({m} >> 7) & 72340172838076673)"
_isl = lambda m: " + ".join(f"CAST({_file(m, f)} > 0" + (f" AND {_file(m, f - 1)} = 0" if f else "") + " AS INTEGER)" for f in range(8))
_iso = lambda m: " + ".join("CASE WHEN " + " AND ".join(f"{_file(m, g)} = 0" for g in (f - 1, f + 1) if 0 <= g < 8) + f" THEN {_file(m, f)} ELSE 0 END" for f in range(8))
_dbl = lambda m: " + ".join(f"greatest({_file(m, f)} - 1, 0)" for f in range(8))


def _times(c, k: int):
    """c * k modulo 2^48 for any whole c that a long holds and k below 2^39: both halves of 24 bits are multiplied apart, so that no product leaves a long."""
    c, half = c.cast("long"), (1 << 24) - 1  # of an int, half times k may leave an int
    low, high = c.bitwiseAND(F.lit(half)), F.shiftright(c, 24).bitwiseAND(F.lit(half))
    return (F.shiftleft((high * F.lit(k)).bitwiseAND(F.lit(half)), 24) + low * F.lit(k)).bitwiseAND(F.lit((1 << 48) - 1))


def _masks(spark, d):
    """The SQL's masks; its products leave a long at customers from 85,000 on, here the remainder is exact for every key."""
    order, customer = F.col("o_orderkey"), F.col("o_custkey")
    w, b = _times(order, 2654435761), _times(_times(customer, 40503) + _times(order, 97), 2654435761)
    return fx.table(spark, d, "orders").select(order.alias("id"), F.shiftleft(w, 8).alias("w"), F.shiftleft(b, 8).alias("b"))


@query(f"""SELECT id, CAST({_isl('w')} AS INTEGER) AS islands, CAST({_iso('w')} AS INTEGER) AS isolated, CAST({_dbl('w')} AS INTEGER) AS doubled,
    CAST({" + ".join(f"CAST({_file('w', f)} = 0 AND {_file('b', f)} = 0 AS INTEGER)" for f in range(8))} AS INTEGER) AS open_files,
    CAST({" + ".join(f"CAST({_file('w', f)} = 0 AND {_file('b', f)} > 0 AS INTEGER)" for f in range(8))} AS INTEGER) AS semi_open,
    CAST(((w >> 27) & 1) | (((w >> 28) & 1) << 1) | (((w >> 35) & 1) << 2) | (((w >> 36) & 1) << 3) | (((b >> 27) & 1) << 4) | (((b >> 28) & 1) << 5) | (((b >> 35) & 1) << 6) | (((b >> 36) & 1) << 7) AS INTEGER) AS centre,
    CAST(bit_count(xor(w, b)) AS INTEGER) AS distance FROM ({MASKS})""")
def bitboard_features(spark, d):
    w, b = F.col("w"), F.col("b")
    return _masks(spark, d).select("id", bb.islands(w).alias("islands"), bb.isolated(w).alias("isolated"), bb.doubled(w).alias("doubled"), bb.open_files(w, b).alias("open_files"), bb.semi_open_files(w, b).alias("semi_open"), bb.centre(w, b).alias("centre"), bb.distance(w, b).alias("distance"))


@query(f"""WITH m AS ({MASKS}), s AS (SELECT i, sum(1::UBIGINT << CAST(j AS INTEGER)) AS ahead FROM range(56) a(i), range(64) b(j) WHERE j // 8 > i // 8 AND abs(j % 8 - i % 8) <= 1 GROUP BY i)
    SELECT id, CAST(sum(CASE WHEN ((w >> CAST(i AS INTEGER)) & 1) = 1 AND (b::UBIGINT & ahead::UBIGINT) = 0 THEN 1 ELSE 0 END) AS BIGINT) AS passed FROM m CROSS JOIN s WHERE bit_count(w) > 0 GROUP BY id""")
def passed_pawns(spark, d):
    """On all masks (their bits lie between 8 and 55); tests compare with brute force."""
    rows = _masks(spark, d).select("id", bb.passed(F.col("w"), F.col("b")).cast("long").alias("passed"), F.bit_count("w").alias("n"))
    return rows.where("n > 0").select("id", "passed")


@query(f"""SELECT s.i AS square, count(*) AS n, round(count(*) / (SELECT sum(bit_count(w)) FROM ({MASKS})), 6) AS share FROM ({MASKS}) m, range(64) s(i) WHERE (m.w >> s.i) & 1 = 1 GROUP BY s.i""")
def occupancy(spark, d):
    from pyspark.sql import Window

    rows = _masks(spark, d).select(F.explode(bb.squares(F.col("w"))).alias("square")).groupBy(F.col("square").cast("long").alias("square")).agg(F.count(F.lit(1)).alias("n"))
    return rounded(rows.withColumn("share", F.col("n") / F.sum("n").over(Window.partitionBy(F.lit(0)))))  # 64 rows
