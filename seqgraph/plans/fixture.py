"""The event tables as sequences: games of three days a user, states from their actions, and the same as SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import sequences as seq

STRUCTURE = ("purchase", "signup")
#: An action needs so many games to be evaluated.
EVAL_GAMES = 5


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    day = F.datediff(F.col("ts").cast("date"), F.lit("2024-01-01").cast("date"))
    game = F.col("user_id") * 100 + F.floor(day / 3)
    return table(spark, sf_dir, "events").select(game.alias("game"), "user_id", "ts", "event_id", "event_type", F.round(F.col("value") * 100).cast("long").alias("cents"))


def games(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = events(spark, sf_dir).groupBy(F.col("game").alias("game_id")).agg(F.sum("cents").alias("_c"), F.max("user_id").alias("_u"), F.min("ts").alias("_t"))
    return rows.select("game_id", F.pmod("_c", F.lit(3)).cast("int").alias("outcome"), (F.pmod("_u", F.lit(3)) == 0).alias("strong"), F.date_format("_t", "yyyyMMdd").cast("int").alias("day_ord"))


def first_visits(spark: SparkSession, sf_dir: str, last_actions: int = 0) -> DataFrame:
    """game_id, ply, state, structure, action, next_state, outcome, strong: each game once at each state, over whole games."""
    steps = seq.number_steps(events(spark, sf_dir), "game", ["ts", "event_id"], "event_type", STRUCTURE, last_actions)
    first = seq.first_visits(seq.visits(steps))
    return first.join(games(spark, sf_dir), "game_id")


def edges(spark: SparkSession, sf_dir: str, last_actions: int = 0) -> DataFrame:
    return seq.edges(first_visits(spark, sf_dir, last_actions))


def evals(edge_rows: DataFrame) -> DataFrame:
    """state, action, ep, n over all games."""
    rows = edge_rows.where("source = 'all'").groupBy(F.col("parent").alias("state"), "action").agg(F.sum("w").alias("w"), F.sum("d").alias("d"), F.sum("games").alias("n"))
    return rows.where(F.col("n") >= EVAL_GAMES).select("state", "action", ((F.col("w") + F.col("d") / 2) / F.col("n")).alias("ep"), "n")


# --- the same in SQL -------------------------------------------------------------------------------------------------

def _sql(last_actions: int) -> str:
    if last_actions:
        past = f"list(action) OVER (PARTITION BY game_id ORDER BY ts, event_id ROWS BETWEEN {last_actions} PRECEDING AND 1 PRECEDING)"
        upto = f"list(action) OVER (PARTITION BY game_id ORDER BY ts, event_id ROWS BETWEEN {last_actions - 1} PRECEDING AND CURRENT ROW)"
    else:
        past = "list_sort(list(action) OVER (PARTITION BY game_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))"
        upto = "list_sort(list(action) OVER (PARTITION BY game_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW))"
    count = lambda a, end: f"CAST(coalesce(sum(CASE WHEN action = '{a}' THEN 1 ELSE 0 END) OVER (PARTITION BY game_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND {end}), 0) AS VARCHAR)"
    structure = lambda end: " || ',' || ".join(count(a, end) for a in STRUCTURE)
    return f"""
ev AS (SELECT user_id * 100 + date_diff('day', DATE '2024-01-01', CAST(ts AS DATE)) // 3 AS game_id, user_id, ts, event_id,
         event_type AS action, CAST(round(value * 100) AS BIGINT) AS cents FROM events),
games AS (SELECT game_id, CAST(((sum(cents) % 3) + 3) % 3 AS INTEGER) AS outcome, max(user_id) % 3 = 0 AS strong,
         CAST(strftime(min(ts), '%Y%m%d') AS INTEGER) AS day_ord FROM ev GROUP BY game_id),
steps AS (SELECT game_id, row_number() OVER (PARTITION BY game_id ORDER BY ts, event_id) - 1 AS ply, action,
         coalesce(array_to_string({past}, '|'), '') AS state, array_to_string({upto}, '|') AS next_state,
         {structure('1 PRECEDING')} AS structure, {structure('CURRENT ROW')} AS next_structure,
         lead(1) OVER (PARTITION BY game_id ORDER BY ts, event_id) IS NULL AS is_last FROM ev),
visits AS (SELECT game_id, ply, state, structure, action, next_state FROM steps
         UNION ALL SELECT game_id, ply + 1, next_state, next_structure, NULL, NULL FROM steps WHERE is_last),
fv AS (SELECT v.* EXCLUDE (n), outcome, strong FROM (SELECT *, row_number() OVER (PARTITION BY game_id, state ORDER BY ply) AS n FROM visits) v
         JOIN games USING (game_id) WHERE n = 1),
fvs AS (SELECT *, 'all' AS source FROM fv UNION ALL SELECT *, CASE WHEN strong THEN 'expert' ELSE 'population' END FROM fv),
edges AS (SELECT source, state AS parent, action, next_state AS child, count(*) AS games, count(*) FILTER (outcome = 0) AS w,
         count(*) FILTER (outcome = 1) AS d, count(*) FILTER (outcome = 2) AS b FROM fvs WHERE action IS NOT NULL GROUP BY ALL),
nodes AS (SELECT state, min(ply) AS min_ply, min(ply) % 2 AS role, arg_min(structure, ply) AS structure, min(ply) = 0 AS is_entry FROM fv GROUP BY state),
dist AS (SELECT source, parent AS state, action, CAST(sum(games) AS BIGINT) AS games, sum(games) / sum(sum(games)) OVER (PARTITION BY source, parent) AS p
         FROM edges GROUP BY source, parent, action),
evals AS (SELECT parent AS state, action, (sum(w) + sum(d) / 2.0) / sum(games) AS ep, sum(games) AS n FROM edges WHERE source = 'all'
         GROUP BY parent, action HAVING sum(games) >= {EVAL_GAMES}),
shares AS (SELECT e.*, e.games / sum(e.games) OVER (PARTITION BY e.source, e.parent) AS share, p.min_ply AS p_ply, c.min_ply AS c_ply,
         p.structure AS p_structure, c.structure AS c_structure, p.is_entry
         FROM edges e JOIN nodes p ON p.state = e.parent LEFT JOIN nodes c ON c.state = e.child),
paths AS (SELECT DISTINCT source, '' AS state, 1.0::DOUBLE AS m, 1::HUGEINT AS n FROM edges
         UNION ALL SELECT s.source, s.child, sum(p.m * s.share), sum(p.n)
         FROM paths p JOIN shares s ON s.source = p.source AND s.parent = p.state AND s.c_ply > s.p_ply GROUP BY s.source, s.child),
reach AS (SELECT source, state, sum(m) AS reach, CAST(sum(n) AS BIGINT) AS paths FROM paths GROUP BY source, state),
enter AS (SELECT source, state, sum(m) AS enter FROM (SELECT r.source, r.state, r.reach AS m FROM reach r JOIN nodes USING (state) WHERE is_entry
         UNION ALL SELECT s.source, s.child, r.reach * s.share FROM reach r JOIN shares s ON s.source = r.source AND s.parent = r.state
         WHERE s.c_ply > s.p_ply AND s.c_structure <> s.p_structure) GROUP BY source, state)"""


#: Common table expressions of the multiset-state binding, and of the one whose states are the last two actions.
SQL = "WITH RECURSIVE " + _sql(0).strip()
SQL_CYCLIC = "WITH RECURSIVE " + _sql(2).strip()

#: The most likely line to each state, level by level (all plies of a level are done when it is extended).
LINES = """, lines AS (SELECT DISTINCT source, '' AS state, {'cost': 0.0::DOUBLE, 'line': '', 'logp': 0.0::DOUBLE} AS best FROM edges
         UNION ALL SELECT s.source, s.child, min({'cost': round(-(p.best.logp + ln(s.share)), 9), 'line': trim(p.best.line || ' ' || s.action), 'logp': p.best.logp + ln(s.share)})
         FROM lines p JOIN shares s ON s.source = p.source AND s.parent = p.state AND s.c_ply > s.p_ply GROUP BY s.source, s.child)"""
