"""Queries over a job ledger: claims, leases, promotions, budgets."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..sources import sinks
from . import fixture as fx
from .catalog import query, rounded

#: Orders as jobs: priority is the tier, the status the state (O open, P leased, F done), the date the lease's start.
TIERS = ("1-URGENT", "2-HIGH", "3-MEDIUM")


def _jobs(spark, d):
    return fx.table(spark, d, "orders").select(F.col("o_orderkey").alias("job"), F.col("o_orderpriority").alias("tier"), F.col("o_orderstatus").alias("state"), F.col("o_orderdate").alias("since"), F.col("o_totalprice").alias("nodes"), F.col("o_custkey").alias("worker"))


@query("""SELECT job, CAST(place AS INTEGER) AS place FROM (SELECT o_orderkey AS job, row_number() OVER (PARTITION BY o_custkey ORDER BY CASE o_orderpriority WHEN '1-URGENT' THEN 0 WHEN '2-HIGH' THEN 1 WHEN '3-MEDIUM' THEN 2 ELSE 3 END, o_totalprice, o_orderkey) AS place
    FROM orders WHERE o_orderstatus = 'O') WHERE place <= 2""")
def claim_order(spark, d):
    """The next two jobs of each worker's queue: by tier, then cost, then id."""
    tier = F.coalesce(*[F.when(F.col("tier") == t, F.lit(k)) for k, t in enumerate(TIERS)], F.lit(3))
    order = Window.partitionBy("worker").orderBy(tier, "nodes", "job")
    return _jobs(spark, d).where("state = 'O'").withColumn("place", F.row_number().over(order)).where("place <= 2").select("job", "place")


@query("""SELECT o_orderkey AS job, CASE WHEN o_orderstatus = 'F' THEN 'done' WHEN o_orderstatus = 'P' AND o_orderdate < TIMESTAMP '1996-01-01' THEN CASE WHEN o_orderkey % 4 >= 3 THEN 'failed' ELSE 'expired' END
    WHEN o_orderstatus = 'P' THEN 'leased' ELSE 'open' END AS state FROM orders""")
def lease_states(spark, d):
    """Leases before a date have expired; a job that was tried three times has failed. Done is never overwritten."""
    expired = (F.col("state") == "P") & (F.col("since") < F.lit("1996-01-01").cast("timestamp"))
    state = F.when(F.col("state") == "F", "done").when(expired & (F.col("job") % 4 >= 3), "failed").when(expired, "expired").when(F.col("state") == "P", "leased").otherwise("open")
    return _jobs(spark, d).select("job", state.alias("state"))


@query("""WITH best AS (SELECT o_custkey AS worker, max(o_totalprice) AS best FROM orders GROUP BY 1), c AS (SELECT o.o_custkey AS worker, o.o_orderkey AS job, best - o_totalprice AS gap, row_number() OVER (PARTITION BY o.o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS n
        FROM orders o JOIN best b ON b.worker = o.o_custkey)
    SELECT c.job, CASE WHEN EXISTS (SELECT 1 FROM lineitem l WHERE l.l_orderkey = c.job AND l.l_returnflag = 'R') THEN 'known' WHEN round(gap, 2) <= 20000 THEN 'promoted' ELSE 'clear' END AS decision FROM c WHERE n = 2""")
def promotions(spark, d):
    """The second best of each group goes one budget deeper if it is close, at most once, and not if it is known already."""
    order = Window.partitionBy("worker").orderBy(F.desc("nodes"), "job")
    rows = _jobs(spark, d).withColumn("n", F.row_number().over(order)).withColumn("gap", F.max("nodes").over(Window.partitionBy("worker")) - F.col("nodes")).where("n = 2")
    known = fx.table(spark, d, "lineitem").where("l_returnflag = 'R'").select(F.col("l_orderkey").alias("job")).distinct().withColumn("_known", F.lit(True))
    decision = F.when(F.col("_known"), "known").when(F.round("gap", 2) <= 20000, "promoted").otherwise("clear")
    return rows.join(known, "job", "left").select("job", decision.alias("decision"))


@query("""SELECT o_orderkey AS job, CASE WHEN abs(o_totalprice - 100000) / 100000 <= 0.02 THEN 100000 WHEN abs(o_totalprice - 200000) / 200000 <= 0.02 THEN 200000 WHEN abs(o_totalprice - 400000) / 400000 <= 0.02 THEN 400000 END AS budget FROM orders""")
def budget_snapping(spark, d):
    """Work within 2 % of a nominal budget counts as that budget; null otherwise."""
    near = lambda b: F.abs(F.col("nodes") - b) / b <= 0.02
    return _jobs(spark, d).select("job", F.coalesce(*[F.when(near(b), F.lit(b)) for b in (100000, 200000, 400000)]).alias("budget"))


@query("""WITH have AS (SELECT o_orderkey AS job FROM orders WHERE o_orderkey % 3 = 0), offered AS (SELECT o_orderkey AS job FROM orders WHERE o_orderkey % 2 = 0)
    SELECT count(*) AS offered, count(*) FILTER (job NOT IN (SELECT job FROM have)) AS inserted, count(*) FILTER (job IN (SELECT job FROM have)) AS skipped FROM offered""")
def idempotent_import(spark, d):
    """Importing twice changes nothing: rows whose key exists are skipped and counted."""
    jobs = _jobs(spark, d).select("job")
    return sinks.insert_missing(jobs.where("job % 3 = 0"), jobs.where("job % 2 = 0"), ["job"])[1]


@query("""SELECT o_orderpriority AS tier, count(*) AS jobs, round(sum(o_totalprice) * 1000 / 505000 / 3600, 4) AS hours, round(sum(o_totalprice) * 1000, 0) AS nodes FROM orders WHERE o_orderstatus <> 'F' GROUP BY 1""")
def campaign_projection(spark, d):
    """What is left to do, in nodes and in hours at a given speed."""
    nodes = F.sum(F.col("nodes")) * 1000
    rows = _jobs(spark, d).where("state <> 'F'").groupBy("tier").agg(F.count(F.lit(1)).alias("jobs"), F.round(nodes / 505000 / 3600, 4).alias("hours"), F.round(nodes, 0).alias("nodes"))
    return rounded(rows)
