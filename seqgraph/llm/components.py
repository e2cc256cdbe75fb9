"""Connected components of a link table by alternating stars, staged in the shared folder after each round."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import staged, unstage


def _least_neighbour(arcs: DataFrame) -> DataFrame:
    """u, v, m for each arc: m is the least of u and all its neighbours (aggregated before it is joined back)."""
    least = arcs.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
    return arcs.join(least, "u")


def _large_star(links: DataFrame) -> DataFrame:
    arcs = links.unionByName(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
    return _least_neighbour(arcs).where("v > u AND v > m").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()


def _small_star(links: DataFrame) -> DataFrame:
    """`links` lead from larger to smaller nodes already."""
    found = _least_neighbour(links)
    return found.select(F.explode(F.array("u", "v")).alias("u"), F.col("m").alias("v")).where("u > v").distinct()


def components(links: DataFrame, most_rounds: int = 60) -> DataFrame:
    """(node, root) for each node with a link; root is the least node of its component.

    `links` has columns u and v of one orderable type; self links and repeats are allowed, nulls take no part.
    Each round at least halves the distance to the roots; the loop ends when the link set no longer changes.
    """
    links = links.where("u IS NOT NULL AND v IS NOT NULL AND u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()
    links = staged(links, "links")
    mark = _mark(links)
    for _ in range(most_rounds):
        new = staged(_small_star(_large_star(links)), "links")
        unstage(links)
        links, last = new, mark
        mark = _mark(links)
        if mark == last:
            return links.select(F.col("u").alias("node"), F.col("v").alias("root"))
    raise RuntimeError(f"components did not settle in {most_rounds} rounds")


def _mark(links: DataFrame) -> tuple:
    """A fingerprint of the link set, whatever its order."""
    row = links.agg(F.count(F.lit(1)), F.expr("bit_xor(xxhash64(u, v))"), F.expr("sum(CAST(pmod(xxhash64(v, u), 1000003) AS BIGINT))")).first()
    return tuple(row)
