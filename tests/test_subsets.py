"""Strict subsets among many different sets, against brute force."""

import random

import pytest
from pyspark.sql import functions as F

from seqgraph.operators import selection, subsets


def _sets(spark, n, members, most, seed, odd=False):
    """Different sets with some of their halves: by class; as a table. `odd`: a few members are frequent, nulls are members."""
    rng = random.Random(seed)
    weights = [1 / (1 + i) if odd else 1 for i in range(members)]
    found = {frozenset(f"c{m}" for m in rng.choices(range(members), weights, k=rng.randint(1, most))) for _ in range(n)}
    found |= {frozenset(sorted(s)[: len(s) // 2 + 1]) for s in found}
    if odd:
        found |= {s | {None} for s in sorted(found, key=sorted)[::3]} | {frozenset([None])}
    key = lambda s: sorted(map(str, s))
    sets = {i * 7 + (i % 3 << 33): s for i, s in enumerate(sorted(found, key=key))}
    return sets, spark.createDataFrame([(i, sorted(s, key=str)) for i, s in sets.items()], "class long, members array<string>")


@pytest.mark.parametrize("n, members, most, odd", [(250, 90, 60, False), (300, 200, 9, True), (200, 1500, 3, False), (60, 3, 3, True)])
def test_parts_find_all_pairs(spark, n, members, most, odd):
    """Whatever the buckets and parts, rare and frequent members, nulls among them."""
    sets, table = _sets(spark, n, members, most, n, odd)
    want = sorted((a, b) for a, x in sets.items() for b, y in sets.items() if x < y)
    for limits in [(subsets.SMALLS, subsets.LARGES), (16, 64), (5, 1000)]:
        assert sorted(map(tuple, subsets.class_pairs(table, *limits).collect())) == want != [], limits


def test_different_sets_are_not_joined(spark):
    """Sets over few members all share some: their pairs come from bitmaps, no join makes or checks them."""
    sets, table = _sets(spark, 300, 40, 20, 1)
    pairs = selection._class_pairs(table.withColumns({"sign": F.col("class"), "size": F.size("members"), "copies": F.lit(1)}))
    assert pairs.count() == sum(x < y for x in sets.values() for y in sets.values())
    assert "Join" not in pairs._jdf.queryExecution().optimizedPlan().toString()


def test_no_sets(spark):
    empty = spark.createDataFrame([], "id long, members array<string>")
    assert selection.containment(empty).count() == selection.containers(empty).count() == 0
