"""Sets and groups with very many copies: classes are compared, copies are dealt out or counted."""

from pyspark.sql import functions as F

from seqgraph.operators import selection


def test_containment_compares_classes(spark, tmp_path):
    """Copies add rows of the result, but none to what is compared."""
    sets = spark.range(300).select("id", F.when(F.col("id") % 3 == 0, F.array(F.lit("a"))).when(F.col("id") % 3 == 1, F.array(F.lit("b"), F.lit("a"), F.lit("b"))).otherwise(F.array(F.lit("c"), F.lit("a"))).alias("members"))
    held, classes = selection._classes(sets)
    assert held.count() == 300 and sorted((r["size"], r["copies"]) for r in classes.collect()) == [(1, 100), (2, 100), (2, 100)]
    assert selection._class_pairs(classes).count() == 2
    got = [(r["small"], r["large"]) for r in selection.containment(sets).collect()]
    want = {(a, b) for a in range(0, 300, 3) for b in range(300) if b % 3}
    assert len(got) == len(want) and set(got) == want


def test_containers_of_many_copies(spark):
    """10^10 pairs are counted without being made."""
    sets = spark.range(200_000).select("id", F.when(F.col("id") % 2 == 0, F.array(F.lit("a"))).otherwise(F.array(F.lit("a"), F.lit("b"))).alias("members"))
    got = selection.containers(sets).agg(F.count("id").alias("sets"), F.min("n").alias("least"), F.max("n").alias("most"), F.max(F.col("id") % 2).alias("odd")).first()
    assert tuple(got) == (100_000, 100_000, 100_000, 0)


def test_audit_counts(spark, small):
    """The counts are those of the audit's own rows, schemas within schemas included."""
    from seqgraph.operators import course
    from seqgraph.plans.course import _course

    tables = _course(spark, small)
    key = lambda rows: sorted((r["budget"], r["finding"], r["n"]) for r in rows)
    want = key(course.audit(*tables).groupBy("budget", "finding").agg(F.count(F.lit(1)).alias("n")).collect())
    assert any(f == "redundant_undeclared" and n > 1 for _, f, n in want)
    assert key(course.audit_counts(*tables).collect()) == want


def test_dealt_labels_are_the_ranked_ones(spark):
    """Groups dealt within a task and groups ranked by windows draw the same labels: nulls, weights and single rows too."""
    from seqgraph.operators import mining

    rows = [(None if i == 5 else i, "ab"[i % 7 == 0] + str(i // 60), None if i % 11 == 0 else "xyz"[i % 3], "pq"[i % 5 > 1], 1.0 + i % 2) for i in range(121)]
    base = spark.createDataFrame(rows, "id long, g string, y string, f string, w double").withColumn("id", F.col("id").cast("string"))
    cells = lambda df: sorted(map(str, df.groupBy("g", "perm", "y", "f").agg(F.sum("w").alias("w")).collect()))
    assert cells(mining._dealt(base, 9)) == cells(mining._ranked(base, 9))
    test = lambda most: sorted(map(tuple, mining.permutation_test(base, "g", "y", "f", "w", "id", 9, most).collect()))
    assert [(g, round(mi, 9), p) for g, mi, p in test(0)] == [(g, round(mi, 9), p) for g, mi, p in test(20)] == [(g, round(mi, 9), p) for g, mi, p in test(1000)]


def test_dealt_labels_of_equal_first_bits(spark):
    """Hashes that are equal in the bits that are sorted are told apart by all of them."""
    from seqgraph.operators import mining

    rows = [(None if i == 5 else str(i), "ab"[i % 7 == 0], None if i % 11 == 0 else "xyz"[i % 3], "pq"[i % 5 > 1], 1.0 + i % 2) for i in range(121)]
    base = spark.createDataFrame(rows, "id string, g string, y string, f string, w double")
    cells = lambda df: sorted(map(str, df.groupBy("g", "perm", "y", "f").agg(F.sum("w").alias("w")).collect()))
    want = cells(mining._ranked(base, 9))
    assert [bits for bits in (1, 3, 8, 64) if cells(mining._dealt(base, 9, bits)) != want] == []


def test_labels_are_dealt_once(spark):
    from seqgraph.operators import mining

    base = spark.range(40).selectExpr("cast(id as string) AS id", "'a' AS g", "cast(id % 3 as string) AS y", "cast(id % 2 as string) AS f", "1.0D AS w")
    plan = mining.permutation_test(base, "g", "y", "f", "w", "id", 5)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("FlatMapGroupsInArrow") <= 1
