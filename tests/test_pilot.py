"""Evaluations at several budgets, scopes and set summaries: nulls, ties and empty tables against results by hand."""

from pyspark.sql import functions as F

from seqgraph.operators import lines, pilot


def rows(df):
    return sorted(map(tuple, df.collect()), key=str)


def test_thresholds_and_lists(spark):
    df = spark.createDataFrame([("local", None), ("cloud", 30), ("cloud", 29), (None, 40), (None, None)], "s string, d int")
    assert [r[0] for r in df.select(pilot.meets_threshold(F.col("s"), F.col("d"), "local")).collect()] == [True, True, False, True, False]
    both = spark.createDataFrame([(["b", "a"], ["a", "c", "b"]), (None, ["x"]), ([], None)], "a array<string>, b array<string>")
    assert [r[0] for r in both.select(pilot.joined_lists(F.col("a"), F.col("b"))).collect()] == [["b", "a", "c"], ["x"], []]


def test_budget_losses(spark):
    evals = spark.createDataFrame([("s", 1, "a", 0.6), ("s", 1, "b", 0.4), ("s", 2, "b", 0.5), ("t", 1, "a", 0.1)], "state string, budget int, action string, ep double")
    taught = spark.createDataFrame([("s", "a"), ("s", "b"), ("s", "b"), ("t", "z"), (None, "a")], "state string, action string")
    got = {(s, b): round(v, 9) for s, b, v in rows(pilot.budget_losses(evals, taught))}
    assert got == {("s", 1): 0.1, ("s", 2): 0.0}
    assert pilot.budget_losses(evals.where("false"), taught).count() == 0


def test_cached_pilot(spark):
    evals = spark.createDataFrame(
        [("s", "x", 20, "a", 0.7), ("s", "x", 20, "b", 0.5), ("s", "y", 10, "a", 0.1), ("s", "y", 10, "b", 0.9), ("t", "x", 9, "a", 0.5), ("u", "x", 5, "a", 0.5), ("u", "x", 5, "b", 0.5), ("v", "x", 5, "a", 0.5), ("v", "x", 5, "b", None)],
        "state string, source string, depth long, action string, ep double",
    )
    dist = spark.createDataFrame([("s", "a", 0.5), ("s", "b", 0.25), ("s", "c", 0.25), ("t", "a", 1.0)], "state string, action string, p double")
    got = {r["state"]: (r["depth"], r["actions"], r["loss"] and round(r["loss"], 9), r["coverage"]) for r in pilot.cached_pilot(evals, dist).collect()}
    assert got == {"s": (20, 2, round(0.05 / 0.75, 9), 0.75), "u": (5, 2, None, None)}


def test_lines_and_scopes(spark):
    edges = spark.createDataFrame([("a", "m", 5, "b"), ("a", "k", 5, "c"), ("b", "m", 9, "a"), ("c", "n", 1, "d")], "parent string, action string, games long, child string")
    starts = spark.createDataFrame([("F", "a"), ("G", "b"), ("H", "d")], "family string, state string")
    got = {}
    for f, ply, _, action, _ in rows(pilot.representative_lines(starts, edges, 4)):
        got.setdefault(f, {})[ply] = action
    assert got == {"F": {0: "k", 1: "n"}, "G": {0: "m", 1: "k", 2: "n"}}
    loop = pilot.representative_lines(starts.where("family = 'F'"), edges.where("action = 'm'"), 5)
    assert loop.count() == 5
    plans = spark.createDataFrame([("p", "F", 0), ("q", "F", None), ("r", None, 0)], "plan string, family string, side int")
    boards = spark.createDataFrame([("a", "F", 0, None), ("b", "F", 1, 0.5), ("c", "F", 0, 0.5), ("d", None, 0, 1.0)], "state string, family string, role int, reach double")
    known = spark.createDataFrame([("a",), ("b",), ("b",), ("d",)], "state string")
    assert rows(pilot.plan_scope(plans, boards, known)) == [("p", "a", 0.0), ("q", "a", 0.0), ("q", "b", 0.5)]
    dist = spark.createDataFrame([("b", "x", 1.0)], "state string, action string, p double")
    weights = {r["state"]: (r["weight"], r["action"]) for r in pilot.family_samples(boards, dist).collect()}
    assert weights["a"] == (1e-9, None) and weights["b"] == (0.5, "x")
    ranked = spark.createDataFrame([("i", 2), ("j", 1), ("k", 9)], "item string, rank int")
    cells = spark.createDataFrame([("i", "s"), ("j", "s"), ("i", "s"), ("k", "s"), ("k", "t")], "item string, state string")
    assert rows(pilot.frontier_scope(ranked, cells)) == [("s", ["j", "i"])]


def test_destinations(spark):
    moves = spark.createDataFrame([("F", "N", "g1", "f3", 2.0), ("F", "N", "g1", "f3", 1.0), ("F", "B", "c1", "f4", 1.0), ("Z", "N", "g1", "f3", 0.0)], "family string, piece string, origin string, target string, weight double")
    assert rows(pilot.destinations(moves, 1)) == [("F", "N", "g1", "f3", 0.75), ("Z", "N", "g1", "f3", None)]


def test_set_summary(spark):
    cells = spark.createDataFrame([("A", "i", "s", 0.1, 0.5), ("A", "j", "s", 0.2, 0.7), ("A", "j", "t", None, 1.0), ("B", "i", "gone", 0.1, 1.0)], "set string, item string, state string, loss double, explained double")
    boards = spark.createDataFrame([("s", 0.5, 0.3), ("t", 0.5, 0.1)], "state string, reach double, loss_pop double")
    parts = spark.createDataFrame([("A", "p", 1.5), ("A", "p", 1.5), ("A", "q", 0.5)], "set string, part string, weight double")
    got = {r["set"]: r for r in pilot.set_summary(cells, boards, parts).collect()}
    a, b = got["A"], got["B"]
    assert (a["items"], a["burden"], a["positions"]) == (2, 2.0, 2) and abs(a["value"] - 0.1) < 1e-12 and abs(a["recovery"] - 0.5) < 1e-12
    assert abs(a["behaviour_fraction"] - 0.85) < 1e-12 and abs(a["value_per_burden"] - 0.05) < 1e-12
    assert b["items"] == 1 and b["burden"] is None and b["value_per_burden"] is None


def test_line_filters(spark):
    entries = spark.createDataFrame([("s1", "Alpha: One", "C10", "Alpha: One"), ("s2", "Alpha: Two", "C11", "Alpha: Two"), ("s3", "Beta", "C12", "Beta")], "state string, name string, ecos string, aliases string")
    mains = spark.createDataFrame([("Alpha: One",), ("Beta",), ("Beta",)], "name string")
    twins = spark.createDataFrame([("s3",)], "state string")
    found = lambda **k: [r["state"] for r in lines.matching(entries, "a", "C", **k).orderBy("state").collect()]
    assert found() == ["s1", "s2", "s3"] and found(mains=mains) == ["s1", "s3"] and found(mains=mains, twins=twins) == ["s3"]
