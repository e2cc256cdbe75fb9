"""Hand-calculated cases and invariants."""

import math
import random

import pytest
from pyspark.sql import functions as F

from seqgraph.functions import bitboards as bb, values as v
from seqgraph.operators import graph, metrics, mining, selection, sequences as seq


@pytest.fixture(scope="module")
def toy(spark):
    """Entry E; F is fed back into C, A also leads outside."""
    nodes = spark.createDataFrame([("E", 2, "s0", True), ("A", 3, "s1", False), ("B", 3, "s1", False), ("C", 4, "s1", False), ("D", 5, "s2", False), ("F", 6, "s2", False)], "state string, min_ply int, structure string, is_entry boolean")
    rows = [("E", "A", 60), ("E", "B", 40), ("A", "C", 30), ("A", "OUT", 70), ("B", "C", 5), ("B", "D", 35), ("D", "F", 100), ("F", "C", 10)]
    edges = spark.createDataFrame([("all", a, a + b, b, n, n, 0, 0) for a, b, n in rows], "source string, parent string, action string, child string, games long, w long, d long, b long")
    # plies count from the entry's
    return edges, nodes.withColumn("min_ply", F.col("min_ply") - 2)


def test_flow(toy):
    got = {r["state"]: r for r in graph.flow(*toy).collect()}
    reach = {s: round(r["reach"], 9) for s, r in got.items()}
    assert reach == {"E": 1, "A": 0.6, "B": 0.4, "C": 0.23, "D": 0.35, "F": 0.35}
    assert got["A"]["leakage"] == pytest.approx(0.7) and got["C"]["ignored_back_mass"] == pytest.approx(0.35) and got["C"]["paths"] == 2


def test_parents_lines_coverage(spark, toy):
    edges, nodes = toy
    assert {r["state"]: (r["parents_in"], r["parents_all"]) for r in graph.parents(edges, nodes).collect()}["C"] == (2, 3)
    lines = {r["state"]: (r["line"], math.exp(r["logp"])) for r in graph.best_lines(edges, nodes).collect()}
    assert lines["C"][0] == "EA AC" and lines["C"][1] == pytest.approx(0.18)
    caught = graph.union_coverage(edges, nodes, spark.createDataFrame([("C",), ("F",), ("B",)], "state string"))
    assert {r["state"]: round(r["reach"], 9) for r in caught.collect()} == {"B": 0.4, "C": 0.18}


def test_dwell_and_exits(toy):
    edges, nodes = toy
    flow = graph.flow(edges, nodes).cache()
    enter = {r["state"]: round(r["enter"], 9) for r in flow.collect()}
    assert enter == {"E": 1, "A": 0.6, "B": 0.4, "C": 0, "D": 0.35, "F": 0}
    curve = graph.dwell(edges, nodes, flow, 20).cache()
    inside = {(r["structure"], r["step"]): round(r["inside"], 9) for r in curve.collect()}
    # s1 is entered at A and B; A keeps .3 in C, B .125; C has no way on
    assert inside[("s1", 0)] == 1 and inside[("s1", 1)] == pytest.approx(0.23) and ("s1", 2) not in inside
    assert inside[("s2", 1)] == 1 and ("s2", 2) not in inside  # all of D goes on to F, and F leaves
    stats = {r["structure"]: r for r in graph.dwell_stats(curve).collect()}
    assert stats["s1"]["mean_dwell"] == pytest.approx(1.23) and stats["s1"]["median_dwell"] == 1 and stats["s2"]["median_dwell"] == 2 and stats["s1"]["exit_within_two"] == 1
    out = {(r["structure"], r["next_structure"], r["action"]): (r["mass"], r["exit_ply"]) for r in graph.structure_edges(edges, nodes, flow).collect()}
    assert out[("s1", "s2", "BD")] == (pytest.approx(0.35), 1) and out[("s1", None, "AOUT")] == (pytest.approx(0.42), 1)
    assert out[("s1", None, None)] == (pytest.approx(0.23), 2) and out[("s2", "s1", "FC")] == (pytest.approx(0.35), 4)
    assert sum(m for (s, _, _), (m, _) in out.items() if s == "s1") == pytest.approx(1)  # all that enters leaves or leaks


def test_first_visits(spark):
    rows = [(1, 0, "a", "x", "b"), (1, 1, "b", "y", "a"), (1, 2, "a", "z", "c"), (1, 3, "c", None, None), (2, 0, "a", "z", "c"), (2, 1, "c", None, None)]
    visits = spark.createDataFrame([(g, p, s, "", a, n) for g, p, s, a, n in rows], "game_id long, ply int, state string, structure string, action string, next_state string")
    first = seq.first_visits(visits).withColumn("outcome", F.when(F.col("game_id") == 1, 0).otherwise(1)).withColumn("strong", F.col("game_id") == 2)
    counts = {(r["state"], r["action"]): (r["w"], r["d"], r["b"], r["d_s"]) for r in seq.count_moves(first).collect()}
    assert counts[("a", "")] == (1, 1, 0, 1) and counts[("a", "x")] == (1, 0, 0, 0) and counts[("a", "z")] == (0, 1, 0, 1) and counts[("c", "")] == (1, 1, 0, 1)
    assert ("c", None) not in counts and sum(r["w"] + r["d"] for r in seq.count_complete(first).where("state = 'a'").collect()) == 2


def test_sampled_walks_follow_shares(toy):
    edges, _ = toy
    rows = graph.sampled_walks(edges, "all", "E", 4000, 1, "s").groupBy("action").count().collect()
    assert {r["action"]: r["count"] / 4000 for r in rows} == pytest.approx({"EA": 0.6, "EB": 0.4}, abs=0.03)


def test_metrics(spark):
    dist = spark.createDataFrame([("expert", "s", "a", 9, 0.9), ("expert", "s", "b", 1, 0.1), ("population", "s", "b", 5, 0.5), ("population", "s", "c", 5, 0.5)], "source string, state string, action string, games long, p double")
    evals = spark.createDataFrame([("s", "a", 0.6), ("s", "b", 0.5)], "state string, action string, ep double")
    got = {r["source"]: r for r in metrics.expected_regret(dist, evals).collect()}
    assert got["expert"]["regret"] == pytest.approx(0.01) and got["population"]["regret"] == pytest.approx(0.1) and got["population"]["mass_covered"] == 0.5
    d = metrics.divergence(metrics.paired(dist, "expert", "population")).first()
    assert d["overlap"] == pytest.approx(0.1) and d["tv"] == pytest.approx(0.9) and d["kl"] is None and 0 < d["js"] < 1
    same = metrics.divergence(metrics.paired(dist.unionByName(dist.where("source = 'expert'").withColumn("source", F.lit("twin"))), "expert", "twin")).first()
    assert same["js"] == pytest.approx(0) and same["kl"] == pytest.approx(0)


def test_mutual_information(spark):
    rng = random.Random(0)
    rows = [(i, "g", "yes" if i % 2 else "no", "odd" if i % 2 else "even", rng.choice("pq"), 1.0) for i in range(200)]
    df = spark.createDataFrame(rows, "id long, g string, y string, f string, noise string, w double")
    assert mining.mutual_information(df, "g", "y", "f", "w").first()["mi"] == pytest.approx(1.0)
    assert mining.mutual_information(df, "g", "y", "noise", "w").first()["mi"] < 0.05
    assert mining.permutation_test(df, "g", "y", "f", "w", "id", 19).first()["p_value"] == pytest.approx(0.05)
    assert mining.permutation_test(df, "g", "y", "noise", "w", "id", 19).first()["p_value"] > 0.05


def test_greedy_takes_the_best_not_the_sum(spark):
    cells = spark.createDataFrame([("a", "s", 5.0), ("b", "s", 4.0), ("b", "t", 2.0), ("c", "t", 3.0), ("d", "u", 0.0)], "item string, state string, gain double")
    costs = spark.createDataFrame([(i, 1.0) for i in "abcd"], "item string, cost double")
    steps = selection.greedy(cells, costs, 10)
    assert [(s["item"], s["marginal"]) for s in steps] == [("b", 6.0), ("a", 1.0), ("c", 1.0)] and steps[-1]["cumulative"] == 8.0


def test_item_without_answers_has_no_value(spark):
    items = spark.createDataFrame([("i", ["s"], ["a"]), ("j", ["s"], ["never"])], "item string, states array<string>, answers array<string>")
    losses = spark.createDataFrame([("s", "a", 0.0)], "state string, action string, loss double")
    base = spark.createDataFrame([("s", 0.5, 1.0)], "state string, base_loss double, reach double")
    got = {r["item"]: r["value"] for r in selection.item_values(selection.item_losses(items, losses), base).collect()}
    assert got == {"i": 0.5, "j": None}


def test_bitboards(spark):
    # white a2 b2 b3 d4, black c7 e5 h7; bit 63 set in the third mask
    mask = lambda *names: bb.signed(sum(1 << ("abcdefgh".index(n[0]) + 8 * (int(n[1]) - 1)) for n in names))
    df = spark.createDataFrame([(mask("a2", "b2", "b3", "d4"), mask("c7", "e5", "h7"), mask("h8", "a1"))], "w long, b long, x long")
    w, b, x = F.col("w"), F.col("b"), F.col("x")
    r = df.select(bb.islands(w), bb.isolated(w), bb.doubled(w), bb.passed(w, b), bb.passed(b, w, white=False), bb.centre(w, b), bb.open_files(w, b), bb.semi_open_files(w, b), bb.squares(x), bb.distance(w, w), bb.from_hex(F.lit("8000000000000001")) == x, bb.backward(w, b)).first()
    assert tuple(r) == (2, 1, 1, 1, 1, 0b10000001, 2, 3, [0, 63], 0, True, 0)
    assert df.select(bb.diagram(w, b)).first()[0].split("\n")[1] == "..p....p"


def test_scalars(spark):
    df = spark.createDataFrame([(1, 2, 1, 100, 3, "rnbq/PPPP", "2024.05.01")], "w int, d int, b int, cp int, mate int, board string, day string")
    lo, hi = v.wilson(F.col("w"), F.col("w") + F.col("b") + F.col("d"))
    zero = v.wilson(F.lit(0), F.lit(0))
    r = df.select(
        v.ep_from_wdl(F.col("w"), F.col("d"), F.col("b")), v.ep_from_wdl(F.lit(0), F.lit(0), F.lit(0)), v.ep_from_cp(F.lit(0)), v.ep_from_score(F.lit(None), F.col("mate"), F.col("cp")), lo < hi, zero[0], zero[1],
        v.mirror_key(F.col("board")), v.mirror_key(v.mirror_key(F.col("board"))), v.month_ordinal(F.col("day")), v.month_ordinal(F.lit("????")), v.eval_text(F.lit(125), F.lit(None)), v.eval_text(F.lit(0), F.lit(3)),
        *v.unpack_move(v.pack_move(F.lit(12), F.lit(28), F.lit(4))), v.deviation_class(F.lit(0.05)), v.structure_class(F.lit(3.5), F.lit(0.6)),
    ).first()
    assert list(r) == [0.5, None, 0.5, 1.0, True, 0.0, 1.0, "pppp/RNBQ", "rnbq/PPPP", 202405, 0, "+1.25", "#3", 12, 28, 4, "inaccurate", "strategic_attractor"]
