"""Rules, campaigns, courses, selections and manifests: by hand, and against brute force."""

import random
from itertools import combinations

import pytest
from pyspark.sql import functions as F

from seqgraph.functions import chess
from seqgraph.operators import campaign, course, mining, rules, selection
from seqgraph.sources import files, manifest


def _dist(spark, rows):
    return spark.createDataFrame(rows, "state string, action string, games long, p double")


def test_rules(spark):
    """A shared answer is a rule; an even split isn't one, not even as a set of two; its groups may earn their own."""
    dist = _dist(spark, [("a", "x", 60, 0.6), ("a", "y", 40, 0.4), ("b", "x", 90, 0.9), ("c", "x", 80, 0.8), ("d", "y", 80, 0.8), ("e", "z", 5, 1.0), ("f", "u", 30, 0.3), ("f", "v", 30, 0.3), ("f", "w", 40, 0.34)])
    answers = rules.state_answers(dist)
    assert {r["state"]: (r["answers"], r["top"]) for r in answers.collect()} == {"a": (["x", "y"], "x"), "b": (["x"], "x"), "c": (["x"], "x"), "d": (["y"], "y"), "e": ([], None), "f": (["w"], "w")}
    boards = spark.createDataFrame([("F", "w", "a", 0.2, "p"), ("F", "w", "b", 0.6, "p"), ("F", "w", "e", 0.2, None), ("G", "w", "c", 0.3, "left"), ("G", "w", "d", 0.3, "right"), ("G", "b", "d", 1.0, "right")], "family string, role string, state string, weight double, side string")
    got = {(r["family"], r["role"], r["value"]): r for r in rules.with_fallback(boards, answers, ["side"]).collect()}
    f = got["F", "w", None]
    assert (f["kind"], f["answers"], f["exceptions"]) == ("prescriptive", "x", 0) and f["support"] == pytest.approx(0.8) and f["strict_support"] == pytest.approx(0.6)
    g = got["G", "w", None]
    assert (g["kind"], g["answers"], g["reason"]) == ("recognition_only", "", "not_strict") and g["strict_support"] == 0
    assert got["G", "w", "left"]["answers"] == "x" and got["G", "w", "right"]["answers"] == "y"
    assert got["G", "b", None]["answers"] == "y" and ("F", "w", "p") not in got
    # 0.3 of mass doesn't reach the floor of what an answer set covers, but all of the group's own mass does
    assert got["G", "w", "right"]["kind"] == "prescriptive" and got["G", "w", "right"]["support"] == pytest.approx(1)
    items = {r["type"]: r["answers"] for r in rules.as_items(rules.with_fallback(boards, answers, ["side"]).where("family = 'G' AND feature IS NULL AND role = 'w'")).collect()}
    assert items == {"orientation": None}


def test_support_and_needed_actions(spark):
    rows = [("s", "e1", "x", 1), ("s", "e1", "y", 1), ("s", "e2", "x", 9), ("s", "e2", "y", 1), ("s", "pop", "x", 90), ("s", "pop", "z", 20), ("t", "e2", "x", 90), ("t", "pop", "x", 50), ("t", "pop", "y", 60), ("u", "e2", "x", 5), ("u", "e2", "y", 5), ("u", "pop", "x", 1), ("u", "pop", "y", 2)]
    dist = spark.createDataFrame(rows, "state string, source string, action string, games long")
    assert [tuple(r) for r in campaign.supported(dist, {"e1": 5, "e2": 5}, "pop", 100).collect()] == [("s", "e2", 10, 110)]
    pairs = spark.createDataFrame([("s", "a", 0.5, 0.4), ("s", "b", 0.3, 0.3), ("s", "c", 0.15, 0.3), ("s", "d", 0.05, 0.0)], "state string, action string, p double, q double")
    assert [(r["action"], round(r["left_out"], 9)) for r in campaign.needed_actions(pairs, 0.1, 2).orderBy("needed_rank").collect()] == [("a", 0.25), ("b", 0.25)]


def test_served_moves(spark):
    """Unknown is null, known but never played is 0; order: reference, then the other layer, then the action."""
    actions = spark.createDataFrame([("s", a) for a in "abc"] + [("t", "a")], "state string, action string")
    one, two = spark.createDataFrame([("s", "b", 5), ("s", "c", 5)], "state string, action string, games long"), spark.createDataFrame([("s", "c", 7), ("t", "a", 1)], "state string, action string, games long")
    known = {"one": one, "two": two}
    got = campaign.served_moves(actions, {"one": one, "two": two}, known, "one", "two").orderBy("state", "shown").collect()
    assert [(r["state"], r["action"], r["one"], r["two"]) for r in got] == [("s", "c", 5, 7), ("s", "b", 5, 0), ("s", "a", 0, 0), ("t", "a", None, 1)]


def test_gains_share_a_baseline(spark):
    evals = spark.createDataFrame([("s", "a", 0.6), ("s", "b", 0.5), ("s", "c", 0.1)], "state string, action string, ep double")
    pop, taught = spark.createDataFrame([("s", "b", 0.5), ("s", "c", 0.3), ("s", "q", 0.2), ("t", "a", 1.0)], "state string, action string, p double"), spark.createDataFrame([("s", "b", 1.0)], "state string, action string, p double")
    r = campaign.taught_gain(pop, evals, taught).first()
    assert r["loss_pop"] == pytest.approx((0.5 * 0.1 + 0.3 * 0.5) / 0.8) and r["loss_taught"] == pytest.approx(0.1) and r["mass_covered"] == pytest.approx(0.8)
    none = campaign.taught_gain(pop, evals, taught.where("false")).first()
    assert none["loss_taught"] is None and none["gain"] is None  # unknown, not zero
    values = campaign.template_values(spark.createDataFrame([("F", "s", 2.0), ("F", "z", 1.0)], "family string, state string, weight double"), campaign.taught_gain(pop, evals, taught)).first()
    assert (values["sampled"], values["evaluated"], values["missing"]) == (2, 1, 1) and values["ev_per_board"] == pytest.approx(r["gain"])
    steps = spark.createDataFrame([(1, "s", "c"), (1, "s", "b"), (1, "t", "a"), (2, "s", "q")], "game_id long, state string, action string")
    walked = campaign.walk_losses(steps, evals, spark.createDataFrame([("s", "a"), ("s", "b")], "state string, action string")).collect()
    assert [(w["game_id"], w["steps"]) for w in walked] == [(1, 2)] and walked[0]["loss_played"] == pytest.approx(0.6) and walked[0]["loss_taught"] == pytest.approx(0.1)


def test_tiers(spark):
    rows = [(f"s{i:03d}", 0.01, True, 0.2, False, 0.001 if i < 40 else 0.0, 0.0, False, 0) for i in range(100)]
    got = campaign.tiers(campaign.reasoned(spark.createDataFrame(rows, "state string, reach double, in_template boolean, js double, top_differs boolean, decision double, deviation double, in_split boolean, frontier_items int"))).collect()
    by = {r["state"]: r for r in got}
    assert by["s000"]["reasons"] == ["high_reach", "mature_template", "behavioural_disagreement", "decision_priority"] and by["s000"]["score"] == pytest.approx(1 + 1.5 + 4 + 4)
    assert sorted(r["state"] for r in got if r["tier"] == "C") == [f"s{i:03d}" for i in range(25)] and all(r["tier"] == "A" for r in got if r["rank"] > 25)


@pytest.mark.parametrize("seed", range(6))
def test_greedy_against_brute_force(spark, seed):
    rng = random.Random(seed)
    cells = [(f"i{i}", f"s{s}", round(rng.random(), 3)) for i in range(7) for s in rng.sample(range(9), 4)]
    cost = {f"i{i}": float(rng.randrange(1, 4)) for i in range(7)}
    got = selection.greedy(spark.createDataFrame(cells, "item string, state string, gain double"), spark.createDataFrame(list(cost.items()), "item string, cost double"), 5, budget=8.0)
    value = lambda taken: sum(max((g for i, s2, g in cells if i in taken and s2 == s), default=0.0) for s in {s for _, s, _ in cells})
    taken, spent = [], 0.0
    for _ in range(5):
        options = [(-round(value([*taken, i]) - value(taken), 12), cost[i], i) for i in cost if i not in taken and spent + cost[i] <= 8.0 and value([*taken, i]) - value(taken) > 1e-12]
        if not options:
            break
        taken.append(min(options)[2])
        spent += cost[taken[-1]]
    assert [s["item"] for s in got] == taken and got[-1]["cumulative"] == pytest.approx(value(taken)) and got[-1]["cost"] == spent


def test_template_frontier():
    """Greedy coverage; near copies of what is taken leave the pool; it stops when nothing is gained."""
    covers = {"a": {1, 2, 3}, "b": {1, 2, 3, 4}, "c": {5}, "d": {4}}
    distance = lambda x, y: 1 if {x, y} == {"b", "a"} or {x, y} == {"b", "d"} else 9
    got = course.template_frontier(list("abcd"), lambda s: float(len(set().union(*[covers[x] for x in s]))), distance)
    assert [(g["structure"], g["coverage"], g["marginal"]) for g in got] == [("b", 4.0, 4.0), ("c", 5.0, 1.0)]


def test_knowledge_frontier_pays_once(spark):
    items = spark.createDataFrame([("p",), ("q",), ("r",)], "item string")
    components = spark.createDataFrame([("p", "k1", 2.0), ("q", "k1", 2.0), ("q", "k2", 1.0), ("r", "k3", 9.0)], "item string, component string, cost double")
    values = spark.createDataFrame([("p", "s", 4.0), ("q", "s", 5.0), ("q", "t", 3.0), ("r", "t", 3.5)], "item string, state string, gain double")
    got = [(g["item"], g["value"], g["burden"]) for g in course.knowledge_frontier(items, components, values, 5)]
    assert got == [("q", 8.0, 3.0), ("r", 0.5, 9.0)]  # p adds nothing after q


def test_course_rules(spark):
    boards = spark.createDataFrame([("s", 0.30, 0.001), ("t", 0.30, 0.001), ("u", 0.30, 0.00001)], "state string, loss_pop double, reach double")
    schemas = spark.createDataFrame([("s", 0.10), ("s", 0.20)], "state string, loss double")
    decisions = spark.createDataFrame([("d1", "s", 0.05), ("d2", "s", 0.097), ("d3", "t", 0.0)], "item string, state string, loss double")
    got = {r["item"]: (round(r["residual"], 9), round(r["gained"], 9)) for r in course.admitted_decisions(decisions, schemas, boards).collect()}
    assert got == {"d1": (0.2, 0.05)}  # d2 gains too little, t has no schema that improves it
    effects = spark.createDataFrame([("i", "s", 0.2, ["a"]), ("i", "t", 0.9, ["b"]), ("i", "u", 0.1, ["c"])], "item string, state string, explained double, answers array<string>")
    top = spark.createDataFrame([("s", "z", 0.6), ("t", "z", 0.6), ("u", "z", 0.6)], "state string, action string, share double")
    assert [tuple(r) for r in course.material_deviations(effects, boards, top).collect()] == [("i", "s", "z")]
    plans = spark.createDataFrame([("p1", "s", ["b", "a"]), ("p2", "s", ["a", "b"]), ("p3", "s", ["a"])], "plan string, state string, answers array<string>")
    assert {r["plan"]: r["same_as"] for r in course.same_prescriptions(plans).collect()} == {"p1": "p1", "p2": "p1", "p3": "p3"}


def test_audit(spark):
    kinds = "budget string, item string, kind string, title string, reach double, contained_in string, retained_because string, flexibility double, lift double, moves array<string>"
    items = spark.createDataFrame([
        ("b", "schema:1", "schema", "one", 0.1, "", None, 0.0, None, None), ("b", "schema:2", "schema", "two", 0.1, "x", "novel", 0.5, None, None), ("b", "schema:3", "schema", "two", 0.1, None, None, 0.9, None, None),
        ("b", "decision:1", "decision", "dec", 0.00001, None, None, None, None, ["e2e4"]), ("b", "o", "orientation", "ori", None, None, None, None, 1.1, None),
    ], kinds)
    required = spark.createDataFrame([("b", "schema:1", "x", "file_open"), ("b", "schema:2", "x", "goal"), ("b", "schema:2", "y", "goal"), *[("b", "schema:3", c, "goal") for c in "xyzw"]], "budget string, item string, component string, kind string")
    exceptions = spark.createDataFrame([("b", f"e{i}", "decision:1" if i else "decision:9", ["d2d4"]) for i in range(25)], "budget string, item string, modifies string, moves array<string>")
    got = sorted((r["finding"], r["subject"]) for r in course.audit(items, required, exceptions).collect() if r["finding"] != "contradictory")
    assert got == sorted([("cannot_be_checked", "one"), ("redundant_undeclared", "one"), ("redundant_undeclared", "one"), ("redundant_declared", "two"), ("duplicate_titles", "two"), ("unreachable", "dec"), ("uninformative_recognition", "ori"),
                          ("hard_to_parse", "two"), ("hard_to_parse", "two"), ("orphan_exceptions", "e0"), ("deviation_swamp", "25")])


def test_grouped_sets(spark):
    rng = random.Random(2)
    trajectories = {t: (rng.choice("gh"), set(rng.sample("abcd", rng.randrange(1, 4)))) for t in range(60)}
    events = spark.createDataFrame([(t, e) for t, (_, es) in trajectories.items() for e in es], "traj long, event string")
    weights = spark.createDataFrame([(t, g, 1.0) for t, (g, _) in trajectories.items()], "traj long, grp string, weight double")
    want = {}
    for g in "gh":
        own = [es for grp, es in trajectories.values() if grp == g]
        for size in (1, 2, 3, 4):
            for items in combinations("abcd", size):
                support = sum(set(items) <= es for es in own) / len(own)
                if support >= 0.2:
                    want[g, "+".join(items)] = round(support, 9)
    got = mining.grouped_sets(events, weights, 0.2, 4)
    assert {(r["grp"], r["items"]): round(r["support"], 9) for r in got.collect()} == want
    best = {r["items"]: round(r["support"], 9) for r in mining.best_group(got).collect()}
    assert best == {i: max(s for (_, j), s in want.items() if i == j) for _, i in want}


def test_position_events():
    p = chess.Position.from_fen("r3k2r/8/8/3pP3/4P3/8/8/R3K2R w KQkq d6")
    move = lambda a, b: chess.Move(chess.square(a), chess.square(b))
    assert p.transformations(move("e1", "g1")) == [("castle", "w", "k")] and p.transformations(move("e5", "d6")) == [("capture", "P", "P", "e5", "d6")]
    assert p.transformations(move("e4", "d5")) == [("capture", "P", "P", "e4", "d5")] and p.transformations(move("a1", "a7"), exits=True) == [("piece_move", "R", "a1", "a7"), ("structure_exit", None, None)]
    opened = chess.Position.from_fen("4k3/8/8/3p4/4P3/8/8/4K3 w - -").transformations(move("e4", "d5"))
    assert opened == [("capture", "P", "P", "e4", "d5"), ("file_open", "e", None)]
    states = [p.event_state(e) for e in (("castle", "w", "k"), ("pawn_move", "e5", "e6"), ("pawn_move", "d5", "d4"), ("piece_move", "N", "a1", "b3"), ("file_open", "a", None), ("file_open", "e", None), ("capture", "P", "P", "e5", "d6"), ("pawn_move", "c2", "c4"))]
    assert states == ["actionable", "actionable", "unknown", "complete", "complete", "unknown", "unknown", "complete"]
    assert p.advancing([("pawn_move", "e5", "e6"), ("castle", "w", "q")]) == {"e5e6": [("pawn_move", "e5", "e6")], "e1c1": [("castle", "w", "q")]}


def test_manifest_and_reports(spark, tmp_path):
    source, folder = tmp_path / "in.txt", f"file://{tmp_path}/runs"
    source.write_text("a")
    ident = manifest.identity(spark, [f"file://{source}"], {"threshold": 3})
    run = manifest.Run(spark, folder, "r1", manifest.TWO_PASS)
    assert run.start(ident, {"threshold": 3}) == "candidates" and run.advance() == "exact"
    again = manifest.Run(spark, folder, "r1", manifest.TWO_PASS)
    assert again.start(ident) == "exact"  # resumed
    source.write_text("changed")
    with pytest.raises(manifest.InputChanged):
        again.start(manifest.identity(spark, [f"file://{source}"], {"threshold": 3}))
    assert [again.advance() for _ in range(3)] == ["finalizing", "complete", "complete"]
    r = manifest.runs(spark, folder).first()
    assert r["phase"] == "complete" and r["finished"] is not None and r["config"] == '{"threshold": 3}'
    rows = spark.createDataFrame([(1, "a|b"), (2, None)], "n long, t string")
    files.write_report(rows.coalesce(1), f"file://{tmp_path}/md", "markdown")
    assert [x["value"] for x in spark.read.text(f"file://{tmp_path}/md").collect()] == ["| n | t |", "|-|-|", "| 1 | a\\|b |", "| 2 |  |"]
    for _ in range(2):
        files.append_log(rows, f"file://{tmp_path}/log", "n")
    assert spark.read.csv(f"file://{tmp_path}/log", header=True).count() == 4 and files.lookup(rows, n=2)[0]["t"] is None
    assert {r["coverage_state"] for r in manifest.labelled(rows, "exact").select("coverage_state").collect()} == {"partial"}
    assert rows.select(F.lit(1)).count() == 2
