"""Queries over whole tables, against brute force."""

import hashlib
import random
from collections import Counter, defaultdict
from math import log2

import duckdb
import pytest

from seqgraph.operators import selection
from seqgraph.plans import catalog, core, more, study, values  # noqa: F401  (importing registers the queries)


def test_passed_pawns_on_all_masks(spark, small):
    got = {r["id"]: r["passed"] for r in catalog.QUERIES["passed_pawns"](spark, small).collect()}
    want = {}
    for r in values._masks(spark, small).collect():
        own, other = ([s for s in range(64) if r[k] >> s & 1] for k in "wb")
        if own:
            want[r["id"]] = sum(not any(o // 8 > s // 8 and abs(o % 8 - s % 8) <= 1 for o in other) for s in own)
    assert got == want and any(i % 20 for i in want)


def _information(pairs):
    """I(y; f) of (f, y) pairs in bits."""
    n, joint, f, y = len(pairs), Counter(pairs), Counter(p[0] for p in pairs), Counter(p[1] for p in pairs)
    return sum(c / n * log2(c * n / (f[a] * y[b])) for (a, b), c in joint.items())


def _tested(rows, shuffles):
    """Per group: the information and the p-value of rows (id, g, y, f), by the operator's seeded deals."""
    groups, out = defaultdict(list), {}
    for i, g, y, f in rows:
        groups[g].append((str(i), y, f))
    for g, own in groups.items():
        own.sort()
        mi, reached = _information([(f, y) for _, y, f in own]), 0
        for k in range(1, shuffles + 1):
            drawn = sorted(own, key=lambda r: (hashlib.sha256(f"{k}:{r[0]}".encode()).hexdigest(), r[0]))  # noqa: B023
            reached += _information([(a[2], b[1]) for a, b in zip(own, drawn)]) >= mi - 1e-9
        out[g] = (mi, (reached + 1) / (shuffles + 1))
    return out


@pytest.fixture(scope="module")
def boards(spark, small):
    rows = [(r["o_orderkey"], r["g"], r["y"], r["f"]) for r in study._boards(spark, small).collect()]
    return rows, _tested(rows, 200)


def test_permutations_of_all_boards(spark, small, boards):
    got = {r["g"]: (r["mi"], r["p_value"]) for r in catalog.QUERIES["permutation_test"](spark, small).collect()}
    assert set(got) == set(boards[1])
    for g, (mi, p) in boards[1].items():
        assert got[g] == (pytest.approx(mi, abs=1e-6), pytest.approx(p, abs=1e-6))


def test_split_decisions_with_p_values(spark, small, boards):
    got = {r["g"]: (r["p_value"], r["boards"], r["decision"]) for r in catalog.QUERIES["split_decisions"](spark, small).collect()}
    sizes = Counter(r[1] for r in boards[0])
    want = {}
    for g, (mi, p) in boards[1].items():
        want[g] = (pytest.approx(p, abs=1e-6), sizes[g], "too_few" if sizes[g] < 5 else "no_information" if mi < 0.10 else "split" if p < 0.05 else "chance")
    assert got == want


def test_chance_is_not_a_split(spark):
    """Much information from few boards is chance; without the permutation test it would be a split."""
    rows = [(i, "few", "xy"[i % 2], f, 1.0) for i, f in enumerate("aaabab")] + [(100 + i, "many", "xy"[i % 2], "ab"[i % 2], 1.0) for i in range(40)]
    tested = _tested([(i, g, y, f) for i, g, y, f, _ in rows], 200)
    got = {r["g"]: r["decision"] for r in more.split_all(spark.createDataFrame(rows, "o_orderkey long, g string, y string, f string, w double")).collect()}
    assert tested["few"][0] >= 0.10 and tested["few"][1] >= 0.05
    assert got["many"] == "split" and got["few"] == "chance"


def test_containment_of_whole_sets(spark, small):
    got = [(r["small"], r["large"]) for r in catalog.QUERIES["containment"](spark, small).collect()]
    sets = defaultdict(set)
    for r in study._uses(spark, small).collect():
        sets[r["plan"]].add(r["component"])
    want = {(a, b) for a, x in sets.items() for b, y in sets.items() if x < y}
    assert len(got) == len(set(got)) and set(got) == want


def test_containment_of_large_sets(spark):
    rng = random.Random(6)
    sets = {i: set(rng.sample(range(12), rng.randrange(1, 11))) for i in range(150)}
    df = spark.createDataFrame([(i, [f"c{m}" for m in s]) for i, s in sets.items()], "id long, members array<string>")
    got = sorted((r["small"], r["large"]) for r in selection.containment(df).collect())
    assert got == sorted((a, b) for a, x in sets.items() for b, y in sets.items() if x < y)


def test_counts_of_whole_games(spark, small):
    """Every event of every game counts, however long the game is."""
    rows = duckdb.connect().execute(f"SELECT user_id * 100 + date_diff('day', DATE '2024-01-01', CAST(ts AS DATE)) // 3, event_type, CAST(round(value * 100) AS BIGINT) FROM '{small}/events.parquet' ORDER BY 1, ts, event_id").fetchall()
    games, want = defaultdict(list), Counter()
    for game, action, cents in rows:
        games[game].append((action, cents))
    for steps in games.values():
        outcome, past = sum(c for _, c in steps) % 3, []
        for action in [a for a, _ in steps] + [""]:
            want["|".join(sorted(past)), action, outcome] += 1
            past.append(action)
    got = Counter()
    for r in catalog.QUERIES["edges_complete"](spark, small).collect():
        got.update({(r["state"], r["action"], k): r[name] for k, name in enumerate("wdb") if r[name]})
    assert got == want and max(map(len, games.values())) > 6 and sum(got.values()) == len(rows) + len(games)


@pytest.mark.parametrize("name", ["move_table", "nodes", "provenance", "position_source_coverage", "universes"])
def test_whole_games_in_sql(spark, small, name):
    db = duckdb.connect()
    db.execute(f"CREATE VIEW events AS SELECT * FROM '{small}/events.parquet'")
    found = db.execute(catalog.SQL[name])
    columns = [c[0] for c in found.description]
    key = lambda r: tuple(round(float(x), 5) if isinstance(x, float) else str(x) for x in r)
    want = Counter(map(key, found.fetchall()))
    rows = catalog.QUERIES[name](spark, small).select(*columns).collect()
    assert Counter(map(key, rows)) == want
