"""Boards of large keys against the queries' own SQL, whose products are made in 128 bits."""

import duckdb
import pytest

import __spark_entry__ as entry

#: Customers beyond 85,000 and orders beyond 3.47e9 make products that leave a long; 2^56 + 3 isn't a double.
KEYS = [(0, 0), (7, 3), (149_999, 85_788), (899_999, 89_999), (8_999_999, 899_999), (3_474_701_533, 14_999), (10**12 + 1, 10**9 + 7), ((1 << 56) + 3, 1 << 40)]
QUERIES = ["backward_pawns", "bitboard_features", "board_states", "maturity_components", "passed_pawns", "split_features"]


@pytest.fixture(scope="module")
def large(spark, tmp_path_factory):
    d = str(tmp_path_factory.mktemp("large_keys"))
    keys = sorted({o + i: c + 5 * i for o, c in KEYS for i in range(40)}.items())
    spark.createDataFrame(keys, "o_orderkey long, o_custkey long").coalesce(1).write.parquet(f"{d}/orders.parquet")
    return d


@pytest.mark.parametrize("name", QUERIES)
def test_large_keys(spark, large, name):
    with duckdb.connect() as db:
        db.execute(f"CREATE VIEW orders AS SELECT o_orderkey::HUGEINT AS o_orderkey, o_custkey::HUGEINT AS o_custkey FROM '{large}/orders.parquet/*.parquet'")
        want = db.execute(entry.oracle_sql()[name]).fetchall()
    got = [tuple(r) for r in entry.queries()[name](spark, large).collect()]
    got, want = sorted(got, key=lambda r: str(r[:1])), sorted(want, key=lambda r: str(r[:1]))
    # doubles but for the last digit: the engines round a half apart
    near = lambda a, b: abs(a - b) < 1.5e-6 if isinstance(a, float) else a == b
    assert len(got) == len(want) >= 45 and all(len(a) == len(b) and all(map(near, a, b)) for a, b in zip(got, want))


@pytest.mark.parametrize("name", QUERIES)
def test_keys_in_ints(spark, tmp_path, name):
    """Keys of 32 bits give what the same keys give as longs."""
    keys = spark.createDataFrame([(7 + i, 3 + i) for i in range(40)] + [(8_999_000 + i, 899_000 + 5 * i) for i in range(40)], "o_orderkey long, o_custkey long").coalesce(1)
    found = []
    for kind in ("long", "int"):
        keys.selectExpr(f"cast(o_orderkey as {kind}) AS o_orderkey", f"cast(o_custkey as {kind}) AS o_custkey").write.parquet(f"{tmp_path}/{kind}/orders.parquet")
        found.append(sorted(map(str, map(tuple, entry.queries()[name](spark, f"{tmp_path}/{kind}").collect()))))
    assert found[0] == found[1] and len(found[0]) >= 45
