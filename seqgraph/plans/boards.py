"""Facts of whole boards, on boards that are made from the orders table."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import bitboards as bb
from . import fixture as fx
from .catalog import query, rounded
from .values import MASKS, _masks

_KINDS = {"wn": ("id", (1, 7)), "wb": ("id", (11, 13)), "wr": ("id", (3, 5)), "bn": ("c", (1, 9)), "bb": ("c", (11, 15)), "br": ("c", (3, 7))}
_KINGS = {"wk": "id * 19 % 8", "bk": "56 + c * 21 % 8"}
_QUEENS = {"wq": "id * 17 % 64", "bq": "c * 29 % 64"}


def _boards(spark, d):
    """id, the twelve masks, castling rights. Squares are remainders by 64: keys are reduced first, so that no product leaves a long."""
    rows = _masks(spark, d).join(fx.table(spark, d, "orders").select(F.col("o_orderkey").alias("id"), F.pmod("o_custkey", F.lit(64)).alias("c")), "id")
    small = lambda s: s.replace("id", "pmod(id, 64)")
    bit = lambda s: F.expr(f"shiftleft(1L, cast({small(s)} as int))")
    rows = rows.withColumnsRenamed({"w": "wp", "b": "bp"})
    rows = rows.withColumns({p: bit(f"{k} * {a} % 64").bitwiseOR(bit(f"{k} * {b} % 64")) for p, (k, (a, b)) in _KINDS.items()} | {p: bit(e) for p, e in _KINGS.items()})
    rows = rows.withColumns({p: F.when(F.expr(f"{small(e)} % 4 <> 0"), bit(e)).otherwise(F.lit(0).cast("long")) for p, e in _QUEENS.items()})
    return rows.withColumn("rights", F.concat(*[F.when(F.expr(f"id div {1 << k} % 2 = 1"), c).otherwise("") for k, c in enumerate("KQkq")])).drop("c")


_one = lambda s: f"(1::UBIGINT << CAST({s} AS INTEGER))"
BOARDS = f"""WITH raw AS (SELECT m.id, m.w::UBIGINT AS wp, m.b::UBIGINT AS bp, o.o_custkey AS c FROM ({MASKS}) m JOIN orders o ON o.o_orderkey = m.id),
    boards AS (SELECT id, wp, bp, {", ".join(f"{_one(f'{k} * {a} % 64')} | {_one(f'{k} * {b} % 64')} AS {p}" for p, (k, (a, b)) in _KINDS.items())},
    {", ".join(f"{_one(e)} AS {p}" for p, e in _KINGS.items())}, {", ".join(f"CASE WHEN {e} % 4 <> 0 THEN {_one(e)} ELSE 0::UBIGINT END AS {p}" for p, e in _QUEENS.items())},
    {" || ".join(f"CASE WHEN (id // {1 << k}) % 2 = 1 THEN '{c}' ELSE '' END" for k, c in enumerate("KQkq"))} AS rights FROM raw)"""
_away = lambda p: f"bit_count({p} & {(1 << 64) - 1 - bb._bits(bb.HOMES[p])}::UBIGINT)"
_at = lambda s, q: f"{s}k = {1 << q}::UBIGINT"


def _castled(s: str) -> str:
    base, k, q = (0, "K", "Q") if s == "w" else (56, "k", "q")
    return f"""CASE WHEN {_at(s, base + 6)} THEN 'castled_kingside' WHEN {_at(s, base + 2)} THEN 'castled_queenside' WHEN contains(rights, '{k}') AND contains(rights, '{q}') THEN 'available_both'
        WHEN contains(rights, '{k}') THEN 'available_kingside' WHEN contains(rights, '{q}') THEN 'available_queenside' WHEN {_at(s, base + 4)} THEN 'none' ELSE 'king_moved' END"""


def _dev(s: str) -> str:
    base = 0 if s == "w" else 56
    rook = f"CASE WHEN {_at(s, base + 6)} THEN bit_count({s}r & {1 << base + 5}::UBIGINT) WHEN {_at(s, base + 2)} THEN bit_count({s}r & {1 << base + 3}::UBIGINT) ELSE 0 END"
    return f"({' + '.join(_away(s + k) for k in 'nbrq')} - {rook} + CASE WHEN {_at(s, base + 4)} THEN 0 ELSE 1 END)"


_file = lambda m, f: f"bit_count({m} & {bb.FILES[f]}::UBIGINT)"
_open = " + ".join(f"CASE WHEN {_file('wp', f)} = 0 AND {_file('bp', f)} = 0 THEN {1 << f} ELSE 0 END" for f in range(8))
_semi = lambda a, b: " + ".join(f"CASE WHEN {_file(a, f)} = 0 AND {_file(b, f)} > 0 THEN {1 << f} ELSE 0 END" for f in range(8))
_material = lambda s: f"'{s.upper()}:' || " + " || ".join(f"'{k.upper()}' || bit_count({s}{k})" for k in "qrbnp")


@query(BOARDS + f""" SELECT id, CAST({_open} AS INTEGER) AS open_file_mask, CAST({_semi('wp', 'bp')} AS INTEGER) AS semi_open_white, CAST({_semi('bp', 'wp')} AS INTEGER) AS semi_open_black,
    {_material('w')} || ' ' || {_material('b')} AS material, rights AS castling_rights, {_castled('w')} AS white_castled, {_castled('b')} AS black_castled,
    CAST({_dev('w')} AS INTEGER) AS dev_white, CAST({_dev('b')} AS INTEGER) AS dev_black, CASE WHEN {_dev('w')} + {_dev('b')} <= 3 THEN 'undeveloped' WHEN {_dev('w')} + {_dev('b')} <= 7 THEN 'partial' ELSE 'developed' END AS dev_status FROM boards""")
def board_states(spark, d):
    """Files, material, castling and development of every board."""
    rows = _boards(spark, d)
    facts = bb.fingerprint({p: F.col(p) for p in bb.PIECES}, F.col("rights"))
    names = ("open_file_mask", "semi_open_white", "semi_open_black", "material", "castling_rights", "white_castled", "black_castled", "dev_white", "dev_black", "dev_status")
    return rows.select("id", *[facts[n].alias(n) for n in names])


def _backward(own: str, other: str, up: int) -> str:
    """A pawn without support on the files beside it, level or behind, whose next square is guarded."""
    return f"""(SELECT count(*) FROM range(64) s(i) WHERE ({own} >> CAST(i AS INTEGER)) & 1 = 1
        AND NOT EXISTS (SELECT 1 FROM range(64) t(j) WHERE ({own} >> CAST(j AS INTEGER)) & 1 = 1 AND abs(j % 8 - i % 8) = 1 AND (j // 8 - i // 8) * {up} <= 0)
        AND EXISTS (SELECT 1 FROM range(64) t(j) WHERE ({other} >> CAST(j AS INTEGER)) & 1 = 1 AND abs(j % 8 - i % 8) = 1 AND (j // 8 - i // 8) * {up} = 2))"""


@query(BOARDS + f" SELECT id, CAST({_backward('wp', 'bp', 1)} AS INTEGER) AS backward_white, CAST({_backward('bp', 'wp', -1)} AS INTEGER) AS backward_black FROM boards")
def backward_pawns(spark, d):
    facts = bb.fingerprint({p: F.col(p) for p in bb.PIECES}, F.col("rights"))
    return _boards(spark, d).select("id", *[facts[n].alias(n) for n in ("backward_white", "backward_black")])


def _mature(s: str, name: str, rank: int) -> str:
    gone = lambda files: f"({len(files)} - bit_count({s}p & {bb._bits([rank + f for f in files])}::UBIGINT))"
    return f"""({_away(s + 'n')} + {_away(s + 'b')}) / 4.0 AS minors_{name}, CASE WHEN starts_with({_castled(s)}, 'castled') THEN 1.0 WHEN {_castled(s)} = 'king_moved' THEN 0.5 ELSE 0.0 END AS castled_{name},
        {gone((3, 4))} / 2.0 AS centre_left_{name}, {gone((2, 3, 4, 5))} / 4.0 AS centre_files_{name}"""


_PARTS = [f"{part}_{side}" for part in ("minors", "castled", "centre_left", "centre_files") for side in ("white", "black")]


@query(BOARDS + f""", m AS (SELECT id % 50 AS structure, 1 + id % 3 AS weight, {_mature('w', 'white', 8)}, {_mature('b', 'black', 48)} FROM boards)
    SELECT structure, {", ".join(f"round(sum(weight * {p}) / sum(weight), 6) AS {p}" for p in _PARTS)}, round(({" + ".join(f"sum(weight * {p}) / sum(weight)" for p in _PARTS)}) / 8, 6) AS development_level FROM m GROUP BY structure""")
def maturity_components(spark, d):
    """Weighted means of the eight components by structure, and their mean, the development level."""
    parts = bb.maturity({p: F.col(p) for p in bb.PIECES}, F.col("rights"))
    rows = _boards(spark, d).select((F.col("id") % 50).alias("structure"), (1 + F.col("id") % 3).alias("weight"), *[c.alias(n) for n, c in parts.items()])
    mean = {p: F.sum(F.col("weight") * F.col(p)) / F.sum("weight") for p in _PARTS}
    level = sum(mean.values(), F.lit(0.0)) / 8
    return rounded(rows.groupBy("structure").agg(*[c.alias(p) for p, c in mean.items()], level.alias("development_level")))


def _queen(s: str) -> str:
    square = f"bit_count({s}q - 1)"
    return f"'{s}_queen=' || CASE WHEN bit_count({s}q) = 1 THEN substr('abcdefgh', CAST({square} % 8 + 1 AS INTEGER), 1) || ({square} // 8 + 1) ELSE 'absent_or_multiple' END"


def _rook(s: str) -> str:
    return f"'{s}_rook_on_open_file=' || CASE WHEN " + " OR ".join(f"({_file('wp', f)} = 0 AND {_file('bp', f)} = 0 AND {_file(s + 'r', f)} > 0)" for f in range(8)) + " THEN 1 ELSE 0 END"


_side = lambda s, n: f"{_castled(s)} AS castling_{n}, {_queen(s).replace(f'{s}q - 1', f'CASE WHEN {s}q > 0 THEN {s}q - 1 ELSE 0 END')} AS queen_{n}, '{s}_bishops_developed=' || least(2, {_away(s + 'b')}) AS bishops_{n}, '{s}_knights_developed=' || least(2, {_away(s + 'n')}) AS knights_{n}, {_rook(s)} AS open_file_rook_{n}"


@query(BOARDS + f" SELECT id, {_side('w', 'white')}, {_side('b', 'black')}, CAST(least(4, ({_dev('w')} + {_dev('b')}) // 2) AS INTEGER) AS development_total, CAST(greatest(-2, least(2, {_dev('w')} - {_dev('b')})) AS INTEGER) AS development_imbalance FROM boards")
def split_features(spark, d):
    """The twelve features by which families are split, for every board."""
    found = bb.split_features({p: F.col(p) for p in bb.PIECES}, F.col("rights"))
    return _boards(spark, d).select("id", *[c.alias(n) for n, c in found.items()])


@query(BOARDS + f""", w AS (SELECT id % 50 AS structure, 1 + id % 3 AS weight, {_castled('w')} AS white_castled, {_castled('b')} AS black_castled,
        CASE WHEN {_dev('w')} + {_dev('b')} <= 3 THEN 'undeveloped' WHEN {_dev('w')} + {_dev('b')} <= 7 THEN 'partial' ELSE 'developed' END AS dev_status FROM boards),
    u AS (SELECT structure, weight, unnest(['castling_white', 'castling_black', 'development']) AS fact, unnest([white_castled, black_castled, dev_status]) AS value FROM w)
    SELECT structure, fact, value, round(sum(weight) / sum(sum(weight)) OVER (PARTITION BY structure, fact), 6) AS share FROM u GROUP BY structure, fact, value""")
def state_distributions(spark, d):
    """Weighted shares of castling and development states by structure."""
    from pyspark.sql import Window

    facts = bb.fingerprint({p: F.col(p) for p in bb.PIECES}, F.col("rights"))
    rows = _boards(spark, d).select((F.col("id") % 50).alias("structure"), (1 + F.col("id") % 3).alias("weight"), *[facts[n].alias(n) for n in ("white_castled", "black_castled", "dev_status")])
    rows = rows.selectExpr("structure", "weight", "stack(3, 'castling_white', white_castled, 'castling_black', black_castled, 'development', dev_status) AS (fact, value)")
    rows = rows.groupBy("structure", "fact", "value").agg(F.sum("weight").alias("w"))
    return rounded(rows.select("structure", "fact", "value", (F.col("w") / F.sum("w").over(Window.partitionBy("structure", "fact"))).alias("share")))
