"""Pawn-structure facts as bit algebra on 64-bit masks (bit = 8 * rank + file, rank 0 at the bottom)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

FILES = [0x0101010101010101 << f for f in range(8)]


def signed(mask: int) -> int:
    """A 64-bit pattern as the long that holds it."""
    return mask - (1 << 64) if mask >> 63 else mask


def _and(board: Column, mask: int) -> Column:
    return board.bitwiseAND(F.lit(signed(mask)).cast("long"))


def on_file(board: Column, f: int) -> Column:
    return F.bit_count(_and(board, FILES[f]))


def _sum(columns: list[Column]) -> Column:
    return reduce(lambda a, b: a + b, columns)


def _flag(condition: Column) -> Column:
    return condition.cast("int")


def islands(board: Column) -> Column:
    """Runs of neighbouring files with pawns."""
    has = [on_file(board, f) > 0 for f in range(8)]
    return _sum([_flag(has[f] & ~has[f - 1]) if f else _flag(has[0]) for f in range(8)])


def isolated(board: Column) -> Column:
    """Pawns without a pawn on a neighbouring file."""
    alone = lambda f: reduce(lambda a, b: a & b, [on_file(board, g) == 0 for g in (f - 1, f + 1) if 0 <= g < 8])
    return _sum([F.when(alone(f), on_file(board, f)).otherwise(0) for f in range(8)])


def doubled(board: Column) -> Column:
    """Pawns beyond the first of their file."""
    return _sum([F.greatest(on_file(board, f) - 1, F.lit(0)) for f in range(8)])


def _down(board: Column, bits: int) -> Column:
    return F.shiftrightunsigned(board, bits)


def _beside(board: Column) -> Column:
    """The squares next to the bits that are set, on the files to both sides."""
    return _down(_and(board, ~FILES[0] & (1 << 64) - 1), 1).bitwiseOR(F.shiftleft(_and(board, ~FILES[7] & (1 << 64) - 1), 1))


def _fill(board: Column, shift) -> Column:
    """The bits and all squares that lie from them in the direction of `shift`, to the edge."""
    for step in (8, 16, 32):
        board = board.bitwiseOR(shift(board, step))
    return board


def _count(board: Column) -> Column:
    return F.coalesce(F.bit_count(board), F.lit(0))


def passed(own: Column, other: Column, white: bool = True) -> Column:
    """Pawns that no enemy pawn can stop or take on their way."""
    shift = _down if white else F.shiftleft
    behind = _fill(shift(other, 8), shift)
    return _count(own.bitwiseAND(F.bitwise_not(behind.bitwiseOR(_beside(behind)))))


def backward(own: Column, other: Column) -> Column:
    """White pawns with no own pawn level or behind on a neighbouring file whose next square an enemy pawn guards."""
    supported = _beside(_fill(own, F.shiftleft))
    return _count(own.bitwiseAND(F.bitwise_not(supported)).bitwiseAND(_beside(_down(other, 16))))


def centre(white: Column, black: Column) -> Column:
    """Eight bits: the pawns on d4, e4, d5, e5 of white, then of black."""
    squares = (27, 28, 35, 36)
    bits = [F.shiftleft(F.shiftrightunsigned(board, s).bitwiseAND(1), k + 4 * side).cast("int") for side, board in enumerate((white, black)) for k, s in enumerate(squares)]
    return reduce(lambda a, b: a.bitwiseOR(b), bits)


def open_files(white: Column, black: Column) -> Column:
    return _sum([_flag((on_file(white, f) == 0) & (on_file(black, f) == 0)) for f in range(8)])


def semi_open_files(own: Column, other: Column) -> Column:
    return _sum([_flag((on_file(own, f) == 0) & (on_file(other, f) > 0)) for f in range(8)])


def squares(board: Column) -> Column:
    """The numbers of the bits that are set."""
    return F.filter(F.sequence(F.lit(0), F.lit(63)), lambda s: F.getbit(board, s) == 1)


def distance(a: Column, b: Column) -> Column:
    return F.bit_count(a.bitwiseXOR(b))


def from_hex(text: Column) -> Column:
    """A mask stored as 16 hex digits; bit 63 makes the long negative."""
    return F.conv(text, 16, -10).cast("long")


def castling_state(king: Column, king_home: Column, kingside_right: Column, queenside_right: Column, castled_short: Column, castled_long: Column) -> Column:
    return (
        F.when(king == castled_short, "castled_short").when(king == castled_long, "castled_long").when(king != king_home, "king_moved")
        .when(kingside_right & queenside_right, "both_rights").when(kingside_right, "short_only").when(queenside_right, "long_only").otherwise("lost_rights")
    )


def developed(minors: Column, home: int) -> Column:
    """Home squares that their pieces have left."""
    return F.lit(home.bit_count()) - F.bit_count(_and(minors, home))


def diagram(white: Column, black: Column) -> Column:
    """Eight ranks of P, p and dots, the top rank first."""
    sign = lambda s: F.when(F.getbit(white, s) == 1, "P").when(F.getbit(black, s) == 1, "p").otherwise(".")
    rank = lambda r: F.array_join(F.transform(F.sequence(F.lit(0), F.lit(7)), lambda f: sign(r * 8 + f)), "")
    return F.array_join(F.transform(F.sequence(F.lit(7), F.lit(0), F.lit(-1)), rank), "\n")


# --- facts of whole boards -------------------------------------------------------------------------------------------

PIECES = tuple(side + kind for side in "wb" for kind in "pnbrqk")
#: Home squares by piece.
HOMES = {"wn": (1, 6), "wb": (2, 5), "wr": (0, 7), "wq": (3,), "wk": (4,), "bn": (57, 62), "bb": (58, 61), "br": (56, 63), "bq": (59,), "bk": (60,)}


def _bits(squares_: tuple[int, ...] | list[int]) -> int:
    return sum(1 << s for s in squares_)


def mirror_mask(board: Column) -> Column:
    """The mask with its ranks turned upside down: a side's facts by the other side's functions."""
    byte = lambda k: F.shiftleft(F.shiftrightunsigned(board, 8 * k).bitwiseAND(255), 8 * (7 - k))
    return reduce(lambda a, b: a.bitwiseOR(b), [byte(k) for k in range(8)])


def open_file_mask(white: Column, black: Column) -> Column:
    """Eight bits: the files without any pawn."""
    return reduce(lambda a, b: a.bitwiseOR(b), [F.when((on_file(white, f) == 0) & (on_file(black, f) == 0), 1 << f).otherwise(0) for f in range(8)])


def semi_open_mask(own: Column, other: Column) -> Column:
    return reduce(lambda a, b: a.bitwiseOR(b), [F.when((on_file(own, f) == 0) & (on_file(other, f) > 0), 1 << f).otherwise(0) for f in range(8)])


def material(board: dict[str, Column]) -> Column:
    """Counts of both sides, as 'W:Q1R2B2N2P8 B:...'."""
    side = lambda s: F.concat(F.lit(f"{s.upper()}:"), *[F.concat(F.lit(k.upper()), F.bit_count(board[s + k]).cast("string")) for k in "qrbnp"])
    return F.concat_ws(" ", side("w"), side("b"))


def castled(board: dict[str, Column], rights: Column, side: str) -> Column:
    """A side's castling by its king's square, else by the rights that are left ('KQkq')."""
    base = 0 if side == "w" else 56
    king, short, long = board[side + "k"], "K" if side == "w" else "k", "Q" if side == "w" else "q"
    at = lambda s: king == F.lit(signed(1 << (base + s))).cast("long")
    k, q = F.contains(rights, F.lit(short)), F.contains(rights, F.lit(long))
    return (
        F.when(at(6), "castled_kingside").when(at(2), "castled_queenside").when(k & q, "available_both").when(k, "available_kingside")
        .when(q, "available_queenside").when((king == 0) | at(4), "none").otherwise("king_moved")
    )


def away(board: dict[str, Column], piece: str) -> Column:
    """Pieces of a kind that stand off their home squares."""
    return F.bit_count(_and(board[piece], ~_bits(HOMES[piece]) & (1 << 64) - 1))


def development(board: dict[str, Column], side: str) -> Column:
    """Pieces off their home squares, the king included; a castled king's rook counts with its king."""
    base, king = (0 if side == "w" else 56), board[side + "k"]
    at = lambda s: king == F.lit(signed(1 << (base + s))).cast("long")
    rook = F.when(at(6), F.getbit(board[side + "r"], F.lit(base + 5))).when(at(2), F.getbit(board[side + "r"], F.lit(base + 3))).otherwise(F.lit(0)).cast("int")
    moved = _flag((king != 0) & ~at(4))
    return _sum([away(board, side + k) for k in "nbrq"]) - rook + moved


def development_status(white: Column, black: Column) -> Column:
    return F.when(white + black <= 3, "undeveloped").when(white + black <= 7, "partial").otherwise("developed")


def fingerprint(board: dict[str, Column], rights: Column) -> dict[str, Column]:
    """All structural facts of a board but its structure id (see `with_structure_id`); masks by piece name, as in PIECES."""
    wp, bp = board["wp"], board["bp"]
    dev = {s: development(board, s) for s in "wb"}
    out = {"centre_config": centre(wp, bp), "open_files": open_files(wp, bp), "open_file_mask": open_file_mask(wp, bp), "semi_open_white": semi_open_mask(wp, bp), "semi_open_black": semi_open_mask(bp, wp)}
    for name, f in (("islands", islands), ("isolated", isolated), ("doubled", doubled)):
        out |= {f"{name}_white": f(wp), f"{name}_black": f(bp)}
    # black's backward pawns are white's on the board turned upside down
    out |= {"backward_white": backward(wp, bp), "backward_black": backward(mirror_mask(bp), mirror_mask(wp)), "passed_white": passed(wp, bp), "passed_black": passed(bp, wp, white=False)}
    out |= {"material": material(board), "castling_rights": rights, "white_castled": castled(board, rights, "w"), "black_castled": castled(board, rights, "b")}
    return out | {"dev_white": dev["w"], "dev_black": dev["b"], "dev_status": development_status(dev["w"], dev["b"])}


def maturity(board: dict[str, Column], rights: Column) -> dict[str, Column]:
    """Development of each side between 0 and 1: minor pieces, castling, centre pawns, centre files."""
    out = {}
    for side, name, rank in (("w", "white", 8), ("b", "black", 48)):
        pawns = board[side + "p"]
        gone = lambda files: F.lit(len(files)) - F.bit_count(_and(pawns, _bits([rank + f for f in files])))  # noqa: B023, E731
        state = castled(board, rights, side)
        out[f"minors_{name}"] = (away(board, side + "n") + away(board, side + "b")) / 4.0
        out[f"castled_{name}"] = F.when(F.startswith(state, F.lit("castled")), 1.0).when(state == "king_moved", 0.5).otherwise(0.0)
        out[f"centre_left_{name}"] = gone((3, 4)) / 2.0
        out[f"centre_files_{name}"] = gone((2, 3, 4, 5)) / 4.0
    return out


def split_features(board: dict[str, Column], rights: Column) -> dict[str, Column]:
    """Twelve facts by which a family's boards may be split into groups."""
    out, dev, files = {}, {s: development(board, s) for s in "wb"}, open_file_mask(board["wp"], board["bp"])
    for side, name in (("w", "white"), ("b", "black")):
        queen = board[side + "q"]
        square = _sum([F.shiftleft(F.bit_count(_and(queen, _bits([s for s in range(64) if s >> k & 1]))), k) for k in range(6)])  # of a single bit: its place
        where = F.concat(F.substring(F.lit("abcdefgh"), square % 8 + 1, F.lit(1)), (F.floor(square / 8) + 1).cast("string"))
        rook_files = reduce(lambda a, b: a.bitwiseOR(b), [F.when(on_file(board[side + "r"], f) > 0, 1 << f).otherwise(0) for f in range(8)])
        out[f"castling_{name}"] = castled(board, rights, side)
        out[f"queen_{name}"] = F.concat(F.lit(f"{side}_queen="), F.when(F.bit_count(queen) == 1, where).otherwise("absent_or_multiple"))
        for kind, plural in (("b", "bishops"), ("n", "knights")):
            out[f"{plural}_{name}"] = F.concat(F.lit(f"{side}_{plural}_developed="), F.least(F.lit(2), away(board, side + kind)).cast("string"))
        out[f"open_file_rook_{name}"] = F.concat(F.lit(f"{side}_rook_on_open_file="), _flag(files.bitwiseAND(rook_files) != 0).cast("string"))
    out["development_total"] = F.least(F.lit(4), F.floor((dev["w"] + dev["b"]) / 2)).cast("int")
    out["development_imbalance"] = F.greatest(F.lit(-2), F.least(F.lit(2), dev["w"] - dev["b"]))
    return out


def with_structure_id(rows, white: str = "wp", black: str = "bp", name: str = "structure_id"):
    """`rows` with the id of their pawn structure: the hex digest (BLAKE2b of 8 bytes) of both masks, little-endian.

    Spark has no BLAKE2b; the digest is made by Arrow batches, once for each row.
    """
    import hashlib
    import struct

    import pyarrow as pa

    def run(batches):
        for batch in batches:
            masks = zip(*[batch.column(batch.schema.get_field_index(c)).to_pylist() for c in (white, black)])
            ids = [None if w is None or b is None else hashlib.blake2b(struct.pack("<2q", w, b), digest_size=8).hexdigest() for w, b in masks]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(ids, pa.string())], names=[*batch.schema.names, name])

    return rows.mapInArrow(run, rows.withColumn(name, F.lit(None).cast("string")).schema)
