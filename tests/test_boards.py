"""Structural facts of single boards, by hand."""

import hashlib
import struct

import pytest
from pyspark.sql import functions as F

from seqgraph.functions import bitboards as bb
from seqgraph.functions import chess


def masks(fen):
    position = chess.Position.from_fen(fen)
    out = dict.fromkeys(bb.PIECES, 0)
    for s, p in enumerate(position.board):
        if p:
            out[("w" if p.isupper() else "b") + p.lower()] |= 1 << s
    return {k: bb.signed(v) for k, v in out.items()}, position.castling


@pytest.fixture(scope="module")
def facts(spark):
    def of(*fens):
        rows = []
        for i, fen in enumerate(fens):
            found, rights = masks(fen)
            rows.append((i, *[found[p] for p in bb.PIECES], rights))
        df = spark.createDataFrame(rows, "id int, " + ", ".join(f"{p} long" for p in bb.PIECES) + ", rights string")
        board = {p: F.col(p) for p in bb.PIECES}
        columns = bb.fingerprint(board, F.col("rights")) | bb.maturity(board, F.col("rights")) | {f"split_{k}": c for k, c in bb.split_features(board, F.col("rights")).items()}
        df = bb.with_structure_id(df)
        return [r.asDict() for r in df.select("id", "structure_id", "wp", "bp", *[c.alias(k) for k, c in columns.items()]).orderBy("id").collect()]

    return of


def test_start_and_castled(facts):
    start, castled, lone = facts(chess.START, "r1bq1rk1/ppp2ppp/2n2n2/3p4/3P4/2N2N2/PPP2PPP/R1BQ1RK1 w - -", "8/8/8/8/8/4k3/8/K6q w - -")
    assert start["material"] == "W:Q1R2B2N2P8 B:Q1R2B2N2P8" and (start["white_castled"], start["black_castled"]) == ("available_both", "available_both")
    assert (start["dev_white"], start["dev_black"], start["dev_status"]) == (0, 0, "undeveloped") and start["minors_white"] == 0
    assert start["structure_id"] == hashlib.blake2b(struct.pack("<2q", start["wp"], start["bp"]), digest_size=8).hexdigest()
    assert (castled["white_castled"], castled["black_castled"]) == ("castled_kingside", "castled_kingside")
    # two knights, the f-bishop is gone, the king counts once and its rook doesn't
    assert (castled["dev_white"], castled["dev_black"], castled["dev_status"]) == (3, 3, "partial")
    assert castled["castled_white"] == 1.0 and castled["minors_white"] == 0.5 and castled["centre_left_white"] == 1.0 and castled["centre_files_white"] == 0.5
    assert castled["open_file_mask"] == 1 << 4 and castled["split_open_file_rook_white"] == "w_rook_on_open_file=0" and castled["split_knights_white"] == "w_knights_developed=2"
    assert lone["white_castled"] == "king_moved" and lone["split_queen_black"] == "b_queen=h1" and lone["split_queen_white"] == "w_queen=absent_or_multiple" and lone["castled_white"] == 0.5


def test_pawns_mirror(facts):
    """Black's facts are white's on the board turned upside down."""
    a, b = facts("4k3/8/8/2p1p3/8/3P4/8/4K3 w - -", "4k3/8/3p4/8/2P1P3/8/8/4K3 b - -")
    assert (a["backward_white"], b["backward_black"]) == (1, 1) and (a["backward_black"], b["backward_white"]) == (2, 2)
    assert (a["passed_white"], b["passed_black"]) == (0, 0) and (a["isolated_black"], b["isolated_white"]) == (2, 2) and a["semi_open_white"] == b["semi_open_black"]
