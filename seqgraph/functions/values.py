"""Scalar value functions over Columns: expected points, intervals, priorities and classes."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def ep_from_wdl(w: Column, d: Column, b: Column) -> Column:
    """(w + d / 2) / n; null without games."""
    return F.try_divide(w + d / 2, w + d + b)


def ep_from_cp(cp: Column) -> Column:
    return 1 / (1 + F.pow(F.lit(10.0), -cp / 400))


def ep_from_mate(mate: Column) -> Column:
    return F.when(mate > 0, 1.0).when(mate <= 0, 0.0)


def ep_from_score(wdl_ep: Column, mate: Column, cp: Column) -> Column:
    """Win/draw/loss first, then mates, then centipawns."""
    return F.coalesce(wdl_ep, ep_from_mate(mate), ep_from_cp(cp))


def flip_ep(ep: Column) -> Column:
    """The same value from the other side."""
    return 1 - ep


def wilson(successes: Column, n: Column, z: float = 1.96) -> tuple[Column, Column]:
    """The Wilson interval; (0, 1) where there are no trials."""
    p, z2 = successes / n, z * z
    centre = (p + z2 / (2 * n)) / (1 + z2 / n)
    half = z * F.sqrt(p * (1 - p) / n + z2 / (4 * n * n)) / (1 + z2 / n)
    return F.when(n > 0, F.greatest(F.lit(0.0), centre - half)).otherwise(0.0), F.when(n > 0, F.least(F.lit(1.0), centre + half)).otherwise(1.0)


def knowledge_gap(population_regret: Column, expert_regret: Column) -> Column:
    """Regret of the population over the experts'; null if either is, negative gaps stay."""
    return population_regret - expert_regret


def study_priority(reach: Column, gap: Column) -> Column:
    return reach * F.greatest(gap, F.lit(0.0))


def deviation_class(loss: Column) -> Column:
    """playable up to 0.02, inaccurate up to 0.10, else punishable; unknown without a loss."""
    return F.when(loss.isNull(), "unknown").when(loss <= 0.02, "playable").when(loss <= 0.10, "inaccurate").otherwise("punishable")


def structure_class(dwell: Column, retention: Column) -> Column:
    return F.when((dwell < 2) | (retention < 0.25), "transit").when((dwell >= 3) & (retention >= 0.5), "strategic_attractor").otherwise("intermediate")


def attractor_score(coverage: Column, dwell: Column, paths: Column) -> Column:
    return coverage * dwell * (1 + F.log10(1 + paths))


def confidence(games: Column, evaluated: Column, mass: Column) -> Column:
    """high, medium or low by three bounds that must hold together."""
    return F.when((games >= 200) & (evaluated >= 3) & (mass >= 0.9), "high").when((games >= 50) & (evaluated >= 2) & (mass >= 0.7), "medium").otherwise("low")


def information_score(p: Column, q: Column) -> Column:
    return p * F.log2((p + 1e-6) / (q + 1e-6))


def hash_fraction(seed: str, key: Column) -> Column:
    """The first 32 bits of sha256(seed:key) as a fraction: a seeded draw that any engine repeats."""
    return F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), key.cast("string")), 256), 1, 8), 16, 10).cast("double") / 4294967296.0


def stable_id(*parts: Column) -> Column:
    return F.sha1(F.concat_ws("|", *[p.cast("string") for p in parts]))


def month_ordinal(text: Column) -> Column:
    """yyyymm of a date text with '-' or '.'; 0 if it can't be read."""
    return F.coalesce(F.regexp_replace(F.substring(text, 1, 7), "[.-]", "").try_cast("int"), F.lit(0))


def eval_text(cp: Column, mate: Column) -> Column:
    """+1.25 or #3."""
    return F.when(mate.isNotNull(), F.concat(F.lit("#"), mate.cast("string"))).otherwise(F.format_string("%+.2f", cp / 100))


def base_name(name: Column) -> Column:
    """What stands before the first colon."""
    return F.trim(F.split_part(name, F.lit(":"), F.lit(1)))


def mirror_key(placement: Column) -> Column:
    """The colour-swapped twin of a board placement: ranks reversed, case swapped."""
    upper, lower = "KQRBNP", "kqrbnp"
    return F.array_join(F.reverse(F.split(F.translate(placement, upper + lower, lower + upper), "/")), "/")


def pack_move(start: Column, end: Column, promotion: Column) -> Column:
    return start.bitwiseOR(F.shiftleft(end, 6)).bitwiseOR(F.shiftleft(promotion, 12))


def unpack_move(move: Column) -> tuple[Column, Column, Column]:
    return move.bitwiseAND(63), F.shiftright(move, 6).bitwiseAND(63), F.shiftright(move, 12)
