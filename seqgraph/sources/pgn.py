"""Game collections in PGN text: header columns first, moves only of games that pass the header checks."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import chess

#: Headers that become columns.
HEADERS = ("Event", "Date", "White", "Black", "WhiteElo", "BlackElo", "Result", "Variant", "SetUp", "FEN", "TimeControl")


#: Names of the ordinary game.
VARIANTS = ("", "standard", "chess", "normal")


def read_games(spark: SparkSession, path: str) -> DataFrame:
    """game_id (a hash of the text), one column for each header, movetext. Splits of large files stay splittable."""
    rows = spark.read.option("lineSep", "\n[Event ").text(path).where("trim(value) <> ''")
    text = F.regexp_replace(F.when(F.col("value").startswith("[Event "), F.col("value")).otherwise(F.concat(F.lit("[Event "), "value")), "\r", "")
    text = F.regexp_replace(text, "^\ufeff", "")
    rows = rows.select(text.alias("text"))
    header = lambda name: F.regexp_extract("text", rf'(?m)^\[{name} "([^"]*)"\]', 1)
    moves = F.trim(F.regexp_replace("text", r'(?m)^\[\w+ "[^"]*"\]\s*', ""))
    return rows.select(F.xxhash64("text").alias("game_id"), *[header(h).alias(h) for h in HEADERS], moves.alias("movetext"))


def both_at_least(white, black, least: int):
    """Whether both ratings are known and reach `least`."""
    return F.when(white.isNotNull() & black.isNotNull(), F.least(white, black) >= least).otherwise(False)


def with_reason(games: DataFrame, minimum: int = 0) -> DataFrame:
    """Adds outcome (0 white, 1 draw, 2 black), strong (both ratings >= 2200) and the last failing header check's reason."""
    outcome = F.when(F.col("Result") == "1-0", 0).when(F.col("Result") == "1/2-1/2", 1).when(F.col("Result") == "0-1", 2)
    white, black = (F.col(c).try_cast("int") for c in ("WhiteElo", "BlackElo"))
    low = F.when(white.isNotNull() & black.isNotNull(), F.least(white, black))
    rows = games.withColumn("outcome", outcome).withColumn("strong", both_at_least(white, black, 2200))
    placed = F.coalesce(F.trim("FEN"), F.lit(""))
    own_start = (placed != "") & (F.array_join(F.slice(F.split(placed, r"\s+"), 1, 4), " ") != chess.START)
    failed = F.when(own_start, "start").when(~F.lower(F.trim(F.coalesce("Variant", F.lit("")))).isin(*VARIANTS), "variant").when(F.col("outcome").isNull(), "unknown_result")
    rating = F.when(F.coalesce(low < minimum, F.lit(minimum > 0)), "rating")
    return rows.withColumn("reason", F.coalesce(failed, rating))


def _replayed(batches):
    for batch in batches:
        out = {"game_id": [], "ply": [], "state": [], "action": [], "san": [], "error": []}
        for game, text in zip(batch.column("game_id").to_pylist(), batch.column("movetext").to_pylist()):
            try:
                steps, error = chess.replay(text), None
            except (chess.IllegalMove, IndexError) as e:
                steps, error = [("", "", "")], f"parse_error: {e}"
            for ply, (key, uci, san) in enumerate(steps):
                for name, value in zip(out, (game, ply, key, uci or None, san or None, error)):
                    out[name].append(value)
        kinds = (pa.int64(), pa.int32(), *[pa.string()] * 4)
        yield pa.RecordBatch.from_pydict({name: pa.array(values, kind) for (name, values), kind in zip(out.items(), kinds)})


def replay(games: DataFrame) -> DataFrame:
    """game_id, ply, state, action (uci; null at the end), san, error of games without a reason against them."""
    rows = games.where("reason IS NULL").select("game_id", "movetext")
    return rows.mapInArrow(_replayed, "game_id long, ply int, state string, action string, san string, error string")


def first_visits(games: DataFrame) -> DataFrame:
    """state, action, next_state-free first visits with outcomes, as the sequence operators take them."""
    from ..operators.sequences import first_visits as first

    steps = replay(games).where("error IS NULL").withColumn("structure", F.lit(""))
    return first(steps.select("game_id", "ply", "state", "structure", "action")).join(games.select("game_id", "outcome", "strong"), "game_id")


def exclusions(games: DataFrame) -> DataFrame:
    """reason, games: header reasons and parse errors."""
    errors = replay(games).where("error IS NOT NULL").select(F.lit("parse_error").alias("reason"))
    return games.where("reason IS NOT NULL").select("reason").unionByName(errors).groupBy("reason").agg(F.count(F.lit(1)).alias("games"))


def header_inventory(games: DataFrame) -> DataFrame:
    """Counts in one scan: games, results, both ratings at six bounds, years; no move is read."""
    low = F.least(F.col("WhiteElo").try_cast("int"), F.col("BlackElo").try_cast("int"))
    both = F.when(F.col("WhiteElo").try_cast("int").isNotNull() & F.col("BlackElo").try_cast("int").isNotNull(), low)
    return games.groupBy(F.substring("Date", 1, 4).alias("year"), "Result").agg(F.count(F.lit(1)).alias("games"), *[F.count_if(both >= b).alias(f"elo{b}") for b in (1800, 2000, 2200, 2400, 2500, 2600)])
