"""Standings: one row per (game, user) or per user, derived from scores."""

from pyspark.sql import functions as F
from pyspark.sql import types as T

from podium.functions.sizes import touched_games
from podium.functions.values import best_of, event_key
from podium.schemas import SCORE

BEST, LATEST = "best", "latest"

STORED = T.StructType(
    [
        T.StructField("game_id", T.LongType()),
        T.StructField("user_id", T.LongType()),
        T.StructField("score", SCORE),
        T.StructField("submitted_at", T.TimestampNTZType()),
        T.StructField("n", T.LongType()),
    ]
)


def latest_standings(scores):
    """The last submission of every (game, user) counts."""
    key = event_key()
    return scores.groupBy("game_id", "user_id").agg(
        F.max_by("score", key).alias("score"),
        F.max("submitted_at").alias("submitted_at"),
        F.count(F.lit(1)).alias("n"),
    )


def best_standings(scores, games):
    """The best submission of every (game, user) counts: max or min by score type."""
    return _typed_best(scores, games).drop("score_type")


def _typed_best(scores, games):
    extremes = scores.groupBy("game_id", "user_id").agg(
        F.max("score").alias("_top"),
        F.min("score").alias("_low"),
        F.max("submitted_at").alias("submitted_at"),
        F.count(F.lit(1)).alias("n"),
    )
    typed = extremes.join(games.select("game_id", "score_type"), "game_id")
    return typed.select(
        "game_id",
        "user_id",
        best_of(F.col("_top"), F.col("_low")).alias("score"),
        "submitted_at",
        "n",
        "score_type",
    )


def standings(scores, games, kind=BEST):
    """Standings of either kind with the score type of the game."""
    if kind == BEST:
        return _typed_best(scores, games)
    if kind == LATEST:
        return latest_standings(scores).join(games.select("game_id", "score_type"), "game_id")
    raise ValueError(f"kind must be {BEST!r} or {LATEST!r}, not {kind!r}")


def global_latest(scores):
    """The last raw score of every user in any game, named as the boards name it."""
    return scores.groupBy("user_id").agg(F.max_by("score", event_key()).alias("total_score"))


def global_total(scores, games):
    """Sum of a user's best scores over the games where high scores win."""
    high = games.filter(F.col("score_type") == "highest").select("game_id")
    best = scores.join(high, "game_id").groupBy("game_id", "user_id").agg(
        F.max("score").alias("score")
    )
    return best.groupBy("user_id").agg(F.sum("score").alias("total_score"))


def board_sizes(scores):
    """Players per game."""
    pairs = scores.groupBy("game_id", "user_id").agg(F.lit(1).alias("one"))
    return pairs.groupBy("game_id").agg(F.count(F.lit(1)).alias("total_players"))


def rebuilt(scores, games, selected):
    """Best standings of the games that occur in ``selected`` scores."""
    chosen = scores.join(touched_games(selected, games), "game_id", "left_semi")
    return best_standings(chosen, games)


def _dynamic(writer):
    return writer.option("partitionOverwriteMode", "dynamic").mode("overwrite")


def _static(writer):
    return writer.option("partitionOverwriteMode", "static").mode("overwrite")


def store_standings(board, path):
    """Write standings, one folder per game; only the games present are replaced.

    Rows are dealt out by game first, large games in several parts of a sensible size, so a game
    has few files however many tasks made its rows.
    """
    dealt = board.hint("rebalance", "game_id")
    _dynamic(dealt.write).partitionBy("game_id").parquet(path)


def rebuild(scores, games, selected, path):
    """Replace the stored boards of the selected scores' games by their best standings."""
    store_standings(rebuilt(scores, games, selected), path)


def clear_board(spark, path, game_id=None):
    """Leave no rows of one game, or of any game, in the stored boards."""
    empty = spark.createDataFrame([], STORED)
    if game_id is None:
        _static(empty.write).partitionBy("game_id").parquet(path)
    else:
        folder = f"{path.rstrip('/')}/game_id={int(game_id)}"
        _static(empty.drop("game_id").write).parquet(folder)


def stored_standings(spark, path):
    return spark.read.schema(STORED).parquet(path)
