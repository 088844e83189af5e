"""Broadcasts behind a check of the size."""

from pyspark.sql import functions as F

ROW_BOUND = 500_000  # rows of a few dozen bytes each


def per_game(rows, games, each=1, bound=ROW_BOUND):
    """``rows``, which hold at most ``each`` rows per game, broadcast when the games are few.

    The games are counted (for Parquet from the file footers). Beyond the bound the join is left
    to Spark.
    """
    return F.broadcast(rows) if games.count() * each <= bound else rows


def counted_broadcast(rows, bound=ROW_BOUND):
    """``rows`` broadcast when few. They are counted, so they should be cheap to read again."""
    return F.broadcast(rows) if rows.count() <= bound else rows


def touched_games(rows, games):
    """The known games that occur in ``rows``, as game_id, to restrict other tables by."""
    ids = rows.select("game_id").distinct()
    return per_game(games.select("game_id").join(ids, "game_id", "left_semi"), games)
