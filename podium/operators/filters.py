"""Filters, search and enrichment over scores, games and users."""

from datetime import timedelta
from functools import reduce

from pyspark.sql import functions as F

from podium.functions.sizes import counted_broadcast, per_game
from podium.functions.times import as_datetime, local_time


class UnknownGame(ValueError):
    """The asked game is not in the games table."""


def check_game(games, game_id):
    """Raise unless the game exists (looks for one row of the games table)."""
    if not games.filter(F.col("game_id") == game_id).limit(1).count():
        raise UnknownGame(f"Game not found: {game_id}")


def of_game(scores, game_id=None, games=None):
    """Scores of one game; all when no game is named. With ``games`` an unknown id is an error."""
    if game_id is None:
        return scores
    if games is not None:
        check_game(games, game_id)
    return scores.filter(F.col("game_id") == game_id)


def active_games(games):
    return games.filter("is_active").orderBy("game_name")


def visible_games(games, staff=False):
    """Staff see all games, others the active ones."""
    return games if staff else games.filter("is_active")


def with_names(scores, games, users):
    """Game name and user email on every score, for lists. Games are few; users join by size."""
    return scores.join(games.select("game_id", "game_name", "score_type"), "game_id").join(
        users.select("user_id", F.col("email").alias("user_email"), F.col("name").alias("user_name")),
        "user_id",
    )


def own_scores(scores, games, user_id):
    """All scores of one user with their game."""
    mine = scores.filter(F.col("user_id") == user_id)
    return mine.join(games.select("game_id", "game_name", "score_type", "is_active"), "game_id")


def has_metadata(scores):
    """Scores whose metadata is not the empty object."""
    return scores.filter(~F.col("metadata").rlike(r"^\s*\{\s*\}\s*$"))


def _any_contains(word, cols):
    return reduce(lambda a, b: a | b, [F.lower(F.col(c)).contains(word.lower()) for c in cols])


def _matches(query, cols):
    """Every word of the query occurs in some column, letter case ignored."""
    return reduce(lambda a, b: a & b, [_any_contains(w, cols) for w in query.split()], F.lit(True))


def _found_words(query, cols):
    """The words of the query that occur in some column, as bits."""
    bits = [F.when(_any_contains(w, cols), 1 << i).otherwise(0) for i, w in enumerate(query.split())]
    return reduce(lambda a, b: a + b, bits, F.lit(0)).cast("bigint")


def search_scores(scores, games, users, query):
    """Scores whose user email, user name or game name hold every word of ``query``.

    Users and games are searched first. A score needs a user that has the words its game lacks, so
    only users with any of the words meet the scores, and names are attached to what was found.
    """
    every = (1 << len(query.split())) - 1
    kinds = games.select(
        "game_id", "game_name", "score_type", _found_words(query, ["game_name"]).alias("_in_game")
    )
    people = users.select("user_id", _found_words(query, ["email", "name"]).alias("_in_user"))
    people = counted_broadcast(people.filter("_in_user <> 0"))
    met = scores.join(per_game(kinds, games), "game_id").join(people, "user_id", "left")
    both = F.col("_in_game").bitwiseOR(F.coalesce("_in_user", F.lit(0)))
    found = met.filter(both == every)
    names = users.select("user_id", F.col("email").alias("user_email"), F.col("name").alias("user_name"))
    return found.join(names, "user_id").select(
        *scores.columns, "game_name", "score_type", "user_email", "user_name"
    )


def search_games(games, query):
    return games.filter(_matches(query, ["game_name", "description"]))


def search_users(users, query):
    return users.filter(_matches(query, ["name"]))


def facet(rows, col):
    """Counts per value of a list filter, such as game_id, score_type or is_active."""
    return rows.groupBy(col).agg(F.count(F.lit(1)).alias("count"))


def score_facets(scores, games):
    """Counts by game and by score type as (facet, value, count), from one pass over the scores."""
    by_game = scores.groupBy("game_id").agg(F.count(F.lit(1)).alias("n"))
    named = by_game.join(games.select("game_id", "game_name", "score_type"), "game_id")
    sets = named.groupingSets([["game_name"], ["score_type"]], "game_name", "score_type")
    counts = sets.agg(F.sum("n").alias("count"), F.grouping("game_name").alias("_of_type"))
    of_type = F.col("_of_type") == 1
    return counts.select(
        F.when(of_type, "score_type").otherwise("game").alias("facet"),
        F.when(of_type, F.col("score_type")).otherwise(F.col("game_name")).alias("value"),
        "count",
    )


def game_facets(games, tz="UTC"):
    """Games by activity, score type and day of creation as (facet, value, count)."""
    facets = {
        "is_active": F.col("is_active").cast("string"),
        "score_type": F.col("score_type"),
        "created": F.to_date(local_time("created_at", tz)).cast("string"),
    }
    each = F.array(
        *(F.struct(F.lit(n).alias("facet"), c.alias("value")) for n, c in facets.items())
    )
    spread = games.select(F.explode(each).alias("f"))
    return spread.groupBy("f.facet", "f.value").agg(F.count(F.lit(1)).alias("count"))


def date_drilldown(scores, tz="UTC"):
    """Counts by year, year and month, and full date; coarser rows have nulls."""
    # Counted per day first, so the rollup expands days and not scores.
    when = local_time("submitted_at", tz)
    days = scores.groupBy(F.to_date(when).alias("d")).agg(F.count(F.lit(1)).alias("n"))
    parts = days.select(
        F.year("d").cast("bigint").alias("year"),
        F.month("d").cast("bigint").alias("month"),
        F.day("d").cast("bigint").alias("day"),
        "n",
    )
    return parts.rollup("year", "month", "day").agg(F.sum("n").alias("submissions")).filter(
        F.col("year").isNotNull()
    )


def submitted_when(scores, choice, as_of, tz="UTC"):
    """The date choices of a list filter: today, past_7_days, this_month or this_year."""
    today = as_datetime(as_of).date()
    day = F.to_date(local_time("submitted_at", tz))
    starts = {
        "today": today,
        "past_7_days": today - timedelta(days=7),
        "this_month": today.replace(day=1),
        "this_year": today.replace(month=1, day=1),
    }
    if choice not in starts:
        raise ValueError(f"choice must be one of {', '.join(starts)}, not {choice!r}")
    return scores.filter((day >= F.lit(starts[choice])) & (day <= F.lit(today)))
