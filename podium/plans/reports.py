"""Report sections, each one DataFrame. ``as_of`` is the moment the report is made.

Sections that the reports cut to the first n rows carry the cut as an optional ``limit``.
"""

from datetime import timedelta

from pyspark.sql import Window
from pyspark.sql import functions as F

from podium.functions.quantiles import percentiles
from podium.functions.ranks import with_rank
from podium.functions.sequences import numbered
from podium.functions.times import (
    BUCKET_UNIT,
    as_datetime,
    bucket,
    date_of,
    in_period,
    moment,
    span_days,
)
from podium.functions.values import (
    best_of,
    display_name,
    event_key,
    mean,
    ratio,
    sort_key,
    spread,
    with_json,
)
from podium.operators.filters import has_metadata, of_game
from podium.operators.ranking import TOP_BOUND, game_board
from podium.session import pinned


def _limited(rows, limit):
    return rows if limit is None else rows.limit(limit)


# --- top players ---------------------------------------------------------------------------


def top_players(
    scores, games, users, as_of, period="weekly", game_id=None, limit=10, direction_aware=False
):
    """Best players of the period, ranked 1..n; a user appears once per score type.

    The best score is the maximum, or with ``direction_aware`` the best by score type.
    Every score has a user, so the cut comes before users are joined. ``limit=None`` gives all.
    """
    if limit is not None and limit < 1:
        raise ValueError("limit must be at least 1")
    chosen = of_game(in_period(scores, "top_players", period, as_of), game_id)
    typed = chosen.join(games.select("game_id", "score_type"), "game_id")
    stats = typed.groupBy("user_id", "score_type").agg(
        F.count(F.lit(1)).alias("total_submissions"),
        F.max("score").alias("top"),
        F.min("score").alias("low"),
        mean("score").alias("average_score"),
        F.min("submitted_at").alias("first_submission"),
        F.max("submitted_at").alias("last_submission"),
    )
    best = best_of(F.col("top"), F.col("low")) if direction_aware else F.col("top")
    stats = stats.withColumn("best_score", best)
    order = [F.desc("best_score"), F.asc("user_id"), F.asc("score_type")]
    if limit is not None and limit <= TOP_BOUND:
        top = stats.orderBy(*order).limit(limit)
        first = Window.partitionBy(F.lit(0)).orderBy(*order)
        ranked = F.broadcast(top.withColumn("rank", F.row_number().over(first)))
    else:
        # The rank of all, numbered in pieces; the groups are written once for its passes.
        every = pinned(stats.withColumn("_all", F.lit(0)))
        ranked = numbered(every, ["_all"], order, "rank")
        ranked = ranked if limit is None else ranked.filter(F.col("rank") <= limit)
    return ranked.join(users, "user_id").select(
        F.col("rank").cast("bigint").alias("rank"),
        "user_id",
        F.col("email").alias("username"),
        display_name().alias("name"),
        "best_score",
        "total_submissions",
        "average_score",
        "first_submission",
        "last_submission",
    )


# --- game analytics ------------------------------------------------------------------------


def game_performance(scores, games, as_of, period="weekly", game_id=None):
    chosen = of_game(in_period(scores, "game_analytics", period, as_of), game_id)
    stats = chosen.groupBy("game_id").agg(
        F.count(F.lit(1)).alias("total_plays"),
        F.count_distinct("user_id").alias("unique_players"),
        mean("score").alias("avg_score"),
        F.max("score").alias("max_score"),
        F.min("score").alias("min_score"),
        (F.max("score") - F.min("score")).alias("score_range"),
        F.min("submitted_at").alias("first_play"),
        F.max("submitted_at").alias("last_play"),
    )
    return stats.join(games.select("game_id", "game_name", "score_type"), "game_id").select(
        F.col("game_id").alias("game__id"),
        F.col("game_name").alias("game__name"),
        F.col("score_type").alias("game__score_type"),
        *stats.columns[1:],
    )


def activity_trend(scores, as_of, period="weekly", game_id=None, tz="UTC"):
    chosen = of_game(in_period(scores, "game_analytics", period, as_of), game_id)
    start = bucket(BUCKET_UNIT[period], "submitted_at", tz)
    return chosen.groupBy(start.alias("period")).agg(
        F.count(F.lit(1)).alias("total_submissions"),
        F.count_distinct("user_id").alias("unique_players"),
        mean("score").alias("avg_score"),
    )


def score_distribution(scores, as_of, period="weekly", game_id=None):
    """Count, exact quartiles and sample standard deviation of the whole selection, in one row."""
    chosen = of_game(in_period(scores, "game_analytics", period, as_of), game_id)
    names = ["percentile_25", "percentile_50", "percentile_75"]
    quartiles = percentiles(chosen, "score", [0.25, 0.5, 0.75], names)
    totals = chosen.agg(
        F.count(F.lit(1)).alias("total_scores"), spread("score").alias("std_deviation")
    )
    # Two single rows, folded into one.
    both = totals.unionByName(quartiles, allowMissingColumns=True)
    return both.agg(*[F.max(c).alias(c) for c in ("total_scores", *names, "std_deviation")])


# --- user engagement -----------------------------------------------------------------------


def user_activity(scores, users, as_of, period="weekly", limit=50):
    """The most active users; sessions per day is null where all sessions share one instant."""
    chosen = in_period(scores, "user_engagement", period, as_of)
    stats = chosen.groupBy("user_id").agg(
        F.count(F.lit(1)).alias("total_sessions"),
        F.count_distinct("game_id").alias("games_played"),
        mean("score").alias("avg_score"),
        F.max("score").alias("best_score"),
        F.min("submitted_at").alias("first_activity"),
        F.max("submitted_at").alias("last_activity"),
    )
    top = _limited(stats.orderBy(F.desc("total_sessions"), "user_id"), limit)
    if limit is not None and limit <= TOP_BOUND:
        top = F.broadcast(top)  # at most `limit` rows
    span = span_days(F.col("first_activity"), F.col("last_activity"))
    return top.join(users.select("user_id", "email", "name"), "user_id").select(
        F.col("user_id").alias("user__id"),
        F.col("email").alias("user__email"),
        F.col("name").alias("user__name"),
        *stats.columns[1:],
        span.alias("activity_span_days"),
        ratio(F.col("total_sessions"), span).alias("sessions_per_day"),
    )


def engagement_trend(scores, as_of, period="weekly", tz="UTC"):
    """Active users and sessions per bucket; average of time_played where it is a number."""
    chosen = in_period(scores, "user_engagement", period, as_of)
    start = bucket(BUCKET_UNIT[period], "submitted_at", tz)
    timed = with_json(chosen, "time_played").select(
        start.alias("period"), "user_id", F.col("time_played").try_cast("double").alias("played")
    )
    users = F.count_distinct("user_id")
    return timed.groupBy("period").agg(
        users.alias("active_users"),
        F.count(F.lit(1)).alias("total_sessions"),
        mean("played").alias("avg_session_length"),
        users.alias("retention_rate"),
    )


def new_vs_returning(scores, users, as_of, days=7):
    """Distinct users of each of the last ``days`` UTC days: joined that day or later, or before.

    Days without scores stay, with zeros.
    """
    today = as_datetime(as_of).date()
    first = today - timedelta(days=days - 1)
    kind = scores.schema["submitted_at"].dataType
    until = F.col("submitted_at") < moment(f"{today + timedelta(days=1)} 00:00:00", kind)
    window = scores.filter(
        (F.col("submitted_at") >= moment(f"{first} 00:00:00", kind)) & until
    )
    active = window.select(date_of("submitted_at").alias("date"), "user_id").distinct()
    joined = users.select("user_id", date_of("date_joined").alias("joined"))
    counts = (
        active.join(joined, "user_id")
        .groupBy("date")
        .agg(
            F.count_if(F.col("joined") >= F.col("date")).alias("new_users"),
            F.count_if(F.col("joined") < F.col("date")).alias("returning_users"),
            F.count(F.lit(1)).alias("total_users"),
        )
    )
    spark = scores.sparkSession
    calendar = spark.range(days).select(
        F.date_add(F.lit(first), F.col("id").cast("int")).alias("date")
    )
    filled = calendar.join(counts, "date", "left")
    return filled.na.fill(0, ["new_users", "returning_users", "total_users"])


# --- leaderboard trends --------------------------------------------------------------------


def current_top(scores, games, users, game_id, n=10):
    """First ``n`` of the game's board (best standings)."""
    return game_board(scores, games, users, 0, n - 1, game_id=game_id)


def score_progression(scores, games, users, as_of, game_id, period="weekly", n=10):
    """Scores since the cutoff of the users in the game's top ``n``, one row per score.

    A history can be long, so it is rows and not one list; ``improvement`` is last minus first
    score of the user, 0 for a single score.
    """
    leaders = current_top(scores, games, users, game_id, n)
    recent = in_period(
        scores.filter(F.col("game_id") == game_id), "leaderboard_trends", period, as_of
    ).select("id", "user_id", "submitted_at", "score")
    people = leaders.select("user_id", "username", "name")
    few = F.broadcast if n <= TOP_BOUND else (lambda df: df)  # at most n rows
    rows = recent.join(few(people), "user_id")
    key = event_key()
    ends = rows.groupBy("user_id").agg(
        (F.max_by("score", key) - F.min_by("score", key)).alias("improvement")
    )
    return rows.join(few(ends), "user_id").select(
        "user_id", "username", "name", "id", "submitted_at", "score", "improvement"
    )


def competition_metrics(scores, as_of, game_id, period="weekly"):
    chosen = in_period(
        scores.filter(F.col("game_id") == game_id), "leaderboard_trends", period, as_of
    )
    players = F.count_distinct("user_id")
    return chosen.agg(
        players.alias("total_participants"),
        F.count(F.lit(1)).alias("score_submissions"),
        ratio(F.count(F.lit(1)), players).alias("avg_submissions_per_user"),
        (F.max("score") - F.min("score")).alias("score_range"),
        players.alias("leaderboard_volatility"),
    )


def daily_best_ranks(scores, games, tz="UTC"):
    """Rank of each user's best score of the day, per (game, date)."""
    best = scores.groupBy("game_id", "user_id", date_of("submitted_at", tz).alias("date")).agg(
        F.max("score").alias("_top"), F.min("score").alias("_low")
    )
    typed = best.join(games.select("game_id", "score_type"), "game_id").withColumn(
        "score", best_of(F.col("_top"), F.col("_low"))
    )
    keyed = typed.select("game_id", "user_id", "date", sort_key().alias("_key"))
    return with_rank(keyed, ["game_id", "date"], "_key").drop("_key")


def board_volatility(scores, games, tz="UTC"):
    """Mean absolute change of a user's daily rank from one active day to the next, per game."""
    ranked = daily_best_ranks(scores, games, tz)
    # A user has one row per active day in a game, so this window is bounded by the days.
    w = Window.partitionBy("game_id", "user_id").orderBy("date")
    moves = ranked.withColumn("move", F.abs(F.col("rank") - F.lag("rank").over(w)))
    return moves.groupBy("game_id").agg(
        mean("move").alias("volatility"), F.count("move").alias("moves")
    )


# --- scoring patterns ----------------------------------------------------------------------


def peak_hours(scores, as_of, period="weekly", game_id=None, limit=24, tz="UTC"):
    """The busiest hours (hour buckets, not hours of the day)."""
    chosen = of_game(in_period(scores, "scoring_patterns", period, as_of), game_id)
    counts = chosen.groupBy(bucket("hour", "submitted_at", tz).alias("hour")).agg(
        F.count(F.lit(1)).alias("submissions")
    )
    return _limited(counts.orderBy(F.desc("submissions"), "hour"), limit)


def improvement_patterns(scores, as_of, period="weekly", game_id=None, limit=None):
    """Per user with more than one score: first, last and peak score, and the share of scores
    that are at least the first one.

    Scores are first grouped by (user, value), which also splits a very active user.
    """
    chosen = of_game(in_period(scores, "scoring_patterns", period, as_of), game_id)
    key = event_key()
    by_value = chosen.groupBy("user_id", "score").agg(
        F.count(F.lit(1)).alias("n"), F.min(key).alias("first_at"), F.max(key).alias("last_at")
    )
    ends = by_value.groupBy("user_id").agg(
        F.sum("n").alias("total_sessions"),
        F.min_by("score", "first_at").alias("starting_score"),
        F.max_by("score", "last_at").alias("ending_score"),
        F.max("score").alias("peak_score"),
    )
    ends = ends.filter(F.col("total_sessions") > 1)
    at_least = F.when(F.col("score") >= F.col("starting_score"), F.col("n")).otherwise(0)
    reached = (
        by_value.join(ends, "user_id")
        .groupBy(*ends.columns)
        .agg(F.sum(at_least).alias("reached"))
    )
    rows = reached.select(
        "user_id",
        "total_sessions",
        "starting_score",
        "ending_score",
        (F.col("ending_score") - F.col("starting_score")).alias("improvement"),
        ratio(F.col("reached"), F.col("total_sessions")).alias("consistency"),
        "peak_score",
    )
    return rows if limit is None else rows.orderBy("user_id").limit(limit)


def metadata_patterns(scores, as_of, period="weekly", game_id=None, limit=10):
    """The most frequent (difficulty, level) pairs of scores with metadata."""
    chosen = of_game(in_period(scores, "scoring_patterns", period, as_of), game_id)
    pairs = with_json(has_metadata(chosen), "difficulty", "level").groupBy(
        F.col("difficulty").alias("metadata__difficulty"),
        F.col("level").try_cast("bigint").alias("metadata__level"),
    )
    counts = pairs.agg(mean("score").alias("avg_score"), F.count(F.lit(1)).alias("count"))
    order = [F.desc("count"), "metadata__difficulty", "metadata__level"]
    return _limited(counts.orderBy(*order), limit)


def submission_frequency(scores, as_of, period="weekly", game_id=None, at_least=5, limit=20,
                         tz="UTC"):
    """Users with enough submissions, by submissions per active day."""
    chosen = of_game(in_period(scores, "scoring_patterns", period, as_of), game_id)
    days = F.count_distinct("day")
    counts = (
        chosen.select("user_id", date_of("submitted_at", tz).alias("day"))
        .groupBy("user_id")
        .agg(
            F.count(F.lit(1)).alias("submission_count"),
            days.alias("days_active"),
            ratio(F.count(F.lit(1)), days).alias("avg_daily_submissions"),
        )
        .filter(F.col("submission_count") >= at_least)
    )
    return _limited(counts.orderBy(F.desc("avg_daily_submissions"), "user_id"), limit)
