"""The seven analytics views. Unsorted; sort where they are shown."""

from pyspark.sql import Window
from pyspark.sql import functions as F

from podium.functions.ranks import value_ranks
from podium.functions.sequences import Sequence
from podium.functions.times import (
    DAY_MICROS,
    bucket,
    date_of,
    day_name,
    hour_of,
    local_time,
    micros_between,
    moment,
    span_days,
    weekday,
    weekday_of_date,
)
from podium.functions.values import (
    best_of,
    event_key,
    is_highest,
    mean,
    ratio,
    sort_key,
    spread,
    with_json,
)


def _zero(name):
    return F.coalesce(F.col(name), F.lit(0)).cast("bigint").alias(name)


def game_analytics(scores, games):
    """One row per game, idle games included."""
    stats = scores.groupBy("game_id").agg(
        F.count(F.lit(1)).alias("total_submissions"),
        F.count_distinct("user_id").alias("unique_players"),
        mean("score").alias("avg_score"),
        F.max("score").alias("max_score"),
        F.min("score").alias("min_score"),
        spread("score").alias("score_stddev"),
        F.min("submitted_at").alias("first_submission"),
        F.max("submitted_at").alias("last_submission"),
    )
    days = span_days(F.col("first_submission"), F.col("last_submission"))
    return games.join(stats, "game_id", "left").select(
        "game_id",
        "game_name",
        "score_type",
        "is_active",
        F.col("created_at").alias("game_created_at"),
        _zero("total_submissions"),
        _zero("unique_players"),
        "avg_score",
        "max_score",
        "min_score",
        "score_stddev",
        (F.col("max_score") - F.col("min_score")).alias("score_range"),
        "first_submission",
        "last_submission",
        days.alias("activity_days"),
        ratio(F.col("total_submissions"), F.col("unique_players")).alias("submissions_per_player"),
        ratio(F.col("total_submissions"), days).alias("submissions_per_day"),
    )


def user_engagement(scores, users, as_of, tz="UTC"):
    """One row per user, users without scores up to ``as_of`` included."""
    now = moment(as_of, scores.schema["submitted_at"].dataType)
    scores = scores.filter(F.col("submitted_at") <= now)
    # Two narrow groupings instead of two distinct counts, which would multiply the rows.
    played = (
        scores.groupBy("user_id", "game_id")
        .agg(
            F.count(F.lit(1)).alias("n"),
            F.sum("score").alias("total"),
            F.max("score").alias("top"),
            F.min("score").alias("low"),
            F.min("submitted_at").alias("first"),
            F.max("submitted_at").alias("last"),
        )
        .groupBy("user_id")
        .agg(
            F.sum("n").alias("total_submissions"),
            F.count(F.lit(1)).alias("games_played"),
            ratio(F.sum("total"), F.sum("n")).alias("avg_score"),
            F.max("top").alias("best_score"),
            F.min("low").alias("worst_score"),
            F.min("first").alias("first_submission"),
            F.max("last").alias("last_submission"),
        )
    )
    days = (
        scores.select("user_id", date_of("submitted_at", tz).alias("day"))
        .distinct()
        .groupBy("user_id")
        .agg(F.count(F.lit(1)).alias("active_days"))
    )
    last = F.col("last_submission")
    status = (
        F.when(last >= now - F.expr("interval 7 days"), "Active")
        .when(last >= now - F.expr("interval 30 days"), "Recent")
        .otherwise("Inactive")
    )
    return users.join(played, "user_id", "left").join(days, "user_id", "left").select(
        "user_id",
        F.col("email").alias("user_email"),
        F.col("name").alias("user_name"),
        "date_joined",
        F.col("is_active").alias("user_is_active"),
        _zero("total_submissions"),
        _zero("games_played"),
        "avg_score",
        "best_score",
        "worst_score",
        "first_submission",
        "last_submission",
        span_days(F.col("first_submission"), last).alias("activity_span_days"),
        _zero("active_days"),
        ratio(F.col("total_submissions"), F.col("active_days")).alias("submissions_per_active_day"),
        status.alias("user_status"),
        span_days(last, now).alias("days_since_last_activity"),
    )


def leaderboard_trends(scores, games, users, tz="UTC", bound=None):
    """One row per score: daily rank in its game, place in its user's sequence, improvement."""
    narrow = scores.select("id", "game_id", "user_id", "score", "submitted_at")
    kinds = games.select("game_id", "score_type")
    date = date_of("submitted_at", tz).alias("submission_date")
    # The sequence comes first: it may read its rows several times, and these are a plain scan.
    # Names are joined last, so that no text travels through the shuffles.
    seq = Sequence(narrow, ["user_id", "game_id"], ["submitted_at", "id"], bound)
    rows = seq.number("user_submission_sequence").previous("previous_score", "score").done()
    keyed = rows.join(kinds, "game_id").select(*rows.columns, date, sort_key().alias("_key"))
    day_keys = narrow.join(kinds, "game_id").select("game_id", date, sort_key().alias("_key"))
    ranks = value_ranks(day_keys, ["game_id", "submission_date"], "_key", "daily_rank").drop("n")
    rows = keyed.join(ranks, ["game_id", "submission_date", "_key"]).drop("_key")
    before, score = F.col("previous_score"), F.col("score")
    better = F.when(is_highest(), score > before).otherwise(score < before)
    trend = (
        F.when(before.isNull(), "First")
        .when(better, "Better")
        .when(score == before, "Same")
        .otherwise("Worse")
    )
    wall = local_time("submitted_at", tz)
    people = users.select(
        "user_id", F.col("email").alias("user_email"), F.col("name").alias("user_name")
    )
    named = rows.join(people, "user_id").join(
        games.select("game_id", "game_name", "score_type"), "game_id"
    )
    return named.select(
        "game_id",
        "game_name",
        "score_type",
        "user_id",
        "user_email",
        "user_name",
        "score",
        "submitted_at",
        "submission_date",
        hour_of("submitted_at", tz).alias("submission_hour"),
        weekday("submitted_at", tz).alias("day_of_week"),
        F.weekofyear(wall).cast("bigint").alias("week_number"),
        F.month(wall).cast("bigint").alias("month"),
        "daily_rank",
        "user_submission_sequence",
        "previous_score",
        (score - before).alias("score_improvement"),
        trend.alias("performance_trend"),
    )


def scoring_patterns(scores, games, tz="UTC"):
    """One row per (hour, game)."""
    rows = with_json(scores, "level", "time_played", "difficulty").select(
        bucket("hour", "submitted_at", tz).alias("hour_bucket"),
        "game_id",
        "user_id",
        "score",
        F.col("level").try_cast("bigint").alias("level"),
        F.col("time_played").try_cast("bigint").alias("time_played"),
        "difficulty",
    )
    stats = rows.groupBy("hour_bucket", "game_id").agg(
        F.count(F.lit(1)).alias("submission_count"),
        F.count_distinct("user_id").alias("unique_users"),
        mean("score").alias("avg_score"),
        F.max("score").alias("max_score"),
        F.min("score").alias("min_score"),
        spread("score").alias("score_stddev"),
        F.coalesce(mean("level"), F.lit(0.0)).alias("avg_level"),
        F.coalesce(mean("time_played"), F.lit(0.0)).alias("avg_time_played"),
        *[
            F.count_if(F.col("difficulty") == d).alias(f"{d}_count")
            for d in ("easy", "medium", "hard")
        ],
    )
    hour = F.hour("hour_bucket").cast("bigint")
    dow = weekday_of_date(F.col("hour_bucket"))
    period = (
        F.when(hour.between(6, 11), "Morning")
        .when(hour.between(12, 17), "Afternoon")
        .when(hour.between(18, 23), "Evening")
        .otherwise("Night")
    )
    return stats.join(games.select("game_id", "game_name", "score_type"), "game_id").select(
        "hour_bucket",
        F.to_date("hour_bucket").alias("submission_date"),
        hour.alias("hour_of_day"),
        dow.alias("day_of_week"),
        day_name(dow).alias("day_name"),
        period.alias("time_period"),
        "game_id",
        "game_name",
        "score_type",
        *stats.columns[2:],
    )


def daily_metrics(scores, users, tz="UTC"):
    """One row per date with activity.

    Three narrow groupings of the scores, each combined before its shuffle, instead of several
    distinct counts in one, which would multiply the rows.
    """
    date = date_of("submitted_at", tz).alias("metric_date")
    by_user = scores.groupBy(date, "user_id").agg(
        F.count(F.lit(1)).alias("n"), F.sum("score").alias("total"), F.max("score").alias("top")
    )
    joined = users.select("user_id", date_of("date_joined", tz).alias("joined"))
    days = (
        by_user.join(joined, "user_id")
        .groupBy("metric_date")
        .agg(
            F.sum("n").alias("total_submissions"),
            F.count(F.lit(1)).alias("daily_active_users"),
            ratio(F.sum("total"), F.sum("n")).alias("avg_score"),
            F.count_if(F.col("joined") == F.col("metric_date")).alias("new_users_active"),
            F.count_if(F.col("joined") < F.col("metric_date")).alias("returning_users_active"),
            F.max("top").alias("daily_high_score"),
        )
    )
    game_days = (
        scores.select(date, "game_id")
        .distinct()
        .groupBy("metric_date")
        .agg(F.count(F.lit(1)).alias("games_with_activity"))
    )
    # Users whose first play of some game falls on the date.
    first = F.min("submitted_at").alias("first")
    starters = (
        scores.groupBy("user_id", "game_id")
        .agg(first)
        .select(date_of("first", tz).alias("metric_date"), "user_id")
        .distinct()
        .groupBy("metric_date")
        .agg(F.count(F.lit(1)).alias("new_players_to_games"))
    )
    dow = weekday_of_date(F.col("metric_date"))
    return (
        days.join(game_days, "metric_date")
        .join(starters, "metric_date", "left")
        .select(
            "metric_date",
            "total_submissions",
            "daily_active_users",
            "games_with_activity",
            "avg_score",
            "new_users_active",
            "returning_users_active",
            ratio(F.col("total_submissions"), F.col("daily_active_users")).alias(
                "avg_submissions_per_user"
            ),
            "daily_high_score",
            _zero("new_players_to_games"),
            dow.alias("day_of_week"),
            day_name(dow).alias("day_name"),
            F.when(dow.isin(0, 6), "Weekend").otherwise("Weekday").alias("day_type"),
        )
    )


def player_type(attempts):
    """Fixed classes by number of attempts."""
    return (
        F.when(attempts == 1, "Beginner")
        .when(attempts <= 5, "Casual")
        .when(attempts <= 20, "Regular")
        .otherwise("Dedicated")
    )


def user_performance(scores, games, users):
    """One row per (user, game)."""
    key = event_key()
    stats = scores.groupBy("user_id", "game_id").agg(
        F.count(F.lit(1)).alias("total_attempts"),
        F.max("score").alias("_top"),
        F.min("score").alias("_low"),
        mean("score").alias("avg_score"),
        spread("score").alias("score_consistency"),
        F.min("submitted_at").alias("first_attempt"),
        F.max("submitted_at").alias("last_attempt"),
        F.min_by("score", key).alias("first_score"),
        F.max_by("score", key).alias("latest_score"),
    )
    people = users.select(
        "user_id", F.col("email").alias("user_email"), F.col("name").alias("user_name")
    )
    named = stats.join(games.select("game_id", "game_name", "score_type"), "game_id").join(
        people, "user_id"
    )
    first, latest = F.col("first_score"), F.col("latest_score")
    improving = F.when(is_highest(), latest > first).otherwise(latest < first)
    trend = F.when(improving, "Improving").when(latest == first, "Stable").otherwise("Declining")
    days = span_days(F.col("first_attempt"), F.col("last_attempt"))
    return named.select(
        "user_id",
        "game_id",
        "user_email",
        "user_name",
        "game_name",
        "score_type",
        "total_attempts",
        best_of(F.col("_top"), F.col("_low")).alias("best_score"),
        best_of(F.col("_low"), F.col("_top")).alias("worst_score"),
        "avg_score",
        "score_consistency",
        "first_attempt",
        "last_attempt",
        "first_score",
        "latest_score",
        (latest - first).alias("score_improvement"),
        trend.alias("improvement_trend"),
        player_type(F.col("total_attempts")).alias("player_type"),
        days.alias("playing_period_days"),
        ratio(F.col("total_attempts"), days).alias("attempts_per_day"),
    )


def game_popularity(scores, games, tz="UTC"):
    """One row per (game, week with activity), with the game's overall numbers.

    A player is new in the week of the pair's first score, so no self-join is needed.
    """
    week = bucket("week", "submitted_at", tz).alias("week_start")
    weekly = (
        scores.groupBy("game_id", "user_id", week)
        .agg(
            F.count(F.lit(1)).alias("n"),
            F.sum("score").alias("total"),
            F.min("submitted_at").alias("first"),
            F.max("submitted_at").alias("last"),
        )
        .groupBy("game_id", "week_start")
        .agg(
            F.sum("n").alias("weekly_submissions"),
            F.count(F.lit(1)).alias("weekly_players"),
            ratio(F.sum("total"), F.sum("n")).alias("weekly_avg_score"),
            F.min("first").alias("first"),
            F.max("last").alias("last"),
        )
    )
    starts = (
        scores.groupBy("game_id", "user_id")
        .agg(F.min("submitted_at").alias("first"))
        .groupBy("game_id", bucket("week", "first", tz).alias("week_start"))
        .agg(F.count(F.lit(1)).alias("starters"))
    )
    # From here on there is one row per game and week: the windows below are bounded by the
    # number of games and of weeks. Each player starts in exactly one week of a game.
    by_size = Window.partitionBy("week_start").orderBy(F.desc("weekly_submissions"))
    overall = Window.partitionBy("game_id")
    started = F.coalesce("starters", F.lit(0)).cast("bigint")
    weeks = micros_between(F.col("first_activity"), F.col("last_activity")).cast("double") / F.lit(
        7.0 * DAY_MICROS
    )
    place = F.col("weekly_popularity_rank")
    tier = F.when(place <= 3, "Top").when(place <= 10, "Popular").otherwise("Niche")
    return (
        weekly.join(starts, ["game_id", "week_start"], "left")
        .withColumn("new_players_this_week", started)
        .withColumns(
            {
                "total_submissions": F.sum("weekly_submissions").over(overall),
                "total_players": F.sum("new_players_this_week").over(overall),
                "first_activity": F.min("first").over(overall),
                "last_activity": F.max("last").over(overall),
            }
        )
        .join(games.select("game_id", "game_name", "score_type"), "game_id")
        .withColumn("weekly_popularity_rank", F.rank().over(by_size).cast("bigint"))
        .select(
            "game_id",
            "game_name",
            "score_type",
            "week_start",
            "weekly_submissions",
            "weekly_players",
            "weekly_avg_score",
            "new_players_this_week",
            "weekly_popularity_rank",
            "total_submissions",
            "total_players",
            "first_activity",
            "last_activity",
            weeks.alias("active_weeks"),
            tier.alias("popularity_tier"),
            ratio(F.col("weekly_submissions"), F.col("weekly_players")).alias(
                "submissions_per_player_per_week"
            ),
            ratio(F.col("new_players_this_week"), F.col("weekly_players")).alias(
                "new_player_ratio"
            ),
        )
    )


def all_views(scores, games, users, as_of, tz="UTC"):
    """The seven views by name."""
    return {
        "game_analytics": game_analytics(scores, games),
        "user_engagement": user_engagement(scores, users, as_of, tz),
        "leaderboard_trends": leaderboard_trends(scores, games, users, tz),
        "scoring_patterns": scoring_patterns(scores, games, tz),
        "daily_metrics": daily_metrics(scores, users, tz),
        "user_performance": user_performance(scores, games, users),
        "game_popularity": game_popularity(scores, games, tz),
    }
