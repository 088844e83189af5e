"""Datasets behind dashboard charts. The definitions are stated in each docstring."""

from pyspark.sql import Window
from pyspark.sql import functions as F

from podium.functions.ranks import value_ranks
from podium.functions.sizes import per_game
from podium.functions.times import bucket, date_of
from podium.functions.values import mean, ratio, sort_key, with_json
from podium.plans.views import game_analytics, player_type, user_engagement

DIFFICULTIES = ("easy", "medium", "hard")


def retention_cohort(scores, tz="UTC"):
    """Users by week of first activity and weeks since then.

    ``users`` are distinct active users, ``share`` their part of the cohort's users.
    """
    weeks = scores.select("user_id", bucket("week", "submitted_at", tz).alias("week")).distinct()
    # One row per user and active week, so the window is bounded by the number of weeks.
    first = F.min("week").over(Window.partitionBy("user_id"))
    placed = weeks.withColumn("cohort_week", first)
    since = (F.date_diff("week", "cohort_week") / 7).cast("bigint")
    counts = placed.groupBy("cohort_week", since.alias("weeks_since")).agg(
        F.count(F.lit(1)).alias("users")
    )
    size = F.max(F.when(F.col("weeks_since") == 0, F.col("users"))).over(
        Window.partitionBy("cohort_week")
    )
    return counts.withColumn("share", ratio(F.col("users"), size))


def score_histogram(scores, games, bins=10):
    """Equal-width bins 1..``bins`` between each game's lowest and highest score.

    The highest score falls in the last bin; a game with one value uses bin 1. Empty bins have no
    row.
    """
    # Counted per value first: the range and the bins both come from that table.
    values = scores.groupBy("game_id", "score").agg(F.count(F.lit(1)).alias("n"))
    ends = scores.groupBy("game_id").agg(F.min("score").alias("low"), F.max("score").alias("high"))
    ends = ends.join(games.select("game_id"), "game_id")
    width = (F.col("high") - F.col("low")).cast("double")
    place = F.try_divide((F.col("score") - F.col("low")).cast("double") * bins, width)
    number = F.least(F.floor(F.coalesce(place, F.lit(0.0))).cast("bigint") + 1, F.lit(bins))
    step = width / F.lit(float(bins))
    return (
        values.join(per_game(ends, games), "game_id")
        .groupBy("game_id", number.cast("bigint").alias("bin"), "low", "high")
        .agg(F.sum("n").alias("count"))
        .select(
            "game_id",
            "bin",
            (F.col("low").cast("double") + (F.col("bin") - 1) * step).alias("bin_low"),
            (F.col("low").cast("double") + F.col("bin") * step).alias("bin_high"),
            "count",
        )
    )


def difficulty_mix(scores, games):
    """Submissions per game and difficulty, one column per difficulty."""
    counts = (
        with_json(scores, "difficulty")
        .groupBy("game_id")
        .pivot("difficulty", list(DIFFICULTIES))
        .count()
    )
    filled = counts.na.fill(0, list(DIFFICULTIES))
    return games.select("game_id", "game_name").join(filled, "game_id")


def calendar_heatmap(scores, tz="UTC"):
    """Submissions per date."""
    return scores.groupBy(date_of("submitted_at", tz).alias("date")).agg(
        F.count(F.lit(1)).alias("submissions")
    )


def board_heatmap(scores, games, top=None, tz="UTC"):
    """Per game, date and daily rank: the score holding that rank and its submissions."""
    typed = scores.select(
        "game_id", "score", date_of("submitted_at", tz).alias("date")
    ).join(games.select("game_id", "score_type"), "game_id")
    keyed = typed.select("game_id", "date", "score_type", sort_key().alias("_key"))
    ranks = value_ranks(keyed, ["game_id", "date", "score_type"], "_key", "daily_rank")
    if top is not None:
        ranks = ranks.filter(F.col("daily_rank") <= top)
    cents = F.when(F.col("score_type") == "highest", -F.col("_key")).otherwise(F.col("_key"))
    return ranks.select(
        "game_id",
        "date",
        "daily_rank",
        (cents.cast("decimal(14,0)") / F.lit(100).cast("decimal(3,0)"))
        .cast("decimal(12,2)")
        .alias("score"),
        F.col("n").alias("submissions"),
    )


def player_segments(scores, users, as_of, tz="UTC"):
    """Status, player type and engagement score of every user.

    The type is by submissions (None, Beginner, Casual, Regular, Dedicated). The engagement score
    is 40 * min(submissions / 20, 1) + 30 * min(games / 5, 1) + 30 * (1 Active, 0.5 Recent, else 0).
    """
    base = user_engagement(scores, users, as_of, tz)
    n = F.col("total_submissions")
    kind = F.when(n == 0, "None").otherwise(player_type(n))
    recency = (
        F.when(F.col("user_status") == "Active", 1.0)
        .when(F.col("user_status") == "Recent", 0.5)
        .otherwise(0.0)
    )
    score = (
        F.lit(40.0) * F.least(n / F.lit(20.0), F.lit(1.0))
        + F.lit(30.0) * F.least(F.col("games_played") / F.lit(5.0), F.lit(1.0))
        + F.lit(30.0) * recency
    )
    return base.select(
        "user_id", "user_status", kind.alias("player_type"), score.alias("engagement_score")
    )


def segment_sizes(segments):
    """Users and mean engagement score per (status, player type)."""
    return segments.groupBy("user_status", "player_type").agg(
        F.count(F.lit(1)).alias("users"), F.avg("engagement_score").alias("avg_engagement")
    )


def competition_intensity(scores, games):
    """Mean score, submissions and players per game."""
    return game_analytics(scores, games).select(
        "game_id",
        "game_name",
        "score_type",
        "avg_score",
        F.col("total_submissions").alias("submissions"),
        F.col("unique_players").alias("players"),
        "submissions_per_day",
    )


def segment_transitions(scores, tz="UTC"):
    """Moves between weekly player types, from each active week of a user to the next one.

    The type of a week is by the submissions in it; ``rate`` is the share within the source type.
    """
    weekly = scores.groupBy("user_id", bucket("week", "submitted_at", tz).alias("week")).agg(
        F.count(F.lit(1)).alias("n")
    )
    typed = weekly.select("user_id", "week", player_type(F.col("n")).alias("to_segment"))
    # Bounded by the number of weeks of a user.
    before = F.lag("to_segment").over(Window.partitionBy("user_id").orderBy("week"))
    moves = typed.withColumn("from_segment", before).filter(F.col("from_segment").isNotNull())
    counts = moves.groupBy("from_segment", "to_segment").agg(
        F.count(F.lit(1)).alias("transitions")
    )
    leaving = F.sum("transitions").over(Window.partitionBy("from_segment"))
    return counts.withColumn("rate", ratio(F.col("transitions"), leaving))


FUNNEL = (("joined", 0), ("first_score", 1), ("two_or_more", 2), ("five_or_more", 5))


def engagement_funnel(scores, users):
    """Users who joined, scored, scored twice, scored five times; share of all users."""
    counts = scores.groupBy("user_id").agg(F.count(F.lit(1)).alias("n"))
    reached = (
        users.select("user_id")
        .join(counts, "user_id", "left")
        .agg(*[F.count_if(F.coalesce("n", F.lit(0)) >= k).alias(name) for name, k in FUNNEL])
    )
    rows = reached.select(
        "joined",
        F.explode(
            F.array(
                *[
                    F.struct(
                        F.lit(i).cast("bigint").alias("step"),
                        F.lit(name).alias("stage"),
                        F.col(name).alias("users"),
                    )
                    for i, (name, _) in enumerate(FUNNEL, 1)
                ]
            )
        ).alias("s"),
    )
    return rows.select("s.*", ratio(F.col("s.users"), F.col("joined")).alias("share"))
