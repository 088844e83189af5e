"""Demo data: generator, clean-up and summary."""

from pyspark.sql import functions as F

from podium import schemas

# Name and score type. The descriptions are free.
DEMO_GAMES = (
    ("Demo Racing Game", "Laps against the clock; the shortest time wins", "time"),
    ("Demo Shooting Game", "Targets on a range; every hit adds points", "highest"),
    ("Demo Puzzle Game", "Tiles to be sorted in as few moves as possible", "lowest"),
    ("Demo Platform Game", "Jumps and coins; whoever collects most leads", "highest"),
    ("Demo Strategy Game", "Cities to be built; the richest one wins", "highest"),
)

START = "2024-01-01 00:00:00"


def _dice(seed, use, sides):
    """A number in 0..sides-1 that depends on the row id only, not on the partitioning."""
    return F.pmod(F.xxhash64(F.col("id"), F.lit(f"{seed}/{use}")), F.lit(sides))


def demo_games(spark):
    born = F.lit(START).cast("timestamp_ntz")
    listed = F.array(
        *[
            F.struct(
                F.lit(i).cast("bigint").alias("game_id"),
                F.lit(name).alias("game_name"),
                F.lit(description).alias("description"),
                F.lit(kind).alias("score_type"),
                F.lit(True).alias("is_active"),
            )
            for i, (name, description, kind) in enumerate(DEMO_GAMES, 1)
        ]
    )
    plain = spark.range(1).select(F.inline(listed))
    return plain.withColumns({"created_at": born, "updated_at": born})


def demo_users(spark, count=50):
    return spark.range(1, count + 1).select(
        F.col("id").alias("user_id"),
        F.format_string("demo_user_%d@example.com", "id").alias("email"),
        F.format_string("Demo User %d", "id").alias("name"),
        F.lit(True).alias("is_active"),
        F.lit(False).alias("is_staff"),
        F.lit(START).cast("timestamp_ntz").alias("date_joined"),
    )


def demo_scores(spark, count=500, users=50, seed=0, days=30):
    """``count`` scores by ``users`` users over the demo games, spread over ``days`` days.

    Ranges by score type: highest 100..10000, lowest 1..100, time 10.00..300.00.
    """
    kinds = F.array(*[F.lit(t) for _, _, t in DEMO_GAMES])
    rolled = spark.range(1, count + 1).select(
        "id",
        (_dice(seed, "user", users) + 1).alias("user_id"),
        (_dice(seed, "game", len(DEMO_GAMES)) + 1).alias("game_id"),
    )
    kind = F.element_at(kinds, F.col("game_id").cast("int"))
    score = (
        F.when(kind == schemas.HIGHEST, _dice(seed, "high", 9901) + 100)
        .when(kind == schemas.LOWEST, _dice(seed, "low", 100) + 1)
        .otherwise((_dice(seed, "time", 29001) + 1000) / F.lit(100).cast("decimal(3,0)"))
    )
    offset = _dice(seed, "at", days * 86_400_000_000)
    start = F.unix_micros(F.lit(START).cast("timestamp"))
    metadata = F.to_json(
        F.struct(
            (_dice(seed, "level", 10) + 1).alias("level"),
            F.element_at(
                F.array(F.lit("easy"), F.lit("medium"), F.lit("hard")),
                (_dice(seed, "difficulty", 3) + 1).cast("int"),
            ).alias("difficulty"),
            F.format_string("session_%d", _dice(seed, "session", 9000) + 1000).alias("session_id"),
        )
    )
    return rolled.select(
        "id",
        "user_id",
        "game_id",
        score.cast(schemas.SCORE).alias("score"),
        F.timestamp_micros(start + offset).cast("timestamp_ntz").alias("submitted_at"),
        metadata.alias("metadata"),
    )


def without_demo(scores, games, users):
    """(scores, games, users) without demo users and games and the scores of either."""
    demo_user = users.filter(F.col("email").contains("demo")).select("user_id")
    demo_game = games.filter(F.col("game_name").contains("Demo")).select("game_id")
    kept = scores.join(demo_user, "user_id", "left_anti").join(demo_game, "game_id", "left_anti")
    return (
        kept,
        games.filter(~F.col("game_name").contains("Demo")),
        users.filter(~F.col("email").contains("demo")),
    )


def scores_per_game(scores, games):
    """Score count of every game, idle games included."""
    counts = scores.groupBy("game_id").agg(F.count(F.lit(1)).alias("n"))
    return games.join(counts, "game_id", "left").select(
        "game_id", "game_name", F.coalesce("n", F.lit(0)).cast("bigint").alias("scores")
    )


def totals(scores, games, users):
    """Rows of (item, total, demo): how many there are and how many belong to demo users/games."""
    demo_email = F.col("email").contains("demo")
    demo_users_only = users.filter(demo_email).select("user_id")

    def counted(df, item, demo):
        return df.agg(
            F.lit(item).alias("item"),
            F.count(F.lit(1)).alias("total"),
            F.count_if(demo).alias("demo"),
        )

    by_user = scores.groupBy("user_id").agg(F.count(F.lit(1)).alias("n"))
    marked = by_user.join(demo_users_only.withColumn("is_demo", F.lit(True)), "user_id", "left")
    score_totals = marked.agg(
        F.lit("scores").alias("item"),
        F.coalesce(F.sum("n"), F.lit(0)).alias("total"),
        F.coalesce(F.sum(F.when(F.col("is_demo"), F.col("n"))), F.lit(0)).alias("demo"),
    )
    return (
        counted(games, "games", F.col("game_name").contains("Demo"))
        .unionByName(counted(users, "users", demo_email))
        .unionByName(score_totals)
    )
