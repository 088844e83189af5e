"""Scores, games and users taken from the star-schema test tables (see FIXTURES.md)."""

from pyspark.sql import functions as F

from podium import schemas
from podium.functions.values import with_json

AS_OF = "2024-01-31 00:00:00"
ORDERS_AS_OF = "2001-08-02 00:00:00"

# Fixed values: (game_id, game_name, score_type, is_active).
EVENT_GAMES = (
    (1, "click", "highest", True),
    (2, "view", "highest", True),
    (3, "purchase", "highest", True),
    (4, "signup", "lowest", True),
    (5, "error", "time", False),
    (6, "idle", "highest", True),
)
ORDER_GAMES = (
    (1, "1-URGENT", "highest", True),
    (2, "2-HIGH", "lowest", True),
    (3, "3-MEDIUM", "time", True),
    (4, "4-NOT SPECIFIED", "highest", True),
    (5, "5-LOW", "highest", True),
)


def table(spark, sf_dir, name):
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _games(spark, listed):
    rows = ", ".join(f"({i}, '{name}', '{kind}', {active})" for i, name, kind, active in listed)
    return spark.sql(
        f"""SELECT CAST(i AS BIGINT) AS game_id, name AS game_name,
              'Board for ' || name AS description, kind AS score_type, active AS is_active,
              TIMESTAMP_NTZ '2023-12-01 00:00:00' + make_dt_interval(i) AS created_at,
              TIMESTAMP_NTZ '2023-12-01 00:00:00' AS updated_at
            FROM VALUES {rows} AS g(i, name, kind, active)"""
    )


def games(spark):
    return _games(spark, EVENT_GAMES)


def order_games(spark):
    return _games(spark, ORDER_GAMES)


def _game_id(col, listed):
    """Game id of a game name, as a fixed lookup (null for other names)."""
    return F.coalesce(*[F.when(F.col(col) == name, F.lit(i)) for i, name, _, _ in listed]).cast(
        "bigint"
    )


def _with_k(events):
    """Events with the number ``k`` of their properties, parsed once."""
    parsed = with_json(events, "k", col="props")
    return parsed.withColumn("k", F.col("k").cast("int"))


def _metadata():
    k = F.col("k")
    difficulty = F.when(k % 3 == 0, "easy").when(k % 3 == 1, "medium").otherwise("hard")
    full = F.concat(
        F.lit('{"level": '),
        (k % 10 + 1).cast("string"),
        F.lit(', "difficulty": "'),
        difficulty,
        F.lit('", "time_played": '),
        (k * 6).cast("string"),
        F.lit("}"),
    )
    return F.when(k < 5, F.lit("{}")).otherwise(full)


def scores_from_events(events):
    """Each event is a submission to the game named by its type. Works on streams too."""
    return _with_k(events).select(
        F.col("event_id").alias("id"),
        "user_id",
        _game_id("event_type", EVENT_GAMES).alias("game_id"),
        F.col("value").cast(schemas.SCORE).alias("score"),
        F.col("ts").alias("submitted_at"),
        _metadata().alias("metadata"),
    )


def scores(spark, sf_dir):
    return scores_from_events(table(spark, sf_dir, "events"))


def order_scores(spark, sf_dir):
    """Orders as scores: times of day grain, so with time ties and many years."""
    return table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("id"),
        F.col("o_custkey").alias("user_id"),
        _game_id("o_orderpriority", ORDER_GAMES).alias("game_id"),
        F.col("o_totalprice").cast(schemas.SCORE).alias("score"),
        F.col("o_orderdate").alias("submitted_at"),
        F.lit("{}").alias("metadata"),
    )


def users(spark, sf_dir, demo_segment=None):
    """Customers as users; those of ``demo_segment`` get an email that marks demo users."""
    key = F.col("c_custkey")
    mark = F.when(F.col("c_mktsegment") == demo_segment, "demo_").otherwise("")
    email = F.concat(F.lower("c_name"), F.lit("@example.com"))
    joined = F.date_add(F.lit("2024-01-01").cast("date"), (key % 30).cast("int"))
    return table(spark, sf_dir, "customer").select(
        key.alias("user_id"),
        (email if demo_segment is None else F.concat(mark, email)).alias("email"),
        F.when(key % 7 == 0, F.lit("")).otherwise(F.col("c_name")).alias("name"),
        (key % 11 != 0).alias("is_active"),
        (key < 3).alias("is_staff"),
        joined.cast("timestamp_ntz").alias("date_joined"),
    )


def submissions_from_events(events):
    """Events as raw submissions; chosen values of ``k`` break one rule each."""
    k = F.col("k")
    value = F.col("value").cast("decimal(20,3)")
    score = (
        F.when(k == 11, -value - 1)
        .when(k == 13, value + F.lit("0.001").cast("decimal(20,3)"))
        .when(k == 17, (value + 100) * 1_000_000_000)
        .otherwise(value)
        .cast("decimal(38,3)")
        .cast("string")
    )
    # Texts that a cast to a number would round or lose.
    score = (
        F.when(k == 23, F.lit("abc"))
        .when(k == 29, F.concat(score, F.lit("00000000001")))
        .when(k == 31, F.lit("-0.00000000001"))
        .when(k == 37, F.concat(F.lit("1"), F.lit("0" * 30)))
        .when(k == 41, F.concat(score, F.lit("e-2")))
        .when(k == 43, F.concat(F.lit("+"), score, F.lit("E+0")))
        .when(k == 47, F.lit("-0.00"))
        .otherwise(score)
    )
    known = _game_id("event_type", EVENT_GAMES)
    return _with_k(events).select(
        F.col("event_id").alias("id"),
        "user_id",
        F.when(k == 7, F.lit(99).cast("bigint")).otherwise(known).alias("game_id"),
        score.alias("score"),
        F.col("ts").alias("submitted_at"),
        F.when(k >= 5, _metadata()).alias("metadata"),
    )


def events_stream(spark, sf_dir):
    """The events files as a stream; the pattern matches one file or a folder of parts."""
    shape = table(spark, sf_dir, "events").schema
    return spark.readStream.schema(shape).parquet(f"{sf_dir}/events.parque[t]")
