"""Summaries by day that merge: any span of days without reading a score.

Per day and game there are sums and extremes, sketches of the players and of the scores, and the players
themselves as bitmaps, so distinct counts of any span are exact. A bitmap holds 32,768 neighbouring user
ids in 4 kB at most; merging is an OR, combined before the shuffle.
"""

from pyspark.sql import functions as F

from podium.functions.values import ratio
from podium.session import subfolders

SUMS = (
    "game_id long, n long, score_sum decimal(38,2), max_score decimal(12,2), min_score decimal(12,2), "
    "first_play timestamp_ntz, last_play timestamp_ntz, players binary, scores binary, day date"
)
PLAYERS = "game_id long, bucket long, users binary, day date"
LG_K = 12  # 4,096 registers: a standard error of 1.6 %
KLL_K = 200  # a rank error of about 1.7 %


def _by_day(scores):
    return scores.withColumn("day", F.to_date("submitted_at"))


def day_sums(scores):
    """A row per day and game: counts, sums, extremes and both sketches."""
    return _by_day(scores).groupBy("day", "game_id").agg(
        F.count(F.lit(1)).alias("n"),
        F.sum("score").cast("decimal(38,2)").alias("score_sum"),
        F.max("score").alias("max_score"),
        F.min("score").alias("min_score"),
        F.min("submitted_at").alias("first_play"),
        F.max("submitted_at").alias("last_play"),
        F.hll_sketch_agg("user_id", LG_K).alias("players"),
        F.kll_sketch_agg_double(F.col("score").cast("double"), KLL_K).alias("scores"),
    )


def day_players(scores):
    """A row per day, game and 32,768 user ids: a bitmap of who played."""
    played = _by_day(scores).filter("user_id is not null")
    return played.groupBy("day", "game_id", F.bitmap_bucket_number("user_id").alias("bucket")).agg(
        F.bitmap_construct_agg(F.bitmap_bit_position("user_id")).alias("users")
    )


def store_days(scores, path):
    """Write the summaries of the days of ``scores``, a folder a day; other days stay as they are.

    To refresh some days give all scores of those days.
    """
    for rows, name in ((day_sums(scores), "sums"), (day_players(scores), "players")):
        dealt = rows.hint("rebalance", "day").sortWithinPartitions("day", "game_id")
        writer = dealt.write.partitionBy("day").option("partitionOverwriteMode", "dynamic")
        writer.mode("overwrite").parquet(f"{path}/{name}")


def touched_days(changed):
    """The days that some changed scores fall on, to restrict all scores by."""
    return _by_day(changed).select("day").distinct()


def refresh_days(scores, changed, path):
    """Make the summaries of the days on which scores changed anew, and of no others.

    ``scores`` are all scores as they are now, ``changed`` those that came, went or were edited (as they
    were and as they are). A day without scores any more loses its summaries.
    """
    days = touched_days(changed)
    store_days(_by_day(scores).join(F.broadcast(days), "day", "left_semi").drop("day"), path)  # a row a day
    left = _by_day(scores).join(F.broadcast(days), "day", "left_semi").select("day").distinct()
    spark = scores.sparkSession
    for row in days.join(left, "day", "left_anti").collect():
        for name in ("sums", "players"):
            place = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/{name}/day={row['day']}")
            place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)


def _read(spark, path, name, first=None, last=None):
    schema = {"sums": SUMS, "players": PLAYERS}[name]
    if not subfolders(spark, f"{path}/{name}"):
        return spark.createDataFrame([], schema)
    rows = spark.read.schema(schema).parquet(f"{path}/{name}")
    if first is not None:
        rows = rows.filter(F.col("day") >= F.lit(first).cast("date"))
    return rows if last is None else rows.filter(F.col("day") <= F.lit(last).cast("date"))


def _united(players, *by):
    """The number of different users of bitmaps, by some columns."""
    merged = players.groupBy(*by, "bucket").agg(F.bitmap_or_agg("users").alias("users"))
    return merged.groupBy(*by).agg(F.sum(F.bitmap_count("users")).alias("unique_players"))


def distinct_players(spark, path, first=None, last=None, by=("game_id",)):
    """Exact number of different players of a span of days (inclusive); ``by=()`` of all games."""
    return _united(_read(spark, path, "players", first, last), *by)


def merged_performance(spark, path, games, first=None, last=None):
    """As :func:`reports.game_performance`, of a span of whole days, from their summaries."""
    sums = _read(spark, path, "sums", first, last).groupBy("game_id").agg(
        F.sum("n").alias("total_plays"),
        ratio(F.sum("score_sum"), F.sum("n")).alias("avg_score"),
        F.max("max_score").alias("max_score"),
        F.min("min_score").alias("min_score"),
        (F.max("max_score") - F.min("min_score")).alias("score_range"),
        F.min("first_play").alias("first_play"),
        F.max("last_play").alias("last_play"),
    )
    players = distinct_players(spark, path, first, last)
    kinds = games.select("game_id", "game_name", "score_type")
    return sums.join(players, "game_id").join(kinds, "game_id").select(
        F.col("game_id").alias("game__id"),
        F.col("game_name").alias("game__name"),
        F.col("score_type").alias("game__score_type"),
        "total_plays",
        "unique_players",
        *sums.columns[2:],
    )


def rolling_players(spark, path, width=7, by=()):
    """Of every day with players, the different players of the ``width`` days that end with it."""
    players = _read(spark, path, "players")
    reach = F.sequence(F.col("day"), F.date_add("day", width - 1))
    spread = players.withColumn("_until", F.explode(reach))
    days = players.select(F.col("day").alias("_until")).distinct()  # a row a day
    spread = spread.join(F.broadcast(days), "_until", "left_semi")
    return _united(spread, "_until", *by).withColumnRenamed("_until", "day")


def approximate_players(spark, path, first=None, last=None, by=("game_id",)):
    """As :func:`distinct_players`, estimated from sketches of 4 kB a day and game."""
    sums = _read(spark, path, "sums", first, last).groupBy(*by)
    return sums.agg(F.hll_sketch_estimate(F.hll_union_agg("players")).alias("unique_players"))


def approximate_quantiles(spark, path, shares, first=None, last=None, by=("game_id",)):
    """Estimated quantiles of the scores of a span of days, one column ``q<percent>`` a share."""
    sums = _read(spark, path, "sums", first, last).groupBy(*by).agg(F.kll_merge_agg_double("scores").alias("_all"))
    return sums.select(
        *by,
        *(F.kll_sketch_get_quantile_double("_all", F.lit(s)).alias(f"q{round(100 * s)}") for s in shares),
    )
