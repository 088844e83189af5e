"""Reading scores, games and users."""

from pyspark.sql import functions as F

from podium import schemas
from podium.functions.values import normal_email

TABLES = {"scores": schemas.SCORES, "games": schemas.GAMES, "users": schemas.USERS}


def read_table(spark, base, name, fmt="parquet"):
    """One table of ``base``/<name> with its fixed schema, nothing inferred."""
    return spark.read.schema(TABLES[name]).format(fmt).load(f"{base}/{name}")


def scan_scores(spark, base, fmt="parquet"):
    return read_table(spark, base, "scores", fmt)


def scan_games(spark, base, fmt="parquet"):
    return read_table(spark, base, "games", fmt)


def scan_users(spark, base, fmt="parquet"):
    return read_table(spark, base, "users", fmt)


def newest_first(scores):
    """The default order of scores."""
    return scores.orderBy(F.desc("submitted_at"), F.desc("id"))


def write_scores(scores, path):
    """Scores laid out for the common filters: one folder per day, sorted by game inside files."""
    (
        scores.withColumn("day", F.to_date("submitted_at"))
        .repartition("day", F.pmod(F.xxhash64("id"), F.lit(32)))
        .sortWithinPartitions("day", "game_id", "user_id")
        .write.mode("overwrite")
        .partitionBy("day")
        .parquet(path)
    )


def store_users(users):
    """Users as they are stored: the domain of the email in lower case; a missing one is refused."""
    blank = F.coalesce(F.col("email"), F.lit("")) == ""
    checked = F.when(blank, F.raise_error(F.lit("a user needs an email"))).otherwise(
        normal_email()
    )
    return users.withColumn("email", checked)


def jdbc_options(url, table, rows, pieces, properties=None):
    """Options of a split read over ids 0..``rows`` in ``pieces`` parallel queries."""
    if pieces < 1:
        raise ValueError("pieces must be at least 1")
    return {
        "url": url,
        "dbtable": table,
        "partitionColumn": "id",
        "lowerBound": "0",
        "upperBound": str(rows),
        "numPartitions": str(pieces),
        "fetchsize": "10000",
        **(properties or {}),
    }


def read_jdbc(spark, url, table, rows, pieces, properties=None):
    """A table of a relational store; needs the driver's jar on the class path."""
    options = jdbc_options(url, table, rows, pieces, properties)
    return spark.read.format("jdbc").options(**options).load()
