"""Publishing views and writing reports."""

from pyspark.sql import functions as F
from pyspark.sql import types as T

from podium.sources.versions import current_version, publish_version

MICROS = "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"
MONEY = "decimal(12,2)"
RATE = "decimal(10,2)"
SHARE = "decimal(5,4)"

# Report columns that are written as decimals, and their form. Half-even rounding.
DECIMAL_FIELDS = {
    "score": MONEY,
    "total_score": MONEY,
    "user_score": MONEY,
    "best_score": MONEY,
    "average_score": MONEY,
    "avg_score": MONEY,
    "max_score": MONEY,
    "min_score": MONEY,
    "score_range": MONEY,
    "percentile_25": MONEY,
    "percentile_50": MONEY,
    "percentile_75": MONEY,
    "std_deviation": MONEY,
    "improvement": MONEY,
    "starting_score": MONEY,
    "ending_score": MONEY,
    "peak_score": MONEY,
    "sessions_per_day": RATE,
    "avg_session_length": RATE,
    "avg_submissions_per_user": RATE,
    "avg_daily_submissions": RATE,
    "consistency": SHARE,
}

# Large views are written in folders by date; a busy date is split over tasks by time.
VIEW_LAYOUT = {
    "leaderboard_trends": ("submission_date", "submitted_at"),
    "scoring_patterns": ("submission_date", "hour_bucket"),
}


def formatted(report):
    """A report section with its decimals in their written form.

    Doubles go through their shortest decimal text, so 0.125 rounds as 0.125 and not as a
    neighbouring binary value.
    """

    def shaped(name):
        form = DECIMAL_FIELDS.get(name)
        if form is None:
            return F.col(name)
        places = T.DecimalType(*[int(n) for n in form[8:-1].split(",")]).scale
        exact = F.col(name).cast("string").cast("decimal(38,16)")
        return F.bround(exact, places).cast(form).alias(name)

    return report.select(*[shaped(c) for c in report.columns])


# The order a section is read in, where it has one.
REPORT_ORDER = {
    "game_performance": ("-total_plays", "game__id"),
    "activity_trend": ("period",),
    "engagement_trend": ("period",),
    "new_vs_returning": ("date",),
    "score_progression": ("user_id", "submitted_at", "id"),
}


def write_report(report, path, fmt="json", order=()):
    """Write a section with formatted decimals, sorted by ``order``: column names, - for falling."""
    rows = formatted(report)
    if order:
        rows = rows.orderBy(*(F.desc(c[1:]) if c[0] == "-" else F.asc(c) for c in order))
    # As text, times would else end with their milliseconds.
    writer = rows.write.option("timestampNTZFormat", MICROS).option("timestampFormat", f"{MICROS}XXX")
    writer.mode("overwrite").format(fmt).save(path)


def publish(views, path=None, prefix="analytics_", drop_existing=False):
    """Make views available by name: as temp views, or as Parquet tables under ``path``.

    ``views`` maps names to DataFrames. Returns the published names.
    """
    names = []
    for name, view in views.items():
        full = f"{prefix}{name}"
        if path is None:
            spark = view.sparkSession
            if drop_existing:
                spark.catalog.dropTempView(full)
            view.createOrReplaceTempView(full)
        else:
            layout = VIEW_LAYOUT.get(name)
            if layout:
                writer = view.repartitionByRange(*layout).write.partitionBy(layout[0])
            else:
                writer = view.write
            writer.mode("overwrite").parquet(f"{path}/{full}")
        names.append(full)
    return names


def publish_snapshot(views, path, prefix="analytics_"):
    """Write all ``views`` (name to DataFrame) as one version: readers find all of them new, or all old."""
    spark = next(iter(views.values())).sparkSession
    return publish_version(spark, path, lambda folder: publish(views, folder, prefix))


def read_snapshot(spark, path, name, prefix="analytics_"):
    """A view of the last published version; it stays that version until it is cleared."""
    folder = current_version(spark, path)
    if folder is None:
        raise FileNotFoundError(f"nothing published at {path}")
    return spark.read.parquet(f"{folder}/{prefix}{name}")


def drop_views(spark, names, prefix="analytics_"):
    for name in names:
        spark.catalog.dropTempView(f"{prefix}{name}")
