"""Report periods, time buckets and spans. Buckets take ``tz``; stored times are UTC."""

from datetime import datetime, timedelta

from pyspark.sql import functions as F
from pyspark.sql import types as T

PERIODS = ("daily", "weekly", "monthly")

# Days looked back for each report and period.
LOOKBACK_DAYS = {
    "top_players": {"daily": 1, "weekly": 7, "monthly": 30},
    "game_analytics": {"daily": 7, "weekly": 84, "monthly": 365},
    "user_engagement": {"daily": 30, "weekly": 84, "monthly": 365},
    "leaderboard_trends": {"daily": 30, "weekly": 84, "monthly": 365},
    "scoring_patterns": {"daily": 7, "weekly": 28, "monthly": 90},
}

BUCKET_UNIT = {"daily": "day", "weekly": "week", "monthly": "month"}

# Names of the days, Sunday first.
DAY_NAMES = ("Sunday", "Monday", "Tuesday", "Wednesday", "Thursday", "Friday", "Saturday")

DAY_MICROS = 86_400_000_000


def check_period(period):
    if period not in PERIODS:
        raise ValueError(f"period must be one of {', '.join(PERIODS)}, not {period!r}")
    return period


def as_datetime(moment):
    return moment if isinstance(moment, datetime) else datetime.fromisoformat(moment)


def moment(value, like=None):
    """A timestamp literal of the type of ``like`` (a DataType), so comparisons reach the scan."""
    kind = "timestamp" if isinstance(like, T.TimestampType) else "timestamp_ntz"
    return F.lit(as_datetime(value).isoformat(sep=" ")).cast(kind)


def since(scores, start, end=None):
    """Scores submitted from ``start`` on, up to and with ``end`` where one is given.

    Stored scores are laid out by day; where the column is there, other days are not opened.
    """
    kind = scores.schema["submitted_at"].dataType
    rows = scores.filter(F.col("submitted_at") >= moment(start, kind))
    if end is not None:
        rows = rows.filter(F.col("submitted_at") <= moment(end, kind))
    if "day" in scores.columns and isinstance(scores.schema["day"].dataType, T.DateType):
        # A day more on both sides, since the folders may be named in another zone.
        first = as_datetime(start).date() - timedelta(days=1)
        rows = rows.filter(F.col("day") >= F.lit(first))
        if end is not None:
            rows = rows.filter(F.col("day") <= F.lit(as_datetime(end).date() + timedelta(days=1)))
    return rows


def period_window(report, period, as_of):
    """(start, end) of the window that ``report`` uses for ``period``."""
    end = as_datetime(as_of)
    return end - timedelta(days=LOOKBACK_DAYS[report][check_period(period)]), end


def in_period(scores, report, period, as_of):
    """Scores within the report's window."""
    return since(scores, *period_window(report, period, as_of))


def local_time(ts, tz="UTC"):
    """Wall-clock time in ``tz`` of a UTC instant, as timestamp_ntz."""
    wall = F.col(ts) if isinstance(ts, str) else ts
    wall = wall.cast("timestamp_ntz")
    return wall if tz == "UTC" else F.convert_timezone(F.lit("UTC"), F.lit(tz), wall)


def bucket(unit, ts, tz="UTC"):
    """Start of the hour, day, week (Monday) or month that holds ``ts``."""
    return F.date_trunc(unit, local_time(ts, tz)).cast("timestamp_ntz")


def date_of(ts, tz="UTC"):
    return F.to_date(local_time(ts, tz))


def hour_of(ts, tz="UTC"):
    return F.hour(local_time(ts, tz)).cast("bigint")


def weekday(ts, tz="UTC"):
    """Day of week, Sunday = 0."""
    return (F.dayofweek(local_time(ts, tz)) - 1).cast("bigint")


def weekday_of_date(date):
    return (F.dayofweek(date) - 1).cast("bigint")


def day_name(dow):
    names = F.array(*[F.lit(n) for n in DAY_NAMES])
    return F.element_at(names, (dow + 1).cast("int"))


def micros_of(ts):
    """Microseconds from 1970 to a stored time. No session zone takes part, so none folds times."""
    wall = (F.col(ts) if isinstance(ts, str) else ts).cast("timestamp_ntz")
    second = F.extract(F.lit("SECOND"), wall) * 1_000_000
    minutes = (F.hour(wall) * 60 + F.minute(wall)).cast("bigint")
    days = F.unix_date(wall.cast("date")).cast("bigint")
    return days * DAY_MICROS + minutes * 60_000_000 + second.cast("bigint")


def micros_between(start, end):
    return micros_of(end) - micros_of(start)


def span_days(start, end):
    return micros_between(start, end).cast("double") / F.lit(float(DAY_MICROS))


UTC_NAMES = ("UTC", "Etc/UTC", "GMT", "Z", "+00:00")


def on_event_time(stream, delay):
    """A stream with its watermark. Watermarks need the zoned type, so the session zone must be UTC."""
    zone = stream.sparkSession.conf.get("spark.sql.session.timeZone")
    if zone not in UTC_NAMES:
        raise ValueError(f"streams need spark.sql.session.timeZone=UTC, not {zone}: others shift times")
    zoned = stream.withColumn("submitted_at", F.col("submitted_at").cast("timestamp"))
    return zoned.withWatermark("submitted_at", delay)


def stored_time(col):
    return F.col(col).cast("timestamp_ntz")
