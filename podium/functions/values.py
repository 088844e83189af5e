"""Small column helpers used by most operators."""

from pyspark.sql import functions as F

from podium.functions.times import micros_of
from podium.schemas import HIGHEST


def mean(col):
    """Average as double from an exact decimal sum; null for no rows."""
    c = F.col(col) if isinstance(col, str) else col
    return ratio(F.sum(c), F.count(c))


def ratio(top, bottom):
    """True division to double, null when the bottom is zero."""
    return F.try_divide(top.cast("double"), bottom.cast("double"))


def spread(col):
    """Sample standard deviation; null for one row."""
    return F.stddev_samp(F.col(col).cast("double"))


def display_name(name="name", email="email"):
    """The name, or the email when the name is empty."""
    return F.coalesce(F.nullif(F.col(name), F.lit("")), F.col(email))


def is_highest(score_type="score_type"):
    return F.col(score_type) == HIGHEST


def best_of(top, low, score_type="score_type"):
    """The better of an extreme pair: max where high scores win, else min."""
    return F.when(is_highest(score_type), top).otherwise(low)


def sort_key(score="score", score_type="score_type"):
    """Ascending key that puts the best score first, in hundredths.

    A score has at most 12 digits, so the key fits a bigint and lies within +-10^12.
    """
    cents = (F.col(score) * 100).cast("bigint")
    return F.when(is_highest(score_type), -cents).otherwise(cents)


def member(user_id="user_id"):
    """Tie-break of the boards: users compare as text."""
    return F.col(user_id).cast("string")


def event_key(ts="submitted_at", id="id"):
    """(time, id) as one decimal, so that max_by/min_by stay in a hash aggregate.

    A struct key would force a sort-based aggregate over all rows. 18 digits hold the
    microseconds, 19 more the id.
    """
    shift = F.expr("cast('10000000000000000000' as decimal(20,0))")
    micros = micros_of(ts).cast("decimal(18,0)")
    return ((micros * shift).cast("decimal(38,0)") + F.col(id)).cast("decimal(38,0)")


def with_json(rows, *keys, col="metadata"):
    """Rows with top-level JSON fields as text columns, parsed once; null when absent or broken."""
    return rows.select("*", F.json_tuple(col, *keys).alias(*keys))


def normal_email(col="email"):
    """Lower-case the domain part, as done when a user is stored."""
    c = F.col(col)
    domain = F.substring_index(c, "@", -1)
    local = F.substring(c, F.lit(1), F.length(c) - F.length(domain))
    return F.when(c.contains("@"), F.concat(local, F.lower(domain))).otherwise(c)
