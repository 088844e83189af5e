"""Ranks by value that never put one whole group into one task.

Rows are first counted per distinct value (combined before the shuffle). A key lies within
+-10^12, so it splits into a high part of at most 2^21 values and a low part of 2^20 values; each
window below therefore sorts a bounded number of rows, whatever the data.
"""

from pyspark.sql import Window
from pyspark.sql import functions as F

LOW_BITS = 20


def running_before(counts, group, key, totals, count="n", out="before"):
    """For rows unique in (group, key): the sum of ``count`` over smaller keys of the group.

    ``key`` is a bigint as made by :func:`podium.functions.values.sort_key`. ``totals`` has the sum
    of ``count`` per group and high part, in the columns ``_high`` and ``_total``.
    """
    high = [*group, "_high"]
    w_low = Window.partitionBy(*high).orderBy(key).rowsBetween(Window.unboundedPreceding, -1)
    fine = counts.withColumn("_high", high_part(key)).withColumn(
        "_low_before", F.coalesce(F.sum(count).over(w_low), F.lit(0))
    )
    w_high = Window.partitionBy(*group).orderBy("_high").rowsBetween(Window.unboundedPreceding, -1)
    coarse = totals.select(
        *high, F.coalesce(F.sum("_total").over(w_high), F.lit(0)).alias("_high_before")
    )
    return (
        fine.join(coarse, high)
        .withColumn(out, F.col("_low_before") + F.col("_high_before"))
        .drop("_high", "_low_before", "_high_before")
    )


def high_part(key):
    return F.shiftright(F.col(key), LOW_BITS)


def value_ranks(rows, group, key, out="rank"):
    """Distinct (group, key) with row count ``n`` and competition rank, best (smallest) key first."""
    counts = rows.groupBy(*group, key).agg(F.count(F.lit(1)).alias("n"))
    # From the rows again: combined before the shuffle, this is small, while deriving it from the
    # counts would shuffle all distinct values a second time.
    totals = rows.groupBy(*group, high_part(key).alias("_high")).agg(
        F.count(F.lit(1)).alias("_total")
    )
    ranked = running_before(counts, group, key, totals)
    return ranked.withColumn(out, (F.col("before") + 1).cast("bigint")).drop("before")


def with_rank(rows, group, key, out="rank"):
    """Competition rank (1, 2, 2, 4) of every row in its group by ascending ``key``."""
    ranks = value_ranks(rows, group, key, out).drop("n")
    return rows.join(ranks, [*group, key])
