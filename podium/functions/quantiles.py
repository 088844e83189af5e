"""Exact percentiles of a whole column without one sort in one task.

The value is split as in :mod:`podium.functions.ranks`. The counts per high part find which parts
hold the wanted positions; only those parts (at most two per percentile) are counted by value.
"""

from pyspark.sql import Window
from pyspark.sql import functions as F

from podium.functions.ranks import LOW_BITS


def _upto(partition, order):
    return Window.partitionBy(*partition).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)


def percentiles(rows, col, points, names):
    """One row with the linearly interpolated percentiles of a decimal(12,2) column, as doubles.

    ``points`` are fractions; ``names`` the output columns. No rows give nulls.
    """
    keyed = rows.filter(F.col(col).isNotNull()).select((F.col(col) * 100).cast("bigint").alias("k"))
    high = F.shiftright("k", LOW_BITS)

    # At most 2^21 rows, so one window over all of them is bounded. The literal key marks that.
    parts = keyed.groupBy(high.alias("h")).agg(F.count(F.lit(1)).alias("n"))
    parts = parts.withColumn("one", F.lit(1))
    parts = parts.select(
        "one",
        "h",
        F.sum("n").over(_upto(["one"], "h")).alias("upto"),
        F.sum("n").over(Window.partitionBy("one")).alias("total"),
        "n",
    )
    at = [F.lit(float(p)) * (F.col("total") - 1) for p in points]
    ends = F.array_distinct(
        F.array(*[f(a).cast("bigint") for a in at for f in (F.floor, F.ceil)])
    )
    first = F.col("upto") - F.col("n")
    # At most 2 * len(points) rows.
    wanted = parts.filter(F.exists(ends, lambda e: (e >= first) & (e < F.col("upto"))))
    wanted = F.broadcast(wanted.select("h", first.alias("start"), "total"))
    values = (
        keyed.withColumn("h", high)
        .join(wanted, "h")
        .groupBy("h", "start", "total", "k")
        .agg(F.count(F.lit(1)).alias("n"))
        .withColumn("upto", F.col("start") + F.sum("n").over(_upto(["h"], "k")))
    )
    values = values.withColumn(
        "ends", F.filter(ends, lambda e: (e >= first) & (e < F.col("upto")))
    ).filter(F.size("ends") > 0)
    found = values.select(F.explode("ends").alias("pos"), (F.col("k") / 100.0).alias("v"), "total")

    def value_at(position):
        return F.max(F.when(F.col("pos") == position.cast("bigint"), F.col("v")))

    aggs = []
    for a, name in zip(at, names):
        aggs += [
            value_at(F.floor(a)).alias(f"{name}_lo"),
            value_at(F.ceil(a)).alias(f"{name}_hi"),
            F.max(a - F.floor(a)).alias(f"{name}_part"),
        ]
    picked = found.agg(*aggs)
    return picked.select(
        *[
            (
                F.col(f"{n}_lo") + F.col(f"{n}_part") * (F.col(f"{n}_hi") - F.col(f"{n}_lo"))
            ).alias(n)
            for n in names
        ]
    )
