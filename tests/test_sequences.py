import random

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from podium.functions.quantiles import percentiles
from podium.functions.ranks import high_part, running_before, with_rank
from podium.functions.sequences import Sequence, numbered
from tests.conftest import rows


@pytest.fixture(scope="module")
def skewed(spark):
    """One group holds most rows, times repeat, ids are unique."""
    r = random.Random(5)
    data = [
        (i, 1 if r.random() < 0.6 else r.randrange(2, 30), r.randrange(100), r.randrange(1000))
        for i in range(3000)
    ]
    return spark.createDataFrame(data, "id long, g long, t long, v long").repartition(6)


@pytest.mark.parametrize("bound", [50, 100_000])
def test_scans_equal_plain_windows(skewed, bound):
    seq = Sequence(skewed, ["g"], ["t", "id"], bound)
    assert seq.split == (bound == 50)
    seq.number("n").previous("p", "v").running("hi", F.max, F.greatest, "v")
    seq.running("lo", F.min, F.least, "v", inclusive=True)
    w = Window.partitionBy("g").orderBy("t", "id")
    plain = (
        skewed.withColumn("n", F.row_number().over(w).cast("bigint"))
        .withColumn("p", F.lag("v").over(w))
        .withColumn("hi", F.max("v").over(w.rowsBetween(Window.unboundedPreceding, -1)))
        .withColumn("lo", F.min("v").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    )
    cols = ["id", "g", "n", "p", "hi", "lo"]
    assert rows(seq.done(), *cols) == rows(plain, *cols)


def test_hot_group_is_spread(skewed):
    seq = Sequence(skewed, ["g"], ["t", "id"], 50)
    sizes = seq.rows.groupBy("g", "_piece").count()
    assert sizes.agg(F.max("count")).first()[0] <= 200  # of about 1800 rows in the group


def test_numbering_with_descending_order(skewed):
    order = [F.col("v").desc(), F.col("id")]
    plain = skewed.withColumn(
        "n", F.row_number().over(Window.partitionBy("g").orderBy(*order)).cast("bigint")
    )
    assert rows(numbered(skewed, ["g"], order, "n", 40), "id", "n") == rows(plain, "id", "n")


def test_one_order_value_only(spark):
    """All rows tie on time: the id still splits the group."""
    df = spark.range(1000).select("id", F.lit(1).alias("g"), F.lit(0).alias("t"))
    seq = Sequence(df, ["g"], ["t", "id"], 100).number("n")
    assert seq.done().filter("n != id + 1").count() == 0


def test_ranks_by_value(skewed, spark):
    keyed = skewed.withColumn("k", (F.col("v") - 500) * 7_000_011)
    plain = keyed.withColumn("r", F.rank().over(Window.partitionBy("g").orderBy("k")).cast("bigint"))
    assert rows(with_rank(keyed, ["g"], "k", "r"), "id", "r") == rows(plain, "id", "r")


def test_running_before_over_the_whole_key_range(spark):
    ks = [-(10**12), -(2**20), -(2**20) + 1, -1, 0, 1, 2**20 - 1, 2**20, 10**12]
    df = spark.createDataFrame([("a", k, i + 1) for i, k in enumerate(ks)], "g string, k long, n long")
    totals = df.groupBy("g", high_part("k").alias("_high")).agg(F.sum("n").alias("_total"))
    got = {r.k: r.before for r in running_before(df, ["g"], "k", totals).collect()}
    total = 0
    for i, k in enumerate(ks):
        assert got[k] == total
        total += i + 1


@pytest.mark.parametrize("n", [1, 2, 3, 10, 1000])
def test_percentiles(spark, n):
    df = spark.range(n).select(
        (F.pmod(F.xxhash64("id"), F.lit(10**9)) / 100).cast("decimal(12,2)").alias("score")
    )
    points, names = [0.25, 0.5, 0.75], ["a", "b", "c"]
    got = percentiles(df, "score", points, names).first()
    want = df.agg(*[F.percentile(F.col("score").cast("double"), p) for p in points]).first()
    assert list(got) == pytest.approx(list(want))


def test_percentiles_of_nothing(spark):
    df = spark.range(0).select(F.col("id").cast("decimal(12,2)").alias("score"))
    got = percentiles(df, "score", [0.5], ["m"]).collect()
    assert len(got) == 1 and got[0].m is None
