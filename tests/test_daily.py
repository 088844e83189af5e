"""Summaries by day against the same counts of the scores."""

import os
import random

import pytest
from pyspark.sql import functions as F

from podium.plans import daily
from tests.conftest import rows

SHARES = (0.25, 0.5, 0.75)


@pytest.fixture(scope="module")
def stored(make, tmp_path_factory):
    rand, path = random.Random(6), str(tmp_path_factory.mktemp("days"))
    scores = make.scores(
        *(
            (i, rand.choice([rand.randrange(300), 32_768 * rand.randrange(3), 10**9 + i % 5]), rand.choice([1, 2, 3]),
             rand.randrange(1000), f"2024-01-{rand.choice([1, 2, 3, 9, 20]):02d} {i % 24:02d}:00:00")
            for i in range(4000)
        )
    )
    daily.store_days(scores, path)
    return scores, path


@pytest.mark.parametrize("first, last", [(None, None), ("2024-01-02", "2024-01-09"), ("2024-01-04", "2024-01-08")])
def test_spans_of_days(spark, make, stored, first, last):
    scores, path = stored
    day = F.to_date("submitted_at")
    span = scores.filter(day.between(first, last)) if first else scores
    for by in ((), ("game_id",)):
        want = span.groupBy(*by).agg(F.count_distinct("user_id").alias("n"))
        got = daily.distinct_players(spark, path, first, last, by)
        assert [r for r in rows(got) if r[-1]] == [r for r in rows(want) if r[-1]]
    games = make.games((1, "a", "highest"), (2, "b", "lowest"), (3, "c", "time"))
    got = daily.merged_performance(spark, path, games, first, last)
    want = span.groupBy("game_id").agg(
        F.count(F.lit(1)), F.count_distinct("user_id"), F.max("score"), F.min("submitted_at")
    )
    assert rows(got, "game__id", "total_plays", "unique_players", "max_score", "first_play") == rows(want)
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan") == 2 and "submitted_at" not in plan


@pytest.mark.parametrize("width", [1, 3, 30])
def test_rolling_players(spark, stored, width):
    scores, path = stored
    seen = {}
    for r in scores.select(F.to_date("submitted_at").alias("d"), "user_id").distinct().collect():
        seen.setdefault(r.d, set()).add(r.user_id)
    want = sorted(
        (d, len(set().union(*(u for e, u in seen.items() if 0 <= (d - e).days < width)))) for d in seen
    )
    assert sorted(map(tuple, daily.rolling_players(spark, path, width).collect())) == want


def test_estimates_stay_within_their_error(spark, tmp_path):
    path = str(tmp_path / "days")
    scores = spark.range(200_000).selectExpr(
        "id", "cast(pmod(id * 7919, 60000) as bigint) user_id", "id % 2 game_id",
        "cast(pmod(id * 104729, 100003) / 100 as decimal(12,2)) score",
        "timestamp_ntz '2024-01-01 00:00:00' + make_dt_interval(id % 10) submitted_at",
    )
    daily.store_days(scores, path)
    exact = dict(rows(daily.distinct_players(spark, path)))
    near = dict(rows(daily.approximate_players(spark, path)))
    assert all(abs(near[g] / n - 1) < 4 * 0.0163 for g, n in exact.items())  # four standard errors
    found = daily.approximate_quantiles(spark, path, SHARES)
    met = scores.join(F.broadcast(found), "game_id").groupBy("game_id").agg(
        *(F.avg((F.col("score") <= F.col(f"q{round(100 * s)}")).cast("double")) for s in SHARES)
    )
    for row in met.collect():
        assert all(abs(got - s) < 3 * 0.0167 for got, s in zip(row[1:], SHARES))


def test_a_refresh_touches_its_days_only(spark, make, tmp_path):
    path = str(tmp_path / "days")
    before = make.scores(*((i, i % 5, 1, i, f"2024-01-0{1 + i % 4} 10:00:00") for i in range(40)))
    daily.store_days(before, path)
    files = {n: sorted(os.listdir(f"{path}/{n}/day=2024-01-01")) for n in ("sums", "players")}
    # One day gets a score, one loses all of its own.
    after = before.filter("day(submitted_at) <> 3").unionByName(make.scores((99, 77, 1, 5, "2024-01-02 12:00:00")))
    changed = before.filter("day(submitted_at) = 3").unionByName(after.filter("id = 99"))
    daily.refresh_days(after, changed, path)
    assert files == {n: sorted(os.listdir(f"{path}/{n}/day=2024-01-01")) for n in ("sums", "players")}
    again = str(tmp_path / "again")
    daily.store_days(after, again)
    for name, columns in (("sums", ["day", "game_id", "n", "score_sum"]), ("players", ["day", "bucket", "users"])):
        a, b = (daily._read(spark, p, name) for p in (path, again))
        assert rows(a, *columns) == rows(b, *columns)
    assert rows(daily.distinct_players(spark, path, by=())) == [(6,)]


def test_nothing_stored(spark, tmp_path):
    assert daily.approximate_players(spark, str(tmp_path)).collect() == []
