import json
from decimal import Decimal as D

import pytest
from pyspark.sql import functions as F

from podium.plans import reports, views
from podium.session import scratch, shared_dir
from podium.sources import demo, sinks, tables
from tests.conftest import rows


def test_demo_is_the_same_for_any_partitioning(spark):
    scores = demo.demo_scores(spark, 300, users=20, seed=4)
    assert rows(scores.repartition(7)) == rows(demo.demo_scores(spark, 300, users=20, seed=4))
    assert rows(demo.demo_scores(spark, 300, users=20, seed=5)) != rows(scores)


def test_demo_ranges(spark):
    games = demo.demo_games(spark)
    assert games.count() == 5
    scores = demo.demo_scores(spark, 3000)
    ends = {
        r.score_type: (r.low, r.high)
        for r in scores.join(games, "game_id")
        .groupBy("score_type")
        .agg(F.min("score").alias("low"), F.max("score").alias("high"))
        .collect()
    }
    assert D(100) <= ends["highest"][0] and ends["highest"][1] <= D(10000)
    assert D(1) <= ends["lowest"][0] and ends["lowest"][1] <= D(100)
    assert D(10) <= ends["time"][0] and ends["time"][1] <= D(300)
    one = json.loads(scores.first().metadata)
    assert 1 <= one["level"] <= 10 and one["difficulty"] in ("easy", "medium", "hard")
    assert one["session_id"].startswith("session_")
    assert scores.agg(F.count_distinct("user_id")).first()[0] == 50


def test_clear_and_summary(make, spark):
    users = make.users((100, "real")).unionByName(demo.demo_users(spark, 3))
    games = make.games((50, "Chess", "highest")).unionByName(demo.demo_games(spark))
    scores = make.scores(
        (1, 100, 50, 1, "2024-01-01 00:00:00"),
        (2, 100, 1, 1, "2024-01-01 00:00:00"),
        (3, 1, 50, 1, "2024-01-01 00:00:00"),
    )
    assert dict(rows(demo.scores_per_game(scores, games), "game_id", "scores"))[2] == 0
    assert rows(demo.totals(scores, games, users)) == [
        ("games", 6, 5), ("scores", 3, 1), ("users", 4, 3)
    ]
    kept, left_games, left_users = demo.without_demo(scores, games, users)
    assert rows(kept, "id") == [(1,)]
    assert rows(left_games, "game_id") == [(50,)] and rows(left_users, "user_id") == [(100,)]


def test_tables_round_trip(spark, tmp_path):
    base = str(tmp_path)
    scores = demo.demo_scores(spark, 200)
    tables.write_scores(scores, f"{base}/scores")
    back = tables.scan_scores(spark, base)
    assert rows(back.select(scores.columns)) == rows(scores)
    plan = back.filter("game_id = 2").select("user_id")
    text = plan._jdf.queryExecution().executedPlan().toString()
    assert "EqualTo(game_id,2)" in text and "metadata" not in text.split("ReadSchema")[1]
    first = tables.newest_first(scores).first()
    assert first.submitted_at == scores.agg(F.max("submitted_at")).first()[0]


def test_users_are_stored_with_lower_case_domains(spark):
    users = spark.createDataFrame([(1, "Ann.B@EXAMPLE.Com"), (2, "no-at")], "user_id long, email string")
    assert rows(tables.store_users(users), "email") == [("Ann.B@example.com",), ("no-at",)]
    with pytest.raises(Exception, match="needs an email"):
        tables.store_users(spark.createDataFrame([(1, "")], users.schema)).collect()


def test_jdbc_options():
    options = tables.jdbc_options("jdbc:postgresql://db/x", "scores", 10_000, 16, {"user": "u"})
    assert options["partitionColumn"] == "id" and options["numPartitions"] == "16"
    with pytest.raises(ValueError):
        tables.jdbc_options("u", "t", 1, 0)


def test_publish(spark, tmp_path):
    scores, games = demo.demo_scores(spark, 300), demo.demo_games(spark)
    users = demo.demo_users(spark)
    made = views.all_views(scores, games, users, "2024-02-01 00:00:00")
    assert len(made) == 7
    names = sinks.publish(made, drop_existing=True)
    assert spark.sql(f"select count(*) from {names[0]}").first()[0] == 5
    sinks.publish(made, str(tmp_path))
    for name, view in made.items():
        stored = spark.read.parquet(f"{tmp_path}/analytics_{name}")
        assert stored.count() == view.count()
    one_day = spark.read.parquet(f"{tmp_path}/analytics_leaderboard_trends").filter(
        "submission_date = date'2024-01-05'"
    )
    assert "PartitionFilters: [isnotnull(submission_date" in (
        one_day._jdf.queryExecution().executedPlan().toString()
    )
    sinks.drop_views(spark, made)
    assert not spark.catalog.tableExists(names[0])


def test_report_decimals_are_half_even(spark, tmp_path):
    df = spark.createDataFrame([(0.125, 0.00005, 1), (2.675, 0.5, 2)],
                               "avg_score double, consistency double, n int")
    assert rows(sinks.formatted(df)) == [(D("0.12"), D("0.0000"), 1), (D("2.68"), D("0.5000"), 2)]
    scores = demo.demo_scores(spark, 100)
    path = str(tmp_path / "report")
    sinks.write_report(reports.peak_hours(scores, "2024-02-01 00:00:00"), path)
    assert spark.read.json(path).count() == 24


def test_scratch_lies_in_the_shared_folder(spark):
    base = shared_dir(spark)
    assert spark.sparkContext.getCheckpointDir()
    one, two = scratch(spark, "a"), scratch(spark, "a")
    assert one != two and one.startswith(base.rstrip("/")) and one.endswith("/a")


def test_snapshots_are_whole(make, spark, tmp_path):
    path = str(tmp_path / "views")

    def two(n, *more):
        return {"a": spark.range(n), "b": spark.range(n).select(F.col("id") * 2, *more)}

    with pytest.raises(FileNotFoundError):
        sinks.read_snapshot(spark, path, "a")
    sinks.publish_snapshot(two(2), path)
    held = sinks.read_snapshot(spark, path, "b")
    with pytest.raises(Exception, match="lost"):
        sinks.publish_snapshot(two(5, F.raise_error(F.lit("lost"))), path)
    assert sinks.read_snapshot(spark, path, "a").count() == 2
    sinks.publish_snapshot(two(3), path)
    assert [sinks.read_snapshot(spark, path, n).count() for n in "ab"] == [3, 3]
    assert held.count() == 2
