"""Cases the generated tables lack: nulls in split groups, digits in texts, zones, deep pages."""

import os
from decimal import Decimal as D

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from podium.functions import times
from podium.functions.sequences import Sequence
from podium.functions.values import event_key
from podium.operators import ranking, standings, submissions
from podium.plans import reports, views
from podium.sources import sinks, tables
from tests.conftest import rows

T = "2024-01-%02d 10:00:00"


@pytest.mark.parametrize("bound", [None, 1, 3])
def test_nulls_before_a_row_stay_null_when_split(spark, bound):
    data = [(i, 1, None if i % 3 == 1 else i) for i in range(12)] + [(50, 2, None), (51, 2, 4)]
    df = spark.createDataFrame(data, "id long, g long, v long")
    got = Sequence(df, ["g"], ["id"], bound).previous("p", "v").done()
    plain = df.withColumn("p", F.lag("v").over(Window.partitionBy("g").orderBy("id")))
    assert rows(got, "id", "p") == rows(plain, "id", "p")


@pytest.mark.parametrize(
    "text, reason, score",
    [
        ("1.00000000001", "too_many_decimals", None),
        ("0.009999999999999", "too_many_decimals", None),
        ("-0.00000000001", "score_negative", None),
        ("1" + "0" * 30, "too_many_digits", None),
        ("1.000", None, "1.00"), ("00012.50", None, "12.50"), ("1e2", None, "100.00"),
        ("1.5E-1", None, "0.15"), ("15e-3", "too_many_decimals", None), ("1e10", "too_many_digits", None),
        ("1e99999999999", "too_many_digits", None), ("1e-99999999999", "too_many_decimals", None),
        ("-0.00", None, "0.00"), ("0e99999999999", None, "0.00"), (".5", None, "0.50"), ("5.", None, "5.00"),
        (" 7 ", None, "7.00"), ("+7", None, "7.00"), ("", "score_not_a_number", None),
        (".", "score_not_a_number", None), ("NaN", "score_not_a_number", None),
        ("1_000", "score_not_a_number", None), (None, "score_not_a_number", None),
    ],
)
def test_digits_are_judged_in_the_text(make, text, reason, score):
    games = make.games((1, "open", "highest"))
    (row,) = submissions.judged(make.submissions((1, 1, 1, text, "{}")), games).collect()
    assert (row.reject_reason, row.score) == (reason, D(score) if score else None)


def test_times_do_not_fold_in_the_session_zone(make, spark):
    """02:30 does not exist in New York on that day."""
    zone = spark.conf.get("spark.sql.session.timeZone")
    try:
        spark.conf.set("spark.sql.session.timeZone", "America/New_York")
        scores = make.scores(
            (2, 1, 1, 5, "2024-03-10 02:30:00"), (1, 1, 1, 9, "2024-03-10 03:10:00"),
            (3, 2, 1, 4, "1969-12-31 23:59:59.5"),
        )
        assert rows(standings.latest_standings(scores), "user_id", "score") == [(1, D("9.00")), (2, D("4.00"))]
        micros = scores.select(times.micros_of("submitted_at").alias("m"))
        assert rows(micros) == [(-500_000,), (1710037800000000,), (1710040200000000,)]
        between = submissions.play_sessions(scores, gap_minutes=39).filter("user_id = 1")
        assert between.count() == 2
        assert scores.select(event_key().alias("k")).orderBy("k").count() == 3
    finally:
        spark.conf.set("spark.sql.session.timeZone", zone)


@pytest.fixture
def month(make):
    games = make.games((1, "a", "highest"))
    users = make.users((1, "one"), (2, "two"))
    return make.scores((1, 1, 1, 5, T % 3), (2, 1, 1, 6, T % 5), (3, 2, 1, 9, T % 9)), games, users


def test_reports_do_not_see_later_scores(month):
    scores, games, users = month
    trend = reports.activity_trend(scores, "2024-01-05 10:00:00")
    assert trend.agg(F.sum("total_submissions")).first()[0] == 2
    engaged = {r.user_id: r for r in views.user_engagement(scores, users, "2024-01-06").collect()}
    assert engaged[2].total_submissions == 0 and engaged[1].days_since_last_activity > 0


def test_days_outside_the_window_are_not_opened(month, spark, tmp_path):
    path = str(tmp_path / "scores")
    tables.write_scores(month[0], path)
    stored = spark.read.parquet(path)
    chosen = times.since(stored, "2024-01-05 00:00:00", "2024-01-06 00:00:00")
    plan = chosen._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(day" in plan
    assert rows(chosen, "id") == [(2,)]


def test_top_players_without_a_limit(month, monkeypatch):
    scores, games, users = month
    got = reports.top_players(scores, games, users, "2024-01-10", limit=None)
    assert rows(got, "rank", "user_id") == [(1, 2), (2, 1)]
    monkeypatch.setattr(reports, "TOP_BOUND", 0)
    assert rows(reports.top_players(scores, games, users, "2024-01-10", limit=1), "rank") == [(1,)]
    with pytest.raises(ValueError):
        reports.top_players(scores, games, users, "2024-01-10", limit=0)


def test_user_best_needs_no_sort(month):
    plan = submissions.user_best(*month[:2])._jdf.queryExecution().executedPlan().toString()
    assert "SortAggregate" not in plan


def test_a_game_has_few_files_and_clearing_clears(spark, tmp_path):
    path, mode = str(tmp_path / "boards"), "spark.sql.sources.partitionOverwriteMode"
    board = spark.range(5000).repartition(64).selectExpr(
        "id % 5 as game_id", "id as user_id", "cast(id as decimal(12,2)) as score",
        "timestamp_ntz'2024-01-01 00:00:00' as submitted_at", "1L as n",
    )
    standings.store_standings(board, path)
    files = [f for _, _, names in os.walk(path) for f in names if f.endswith(".parquet")]
    assert len(files) <= 10
    before = spark.conf.get(mode)
    spark.conf.set(mode, "dynamic")
    try:
        standings.clear_board(spark, path, 3)
        assert standings.stored_standings(spark, path).count() == 4000
        standings.clear_board(spark, path)
        assert standings.stored_standings(spark, path).count() == 0
    finally:
        spark.conf.set(mode, before)


def test_one_games_board_opens_only_its_folder(spark, make, tmp_path):
    path = str(tmp_path / "boards")
    scores = make.scores(*((i, i, 1 + i % 3, i, T % 1) for i in range(30)))
    games = make.games((1, "a", "highest"), (2, "b", "lowest"), (3, "c", "time"))
    users = make.users(*((i, f"n{i}") for i in range(30)))
    standings.store_standings(standings.best_standings(scores, games), path)
    board = standings.stored_standings(spark, path)
    got = ranking.standing_board(board, games, users, 0, 4, game_id=2)
    assert "PartitionFilters: [isnotnull(game_id" in got._jdf.queryExecution().executedPlan().toString()
    assert rows(got, "rank", "user_id") == rows(ranking.game_board(scores, games, users, 0, 4, game_id=2), "rank", "user_id")
    wanted = scores.filter("user_id < 6")
    assert rows(ranking.standing_ranks(board, games, wanted)) == rows(ranking.ranks_of(scores, games, wanted))


def test_deep_pages_equal_shallow_ones_and_empty_pages_have_an_envelope(make, monkeypatch):
    scores = make.scores(*((i, i % 40, 1, i % 7, T % (1 + i % 9)) for i in range(120)))
    games, users = make.games((1, "a", "highest")), make.users(*((i, f"n{i}") for i in range(38)))

    def pages(page):
        return [
            rows(ranking.global_page(scores, users, page, 10, bound=5)),
            rows(ranking.board_page(scores, games, users, 1, page, 10)),
            rows(submissions.history_page(scores, games, 7, 1, page, 2, bound=2)),
            rows(submissions.score_history(scores, games, 7, 1, page, 2, bound=2)),
        ]

    shallow = [pages(p) for p in (1, 2, 4, 9)]
    monkeypatch.setattr(ranking, "TOP_BOUND", 3)
    monkeypatch.setattr(submissions, "TOP_BOUND", 1)
    assert [pages(p) for p in (1, 2, 4, 9)] == shallow
    empty = ranking.global_page(scores, users, 9, 10).collect()
    assert [(r.user_id, r.page, r.has_next) for r in empty] == [(None, 9, False)]
    assert shallow[3][2][0][-3:] == (9, 2, False) and shallow[3][3] == []
    deep = ranking.global_page(scores, users, 20_000, 100)._jdf.queryExecution().executedPlan().toString()
    assert "TakeOrderedAndProject(limit=2000" not in deep


def test_a_page_of_unknown_users_still_says_what_follows(make):
    scores = make.scores(*((i, 100 + i, 1, i, T % 1) for i in range(5)))
    page = ranking.board_page(scores, make.games((1, "a", "highest")), make.users((1, "x")), 1, 1, 2)
    assert [(r.user_id, r.has_next) for r in page.collect()] == [(None, True)]


def test_reports_are_written_in_order(month, spark, tmp_path):
    scores, games, _ = month
    path = str(tmp_path / "r")
    order = sinks.REPORT_ORDER["activity_trend"]
    sinks.write_report(reports.activity_trend(scores, "2024-01-10", "daily"), path, order=order)
    lines = [line for f in sorted(os.listdir(path)) if f.endswith(".json") for line in open(f"{path}/{f}")]
    assert len(lines) == 3 and lines == sorted(lines)
