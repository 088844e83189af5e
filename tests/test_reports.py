from datetime import date, datetime
from decimal import Decimal as D

import pytest

from podium.functions.times import bucket, in_period, period_window
from podium.operators import filters
from podium.plans import dashboards, reports, views
from tests.conftest import rows

AS_OF = "2024-01-31 00:00:00"


@pytest.fixture(scope="module")
def world(make):
    games = make.games((1, "Alpha", "highest"), (2, "Beta", "time"), (3, "Idle", "highest"))
    users = make.users(
        (1, "ann", "2024-01-28 12:00:00"), (2, "", "2024-01-01 00:00:00"), (3, "cy"), (4, "never")
    )
    scores = make.scores(
        # user 1: exactly seven days before; Sunday 23:59:59, Monday 00:00:00
        (1, 1, 1, 10, "2024-01-24 00:00:00", '{"level": 3, "difficulty": "easy"}'),
        (2, 1, 1, 30, "2024-01-28 23:59:59", '{"level": "x"}'),
        (3, 1, 1, 20, "2024-01-29 00:00:00", "{}"),
        # user 2: exactly thirty days before
        (4, 2, 2, 5, "2024-01-01 00:00:00", '{"time_played": 60, "difficulty": "hard"}'),
        # user 3: a moment too old for Recent; one instant twice
        (5, 3, 2, 7, "2023-12-31 23:59:59", None),
        (6, 3, 2, 4, "2023-12-31 23:59:59", "{ }"),
    )
    return scores, games, users


def test_windows_are_inclusive(world):
    scores = world[0]
    assert rows(in_period(scores, "top_players", "weekly", AS_OF), "id") == [(1,), (2,), (3,)]
    assert in_period(scores, "user_engagement", "daily", AS_OF).count() == 4
    start, end = period_window("scoring_patterns", "weekly", AS_OF)
    assert (end - start).days == 28
    with pytest.raises(ValueError):
        in_period(scores, "top_players", "yearly", AS_OF)


def test_status(world):
    scores, _, users = world
    got = {r.user_id: r for r in views.user_engagement(scores, users, AS_OF).collect()}
    assert [got[u].user_status for u in (1, 2, 3, 4)] == ["Active", "Recent", "Inactive", "Inactive"]
    assert got[4].total_submissions == 0 and got[4].avg_score is None
    assert got[4].submissions_per_active_day is None and got[4].days_since_last_activity is None
    assert got[1].active_days == 3 and got[1].submissions_per_active_day == 1.0
    assert got[3].activity_span_days == 0.0


def test_game_analytics_keeps_idle_games(world):
    scores, games, _ = world
    got = {r.game_id: r for r in views.game_analytics(scores, games).collect()}
    assert got[3].total_submissions == 0 and got[3].submissions_per_player is None
    assert got[1].unique_players == 1 and got[1].score_range == D("20.00")


def test_trends(world):
    scores, games, users = world
    got = {
        (r.user_id, r.score): r
        for r in views.leaderboard_trends(scores, games, users).collect()
    }
    assert got[1, D("10.00")].performance_trend == "First"
    assert got[1, D("30.00")].performance_trend == "Better"
    assert got[1, D("20.00")].performance_trend == "Worse"
    # equal times: the id decides, and lower wins in this game
    assert got[3, D("7.00")].performance_trend == "First"
    assert got[3, D("4.00")].performance_trend == "Better"
    assert got[3, D("4.00")].daily_rank == 1 and got[3, D("7.00")].daily_rank == 2
    assert got[1, D("30.00")].day_of_week == 0 and got[1, D("20.00")].day_of_week == 1


def test_trends_in_pieces(world):
    assert rows(views.leaderboard_trends(*world)) == rows(views.leaderboard_trends(*world, bound=1))


def test_patterns_tolerate_bad_metadata(world):
    scores, games, _ = world
    got = {(r.hour_bucket, r.game_id): r for r in views.scoring_patterns(scores, games).collect()}
    sunday = got[datetime(2024, 1, 28, 23), 1]
    assert sunday.avg_level == 0.0 and sunday.day_name == "Sunday"
    assert sunday.time_period == "Evening" and sunday.score_stddev is None
    new_year = got[datetime(2024, 1, 1, 0), 2]
    assert new_year.avg_time_played == 60.0 and new_year.hard_count == 1
    assert new_year.time_period == "Night"


def test_daily_metrics(world):
    scores, _, users = world
    got = {r.metric_date: r for r in views.daily_metrics(scores, users).collect()}
    assert got[date(2024, 1, 28)].new_users_active == 1
    assert got[date(2024, 1, 29)].returning_users_active == 1
    assert got[date(2024, 1, 28)].day_type == "Weekend"
    assert got[date(2024, 1, 29)].day_type == "Weekday"
    # joined after the day: neither new nor returning
    early = got[date(2024, 1, 24)]
    assert (early.new_users_active, early.returning_users_active) == (0, 0)
    assert early.new_players_to_games == 1 and got[date(2024, 1, 29)].new_players_to_games == 0


def test_performance(world):
    scores, games, users = world
    got = {(r.user_id, r.game_id): r for r in views.user_performance(scores, games, users).collect()}
    one = got[2, 2]
    assert one.player_type == "Beginner" and one.score_consistency is None
    assert one.attempts_per_day is None and one.improvement_trend == "Stable"
    assert got[3, 2].improvement_trend == "Improving" and got[3, 2].best_score == D("4.00")
    assert got[1, 1].score_improvement == D("10.00")


def test_popularity_weeks(world):
    scores, games, _ = world
    got = {(r.game_id, r.week_start): r for r in views.game_popularity(scores, games).collect()}
    assert got[1, datetime(2024, 1, 22)].weekly_submissions == 2
    assert got[1, datetime(2024, 1, 29)].new_players_this_week == 0
    assert got[2, datetime(2023, 12, 25)].new_players_this_week == 1
    assert got[2, datetime(2024, 1, 1)].new_player_ratio == 1.0


def test_new_vs_returning_keeps_empty_days(world):
    scores, _, users = world
    got = rows(reports.new_vs_returning(scores, users, AS_OF))
    assert len(got) == 7 and got[0] == (date(2024, 1, 25), 0, 0, 0)
    by_day = {r[0]: r[1:] for r in got}
    assert by_day[date(2024, 1, 28)] == (1, 0, 1)
    assert by_day[date(2024, 1, 29)] == (0, 1, 1)


def test_top_players(world):
    scores, games, users = world
    got = reports.top_players(scores, games, users, AS_OF, "monthly").collect()
    assert [(r.rank, r.user_id, r.name) for r in sorted(got)] == [
        (1, 1, "ann"),
        (2, 2, "u2@example.com"),
    ]
    aware = reports.top_players(
        scores, games, users, "2024-01-01 00:00:00", "daily", game_id=2, direction_aware=True
    ).collect()
    assert {r.user_id: r.best_score for r in aware} == {2: D("5.00"), 3: D("4.00")}


def test_activity_and_metrics(world):
    scores, _, users = world
    got = {r.user__id: r for r in reports.user_activity(scores, users, AS_OF).collect()}
    assert got[3].sessions_per_day is None and got[1].total_sessions == 3
    none = reports.competition_metrics(scores, AS_OF, 3).collect()
    assert len(none) == 1 and none[0].avg_submissions_per_user is None
    assert none[0].total_participants == 0


def test_empty_distribution(world):
    empty = reports.score_distribution(world[0].filter("id < 0"), AS_OF).collect()
    assert len(empty) == 1 and empty[0].total_scores == 0 and empty[0].percentile_50 is None


def test_improvement_patterns(world):
    got = reports.improvement_patterns(world[0], AS_OF, "monthly").collect()
    by_user = {r.user_id: r for r in got}
    assert sorted(by_user) == [1, 3]
    assert by_user[1].improvement == D("10.00") and by_user[1].consistency == 1.0
    assert by_user[3].improvement == D("-3.00") and by_user[3].consistency == 0.5


def test_metadata(world):
    scores = world[0]
    assert filters.has_metadata(scores).count() == 3
    got = rows(reports.metadata_patterns(scores, AS_OF, "monthly"))
    assert ("easy", 3, 10.0, 1) in got and (None, None, 30.0, 1) in got


def test_progression_and_volatility(world):
    scores, games, users = world
    got = reports.score_progression(scores, games, users, AS_OF, 2).collect()
    assert {(r.user_id, r.improvement) for r in got} == {(2, D("0.00")), (3, D("-3.00"))}
    assert len(got) == 3
    moves = {r.game_id: r for r in reports.board_volatility(scores, games).collect()}
    assert moves[1].moves == 2 and moves[1].volatility == 0.0
    assert moves[2].volatility is None


def test_time_zone_buckets(world, spark):
    df = spark.sql("select timestamp_ntz'2024-01-28 23:30:00' as t")
    assert df.select(bucket("day", "t", "Africa/Cairo")).first()[0] == datetime(2024, 1, 29)
    assert df.select(bucket("week", "t")).first()[0] == datetime(2024, 1, 22)


def test_search_and_lists(world):
    scores, games, users = world
    assert rows(filters.search_scores(scores, games, users, "ALPHA ann"), "id") == [(1,), (2,), (3,)]
    assert filters.search_scores(scores, games, users, "alpha cy").count() == 0
    assert rows(filters.search_games(games, "about beta"), "game_id") == [(2,)]
    assert rows(filters.search_users(users, "NEV"), "user_id") == [(4,)]
    assert filters.visible_games(games, staff=True).count() == 3
    drill = rows(filters.date_drilldown(scores))
    assert (2024, None, None, 4) in drill and (2023, 12, 31, 2) in drill
    assert filters.submitted_when(scores, "past_7_days", AS_OF).count() == 3
    assert filters.submitted_when(scores, "this_year", AS_OF).count() == 4


def test_dashboards(world):
    scores, games, users = world
    cohort = rows(dashboards.retention_cohort(scores), "cohort_week", "weeks_since", "users", "share")
    assert (datetime(2024, 1, 22), 1, 1, 1.0) in cohort
    bins = rows(dashboards.score_histogram(scores, games, 2), "game_id", "bin", "count")
    assert bins == [(1, 1, 1), (1, 2, 2), (2, 1, 2), (2, 2, 1)]
    funnel = rows(dashboards.engagement_funnel(scores, users), "step", "users")
    assert funnel == [(1, 4), (2, 3), (3, 2), (4, 0)]
    segments = {r.user_id: r for r in dashboards.player_segments(scores, users, AS_OF).collect()}
    assert segments[4].player_type == "None" and segments[4].engagement_score == 0.0
    heat = rows(dashboards.board_heatmap(scores, games, top=1), "game_id", "score")
    assert (2, D("4.00")) in heat and (2, D("7.00")) not in heat
    mix = rows(dashboards.difficulty_mix(scores, games))
    assert mix == [(1, "Alpha", 1, 0, 0), (2, "Beta", 0, 0, 1)]
    moves = rows(dashboards.segment_transitions(scores), "from_segment", "to_segment", "transitions")
    assert moves == [("Casual", "Beginner", 1)]


def test_search_by_words_of_user_and_game(make, spark):
    games = make.games((1, "Alpha run", "highest"), (2, "Beta", "lowest"))
    users = make.users((1, "Ann Run"), (2, "Bob"), (3, ""))
    scores = make.scores(*((i, u, g, 5, "2024-01-01 00:00:00") for i, (u, g) in enumerate(
        [(1, 1), (2, 1), (3, 1), (1, 2), (2, 2), (3, 2), (9, 1)]
    )))

    def ids(query):
        return [r[0] for r in rows(filters.search_scores(scores, games, users, query), "id")]

    named = filters.with_names(scores, games, users)
    for query in ("", "run", "alpha run", "RUN beta", "beta ann", "u2@ beta", "nobody", "a a a", "e b"):
        want = named.filter(filters._matches(query, ["user_email", "user_name", "game_name"]))
        assert ids(query) == [r[0] for r in rows(want, "id")]
    found = filters.search_scores(scores, games, users, "beta ann")
    assert sorted(found.columns) == sorted(named.columns)


def test_facets_scan_the_scores_once(make, tmp_path, spark):
    games = make.games((1, "a", "highest"), (2, "b", "highest"), (3, "highest", "lowest"))
    path = str(tmp_path / "scores")
    make.scores(*((i, 1, 1 + i % 3, 5, "2024-01-01 00:00:00") for i in range(7))).write.parquet(path)
    facets = filters.score_facets(spark.read.parquet(path), games)
    assert facets._jdf.queryExecution().executedPlan().toString().count("FileScan parquet") == 1
    assert rows(facets) == [
        ("game", "a", 3), ("game", "b", 2), ("game", "highest", 2), ("score_type", "highest", 5), ("score_type", "lowest", 2)
    ]
