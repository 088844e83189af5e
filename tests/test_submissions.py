from decimal import Decimal as D

import pytest
from pyspark.sql import functions as F

from podium.operators import submissions as subs
from tests.conftest import rows

T1, T2 = "2024-01-01 10:00:00", "2024-01-02 10:00:00"


def test_reject_reasons(make):
    games = make.games((1, "open", "highest"), (2, "closed", "highest", False))
    given = make.submissions(
        (1, 1, 1, "12.50", None),
        (2, 1, 7, "1", "{}"),
        (3, 1, 2, "1", "{}"),
        (4, 1, 1, "-0.01", "{}"),
        (5, 1, 1, "1.005", "{}"),
        (6, 1, 1, "10000000000", "{}"),
        (7, 1, 1, "many", "{}"),
        (8, 1, 1, "9999999999.99", '{"level": 2}'),
        (9, 1, 1, "0", "{}"),
        (10, 1, None, "0", "{}"),
    )
    judged = subs.judged(given, games)
    reasons = dict(rows(judged, "id", "reject_reason"))
    assert reasons == {
        1: None,
        2: "game_not_found",
        3: "game_inactive",
        4: "score_negative",
        5: "too_many_decimals",
        6: "too_many_digits",
        7: "score_not_a_number",
        8: None,
        9: None,
        10: "game_not_found",
    }
    assert rows(subs.valid(judged), "id", "score", "metadata") == [
        (1, D("12.50"), "{}"),
        (8, D("9999999999.99"), '{"level": 2}'),
        (9, D("0.00"), "{}"),
    ]
    assert subs.rejected(judged).count() == 7


@pytest.fixture(scope="module")
def played(make):
    games = make.games((1, "high", "highest"), (2, "fast", "time"))
    scores = make.scores(
        (1, 5, 1, 10, T1),
        (2, 5, 1, 10, T1),  # same instant and score: no best
        (3, 5, 1, 11, T2),
        (4, 5, 2, 10, T1),
        (5, 5, 2, 12, T2),
        (6, 6, 2, 9, T1),
        (7, 6, 2, 8, T2),
    )
    return scores, games


@pytest.mark.parametrize("bound", [None, 1])
def test_personal_best(played, bound):
    scores, games = played
    flags = dict(rows(subs.personal_best_flags(scores, games, bound), "id", "is_personal_best"))
    assert flags == {1: True, 2: False, 3: True, 4: True, 5: False, 6: True, 7: True}


def test_user_best_takes_the_earliest_of_equals(make, played):
    scores, games = played
    got = rows(subs.user_best(scores, games), "user_id", "game_id", "id", "score")
    assert got == [(5, 1, 3, D("11.00")), (5, 2, 4, D("10.00")), (6, 2, 7, D("8.00"))]
    tied = make.scores((1, 5, 1, 7, T2), (2, 5, 1, 7, T1), (3, 5, 1, 7, T1))
    assert rows(subs.user_best(tied, games, 5, 1), "id") == [(2,)]


def test_history(played):
    scores, games = played
    first = subs.score_history(scores, games, 5, 1, page=1, page_size=2).collect()
    assert [r.id for r in first] == [3, 2]
    second = subs.score_history(scores, games, 5, 1, page=2, page_size=2).collect()
    assert [r.id for r in second] == [1]
    assert [r.id for r in subs.score_history_top(scores, games, 5, 1, limit=1).collect()] == [3]
    assert subs.score_history_top(scores, games, 5, 1).count() == 3


def test_history_pages(played):
    scores, games = played
    first = subs.history_page(scores, games, 5, 1, page=1, page_size=2).collect()
    assert [r.id for r in first] == [3, 2] and first[0].has_next and first[0].page_size == 2
    last = subs.history_page(scores, games, 5, 1, page=2, page_size=2).collect()
    assert [r.id for r in last] == [1] and not last[0].has_next
    (empty,) = subs.history_page(scores, games, 5, 1, page=3, page_size=2).collect()
    assert (empty.id, empty.page, empty.page_size, empty.has_next) == (None, 3, 2, False)


def test_submission_results(played, spark):
    scores, games = played
    new = spark.createDataFrame([(3,), (5,)], "id long")
    got = rows(subs.submission_results(scores, games, new), "id", "rank", "total_players",
               "is_personal_best")
    assert got == [(3, 1, 1, True), (5, 2, 2, False)]


@pytest.mark.parametrize("bound", [None, 5])
def test_rate_limit(make, spark, bound):
    one = [(i, 1, 1, i, f"2024-01-01 00:00:{i:02d}") for i in range(31)]
    scores = make.scores(*one, (99, 1, 1, 1, "2024-01-01 00:01:00"))
    over = subs.rate_limit_excess(scores, bound=bound)
    assert rows(over, "id", "position") == [(30, 31)]


@pytest.mark.parametrize("bound", [None, 2])
def test_sessions(make, bound):
    scores = make.scores(
        (1, 1, 1, 1, "2024-01-01 00:00:00"),
        (2, 1, 1, 1, "2024-01-01 00:29:59"),
        (3, 1, 1, 1, "2024-01-01 00:59:59"),  # a pause of exactly 30 minutes
        (4, 1, 1, 1, "2024-01-01 01:30:00"),  # one second more
        (5, 2, 1, 1, "2024-01-01 01:00:00"),
    )
    got = rows(subs.play_sessions(scores, 30, bound), "user_id", "submissions", "length_seconds")
    assert got == [(1, 1, 0.0), (1, 3, 3599.0), (2, 1, 0.0)]
    # The same rule as the session windows of a stream.
    native = scores.withColumn("submitted_at", F.col("submitted_at").cast("timestamp")).groupBy(
        "user_id", F.session_window("submitted_at", "30 minutes")
    ).count()
    assert rows(native, "user_id", "count") == [(1, 1), (1, 3), (2, 1)]


def test_odd_texts_are_taken_apart_once(spark, make):
    """Each part of a text is matched once a row, however many rules and columns use it."""
    games = make.games((1, "High", "highest"))
    texts = ["5", "-1", "1.001", "1e3", "1.50e1", "abc", "1" + "0" * 30, "-0.00", None]
    given = spark.createDataFrame(
        [(i, 1, 1, t, None) for i, t in enumerate(texts)],
        "id long, user_id long, game_id long, score string, metadata string",
    ).withColumn("submitted_at", F.lit("2024-01-01 10:00:00").cast("timestamp_ntz"))
    judged = subs.judged(given, games)
    plan = judged._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("regexp_extract") == 6
    found = [(None if r["score"] is None else float(r["score"]), r["reject_reason"]) for r in judged.orderBy("id").collect()]
    assert found == [
        (5.0, None), (None, "score_negative"), (None, "too_many_decimals"), (1000.0, None), (15.0, None),
        (None, "score_not_a_number"), (None, "too_many_digits"), (0.0, None), (None, "score_not_a_number"),
    ]
