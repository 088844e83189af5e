"""Every registered query against its SQL on the smallest test folder."""

import os

import pytest

import __spark_entry__ as entry
from check import compare, duck
from podium.functions import sequences

SF_DIR = "/root/testdata/sf0.001"

pytestmark = pytest.mark.skipif(not os.path.isdir(SF_DIR), reason="no test tables")


@pytest.fixture(scope="module")
def con():
    return duck(SF_DIR)


@pytest.mark.parametrize("name", sorted(entry.own_queries()))
def test_query(spark, con, name):
    verdict, _ = compare(spark, con, SF_DIR, name, entry.queries()[name],
                         entry.oracle_sql().get(name))
    assert verdict.startswith("ok"), verdict


@pytest.mark.parametrize(
    "name",
    [
        "full_board_ranks",
        "staff_ranks",
        "staff_neighbours",
        "personal_best_flags",
        "personal_best_flags_orders",
        "submission_results",
        "rate_limit_excess_hourly",
        "play_sessions",
        "v_leaderboard_trends",
        "v_leaderboard_trends_orders",
        "stream_answers",
    ],
)
def test_query_with_all_groups_split(spark, con, name, monkeypatch):
    monkeypatch.setattr(sequences, "GROUP_BOUND", 3)
    verdict, _ = compare(spark, con, SF_DIR, name, entry.queries()[name], entry.oracle_sql()[name])
    assert verdict.startswith("ok"), verdict


def test_every_query_has_sql():
    assert set(entry.own_queries()) <= set(entry.oracle_sql())


def test_entry(spark):
    assert entry.entry(spark).count() > 0
