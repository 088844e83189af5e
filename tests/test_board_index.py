"""Stored indexes of boards: equal to the operators on scores, opening few files; versions."""

import random

import pytest
from pyspark.sql import functions as F

from podium.operators import board_index, ranking, standings
from podium.session import scratch
from podium.sources import versions
from tests.conftest import rows

USERS = 60


def files_read(df):
    """Run ``df`` and count the files its scans opened."""
    df.collect()
    plan, found = df._jdf.queryExecution().executedPlan(), 0
    leaves = plan.collectLeaves()
    for i in range(leaves.size()):
        metrics = leaves.apply(i).metrics()
        if metrics.contains("numFiles"):
            found += metrics.apply("numFiles").value()
    return found


@pytest.fixture
def plain(spark):
    """Plans as they are run, for their metrics."""
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    yield
    spark.conf.set("spark.sql.adaptive.enabled", "true")


@pytest.fixture(scope="module")
def tables(make):
    rand = random.Random(4)
    games = make.games((1, "High", "highest"), (2, "Low", "lowest"), (3, "Short", "time"), (4, "None", "highest"))
    users = make.users(*((i, f"U{i}") for i in range(USERS) if i % 9))
    scores = make.scores(
        *(
            (i, rand.randrange(USERS), rand.choice([1, 1, 1, 2, 3]), rand.randrange(12), f"2024-01-{1 + i % 28:02d} 10:00:00")
            for i in range(500)
        )
    )
    return scores, games, users


@pytest.fixture(scope="module", params=[1, 5, 1000])
def index(request, spark, tables):
    scores, games, _ = tables
    path = scratch(spark, "index")
    board_index.store_index(standings.best_standings(scores, games), games, path, leaf=request.param)
    return path


def test_pages(spark, tables, index):
    scores, games, users = tables
    for game, page, size in [(1, 1, 20), (1, 3, 7), (2, 2, 5), (1, 50, 20), (4, 1, 20)]:
        got = board_index.indexed_page(spark, index, users, game, page, size)
        want = ranking.board_page(scores, games, users, game, page, size)
        assert rows(got) == rows(want.select(*got.columns))


def test_ranks_and_neighbours(spark, tables, index):
    scores, games, users = tables
    for user in (0, 1, 17, 59, 999):
        got = board_index.indexed_rank(spark, index, user)
        want = ranking.user_rank(scores, games, user)
        assert rows(got) == rows(want.select(*got.columns))
    for user, game, reach in [(1, 1, 5), (17, 2, 1), (59, 1, 60), (5, 4, 5)]:
        got = board_index.indexed_neighbours(spark, index, users, user, game, reach)
        want = ranking.surrounding_players(scores, games, users, user, game, reach)
        assert rows(got) == rows(want.select(*got.columns))
    assert rows(board_index.indexed_rank(spark, index, 1, 1)) == rows(ranking.user_rank(scores, games, 1, 1))


def test_an_index_that_is_behind(spark, tables):
    scores, games, _ = tables
    early = scores.filter("id % 3 > 0")
    for best, kind in ((True, "best"), (False, "latest")):
        if kind == "best":
            board, since = standings.best_standings(early, games), standings.best_standings(scores.filter("id % 3 = 0"), games)
        else:
            late = scores.filter("day(submitted_at) > 20")
            board, since = standings.latest_standings(scores.filter("day(submitted_at) <= 20")), standings.latest_standings(late)
        path = scratch(spark, "behind")
        board_index.store_index(board, games, path, leaf=4)
        for user in (1, 8, 30):
            got = board_index.changed_rank(spark, path, since, games, user, best=best)
            want = ranking.user_rank(scores, games, user, kind=kind)
            assert rows(got) == rows(want.select(*got.columns))
    nothing = since.limit(0)
    got = board_index.changed_rank(spark, path, nothing, games, 8, game_id=1, best=False)
    assert rows(got) == rows(board_index.indexed_rank(spark, path, 8, 1))
    assert board_index.changed_rank(spark, path, nothing, games, 999).collect() == []


def test_files_opened(spark, tables, plain):
    scores, games, users = tables
    path = scratch(spark, "index")
    board_index.store_index(standings.best_standings(scores, games), games, path, leaf=5)
    index = board_index.Index(spark, path)
    assert files_read(index.ranks(1, 6, 10)) == 1 and files_read(index.ranks(1, 6, 11)) == 2
    assert files_read(board_index.indexed_page(spark, path, users, 1, 4, 5)) <= 2 * 2  # shown and looked ahead
    assert files_read(index.of_user(8)) == 1 and files_read(index.tops([1, 2])) == 2
    leaves = spark.read.parquet(f"{index.folder}/rows").select("game_id", "leaf", F.input_file_name()).distinct()
    assert leaves.groupBy("game_id", "leaf").count().agg(F.max("count")).first()[0] == 1


def test_small_leaves_share_files(spark, tables, plain):
    """Many small leaves lie in few files, and each is still found alone."""
    scores, games, users = tables
    early, late = scores.filter("id % 3 > 0"), scores.filter("id % 3 = 0")
    path = scratch(spark, "shared")
    board_index.store_index(standings.best_standings(early, games), games, path, leaf=1)
    index = board_index.Index(spark, path)
    stored = spark.read.parquet(f"{index.folder}/rows")
    leaves = stored.count()
    assert leaves > board_index.FILES
    assert len(stored.inputFiles()) <= board_index.FILES + 3  # games
    assert index.tops([1, 2, 3]).count() == leaves  # the directory knows every leaf
    assert files_read(index.ranks(1, 1, index.together)) == 1
    assert files_read(index.ranks(1, index.together, index.together + 1)) == 2
    for wanted in ([(1, 4)], [(1, 3), (2, 4), (1, 5)], [(4, 0)], []):
        got = index.leaves(wanted).select("game_id", "leaf", "rank").collect()
        assert sorted(map(tuple, got)) == sorted((g, n, n + 1) for g, n in wanted if g != 4)
    since = standings.best_standings(late, games)
    for user in (1, 8, 30):
        got = board_index.changed_rank(spark, path, since, games, user)
        assert rows(got) == rows(ranking.user_rank(scores, games, user).select(*got.columns))


def test_no_index(spark):
    with pytest.raises(FileNotFoundError):
        board_index.Index(spark, scratch(spark, "none"))


def test_readers_see_whole_versions(spark):
    path = scratch(spark, "versions")

    def numbers(n):
        return lambda folder: spark.range(n).write.parquet(folder)

    assert versions.current_version(spark, path) is None
    versions.publish_version(spark, path, numbers(3))
    held = spark.read.parquet(versions.current_version(spark, path))

    def failing(folder):
        numbers(5)(folder)
        broken = spark.range(100).select(F.when(F.col("id") < 90, F.col("id")).otherwise(F.raise_error(F.lit("lost"))))
        broken.write.mode("append").parquet(folder)

    with pytest.raises(Exception, match="lost"):
        versions.publish_version(spark, path, failing)
    assert spark.read.parquet(versions.current_version(spark, path)).count() == 3

    def while_writing(folder):
        numbers(4)(folder)
        assert spark.read.parquet(versions.current_version(spark, path)).count() == 3

    versions.publish_version(spark, path, while_writing)
    assert spark.read.parquet(versions.current_version(spark, path)).count() == 4
    assert held.count() == 3  # pinned to what it found
    versions.clear_versions(spark, path, keep=1)
    assert spark.read.parquet(versions.current_version(spark, path)).count() == 4
    assert versions.existing(spark, [f"{path}/v=1", f"{path}/v=2", f"{path}/v=3"]) == [f"{path}/v=3"]
