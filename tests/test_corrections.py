"""Boards under edits and deletes, against a recompute."""

import random
from decimal import Decimal

import pytest

from podium.operators import standings
from podium.streaming import corrections, eras
from tests.conftest import at, rows


def image(row):
    """(id, user, game, score, day) as a row of scores."""
    return row and (row[0], row[1], row[2], Decimal(row[3]), at(f"2024-01-{row[4]:02d} 00:00:00"))


def changes(spark, *pairs):
    return spark.createDataFrame([(image(b), image(a)) for b, a in pairs], corrections.CHANGES)


@pytest.mark.parametrize("kind", ["best", "latest"])
@pytest.mark.parametrize("depth", [1, 3])
def test_random_edits(make, spark, tmp_path, kind, depth):
    rand, path = random.Random(depth), str(tmp_path / "board")
    games = make.games((1, "a", "highest"), (2, "b", "lowest"))
    store = corrections.correct_batch(path, games, kind, depth, every=3)
    now, fresh, read = {}, 0, 0

    def some(i):
        return i, rand.randrange(4), rand.choice([1, 1, 2]), rand.randrange(30), rand.randrange(1, 28)

    for batch_id in range(8):
        batch = []
        for _ in range(40 if batch_id < 2 else 12):
            what = rand.random() if now else 0
            old = rand.choice(sorted(now.values())) if now else None
            if what < 0.4:
                fresh += 1
                batch.append((None, some(fresh)))
                now[fresh] = batch[-1][1]
            elif what < 0.7:  # another score, user or game
                batch.append((old, some(old[0])))
                now[old[0]] = batch[-1][1]
            else:
                batch.append((old, None))
                del now[old[0]]
        if batch_id == 6:  # the best of a user all go
            for row in sorted(now.values())[:30]:
                batch.append((row, None))
                del now[row[0]]
        if batch_id == 5:
            store(changes(spark, *batch).limit(0), batch_id)
        for _ in range(1 + (batch_id in (3, 4))):
            store(changes(spark, *batch), batch_id)
        scores = make.scores(*((i, u, g, s, f"2024-01-{d:02d} 00:00:00") for i, u, g, s, d in now.values()))
        want = standings.best_standings(scores, games) if kind == "best" else standings.latest_standings(scores)
        got = corrections.corrected_board(spark, path, games, scores, kind)
        assert rows(got) == rows(want, "game_id", "user_id", "score")
    assert eras.current_era(spark, path) == 2


def test_only_dry_users_are_read_again(make, spark, tmp_path):
    path, games = str(tmp_path / "board"), make.games((1, "a", "highest"))
    every = [(i, i % 3, 1, i, 1) for i in range(60)]
    store = corrections.correct_batch(path, games, depth=4)
    store(changes(spark, *((None, r) for r in every)), 0)
    store(changes(spark, *((r, None) for r in every if r[1] == 0 and r[0] > 20)), 1)
    left = [r for r in every if not (r[1] == 0 and r[0] > 20)]
    # Of users that are not dry the given scores do not matter.
    given = make.scores(*((i, u, g, s if u == 0 else 999, "2024-01-01 00:00:00") for i, u, g, s, _ in left))
    got = corrections.corrected_board(spark, path, games, given)
    assert [(u, int(s)) for _, u, s in rows(got)] == [(0, 18), (1, 58), (2, 59)]


def test_a_hot_user_files_few_rows(make, spark, tmp_path):
    path, games = str(tmp_path / "board"), make.games((1, "a", "lowest"))
    store = corrections.correct_batch(path, games, depth=4)
    store(changes(spark, *((None, (i, 1, 1, i, 1)) for i in range(500))), 0)
    filed = spark.read.schema(corrections.FILED).parquet(f"{path}/era=0")
    assert filed.count() == 4 + 1
    assert rows(corrections.corrected_board(spark, path, games, make.scores()), "score") == [(Decimal("0.00"),)]


def test_nothing_filed(make, spark, tmp_path):
    games = make.games((1, "a", "lowest"))
    assert corrections.corrected_board(spark, str(tmp_path / "none"), games, make.scores()).collect() == []
