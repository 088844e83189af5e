from decimal import Decimal as D

import pytest

from podium.operators import ranking, standings
from podium.operators.filters import UnknownGame, of_game
from tests.conftest import rows

T1, T2, T3 = "2024-01-01 10:00:00", "2024-01-02 10:00:00", "2024-01-03 10:00:00"


@pytest.fixture(scope="module")
def small(make):
    games = make.games((1, "high", "highest"), (2, "low", "lowest"), (3, "idle", "time"))
    users = make.users((9, "nine"), (10, "ten"), (11, ""), (12, "twelve"))
    scores = make.scores(
        (1, 9, 1, 50, T1),
        (2, 10, 1, 50, T1),
        (3, 11, 1, 80, T1),
        (4, 11, 1, 20, T2),  # worse and later
        (5, 99999, 1, 70, T1),  # no user row
        (6, 9, 2, 5, T1),
        (7, 10, 2, 3, T1),
        (8, 10, 2, 9, T1),  # same instant, higher id: the latest
        (9, 12, 1, 10, T3),
    )
    return scores, games, users


def test_best_board_orders_ties_by_text_and_leaves_gaps(small):
    board = ranking.game_board(*small, game_id=1)
    assert rows(board, "rank", "user_id", "name", "score") == [
        (1, 11, "u11@example.com", D("80.00")),
        (3, 10, "ten", D("50.00")),
        (4, 9, "nine", D("50.00")),
        (5, 12, "twelve", D("10.00")),
    ]


def test_lowest_board(small):
    board = ranking.game_board(*small, game_id=2)
    assert rows(board, "rank", "user_id", "score") == [(1, 10, D("3.00")), (2, 9, D("5.00"))]


def test_latest_differs_from_best(small):
    scores, games, users = small
    board = ranking.game_board(scores, games, users, kind="latest")
    got = {(r.game_id, r.user_id): r.score for r in board.collect()}
    assert got[1, 11] == D("20.00")
    assert got[2, 10] == D("9.00")


def test_as_stored_is_the_reverse(small):
    scores, games, users = small
    best = ranking.game_board(scores, games, users, kind="latest").collect()
    stored = ranking.game_board(scores, games, users, kind="latest", as_stored=True).collect()
    size = {1: 5, 2: 2}
    for r in best:
        mirror = [s for s in stored if (s.game_id, s.user_id) == (r.game_id, r.user_id)]
        assert mirror[0].rank == size[r.game_id] + 1 - r.rank


def test_deep_pages_use_the_full_rank_and_agree(small, monkeypatch):
    scores, games, users = small
    page = rows(ranking.game_board(scores, games, users, 1, 4))
    everyone = rows(ranking.global_board(scores, users, 0, 9))
    monkeypatch.setattr(ranking, "TOP_BOUND", 1)
    assert rows(ranking.game_board(scores, games, users, 1, 4, bound=2)) == page
    assert rows(ranking.global_board(scores, users, 0, 9, bound=2)) == everyone


def test_global_boards(small):
    scores, games, users = small
    got = rows(ranking.global_board(scores, users), "rank", "user_id", "total_score")
    # Last scores: 99999 -> 70, 11 -> 20, 12 -> 10, 10 -> 9, 9 -> 5.
    assert got == [
        (2, 11, D("20.00")),
        (3, 12, D("10.00")),
        (4, 10, D("9.00")),
        (5, 9, D("5.00")),
    ]
    total = rows(ranking.global_total_board(scores, games, users), "rank", "user_id", "total_score")
    assert total[0] == (1, 11, D("80.00"))
    assert (4, 9, D("50.00")) in total


def test_rank_of_one_user_equals_the_board(small):
    scores, games, users = small
    board = {(r.game_id, r.user_id): r.rank for r in ranking.game_board(*small).collect()}
    for user in (9, 10, 11, 12):
        for r in ranking.user_rank(scores, games, user).collect():
            assert board[r.game_id, user] == r.user_rank
            assert r.total_players == {1: 5, 2: 2}[r.game_id]
    assert ranking.user_rank(scores, games, 4711).count() == 0
    assert ranking.user_rank(scores, games, 12, game_id=2).count() == 0


def test_global_rank(small):
    scores, _, _ = small
    got = ranking.user_global_rank(scores, 12).first()
    assert (got.user_rank, got.total_score, got.total_players) == (3, D("10.00"), 5)
    assert ranking.user_global_rank(scores, 4711).count() == 0


def test_neighbours(small):
    scores, games, users = small
    near = ranking.surrounding_players(scores, games, users, 10, game_id=1, reach=1)
    # Rank 2 is the member without a user row.
    assert rows(near, "rank", "user_id") == [(3, 10), (4, 9)]
    wanted = scores.filter("user_id = 10 and game_id = 1")
    many = ranking.neighbours_of(scores, games, wanted, reach=1, bound=2)
    assert rows(many, "rank", "user_id") == [(2, 99999), (3, 10), (4, 9)]


def test_full_rank_in_pieces_equals_top_k(make, spark):
    games = make.games((1, "g", "highest"), (2, "h", "time"))
    board = spark.range(400).selectExpr(
        "if(id < 300, 1L, 2L) as game_id", "id as user_id",
        "cast(id % 7 as decimal(12,2)) as score",
    )
    whole = rows(ranking.ranked_standings(board, games))
    assert rows(ranking.ranked_standings(board, games, bound=20)) == whole
    reverse = rows(ranking.ranked_standings(board, games, as_stored=True))
    assert rows(ranking.ranked_standings(board, games, as_stored=True, bound=20)) == reverse


def test_pages(small):
    scores, games, users = small
    page = ranking.board_page(scores, games, users, 1, page=1, page_size=2).collect()
    assert [r.rank for r in page] == [1]  # rank 2 has no user row
    assert page[0].has_next and page[0].page_size == 2
    last = ranking.board_page(scores, games, users, 1, page=2, page_size=3).collect()
    assert sorted(r.rank for r in last) == [4, 5] and not last[0].has_next
    everything = ranking.global_page(scores, users, page=1, page_size=500).collect()
    assert everything[0].page_size == 100 and not everything[0].has_next
    with pytest.raises(ValueError):
        ranking.page_bounds(0)
    assert ranking.page_bounds(3, 10) == (20, 29)


def test_sizes_and_filters(small):
    scores, games, _ = small
    assert rows(standings.board_sizes(scores)) == [(1, 5), (2, 2)]
    with pytest.raises(UnknownGame):
        of_game(scores, 77, games)
    assert of_game(scores, 2, games).count() == 3


def test_rebuild_and_clear(small, spark, tmp_path):
    scores, games, _ = small
    path = str(tmp_path / "boards")
    standings.store_standings(standings.latest_standings(scores), path)
    # Only game 2 is rebuilt; game 1 keeps its latest scores.
    standings.rebuild(scores, games, scores.filter("game_id = 2"), path)
    stored = standings.stored_standings(spark, path)
    assert rows(stored, "game_id", "user_id", "score") == [
        (1, 10, D("50.00")),
        (1, 11, D("20.00")),
        (1, 12, D("10.00")),
        (1, 9, D("50.00")),
        (1, 99999, D("70.00")),
        (2, 10, D("3.00")),
        (2, 9, D("5.00")),
    ]
    standings.clear_board(spark, path, 1)
    assert rows(standings.stored_standings(spark, path), "game_id", "user_id") == [(2, 10), (2, 9)]
    standings.clear_board(spark, path)
    assert standings.stored_standings(spark, path).count() == 0
