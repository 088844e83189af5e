"""Boards, ranks, neighbours and pages.

Ranks are unique positions. Equal scores are ordered by user id as text. Ranks are given before
users are joined, so a member without a user row leaves a gap and still counts in the board size.
"""

from pyspark.sql import Window
from pyspark.sql import functions as F

from podium.functions.ranks import value_ranks
from podium.functions.sequences import numbered
from podium.functions.sizes import per_game, touched_games
from podium.functions.values import display_name, member, sort_key
from podium.session import pinned
from podium.operators.standings import BEST, global_latest, global_total, standings

MAX_PAGE = 100
TOP_BOUND = 1_000  # up to this rank a board is a top-k; beyond it a full distributed rank


def page_bounds(page=1, page_size=20):
    """(first, last) position of a page, 0-based and inclusive; at most 100 rows a page."""
    if page < 1:
        raise ValueError("page must be at least 1")
    size = max(1, min(page_size, MAX_PAGE))
    return (page - 1) * size, page * size - 1


def _check_range(start, end):
    if start < 0 or end < start:
        raise ValueError("need 0 <= start <= end")


def _named(ranked, users, value):
    """Attach user names; members without a user row drop out."""
    people = users.select("user_id", "email", "name")
    return ranked.join(people, "user_id").select(
        *[c for c in ("game_id",) if c in ranked.columns],
        "rank",
        "user_id",
        F.col("email").alias("username"),
        display_name().alias("name"),
        value,
    )


def _keyed(board, games, as_stored):
    """Standings with the two ordering columns of a board."""
    key = sort_key()
    typed = board
    if "score_type" not in board.columns:
        typed = board.join(games.select("game_id", "score_type"), "game_id")
    return typed.select(
        "game_id",
        "user_id",
        "score",
        (-key if as_stored else key).alias("_key"),
        member().alias("_member"),
    )


def _order(as_stored):
    return [F.col("_key"), F.col("_member").desc() if as_stored else F.col("_member")]


def _positions(keyed, group, order, first, last, bound=None):
    """Rows whose rank within the group lies in first..last (1-based)."""
    if last is not None and last <= TOP_BOUND:
        # Spark keeps only the first `last` rows of a group before the shuffle.
        w = Window.partitionBy(*group).orderBy(*order)
        ranked = keyed.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= last)
    else:
        ranked = numbered(keyed, group, order, "rank", bound)
        if last is not None:
            ranked = ranked.filter(F.col("rank") <= last)
    if first > 1:
        ranked = ranked.filter(F.col("rank") >= first)
    return ranked.withColumn("rank", F.col("rank").cast("bigint"))


def ranked_standings(board, games, as_stored=False, bound=None):
    """Every member of every board with its rank, for boards of any size.

    The ordered rows are written to the shared folder first: they are read several times, and
    making them anew would group all scores each time.
    """
    keyed = pinned(_keyed(board, games, as_stored))
    ranked = numbered(keyed, ["game_id"], _order(as_stored), "rank", bound)
    return ranked.drop("_key", "_member")


def of_one_game(rows, game_id):
    """The rows of a game, or all; on stored standings only that game's folder is read."""
    return rows if game_id is None else rows.filter(F.col("game_id") == game_id)


def game_board(
    scores, games, users, start=0, end=99, kind=BEST, as_stored=False, game_id=None, bound=None
):
    """Positions start..end (0-based, inclusive) of one board, or of every game's board.

    ``as_stored`` gives the reversed order the live boards are read in (worst first).
    """
    board = standings(of_one_game(scores, game_id), games, kind)
    return standing_board(board, games, users, start, end, as_stored, game_id, bound)


def standing_board(
    board, games, users, start=0, end=99, as_stored=False, game_id=None, bound=None
):
    """As :func:`game_board`, of standings that are at hand: game_id, user_id, score."""
    _check_range(start, end)
    keyed = _keyed(of_one_game(board, game_id), games, as_stored)
    ranked = _positions(keyed, ["game_id"], _order(as_stored), start + 1, end + 1, bound)
    # A page is small beside the users, who then need no shuffle to get their names attached.
    if game_id is not None and end < TOP_BOUND:
        ranked = F.broadcast(ranked)  # at most end + 1 rows
    elif end < TOP_BOUND:
        ranked = per_game(ranked, games, end - start + 1)
    return _named(ranked, users, "score")


def _global_keyed(board):
    key = -(F.col("total_score") * 100).cast("bigint")
    return board.select(
        F.lit(0).alias("board"),
        "user_id",
        "total_score",
        key.alias("_key"),
        member().alias("_member"),
    )


def _global_positions(keyed, first, last, bound=None):
    """Rows of the global board whose rank lies in first..last."""
    if last > TOP_BOUND:
        return _positions(keyed, ["board"], _order(False), first, last, bound)
    # A top-k without a partition key: sorted per task, then merged.
    top = keyed.orderBy("_key", "_member").limit(last)
    w = Window.partitionBy("board").orderBy("_key", "_member")
    ranked = top.withColumn("rank", F.row_number().over(w).cast("bigint"))
    return ranked.filter(F.col("rank") >= first)


def _global_page(board, users, start, end, bound=None):
    _check_range(start, end)
    ranked = _global_positions(_global_keyed(board), start + 1, end + 1, bound)
    if end < TOP_BOUND:
        ranked = F.broadcast(ranked)  # at most end + 1 rows
    return _named(ranked, users, "total_score")


def global_board(scores, users, start=0, end=99, bound=None):
    """Users by their last raw score in any game, highest first."""
    return _global_page(global_latest(scores), users, start, end, bound)


def standing_global_board(totals, users, start=0, end=99, bound=None):
    """As :func:`global_board`, of one row per user that is at hand: user_id, total_score."""
    return _global_page(totals, users, start, end, bound)


def global_total_board(scores, games, users, start=0, end=99, bound=None):
    """Users by the sum of their best scores over games where high scores win."""
    return _global_page(global_total(scores, games), users, start, end, bound)


def board_page(scores, games, users, game_id, page=1, page_size=20, kind=BEST):
    """One page of a game's board with paging columns; has_next looks one position ahead.

    A page without players is one row with the paging columns and nulls beside them.
    """
    board = standings(of_one_game(scores, game_id), games, kind)
    return standing_page(board, games, users, game_id, page, page_size)


def standing_page(board, games, users, game_id, page=1, page_size=20, bound=None):
    """As :func:`board_page`, of standings that are at hand."""
    start, end = page_bounds(page, page_size)
    keyed = _keyed(of_one_game(board, game_id), games, False)
    ahead = _positions(keyed, ["game_id"], _order(False), start + 1, end + 2, bound)
    return _paged(ahead, users, "score", page, start, end)


def global_page(scores, users, page=1, page_size=20, bound=None):
    """One page of the global board with paging columns; empty pages as in :func:`board_page`."""
    start, end = page_bounds(page, page_size)
    ahead = _global_positions(_global_keyed(global_latest(scores)), start + 1, end + 2, bound)
    return _paged(ahead, users, "total_score", page, start, end)


def _paged(ahead, users, value, page, start, end):
    """Rows start+1..end+2 of a board (at most 101) become a page plus the look-ahead flag.

    Gathered into one row first, so an empty page still has its paging columns.
    """
    people = users.select("user_id", "email", "name")
    named = F.broadcast(ahead).join(people, "user_id").select(
        "rank", "user_id", F.col("email").alias("username"), display_name().alias("name"), value
    )
    of = ["rank", "user_id", "username", "name", value]
    looked = ahead.agg(F.coalesce(F.max("rank") > end + 1, F.lit(False)).alias("has_next"))
    shown = named.filter(F.col("rank") <= end + 1).agg(F.collect_list(F.struct(*of)).alias("rows"))
    both = looked.withColumn("_page", F.lit(page)).join(
        shown.withColumn("_page", F.lit(page)), "_page"
    )
    return both.select("has_next", F.explode_outer("rows").alias("row")).select(
        "row.*",
        F.lit(page).cast("bigint").alias("page"),
        F.lit(end - start + 1).cast("bigint").alias("page_size"),
        "has_next",
    )


def _better(key, who, own_key, own_member):
    """True where (key, who) comes before the target's position."""
    return (F.col(key) < F.col(own_key)) | (
        (F.col(key) == F.col(own_key)) & (F.col(who) < F.col(own_member))
    )


def _targets(board, games, user_id):
    """The user's own position keys, at most one row per game; reads only the user's rows."""
    mine = board.filter(F.col("user_id") == user_id)
    own = _keyed(mine, games, False).select(
        "game_id",
        F.col("_key").alias("_own_key"),
        F.col("_member").alias("_own_member"),
        F.col("score").alias("user_score"),
    )
    return per_game(own, games)


def user_rank(scores, games, user_id, game_id=None, kind=BEST):
    """Rank, score and board size of one user in each game played; no row where unranked.

    Counts the better members in one aggregate, so no board is sorted.
    """
    board = standings(of_one_game(scores, game_id), games, kind)
    return standing_rank(board, games, user_id, game_id)


def standing_rank(board, games, user_id, game_id=None):
    """As :func:`user_rank`, of standings that are at hand."""
    board = of_one_game(board, game_id)
    keyed = _keyed(board, games, False)
    own = _targets(board, games, user_id)
    against = keyed.join(own, "game_id")
    return against.groupBy("game_id").agg(
        (F.count_if(_better("_key", "_member", "_own_key", "_own_member")) + 1).alias("user_rank"),
        F.max("user_score").alias("user_score"),
        F.count(F.lit(1)).alias("total_players"),
    )


def user_global_rank(scores, user_id):
    """Rank, last raw score and board size of one user on the global board."""
    return standing_global_rank(global_latest(scores), user_id)


def standing_global_rank(totals, user_id):
    """As :func:`user_global_rank`, of one row per user that is at hand."""
    keyed = _global_keyed(totals)
    mine = _global_keyed(totals.filter(F.col("user_id") == user_id))
    own = mine.select(F.struct("_key", "_member", "total_score")).scalar()
    against = keyed.select("_key", "_member", own.alias("_own"))
    ranked = against.agg(
        (F.count_if(_better("_key", "_member", "_own._key", "_own._member")) + 1).alias("user_rank"),
        F.max("_own.total_score").alias("total_score"),
        F.count(F.lit(1)).alias("total_players"),
    )
    return ranked.filter(F.col("total_score").isNotNull())


def surrounding_players(scores, games, users, user_id, game_id=None, reach=5, kind=BEST):
    """The user's row and up to ``reach`` neighbours on either side, in each game played.

    The neighbours are the nearest better and the nearest worse members: a top-k per game and side
    instead of a sorted board.
    """
    board = standings(of_one_game(scores, game_id), games, kind)
    return standing_neighbours(board, games, users, user_id, game_id, reach)


def standing_neighbours(board, games, users, user_id, game_id=None, reach=5):
    """As :func:`surrounding_players`, of standings that are at hand."""
    board = of_one_game(board, game_id)
    keyed = _keyed(board, games, False)
    own = _targets(board, games, user_id)
    placed = keyed.join(own, "game_id").withColumn(
        "_above", _better("_key", "_member", "_own_key", "_own_member")
    )
    # Nearest first on both sides: better members from the worst up, the others from the best down.
    above = F.col("_above")
    nearest = Window.partitionBy("game_id", "_above").orderBy(
        F.when(above, -F.col("_key")).otherwise(F.col("_key")),
        F.when(above, F.col("_member")).desc(),
        F.when(~above, F.col("_member")).asc(),
    )
    near = F.col("_near")
    around = (
        placed.withColumn("_near", F.row_number().over(nearest))
        .filter(near <= reach + 1)
        .filter(~above | (near <= reach))
        .withColumn("_offset", F.when(above, -near).otherwise(near - 1))
    )
    ranks = placed.groupBy("game_id").agg((F.count_if("_above") + 1).alias("_own_rank"))
    around = around.join(per_game(ranks, games), "game_id")
    ranked = around.withColumn("rank", (F.col("_own_rank") + F.col("_offset")).cast("bigint"))
    return _named(per_game(ranked, games, 2 * reach + 1), users, "score")


def ranks_of(scores, games, wanted=None, kind=BEST, bound=None):
    """Rank, score and board size of many (game_id, user_id) rows at once; of all by default."""
    if wanted is not None:
        scores = scores.join(touched_games(wanted, games), "game_id", "left_semi")
    return standing_ranks(standings(scores, games, kind), games, wanted, bound)


def standing_ranks(board, games, wanted=None, bound=None):
    """As :func:`ranks_of`, of standings that are at hand."""
    if wanted is not None:
        board = board.join(touched_games(wanted, games), "game_id", "left_semi")
    ranked = ranked_standings(board, games, bound=bound)
    sizes = ranked.groupBy("game_id").agg(F.count(F.lit(1)).alias("total_players"))
    if wanted is not None:
        pairs = wanted.select("game_id", "user_id").distinct()
        ranked = ranked.join(pairs, ["game_id", "user_id"])
    return (
        ranked.join(per_game(sizes, games), "game_id")
        .select(
            "game_id",
            "user_id",
            F.col("rank").alias("user_rank"),
            F.col("score").alias("user_score"),
            "total_players",
        )
    )


def counted_ranks(board, games, wanted, bound=None):
    """As :func:`standing_ranks`, for few members of large boards: no board is sorted.

    Members are counted per score; only those who tie with a wanted member are put in order.
    """
    keyed = pinned(_keyed(board, games, False))
    values = value_ranks(keyed, ["game_id"], "_key", "_first")
    sizes = values.groupBy("game_id").agg(F.sum("n").alias("total_players"))
    pairs = wanted.select("game_id", "user_id").distinct()
    mine = keyed.join(pairs, ["game_id", "user_id"]).join(values, ["game_id", "_key"])
    tied = mine.filter("n > 1").select("game_id", "_key").distinct()
    level = keyed.select("game_id", "_key", "user_id", "_member").join(
        tied, ["game_id", "_key"], "left_semi"
    )
    places = numbered(level, ["game_id", "_key"], ["_member"], "_place", bound).select(
        "game_id", "user_id", "_place"
    )
    place = F.coalesce(F.col("_place"), F.lit(1))
    return (
        mine.join(places, ["game_id", "user_id"], "left")
        .join(per_game(sizes, games), "game_id")
        .select(
            "game_id",
            "user_id",
            (F.col("_first") + place - 1).alias("user_rank"),
            F.col("score").alias("user_score"),
            "total_players",
        )
    )


def neighbours_of(scores, games, wanted, reach=5, kind=BEST, bound=None):
    """Neighbours of many (game_id, user_id) rows at once, as one row per neighbour.

    The wanted ranks are spread to rank-reach..rank+reach, so the board is met by equality.
    """
    chosen = scores.join(touched_games(wanted, games), "game_id", "left_semi")
    board = standings(chosen, games, kind)
    ranked = ranked_standings(board, games, bound=bound).select(
        "game_id", "rank", "user_id", "score"
    )
    centres = ranked.join(
        wanted.select("game_id", "user_id").distinct(), ["game_id", "user_id"]
    ).select(
        "game_id",
        F.col("user_id").alias("of_user_id"),
        F.explode(F.sequence(F.greatest(F.col("rank") - reach, F.lit(1)), F.col("rank") + reach))
        .alias("rank"),
    )
    return centres.join(ranked, ["game_id", "rank"])
