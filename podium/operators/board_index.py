"""Boards stored by rank: a page, a rank or a player's surroundings open a few files of any board.

An index holds three tables. ``rows`` has every member with the rank, cut into leaves of equal numbers of
ranks, so a page lies in one leaf or two. A leaf has a folder and a file; where small leaves are many,
some that follow each other share one, named by the first of them, so files do not grow with the leaves.
``tops`` is the directory: the first rank and position of every leaf, one file per game. ``members`` has
the same rows dealt by user into buckets, sorted by user, so one user's standings lie in one bucket.

What changed since an index was made need not be in it: ``changed`` standings are counted in place of the
ones the index has for the same users.
"""

from pyspark.sql import functions as F
from pyspark.sql import types as T

from podium.functions.sequences import numbered
from podium.functions.sizes import counted_broadcast
from podium.operators.ranking import _better, _keyed, _named, _order, _paged, page_bounds
from podium.schemas import SCORE
from podium.session import pinned
from podium.sources.versions import current_version, existing, publish_version

LEAF = 50_000  # ranks in a leaf
FILES = 64  # leaves beyond this number share files of at most LEAF ranks
BUCKET = 500_000  # rows of a bucket of members, about
MOST_BUCKETS = 50_000

_POSITION = [
    T.StructField("user_id", T.LongType()),
    T.StructField("score", SCORE),
    T.StructField("_key", T.LongType()),
    T.StructField("_member", T.StringType()),
    T.StructField("rank", T.LongType()),
]
ROWS = T.StructType([*_POSITION, T.StructField("game_id", T.LongType()), T.StructField("leaf", T.LongType())])
MEMBERS = T.StructType([*_POSITION, T.StructField("game_id", T.LongType())])
TOPS = T.StructType(
    [
        T.StructField("leaf", T.LongType()),
        T.StructField("first_rank", T.LongType()),
        T.StructField("_key", T.LongType()),
        T.StructField("_member", T.StringType()),
        T.StructField("total_players", T.LongType()),
        T.StructField("game_id", T.LongType()),
    ]
)
SIZES = "leaf_rows long, buckets long, together long"


def _bucket(buckets):
    return F.pmod(F.xxhash64("user_id"), F.lit(buckets))


def _leaf(leaf_rows):
    """The number of the leaf a rank lies in."""
    return F.floor((F.col("rank") - 1) / leaf_rows)


def _together(keyed, leaf):
    """How many leaves share a file: one, unless they are small and many."""
    sizes = keyed.groupBy("game_id").agg(F.count(F.lit(1)).alias("n"))
    leaves = sizes.agg(F.sum(F.ceil(F.col("n") / leaf))).first()[0] or 0
    return max(1, min(-(-leaves // FILES), LEAF // leaf))


def store_index(board, games, path, leaf=LEAF, bound=None):
    """Index the standings ``board`` (game_id, user_id, score) as a new version under ``path``."""
    spark = board.sparkSession

    def write(folder):
        keyed = pinned(_keyed(board, games, False))
        ranked = numbered(keyed, ["game_id"], _order(False), "rank", bound)
        together = _together(keyed, leaf)
        ranked = ranked.withColumn("leaf", _leaf(leaf * together) * together)  # the first of its file
        # The leaves of a file are written by one task, so it is one file, sorted by rank.
        dealt = ranked.repartition("game_id", "leaf").sortWithinPartitions("game_id", "leaf", "rank")
        dealt.select(*ROWS.names).write.partitionBy("game_id", "leaf").parquet(f"{folder}/rows")
        rows = spark.read.schema(ROWS).parquet(f"{folder}/rows")
        buckets = min(MOST_BUCKETS, max(1, -(-rows.count() // BUCKET)))
        by_user = rows.withColumn("bucket", _bucket(buckets)).repartition("bucket")
        by_user = by_user.sortWithinPartitions("bucket", "user_id").select(*MEMBERS.names, "bucket")
        by_user.write.partitionBy("bucket").parquet(f"{folder}/members")
        tops = rows.withColumn("leaf", _leaf(leaf)).groupBy("game_id", "leaf").agg(
            F.min("rank").alias("first_rank"),
            F.min(F.struct("rank", "_key", "_member")).alias("first"),
            F.max("rank").alias("last"),
        )
        totals = tops.groupBy("game_id").agg(F.max("last").alias("total_players"))
        tops = tops.join(counted_broadcast(totals), "game_id").select(
            "leaf", "first_rank", "first._key", "first._member", "total_players", "game_id"
        )
        tops = tops.repartition("game_id").sortWithinPartitions("game_id", "first_rank")
        tops.write.partitionBy("game_id").parquet(f"{folder}/tops")
        # Written last: with it the version is whole.
        numbers = {"leaf_rows": leaf, "buckets": buckets, "together": together}
        sizes = spark.range(1).select(*(F.lit(n).cast("long").alias(name) for name, n in numbers.items()))
        sizes.write.parquet(f"{folder}/sizes")

    return publish_version(spark, path, write)


class Index:
    """The current version of a stored index, held for as long as it is used."""

    def __init__(self, spark, path):
        self.spark = spark
        self.folder = current_version(spark, path)
        if self.folder is None:
            raise FileNotFoundError(f"no index at {path}")
        sizes = spark.read.schema(SIZES).parquet(f"{self.folder}/sizes").first()
        self.leaf_rows, self.buckets = sizes["leaf_rows"], sizes["buckets"]
        self.together = sizes["together"] or 1  # an older index has a file for every leaf

    def _read(self, schema, table, folders):
        """Rows of the named folders of a table, without listing the others."""
        base = f"{self.folder}/{table}"
        found = existing(self.spark, [f"{base}/{f}" for f in folders])
        if not found:
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).option("basePath", base).parquet(*found)

    def ranks(self, game_id, first, last):
        """The rows of ranks first..last (from 1) of a game: of the leaves that hold them."""
        size = self.leaf_rows * self.together
        files = range(max(0, first - 1) // size, (last - 1) // size + 1)
        rows = self._files([(game_id, n * self.together) for n in files])
        return rows.filter(F.col("rank").between(first, last))

    def leaves(self, wanted):
        """The rows of leaves: pairs of game_id and number."""
        files = {(g, n - n % self.together) for g, n in wanted}
        rows = self._files(sorted(files))
        if self.together == 1:
            return rows
        some = F.broadcast(self.spark.createDataFrame(wanted, "game_id long, leaf long"))  # as many as asked for
        return rows.join(some, ["game_id", "leaf"], "left_semi").select(*ROWS.names)

    def _files(self, wanted):
        """The rows of files: pairs of game_id and the number of their first leaf."""
        rows = self._read(ROWS, "rows", [f"game_id={g}/leaf={n}" for g, n in wanted])
        return rows.withColumn("leaf", _leaf(self.leaf_rows))

    def tops(self, games):
        """The directories of some games."""
        return self._read(TOPS, "tops", [f"game_id={g}" for g in games])

    def of_user(self, user_id):
        """The standings of a user: a part of one bucket."""
        one = self.spark.range(1).select(F.lit(user_id).cast("long").alias("user_id"))
        bucket = one.select(_bucket(self.buckets)).first()[0]
        rows = self._read(MEMBERS, "members", [f"bucket={bucket}"])
        return rows.filter(F.col("user_id") == user_id)

    def of_users(self, pairs):
        """The standings of (game_id, user_id) pairs: of the buckets that have any of them."""
        some = pairs.select("game_id", "user_id").distinct().withColumn("bucket", _bucket(self.buckets))
        hit = [r[0] for r in some.select("bucket").distinct().collect()]  # at most MOST_BUCKETS
        rows = self._read(MEMBERS, "members", [f"bucket={b}" for b in sorted(hit)])
        return rows.join(counted_broadcast(some.drop("bucket")), ["game_id", "user_id"], "left_semi")


def indexed_page(spark, path, users, game_id, page=1, page_size=20):
    """As :func:`ranking.board_page`, of a stored index: opens one leaf, or two."""
    start, end = page_bounds(page, page_size)
    ahead = Index(spark, path).ranks(game_id, start + 1, end + 2)
    return _paged(ahead, users, "score", page, start, end)


def indexed_rank(spark, path, user_id, game_id=None):
    """As :func:`ranking.user_rank`, of a stored index: opens a bucket and the games' directories."""
    index = Index(spark, path)
    mine = index.of_user(user_id)
    if game_id is not None:
        mine = mine.filter(F.col("game_id") == game_id)
    played = [r["game_id"] for r in mine.select("game_id").collect()]  # a game is a folder
    totals = index.tops(played).groupBy("game_id").agg(F.max("total_players").alias("total_players"))
    return totals.join(F.broadcast(mine), "game_id").select(  # at most a row per game
        "game_id", F.col("rank").alias("user_rank"), F.col("score").alias("user_score"), "total_players"
    )


def indexed_neighbours(spark, path, users, user_id, game_id, reach=5):
    """As :func:`ranking.surrounding_players` in one game, of a stored index: a bucket and two leaves."""
    index = Index(spark, path)
    mine = index.of_user(user_id).filter(F.col("game_id") == game_id).first()
    rank = mine["rank"] if mine else None
    rows = index.ranks(game_id, rank - reach, rank + reach) if rank else index.ranks(game_id, 1, 0).limit(0)
    return _named(F.broadcast(rows), users, "score")  # at most 2 * reach + 1 rows


def _before(index, own):
    """How many members come before each position of ``own`` (game_id, _own_key, _own_member): _before.

    There is at most one position a game. It reads the leaf it falls in; the leaves before are known
    from the directory.
    """
    games = [r[0] for r in own.select("game_id").collect()]  # a game is a folder
    tops = index.tops(games).join(F.broadcast(own), "game_id")
    begun = ~_better("_own_key", "_own_member", "_key", "_member")
    at = tops.filter(begun).groupBy("game_id").agg(
        F.max("leaf").alias("leaf"), (F.max("first_rank") - 1).alias("_first")
    )
    found = at.collect()
    rows = index.leaves([(r["game_id"], r["leaf"]) for r in found]).join(F.broadcast(own), "game_id")
    inside = rows.groupBy("game_id").agg(
        F.count_if(_better("_key", "_member", "_own_key", "_own_member")).alias("_n")
    )
    counts = own.select("game_id").join(at, "game_id", "left").join(inside, "game_id", "left")
    before = F.coalesce("_first", F.lit(0)) + F.coalesce("_n", F.lit(0))
    return counts.select("game_id", before.alias("_before"))


def changed_rank(spark, path, changed, games, user_id, game_id=None, best=True):
    """As :func:`ranking.user_rank`, of an index that is behind.

    ``changed`` are the standings (game_id, user_id, score) since then. The better of the two counts,
    or with ``best=False`` the changed one. No board is read: members are counted by the directory, one
    leaf a game, ``changed``, and the buckets of its users.
    """
    index = Index(spark, path)
    at = ["game_id", "user_id"]
    if game_id is not None:
        changed = changed.filter(F.col("game_id") == game_id)
    new = _keyed(changed.select(*at, "score"), games, False)
    old = index.of_users(changed)
    both = new.join(
        old.select(*at, F.col("_key").alias("_old"), F.col("score").alias("_old_score")), at, "left"
    )
    stays = F.lit(best) & F.col("_old").isNotNull() & (F.col("_old") <= F.col("_key"))
    both = pinned(
        both.select(
            *at,
            F.when(stays, F.col("_old")).otherwise(F.col("_key")).alias("_key"),
            F.when(stays, F.col("_old_score")).otherwise(F.col("score")).alias("score"),
            "_member",
            "_old",
        )
    )
    # The user's positions: as changed, else as indexed.
    fresh = both.filter(F.col("user_id") == user_id).select("game_id", "_key", "_member", "score")
    known = index.of_user(user_id)
    if game_id is not None:
        known = known.filter(F.col("game_id") == game_id)
    known = known.join(fresh, "game_id", "left_anti").select(*fresh.columns)
    own = pinned(
        fresh.unionByName(known).select(
            "game_id",
            F.col("_key").alias("_own_key"),
            F.col("_member").alias("_own_member"),
            F.col("score").alias("user_score"),
        )
    )
    # What the changes add to and take from the members before the user and the board.
    moved = both.join(F.broadcast(own), "game_id").groupBy("game_id").agg(
        (
            F.count_if(_better("_key", "_member", "_own_key", "_own_member"))
            - F.count_if(_better("_old", "_member", "_own_key", "_own_member"))
        ).alias("_moved"),
        F.count_if(F.col("_old").isNull()).alias("_added"),
    )
    played = [r[0] for r in own.select("game_id").collect()]
    totals = index.tops(played).groupBy("game_id").agg(F.max("total_players").alias("_total"))
    ranked = own.join(_before(index, own), "game_id").join(moved, "game_id", "left")
    ranked = ranked.join(totals, "game_id", "left")
    zero = F.lit(0)
    return ranked.select(
        "game_id",
        (F.col("_before") + F.coalesce("_moved", zero) + 1).alias("user_rank"),
        "user_score",
        (F.coalesce("_total", zero) + F.coalesce("_added", zero)).alias("total_players"),
    )
