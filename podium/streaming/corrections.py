"""Live boards of scores that are edited and deleted.

A change has the row before it (none of a new score) and the row after it (none of a deleted one). Every
batch files what it adds to and takes from each (game, user), the best ``DEPTH`` of either, with how many
rows that is. Whatever lies behind the first of a cut list is not known and not needed: up to the cut all
rows that came and went are filed, and the best of those that stayed is the user's standing. Only where
none of them stayed but rows behind the cut did, the scores themselves are read, of those users alone.

Sums do not depend on order, so batches are folded like any others, and no state is kept.
"""

from pyspark.sql import Window
from pyspark.sql import functions as F

from podium.functions.sizes import counted_broadcast
from podium.functions.values import event_key, sort_key
from podium.operators.standings import BEST, LATEST
from podium.streaming.eras import ERA, current_era, eras, file_batch, fold_past

DEPTH = 8  # rows of a user and game that a batch files

IMAGE = "struct<id:long,user_id:long,game_id:long,score:decimal(12,2),submitted_at:timestamp_ntz>"
CHANGES = f"before {IMAGE}, after {IMAGE}"
PAIR = ["game_id", "user_id"]
ENTRY = [*PAIR, "_order", "id", "score", "submitted_at"]
# A row of each entry that came (+1) or went (-1), and one of each pair without entry: its rows and cuts.
FILED = (
    "game_id long, user_id long, _order decimal(38,0), id long, score decimal(12,2), "
    "submitted_at timestamp_ntz, w long, n long, cut decimal(38,0), batch_id long"
)


def _newest_first():
    # Subtracted, since Spark rounds the negative of a decimal to 34 digits.
    return F.expr("cast(0 as decimal(38,0))") - event_key()


def _entries(changes, games, kind):
    """What changes add (w 1) and take (w -1), by the order of the best; what nets out is left out."""
    sides = [changes.select(f"{name}.*", F.lit(w).alias("w")) for name, w in (("before", -1), ("after", 1))]
    rows = sides[0].unionByName(sides[1]).filter("id is not null")
    if kind == BEST:
        rows = rows.join(games.select("game_id", "score_type"), "game_id")
        order = sort_key()
    elif kind == LATEST:
        rows, order = rows.join(games.select("game_id"), "game_id"), _newest_first()
    else:
        raise ValueError(f"kind must be {BEST!r} or {LATEST!r}, not {kind!r}")
    rows = rows.withColumn("_order", order.cast("decimal(38,0)"))
    return rows.groupBy(*ENTRY).agg(F.sum("w").alias("w")).filter("w <> 0")


def _cut(entries, pairs, depth):
    """The rows to file: the first ``depth`` entries of either sign, and of each pair its rows and cut.

    ``pairs`` has the rows and cuts of what the entries were made of.
    """
    side = Window.partitionBy(*PAIR, F.col("w") > 0).orderBy("_order", "id", "submitted_at")
    # Spark keeps the first rows of a group before the shuffle; one more tells whether there are more.
    first = entries.withColumn("_place", F.row_number().over(side)).filter(F.col("_place") <= depth + 1)
    none = F.lit(None)
    last = F.when(F.col("_place") == depth + 1, F.col("_order"))
    cuts = first.groupBy(*PAIR).agg(F.min(last).alias("cut")).filter("cut is not null")
    marks = pairs.unionByName(cuts.withColumn("n", F.lit(0).cast("long"))).groupBy(*PAIR).agg(
        F.sum("n").alias("n"), F.min("cut").alias("cut")
    )
    kept = first.filter(F.col("_place") <= depth).select(
        *ENTRY, "w", none.cast("long").alias("n"), none.cast("decimal(38,0)").alias("cut")
    )
    marks = marks.select(
        *PAIR,
        *(none.cast(t).alias(c) for c, t in (("_order", "decimal(38,0)"), ("id", "long"))),
        none.cast("decimal(12,2)").alias("score"),
        none.cast("timestamp_ntz").alias("submitted_at"),
        none.cast("long").alias("w"),
        "n",
        "cut",
    )
    return kept.unionByName(marks)


def _marks(filed):
    """The rows and the cut of every pair."""
    return filed.filter("id is null").groupBy(*PAIR).agg(F.sum("n").alias("n"), F.min("cut").alias("cut"))


def _net(filed):
    """The entries of many batches, what came and went again left out."""
    return filed.filter("id is not null").groupBy(*ENTRY).agg(F.sum("w").alias("w")).filter("w <> 0")


def summary(changes, games, kind=BEST, depth=DEPTH):
    """What a batch of ``changes`` (before, after) files."""
    entries = _entries(changes, games, kind)
    # Entries that are the same row many times over count as often.
    pairs = entries.groupBy(*PAIR).agg(F.sum("w").alias("n")).withColumn("cut", F.lit(None).cast("decimal(38,0)"))
    return _cut(entries, pairs, depth)


def folded(filed, depth=DEPTH):
    """What many batches have filed, as one."""
    marks = _marks(filed)
    known = _net(filed).join(marks.select(*PAIR, F.col("cut").alias("_cut")), PAIR, "left")
    # Entries at or behind the cut may lack what came or went there.
    known = known.filter(F.col("_cut").isNull() | (F.col("_order") < F.col("_cut"))).drop("_cut")
    return _cut(known, marks, depth)


def _read(spark, path, era):
    return spark.read.schema(FILED).option("basePath", f"{path}/era={era}").parquet(f"{path}/era={era}")


def correct_batch(path, games, kind=BEST, depth=DEPTH, every=ERA):
    """The foreachBatch function that files a batch of changes."""

    def store(batch, batch_id):
        if batch.isEmpty():
            return
        spark, era = batch.sparkSession, batch_id // every
        fold_past(spark, path, era, batch_id, lambda e: folded(_read(spark, path, e), depth))
        file_batch(summary(batch, games, kind, depth), path, era, batch_id)

    return store


def start_corrections(changes, path, games, checkpoint, available_now=False, kind=BEST, every=ERA):
    """Start the query that keeps a board current under new, edited and deleted scores."""
    writer = changes.writeStream.foreachBatch(correct_batch(path, games, kind, every=every)).option(
        "checkpointLocation", checkpoint
    )
    if available_now:
        writer = writer.trigger(availableNow=True)
    return writer.start()


def corrected_board(spark, path, games, scores, kind=BEST):
    """The standings (game_id, user_id, score) after all changes.

    ``scores`` are the scores as they are now. Only those of users whose filed rows have all gone
    while others are left are read from there. Every change must be filed once.
    """
    if not eras(spark, path):
        return spark.createDataFrame([], "game_id long, user_id long, score decimal(12,2)")
    filed = _read(spark, path, current_era(spark, path))
    marks = _marks(filed).filter("n > 0")
    live = _net(filed).filter("w > 0").join(marks, PAIR)
    live = live.filter(F.col("cut").isNull() | (F.col("_order") < F.col("cut")))
    first = live.groupBy(*PAIR).agg(F.min_by("score", F.struct("_order", "id", "submitted_at")).alias("score"))
    dry = marks.join(first, PAIR, "left_anti").select(*PAIR)
    gone = scores.join(counted_broadcast(dry), PAIR, "left_semi")
    order = sort_key() if kind == BEST else _newest_first()
    again = gone.join(games.select("game_id", "score_type"), "game_id").groupBy(*PAIR).agg(
        F.min_by("score", F.struct(order, "id")).alias("score")
    )
    return first.unionByName(again)
