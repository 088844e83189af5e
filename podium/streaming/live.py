"""Live standings: every micro-batch adds its own summary; readers fold the summaries.

Each batch is grouped to one row per (game, user) and written to its own folder, named by the
batch id. Replaying a batch replaces its folder, so nothing counts twice. Rows may be late or out
of order: the fold takes the best score, and the latest one by (time, id). No state is kept in
the query, so there is no watermark to drop late scores and no state that grows.

Batches are filed in eras (``eras.py``), so a reader opens a summary and at most ``ERA`` batches.
"""

from pyspark.sql import functions as F
from pyspark.sql import types as T

from podium.functions.sequences import Sequence
from podium.functions.sizes import touched_games
from podium.functions.times import bucket, stored_time
from podium.functions.values import best_of, event_key, is_highest
from podium.operators.ranking import counted_ranks, ranked_standings
from podium.operators.submissions import RATE_LIMIT, judged, rejected, valid
from podium.schemas import SCORE
from podium.streaming.eras import ERA, current_era, file_batch, fold_past
from podium.streaming.intake import distinct_ids
from podium.streaming.seen import first_seen

SLOTS = "user_id long, _slot timestamp_ntz, n long, day string, batch_id long"

KEY = T.DecimalType(38, 0)

DELTA = T.StructType(
    [
        T.StructField("game_id", T.LongType()),
        T.StructField("user_id", T.LongType()),
        T.StructField("top", SCORE),
        T.StructField("low", SCORE),
        T.StructField("latest", SCORE),
        T.StructField("latest_key", KEY),
        T.StructField("submitted_at", T.TimestampNTZType()),
        T.StructField("n", T.LongType()),
        T.StructField("batch_id", T.LongType()),
    ]
)


def summary(scores):
    """One row per (game, user) of a batch of scores."""
    key = event_key()
    return scores.groupBy("game_id", "user_id").agg(
        F.max("score").alias("top"),
        F.min("score").alias("low"),
        F.max_by("score", key).alias("latest"),
        F.max(key).alias("latest_key"),
        F.max("submitted_at").alias("submitted_at"),
        F.count(F.lit(1)).alias("n"),
    )


def folded(deltas):
    """Summaries of any number of batches as one row per (game, user)."""
    return deltas.groupBy("game_id", "user_id").agg(
        F.max("top").alias("top"),
        F.min("low").alias("low"),
        F.max_by("latest", "latest_key").alias("latest"),
        F.max("latest_key").alias("latest_key"),
        F.max("submitted_at").alias("submitted_at"),
        F.sum("n").alias("n"),
    )


def read_era(spark, path, era):
    return spark.read.schema(DELTA).parquet(f"{path}/era={era}")


def read_deltas(spark, path):
    """Summaries that together hold all batches."""
    return read_era(spark, path, current_era(spark, path))


def live_standings(spark, path, games):
    """Current standings: best and latest score of every (game, user)."""
    now = folded(read_deltas(spark, path))
    return now.join(games.select("game_id", "score_type"), "game_id").select(
        "game_id",
        "user_id",
        best_of(F.col("top"), F.col("low")).alias("best_score"),
        F.col("latest").alias("latest_score"),
        "submitted_at",
        "n",
    )


def live_board(spark, path, games, kind="best"):
    """The live standings of one kind, as the operators on standings take them."""
    board = live_standings(spark, path, games).withColumnRenamed(f"{kind}_score", "score")
    return board.select("game_id", "user_id", "score")


def live_totals(spark, path):
    """The last raw score of every user in any game: user_id, total_score."""
    now = folded(read_deltas(spark, path))
    return now.groupBy("user_id").agg(F.max_by("latest", "latest_key").alias("total_score"))


def live_ranks(spark, path, games, kind="best", bound=None):
    """Ranked live boards of all games."""
    return ranked_standings(live_board(spark, path, games, kind), games, bound=bound)


def write_delta(path, every=ERA):
    """The foreachBatch function that stores a batch's summary."""

    def store(batch, batch_id):
        spark, era = batch.sparkSession, batch_id // every
        fold_past(spark, path, era, batch_id, lambda e: folded(read_era(spark, path, e)))
        file_batch(summary(batch), path, era, batch_id)

    return store


def start_live_standings(scores, path, checkpoint, available_now=False):
    """Start the query that keeps the standings under ``path`` current."""
    return _started(scores, write_delta(path), checkpoint, available_now)


def answered(batch, before, now, games, bound=None):
    """What the submitters of a batch are told: rank, board size and personal-best flag.

    ``before`` and ``now`` are summaries without and with the batch; only the batch's players are
    taken from ``before`` and its games from ``now``. A score is a personal best when it beats all
    earlier batches and all earlier rows of its own batch.
    """
    kinds = games.select("game_id", "score_type")
    pairs = batch.select("game_id", "user_id").distinct()
    worth = F.when(is_highest(), F.col("score")).otherwise(-F.col("score")).alias("_worth")
    rows = batch.join(kinds, "game_id").select(
        "id", "user_id", "game_id", "score", "submitted_at", worth
    )
    seq = Sequence(rows, ["user_id", "game_id"], ["submitted_at", "id"], bound)
    rows = seq.running("_within", F.max, F.greatest, "_worth").done()
    known = folded(before.join(pairs, ["game_id", "user_id"], "left_semi"))
    old = known.join(kinds, "game_id").select(
        "game_id",
        "user_id",
        F.when(is_highest(), F.col("top")).otherwise(-F.col("low")).alias("_old"),
    )
    touched = touched_games(batch, games)
    board = folded(now.join(touched, "game_id", "left_semi")).join(kinds, "game_id").select(
        "game_id", "user_id", best_of(F.col("top"), F.col("low")).alias("score"), "score_type"
    )
    ranks = counted_ranks(board, games, pairs, bound)
    best_before = F.greatest("_within", "_old")
    return (
        rows.join(old, ["game_id", "user_id"], "left")
        .join(ranks, ["game_id", "user_id"])
        .select(
            "id",
            "user_id",
            "game_id",
            "score",
            F.col("user_rank").alias("rank"),
            "total_players",
            (best_before.isNull() | (F.col("_worth") > best_before)).alias("is_personal_best"),
        )
    )


def answer_batch(path, results, games, bound=None, every=ERA):
    """The foreachBatch function that stores a batch's summary and then its answers.

    Only earlier batches count as before, so a replayed batch gives the same answers. The batch is
    held meanwhile: its source is read once.
    """
    store_delta = write_delta(path, every)

    def store(batch, batch_id):
        batch = batch.persist()
        try:
            store_delta(batch, batch_id)
            deltas = read_era(batch.sparkSession, path, batch_id // every)
            before = deltas.filter(F.col("batch_id") < batch_id)
            now = deltas.filter(F.col("batch_id") <= batch_id)
            answers = answered(batch, before, now, games, bound)
            answers.write.mode("overwrite").parquet(f"{results}/batch_id={batch_id}")
        finally:
            batch.unpersist()

    return store


def _started(stream, store, checkpoint, available_now):
    writer = stream.writeStream.foreachBatch(store).option("checkpointLocation", checkpoint)
    if available_now:
        writer = writer.trigger(availableNow=True)
    return writer.start()


def start_answers(scores, path, results, games, checkpoint, available_now=False, bound=None):
    """Start the query that keeps the standings current and answers every submission."""
    return _started(scores, answer_batch(path, results, games, bound), checkpoint, available_now)


# --- submissions, from arrival to answer ---------------------------------------------------


def _read_slots(spark, slots, era):
    return spark.read.schema(SLOTS).option("basePath", f"{slots}/era={era}").parquet(f"{slots}/era={era}")


def _folded_slots(filed):
    return filed.groupBy("user_id", "_slot", "day").agg(F.sum("n").alias("n"))


def over_limit(batch, batch_id, slots, limit=RATE_LIMIT, every=ERA):
    """``batch`` with ``_over``: is it beyond the first ``limit`` of its user and minute?

    The counts of each batch are filed in eras under ``slots``, by day; only the days of this batch
    and earlier batches are looked up, so a replayed batch gets the same answer.
    """
    spark, era = batch.sparkSession, batch_id // every
    fold_past(spark, slots, era, batch_id, lambda e: _folded_slots(_read_slots(spark, slots, e)), ["day"])
    slot = bucket("minute", "submitted_at")
    rows = batch.withColumn("_slot", slot).withColumn("_day", F.to_date(slot).cast("string"))
    counts = rows.groupBy("user_id", "_slot", F.col("_day").alias("day")).agg(F.count(F.lit(1)).alias("n"))
    file_batch(counts.hint("rebalance", "day"), slots, era, batch_id, ["day"])
    days = [r["_day"] for r in rows.select("_day").distinct().collect()]
    filed = _read_slots(spark, slots, era).filter(F.col("day").isin(days) & (F.col("batch_id") < batch_id))
    seen = filed.groupBy("user_id", "_slot").agg(F.sum("n").alias("_seen"))
    seq = Sequence(rows, ["user_id", "_slot"], ["submitted_at", "id"]).number("_place")
    placed = seq.done().join(seen, ["user_id", "_slot"], "left")
    over = F.col("_place") + F.coalesce("_seen", F.lit(0)) > limit
    return placed.withColumn("_over", over).select(*batch.columns, "_over")


def submission_batch(
    path, results, rejects, slots, games, limit=RATE_LIMIT, bound=None, every=ERA, seen=None
):
    """The foreachBatch function that takes submissions all the way to their answers.

    With ``seen``, the folder of the ids that were taken, a repeated id is left out, however late.

    Rows beyond the rate limit are rejected first, then those that break a rule; the rest are
    stored and answered. Every row ends in ``results`` or, with a reason, in ``rejects``.
    """
    answer = answer_batch(path, results, games, bound, every)

    def store(batch, batch_id):
        batch = batch.withColumn("submitted_at", stored_time("submitted_at")).persist()
        try:
            if batch.isEmpty():
                return
            fresh = first_seen(batch, batch_id, seen, every) if seen else batch
            marked = over_limit(fresh, batch_id, slots, limit, every).persist()
            slow = marked.filter(~F.col("_over")).drop("_over")
            fast = judged(marked.filter("_over").drop("_over"), games)
            fast = fast.withColumn("reject_reason", F.lit("rate_limited"))
            checked = judged(slow, games).persist()
            refused = rejected(fast).unionByName(rejected(checked))
            refused.write.mode("overwrite").parquet(f"{rejects}/batch_id={batch_id}")
            answer(valid(checked), batch_id)
            checked.unpersist()
            marked.unpersist()
            fresh.unpersist()
        finally:
            batch.unpersist()

    return store


def start_submissions(
    submissions, path, results, rejects, slots, games, checkpoint, available_now=False,
    limit=RATE_LIMIT, delay="1 hour", bound=None, seen=None,
):
    """Start the query from raw submissions to answers: dedup, rate limit, rules, boards, answer.

    Repeated ids are dropped within ``delay`` of event time, or with the folder ``seen`` for ever.
    """
    store = submission_batch(path, results, rejects, slots, games, limit, bound, seen=seen)
    given = submissions if seen else distinct_ids(submissions, delay)
    return _started(given, store, checkpoint, available_now)


def compact(spark, path, target):
    """Fold all batches into one, in a new folder.

    Stop the query, compact, and start it again with the same checkpoint on the new folder. The
    folded part carries batch id -1, which no stream batch has; the old folder stays untouched.
    """
    rows = folded(read_deltas(spark, path))
    era = current_era(spark, path)
    rows.write.mode("overwrite").parquet(f"{target}/era={era}/batch_id=-1")
