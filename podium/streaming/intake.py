"""Intake of submissions: dedup, validation, rate check."""

from pyspark.sql import functions as F

from podium.functions.times import on_event_time, stored_time
from podium.operators.submissions import RATE_LIMIT, judged, rejected, valid


def distinct_ids(stream, delay="1 hour"):
    """Each id once; a repeat is dropped while it arrives within ``delay`` of event time."""
    return on_event_time(stream, delay).dropDuplicatesWithinWatermark(["id"])


def split_batch(games, accepted_path, rejected_path):
    """The foreachBatch function that judges a batch and writes both outcomes."""

    def store(batch, batch_id):
        rows = judged(batch, games).persist()  # two writes from one pass
        try:
            valid(rows).write.mode("overwrite").parquet(f"{accepted_path}/batch_id={batch_id}")
            rejected(rows).write.mode("overwrite").parquet(f"{rejected_path}/batch_id={batch_id}")
        finally:
            rows.unpersist()

    return store


def start_intake(submissions, games, accepted_path, rejected_path, checkpoint,
                 available_now=False):
    """Start the query that sorts submissions into accepted and rejected ones."""
    writer = submissions.writeStream.foreachBatch(
        split_batch(games, accepted_path, rejected_path)
    ).option("checkpointLocation", checkpoint)
    if available_now:
        writer = writer.trigger(availableNow=True)
    return writer.start()


def busy_minutes(scores, limit=RATE_LIMIT, delay="1 hour", width="1 minute"):
    """Stream of (user, minute) with more than ``limit`` submissions.

    Rows later than ``delay`` are not counted any more.
    """
    return (
        on_event_time(scores, delay)
        .groupBy(F.window("submitted_at", width).alias("w"), "user_id")
        .agg(F.count(F.lit(1)).alias("n"))
        .filter(F.col("n") > limit)
        .select("user_id", stored_time("w.start").alias("slot"), "n")
    )
