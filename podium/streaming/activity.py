"""Live activity and play sessions over event time.

Unlike the tables, these drop scores that arrive later than the watermark delay.
"""

from pyspark.sql import functions as F

from podium.functions.times import on_event_time, stored_time


def live_activity(scores, width="1 day", delay="1 hour"):
    """Per closed window: submissions, distinct users, highest score. Exact, append mode.

    The first grouping is per user, so distinct users are a plain count in the second.
    """
    per_user = (
        on_event_time(scores, delay)
        .groupBy(F.window("submitted_at", width).alias("w"), "user_id")
        .agg(F.count(F.lit(1)).alias("n"), F.max("score").alias("top"))
    )
    return (
        per_user.groupBy(F.window("w", width).alias("span"))
        .agg(
            F.sum("n").alias("submissions"),
            F.count(F.lit(1)).alias("active_users"),
            F.max("top").alias("high_score"),
        )
        .select(
            stored_time("span.start").alias("window_start"), "submissions", "active_users", "high_score"
        )
    )


def approximate_activity(scores, width="1 hour", delay="1 hour"):
    """Per window so far: submissions and estimated users. Update mode, for quick displays."""
    return (
        on_event_time(scores, delay)
        .groupBy(F.window("submitted_at", width).alias("w"))
        .agg(
            F.count(F.lit(1)).alias("submissions"),
            F.approx_count_distinct("user_id").alias("active_users"),
        )
        .select(stored_time("w.start").alias("window_start"), "submissions", "active_users")
    )


def live_sessions(scores, gap="30 minutes", delay="1 hour"):
    """Closed play sessions per user: start, last submission, number of submissions."""
    return (
        on_event_time(scores, delay)
        .groupBy(F.session_window("submitted_at", gap).alias("s"), "user_id")
        .agg(F.count(F.lit(1)).alias("submissions"), F.max("submitted_at").alias("session_end"))
        .select(
            "user_id",
            stored_time("s.start").alias("session_start"),
            stored_time("session_end").alias("session_end"),
            "submissions",
        )
    )


def store_batches(path):
    """The foreachBatch function that writes each batch to a folder of its own."""

    def store(batch, batch_id):
        batch.write.mode("overwrite").parquet(f"{path}/batch_id={batch_id}")

    return store


def start(rows, path, checkpoint, mode="append", available_now=False):
    """Start a query that stores its output batches under ``path``."""
    writer = (
        rows.writeStream.outputMode(mode)
        .foreachBatch(store_batches(path))
        .option("checkpointLocation", checkpoint)
    )
    if available_now:
        writer = writer.trigger(availableNow=True)
    return writer.start()
