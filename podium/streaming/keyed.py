"""Live standings with keyed state: the query holds every (game, user) and passes on those that changed.

The state lies in RocksDB on the executors and as changelogs under the checkpoint, so a restart goes on
where the query stopped, and memory does not follow the number of players. What changed in a batch is
filed in eras like the other jobs' rows; the last filed row of a player is the current one.
"""

from contextlib import contextmanager

from pyspark.sql import functions as F

from podium.functions.values import best_of
from podium.streaming.eras import ERA, current_era, eras, file_batch, fold_past
from podium.streaming.live import DELTA, summary

ROCKSDB = {
    "spark.sql.streaming.stateStore.providerClass": (
        "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
    ),
    "spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled": "true",
}
PAIR = ["game_id", "user_id"]


@contextmanager
def _with(spark, settings):
    """The settings while a query starts, which keeps them; then what was set before."""
    before = {name: spark.conf.get(name, None) for name in settings}
    for name, value in settings.items():
        spark.conf.set(name, value)
    try:
        yield
    finally:
        for name, value in before.items():
            if value is None:
                spark.conf.unset(name)
            else:
                spark.conf.set(name, value)


def _read(spark, path, era):
    return spark.read.schema(DELTA).option("basePath", f"{path}/era={era}").parquet(f"{path}/era={era}")


def _last(filed):
    """The last filed row of every player."""
    row = F.struct(*(c for c in filed.columns if c not in ("batch_id", *PAIR)))
    return filed.groupBy(*PAIR).agg(F.max_by(row, "batch_id").alias("row")).select(*PAIR, "row.*")


def file_changes(path, every=ERA):
    """The foreachBatch function that files the players whose standings changed."""

    def store(batch, batch_id):
        spark, era = batch.sparkSession, batch_id // every
        fold_past(spark, path, era, batch_id, lambda e: _last(_read(spark, path, e)))
        file_batch(batch, path, era, batch_id)

    return store


def start_keyed(scores, path, checkpoint, available_now=False, every=ERA):
    """Start the query that keeps the standings under ``path`` current from state by player."""
    writer = summary(scores).writeStream.outputMode("update").foreachBatch(file_changes(path, every))
    writer = writer.option("checkpointLocation", checkpoint)
    if available_now:
        writer = writer.trigger(availableNow=True)
    with _with(scores.sparkSession, ROCKSDB):
        return writer.start()


def keyed_standings(spark, path, games):
    """Current standings as :func:`live.live_standings` has them."""
    filed = _read(spark, path, current_era(spark, path)) if eras(spark, path) else spark.createDataFrame([], DELTA)
    return _last(filed).join(games.select("game_id", "score_type"), "game_id").select(
        "game_id",
        "user_id",
        best_of(F.col("top"), F.col("low")).alias("best_score"),
        F.col("latest").alias("latest_score"),
        "submitted_at",
        "n",
    )
