"""Submission ids that count once for ever, however late a repeat arrives.

Ids are filed as sets: an id's bucket is its number by 32,768, and a bucket holds the offsets of its ids,
as a bitmap where there are many. Buckets lie in parts by ranges of ids, and a batch opens only the parts
it has ids of: new ids, which follow each other, meet the last part, a replay the part of its time.
"""

from pyspark.sql import functions as F

from podium.streaming.eras import ERA, eras, file_batch, fold_past

PARTS = 256
PART_BUCKETS = 1024  # neighbouring buckets that share a part: 33 million ids
DENSE = 256  # offsets from which on a bucket is a bitmap of 4 kB

FILED = "bucket long, offsets array<int>, bits binary, n long, part int, batch_id long"
_BYTE = "conv(hex(substring(bits, cast(offset div 8 as int) + 1, 1)), 16, 10)"
_HELD = f"coalesce(getbit(cast({_BYTE} as bigint), offset % 8) = 1, array_contains(offsets, offset), false)"


def _placed(rows):
    """``rows`` (id) with the bucket, offset and part of the id."""
    bucket = F.bitmap_bucket_number("id")
    part = F.pmod(F.floor(bucket / PART_BUCKETS), F.lit(PARTS)).cast("int")
    return rows.select(
        "*", bucket.alias("bucket"), F.bitmap_bit_position("id").cast("int").alias("offset"), part.alias("part")
    )


def _sets(offsets):
    """Buckets of (part, bucket, offset), each offset once: with all three of n, offsets and bits."""
    return offsets.groupBy("part", "bucket").agg(
        F.count(F.lit(1)).alias("n"),
        F.collect_list("offset").alias("offsets"),  # at most 32,768
        F.bitmap_construct_agg("offset").alias("bits"),
    )


def _filed(sets):
    """Sets as they are stored: few offsets as such, many as a bitmap."""
    many = F.col("n") >= DENSE
    return sets.select(
        "bucket",
        F.when(~many, F.sort_array("offsets")).alias("offsets"),
        F.when(many, F.col("bits")).alias("bits"),
        "n",
        "part",
    )


def _read(spark, path, era):
    return spark.read.schema(FILED).option("basePath", f"{path}/era={era}").parquet(f"{path}/era={era}")


def _united(filed):
    """The sets of many batches as one a bucket."""
    sparse = filed.filter("offsets is not null").select("part", "bucket", F.explode("offsets").alias("offset"))
    few = _sets(sparse).select("part", "bucket", "n", "offsets", "bits")
    dense = filed.filter("bits is not null").select(
        "part", "bucket", "n", F.lit(None).cast("array<int>").alias("offsets"), "bits"
    )
    both = few.unionByName(dense).groupBy("part", "bucket").agg(
        F.sum("n").alias("n"),
        F.max("offsets").alias("offsets"),  # one bucket has one list at most
        F.bitmap_or_agg("bits").alias("bits"),
    )
    return _filed(both)


def first_seen(batch, batch_id, path, every=ERA):
    """The rows of ``batch`` whose id no earlier batch had, one row an id: the earliest by submitted_at.

    Their ids are filed under ``path``. Rows without id are all kept: there is nothing to tell them by.
    Only earlier batches count, so a batch played again gives the same. The rows come persisted: finding
    them is most of the work, and filing their ids is the first of their uses. The caller lets them go.
    """
    spark, era = batch.sparkSession, batch_id // every
    fold_past(spark, path, era, batch_id, lambda e: _united(_read(spark, path, e)), ["part"])
    names = batch.columns
    order = F.struct("submitted_at", F.xxhash64(*names))
    # Combined before the shuffle: an id on many rows is a few rows by then.
    one = batch.filter("id is not null").groupBy("id").agg(F.min_by(F.struct(*names), order).alias("row"))
    placed = _placed(one)
    met = _placed(batch.filter("id is not null").select("id"))  # of the ids alone: no row is chosen for it
    parts = [r[0] for r in met.select("part").distinct().collect()]  # at most PARTS
    known = _read(spark, path, era) if era in eras(spark, path) else spark.createDataFrame([], FILED)
    known = known.filter((F.col("batch_id") < batch_id) & F.col("part").isin(parts))
    hits = placed.join(known, ["part", "bucket"]).filter(F.expr(_HELD)).select("id").distinct()
    fresh = placed.join(hits, "id", "left_anti").select("row.*")
    rows = fresh.unionByName(batch.filter("id is null")).persist()
    offsets = _placed(rows.filter("id is not null").select("id")).select("part", "bucket", "offset")
    file_batch(_filed(_sets(offsets)).hint("rebalance", "part"), path, era, batch_id, ["part"])
    return rows


def unique_batch(path, out, every=ERA):
    """The foreachBatch function that writes the rows whose id is new."""

    def store(batch, batch_id):
        batch = batch.persist()  # its source is read once
        try:
            if not batch.isEmpty():
                rows = first_seen(batch, batch_id, path, every)
                rows.write.mode("overwrite").parquet(f"{out}/batch_id={batch_id}")
                rows.unpersist()
        finally:
            batch.unpersist()

    return store


def start_unique(stream, path, out, checkpoint, available_now=False, every=ERA):
    """Start the query that passes each id on once, for ever."""
    writer = stream.writeStream.foreachBatch(unique_batch(path, out, every)).option(
        "checkpointLocation", checkpoint
    )
    if available_now:
        writer = writer.trigger(availableNow=True)
    return writer.start()
