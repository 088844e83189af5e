"""Sharding by rendezvous hashing: every record goes to the shard that scores highest for its key.

A shard's score for a key depends on that key, the shard's number and its weight alone. Adding a
shard therefore moves only the records whose best score is now the new shard's, and removing one
moves only its own records. The share of records a shard gets is proportional to its weight.
"""

import math

from pyspark.sql import Window
from pyspark.sql import functions as F

from podium.llm.common import free

ROWS_PER_PIECE = 200_000


def record_key(key, text):
    """The stable 64-bit key of a record; records without one are spread by their text."""
    return F.when(key.isNull(), F.xxhash64(F.lit(1), text)).otherwise(F.xxhash64(key))


def _score(key, shard, weight):
    """-weight / ln(u): u is uniform in (0, 1), drawn by hashing key and shard."""
    bits = F.shiftrightunsigned(F.xxhash64(key, F.lit(shard)), 11)
    return -F.lit(float(weight)) / F.ln((bits + F.lit(0.5)) / F.lit(2.0**53))


def shard_of(key, weights):
    """The shard number, 0 to len(weights) - 1, of a 64-bit key column.

    Equal scores go to the lower number. A weight of zero or less keeps a shard empty.
    """
    scores = [
        F.struct(_score(key, i, w).alias("score"), F.lit(-i).alias("order"))
        for i, w in enumerate(weights)
        if w > 0
    ]
    return (-F.array_max(F.array(*scores))["order"]).cast("int")


def assign(docs, weights, grown_weight=1.0, rows_per_piece=ROWS_PER_PIECE):
    """One row per row of ``docs`` (doc_id, text): its shard, its slot there, its next shard.

    ``size`` is the text's UTF-8 length plus 16, ``text_crc32`` the unsigned CRC of those bytes,
    ``grown_shard`` the shard when one more of ``grown_weight`` is added. Slots number the rows of
    a shard from 0 without gaps. They are numbered in pieces of about ``rows_per_piece`` rows, so
    no task ever holds a whole shard; the text does not travel.

    A null text has no bytes. Rows without a doc_id are spread by their text. Repeated rows share
    a shard and get a slot each. An empty table gives an empty result.
    """
    pieces = max(1, math.ceil(docs.count() / (len(weights) * rows_per_piece)))
    data = F.coalesce(F.col("text"), F.lit("")).cast("binary")
    keyed = docs.select("doc_id", "text").withColumn("_key", record_key(F.col("doc_id"), F.col("text")))
    placed = keyed.select(
        "doc_id",
        (F.octet_length(data).cast("long") + 16).alias("size"),
        F.crc32(data).alias("text_crc32"),
        shard_of(F.col("_key"), weights).alias("shard"),
        shard_of(F.col("_key"), [*weights, grown_weight]).alias("grown_shard"),
        F.pmod(F.xxhash64("_key", F.lit("piece")), F.lit(pieces)).cast("int").alias("_piece"),
    )
    counts = placed.groupBy("shard", "_piece").agg(F.count(F.lit(1)).alias("_rows"))
    before = Window.partitionBy("shard").orderBy("_piece").rowsBetween(Window.unboundedPreceding, -1)
    bases = counts.select(
        "shard", "_piece", F.coalesce(F.sum("_rows").over(before), F.lit(0)).alias("_base")
    )
    inside = Window.partitionBy("shard", "_piece").orderBy("doc_id", "text_crc32", "size")
    return (
        placed.withColumn("_number", F.row_number().over(inside) - 1)
        .join(bases, ["shard", "_piece"])
        .select(
            "doc_id",
            "size",
            "text_crc32",
            F.lit("key").alias("law"),
            "shard",
            (F.col("_base") + F.col("_number")).cast("long").alias("slot"),
            "grown_shard",
        )
    )


def write_shards(docs, path, weights, files_per_shard=4):
    """Write whole records to ``path``/shard=N, every column kept.

    A shard is spread over ``files_per_shard`` tasks by key, so a heavy one is not one task's work.
    Where a column is named ``shard`` already, the folders are named ``_shard``.
    """
    name, part = free(docs.columns, "shard", "part")
    key = record_key(F.col("doc_id"), F.col("text"))
    spread = F.pmod(F.xxhash64(key, F.lit("file")), F.lit(files_per_shard))
    rows = docs.withColumns({name: shard_of(key, weights), part: spread})
    rows = rows.repartition(len(weights) * files_per_shard, name, part).drop(part)
    rows.write.partitionBy(name).mode("overwrite").option(
        "partitionOverwriteMode", "static"
    ).parquet(path)
