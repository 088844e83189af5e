"""Quality classifier: which of two zstandard dictionaries compresses a text better.

One dictionary is built from good labelled text, one from bad. A text is compressed piece by piece
with both; the bytes that the good dictionary saves against the bad one, per byte of text, are the
measure, and a logistic curve fitted on other labelled texts turns it into a probability.
"""

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import zstandard
from pyspark.sql import functions as F
from pyspark.sql import types as T

from podium.llm.common import importable, mapped, stored, utf8

PIECE = 2000  # bytes compressed at once, so that the dictionary matters throughout a long text
DICT_BYTES = 1 << 18
SAMPLE_ROWS = 2000  # labelled texts of each class
SAMPLE_PIECES = 4000  # pieces of a class that its dictionary is built from
LEVEL = 3
THRESHOLD = 0.3


@dataclass(frozen=True)
class Model:
    """Dictionaries of bad and good text, and the curve 1 / (1 + exp(-(slope * x + bias)))."""

    bad: bytes
    good: bytes
    slope: float
    bias: float


def pieces(data):
    return [data[at : at + PIECE] for at in range(0, len(data), PIECE)]


class Measure:
    """Bytes saved by the good dictionary per byte of text; 0 for empty texts."""

    def __init__(self, bad, good):
        self.packers = [self._packer(d) for d in (bad, good)]

    @staticmethod
    def _packer(data):
        known = zstandard.ZstdCompressionDict(data) if data else None
        if known:
            known.precompute_compress(level=LEVEL)
        return zstandard.ZstdCompressor(
            level=LEVEL, dict_data=known, write_content_size=False, write_dict_id=False
        )

    def __call__(self, text):
        data = utf8(text)
        bad, good = (sum(len(p.compress(x)) for x in pieces(data)) for p in self.packers)
        return (bad - good) / max(1, len(data))


def _logistic(x):
    return 1 / (1 + np.exp(-np.clip(x, -500, 500)))


def _curve(x, label, weight, rounds=50, ridge=1e-3):
    """Slope and bias of a weighted logistic regression, by Newton steps."""
    center, scale = x.mean(), x.std() or 1.0
    points = np.stack([(x - center) / scale, np.ones(len(x))], axis=1)
    w = np.zeros(2)
    for _ in range(rounds):
        p = _logistic(points @ w)
        slope = points.T @ (weight * (p - label)) + ridge * w
        bend = (points * (weight * p * (1 - p))[:, None]).T @ points + ridge * np.eye(2)
        step = np.linalg.solve(bend, slope)
        w = w - step
        if np.abs(step).max() < 1e-9:
            break
    return float(w[0] / scale), float(w[1] - w[0] * center / scale)


def held_out(doc_id):
    """Rows no model learns from: crc32 of the doc_id as text is divisible by five."""
    text = F.coalesce(doc_id.cast("string"), F.lit(""))
    return F.crc32(text.cast("binary")) % 5 == 0


def fit(docs, labels, sample_rows=SAMPLE_ROWS, sample_pieces=SAMPLE_PIECES):
    """A ``Model`` from ``docs`` (doc_id, text) and ``labels`` (doc_id, quality 0 or 1).

    Learns from at most ``sample_rows`` texts of each class, chosen by a hash of doc_id among all
    labelled doc_ids that are not held out; at most ``sample_pieces`` pieces of them reach the driver.
    A doc_id counts once: of several labels the lower, of several texts the one with the least hash.
    The curve is fitted on texts measured with dictionaries they are not in, and is weighted by the
    number of labels of each class. Where a class has no texts, every
    score is the share of label 1, or 0.5 without labels.
    """
    known = (
        labels.filter(F.col("quality").isin(0, 1) & F.col("doc_id").isNotNull())
        .filter(~held_out(F.col("doc_id")))
        .groupBy("doc_id")
        .agg(F.min(F.col("quality").cast("int")).alias("quality"))
    )
    counts = dict(known.groupBy("quality").agg(F.count(F.lit(1))).collect())
    bad, good = counts.get(0, 0), counts.get(1, 0)
    # The smallest hashes: at most 2 * sample_rows rows, whatever the size of labels.
    order = F.xxhash64("doc_id")
    chosen = [known.filter(F.col("quality") == q).orderBy(order).limit(sample_rows) for q in (0, 1)]
    chosen = F.broadcast(chosen[0].unionByName(chosen[1]))
    sample = docs.select("doc_id", "text").join(chosen, "doc_id")
    rows = docs.select("doc_id").join(chosen, "doc_id").groupBy("doc_id").agg(F.count(F.lit(1)).alias("n"))
    if not rows.filter("n > 1").isEmpty():
        # One text each, combined in the tasks that read them.
        sample = sample.groupBy("doc_id").agg(
            F.min("quality").alias("quality"), F.min_by("text", F.xxhash64("text")).alias("text")
        )
    # Read once, then from the shared folder.
    sample = stored(sample, "sample")
    part = F.pmod(F.xxhash64("doc_id", F.lit("part")), F.lit(2))
    # The texts of each half are measured with dictionaries of the other half.
    rows = []
    for half in (0, 1):
        others = _dictionaries(sample.filter(part != half), sample_pieces)
        if all(others):
            measured = measures(sample.filter(part == half), *others, keep=("quality",))
            rows += measured.select("quality", "measure").collect()
    rows.sort()  # the same curve whatever task a row came from
    y = np.array([r[0] for r in rows], float)
    if not len(y) or y.min() == y.max():
        share = good / (good + bad) if good + bad else 0.5
        share = min(max(share, 1e-6), 1 - 1e-6)
        return Model(b"", b"", 0.0, float(np.log(share / (1 - share))))
    x = np.array([r[1] for r in rows], float)
    ones = y.sum()
    weight = np.where(y == 1, good / ones, bad / (len(y) - ones))
    slope, bias = _curve(x, y, weight * len(y) / weight.sum())
    return Model(*_dictionaries(sample, sample_pieces), slope, bias)


def _dictionaries(sample, sample_pieces):
    return [_dictionary(sample.filter(F.col("quality") == q), sample_pieces) for q in (0, 1)]


def _dictionary(rows, sample_pieces):
    """A dictionary from the pieces of ``rows`` with the smallest hashes; empty if too few."""
    count = F.ceil(F.length("text") / PIECE).cast("int")
    each = rows.filter(F.length("text") > 0).select(
        "doc_id", "text", F.explode(F.sequence(F.lit(0), count - 1)).alias("n")
    )
    chosen = each.select(
        F.xxhash64("doc_id", "n").alias("h"), F.expr(f"substring(text, n * {PIECE} + 1, {PIECE})").alias("t")
    )
    samples = [r["t"].encode() for r in chosen.orderBy("h", "t").limit(sample_pieces).collect()]
    size = min(DICT_BYTES, sum(map(len, samples)) // 4)
    try:
        return zstandard.train_dictionary(size, samples).as_bytes() if size >= 1024 else b""
    except zstandard.ZstdError:  # too few or too uniform samples: the text itself is a dictionary
        return b"".join(samples)[-DICT_BYTES:]


def measures(docs, bad, good, keep=()):
    """doc_id, ``keep`` and the measure of every whole text."""

    def measure(batches):
        value = Measure(bad, good)
        for batch in batches:
            found = [value(t.as_py()) for t in batch.column("text")]
            names = ["doc_id", *keep]
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(n) for n in names), pa.array(found, pa.float64())],
                [*names, "measure"],
            )

    rows = docs.select("doc_id", "text", *keep)
    schema = T.StructType(
        [*(rows.schema[n] for n in ("doc_id", *keep)), T.StructField("measure", T.DoubleType())]
    )
    return mapped(rows, measure, schema)


def scores(docs, model, threshold=THRESHOLD):
    """doc_id, held_out, score and predicted of every row of ``docs`` (doc_id, text).

    The score is the probability of label 1. Null and empty texts measure 0. Repeated rows are each
    scored, rows without doc_id are held out, and an empty table gives no rows.
    """
    score = 1 / (1 + F.exp(-(F.col("measure") * model.slope + model.bias)))
    rows = measures(docs, model.bad, model.good).withColumn("score", score)
    return rows.select(
        "doc_id",
        held_out(F.col("doc_id")).alias("held_out"),
        "score",
        (F.col("score") >= threshold).cast("int").alias("predicted"),
    )


def accepted(docs, model, threshold=THRESHOLD):
    """The rows of ``docs`` with a score of at least ``threshold``, all columns as they are."""

    @F.pandas_udf("boolean")
    def good(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        value = Measure(model.bad, model.good)
        for part in texts:
            found = np.array([value(t) for t in part], float)
            yield pd.Series(_logistic(found * model.slope + model.bias) >= threshold)

    importable(docs.sparkSession)
    return docs.filter(good("text"))
