import math
import struct
import zlib
from collections import Counter

import xxhash
from pyspark.sql import functions as F

from podium.llm import shards


def _hash(value, seed, code):
    return xxhash.xxh64_intdigest(struct.pack(code, value), seed)


def _signed(value):
    return value - (1 << 64) if value >> 63 else value


def _key(doc_id, text):
    if doc_id is not None:
        return _hash(doc_id, 42, "<q")
    first = _hash(1, 42, "<i")
    return first if text is None else xxhash.xxh64_intdigest(text.encode(), first)


def _shard(doc_id, text, weights):
    best = None
    for i, w in enumerate(weights):
        if w > 0:
            bits = _hash(i, _hash(_signed(_key(doc_id, text)), 42, "<q"), "<i") >> 11
            score = -w / math.log((bits + 0.5) / 2**53)
            if best is None or score > best[0]:
                best = score, i
    return best[1]


def test_rows_match_brute_force(real):
    docs, rows = real
    got = shards.assign(docs, [1.0] * 40, rows_per_piece=2).collect()
    want = Counter(
        (
            i, len((t or "").encode()) + 16, zlib.crc32((t or "").encode()),
            _shard(i, t, [1.0] * 40), _shard(i, t, [1.0] * 41),
        )
        for i, t in rows
    )
    assert want == Counter((r.doc_id, r["size"], r.text_crc32, r.shard, r.grown_shard) for r in got)
    slots = {}
    for r in got:
        slots.setdefault(r.shard, []).append(r.slot)
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert {r.law for r in got} == {"key"}


def test_growing_moves_rows_only_into_the_new_shard(spark):
    docs = spark.range(20_000).select(F.col("id").alias("doc_id"), F.lit("x").alias("text"))
    rows = shards.assign(docs, [1.0] * 9).collect()
    moved = [r for r in rows if r.shard != r.grown_shard]
    assert {r.grown_shard for r in moved} == {9}
    assert abs(len(moved) - 2000) < 200


def test_weights(spark):
    docs = spark.range(20_000).select(F.col("id").alias("doc_id"), F.lit("x").alias("text"))
    counts = Counter(r.shard for r in shards.assign(docs, [1.0, 0.0, 3.0]).collect())
    assert set(counts) == {0, 2} and abs(counts[2] - 15_000) < 400


def test_empty(docs):
    assert shards.assign(docs(), [1.0, 1.0]).count() == 0


def test_written_shards_hold_all_rows(docs, tmp_path, spark):
    rows = docs(*(f"text {i}" for i in range(50)))
    shards.write_shards(rows, str(tmp_path / "s"), [1.0] * 4, files_per_shard=2)
    back = spark.read.parquet(str(tmp_path / "s"))
    assert sorted(r.text for r in back.collect()) == sorted(f"text {i}" for i in range(50))
    want = {r.doc_id: r.shard for r in shards.assign(rows, [1.0] * 4).collect()}
    assert {r.doc_id: r.shard for r in back.collect()} == want
    clash = rows.withColumnRenamed("lang", "shard").withColumnRenamed("source", "part")
    shards.write_shards(clash, str(tmp_path / "c"), [1.0] * 4)
    assert {r.doc_id: r['_shard'] for r in spark.read.parquet(str(tmp_path / "c")).select("doc_id", "_shard").collect()} == want
