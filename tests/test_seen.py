"""Ids that count once for ever, and rate-limit slots, over eras and replays."""

import random

import pytest
from pyspark.sql import functions as F

from podium.session import scratch
from podium.streaming import eras, live, seen
from tests.conftest import rows


def test_repeats_are_refused_however_late(make, spark, tmp_path):
    path = str(tmp_path / "seen")
    first = make.scores((1, 1, 1, 5, "2024-01-01 10:00:00"), (1, 2, 1, 9, "2024-01-01 09:00:00"), (2, 1, 1, 7, "2024-01-01 00:00:00"))
    later = make.scores((2, 9, 1, 1, "2024-03-01 00:00:00"), (3, 1, 1, 5, "2024-03-01 00:00:00"))
    for _ in range(2):  # played again: the same
        assert rows(seen.first_seen(first, 0, path), "id", "user_id") == [(1, 2), (2, 1)]
    for _ in range(2):
        assert rows(seen.first_seen(later, 7, path), "id", "user_id") == [(3, 1)]
    again = make.scores((3, 1, 1, 5, "2024-09-01 00:00:00"), (1, 1, 1, 5, "2024-09-01 00:00:00"))
    assert seen.first_seen(again, 8, path).collect() == []


@pytest.mark.parametrize("dense", [1, 4, 256])
def test_random_batches_over_eras(make, spark, tmp_path, monkeypatch, dense):
    monkeypatch.setattr(seen, "DENSE", dense)
    rand, path, known = random.Random(dense), str(tmp_path / "seen"), set()
    near = [-40_000, -1, 0, 1, 32_768, 32_769, 2**62, 10**9]
    for batch_id in [0, 1, 4, 5, 6, 9]:
        ids = [rand.choice(near) + rand.randrange(12) for _ in range(25)]
        batch = make.scores(*((i, 1, 1, 5, f"2024-01-{d % 28 + 1:02d} 00:00:00") for d, i in enumerate(ids)))
        got = [r[0] for r in rows(seen.first_seen(batch, batch_id, path, every=2), "id")]
        assert sorted(got) == sorted(set(ids) - known)
        known |= set(ids)
    last = eras.current_era(spark, path)
    assert last == 4
    held = spark.read.schema(seen.FILED).parquet(f"{path}/era={last}").groupBy().sum("n").first()[0]
    assert held == len(known)


def test_a_hot_id_and_rows_without_one(make, spark, tmp_path):
    scores = make.scores(*((5, 1, 1, 5, "2024-01-01 00:00:00") for _ in range(50)), (6, 1, 1, 5, "2024-01-01 00:00:00"))
    bare = scores.selectExpr("if(id = 6, null, id) as id", *scores.columns[1:])
    got = seen.first_seen(bare, 0, str(tmp_path / "seen"))
    assert sorted(rows(got, "id"), key=str) == [(5,), (None,)]
    assert seen.first_seen(scores.limit(0), 1, str(tmp_path / "seen")).collect() == []


def test_slots_are_folded_by_era(make, spark, tmp_path):
    slots = str(tmp_path / "slots")
    for batch_id in range(6):
        batch = make.scores(*((10 * batch_id + i, 1, 1, 5, f"2024-01-0{1 + i} 00:00:00") for i in range(2)))
        for _ in range(1 + (batch_id == 4)):
            over = live.over_limit(batch, batch_id, slots, limit=3, every=2)
            assert [r[0] for r in rows(over, "_over")] == [batch_id >= 3] * 2
    filed = live._read_slots(spark, slots, 2)
    assert rows(filed.groupBy("batch_id").sum("n")) == [(-1, 8), (4, 2), (5, 2)]


def test_new_rows_are_found_once(spark):
    """The rows are held for all who use them: filing their ids, counting, judging."""
    path = scratch(spark, "held")
    batch = spark.createDataFrame(
        [(1, "a"), (1, "b"), (2, "c"), (None, "d"), (None, "d")], "id long, note string"
    ).withColumn("submitted_at", F.lit("2024-01-01 10:00:00").cast("timestamp_ntz"))
    for n, ids in ((0, [-1, -1, 1, 2]), (0, [-1, -1, 1, 2]), (1, [-1, -1])):
        new = seen.first_seen(batch, n, path)
        assert new.storageLevel.useMemory
        assert sorted(r["id"] or -1 for r in new.collect()) == ids
        new.unpersist()
