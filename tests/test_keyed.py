"""Standings from keyed state, over restarts, against the folded boards and a recompute."""

import os
import random

from podium.operators import standings
from podium.streaming import keyed, live
from tests.conftest import rows


def test_standings_after_restarts(make, spark, tmp_path):
    rand = random.Random(2)
    games = make.games((1, "a", "highest"), (2, "b", "lowest"))
    src, path, check = (str(tmp_path / n) for n in ("in", "keyed", "check"))
    every, ids = [], 0
    for run in range(5):
        batch = []
        for _ in range(15):
            ids += 1  # days out of order: late rows count like others
            batch.append((ids, rand.randrange(6), rand.choice([1, 2]), rand.randrange(50), f"2024-01-{rand.randrange(1, 28):02d} 00:00:00"))
        every += batch
        make.scores(*batch).write.mode("append").parquet(src)
        stream = spark.readStream.schema(make.scores().schema).parquet(src)
        keyed.start_keyed(stream, path, check, available_now=True, every=2).awaitTermination()
        scores = make.scores(*every)
        got = keyed.keyed_standings(spark, path, games)
        for kind, column in (("best", "best_score"), ("latest", "latest_score")):
            want = standings.standings(scores, games, kind)
            assert rows(got, "game_id", "user_id", column, "n") == rows(want, "game_id", "user_id", "score", "n")
    folded = str(tmp_path / "folded")
    live.write_delta(folded)(make.scores(*every), 0)
    assert rows(got) == rows(live.live_standings(spark, folded, games))
    state = [f for _, _, files in os.walk(f"{check}/state") for f in files]
    assert any(f.endswith((".changelog", ".zip")) for f in state)  # RocksDB's
    assert spark.conf.get("spark.sql.streaming.stateStore.providerClass").endswith("HDFSBackedStateStoreProvider")


def test_nothing_filed(make, spark, tmp_path):
    games = make.games((1, "a", "highest"))
    assert keyed.keyed_standings(spark, str(tmp_path), games).collect() == []
