import random

from pyspark.sql import functions as F

from podium.operators import standings, submissions
from podium.streaming import activity, intake, live
from podium.schemas import SCORES
from tests.conftest import rows


def score_files(make, path, parts=4, seed=3):
    """Random scores with time ties in ``parts`` files, out of time order."""
    r = random.Random(seed)
    data = [
        (i, r.randrange(1, 8), r.randrange(1, 3), r.randrange(50),
         f"2024-01-0{r.randrange(1, 8)} 0{r.randrange(10)}:00:00")
        for i in range(200)
    ]
    scores = make.scores(*data)
    for k in range(parts):
        scores.filter(F.col("id") % parts == k).coalesce(1).write.mode("append").parquet(path)
    return scores


def read_stream(spark, path, files=1):
    return spark.readStream.schema(SCORES).option("maxFilesPerTrigger", files).parquet(path)


def test_live_standings_equal_batch(make, spark, tmp_path):
    src, out = str(tmp_path / "in"), str(tmp_path / "out")
    scores = score_files(make, src)
    games = make.games((1, "a", "highest"), (2, "b", "lowest"))
    query = live.start_live_standings(
        read_stream(spark, src), out, str(tmp_path / "check"), available_now=True
    )
    query.awaitTermination()
    now = live.live_standings(spark, out, games)
    best = rows(standings.best_standings(scores, games), "game_id", "user_id", "score", "n")
    latest = rows(standings.latest_standings(scores), "game_id", "user_id", "score")
    assert live.read_deltas(spark, out).select("batch_id").distinct().count() == 4
    assert rows(now, "game_id", "user_id", "best_score", "n") == best
    assert rows(now, "game_id", "user_id", "latest_score") == latest

    # Folding the batches changes nothing.
    folded = str(tmp_path / "folded")
    live.compact(spark, out, folded)
    assert rows(live.live_standings(spark, folded, games)) == rows(now)
    ranks = rows(live.live_ranks(spark, folded, games), "game_id", "user_id", "rank")
    assert len(ranks) == len(best)


def test_replaying_a_batch_twice(make, spark, tmp_path):
    games = make.games((1, "a", "highest"))
    scores = make.scores((1, 1, 1, 5, "2024-01-01 00:00:00"), (2, 1, 1, 4, "2024-01-01 00:00:00"))
    store = live.write_delta(str(tmp_path / "out"))
    for _ in range(3):
        store(scores, 0)
    late = make.scores((3, 1, 1, 9, "2023-01-01 00:00:00"))
    store(late, 1)
    got = live.live_standings(spark, str(tmp_path / "out"), games).first()
    assert (got.n, int(got.best_score), int(got.latest_score)) == (3, 9, 4)


def test_answers_across_batches(make, spark, tmp_path):
    games = make.games((1, "a", "highest"), (2, "b", "time"))
    path, out = str(tmp_path / "out"), str(tmp_path / "answers")
    store = live.answer_batch(path, out, games)
    t = "2024-01-01 00:00:00"
    store(make.scores((1, 1, 1, 5, t), (2, 2, 1, 7, t), (3, 1, 2, 9, t)), 0)
    second = make.scores((4, 1, 1, 8, t), (5, 1, 1, 8, t), (6, 1, 2, 10, t))
    for _ in range(2):
        store(second, 1)
    got = rows(spark.read.parquet(out), "id", "rank", "total_players", "is_personal_best")
    assert got == [
        (1, 2, 2, True),
        (2, 1, 2, True),
        (3, 1, 1, True),
        (4, 1, 2, True),
        (5, 1, 2, False),
        (6, 1, 1, False),
    ]


def test_intake(make, spark, tmp_path):
    games = make.games((1, "a", "highest"))
    given = make.submissions((1, 1, 1, "5", "{}"), (2, 1, 1, "-5", "{}"), (3, 1, 9, "5", "{}"))
    src = str(tmp_path / "in")
    given.write.parquet(src)
    stream = spark.readStream.schema(given.schema).parquet(src)
    good, bad = str(tmp_path / "good"), str(tmp_path / "bad")
    intake.start_intake(
        stream, games, good, bad, str(tmp_path / "check"), available_now=True
    ).awaitTermination()
    assert rows(spark.read.parquet(good), "id") == [(1,)]
    assert rows(spark.read.parquet(bad), "id", "reject_reason") == [
        (2, "score_negative"), (3, "game_not_found")
    ]


def run(spark, rows_out, tmp_path, name, mode="append"):
    out = str(tmp_path / name)
    schema = rows_out.schema
    activity.start(rows_out, out, out + "-check", mode, available_now=True).awaitTermination()
    return spark.read.schema(schema).parquet(out).drop("batch_id")


def test_repeated_ids_are_dropped_across_batches(make, spark, tmp_path):
    src = str(tmp_path / "in")
    score_files(make, src, parts=2)
    score_files(make, src, parts=2)
    kept = run(spark, intake.distinct_ids(read_stream(spark, src), "30 days"), tmp_path, "ids")
    assert kept.count() == 200 and kept.select("id").distinct().count() == 200


def test_activity_sessions_and_rate(make, spark, tmp_path):
    src = str(tmp_path / "in")
    scores = score_files(make, src)
    final = F.col("window_start") < F.lit("2024-01-07").cast("timestamp_ntz")
    # All files in one batch, so no row is late.
    days = run(spark, activity.live_activity(read_stream(spark, src, 100)), tmp_path, "days")
    want = scores.groupBy(F.date_trunc("day", "submitted_at").cast("timestamp_ntz")
                          .alias("window_start")).agg(
        F.count("*").alias("submissions"), F.count_distinct("user_id").alias("active_users"),
        F.max("score").alias("high_score"))
    assert rows(days) == rows(want.filter(final))
    rough = run(spark, activity.approximate_activity(read_stream(spark, src, 100), "1 day"),
                tmp_path, "rough", "update")
    assert rows(rough, "window_start", "submissions") == rows(want, "window_start", "submissions")

    sessions = run(spark, activity.live_sessions(read_stream(spark, src, 100)), tmp_path, "sess")
    all_sessions = submissions.play_sessions(scores)
    cols = ["user_id", "session_start", "session_end", "submissions"]
    closed = set(rows(sessions, *cols))
    assert closed and closed <= set(rows(all_sessions, *cols))

    busy = run(spark, intake.busy_minutes(read_stream(spark, src, 100), limit=1), tmp_path, "busy")
    batch = submissions.busy_slots(scores, 1)
    assert set(rows(busy, "user_id", "slot", "n")) <= set(rows(batch, "user_id", "slot", "n"))
    assert busy.count() > 0


def test_eras_fold_what_went_before(make, spark, tmp_path):
    games = make.games((1, "a", "highest"), (2, "b", "time"))
    path, out = str(tmp_path / "out"), str(tmp_path / "answers")
    store = live.answer_batch(path, out, games, every=2)
    r, every = random.Random(1), []
    for n in range(7):
        batch = [
            (10 * n + i, r.randrange(5), r.randrange(1, 3), r.randrange(9), f"2024-01-0{r.randrange(1, 9)} 00:00:00")
            for i in range(10)
        ]
        every += batch
        store(make.scores(*batch), n)
        if n == 4:
            store(make.scores(*batch), n)  # the first of an era, replayed
    scores = make.scores(*every)
    now = live.live_standings(spark, path, games)
    assert rows(now, "game_id", "user_id", "best_score", "n") == rows(
        standings.best_standings(scores, games), "game_id", "user_id", "score", "n"
    )
    assert live.current_era(spark, path) == 3
    assert live.read_deltas(spark, path).select("batch_id").distinct().count() == 2
    last = rows(spark.read.parquet(out).filter("batch_id = 6"), "id", "rank", "total_players")
    want = submissions.submission_results(scores, games).filter("id >= 60")
    assert last == rows(want, "id", "rank", "total_players")
    (tmp_path / "out" / "era=4" / "batch_id=-1").mkdir(parents=True)  # being written
    assert live.current_era(spark, path) == 3


def test_submissions_are_answered_or_rejected(make, spark, tmp_path):
    games = make.games((1, "a", "highest"), (2, "shut", "highest", False))
    base = str(tmp_path)
    store = live.submission_batch(
        f"{base}/boards", f"{base}/answers", f"{base}/rejects", f"{base}/slots", games, limit=3
    )
    first = make.submissions((1, 5, 1, "10", None), (2, 5, 1, "9", None), (3, 6, 2, "1", None), (4, 6, 8, "1", None))
    second = make.submissions((5, 5, 1, "x", None), (6, 5, 1, "99", None), (7, 7, 1, "10", "{}"))
    store(first, 0)
    for _ in range(2):
        store(second, 1)
    answers = rows(spark.read.parquet(f"{base}/answers"), "id", "rank", "total_players", "is_personal_best")
    assert answers == [(1, 1, 1, True), (2, 1, 1, False), (7, 2, 2, True)]
    refused = rows(spark.read.parquet(f"{base}/rejects"), "id", "reject_reason")
    assert refused == [
        (3, "game_inactive"), (4, "game_not_found"), (5, "score_not_a_number"), (6, "rate_limited")
    ]


def test_a_batch_is_read_once(make, spark, tmp_path):
    games = make.games((1, "a", "highest"))
    reads = spark.sparkContext.accumulator(0)

    def seen(batches):
        reads.add(1)
        yield from batches

    batch = make.scores((1, 1, 1, 5, "2024-01-01 00:00:00"), (2, 2, 1, 5, "2024-01-01 00:00:00"))
    counted = batch.coalesce(1).mapInArrow(seen, batch.schema)
    live.answer_batch(str(tmp_path / "out"), str(tmp_path / "answers"), games)(counted, 0)
    assert reads.value == 1
    got = rows(spark.read.parquet(str(tmp_path / "answers")), "id", "rank")
    assert got == [(1, 1), (2, 2)]


def test_late_rows_are_dropped_from_the_dedup(make, spark, tmp_path):
    src = str(tmp_path / "in")
    for n, when in enumerate(("2024-01-05", "2024-01-09", "2024-01-01")):
        make.scores((n, 1, 1, 5, f"{when} 00:00:00")).coalesce(1).write.mode("append").parquet(src)
    kept = run(spark, intake.distinct_ids(read_stream(spark, src), "1 day"), tmp_path, "late")
    assert rows(kept, "id") == [(0,), (1,)]


def test_an_era_may_begin_with_empty_batches(make, spark, tmp_path):
    games = make.games((1, "a", "highest"))
    path, out, bad, slots = (str(tmp_path / n) for n in ("boards", "out", "bad", "slots"))
    store = live.submission_batch(path, out, bad, slots, games, every=2)
    given = [
        make.submissions(*((10 * b + u, u, 1, str(score), "{}") for u, score in sent))
        for b, sent in enumerate([
            [(1, 5), (2, 7)], [(3, 9)], [], [(1, 6)], [], [], [(4, 1)], [(1, 6), (2, 8)],
        ])
    ]
    for batch_id, batch in enumerate(given):
        for _ in range(1 + (batch_id in (3, 6))):  # played again: the same
            store(batch, batch_id)
    got = rows(live.live_standings(spark, path, games), "user_id", "best_score", "n")
    assert [(u, int(s), n) for u, s, n in got] == [(1, 6, 3), (2, 8, 2), (3, 9, 1), (4, 1, 1)]
    told = rows(spark.read.parquet(out), "id", "rank", "total_players", "is_personal_best")
    assert sorted(told) == [
        (1, 2, 2, True), (2, 1, 2, True), (13, 1, 3, True), (31, 3, 3, True), (64, 4, 4, True),
        (71, 3, 4, False), (72, 2, 4, True),
    ]
