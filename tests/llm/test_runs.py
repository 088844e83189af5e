"""Runs of words against their definition."""

import hashlib
import random
import zlib

import numpy as np
import pytest

from podium.llm import queries, runs
from tests.llm.conftest import SF_DIR


def by_definition(words, least=12):
    """All maximal stretches of every period, those without a smaller period kept."""
    n, found = len(words), []
    for q in range(1, n // 2 + 1):
        i = 0
        while i + q < n:
            j = i
            while j + q < n and words[j] == words[j + q]:
                j += 1
            part = words[i : j + q]
            if j > i and len(part) >= max(least, 2 * q):
                if not any(part[p:] == part[: len(part) - p] for p in range(1, q)):
                    found.append((i, len(part), q))
            i = j + 1
    return sorted(found, key=lambda r: (r[0], r[2]))


def edited(words, doc_id):
    h = zlib.crc32(str(doc_id).encode())
    if doc_id is None or not words or h % 10:
        return words
    n, g = len(words), h // 10
    a, p = g % n, 1 + (n - g % n) // (3 + g % 8)
    return [w if i < a else words[a + (i - a) % p] for i, w in enumerate(words)]


def by_hand(doc_id, text):
    words = edited((text or "").encode().split(), doc_id)
    found = by_definition(words)
    gone = {i for s, n, q in found for i in range(s + q, s + n)}
    best = sorted(found, key=lambda r: (-r[1], r[0], r[2]))[0] if found else (None,) * 3
    return (
        doc_id,
        len(found),
        *best,
        1000 * best[1] // best[2] if found else None,
        hashlib.sha256("".join(f"{s},{n},{q}\n" for s, n, q in found).encode()).hexdigest(),
        hashlib.sha256(b" ".join(w for i, w in enumerate(words) if i not in gone)).hexdigest(),
    )


@pytest.mark.parametrize("letters, least", [(1, 2), (2, 12), (2, 4), (3, 5), (4, 12)])
def test_random_words(letters, least):
    rand = random.Random(letters * 100 + least)
    for _ in range(400):
        n = rand.randrange(70)
        words = [rand.randrange(letters) for _ in range(n)]
        if rand.random() < 0.5 and n > 10:
            words = (words[: rand.randrange(1, 9)] * 30)[: n // 2] + words[: n // 2]
        assert runs.find_runs(np.array(words, np.int64), least) == by_definition(words, least)
        assert runs.runs_of([[b"%d" % w for w in words], [], [b"0"] * 12], least) == [
            by_definition(words, least), [], by_definition([0] * 12, least),
        ]


def test_words_of_one_text_do_not_meet_those_of_another():
    half = [b"%d" % i for i in range(8)]
    assert runs.runs_of([half, half, half + half]) == [[], [], [(0, 16, 8)]]


def test_long_texts():
    assert runs.runs_of([[b"a"] * 300_000]) == [[(0, 300_000, 1)]]
    mixed = [b"%d" % (i % 17) for i in range(30_000)] + [b"a"] * 20_000
    assert runs.runs_of([mixed]) == [[(0, 30_000, 17), (30_000, 20_000, 1)]]
    a, b = [b"a"], [b"a", b"b"]
    while len(b) < 1000:
        a, b = b, b + a
    assert runs.runs_of([b]) == [by_definition(b)]


def test_white_space_is_that_of_ascii(docs):
    text = "   \t\x1f\x0b" * 12
    row = runs.periodic_runs(docs((3, text))).first()
    assert tuple(row) == by_hand(3, text) and row.n_runs == 1


def test_rows(spark, real):
    both, rows = real
    clash = both.selectExpr("*", "1 as n_runs", "2 as period", "3 as start")
    found = runs.periodic_runs(clash, runs.planted)
    assert found.columns == runs.SCHEMA.names
    # The longest texts are too long for the definition; only their number is compared.
    short = {(i, t) for i, t in rows if len(t or "") < 4_000}
    want = sorted((by_hand(i, t) for i, t in rows if (i, t) in short), key=str)
    ids = {i for i, t in rows if (i, t) not in short}
    got = [tuple(r) for r in found.collect()]
    assert len(got) == len(rows)
    assert sorted((r for r in got if r[0] not in ids), key=str) == want
    assert sum(r[1] > 0 for r in want) > 10
    assert runs.periodic_runs(both.limit(0)).collect() == []


def test_query(spark):
    table = spark.read.parquet(f"{SF_DIR}/documents.parquet")
    rows = [tuple(r) for r in table.select("doc_id", "text").collect()]
    found = {r.doc_id: tuple(r) for r in queries.queries()["op13_periodic_runs"](spark, SF_DIR).collect()}
    assert len(found) == len(rows)
    for doc_id, text in rows:
        if len(text or "") < 4_000:
            assert found[doc_id] == by_hand(doc_id, text)
