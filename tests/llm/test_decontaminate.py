import hashlib
import random
import re

import pytest
from pyspark.sql import functions as F

from podium.llm import decontaminate as d

ITEMS = "item_id long, text string"


def _words(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)


def _brute(text, items, window=10):
    run, hit, owners = _words(text), set(), set()
    for item, body in items:
        words = _words(body)
        size = min(window, len(words))
        windows = {tuple(words[i : i + size]) for i in range(len(words) - size + 1)} if words else set()
        for i in range(len(run) - size + 1 if size else 0):
            if tuple(run[i : i + size]) in windows:
                hit.update(range(i, i + size))
                owners.add("null" if item is None else str(item))
    listed = ",".join(sorted(owners)).encode()
    return len(run), len(hit), len(owners), hashlib.sha256(listed).hexdigest(), bool(hit)


def _compare(spark, docs, rows, items, **options):
    table = spark.createDataFrame(items, ITEMS)
    got = d.contamination(docs, table, **options).collect()
    want = [(i, *_brute(t, items, options.get("window", 10))) for i, t in rows]
    assert sorted(map(str, want)) == sorted(str(tuple(r)) for r in got)
    return got


def test_benchmark_matches_brute_force(spark, real):
    docs, rows = real
    items = [tuple(r) for r in spark.read.parquet("/root/testdata/sf0.001/benchmark.parquet").collect()]
    passage = items[3][1]
    extra = [(20_001, f"Intro words. {passage.upper()} and after"), (20_002, passage[:40]), (20_003, passage * 3)]
    more = spark.createDataFrame(extra, "doc_id long, text string")
    got = _compare(spark, docs.select("doc_id", "text").unionByName(more), rows + extra, items)
    assert {r.doc_id for r in got if r.contaminated} >= {20_001, 20_003}


@pytest.mark.parametrize("item_bytes", [2 << 20, 60])
@pytest.mark.parametrize("window", [1, 3, 4])
def test_random_words(spark, docs, window, item_bytes):
    rand = random.Random(window)

    def text(n):
        return " ".join(rand.choice("abcd") for _ in range(n))

    items = [(i, text(rand.randrange(0, 9))) for i in range(12)] + [(3, text(6)), (None, "a b c d a"), (50, None)]
    rows = [(i, text(rand.randrange(0, 40))) for i in range(60)]
    _compare(spark, docs(*rows), rows, items, window=window, item_bytes=item_bytes)


def test_long_items_and_blocks(spark, docs, monkeypatch):
    monkeypatch.setattr(d, "SEGMENT", 25)
    monkeypatch.setattr(d, "BLOCK", 64)
    rand = random.Random(1)
    body = " ".join(f"w{rand.randrange(40)}" for _ in range(400))
    cuts = [body[i : i + 130] for i in range(0, 900, 90)]
    run = d.Automaton([("1", body.encode().split())]).hits(("x " * 50 + body + " y").encode())
    assert run[:2] == (50 + 400 + 1, [[50, 450]])
    rows = list(enumerate(cuts))
    _compare(spark, docs(*rows), rows, [(1, body), (2, "w1 w2")])


@pytest.mark.parametrize("item_bytes", [2 << 20, 90])
def test_cutting(spark, docs, item_bytes):
    secret = "one two three four five six seven eight nine ten eleven twelve"
    other = "uno dos tres cuatro cinco seis siete ocho nueve diez once doce"
    halves = secret.replace(" six ", f" six {other} ")
    clean = "Nothing of it is here, ever so many words stand here and all of them are clean."
    rows = docs(
        clean, f"{clean} {secret.upper()}! {clean}", secret, None, "", f"{clean} {halves} {clean}",
        (None, f"{other} {clean}"),
    ).withColumn("spans", F.lit("clash"))
    items = spark.createDataFrame([(1, secret), (2, other)], ITEMS)
    got = d.decontaminated(rows, items, item_bytes=item_bytes)
    assert got.columns == rows.columns
    found = {r.doc_id: r for r in got.collect()}
    assert set(found) == {0, 1, 3, 4, 5, None}
    assert found[0].text == clean and found[3].text is None and found[4].text == ""
    assert found[1].text == f"{clean} ! {clean}" and found[1].n_chars == len(found[1].text)
    assert _words(found[5].text) == _words(f"{clean} {clean}")
    assert found[None].text == f" {clean}" and found[1].spans == "clash"
    again = d.contamination(got, items)
    assert again.filter("contaminated").count() == 0


def test_empty(spark, docs):
    none = spark.createDataFrame([], ITEMS)
    assert d.contamination(docs(), none).count() == 0
    assert [r.n_hit for r in d.contamination(docs("a b"), none).collect()] == [0]
    assert d.decontaminated(docs("a b"), none).count() == 1


@pytest.mark.parametrize("item_bytes", [2 << 20, 30])
def test_what_is_dropped_does_not_depend_on_the_number_of_automata(spark, docs, item_bytes):
    def named(letter, n):
        return [f"{letter}{i}" for i in range(n)]

    a, b, f = named("a", 10), named("b", 10), named("f", 8)
    texts = [" ".join([*b[:5], *a, *b[5:], *f]), " ".join(a + f), " ".join(a + f[:5]), "clean words", "", None]
    items = spark.createDataFrame([("x", " ".join(a)), ("y", " ".join(b))], "item_id string, text string")
    clash = docs(*texts).withColumnRenamed("lang", "spans")
    got = d.decontaminated(clash, items, item_bytes=item_bytes)
    assert got.columns == clash.columns
    kept = {r.doc_id: r.text for r in got.collect()}
    # The first hits are 10 of 28 words; those that then meet are 10 of 18. Two thirds are too many.
    assert sorted(kept) == [0, 3, 4, 5] and kept[0].split() == f and kept[3] == "clean words"
