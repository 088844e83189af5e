import random
import struct
import zlib

import numpy as np
import pytest
import xxhash
import zstandard

from podium.llm import quality

LABELS = "doc_id long, quality int, toxic int"


def _text(rand, good):
    if good:
        words = ["time", "people", "way", "water", "long", "little", "very", "after", "just", "name"]
        return " ".join(rand.choice(words) for _ in range(rand.randrange(20, 200))).capitalize() + "."
    return " ".join(rand.choice(["BUY!!", "###", "$$$ now", "click", "FREE***"]) for _ in range(rand.randrange(5, 200)))


@pytest.fixture(scope="module")
def corpus(spark, docs):
    rand = random.Random(5)
    rows = [(i, _text(rand, i % 3 > 0)) for i in range(900)]
    labels = spark.createDataFrame([(i, int(i % 3 > 0), 0) for i, _ in rows], LABELS)
    return docs(*rows), labels, dict(rows)


def test_held_out_accuracy(corpus):
    docs, labels, texts = corpus
    model = quality.fit(docs, labels)
    got = quality.scores(docs, model).collect()
    assert len(got) == 900
    for r in got:
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0)
        assert 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3)
    held = [r for r in got if r.held_out]
    right = sum(r.predicted == int(r.doc_id % 3 > 0) for r in held)
    assert len(held) > 100 and right / len(held) > 0.97
    measure = quality.Measure(model.bad, model.good)
    for r in got[:50]:  # the score is the curve over the sizes both dictionaries give
        x = measure(texts[r.doc_id]) * model.slope + model.bias
        assert r.score == pytest.approx(1 / (1 + np.exp(-x)), abs=1e-9)


def test_labels_of_held_out_rows_are_not_learned(spark, corpus):
    docs, labels, _ = corpus
    turned = [(r.doc_id, r.quality if zlib.crc32(str(r.doc_id).encode()) % 5 else 1 - r.quality, 0) for r in labels.collect()]
    assert quality.fit(docs, spark.createDataFrame(turned, LABELS)) == quality.fit(docs, labels)


def test_odd_rows(docs, corpus):
    model = quality.fit(*corpus[:2])
    rows = docs((1, None), (1, ""), (None, "Time after time."), (3, "x" * 100_000))
    got = quality.scores(rows, model).collect()
    assert len(got) == 4 and all(0 <= r.score <= 1 for r in got)
    assert [r.held_out for r in got if r.doc_id is None] == [True]


def test_accepted_rows_stay_as_they_are(corpus):
    docs, labels, _ = corpus
    model = quality.fit(docs, labels)
    clash = docs.withColumnRenamed("lang", "score").withColumnRenamed("source", "predicted")
    kept = quality.accepted(clash, model)
    want = {r.doc_id for r in quality.scores(docs, model).collect() if r.predicted}
    assert kept.columns == clash.columns and {r.doc_id for r in kept.collect()} == want


@pytest.mark.parametrize("labelled, score", [([], 0.5), ([(1, 1, 0)], 1.0), ([(1, 0, 0), (2, 0, 0)], 0.0), ([(1, None, None)], 0.5)])
def test_too_few_labels(spark, docs, labelled, score):
    rows = docs("some", "text", "here")
    model = quality.fit(rows, spark.createDataFrame(labelled, LABELS))
    assert [r.score for r in quality.scores(rows, model).collect()] == pytest.approx([score] * 3, abs=1e-5)
    assert quality.scores(docs(), model).count() == 0


def _xxh(value):
    h = xxhash.xxh64_intdigest(value if isinstance(value, bytes) else struct.pack("<q", value), 42)
    return h - (1 << 64) if h >> 63 else h


def _chained(doc_id, more):
    """Spark's hash of (doc_id, more): the first one's hash is the seed of the next."""
    first = xxhash.xxh64_intdigest(struct.pack("<q", doc_id), 42)
    h = xxhash.xxh64_intdigest(more if isinstance(more, bytes) else struct.pack("<i", more), first)
    return h - (1 << 64) if h >> 63 else h


def _by_hand(texts, labels):
    """The scores of ``texts`` by doc_id, the classifier made anew from its description."""
    known = {i: q for i, q in labels.items() if zlib.crc32(str(i).encode()) % 5}
    chosen = [i for q in (0, 1) for i in sorted((i for i in known if known[i] == q), key=_xxh)[:2000]]

    def dictionary(ids, q):
        cut = [
            (_chained(i, n), texts[i][n * 2000 : n * 2000 + 2000])
            for i in ids if known[i] == q and texts[i]
            for n in range(-(-len(texts[i]) // 2000))
        ]
        data = [t.encode() for _, t in sorted(cut)[:4000]]
        return zstandard.train_dictionary(min(1 << 18, sum(map(len, data)) // 4), data)

    def packed(text, known):
        data = text.encode()
        return sum(
            len(zstandard.ZstdCompressor(level=3, dict_data=known, write_content_size=False, write_dict_id=False).compress(data[a : a + 2000]))
            for a in range(0, len(data), 2000)
        )

    def measure(text, dictionaries):
        bad, good = (packed(text, d) for d in dictionaries)
        return (bad - good) / max(1, len(text.encode()))

    half = {i: _chained(i, b"part") % 2 for i in chosen}
    x, y = [], []
    for h in (0, 1):
        others = [dictionary([i for i in chosen if half[i] != h], q) for q in (0, 1)]
        for i in chosen:
            if half[i] == h:
                x.append(measure(texts[i], others))
                y.append(known[i])
    x, y = np.array(x), np.array(y)
    share = np.array([1 - y.mean(), y.mean()])
    full = np.array([sum(q == c for q in known.values()) for c in (0, 1)]) / len(known)
    weight = (full / share)[y]
    # The least of the weighted loss with a small ridge on the scaled points, by plain descent.
    points = np.stack([(x - x.mean()) / x.std(), np.ones(len(x))], axis=1)
    w = np.zeros(2)
    for _ in range(200):
        p = 1 / (1 + np.exp(-points @ w))
        bend = (points * (weight * p * (1 - p))[:, None]).T @ points + 1e-3 * np.eye(2)
        w -= np.linalg.inv(bend) @ (points.T @ (weight * (p - y)) + 1e-3 * w)
    both = [dictionary(chosen, q) for q in (0, 1)]
    return {
        i: 1 / (1 + np.exp(-(w[0] * (measure(t, both) - x.mean()) / x.std() + w[1]))) for i, t in texts.items()
    }


def test_scores_from_the_description(corpus):
    docs, labels, texts = corpus
    want = _by_hand(texts, {r.doc_id: r.quality for r in labels.collect()})
    got = {r.doc_id: r.score for r in quality.scores(docs, quality.fit(docs, labels)).collect()}
    assert got == pytest.approx(want, abs=1e-6)


def test_a_labelled_id_on_many_rows_counts_once(spark, corpus, docs):
    frame, labels, texts = corpus
    learned = next(i for i in texts if zlib.crc32(str(i).encode()) % 5)
    copies = docs(*[(learned, texts[learned])] * 3000)
    twice = labels.unionByName(labels.filter(f"doc_id = {learned}"))
    assert quality.fit(frame.unionByName(copies), twice) == quality.fit(frame, labels)


def test_names_that_clash(corpus):
    docs, labels, _ = corpus
    clash = docs.withColumnRenamed("lang", "measure").withColumnRenamed("source", "quality")
    model = quality.fit(clash, labels)
    assert quality.scores(clash, model).count() == quality.accepted(clash, model).count() + (
        quality.scores(clash, model).filter("predicted = 0").count()
    )
