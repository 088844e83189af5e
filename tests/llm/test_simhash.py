import random

import pytest
import xxhash
from pyspark.sql import functions as F

from podium.llm import simhash
from podium.llm.graph import components


def _fingerprint(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    for c in "\t\n\x0b\x0c\r":
        low = low.replace(c, " ")
    words = [w for w in low.split(" ") if w]
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def _groups(prints, bits=2):
    """The smallest index each distinct print reaches, by brute force."""
    parent = list(range(len(prints)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(prints)):
        for j in range(i):
            if (prints[i] ^ prints[j]).bit_count() <= bits:
                a, b = sorted((root(i), root(j)))
                parent[b] = a
    return [root(i) for i in range(len(prints))]


def test_rows_match_brute_force(real):
    docs, rows = real
    got = sorted(simhash.near_duplicates(docs).collect(), key=str)
    prints = [_fingerprint(t) for _, t in rows]
    group = _groups(prints)
    least = {}
    for (doc_id, _), g in zip(rows, group, strict=True):
        known = [x for x in (least.get(g), doc_id) if x is not None]
        least[g] = min(known) if known else None
    want = [(i, f"{p:016x}", least[g]) for (i, _), p, g in zip(rows, prints, group, strict=True)]
    assert sorted(map(str, want)) == sorted(str(tuple(r)) for r in got)
    assert len(set(least.values())) < len(rows)


@pytest.mark.parametrize("key_bound", [1, 4, 256])
def test_links_connect_all_close_prints(spark, key_bound):
    rand = random.Random(3)
    prints = set()
    for _ in range(12):
        centre = rand.getrandbits(64)
        for _ in range(40):
            prints.add(centre)
            for _ in range(rand.choice((1, 1, 2, 3))):
                centre ^= 1 << rand.randrange(64)
    prints = sorted(prints)
    signed = [p - (1 << 64) if p >> 63 else p for p in prints]
    rows = spark.createDataFrame([(s,) for s in signed], "bits long")
    found = {(r.a, r.b) for r in simhash.links(rows, key_bound=key_bound).collect()}
    at = {s: i for i, s in enumerate(signed)}
    assert all((prints[at[a]] ^ prints[at[b]]).bit_count() <= 2 for a, b in found)
    graph = {r.node: r.component for r in components(spark.createDataFrame(list(found), "a long, b long")).collect()}
    group = _groups(prints)
    mine = {}
    for s, g in zip(signed, group, strict=True):
        mine.setdefault(g, set()).add(graph.get(s, s))
    assert all(len(x) == 1 for x in mine.values())
    assert len({min(x) for x in mine.values()}) == len(mine)


def test_dense_group_leaves_a_forest(spark):
    rows = spark.range(256).select(F.col("id").alias("bits"))  # close pairs: 256 * 36 / 2
    found = simhash.links(rows, key_bound=256)
    graph = components(found)
    assert graph.count() == 256 and graph.select("component").distinct().count() == 1
    assert found.count() <= 6 * 255


def test_components_of_a_long_path(spark):
    edges = spark.range(300).select(F.col("id").alias("a"), (F.col("id") + 1).alias("b"))
    assert {r.component for r in components(edges).collect()} == {0}
    assert components(edges.limit(0)).count() == 0


def test_one_of_each_keeps_whole_rows(docs):
    text = "the same words in the same order, over and over again, in every copy"
    rows = docs(
        (5, text), (2, text), (2, text), (9, "quite another text of more than three words here"),
        (None, text), (None, None), (None, ""), (2, "a different text under a repeated id, for once"),
        (8, "The Same words in the same order, over and over again, in every copy"),
    ).withColumns({n: F.lit("clash") for n in ("bits", "component_id", "again")})
    kept = simhash.one_of_each(rows)
    assert kept.columns == rows.columns
    got = sorted(map(str, ((r.doc_id, r.text) for r in kept.collect())))
    assert len(got) == 4
    assert str((2, text)) in got and any("different" in g for g in got) and any("quite" in g for g in got)
    assert sum(g.startswith("(None") for g in got) == 1


def test_one_of_each_without_repeats(docs):
    rows = docs("a b c d e f", "A B c d e f", "other words stand in this one", None, "")
    assert sorted(r.doc_id for r in simhash.one_of_each(rows).collect()) == [0, 2, 3]


def test_empty(docs):
    assert simhash.near_duplicates(docs()).count() == 0
    assert simhash.one_of_each(docs()).count() == 0
