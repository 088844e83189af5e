import random
import re

import duckdb
import pytest

from podium.llm import licenses, queries


def _ordered(text):
    words = re.sub(r"[\W_]+", " ", text.lower()).strip().split(" ")
    return list(zip(words, words[1:], strict=False))


def _pairs(text):
    return set(_ordered(text))


def _by_run(text, threshold):
    """{name: best (dice, -number, name, title)} of the runs of a text."""
    pairs, hits = _ordered(text), []
    for number, (name, title, body) in enumerate(licenses.TEMPLATES):
        other = _ordered(body)
        own, size = set(other), len(other)
        last, step = len(pairs) - size, max(1, size // licenses.STEPS)
        for i in {
            min(i, last)
            for i, pair in enumerate(pairs)
            if last >= 0 and pair in own
            and (i == 0 or pairs[i - 1] not in own or pair == other[0] or (i + 1) % step == 0)
        }:
            run = set(pairs[i : i + size])
            dice = 2 * len(run & own) / (len(run) + len(own))
            if dice >= threshold:
                hits.append((i, i + size, len(run & own), dice, -number, name, title))
    kept = []  # of two that overlap by half of the shorter, the one with more in common
    for hit in sorted(hits):
        last = kept[-1] if kept else None
        if last and 2 * (min(last[1], hit[1]) - max(last[0], hit[0])) >= min(last[1] - last[0], hit[1] - hit[0]):
            kept[-1] = max(last, hit, key=lambda h: h[2:5])
        else:
            kept.append(hit)
    found = {}
    for hit in kept:
        if hit[5] not in found or hit[3] > found[hit[5]][0]:
            found[hit[5]] = hit[3:]
    return found


def _units(text):
    marks = "(?m)" + licenses.MARK
    bare = re.split(r"\n[ \t]*\n", re.sub(marks, "", text)) if re.search(marks + "$", text) else []
    return [*text.split("\n"), *re.split(r"\n[ \t]*\n", text), *bare, text]


def _brute(text, threshold=licenses.THRESHOLD):
    found = []
    for pairs in {frozenset(_pairs(u)) for u in _units(text or "")}:
        best = None
        for number, (name, title, body) in enumerate(licenses.TEMPLATES):
            other = _pairs(body)
            dice = 2 * len(pairs & other) / (len(pairs) + len(other))
            if dice >= threshold and (best is None or dice > best[0]):
                best = dice, -number, name, title
        if best:
            found.append(best)
    names = {f[2] for f in found}
    found += [f for name, f in _by_run(text or "", threshold).items() if name not in names]
    if {"BSD-2-Clause", "BSD-3-Clause"} & {f[2] for f in found}:
        found = [f for f in found if f[2] != "BSD"]
    if not found:
        return None, None, None, "", 0
    top = max(found)
    return top[2], top[3], top[0], ",".join(sorted({f[2] for f in found})), len(found)


def _check(frame, rows):
    got = licenses.dice_scan(frame).collect()
    assert sorted(str((i, *_brute(t))) for i, t in rows) == sorted(str(tuple(r)) for r in got)
    return {r.doc_id: r for r in got}


def test_rows_match_brute_force(real):
    _check(*real)


def test_texts(docs):
    grant = dict(((n, t), b) for n, t, b in licenses.TEMPLATES)["MIT", "grant"]
    wrapped = re.sub(r"(.{60}\S*) ", r"\1\n", grant)
    rows = [
        (1, f"Prose before.\n\n{wrapped}\n\nProse after."),
        (2, "Some words.\nreleased UNDER the mit license\nThis work is licensed under the GNU General Public License, version 3."),
        (3, grant.replace("Permission", "Leave").replace("restriction", "limits")),
        (4, "Released under the house rules."), (5, "License"), (6, None), (7, ""), (8, "\n\n\n"),
        (9, " ".join(["released under the MIT license"] * 400)), (9, "same id"), (None, "Licensed under CC BY-NC 4.0."),
    ]
    got = _check(docs(*rows), rows)
    assert got[1].license == "MIT" and got[3].license == "MIT" and 0.8 <= got[3].dice < 1
    assert got[2].licenses == "GPL-3.0,MIT" and got[2].n_units == 2
    assert got[4].license is None and got[6].n_units == 0 and got[None].license == "CC-BY-NC-4.0"


def test_empty_and_clashing_names(docs):
    assert licenses.dice_scan(docs()).count() == 0
    clash = docs("Released under the MIT License.").withColumnRenamed("lang", "units").withColumnRenamed("source", "best")
    assert [r.license for r in licenses.dice_scan(clash).collect()] == ["MIT"]


def test_no_python_in_the_plan(docs):
    plan = licenses.dice_scan(docs("a b"))._jdf.queryExecution().toString()
    assert not re.search("Python|Pandas|Arrow", plan)


@pytest.mark.parametrize("threshold", [0.5, 0.8, 0.95])
def test_size_bounds_lose_nothing(docs, threshold):
    body = licenses.TEMPLATES[9][2].split(" ")
    rows = [(n, " ".join(body[:n])) for n in range(1, len(body) + 1)] + [(-n, " ".join(body + ["x", "y"][:2] * n)) for n in range(1, 30)]
    got = {r.doc_id: r.dice for r in licenses.dice_scan(docs(*rows), threshold=threshold).collect()}
    assert got == {i: _brute(t, threshold)[2] for i, t in rows}


def test_close_relatives_are_told_apart(docs):
    body = {(n, t): b for n, t, b in licenses.TEMPLATES}
    headers = [k for k in body if "header" in k[1] and "GPL" in k[0]]
    clauses = [body["BSD", "grant"], licenses._BSD_CONDITIONS, licenses._BSD_NAMES, licenses._BSD_DISCLAIMER]
    two, three = "\n\n".join(c for c in clauses if c != licenses._BSD_NAMES), "\n\n".join(clauses)
    rows = [(i, body[k]) for i, k in enumerate(headers)] + [(100, two), (101, three), (102, body["BSD", "grant"])]
    got = _check(docs(*rows), rows)
    assert [got[i].licenses for i in range(len(headers))] == [n for n, _ in headers] and len(headers) >= 7
    assert [got[i].licenses for i in (100, 101, 102)] == ["BSD-2-Clause", "BSD-3-Clause", "BSD"]
    assert [got[i].license for i in (100, 101, 102)] == ["BSD-2-Clause", "BSD-3-Clause", "BSD"]


def test_licences_that_are_no_unit_of_their_own(docs):
    body = {(n, t): b for n, t, b in licenses.TEMPLATES}
    mit = [body["MIT", "grant"], licenses._MIT_NOTICE, body["MIT", "disclaimer"]]
    gpl, bsd = body["GPL-3.0", "header"], body["BSD", "grant"]
    clauses = [bsd, licenses._BSD_CONDITIONS, licenses._BSD_DISCLAIMER]

    def comment(*paragraphs):
        return "/*\n" + "\n *\n".join(re.sub(r"(.{60}\S*) ", r"\1\n * ", f" * {p}") for p in paragraphs) + "\n */\nint main() {}"

    prose = " ".join(f"word{i}" for i in range(300))
    rows = [
        (1, comment(*mit)), (2, " ".join([prose, *mit, prose])), (3, comment("A tool of ours.", gpl, prose)),
        (4, f"{prose} {gpl} {prose}"), (5, comment("Copyright Jane Doe", bsd)), (6, comment("Copyright Jane Doe", *clauses)),
        (7, "Copyright 2021 Jane Doe. Released under the MIT License. All rights reserved."),
        (8, f"{prose} {gpl} {prose} {' '.join(mit)} {body['AGPL-3.0', 'header']}"), (9, f"{prose} released under no licence"),
        (10, "# " + "\n# ".join(f"{prose} {' '.join(clauses)} {prose}".split(" "))), (11, f"{gpl}\n{prose} Released under the MIT License. {prose}"),
    ]
    got = _check(docs(*rows), rows)
    names = [got[i].licenses for i in range(1, 12)]
    assert names == [
        "MIT", "MIT", "GPL-3.0", "GPL-3.0", "BSD", "BSD-2-Clause", "MIT", "AGPL-3.0,GPL-3.0,MIT", "", "BSD-2-Clause", "GPL-3.0,MIT",
    ]
    assert got[7].dice == 1.0 and got[4].dice == 1.0 and got[9].n_units == 0


def _mixed(rand):
    """Texts of prose, licences whole or damaged, and comment marks."""
    bodies = [body for _, _, body in licenses.TEMPLATES]
    for i in range(60):
        parts = []
        for _ in range(rand.randrange(1, 6)):
            words = rand.choice(bodies).split(" ")
            if rand.random() < 0.5:
                words = [w if rand.random() < 0.9 else "other" for w in words][rand.randrange(4):]
            if rand.random() < 0.4:
                words = [rand.choice(["of", "the", "software", "is", "work"]) for _ in range(rand.randrange(40))]
            parts.append(" ".join(words))
        text = rand.choice([" ", "\n", "\n\n", "\n * \n", "\n# "]).join(parts)
        if rand.random() < 0.3:
            text = rand.choice([" * ", "# ", "dnl ", "// "]) + re.sub(r"(.{50}\S*) ", r"\1\n * ", text)
        yield i, text


def test_mixed_texts_and_sql(spark, docs):
    rows = [*_mixed(random.Random(8)), (100, None), (101, ""), (101, "Licensed under CC BY 4.0.\r\n\r\nx")]
    frame = docs(*rows)
    _check(frame, rows)
    base = duckdb.connect()
    base.register("documents", frame.toArrow())
    want = base.execute(queries.OP8_SQL).fetchall()
    got = [tuple(r) for r in licenses.dice_scan(frame).collect()]
    assert sorted(map(str, got)) == sorted(map(str, want))


def test_long_texts(docs):
    """A text of a million characters, and one licence many times over."""
    body = {(n, t): b for n, t, b in licenses.TEMPLATES}
    whole, grant = body["MIT", "whole"], body["ISC", "grant"]
    prose = "some words of the text that goes on and on, under the terms of the thing. " * 7000
    got = licenses.dice_scan(docs(f"{prose}{whole} {prose}", " ".join([grant] * 10_000), "x" * 1_000_000))
    rows = sorted((r.doc_id, r.licenses, r.n_units) for r in got.collect())
    assert rows == [(0, "MIT", 1), (1, "ISC", 1), (2, "", 0)]
