"""The operators of this folder as registered queries, and the SQL of those that SQL can express."""

import public_tokenizers

import corpus_pipeline
from podium.llm import (
    counts,
    decontaminate,
    density,
    frames,
    imatch,
    licenses,
    packing,
    quality,
    runs,
    shards,
    simhash,
    warc,
    whitening,
)
from podium.llm.common import table

SHARDS = 40


def _op1(spark, sf_dir):
    return warc.archived_pages(table(spark, sf_dir, "pages"))


def _op2(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    return quality.scores(docs, quality.fit(docs, table(spark, sf_dir, "labels")))


def _op3(spark, sf_dir):
    return imatch.fingerprints(table(spark, sf_dir, "documents"), by_text=True)


def _op4(spark, sf_dir):
    return decontaminate.contamination(
        table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")
    )


def _op5(spark, sf_dir):
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


def _op6(spark, sf_dir):
    return packing.pack(
        table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), end_id=1
    )


def _op7(spark, sf_dir):
    path = public_tokenizers.path("word_bpe_49k.json")
    return counts.token_counts(table(spark, sf_dir, "documents"), path)


def _op8(spark, sf_dir):
    return licenses.dice_scan(table(spark, sf_dir, "documents"))


def _op9(spark, sf_dir):
    path = public_tokenizers.path("byte_bpe_50k.json")
    return frames.round_trip(table(spark, sf_dir, "documents"), path, end_id=2)


def _op10(spark, sf_dir):
    return shards.assign(table(spark, sf_dir, "documents"), [1.0] * SHARDS)


def _op11(spark, sf_dir):
    return density.extracted(table(spark, sf_dir, "pages"))


def _op12(spark, sf_dir):
    return whitening.whitened(table(spark, sf_dir, "embeddings"))


def _op13(spark, sf_dir):
    return runs.periodic_runs(table(spark, sf_dir, "documents"), runs.planted)


def queries():
    return {
        "op1_warc": _op1,
        "op2_quality": _op2,
        "op3_imatch": _op3,
        "op4_decontamination": _op4,
        "op5_simhash": _op5,
        "op6_packing": _op6,
        "op7_token_counts": _op7,
        "op8_licenses": _op8,
        "op9_token_files": _op9,
        "op10_sharding": _op10,
        "op11_main_text": _op11,
        "op12_whitening": _op12,
        "op13_periodic_runs": _op13,
        "pipeline": corpus_pipeline.run,
    }


OP1_SQL = """
WITH p AS (
    SELECT page_id, strlen(coalesce(html, '')) AS payload_bytes,
           sha256(coalesce(html, '')) AS payload_digest
    FROM pages
), f AS (
    SELECT *, min(page_id) OVER (PARTITION BY payload_digest) AS first_id FROM p
)
SELECT page_id, payload_bytes, payload_digest,
       CASE WHEN payload_bytes >= 100 AND page_id <> first_id THEN 'revisit' ELSE 'response' END
           AS record_type,
       CASE WHEN payload_bytes >= 100 AND page_id <> first_id THEN first_id END AS refers_to
FROM f
"""

_WORDS = """regexp_extract_all(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')"""

OP4_SQL = f"""
WITH docs AS (
    SELECT row_number() OVER () AS r, doc_id, {_WORDS} AS w FROM documents
), items AS (
    SELECT coalesce(CAST(item_id AS VARCHAR), 'null') AS item, {_WORDS} AS w FROM benchmark
), item_windows AS (
    SELECT DISTINCT item, n, list_aggregate(w[i : i + n - 1], 'string_agg', ' ') AS words
    FROM (SELECT *, unnest(range(1, len(w) - n + 2)) AS i
          FROM (SELECT *, least(10, len(w)) AS n FROM items WHERE len(w) > 0))
), doc_windows AS (
    SELECT r, i, n, list_aggregate(w[i : i + n - 1], 'string_agg', ' ') AS words
    FROM (SELECT *, unnest(range(1, len(w) - n + 2)) AS i
          FROM docs JOIN (SELECT DISTINCT n FROM item_windows) ON n <= len(w))
), found AS (
    SELECT r, i, n, item FROM doc_windows JOIN item_windows USING (n, words)
), hits AS (
    SELECT r, count(DISTINCT place) AS n_hit
    FROM (SELECT r, unnest(range(i, i + n)) AS place FROM found) GROUP BY r
), owners AS (
    SELECT r, count(DISTINCT item) AS n_items, string_agg(DISTINCT item, ',' ORDER BY item) AS ids
    FROM found GROUP BY r
)
SELECT doc_id, len(w) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
       sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM docs LEFT JOIN hits USING (r) LEFT JOIN owners USING (r)
"""

_TEMPLATES = ",\n    ".join(
    "({}, '{}', '{}', '{}')".format(-number, *(x.replace("'", "''") for x in template))
    for number, template in enumerate(licenses.TEMPLATES)
)

_MARK = "(?m)" + licenses.MARK.replace("'", "''")
_WORDS_OF = """string_split(trim(regexp_replace(lower({}), '[^\\p{{L}}\\p{{N}}]+', ' ', 'g')), ' ')"""
_PAIRS_OF = "list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])"
_HIT = "STRUCT(start BIGINT, stop BIGINT, common BIGINT, dice DOUBLE, ord INTEGER, name VARCHAR)"
_FOUND = "STRUCT(dice DOUBLE, ord INTEGER, name VARCHAR)[]"
# The found licences with one more hit: the best of each name.
_WITH = """CASE WHEN len(list_filter({0}.found, lambda f: f.name = {0}.top.name AND f.dice >= {0}.top.dice)) > 0
    THEN {0}.found ELSE list_append(list_filter({0}.found, lambda f: f.name <> {0}.top.name),
        struct_pack(dice := {0}.top.dice, ord := {0}.top.ord, name := {0}.top.name)) END"""
_CLASH = """s.top IS NOT NULL AND 2 * (least(s.top.stop, h.top.stop) - greatest(s.top.start, h.top.start))
    >= least(s.top.stop - s.top.start, h.top.stop - h.top.start)"""
_WORTH = "struct_pack(c := {0}.top.common, d := {0}.top.dice, o := {0}.top.ord)"

OP8_SQL = f"""
WITH templates(ord, name, title, body) AS (VALUES
    {_TEMPLATES}
), docs AS (
    SELECT row_number() OVER () AS r, doc_id, text FROM documents
), units AS (
    SELECT DISTINCT r, unnest(list_concat(string_split(text, chr(10)),
        regexp_split_to_array(text, '\n[ \t]*\n'),
        CASE WHEN regexp_matches(text, '{_MARK}$') THEN
            regexp_split_to_array(regexp_replace(text, '{_MARK}', '', 'g'), '\n[ \t]*\n')
        ELSE [] END, [text])) AS unit
    FROM docs WHERE text IS NOT NULL
), texts AS (
    SELECT r, NULL AS ord, unit AS body FROM units
    UNION ALL SELECT NULL, ord, body FROM templates
), words AS (
    SELECT r, ord, {_WORDS_OF.format("body")} AS w FROM texts
), pairs AS (
    SELECT DISTINCT r, ord, list_sort(list_distinct({_PAIRS_OF})) AS p FROM words WHERE len(w) > 1
), unit_pairs AS (
    SELECT r, row_number() OVER () AS u, p, len(p) AS a FROM pairs WHERE ord IS NULL
), template_pairs AS (
    SELECT ord, p AS q, len(p) AS b FROM pairs WHERE ord IS NOT NULL
), dices AS (
    SELECT r, u, ord, 2.0::DOUBLE * len(list_intersect(p, q)) / (a + b) AS dice
    FROM unit_pairs JOIN template_pairs
      ON 2.0::DOUBLE * least(a, b) / (a + b) >= 0.8
), best AS (
    SELECT r, max(struct_pack(dice := dice, ord := ord)) AS m
    FROM dices WHERE dice >= 0.8 GROUP BY r, u
), by_unit AS (
    SELECT r, m.dice AS dice, m.ord AS ord, name FROM best JOIN templates ON templates.ord = m.ord
), ordered AS (
    SELECT r, {_PAIRS_OF} AS p FROM (SELECT r, {_WORDS_OF.format("text")} AS w FROM docs) WHERE len(w) > 1
), known AS (
    SELECT ord, name, p[1] AS head, len(p) AS size_all, list_distinct(p) AS q, len(list_distinct(p)) AS b,
           greatest(len(p) // {licenses.STEPS}, 1) AS step
    FROM (SELECT ord, name, {_PAIRS_OF} AS p
          FROM (SELECT ord, name, {_WORDS_OF.format("body")} AS w FROM templates) WHERE len(w) > 1)
), near AS (
    SELECT *, len(p) - size_all + 1 AS last FROM (
        SELECT *, len(list_intersect(d, q)) AS c
        FROM (SELECT r, p, list_distinct(p) AS d FROM ordered) JOIN known ON len(p) >= size_all)
    WHERE 2 * c >= 0.8 * (c + b)
), places AS (
    SELECT DISTINCT r, ord, unnest(list_transform(list_filter(range(1, len(p) + 1), lambda i:
        list_contains(q, p[i]) AND (i = 1 OR p[i] = head OR i % step = 0 OR NOT list_contains(q, p[i - 1]))),
        lambda i: least(i, last))) AS i
    FROM near
), runs AS (
    SELECT r, ord, name, i, size_all, b, q, list_distinct(p[i : i + size_all - 1]) AS run
    FROM places JOIN near USING (r, ord)
), hits AS (
    SELECT *, 2.0::DOUBLE * common / (len(run) + b) AS dice
    FROM (SELECT *, len(list_intersect(run, q)) AS common FROM runs)
), listed AS (
    SELECT r, list(struct_pack(top := struct_pack(start := i, stop := i + size_all, common := common,
                   dice := dice, ord := ord, name := name)::{_HIT}, found := []::{_FOUND})
                   ORDER BY i, i + size_all, common, dice, ord) AS hits
    FROM hits WHERE dice >= 0.8 GROUP BY r
), folded AS (
    SELECT r, list_reduce(hits, lambda s, h: struct_pack(
        top := CASE WHEN {_CLASH} AND NOT {_WORTH.format("h")} > {_WORTH.format("s")} THEN s.top ELSE h.top END,
        found := CASE WHEN s.top IS NULL OR ({_CLASH}) THEN s.found ELSE {_WITH.format("s")} END
        ), struct_pack(top := NULL::{_HIT}, found := []::{_FOUND})) AS s
    FROM listed
), by_run AS (
    SELECT r, unnest({_WITH.format("s")}) AS f FROM folded
), every AS (
    SELECT * FROM by_unit
    UNION ALL SELECT r, f.dice, f.ord, f.name FROM by_run
    WHERE (r, f.name) NOT IN (SELECT (r, name) FROM by_unit)
), own AS (
    SELECT * FROM every WHERE name <> 'BSD' OR r NOT IN (
        SELECT r FROM every WHERE name IN ('BSD-2-Clause', 'BSD-3-Clause'))
), by_doc AS (
    SELECT r, max(struct_pack(dice := dice, ord := ord)) AS m,
           string_agg(DISTINCT name, ',' ORDER BY name) AS licenses, count(*) AS n
    FROM own GROUP BY r
)
SELECT doc_id, name AS license, title AS template, m.dice AS dice,
       coalesce(licenses, '') AS licenses, coalesce(n, 0) AS n_units
FROM docs LEFT JOIN by_doc USING (r) LEFT JOIN templates ON templates.ord = by_doc.m.ord
"""


def oracle_sql():
    return {"op1_warc": OP1_SQL, "op4_decontamination": OP4_SQL, "op8_licenses": OP8_SQL}
