"""The stages against brute force, each on what its predecessor kept."""

import os
import zlib
from collections import defaultdict

import duckdb
import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

import __spark_entry__ as entry
import corpus_pipeline
from check import compare, duck
from podium.llm import decontaminate, quality
from podium.llm.common import stored

from .conftest import SF_DIR
from .test_decontaminate import _brute, _words
from .test_simhash import _fingerprint, _groups

pytestmark = pytest.mark.skipif(not os.path.isdir(SF_DIR), reason="no test tables")


def _rows(frame):
    return [(r["doc_id"], r["text"]) for r in frame.collect()]


def test_stages(spark):
    docs = spark.read.parquet(f"{SF_DIR}/documents.parquet")
    kept = []
    for name, stage in corpus_pipeline.STAGES:
        out = stored(stage(spark, docs, SF_DIR), name)
        if name != "pack":
            assert out.columns == docs.columns
        kept.append((_rows(docs), out))
        docs = out

    before, out = kept[0]
    labels = spark.read.parquet(f"{SF_DIR}/labels.parquet")
    model = quality.fit(spark.read.parquet(f"{SF_DIR}/documents.parquet"), labels)
    measure = quality.Measure(model.bad, model.good)
    good = [(i, t) for i, t in before if 1 / (1 + np.exp(-(measure(t) * model.slope + model.bias))) >= 0.3]
    assert sorted(_rows(out)) == sorted(good) and good

    before, out = kept[1]
    group = _groups([_fingerprint(t) for _, t in before])
    least = defaultdict(lambda: 1 << 62)
    for (i, _), g in zip(before, group, strict=True):
        least[g] = min(least[g], i)
    assert sorted(_rows(out)) == sorted((i, t) for (i, t), g in zip(before, group, strict=True) if least[g] == i)
    assert len(_rows(out)) < len(before)

    before, out = kept[2]
    items = [tuple(r) for r in spark.read.parquet(f"{SF_DIR}/benchmark.parquet").collect()]
    after = dict(_rows(out))
    for i, t in before:
        n, hit, *_ = _brute(t, items)
        if not hit:
            assert after[i] == t
        elif hit > n / 2:
            assert i not in after
        else:
            assert not _brute(after[i], items)[1] and len(_words(after[i])) <= n - hit
    assert any(after.get(i) != t for i, t in before)

    before, out = kept[3]
    library = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    ids = {i: np.array([*library.encode(t, add_special_tokens=False).ids, 1], "<u4") for i, t in before}
    pieces = out.collect()
    for r in pieces:
        assert r.ids_crc32 == zlib.crc32(ids[r.doc_id][r.start : r.start + r.length].tobytes())
    assert sum(r.length for r in pieces) == sum(map(len, ids.values()))


def test_run_gives_the_last_stage(spark):
    got = entry.queries()["pipeline"](spark, SF_DIR)
    assert got.columns[:3] == ["doc_id", "start", "length"] and got.count() > 0


@pytest.mark.parametrize("empty", ["documents", "labels", "benchmark"])
def test_empty_tables(spark, tmp_path, empty):
    for name in ("documents", "labels", "benchmark"):
        rows = spark.read.parquet(f"{SF_DIR}/{name}.parquet").limit(0 if name == empty else 40)
        rows.write.parquet(str(tmp_path / f"{name}.parquet"))
    got = corpus_pipeline.run(spark, str(tmp_path))
    assert (got.count() == 0) == (empty == "documents")


@pytest.mark.parametrize("name", ["op1_warc", "op4_decontamination", "op8_licenses"])
def test_query_against_sql(spark, name):
    verdict, _ = compare(
        spark, duck(SF_DIR), SF_DIR, name, entry.queries()[name], entry.oracle_sql()[name]
    )
    assert verdict.startswith("ok"), verdict


def test_contamination_of_the_whole_table(spark):
    con = duckdb.connect()
    n = con.execute(f"SELECT count(*) FROM '{SF_DIR}/documents.parquet'").fetchone()[0]
    docs = spark.read.parquet(f"{SF_DIR}/documents.parquet")
    found = decontaminate.contamination(docs, spark.read.parquet(f"{SF_DIR}/benchmark.parquet"))
    assert found.count() == n
