import gzip
import hashlib
import io

import pytest

from podium.llm import warc

PAGES = "page_id long, url string, html string, record_type string, payload string"
LONG = "<p>long enough to be worth a revisit</p>" * 5


@pytest.fixture
def pages(spark):
    rows = [
        (7, "http://a/", LONG), (3, "http://b/", LONG), (3, "http://b/", LONG),
        (9, None, None), (1, "http://c/\r\nX: y", "short"), (2, "u", "short"),
        (4, "u", ""), (None, "u", LONG), (5, "ü", "größer " * 30000), (None, None, "only " * 40),
        (None, None, "only " * 40),
    ]
    return spark.createDataFrame([(*r, "a column", "of the same name") for r in rows], PAGES)


def test_round_trip(pages, tmp_path):
    got = warc.archived_pages(pages, str(tmp_path / "w")).collect()
    assert len(got) == 11
    for r in got:
        assert (r.record_type == "revisit") == (r.refers_to is not None)
    by = {}
    for r in got:
        by.setdefault(r.page_id, []).append(r)
    digest = hashlib.sha256(LONG.encode()).hexdigest()
    assert [(r.record_type, r.refers_to) for r in by[7]] == [("revisit", 3)]
    assert [(r.record_type, r.refers_to) for r in by[3]] == [("response", None)] * 2
    assert {r.payload_digest for r in by[7] + by[3]} == {digest}
    assert by[7][0].payload_bytes == len(LONG)
    assert by[9][0].payload_bytes == 0 and by[9][0].payload_digest == hashlib.sha256().hexdigest()
    assert by[1][0].record_type == by[2][0].record_type == "response"
    assert by[5][0].payload_bytes == len("größer ".encode()) * 30000
    # without page_id: refers to the smallest there is, else nothing to refer to
    assert sorted((r.record_type, r.refers_to) for r in by[None]) == [
        ("response", None), ("response", None), ("revisit", 3)
    ]


def test_empty(spark, tmp_path):
    assert warc.archived_pages(spark.createDataFrame([], PAGES), str(tmp_path / "w")).count() == 0


def test_files_rotate_and_read_in_any_chunk(pages, tmp_path):
    manifest = warc.write(warc.page_records(pages), str(tmp_path / "w"), file_bytes=1)
    assert manifest.count() == 11
    rows = [sorted(map(str, warc.read(manifest, chunk).collect())) for chunk in (7, 1 << 16)]
    assert rows[0] == rows[1] and len(rows[0]) == 11


def test_what_no_manifest_names_is_not_read(pages, tmp_path):
    manifest = warc.write(warc.page_records(pages), str(tmp_path / "w"))
    (tmp_path / "w" / "left-behind.warc.gz").write_bytes(b"half a mem")
    assert warc.read(manifest).count() == 11


def _record(payload=b"<html>", **change):
    fields = dict(
        record_id="urn:x:1", url="http://a/", payload=payload, payload_bytes=len(payload),
        digest=hashlib.sha256(payload).hexdigest(), refers_to=None, date="2024-01-01T00:00:00Z",
    )
    return warc.record(**(fields | change))


def test_gzip_reads_each_member(tmp_path):
    data = warc._member(_record(), 6) + warc._member(_record(b"second"), 6)
    assert gzip.decompress(data).count(b"WARC/1.1") == 2
    found = list(warc.read_archive(io.BytesIO(data), chunk=5))
    assert [r["payload_bytes"] for r in found] == [6, 6]
    second = data[found[1]["offset"] : found[1]["offset"] + found[1]["length"]]
    assert next(warc.read_archive(io.BytesIO(second)))["payload_digest"] == found[1]["payload_digest"]


@pytest.mark.parametrize(
    "data",
    [
        warc._member(_record(digest="0" * 64), 6),
        warc._member(_record(payload_bytes=5), 6),
        warc._member(_record().replace(b"<html>", b"<HTML>"), 6),
        warc._member(_record() + b"more", 6),
        warc._member(_record()[:-6], 6),
        warc._member(_record(), 6)[:-9],
        warc._member(b"no record\r\n\r\n", 6),
        b"no gzip at all",
    ],
)
def test_bad_archives(data):
    with pytest.raises(warc.Bad):
        list(warc.read_archive(io.BytesIO(data)))
