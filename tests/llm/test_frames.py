import io
import zlib

import numpy as np
import public_tokenizers
import pytest
import zstandard
from tokenizers import Tokenizer

from podium.llm import frames

PATH = public_tokenizers.path("byte_bpe_50k.json")


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(PATH)


def _ids(library, text):
    return np.array([*library.encode(text or "", add_special_tokens=False).ids, 2], "<u4")


@pytest.mark.parametrize("sizes", [{}, {"file_ids": 20_000, "frame_ids": 100}])
def test_round_trip(real, library, tmp_path, sizes):
    docs, rows = real
    manifest = frames.write(docs, str(tmp_path / "t"), PATH, 2, **sizes)
    got = sorted(frames.read(manifest).collect(), key=lambda r: r.start)
    names = [r.doc_id for r in got]
    assert names[0] is None and names[1:] == sorted(i for i, _ in rows if i is not None)
    want = sorted((str(i), len(x), zlib.crc32(x.tobytes())) for i, x in ((i, _ids(library, t)) for i, t in rows))
    assert sorted((str(r.doc_id), r.n_tokens, r.ids_crc32) for r in got) == want
    at = 0
    for r in got:
        assert r.start == at
        at += r.n_tokens
    assert at == manifest.agg({"ids": "sum"}).first()[0]


def test_fetch_unpacks_wanted_documents(real, library, spark, tmp_path):
    docs, rows = real
    manifest = frames.write(docs, str(tmp_path / "t"), PATH, 2, file_ids=20_000, frame_ids=1000)
    wanted = spark.createDataFrame([(3,), (10_007,), (10_008,), (77_777,)], "doc_id long")
    got = sorted((r.doc_id, r.ids) for r in frames.fetch(manifest, wanted).collect())
    assert got == sorted((i, _ids(library, t).tolist()) for i, t in rows if i in (3, 10_007, 10_008))


def _file(frame_ids=10):
    out = io.BytesIO()
    out.close = lambda: None
    writer = frames.Writer(out, frame_ids)
    for i, n in ((1, 3), (2, 0), (None, 25), (9, 2)):
        writer.add(i, np.arange(n, dtype="<u4") + 100 * n)
    writer.close()
    return out.getvalue()


def test_only_the_frames_of_a_document_are_read():
    data = _file()
    reader = frames.Reader(io.BytesIO(data), len(data))
    assert reader.doc_ids == [1, 2, None, 9] and [list(reader.frames_of(d)) for d in range(4)] == [[0], [], [0, 1, 2], [2]]
    assert reader.ids(2).tolist() == list(range(2500, 2525)) and reader.ids(3).tolist() == [200, 201]
    assert len(reader.ids(1)) == 0


def test_any_zstandard_reader_reads_the_ids():
    read = zstandard.ZstdDecompressor().stream_reader(io.BytesIO(_file()), read_across_frames=True)
    assert np.frombuffer(read.read(), "<u4")[:4].tolist() == [300, 301, 302, 2500]


@pytest.mark.parametrize("place", [3, 60, -5, -12, -30])
def test_damage_is_noticed(place):
    data = bytearray(_file())
    data[place] ^= 0x40
    with pytest.raises((frames.Bad, zstandard.ZstdError)):
        reader = frames.Reader(io.BytesIO(bytes(data)), len(data))
        [reader.ids(d) for d in range(4)]


def test_empty(docs, tmp_path):
    assert frames.round_trip(docs(), PATH, 2, str(tmp_path / "t")).count() == 0
