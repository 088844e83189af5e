import random
import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from podium.llm import packing
from podium.llm.tokens import Encoder

PATH = public_tokenizers.path("byte_bpe_50k.json")


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(PATH)


def _ids(library, text, end):
    return np.array([*library.encode(text or "", add_special_tokens=False).ids, end], "<u4")


def _check(pieces, limit):
    """Sequences by id; every piece list must be gapless."""
    by = defaultdict(list)
    for r in pieces:
        by[r.sequence_id].append(r)
    for rows in by.values():
        rows.sort(key=lambda r: r.offset)
        at = 0
        for r in rows:
            assert r.offset == at and r.length > 0
            at += r.length
        assert at <= limit
    return by


def test_every_id_is_in_one_piece(real, library):
    docs, rows = real
    pieces = packing.pack(docs, PATH).collect()
    want = defaultdict(int)
    for i, t in rows:
        want[i, zlib.crc32(_ids(library, t, 1).tobytes())] += 1
    texts = defaultdict(list)
    for i, t in rows:
        texts[i].append(_ids(library, t, 1))
    sums = defaultdict(int)
    for r in pieces:
        fits = [x for x in texts[r.doc_id] if len(x) == r.doc_tokens]
        part = [zlib.crc32(x[r.start : r.start + r.length].tobytes()) for x in fits]
        assert r.ids_crc32 in part
        sums[r.doc_id] += r.length
    assert sums == {i: sum(map(len, xs)) for i, xs in texts.items()}
    sequences = _check(pieces, 2048)
    lengths = [sum(r.length for r in rows) for rows in sequences.values()]
    padding = sum(2048 - n for n in lengths if n & (n - 1))
    assert padding < 0.005 * sum(lengths)


def test_limits(docs, library):
    rand = random.Random(2)
    rows = [(i, " ".join(rand.choice(["a", "bb", "ccc"]) for _ in range(rand.randrange(0, 90)))) for i in range(300)]
    frame = docs(*rows).withColumnRenamed("source", "prompt").selectExpr(
        "doc_id", "text", "repeat('p ', cast(doc_id % 7 as int)) as prompt", "lang as start"
    )
    got = packing.pack(
        frame, PATH, max_tokens=64, max_segments=3, max_loss=50, prompt="prompt", pool_size=32, keep_ids=True
    ).collect()
    whole = {}
    for i, t in rows:
        head = library.encode("p " * (i % 7), add_special_tokens=False).ids
        whole[i] = len(head), [*head, *library.encode(t, add_special_tokens=False).ids, 1]
    for rows_ in _check(got, 64).values():
        assert len(rows_) <= 3
        loss = [max(0, r.start + r.length - max(r.start, whole[r.doc_id][0])) for r in rows_]
        assert sum(loss) <= 50
    back = defaultdict(dict)
    for r in got:
        back[r.doc_id][r.start] = r.ids
    for i, parts in back.items():
        assert sum((parts[k] for k in sorted(parts)), []) == whole[i][1]
    assert len(back) == 300


def test_dot_product_choice():
    packer = packing.Packer(100, 10, 100)
    pool = {"need": np.empty((0, 3)), "state": []}
    packing._add(pool, [(0, 0, 60, 0), (1, 0, 70, 0), (2, 0, 30, 0), (3, 0, 20, 0)], packer)
    assert packer.sequence(pool) == [(1, 0, 70), (2, 0, 30)]
    assert packer.sequence(pool) == [(0, 0, 60), (3, 0, 20)]
    assert packer.powers([(0, 0, 60), (3, 0, 20)]) == [[(0, 0, 60), (3, 0, 4)], [(3, 4, 20)]]


@pytest.mark.parametrize("tokens", range(1, 11))
def test_short_texts_leave_little_padding(docs, library, tokens):
    text = " a" * (tokens - 1)  # and the end id
    assert len(library.encode(text, add_special_tokens=False).ids) == tokens - 1
    got = packing.pack(docs(*[text] * 6000).coalesce(2), PATH)
    lengths = [sum(r.length for r in rows) for rows in _check(got.collect(), 2048).values()]
    padding = sum(2048 - n for n in lengths if n & (n - 1))
    assert sum(lengths) == 6000 * tokens and padding < 0.01 * sum(lengths)


def test_limits_must_be_positive(docs):
    with pytest.raises(ValueError):
        packing.pack(docs("a"), PATH, max_segments=0)


def test_empty(docs):
    assert packing.pack(docs(), PATH).count() == 0
    assert [tuple(r)[1:5] for r in packing.pack(docs(None), PATH).collect()] == [
        (0, 1, zlib.crc32(np.array([1], "<u4").tobytes()), 1)
    ]


def test_encoder_is_exact(library):
    rand = random.Random(4)
    parts = [" ", "  ", "\n", "a", "B", "é", "1", "'s", "'", ".", "!", "\t", "　", "😀", "<|endoftext|>", "_"]
    parts += ["Ⅷ", "½", "\x1c", "\x85", "ab", "ª", "́"]
    texts = ["".join(rand.choice(parts) for _ in range(rand.randrange(40))) for _ in range(1500)]
    for kept in (0, 100, 10_000):
        encode = Encoder(PATH, words_kept=kept)
        for at in range(0, len(texts), 300):
            got = encode.batch(texts[at : at + 300])
            want = library.encode_batch(texts[at : at + 300], add_special_tokens=False)
            assert [x.tolist() for x in got] == [e.ids for e in want]
        assert len(encode.words) <= max(kept, 1) + 20_000
    other = public_tokenizers.path("word_bpe_49k.json")  # not of the kind that tiktoken serves
    assert Encoder(other).ranked is None
