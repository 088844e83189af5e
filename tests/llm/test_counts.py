import random

import public_tokenizers
import pytest
from tokenizers import Tokenizer

from podium.llm import counts

PATH = public_tokenizers.path("word_bpe_49k.json")


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(PATH)


@pytest.fixture(scope="module")
def made():
    return counts.Counter(PATH)


def _texts():
    rand = random.Random(8)
    parts = [" ", "  ", "\n", "a", "B", "é", "1", "'s", "'", "'LL", ".", "!", "\t", "　", "😀", "_", "İ", "Σ"]
    parts += ["<|endoftext|>", "<|startoftext|>", "<|end", "ς", "Ⅷ", "½", "²", "ª", "́", "\x1c", "\x85", "한", "the", "ing"]
    mixed = ["".join(rand.choice(parts) for _ in range(rand.randrange(40))) for _ in range(1200)]
    return mixed + ["".join(rand.choice("etaoinshrdlu") for _ in range(rand.randrange(1, 70))) for _ in range(1200)]


@pytest.mark.parametrize("chunk", [1, 3, 17, 1 << 16])
def test_counts_match_the_library(library, made, chunk):
    texts = _texts()
    made.chunk = chunk
    want = [len(e) for e in library.encode_batch(texts, add_special_tokens=False)]
    assert [made.count(t) for t in texts] == want


def test_few_states_and_words_are_enough(library):
    small = counts.Counter(PATH, words_kept=10)
    small.bpe.states_kept = 50
    texts = _texts()[::4]
    assert [small.count(t) for t in texts] == [len(library.encode(t, add_special_tokens=False)) for t in texts]
    assert len(small.bpe.states) <= 50 and len(small.words) <= 10


def test_seams_agree_with_the_merges(made):
    rand = random.Random(3)
    bpe = made.bpe
    plain = [t for t in bpe.vocab if not t.endswith(bpe.end) and bpe._alone(t, False)]
    for _ in range(3000):
        a, b = rand.choice(plain), rand.choice(plain)
        assert bpe.apart(a, b) == (bpe.merged(a + b) == [a, b])


def test_maps_compose_in_any_grouping(made):
    text = "one two<|endoftext|>three\n four  five's " * 5
    for size in (1, 2, 5, 9):
        maps = [made.map(text[i : i + size]) for i in range(0, len(text), size)]
        left = maps[0]
        for m in maps[1:]:
            left = made.compose(left, m)
        assert left == counts.scanned(maps, made.compose)


def test_rows(real, library):
    docs, rows = real
    got = counts.token_counts(docs, PATH).collect()
    want = []
    for i, t in rows:
        n = len(library.encode(t or "", add_special_tokens=False))
        want.append((i, len((t or "").encode()), n, n > 2048))
    assert sorted(map(str, want)) == sorted(str(tuple(r)) for r in got)


def test_empty_and_other_files(docs):
    assert counts.token_counts(docs(), PATH).count() == 0
    with pytest.raises(ValueError):
        counts.Counter(public_tokenizers.path("byte_bpe_50k.json"))


def test_texts_without_white_space_compose(library, made):
    rand = random.Random(11)
    signs = "etaoin" * 3 + "ETAO0123456789'<|>.,;:!?/-_=+()[]{}@#$%^&*~`\"\\éΣ́한²"
    texts = ["".join(rand.choice(signs) for _ in range(rand.randrange(1, 400))) for _ in range(300)]
    texts += [t.replace("0", "<|endoftext|>").replace("1", "'s") for t in texts]
    want = [len(e) for e in library.encode_batch(texts, add_special_tokens=False)]
    for chunk in (2, 5, 64, 1 << 16):
        made.chunk = chunk
        assert [made.count(t) for t in texts] == want
    made.chunk = counts.CHUNK
    code = "".join(rand.choice("abcdefABCDEF0123456789+/") for _ in range(300_000))
    for at in range(0, len(code), made.chunk):
        found = made.map(code[at : at + made.chunk])
        assert found.head is not None and len(found.head) + len(found.tail) < 200
    assert made.count(code) == len(library.encode(code, add_special_tokens=False))


def test_names_that_clash(docs):
    clash = docs("one two", None).withColumnRenamed("lang", "n_tokens").withColumnRenamed("source", "n_bytes")
    assert sorted(r.n_tokens for r in counts.token_counts(clash, PATH).collect()) == [0, 2]
