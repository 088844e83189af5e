"""Token ids of texts by a tokenizer file, with the ids of known words remembered.

Words between single spaces are encoded on their own: a byte-level tokenizer's split into words
never looks across a space that has other than white space on both sides. What it gives for a word
is kept, so only words that are new to a Python worker are encoded. Where the file is a plain
byte-level BPE whose ids follow the order of its merges, which is checked, ``tiktoken`` with the
same vocabulary gives the same ids of a new word as ``tokenizers`` in a third of the time. All
else, words with special tokens too, goes to ``tokenizers``.
"""

import json
import re
from array import array
from pathlib import Path

import numpy as np
import tiktoken
from tokenizers import Tokenizer

WORDS_KEPT = 300_000
AT_ONCE = 1 << 21  # characters cut into words at once
SPACE = re.compile(r" (?=\S)(?<=\S )")
# The byte-level split into words (a published pattern, fixed).
PATTERN = (
    r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
)


def _byte_letters():
    """The letter that stands for each byte in byte-level vocabularies."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    others = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(others)}


def _ranked(path):
    """A tiktoken encoding with the same ids, or None where the file does not allow it."""
    made = json.loads(Path(path).read_text())
    model, split = made["model"], made["pre_tokenizer"] or {}
    plain = (
        model.get("type") == "BPE"
        and not any(model.get(k) for k in ("dropout", "byte_fallback", "ignore_merges"))
        and not any(model.get(k) for k in ("continuing_subword_prefix", "end_of_word_suffix"))
        and made["normalizer"] is None
        and split.get("type") == "ByteLevel"
        and split.get("use_regex")
        and not split.get("add_prefix_space")
        and all(t["special"] and not (t["lstrip"] or t["rstrip"]) for t in made["added_tokens"])
    )
    if not plain:
        return None
    byte, vocab = _byte_letters(), model["vocab"]
    pairs = (m if isinstance(m, list) else m.split(" ") for m in model["merges"])
    if any(vocab.get("".join(pair)) != 256 + i for i, pair in enumerate(pairs)):
        return None
    special = {t["content"] for t in made["added_tokens"]}
    ranks = {bytes(byte[c] for c in t): i for t, i in vocab.items() if t not in special}
    return tiktoken.Encoding(path, pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


class Encoder:
    """The ids ``tokenizers`` gives for the file at ``path``, without begin or end tokens."""

    def __init__(self, path, words_kept=WORDS_KEPT):
        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.ranked = _ranked(path)
        self.words_kept = words_kept
        self.words = {}

    def _encode(self, words):
        """The ids of each word, as bytes of little-endian uint32."""
        quick = self.ranked.encode_ordinary if self.ranked else None
        slow = words
        known = {}
        if quick:
            every = "\0".join(words)
            special = [s for s in self.special if s in every]
            slow = [w for w in words if any(s in w for s in special)] if special else []
            known = {w: array("I", quick(w)).tobytes() for w in words}
        found = self.tokenizer.encode_batch_fast(slow, add_special_tokens=False)
        return known | {w: array("I", e.ids).tobytes() for w, e in zip(slow, found, strict=True)}

    def _parts(self, text):
        """The text cut before spaces with other than white space on both sides; its new words."""
        line = text.split(" ")
        new = set(line[1:]).difference(self.words)
        edge = line[0][-1:]
        # Words with white space at an edge are never kept, so they are always among the new.
        if len(line) > 1 and (
            not edge or edge.isspace() or any(not w or w.strip() != w for w in new)
        ):
            line = SPACE.split(text)
            new = set(line[1:]).difference(self.words)
        return line, new

    def batch(self, texts):
        """The ids of each text as little-endian uint32 arrays."""
        out, some, size = [], [], 0
        for text in texts:
            some.append("" if text is None else text)
            size += len(some[-1])
            if size >= AT_ONCE:
                out += self._some(some)
                some, size = [], 0
        return out + self._some(some)

    def _some(self, texts):
        cut = [self._parts(t) for t in texts]
        words = self.words
        known = self._encode([" " + w for w in set().union(*(new for _, new in cut))])
        fresh = {w[1:]: ids for w, ids in known.items()}
        words.update(fresh)
        firsts = self._encode(list({line[0] for line, _ in cut}))
        out = [
            np.frombuffer(firsts[line[0]] + b"".join(map(words.__getitem__, line[1:])), "<u4")
            for line, _ in cut
        ]
        if len(words) > self.words_kept:  # those met first stay, the frequent ones
            for word in fresh:
                del words[word]
        return out


_encoders = {}


def encoder(path):
    """The encoder of a file, made once in each Python worker."""
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]
