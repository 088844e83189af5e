"""Token counts by a finite-state transducer compiled from a BPE tokenizer file.

Reading a word byte by byte, all that the rest of its tokens depends on is which token ends at each
of the last few bytes. These windows are the states of a deterministic transducer; a transition
carries how many tokens the word so far gains by the byte. It rests on two facts about BPE: the
tokens of a word without the last are the tokens of that part alone, and a sequence of tokens is
the BPE result just when each neighbouring pair is. States are made when first met.

A text is cut into chunks anywhere. Between words the transducer is in its first state whatever came
before, so a chunk's state map says what it does to an unfinished word: it lengthens it, or closes it,
counts the words inside, and leaves another unfinished. Words end at white space and wherever the
tokenizer's own pattern parts two characters, so texts without white space have maps as short. The maps
compose associatively, so they are scanned like sums. Only a word that goes on over chunks, letters or
signs alone, is put together again and read in one go.
"""

import json
import re
import unicodedata
from functools import reduce
from pathlib import Path
from typing import NamedTuple

import pyarrow as pa
import regex
from pyspark.sql import types as T

from podium.llm.common import mapped, utf8

CHUNK = 1 << 16  # characters mapped at once
STATES_KEPT = 200_000
WORDS_KEPT = 500_000


def _byte_letters():
    """The letter that stands for each byte in byte-level vocabularies."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    others = [b for b in range(256) if b not in plain]
    return {b: chr(b) for b in plain} | {b: chr(256 + i) for i, b in enumerate(others)}


class State(NamedTuple):
    """The last letters of a word so far, and for the places before, between and after them the
    token that ends there (None: the word begins) and its count less the count at the end."""

    letters: str
    tokens: tuple
    counts: tuple


NOT_MADE = (-1, None, None)  # of tokens that no merge makes
START = State("", (None,), (0,))


class Transducer:
    """count(word): the number of BPE tokens of a word, given as letters that stand for bytes."""

    def __init__(self, vocab, merges, end, states_kept=STATES_KEPT):
        self.vocab, self.end = vocab, end
        self.ranks = {tuple(pair): rank for rank, pair in enumerate(merges)}
        self.made = {a + b: (rank, a, b) for rank, (a, b) in reversed([*enumerate(merges)])}
        self.sizes = self._sizes()
        self.longest = max(size for sizes in self.sizes.values() for size in sizes)
        self.states_kept = states_kept
        self.alone, self.followers = {}, {}
        self.numbers, self.states = {START: 0}, [START]
        self.moves, self.ends = [{}], [{}]

    def merged(self, symbols):
        """BPE as it is defined: of the pairs that merge, the lowest rank first, leftmost first."""
        symbols = list(symbols)
        while len(symbols) > 1:
            ranks = [self.ranks.get(p) for p in zip(symbols, symbols[1:], strict=False)]
            known = [(rank, i) for i, rank in enumerate(ranks) if rank is not None]
            if not known:
                break
            _, at = min(known)
            symbols[at : at + 2] = [symbols[at] + symbols[at + 1]]
        return symbols

    def _sizes(self):
        """By the last two letters and whether a word ends: the sizes of such tokens, long first."""
        found = {}
        for token in self.vocab:
            for last in (False, True):
                body = token.removesuffix(self.end) if last else token
                if body and (not last or body != token):
                    for tail in {body[-1:], body[-2:]}:
                        found.setdefault((tail, last), set()).add(len(body))
        return {
            (tail, last): sorted({*sizes, 1}, reverse=True) for (tail, last), sizes in found.items()
        }

    def _alone(self, token, last):
        """Whether a token is what BPE makes of its own letters."""
        key = token, last
        if key not in self.alone:
            symbols = [*token[:-1], token[-1] + self.end] if last else token
            self.alone[key] = self.merged(symbols) == [token + self.end * last]
        return self.alone[key]

    def apart(self, left, right):
        """Whether BPE leaves two tokens side by side.

        Their merges are undone from the last on. The symbols that then meet at the seam must not
        have a merge that would have come before the one undone.
        """
        until = len(self.ranks)
        while True:
            if self.ranks.get((left, right), until) < until:
                return False
            a, b = self.made.get(left, NOT_MADE), self.made.get(right, NOT_MADE)
            if a[0] < 0 and b[0] < 0:
                return True
            if a[0] > b[0]:
                until, left = a[0], a[2]
            else:  # of equal merges the left one is made first, so the seam comes before this one
                until, right = b[0] + 1, b[1]

    def _stands(self, before, token, last):
        """Whether ``token`` can follow ``before``, or begin a word where that is None."""
        if before is None:
            return self._alone(token, last)
        key = before, token, last
        if key not in self.followers:
            if len(self.followers) > 2 * self.states_kept:
                self.followers.clear()
            ended = token + self.end * last
            self.followers[key] = self._alone(token, last) and self.apart(before, ended)
        return self.followers[key]

    def _token(self, state, letter, last):
        """The token that ends with ``letter`` and the tokens gained by it."""
        run, end = state.letters + letter, self.end * last
        room = len(run)
        for size in self.sizes.get((run[-2:], last), ()) or self.sizes.get((letter, last), ()):
            if size <= room and run[-size:] + end in self.vocab:
                if self._stands(state.tokens[room - size], run[-size:], last):
                    return run[-size:], state.counts[room - size] + 1
        raise ValueError(f"the tokenizer has no token for {letter!r}")

    def _step(self, state, letter):
        token, gained = self._token(state, letter, False)
        keep = self.longest - 1
        letters = (state.letters + letter)[-keep:]
        tokens = (*state.tokens, token)[-len(letters) - 1 :]
        counts = (*(c - gained for c in state.counts), 0)[-len(letters) - 1 :]
        return State(letters, tokens, counts), gained

    def _number(self, state):
        """The number of a state; None when it is new and there are enough of them."""
        number = self.numbers.get(state)
        if number is None and len(self.states) < self.states_kept:
            number = self.numbers[state] = len(self.states)
            self.states.append(state)
            self.moves.append({})
            self.ends.append({})
        return number

    def count(self, word):
        at, total, moves = 0, 0, self.moves
        for place, letter in enumerate(word[:-1]):
            move = moves[at].get(letter)
            if move is None:
                state, gained = self._step(self.states[at], letter)
                number = self._number(state)
                if number is None:
                    return total + gained + self._unkept(state, word[place + 1 :])
                move = moves[at][letter] = number, gained
            at = move[0]
            total += move[1]
        gained = self.ends[at].get(word[-1])
        if gained is None:
            gained = self.ends[at][word[-1]] = self._token(self.states[at], word[-1], True)[1]
        return total + gained

    def _unkept(self, state, rest):
        """The count of the rest of a word whose states are not kept."""
        total = 0
        for letter in rest[:-1]:
            state, gained = self._step(state, letter)
            total += gained
        return total + self._token(state, rest[-1], True)[1]


class Map(NamedTuple):
    """What a chunk does: ``head`` ends the word before it; None if the chunk is inside a word."""

    head: str | None
    inside: int
    tail: str


class Counter:
    """Counts tokens as ``tokenizers`` does for a file of word BPE with an end-of-word suffix."""

    def __init__(self, path, words_kept=WORDS_KEPT, chunk=CHUNK):
        made = json.loads(Path(path).read_text())
        model, split = made["model"], (made["pre_tokenizer"] or {}).get("pretokenizers", [])
        steps = [n["type"] for n in (made["normalizer"] or {}).get("normalizers", [])]
        if (
            model["type"] != "BPE"
            or not model["end_of_word_suffix"]
            or any(model[k] for k in ("dropout", "byte_fallback", "ignore_merges", "unk_token"))
            or steps != ["NFC", "Replace", "Lowercase"]
            or [p["type"] for p in split] != ["Split", "ByteLevel"]
            or any(t["normalized"] or t["lstrip"] or t["rstrip"] for t in made["added_tokens"])
        ):
            raise ValueError(f"{path} is not a lower-casing word BPE")
        merges = [m if isinstance(m, list) else m.split(" ") for m in model["merges"]]
        self.bpe = Transducer(model["vocab"], merges, model["end_of_word_suffix"])
        self.letters = _byte_letters()
        self.pattern = regex.compile(split[0]["pattern"]["Regex"])
        special = "|".join(re.escape(t["content"]) for t in made["added_tokens"])
        self.special = re.compile(f"({special})") if special else None
        self.longest_special = max([0, *(len(t["content"]) for t in made["added_tokens"])])
        self.chunk, self.words_kept, self.words = chunk, words_kept, {}

    def _plain(self, text):
        """Tokens of a text without white space and special tokens."""
        text = unicodedata.normalize("NFC", text)
        # Letter by letter: the sigma that ends a word is lower-cased like any other.
        text = "".join(c.lower() for c in text) if "\u03a3" in text else text.lower()
        words = self.pattern.findall(text)
        return sum(self.bpe.count(w.encode().decode("latin-1").translate(self.letters)) for w in words)

    def word(self, text):
        """Tokens of a text without white space."""
        if self.special is None or "<" not in text:
            return self._plain(text)
        parts = self.special.split(text)
        return len(parts) // 2 + sum(self._plain(p) for p in parts[::2])

    def words_in(self, words):
        """Tokens of many texts without white space."""
        known = self.words
        new = {w: self.word(w) for w in set(words).difference(known)}
        known.update(new)
        total = sum(map(known.__getitem__, words))
        if len(known) > self.words_kept:  # those met first stay, the frequent ones
            for w in new:
                del known[w]
        return total

    def map(self, text):
        """The state map of a chunk."""
        words = text.split() if not SEPARATORS.search(text) else WHITE.split(text)
        if len(words) == 1 and len(words[0]) == len(text):
            cuts = [m.start() for m in PARTED.finditer(text)]
            if not cuts:
                return Map(None, 0, text)
            inside = self.word(text[cuts[0] : cuts[-1]])
            return Map(text[: cuts[0]], inside, text[cuts[-1] :])
        words = [w for w in words if w]
        head = words.pop(0) if words and not WHITE.match(text) else ""
        tail = words.pop() if words and not WHITE.match(text[-1]) else ""
        return Map(head, self.words_in(words), tail)

    def compose(self, a, b):
        """The map of two neighbouring chunks; associative."""
        if b.head is None:
            return Map(a.head, a.inside, a.tail + b.tail)
        if a.head is None:
            return Map(a.tail + b.head, b.inside, b.tail)
        return Map(a.head, a.inside + self.words_in([a.tail + b.head] if a.tail or b.head else []) + b.inside, b.tail)

    def count(self, text):
        if not text:
            return 0
        chunks = [text[i : i + self.chunk] for i in range(0, len(text), self.chunk)]
        whole = scanned([self.map(c) for c in chunks], self.compose)
        ends = [whole.tail] if whole.head is None else [whole.head, whole.tail]
        return whole.inside + self.words_in([w for w in ends if w])


# White space of the tokenizer's pattern. Python's own also has the four separators below.
WHITE = regex.compile(r"[\p{Z}\t-\r\x85]+")
SEPARATORS = re.compile("[\x1c-\x1f]")
# Places where the pattern always parts a text without white space: at a digit, and between a letter and
# a sign, but for the signs of short forms and special tokens. All ASCII, so no accent joins across them.
_SIGNS = r"!\"#$%&()*+,\-./:;=?@\[\\\]^_`{}~"
PARTED = re.compile(
    rf"(?<=[0-9])(?=[0-9A-Za-z{_SIGNS}])|(?<=[A-Za-z{_SIGNS}])(?=[0-9])"
    rf"|(?<=[A-Za-z])(?=[{_SIGNS}])|(?<=[{_SIGNS}])(?=[A-Za-z])"
)


def scanned(maps, compose):
    """The composition of all maps, neighbours first, as a parallel scan would do it."""
    while len(maps) > 1:
        pairs = [reduce(compose, maps[i : i + 2]) for i in range(0, len(maps), 2)]
        maps = pairs
    return maps[0]


_counters = {}


def counter(path):
    """The counter of a file, compiled once in each Python worker."""
    if path not in _counters:
        _counters[path] = Counter(path)
    return _counters[path]


def token_counts(docs, tokenizer, limit=2048):
    """doc_id, n_bytes, n_tokens and over_limit of every whole text of ``docs`` (doc_id, text).

    Begin, end and other added tokens are not counted; special tokens written in a text count one
    each. Null and empty texts have no tokens. Repeated rows are each answered, rows without doc_id
    too, and an empty table gives no rows.
    """

    def measure(batches):
        count = counter(tokenizer).count
        for batch in batches:
            texts = batch.column("text").to_pylist()
            found = [count(t) for t in texts]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("doc_id"),
                    pa.array([len(utf8(t)) for t in texts], pa.int64()),
                    pa.array(found, pa.int64()),
                    pa.array([n > limit for n in found], pa.bool_()),
                ],
                ["doc_id", "n_bytes", "n_tokens", "over_limit"],
            )

    rows = docs.select("doc_id", "text")
    schema = T.StructType(
        [
            rows.schema["doc_id"],
            T.StructField("n_bytes", T.LongType()),
            T.StructField("n_tokens", T.LongType()),
            T.StructField("over_limit", T.BooleanType()),
        ]
    )
    return mapped(rows, measure, schema)
