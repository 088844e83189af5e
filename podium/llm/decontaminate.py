"""Benchmark decontamination with a generalised suffix automaton over words.

The automaton of all benchmark items recognises every run of words that occurs in any item. A
document's words are streamed through it; at each word the length of the longest run that ends
there is known, and with it which windows end there: ``window`` consecutive words of an item, or a
whole item of fewer words.
"""

import hashlib
import re
import uuid
from functools import reduce
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from podium.llm.common import free, mapped, stored, utf8

WINDOW = 10
BLOCK = 1 << 20  # bytes of a document split into words at once

_WORD = set(range(0x30, 0x3A)) | set(range(0x61, 0x7B)) | set(range(0x80, 0x100))
# Lower-cases A-Z and turns every byte that is in no word into a space.
WORD_BYTES = bytes(
    c if c in _WORD else c + 32 if 0x41 <= c <= 0x5A else 0x20 for c in range(256)
)
REST_OF_WORD = re.compile(rb"[0-9A-Za-z\x80-\xff]*")
ITEM_BYTES = 2 << 20  # bytes of item text in one automaton
SEGMENT = 50_000  # words of a long item handled as one


def words(data):
    return data.translate(WORD_BYTES).split()


class Automaton:
    """Generalised suffix automaton of items: {item id: words}."""

    def __init__(self, items, window=WINDOW):
        self.window = window
        self.next, self.link, self.length = [{}], [-1], [0]
        self.ids = {}
        ends, whole = [], []
        for item, run in items:
            if not run:
                continue
            last = 0
            for word in run:
                last = self._extend(last, self.ids.setdefault(word, len(self.ids)))
                ends.append((last, item))
            if len(run) < window:
                whole.append((last, item))
        self._mark(ends, whole)
        self.shortest = min([window, *(len(run) for _, run in items if run)])

    def _extend(self, last, c):
        nxt, link, length = self.next, self.link, self.length
        if c in nxt[last]:  # a run that another item has already
            q = nxt[last][c]
            return q if length[q] == length[last] + 1 else self._split(last, c, q)
        at = self._state({}, 0, length[last] + 1)
        p = last
        while p >= 0 and c not in nxt[p]:
            nxt[p][c] = at
            p = link[p]
        if p >= 0:
            q = nxt[p][c]
            link[at] = q if length[q] == length[p] + 1 else self._split(p, c, q)
        return at

    def _state(self, moves, link, length):
        self.next.append(moves)
        self.link.append(link)
        self.length.append(length)
        return len(self.next) - 1

    def _split(self, p, c, q):
        copy = self._state(dict(self.next[q]), self.link[q], self.length[p] + 1)
        while p >= 0 and self.next[p].get(c) == q:
            self.next[p][c] = copy
            p = self.link[p]
        self.link[q] = copy
        return copy

    def _mark(self, ends, whole):
        """Which items own the windows and short items that states stand for."""
        n = len(self.next)
        self.items = [None] * n
        for state, item in ends:
            if self.length[state] >= self.window:
                self.items[state] = (self.items[state] or set()) | {item}
        order = sorted(range(1, n), key=self.length.__getitem__)
        for state in reversed(order):  # a state's runs also end where those of its children end
            up = self.link[state]
            if self.items[state] and self.length[up] >= self.window:
                self.items[up] = (self.items[up] or set()) | self.items[state]
        self.whole = {}
        for state, item in whole:
            self.whole.setdefault(state, set()).add(item)
        # The state of the window that ends a run, and the nearest shorter run that is an item.
        self.ending, self.short = [0] * n, [0] * n
        for state in order:
            up = self.link[state]
            if self.length[state] >= self.window:
                longer = self.length[up] >= self.window
                self.ending[state] = self.ending[up] if longer else state
            self.short[state] = up if up in self.whole else self.short[up]

    def scan(self, codes, base, found, items):
        """Stream known words; append hit (start, end) to ``found`` and owners to ``items``."""
        nxt, link, length, window = self.next, self.link, self.length, self.window
        ending, short, whole = self.ending, self.short, self.whole
        state = run = 0
        for at, c in enumerate(codes, base + 1):
            to = nxt[state].get(c)
            if to is None:
                while state > 0 and c not in nxt[state]:
                    state = link[state]
                run = length[state]
                to = nxt[state].get(c, 0)
                run = run + 1 if to else 0
            else:
                run += 1
            state = to
            if run >= window:
                found.append((at - window, at))
                items.add((ending[state], True))
            if whole:
                w = state if state in whole and run >= length[state] else short[state]
                while w:
                    found.append((at - length[w], at))
                    items.add((w, False))
                    w = short[w]

    def owners(self, states):
        return set().union(*(self.items[s] if full else self.whole[s] for s, full in states))

    def hits(self, data):
        """(words, merged hit spans, owning items) of a document's bytes."""
        count, found, items = 0, [], set()
        tail = np.empty(0, np.int64)  # known words at the end of a block, which may go on
        for block in blocks(data):
            run = words(block)
            codes = np.fromiter(map(self.ids.get, run, repeat(-1)), np.int64, len(run))
            codes = np.concatenate((tail, codes))
            base, count = count - len(tail), count + len(run)
            known = np.flatnonzero(codes < 0)
            starts, ends = np.append(0, known + 1), np.append(known, len(codes))
            tail = codes[starts[-1]:][-(self.window - 1) or len(codes):]
            for a in np.flatnonzero(ends - starts >= self.shortest):
                self.scan(codes[starts[a]:ends[a]].tolist(), base + int(starts[a]), found, items)
        return count, merged(found), self.owners(items)


def blocks(data):
    """The bytes in pieces of about ``BLOCK``, cut where no word goes on."""
    at = 0
    while len(data) - at > BLOCK:
        end = REST_OF_WORD.match(data, at + BLOCK).end()
        yield data[at:end]
        at = end
    yield data[at:]


def merged(spans):
    """Sorted, disjoint spans."""
    out = []
    for start, end in sorted(spans):
        if out and start <= out[-1][1]:
            out[-1][1] = max(out[-1][1], end)
        else:
            out.append([start, end])
    return out


def cut(data, spans):
    """``data`` without the words of ``spans``."""
    found = re.finditer(rb"[^ ]+", data.translate(WORD_BYTES))
    places = [(m.start(), m.end()) for m in found]
    out, at = [], 0
    for start, end in spans:
        out.append(data[at : places[start][0]])
        at = places[end - 1][1]
    return b"".join([*out, data[at:]])


# --- items ---------------------------------------------------------------------------------


def _segments(items, window, segment):
    """(item, words) with words joined by spaces; a long item in pieces that overlap by a window."""

    def split(batches):
        for batch in batches:
            rows = []
            columns = (batch.column(c).to_pylist() for c in ("item_id", "text"))
            for item, text in zip(*columns, strict=True):
                run = words(utf8(text))
                at = 0
                while run and (at == 0 or len(run) - at >= window):
                    rows.append({"item": item, "words": b" ".join(run[at : at + segment]).decode()})
                    at += segment - window + 1
            yield pa.RecordBatch.from_pylist(
                rows, pa.schema([("item", pa.string()), ("words", pa.string())])
            )

    named = F.coalesce(F.col("item_id").cast("string"), F.lit("null")).alias("item_id")
    return mapped(items.select(named, "text"), split, "item string, words string")


def _groups(items, window, item_bytes):
    """Runs of item words as a table, and how many groups of about ``item_bytes`` they make."""
    runs = stored(_segments(items, window, max(SEGMENT, 2 * window)).distinct(), "items")
    total = runs.agg(F.sum(F.octet_length("words") + F.octet_length("item"))).first()[0] or 0
    return runs, max(1, -(-total // item_bytes))


def _shared(runs, number, groups):
    """Broadcast (name, runs of item words) of one group, small enough for one automaton."""
    group = F.pmod(F.xxhash64("item", "words"), F.lit(groups))
    rows = runs.filter(group == number).collect()  # about item_bytes of text
    return runs.sparkSession.sparkContext.broadcast(
        (uuid.uuid4().hex, [(r["item"], r["words"]) for r in rows])
    )


_built = {}


def _automaton(shared, window):
    """The automaton of a broadcast list, built once in each Python worker."""
    name, items = shared.value
    if (name, window) not in _built:
        _built.clear()
        runs = [(item, words.encode().split()) for item, words in items]
        _built[name, window] = Automaton(runs, window)
    return _built[name, window]


# --- documents -----------------------------------------------------------------------------

_SPANS = T.ArrayType(T.StructType([T.StructField("start", T.LongType()), T.StructField("end", T.LongType())]))
_SPAN_TYPE = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))


def _marked(rows, shared, window, names):
    """``rows`` with words, spans and items; spans and items of earlier passes are added to."""
    text = rows.columns.index("text")
    count, spans, owners = names

    def mark(batches):
        automaton = _automaton(shared, window)
        for batch in batches:
            old = [None, None]
            if spans in batch.schema.names:
                old = [batch.column(n).to_pylist() for n in (spans, owners)]
            marks = [automaton.hits(utf8(t.as_py())) for t in batch.column(text)]
            found = [m[1] for m in marks]
            items = [m[2] for m in marks]
            if old[0] is not None:
                pairs = [[(s["start"], s["end"]) for s in x] for x in old[0]]
                found = [merged([*a, *map(tuple, b)]) for a, b in zip(pairs, found, strict=True)]
                items = [{*a, *b} for a, b in zip(old[1], items, strict=True)]
            kept = [i for i, n in enumerate(batch.schema.names) if n not in names]
            yield pa.RecordBatch.from_arrays(
                [
                    *(batch.column(i) for i in kept),
                    pa.array([m[0] for m in marks], pa.int64()),
                    pa.array(
                        [[{"start": a, "end": b} for a, b in x] for x in found], _SPAN_TYPE
                    ),
                    pa.array([sorted(x) for x in items], pa.list_(pa.string())),
                ],
                [*(batch.schema.names[i] for i in kept), *names],
            )

    kept = [f for f in rows.schema.fields if f.name not in names]
    schema = T.StructType(
        [
            *kept,
            T.StructField(count, T.LongType()),
            T.StructField(spans, _SPANS),
            T.StructField(owners, T.ArrayType(T.StringType())),
        ]
    )
    return mapped(rows, mark, schema)


def marked(docs, items, names=("n_words", "spans", "items"), window=WINDOW, item_bytes=ITEM_BYTES):
    """``docs`` with the number of words, the hit spans (word numbers) and the owning item ids.

    The items may be of any size: each pass over the documents has one automaton of about
    ``item_bytes`` of item text, and later passes add to what the earlier ones found.
    """
    runs, groups = _groups(items, window, item_bytes)
    rows, shared = docs, None
    for number in range(groups):
        if shared:
            rows = stored(rows, "marked")
            shared.destroy()  # one group at a time is held
        shared = _shared(runs, number, groups)
        rows = _marked(rows, shared, window, names)
    return rows


def contamination(docs, items, window=WINDOW, item_bytes=ITEM_BYTES):
    """One row per row of ``docs`` (doc_id, text): which of its words are benchmark words.

    n_words, n_hit (words inside any occurrence of a window), n_items, items_sha256 (of the sorted
    item ids, joined by commas) and contaminated. Null texts have no words. Rows that repeat are
    each answered; items that repeat count once; an item without id is named ``null``. No items:
    nothing is hit. An empty table gives no rows.
    """
    found = marked(docs.select("doc_id", "text"), items, window=window, item_bytes=item_bytes)
    n_hit = F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + s["end"] - s["start"])
    return found.select(
        "doc_id",
        "n_words",
        n_hit.alias("n_hit"),
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ",").cast("binary"), 256).alias("items_sha256"),
        (F.size("spans") > 0).alias("contaminated"),
    )


def _cleaned(batch, fields, hits, max_share, again=None):
    """A batch of the columns ``fields`` without the words of ``hits`` (words, spans) of each row.

    Rows of which more than ``max_share`` is hit are left out. With ``again`` (the hits of bytes) a
    text is cut until nothing is hit any more.
    """
    texts, keep = batch.column("text").to_pylist(), []
    lengths = batch.column("n_chars").to_pylist() if "n_chars" in fields else None
    for i, (number, hit) in enumerate(hits):
        if hit and sum(end - start for start, end in hit) > max_share * number:
            continue
        keep.append(i)
        while hit:
            data = cut(utf8(texts[i]), hit)
            texts[i] = data.decode()
            if lengths:
                lengths[i] = len(texts[i])
            hit = again(data)[1] if again else None
    changed = {"text": texts, "n_chars": lengths}
    whole = pa.RecordBatch.from_arrays(
        [
            pa.array(changed[n], batch.schema.field(n).type)
            if changed.get(n) is not None
            else batch.column(n)
            for n in fields
        ],
        fields,
    )
    return whole.take(pa.array(keep, pa.int64()))


def _cut_marked(rows, names, max_share):
    """Rows with the spans they are marked with cut out."""
    count, spans, _ = names
    kept = [f for f in rows.schema.fields if f.name not in names]

    def clean(batches):
        for batch in batches:
            found = batch.column(spans).to_pylist()
            found = [[(s["start"], s["end"]) for s in hit] for hit in found]
            hits = zip(batch.column(count).to_pylist(), found, strict=True)
            yield _cleaned(batch, [f.name for f in kept], hits, max_share)

    return mapped(rows, clean, T.StructType(kept))


def _cut_found(rows, shared, window, max_share):
    """Rows with all hits of one automaton cut out, in one pass."""
    fields = rows.columns

    def clean(batches):
        find = _automaton(shared, window).hits
        for batch in batches:
            hits = (find(utf8(t.as_py()))[:2] for t in batch.column("text"))
            yield _cleaned(batch, fields, hits, max_share, find)

    return mapped(rows, clean, rows.schema)


def decontaminated(docs, items, window=WINDOW, max_share=0.5, item_bytes=ITEM_BYTES):
    """``docs`` without benchmark passages; all columns stay, ``n_chars`` follows the text.

    Every hit span is cut out of its text, and again until none is left, since the words on both
    sides of a cut meet. A document of which more than ``max_share`` of the words is hit is dropped.
    All other rows stay as they are: clean, null, empty and repeated ones.
    """
    names = tuple(free(docs.columns, "n_words", "spans", "items"))
    runs, groups = _groups(items, window, item_bytes)
    if groups == 1:
        return _cut_found(docs, _shared(runs, 0, 1), window, max_share)
    rows, done, share = docs, [], max_share
    while not done or not rows.isEmpty():
        for number in range(groups):
            shared = _shared(runs, number, groups)
            rows = stored(_marked(rows, shared, window, names), "marked")
            shared.destroy()
        hit = F.size(names[1]) > 0
        done.append(rows.filter(~hit).select(*docs.columns))
        rows = stored(_cut_marked(rows.filter(hit), names, share), "cut")
        share = 1.0  # what is dropped is decided by the first hits, of the whole text
    return reduce(DataFrame.unionByName, done)
