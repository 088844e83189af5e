"""Periodic runs of words: passages that repeat a phrase without a break.

The words of a text are numbers; its suffixes are sorted (by prefix doubling, together for many texts)
and the common prefixes of neighbours found. Every interval of suffixes with a common prefix of length d
is a candidate period: of its children but the largest, each suffix i is looked up at i + d and i - d by
its place in the order. Where both lie in the interval and then go on differently, a square of period d
ends there, which cannot be moved to the right; moved to the left as far as the period holds it is a run.
The intervals are ranges of the sorted suffixes; no tree is built.
"""

import hashlib
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import types as T

from podium.llm.common import mapped, utf8

LEAST = 12  # words of a run, at least
AT_ONCE = 200_000  # words sorted together; a longer text is sorted alone

SCHEMA = T.StructType(
    [
        T.StructField("doc_id", T.LongType()),
        *(T.StructField(n, T.LongType()) for n in ("n_runs", "start", "length", "period", "exponent_milli")),
        T.StructField("runs_sha256", T.StringType()),
        T.StructField("collapsed_sha256", T.StringType()),
    ]
)


def planted(words, doc_id):
    """``words`` with a tail that repeats, for one doc_id in ten; what is tested on."""
    if doc_id is None or not words:
        return words
    h = zlib.crc32(str(doc_id).encode())
    if h % 10:
        return words
    n, g = len(words), h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    tail = words[a : a + p]
    return words[:a] + (tail * ((n - a) // p + 1))[: n - a]


# --- sorted suffixes -----------------------------------------------------------------------


def _ranked(keys):
    """Dense ranks of an array of integers."""
    order = np.argsort(keys, kind="stable")
    ranked = keys[order]
    steps = np.empty(len(keys), np.int64)
    steps[0] = 0
    np.cumsum(ranked[1:] != ranked[:-1], out=steps[1:])
    ranks = np.empty(len(keys), np.int64)
    ranks[order] = steps
    return ranks


def _doubled(ranks, ends, k, more=None):
    """Ranks by the first ``k`` words and what follows them by ``more``, within each text.

    ``ends`` is the end of the text of each word. A text that ends sorts first.
    """
    n = len(ranks)
    more = ranks if more is None else more
    nxt = np.zeros(n, np.int64)
    at = np.arange(n - k) if k < n else np.empty(0, np.int64)
    inside = at + k < ends[: len(at)]
    nxt[: len(at)][inside] = more[k:][inside] + 1
    return _ranked(ranks * (n + 1) + nxt)


def repeating(ids, texts, ends, least=LEAST):
    """Numbers of the texts that can have runs of ``least`` words or more.

    A run of period q has equal words q apart on all its length but the last q words, which are
    half of it at most: some ``least // 2`` words in a row occur twice. ``ids`` are the words of all
    texts, ``texts`` and ``ends`` the text of each word and where that ends.
    """
    width = least // 2
    ranks, k = _ranked(texts * (int(ids.max()) + 1) + ids), 1
    while k < width:
        step = min(k, width - k)
        # The two windows of k words overlap where the last step is short.
        ranks = _doubled(ranks, ends, step)
        k += step
    whole = np.arange(len(ids)) + width <= ends
    ranks, texts = ranks[whole], texts[whole]
    often = np.bincount(ranks, minlength=1)[ranks] > 1 if len(ranks) else np.empty(0, bool)
    return np.unique(texts[often])


def suffixes(ids):
    """(sorted starts, place of each start) of the suffixes of an array of numbers."""
    n = len(ids)
    ranks, k = _ranked(ids), 1
    ends = np.full(n, n)
    while k < n and ranks.max() < n - 1:
        ranks = _doubled(ranks, ends, k)
        k *= 2
    order = np.empty(n, np.int64)
    order[ranks] = np.arange(n)
    return order, ranks


def common_prefixes(ids, order, places):
    """Of each sorted suffix, how many words it has in common with the one before; first 0."""
    words, order_, n = ids.tolist(), order.tolist(), len(ids)
    found, h = [0] * n, 0
    for i, place in enumerate(places.tolist()):
        if place == 0:
            h = 0
            continue
        j = order_[place - 1]
        most = n - max(i, j)
        while h < most and words[i + h] == words[j + h]:
            h += 1
        found[place] = h
        if h:
            h -= 1
    return found


def intervals(lcp):
    """(depth, first, last, children) of every range of sorted suffixes with a common prefix.

    ``children`` are the first places of the ranges it is parted into, and the place after the last.
    """
    stack = []  # [depth, first places of the children]
    n = len(lcp)
    for place in range(1, n + 1):
        depth = lcp[place] if place < n else 0
        first = place - 1
        while stack and stack[-1][0] > depth:
            d, parts = stack.pop()
            first = parts[0]
            yield d, first, place - 1, [*parts, place]
        if depth:
            if stack and stack[-1][0] == depth:
                stack[-1][1].append(place)
            else:
                stack.append([depth, [first, place]])


def _squares(ids, lcp, order, places):
    """(period, start) of the squares that cannot be moved to the right, as sorted arrays."""
    n = len(ids)
    froms, tos, depths, lows, highs = [], [], [], [], []
    for depth, first, last, parts in intervals(lcp):
        if 2 * depth > n:
            continue
        sizes = [b - a for a, b in zip(parts, parts[1:])]
        largest = sizes.index(max(sizes))
        # Two ranges of places: all children before the largest and all after it.
        for a, b in ((first, parts[largest]), (parts[largest + 1], last + 1)):
            if a < b:
                froms.append(a)
                tos.append(b)
                depths.append(depth)
                lows.append(first)
                highs.append(last)
    if not froms:
        return []
    froms, tos, depths, lows, highs = map(np.array, (froms, tos, depths, lows, highs))
    found = []
    # Ranges in blocks of about AT_ONCE suffixes.
    sizes = tos - froms
    blocks = np.cumsum(sizes) // AT_ONCE
    cuts = [0, *(np.flatnonzero(np.diff(blocks)) + 1).tolist(), len(sizes)]
    for x, y in zip(cuts, cuts[1:]):
        size = sizes[x:y]
        total = int(size.sum())
        at = np.arange(total) - np.repeat(np.cumsum(size) - size, size) + np.repeat(froms[x:y], size)
        start = order[at]
        d, low, high = (np.repeat(v[x:y], size) for v in (depths, lows, highs))
        for first in (start, start - d):  # i with i + d, and i - d with i
            second = first + d
            other = second if first is start else first
            good = (first >= 0) & (second + d <= n)
            place = places[np.where(good, other, 0)]
            good &= (place >= low) & (place <= high)
            first, period = first[good], d[good]
            after = first + 2 * period
            # It goes on differently, so that it cannot be moved to the right.
            parts = (after >= n) | (ids[first + period] != ids[np.minimum(after, n - 1)])
            found.append(np.stack([period[parts], first[parts]]))
    found = np.unique(np.concatenate(found, axis=1), axis=1)  # by period, then start
    return found.T.tolist()


def find_runs(ids, least=LEAST):
    """(start, length, period) of the runs of an array of numbers, by start and period."""
    if len(ids) < 2:
        return []
    order, places = suffixes(ids)
    lcp = common_prefixes(ids, order, places)
    words = ids.tolist()
    ending, found = {}, []
    for period, start in _squares(ids, lcp, order, places):
        end = start + 2 * period
        known = ending.setdefault(end, [])
        # A multiple of a smaller period, which has been found with the same end.
        if any(period % q == 0 and first <= start for q, first in known):
            continue
        while start and words[start - 1] == words[start - 1 + period]:
            start -= 1
        known.append((period, start))
        if end - start >= max(least, 2 * period):
            found.append((start, end - start, period))
    return sorted(found, key=lambda run: (run[0], run[2]))


def collapsed(words, found):
    """``words`` without those that repeat the ones a period before, of all runs."""
    keep = np.zeros(len(words) + 1, np.int64)
    for start, length, period in found:
        keep[start + period] += 1
        keep[start + length] -= 1
    dropped = np.cumsum(keep)[:-1] > 0
    return [w for w, gone in zip(words, dropped.tolist(), strict=True) if not gone]


def runs_of(texts, least=LEAST):
    """The runs of each of a list of word lists."""
    known = {}
    number = [np.array([known.setdefault(w, len(known)) for w in words], np.int64) for words in texts]
    sizes = np.array([len(words) for words in texts], np.int64)
    found = [[] for _ in texts]
    if not sizes.sum():
        return found
    owner = np.repeat(np.arange(len(texts)), sizes)
    ends = np.repeat(np.cumsum(sizes), sizes)
    for text in repeating(np.concatenate(number), owner, ends, least).tolist():
        found[text] = find_runs(_ranked(number[text]), least)
    return found


# --- rows ----------------------------------------------------------------------------------


def _sha(data):
    return hashlib.sha256(data).hexdigest()


def _row(doc_id, words, found):
    listed = "".join(f"{s},{n},{q}\n" for s, n, q in found)
    best = min(found, key=lambda r: (-r[1], r[0], r[2]), default=(None, None, None))
    start, length, period = best
    kept = collapsed(words, found) if found else words
    return (
        doc_id,
        len(found),
        start,
        length,
        period,
        1000 * length // period if found else None,
        _sha(listed.encode()),
        _sha(b" ".join(kept)),
    )


def periodic_runs(docs, edit=lambda words, doc_id: words, least=LEAST):
    """One row per row of ``docs`` (doc_id, text): its runs of words.

    Words are what white space (ASCII) parts; ``edit`` may change the list of words (bytes) first.
    A run is a stretch with smallest period q, words q apart being the same, of at least ``least``
    words and at least 2q, that neither side goes on with that period. n_runs, then start, length,
    period and floor(1000 * length / period) of the longest (ties: first start, then period), null
    without a run; runs_sha256 of all as ``start,length,period`` lines by start, then period; and
    collapsed_sha256 of the words, joined by spaces, that no run holds after its first q words.

    Null and empty texts have no words. A row without doc_id is not edited by ``planted``. Repeated
    rows are each answered, other columns are not read, and an empty table gives no rows.
    """

    def find(batches):
        def answered(ids, texts):
            rows = [_row(*r) for r in zip(ids, texts, runs_of(texts, least), strict=True)]
            columns = zip(*rows, strict=True)
            types = [pa.int64()] * 6 + [pa.string()] * 2
            return pa.RecordBatch.from_arrays(
                [pa.array(c, t) for c, t in zip(columns, types, strict=True)], SCHEMA.names
            )

        for batch in batches:
            ids, texts, size = [], [], 0
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                words = edit(utf8(text.as_py()).split(), doc_id)
                if size and size + len(words) > AT_ONCE:
                    yield answered(ids, texts)
                    ids, texts, size = [], [], 0
                ids.append(doc_id)
                texts.append(words)
                size += len(words)
            if ids:
                yield answered(ids, texts)

    rows = docs.selectExpr("cast(doc_id as long) doc_id", "text")
    return mapped(rows, find, SCHEMA)
