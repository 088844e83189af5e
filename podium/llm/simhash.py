"""SimHash near-duplicates: fingerprints that differ in few bits, found by pigeonhole blocks.

A 64-bit fingerprint is cut into ``bits + 2`` blocks. Two fingerprints that differ in at most
``bits`` bits agree on at least two blocks, so every pair of blocks is a key to join on. A key that
too many fingerprints share is refined: the bits it leaves open are cut into blocks again, and the
same argument holds for them. Within a key the distances are verified and only a spanning forest of
the links leaves the task, so a dense group never becomes all its pairs.
"""

from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import functions as F
from pyspark.sql import types as T

from podium.llm.common import free, mapped, stored, utf8
from podium.llm.graph import components

SHINGLE = 3
BITS = 2
SEED = 42
KEY_BOUND = 256  # fingerprints that one key may hold before it is refined
BLOCK = 1 << 15  # shingles whose bits are counted at once

LOWER = bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))


def fingerprint(text, shingle=SHINGLE, seed=SEED):
    """The unsigned 64-bit SimHash of a text.

    A-Z are lower-cased, words are runs of other than ASCII white space, shingles are ``shingle``
    words joined by a space, repeats included; fewer words are one shingle. A bit is set if it is
    in over half of the shingles' hashes. Null and texts without words give zero.
    """
    words = utf8(text).translate(LOWER).split()
    if not words:
        return 0
    line = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    width = min(shingle, len(words))
    starts, ends = starts[: len(words) - width + 1].tolist(), ends[width - 1 :].tolist()
    digest, ones = xxhash.xxh64_intdigest, np.zeros(64, np.int64)
    for at in range(0, len(starts), BLOCK):
        spans = zip(starts[at : at + BLOCK], ends[at : at + BLOCK], strict=True)
        hashes = np.array([digest(line[a:b], seed) for a, b in spans], "<u8")
        bits = np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        ones += bits.sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > len(starts), bitorder="little").tobytes(), "little")


def fingerprints(docs, shingle=SHINGLE):
    """(doc_id, bits) per row of ``docs``: the fingerprint as a signed long."""

    def mark(batches):
        for batch in batches:
            texts = batch.column("text")
            marks = np.array([fingerprint(t.as_py(), shingle) for t in texts], np.uint64)
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(marks.view(np.int64), pa.int64())],
                ["doc_id", "bits"],
            )

    rows = docs.select("doc_id", "text")
    schema = T.StructType([rows.schema["doc_id"], T.StructField("bits", T.LongType())])
    return mapped(rows, mark, schema)


# --- links ---------------------------------------------------------------------------------


def _cut(open_bits, blocks):
    """The positions ``open_bits`` in ``blocks`` runs of nearly equal length."""
    at = [round(i * len(open_bits) / blocks) for i in range(blocks + 1)]
    return [open_bits[a:b] for a, b in zip(at, at[1:], strict=False)]


def _mask(positions):
    value = sum(1 << p for p in positions)
    return value - (1 << 64) if value >> 63 else value


def masks(taken=(), bits=BITS):
    """All keys that refine the key with the positions ``taken``: lists of positions."""
    parts = _cut([p for p in range(64) if p not in set(taken)], bits + 2)
    return [sorted({*taken, *a, *b}) for a, b in combinations(parts, 2)]


def _levels(bits):
    """Keys by level: {key number: (positions, numbers of the keys that refine it)}."""
    keys = {}

    def add(taken, depth):
        numbers = []
        for positions in masks(taken, bits):
            number = len(keys)
            keys[number] = [positions, []]
            numbers.append(number)
            if depth > 1 and 64 - len(positions) > bits + 2:
                keys[number][1] = add(positions, depth - 1)
        return numbers

    return keys, add((), 3)


def _under(numbers, keys):
    """The keys of a fingerprint as an array: key number, masked value."""
    return F.array(
        *(
            F.struct(F.lit(n).alias("k"), F.col("bits").bitwiseAND(F.lit(_mask(keys[n][0]))).alias("v"))
            for n in numbers
        )
    )


def _keyed(rows, each):
    """A row per fingerprint and key: k, v, bits."""
    return rows.select("bits", F.explode(each).alias("_key")).select("_key.k", "_key.v", "bits")


def _refined(crowded, keys):
    """The rows of crowded keys under the keys that refine them."""
    choice = F.lit(None)
    for n, (_, finer) in keys.items():
        if finer:
            choice = F.when(F.col("k") == n, _under(finer, keys)).otherwise(choice)
    return _keyed(crowded, choice)


def _spread(prints, bits, out):
    """Append links that connect all of ``prints`` within ``bits`` bits; no more than its size."""
    left = np.arange(len(prints))
    while len(left):
        queue, left = [left[0]], left[1:]
        while queue and len(left):
            at = queue.pop()
            near = np.bitwise_count(prints[left] ^ prints[at]) <= bits
            found, left = left[near], left[~near]
            queue.extend(found)
            out.extend((prints[at], prints[x]) for x in found)


def _forest(bits):
    """Spanning links within each key of a partition that is sorted by (k, v)."""

    def linked(k, v, prints):
        edges = np.flatnonzero((k[1:] != k[:-1]) | (v[1:] != v[:-1])) + 1
        starts, ends = np.append(0, edges), np.append(edges, len(k))
        sizes, out = ends - starts, []
        pairs = starts[sizes == 2]
        pairs = pairs[np.bitwise_count(prints[pairs] ^ prints[pairs + 1]) <= bits]
        for a, b in zip(starts[sizes > 2], ends[sizes > 2], strict=True):
            _spread(prints[a:b], bits, out)
        more = np.array(out, np.uint64).reshape(-1, 2)
        a = np.concatenate((prints[pairs], more[:, 0])).view(np.int64)
        b = np.concatenate((prints[pairs + 1], more[:, 1])).view(np.int64)
        return pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], ["a", "b"])

    def forest(batches):
        held = None  # the rows of the last key, which may go on in the next batch
        for batch in batches:
            part = [batch.column(n).to_numpy(zero_copy_only=False) for n in ("k", "v", "bits")]
            if not len(part[0]):
                continue
            if held:
                part = [np.concatenate(x) for x in zip(held, part, strict=True)]
            k, v, prints = part
            cut = np.flatnonzero((k != k[-1]) | (v != v[-1]))
            cut = cut[-1] + 1 if len(cut) else 0
            held = [x[cut:] for x in part]
            if cut:
                yield linked(k[:cut], v[:cut], prints[:cut].view(np.uint64))
        if held:
            yield linked(held[0], held[1], held[2].view(np.uint64))

    return forest


def links(prints, bits=BITS, key_bound=KEY_BOUND):
    """Links (a, b) that connect the distinct fingerprints within ``bits`` bits of each other.

    ``prints`` has a row per fingerprint (bits). The links of one key are a spanning forest of its
    close pairs, so all links together connect exactly what all close pairs connect.
    """
    keys, top = _levels(bits)
    last = [n for n, (_, finer) in keys.items() if not finer]
    rows, found = _keyed(prints, _under(top, keys)), []
    while True:
        counts = rows.groupBy("k", "v").agg(F.count(F.lit(1)).alias("n"))
        crowd = counts.filter((F.col("n") > key_bound) & ~F.col("k").isin(last)).select("k", "v")
        crowd = stored(crowd, "crowd")
        more = not crowd.isEmpty()
        ready = rows.join(crowd, ["k", "v"], "left_anti") if more else rows
        ready = ready.repartition("k", "v").sortWithinPartitions("k", "v")
        found.append(stored(mapped(ready, _forest(bits), "a long, b long"), "links"))
        if not more:
            break
        rows = stored(_refined(rows.join(crowd, ["k", "v"], "left_semi"), keys), "refined")
    every = found[0]
    for links_of_level in found[1:]:
        every = every.unionByName(links_of_level)
    return every


def _components(docs, shingle, bits, key_bound):
    """(doc_id, bits) of every row, and (bits, component, component_id) of every fingerprint."""
    marked = stored(fingerprints(docs, shingle), "fingerprints")
    prints = stored(marked.groupBy("bits").agg(F.min("doc_id").alias("least")), "prints")
    graph = components(links(prints.select("bits"), bits, key_bound))
    labelled = prints.join(graph, prints["bits"] == graph["node"], "left").select(
        "bits", "least", F.coalesce("component", "bits").alias("component")
    )
    smallest = labelled.groupBy("component").agg(F.min("least").alias("component_id"))
    return marked, labelled.join(smallest, "component").select("bits", "component", "component_id")


def near_duplicates(docs, shingle=SHINGLE, bits=BITS, key_bound=KEY_BOUND):
    """(doc_id, fingerprint, component_id) per row of ``docs`` (doc_id, text).

    ``fingerprint`` is 16 hex digits, ``component_id`` the smallest doc_id reachable over links of
    at most ``bits`` differing bits. Null and empty texts have fingerprint zero and are linked like
    any other. Repeated rows stay, each with the same answer. Rows without doc_id get the component
    of their fingerprint; where only such rows are in it, component_id is null. An empty table
    gives no rows.
    """
    marked, answers = _components(docs, shingle, bits, key_bound)
    return marked.join(answers, "bits").select(
        "doc_id", F.lpad(F.lower(F.hex("bits")), 16, "0").alias("fingerprint"), "component_id"
    )


def one_of_each(docs, shingle=SHINGLE, bits=BITS, key_bound=KEY_BOUND):
    """``docs`` (doc_id, text, any others) with one row of each component, the smallest doc_id.

    The rows are kept as they are. Where that doc_id is repeated in the component, one of its rows
    stays; rows without doc_id go if a row with one is in their component, else one of them stays.
    """
    marked, answers = _components(docs, shingle, bits, key_bound)
    answers = stored(answers, "components")
    found = marked.join(answers, "bits")
    again = marked.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n"))
    again = stored(again.filter("n > 1 or doc_id is null").select("doc_id"), "repeated")
    gone = found.filter("doc_id <> component_id").select("doc_id")
    if again.isEmpty():
        return docs.join(gone, "doc_id", "left_anti").select(*docs.columns)
    # A doc_id alone does not name a row here, so these rows go by their own fingerprint.
    mark, component, smallest, key = free(
        docs.columns, "bits", "component", "component_id", "again"
    )
    finger = F.pandas_udf(
        lambda texts: texts.map(lambda t: np.uint64(fingerprint(t, shingle)).astype(np.int64)),
        "long",
    )
    named = answers.select(
        F.col("bits").alias(mark),
        F.col("component").alias(component),
        F.col("component_id").alias(smallest),
    )
    keys = again.select(F.col("doc_id").alias(key))
    same = F.col(key).eqNullSafe(docs["doc_id"])
    repeated = (
        docs.join(keys, same, "left_semi")
        .withColumn(mark, finger("text"))
        .join(named, mark)
        .filter(F.col("doc_id").eqNullSafe(F.col(smallest)))
        .dropDuplicates(["doc_id", component])
        .select(*docs.columns)
    )
    single = docs.join(keys, same, "left_anti").join(gone, "doc_id", "left_anti")
    return single.select(*docs.columns).unionByName(repeated)
