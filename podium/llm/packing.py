"""Packing of examples into fixed-length sequences by vector bin packing.

A sequence has limits on tokens, segments and loss-bearing tokens. It is filled by the dot-product
heuristic: of the examples that fit, the one whose needs point most in the direction of what is
still free goes in next. When none fits, the best one is cut so that it fills the rest. Examples
longer than a sequence are first cut into whole sequences. Each task packs its own rows from a
bounded pool; nothing is shuffled. What is left at the end of a task goes into sequences whose
lengths are powers of two, which need no padding.
"""

import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from podium.llm.common import mapped
from podium.llm.tokens import encoder

POOL = 2048  # examples to choose from
LEAST_PIECE = 16  # tokens below which no example is cut to fill a sequence


class Packer:
    """Packs pieces (example, start, length, loss) into sequences; ``limits`` for each of them."""

    def __init__(self, max_tokens, max_segments, max_loss, least_piece=LEAST_PIECE):
        self.limits = np.array([max_tokens, max_segments, max_loss], float)
        self.max_tokens, self.max_segments, self.max_loss = max_tokens, max_segments, max_loss
        self.least_piece = least_piece

    @staticmethod
    def loss(prompt, start, end):
        """Loss-bearing tokens of [start, end): those after the prompt."""
        return max(0, end - max(start, prompt))

    def reach(self, prompt, start, end, tokens, loss):
        """How far a piece from ``start`` goes with so many tokens and loss-bearing tokens."""
        return min(end, start + tokens, max(start, prompt) + loss)

    def whole(self, prompt, total):
        """Cut an example that exceeds a sequence: (pieces that fill one, start of the rest)."""
        start, pieces = 0, []
        while True:
            end = self.reach(prompt, start, total, self.max_tokens, self.max_loss)
            if end == total and (end - start < self.max_tokens or start == end):
                return pieces, start
            pieces.append((start, end))
            start = end

    def fills(self, pool):
        """Whether the pool can fill a sequence to one of its limits."""
        return bool((pool["need"].sum(axis=0) >= self.limits).any())

    def sequence(self, pool):
        """Take one sequence out of ``pool``, a dict of lists; returns its pieces."""
        need, state = pool["need"], pool["state"]
        free, taken = self.limits.copy(), []
        open_ = np.ones(len(need), bool)
        tokens, loss = need[:, 0].copy(), need[:, 2].copy()
        # What does not fit now never will in this sequence. All need one segment.
        fitting = np.arange(len(need))
        while free[1] >= 1 and free[0] > 0:
            fitting = fitting[(tokens[fitting] <= free[0]) & (loss[fitting] <= free[2])]
            toward = free / self.limits**2
            if len(fitting):
                best = int((tokens[fitting] * toward[0] + loss[fitting] * toward[2]).argmax())
                at = int(fitting[best])
                example, start, end, prompt = state[at]
                taken.append((example, start, end))
                free -= need[at]
                open_[at] = False
                fitting = np.delete(fitting, best)
                continue
            # None fits as a whole: cut the best of those that have enough to give.
            best = np.where(open_, need @ toward, -1)
            first = np.argpartition(-best, 8)[:8] if len(best) > 8 else np.arange(len(best))
            for at in first[np.argsort(-best[first])].tolist():
                if best[at] < 0:
                    break
                example, start, end, prompt = state[at]
                to = self.reach(prompt, start, end, int(free[0]), int(free[2]))
                if to - start >= self.least_piece and end - to >= 1:
                    taken.append((example, start, to))
                    state[at] = (example, to, end, prompt)
                    need[at] = [end - to, 1, self.loss(prompt, to, end)]
                    break
            break
        pool["need"] = need[open_]
        for at in np.flatnonzero(~open_)[::-1].tolist():
            del state[at]
        return taken

    def powers(self, pieces):
        """Share out ``pieces`` over sequences whose lengths are falling powers of two."""
        left = sum(end - start for _, start, end in pieces)
        out, pieces = [], list(pieces)
        while left:
            room = 1 << (left.bit_length() - 1)
            left -= room
            row = []
            while room:
                example, start, end = pieces.pop(0)
                to = min(end, start + room)
                row.append((example, start, to))
                room -= to - start
                if to < end:
                    pieces.insert(0, (example, to, end))
            out.append(row)
        return out


def _packing(tokenizer, id_type, prompt_column, end_id, packer, pool_size, keep_ids):
    names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]
    names += ["ids"] * keep_ids

    def rows(examples, sequence, number):
        offset, out = 0, []
        for example, start, end in sequence:
            doc_id, ids = examples[example]
            part = ids[start:end]
            row = (doc_id, start, end - start, zlib.crc32(part.tobytes()), len(ids), number, offset)
            out.append((*row, part) if keep_ids else row)
            offset += end - start
        return out

    def pack(batches):
        encode = encoder(tokenizer)
        examples, count, number = {}, 0, TaskContext.get().partitionId() << 33
        pool = {"need": np.empty((0, 3)), "state": []}

        def drain(least):
            nonlocal number
            # While more is to come, a sequence waits until there are tokens enough to fill it.
            while len(pool["state"]) > least and (not least or packer.fills(pool)):
                sequence = packer.sequence(pool)
                full = sum(e - s for _, s, e in sequence)
                last = not pool["state"] and full + packer.least_piece <= packer.max_tokens
                for row in packer.powers(sequence) if last else [sequence]:
                    yield from rows(examples, row, number)
                    number += 1
            alive = {s[0] for s in pool["state"]}
            for example in [x for x in examples if x not in alive]:
                del examples[example]

        for batch in batches:
            texts = batch.column("text").to_pylist()
            ids = encode.batch(texts)
            prompts = [np.empty(0, "<u4")] * len(texts)
            if prompt_column:
                prompts = encode.batch(batch.column(prompt_column).to_pylist())
            out, fresh = [], []
            for doc_id, prompt, text in zip(
                batch.column("doc_id").to_pylist(), prompts, ids, strict=True
            ):
                every = np.concatenate((prompt, text, np.array([end_id], "<u4")))
                examples[count] = (doc_id, every)
                pieces, start = packer.whole(len(prompt), len(every))
                for piece in pieces:
                    out += rows(examples, [(count, *piece)], number)
                    number += 1
                if start < len(every):
                    fresh.append((count, start, len(every), len(prompt)))
                count += 1
                if len(fresh) >= pool_size:
                    _add(pool, fresh, packer)
                    fresh = []
                    out += drain(pool_size // 2)
            _add(pool, fresh, packer)
            out += drain(pool_size // 2)
            yield _batch(out, names, id_type)
        yield _batch(list(drain(0)), names, id_type)

    return pack


def _add(pool, fresh, packer):
    if fresh:
        need = [(end - start, 1, packer.loss(prompt, start, end)) for _, start, end, prompt in fresh]
        pool["need"] = np.concatenate((pool["need"], np.array(need, float)))
        pool["state"] = pool["state"] + fresh


def _batch(rows, names, id_type):
    columns = list(zip(*rows, strict=True)) if rows else [[] for _ in names]
    arrays = [pa.array(columns[0], id_type)]
    arrays += [pa.array(c, pa.int64()) for c in columns[1:7]]
    arrays += [pa.array([x.astype(np.int32) for x in c], pa.list_(pa.int32())) for c in columns[7:]]
    return pa.RecordBatch.from_arrays(arrays, names)


def pack(
    docs,
    tokenizer,
    end_id=1,
    max_tokens=2048,
    max_segments=None,
    max_loss=None,
    prompt=None,
    pool_size=POOL,
    least_piece=LEAST_PIECE,
    keep_ids=False,
):
    """Pack ``docs`` (doc_id, text) into sequences: one row per piece.

    An example's ids are those of ``prompt`` (a column; none for plain text), of its text, and
    ``end_id``; the loss is borne by what follows the prompt. A sequence has at most ``max_tokens``
    tokens, ``max_segments`` pieces and ``max_loss`` loss-bearing tokens; a limit that is not given
    is that of the tokens, so it never ends a sequence early. Columns: doc_id, start
    and length of the piece among its example's ids, ids_crc32 (of the ids as little-endian
    uint32), doc_tokens, sequence_id, offset in the sequence; with ``keep_ids`` the ids.

    Null texts are empty: their end id alone is packed. Every id is in exactly one piece. Repeated
    rows and rows without doc_id are packed like others. Empty tables give no rows.
    """
    max_segments = max_tokens if max_segments is None else max_segments
    max_loss = max_tokens if max_loss is None else max_loss
    if min(max_tokens, max_segments, max_loss) < 1:
        raise ValueError("every limit must be at least 1")
    packer = Packer(max_tokens, max_segments, max_loss, least_piece)
    rows = docs.select("doc_id", "text", *([prompt] if prompt else []))
    schema = T.StructType(
        [
            rows.schema["doc_id"],
            *(
                T.StructField(n, T.LongType())
                for n in ("start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")
            ),
            *([T.StructField("ids", T.ArrayType(T.IntegerType()))] if keep_ids else []),
        ]
    )
    id_type = to_arrow_type(rows.schema["doc_id"].dataType)
    work = _packing(tokenizer, id_type, prompt, end_id, packer, pool_size, keep_ids)
    return mapped(rows, work, schema)
