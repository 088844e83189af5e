"""Whitening of embeddings: principal components of whole numbers, each scaled to unit variance.

Entries become whole numbers, so counts, sums and products over any number of rows are exact and do not
depend on the order they are added in. The covariance, a square of the dimensions, is then divided on the
driver: the polar factor of the covariance less a shift (by the dynamically weighted Halley iteration) is
+1 on the components above the shift and -1 on those below, so it gives the projector on either part.
Both parts are divided again until each is one component. The components are broadcast to the rows.
"""

from decimal import Decimal
from math import sqrt
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import functions as F
from pyspark.sql import types as T

from podium.llm.common import mapped, stored

COMPONENTS = 32
SCALE, OFFSET = 64, 1_000_000
# Components with less than this share of the largest variance are rounding, not variance.
LEAST_VARIANCE = 1e-11
EPS = np.finfo(float).eps
BLOCK = 4096  # rows multiplied at once
SAFE = 2**53


class Model(NamedTuple):
    n: int
    centre: list  # whole numbers near the means
    rest: list  # n * (mean - centre), whole numbers
    values: np.ndarray  # variances, falling
    vectors: np.ndarray  # a column for each
    trace: float


# --- the covariance divided ----------------------------------------------------------------


def polar(matrix):
    """The symmetric orthogonal factor of a symmetric matrix, by QDWH."""
    size = len(matrix)
    eye = np.eye(size)
    x = matrix / (np.abs(matrix).sum(0).max() or 1.0)
    low = EPS  # singular values below this share stay undecided
    for _ in range(30):
        d = np.cbrt(4 * (1 - low * low) / low**4)
        a = sqrt(1 + d) + 0.5 * sqrt(8 - 4 * d + 8 * (2 - low * low) / (low * low * sqrt(1 + d)))
        b = (a - 1) ** 2 / 4
        c = a + b - 1
        if c > 100:
            q, _ = np.linalg.qr(np.vstack([sqrt(c) * x, eye]))
            y = b / c * x + (a - b / c) / sqrt(c) * q[:size] @ q[size:].T
        else:
            y = b / c * x + (a - b / c) * np.linalg.solve(eye + c * x.T @ x, x.T).T
        y = (y + y.T) / 2
        low = min(1.0, low * (a + b * low * low) / (1 + c * low * low))
        moved = np.linalg.norm(y - x)
        x = y
        if moved < (5 * EPS) ** (1 / 3) and 1 - low < 10 * EPS:
            break
    return x


def _shifts(matrix):
    """Numbers that part the eigenvalues: near their middle first, then between their bounds."""
    diagonal = np.diag(matrix)
    mean = diagonal.mean()
    spread = np.linalg.norm(matrix - mean * np.eye(len(matrix))) / sqrt(len(matrix))
    yield np.median(diagonal)
    yield mean
    for step in (0.1, -0.1, 0.03, -0.03, 0.3, -0.3, 0.01, -0.01, 0.6, -0.6):
        yield mean + step * spread


def _parted(matrix, scale):
    """An orthogonal matrix that parts ``matrix`` into two blocks, and the size of the first."""
    size = len(matrix)
    start = np.random.default_rng(size).standard_normal((size, size))
    best = None
    for shift in _shifts(matrix):
        projector = (polar(matrix - shift * np.eye(size)) + np.eye(size)) / 2
        count = int(round(np.trace(projector)))
        if not 0 < count < size:
            continue
        basis = start[:, :count]
        for _ in range(2):
            basis, _ = np.linalg.qr(projector @ basis)
        whole, _ = np.linalg.qr(basis, mode="complete")
        # What is left between the blocks, were they cut apart.
        left = np.linalg.norm(whole[:, :count].T @ matrix @ whole[:, count:])
        if best is None or left < best[0]:
            best = left, whole, count
        if left <= 10 * EPS * scale * sqrt(size):
            break
    if best is None:
        raise ArithmeticError("no shift parts the eigenvalues")
    return best[1:]


def divided(matrix):
    """(eigenvalues, falling, and unit eigenvectors as columns) of a symmetric matrix."""
    size = len(matrix)
    scale = np.linalg.norm(matrix)
    values, vectors = np.zeros(size), np.eye(size)
    todo, done = [(matrix, np.eye(size))], 0
    while todo:
        part, basis = todo.pop()
        n = len(part)
        mean = np.trace(part) / n
        # All its eigenvalues are the same, to the last digits of the whole.
        if n == 1 or np.linalg.norm(part - mean * np.eye(n)) <= EPS * scale:
            values[done : done + n], vectors[:, done : done + n] = np.diag(part), basis
            done += n
            continue
        turn, count = _parted(part, scale)
        for q in (turn[:, :count], turn[:, count:]):
            block = q.T @ part @ q
            todo.append(((block + block.T) / 2, basis @ q))
    return _refined(matrix, vectors)


def _refined(matrix, vectors):
    """One Newton step on all eigenvectors together; then eigenvalues, falling."""
    size = len(matrix)
    rest = np.eye(size) - vectors.T @ vectors
    turned = vectors.T @ matrix @ vectors
    values = np.diag(turned) / (1 - np.diag(rest))
    near = 2 * (np.linalg.norm(turned - np.diag(values)) + np.linalg.norm(matrix) * np.linalg.norm(rest))
    gaps = values[None, :] - values[:, None]
    apart = np.abs(gaps) > near
    step = np.where(apart, (turned + values[None, :] * rest) / np.where(apart, gaps, 1.0), rest / 2)
    # The step leaves close components slightly askew; the larger ones lead.
    order = np.argsort(-values, kind="stable")
    vectors, _ = np.linalg.qr((vectors + vectors @ step)[:, order])
    values = np.einsum("ij,ij->j", vectors, matrix @ vectors)
    order = np.argsort(-values, kind="stable")
    values, vectors = values[order], vectors[:, order]
    largest = np.abs(vectors).argmax(0)
    return values, vectors * np.sign(vectors[largest, np.arange(size)])


# --- rows as whole numbers -----------------------------------------------------------------


def _whole(column, size=None):
    """(which rows of a column of lists count, their whole numbers).

    Rows that are null, of another size than ``size``, or with an entry that is null, not finite or
    too large for a whole number of 62 bits do not count. Without ``size``: a pair for each size.
    """
    lengths = pc.fill_null(pc.list_value_length(column), -1).to_numpy(zero_copy_only=False)
    found = {}
    for length in [size] if size is not None else np.unique(lengths[lengths > 0]).tolist():
        rows = np.flatnonzero(lengths == length)
        flat = column.take(pa.array(rows)).flatten().cast(pa.float64())
        entries = SCALE * flat.to_numpy(zero_copy_only=False).reshape(len(rows), length)
        good = (np.abs(entries) < 2.0**61).all(axis=1)  # neither null nor infinite nor no number
        found[length] = rows[good], np.floor(entries[good]).astype(np.int64) + OFFSET
    return found if size is None else found[size]


def _sums(x):
    """Exact sums of the columns."""
    if len(x) and int(np.abs(x).max()) * len(x) >= 2**62:
        x = x.astype(object)
    return [int(v) for v in x.sum(axis=0)]


def _products(x):
    """Exact sums of the products of every two columns."""
    largest = int(np.abs(x).max()) if len(x) else 0
    if largest * largest * len(x) < SAFE:
        y = x.astype(float)  # all partial sums are whole numbers a double can hold
        return (y.T @ y).astype(np.int64).astype(object)
    x = x.astype(object)
    return x.T @ x


def _long(value):
    """A whole number as a long; null where it is none."""
    return value if -(2**63) <= value < 2**63 else None


_SUMS = "size int, dim int, total decimal(38,0)"
_CELLS = "i int, j int, total decimal(38,0)"


def _count(vectors):
    """(size, number, sums) of the vectors of the most frequent size; none without vectors."""

    def add(batches):
        totals = {}
        for batch in batches:
            for size, (_, x) in _whole(batch.column(0)).items():
                for at in range(0, len(x), BLOCK):
                    part = x[at : at + BLOCK]
                    old = totals.get(size, [0] * (size + 1))
                    totals[size] = [a + b for a, b in zip(old, [len(part), *_sums(part)], strict=True)]
        rows = [(s, d - 1, Decimal(t)) for s, sums in totals.items() for d, t in enumerate(sums)]
        yield _batch(rows, ("size", "dim", "total"), (pa.int32(), pa.int32(), pa.decimal128(38, 0)))

    each = mapped(vectors.select("embedding"), add, _SUMS)
    # At most a row per size and dimension.
    totals = stored(each.groupBy("size", "dim").agg(F.sum("total").alias("total")), "sums")
    most = totals.filter("dim = -1 and total > 0").orderBy(F.desc("total"), F.desc("size")).first()
    if most is None:
        return 0, 0, []
    rows = totals.filter((F.col("size") == most["size"]) & (F.col("dim") >= 0)).collect()
    return most["size"], int(most["total"]), [int(r["total"]) for r in sorted(rows, key=lambda r: r["dim"])]


def _batch(rows, names, types):
    columns = list(zip(*rows, strict=True)) if rows else [()] * len(names)
    return pa.RecordBatch.from_arrays(
        [pa.array(c, t) for c, t in zip(columns, types, strict=True)], list(names)
    )


def fit(vectors):
    """The components of ``vectors`` (embedding), all of them; None without vectors."""
    size, n, sums = _count(vectors)
    if not n:
        return None
    centre = [round_half(s, n) for s in sums]
    rest = [s - n * c for s, c in zip(sums, centre, strict=True)]

    def multiply(batches):
        total = np.zeros((size, size), object)
        middle = np.array(centre)
        for batch in batches:
            _, x = _whole(batch.column(0), size)
            for at in range(0, len(x), BLOCK):
                total = total + _products(x[at : at + BLOCK] - middle)
        rows = [(i, j, Decimal(int(total[i, j]))) for i in range(size) for j in range(i, size)]
        yield _batch(rows, ("i", "j", "total"), (pa.int32(), pa.int32(), pa.decimal128(38, 0)))

    cells = mapped(vectors.select("embedding"), multiply, _CELLS).groupBy("i", "j")
    covariance = np.zeros((size, size))
    for i, j, total in cells.agg(F.sum("total").alias("total")).collect():  # a row per two dimensions
        # Whole numbers up to here; the quotient is rounded once.
        covariance[i, j] = covariance[j, i] = (n * int(total) - rest[i] * rest[j]) / (n * n)
    values, found = divided(covariance)
    return Model(n, centre, rest, values, found, float(np.trace(covariance)))


def round_half(total, n):
    """The whole number nearest to total / n."""
    return (2 * total + n) // (2 * n)


def _whitened(vectors, model, count):
    """vec_id, deviation and the whitened entries of every vector that counts."""
    size = len(model.centre)
    shared = vectors.sparkSession.sparkContext.broadcast((model, count))
    ids = vectors.schema["vec_id"]
    schema = T.StructType(
        [
            ids,
            T.StructField("deviation", T.LongType()),
            T.StructField("whitened", T.ArrayType(T.DoubleType())),
        ]
    )

    def whiten(batches):
        known, k = shared.value
        turn = known.vectors[:, :k] / np.sqrt(known.values[:k])
        centre, rest = np.array(known.centre), np.array(known.rest, object)
        small = all(abs(r) < 2**61 for r in known.rest)
        for batch in batches:
            rows, x = _whole(batch.column(1), size)
            off = x - centre
            largest = int(np.abs(off).max()) if len(off) else 0
            # n * x - sums, exactly.
            if small and known.n * largest < 2**61:
                off = known.n * off - rest.astype(np.int64)
            else:
                off = known.n * off.astype(object) - rest
            largest = int(np.abs(off).max()) if len(off) else 0
            if largest * largest * size >= 2**63:
                squares = off.astype(object)
            else:
                squares = off
            deviation = [_long(int(v)) for v in (squares * squares).sum(axis=1)]
            out = (off / known.n).astype(float) @ turn
            offsets = pa.array(np.arange(len(rows) + 1, dtype=np.int32) * k, pa.int32())
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0).take(pa.array(rows)),
                    pa.array(deviation, pa.int64()),
                    pa.ListArray.from_arrays(offsets, pa.array(out.ravel(), pa.float64())),
                ],
                schema.names,
            )

    return mapped(vectors.select("vec_id", "embedding"), whiten, schema)


def _identity_error(rows, n, count):
    """The largest entry of the covariance of the whitened rows less the identity."""
    sums = rows.agg(*(F.sum(F.element_at("whitened", k + 1)).alias(str(k)) for k in range(count))).first()
    means = np.array(list(sums)) / n

    def multiply(batches):
        total = np.zeros((count, count))
        for batch in batches:
            off = batch.column(0).flatten().to_numpy().reshape(-1, count) - means
            total += off.T @ off
        rows = [(i, j, total[i, j]) for i in range(count) for j in range(i, count)]
        yield _batch(rows, ("i", "j", "total"), (pa.int32(), pa.int32(), pa.float64()))

    cells = mapped(rows.select("whitened"), multiply, "i int, j int, total double").groupBy("i", "j")
    cells = cells.agg((F.sum("total") / n).alias("cell"))
    off = F.abs(F.col("cell") - F.when(F.col("i") == F.col("j"), 1.0).otherwise(0.0))
    return cells.agg(F.max(off)).first()[0]


def whitened(vectors, components=COMPONENTS):
    """A row for each vector of ``vectors`` (vec_id, embedding) and component.

    x is floor(64 * entry) + 1,000,000. Columns: vec_id, component (from 1, by falling variance), n
    (vectors), deviation (sum of (n * x - S)^2 over the dimensions, S the sums of x; null where that
    is no long), whitened (x - S / n on the component, by its standard deviation), explained (its
    share of the variance) and identity_error (of all whitened values).

    Null vectors, and those with entries that are null, not finite or beyond 2^55, are left out, and
    so are vectors of another size than most (of equally many, the longer) and empty ones. A
    component without variance (below 1e-11 of the first) has no rows, so one vector, or many equal
    ones, give none. Repeated rows and ids are each answered; other columns are not read.
    """
    model = fit(vectors)
    kept = 0
    if model is not None:
        kept = int((model.values[:components] > max(0.0, LEAST_VARIANCE * model.values[0])).sum())
    if not kept:
        nothing = vectors.select("vec_id").limit(0)
        return nothing.select(
            "vec_id",
            *(F.lit(0).cast(t).alias(c) for c, t in (("component", "int"), ("n", "long"), ("deviation", "long"))),
            *(F.lit(0.0).alias(c) for c in ("whitened", "explained", "identity_error")),
        )
    rows = stored(_whitened(vectors, model, kept), "whitened")
    error = _identity_error(rows, model.n, kept)
    shares = F.array(*(F.lit(float(v / model.trace)) for v in model.values[:kept]))
    each = rows.select("vec_id", "deviation", F.posexplode("whitened").alias("at", "value"))
    return each.select(
        "vec_id",
        (F.col("at") + 1).alias("component"),
        F.lit(model.n).cast("long").alias("n"),
        "deviation",
        F.col("value").alias("whitened"),
        F.element_at(shares, F.col("at") + 1).alias("explained"),
        F.lit(float(error)).alias("identity_error"),
    )
