"""Ordered scans (numbering, lag, running best) that survive hot groups.

A plain window sorts each group in one task. Here the groups are counted first (one aggregate,
one row back to the driver). When none exceeds ``bound`` rows the plain window is the plan. Groups
beyond it are range-partitioned by their order, so each piece has about ``bound`` rows; the pieces
are scanned like small groups, and what each piece must know of the earlier ones (rows so far,
last value, best so far) is added from a table with one row per piece.

``order`` must be unique within a group; group columns must not be null. Where ``rows`` is costly,
``counted`` names a cheaper table with (at least) the same rows per group to take the counts from.
"""

import math

from pyspark.sql import Window
from pyspark.sql import functions as F

from podium.functions.sizes import ROW_BOUND
from podium.session import pinned

GROUP_BOUND = 2_000_000  # rows that one task sorts with ease

PIECE = "_piece"
WHOLE = -1


class Sequence:
    """Rows of each group in ``order`` (ascending column names), ready for ordered scans."""

    def __init__(self, rows, group, order, bound=None, counted=None):
        self.group = list(group)
        self.order = list(order)
        self.bound = bound or GROUP_BOUND
        self.rows, self.split = self._pieces(rows, rows if counted is None else counted)

    def _pieces(self, rows, counted):
        sizes = counted.groupBy(*self.group).count()
        # Held while the plan is made and run: the groups are counted once for all its uses. There
        # is at most one hot group for every ``bound`` rows.
        hot = sizes.filter(F.col("count") > self.bound).persist()
        keys, total = hot.agg(F.count(F.lit(1)), F.coalesce(F.sum("count"), F.lit(0))).first()
        if not keys:
            hot.unpersist()
            return rows.withColumn(PIECE, F.lit(WHOLE)), False
        hot = hot.select(*self.group)
        if keys <= ROW_BOUND:
            hot = F.broadcast(hot)
        # The bounds of a range partitioning are sampled, so it is computed once and written:
        # every later use must see the same pieces.
        n = max(2, math.ceil(total / self.bound))
        pieces = pinned(
            rows.join(hot, self.group, "left_semi")
            .repartitionByRange(n, *self.group, *self.order)
            .withColumn(PIECE, F.spark_partition_id())
        )
        rest = rows.join(hot, self.group, "left_anti").withColumn(PIECE, F.lit(WHOLE))
        return rest.unionByName(pieces), True

    @property
    def _piece_key(self):
        return [*self.group, PIECE]

    def _window(self):
        return Window.partitionBy(*self._piece_key).orderBy(*self.order)

    def _earlier_pieces(self):
        w = Window.partitionBy(*self.group).orderBy(PIECE)
        return w.rowsBetween(Window.unboundedPreceding, -1)

    def _summary(self, *aggs):
        return self.rows.filter(F.col(PIECE) != WHOLE).groupBy(*self._piece_key).agg(*aggs)

    def _carry(self, carries):
        self.rows = self.rows.join(carries, self._piece_key, "left")

    def number(self, out):
        """Position within the group, from 1."""
        self.rows = self.rows.withColumn(out, F.row_number().over(self._window()).cast("bigint"))
        if self.split:
            sizes = self._summary(F.count(F.lit(1)).alias("_n"))
            before = F.sum("_n").over(self._earlier_pieces())
            self._carry(sizes.select(*self._piece_key, before.alias("_before")))
            so_far = F.coalesce(F.col("_before"), F.lit(0))
            self.rows = self.rows.withColumn(out, F.col(out) + so_far).drop("_before")
        return self

    def previous(self, out, col):
        """``col`` of the row before, null for the first row."""
        if not self.split:
            self.rows = self.rows.withColumn(out, F.lag(col).over(self._window()))
            return self
        # In a struct a null value differs from the missing row before the first of a piece, and
        # only that one is filled from the piece before.
        held = F.struct(F.col(col).alias("value"))
        last = F.max_by(held, F.struct(*self.order)).alias("_last")
        earlier = Window.partitionBy(*self.group).orderBy(PIECE)
        carries = self._summary(last).select(
            *self._piece_key, F.lag("_last").over(earlier).alias("_carry")
        )
        self.rows = self.rows.withColumn(out, F.lag(held).over(self._window()))
        self._carry(carries)
        found = F.coalesce(F.col(out), F.col("_carry"))["value"]
        self.rows = self.rows.withColumn(out, found).drop("_carry")
        return self

    def running(self, out, fold, combine, col, inclusive=False):
        """Running ``fold`` (F.max, F.min) over earlier rows; with ``inclusive`` over this one too.

        ``combine`` joins two partial results and ignores nulls (F.greatest, F.least).
        """
        frame = self._window().rowsBetween(Window.unboundedPreceding, 0 if inclusive else -1)
        self.rows = self.rows.withColumn(out, fold(col).over(frame))
        if self.split:
            part = self._summary(fold(col).alias("_part"))
            carries = part.select(
                *self._piece_key, fold("_part").over(self._earlier_pieces()).alias("_carry")
            )
            self._carry(carries)
            self.rows = self.rows.withColumn(out, combine(F.col(out), F.col("_carry")))
            self.rows = self.rows.drop("_carry")
        return self

    def derive(self, out, col):
        """A column made from the row itself, for later scans."""
        self.rows = self.rows.withColumn(out, col)
        return self

    def done(self):
        return self.rows.drop(PIECE)


def numbered(rows, group, order, out="rank", bound=None):
    """Exact row numbers per group in ascending ``order``."""
    return Sequence(rows, group, order, bound).number(out).done()
