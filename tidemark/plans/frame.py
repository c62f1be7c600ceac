"""Interval frames: the long form in which metrics are evaluated.

A frame has the key columns, ``pos`` (0-based and dense inside the key) and one column a field.  Intervals are given per product as half-open
position ranges; rows of overlapping intervals are repeated for each.  All keys start with the product, so one hash
partitioning by product serves the position window, the interval join and every later window.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

POS = "pos"


@dataclass(frozen=True)
class IntervalFrame:
    data: DataFrame
    keys: tuple[str, ...]

    def partition(self):
        return Window.partitionBy(*self.keys)

    def ordered(self):
        return self.partition().orderBy(POS)

    def prefix(self):
        return self.ordered().rowsBetween(Window.unboundedPreceding, 0)


def observations(data: DataFrame, product: str, order: list[str], fields: dict[str, str | Column]) -> IntervalFrame:
    """One interval a product: its whole history in the total order ``order``."""
    w = Window.partitionBy(product).orderBy(*order)
    columns = [(F.col(v) if isinstance(v, str) else v).alias(k) for k, v in fields.items()]
    return IntervalFrame(data.select(product, (F.row_number().over(w) - 1).cast("long").alias(POS), *columns), (product,))


def sliced(frame: IntervalFrame, intervals: DataFrame, start: str = "start_pos", end: str = "end_pos", interval: str = "interval_id") -> IntervalFrame:
    """The frame of (product, interval): rows with start <= pos < end, re-numbered from 0.

    The join is an equi-join on the product with the range as a residual condition, never a nested loop.
    """
    product = frame.keys[0]
    ranges = intervals.select(product, interval, F.col(start).alias("_start"), F.col(end).alias("_end"))
    rows = frame.data.join(ranges, product).where((F.col(POS) >= F.col("_start")) & (F.col(POS) < F.col("_end")))
    rows = rows.withColumn(POS, F.col(POS) - F.col("_start")).drop("_start", "_end")
    return IntervalFrame(rows, (product, interval))
