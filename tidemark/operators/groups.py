"""Groups of rows in Arrow tasks, many at a time: a task a group costs more than most groups' work."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

#: rows that a task gathers before it works on the groups that are complete
ROWS = 1 << 16


def in_groups(df: DataFrame, keys: list[str], order: list[str], run: Callable[[pa.Table, np.ndarray], Iterator[pa.Table]], schema: str | StructType) -> DataFrame:
    """``run(rows, first rows of the groups)`` on tables of whole groups of ``keys``, sorted by ``order`` inside.

    A table holds some 65,536 rows and what goes with them of its last group, or one group.  A window numbers the rows: it needs the distribution
    and the order, so there is no shuffle where the rows are dealt by keys already, and its 1 marks where a group begins.
    """
    mark = "_group_row"

    def stream(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        rows, limit = 0, ROWS

        def cut(last: bool) -> Iterator[pa.RecordBatch]:
            nonlocal held, rows, limit
            t = pa.Table.from_batches(held)
            starts = np.flatnonzero(t.column(mark).to_numpy() == 1)
            end = t.num_rows if last else int(starts[-1])
            held, rows = ([] if last else t.slice(end).to_batches()), t.num_rows - end
            limit = max(ROWS, 2 * rows)  # a group that is larger than that is waited for
            if end:
                for made in run(t.slice(0, end).drop_columns([mark]).combine_chunks(), starts[starts < end]):
                    yield from made.combine_chunks().to_batches()

        for b in batches:
            held.append(b)
            rows += b.num_rows
            if rows >= limit:
                yield from cut(False)
        if rows:
            yield from cut(True)

    return df.withColumn(mark, F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).mapInArrow(stream, schema)
