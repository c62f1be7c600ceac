"""Scopes over whole frames: several bodies at once, with their own result axis."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.plans.compiler import evaluate
from tidemark.plans.frame import IntervalFrame


def block_apply(frame: IntervalFrame, bodies: dict[str, str], width: int, parameters: dict[str, float] | None = None) -> DataFrame:
    """Each full block of ``width`` rows reduces to one row; the incomplete tail is dropped.  keys, pos (block number), one column a body."""
    out = evaluate(frame, {k: f"block_apply({b}, {width})" for k, b in bodies.items()}, parameters)
    return out.where(F.coalesce(*[F.col(b).isNotNull() for b in bodies]))


def segment_apply(frame: IntervalFrame, bodies: dict[str, str], segments: str, parameters: dict[str, float] | None = None) -> DataFrame:
    """Bodies over the rows [start, end] of each segment, shared ends included in both; the value stands on [start, end), rows outside get NaN."""
    return evaluate(frame, {k: f"segment_apply({b}, {segments})" for k, b in bodies.items()}, parameters)
