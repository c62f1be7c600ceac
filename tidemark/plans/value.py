"""Nodes of a plan."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import Column

from tidemark.plans.expr import ExpressionError

SCALAR, SERIES, RECORD, WINDOW, ARRAY = "scalar", "series", "record", "window", "array"


@dataclass(eq=False)
class Value:
    """A node: its kind, its expression over columns that exist at ``level``, and its status there."""

    kind: str
    column: Column | None = None
    level: int = 0
    status: Column | None = None
    fields: dict[str, Value] = field(default_factory=dict)
    drop: object = 0  # rows at the end that the series doesn't have; series mix only where these are equal
    reduction: Callable[[Callable], tuple] | None = None  # delayed: a group or a window form
    parents: tuple[Value, ...] = ()
    name: str = ""
    literal: float | None = None
    dtype: str = "double"
    feeds_series: bool = False
    window: tuple[Value, int, int] | None = None
    weight: int = 1  # about the size of the expression
    cells: np.ndarray | None = None  # of an array: its nodes, time left out
    timed: bool = False  # time is the first axis of the array


def common_drop(name: str, args: list[Value]) -> object:
    drops = {a.drop for a in args if a.kind == SERIES}
    if len(drops) > 1:
        raise ExpressionError(f"{name} mixes series of different lengths")
    return next(iter(drops), 0)


def deep(values: list[Value]) -> list[Value]:
    """The delayed scalars among the values and below them."""
    out = []
    for v in values:
        if v.reduction is not None:
            out.append(v)
            if v.name == "scalar":
                out += deep(list(v.parents))
    return out
