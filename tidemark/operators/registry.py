"""Where each operator of the catalogue lives, and one way to call any of them."""

from __future__ import annotations

from collections.abc import Callable
from typing import Any

from tidemark.functions.catalog import CATALOG, resolve
from tidemark.functions.reduce import REDUCTIONS
from tidemark.functions.scalar import ELEMENTWISE, checked
from tidemark.operators import axes, latent, matrix
from tidemark.operators.kernels import KERNELS


def in_expressions(name: str) -> bool:
    """True if the operator works on series and scalars of an interval frame, by name in an expression."""
    from tidemark.plans.compiler import REWRITES, Plan

    op = resolve(name).name
    return op in ELEMENTWISE or op in REDUCTIONS or op in KERNELS or op in REWRITES or hasattr(Plan, "_op_" + op)


def on_frames(name: str) -> Callable[..., Any] | None:
    """The function on long frames (matrices, tensors, models), if the operator has one."""
    op = resolve(name).name
    return next((getattr(m, op) for m in (axes, matrix, latent) if hasattr(m, op)), None)


def call(name: str, *args: Any, **options: Any) -> Any:
    """Columns for element-wise operators, frames for those on arrays and models."""
    op = resolve(name).name
    if op in ELEMENTWISE:
        return checked(op, *args)
    if f := on_frames(op):
        return f(*args, **options)
    raise TypeError(f"{op} needs an interval frame; name it in an expression for tidemark.evaluate")


def missing() -> list[str]:
    return [n for n in CATALOG if not in_expressions(n) and on_frames(n) is None]
