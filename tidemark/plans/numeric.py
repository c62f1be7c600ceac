"""Expressions over NumPy arrays: what solvers evaluate many times for a row, a scalar or an interval.

Only the part of a body that depends on the unknown comes here; everything else is an input that the plan has
computed.  An operator without a value gives NaN, which the solvers report.
"""

from __future__ import annotations

import math
from collections.abc import Callable

import numpy as np

from tidemark.functions.catalog import ALIASES
from tidemark.functions.scalar import _PPF_CENTRE, _PPF_CENTRE_D, _PPF_EDGE, _PPF_TAIL, _PPF_TAIL_D
from tidemark.plans.expr import Call, Name, Node, Number

NAN = float("nan")
_erfc = np.frompyfunc(math.erfc, 1, 1)


def _ppf(p):
    p = np.asarray(p, float)
    low = np.minimum(p, 1 - p)
    q, c = np.sqrt(-2 * np.log(low)), p - 0.5
    tail = np.polyval(_PPF_TAIL, q) / np.polyval(_PPF_TAIL_D, q)
    centre = np.polyval(_PPF_CENTRE, c * c) * c / np.polyval(_PPF_CENTRE_D, c * c)
    out = np.where(low < _PPF_EDGE, np.where(c < 0, tail, -tail), centre)
    return np.where((p > 0) & (p < 1), out, NAN)


def _only(ok, value):
    return np.where(ok, value, NAN)


ELEMENT: dict[str, Callable] = {
    "add": np.add,
    "subtract": np.subtract,
    "active_returns": np.subtract,
    "multiply": np.multiply,
    "divide": lambda x, y: _only(np.not_equal(y, 0), np.divide(x, y)),
    "power": lambda x, y: np.power(np.asarray(x, float), y),
    "minimum": lambda x, y: np.where(np.less(y, x), y, x),
    "maximum": lambda x, y: np.where(np.less(x, y), y, x),
    "negate": np.negative,
    "absolute": np.abs,
    "sqrt": np.sqrt,
    "clip": lambda x, a, b: _only(np.less_equal(a, b), np.clip(x, a, b)),
    "log": lambda x: _only(np.greater(x, 0), np.log(x)),
    "exp": lambda x: _only(np.isfinite(np.exp(x)), np.exp(x)),
    "reciprocal": lambda x: _only(np.not_equal(x, 0), np.divide(1.0, x)),
    "sign": lambda x: np.where(np.isnan(x), 0.0, np.sign(x)),
    "equal": np.equal,
    "not_equal": np.not_equal,
    "less_than": np.less,
    "less_equal": np.less_equal,
    "greater_than": np.greater,
    "greater_equal": np.greater_equal,
    "logical_and": np.logical_and,
    "logical_or": np.logical_or,
    "logical_not": np.logical_not,
    "where": np.where,
    "divide_or_default": lambda x, y, d: _only(np.isfinite(x) & np.isfinite(y), np.where(np.abs(y) < 1e-12, d, np.divide(x, y))),
    "normal_pdf": lambda x: np.exp(-0.5 * np.square(x)) / math.sqrt(2 * math.pi),
    "normal_cdf": lambda x: 0.5 * np.asarray(_erfc(-np.asarray(x, float) / math.sqrt(2.0)), float),
    "normal_ppf": _ppf,
    "finite_mask": np.isfinite,
    "floor": np.floor,
    "cos": np.cos,
    "expm1": np.expm1,
}


def _spread(root: bool) -> Callable:
    def f(x, ddof=1.0):
        n = np.size(x)
        v = np.var(x) * n / (n - ddof) if n > ddof else NAN
        return np.sqrt(v) if root else v

    return f


def _some(f: Callable) -> Callable:
    return lambda x, *rest: f(x, *rest) if np.size(x) else NAN


#: reductions of the unknown's interval
REDUCE: dict[str, Callable] = {
    "sum": _some(np.sum),
    "product": _some(np.prod),
    "mean": _some(np.mean),
    "min_value": _some(np.min),
    "max_value": _some(np.max),
    "median": _some(np.median),
    "quantile": _some(np.quantile),
    "variance": _spread(False),
    "std": _spread(True),
    "first": _some(lambda x: x[0]),
    "last": _some(lambda x: x[-1]),
    "length": lambda x: float(np.size(x)),
    "root_mean_square": _some(lambda x: np.sqrt(np.mean(np.square(x)))),
    "dot": lambda x, y: np.sum(np.multiply(x, y)),
    "sum_where": lambda x, m: _some(np.sum)(np.broadcast_to(x, np.shape(m))[m]),
    "mean_where": lambda x, m: _some(np.mean)(np.broadcast_to(x, np.shape(m))[m]),
    "count_true": lambda m: float(np.count_nonzero(m)),
}


def calls(tree: Node) -> set[str]:
    """The functions of a tree, aliases resolved."""
    if not isinstance(tree, Call):
        return set()
    return {ALIASES.get(tree.function, tree.function)}.union(*map(calls, tree.args))


def evaluate(tree: Node, env: dict[str, object], rows: int):  # noqa: ANN201
    """``rows`` is the length that a value has where a reduction takes it."""
    if isinstance(tree, Number):
        return tree.value
    if isinstance(tree, Name):
        return env[tree.name]
    name = ALIASES.get(tree.function, tree.function)
    args = [evaluate(a, env, rows) for a in tree.args]
    if name in ELEMENT:
        return ELEMENT[name](*args)
    wide = [np.broadcast_to(a, rows) if np.ndim(a) == 0 else a for a in args[:1]]
    return REDUCE[name](*wide, *args[1:])


class Groups:
    """Groups of at least one row each that stand one after the other."""

    def __init__(self, sizes: np.ndarray | list[int]) -> None:
        self.sizes = np.asarray(sizes, np.int64)
        self.starts = np.cumsum(self.sizes) - self.sizes
        self.of = np.repeat(np.arange(len(self.sizes)), self.sizes)

    def added(self, x: np.ndarray) -> np.ndarray:
        return np.add.reduceat(np.asarray(x, float), self.starts)


#: the same reductions of all groups at once; others go group by group
REDUCE_GROUPS: dict[str, Callable] = {
    "sum": lambda g, x: g.added(x),
    "product": lambda g, x: np.multiply.reduceat(np.asarray(x, float), g.starts),
    "mean": lambda g, x: g.added(x) / g.sizes,
    "min_value": lambda g, x: np.minimum.reduceat(x, g.starts),
    "max_value": lambda g, x: np.maximum.reduceat(x, g.starts),
    "first": lambda g, x: x[g.starts],
    "last": lambda g, x: x[g.starts + g.sizes - 1],
    "length": lambda g, x: g.sizes.astype(float),
    "root_mean_square": lambda g, x: np.sqrt(g.added(np.square(x)) / g.sizes),
    "dot": lambda g, x, y: g.added(np.multiply(x, y)),
    "count_true": lambda g, m: g.added(np.not_equal(m, 0)),
}


def evaluate_groups(tree: Node, env: dict[str, tuple[np.ndarray, bool]], groups: Groups):  # noqa: ANN201
    """A value a group.  Names are arrays, with a mark of whether they have a value a row."""

    def wide(v: object, long: bool) -> np.ndarray:
        return v if long else np.full(len(groups.of), v) if np.ndim(v) == 0 else v[groups.of]

    def walk(node: Node) -> tuple[object, bool]:
        if isinstance(node, Number):
            return node.value, False
        if isinstance(node, Name):
            return env[node.name]
        name = ALIASES.get(node.function, node.function)
        args = [walk(a) for a in node.args]
        if name in ELEMENT:
            long = any(on for _, on in args)
            return ELEMENT[name](*[v[groups.of] if long and not on and np.ndim(v) else v for v, on in args]), long
        first, *rest = [wide(*args[0]), *[v if np.ndim(v) == 0 else wide(v, on) for v, on in args[1:]]]
        if name in REDUCE_GROUPS:
            return REDUCE_GROUPS[name](groups, first, *rest), False
        parts = [slice(a, a + n) for a, n in zip(groups.starts, groups.sizes, strict=True)]
        return np.array([REDUCE[name](first[p], *[r if np.ndim(r) == 0 else r[p] for r in rest]) for p in parts], float), False

    return np.broadcast_to(walk(tree)[0], len(groups.sizes))


def bisect(f: Callable, low: np.ndarray, high: np.ndarray, tolerance: float, rounds: int) -> tuple[np.ndarray, np.ndarray]:
    """Roots of every element at once, and 0 or the number of the failure: 1 parameters, 2 not finite, 3 not bracketed, 4 not converged."""
    low, high = np.array(low, float), np.array(high, float)
    fl, fh = f(low), f(high)
    out, code = np.full(low.shape, NAN), np.full(low.shape, 4, np.int64)
    done = np.zeros(low.shape, bool)

    def settle(at: np.ndarray, value, kind: int = 0) -> None:  # noqa: ANN001
        new = at & ~done
        out[new], code[new] = np.broadcast_to(value, low.shape)[new], kind
        done[new] = True

    settle(~(np.isfinite(low) & np.isfinite(high) & (low < high)), NAN, 1)
    settle(~(np.isfinite(fl) & np.isfinite(fh)), NAN, 2)
    settle(fl == 0, low)
    settle(fh == 0, high)
    settle(np.signbit(fl) == np.signbit(fh), NAN, 3)
    for _ in range(rounds):
        if done.all():
            break
        mid = low * 0.5 + high * 0.5
        settle((high - low <= tolerance) | (mid == low) | (mid == high), mid)
        fm = f(mid)
        settle(~np.isfinite(fm), NAN, 2)
        settle(fm == 0, mid)
        same = np.signbit(fm) == np.signbit(fl)
        low, fl, high = np.where(same, mid, low), np.where(same, fm, fl), np.where(same, high, mid)
    settle(high - low <= tolerance, low * 0.5 + high * 0.5)
    return out, code


def iterate(f: Callable, start: np.ndarray, tolerance: float, rounds: int, together: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """x, status (0 settled, 1 out of rounds, 5 no finite step), count and residual, an element each.

    ``together``: all elements are one state that settles when its largest step is within the tolerance.
    """
    x = np.array(start, float)
    bad = ~np.isfinite(x)
    if together:
        bad = np.full(x.shape, bad.any())
    status, count, residual = np.where(bad, 5.0, 1.0), np.zeros(x.shape), np.full(x.shape, np.inf)
    for _ in range(rounds):
        open_ = status == 1.0
        if not open_.any():
            break
        new = np.broadcast_to(np.asarray(f(x), float), x.shape)
        step, broken = np.abs(new - x), ~np.isfinite(new)
        if together:
            step, broken = np.full(x.shape, step.max(initial=0.0)), np.full(x.shape, broken.any())
        count = np.where(open_, count + 1, count)
        x = np.where(open_ & ~broken, new, x)
        residual = np.where(open_, np.where(broken, np.inf, step), residual)
        status = np.where(open_, np.where(broken, 5.0, np.where(step <= tolerance, 0.0, 1.0)), status)
    return x, status, count, residual
