"""Matrices and tensors inside expressions: grids of nodes of the plan, of a size that the expressions fix.

With time as its first axis an array is a grid of series, else of scalars; time is never an axis of the grid.  Whatever
goes along other axes is an expression of a row, what goes along time a reduction in the plan's one groupBy, so arrays add no shuffle.
Factorisations run in one vectorised Arrow function of the cells.  Shapes are strict: operands of an element-wise operator
have equal axes or are scalars; ``broadcast_like`` widens.  Plans grow with the cells, so over ``MAX_CELLS`` are refused:
wide matrices are long frames (``tidemark.operators``).
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

from tidemark.functions.scalar import ELEMENTWISE, finite, nan
from tidemark.operators import matrix
from tidemark.plans.expr import ExpressionError, Node
from tidemark.plans.value import ARRAY, RECORD, SCALAR, SERIES, Value, common_drop, deep

MAX_CELLS = 4096
ERRORS = ("SINGULAR_MATRIX", "DOMAIN_ERROR", "NOT_POSITIVE_DEFINITE", "NON_CONVERGENCE")
_LONG = {"sum": "sum", "mean": "mean", "product": "product", "variance": "variance", "std": "std", "min": "min_value", "max": "max_value"}


def _total(columns: list[Column]) -> Column:
    out = columns[0]
    for c in columns[1:]:
        out = out + c
    return out


def _most(columns: list[Column], largest: bool = True) -> Column:
    return columns[0] if len(columns) == 1 else (F.greatest if largest else F.least)(*columns)


def _extreme(largest: bool) -> Callable:
    """The first element sticks if it is NaN; later NaN never win."""

    def form(*c: Column) -> tuple:
        return F.when(F.isnan(c[0]), nan()).otherwise(_most([F.when(~F.isnan(x), x) for x in c], largest)), None, ""

    return form


def _product(*c: Column) -> tuple:
    out = c[0]
    for x in c[1:]:
        out = out * x
    return out, None, ""


def _infinite(columns: tuple[Column, ...]) -> Column:
    bad = ~finite(columns[0])
    for c in columns[1:]:
        bad = bad | ~finite(c)
    return bad


class Arrays:
    """The part of a plan that knows arrays."""

    # -- grids -------------------------------------------------------------------

    def _boxed(self, cells: np.ndarray, timed: bool) -> Value:
        if cells.ndim == 0:
            return cells[()]
        if cells.size > MAX_CELLS:
            raise ExpressionError(f"arrays of over {MAX_CELLS} cells are frames of tidemark.operators")
        return Value(ARRAY, cells=cells, timed=timed)

    @staticmethod
    def _unboxed(v: Value) -> tuple[np.ndarray, bool]:
        if v.kind == ARRAY:
            return v.cells, v.timed
        if v.kind not in (SCALAR, SERIES):
            raise ExpressionError("records and windows must be projected before an array takes them")
        cells = np.empty((), object)
        cells[()] = v
        return cells, v.kind == SERIES

    def _array_literal(self, *parts: Node) -> Value:
        """An array of equal parts: expressions or arrays.  Series make time its first axis."""
        grids = [self._unboxed(self.node(p)) for p in parts]
        if not grids or len({c.shape for c, _ in grids}) > 1:
            raise ExpressionError("the parts of an array have one shape")
        return self._boxed(np.stack([c for c, _ in grids]), any(t for _, t in grids))

    def _plain(self, v: Value, name: str, rank: int) -> np.ndarray:
        """The cells of an array without time."""
        cells, timed = self._unboxed(v)
        if timed or cells.ndim != rank:
            raise ExpressionError(f"SHAPE_MISMATCH: {name} takes {'a matrix' if rank == 2 else 'a vector'} without a time axis")
        return cells

    def _square(self, v: Value, name: str) -> np.ndarray:
        cells = self._plain(v, name, 2)
        if cells.shape[0] != cells.shape[1]:
            raise ExpressionError(f"SHAPE_MISMATCH: {name} takes a square matrix")
        return cells

    def _axis(self, v: Value, axis: Value, name: str, more: int = 0) -> tuple[np.ndarray, bool, int]:
        """Cells, whether time is an axis, and the grid's axis: -1 is time."""
        cells, timed = self._unboxed(v)
        a = self._whole(axis, name, 0)
        if a >= cells.ndim + timed + more:
            raise ExpressionError(f"INVALID_PARAMETER: {name} has no axis {a}")
        return cells, timed, a - timed

    def _lines(self, cells: np.ndarray, axis: int, f: Callable[[list[Value]], list[Value] | Value]) -> np.ndarray:
        """``f`` of each line along an axis; a list of values takes the axis' place."""
        moved = np.moveaxis(cells, axis, -1)
        made = [f(list(moved[at])) for at in np.ndindex(moved.shape[:-1])]
        if made and isinstance(made[0], list):
            out = np.empty((*moved.shape[:-1], len(made[0])), object)
            for at, line in zip(np.ndindex(moved.shape[:-1]), made, strict=True):
                for i, x in enumerate(line):
                    out[(*at, i)] = x
            return np.moveaxis(out, -1, axis)
        out = np.empty(moved.shape[:-1], object)
        for at, x in zip(np.ndindex(moved.shape[:-1]), made, strict=True):
            out[at] = x
        return out

    def _each(self, cells: np.ndarray, f: Callable[[Value], Value]) -> np.ndarray:
        out = np.empty(cells.shape, object)
        for at in np.ndindex(cells.shape):
            out[at] = f(cells[at])
        return out

    def _combined(self, form: Callable, args: list[Value], dtype: str = "double") -> Value:
        """One expression over other nodes: a series if any of them is, delayed if any of them is a reduction."""
        series = any(a.kind == SERIES for a in args)
        if not series and any(a.reduction is not None for a in deep(args)):
            v = Value(SCALAR, None, self._level(args), parents=tuple(args), dtype=dtype, name="scalar")
            policy = self.policy

            def build(read: Callable[[Value], tuple[Column, Column | None]]) -> tuple:
                got = [read(a) for a in args]
                value, failed, error = form(*[c for c, _ in got])
                return self._guard(value, failed, error, [Value(SCALAR, c, status=s) for c, s in got], True, dtype, policy)

            v.reduction = build
            return v
        for a in args:
            if a.kind == SERIES:
                self._settle(a)
        columns = [self._read_series(a) for a in args]
        value, failed, error = form(*columns)
        column, status = self._guard(value, failed, error, args, not series, dtype)
        return Value(SERIES if series else SCALAR, column, self._level(args), status, drop=common_drop("an array", args), parents=tuple(args), dtype=dtype, weight=sum(a.weight for a in args) + 1)

    def _sum_of(self, *products: tuple[Value, ...]) -> Value:
        """The sum of products of nodes."""
        if not products:
            return Value(SCALAR, F.lit(0.0), literal=0.0)
        sizes = [len(p) for p in products]

        def form(*c: Column) -> tuple:
            at, terms = 0, []
            for n in sizes:
                terms.append(_product(*c[at : at + n])[0])
                at += n
            return _total(terms), None, ""

        return self._combined(form, [v for p in products for v in p])

    # -- dispatch ----------------------------------------------------------------

    def _array(self, name: str, args: list[Value]) -> Value:
        if name in ELEMENTWISE:
            return self._broadcast(name, args)
        short, _, axis = name.partition("_")
        if axis in ("time", "asset") and short in _LONG:
            return self._time_or_asset(_LONG[short], axis == "time", *args)
        if handler := getattr(self, "_array_" + name, None):
            return handler(*args)
        raise ExpressionError(f"{name} takes series, not arrays; reduce or take an axis first")

    def _broadcast(self, name: str, args: list[Value]) -> Value:
        shapes = {(v.cells.shape, v.timed) for v in args if v.kind == ARRAY}
        if len(shapes) > 1 or any(v.kind not in (ARRAY, SCALAR) for v in args):
            raise ExpressionError(f"SHAPE_MISMATCH: {name} takes arrays of equal axes and scalars; see broadcast_like")
        shape, timed = next(iter(shapes))
        out = np.empty(shape, object)
        for at in np.ndindex(shape):
            out[at] = self._elementwise(name, [v.cells[at] if v.kind == ARRAY else v for v in args])
        return self._boxed(out, timed)

    # -- along an axis -------------------------------------------------------------

    def _time_or_asset(self, reduction: str, time: bool, v: Value) -> Value:
        cells, timed = self._unboxed(v)
        if cells.ndim + timed != 2:
            raise ExpressionError("SHAPE_MISMATCH: a matrix of time and assets is needed")
        if time and timed:
            return self._boxed(self._each(cells, lambda c: self._reduction(reduction, [c])), False)
        return self._boxed(self._lines(cells, 0 if time or timed else 1, lambda line: self._row(reduction, line)), timed and not time)

    def _row(self, reduction: str, line: list[Value], ddof: int = 1) -> Value:
        """A reduction of the cells of a line."""
        n = len(line)
        if reduction == "sum":
            return self._sum_of(*[(v,) for v in line])
        if reduction == "mean":
            return self._combined(lambda *c: (_total(list(c)) / F.lit(float(n)), None, ""), line)
        if reduction == "product":
            return self._combined(_product, line)
        if reduction in ("min_value", "max_value"):
            return self._combined(_extreme(reduction == "max_value"), line)
        if n <= ddof:
            raise ExpressionError(f"INSUFFICIENT_SAMPLE: {reduction} over {n} cells")
        mean = self._row("mean", line)
        root = F.sqrt if reduction == "std" else lambda x: x
        return self._combined(lambda m, *c: (root(_total([(x - m) * (x - m) for x in c]) / F.lit(float(n - ddof))), None, ""), [mean, *line])

    def _along(self, v: Value, axis: Value, name: str, time: Callable[[Value], Value], row: Callable[[list[Value]], list[Value] | Value], keeps: bool = False) -> Value:
        cells, timed, a = self._axis(v, axis, name)
        if a < 0:
            return self._boxed(self._each(cells, time), keeps)
        return self._boxed(self._lines(cells, a, row), timed)

    def _checked_row(self, form: Callable, line: list[Value], dtype: str = "double") -> Value:
        return self._combined(lambda *c: (form(*c), _infinite(c), "NON_FINITE_INPUT"), line, dtype)

    def _finite_series(self, v: Value) -> Value:
        return self._combined(lambda c: (c, ~finite(c) & c.isNotNull(), "NON_FINITE_INPUT"), [v])

    def _array_sum_axis(self, v: Value, axis: Value) -> Value:
        return self._along(v, axis, "sum_axis", lambda c: self._reduction("sum", [c]), lambda line: self._row("sum", line))

    def _array_mean_axis(self, v: Value, axis: Value) -> Value:
        return self._along(v, axis, "mean_axis", lambda c: self._reduction("mean", [c]), lambda line: self._row("mean", line))

    def _array_variance_axis(self, v: Value, axis: Value, ddof: Value | None = None) -> Value:
        d = self._whole(ddof, "variance_axis", 0, 0)
        number = Value(SCALAR, F.lit(float(d)), literal=float(d))

        def row(line: list[Value]) -> Value:
            return self._row("variance", [self._finite_series(c) for c in line], d)

        return self._along(v, axis, "variance_axis", lambda c: self._reduction("variance", [self._finite_series(c), number]), row)

    def _array_max_axis(self, v: Value, axis: Value) -> Value:
        return self._along(v, axis, "max_axis", lambda c: self._reduction("max_value", [self._finite_series(c)]), lambda line: self._checked_row(lambda *c: _most(list(c)), line))

    def _array_argmax_axis(self, v: Value, axis: Value) -> Value:
        def first(*c: Column) -> Column:
            top = _most(list(c))
            out = F.lit(len(c) - 1)
            for i in range(len(c) - 2, -1, -1):
                out = F.when(c[i] == top, i).otherwise(out)
            return out.cast("long")

        def time(c: Value) -> Value:
            return self._combined(lambda x: (x.cast("long"), None, ""), [self._reduction("argmax", [self._finite_series(c)])], "long")

        return self._along(v, axis, "argmax_axis", time, lambda line: self._checked_row(first, line, "long"))

    def _array_logsumexp_axis(self, v: Value, axis: Value) -> Value:
        return self._along(v, axis, "logsumexp_axis", self._time_logsumexp, lambda line: self._row_exponents(line)[1])

    def _time_logsumexp(self, c: Value) -> Value:
        top = self._reduction("max_value", [self._finite_series(c)])
        scaled = self._elementwise("exp", [self._elementwise("subtract", [c, top])])
        return self._elementwise("add", [self._elementwise("log", [self._reduction("sum", [scaled])]), top])

    def _row_exponents(self, line: list[Value]) -> tuple[Value, Value]:
        """The largest cell of a line and the logarithm of the sum of its exponentials."""
        top = self._checked_row(lambda *c: _most(list(c)), line)
        return top, self._combined(lambda m, *c: (m + F.log(_total([F.exp(x - m) for x in c])), None, ""), [top, *line])

    def _array_softmax_axis(self, v: Value, axis: Value) -> Value:
        def row(line: list[Value]) -> list[Value]:
            total = self._row_exponents(line)[1]
            return [self._combined(lambda t, c: (F.exp(c - t), None, ""), [total, c]) for c in line]

        def time(c: Value) -> Value:
            return self._elementwise("exp", [self._elementwise("subtract", [c, self._time_logsumexp(c)])])

        return self._along(v, axis, "softmax_axis", time, row, True)

    def _array_cumulative_product_axis(self, v: Value, axis: Value, initial: Value) -> Value:
        start = Value(SCALAR, F.lit(x := self._literal(initial, "cumulative_product_axis")), literal=x)

        def row(line: list[Value]) -> list[Value]:
            return [self._combined(_product, [start, *line[: i + 1]]) for i in range(len(line))]

        return self._along(v, axis, "cumulative_product_axis", lambda c: self._elementwise("multiply", [start, self._op_cumulative_product(c)]), row, True)

    def _array_cumulative_max_axis(self, v: Value, axis: Value, initial: Value) -> Value:
        x = self._literal(initial, "cumulative_max_axis")
        start = F.lit(x)
        best = lambda c: F.when(~F.isnan(c), c)

        def row(line: list[Value]) -> list[Value]:
            return [self._combined(lambda *c: (start if x != x else F.greatest(start, *map(best, c)), None, ""), line[: i + 1]) for i in range(len(line))]

        def time(c: Value) -> Value:
            return self._window(lambda k, p, _: (F.when(k[0].isNotNull(), start if x != x else F.greatest(start, F.max(best(k[0])).over(p))), None, ""), [c])

        return self._along(v, axis, "cumulative_max_axis", time, row, True)

    def _array_quantiles_axis(self, v: Value, probabilities: Value, axis: Value) -> Value:
        """Quantiles by linear interpolation, NaN as the largest; the probabilities take the axis' place."""
        ps = [self._literal(p, "quantiles_axis") for p in self._unboxed(probabilities)[0].reshape(-1)]
        if any(not 0 <= p <= 1 for p in ps):
            raise ExpressionError("INVALID_PARAMETER: quantiles_axis takes 0 <= probability <= 1")

        def row(line: list[Value]) -> list[Value]:
            last = len(line) - 1

            def form(*c: Column) -> tuple:
                s = F.array_sort(F.array(*c))
                parts = [(s[int(p * last)], s[min(int(p * last) + 1, last)], p * last - int(p * last)) for p in ps]
                return F.array(*[a + (b - a) * F.lit(w) if w else a for a, b, w in parts]), None, ""

            if self.policy == "raise":
                sorted_ = self._combined(form, line)
                return [self._combined(lambda s, i=i: (s[i], None, ""), [sorted_]) for i in range(len(ps))]
            return [self._combined(lambda *c, i=i: (form(*c)[0][i], None, ""), line) for i in range(len(ps))]

        def time(c: Value, p: float) -> Value:
            return self._reduce(lambda o: (o(F.percentile(self._read_series(c), F.lit(p))), None, ""), [c])

        cells, timed, a = self._axis(v, axis, "quantiles_axis")
        if a < 0:
            return self._boxed(np.stack([self._each(cells, lambda c, p=p: time(c, p)) for p in ps]), False)
        return self._boxed(self._lines(cells, a, row), timed)

    # -- shapes --------------------------------------------------------------------

    def _array_transpose(self, v: Value) -> Value:
        return self._boxed(self._plain(v, "transpose", 2).T, False)

    def _array_swap_axes(self, v: Value, first: Value, second: Value) -> Value:
        cells, timed, a = self._axis(v, first, "swap_axes")
        b = self._axis(v, second, "swap_axes")[2]
        if min(a, b) < 0 and a != b:
            raise ExpressionError("SHAPE_MISMATCH: time stays the first axis")
        return v if a == b else self._boxed(np.swapaxes(cells, a, b), timed)

    def _static_axis(self, v: Value, axis: Value, name: str) -> tuple[np.ndarray, bool, int]:
        cells, timed, a = self._axis(v, axis, name)
        if a < 0:
            raise ExpressionError(f"SHAPE_MISMATCH: {name} works along axes other than time")
        return cells, timed, a

    def _array_take_axis(self, v: Value, indices: Value, axis: Value) -> Value:
        cells, timed, a = self._static_axis(v, axis, "take_axis")
        at = [self._whole(i, "take_axis", 0) for i in self._unboxed(indices)[0].reshape(-1)]
        if any(i >= cells.shape[a] for i in at):
            raise ExpressionError("INDEX_OUT_OF_RANGE")
        return self._boxed(np.take(cells, at, a), timed)

    def _array_slice_axis(self, v: Value, axis: Value, start: Value, stop: Value, step: Value) -> Value:
        cells, timed, a = self._static_axis(v, axis, "slice_axis")
        low, high, by = (self._whole(x, "slice_axis", least) for x, least in ((start, 0), (stop, 0), (step, 1)))
        if not low < high <= cells.shape[a]:
            raise ExpressionError("INVALID_PARAMETER: slice_axis takes 0 <= start < stop <= length")
        return self._boxed(np.take(cells, range(low, high, by), a), timed)

    def _array_concatenate(self, lhs: Value, rhs: Value, axis: Value) -> Value:
        x, timed, a = self._static_axis(lhs, axis, "concatenate")
        y, also = self._unboxed(rhs)
        rest = lambda c: [n for i, n in enumerate(c.shape) if i != a]
        if timed != also or x.ndim != y.ndim or rest(x) != rest(y):
            raise ExpressionError("SHAPE_MISMATCH: concatenate takes arrays that differ along one axis only")
        return self._boxed(np.concatenate([x, y], a), timed)

    def _array_stack(self, lhs: Value, rhs: Value, axis: Value) -> Value:
        x, timed, a = self._axis(lhs, axis, "stack", 1)
        y, also = self._unboxed(rhs)
        if a < 0 or timed != also or x.shape != y.shape:
            raise ExpressionError("SHAPE_MISMATCH: stack takes arrays of equal axes; time stays the first")
        return self._boxed(np.stack([x, y], a), timed)

    def _array_broadcast_like(self, v: Value, template: Value) -> Value:
        cells, timed = self._unboxed(v)
        shape, wide = (self._unboxed(template)[0].shape, self._unboxed(template)[1])
        if (timed and (not wide or cells.ndim != len(shape))) or (cells.ndim > len(shape) + wide):
            raise ExpressionError("SHAPE_MISMATCH: the last axes of broadcast_like are equal or 1")
        try:
            return self._boxed(np.broadcast_to(cells, shape).copy(), wide)
        except ValueError as e:
            raise ExpressionError("SHAPE_MISMATCH: the last axes of broadcast_like are equal or 1") from e

    # -- products --------------------------------------------------------------------

    def _array_dot(self, lhs: Value, rhs: Value) -> Value:
        x, y = self._plain(lhs, "dot", 1), self._plain(rhs, "dot", 1)
        self._inner(len(x), len(y), "dot")
        return self._sum_of(*zip(x, y, strict=True))

    @staticmethod
    def _inner(n: int, m: int, name: str) -> None:
        if n != m:
            raise ExpressionError(f"SHAPE_MISMATCH: {name} of {n} and {m}")

    def _array_outer(self, lhs: Value, rhs: Value) -> Value:
        x, y = self._plain(lhs, "outer", 1), self._plain(rhs, "outer", 1)
        return self._array_matmul(self._boxed(x[:, None], False), self._boxed(y[None], False))

    def _array_matmul(self, lhs: Value, rhs: Value) -> Value:
        x, timed = self._unboxed(lhs)
        y = self._plain(rhs, "matmul", 2)
        if x.ndim + timed != 2:
            raise ExpressionError("SHAPE_MISMATCH: matmul takes matrices")
        return self._contracted(x, timed, y, "matmul")

    def _contracted(self, x: np.ndarray, timed: bool, y: np.ndarray, name: str, initial: np.ndarray | None = None) -> Value:
        """The last axis of x against the first of y."""
        self._inner(x.shape[-1], len(y), name)
        out = np.empty((*x.shape[:-1], y.shape[1]), object)
        for at in np.ndindex(out.shape):
            first = [] if initial is None else [(initial[at[-1]],)]
            out[at] = self._sum_of(*first, *zip(x[at[:-1]], y[:, at[-1]], strict=True))
        return self._boxed(out, timed)

    def _array_matvec(self, m: Value, vector: Value) -> Value:
        x, timed = self._unboxed(m)
        if x.ndim + timed != 2:
            raise ExpressionError("SHAPE_MISMATCH: matvec takes a matrix")
        column = self._contracted(x, timed, self._plain(vector, "matvec", 1)[:, None], "matvec")
        return self._boxed(column.cells[..., 0], timed)

    _array_portfolio_returns = _array_matvec

    def _array_affine_contract(self, values: Value, coefficients: Value, initial: Value) -> Value:
        x, timed = self._unboxed(values)
        k, start = self._plain(coefficients, "affine_contract", 2), self._plain(initial, "affine_contract", 1)
        self._inner(k.shape[1], len(start), "affine_contract")
        return self._contracted(x, timed, k, "affine_contract", start)

    def _array_quadratic_form(self, vector: Value, m: Value) -> Value:
        x, a = self._plain(vector, "quadratic_form", 1), self._square(m, "quadratic_form")
        self._inner(len(x), len(a), "quadratic_form")
        return self._sum_of(*[(x[i], a[i, j], x[j]) for i, j in np.ndindex(a.shape)])

    def _array_diag(self, v: Value) -> Value:
        cells = self._plain(v, "diag", 1 if v.kind == ARRAY and v.cells.ndim == 1 else 2)
        if cells.ndim == 2:
            return self._boxed(np.array([cells[i, i] for i in range(min(cells.shape))], object), False)
        out = np.full((len(cells), len(cells)), Value(SCALAR, F.lit(0.0), literal=0.0), object)
        np.fill_diagonal(out, cells)
        return self._boxed(out, False)

    def _array_trace(self, v: Value) -> Value:
        cells = self._plain(v, "trace", 2)
        return self._sum_of(*[(cells[i, i],) for i in range(min(cells.shape))])

    def _pairs(self, name: str, m: Value) -> Value:
        cells, timed = self._unboxed(m)
        if not timed or cells.ndim != 1:
            raise ExpressionError(f"SHAPE_MISMATCH: {name} takes a matrix of time and assets")
        out = np.empty((len(cells), len(cells)), object)
        for i in range(len(cells)):
            for j in range(i, len(cells)):
                out[i, j] = out[j, i] = self._reduction(name, [cells[i], cells[j]])
        return self._boxed(out, False)

    def _array_covariance(self, m: Value) -> Value:
        return self._pairs("covariance", m)

    def _array_correlation(self, m: Value) -> Value:
        return self._pairs("correlation", m)

    # -- factorisations ----------------------------------------------------------------

    def _factored(self, run: Callable[..., tuple[np.ndarray, ...]], inputs: list[np.ndarray], shapes: list[tuple[int, ...]]) -> list[Value]:
        """``run`` of the matrices of every row or scalar: one Arrow function of all cells, with a code for what failed."""
        flat = [v for cells in inputs for v in cells.reshape(-1)]
        size, given_as = sum(int(np.prod(s)) for s in shapes), [x.shape for x in inputs]

        def one(cells: np.ndarray) -> np.ndarray:
            at, given = 0, []
            for shape in given_as:
                n = int(np.prod(shape))
                given.append(cells[at : at + n].reshape(shape))
                at += n
            try:
                return np.concatenate([[0.0], *[np.asarray(r, float).reshape(-1) for r in run(*given)]])
            except ValueError as e:
                if str(e) not in ERRORS:
                    raise
                return np.concatenate([[1.0 + ERRORS.index(str(e))], np.zeros(size)])

        if all(v.literal is not None for v in flat):
            made = one(np.array([v.literal for v in flat]))
            if made[0]:
                raise ExpressionError(ERRORS[int(made[0]) - 1])
            cells = np.array([Value(SCALAR, F.lit(float(x)), literal=float(x)) for x in made[1:]], object)
        else:
            names = ("code", *[f"v{i}" for i in range(size)])
            got = self._mapped(flat, lambda *c: tuple(np.array([one(np.array(row, float)) for row in zip(*c, strict=True)]).reshape(-1, size + 1).T), names)
            cells = np.array([self._combined(self._raised, [got[n], got["code"]]) for n in names[1:]], object)
        out, at = [], 0
        for s in shapes:
            n = int(np.prod(s))
            out.append(self._boxed(cells[at : at + n].reshape(s), False))
            at += n
        return out

    def _raised(self, x: Column, code: Column) -> tuple:
        value = F.coalesce(x, nan())
        if self.policy == "isolate":
            return value, code != 0, "NUMERIC_FAILURE"
        for k, error in enumerate(ERRORS, 1):
            value = F.when(code == k, F.raise_error(F.lit(error))).otherwise(value)
        return value, None, ""

    def _rhs(self, a: np.ndarray, rhs: Value, name: str, vector: bool | None) -> np.ndarray:
        cells, timed = self._unboxed(rhs)
        ranks = (1, 2) if vector is None else (1,) if vector else (2,)
        if timed or cells.ndim not in ranks or len(cells) != len(a):
            raise ExpressionError(f"SHAPE_MISMATCH: {name} takes a right side of {len(a)} rows without a time axis")
        return cells

    def _array_solve(self, m: Value, rhs: Value) -> Value:
        a = self._square(m, "solve")
        b = self._rhs(a, rhs, "solve", True)
        return self._factored(lambda x, y: (matrix.lu_solve(x, y[:, None]),), [a, b], [b.shape])[0]

    def _array_solve_multi(self, m: Value, rhs: Value) -> Value:
        a = self._square(m, "solve_multi")
        b = self._rhs(a, rhs, "solve_multi", False)
        return self._factored(lambda x, y: (matrix.lu_solve(x, y),), [a, b], [b.shape])[0]

    def _array_triangular_solve(self, m: Value, rhs: Value, lower: Value | None = None, unit: Value | None = None) -> Value:
        a = self._square(m, "triangular_solve")
        b = self._rhs(a, rhs, "triangular_solve", None)
        low, one = self._whole(lower, "triangular_solve", 0, 1), self._whole(unit, "triangular_solve", 0, 0)
        if max(low, one) > 1:
            raise ExpressionError("INVALID_PARAMETER: triangular_solve takes 0 or 1")
        return self._factored(lambda x, y: (matrix.back_substitute(x, y.reshape(len(y), -1), bool(low), bool(one)),), [a, b], [b.shape])[0]

    def _array_cholesky(self, m: Value) -> Value:
        a = self._square(m, "cholesky")
        return self._factored(lambda x: (matrix.cholesky_of(x),), [a], [a.shape])[0]

    def _array_symmetric_eigh(self, m: Value, tolerance: Value | None = None, max_sweeps: Value | None = None) -> Value:
        a = self._square(m, "symmetric_eigh")
        tol = None if tolerance is None else self._literal(tolerance, "symmetric_eigh")
        sweeps = None if max_sweeps is None else self._whole(max_sweeps, "symmetric_eigh", 1)
        if tol is not None and not tol > 0:
            raise ExpressionError("INVALID_PARAMETER: symmetric_eigh takes a tolerance > 0")
        values, vectors = self._factored(lambda x: matrix.eigh_of(x, tol, sweeps), [a], [(len(a),), a.shape])
        return Value(RECORD, fields={"eigenvalues": values, "eigenvectors": vectors})

    # -- roots ---------------------------------------------------------------------------

    def _nested(self, cells: np.ndarray, columns: dict[int, Column]) -> Column:
        """The array column of a grid, by the identity of its nodes."""
        if cells.ndim == 0:
            return columns[id(cells[()])]
        return F.array(*[self._nested(cells[i, ...], columns) for i in range(len(cells))])


#: operators that make an array of series or that a lone series may be an operand of
ARRAY_OPERATORS = {"stack", "broadcast_like", *[n[len("_array_"):] for n in vars(Arrays) if n.startswith("_array_") and n.endswith("_axis")]}
