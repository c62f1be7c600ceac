"""Compiles metric expressions to one shared Spark plan.

All roots share a hash-consed graph: equal sub-expressions are computed once.  Element-wise nodes stay
expressions.  Window nodes are added stage by stage, all of one depth in one projection over one partitioning and order.
Reductions that only feed scalars end in a single groupBy with partial aggregation; those that feed
series become windows.  Sequential nodes of one depth run in one Arrow task, many groups a batch.  Scopes are child plans over
finer groups of the same rows: their key is added to the partitioning columns, so that they need a sort but no other shuffle.

``error_policy="raise"`` fails the query where an operator has no value; ``"isolate"`` gives NaN and a
status column per root: 0 fine, 2 division by a scalar zero, 3 scalar domain error, 4 any other failure.
Statuses follow the data through every dependency, also through branches that ``where`` doesn't take.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from tidemark.functions.catalog import ALIASES, CATALOG
from tidemark.functions.reduce import FIT, REDUCTIONS
from tidemark.functions.scalar import BOOLEAN, ELEMENTWISE, erfc_of_column, finite, nan
from tidemark.operators.groups import in_groups
from tidemark.operators.kernels import KERNELS
from tidemark.plans import numeric
from tidemark.plans.arrays import ARRAY_OPERATORS, Arrays
from tidemark.plans.expr import Call, ExpressionError, Name, Node, Number, parse
from tidemark.plans.expr import names as names_of
from tidemark.plans.frame import POS, IntervalFrame
from tidemark.plans.numeric import Groups
from tidemark.plans.value import ARRAY, RECORD, SCALAR, SERIES, WINDOW, Value, common_drop, deep

STATUS = {"DIVIDE_BY_ZERO": 2, "DOMAIN_ERROR": 3}
SOLVER = {1: "INVALID_PARAMETER", 2: "NONFINITE_RESULT", 3: "ROOT_NOT_BRACKETED", 4: "NON_CONVERGENCE"}
REWRITES = {
    "mean_absolute_deviation": "mean(absolute(a - mean(a)))",
    "total_return": "product(a + 1) - 1",
    "annualized_return": "power(require_nonnegative(product(a + 1)), b / length(a)) - 1",
    "cumulative_return": "cumulative_product(a + 1) - 1",
}


LINEAR = {"add", "subtract", "multiply", "negate", "active_returns", "logical_and", "logical_or", "logical_not", "absolute", "cos", "expm1"}
HEAVY = 24


@dataclass(eq=False)
class Child:
    """A scope: how rows enter its groups, its plan, and the values that its bodies leave on each row."""

    plan: Plan
    key: str
    level: int  # where its values exist in the plan around it
    enter: Callable[[DataFrame, str], DataFrame]
    leave: Callable[[DataFrame, str, list[str]], DataFrame]
    bodies: list[tuple[str, Column]] = field(default_factory=list)
    keeps: list[Column] = field(default_factory=list)  # its own columns that the plan around it reads
    dense: bool = False

    def apply(self, df: DataFrame) -> DataFrame:
        outer = self.key + "p"
        inner = self.enter(df.withColumn(outer, F.col(POS)), self.key)
        if self.dense:
            at = Window.partitionBy(*self.plan.frame.keys).orderBy(outer)
            inner = inner.select(*[c for c in inner.columns if c != POS], (F.row_number().over(at) - 1).cast("long").alias(POS))
        inner = self.plan._staged(inner)
        names = [n for n, _ in self.bodies]
        inner = self.leave(inner.select("*", *[c.alias(n) for n, c in self.bodies]), self.key, names)
        return inner.select(*[F.col(outer if c == POS else c).alias(c) for c in df.columns], *self.keeps, *names)


class Plan(Arrays):
    """A compiled set of roots over a frame."""

    def __init__(self, frame: IntervalFrame, fields: set[str], parameters: dict[str, float] | None = None, error_policy: str = "raise") -> None:
        if error_policy not in ("raise", "isolate"):
            raise ValueError("error_policy is raise or isolate")
        self.frame, self.fields, self.policy = frame, fields, error_policy
        self.parameters, self.memo, self.values = dict(parameters or {}), {}, []
        self.types = dict(frame.data.dtypes)
        self.stages: dict[int, list[tuple[str, Column]]] = {}
        self.kernels: dict[int, list[tuple[list[str], list[Value], Callable, tuple[str, ...], Callable | None]]] = {}
        self.transforms: dict[int, list[Callable[[DataFrame], DataFrame]]] = {}
        self.children: dict[tuple, Child] = {}
        self.locals: dict[str, Value] = {}
        self.bindings: dict[str, Node] = {}
        self.used: set[str] = set()
        self.frame_mask: Column | None = None
        self.mask_level, self.pos_name = 0, POS
        self.frame_rows: tuple[int, int] | None = None

    # -- graph ---------------------------------------------------------------

    def node(self, tree: Node) -> Value:
        if isinstance(tree, Call) and tree.function not in _SCOPES:
            tree = Call(ALIASES.get(tree.function, tree.function), tree.args)
        key = (tree, self._scope_key())
        if key not in self.memo:
            self.memo[key] = self._make(tree)
        return self.memo[key]

    def _scope_key(self) -> tuple:
        return (self.frame_rows, id(self.frame_mask) if self.frame_mask is not None else None, tuple(sorted((k, id(v)) for k, v in self.locals.items())))

    def _make(self, tree: Node) -> Value:
        if isinstance(tree, Number):
            return Value(SCALAR, F.lit(tree.value), literal=tree.value)
        if isinstance(tree, Name):
            if tree.name in self.locals:
                return self.locals[tree.name]
            if tree.name in self.bindings:
                return self.node(self.bindings[tree.name])
            if tree.name in self.fields:
                c = F.col(tree.name)
                self.used.add(tree.name)
                masked = c if self.frame_mask is None else F.when(self.frame_mask, c)
                kind = self.types[tree.name]
                return Value(SERIES, masked, self.mask_level if self.frame_mask is not None else 0, dtype="boolean" if kind == "boolean" else "long" if kind in ("bigint", "int") else "double")
            if tree.name in self.parameters:
                v = float(self.parameters[tree.name])
                return Value(SCALAR, F.lit(v), literal=v)
            raise ExpressionError(f"unknown name {tree.name}")
        if tree.function in _SCOPES:
            return getattr(self, "_" + tree.function.replace(" ", "_"))(*tree.args)
        if tree.function not in CATALOG:
            raise ExpressionError(f"unknown function {tree.function}")
        op = CATALOG[tree.function]
        if not op.accepts(len(tree.args)):
            raise ExpressionError(f"{op.name} takes {len(op.required)} to {len(op.required) + len(op.optional)} arguments")
        if op.name in REWRITES:
            return self._inline(parse(REWRITES[op.name]), dict(zip("ab", tree.args, strict=False)))
        args = [self.node(a) for a in tree.args]
        if args and args[0].kind == WINDOW:
            return self._rolling_reducer(op.name, args[0])
        if op.name in ARRAY_OPERATORS or any(a.kind == ARRAY for a in args):
            return self._array(op.name, args)
        for table, make in ((ELEMENTWISE, self._elementwise), (REDUCTIONS, self._reduction), (KERNELS, self._kernel)):
            if op.name in table:
                return make(op.name, args)
        if handler := getattr(self, "_op_" + op.name, None):
            return handler(*args)
        raise ExpressionError(f"{op.name} works on arrays: bind one, or use the frames of tidemark.operators")

    def _inline(self, body: Node, binding: dict[str, Node]) -> Value:
        return self.node(_put(body, binding))

    @staticmethod
    def _level(args: list[Value]) -> int:
        return max((a.level for a in args), default=0)

    def _read(self, v: Value) -> Column:
        """The value as a column inside a row of the frame; a delayed reduction becomes a window."""
        if v.reduction is not None and v.column is None:
            v.column, v.status = self._windowed(v)
        return v.column

    def _status_of(self, args: list[Value]) -> list[Column]:
        return [a.status for a in args if a.status is not None]

    def _guard(self, value: Column, failed: Column | None, error: str, args: list[Value], scalar: bool, dtype: str = "double", policy: str | None = None) -> tuple[Column, Column | None]:
        if (policy or self.policy) == "raise":
            return (value if failed is None else F.when(failed, F.raise_error(F.lit(error or "NUMERIC_FAILURE"))).otherwise(value)), None
        codes = self._status_of(args)
        if failed is not None:
            codes.append(F.when(failed, F.lit(STATUS.get(error, 4) if scalar else 4)).otherwise(F.lit(0)))
        if not codes:
            return value, None
        status = codes[0] if len(codes) == 1 else F.greatest(*codes)
        empty = {"double": nan(), "boolean": F.lit(False), "long": F.lit(0).cast("long")}[dtype]
        return F.when(status != 0, empty).otherwise(value), status

    def _elementwise(self, name: str, args: list[Value]) -> Value:
        kind = SERIES if any(a.kind == SERIES for a in args) else SCALAR
        drop = common_drop(name, args)
        if args and all(a.literal is not None for a in args) and name in numeric.ELEMENT and name not in BOOLEAN:
            with np.errstate(all="ignore"):
                folded = float(numeric.ELEMENT[name](*[a.literal for a in args]))
            if math.isfinite(folded):
                return Value(SCALAR, F.lit(folded), literal=folded)
        dtype = "boolean" if name in BOOLEAN else "long" if name == "state_select" else "double"
        if name in ("where",) and all(a.dtype == args[1].dtype for a in args[1:]):
            dtype = args[1].dtype
        if kind == SCALAR and any(a.reduction is not None for a in deep(args)):
            return self._combined(ELEMENTWISE[name], args, dtype)
        if name == "normal_cdf" and kind == SERIES and not self.locals:
            level = args[0].level + 1
            z = self._stage(-self._read_series(args[0]) / F.lit(math.sqrt(2.0)), level)
            return Value(SERIES, 0.5 * erfc_of_column(z), level, args[0].status, drop=args[0].drop, parents=tuple(args))
        columns = [self._read_series(a) for a in args]
        size = sum(a.weight for a in args)
        if size > HEAVY and name not in LINEAR:
            for a in args:
                self._settle(a)
            columns, size = [a.column for a in args], sum(a.weight for a in args)
        value, failed, error = ELEMENTWISE[name](*columns)
        column, status = self._guard(value, failed, error, args, kind == SCALAR, dtype)
        size = size * (1 if name in LINEAR and self.policy == "raise" else 3) + 1
        return Value(kind, column, self._level(args), status, drop=drop, parents=tuple(args), dtype=dtype, weight=size)

    def _settle(self, v: Value) -> None:
        """Turns a large series expression into a column of its own stage, so that operators that name it often stay small."""
        if v.kind == SERIES and v.weight > 8:
            v.level += 1
            v.column = self._stage(v.column, v.level)
            v.status = None if v.status is None else self._stage(v.status, v.level)
            v.weight = 1

    def _read_series(self, v: Value) -> Column:
        """A value where a series consumes it."""
        for d in deep([v]):
            d.feeds_series = True
        return self._read(v)

    def _windowed(self, v: Value) -> tuple[Column, Column | None]:
        if v.name == "scalar":
            def read(a: Value) -> tuple[Column, Column | None]:
                return self._read(a), a.status

            value, status = v.reduction(read)
            v.level = self._level(list(v.parents))
            if v.dtype != "record":
                return value, status
            v.level += 1
            return self._stage(value, v.level), None if status is None else self._stage(status, v.level)
        level = self._level(list(v.parents)) + 1
        spec = self._spec()
        value, status = v.reduction(lambda c: c.over(v_spec) if (v_spec := spec) is not None else c)
        name = f"_w{len(self.values)}"
        self.values.append(v)
        self.stages.setdefault(level, []).append((name, value))
        v.level = level
        if status is not None:
            self.stages[level].append((name + "s", status))
            return F.col(name), F.col(name + "s")
        return F.col(name), None

    def _spec(self):
        if self.frame_rows is not None:
            return self.frame.ordered().rowsBetween(*self.frame_rows)
        return self.frame.partition()

    def _reduction(self, name: str, args: list[Value]) -> Value:
        pos = F.col(self.pos_name)
        if name in PROBABILITY:
            p = self._literal(args[-1], name)
            if not 0 < p < 1:
                raise ExpressionError(f"INVALID_PARAMETER: {name} takes 0 < probability < 1")
        if name in ("variance", "std") and len(args) > 1:
            self._whole(args[1], name, 0)
        return self._reduce(lambda o: REDUCTIONS[name](pos, o, *[self._read_series(a) for a in args]), args)

    def _reduce(self, form: Callable, args: list[Value], dtype: str = "double") -> Value:
        inner = [a for a in args if a.kind in (SERIES, SCALAR)]
        for a in inner:
            self._read_series(a)

        policy = self.policy

        def build(o: Callable[[Column], Column]) -> tuple[Column, Column | None]:
            value, failed, error = form(o)
            if policy == "raise":
                return (value if failed is None else F.when(failed, F.raise_error(F.lit(error))).otherwise(value)), None
            codes = [F.coalesce(o(F.max(s)), F.lit(0)) for s in self._status_of(inner)]
            bad = ~finite(value) | value.isNull() if dtype == "double" else F.lit(False)
            codes.append(F.when((failed if failed is not None else F.lit(False)) | bad, 4).otherwise(0))
            status = codes[0] if len(codes) == 1 else F.greatest(*codes)
            return F.when(status == 0, value).otherwise(nan()), status

        v = Value(SCALAR, None, self._level(inner), reduction=build, parents=tuple(inner), dtype=dtype)
        if self.frame_rows is not None:
            v.column, v.status = self._windowed(v)
            v.kind, v.reduction = SERIES, None
        return v

    def _stage(self, column: Column, level: int) -> Column:
        name = f"_w{len(self.values)}"
        self.values.append(column)
        self.stages.setdefault(level, []).append((name, column))
        return F.col(name)

    def _window(self, form: Callable[[list[Column], object, object], tuple[Column, Column | None, str]], args: list[Value], dtype: str = "double", drop: int | None = None) -> Value:
        columns = [self._read_series(a) for a in args]
        level = self._level(args) + 1
        value, failed, error = form(columns, self.frame.prefix(), self.frame.partition())
        if self.policy == "raise":
            if failed is not None:
                value = F.when(failed, F.raise_error(F.lit(error))).otherwise(value)
            status = None
        else:
            codes = [F.coalesce(F.max(s).over(self.frame.partition()), F.lit(0)) for s in self._status_of(args)]
            if failed is not None:
                codes.append(F.when(failed, 4).otherwise(0))
            status = None if not codes else self._stage(codes[0] if len(codes) == 1 else F.greatest(*codes), level)
        c = self._stage(value, level)
        if status is not None:
            c = F.when(status == 0, c).otherwise({"double": nan(), "boolean": F.lit(False), "long": F.lit(0).cast("long")}[dtype])
        return Value(SERIES, c, level, status, drop=common_drop("a window", args) if drop is None else drop, parents=tuple(args), dtype=dtype)

    def _kernel(self, name: str, args: list[Value]) -> Value:
        k = KERNELS[name]
        given = [args[i] if i < len(args) else None for i in k.order]
        series = given[: k.series]
        constants = [k.defaults[i] if v is None else self._literal(v, name) for i, v in zip(k.order[k.series :], given[k.series :], strict=True)]
        integer = k.integer
        return self._run_kernel(lambda *a: k.run(*a, *constants), series, k.outputs, integer)

    def _run_kernel(self, run: Callable, series: list[Value], outputs: tuple[str, ...], integer: bool, many: Callable | None = None) -> Value:
        """``run`` of the arrays of each group; ``many``, if there is one, takes all groups of a batch at once."""
        for a in series:
            self._read_series(a)
        level = self._level(series) + 1
        names = [f"_k{len(self.values)}_{o}" for o in outputs]
        self.values.append(None)
        kinds = ("long" if integer else "double",) * len(outputs)
        self.kernels.setdefault(level, []).append((names, series, run, kinds, many))
        fields = {o: Value(SERIES, F.col(n), level, self._all_status(series, level), parents=tuple(series), dtype=kinds[0], drop=series[0].drop) for o, n in zip(outputs, names, strict=True)}
        return fields[outputs[0]] if len(outputs) == 1 else Value(RECORD, None, level, fields=fields)

    def _all_status(self, series: list[Value], level: int) -> Column | None:
        codes = self._status_of(series)
        return F.coalesce(*[self._stage(F.max(F.greatest(*codes, F.lit(0))).over(self.frame.partition()), level)]) if codes else None

    @staticmethod
    def _literal(v: Value, name: str) -> float:
        if v.literal is None:
            raise ExpressionError(f"{name} needs constants for its parameters")
        return v.literal

    def _whole(self, v: Value | None, name: str, least: int, default: int = 1) -> int:
        """An integral constant of at least ``least``."""
        x = float(default) if v is None else self._literal(v, name)
        if x != math.floor(x) or x < least:
            raise ExpressionError(f"INVALID_PARAMETER: {name} takes a whole number of at least {least}")
        return int(x)

    # -- window operators ------------------------------------------------------

    def _first_sticks(self, x: Column, prefix, best: Column) -> Column:  # noqa: ANN001
        return F.when(x.isNotNull(), F.when(F.isnan(F.first(x).over(prefix)), nan()).otherwise(best))

    def _op_cumulative_sum(self, x):
        return self._window(lambda c, p, _: (F.when(c[0].isNotNull(), F.sum(c[0]).over(p)), None, ""), [x])

    def _op_cumulative_product(self, x):
        return self._window(lambda c, p, _: (F.when(c[0].isNotNull(), F.product(c[0]).over(p)), None, ""), [x])

    def _op_cumulative_max(self, x):
        return self._window(lambda c, p, _: (self._first_sticks(c[0], p, F.max(F.when(~F.isnan(c[0]), c[0])).over(p)), None, ""), [x])

    def _op_cumulative_min(self, x):
        return self._window(lambda c, p, _: (self._first_sticks(c[0], p, F.min(F.when(~F.isnan(c[0]), c[0])).over(p)), None, ""), [x])

    @staticmethod
    def _levels_fail(x: Column, whole) -> Column:  # noqa: ANN001
        return F.max(F.when(x.isNotNull() & ~(finite(x) & (x > 0)), 1).otherwise(0)).over(whole) == 1

    def _op_drawdown_series(self, x):
        return self._window(lambda c, p, w: (c[0] / F.max(c[0]).over(p) - 1.0, self._levels_fail(c[0], w), "DOMAIN_ERROR"), [x])

    def _op_new_high_mask(self, x):
        before = self.frame.ordered().rowsBetween(Window.unboundedPreceding, -1)
        form = lambda c, p, w: (F.when(c[0].isNotNull(), F.coalesce(c[0] > F.max(c[0]).over(before), F.lit(True))), self._levels_fail(c[0], w), "DOMAIN_ERROR")
        return self._window(form, [x], "boolean")

    def _shortened(self, c: Column, k: int) -> tuple[Column, Column]:
        """True where the series without its last k rows still has a row, and where it hadn't so many."""
        n = F.count(c).over(self.frame.partition())
        return F.col(POS) < n - k, (n <= k) & (n > 0) & F.lit(k > 0)

    def _op_lag(self, x, periods=None):
        k = self._whole(periods, "lag", 0)

        def form(c, p, w):
            there, short = self._shortened(c[0], k)
            return F.when(there, c[0]), short, "INVALID_PARAMETER"

        return self._window(form, [x], x.dtype, _less(x.drop, k))

    def _op_difference(self, x, periods=None):
        k = self._whole(periods, "difference", 1)
        form = lambda c, p, w: (F.lead(c[0], k).over(self.frame.ordered()) - c[0], self._shortened(c[0], k)[1], "INVALID_PARAMETER")
        return self._window(form, [x], x.dtype, _less(x.drop, k))

    def _op_aligned_shift(self, x, periods=None, fill=None):
        k = self._whole(periods, "aligned_shift", 0)
        value = F.lit(self._literal(fill, "aligned_shift")) if fill else nan()
        shifted = lambda c: F.when(F.col(POS) < k, value).otherwise(F.lag(c, k).over(self.frame.ordered()) if k else c)
        return self._window(lambda c, p, w: (F.when(c[0].isNotNull(), shifted(c[0])), None, ""), [x])

    def _rolling(self, f: Callable[[Column], Column], x: Value, width: int, least: int, ddof: int = -1) -> Value:
        frame = self.frame.ordered().rowsBetween(1 - width, 0)

        def form(c, p, w):
            good = F.when(finite(c[0]), c[0])
            n = F.count(good).over(frame)
            return F.when(c[0].isNotNull(), F.when((n >= least) & (n > ddof), f(good, n, frame)).otherwise(nan())), None, ""

        return self._window(form, [x])

    def _widths(self, name: str, window: Value, least: Value | None) -> tuple[int, int]:
        w = self._whole(window, name, 1)
        m = self._whole(least, name, 1, w)
        if m > w:
            raise ExpressionError(f"INVALID_PARAMETER: {name} takes 1 <= min_periods <= window")
        return w, m

    def _op_rolling_mean(self, x, window, least=None):
        return self._rolling(lambda g, n, f: F.avg(g).over(f), x, *self._widths("rolling_mean", window, least))

    def _op_rolling_min(self, x, window, least=None):
        return self._rolling(lambda g, n, f: F.min(g).over(f), x, *self._widths("rolling_min", window, least))

    def _op_rolling_max(self, x, window, least=None):
        return self._rolling(lambda g, n, f: F.max(g).over(f), x, *self._widths("rolling_max", window, least))

    def _op_rolling_std(self, x, window, ddof=None, least=None):
        d = self._whole(ddof, "rolling_std", 0, 0)
        return self._rolling(lambda g, n, f: F.sqrt(F.var_pop(g).over(f) * n / (n - d)), x, *self._widths("rolling_std", window, least), d)

    def _op_max_consecutive_true(self, m):
        run = self._window(lambda c, p, w: (F.sum(F.when(c[0], 0).otherwise(1)).over(p), None, ""), [m], "long")
        within = Window.partitionBy(*self.frame.keys, run.column)
        size = self._stage(F.count(F.when(self._read(m), 1)).over(within), run.level + 1)
        return self._reduce(lambda o: (F.coalesce(o(F.max(size)), F.lit(0)).cast("double"), None, ""), [Value(SERIES, size, run.level + 1, m.status)])

    # -- records ---------------------------------------------------------------

    def _op_linear_fit(self, x, y=None):
        args, pos = [x] if y is None else [x, y], F.col(self.pos_name)
        fields = {k: self._reduce(lambda o, f=f: f(pos, o, *[self._read_series(a) for a in args]), args) for k, f in FIT.items()}
        return Value(RECORD, fields=fields)

    def _op_last_drawdown_interval(self, dd):
        c = self._read_series(dd)
        zero = F.when(c == 0, F.col(POS))
        deep = self._stage(F.min(F.when(c < 0, F.struct(c.alias("v"), (-F.col(POS)).alias("p")))).over(self.frame.partition()), dd.level + 1)
        ok = self._stage(F.min(F.when(c.isNull(), True).otherwise(finite(c) & (c <= 0) & (c >= -1) & ((F.col(POS) > 0) | (c == 0)))).over(self.frame.partition()), dd.level + 1)
        trough = -deep["p"]
        base = Value(SERIES, c, dd.level + 1, dd.status)

        def part(f: Callable) -> Value:
            return self._reduce(lambda o: (F.when(o(F.min(ok)), F.coalesce(f(o).cast("double"), nan())).otherwise(nan()), None, ""), [base], "record")

        fields = {
            "start": part(lambda o: o(F.max(F.when(zero < trough, zero)))),
            "trough": part(lambda o: o(F.max(trough))),
            "recovery": part(lambda o: o(F.min(F.when(zero > trough, zero)))),
        }
        state = lambda o: (F.when(o(F.min(ok)), F.when(o(F.max(trough)).isNull(), 0.0).otherwise(1.0)).otherwise(-1.0), None, "")
        fields["status"] = self._reduce(state, [base], "record")
        return Value(RECORD, fields=fields)

    def _op_between_events(self, events):
        c = self._read_series(events)
        run = self._stage(F.sum(F.when(c == -2, 1).otherwise(0)).over(self.frame.prefix()), events.level + 1)
        w = Window.partitionBy(*self.frame.keys, run).orderBy(POS)
        turn = F.when(c.isin(1, -1), F.struct(F.col(POS).alias("p"), c.alias("k")))
        left = F.last(turn, True).over(w.rowsBetween(Window.unboundedPreceding, 0))
        right = F.first(turn, True).over(w.rowsBetween(1, Window.unboundedFollowing))
        both = self._stage(F.when(left.isNotNull() & right.isNotNull() & (left["k"] != right["k"]), F.struct(left["p"].alias("s"), right["p"].alias("e"))), events.level + 2)
        fields = {k: Value(SERIES, F.coalesce(both[f], F.lit(-1).cast("long")), events.level + 2, events.status, dtype="long") for k, f in (("start", "s"), ("end", "e"))}
        return Value(RECORD, fields=fields)

    def _segments_of(self, segments: Value) -> tuple[Column, Column, int, Column | None]:
        if segments.kind != RECORD or set(segments.fields) != {"start", "end"}:
            raise ExpressionError("segments come from between_events")
        a, b = segments.fields["start"], segments.fields["end"]
        return a.column, b.column, max(a.level, b.level), a.status

    def _op_phase_direction(self, events, segments):
        start, end, level, _ = self._segments_of(segments)
        c = self._read_series(events)
        level = max(level, events.level)
        inside = lambda at: F.when(at >= 0, at)
        left = self._deliver(level, F.col(POS), c, inside(start))
        right = self._deliver(level + 1, F.col(POS), c, inside(end))
        rise, fall = (left == -1) & (right == 1), (left == 1) & (right == -1)
        phase = F.when(rise, 0).when(fall, 1).otherwise(-1).cast("long")
        return Value(SERIES, phase, level + 2, self._all_status([events, *segments.fields.values()], level + 1), drop=events.drop, parents=(events,), dtype="long")

    def _op_drawdown_cycle_reference(self, phases, changes, segments, stress):
        """Marks (left, right] of each segment: 2 where a fall (phase 1) is deep enough, 1 in the rise (phase 0) after it, else 0.

        The start row has 0 at least, and 2 where a rise follows a deep fall; segments without a phase or a finite change mark nothing.
        """
        s = F.lit(self._literal(stress, "drawdown_cycle_reference"))
        start, end, level, _ = self._segments_of(segments)
        phase, change = self._read_series(phases), self._read_series(changes)
        level = max(level, phases.level, changes.level) + 1
        head = (start == F.col(POS)) & (end > F.col(POS))
        valid = phase.isin(0, 1) & finite(change)
        own = self._stage(F.when(head, F.struct(valid.alias("ok"), (phase == 0).alias("rise"), (valid & (phase == 1) & (change <= -s)).alias("deep"), end.alias("end"))), level)
        before = F.last(own, True).over(self.frame.ordered().rowsBetween(Window.unboundedPreceding, -1))
        marked = self._stage(
            F.when(own.isNotNull(), F.struct(own["ok"].alias("ok"), own["end"].alias("end"), (own["rise"] & F.coalesce(before["deep"], F.lit(False))).alias("back"), own["deep"].alias("deep"))), level + 1
        )
        last = self._stage(F.last(marked, True).over(self.frame.ordered().rowsBetween(Window.unboundedPreceding, -1)), level + 2)
        here = F.when((last["end"] >= F.col(POS)) & last["ok"], F.when(last["deep"], 2).when(last["back"], 1).otherwise(0)).otherwise(-1)
        out = F.when(marked["ok"] & marked["back"], 2).when(marked["ok"], F.greatest(here, F.lit(0))).otherwise(here)
        args = [phases, changes, *segments.fields.values()]
        return Value(SERIES, out.cast("long"), level + 2, self._all_status(args, level + 1), drop=phases.drop, parents=(phases, changes), dtype="long")

    def _op_argsort(self, x):
        c = self._read_series(x)
        place = self._stage(F.when(c.isNotNull(), F.row_number().over(self.frame.partition().orderBy(F.asc_nulls_last(c), POS)) - 1), x.level + 1)
        at = self._deliver(x.level + 1, place, F.col(POS).cast("long"), F.col(POS))
        return Value(SERIES, at, x.level + 2, self._all_status([x], x.level + 1), drop=x.drop, parents=(x,), dtype="long")

    def _op_gather(self, x, indices):
        c, at = self._read_series(x), self._read_series(indices)
        level = self._level([x, indices])
        got = self._deliver(level, F.when(c.isNotNull(), F.col(POS)), c, at, "INDEX_OUT_OF_RANGE")
        return Value(SERIES, got, level + 1, self._all_status([x, indices], level), drop=indices.drop, parents=(x, indices), dtype=x.dtype)

    def _deliver(self, level: int, place: Column, value: Column, at: Column, missing: str = "") -> Column:
        """The value that stands at the place ``at``: rows give it from ``place`` and take it by a window of the same
        partitioning, so a gather needs a sort but no join.  Inputs exist at ``level``, the result one later."""
        name = f"_d{len(self.values)}"
        self.values.append(None)
        gives, t, found = name + "g", name + "t", name + "f"

        def run(df: DataFrame) -> DataFrame:
            both = df.select("*", F.explode(F.array(F.lit(True), F.lit(False))).alias(gives))
            both = both.select(*df.columns, gives, F.when(F.col(gives), place).otherwise(at).cast("long").alias(t), F.when(F.col(gives), value).alias(name))
            w = Window.partitionBy(*self.frame.keys, t)
            both = both.where(F.col(t).isNotNull() | ~F.col(gives)).select(*df.columns, gives, t, F.max(name).over(w).alias(name), F.max(gives).over(w).alias(found))
            got = F.when(F.col(t).isNotNull(), F.col(name))
            if missing:
                got = F.when(F.col(t).isNotNull() & ~F.col(found), F.raise_error(F.lit(missing))).otherwise(got)
            return both.where(~F.col(gives)).select(*df.columns, got.alias(name))

        self.transforms.setdefault(level + 1, []).append(run)
        return F.col(name)

    # -- scopes ----------------------------------------------------------------

    def _rolling_window(self, x: Node, window: Node, least: Node | None = None) -> Value:
        w, m = self._widths("rolling_window", self.node(window), self.node(least) if least else None)
        return Value(WINDOW, window=(self.node(x), w, m))

    def _rolling_reducer(self, name: str, v: Value) -> Value:
        x, w, m = v.window
        forms = {
            "mean": (lambda g, n, f: F.avg(g).over(f), -1),
            "min_value": (lambda g, n, f: F.min(g).over(f), -1),
            "max_value": (lambda g, n, f: F.max(g).over(f), -1),
            "std": (lambda g, n, f: F.sqrt(F.var_pop(g).over(f) * n / (n - 1)), 1),
            "variance": (lambda g, n, f: F.var_pop(g).over(f) * n / (n - 1), 1),
        }
        if name not in forms:
            raise ExpressionError(f"{name} isn't a rolling_window reducer")
        f, ddof = forms[name]
        return self._rolling(f, x, w, m, ddof)

    def _rolling_apply(self, body: Node, window: Node, *rest: Node) -> Value:
        """Trailing windows of reductions: (body, width[, least]) or (body, width, dates, annual[, least]).

        Without ``least`` only full windows of finite rows count, else at least so many jointly finite rows.  With dates the
        body may name observation_count (rows less one, or rows if it reads a field whose name begins with
        ``return``), window_elapsed_days and risk_free_return_window.
        """
        w = self._whole(self.node(window), "rolling_apply", 1)
        dated = len(rest) >= 2
        least = rest[2] if len(rest) == 3 else rest[0] if len(rest) == 1 else None
        m = self._whole(self.node(least), "rolling_apply", 1) if least else None
        body = self._expanded(body)
        used = [self.node(Name(n)) for n in sorted(names_of(body) & self.fields)]
        frame = self.frame.ordered().rowsBetween(1 - w, 0)
        names: dict[str, Value] = {}
        if dated:
            dates, annual = self.node(rest[0]), self._literal(self.node(rest[1]), "rolling_apply")
            d = self._read_series(dates)
            elapsed = self._stage(F.last(d).over(frame) - F.first(d).over(frame), dates.level + 1)
            rows = self._stage(F.count(F.lit(1)).over(frame).cast("double"), dates.level + 1)
            returns = any(n.startswith("return") for n in names_of(body) & self.fields)
            growth = F.pow(F.lit(max(0.0, 1.0 + annual)), elapsed / 365.0) - 1.0
            for name, column in (("observation_count", rows if returns else rows - 1.0), ("window_elapsed_days", elapsed), ("risk_free_return_window", growth)):
                names[name] = Value(SERIES, column, dates.level + 1)
        before, self.frame_rows, policy = self.frame_rows, (1 - w, 0), self.policy
        outer, self.locals = self.locals, {**self.locals, **names}
        self.policy = "isolate"
        try:
            v = self.node(body)
        finally:
            self.frame_rows, self.policy, self.locals = before, policy, outer
        if v.kind != SERIES:
            raise ExpressionError("the body of rolling_apply must reduce")
        joint = F.lit(True)
        for u in used:
            joint = joint & finite(self._read_series(u).cast("double"))
        n, rows = F.count(F.when(joint, 1)).over(frame), F.count(F.lit(1)).over(frame)
        enough = (n >= m) if m is not None else ((n == w) & (rows == w))
        gate = self._stage(enough, self._level(used) + 1)
        column = F.when(gate & finite(v.column), v.column).otherwise(nan())
        return Value(SERIES, column, max(v.level, self._level(used) + 1), parents=(v,))

    def _interval_tail(self, x: Node) -> Value:
        """The series without its first row."""
        v = self.node(x)
        return self._window(lambda c, p, w: (F.lead(c[0], 1).over(self.frame.ordered()), None, ""), [v], v.dtype, _less(v.drop, 1))

    def _expanded(self, tree: Node) -> Node:
        """The tree with its bindings and compositions written out."""
        if isinstance(tree, Name):
            own = tree.name in self.bindings and tree.name not in self.locals
            return self._expanded(self.bindings[tree.name]) if own else tree
        if not isinstance(tree, Call):
            return tree
        name = tree.function if tree.function in _SCOPES else ALIASES.get(tree.function, tree.function)
        args = tuple(map(self._expanded, tree.args))
        return _put(parse(REWRITES[name]), dict(zip("ab", args, strict=False))) if name in REWRITES else Call(name, args)

    def _child(self, kind: str, keys: tuple, level: int, enter: Callable, leave: Callable, mask: Column | None, policy: str) -> Child:
        """The child plan of a scope; scopes of one kind over equal keys share it."""
        if self.frame_rows is not None:
            raise ExpressionError(f"{kind} can't stand inside rolling_apply")
        own = (kind, keys, self._scope_key())
        if own not in self.children:
            name = f"_g{len(self.values)}"
            self.values.append(None)
            plan = Plan(IntervalFrame(self.frame.data, (*self.frame.keys, name)), self.fields, self.parameters, policy)
            plan.values, plan.used, plan.bindings, plan.frame_mask = self.values, self.used, self.bindings, mask
            level = max([level, *(v.level for v in self.locals.values())]) + 1
            plan.locals = {k: Value(v.kind, v.column if mask is None else F.when(mask, v.column), 0, v.status, drop=v.drop, dtype=v.dtype) for k, v in self.locals.items()}
            child = self.children[own] = Child(plan, name, level, enter, leave)
            self.transforms.setdefault(level, []).append(lambda df: child.apply(df))
        return self.children[own]

    def _scoped(self, child: Child, body: Node, kind: str) -> tuple[Column, Column | None, str]:
        """The body's value a group, as a column that stands on all rows of the group, with its status."""
        body = self._expanded(body)
        child.dense |= bool(numeric.calls(body) & DENSE)
        v = child.plan.node(body)
        if v.kind != SCALAR:
            raise ExpressionError(f"the body of {kind} must reduce")
        if v.literal is not None:
            return v.column, None, v.dtype
        name = f"_s{len(self.values)}"
        self.values.append(None)
        child.bodies.append((name, child.plan._read(v)))
        if v.status is not None:
            child.bodies.append((name + "s", v.status))
        return F.col(name), None if v.status is None else F.col(name + "s"), v.dtype

    def _from_scope(self, value: Column, status: Column | None, there: Column, otherwise: Column) -> tuple[Column, Column | None]:
        """A scope's value where it has one; its failures are raised or kept as this plan's policy says."""
        if status is None:
            return F.when(there, value).otherwise(otherwise), None
        if self.policy == "isolate":
            return F.when(there, value).otherwise(otherwise), F.when(there, status).otherwise(0)
        error = F.when(status == 2, "DIVIDE_BY_ZERO").when(status == 3, "DOMAIN_ERROR").otherwise("NUMERIC_FAILURE")
        return F.when(~F.coalesce(there, F.lit(False)), otherwise).when(status != 0, F.raise_error(error)).otherwise(value), None

    def _group_apply(self, body: Node, key: Node) -> Value:
        k = self.node(key)
        c = self._read_series(k)
        child = self._child("group_apply", (key,), k.level, lambda df, own: df.withColumn(own, c), lambda df, own, names: df, self.frame_mask, self.policy)
        value, status, dtype = self._scoped(child, body, "group_apply")
        return Value(SERIES, value, child.level, status, drop=k.drop, parents=(k,), dtype=dtype)

    def _filter_apply(self, body: Node, mask: Node, default: Node | None = None) -> Value:
        m = self.node(mask)
        c = self._read_series(m)
        fallback = F.lit(self._literal(self.node(default), "filter_apply")) if default else nan()
        some = self._reduce(lambda o: (o(F.count(F.when(c, 1))).cast("double"), None, ""), [m])
        flat = numeric.calls(self._expanded(body)) <= set(ELEMENTWISE) | set(REDUCTIONS)
        v = self._filtered(body, m, c) if flat and self.frame_rows is None else self._filtered_child(body, mask, m, c)
        out = Value(SCALAR, None, 0, parents=(v, some))
        policy = self.policy

        def build(read: Callable) -> tuple:
            (x, s), (n, _) = read(v), read(some)
            s = F.lit(0) if s is None else s
            if policy == "isolate":
                return F.when(n > 0, x).otherwise(fallback), F.when(n > 0, s).otherwise(0)
            return F.when(n <= 0, fallback).when(s != 0, F.raise_error(F.lit("NUMERIC_FAILURE"))).otherwise(x), None

        out.reduction, out.name = build, "scalar"
        return out

    def _filtered(self, body: Node, m: Value, c: Column) -> Value:
        """Reductions need no group of their own: rows outside are NULL."""
        name = f"_p{len(self.values)}"
        self.values.append(None)
        if numeric.calls(self._expanded(body)) & DENSE:
            self.stages.setdefault(m.level + 1, []).append((name, F.count(F.when(c, 1)).over(self.frame.prefix()) - 1))
        else:
            name = self.pos_name
        old = self.frame_mask, self.mask_level, self.pos_name, self.policy
        self.frame_mask, self.mask_level, self.pos_name, self.policy = c, m.level + 1, name, "isolate"
        try:
            return self.node(body)
        finally:
            self.frame_mask, self.mask_level, self.pos_name, self.policy = old

    def _filtered_child(self, body: Node, mask: Node, m: Value, c: Column) -> Value:
        name = f"_m{len(self.values)}"
        self.values.append(None)

        def enter(df: DataFrame, own: str) -> DataFrame:
            return df.withColumn(own, F.coalesce(c, F.lit(False))).withColumn(name, F.col(own))

        child = self._child("filter_apply", (mask,), m.level, enter, lambda df, own, names: df, F.col(name), "isolate")
        value, status, _ = self._scoped(child, body, "filter_apply")
        on = Value(SERIES, F.when(c, value), child.level, None, parents=(m,))
        failed = Value(SERIES, F.when(c, F.lit(0) if status is None else status), child.level, None, parents=(m,))
        x = self._reduce(lambda o: (o(F.max(on.column)), None, ""), [on], "record")
        s = self._reduce(lambda o: (o(F.max(failed.column)), None, ""), [failed], "record")
        out = Value(SCALAR, None, 0, parents=(x, s), name="scalar")
        out.reduction = lambda read: (read(x)[0], F.coalesce(read(s)[0], F.lit(0)))
        return out

    def _block_apply(self, body: Node, width: Node) -> Value:
        """A value for each full block of ``width`` rows; the tail goes.  The result is as long as there are blocks."""
        w = self._whole(self.node(width), "block_apply", 1)
        name = f"_m{len(self.values)}"
        self.values.append(None)
        full = F.col(name)
        outer = self.frame_mask if self.frame_mask is not None else F.lit(True)

        def enter(df: DataFrame, own: str) -> DataFrame:
            df = df.withColumn(own, F.floor(F.col(POS) / w).cast("long"))
            n = F.count(F.when(outer, 1)).over(Window.partitionBy(*self.frame.keys, own))
            return df.select("*", (n == w).alias(name)).withColumn(POS, F.col(POS) % w)

        child = self._child("block_apply", (width,), 0, enter, lambda df, own, names: df, full, "isolate")
        if child.plan.frame_mask is not full:  # a block scope of this width is there already
            full = child.plan.frame_mask
        child.keeps.append(full)
        value, status, dtype = self._scoped(child, body, "block_apply")
        block = F.floor(F.col(POS) / w).cast("long")
        level, place = child.level, F.when(full & (F.col(POS) % w == 0), block)
        both = F.struct(value.alias("v"), (F.lit(0) if status is None else status).alias("s"))
        got = self._deliver(level, place, both, F.col(POS))
        value, status = self._from_scope(got["v"], None if status is None else got["s"], got.isNotNull(), F.lit(None))
        return Value(SERIES, value, level + 1, status, drop=("block", w), dtype=dtype)

    def _segment_apply(self, body: Node, segments: Node) -> Value:
        """A value for each segment over its rows [left, right]; it stands on [left, right), rows outside get NaN."""
        record = self.node(segments)
        start, end, level, status = self._segments_of(record)
        name = f"_m{len(self.values)}"
        self.values.append(None)

        def enter(df: DataFrame, own: str) -> DataFrame:
            head = F.when((start == F.col(POS)) & (end > F.col(POS)), F.struct(start.alias("s"), end.alias("e")))
            last = F.last(head, True).over(self.frame.ordered().rowsBetween(Window.unboundedPreceding, -1))
            df = df.select("*", F.when(last["e"] == F.col(POS), last["s"]).alias("_last"))
            copies = F.filter(F.array(F.struct(F.coalesce(F.when(start >= 0, start), F.lit(-1).cast("long")).alias("s"), F.lit(True).alias("o")), F.struct(F.col("_last").alias("s"), F.lit(False).alias("o"))), lambda x: x["s"].isNotNull())
            df = df.select("*", F.explode(copies).alias("_copy")).drop("_last")
            df = df.select("*", F.col("_copy.s").alias(own), F.col("_copy.o").alias(own + "o"), (F.col("_copy.s") >= 0).alias(name)).drop("_copy")
            return df.withColumn(POS, F.when(F.col(name), F.col(POS) - F.col(own)).otherwise(F.col(POS)))

        child = self._child("segment_apply", (segments,), level, enter, lambda df, own, names: df.where(F.col(own + "o")), F.col(name), "isolate")
        value, failed, dtype = self._scoped(child, body, "segment_apply")
        empty = {"double": nan(), "boolean": F.lit(False), "long": F.lit(-1).cast("long")}[dtype]
        value, failed = self._from_scope(value, failed, start >= 0, empty)
        codes = [s for s in (status, failed) if s is not None]
        return Value(SERIES, value, child.level, F.greatest(*codes) if len(codes) == 2 else codes[0] if codes else None, parents=tuple(record.fields.values()), dtype=dtype)

    # -- solvers -----------------------------------------------------------------

    def _hoisted(self, body: Node, unknown: str) -> tuple[Node, dict[str, Value]]:
        """The body with every part that doesn't name the unknown taken out; those are nodes of this plan."""
        inputs: dict[str, Value] = {}

        def walk(tree: Node) -> Node:
            if isinstance(tree, Number) or (isinstance(tree, Name) and tree.name == unknown):
                return tree
            if unknown not in names_of(tree):
                v = self.node(tree)
                if v.literal is not None:
                    return Number(v.literal)
                if v.kind == ARRAY:
                    raise ExpressionError(f"{unknown} can't stand beside an array")
                key = next((k for k, x in inputs.items() if x is v), f"{unknown}_{len(inputs)}")
                inputs[key] = v
                return Name(key)
            if tree.function not in numeric.ELEMENT and tree.function not in numeric.REDUCE:
                raise ExpressionError(f"{tree.function} can't take {unknown}")
            return Call(tree.function, tuple(map(walk, tree.args)))

        return walk(self._expanded(body)), inputs

    def _mapped(self, args: list[Value], run: Callable, outputs: tuple[str, ...]) -> dict[str, Value]:
        """A vectorised function of rows, or of scalars once they are known: one Arrow exchange for all outputs."""

        def f(*columns: pd.Series) -> pd.DataFrame:
            with np.errstate(all="ignore"):
                return pd.DataFrame(dict(zip(outputs, run(*[c.to_numpy(dtype=float) for c in columns]), strict=True)))

        made = F.pandas_udf(f, ", ".join(f"{o} double" for o in outputs))
        if not any(a.kind == SERIES for a in args) and any(a.reduction is not None for a in deep(args)):
            record = Value(SCALAR, None, 0, parents=tuple(args), name="scalar", dtype="record")

            def build(read: Callable) -> tuple:
                got = [read(a) for a in args]
                codes = [s for _, s in got if s is not None]
                return made(*[c.cast("double") for c, _ in got]), codes[0] if len(codes) == 1 else F.greatest(*codes) if codes else None

            record.reduction = build

            def part(o: str) -> Value:
                v = Value(SCALAR, None, 0, parents=(record,), name="scalar")
                v.reduction = lambda read: (read(record)[0][o], read(record)[1])
                return v

            return {o: part(o) for o in outputs}
        level = self._level(args) + 1
        record = self._stage(made(*[self._read_series(a).cast("double") for a in args]), level)
        codes = self._status_of(args)
        status = None if not codes else codes[0] if len(codes) == 1 else F.greatest(*codes)
        return {o: Value(SERIES, record[o], level, status, drop=common_drop("a solver", args), parents=tuple(args)) for o in outputs}

    def _checked(self, v: Value, code: Value) -> Value:
        """A solver's value, which fails where its code isn't 0."""
        out = Value(v.kind, None, v.level, parents=(v, code), drop=v.drop, name="scalar" if v.kind == SCALAR else "")
        policy = self.policy

        def build(read: Callable) -> tuple:
            (x, s), (c, _) = read(v), read(code)
            if policy == "raise":
                text = F.lit(SOLVER[4])
                for k, t in SOLVER.items():
                    text = F.when(c == k, t).otherwise(text)
                return F.when(c != 0, F.raise_error(text)).otherwise(x), None
            status = F.greatest(F.when(c != 0, 4).otherwise(0), F.lit(0) if s is None else s)
            return F.when(status == 0, x).otherwise(nan()), status

        if v.kind == SERIES:
            out.column, out.status = build(lambda a: (a.column, a.status))
        else:
            out.reduction = build
        return out

    def _solver(self, body: Node, unknown: str, args: list[Value], run: Callable, outputs: tuple[str, ...], whole: bool) -> dict[str, Value]:
        """``run(f, arrays of args)`` over rows or scalars, or over whole intervals where the body reduces the unknown's series."""
        tree, inputs = self._hoisted(body, unknown)
        names, values = list(inputs), list(inputs.values())
        reduces = bool(numeric.calls(tree) & set(numeric.REDUCE))
        ends, columns = len(args), [v.kind == SERIES for v in values]

        def solve(*arrays: np.ndarray) -> tuple:
            env = dict(zip(names, arrays[ends:], strict=True))
            rows = max((np.size(a) for a in arrays), default=1)
            return run(lambda x: numeric.evaluate(tree, env | {unknown: x}, rows), *arrays[:ends])

        everything = [*args, *values]
        series = any(a.kind == SERIES for a in everything)
        if all(a.literal is not None for a in everything):
            with np.errstate(all="ignore"):
                got = solve(*[np.array([a.literal]) for a in args])
            return {o: Value(SCALAR, F.lit(float(x[0])), literal=float(x[0])) for o, x in zip(outputs, got, strict=True)}
        if not (series and (whole or reduces)):
            return self._mapped(everything, solve, outputs)

        single = reduces and not whole  # one unknown for the interval, not one a row

        def kernel(*arrays: np.ndarray) -> tuple:
            if not len(arrays[0]):
                return tuple(np.zeros(0) for _ in outputs)
            if single:
                return many(Groups([len(arrays[0])]), *arrays)
            with np.errstate(all="ignore"):
                return tuple(np.asarray(r, float) for r in solve(*[np.asarray(a, float) for a in arrays]))

        def many(groups: Groups, *arrays: np.ndarray) -> tuple:
            """The unknowns of all groups, solved side by side."""
            own = {k: (a, True) if long else (a[groups.starts], False) for k, long, a in zip(names, columns, arrays[ends:], strict=True)}
            with np.errstate(all="ignore"):
                f = lambda x: np.asarray(numeric.evaluate_groups(tree, own | {unknown: (x, False)}, groups), float)
                return tuple(np.asarray(r, float)[groups.of] for r in run(f, *[a[groups.starts] for a in arrays[:ends]]))

        held = [a if a.kind == SERIES else Value(SERIES, self._read_series(a), a.level, a.status) for a in everything]
        made = self._run_kernel(kernel, held, outputs, False, many if single else None)
        return made.fields if len(outputs) > 1 else {outputs[0]: made}

    def _as_scalar(self, v: Value) -> Value:
        """A series that is constant in an interval as its one value."""
        return v if v.kind == SCALAR else self._reduce(lambda o: (o(F.max(v.column)), None, ""), [v], "record")

    def _bisect(self, body: Node, low: Node, high: Node, tolerance: Node, rounds: Node) -> Value:
        """A root of the body in ``solve_x`` between the ends: of scalars, or row by row where the body or an end is a series.

        A body that reduces a series of the unknown has one root an interval.  No finite values, no change of sign or too few rounds fail.
        """
        tol, n = self._literal(self.node(tolerance), "bisect"), self._whole(self.node(rounds), "bisect", 1)
        if tol <= 0 or n > MAX_ROUNDS:
            raise ExpressionError("INVALID_PARAMETER: bisect takes a tolerance > 0 and at most 10,000 rounds")
        got = self._solver(body, "solve_x", [self.node(low), self.node(high)], lambda f, a, b: numeric.bisect(f, a, b, tol, n), ("x", "code"), False)
        if all(v.literal is not None for v in got.values()):
            if got["code"].literal and self.policy == "raise":
                raise ExpressionError(SOLVER[int(got["code"].literal)])
            return Value(SCALAR, nan(), status=F.lit(4)) if got["code"].literal else got["x"]
        tree, _ = self._hoisted(body, "solve_x")
        if got["x"].kind == SERIES and numeric.calls(tree) & set(numeric.REDUCE):
            got = {k: self._as_scalar(v) for k, v in got.items()}
        return self._checked(got["x"], got["code"])

    def _iteration_record(self, body: Node, initial: Node, tolerance: Node, rounds: Node) -> Value:
        """The record of a fixed-point iteration.  A series is one state: it settles when its largest step is within the tolerance."""
        tol, n = self._literal(self.node(tolerance), "iterate"), self._whole(self.node(rounds), "iterate", 1)
        if n > MAX_ROUNDS:
            raise ExpressionError("INVALID_PARAMETER: iterate takes at most 10,000 rounds")
        first = self.node(initial)
        names = ("x", "status", "count", "residual")
        got = self._solver(body, "iterate_x", [first], lambda f, a: numeric.iterate(f, a, tol, n, True), names, True) if self._spans(body, first) else (
            self._solver(body, "iterate_x", [first], lambda f, a: numeric.iterate(f, a, tol, n, False), names, False))
        if got["x"].kind == SERIES:
            got |= {k: self._as_scalar(got[k]) for k in names[1:]}
        return Value(RECORD, fields=got)

    def _spans(self, body: Node, first: Value) -> bool:
        return first.kind == SERIES or any(v.kind == SERIES for v in self._hoisted(body, "iterate_x")[1].values())

    def _iterate(self, *args: Node) -> Value:
        return self.node(Call("iteration record", args)).fields["x"]

    def _diagnostic(self, call: Node, field_: str) -> Value:
        if not isinstance(call, Call) or call.function != "iterate":
            raise ExpressionError("diagnostics take an iterate(...)")
        return self.node(Call("iteration record", call.args)).fields[field_]

    def _iteration_status(self, call: Node) -> Value:
        return self._diagnostic(call, "status")

    def _iteration_count(self, call: Node) -> Value:
        return self._diagnostic(call, "count")

    def _iteration_residual(self, call: Node) -> Value:
        return self._diagnostic(call, "residual")

    # -- execution -------------------------------------------------------------

    def _staged(self, df: DataFrame | None = None) -> DataFrame:
        if df is None:  # only what the expressions read
            df = self.frame.data.select(*self.frame.keys, POS, *[c for c in self.frame.data.columns if c in self.used])
        for level in sorted({*self.stages, *self.kernels, *self.transforms}):
            if level in self.kernels:
                df = self._apply_kernels(df, self.kernels[level])
            if self.stages.get(level):
                df = df.select("*", *[c.alias(n) for n, c in self.stages[level]])
            for run in self.transforms.get(level, ()):
                df = run(df)
        return df

    def _apply_kernels(self, df: DataFrame, calls: list) -> DataFrame:
        inputs = [[(f"_i{i}_{j}", self._read(v)) for j, v in enumerate(c[1])] for i, c in enumerate(calls)]
        wide = df.select("*", *[c.alias(n) for group in inputs for n, c in group])
        out_names = [(n, k) for names, _, _, kinds, _ in calls for n, k in zip(names, kinds, strict=True)]
        kept = df.columns
        runs = [(c[2], [n for n, _ in group], c[0], c[3], c[4]) for c, group in zip(calls, inputs, strict=True)]

        def run(t: pa.Table, starts: np.ndarray) -> Iterator[pa.Table]:
            columns = {n: t.column(n) for n in kept}
            bounds = np.append(starts, t.num_rows)
            for f, args, names, kinds, many in runs:
                arrays, ends = zip(*[_to_numpy(t.column(a), bounds) for a in args], strict=True)
                rows = np.min([np.diff(e) for e in ends], axis=0)
                if many is not None and (rows > 0).all() and all(len(x) == rows.sum() for x in arrays):
                    made = [(bounds, v) for v in many(Groups(rows), *arrays)]
                else:
                    got = [f(*[x[e[g] : e[g] + n] for x, e in zip(arrays, ends, strict=True)]) for g, n in enumerate(rows)]
                    got = [x if isinstance(x, tuple) else (x,) for x in got]
                    made = [(np.cumsum([0, *map(len, own)]), np.concatenate(own)) for own in zip(*got, strict=True)]
                for n, kind, (at, values) in zip(names, kinds, made, strict=True):
                    columns[n] = _padded(values.astype({"long": np.int64, "double": np.float64}[kind]), at, bounds)
            yield pa.table(columns)

        schema = StructType(list(df.schema.fields))
        for n, k in out_names:
            schema = schema.add(n, k)
        return in_groups(wide, list(self.frame.keys), [POS], run, schema)

    def scalars(self, roots: dict[str, Value]) -> DataFrame:
        """One row an interval."""
        delayed: dict[Value, tuple[str, str | None]] = {}
        aggregates: list[Column] = []
        made: dict[Value, tuple[Column, Column | None]] = {}
        depths: dict[Value, int] = {}
        late: dict[int, list[Column]] = {}  # records of vectorised functions, each a column of its own after the groupBy

        def depth(v: Value) -> int:
            if v not in depths:
                depths[v] = max(map(depth, v.parents), default=0) + (v.dtype == "record") if v.name == "scalar" else 0
            return depths[v]

        def collect(v: Value) -> tuple[Column, Column | None]:
            if v.literal is not None:
                return v.column, None
            if v.column is None and v.name == "scalar":
                if v not in made:
                    made[v] = v.reduction(collect)
                    if v.dtype == "record":
                        value, status = made[v]
                        name = f"_l{len(made)}"
                        late.setdefault(depth(v), []).append(value.alias(name))
                        if status is not None:
                            late[depth(v)].append(status.alias(name + "s"))
                        made[v] = F.col(name), None if status is None else F.col(name + "s")
                return made[v]
            if v not in delayed:
                name = f"_a{len(delayed)}"
                if v.column is None:
                    value, status = v.reduction(lambda c: c)
                else:
                    value, status = F.first(v.column, True), None if v.status is None else F.max(v.status)
                aggregates.append(value.alias(name))
                if status is not None:
                    aggregates.append(status.alias(name + "s"))
                delayed[v] = (name, name + "s" if status is not None else None)
            name, status = delayed[v]
            return F.col(name), None if status is None else F.col(status)

        got = {k: collect(v) for k, v in roots.items()}
        df = self._staged().groupBy(*self.frame.keys).agg(*(aggregates or [F.count(F.lit(1)).alias("_n")]))
        for level in sorted(late):
            df = df.select("*", *late[level])
        out = []
        for k, (value, status) in got.items():
            out.append(value.alias(k))
            if self.policy == "isolate":
                out.append((status if status is not None else F.lit(0)).cast("smallint").alias(k + "_status"))
        return df.select(*self.frame.keys, *out)

    def series(self, roots: dict[str, Value]) -> DataFrame:
        """One row an interval and position; shortened series end before the others, with NULL."""
        columns = []
        for k, v in roots.items():
            columns.append(self._read(v).alias(k))
            if self.policy == "isolate":
                columns.append((v.status if v.status is not None else F.lit(0)).cast("smallint").alias(k + "_status"))
        return self._staged().select(*self.frame.keys, POS, *columns)


_SCOPES = {"interval_tail", "rolling_window", "rolling_apply", "block_apply", "group_apply", "filter_apply", "segment_apply", "bisect", "iterate", "array literal", "iteration record", "iteration_status", "iteration_count", "iteration_residual"}
#: operators that need positions without gaps inside a scope's group
DENSE = {
    "linear_slope", "linear_intercept", "linear_r_squared", "regression_standard_error", "linear_fit", "argmin", "argmax", "value_at", "lag", "difference", "aligned_shift", "last_drawdown_interval",
    "between_events", "argsort", "gather", "drawdown_cycle_reference", "phase_direction", "interval_tail", "block_apply", "segment_apply",
}
PROBABILITY = {"quantile", "quantile_where"}
MAX_ROUNDS = 10_000
_FIELD_OPS = {
    "interval_start": "start", "interval_trough": "trough", "interval_recovery": "recovery",
    "fit_slope": "slope", "fit_intercept": "intercept", "fit_residual_sum_squares": "rss", "fit_total_sum_squares": "tss", "fit_observation_count": "n",
    "state_estimate": "estimate", "state_variance": "variance",
    "continuous_state_values": "state", "continuous_state_evidence": "evidence", "continuous_state_pending": "pending_count",
    "segment_starts": "start", "segment_ends": "end", "eigenvalues": "eigenvalues", "eigenvectors": "eigenvectors",
}
for _op, _field in _FIELD_OPS.items():
    setattr(Plan, "_op_" + _op, lambda self, record, f=_field: record.fields[f])


def _put(tree: Node, binding: dict[str, Node]) -> Node:
    """The tree with names replaced."""
    if isinstance(tree, Name):
        return binding.get(tree.name, tree)
    return Call(tree.function, tuple(_put(a, binding) for a in tree.args)) if isinstance(tree, Call) else tree


def _less(drop: object, k: int) -> object:
    """The mark of a series without its last k rows."""
    return drop + k if isinstance(drop, int) else (*drop, k) if k else drop


def _to_numpy(c: pa.ChunkedArray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The rows that exist, and where the groups begin and end among them."""
    c = c.combine_chunks() if isinstance(c, pa.ChunkedArray) else c
    if c.null_count:  # rows that a shortened series doesn't have are at the end of its group
        bounds = np.append(0, np.cumsum(c.is_valid().to_numpy(zero_copy_only=False)))[bounds]
        c = c.drop_null()
    return c.to_numpy(zero_copy_only=False), bounds


def _padded(values: np.ndarray, at: np.ndarray, bounds: np.ndarray) -> pa.Array:
    """The groups' values as a column of all rows, with NULL where a group has fewer of them."""
    if len(values) == bounds[-1]:
        return pa.array(values)
    place = np.arange(len(values)) + np.repeat(bounds[:-1] - at[:-1], np.diff(at))
    out, there = np.zeros(bounds[-1], values.dtype), np.zeros(bounds[-1], bool)
    out[place], there[place] = values, True
    return pa.array(out, mask=~there)


def evaluate(
    frame: IntervalFrame,
    expressions: str | list[str] | dict[str, str],
    parameters: dict[str, float] | None = None,
    error_policy: str = "raise",
    bindings: dict[str, str] | None = None,
    minimum_observations: int = 0,
    arrays: dict[str, list] | None = None,
) -> DataFrame:
    """Evaluates the roots over every interval of the frame.

    All-scalar roots give a row an interval; otherwise a row an interval and position, scalars repeated.
    ``bindings`` name expressions that roots and later bindings may use.  Intervals with fewer rows than
    ``minimum_observations`` fail, or get status 1 and NaN.  ``arrays`` name nested lists of expressions and numbers: a list
    of series is a matrix whose first axis is time.  A root that is an array gives nested array columns, a row of a
    matrix with time on each position.
    """
    if isinstance(expressions, str):
        expressions = [expressions]
    if not isinstance(expressions, dict):
        expressions = {f"r{i}": e for i, e in enumerate(expressions)}
    fields = set(frame.data.columns) - set(frame.keys) - {POS}
    plan = Plan(frame, fields, parameters, error_policy)
    for name, e in [*(arrays or {}).items(), *(bindings or {}).items()]:
        if name in fields or name in plan.parameters or name in plan.bindings:
            raise ExpressionError(f"{name} is bound already")
        plan.bindings[name] = _tree(e)
        if name in names_of(plan.bindings[name]):
            raise ExpressionError(f"{name} names itself")
    roots = {k: plan.node(parse(e)) for k, e in expressions.items()}
    if any(v.kind in (RECORD, WINDOW) for v in roots.values()):
        raise ExpressionError("records and windows must be projected before they are a root")
    leaves: dict[int, tuple[str, Value]] = {}
    for v in roots.values():
        for cell in v.cells.reshape(-1) if v.kind == ARRAY else ():
            leaves.setdefault(id(cell), (f"_r{len(leaves)}", cell))
    plain = {k: v for k, v in roots.items() if v.kind != ARRAY} | dict(leaves.values())
    timed = any(v.timed for v in roots.values()) or any(v.kind == SERIES for v in plain.values())
    out = _plain_roots(plan, plain, not timed, minimum_observations, min(fields, default=""))
    if not leaves:
        return out
    values = {i: F.col(n) for i, (n, _) in leaves.items()}
    codes = {i: F.col(n + "_status") for i, (n, _) in leaves.items()}
    columns = []
    for k, v in roots.items():
        columns.append(plan._nested(v.cells, values).alias(k) if v.kind == ARRAY else F.col(k))
        if error_policy == "isolate":
            own = [codes[i] for i in {id(c): 0 for c in v.cells.reshape(-1)}] if v.kind == ARRAY else [F.col(k + "_status")]
            columns.append((F.greatest(*own) if len(own) > 1 else own[0]).alias(k + "_status"))
    return out.select(*frame.keys, *([POS] if timed else []), *columns)


def _tree(e: str | float | list) -> Node:
    """The syntax tree of an expression, a number or a nested list of them."""
    if isinstance(e, str):
        return parse(e)
    if isinstance(e, list | tuple | np.ndarray):
        return Call("array literal", tuple(map(_tree, e)))
    return Number(float(e))


def _plain_roots(plan: Plan, roots: dict[str, Value], scalar: bool, minimum_observations: int, some_field: str) -> DataFrame:
    if not minimum_observations:
        return plan.scalars(roots) if scalar else plan.series(roots)
    if "_rows" in roots:
        raise ExpressionError("_rows is reserved")
    size = plan.node(Call("length", (Name(some_field),)))
    out = plan.scalars(roots | {"_rows": size}) if scalar else plan.series(roots | {"_rows": size})
    short = F.col("_rows") < minimum_observations
    if plan.policy == "raise":
        return out.withColumns({k: F.when(short, F.raise_error(F.lit("INSUFFICIENT_OBSERVATIONS"))).otherwise(F.col(k)) for k in roots}).drop("_rows")
    empty = {"double": nan(), "boolean": F.lit(False)}
    kinds = dict(out.dtypes)
    held = {k: F.when(short, empty.get(kinds[k], F.lit(0).cast("long"))).otherwise(F.col(k)) for k in roots}
    held |= {f"{k}_status": F.when(short, F.lit(1).cast("smallint")).otherwise(F.col(f"{k}_status")) for k in roots}
    return out.withColumns(held).drop("_rows", "_rows_status")
