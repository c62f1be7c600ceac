"""Reductions of a series to a scalar, as aggregate expressions.

Every entry takes the position column, the argument columns and ``over``, which turns an aggregate function
into the wanted form: itself in a groupBy, a windowed column in a window.  NULL rows don't
exist for a reduction; NaN rows do.  The result is (value, failed, error) as for
element-wise operators.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from tidemark.functions.scalar import INF, Result, finite, nan

Over = Callable[[Column], Column]


def _n(o: Over, x: Column) -> Column:
    return o(F.count(x))


def _needs(k: int, f: Callable[[Over, Column], Column]) -> Callable[..., Result]:
    def g(pos: Column, o: Over, x: Column) -> Result:
        return f(o, x), _n(o, x) < k, "INSUFFICIENT_SAMPLE"

    return g


def _where(f: Callable[..., Column]) -> Callable[..., Result]:
    def g(pos: Column, o: Over, x: Column, m: Column, *rest: Column) -> Result:
        v = F.when(m, x)
        return f(o, v, *rest), _n(o, v) < 1, "INSUFFICIENT_SAMPLE"

    return g


def _spread(root: bool) -> Callable[..., Result]:
    def g(pos: Column, o: Over, x: Column, ddof: Column | float = 1.0) -> Result:
        n = _n(o, x)
        free = n - ddof
        v = o(F.var_pop(x)) * n / F.when(free > 0, free)
        return (F.sqrt(v) if root else v), free <= 0, "INSUFFICIENT_SAMPLE"

    return g


def _spread_where(root: bool) -> Callable[..., Result]:
    def g(pos: Column, o: Over, x: Column, m: Column) -> Result:
        return _spread(root)(pos, o, F.when(m, x))

    return g


def _extreme(largest: bool, at: bool) -> Callable[..., Result]:
    """The first element sticks if it is NaN; later NaN never win."""

    def g(pos: Column, o: Over, x: Column) -> Result:
        p = F.when(x.isNotNull(), pos)
        head = o(F.min_by(x, p))
        rest = F.when(~F.isnan(x), x)
        if at:
            key = F.when(x.isNotNull() & ~F.isnan(x), F.struct((-x if largest else x).alias("v"), pos.alias("p")))
            best, first = o(F.min(key))["p"].cast("double"), o(F.min(p)).cast("double")
            value = F.when(F.isnan(head), F.lit(0.0)).otherwise(best - first)
        else:
            value = F.when(F.isnan(head), nan()).otherwise(o((F.max if largest else F.min)(rest)))
        return value, _n(o, x) < 1, "INSUFFICIENT_SAMPLE"

    return g


def _skewness(o: Over, x: Column) -> Column:
    n = _n(o, x)
    return o(F.skewness(x)) * F.sqrt(n * (n - 1.0)) / F.when(n > 2, n - 2.0)


def _kurtosis(o: Over, x: Column) -> Column:
    n = _n(o, x)
    return (n - 1.0) / F.when(n > 3, (n - 2.0) * (n - 3.0)) * ((n + 1.0) * o(F.kurtosis(x)) + 6.0)


def _quantile(o: Over, x: Column, p: Column) -> Column:
    return o(F.percentile(x, p))


def _regression(pick: Callable[..., Column], least: int) -> Callable[..., Result]:
    def g(pos: Column, o: Over, x: Column, y: Column | None = None) -> Result:
        if y is None:
            x, y = F.when(x.isNotNull(), pos.cast("double")), x
        sxx, sxy, syy = o(F.regr_sxx(y, x)), o(F.regr_sxy(y, x)), o(F.regr_syy(y, x))
        n, mx, my = o(F.regr_count(y, x)).cast("double"), o(F.regr_avgx(y, x)), o(F.regr_avgy(y, x))
        bad = (n < least) | (sxx <= 0) | ~finite(sxx) | ~finite(sxy)
        return pick(n, mx, my, F.when(sxx > 0, sxx), sxy, syy), bad, "DOMAIN_ERROR"

    return g


def _rss(sxx: Column, sxy: Column, syy: Column) -> Column:
    return F.greatest(F.lit(0.0), syy - sxy * sxy / sxx)


FIT = {
    "slope": _regression(lambda n, mx, my, sxx, sxy, syy: sxy / sxx, 2),
    "intercept": _regression(lambda n, mx, my, sxx, sxy, syy: my - sxy / sxx * mx, 2),
    "rss": _regression(lambda n, mx, my, sxx, sxy, syy: _rss(sxx, sxy, syy), 2),
    "tss": _regression(lambda n, mx, my, sxx, sxy, syy: syy, 2),
    "n": _regression(lambda n, mx, my, sxx, sxy, syy: n, 2),
}


def _value_at(pos: Column, o: Over, x: Column, at: Column) -> Result:
    # ``at`` is the same for all rows of an interval; a NaN or fraction meets no position
    v = o(F.max(F.when(pos.cast("double") == at, x)))
    return F.when(v.isNotNull() & finite(v), v).otherwise(nan()), None, ""


def _correlation(pos: Column, o: Over, x: Column, y: Column) -> Result:
    sd = o(F.stddev_samp(x)) * o(F.stddev_samp(y))
    return o(F.covar_samp(x, y)) / F.when(sd > 0, sd), (_n(o, x) < 2) | (sd <= 0), "NON_FINITE_RESULT"


REDUCTIONS: dict[str, Callable[..., Result]] = {
    "sum_where": _where(lambda o, v: o(F.sum(v))),
    "mean_where": _where(lambda o, v: o(F.avg(v))),
    "variance_where": _spread_where(False),
    "std_where": _spread_where(True),
    "min_where": _where(lambda o, v: F.coalesce(o(F.min(F.when(~F.isnan(v), v))), F.lit(INF))),
    "max_where": _where(lambda o, v: F.coalesce(o(F.max(F.when(~F.isnan(v), v))), F.lit(-INF))),
    "median_where": _where(lambda o, v: o(F.percentile(v, F.lit(0.5)))),
    "quantile_where": _where(_quantile),
    "count_true": lambda pos, o, m: (o(F.count(F.when(m, 1))).cast("double"), None, ""),
    "sum": _needs(1, lambda o, x: o(F.sum(x))),
    "product": _needs(1, lambda o, x: o(F.product(x))),
    "mean": _needs(1, lambda o, x: o(F.avg(x))),
    "min_value": _extreme(False, False),
    "max_value": _extreme(True, False),
    "argmin": _extreme(False, True),
    "argmax": _extreme(True, True),
    "variance": _spread(False),
    "std": _spread(True),
    "median": _needs(1, lambda o, x: o(F.percentile(x, F.lit(0.5)))),
    "quantile": lambda pos, o, x, p: (_quantile(o, x, p), _n(o, x) < 1, "INSUFFICIENT_SAMPLE"),
    "skewness": _needs(3, _skewness),
    "excess_kurtosis": _needs(4, _kurtosis),
    "root_mean_square": _needs(1, lambda o, x: F.sqrt(o(F.avg(x * x)))),
    "first": lambda pos, o, x: (o(F.min_by(x, F.when(x.isNotNull(), pos))), _n(o, x) < 1, "INSUFFICIENT_SAMPLE"),
    "last": lambda pos, o, x: (o(F.max_by(x, F.when(x.isNotNull(), pos))), _n(o, x) < 1, "INSUFFICIENT_SAMPLE"),
    "length": lambda pos, o, x: (_n(o, x).cast("double"), None, ""),
    "distinct_count": lambda pos, o, x, m=None: (F.size(o(F.collect_set(x if m is None else F.when(m, x)))).cast("double"), None, ""),
    "dot": lambda pos, o, x, y: (F.coalesce(o(F.sum(x * y)), F.lit(0.0)), None, ""),
    "covariance": lambda pos, o, x, y: (o(F.covar_samp(x, y)), _n(o, x) < 2, "INSUFFICIENT_SAMPLE"),
    "correlation": _correlation,
    "linear_slope": FIT["slope"],
    "linear_intercept": FIT["intercept"],
    "linear_r_squared": lambda pos, o, x, y=None: _r_squared(pos, o, x, y),
    "regression_standard_error": _regression(lambda n, mx, my, sxx, sxy, syy: F.sqrt(_rss(sxx, sxy, syy) / F.when(n > 2, n - 2)), 3),
    "value_at": _value_at,
}


def _r_squared(pos: Column, o: Over, x: Column, y: Column | None) -> Result:
    value, bad, error = _regression(lambda n, mx, my, sxx, sxy, syy: 1.0 - _rss(sxx, sxy, syy) / F.when(syy > 0, syy), 2)(pos, o, x, y)
    tss, _, _ = FIT["tss"](pos, o, x, y)
    return value, bad | (tss <= 0), error
