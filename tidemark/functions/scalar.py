"""Element-wise operators as Catalyst expressions.

Each entry of ``ELEMENTWISE`` takes columns and gives (value, failed, error): ``failed`` is a condition under
which the operator has no value, or None.  Callers turn it into an error or a status.  NULL means
"no such row" and passes through; NaN is a missing value, unequal and unordered to
everything, unlike Spark's own comparisons.
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

INF = float("inf")
Result = tuple[Column, Column | None, str]


def nan() -> Column:
    return F.lit(float("nan"))


def finite(x: Column) -> Column:
    return F.abs(x) < F.lit(INF)  # NaN is the largest double


def is_nan(x: Column) -> Column:
    return F.isnan(x)


def ordered(x: Column, y: Column) -> Column:
    return ~F.isnan(x) & ~F.isnan(y)


def lower_of(x: Column, y: Column) -> Column:
    return F.when(ordered(x, y) & (y < x), y).otherwise(x)


def upper_of(x: Column, y: Column) -> Column:
    return F.when(ordered(x, y) & (x < y), y).otherwise(x)


def divide(x: Column, y: Column) -> Result:
    return x / F.when(y != 0, y), y == 0, "DIVIDE_BY_ZERO"


def whole_part(x: Column) -> Column:
    """floor that stays a double; large values, NaN and infinities pass."""
    return F.when(F.abs(x) < F.lit(2.0**53), F.floor(F.when(F.abs(x) < F.lit(2.0**53), x)).cast("double")).otherwise(x)


def _horner(coefficients: tuple[float, ...], x: Column) -> Column:
    out = F.lit(coefficients[0])
    for c in coefficients[1:]:
        out = out * x + F.lit(c)
    return out


#: Published rational approximation of the normal quantile (central and tail numerators and denominators).
_PPF_CENTRE = (-3.969683028665376e1, 2.209460984245205e2, -2.759285104469687e2, 1.383577518672690e2, -3.066479806614716e1, 2.506628277459239)
_PPF_CENTRE_D = (-5.447609879822406e1, 1.615858368580409e2, -1.556989798598866e2, 6.680131188771972e1, -1.328068155288572e1, 1.0)
_PPF_TAIL = (-7.784894002430293e-3, -3.223964580411365e-1, -2.400758277161838, -2.549732539343734, 4.374664141464968, 2.938163982698783)
_PPF_TAIL_D = (7.784695709041462e-3, 3.224671290700398e-1, 2.445134137142996, 3.754408661907416, 1.0)
_PPF_EDGE = 0.02425


def normal_ppf(p: Column) -> Result:
    bad = (p <= 0) | ((p >= 1) & ~F.isnan(p))
    low, high = p < _PPF_EDGE, p > 1 - _PPF_EDGE
    q = F.sqrt(-2.0 * F.ln(F.when(low, p).otherwise(1.0 - p)))
    tail = _horner(_PPF_TAIL, q) / _horner(_PPF_TAIL_D, q)
    c = p - 0.5
    centre = _horner(_PPF_CENTRE, c * c) * c / _horner(_PPF_CENTRE_D, c * c)
    value = F.when(F.isnan(p), p).when(low, tail).when(high, -tail).otherwise(centre)
    return F.when(~bad, value).otherwise(nan()), bad, "DOMAIN_ERROR"


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """The body over a value that is computed once, however often it is named."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


TERMS, SPLIT = 60, 2.5


def _erfc_parts(x: Column, series: Callable[[Column], Column], fraction: Callable[[Column], Column]) -> Column:
    """erfc from a series near 0 and a continued fraction beyond, both to about 1e-15.

    erf(a) = 2/sqrt(pi) a exp(-a^2) (1 + 2a^2/3 (1 + 2a^2/5 (...))); erfc(a) = exp(-a^2)/sqrt(pi) / (a + 1/2/(a + 2/2/(a + ...))).
    """
    a = F.abs(x)
    near = 1.0 - F.lit(2.0 / math.sqrt(math.pi)) * a * F.exp(-a * a) * series(a * a)
    far = F.exp(-a * a) / F.lit(math.sqrt(math.pi)) / fraction(F.greatest(a, F.lit(1.0)))
    sign = F.when(x < 0, -1.0).otherwise(1.0)
    return F.when(F.isnan(x), x).otherwise((1.0 - sign) + sign * F.when(a < SPLIT, near).otherwise(far))


def erfc(x: Column) -> Column:
    """Complementary error function over any expression: folds keep the expression small."""
    steps = F.sequence(F.lit(TERMS), F.lit(1), F.lit(-1))

    def body(v: Column) -> Column:
        series = lambda s: F.aggregate(steps, F.lit(1.0), lambda t, n: 1.0 + t * s * 2.0 / (2.0 * n + 1.0))
        fraction = lambda c: F.aggregate(steps, c, lambda t, n: c + n / 2.0 / t)
        return _erfc_parts(v, series, fraction)

    return let(x, body)


def erfc_of_column(x: Column) -> Column:
    """The same, unrolled for code generation: for plain columns, as x is named over a hundred times."""

    def series(s: Column) -> Column:
        t = F.lit(1.0)
        for n in range(TERMS, 0, -1):
            t = 1.0 + t * s * F.lit(2.0 / (2 * n + 1))
        return t

    def fraction(c: Column) -> Column:
        t = c
        for n in range(TERMS, 0, -1):
            t = c + F.lit(n / 2.0) / t
        return t

    return _erfc_parts(x, series, fraction)


def _compare(f: Callable[[Column, Column], Column], unordered: bool) -> Callable[[Column, Column], Result]:
    def g(x: Column, y: Column) -> Result:
        return ((f(x, y) | ~ordered(x, y)) if unordered else (f(x, y) & ordered(x, y))), None, ""

    return g


def _plain(f: Callable[..., Column]) -> Callable[..., Result]:
    return lambda *a: (f(*a), None, "")


def _days(x: Column, y: Column) -> Column:
    ok = finite(x) & finite(y) & (x == whole_part(x)) & (y == whole_part(y)) & (y >= x)
    return F.when(ok, y - x).otherwise(nan())


def _power(x: Column, y: Column) -> Result:
    v = F.pow(x, y)
    return v, ~finite(v), "DOMAIN_ERROR"


def _exp(x: Column) -> Result:
    return F.exp(x), ~finite(F.exp(x)), "DOMAIN_ERROR"


def _default(x: Column, y: Column, d: Column) -> Column:
    return F.when(~(finite(x) & finite(y)), nan()).when(F.abs(y) < 1e-12, d).otherwise(x / F.when(F.abs(y) >= 1e-12, y))


def _clip(x: Column, lo: Column, hi: Column) -> Result:
    return lower_of(upper_of(x, lo), hi), lo > hi, "INVALID_PARAMETER"


ELEMENTWISE: dict[str, Callable[..., Result]] = {
    "add": _plain(lambda x, y: x + y),
    "subtract": _plain(lambda x, y: x - y),
    "active_returns": _plain(lambda x, y: x - y),
    "multiply": _plain(lambda x, y: x * y),
    "divide": divide,
    "power": _power,
    "minimum": _plain(lower_of),
    "maximum": _plain(upper_of),
    "negate": _plain(lambda x: -x),
    "absolute": _plain(F.abs),
    "sqrt": lambda x: (F.sqrt(F.when((x >= 0) | F.isnan(x), x)), x < 0, "DOMAIN_ERROR"),
    "clip": _clip,
    "log": lambda x: (F.when(F.isnan(x), x).otherwise(F.ln(F.when(x > 0, x))), x <= 0, "DOMAIN_ERROR"),
    "exp": _exp,
    "reciprocal": lambda x: (F.lit(1.0) / F.when(x != 0, x), x == 0, "DIVIDE_BY_ZERO"),
    "sign": _plain(lambda x: F.when(F.isnan(x), 0.0).when(x > 0, 1.0).when(x < 0, -1.0).when(x == 0, 0.0)),
    "equal": _compare(lambda x, y: x == y, False),
    "not_equal": _compare(lambda x, y: x != y, True),
    "less_than": _compare(lambda x, y: x < y, False),
    "less_equal": _compare(lambda x, y: x <= y, False),
    "greater_than": _compare(lambda x, y: x > y, False),
    "greater_equal": _compare(lambda x, y: x >= y, False),
    "logical_and": _plain(lambda x, y: x & y),
    "logical_or": _plain(lambda x, y: x | y),
    "logical_not": _plain(lambda x: ~x),
    "where": _plain(lambda m, a, b: F.when(m, a).when(~m, b)),
    "divide_or_default": _plain(_default),
    "normal_pdf": _plain(lambda x: F.exp(-0.5 * x * x) / F.lit(math.sqrt(2 * math.pi))),
    "normal_ppf": normal_ppf,
    "finite_mask": _plain(finite),
    "normal_cdf": _plain(lambda x: 0.5 * erfc(-x / F.lit(math.sqrt(2.0)))),
    "floor": _plain(whole_part),
    "cos": _plain(F.cos),
    "expm1": _plain(F.expm1),
    "days_between": _plain(_days),
    "require_positive": lambda x: (x, ~(finite(x) & (x > 0)), "DOMAIN_ERROR"),
    "require_nonnegative": lambda x: (x, ~(finite(x) & (x >= 0)), "DOMAIN_ERROR"),
    "state_select": _plain(lambda c, a, b, v: F.when(~v, F.lit(-1)).when(c, a.cast("long")).otherwise(b.cast("long")).cast("long")),
}

BOOLEAN = {
    "equal", "not_equal", "less_than", "less_equal", "greater_than", "greater_equal", "logical_and", "logical_or", "logical_not", "finite_mask",
}


def checked(name: str, *columns: Column) -> Column:
    """The operator as one column that raises where it has no value."""
    value, failed, error = ELEMENTWISE[name](*columns)
    return value if failed is None else F.when(failed, F.raise_error(F.lit(error))).otherwise(value)
