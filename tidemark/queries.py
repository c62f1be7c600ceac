"""Registered queries of the analytics operators, each with its SQL where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.functions import finance
from tidemark.operators import axes, latent, matrix
from tidemark.plans.compiler import evaluate
from tidemark.plans.frame import POS, IntervalFrame, observations, sliced
from tidemark.plans.scopes import block_apply, segment_apply

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None) -> Callable:
    def keep(f: Callable[[SparkSession, str], DataFrame]) -> Callable:
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return keep


TIE = 1.23e-9


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    """Doubles to a fixed scale, moved off exact ties and without a negative zero, so that two engines give one text."""
    return df.select(*[(F.round(F.col(c) + F.lit(TIE), digits) + F.lit(0.0)).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes])


def sql(columns: str | dict[str, str], rest: str, keys: str = "", digits: int = 6) -> str:
    if isinstance(columns, str):
        return f"{columns} {rest}"
    body = ", ".join(f"round(CAST({x} AS DOUBLE) + {TIE}, {digits}) + CAST(0 AS DOUBLE) AS {k}" for k, x in columns.items())
    return f"SELECT {keys + ', ' if keys else ''}{body} {rest}"


def events(spark: SparkSession, sf_dir: str) -> IntervalFrame:
    """A product a user: nav (always positive), a mask, codes, and a series with missing values."""
    e = spark.read.parquet(f"{sf_dir}/events.parquet")
    nav = F.col("value") + 1.0
    fields = {
        "nav": nav,
        "buy": F.col("event_type") == "purchase",
        "code": (F.pmod("event_id", F.lit(5)) - 1).cast("long"),
        "event": (F.pmod("event_id", F.lit(11)) % 4 - 2).cast("long"),
        "gap": F.when(F.pmod("event_id", F.lit(7)) == 0, float("nan")).otherwise(nav),
        "ident": "event_id",
        "day": F.datediff("ts", F.lit("2000-01-01")).cast("double"),
    }
    return observations(e, "user_id", ["ts", "event_id"], fields)


#: the same frame in SQL
E = """e AS (SELECT user_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS pos, ts, value + 1 AS nav, event_type = 'purchase' AS buy,
 event_id % 5 - 1 AS code, event_id % 11 % 4 - 2 AS event, CASE WHEN event_id % 7 = 0 THEN CAST('nan' AS DOUBLE) ELSE value + 1 END AS gap, event_id AS ident FROM events)"""
R = E + """, r AS (SELECT *, nav / lag(nav) OVER w - 1 AS ret, lag(nav) OVER w AS prev, max(nav) OVER (w ROWS UNBOUNDED PRECEDING) AS peak,
 max(nav) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before, count(*) OVER (PARTITION BY user_id) AS n FROM e WINDOW w AS (PARTITION BY user_id ORDER BY pos))"""

RETURNS = "difference(nav) / lag(nav)"
METRICS = {
    "total": f"product({RETURNS} + 1) - 1",
    "annual": f"power(product({RETURNS} + 1), periods_per_year / length({RETURNS})) - 1",
    "mean_r": f"mean({RETURNS})",
    "std_r": f"std({RETURNS}, 1)",
    "median_r": f"median({RETURNS})",
    "min_r": f"min_value({RETURNS})",
    "max_r": f"max_value({RETURNS})",
    "q05": f"quantile({RETURNS}, 0.05)",
    "mad_r": f"mean_absolute_deviation({RETURNS})",
    "rms_r": f"root_mean_square({RETURNS})",
    "max_dd": "-min_value(drawdown_series(nav))",
    "high_share": "count_true(new_high_mask(nav)) / length(nav)",
    "slope": "linear_slope(nav)",
    "r2": "linear_r_squared(nav)",
    "up_mean": f"mean_where({RETURNS}, greater_than({RETURNS}, 0))",
    "down_std": f"std_where({RETURNS}, less_than({RETURNS}, 0))",
}
_METRICS_SQL = {
    "total": "product(ret + 1) - 1", "annual": "pow(product(ret + 1), 12.0 / count(ret)) - 1", "mean_r": "avg(ret)", "std_r": "stddev_samp(ret)",
    "median_r": "median(ret)", "min_r": "min(ret)", "max_r": "max(ret)", "q05": "quantile_cont(ret, 0.05)", "mad_r": "avg(abs(ret - mu))",
    "rms_r": "sqrt(avg(ret * ret))", "max_dd": "-min(nav / peak - 1)", "high_share": "avg(CASE WHEN pos = 0 OR nav > before THEN 1.0 ELSE 0.0 END)",
    "slope": "regr_slope(nav, pos)", "r2": "regr_r2(nav, pos)", "up_mean": "avg(CASE WHEN ret > 0 THEN ret END)", "down_std": "stddev_samp(CASE WHEN ret < 0 THEN ret END)",
}


@query(f"WITH {R}, m AS (SELECT *, avg(ret) OVER (PARTITION BY user_id) AS mu FROM r) " + sql(_METRICS_SQL, "FROM m GROUP BY user_id", "user_id", 5))
def metrics16(spark, sf_dir):  # noqa: ANN001, ANN201
    """Sixteen fund metrics over every product in one shared plan."""
    return rounded(evaluate(events(spark, sf_dir), METRICS, {"periods_per_year": 12.0}), 5)


_IV = """, iv AS (SELECT user_id, unnest([0, 1, 2]) AS interval_id, unnest([0, 10, 5]) AS s, unnest([20, 40, 1000000]) AS t FROM (SELECT DISTINCT user_id FROM e)),
 x AS (SELECT e.user_id, interval_id, pos - s AS pos, nav FROM e JOIN iv ON e.user_id = iv.user_id AND pos >= s AND pos < t)"""


@query(f"WITH {E}{_IV} " + sql({"mean_v": "avg(nav)", "slope": "regr_slope(nav, pos)", "n": "count(*)"}, "FROM x GROUP BY user_id, interval_id", "user_id, interval_id"))
def interval_metrics(spark, sf_dir):  # noqa: ANN001, ANN201
    """Overlapping intervals of each product."""
    f = events(spark, sf_dir)
    users = f.data.select("user_id").distinct()
    spans = F.array(*[F.struct(F.lit(i).alias("interval_id"), F.lit(a).alias("start_pos"), F.lit(b).alias("end_pos")) for i, (a, b) in enumerate([(0, 20), (10, 40), (5, 1_000_000)])])
    iv = users.select("user_id", F.explode(spans).alias("s")).select("user_id", "s.*")
    return rounded(evaluate(sliced(f, iv), {"mean_v": "mean(nav)", "slope": "linear_slope(nav)", "n": "length(nav)"}))


_NAN = "CAST('nan' AS DOUBLE)"
_FIN = "isfinite(gap)"
_ARITH = {
    "add": ("nav + gap", "nav + gap"), "subtract": ("nav - gap", "nav - gap"), "multiply": ("nav * gap", "nav * gap"), "divide": ("gap / nav", "gap / nav"),
    "power": ("nav ** 0.5", "pow(nav, 0.5)"), "minimum": ("minimum(gap, 20)", "CASE WHEN isnan(gap) THEN gap ELSE least(gap, 20) END"),
    "maximum": ("maximum(30, gap)", "CASE WHEN isnan(gap) THEN 30 ELSE greatest(gap, 30) END"), "negate": ("-nav", "-nav"), "absolute": ("abs(20 - nav)", "abs(20 - nav)"),
    "sqrt": ("sqrt(nav)", "sqrt(nav)"), "clip": ("clip(gap, 10, 50)", "CASE WHEN isnan(gap) THEN gap ELSE least(greatest(gap, 10), 50) END"), "log": ("log(nav)", "ln(nav)"),
    "exp": ("exp(nav / 100)", "exp(nav / 100)"), "reciprocal": ("reciprocal(nav)", "1 / nav"), "sign": ("sign(gap - 20)", "CASE WHEN isnan(gap) THEN 0 ELSE sign(gap - 20) END"),
    "divide_or_default": ("divide_or_default(gap, nav * 0, 7)", f"CASE WHEN {_FIN} THEN 7 ELSE {_NAN} END"), "normal_pdf": ("normal_pdf(nav / 50)", "exp(-0.5 * (nav / 50) * (nav / 50)) / sqrt(2 * pi())"),
    "floor": ("floor(gap)", "floor(gap)"), "cos": ("cos(nav)", "cos(nav)"), "expm1": ("expm1(nav / 1000)", "exp(nav / 1000) - 1"), "active_returns": ("active_returns(nav, 3)", "nav - 3"),
}


@query(f"WITH {E} " + sql({k: v[1] for k, v in _ARITH.items()}, "FROM e", "user_id, pos"))
def op_elementwise(spark, sf_dir):  # noqa: ANN001, ANN201
    """Operators 1-15, 55, 72, 103, 125, 126 and 187."""
    return rounded(evaluate(events(spark, sf_dir), {k: v[0] for k, v in _ARITH.items()}))


_PPF_A, _PPF_B = "-39.69683028665376 220.9460984245205 -275.9285104469687 138.3577518672690 -30.66479806614716 2.506628277459239", "-54.47609879822406 161.5858368580409 -155.6989798598866 66.80131188771972 -13.28068155288572 1.0"
_PPF_C, _PPF_D = "-0.007784894002430293 -0.3223964580411365 -2.400758277161838 -2.549732539343734 4.374664141464968 2.938163982698783", "0.007784695709041462 0.3224671290700398 2.445134137142996 3.754408661907416 1.0"


def _poly(c: str, x: str) -> str:
    out = "CAST(0 AS DOUBLE)"
    for v in c.split():
        out = f"({out} * {x} + CAST({v} AS DOUBLE))"
    return out


_P = "(pos + 1) / (n + 1.0)"
_Q = f"sqrt(-2 * ln(least({_P}, 1 - {_P})))"
_TAIL = f"{_poly(_PPF_C, _Q)} / {_poly(_PPF_D, _Q)}"
_CENTRE = f"{_poly(_PPF_A, f'(({_P} - 0.5) * ({_P} - 0.5))')} * ({_P} - 0.5) / {_poly(_PPF_B, f'(({_P} - 0.5) * ({_P} - 0.5))')}"


@query(f"WITH {R} " + sql({"ppf": f"CASE WHEN {_P} < 0.02425 THEN {_TAIL} WHEN {_P} > 1 - 0.02425 THEN -({_TAIL}) ELSE {_CENTRE} END"}, "FROM r", "user_id, pos"))
def op_normal_ppf(spark, sf_dir):  # noqa: ANN001, ANN201
    """Operator 73."""
    return rounded(evaluate(events(spark, sf_dir), {"ppf": "normal_ppf((cumulative_sum(nav * 0 + 1)) / (length(nav) + 1))"}))


_NODE = "((k // 2 + CASE WHEN k % 2 = 0 THEN 0.5 - 0.5 / sqrt(3) ELSE 0.5 + 0.5 / sqrt(3) END) / 400 * z)"
_CDF = f"list_sum(list_transform(range(0, 800), lambda k: exp(-0.5 * {_NODE} * {_NODE}))) * z / 800 / sqrt(2 * pi())"


@query(f"WITH {E}, z AS (SELECT user_id, pos, (nav - 40) / 20 AS z FROM e) " + sql({"cdf": f"0.5 + {_CDF}"}, "FROM z", "user_id, pos", 5))
def op_normal_cdf(spark, sf_dir):  # noqa: ANN001, ANN201
    """Operator 119, held against a two-point Gauss rule on 400 parts."""
    return rounded(evaluate(events(spark, sf_dir), {"cdf": "normal_cdf((nav - 40) / 20)"}), 5)


_CMP = {
    "equal": ("equal(gap, nav)", "NOT isnan(gap) AND gap = nav"), "not_equal": ("gap != nav", "isnan(gap) OR gap <> nav"), "less_than": ("gap < 20", "NOT isnan(gap) AND gap < 20"),
    "less_equal": ("gap <= 20", "NOT isnan(gap) AND gap <= 20"), "greater_than": ("gap > 20", "NOT isnan(gap) AND gap > 20"), "greater_equal": ("20 >= gap", "NOT isnan(gap) AND 20 >= gap"),
    "logical_and": ("logical_and(buy, nav > 20)", "buy AND nav > 20"), "logical_or": ("logical_or(buy, nav > 20)", "buy OR nav > 20"), "logical_not": ("logical_not(buy)", "NOT buy"),
    "finite_mask": ("finite_mask(gap)", "isfinite(gap)"),
}


@query(f"WITH {E} SELECT user_id, pos, {', '.join(f'{v[1]} AS {k}_' for k, v in _CMP.items())}, CASE WHEN buy THEN nav ELSE -1 END AS where_, CASE WHEN NOT buy THEN -1 WHEN nav > 20 THEN code ELSE 3 END AS select_ FROM e")
def op_predicates(spark, sf_dir):  # noqa: ANN001, ANN201
    """Operators 16-25, 118 and 146."""
    return evaluate(events(spark, sf_dir), {f"{k}_": v[0] for k, v in _CMP.items()} | {"where_": "where(buy, nav, -1)", "select_": "state_select(nav > 20, code, 3, buy)"})


_ISL = ", isl AS (SELECT user_id, g, count(*) FILTER (buy) AS c FROM (SELECT *, sum(CASE WHEN buy THEN 0 ELSE 1 END) OVER (PARTITION BY user_id ORDER BY pos ROWS UNBOUNDED PRECEDING) AS g FROM e) GROUP BY user_id, g), mc AS (SELECT user_id, max(c) AS mc FROM isl GROUP BY user_id)"
_MASKED = {
    "sum_w": ("sum_where(nav, nav > 5)", "sum(nav) FILTER (nav > 5)"), "mean_w": ("masked_mean(nav, nav > 5)", "avg(nav) FILTER (nav > 5)"), "var_w": ("variance_where(nav, nav > 5)", "var_samp(nav) FILTER (nav > 5)"),
    "std_w": ("std_where(nav, nav > 5)", "stddev_samp(nav) FILTER (nav > 5)"), "min_w": ("min_where(gap, nav > 5)", "min(gap) FILTER (nav > 5 AND NOT isnan(gap))"), "max_w": ("max_where(gap, nav > 5)", "max(gap) FILTER (nav > 5 AND NOT isnan(gap))"),
    "median_w": ("median_where(nav, nav > 5)", "median(nav) FILTER (nav > 5)"), "q_w": ("quantile_where(nav, nav > 5, 0.3)", "quantile_cont(nav, 0.3) FILTER (nav > 5)"), "count_t": ("count_true(buy)", "count(*) FILTER (buy)"),
    "max_run": ("max_consecutive_true(buy)", "any_value(mc)"),
}


@query(f"WITH {E}{_ISL} " + sql({k: v[1] for k, v in _MASKED.items()}, "FROM e JOIN mc USING (user_id) GROUP BY user_id", "user_id"))
def op_masked_reductions(spark, sf_dir):  # noqa: ANN001, ANN201
    """Operators 26-35."""
    return rounded(evaluate(events(spark, sf_dir), {k: v[0] for k, v in _MASKED.items()}))


_REDUCED = {
    "sum_": ("sum(nav)", "sum(nav)"), "product_": ("product(nav / 40)", "product(nav / 40)"), "mean_": ("mean(nav)", "avg(nav)"),
    "min_": ("min_value(gap)", f"CASE WHEN isnan(max(gap) FILTER (pos = 0)) THEN {_NAN} ELSE min(gap) FILTER (NOT isnan(gap)) END"),
    "max_": ("max_value(gap)", f"CASE WHEN isnan(max(gap) FILTER (pos = 0)) THEN {_NAN} ELSE max(gap) FILTER (NOT isnan(gap)) END"),
    "var_": ("variance(nav, 0)", "var_pop(nav)"), "std_": ("std(nav)", "stddev_samp(nav)"), "median_": ("median(nav)", "median(nav)"), "skew_": ("skewness(nav)", "skewness(nav)"), "kurt_": ("excess_kurtosis(nav)", "kurtosis(nav)"),
    "mad_": ("mad(nav)", "avg(abs(nav - mu))"), "rms_": ("rms(nav)", "sqrt(avg(nav * nav))"), "argmin_": ("argmin(nav)", "arg_min(pos, (nav, pos))"), "argmax_": ("argmax(nav)", "arg_min(pos, (-nav, pos))"),
    "quantile_": ("quantile(nav, 0.9)", "quantile_cont(nav, 0.9)"), "distinct_": ("distinct_count(code)", "count(DISTINCT code)"), "distinct_m": ("distinct_count(code, buy)", "count(DISTINCT code) FILTER (buy)"),
    "first_": ("first(nav)", "arg_min(nav, pos)"), "last_": ("last(nav)", "arg_max(nav, pos)"), "length_": ("length(nav)", "count(*)"), "dot_": ("dot(nav, nav)", "sum(nav * nav)"),
    "cov_": ("covariance(nav, nav * nav)", "covar_samp(nav, nav * nav)"), "corr_": ("corr(nav, nav * nav)", "corr(nav, nav * nav)"),
}


@query(f"WITH {E}, m AS (SELECT *, avg(nav) OVER (PARTITION BY user_id) AS mu FROM e) " + sql({k: v[1] for k, v in _REDUCED.items()}, "FROM m GROUP BY user_id", "user_id", 4))
def op_reductions(spark, sf_dir):  # noqa: ANN001, ANN201
    """Operators 36-42, 56, 57, 60-67, 74, 92, 99, 100 and 124."""
    return rounded(evaluate(events(spark, sf_dir), {k: v[0] for k, v in _REDUCED.items()}), 4)


_W = "(PARTITION BY user_id ORDER BY pos ROWS UNBOUNDED PRECEDING)"
_FIRST_NAN = f"CASE WHEN isnan(first_value(gap) OVER {_W}) THEN {_NAN} ELSE "
_CUM = {
    "csum": ("cumulative_sum(nav)", f"sum(nav) OVER {_W}"), "cprod": ("cumulative_product(nav / 40)", f"product(nav / 40) OVER {_W}"), "cret": ("cumulative_return(nav / 1000)", f"product(nav / 1000 + 1) OVER {_W} - 1"),
    "cmax": ("cumulative_max(gap)", f"{_FIRST_NAN} max(gap) FILTER (NOT isnan(gap)) OVER {_W} END"), "cmin": ("cumulative_min(gap)", f"{_FIRST_NAN} min(gap) FILTER (NOT isnan(gap)) OVER {_W} END"),
    "dd": ("drawdown_series(nav)", "nav / peak - 1"), "high": ("where(new_high_mask(nav), 1, 0)", "CASE WHEN pos = 0 OR nav > before THEN 1 ELSE 0 END"),
    "shift": ("aligned_shift(nav, 2, -1)", "coalesce(lag(nav, 2) OVER (PARTITION BY user_id ORDER BY pos), -1)"),
}


@query(f"WITH {R} " + sql({k: v[1] for k, v in _CUM.items()}, "FROM r", "user_id, pos", 4))
def op_cumulative(spark, sf_dir):  # noqa: ANN001, ANN201
    """Operators 43-49 and 120."""
    return rounded(evaluate(events(spark, sf_dir), {k: v[0] for k, v in _CUM.items()}), 4)


@query(f"WITH {R} SELECT user_id, pos, CASE WHEN pos < n - 2 THEN nav END AS lagged, lead(nav, 2) OVER (PARTITION BY user_id ORDER BY pos) - nav AS diff FROM r")
def op_shortened(spark, sf_dir):  # noqa: ANN001, ANN201
    """Operators 58 and 59: series that end before the others."""
    return evaluate(events(spark, sf_dir), {"lagged": "lag(nav, 2)", "diff": "difference(nav, 2)"})


_SORTED = "row_number() OVER (PARTITION BY user_id ORDER BY CASE WHEN isnan(gap) THEN 1 ELSE 0 END, gap, pos) - 1"


@query(f"WITH {E}, s AS (SELECT user_id, {_SORTED} AS k, pos AS p, nav FROM e) SELECT user_id, k AS pos, p AS order_, nav AS picked FROM s")
def op_argsort_gather(spark, sf_dir):  # noqa: ANN001, ANN201
    """Operators 122 and 123."""
    return evaluate(events(spark, sf_dir), {"order_": "argsort(gap)", "picked": "gather(nav, argsort(gap))"})


_F5 = "OVER (PARTITION BY user_id ORDER BY pos ROWS BETWEEN 4 PRECEDING AND CURRENT ROW)"
_G = "FILTER (NOT isnan(gap))"


def _roll(x: str, least: int) -> str:
    return f"CASE WHEN count(gap) {_G} {_F5} >= {least} THEN {x} ELSE {_NAN} END"


_ROLL = {
    "r_mean": ("rolling_mean(gap, 5, 3)", _roll(f"avg(gap) {_G} {_F5}", 3)), "r_std": ("rolling_std(gap, 5, 1, 3)", _roll(f"stddev_samp(gap) {_G} {_F5}", 3)), "r_min": ("rolling_min(gap, 5, 1)", _roll(f"min(gap) {_G} {_F5}", 1)),
    "r_max": ("rolling_max(gap, 5)", _roll(f"max(gap) {_G} {_F5}", 5)), "w_mean": ("mean(rolling_window(gap, 5, 2))", _roll(f"avg(gap) {_G} {_F5}", 2)), "w_var": ("var(rolling_window(gap, 5, 2))", _roll(f"var_samp(gap) {_G} {_F5}", 2)),
    "a_range": ("rolling_apply(max(nav) - min(nav), 5)", f"CASE WHEN pos >= 4 THEN max(nav) {_F5} - min(nav) {_F5} ELSE {_NAN} END"),
    "a_median": ("rolling_apply(median(nav) + 1, 5)", f"CASE WHEN pos >= 4 THEN median(nav) {_F5} + 1 ELSE {_NAN} END"),
}


@query(f"WITH {E} " + sql({k: v[1] for k, v in _ROLL.items()}, "FROM e", "user_id, pos", 5))
def op_rolling(spark, sf_dir):  # noqa: ANN001, ANN201
    """Operators 50-53 and the scopes rolling_window and rolling_apply."""
    return rounded(evaluate(events(spark, sf_dir), {k: v[0] for k, v in _ROLL.items()}), 5)


_REC = f"""WITH RECURSIVE {E}, t AS (
 SELECT user_id, pos, CASE WHEN isnan(gap) THEN CAST(10 AS DOUBLE) ELSE (4 * CAST(10 AS DOUBLE) + gap) / 5 END AS sm, CASE WHEN buy AND NOT isnan(gap) THEN 0.25 * gap ELSE CAST(0 AS DOUBLE) END AS rf,
  CASE WHEN isnan(gap) THEN NULL ELSE gap END AS km, CAST(1 AS DOUBLE) AS kv, CASE WHEN nav >= 60 THEN 0 WHEN nav <= 15 THEN 2 ELSE 1 END AS hy, isnan(gap) AS miss FROM e WHERE pos = 0
 UNION ALL
 SELECT e.user_id, e.pos, CASE WHEN isnan(gap) THEN sm ELSE (4 * sm + gap) / 5 END, CASE WHEN buy AND NOT isnan(gap) THEN 0.75 * rf + 0.25 * gap ELSE rf END,
  CASE WHEN isnan(gap) THEN km WHEN km IS NULL THEN gap ELSE km + (kv + 2) / (kv + 2 + 5) * (gap - km) END,
  CASE WHEN isnan(gap) OR km IS NULL THEN kv ELSE (kv + 2) * (1 - (kv + 2) / (kv + 2 + 5)) END,
  CASE hy WHEN 0 THEN CASE WHEN nav <= 15 THEN 2 WHEN nav <= 40 THEN 1 ELSE 0 END WHEN 2 THEN CASE WHEN nav >= 60 THEN 0 WHEN nav >= 30 THEN 1 ELSE 2 END
   ELSE CASE WHEN nav >= 60 THEN 0 WHEN nav <= 15 THEN 2 ELSE 1 END END, isnan(gap) FROM e JOIN t ON e.user_id = t.user_id AND e.pos = t.pos + 1)
"""


@query(_REC + sql({"smooth": f"CASE WHEN miss THEN {_NAN} ELSE sm END", "filter": "rf", "estimate": f"CASE WHEN miss THEN {_NAN} ELSE km END", "variance": f"CASE WHEN miss THEN {_NAN} ELSE kv END", "hyst": "hy"}, "FROM t", "user_id, pos", 5))
def op_recurrences(spark, sf_dir):  # noqa: ANN001, ANN201
    """Operators 54, 121, 129-132."""
    k = "scalar_kalman(gap, 2, 5)"
    out = evaluate(events(spark, sf_dir), {"smooth": "recursive_smooth(gap, 5, 10)", "filter": "recursive_filter(gap, 1 / (1 + 3), 0, buy)", "estimate": f"state_estimate({k})", "variance": f"state_variance({k})", "hyst": "state_hysteresis(nav, 60, 40, 15, 30)"})
    return rounded(out.withColumn("hyst", F.col("hyst").cast("double")), 5)


_SEQ = f"""WITH RECURSIVE {R}, t AS (
 SELECT DISTINCT user_id, CAST(-1 AS BIGINT) AS pos, CAST(NULL AS DOUBLE) AS ap, CAST(NULL AS DOUBLE) AS adaptive, CAST(0 AS DOUBLE) AS px, CAST(0 AS DOUBLE) AS y1, CAST(0 AS DOUBLE) AS y2, 0 AS cnt, CAST(NULL AS DOUBLE) AS second,
  CAST(-1 AS BIGINT) AS ca, CAST(-1 AS BIGINT) AS cw, 0 AS ch, 0 AS cr, CAST(-1 AS BIGINT) AS confirm, CAST(0 AS BIGINT) AS sa, CAST(-1 AS BIGINT) AS sw, 0 AS sr, 0 AS ss, 0 AS evidence, 0 AS cs, CAST(NULL AS DOUBLE) AS low, -1 AS cycle FROM r
 UNION ALL
 SELECT user_id, pos, n_ap, CASE WHEN made THEN n_ap ELSE {_NAN} END, CASE WHEN fin THEN gap ELSE z_px END, CASE WHEN fin THEN n_y ELSE z_y1 END, CASE WHEN fin THEN z_y1 ELSE z_y2 END, CASE WHEN fin THEN z_cnt + 1 ELSE z_cnt END, CASE WHEN fin THEN n_y ELSE {_NAN} END,
  CASE WHEN turn THEN code ELSE ca END, CASE WHEN code < 0 OR code = ca OR (turn AND ca >= 0) THEN -1 ELSE code END, CASE WHEN turn THEN 1 ELSE h END, CASE WHEN code < 0 OR code = ca OR (turn AND ca >= 0) THEN 0 ELSE c_run END, CASE WHEN code < 0 THEN -1 WHEN turn THEN code ELSE ca END,
  CASE WHEN s_turn THEN code ELSE sa END, CASE WHEN code < 0 OR code = sa OR s_turn THEN -1 ELSE code END, CASE WHEN code < 0 OR code = sa OR s_turn THEN 0 ELSE s_run END, CASE WHEN code = sa OR s_turn THEN 1 ELSE ss END,
  CASE WHEN code < 0 THEN 2 * ss WHEN code = sa OR s_turn THEN 1 ELSE 3 END, n_cs, CASE WHEN n_cs < 0 THEN NULL WHEN cs <= 0 AND n_cs <> cs THEN nav WHEN cs = 2 AND (low IS NULL OR nav < low) THEN nav WHEN cs = 1 AND n_cs <> 1 THEN nav ELSE low END, n_cs
 FROM (SELECT r.user_id, r.pos, r.nav, r.code, r.gap, t.* EXCLUDE (user_id, pos), NOT isnan(gap) AS fin, r.nav > 400 AS rst,
   CASE WHEN rst THEN NULL ELSE ap END AS z_ap, NOT isnan(gap) AND (z_ap IS NULL OR r.buy) AS made, CASE WHEN isnan(gap) THEN z_ap WHEN z_ap IS NULL THEN gap WHEN r.buy THEN z_ap + r.nav / 1000 * (gap - z_ap) ELSE z_ap END AS n_ap,
   CASE WHEN rst THEN 0 ELSE px END AS z_px, CASE WHEN rst THEN 0 ELSE y1 END AS z_y1, CASE WHEN rst THEN 0 ELSE y2 END AS z_y2, CASE WHEN rst THEN 0 ELSE cnt END AS z_cnt, CASE WHEN z_cnt < 2 THEN gap ELSE CAST(0.2 AS DOUBLE) * gap + CAST(0.1 AS DOUBLE) * z_px + CAST(0.5 AS DOUBLE) * z_y1 + CAST(0.1 AS DOUBLE) * z_y2 END AS n_y,
   ch + CASE WHEN ca >= 0 THEN 1 ELSE 0 END AS h, CASE WHEN r.code = cw THEN cr + 1 ELSE 1 END AS c_run, r.code >= 0 AND r.code <> ca AND c_run >= 2 AND (ca < 0 OR h > 1) AS turn,
   CASE WHEN r.code = sw THEN sr + 1 ELSE 1 END AS s_run, r.code >= 0 AND r.code <> sa AND s_run >= 2 AS s_turn, r.nav / r.peak - 1 AS dd,
   CASE WHEN NOT r.buy THEN -1 WHEN cs <= 0 AND dd <= -0.5 THEN 2 WHEN cs < 0 AND dd >= -0.1 THEN 0 WHEN cs = 2 AND low IS NOT NULL AND r.nav >= low AND r.nav / low - 1 >= 0.2 THEN 1 WHEN cs = 1 AND r.nav < low THEN 2 WHEN cs = 1 AND dd >= -0.1 THEN 0 ELSE cs END AS n_cs
  FROM r JOIN t ON r.user_id = t.user_id AND r.pos = t.pos + 1))
"""


@query(_SEQ + sql({c: x for c, x in (("adaptive", "adaptive"), ("second", "second"), ("confirm", "confirm"), ("state", "sa"), ("evidence", "evidence"), ("pending", "sr"), ("cycle", "cycle"))}, "FROM t WHERE pos >= 0", "user_id, pos", 5))
def op_sequential_states(spark, sf_dir):  # noqa: ANN001, ANN201
    """Operators 127, 128 and 133-138."""
    c = "state_continuous(code, code * 0, buy, 2, 5)"
    out = evaluate(
        events(spark, sf_dir),
        {
            "adaptive": "recursive_filter_adaptive(gap, nav / 1000, buy, nav > 400)", "second": "linear_filter2(gap, 0.2, 0.1, 0.5, 0.1, nav > 400)", "confirm": "state_confirm(code, 2, 1)",
            "state": f"continuous_state_values({c})", "evidence": f"continuous_state_evidence({c})", "pending": f"continuous_state_pending({c})",
            "cycle": "drawdown_cycle_state(nav, drawdown_series(nav), buy, 0.5, 0.2, 0.1)",
        },
    )
    return rounded(out.select("user_id", POS, *[F.col(c).cast("double").alias(c) for c in out.columns[2:]]), 5)


_BETWEEN = """, runs AS (SELECT *, sum(CASE WHEN event = -2 THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY pos ROWS UNBOUNDED PRECEDING) AS g FROM e),
 b AS (SELECT *, last_value(CASE WHEN abs(event) = 1 THEN pos END IGNORE NULLS) OVER (PARTITION BY user_id, g ORDER BY pos ROWS UNBOUNDED PRECEDING) AS l,
  last_value(CASE WHEN abs(event) = 1 THEN event END IGNORE NULLS) OVER (PARTITION BY user_id, g ORDER BY pos ROWS UNBOUNDED PRECEDING) AS lk,
  first_value(CASE WHEN abs(event) = 1 THEN pos END IGNORE NULLS) OVER (PARTITION BY user_id, g ORDER BY pos ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS r,
  first_value(CASE WHEN abs(event) = 1 THEN event END IGNORE NULLS) OVER (PARTITION BY user_id, g ORDER BY pos ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS rk FROM runs),
 seg AS (SELECT *, CASE WHEN lk <> rk THEN l ELSE -1 END AS s, CASE WHEN lk <> rk THEN r ELSE -1 END AS t FROM b)"""


@query(f"WITH {E}{_BETWEEN} SELECT user_id, pos, coalesce(s, -1) AS start_, coalesce(t, -1) AS end_, CASE WHEN lk = -1 AND rk = 1 THEN 0 WHEN lk = 1 AND rk = -1 THEN 1 ELSE -1 END AS phase FROM seg")
def op_segments(spark, sf_dir):  # noqa: ANN001, ANN201
    """Operators 141-144."""
    s = "between_events(event)"
    return evaluate(events(spark, sf_dir), {"start_": f"segment_starts({s})", "end_": f"segment_ends({s})", "phase": f"phase_direction(event, {s})"})


_ALT = "CASE WHEN len({0}) = 0 THEN {0} ELSE list_reduce(list_transform({0}, lambda t: [t]), lambda acc, x: CASE WHEN ev[x[1] + 1] * (p[x[1] + 1] - p[acc[-1] + 1]) <= 0 THEN acc WHEN ev[x[1] + 1] = ev[acc[-1] + 1] THEN acc[1:-2] || x ELSE acc || x END) END"
_GAP = "abs(ln(p[turns[{0}] + 1]) - ln(p[turns[{1}] + 1]))"
#: Turning points by rows (extrema) and by lists of turns (censoring); each step of ``st`` applies the first rule that holds.
_TURNS = f"""WITH RECURSIVE {E}, o AS (SELECT *, CASE WHEN ident % 29 = 0 THEN CAST(0 AS DOUBLE) ELSE nav END AS price, ident % 29 <> 0 AS ok, sum(CASE WHEN ident % 29 = 0 THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY pos ROWS UNBOUNDED PRECEDING) AS g FROM e),
 k AS (SELECT user_id, pos, g, price, row_number() OVER r - 1 AS k, count(*) OVER (PARTITION BY user_id, g) AS n, lag(price) OVER r AS l1, lead(price) OVER r AS r1, lead(price, 2) OVER r AS r2 FROM o WHERE ok WINDOW r AS (PARTITION BY user_id, g ORDER BY pos)),
 c AS (SELECT *, CASE WHEN k < 1 OR k >= n - 2 THEN 0 WHEN price > l1 AND price >= r1 AND price >= r2 THEN 1 WHEN price < l1 AND price <= r1 AND price <= r2 THEN -1 ELSE 0 END AS kind FROM k),
 cand AS (SELECT *, row_number() OVER (PARTITION BY user_id, g ORDER BY pos) AS j FROM c WHERE kind <> 0),
 acc AS (SELECT user_id, g, j, pos, kind, TRUE AS yes, price AS lp FROM cand WHERE j = 1
  UNION ALL SELECT c.user_id, c.g, c.j, c.pos, c.kind, c.kind * (c.price - a.lp) > 0, CASE WHEN c.kind * (c.price - a.lp) > 0 THEN c.price ELSE a.lp END FROM cand c JOIN acc a ON c.user_id = a.user_id AND c.g = a.g AND c.j = a.j + 1),
 kept AS (SELECT user_id, pos, kind FROM (SELECT *, lead(kind) OVER (PARTITION BY user_id, g ORDER BY j) AS nk FROM acc WHERE yes) WHERE nk IS NULL OR nk <> kind),
 x AS (SELECT c.*, coalesce(t.kind, 0) AS ex FROM c LEFT JOIN kept t USING (user_id, pos)),
 runs AS (SELECT user_id, g, any_value(n) AS n, min(pos) AS base, list(price ORDER BY k) AS p, list(ex ORDER BY k) AS ev, coalesce(list(k ORDER BY k) FILTER (ex <> 0), []) AS t0 FROM x GROUP BY user_id, g),
 st AS (SELECT user_id, g, n, p, ev, {_ALT.format("t0")} AS turns, TRUE AS more FROM runs
  UNION ALL SELECT user_id, g, n, p, ev, CASE WHEN early THEN turns[2:] WHEN late THEN turns[1:-2] WHEN cut IS NOT NULL THEN {_ALT.format("cut")} ELSE turns END, early OR late OR cut IS NOT NULL FROM (
   SELECT *, CASE WHEN cy IS NOT NULL THEN list_filter(turns, lambda t, i: i - 1 <> ca AND i - 1 <> ca + 1) WHEN ph IS NOT NULL THEN list_filter(turns, lambda t, i: i - 1 <> pa) END AS cut FROM (
   SELECT *, CASE WHEN ev[turns[cy + 1] + 1] * (p[turns[cy + 3] + 1] - p[turns[cy + 1] + 1]) > 0 THEN cy ELSE cy + 1 END AS ca,
    CASE WHEN ph + 2 = len(turns) THEN ph + 1 WHEN ph > 0 AND {_GAP.format("ph + 1", "ph")} >= {_GAP.format("ph + 3", "ph + 2")} THEN ph + 1 ELSE ph END AS pa FROM (
   SELECT *, len(turns) > 0 AND len(list_filter(range(0, turns[1]), lambda j: ev[turns[1] + 1] * (p[j + 1] - p[turns[1] + 1]) > 0)) > 0 AS early,
    len(turns) > 0 AND len(list_filter(range(turns[-1] + 1, n), lambda j: ev[turns[-1] + 1] * (p[j + 1] - p[turns[-1] + 1]) > 0)) > 0 AS late,
    list_filter(range(0, len(turns) - 2), lambda j: turns[j + 3] - turns[j + 1] < 5)[1] AS cy, list_filter(range(0, len(turns) - 1), lambda j: turns[j + 2] - turns[j + 1] < 3 AND abs(p[turns[j + 2] + 1] / p[turns[j + 1] + 1] - 1) <= 0.8)[1] AS ph
   FROM st WHERE more AND len(turns) > 0)))),
 turn AS (SELECT st.user_id, st.g, base + unnest(turns) AS pos, unnest(list_transform(turns, lambda t: st.ev[t + 1])) AS tk FROM st JOIN runs USING (user_id, g) WHERE NOT more OR len(turns) = 0),
 sg AS (SELECT *, phase = 1 AND change <= -0.2 AS deep FROM (SELECT t.user_id, t.pos AS s, lead(t.pos) OVER w AS e, CASE WHEN tk = -1 THEN 0 ELSE 1 END AS phase, nav / 500 - 0.3 AS change FROM turn t JOIN e USING (user_id, pos) WINDOW w AS (PARTITION BY t.user_id, g ORDER BY t.pos)) WHERE e IS NOT NULL),
 sp AS (SELECT *, phase = 0 AND coalesce(lag(deep) OVER (PARTITION BY user_id ORDER BY s), FALSE) AS back FROM sg)
SELECT o.user_id, o.pos, CASE WHEN ok THEN x.ex ELSE -2 END AS extrema, CASE WHEN ok THEN coalesce(turn.tk, 0) ELSE -2 END AS turns,
 CASE WHEN b.back THEN 2 WHEN a.deep THEN 2 WHEN a.back THEN 1 WHEN a.s IS NOT NULL OR b.s IS NOT NULL THEN 0 ELSE -1 END AS reference
FROM o LEFT JOIN x ON x.user_id = o.user_id AND x.pos = o.pos LEFT JOIN turn ON turn.user_id = o.user_id AND turn.pos = o.pos LEFT JOIN sp a ON a.user_id = o.user_id AND a.s < o.pos AND o.pos <= a.e LEFT JOIN sp b ON b.user_id = o.user_id AND b.s = o.pos"""


@query(_TURNS)
def op_turning_points(spark, sf_dir):  # noqa: ANN001, ANN201
    """Operators 139, 140 and 145."""
    price = "where(ident - 29 * floor(ident / 29) < 0.5, 0, nav)"
    x = f"local_extrema({price}, 1, 2, 0, 0)"
    p = f"ps_filter({price}, {x}, 3, 5, 0.8)"
    s = f"between_events({p})"
    return evaluate(events(spark, sf_dir), {"extrema": x, "turns": p, "reference": f"drawdown_cycle_reference(phase_direction({p}, {s}), nav / 500 - 0.3, {s}, 0.2)"})


_SEG_Q = f"""WITH {E}{_BETWEEN}, j AS (SELECT a.user_id, a.s, avg(c.nav) AS m, regr_slope(c.nav, c.pos - a.s) AS k FROM (SELECT DISTINCT user_id, s, t FROM seg WHERE lk <> rk) a JOIN e c ON c.user_id = a.user_id AND c.pos BETWEEN a.s AND a.t GROUP BY a.user_id, a.s)
"""


@query(_SEG_Q + sql({"m": f"coalesce(m, {_NAN})", "k": f"coalesce(k, {_NAN})"}, "FROM seg LEFT JOIN j ON seg.user_id = j.user_id AND seg.s = j.s", "seg.user_id AS user_id, pos"))
def scope_segment_apply(spark, sf_dir):  # noqa: ANN001, ANN201
    return rounded(segment_apply(events(spark, sf_dir), {"m": "mean(nav)", "k": "linear_slope(nav)"}, "between_events(event)"))


@query(f"WITH {E}, b AS (SELECT *, pos // 7 AS block, count(*) OVER (PARTITION BY user_id, pos // 7) AS c FROM e) " + sql({"m": "avg(nav)", "s": "regr_slope(nav, pos)"}, "FROM b WHERE c = 7 GROUP BY user_id, block", "user_id, block AS pos"))
def scope_block_apply(spark, sf_dir):  # noqa: ANN001, ANN201
    return rounded(block_apply(events(spark, sf_dir), {"m": "mean(nav)", "s": "linear_slope(nav)"}, 7))


_D6 = "OVER (PARTITION BY user_id ORDER BY pos ROWS BETWEEN 5 PRECEDING AND CURRENT ROW)"
_DAY = "date_diff('day', DATE '2000-01-01', CAST(ts AS DATE))"


@query(f"WITH {E}, d AS (SELECT *, {_DAY} AS day FROM e), x AS (SELECT user_id, pos, last_value(nav) {_D6} AS b, first_value(nav) {_D6} AS a, last_value(day) {_D6} - first_value(day) {_D6} AS el, count(*) {_D6} AS c FROM d) "
       + sql({"excess": f"CASE WHEN pos >= 5 THEN b / a - 1 - (pow(1.03, el / 365.0) - 1) ELSE {_NAN} END", "pace": "CASE WHEN c >= 2 THEN el * 1.0 / (c - 1) ELSE CAST('nan' AS DOUBLE) END", "tail": "CASE WHEN pos < (SELECT max(pos) FROM e z WHERE z.user_id = x.user_id) THEN (SELECT nav FROM e y WHERE y.user_id = x.user_id AND y.pos = x.pos + 1) END"}, "FROM x", "user_id, pos"))
def scope_dated_rolling(spark, sf_dir):  # noqa: ANN001, ANN201
    """rolling_apply with dates, bindings and interval_tail."""
    roots = {"excess": "rolling_apply(growth - risk_free_return_window, 6, day, 0.03)", "pace": "rolling_apply(window_elapsed_days / observation_count + 0 * last(nav), 6, day, 0.03, 2)", "tail": "interval_tail(nav)"}
    return rounded(evaluate(events(spark, sf_dir), roots, bindings={"growth": "last(nav) / first(nav) - 1"}))


_NEWTON = "iterate((iterate_x + nav / iterate_x) / 2, nav * 0 + 1, 0.000000001, 100)"
_SCOPES = {
    "g_mean": ("group_apply(mean(nav), code)", "avg(nav) OVER (PARTITION BY user_id, code)"), "g_dev": ("nav - group_apply(max(nav), code)", "nav - max(nav) OVER (PARTITION BY user_id, code)"),
    "f_mean": ("nav * 0 + filter_apply(mean(nav), buy, 0)", "coalesce(avg(nav) FILTER (buy) OVER (PARTITION BY user_id), 0)"),
    "root": ("bisect(solve_x ** 2 - nav, 0, 1000, 0.000000001, 80)", "sqrt(nav)"), "newton": (_NEWTON, "sqrt(nav)"),
    "status": (f"iteration_status({_NEWTON})", "0"), "rounds": (f"iteration_count({_NEWTON})", "max(nk) OVER (PARTITION BY user_id)"), "settled": (f"where(iteration_residual({_NEWTON}) <= 0.000000001, 1, 0)", "1"),
}


@query(f"WITH RECURSIVE {E}, nw AS (SELECT user_id, pos, nav, CAST(1 AS DOUBLE) AS x, 0 AS k, CAST(1 AS DOUBLE) AS step FROM e UNION ALL SELECT user_id, pos, nav, (x + nav / x) / 2, k + 1, abs((x + nav / x) / 2 - x) FROM nw WHERE step > 0.000000001), nk AS (SELECT user_id, pos, max(k) AS nk FROM nw GROUP BY user_id, pos) " + sql({k: v[1] for k, v in _SCOPES.items()}, "FROM e JOIN nk USING (user_id, pos)", "user_id, pos", 5))
def scope_group_filter_solve(spark, sf_dir):  # noqa: ANN001, ANN201
    """The scopes group_apply, filter_apply, bisect and iterate with its diagnostics."""
    return rounded(evaluate(events(spark, sf_dir), {k: v[0] for k, v in _SCOPES.items()}), 5)


_NESTED = {
    "share2": ("group_apply(sum((nav / sum(nav)) ** 2), code)", "sum(nav * nav) OVER g / (sum(nav) OVER g * sum(nav) OVER g)"), "root": ("group_apply(bisect(solve_x * solve_x - mean(nav), 0, 100000, 0.000000001, 100), code)", "sqrt(avg(nav) OVER g)"),
    "slope": ("group_apply(linear_slope(nav), code)", f"CASE WHEN c > 1 THEN regr_slope(nav, rk) OVER g ELSE {_NAN} END"), "prefix": ("group_apply(mean(cumulative_sum(nav)), code)", "avg(run) OVER g"), "above": ("group_apply(filter_apply(mean(nav), nav > 20, 0), code)", "coalesce(avg(nav) FILTER (nav > 20) OVER g, 0)"),
    "pairs": ("nav * 0 + filter_apply(mean(block_apply(sum(nav), 2)), nav > 20)", "pairs"), "blocks": ("nav * 0 + mean(block_apply(filter_apply(mean(nav), nav > 20, 0), 3))", "blocks"),
    "cross": ("nav * 0 + bisect(sum(nav / (1 + solve_x) ** 2) - sum(nav) / 4, 0, 10, 0.000000001, 100)", "1"),
}
_NESTED_SQL = f"""WITH {E}, o AS (SELECT *, row_number() OVER g - 1 AS rk, sum(nav) OVER (g ROWS UNBOUNDED PRECEDING) AS run, count(*) OVER (PARTITION BY user_id, code) AS c FROM e WINDOW g AS (PARTITION BY user_id, code ORDER BY pos)),
 k AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY pos) - 1 AS j, count(*) OVER (PARTITION BY user_id) AS n FROM e WHERE nav > 20), p AS (SELECT user_id, sum(nav) / any_value(n // 2) AS pairs FROM k WHERE j < n // 2 * 2 GROUP BY user_id),
 b3 AS (SELECT user_id, pos // 3 AS b, coalesce(avg(nav) FILTER (nav > 20), 0) AS m FROM e GROUP BY user_id, pos // 3 HAVING count(*) = 3), b AS (SELECT user_id, avg(m) AS blocks FROM b3 GROUP BY user_id)
"""


@query(_NESTED_SQL + sql({k: v[1] for k, v in _NESTED.items()}, "FROM o JOIN p USING (user_id) JOIN b USING (user_id) WINDOW g AS (PARTITION BY user_id, code)", "user_id, pos", 5))
def scope_nested(spark, sf_dir):  # noqa: ANN001, ANN201
    """Reductions, window operators and solvers inside groups, filters and blocks; a body that reduces the unknown."""
    out = evaluate(events(spark, sf_dir), {k: v[0] for k, v in _NESTED.items()}, error_policy="isolate")
    return rounded(out.select("user_id", POS, *_NESTED), 5)


_REG = {
    "slope": ("linear_slope(nav)", "regr_slope(nav, pos)"), "intercept": ("linear_intercept(nav)", "regr_intercept(nav, pos)"), "se": ("regression_standard_error(nav)", "sqrt((regr_syy(nav, pos) - regr_sxy(nav, pos) * regr_sxy(nav, pos) / regr_sxx(nav, pos)) / (count(*) - 2))"),
    "slope2": ("linear_slope(nav, nav * nav)", "regr_slope(nav * nav, nav)"), "f_slope": ("fit_slope(linear_fit(nav))", "regr_slope(nav, pos)"), "f_int": ("fit_intercept(linear_fit(nav))", "regr_intercept(nav, pos)"),
    "rss": ("fit_residual_sum_squares(linear_fit(nav))", "regr_syy(nav, pos) - regr_sxy(nav, pos) * regr_sxy(nav, pos) / regr_sxx(nav, pos)"), "tss": ("fit_total_sum_squares(linear_fit(nav))", "regr_syy(nav, pos)"), "n": ("fit_observation_count(linear_fit(nav))", "count(*)"),
    "r2_": ("linear_r_squared(nav)", "regr_r2(nav, pos)"),
}


@query(f"WITH {E} " + sql({k: v[1] for k, v in _REG.items()}, "FROM e GROUP BY user_id", "user_id", 4))
def op_regression(spark, sf_dir):  # noqa: ANN001, ANN201
    """Operators 68-71 and 112-117."""
    return rounded(evaluate(events(spark, sf_dir), {k: v[0] for k, v in _REG.items()}), 4)


_DDI = f"""WITH {R}, d AS (SELECT *, nav / peak - 1 AS dd FROM r), lo AS (SELECT user_id, min((dd, -pos)) FILTER (dd < 0) AS m FROM d GROUP BY user_id),
 tr AS (SELECT user_id, -m[2] AS trough FROM lo), o AS (SELECT d.user_id, any_value(trough) AS trough, max(pos) FILTER (dd = 0 AND pos < trough) AS st, min(pos) FILTER (dd = 0 AND pos > trough) AS rec, arg_max(nav, pos) AS last_nav FROM d JOIN tr USING (user_id) GROUP BY d.user_id)
"""


@query(_DDI + sql({"start_": f"coalesce(st, {_NAN})", "trough": f"coalesce(trough, {_NAN})", "recovery": f"coalesce(rec, {_NAN})", "days": f"coalesce(CASE WHEN st IS NOT NULL THEN rec - st END, {_NAN})", "low": f"coalesce((SELECT nav FROM e WHERE e.user_id = o.user_id AND pos = trough), {_NAN})", "pos_": "last_nav"}, "FROM o", "user_id"))
def op_drawdown_interval(spark, sf_dir):  # noqa: ANN001, ANN201
    """Operators 104-111."""
    i = "last_drawdown_interval(drawdown_series(nav))"
    roots = {"start_": f"interval_start({i})", "trough": f"interval_trough({i})", "recovery": f"interval_recovery({i})", "days": f"days_between(interval_start({i}), interval_recovery({i}))", "low": f"value_at(nav, interval_trough({i}))", "pos_": "require_positive(last(nav)) + 0 * require_nonnegative(length(nav))"}
    return rounded(evaluate(events(spark, sf_dir), roots))


@query(f"WITH {R} " + sql({"total": "product(ret + 1) - 1", "annual": "pow(product(ret + 1), 12.0 / count(ret)) - 1"}, "FROM r GROUP BY user_id", "user_id", 4))
def op_compositions(spark, sf_dir):  # noqa: ANN001, ANN201
    """Operators 75 and 76."""
    return rounded(evaluate(events(spark, sf_dir), {"total": f"total_return({RETURNS})", "annual": f"annualized_return({RETURNS}, 12)"}), 4)


@query(f"WITH {E}, a AS (SELECT user_id, avg(nav) AS m, stddev_samp(nav) AS s, avg(CASE WHEN buy THEN 1.0 ELSE 0.0 END) AS b FROM e GROUP BY user_id) SELECT user_id, round(m / s + {TIE}, 6) AS ratio, CAST(0 AS SMALLINT) AS ratio_status, {_NAN} AS bad, CAST(2 AS SMALLINT) AS bad_status, {_NAN} AS logd, CAST(3 AS SMALLINT) AS logd_status FROM a")
def error_isolation(spark, sf_dir):  # noqa: ANN001, ANN201
    """Failed roots give NaN and a status beside healthy ones."""
    return rounded(evaluate(events(spark, sf_dir), {"ratio": "mean(nav) / std(nav)", "bad": "mean(nav) / (length(nav) - length(nav))", "logd": "log(-mean(nav))"}, error_policy="isolate"))


# -- matrices: embeddings as a rows x 64 matrix ----------------------------------

M = "m AS (SELECT vec_id AS i, unnest(range(64)) AS j, CAST(unnest(embedding) AS DOUBLE) AS v FROM embeddings)"


def cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    return e.select(F.col("vec_id").alias("i"), F.posexplode("embedding").alias("j", "v")).select("i", F.col("j").cast("long").alias("j"), F.col("v").cast("double").alias("v"))


def _stacked(parts: dict[str, DataFrame], keys: list[str]) -> DataFrame:
    """Results of several operators in one frame, named by ``op``; index columns that one lacks are -1."""
    out = None
    for name, df in parts.items():
        cols = [(F.col(k).cast("long") if k in df.columns else F.lit(-1).cast("long")).alias(k) for k in keys]
        one = df.select(F.lit(name).alias("op"), *cols, F.col("v").cast("double").alias("v"))
        out = one if out is None else out.unionByName(one)
    return rounded(out)


def _stacked_sql(ctes: str, parts: dict[str, tuple[dict[str, str], str, str]], keys: list[str]) -> str:
    rows = [
        f"SELECT '{op}' AS op, {', '.join(f'CAST({have.get(k, -1)} AS BIGINT) AS {k}' for k in keys)}, round(CAST({v} AS DOUBLE) + {TIE}, 6) + CAST(0 AS DOUBLE) AS v {rest}"
        for op, (have, v, rest) in parts.items()
    ]
    return f"WITH {ctes} " + " UNION ALL ".join(rows)


_AXES = {"sum": ("sum", "sum(v)"), "mean": ("mean", "avg(v)"), "product": ("product", "product(v * 8)"), "variance": ("variance", "var_samp(v)"), "std": ("std", "stddev_samp(v)"), "min": ("min", "min(v)"), "max": ("max", "max(v)")}


def _per_axis(axis: str) -> str:
    return _stacked_sql(M, {f"{k}_{'time' if axis == 'i' else 'asset'}": ({"k": "j" if axis == "i" else "i"}, x if k != "product" else "product(1 + v / 100)", f"FROM m GROUP BY {'j' if axis == 'i' else 'i'}") for k, (_, x) in _AXES.items()}, ["k"])


def _axis_query(spark: SparkSession, sf_dir: str, suffix: str) -> DataFrame:
    a = cells(spark, sf_dir)
    near_one = a.withColumn("v", 1 + F.col("v") / 100)
    key = "j" if suffix == "time" else "i"
    return _stacked({f"{k}_{suffix}": getattr(axes, f"{k}_{suffix}")(near_one if k == "product" else a).withColumnRenamed(key, "k") for k in _AXES}, ["k"])


@query(_per_axis("i"))
def op_time_axis(spark, sf_dir):  # noqa: ANN001, ANN201
    """Operators 77-83."""
    return _axis_query(spark, sf_dir, "time")


@query(_per_axis("j"))
def op_asset_axis(spark, sf_dir):  # noqa: ANN001, ANN201
    """Operators 84-90."""
    return _axis_query(spark, sf_dir, "asset")


_VEC = "w AS (SELECT j AS i, (j + 1) / 64.0 AS v FROM (SELECT unnest(range(64)) AS j)), g AS (SELECT a.j AS i, b.j AS j, sum(a.v * b.v) AS v FROM m a JOIN m b ON a.i = b.i GROUP BY a.j, b.j)"


@query(_stacked_sql(f"{M}, {_VEC}", {
    "transpose": ({"i": "j", "j": "i"}, "v", "FROM m"), "matmul": ({"i": "i", "j": "j"}, "v", "FROM g"), "matvec": ({"i": "m.i"}, "sum(m.v * w.v)", "FROM m JOIN w ON m.j = w.i GROUP BY m.i"),
    "portfolio_returns": ({"i": "m.i"}, "sum(m.v * w.v)", "FROM m JOIN w ON m.j = w.i GROUP BY m.i"), "dot": ({}, "sum(v * v)", "FROM w"), "outer": ({"i": "a.i", "j": "b.i"}, "a.v * b.v", "FROM w a, w b"),
    "quadratic_form": ({}, "sum(a.v * g.v * b.v)", "FROM g JOIN w a ON a.i = g.i JOIN w b ON b.i = g.j"), "diag": ({"i": "i"}, "v", "FROM g WHERE i = j"), "trace": ({}, "sum(v)", "FROM g WHERE i = j"),
    "diag_of": ({"i": "a.i", "j": "b.i"}, "CASE WHEN a.i = b.i THEN a.v ELSE 0 END", "FROM w a, w b"),
}, ["i", "j"]))
def op_matrix_products(spark, sf_dir):  # noqa: ANN001, ANN201
    """Operators 91-97, 101 and 102."""
    a = cells(spark, sf_dir)
    w = spark.range(64).select(F.col("id").alias("i"), ((F.col("id") + 1) / 64.0).alias("v"))
    g = matrix.matmul(axes.transpose(a), a)
    return _stacked({"transpose": axes.transpose(a), "matmul": g, "matvec": matrix.matvec(a, w), "portfolio_returns": matrix.portfolio_returns(a, w), "dot": matrix.dot(w, w), "outer": matrix.outer(w, w), "quadratic_form": matrix.quadratic_form(w, g), "diag": matrix.diag(g), "trace": matrix.trace(g), "diag_of": matrix.diag(w)}, ["i", "j"])


@query(_stacked_sql(M, {"covariance": ({"i": "a.j", "j": "b.j"}, "covar_samp(a.v, b.v)", "FROM m a JOIN m b ON a.i = b.i GROUP BY a.j, b.j"), "correlation": ({"i": "a.j", "j": "b.j"}, "corr(a.v, b.v)", "FROM m a JOIN m b ON a.i = b.i GROUP BY a.j, b.j")}, ["i", "j"]))
def op_covariance(spark, sf_dir):  # noqa: ANN001, ANN201
    """Operators 99 and 100."""
    a = cells(spark, sf_dir)
    return _stacked({"covariance": matrix.covariance(a), "correlation": matrix.correlation(a)}, ["i", "j"])


@query(_stacked_sql(M + ", s AS (SELECT *, max(v) OVER (PARTITION BY i) AS mx FROM m)", {
    "sum": ({"i": "i"}, "sum(v)", "FROM m GROUP BY i"), "mean": ({"j": "j"}, "avg(v)", "FROM m GROUP BY j"), "variance": ({"i": "i"}, "var_pop(v)", "FROM m GROUP BY i"), "max": ({"i": "i"}, "max(v)", "FROM m GROUP BY i"),
    "argmax": ({"i": "i"}, "arg_min(j, (-v, j))", "FROM m GROUP BY i"), "logsumexp": ({"i": "i"}, "ln(sum(exp(v)))", "FROM m GROUP BY i"), "softmax": ({"i": "i", "j": "j"}, "exp(v) / sum(exp(v)) OVER (PARTITION BY i)", "FROM m"),
    "cumprod": ({"i": "i", "j": "j"}, "2 * product(1 + v) OVER (PARTITION BY i ORDER BY j ROWS UNBOUNDED PRECEDING)", "FROM m"), "cummax": ({"i": "i", "j": "j"}, "greatest(0, max(v) OVER (PARTITION BY i ORDER BY j ROWS UNBOUNDED PRECEDING))", "FROM m"),
    "q0": ({"i": "i"}, "quantile_cont(v, 0.75)", "FROM m GROUP BY i"), "q1": ({"i": "i"}, "quantile_cont(v, 0.25)", "FROM m GROUP BY i"), "empty": ({"i": "i + 1"}, "sum(v)", "FROM m GROUP BY i UNION ALL SELECT 'empty', 0, -1, 0"),
}, ["i", "j"]))
def op_axis_primitives(spark, sf_dir):  # noqa: ANN001, ANN201
    """Operators 158, 159, 161-165 and 188-190."""
    a = cells(spark, sf_dir)
    one = a.withColumn("v", 1 + F.col("v"))
    parts = {"sum": axes.sum_axis(a, "j"), "mean": axes.mean_axis(a, "i"), "variance": axes.variance_axis(a, "j"), "max": axes.max_axis(a, "j"), "argmax": axes.argmax_axis(a, "j"), "logsumexp": axes.logsumexp_axis(a, "j"), "softmax": axes.softmax_axis(a, "j")}
    parts |= {"cumprod": axes.cumulative_product_axis(one, "j", 2.0), "cummax": axes.cumulative_max_axis(a, "j", 0.0), "empty": axes.sum_axis(a.withColumn("i", F.col("i") + 1), "j", a.select("i").union(a.select(F.col("i") + 1)))}
    quantiles = axes.quantiles_axis(a, [0.75, 0.25], "j")
    parts |= {f"q{k}": quantiles.where(F.col("q") == k).drop("q") for k in (0, 1)}
    return _stacked(parts, ["i", "j"])


@query(_stacked_sql(M, {
    "take": ({"i": "i", "j": "p"}, "v", "FROM m JOIN (SELECT unnest([0, 1, 2]) AS p, unnest([5, 5, 0]) AS k) ON j = k"), "slice": ({"i": "i", "j": "(j - 2) // 3"}, "v", "FROM m WHERE j >= 2 AND j < 20 AND (j - 2) % 3 = 0"),
    "concat": ({"i": "i", "j": "j"}, "v", "FROM (SELECT i, j, v FROM m UNION ALL SELECT i, j + 64, v FROM m)"), "stack": ({"i": "i", "j": "j", "k": "c"}, "v * (1 + c)", "FROM m, (SELECT unnest([0, 1]) AS c)"), "swap": ({"i": "j", "j": "i"}, "v", "FROM m"),
    "broadcast": ({"i": "m.i", "j": "m.j"}, "x.v", "FROM m JOIN (SELECT j, avg(v) AS v FROM m GROUP BY j) x USING (j)"), "affine": ({"i": "i", "j": "a"}, "a + 1 + sum(v * (j + a) / 64.0)", "FROM m, (SELECT unnest([0, 1]) AS a) GROUP BY i, a"),
}, ["i", "j", "k"]))
def op_array_shapes(spark, sf_dir):  # noqa: ANN001, ANN201
    """Operators 153-157, 160 and 186."""
    a = cells(spark, sf_dir)
    picks = spark.createDataFrame([(0, 5), (1, 5), (2, 0)], "pos long, pick long")
    k = spark.range(128).select(F.expr("id div 2").alias("i"), (F.col("id") % 2).alias("j")).withColumn("v", (F.col("i") + F.col("j")) / 64.0)
    start = spark.createDataFrame([(0, 1.0), (1, 2.0)], "i long, v double")
    parts = {"take": axes.take_axis(a, picks, "j"), "slice": axes.slice_axis(a, "j", 2, 20, 3), "concat": axes.concatenate(a, a, "j"), "stack": axes.stack(a, a.withColumn("v", F.col("v") * 2), "k"), "swap": axes.swap_axes(a, "i", "j"), "broadcast": axes.broadcast_like(axes.mean_axis(a, "i"), a), "affine": matrix.affine_contract(a, k, start)}
    return _stacked(parts, ["i", "j", "k"])


_PAIR = "var_samp(nav) AS a, covar_samp(nav, code) AS b, var_samp(code) AS c, avg(nav) AS x, avg(code) AS y"


@query(
    f"WITH {E}, q AS (SELECT user_id, {_PAIR}, var_samp(0.5 * nav + 0.3 * code + 0.2 * nav * code) AS risk, min(least(nav, code, nav * code)) AS worst, avg(exp(nav / 100) / (exp(nav / 100) + exp(code))) AS share FROM e GROUP BY user_id) "
    + sql({"risk": "risk", "worst": "worst", "share": "share", "b0": "((c + 1) * x - b * y) / ((a + 1) * (c + 1) - b * b)", "b1": "((a + 1) * y - b * x) / ((a + 1) * (c + 1) - b * b)", "e1": "(a + c) / 2 + sqrt((a - c) * (a - c) / 4 + b * b)"}, "FROM q", "user_id", 4)
)
def array_expressions(spark, sf_dir):  # noqa: ANN001, ANN201
    """Matrices in expressions: a portfolio's variance, extremes and softmax of rows, a regularised system and an eigenvalue a user."""
    roots = {
        "risk": "quadratic_form(w, covariance(x))", "worst": "min_value(min_asset(x))", "share": "mean(sum_axis(take_axis(softmax_axis(z, 1), 0, 1), 1))",
        "b": "solve(covariance(p) + one, mean_time(p))", "e1": "max_axis(eigenvalues(symmetric_eigh(covariance(p))), 0)",
    }
    arrays = {"x": ["nav", "code", "nav * code"], "w": [0.5, 0.3, 0.2], "p": ["nav", "code"], "z": ["nav / 100", "code"], "one": [[1, 0], [0, 1]]}
    out = evaluate(events(spark, sf_dir), roots, arrays=arrays)
    return rounded(out.select("*", F.col("b")[0].alias("b0"), F.col("b")[1].alias("b1")).drop("b"), 4)


_SPD = f"WITH {E}, q AS (SELECT user_id, sum(nav * nav) + 1 AS a, sum(nav) AS b, count(*) * 1.0 + 1 AS c, sum(nav * pos) AS x, sum(pos) * 1.0 AS y FROM e GROUP BY user_id), d AS (SELECT *, a * c - b * b AS det, sqrt(a) AS l11, b / sqrt(a) AS l21, sqrt(c - b * b / a) AS l22, (a + c) / 2 AS h, sqrt((a - c) * (a - c) / 4 + b * b) AS g FROM q) "


@query(_SPD + sql({"x0": "(c * x - b * y) / det", "x1": "(a * y - b * x) / det", "m0": "(c * 2 * x - b * y) / det", "l11": "l11", "l21": "l21", "l22": "l22", "t1": "(y - l21 * (x / l11)) / l22", "e0": "h - g", "e1": "h + g", "v1": "sqrt((h + g - c) * (h + g - c) / ((h + g - c) * (h + g - c) + b * b))"}, "FROM d", "user_id", 3))
def op_dense_systems(spark, sf_dir):  # noqa: ANN001, ANN201
    """Operators 98 and 147-152 on one normal matrix a user, held against closed forms."""
    f = events(spark, sf_dir)
    s = evaluate(f, {"a": "dot(nav, nav) + 1", "b": "sum(nav)", "c": "length(nav) + 1", "x": "dot(nav, cumulative_sum(nav * 0 + 1) - 1)", "y": "sum(cumulative_sum(nav * 0 + 1) - 1)"})
    cell = lambda part, i, j, c: F.struct(F.lit(part).alias("part"), F.lit(i).cast("long").alias("i"), F.lit(j).cast("long").alias("j"), c.alias("v"))
    x, y = F.col("x"), F.col("y")
    cells_ = [cell("a", 0, 0, F.col("a")), cell("a", 0, 1, F.col("b")), cell("a", 1, 0, F.col("b")), cell("a", 1, 1, F.col("c")), cell("rhs", 0, 0, x), cell("rhs", 1, 0, y)]
    cells_ += [cell("two", 0, 0, x), cell("two", 1, 0, y), cell("two", 0, 1, x * 2), cell("two", 1, 1, y)]
    whole = s.select("user_id", F.explode(F.array(*cells_)).alias("p")).select("user_id", "p.*")
    dense = matrix.Dense(["user_id"]).solve("x", "a", "rhs").solve("m", "a", "two").cholesky("l", "a").triangular_solve("t", "l", "rhs").symmetric_eigh("e", "v", "a")
    out = dense.over(whole)
    wanted = {"x0": ("x", 0, 0), "x1": ("x", 1, 0), "m0": ("m", 0, 1), "l11": ("l", 0, 0), "l21": ("l", 1, 0), "l22": ("l", 1, 1), "t1": ("t", 1, 0), "e0": ("e", 0, 0), "e1": ("e", 1, 0), "v1": ("v", 0, 1)}
    at = lambda part, i, j: F.max(F.when((F.col("part") == part) & (F.col("i") == i) & (F.col("j") == j), F.col("v")))
    return rounded(out.groupBy("user_id").agg(*[at(*where).alias(n) for n, where in wanted.items()]), 3)


@query(_SPD + sql({"x": "(c * x - b * y) / det", "l": "l21", "t": "(y - l21 * (x / l11)) / l22", "e": "h + g"}, "FROM d", "user_id", 3))
def op_dense_single(spark, sf_dir):  # noqa: ANN001, ANN201
    """Operators 98, 147 and 149-151 called one by one, the eigenvalues by bounded rotations."""
    s = evaluate(events(spark, sf_dir), {"a": "dot(nav, nav) + 1", "b": "sum(nav)", "c": "length(nav) + 1", "x": "dot(nav, cumulative_sum(nav * 0 + 1) - 1)", "y": "sum(cumulative_sum(nav * 0 + 1) - 1)"})
    cell = lambda i, j, c: F.struct(F.lit(i).cast("long").alias("i"), F.lit(j).cast("long").alias("j"), F.col(c).alias("v"))
    grid = lambda *cs: s.select("user_id", F.explode(F.array(*cs)).alias("p")).select("user_id", "p.*")
    a, rhs, by = grid(cell(0, 0, "a"), cell(0, 1, "b"), cell(1, 0, "b"), cell(1, 1, "c")), grid(cell(0, 0, "x"), cell(1, 0, "y")), ["user_id"]
    low = matrix.cholesky(a, by)
    one = lambda df, where, name: df.where(where).select("user_id", F.col("v").alias(name))
    out = one(matrix.solve(a, rhs.drop("j"), by), "i = 0", "x").join(one(low, "i = 1 AND j = 0", "l"), by).join(one(matrix.triangular_solve(low, rhs, by=by), "i = 1", "t"), by)
    return rounded(out.join(one(matrix.eigenvalues(matrix.symmetric_eigh(a, by, 1e-13, 16), by), "i = 1", "e"), by), 3)


# -- latent models -----------------------------------------------------------------

_CODES = "c AS (SELECT user_id, pos, CASE WHEN code < 0 THEN -1 ELSE code END AS code FROM e)"


def _codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return events(spark, sf_dir).data.select("user_id", POS, "code")


@query(f"WITH {E}, {_CODES}, p AS (SELECT user_id, code, lag(code) OVER (PARTITION BY user_id ORDER BY pos) AS prev FROM c), g AS (SELECT user_id, i, j FROM (SELECT DISTINCT user_id FROM c), (SELECT unnest(range(4)) AS i), (SELECT unnest(range(4)) AS j)) SELECT g.user_id, g.i, g.j, CAST(count(p.code) AS DOUBLE) AS v FROM g LEFT JOIN p ON p.user_id = g.user_id AND p.prev = g.i AND p.code = g.j GROUP BY g.user_id, g.i, g.j")
def op_transition_counts(spark, sf_dir):  # noqa: ANN001, ANN201
    """Operator 181."""
    return axes.transition_counts(_codes(spark, sf_dir), 4, ["user_id"])


@query(_stacked_sql(f"{M}, n AS (SELECT count(DISTINCT i) AS n FROM m)", {
    "one_hot": ({"i": "vec_id", "j": "s"}, "CASE WHEN label = s THEN 1 ELSE 0 END", "FROM embeddings, (SELECT unnest(range(10)) AS s)"),
    "partition_mean": ({"i": "c", "j": "j"}, "avg(v)", "FROM m, n, (SELECT unnest(range(7)) AS c) WHERE n - 1 - i >= floor(n * c / 7) AND n - 1 - i < floor(n * (c + 1) / 7) GROUP BY c, j"),
    "scatter": ({"i": "r", "j": "j"}, "coalesce(v, -1)", "FROM (SELECT unnest(range(n + 3)) AS r FROM n) CROSS JOIN (SELECT DISTINCT j FROM m) LEFT JOIN (SELECT i, j, v FROM m) x USING (j) WHERE x.i = CASE WHEN r < 3 THEN NULL ELSE r - 3 END UNION ALL SELECT 'scatter', r, j, -1, FROM (SELECT unnest([0, 1, 2]) AS r), (SELECT DISTINCT j FROM m)"),
    "density": ({"i": "i", "j": "k"}, "sum(-0.5 * (ln(2 * pi()) + ln(0.02 * (k + 1)) + (v - 0.1 * k) * (v - 0.1 * k) / (0.02 * (k + 1))))", "FROM m, (SELECT unnest(range(2)) AS k) GROUP BY i, k"),
}, ["i", "j"]))
def op_arrays_and_density(spark, sf_dir):  # noqa: ANN001, ANN201
    """Operators 166, 182, 183 and 185."""
    e = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    a = cells(spark, sf_dir)
    n = e.count()
    rows = e.select(F.col("vec_id").alias("i"))
    hot = axes.one_hot(e.select(F.col("vec_id").alias("pos"), F.col("label").alias("code")), 10)
    parts = axes.partition_mean(a, rows.select((F.lit(n - 1) - F.col("i")).alias("pos"), "i"), 7).withColumnRenamed("c", "i")
    scat = axes.scatter_rows(a, rows.select("i", (F.col("i") + 3).alias("place")), n + 3, -1.0)
    x = e.select(F.col("vec_id").alias("i"), F.col("embedding").cast("array<double>").alias("x"))
    dens = latent.gaussian_log_density(x, [[0.0] * 64, [0.1] * 64], [[0.02] * 64, [0.04] * 64]).withColumnRenamed("k", "j")
    return _stacked({"one_hot": hot, "partition_mean": parts, "scatter": scat, "density": dens}, ["i", "j"])


def _points(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = spark.read.parquet(f"{sf_dir}/events.parquet")
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    return e.select("user_id", (F.row_number().over(w) - 1).alias("i"), F.array(F.log(F.col("value") + 1), F.pmod("event_id", F.lit(3)).cast("double")).alias("x"))


_START = {"means": [[2.0, 0.5], [4.5, 1.5]], "variances": [[1.0, 1.0], [1.0, 1.0]]}


_ROUNDS = 15


def _mixture_sql() -> str:
    """Rounds of expectation and maximisation over two components and two dimensions, one query after the other."""
    dens = lambda k: f"ln(w{k}) - 0.5 * (2 * ln(2 * pi()) + ln(sa{k}) + ln(sb{k}) + (a - ma{k}) * (a - ma{k}) / sa{k} + (b - mb{k}) * (b - mb{k}) / sb{k})"
    ctes = ["x AS (SELECT ln(value + 1) AS a, CAST(event_id % 3 AS DOUBLE) AS b FROM events)", "p0 AS (SELECT 0.5 AS w0, 0.5 AS w1, 2.0 AS ma0, 0.5 AS mb0, 4.5 AS ma1, 1.5 AS mb1, 1.0 AS sa0, 1.0 AS sb0, 1.0 AS sa1, 1.0 AS sb1, 0.0 AS ll)"]
    for r in range(1, _ROUNDS + 1):
        ctes.append(f"z{r} AS MATERIALIZED (SELECT a, b, 1 / (1 + exp(g1 - g0)) AS r0, 1 / (1 + exp(g0 - g1)) AS r1, greatest(g0, g1) + ln(1 + exp(-abs(g0 - g1))) AS l FROM (SELECT a, b, {dens(0)} AS g0, {dens(1)} AS g1 FROM x, p{r - 1}))")
        ctes.append(f"q{r} AS MATERIALIZED (SELECT sum(r0) AS n0, sum(r1) AS n1, sum(r0 * a) / sum(r0) AS ma0, sum(r0 * b) / sum(r0) AS mb0, sum(r1 * a) / sum(r1) AS ma1, sum(r1 * b) / sum(r1) AS mb1, sum(l) AS ll FROM z{r})")
        spread = ", ".join(f"sum(r{k} * ({c} - m{c}{k}) * ({c} - m{c}{k})) / any_value(n{k}) AS s{c}{k}" for k in (0, 1) for c in "ab")
        ctes.append(f"p{r} AS MATERIALIZED (SELECT any_value(n0) / count(*) AS w0, any_value(n1) / count(*) AS w1, {', '.join(f'any_value(m{c}{k}) AS m{c}{k}' for k in (0, 1) for c in 'ab')}, {spread}, any_value(ll) AS ll FROM z{r}, q{r})")
    row = lambda k: f"SELECT {k} AS k, round(w{k}, 5) AS weight, round(ma{k}, 5) AS mean0, round(mb{k}, 5) AS mean1, round(sa{k}, 5) AS var0, round(sb{k}, 5) AS var1, {_ROUNDS} AS rounds, round(ll, 2) AS ll, FALSE AS done FROM p{_ROUNDS}"
    return f"WITH {', '.join(ctes)} {row(0)} UNION ALL {row(1)}"


@query(_mixture_sql())
def op_mixture(spark, sf_dir):  # noqa: ANN001, ANN201
    """Operators 167 and 169-174.  Stops after 15 rounds, before it has converged (the operator's default is 100)."""
    x = _points(spark, sf_dir)
    m = latent.mixture_frame(x, latent.gaussian_mixture_em(x, [0.5, 0.5], max_iterations=_ROUNDS, **_START))
    own = F.col("model")
    each = m.select(F.posexplode(F.arrays_zip(latent.mixture_weights(own).alias("w"), latent.mixture_means(own).alias("m"), latent.mixture_variances(own).alias("s"))).alias("k", "c"), "model")
    parts = {"weight": F.col("c.w"), "mean0": F.col("c.m")[0], "mean1": F.col("c.m")[1], "var0": F.col("c.s")[0], "var1": F.col("c.s")[1]}
    return each.select("k", *[F.round(v, 5).alias(k) for k, v in parts.items()], latent.em_iterations(own).alias("rounds"), F.round(latent.em_log_likelihood(own), 2).alias("ll"), latent.em_converged(own).alias("done"))


_CHAIN = {"initial": [0.6, 0.4], "transition": [[0.8, 0.2], [0.3, 0.7]]}
_FITS = 5


def _chain_sql() -> str:
    """Baum-Welch of two states and two dimensions for every user, with recursions over normalised forward and backward shares."""
    dens = lambda k: f"exp(-0.5 * (2 * ln(2 * pi()) + ln(sa{k}) + ln(sb{k}) + (a - ma{k}) * (a - ma{k}) / sa{k} + (b - mb{k}) * (b - mb{k}) / sb{k}))"
    names = ["pi0", "a00", "a10", "ma0", "mb0", "ma1", "mb1", "sa0", "sb0", "sa1", "sb1"]
    ctes = ["x AS MATERIALIZED (SELECT user_id, row_number() OVER w - 1 AS t, ln(value + 1) AS a, CAST(event_id % 3 AS DOUBLE) AS b, count(*) OVER (PARTITION BY user_id) - 1 AS last FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id))"]
    ctes.append("p0 AS (SELECT DISTINCT user_id, 0.6 AS pi0, 0.8 AS a00, 0.3 AS a10, 2.0 AS ma0, 0.5 AS mb0, 4.5 AS ma1, 1.5 AS mb1, 1.0 AS sa0, 1.0 AS sb0, 1.0 AS sa1, 1.0 AS sb1, CAST(NULL AS DOUBLE) AS ll, FALSE AS done, 0 AS rounds FROM x)")
    for r in range(1, _FITS + 1):
        ctes.append(f"e{r} AS MATERIALIZED (SELECT user_id, t, last, a, b, pi0, a00, a10, 1 - a00 AS a01, 1 - a10 AS a11, {dens(0)} AS e0, {dens(1)} AS e1 FROM x JOIN p{r - 1} USING (user_id))")
        u0, u1 = "(f.p * a00 + (1 - f.p) * a10) * e0", "(f.p * a01 + (1 - f.p) * a11) * e1"
        ctes.append(f"f{r} AS (SELECT user_id, t, pi0 * e0 / (pi0 * e0 + (1 - pi0) * e1) AS p, pi0 * e0 + (1 - pi0) * e1 AS c FROM e{r} WHERE t = 0 UNION ALL SELECT e.user_id, e.t, {u0} / ({u0} + {u1}), {u0} + {u1} FROM e{r} e JOIN f{r} f ON e.user_id = f.user_id AND e.t = f.t + 1)")
        b0, b1 = "(a00 * e0 * g.q + a01 * e1 * (1 - g.q))", "(a10 * e0 * g.q + a11 * e1 * (1 - g.q))"
        ctes.append(f"g{r} AS (SELECT user_id, t, CAST(0.5 AS DOUBLE) AS q FROM e{r} WHERE t = last UNION ALL SELECT e.user_id, e.t - 1, {b0} / ({b0} + {b1}) FROM e{r} e JOIN g{r} g ON e.user_id = g.user_id AND e.t = g.t WHERE e.t > 0)")
        ctes.append(f"s{r} AS MATERIALIZED (SELECT e.*, f.p, f.c, g.q, f.p * g.q / (f.p * g.q + (1 - f.p) * (1 - g.q)) AS h, lag(f.p) OVER (PARTITION BY e.user_id ORDER BY e.t) AS pp FROM e{r} e JOIN f{r} f USING (user_id, t) JOIN g{r} g USING (user_id, t))")
        w = {"w00": "pp * a00 * e0 * q", "w01": "pp * a01 * e1 * (1 - q)", "w10": "(1 - pp) * a10 * e0 * q", "w11": "(1 - pp) * a11 * e1 * (1 - q)"}
        ctes.append(f"w{r} AS (SELECT *, {', '.join(f'{v} AS {k}' for k, v in w.items())} FROM s{r})")
        sums = ", ".join(f"coalesce(sum({k} / (w00 + w01 + w10 + w11)), 0) AS {k}" for k in w)
        means = ", ".join(f"sum({h} * {c}) / greatest(sum({h}), 1e-8) AS m{c}{k}" for k, h in ((0, "h"), (1, "(1 - h)")) for c in "ab")
        ctes.append(f"q{r} AS MATERIALIZED (SELECT user_id, sum(ln(c)) AS ll, any_value(h) FILTER (t = 0) AS h0, sum(h) AS n0, sum(1 - h) AS n1, {means}, {sums} FROM w{r} GROUP BY user_id)")
        spread = ", ".join(f"greatest(sum({h} * ({c} - m{c}{k}) * ({c} - m{c}{k})) / greatest(any_value(n{k}), 1e-8), 1e-5) AS s{c}{k}" for k, h in ((0, "h"), (1, "(1 - h)")) for c in "ab")
        floor = lambda x, y: f"greatest({x}, 1e-8) / (greatest({x}, 1e-8) + greatest({y}, 1e-8))"
        ctes.append(f"v{r} AS (SELECT user_id, any_value({floor('h0', '1 - h0')}) AS pi0, any_value({floor('w00', 'w01')}) AS a00, any_value({floor('w10', 'w11')}) AS a10, {', '.join(f'any_value(m{c}{k}) AS m{c}{k}' for k in (0, 1) for c in 'ab')}, {spread}, any_value(ll) AS ll FROM s{r} JOIN q{r} USING (user_id) GROUP BY user_id)")
        held = ", ".join(f"CASE WHEN o.done THEN o.{n} ELSE v.{n} END AS {n}" for n in [*names, "ll"])
        ctes.append(f"p{r} AS MATERIALIZED (SELECT user_id, {held}, o.done OR coalesce(abs(v.ll - o.ll) < 1e-5, FALSE) AS done, CASE WHEN o.done THEN o.rounds ELSE {r} END AS rounds FROM p{r - 1} o JOIN v{r} v USING (user_id))")
    return f"WITH RECURSIVE {', '.join(ctes)} SELECT user_id, {', '.join(f'round({n} + {TIE}, 4) + CAST(0 AS DOUBLE) AS {n}' for n in [*names, 'll'])}, CAST(rounds AS BIGINT) AS rounds, done FROM p{_FITS}"


@query(_chain_sql())
def op_hidden_markov(spark, sf_dir):  # noqa: ANN001, ANN201
    """Operators 168 and 172-178: a model for each sequence.  Stops after 5 rounds, converged or not (the operator's default is 100)."""
    m = F.col("model")
    models = latent.gaussian_hmm_em(_points(spark, sf_dir), ["user_id"], **_CHAIN, **_START, max_iterations=_FITS)
    a, mu, s = latent.hmm_transition(m), latent.hmm_means(m), latent.hmm_variances(m)
    parts = {"pi0": latent.hmm_initial(m)[0], "a00": a[0][0], "a10": a[1][0], "ma0": mu[0][0], "mb0": mu[0][1], "ma1": mu[1][0], "mb1": mu[1][1], "sa0": s[0][0], "sb0": s[0][1], "sa1": s[1][0], "sb1": s[1][1], "ll": latent.em_log_likelihood(m)}
    return rounded(models.select("user_id", *[v.alias(k) for k, v in parts.items()], latent.em_iterations(m).alias("rounds"), latent.em_converged(m).alias("done")), 4)


_HMM = f"""WITH RECURSIVE {E}, x AS (SELECT user_id, pos, ln(nav) AS a, ident % 3 AS b, max(pos) OVER (PARTITION BY user_id) AS last FROM e),
 em AS (SELECT user_id, pos, last, exp(-0.5 * ((a - 2) * (a - 2) + (b - 0.5) * (b - 0.5))) AS e0, exp(-0.5 * ((a - 4.5) * (a - 4.5) + (b - 1.5) * (b - 1.5))) AS e1 FROM x),
 f AS (SELECT user_id, pos, 0.6 * e0 / (0.6 * e0 + 0.4 * e1) AS p FROM em WHERE pos = 0
  UNION ALL SELECT em.user_id, em.pos, (0.8 * p + 0.3 * (1 - p)) * e0 / ((0.8 * p + 0.3 * (1 - p)) * e0 + (0.2 * p + 0.7 * (1 - p)) * e1) FROM em JOIN f ON em.user_id = f.user_id AND em.pos = f.pos + 1),
 g AS (SELECT user_id, pos, CAST(0.5 AS DOUBLE) AS q FROM em WHERE pos = last
  UNION ALL SELECT em.user_id, em.pos - 1, (0.8 * e0 * q + 0.2 * e1 * (1 - q)) / (0.8 * e0 * q + 0.2 * e1 * (1 - q) + 0.3 * e0 * q + 0.7 * e1 * (1 - q)) FROM em JOIN g ON em.user_id = g.user_id AND em.pos = g.pos WHERE em.pos > 0)
"""


@query(_HMM + sql({"f0": "p", "f1": "1 - p", "s0": "p * q / (p * q + (1 - p) * (1 - q))", "s1": "(1 - p) * (1 - q) / (p * q + (1 - p) * (1 - q))"}, "FROM f JOIN g USING (user_id, pos)", "user_id, pos AS i"))
def op_hmm_posteriors(spark, sf_dir):  # noqa: ANN001, ANN201
    """Operators 179 and 180."""
    x = _points(spark, sf_dir)
    e = x.select("user_id", "i", F.array(*[latent.log_density(F.col("x"), m, v) for m, v in zip(_START["means"], _START["variances"], strict=True)]).alias("e"))
    f = latent.hmm_filter(e, ["user_id"], **_CHAIN).withColumnRenamed("p", "f")
    both = f.join(latent.hmm_smooth(e, ["user_id"], **_CHAIN).withColumnRenamed("p", "s"), ["user_id", "i"])
    return rounded(both.select("user_id", "i", *[F.get(c, F.lit(k)).alias(f"{c}{k}") for c in "fs" for k in (0, 1)]))


@query("WITH RECURSIVE n AS (SELECT count(*) AS n FROM embeddings), s AS (SELECT 0 AS k, CAST(8 AS BIGINT) AS st UNION ALL SELECT k + 1, st * 48271 % 2147483647 FROM s WHERE k < 5) SELECT k - 1 AS k, st % n AS v FROM s, n WHERE k > 0")
def op_sample_unique_indices(spark, sf_dir):  # noqa: ANN001, ANN201
    """Operator 184."""
    n = spark.read.parquet(f"{sf_dir}/embeddings.parquet").count()
    return spark.createDataFrame(list(enumerate(latent.sample_unique_indices(n, 5, 7))), "k int, v long")


# -- finance -----------------------------------------------------------------------


def returns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A product a user, value in about +-24 %, some missing; the calendar has a day a position.

    Values are odd multiples of 1 / 166, so no level comes back to an earlier one: engines that multiply in another order agree on its rank.
    """
    e = spark.read.parquet(f"{sf_dir}/events.parquet")
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    pos = (F.row_number().over(w) - 1).cast("long")
    r = e.select(F.col("user_id").alias("product"), pos.alias("pos"), F.when(F.pmod("event_id", F.lit(7)) == 0, float("nan")).otherwise((F.pmod("event_id", F.lit(40)) - 19.5) / 83.0).alias("value"), (F.col("user_id") % 3).cast("int").alias("type"))
    return r.withColumn("ts", F.timestamp_add("DAY", F.col("pos").cast("int"), F.lit("2020-01-31").cast("timestamp")))


V = """v AS (SELECT user_id AS product, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS pos, CASE WHEN event_id % 7 = 0 THEN NULL ELSE (event_id % 40 - 19.5) / 83.0 END AS value, user_id % 3 AS type FROM events),
 w AS (SELECT *, strftime(DATE '2020-01-31' + CAST(pos AS INTEGER), '%Y%m%d') AS day, coalesce(product(1 + value) OVER (PARTITION BY product ORDER BY pos ROWS UNBOUNDED PRECEDING), 1) AS level FROM v)"""


@query(f"WITH {V}, s AS (SELECT *, value >= median(value) OVER (PARTITION BY type, pos) AS side FROM v), t AS (SELECT *, lag(side) OVER (PARTITION BY product ORDER BY pos) AS before FROM s WHERE value IS NOT NULL), c AS (SELECT product, count(*) FILTER (side = before) AS a, count(*) FILTER (side <> before) AS b FROM t GROUP BY product), d AS (SELECT product, avg(value) AS mean, stddev_samp(value) AS std FROM v GROUP BY product) " + sql({"mean": "mean", "std": "std", "std_only": "std", "cpr": f"CASE WHEN b > 0 THEN a * 1.0 / b ELSE {_NAN} END"}, "FROM c JOIN d USING (product)", "product"))
def finance_moments(spark, sf_dir):  # noqa: ANN001, ANN201
    """cal_std_mean, cal_std_mean_simd and cal_cpr."""
    v = returns(spark, sf_dir)
    return rounded(finance.cal_std_mean_simd(v).join(finance.cal_std_mean(v).withColumnRenamed("std", "std_only"), "product").join(finance.cal_cpr(v), "product"))


@query(f"""WITH {V}, x AS (SELECT *, greatest(1, max(level) OVER (PARTITION BY product ORDER BY pos ROWS UNBOUNDED PRECEDING)) AS pk1 FROM w), y AS (SELECT *, sum(CASE WHEN level < pk1 * (1 - 1e-12) THEN 0 ELSE 1 END) OVER (PARTITION BY product ORDER BY pos ROWS UNBOUNDED PRECEDING) AS g FROM x),
 lr AS (SELECT product, max(c) AS longest FROM (SELECT product, g, count(*) FILTER (level < pk1 * (1 - 1e-12)) AS c FROM y GROUP BY product, g) GROUP BY product),
 b AS (SELECT product, pos, day, first_value(CASE WHEN value IS NOT NULL THEN level END IGNORE NULLS) OVER (PARTITION BY product ORDER BY pos ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS lv FROM w),
 k AS (SELECT *, max(lv) OVER (PARTITION BY product ORDER BY pos ROWS UNBOUNDED PRECEDING) AS pk FROM b), dd AS (SELECT *, coalesce(least(0, (lv - pk) / pk), 0) AS dd FROM k),
 lo AS (SELECT product, min((dd, pos)) AS m, arg_min(day, (dd, pos)) AS low_day FROM dd GROUP BY product),
 z AS (SELECT dd.product, any_value(-m[1]) AS max_drawdown, any_value(low_day) AS low_day, CASE WHEN any_value(m[2]) = 0 THEN 0 ELSE coalesce(min(pos) FILTER (pos > m[2] AND lv >= pk) - any_value(m[2]), 1000000) END AS recovery FROM dd JOIN lo USING (product) GROUP BY dd.product)
SELECT product, round(max_drawdown + {TIE}, 6) + CAST(0 AS DOUBLE) AS max_drawdown, low_day, CAST(recovery AS BIGINT) AS recovery, CAST(longest AS BIGINT) AS longest FROM z JOIN lr USING (product)""")
def finance_drawdowns(spark, sf_dir):  # noqa: ANN001, ANN201
    """cal_max_dd and cal_longest_dd_recover.  The SQL engine multiplies each frame in an order of its own, so its comparison with the peak has a margin of rounding."""
    v = returns(spark, sf_dir)
    return rounded(finance.cal_max_dd(v).join(finance.cal_longest_dd_recover(v), "product"))


@query(f"""WITH {V}, x AS (SELECT *, coalesce(value > 0, false) AS up FROM w), y AS (SELECT *, sum(CASE WHEN up THEN 0 ELSE 1 END) OVER (PARTITION BY product ORDER BY pos ROWS UNBOUNDED PRECEDING) AS g FROM x),
 c AS (SELECT *, product(1 + value) OVER (PARTITION BY product, g ORDER BY pos ROWS UNBOUNDED PRECEDING) AS ratio, count(*) OVER (PARTITION BY product, g ORDER BY pos ROWS UNBOUNDED PRECEDING) AS n, min(day) OVER (PARTITION BY product, g) AS s0 FROM y WHERE up),
 big AS (SELECT product, max((round(ratio, 9), pos)) AS m, arg_max(n, (round(ratio, 9), pos)) AS p, arg_max(s0, (round(ratio, 9), pos)) AS s, arg_max(day, (round(ratio, 9), pos)) AS l FROM c GROUP BY product),
 lv AS (SELECT product, pos, level, coalesce(lag(level) OVER (PARTITION BY product ORDER BY pos), last_value(level) OVER (PARTITION BY product ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)) AS before FROM w),
 runs AS (SELECT product, g, count(*) AS n, min(pos) AS a, max(pos) AS b, min(day) AS s, max(day) AS l FROM y WHERE up GROUP BY product, g),
 lg AS (SELECT product, max((n, g)) AS m, arg_max(a, (n, g)) AS a, arg_max(b, (n, g)) AS b, arg_max(s, (n, g)) AS s, arg_max(l, (n, g)) AS l FROM runs GROUP BY product)
SELECT big.product, round(big.m[1] - 1 + {TIE}, 6) AS r, CAST(big.p AS BIGINT) AS p, big.s, big.l, round(e.level / f.before - 1 + {TIE}, 6) AS lr, CAST(lg.m[1] AS BIGINT) AS lp, lg.s AS ls, lg.l AS ll
FROM big JOIN lg USING (product) JOIN lv e ON e.product = lg.product AND e.pos = lg.b JOIN lv f ON f.product = lg.product AND f.pos = lg.a""")
def finance_streaks(spark, sf_dir):  # noqa: ANN001, ANN201
    """cal_all_largest_indicators and cal_all_longest_indicators."""
    v = returns(spark, sf_dir)
    longest = finance.cal_all_longest_indicators(v).select("product", *[F.col(c).alias("l" + c) for c in ("r", "p", "s", "l")])
    return rounded(finance.cal_all_largest_indicators(v).join(longest, "product"))


@query(f"""WITH {V}, days AS (SELECT pos, DATE '2020-01-31' + CAST(pos AS INTEGER) AS d FROM (SELECT DISTINCT pos FROM v)), la AS (SELECT max(pos) AS last FROM days),
 sale AS (SELECT a.pos, coalesce((SELECT min(b.pos) FROM days b WHERE b.d >= a.d + INTERVAL 1 MONTH), last) AS sale, last FROM days a, la), tl AS (SELECT count(*) AS tail FROM sale WHERE sale = last),
 h AS (SELECT x.product, y.level / x.level - 1 AS r FROM w x JOIN sale USING (pos) JOIN w y ON y.product = x.product AND y.pos = sale.sale, tl WHERE x.pos < greatest(last + 1 - tail - 1, 0)),
 o AS (SELECT product, avg(r) AS mean, median(r) AS median, avg((r > 0)::INT) AS win, avg((r > 0 AND r <= 0.05)::INT) AS gain_5, avg((r > 0.05 AND r <= 0.10)::INT) AS gain_10, avg((r > 0.10)::INT) AS gain_more, avg((r >= -0.05 AND r <= 0)::INT) AS loss_5, avg((r >= -0.10 AND r < -0.05)::INT) AS loss_10, avg((r < -0.10)::INT) AS loss_more FROM h GROUP BY product)
""" + sql({c: f"coalesce({c}, {_NAN})" for c in ("mean", "median", "win", "gain_5", "gain_10", "gain_more", "loss_5", "loss_10", "loss_more")}, "FROM (SELECT DISTINCT product FROM v) LEFT JOIN o USING (product)", "product"))
def finance_rolling_gain(spark, sf_dir):  # noqa: ANN001, ANN201
    """cal_rolling_gain_loss."""
    return rounded(finance.cal_rolling_gain_loss(returns(spark, sf_dir), "1M"))


@query("""SELECT l_suppkey, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue, round(stddev_samp(l_quantity), 6) AS spread, CAST(count(DISTINCT l_partkey) AS DOUBLE) AS parts FROM lineitem GROUP BY l_suppkey""")
def supplier_metrics(spark, sf_dir):  # noqa: ANN001, ANN201
    """Order-free metrics read three columns of the scan and need one aggregation."""
    li = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    f = IntervalFrame(li.select("l_suppkey", F.lit(0).cast("long").alias(POS), F.col("l_extendedprice").alias("price"), F.col("l_discount").alias("discount"), F.col("l_quantity").alias("quantity"), F.col("l_partkey").alias("part")), ("l_suppkey",))
    out = evaluate(f, {"revenue": "sum(price * (1 - discount))", "spread": "std(quantity)", "parts": "distinct_count(part)"})
    return out.select("l_suppkey", F.round("revenue", 2).alias("revenue"), F.round("spread", 6).alias("spread"), "parts")

