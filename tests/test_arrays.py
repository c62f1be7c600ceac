"""Arrays in expressions against NumPy."""

import math

import numpy as np
import pytest

from tidemark.plans.compiler import evaluate
from tidemark.plans.expr import ExpressionError
from tidemark.plans.frame import IntervalFrame

ROWS, WIDTH = 9, 3
NAMES = ["a", "b", "c"]
M = np.random.default_rng(41).uniform(0.5, 2.0, (2, ROWS, WIDTH))
S = np.array([[5.0, 1.0, 0.5], [1.0, 4.0, 0.25], [0.5, 0.25, 3.0]])
W = np.array([0.5, 0.3, 0.2])
ARRAYS = {"x": NAMES, "w": W.tolist(), "s": S.tolist()}


@pytest.fixture(scope="module")
def frame(spark):
    rows = [(k, t, *map(float, M[k, t])) for k in range(2) for t in range(ROWS)]
    return IntervalFrame(spark.createDataFrame(rows, "key long, pos long, a double, b double, c double"), ("key",))


def softmax(x, axis):
    e = np.exp(x - x.max(axis, keepdims=True))
    return e / e.sum(axis, keepdims=True)


def eigen(a):
    w, v = np.linalg.eigh(a)
    return w, v * np.where(v[np.abs(v).argmax(0), range(len(w))] < 0, -1, 1)


#: expression -> plain version of one interval's matrix
STATIC = {
    "sum_time(x)": lambda x: x.sum(0), "mean_time(x)": lambda x: x.mean(0), "product_time(x)": lambda x: x.prod(0), "variance_time(x)": lambda x: x.var(0, ddof=1),
    "std_time(x)": lambda x: x.std(0, ddof=1), "min_time(x)": lambda x: x.min(0), "max_time(x)": lambda x: x.max(0), "covariance(x)": lambda x: np.cov(x.T), "correlation(x)": lambda x: np.corrcoef(x.T),
    "sum(matvec(x, w))": lambda x: (x @ W).sum(), "std(portfolio_returns(x, w))": lambda x: (x @ W).std(ddof=1), "quadratic_form(w, covariance(x))": lambda x: W @ np.cov(x.T) @ W,
    "trace(covariance(x))": lambda x: np.trace(np.cov(x.T)), "diag(covariance(x))": lambda x: np.diag(np.cov(x.T)), "diag(mean_time(x))": lambda x: np.diag(x.mean(0)), "outer(mean_time(x), w)": lambda x: np.outer(x.mean(0), W),
    "dot(w, mean_time(x))": lambda x: W @ x.mean(0), "matmul(s, covariance(x))": lambda x: S @ np.cov(x.T), "transpose(outer(mean_time(x), w))": lambda x: np.outer(W, x.mean(0)), "matvec(s, mean_time(x))": lambda x: S @ x.mean(0),
    "solve(covariance(x) + s, mean_time(x))": lambda x: np.linalg.solve(np.cov(x.T) + S, x.mean(0)), "solve_multi(covariance(x) + s, s)": lambda x: np.linalg.solve(np.cov(x.T) + S, S),
    "cholesky(covariance(x) + s)": lambda x: np.linalg.cholesky(np.cov(x.T) + S), "triangular_solve(cholesky(covariance(x) + s), w)": lambda x: np.linalg.solve(np.linalg.cholesky(np.cov(x.T) + S), W),
    "eigenvalues(symmetric_eigh(covariance(x)))": lambda x: eigen(np.cov(x.T))[0], "eigenvectors(symmetric_eigh(covariance(x) + s, 0.0000000000001, 50))": lambda x: eigen(np.cov(x.T) + S)[1],
    "sum_axis(x, 0)": lambda x: x.sum(0), "variance_axis(x, 0)": lambda x: x.var(0), "max_axis(x, 0)": lambda x: x.max(0), "argmax_axis(x, 0)": lambda x: x.argmax(0), "logsumexp_axis(x, 0)": lambda x: np.log(np.exp(x).sum(0)),
    "quantiles_axis(x, w, 0)": lambda x: np.quantile(x, W, 0), "mean(sum_axis(stack(a, b, 1), 1))": lambda x: x[:, :2].sum(1).mean(), "sum_axis(covariance(x), 1)": lambda x: np.cov(x.T).sum(1), "variance_asset(s) + 0 * mean_time(x)": lambda x: S.var(1, ddof=1),
    "solve(s, w)": lambda x: np.linalg.solve(S, W), "swap_axes(outer(w, mean_time(x)), 0, 1)": lambda x: np.outer(x.mean(0), W), "group_apply(quadratic_form(w, covariance(x)), a > 0)": lambda x: np.full(ROWS, W @ np.cov(x.T) @ W),
}
TIMED = {
    "x * 2 - 1": lambda x: x * 2 - 1, "x / x": lambda x: x / x, "sum_asset(x)": lambda x: x.sum(1), "mean_asset(x)": lambda x: x.mean(1), "product_asset(x)": lambda x: x.prod(1), "variance_asset(x)": lambda x: x.var(1, ddof=1),
    "std_asset(x)": lambda x: x.std(1, ddof=1), "min_asset(x)": lambda x: x.min(1), "max_asset(x)": lambda x: x.max(1), "matvec(x, w)": lambda x: x @ W, "matmul(x, s)": lambda x: x @ S, "affine_contract(x, s, w)": lambda x: W + x @ S,
    "mean_axis(x, 1)": lambda x: x.mean(1), "variance_axis(x, 1, 1)": lambda x: x.var(1, ddof=1), "max_axis(x, 1)": lambda x: x.max(1), "argmax_axis(x, 1)": lambda x: x.argmax(1), "logsumexp_axis(x, 1)": lambda x: np.log(np.exp(x).sum(1)),
    "softmax_axis(x, 1)": lambda x: softmax(x, 1), "softmax_axis(x, 0)": lambda x: softmax(x, 0), "cumulative_product_axis(x, 1, 2)": lambda x: 2 * x.cumprod(1), "cumulative_product_axis(x, 0, 2)": lambda x: 2 * x.cumprod(0),
    "cumulative_max_axis(x, 1, 1)": lambda x: np.maximum(1, np.maximum.accumulate(x, 1)), "cumulative_max_axis(x, 0, 1)": lambda x: np.maximum(1, np.maximum.accumulate(x, 0)), "quantiles_axis(x, w, 1)": lambda x: np.quantile(x, W, 1).T,
    "take_axis(x, 2, 1)": lambda x: x[:, [2]], "slice_axis(x, 1, 0, 3, 2)": lambda x: x[:, ::2], "concatenate(x, x * 2, 1)": lambda x: np.hstack([x, 2 * x]), "stack(x, -x, 2)": lambda x: np.stack([x, -x], 2), "x - broadcast_like(mean_time(x), x)": lambda x: x - x.mean(0),
    "sum_axis(stack(x, x, 1), 2)": lambda x: np.stack([x.sum(1)] * 2, 1), "rolling_mean(sum_asset(x), 3)": lambda x: np.r_[[np.nan] * 2, np.convolve(x.sum(1), np.ones(3) / 3, "valid")], "sum_asset(x * broadcast_like(w, x))": lambda x: x @ W,
}


@pytest.mark.parametrize("policy", ["raise", "isolate"])
def test_arrays_without_time(frame, policy):
    flat = {k: e for k, e in enumerate(STATIC) if not e.startswith("group_apply")}
    got = evaluate(frame, {f"r{k}": e for k, e in flat.items()}, error_policy=policy, arrays=ARRAYS).collect()
    assert len(got) == 2
    for r in got:
        for k, e in flat.items():
            np.testing.assert_allclose(np.array(r[f"r{k}"], float), STATIC[e](M[r.key]), rtol=1e-9, err_msg=e)
            assert policy == "raise" or r[f"r{k}_status"] == 0


@pytest.mark.parametrize("policy", ["raise", "isolate"])
def test_arrays_with_time(frame, policy):
    both = TIMED | {e: f for e, f in STATIC.items() if e.startswith("group_apply")}
    got = evaluate(frame, {f"r{k}": e for k, e in enumerate(both)}, error_policy=policy, arrays=ARRAYS).orderBy("key", "pos").collect()
    for key in range(2):
        rows = [r for r in got if r.key == key]
        for k, (e, plain) in enumerate(both.items()):
            np.testing.assert_allclose(np.array([r[f"r{k}"] for r in rows], float), plain(M[key]), rtol=1e-9, err_msg=e)


def test_arrays_share_one_shuffle(frame):
    out = evaluate(frame, {"risk": "quadratic_form(w, covariance(x))", "worst": "min_time(x)"}, arrays=ARRAYS)
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1 and "Python" not in plan


def test_failures_of_factorisations(frame):
    bad = {"u": np.ones((2, 2)).tolist(), "n": [[1.0, 2.0], [2.0, 1.0]]}
    for e, error in (("solve(u * mean(a), take_axis(mean_time(x), t, 0))", "SINGULAR_MATRIX"), ("cholesky(n * mean(a))", "NOT_POSITIVE_DEFINITE")):
        arrays = ARRAYS | bad | {"t": [0, 1]}
        with pytest.raises(Exception, match=error):
            evaluate(frame, {"r": e}, arrays=arrays).collect()
        got = evaluate(frame, {"r": e, "ok": "sum(a)"}, error_policy="isolate", arrays=arrays).collect()
        assert all(r.r_status == 4 and r.ok_status == 0 and all(math.isnan(v) for v in np.array(r.r, float).reshape(-1)) for r in got)
    with pytest.raises(ExpressionError, match="SINGULAR_MATRIX"):
        evaluate(frame, "sum_axis(solve(u, t), 0)", arrays=bad | {"t": [0.0, 1.0]})


@pytest.mark.parametrize(
    "e",
    ["x + w", "x + a", "mean(x)", "matvec(x, s)", "solve(x, w)", "transpose(x)", "take_axis(x, 7, 1)", "take_axis(x, 0, 0)", "slice_axis(x, 1, 0, 9, 1)", "sum_axis(x, 2)", "quadratic_form(w, x)", "quantiles_axis(x, w * 2, 5)", "lag(x)"],
)
def test_shapes_are_strict(frame, e):
    with pytest.raises(ExpressionError):
        evaluate(frame, {"r": e}, arrays=ARRAYS)


def test_nan_goes_through_rows_as_through_series(spark):
    nan = float("nan")
    f = IntervalFrame(spark.createDataFrame([(0, 0, 1.0, nan), (0, 1, nan, 2.0), (0, 2, 3.0, 4.0)], "key long, pos long, a double, b double"), ("key",))
    got = evaluate(f, {"low": "min_asset(x)", "q": "quantiles_axis(x, p, 1)"}, arrays={"x": ["a", "b"], "p": [0.0, 1.0]}).orderBy("pos").collect()
    assert str([r.low for r in got]) == str([1.0, nan, 3.0]) and str([list(r.q) for r in got]) == str([[1.0, nan], [2.0, nan], [3.0, 4.0]])
    with pytest.raises(Exception, match="NON_FINITE_INPUT"):
        evaluate(f, {"m": "max_axis(x, 1)"}, arrays={"x": ["a", "b"]}).collect()
