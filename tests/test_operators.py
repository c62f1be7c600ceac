import math

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tidemark.operators import kernels as k
from tidemark.operators import latent, matrix
from tidemark.operators.groups import in_groups

NAN = float("nan")
floats = st.lists(st.one_of(st.floats(-100, 100), st.just(NAN)), max_size=30).map(lambda v: np.array(v, float))
codes = st.lists(st.integers(-1, 2), max_size=30).map(lambda v: np.array(v, np.int64))


def test_smooth_and_filter_goldens():
    assert k.recursive_smooth(np.array([4.0, NAN, 1.0]), 3, 1).tolist()[::2] == [2.0, pytest.approx(5 / 3)]
    x, on = np.array([2.0, NAN, 4.0]), np.array([True, True, True])
    assert k.recursive_filter(x, on, 0.5, 0.0, 0, 0).tolist() == [1.0, 1.0, 2.5]
    assert k.recursive_filter(x, on, 0.5, 7.0, 1, 0).tolist() == [7.0, 7.0, 5.5]
    assert k.recursive_filter(x, on, 0.5, 0.0, 2, 0).tolist() == [2.0, 2.0, 3.0]
    assert math.isnan(k.recursive_filter(x, on, 0.5, 0.0, 0, 1)[1])


def test_adaptive_reset_and_warm_up():
    x, a, on = np.array([1.0, 3.0, 5.0]), np.full(3, 0.5), np.ones(3, bool)
    assert k.recursive_filter_adaptive(x, a, on, np.zeros(3, bool), 0, 1, 1, 1).tolist() == [1.0, 2.0, 3.5]
    assert k.recursive_filter_adaptive(x, a, on, np.array([False, True, False]), 0, 1, 1, 1).tolist() == [1.0, 3.0, 4.0]
    assert math.isnan(k.recursive_filter_adaptive(x, a, on, np.zeros(3, bool), 0, 1, 2, 1)[0])
    with pytest.raises(ValueError):
        k.recursive_filter_adaptive(x, np.full(3, 2.0), on, np.zeros(3, bool), 0, 1, 1, 1)


def test_second_order_and_kalman():
    x, no = np.array([1.0, 2.0, 3.0]), np.zeros(3, bool)
    assert k.linear_filter2(x, no, 1, 0, 0.5, 0, 1, 0).tolist() == [1.0, 2.5, 4.25]
    assert k.linear_filter2(x, no, 1, 0, 0.5, 0, 1, 1).tolist() == [1.0, 2.0, 4.0]
    m, p = k.scalar_kalman(np.array([1.0, NAN, 3.0]), 0.0, 1.0, 1.0)
    assert m[0] == 1 and math.isnan(m[1]) and m[2] == 2.0 and p[2] == 0.5


@given(floats)
@settings(max_examples=60, deadline=None)
def test_hysteresis_states_follow_the_thresholds(x):
    out = k.state_hysteresis(x, 50, 20, -50, -20)
    for v, s in zip(x, out, strict=True):
        assert (s == -1) == (not math.isfinite(v))
        if math.isfinite(v):
            assert s == 0 if v >= 50 else s == 2 if v <= -50 else True
            assert not (s == 0 and v <= 20) and not (s == 2 and v >= -20)


@given(codes, st.integers(1, 3), st.integers(1, 3))
@settings(max_examples=60, deadline=None)
def test_confirmation_needs_a_run(c, need, hold):
    out = k.state_confirm(c, need, hold)
    before = -1
    for i, s in enumerate(out):
        assert s == -1 or s in c[: i + 1]
        if s >= 0 and s != before and before >= 0:
            assert (c[i - need + 1 : i + 1] == s).all()
        before = s if s >= 0 else before


def test_continuous_state():
    s, e, p = k.state_continuous(np.array([1, 1, 0, -1]), np.zeros(4, np.int64), np.ones(4, bool), 2, 2)
    assert s.tolist() == [0, 1, 1, 1] and e.tolist() == [3, 1, 3, 2] and p.tolist() == [1, 0, 1, 0]


def test_drawdown_cycle():
    price = np.array([50.0, 51.0, 38.0, 36.0, 41.0, 43.5, 50.9, 30.0])
    # 38 / 51 - 1 = -0.25 is deep; 41 / 36 - 1 = 0.14 rebounds; 50.9 / 51 - 1 = -0.002 has recovered; 30 is deep again
    assert k.drawdown_cycle_state(price, price / np.maximum.accumulate(price) - 1, np.ones(8, bool), 0.2, 0.1, 0.01).tolist() == [0, 0, 2, 2, 1, 1, 0, 2]


def test_extrema_on_plateaus_and_gaps():
    x = np.array([7, 9, 9, 9, 5, 6, NAN, 8, 4, 4, 9, 2])
    # before is strict and after is not: the first of the plateau is the peak; the missing row cuts the second run off
    assert k.local_extrema(x, 1, 1, 0, 0).tolist() == [0, 1, 0, 0, -1, 0, -2, 0, -1, 0, 1, 0]


@given(st.lists(st.floats(0.5, 2), min_size=5, max_size=40).map(np.array))
@settings(max_examples=60, deadline=None)
def test_turns_alternate_and_last(x):
    turns = k.ps_filter(x, k.local_extrema(x, 1, 1, 0, 0), 2, 4, 0.1)
    at = [i for i in range(len(x)) if abs(turns[i]) == 1]
    assert all(turns[a] == -turns[b] for a, b in zip(at, at[1:], strict=False))
    assert all(b - a >= 4 for a, b in zip(at, at[2:], strict=False))


def plain_between(events):
    """Segments between neighbouring events of opposite kinds, inside runs that -2 cuts."""
    start, end = np.full(len(events), -1), np.full(len(events), -1)
    last = None
    for i, e in enumerate(events):
        if e == -2:
            last = None
        elif e:
            if last is not None and events[last] != e:
                start[last:i], end[last:i] = last, i
            last = i
    return start, end


def plain_reference(phases, changes, start, end, stress):
    out = [-1] * len(phases)
    stressed = False
    for t in range(len(phases)):
        r = int(end[t])
        if start[t] != t or r <= t:
            continue
        if phases[t] not in (0, 1) or not math.isfinite(changes[t]):
            stressed = False
            continue
        fall, rise = phases[t] == 1 and changes[t] <= -stress, phases[t] == 0 and stressed
        out[t] = 2 if rise else max(out[t], 0)
        out[t + 1 : r + 1] = [2 if fall else 1 if rise else 0] * (r - t)
        stressed = fall
    return out


def test_phases_and_reference_cycles_equal_plain_loops(spark):
    from tidemark.plans.compiler import evaluate
    from tidemark.plans.frame import IntervalFrame

    rng = np.random.default_rng(31)
    rows = []
    for p in range(25):
        events = rng.choice([0, 0, 1, -1, -2], 30, p=[0.3, 0.15, 0.25, 0.25, 0.05])
        changes = np.where(rng.random(30) < 0.1, NAN, rng.normal(0, 0.4, 30))
        rows += [(p, i, int(e), float(c)) for i, (e, c) in enumerate(zip(events, changes, strict=True))]
    f = IntervalFrame(spark.createDataFrame(rows, "p int, pos long, e long, c double"), ("p",))
    s = "between_events(e)"
    got = evaluate(f, {"s": f"segment_starts({s})", "t": f"segment_ends({s})", "phase": f"phase_direction(e, {s})", "ref": f"drawdown_cycle_reference(phase_direction(e, {s}), c, {s}, 0.25)"})
    got = {(r.p, r.pos): (r.s, r.t, r.phase, r.ref) for r in got.collect()}
    seen = set()
    for p in range(25):
        own = [r for r in rows if r[0] == p]
        events = np.array([r[2] for r in own])
        start, end = plain_between(events)
        phase = [-1 if a < 0 else 0 if events[a] == -1 else 1 for a in start]
        ref = plain_reference(phase, [r[3] for r in own], start, end, 0.25)
        seen |= set(ref)
        assert [got[p, i] for i in range(30)] == list(zip(start.tolist(), end.tolist(), phase, ref, strict=True))
    assert seen == {-1, 0, 1, 2}


def test_order_and_gather_equal_numpy(spark):
    from tidemark.plans.compiler import evaluate
    from tidemark.plans.frame import IntervalFrame

    rng = np.random.default_rng(8)
    x = [np.where(rng.random(n) < 0.2, NAN, rng.integers(0, 5, n).astype(float)) for n in (1, 7, 40)]
    f = IntervalFrame(spark.createDataFrame([(p, i, float(v)) for p, a in enumerate(x) for i, v in enumerate(a)], "p int, pos long, x double"), ("p",))
    got = {(r.p, r.pos): r for r in evaluate(f, {"o": "argsort(x)", "g": "gather(x, argsort(x))", "back": "gather(x, argsort(argsort(x)))"}).collect()}
    for p, a in enumerate(x):
        order = np.argsort(a, kind="stable")
        assert [got[p, i].o for i in range(len(a))] == order.tolist()
        assert np.array_equal([got[p, i].g for i in range(len(a))], a[order], equal_nan=True)
        assert np.array_equal([got[p, i].back for i in range(len(a))], a[np.argsort(order)], equal_nan=True)
    with pytest.raises(Exception, match="INDEX_OUT_OF_RANGE"):
        evaluate(f, "gather(x, argsort(x) + 1)").collect()


def plain_mixture(x, w, m, s, rounds):
    w, m, s = (np.array(v, float) for v in (w, m, s))
    for _ in range(rounds):
        g = np.log(w) - 0.5 * (((x[:, None] - m[None]) ** 2 / s[None]).sum(2) + np.log(s).sum(1) + x.shape[1] * np.log(2 * np.pi))
        z = np.log(np.exp(g).sum(1))
        p = np.exp(g - z[:, None])
        n = p.sum(0)
        w, m = n / len(x), p.T @ x / n[:, None]
        s = np.maximum(np.stack([(p[:, c : c + 1] * (x - m[c]) ** 2).sum(0) for c in range(len(m))]) / n[:, None], 1e-5)
    return w, m, s, z.sum()


def test_mixture_equals_a_plain_fit(spark):
    rng = np.random.default_rng(3)
    x = np.vstack([rng.normal(0, 1, (60, 2)), rng.normal(4, 1, (40, 2))])
    df = spark.createDataFrame([(i, r.tolist()) for i, r in enumerate(x)], "i long, x array<double>").repartition(3)
    start = ([0.5, 0.5], [[0.5, 0.5], [3.0, 3.0]], [[1.0, 1.0], [1.0, 1.0]])
    got = latent.gaussian_mixture_em(df, *start, max_iterations=6, tolerance=0)
    w, m, s, ll = plain_mixture(x, *start, 6)
    assert np.allclose(got.weights, w) and np.allclose(got.means, m) and np.allclose(got.variances, s) and got.log_likelihood == pytest.approx(ll)
    assert latent.gaussian_mixture_em(df, *start, max_iterations=100, tolerance=1e-3).converged


def test_chain_posteriors_by_enumeration():
    rng = np.random.default_rng(5)
    e, pi, a = rng.normal(size=(4, 2)), np.array([0.6, 0.4]), np.array([[0.7, 0.3], [0.2, 0.8]])
    weight = {}
    for path in np.ndindex(2, 2, 2, 2):
        p = pi[path[0]] * math.exp(e[0, path[0]])
        for t in range(1, 4):
            p *= a[path[t - 1], path[t]] * math.exp(e[t, path[t]])
        weight[path] = p
    total = sum(weight.values())
    want = [[sum(p for q, p in weight.items() if q[t] == s) / total for s in range(2)] for t in range(4)]
    assert np.allclose(latent.smooth_of(e, pi, a), want)
    assert np.allclose(latent.filter_of(e, pi, a)[-1], want[-1])


def plain_chain(x, pi, a, m, s, rounds):
    """Baum-Welch with logarithms, a step at a time; several sequences share one model."""
    pi, a, m, s = (np.array(v, float) for v in (pi, a, m, s))
    lse = lambda v, axis: np.logaddexp.reduce(v, axis=axis)
    for _ in range(rounds):
        first, xi, n, sx, parts, total = np.zeros(len(pi)), np.zeros(a.shape), np.zeros(len(pi)), np.zeros(m.shape), [], 0.0
        for o in x:
            e = -0.5 * (((o[:, None] - m[None]) ** 2 / s[None]).sum(2) + np.log(s).sum(1) + o.shape[1] * np.log(2 * np.pi))
            f, b = np.zeros(e.shape), np.zeros(e.shape)
            f[0] = np.log(pi) + e[0]
            for t in range(1, len(o)):
                f[t] = e[t] + lse(f[t - 1][:, None] + np.log(a), 0)
            for t in range(len(o) - 2, -1, -1):
                b[t] = lse(np.log(a) + (e[t + 1] + b[t + 1])[None], 1)
            ll = lse(f[-1], 0)
            g = np.exp(f + b - ll)
            for t in range(len(o) - 1):
                xi += np.exp(f[t][:, None] + np.log(a) + (e[t + 1] + b[t + 1])[None] - ll)
            first, n, sx, total = first + g[0], n + g.sum(0), sx + g.T @ o, total + ll
            parts.append((g, o))
        pi = np.maximum(first, 1e-8) / np.maximum(first, 1e-8).sum()
        a = np.maximum(xi, 1e-8)
        a /= a.sum(1, keepdims=True)
        m = sx / n[:, None]
        s = np.maximum(sum(np.stack([(g[:, c : c + 1] * (o - m[c]) ** 2).sum(0) for c in range(len(m))]) for g, o in parts) / n[:, None], 1e-5)
    return pi, a, m, s, total


def test_chain_fits_equal_a_plain_fit(spark):
    rng = np.random.default_rng(6)
    x = [np.concatenate([rng.normal(0, 1, (n, 2)), rng.normal(3, 1, (2 * n, 2))]) for n in (1, 3, 9, 4, 30)]
    start = ([0.5, 0.5], [[0.9, 0.1], [0.2, 0.8]], [[0.0, 0.5], [2.0, 2.0]], [[1.0, 1.0], [2.0, 1.0]])
    rows = [(None if k == 3 else k, i, v.tolist()) for k, o in enumerate(x) for i, v in enumerate(o)]
    df = spark.createDataFrame(rows, "k int, i long, x array<double>").repartition(5)
    got = {r.k: r.model for r in latent.gaussian_hmm_em(df, ["k"], *start, max_iterations=4, tolerance=0.0).collect()}
    assert set(got) == {0, 1, 2, None, 4}
    for k, o in enumerate(x):
        want, own = plain_chain([o], *start, 4), got[None if k == 3 else k]
        for a, b in zip((own.initial, own.transition, own.means, own.variances, own.log_likelihood), want, strict=True):
            assert np.allclose(a, b, atol=1e-7)
    shared = latent.gaussian_hmm_em_shared(df, ["k"], *start, max_iterations=4, tolerance=0.0)
    own, want = shared.first().model, plain_chain(x, *start, 4)
    for a, b in zip((own.initial, own.transition, own.means, own.variances, own.log_likelihood), want, strict=True):
        assert np.allclose(a, b, atol=1e-7)
    assert latent.hmm_means(shared).first().means == own.means and latent.em_iterations(shared).first().iterations == 4
    lls = [latent.fit_chain(x[4], *start, n, 0.0).log_likelihood for n in (1, 2, 4)]
    assert lls[0] <= lls[1] <= lls[2] and latent.fit_chain(x[4], *start, 200, 1e-3).converged


def test_moments_with_missing_cells_equal_numpy(spark):
    rng = np.random.default_rng(19)
    x = np.where(rng.random((60, 4)) < 0.15, NAN, rng.normal(1e6, 1.0, (60, 4)))
    cells = [(i, j, float(x[i, j])) for i in range(60) for j in range(4) if not math.isnan(x[i, j])]
    df = spark.createDataFrame(cells, "i long, j long, v double").repartition(6)
    cov, cor = ({(r.i, r.j): r.v for r in f(df).collect()} for f in (matrix.covariance, matrix.correlation))
    for a in range(4):
        for b in range(4):
            both = ~np.isnan(x[:, a]) & ~np.isnan(x[:, b])
            c = np.cov(x[both, a], x[both, b])
            assert cov[a, b] == pytest.approx(c[0, 1], abs=1e-8) and cor[a, b] == pytest.approx(c[0, 1] / np.sqrt(c[0, 0] * c[1, 1]), abs=1e-8)


def test_sampling_is_distinct_and_fixed():
    got = latent.sample_unique_indices(7, 7, 3)
    assert sorted(got) == list(range(7)) and got == latent.sample_unique_indices(7, 7, 3)
    assert got[0] == 4 * 48271 % 2147483647 % 7


def test_window_lengths_of_shortened_series(spark):
    from tidemark.plans.compiler import evaluate
    from tidemark.plans.frame import IntervalFrame

    f = IntervalFrame(spark.createDataFrame([(1, i, v) for i, v in enumerate([1.0, 3.0, 6.0])], "p int, pos long, x double"), ("p",))
    got = evaluate(f, {"n": "length(difference(x))", "s": "sum(difference(x))", "a": "argmax(difference(x))", "k": "sum(recursive_filter(difference(x), 0.5, 0, difference(x) > 0))"}).first()
    assert (got.n, got.s, got.a, got.k) == (2.0, 5.0, 1.0, 1.0 + 2.0)


def test_dense_takes_the_groups_of_a_batch_together(spark):
    """Stacks of matrices of mixed shapes and a null key."""
    r = np.random.default_rng(5)
    systems = {k: (lambda m: (m @ m.T + np.eye(len(m)), r.normal(size=len(m))))(r.normal(size=(1 + (k or 0) % 3,) * 2)) for k in [None, *range(400)]}
    a = spark.createDataFrame([(k, i, j, float(v)) for k, (m, _) in systems.items() for (i, j), v in np.ndenumerate(m)], "k long, i long, j long, v double")
    b = spark.createDataFrame([(k, i, float(v)) for k, (_, y) in systems.items() for i, v in enumerate(y)], "k long, i long, v double")
    dense = matrix.Dense(["k"], a=a, b=b).solve("x", "a", "b").cholesky("l", "a").triangular_solve("t", "l", "b").symmetric_eigh("e", "v", "a", 1e-13, 16).run()
    assert "FlatMapGroups" not in dense._jdf.queryExecution().toString()  # a call a group costs some 1 ms
    got = {(x.k, x.part, x.i, x.j): x.v for x in dense.collect()}
    want = {}
    for k, (m, y) in systems.items():
        low, (e, v) = np.linalg.cholesky(m), matrix.eigh_of(m)
        for part, values in (("x", np.linalg.solve(m, y)[:, None]), ("l", low), ("t", np.linalg.solve(low, y)[:, None]), ("e", e[:, None]), ("v", v)):
            want |= {(k, part, i, j): x for (i, j), x in np.ndenumerate(values)}
    assert got.keys() == want.keys() and all(got[k] == pytest.approx(want[k], abs=1e-9) for k in want)
    stack = np.stack([np.diag([2.0, 4.0]), [[0.0, 1.0], [1.0, 0.0]]])
    assert np.allclose(matrix.lu_solve(stack, np.ones((2, 2, 1)))[..., 0], [[0.5, 0.25], [1, 1]])
    with pytest.raises(ValueError, match="SINGULAR_MATRIX"):
        matrix.lu_solve(np.stack([np.eye(2), np.ones((2, 2))]), np.ones((2, 2, 1)))


def test_groups_stay_whole_across_batches(spark):
    """Small groups, one larger than two batches, and a batch's end inside a group."""
    import pyarrow as pa

    rows = spark.range(300_000).selectExpr("IF(id < 160000, -1, id % 3000) AS g", "300000 - id AS pos")

    def run(t, starts):
        n, pos = np.diff(np.append(starts, t.num_rows)), t.column("pos").to_numpy()
        rising = [bool((np.diff(pos[a : a + c]) > 0).all()) for a, c in zip(starts, n, strict=True)]
        yield pa.table({"g": t.column("g").take(pa.array(starts)), "n": n, "rising": rising})

    got = in_groups(rows, ["g"], ["pos"], run, "g long, n long, rising boolean").collect()
    want = {r.g: r.n for r in rows.groupBy("g").agg(F.count("*").alias("n")).collect()}
    assert len(got) == len(want) and {r.g: r.n for r in got} == want and all(r.rising for r in got)
    assert in_groups(rows.where("g > 5000"), ["g"], ["pos"], run, "g long, n long, rising boolean").count() == 0
