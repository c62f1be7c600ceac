"""Latent-variable operators: diagonal Gaussian densities, mixtures and hidden Markov models.

Rows of observations are (i, x array<double>), i the position.  Mixtures iterate on the driver over one distributed
aggregation a round: only k x (2d + 1) sums come back, whatever the number of rows.  A chain is sequential inside, but
sequences are independent: they arrive sorted, are gathered to batches of bounded size and go through the recursions
side by side, one NumPy step a position for all of them.  A model of all sequences sums their expectations a round.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType

#: Floors of the estimation.
LOG_FLOOR, COUNT_FLOOR, VARIANCE_FLOOR, CHAIN_FLOOR, NORM_FLOOR = 1e-12, 1e-8, 1e-5, 1e-8, 1e-300


def _array(values: np.ndarray) -> Column:
    return F.array(*[F.lit(float(v)) for v in values])


def log_density(x: Column, mean: np.ndarray, variance: np.ndarray) -> Column:
    v = np.maximum(np.asarray(variance, float), LOG_FLOOR)
    total = float(-0.5 * (len(v) * np.log(2 * np.pi) + np.log(v).sum()))
    for j, (m, s) in enumerate(zip(mean, v, strict=True)):
        d = F.get(x, F.lit(j)) - F.lit(float(m))
        total = total - d * d * F.lit(0.5 / float(s)) if isinstance(total, Column) else F.lit(total) - d * d * F.lit(0.5 / float(s))
    return total


def gaussian_log_density(values: DataFrame, means: np.ndarray, variances: np.ndarray) -> DataFrame:
    """(i, x) -> (i, k, v)."""
    columns = F.array(*[log_density(F.col("x"), m, s) for m, s in zip(means, variances, strict=True)])
    return values.select("i", F.posexplode(columns).alias("k", "v"))


@dataclass(frozen=True)
class Mixture:
    weights: np.ndarray
    means: np.ndarray
    variances: np.ndarray
    iterations: int
    log_likelihood: float
    converged: bool


@dataclass(frozen=True)
class Chain:
    initial: np.ndarray
    transition: np.ndarray
    means: np.ndarray
    variances: np.ndarray
    iterations: int
    log_likelihood: float
    converged: bool


def gaussian_mixture_em(values: DataFrame, weights, means, variances, max_iterations: int = 100, tolerance: float = 1e-6) -> Mixture:
    w, m, s = (np.array(a, float) for a in (weights, means, variances))
    k, d = m.shape
    prior, ll, done, rounds = -np.inf, -np.inf, False, 0
    for rounds in range(1, max_iterations + 1):
        logs = [log_density(F.col("x"), m[c], s[c]) + float(np.log(max(w[c], LOG_FLOOR))) for c in range(k)]
        rows = values.select("x", *[g.alias(f"g{c}") for c, g in enumerate(logs)])
        top = F.greatest(*[F.col(f"g{c}") for c in range(k)]) if k > 1 else F.col("g0")
        rows = rows.withColumn("z", F.ln(sum((F.exp(F.col(f"g{c}") - top) for c in range(k)), F.lit(0.0))) + top)
        rows = rows.select("x", "z", *[F.exp(F.col(f"g{c}") - F.col("z")).alias(f"p{c}") for c in range(k)])
        sums = [F.count("*").alias("n"), F.sum("z").alias("ll")]
        for c in range(k):
            sums.append(F.sum(f"p{c}").alias(f"n{c}"))
            for j in range(d):
                # about the old mean, which keeps the second moment well conditioned
                dx = F.get("x", F.lit(j)) - F.lit(float(m[c, j]))
                sums += [F.sum(F.col(f"p{c}") * dx).alias(f"a{c}_{j}"), F.sum(F.col(f"p{c}") * dx * dx).alias(f"b{c}_{j}")]
        got = rows.agg(*sums).first()
        ll = got["ll"]
        size = np.array([max(got[f"n{c}"], COUNT_FLOOR) for c in range(k)])
        raw = np.array([got[f"n{c}"] for c in range(k)])
        a = np.array([[got[f"a{c}_{j}"] for j in range(d)] for c in range(k)])
        b = np.array([[got[f"b{c}_{j}"] for j in range(d)] for c in range(k)])
        new = m * (raw / size)[:, None] + a / size[:, None]
        step = new - m
        s = np.maximum((b - 2 * step * a + step * step * raw[:, None]) / size[:, None], VARIANCE_FLOOR)
        w, m = size / got["n"], new
        done = bool(abs(ll - prior) < tolerance)
        if done:
            break
        prior = ll
    return Mixture(w, m, s, rounds, float(ll), done)


def _scaled(e: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Emissions of padded sequences (sequence, position, state) over their largest at each position, and the sum of its logarithms."""
    top = e.max(2)
    there = np.arange(e.shape[1])[None] < lengths[:, None]
    return np.exp(e - top[:, :, None]), np.where(there, top, 0.0).sum(1)


def _passes(e: np.ndarray, lengths: np.ndarray, initial: np.ndarray, transition: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Normalised forward and backward vectors, log-likelihoods, and the floored transitions, for a batch of padded sequences.

    ``initial`` is (sequence, state) and ``transition`` (sequence, state, state).  Positions from a sequence's length on hold
    what its last one has forward, and ones backward.
    """
    b, ll = _scaled(e, lengths)
    a = np.maximum(transition, LOG_FLOOR)
    n, size, k = e.shape
    forward, backward = np.empty_like(e), np.ones_like(e)
    p = np.maximum(initial, LOG_FLOOR) * b[:, 0]
    for i in range(size):
        if i:
            on = (i < lengths)[:, None]
            p = np.where(on, np.einsum("sk,skj->sj", p, a) * b[:, i], p)
        c = np.maximum(p.sum(1), NORM_FLOOR)
        ll = ll + np.where(i < lengths, np.log(c), 0.0)
        p = p / c[:, None]
        forward[:, i] = p
    q = np.ones((n, k))
    for i in range(size - 2, -1, -1):
        new = np.einsum("skj,sj->sk", a, b[:, i + 1] * q)
        new = new / np.maximum(new.sum(1), NORM_FLOOR)[:, None]
        q = np.where((i + 1 < lengths)[:, None], new, q)
        backward[:, i] = q
    return forward, backward, ll, a


def _expected(x: np.ndarray, lengths: np.ndarray, pi: np.ndarray, a: np.ndarray, m: np.ndarray, s: np.ndarray) -> dict[str, np.ndarray]:
    """Expectations of a batch, a sequence each: first states, transitions, occupations, first and second moments, log-likelihood."""
    v = np.maximum(s, LOG_FLOOR)
    n, size, d = x.shape
    e = -0.5 * (d * np.log(2 * np.pi) + np.log(v).sum(2)[:, None] + sum((x[:, :, None, j] - m[:, None, :, j]) ** 2 / v[:, None, :, j] for j in range(d)))
    f, q, ll, floored = _passes(e, lengths, pi, a)
    there = np.arange(size)[None] < lengths[:, None]
    g = f * q
    g = g / np.maximum(g.sum(2, keepdims=True), NORM_FLOOR) * there[:, :, None]
    xi = np.zeros_like(floored)
    if size > 1:
        right = _scaled(e, lengths)[0][:, 1:] * q[:, 1:]
        total = np.einsum("sti,sij,stj->st", f[:, :-1], floored, right, optimize=True)
        w = there[:, 1:] / np.maximum(total, NORM_FLOOR)
        xi = np.einsum("sti,stj->sij", f[:, :-1] * w[:, :, None], right, optimize=True) * floored
    first = np.einsum("stk,std->skd", g, x, optimize=True)
    return {"pi": g[:, 0], "xi": xi, "n": g.sum(1), "x": first, "xx": (g, x), "ll": ll}


def _updated(t: dict[str, np.ndarray], m: np.ndarray) -> tuple[np.ndarray, ...]:
    pi = np.maximum(t["pi"], CHAIN_FLOOR)
    a = np.maximum(t["xi"], CHAIN_FLOOR)
    size = np.maximum(t["n"], COUNT_FLOOR)[:, :, None]
    return pi / pi.sum(1, keepdims=True), a / a.sum(2, keepdims=True), t["x"] / size, size


def fit_chains(x: np.ndarray, lengths: np.ndarray, initial, transition, means, variances, max_iterations: int = 100, tolerance: float = 1e-5) -> list[Chain]:
    """A model for each of some padded sequences (sequence, position, dimension); a settled one is left alone by later rounds."""
    pi, a, m, s = (np.repeat(np.array(v, float)[None], len(x), 0) for v in (initial, transition, means, variances))
    prior, ll = np.full(len(x), -np.inf), np.full(len(x), -np.inf)
    rounds, done = np.zeros(len(x), int), np.zeros(len(x), bool)
    for _ in range(max_iterations):
        on = np.flatnonzero(~done)
        if not len(on):
            break
        t = _expected(x[on], lengths[on], pi[on], a[on], m[on], s[on])
        pi[on], a[on], new, size = _updated(t, m[on])
        g, own = t["xx"]
        spread = np.stack([np.einsum("stk,stk->sk", g, (own[:, :, None, j] - new[:, None, :, j]) ** 2) for j in range(x.shape[2])], 2)
        m[on], s[on] = new, np.maximum(spread / size, VARIANCE_FLOOR)
        ll[on], rounds[on] = t["ll"], rounds[on] + 1
        done[on] = np.abs(t["ll"] - prior[on]) < tolerance
        prior[on] = t["ll"]
    return [Chain(pi[i], a[i], m[i], s[i], int(rounds[i]), float(ll[i]), bool(done[i])) for i in range(len(x))]


def fit_chain(x: np.ndarray, *start, **options) -> Chain:  # noqa: ANN002, ANN003
    return fit_chains(np.asarray(x, float)[None], np.array([len(x)]), *start, **options)[0]


BATCH_CELLS = 2_000_000


def _sequences(values: DataFrame, by: list[str], column: str, schema: str, run: Callable[[pa.Table, np.ndarray, np.ndarray, list[np.ndarray]], Iterator[pa.RecordBatch]]) -> DataFrame:
    """Calls ``run(rows, lengths, starts, sequences)`` on batches of whole sequences, sorted by position.

    A batch holds some 2,000,000 numbers at most, or one sequence; what is open at the end of a batch goes to the next.
    """
    keys = [F.col(c) for c in by]

    def stream(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        cells = 0

        def cut(last: bool) -> Iterator[pa.RecordBatch]:
            nonlocal held, cells
            t = pa.Table.from_batches(held)
            if not t.num_rows:
                return
            change = np.zeros(t.num_rows, bool)
            change[0] = True
            for c in by:
                own = t.column(c).combine_chunks()
                a, b = own[:-1], own[1:]
                same = pc.or_(pc.fill_null(pc.equal(a, b), False), pc.and_(pc.is_null(a), pc.is_null(b)))
                change[1:] |= ~np.asarray(same)
            starts = np.flatnonzero(change)
            end = t.num_rows if last else int(starts[-1])
            held, cells = ([] if last else t.slice(end).to_batches()), 0
            if not last:
                starts = starts[:-1]
            if not len(starts):
                return
            t = t.slice(0, end)
            lengths = np.diff(np.append(starts, end))
            flat = t.column(column).combine_chunks()
            x = np.asarray(flat.flatten(), float).reshape(t.num_rows, -1)
            yield from run(t, lengths, starts, x)

        for b in batches:
            held.append(b)
            cells += len(b.column(column).flatten())
            if cells > BATCH_CELLS:
                yield from cut(False)
        if held:
            yield from cut(True)

    src = values.select(*by, "i", column)
    src = (src.repartition(*keys) if by else src.coalesce(1)).sortWithinPartitions(*by, "i")
    return src.mapInArrow(stream, schema)


def _padded(x: np.ndarray, lengths: np.ndarray, starts: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(numbers of the sequences, padded sequences): those of like length together, so that padding at most doubles them."""
    order = np.argsort(lengths, kind="stable")
    at = 0
    while at < len(order):
        end = int(np.searchsorted(lengths[order], 2 * lengths[order[at]], side="right"))
        some = order[at:end]
        pos = starts[some][:, None] + np.minimum(np.arange(lengths[some].max())[None], lengths[some][:, None] - 1)
        yield some, x[pos]
        at = end


CHAIN_FIELDS = "initial array<double>, transition array<array<double>>, means array<array<double>>, variances array<array<double>>, iterations long, log_likelihood double, converged boolean"


def gaussian_hmm_em(values: DataFrame, by: list[str], initial, transition, means, variances, max_iterations: int = 100, tolerance: float = 1e-5) -> DataFrame:
    """One fitted model a sequence: by..., model struct."""
    keys = [values.schema[c] for c in by]

    def run(t: pa.Table, lengths: np.ndarray, starts: np.ndarray, x: np.ndarray) -> Iterator[pa.RecordBatch]:
        for some, part in _padded(x, lengths, starts):
            fits = fit_chains(part, lengths[some], initial, transition, means, variances, max_iterations, tolerance)
            rows = {k: pa.array([getattr(c, k).tolist() if k in ("initial", "transition", "means", "variances") else getattr(c, k) for c in fits]) for k in names}
            yield pa.RecordBatch.from_pydict({f.name: t.column(f.name).take(pa.array(starts[some])).combine_chunks() for f in keys} | rows)

    names = [c.split()[0] for c in CHAIN_FIELDS.split(", ")]
    schema = ", ".join([*(f"{f.name} {f.dataType.simpleString()}" for f in keys), CHAIN_FIELDS])
    flat = _sequences(values, by, "x", schema, run)
    return flat.select(*by, F.struct(*names).alias("model"))


def gaussian_hmm_em_shared(values: DataFrame, by: list[str], initial, transition, means, variances, max_iterations: int = 100, tolerance: float = 1e-5) -> DataFrame:
    """One model of all sequences, a row with a model struct: each round sums their expectations, k x (k + 2d + 2) numbers."""
    pi, a, m, s = (np.array(v, float) for v in (initial, transition, means, variances))
    k, d = m.shape
    prior, ll, done, rounds = -np.inf, -np.inf, False, 0
    parts = [("pi", k), ("xi", k * k), ("n", k), ("x", k * d), ("xx", k * d), ("ll", 1)]
    total_size = sum(n for _, n in parts)
    for rounds in range(1, max_iterations + 1):

        def run(t: pa.Table, lengths: np.ndarray, starts: np.ndarray, x: np.ndarray, now=(pi, a, m, s)) -> Iterator[pa.RecordBatch]:
            out = np.zeros(total_size)
            for some, part in _padded(x, lengths, starts):
                got = _expected(part, lengths[some], *(np.repeat(v[None], len(some), 0) for v in now))
                g, own = got["xx"]
                # about the old means, which keeps the second moments well conditioned
                about = np.stack([np.einsum("stk,stk->k", g, (own[:, :, None, j] - now[2][None, None, :, j]) ** 2) for j in range(d)], 1)
                out += np.concatenate([got["pi"].sum(0), got["xi"].sum(0).reshape(-1), got["n"].sum(0), got["x"].sum(0).reshape(-1), about.reshape(-1), [got["ll"].sum()]])
            yield pa.RecordBatch.from_arrays([pa.array(range(total_size), pa.int32()), pa.array(out)], ["at", "v"])

        sums = np.zeros(total_size)
        for r in _sequences(values, by, "x", "at int, v double", run).groupBy("at").agg(F.sum("v").alias("v")).collect():
            sums[r["at"]] = r["v"]
        t, at = {}, 0
        for name, size in parts:
            t[name], at = sums[at : at + size], at + size
        t |= {"pi": t["pi"][None], "xi": t["xi"].reshape(1, k, k), "n": t["n"][None], "x": t["x"].reshape(1, k, d)}
        new_pi, new_a, new, size = (v[0] for v in _updated(t, m[None]))
        step, raw = new - m, t["n"][0][:, None]
        shift = t["x"][0] - m * raw
        s = np.maximum((t["xx"].reshape(k, d) - 2 * step * shift + step * step * raw) / size, VARIANCE_FLOOR)
        pi, a, m, ll = new_pi, new_a, new, float(t["ll"][0])
        done = abs(ll - prior) < tolerance
        if done:
            break
        prior = ll
    row = (pi.tolist(), a.tolist(), m.tolist(), s.tolist(), rounds, ll, bool(done))
    flat = values.sparkSession.createDataFrame([row], CHAIN_FIELDS)
    return flat.select(F.struct("*").alias("model"))


def _field(name: str):  # noqa: ANN202
    def project(models: DataFrame | Column):  # noqa: ANN202
        """The field of a column of models, or of a frame (keys..., model) of them."""
        if isinstance(models, Column):
            return models[name]
        return models.select(*[c for c in models.columns if c != "model"], F.col(f"model.{name}").alias(name))

    return project


hmm_initial, hmm_transition, hmm_means, hmm_variances = map(_field, ("initial", "transition", "means", "variances"))
em_iterations, em_log_likelihood, em_converged = map(_field, ("iterations", "log_likelihood", "converged"))
mixture_weights, mixture_means, mixture_variances = map(_field, ("weights", "means", "variances"))


def mixture_frame(values: DataFrame, model: Mixture) -> DataFrame:
    """A fitted mixture as a one-row frame with a model struct."""
    spark = values.sparkSession
    row = (model.weights.tolist(), model.means.tolist(), model.variances.tolist(), model.iterations, model.log_likelihood, model.converged)
    flat = spark.createDataFrame([row], "weights array<double>, means array<array<double>>, variances array<array<double>>, iterations long, log_likelihood double, converged boolean")
    return flat.select(F.struct("*").alias("model"))


def filters_of(e: np.ndarray, initial, transition, predict_first: int = 0) -> np.ndarray:
    """Causal state probabilities of padded sequences (sequence, position, state)."""
    pi, a = np.array(initial, float), np.array(transition, float)
    out, p = np.empty_like(e), np.repeat((pi if not predict_first else pi @ a)[None], len(e), 0)
    b = np.exp(e - e.max(2, keepdims=True))
    for i in range(e.shape[1]):
        p = (p @ a if i else p) * b[:, i]
        p = p / np.maximum(p.sum(1), NORM_FLOOR)[:, None]
        out[:, i] = p
    return out


def smooths_of(e: np.ndarray, lengths: np.ndarray, initial, transition) -> np.ndarray:
    """State probabilities given the whole of each padded sequence."""
    f, b, _, _ = _passes(e, lengths, np.repeat(np.array(initial, float)[None], len(e), 0), np.repeat(np.array(transition, float)[None], len(e), 0))
    g = f * b
    return g / np.maximum(g.sum(2, keepdims=True), NORM_FLOOR)


def filter_of(e: np.ndarray, initial, transition, predict_first: int = 0) -> np.ndarray:
    return filters_of(np.asarray(e, float)[None], initial, transition, predict_first)[0]


def smooth_of(e: np.ndarray, initial, transition) -> np.ndarray:
    return smooths_of(np.asarray(e, float)[None], np.array([len(e)]), initial, transition)[0]


def _posterior(log_emissions: DataFrame, by: list[str], f: Callable[[np.ndarray, np.ndarray], np.ndarray]) -> DataFrame:
    schema = log_emissions.select(*by, "i").schema.add("p", ArrayType(DoubleType()))

    def run(t: pa.Table, lengths: np.ndarray, starts: np.ndarray, e: np.ndarray) -> Iterator[pa.RecordBatch]:
        p = np.empty_like(e)
        for some, part in _padded(e, lengths, starts):
            got = f(part, lengths[some])
            there = np.arange(part.shape[1])[None] < lengths[some][:, None]
            p[(starts[some][:, None] + np.arange(part.shape[1])[None])[there]] = got[there]
        arrays = pa.ListArray.from_arrays(pa.array(np.arange(0, p.size + 1, p.shape[1]), pa.int32()), pa.array(p.reshape(-1)))
        yield from pa.table({c: t.column(c) for c in [*by, "i"]} | {"p": arrays}).combine_chunks().to_batches()

    return _sequences(log_emissions, by, "e", schema, run)


def hmm_filter(log_emissions: DataFrame, by: list[str], initial, transition, predict_first: int = 0) -> DataFrame:
    """(by..., i, e array) -> (by..., i, p array): causal state probabilities."""
    return _posterior(log_emissions, by, lambda e, n: filters_of(e, initial, transition, predict_first))


def hmm_smooth(log_emissions: DataFrame, by: list[str], initial, transition) -> DataFrame:
    """(by..., i, e array) -> (by..., i, p array): state probabilities given the whole sequence."""
    return _posterior(log_emissions, by, lambda e, n: smooths_of(e, n, initial, transition))


def sample_unique_indices(n: int, count: int, seed: int = 0) -> list[int]:
    """Distinct rows of 0..n-1 from a multiplicative generator (48271 mod 2^31 - 1), advancing past rows taken before."""
    if count > n:
        raise ValueError("INSUFFICIENT_SAMPLE")
    state, out, taken = seed % 2147483646 + 1, [], set()
    for _ in range(count):
        state = state * 48271 % 2147483647
        row = state % n
        while row in taken:
            row = (row + 1) % n
        taken.add(row)
        out.append(row)
    return out
