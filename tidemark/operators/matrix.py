"""Linear algebra on long matrices (i, j, v) and vectors (i, v).

Products, traces and contractions are joins and partial aggregations; covariances sum a partial d x d matrix a task.
Factorisations need a whole matrix at a time: those of many keys of ``by`` run side by side, as stacks of matrices of one
shape, and ``Dense`` runs several factorisations in one pass.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.operators.axes import V, _raise_if
from tidemark.operators.groups import in_groups

PIVOT = 1e-14


def _side(a: DataFrame, **names: str) -> DataFrame:
    return a.select(*[F.col(c).alias(names.get(c, c)) for c in a.columns])


def dot(lhs: DataFrame, rhs: DataFrame) -> DataFrame:
    both = lhs.join(_side(rhs, v="w"), "i")
    return both.agg(F.coalesce(F.sum(F.col(V) * F.col("w")), F.lit(0.0)).alias(V))


def outer(lhs: DataFrame, rhs: DataFrame) -> DataFrame:
    """Every product of two vectors; the result itself has a row for each."""
    return lhs.crossJoin(_side(rhs, i="j", v="w")).select("i", "j", (F.col(V) * F.col("w")).alias(V))


def matmul(lhs: DataFrame, rhs: DataFrame) -> DataFrame:
    both = _side(lhs, j="k").join(_side(rhs, i="k", v="w"), "k")
    return both.groupBy("i", "j").agg(F.sum(F.col(V) * F.col("w")).alias(V))


def matvec(matrix: DataFrame, vector: DataFrame) -> DataFrame:
    both = matrix.join(_side(vector, i="j", v="w"), "j")
    return both.groupBy("i").agg(F.sum(F.col(V) * F.col("w")).alias(V))


def portfolio_returns(asset_returns: DataFrame, asset_weights: DataFrame) -> DataFrame:
    return matvec(asset_returns, asset_weights)


def quadratic_form(vector: DataFrame, matrix: DataFrame) -> DataFrame:
    half = matrix.join(_side(vector, i="j", v="y"), "j").join(_side(vector, v="x"), "i")
    return half.agg(F.sum(F.col("x") * F.col(V) * F.col("y")).alias(V))


def diag(values: DataFrame) -> DataFrame:
    """Of a matrix its diagonal (i, v); of a vector the diagonal matrix."""
    if "j" in values.columns:
        return values.where("i = j").select("i", V)
    cells = values.select("i").crossJoin(values.select(F.col("i").alias("j"), F.col(V).alias("w")))
    return cells.select("i", "j", F.when(F.col("i") == F.col("j"), F.col("w")).otherwise(0.0).alias(V))


def trace(values: DataFrame) -> DataFrame:
    return values.agg(F.coalesce(F.sum(F.when(F.col("i") == F.col("j"), F.col(V))), F.lit(0.0)).alias(V))


BLOCK = 1 << 20  # cells that a task holds at a time


def _moments(values: DataFrame) -> DataFrame:
    """a <= b, n, ma, mb, cab, ca, cb: for each pair of columns the rows that have both, their means and centred products."""
    names = ["a", "b", "n", "ma", "mb", "cab", "ca", "cb"]

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        rows = 0

        def block(t: pa.Table) -> pa.RecordBatch:
            i, j, v = (t.column(c).to_numpy() for c in ("i", "j", V))
            (_, at), (own, to) = np.unique(i, return_inverse=True), np.unique(j, return_inverse=True)
            there, x = np.zeros((at.max() + 1, len(own))), np.zeros((at.max() + 1, len(own)))
            there[at, to], x[at, to] = 1.0, v
            bad = np.isnan(x).astype(float)
            x = np.where(np.isnan(x), 0.0, x)
            shift = x.sum(0) / np.maximum(there.sum(0), 1.0)
            x = (x - shift) * there
            n = there.T @ there
            with np.errstate(divide="ignore", invalid="ignore"):
                ma = (x.T @ there) / n
                mb = ma.T
                spoilt = (bad.T @ there + there.T @ bad) > 0
                cab = np.where(spoilt, np.nan, x.T @ x - n * ma * mb)
                ca = np.where(spoilt, np.nan, (x * x).T @ there - n * ma * ma)
            p, q = np.nonzero(np.triu(n > 0))
            whole = (own[p], own[q], n[p, q], ma[p, q] + shift[p], mb[p, q] + shift[q], cab[p, q], ca[p, q], ca.T[p, q])
            return pa.RecordBatch.from_arrays([pa.array(c) for c in whole], names)

        for b in batches:
            held.append(b)
            rows += b.num_rows
            if rows > BLOCK:
                t = pa.Table.from_batches(held)
                i = t.column("i").to_numpy()
                end = int(np.searchsorted(i, i[-1]))  # the last row may go on
                if end:
                    yield block(t.slice(0, end))
                    held, rows = t.slice(end).to_batches(), t.num_rows - end
        if rows:
            yield block(pa.Table.from_batches(held))

    src = values.select(F.col("i").cast("long").alias("i"), F.col("j").cast("long").alias("j"), F.col(V).cast("double").alias(V)).repartition("i").sortWithinPartitions("i")
    parts = src.mapInArrow(partial, "a long, b long, n double, ma double, mb double, cab double, ca double, cb double")
    w = Window.partitionBy("a", "b")
    for c in ("ma", "mb"):
        parts = parts.withColumn("d" + c, F.col(c) - F.sum(F.col("n") * F.col(c)).over(w) / F.sum("n").over(w))
    joined = lambda c, x, y: F.sum(F.col(c) + F.col("n") * F.col(x) * F.col(y)).alias(c)
    return parts.groupBy("a", "b").agg(F.sum("n").alias("n"), joined("cab", "dma", "dmb"), joined("ca", "dma", "dma"), joined("cb", "dmb", "dmb"))


def _mirrored(values: DataFrame, v: Column) -> DataFrame:
    both = F.when(F.col("a") == F.col("b"), F.array(F.struct("a", "b"))).otherwise(F.array(F.struct("a", "b"), F.struct(F.col("b").alias("a"), F.col("a").alias("b"))))
    return _moments(values).select(F.explode(both).alias("p"), v.alias(V)).select(F.col("p.a").alias("i"), F.col("p.b").alias("j"), V)


def covariance(values: DataFrame) -> DataFrame:
    """Sample covariances of the columns of a time x asset matrix, a pair over the rows that have both."""
    return _mirrored(values, _raise_if(F.col("n") < 2, "INSUFFICIENT_SAMPLE", F.col("cab") / F.when(F.col("n") > 1, F.col("n") - 1)))


def correlation(values: DataFrame) -> DataFrame:
    sd = F.sqrt(F.col("ca")) * F.sqrt(F.col("cb"))
    return _mirrored(values, _raise_if((F.col("n") < 2) | (sd <= 0), "NON_FINITE_RESULT", F.col("cab") / F.when(sd > 0, sd)))


def affine_contract(values: DataFrame, coefficients: DataFrame, initial: DataFrame) -> DataFrame:
    """initial[a] + sum over f of values[i, f] * coefficients[f, a]: i, j, v."""
    own = matmul(values, coefficients)
    return own.join(_side(initial, i="j", v="w"), "j").select("i", "j", (F.col("w") + F.col(V)).alias(V))


# -- dense kernels -------------------------------------------------------------


def lu_solve(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Gaussian elimination with partial pivoting; a pivot of at most 1e-14 is singular.  As the other kernels, of one matrix or a stack of them."""
    m, n = np.concatenate([a, b], -1).astype(float), a.shape[-1]
    for k in range(n):
        p = k + np.abs(m[..., k:, k]).argmax(-1)
        rows = np.broadcast_to(np.arange(n), m.shape[:-1]).copy()
        np.put_along_axis(rows, p[..., None], k, -1)
        rows[..., k] = p
        m = np.take_along_axis(m, rows[..., None], -2)
        if (np.abs(m[..., k, k]) <= PIVOT).any():
            raise ValueError("SINGULAR_MATRIX")
        m[..., k + 1 :, k:] -= (m[..., k + 1 :, k] / m[..., k, k, None])[..., None] * m[..., k, None, k:]
    return back_substitute(m[..., :n], m[..., n:], lower=False)


def back_substitute(a: np.ndarray, b: np.ndarray, lower: bool = True, unit: bool = False) -> np.ndarray:
    n, x = a.shape[-1], np.array(b, float)
    for k in range(n) if lower else range(n - 1, -1, -1):
        seen = slice(0, k) if lower else slice(k + 1, n)
        x[..., k, :] -= (a[..., k, None, seen] @ x[..., seen, :])[..., 0, :]
        if not unit:
            if (np.abs(a[..., k, k]) <= PIVOT).any():
                raise ValueError("SINGULAR_MATRIX")
            x[..., k, :] /= a[..., k, k, None]
    return x


def cholesky_of(a: np.ndarray) -> np.ndarray:
    if not np.isfinite(a).all() or not (a == a.swapaxes(-1, -2)).all():
        raise ValueError("DOMAIN_ERROR")
    try:
        return np.linalg.cholesky(a)
    except np.linalg.LinAlgError as e:
        raise ValueError("NOT_POSITIVE_DEFINITE") from e


def jacobi(a: np.ndarray, tolerance: float, max_sweeps: int) -> tuple[np.ndarray, np.ndarray]:
    """Cyclic rotations until no element off the diagonal is over ``tolerance`` times the largest of the matrix."""
    n = a.shape[-1]
    m = a.astype(float).reshape(-1, n, n)
    v, scale = np.broadcast_to(np.eye(n), m.shape).copy(), np.abs(m).max((1, 2), initial=0.0)
    for sweep in range(max_sweeps + 1):
        open_ = np.flatnonzero(np.abs(m * (1.0 - np.eye(n))).max((1, 2), initial=0.0) > tolerance * scale)
        if not len(open_):
            return np.einsum("gii->gi", m).copy().reshape(a.shape[:-1]), v.reshape(a.shape)
        if sweep == max_sweeps:
            break
        w, u = m[open_], v[open_]
        for p in range(n - 1):
            for q in range(p + 1, n):
                angle = np.where(w[:, p, q] == 0, 0.0, 0.5 * np.arctan2(2 * w[:, p, q], w[:, q, q] - w[:, p, p]))
                c, s = np.cos(angle), np.sin(angle)
                turn = np.stack([c, s, -s, c], -1).reshape(-1, 2, 2)
                w[:, :, [p, q]] = w[:, :, [p, q]] @ turn
                w[:, [p, q]] = turn.swapaxes(1, 2) @ w[:, [p, q]]
                u[:, :, [p, q]] = u[:, :, [p, q]] @ turn
        m[open_], v[open_] = w, u
    raise ValueError("NON_CONVERGENCE")


def eigh_of(a: np.ndarray, tolerance: float | None = None, max_sweeps: int | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Ascending eigenvalues; each vector's first component of largest size is positive.  With limits, by rotations that keep to them."""
    if not np.isfinite(a).all() or not (a == a.swapaxes(-1, -2)).all():
        raise ValueError("DOMAIN_ERROR")
    if tolerance is None and max_sweeps is None:
        w, v = np.linalg.eigh(a)
    else:
        w, v = jacobi(a, 1e-12 if tolerance is None else tolerance, 32 if max_sweeps is None else max_sweeps)
        order = np.argsort(w, -1, kind="stable")
        w, v = np.take_along_axis(w, order, -1), np.take_along_axis(v, order[..., None, :], -1)
    if not w.size:
        return w, v
    at = np.abs(np.round(v, 12)).argmax(-2)
    return w, v * np.where(np.take_along_axis(v, at[..., None, :], -2) < 0, -1.0, 1.0)


def _stacks(t: pa.Table, group: np.ndarray, groups: int, names: list[str]) -> Iterator[tuple[np.ndarray, dict[str, np.ndarray]]]:
    """(groups, the stack of their matrices for each name): those of equal shapes together, of some BLOCK cells or one group at a time."""
    cells, shapes = {}, np.zeros((groups, 2 * len(names)), np.int64)
    for k, name in enumerate(names):
        own = pc.equal(t.column("part"), name)
        part, g = t.filter(own), group[own.to_numpy().astype(bool)]
        i, j, v = (part.column(c).to_numpy() for c in ("i", "j", V))
        np.maximum.at(shapes, (g, 2 * k), i + 1)
        np.maximum.at(shapes, (g, 2 * k + 1), j + 1)
        cells[name] = g, i, j, v
    kinds, kind = np.unique(shapes, axis=0, return_inverse=True)
    for x, shape in enumerate(kinds):
        alike = np.flatnonzero(kind.reshape(-1) == x)
        step = max(1, BLOCK // max(1, int((shape[::2] * shape[1::2]).sum())))
        for a in range(0, len(alike), step):
            some = alike[a : a + step]
            place = np.full(groups, -1)
            place[some] = np.arange(len(some))
            env = {}
            for k, name in enumerate(names):
                g, i, j, v = cells[name]
                at = place[g]
                on = at >= 0
                env[name] = np.zeros((len(some), int(shape[2 * k]), int(shape[2 * k + 1])))
                env[name][at[on], i[on], j[on]] = v[on]
            yield some, env


class Dense:
    """Dense operators on the matrices of each key of ``by``, all in one pass over the groups.

    ``parts`` are long matrices or vectors by name; operators name their inputs and their result, and may use earlier results.
    """

    def __init__(self, by: list[str] | None = None, **parts: DataFrame) -> None:
        self.by, self.parts, self.steps = by or [], parts, []

    def _step(self, out: str, run: Callable, *args: str) -> Dense:
        self.steps.append((out if isinstance(out, tuple) else (out,), run, args))
        return self

    def solve(self, out: str, matrix: str, rhs: str) -> Dense:
        return self._step(out, lu_solve, matrix, rhs)

    def triangular_solve(self, out: str, matrix: str, rhs: str, lower: int = 1, unit_diagonal: int = 0) -> Dense:
        return self._step(out, lambda a, b: back_substitute(a, b, bool(lower), bool(unit_diagonal)), matrix, rhs)

    def cholesky(self, out: str, matrix: str) -> Dense:
        return self._step(out, cholesky_of, matrix)

    def symmetric_eigh(self, values: str, vectors: str, matrix: str, tolerance: float | None = None, max_sweeps: int | None = None) -> Dense:
        if (tolerance is not None and not tolerance > 0) or (max_sweeps is not None and (max_sweeps < 1 or max_sweeps != int(max_sweeps))):
            raise ValueError("INVALID_PARAMETER")
        return self._step((values, vectors), lambda a: eigh_of(a, tolerance, max_sweeps), matrix)

    def run(self) -> DataFrame:
        """by..., part (the result's name), i, j, v."""
        whole = None
        for n, df in self.parts.items():
            one = df.select(*self.by, F.lit(n).alias("part"), "i", (F.col("j") if "j" in df.columns else F.lit(0)).cast("long").alias("j"), V)
            whole = one if whole is None else whole.unionByName(one)
        return self.over(whole)

    def over(self, whole: DataFrame) -> DataFrame:
        """The same on one frame by..., part, i, j, v that holds all parts."""
        by, steps = self.by, list(self.steps)
        key_types = [whole.schema[c] for c in by]
        given, known = [], set()  # the parts that steps read; other names are earlier results
        for out, _, args in steps:
            given += [a for a in args if a not in known and a not in given]
            known |= set(out)

        def many(t: pa.Table, starts: np.ndarray) -> Iterator[pa.Table]:
            if not steps:
                return
            group = np.repeat(np.arange(len(starts)), np.diff(np.append(starts, t.num_rows)))
            for some, env in _stacks(t, group, len(starts), given):
                results: dict[str, np.ndarray] = {}
                for out, run, args in steps:
                    got = run(*[env[a] for a in args])
                    for name, m in zip(out, got if isinstance(got, tuple) else (got,), strict=True):
                        env[name] = results[name] = m.reshape(*m.shape[:2], -1 if m.size else 1)
                for name, m in results.items():
                    g, i, j = np.indices(m.shape).reshape(3, -1)
                    keys = {c: t.column(c).take(pa.array(starts[some[g]])) for c in by}
                    yield pa.table(keys | {"part": pa.array([name] * m.size, pa.string()), "i": i.astype(np.int64), "j": j.astype(np.int64), V: m.reshape(-1).astype(float)})

        schema = ", ".join([f"{f.name} {f.dataType.simpleString()}" for f in key_types] + ["part string", "i long", "j long", "v double"])
        return in_groups(whole if by else whole.withColumn("_one", F.lit(1)), by or ["_one"], ["part"], many, schema)


def _part(df: DataFrame, name: str, by: list[str], vector: bool = False) -> DataFrame:
    own = df.where(F.col("part") == name)
    return own.select(*by, "i", V) if vector else own.select(*by, "i", "j", V)


def solve(matrix: DataFrame, rhs: DataFrame, by: list[str] | None = None) -> DataFrame:
    return _part(Dense(by, a=matrix, b=rhs).solve("x", "a", "b").run(), "x", by or [], True)


def solve_multi(matrix: DataFrame, rhs: DataFrame, by: list[str] | None = None) -> DataFrame:
    return _part(Dense(by, a=matrix, b=rhs).solve("x", "a", "b").run(), "x", by or [])


def triangular_solve(matrix: DataFrame, rhs: DataFrame, lower: int = 1, unit_diagonal: int = 0, by: list[str] | None = None) -> DataFrame:
    return _part(Dense(by, a=matrix, b=rhs).triangular_solve("x", "a", "b", lower, unit_diagonal).run(), "x", by or [])


def cholesky(matrix: DataFrame, by: list[str] | None = None) -> DataFrame:
    return _part(Dense(by, a=matrix).cholesky("l", "a").run(), "l", by or [])


def symmetric_eigh(matrix: DataFrame, by: list[str] | None = None, tolerance: float | None = None, max_sweeps: int | None = None) -> DataFrame:
    """The decomposition, long: part is ``values`` or ``vectors``.  Limits choose cyclic rotations, which fail with NON_CONVERGENCE beyond them."""
    return Dense(by, a=matrix).symmetric_eigh("values", "vectors", "a", tolerance, max_sweeps).run()


def eigenvalues(decomposition: DataFrame, by: list[str] | None = None) -> DataFrame:
    return _part(decomposition, "values", by or [], True)


def eigenvectors(decomposition: DataFrame, by: list[str] | None = None) -> DataFrame:
    return _part(decomposition, "vectors", by or [])
