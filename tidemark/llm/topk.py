"""Exact top-k inner products through a pivot-distance index.

Vectors are lifted by one component, sqrt(M^2 - |v|^2) with M the largest norm and 0 for queries, so that
|q' - v'|^2 = |q|^2 + M^2 - 2 q.v and the largest inner products are the nearest neighbours.  Pivots come
from a bounded sample of ``sample_rows`` rows; every row is indexed under its nearest pivot, in
annuli of the distance to it (cells).  A query sorts the annuli [a, b] of all pivots by the least distance
that the triangle inequality allows there, |D - r| over r in [a, b], and searches them in this order in waves
(``WAVES`` annuli each, the last all that are left).  After each wave its k-th distance is smaller or the same, and it stops at
the first annulus beyond it; a query that has stopped sends nothing to later waves.
Bounds carry a margin for rounding, and scores are exact integers.

Cells are cut into blocks of at most about ``block_rows`` rows by a salt, and the queries that visit a cell into blocks
as well, so that no task gets a whole hot cell or all queries.  A pair of blocks yields at most k rows a query.

Defined cases: rows with a null id, a null vector, null or non-finite components, or another
length than most vectors take no part; equal rows are separate candidates, a query row never finds itself; ties go
to the smaller id; scores beyond a long are held at its ends; fewer than k candidates give all;
an empty table or query set gives no rows; other columns are ignored, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.common import materialize

RESULT = "quid long, query_id long, vec_id long, score long"
#: places in a query's sorted annuli at which waves end
WAVES = (1, 4, 16, 1 << 30)


def _matrix(column: pa.Array | pa.ChunkedArray, dim: int) -> np.ndarray:
    data = b"".join(x for x in column.to_pylist())
    return np.frombuffer(data, np.float64).reshape(-1, dim)


def dots(q: np.ndarray, v: np.ndarray) -> np.ndarray:
    """Exact integer inner products of integral rows."""
    big = (np.abs(q).max(initial=0.0)) * (np.abs(v).max(initial=0.0)) * max(1, q.shape[1])
    if big < 2**53:
        return (q @ v.T).astype(np.int64)
    whole = np.vectorize(int, otypes=[object])
    return np.clip(whole(q) @ whole(v).T, -(2**63), 2**63 - 1).astype(np.int64)


def _best(scores: np.ndarray, ids: np.ndarray, own: np.ndarray, k: int) -> np.ndarray:
    """Columns of the k best (score descending, id ascending) that aren't the query itself."""
    ok = np.flatnonzero(~own)
    if len(ok) > 4 * k:
        cut = np.partition(scores[ok], len(ok) - k)[len(ok) - k]
        ok = ok[scores[ok] >= cut]
    return ok[np.lexsort((ids[ok], -scores[ok]))][:k]


class Pivots:
    """Pivots, their annuli, and the distance of the k-th best score."""

    def __init__(self, sample: np.ndarray, top: float, n: int, rings: int) -> None:
        self.top2 = top
        lifted = self.lift(sample)
        picked = [0]
        gap = self._distance(lifted, lifted[:1])[:, 0]
        while len(picked) < min(n, len(lifted)) and gap.max() > 0:
            picked.append(int(gap.argmax()))
            gap = np.minimum(gap, self._distance(lifted, lifted[picked[-1:]])[:, 0])
        self.points = lifted[picked]
        near, dist = self.nearest(lifted)
        self.rings = rings
        self.edges = np.zeros((len(self.points), rings - 1))
        for p in range(len(self.points)):
            own = dist[near == p]
            self.edges[p] = np.quantile(own if len(own) else [0.0], np.arange(1, rings) / rings)

    def lift(self, v: np.ndarray) -> np.ndarray:
        return np.hstack([v, np.sqrt(np.maximum(0.0, self.top2 - (v * v).sum(1)))[:, None]])

    @staticmethod
    def _distance(a: np.ndarray, b: np.ndarray) -> np.ndarray:
        return np.sqrt(np.maximum(0.0, (a * a).sum(1)[:, None] + (b * b).sum(1)[None] - 2 * a @ b.T))

    def nearest(self, lifted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        d = self._distance(lifted, self.points)
        near = d.argmin(1)
        return near, d[np.arange(len(d)), near]

    def cells(self, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        near, dist = self.nearest(self.lift(v))
        ring = (dist[:, None] > self.edges[near]).sum(1)
        return near * self.rings + ring, dist

    def queries(self, q: np.ndarray) -> np.ndarray:
        return self._distance(np.hstack([q, np.zeros((len(q), 1))]), self.points)

    def reach(self, q: np.ndarray, score: np.ndarray) -> np.ndarray:
        """Distance of a vector with that score."""
        return np.sqrt(np.maximum(0.0, (q * q).sum(1) + self.top2 - 2.0 * score))


def search(
    vectors: DataFrame,
    is_query: Column,
    *,
    vec_id: str = "vec_id",
    vector: str = "embedding",
    k: int = 5,
    scale: float = 256.0,
    pivots: int = 32,
    rings: int = 4,
    sample_rows: int = 4096,
    block_rows: int = 8192,
) -> DataFrame:
    """query_id, rank (from 1), vec_id, score: the k best for every query row.  ``is_query`` is over the column vec_id."""
    spark = vectors.sparkSession
    result = "query_id long, rank int, vec_id long, score long"
    src = vectors.select(F.col(vec_id).cast("long").alias("vec_id"), F.col(vector).cast("array<double>").alias("v"))
    src = src.where("vec_id IS NOT NULL AND v IS NOT NULL AND size(v) > 0")

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids, out = [], []
            for i, v in zip(b.column("vec_id").to_pylist(), b.column("v"), strict=True):
                flat = v.values
                if flat.null_count:
                    continue
                x = np.asarray(flat)
                with np.errstate(over="ignore"):
                    x = np.floor(scale * x)
                if np.isfinite(x).all():
                    ids.append(i)
                    out.append(x.tobytes())
            n2 = [float((np.frombuffer(x) ** 2).sum()) for x in out]
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(out, pa.binary()), pa.array(n2, pa.float64())], ["vec_id", "v", "n2"])

    packed = src.mapInArrow(pack, "vec_id long, v binary, n2 double").withColumn("uid", F.monotonically_increasing_id())
    packed, _ = materialize(packed, "vectors")
    sizes = packed.groupBy(F.octet_length("v").alias("bytes")).agg(F.count("*").alias("n"), F.max("n2").alias("top")).orderBy(F.desc("n"), F.desc("bytes")).first()
    if sizes is None:
        return spark.createDataFrame([], result)
    dim, size = sizes["bytes"] // 8, sizes["bytes"]
    packed = packed.where(F.octet_length("v") == size)
    sample = _matrix(pa.array([bytes(r.v) for r in packed.select("v").limit(sample_rows).collect()], pa.binary()), dim)
    shared = spark.sparkContext.broadcast((Pivots(sample, sizes["top"], pivots, rings), sample))

    def index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                cell, dist = shared.value[0].cells(_matrix(b.column("v"), dim))
                yield pa.RecordBatch.from_arrays([b.column("uid"), b.column("vec_id"), b.column("v"), pa.array(cell.astype(np.int32)), pa.array(dist)], ["uid", "vec_id", "v", "cell", "r"])

    indexed = packed.select("uid", "vec_id", "v").mapInArrow(index, "uid long, vec_id long, v binary, cell int, r double")
    indexed, _ = materialize(indexed, "index")
    stats = {r.cell: (r.lo, r.hi, r.n) for r in indexed.groupBy("cell").agg(F.min("r").alias("lo"), F.max("r").alias("hi"), F.count("*").alias("n")).collect()}
    cells = np.array(sorted(stats), np.int32)
    lo, hi = (np.array([stats[c][i] for c in cells.tolist()]) for i in (0, 1))

    def visit(begin: int, end: int):
        """The cells at these places of a query's order that it must search: (quid, query_id, q, cell)."""

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            p, _ = shared.value
            for b in batches:
                if not b.num_rows:
                    continue
                q = _matrix(b.column("v"), dim)
                d = p.queries(q)[:, cells // p.rings]
                below = np.maximum(0.0, np.maximum(lo[None] - d, d - hi[None]))
                order = np.argsort(below, axis=1, kind="stable")[:, begin:end]
                got = b.column("floor").to_numpy(zero_copy_only=False)  # the k-th score so far, null if there are fewer
                far = np.where(np.isnan(got), np.inf, p.reach(q, got))
                slack = 1e-9 * (np.abs(d).max(initial=1.0) + np.sqrt(p.top2)) + 1e-6 * np.sqrt(p.top2)
                row, place = np.nonzero(np.take_along_axis(below, order, 1) <= far[:, None] + slack)
                take = pa.array(row)
                yield pa.RecordBatch.from_arrays([b.column("uid").take(take), b.column("vec_id").take(take), b.column("v").take(take), pa.array(cells[order[row, place]])], ["quid", "query_id", "q", "cell"])

        return run

    def match(left: pa.Table, right: pa.Table) -> pa.Table:
        rows: list[tuple[int, int, int, int]] = []
        if left.num_rows and right.num_rows:
            v, ids, uids = _matrix(left.column("v"), dim), left.column("vec_id").to_numpy(), left.column("uid").to_numpy()
            quids, qids = right.column("quid").to_numpy(), right.column("query_id").to_numpy()
            for i in range(0, right.num_rows, 256):
                scores = dots(_matrix(right.column("q").slice(i, 256), dim), v)
                for j, s in enumerate(scores):
                    for c in _best(s, ids, uids == quids[i + j], k):
                        rows.append((quids[i + j], qids[i + j], ids[c], s[c]))
        kinds = [pa.int64()] * 4
        columns = zip(*rows, strict=True) if rows else [[]] * 4
        return pa.table([pa.array(list(map(int, c)), t) for c, t in zip(columns, kinds, strict=True)], ["quid", "query_id", "vec_id", "score"])

    def wave(routed: DataFrame, tag: str) -> DataFrame:
        routed, _ = materialize(routed, tag)
        loads = {r.cell: r.n for r in routed.groupBy("cell").agg(F.count("*").alias("n")).collect()}
        blocks = [(int(c), max(1, -(-stats[c][2] // block_rows)), max(1, -(-n // block_rows))) for c, n in loads.items()]
        if not blocks:
            return spark.createDataFrame([], RESULT)
        plan = F.broadcast(spark.createDataFrame(blocks, "cell int, vb int, qb int"))  # a row a cell, pivots x rings at most
        v = indexed.join(plan, "cell").select("uid", "vec_id", "v", "cell", F.pmod(F.xxhash64("uid"), F.col("vb")).cast("int").alias("vs"), F.explode(F.sequence(F.lit(0), F.col("qb") - 1)).alias("qs"))
        q = routed.join(plan, "cell").select("quid", "query_id", "q", "cell", F.explode(F.sequence(F.lit(0), F.col("vb") - 1)).alias("vs"), F.pmod(F.xxhash64("quid"), F.col("qb")).cast("int").alias("qs"))
        keys = ["cell", "vs", "qs"]
        return v.groupBy(*keys).cogroup(q.groupBy(*keys)).applyInArrow(match, RESULT)

    queries = indexed.where(is_query)
    best = Window.partitionBy("quid").orderBy(F.desc("score"), F.asc("vec_id"))
    found, begin = None, 0
    for number, end in enumerate(WAVES):
        if begin >= len(cells):
            break
        if found is None:
            asked = queries.select("uid", "vec_id", "v", F.lit(None).cast("double").alias("floor"))
        else:
            kth = found.where(F.col("n") == k).select(F.col("quid").alias("uid"), F.col("score").cast("double").alias("floor"))
            asked = queries.join(kth, "uid", "left").select("uid", "vec_id", "v", "floor")
        got = wave(asked.mapInArrow(visit(begin, end), "quid long, query_id long, q binary, cell int"), f"wave{number}")
        so_far = got if found is None else found.drop("n").union(got)
        found, _ = materialize(so_far.withColumn("n", F.row_number().over(best)).where(F.col("n") <= k), f"best{number}")
        begin = end
    return found.select("query_id", F.col("n").cast("int").alias("rank"), "vec_id", "score")
