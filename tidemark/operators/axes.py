"""Array-shape and per-axis operators on long arrays: one row a cell, index columns and a value column ``v``.

A matrix has the indices (i, j), a tensor (i, j, k); other index names work alike.  Everything here is joins, windows and
partial aggregations on the index columns, so no array is ever gathered.  Extra key columns in ``by``
give many arrays in one frame.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.reduce import REDUCTIONS
from tidemark.functions.scalar import finite, nan

V = "v"


def indices(a: DataFrame) -> list[str]:
    return [c for c in a.columns if c != V]


def _rest(a: DataFrame, axis: str) -> list[str]:
    return [c for c in indices(a) if c != axis]


def _raise_if(bad: Column, error: str, value: Column) -> Column:
    return F.when(bad, F.raise_error(F.lit(error))).otherwise(value)


def along(a: DataFrame, axis: str, name: str) -> DataFrame:
    """A reduction of the catalogue along an axis: sum, mean, product, variance, std, min_value, max_value, ..."""
    value, failed, error = REDUCTIONS[name](F.col(axis), lambda c: c, F.col(V))
    out = value if failed is None else _raise_if(failed, error, value)
    rest = _rest(a, axis)
    return (a.groupBy(*rest) if rest else a.groupBy()).agg(out.alias(V))


def _named(short: str, name: str, axis: str):  # noqa: ANN202
    def f(values: DataFrame) -> DataFrame:
        return along(values, axis, name)

    f.__name__, f.__doc__ = f"{short}_{'time' if axis == 'i' else 'asset'}", f"{name} of a time x asset matrix along {axis}."
    return f


sum_time, mean_time, product_time, variance_time, std_time, min_time, max_time = (
    _named(s, n, "i") for s, n in (("sum", "sum"), ("mean", "mean"), ("product", "product"), ("variance", "variance"), ("std", "std"), ("min", "min_value"), ("max", "max_value"))
)
sum_asset, mean_asset, product_asset, variance_asset, std_asset, min_asset, max_asset = (
    _named(s, n, "j") for s, n in (("sum", "sum"), ("mean", "mean"), ("product", "product"), ("variance", "variance"), ("std", "std"), ("min", "min_value"), ("max", "max_value"))
)


def sum_axis(values: DataFrame, axis: str, lines: DataFrame | None = None) -> DataFrame:
    """Sums along an axis.  ``lines`` (the other index columns) names all lines: those without a cell sum to 0."""
    out = along(values, axis, "sum")
    if lines is None:
        return out
    rest = _rest(values, axis)
    return lines.select(*rest).distinct().join(out, rest, "left").select(*rest, F.coalesce(V, F.lit(0.0)).alias(V))


def mean_axis(values: DataFrame, axis: str) -> DataFrame:
    return along(values, axis, "mean")


def _finite_only(a: DataFrame) -> DataFrame:
    return a.withColumn(V, _raise_if(~finite(F.col(V)), "NON_FINITE_INPUT", F.col(V)))


def variance_axis(values: DataFrame, axis: str, ddof: int = 0) -> DataFrame:
    n = F.count(V)
    value = F.var_pop(V) * n / F.when(n > ddof, n - ddof)
    return _finite_only(values).groupBy(*_rest(values, axis)).agg(_raise_if(n <= ddof, "INSUFFICIENT_SAMPLE", value).alias(V))


def max_axis(values: DataFrame, axis: str) -> DataFrame:
    return _finite_only(values).groupBy(*_rest(values, axis)).agg(F.max(V).alias(V))


def argmax_axis(values: DataFrame, axis: str) -> DataFrame:
    best = F.min(F.struct((-F.col(V)).alias("m"), F.col(axis).alias("p")))["p"]
    return _finite_only(values).groupBy(*_rest(values, axis)).agg(best.cast("long").alias(V))


def _line(a: DataFrame, axis: str):  # noqa: ANN202
    return Window.partitionBy(*_rest(a, axis))


def logsumexp_axis(values: DataFrame, axis: str) -> DataFrame:
    m = _finite_only(values).withColumn("m", F.max(V).over(_line(values, axis)))
    return m.groupBy(*_rest(values, axis)).agg((F.ln(F.sum(F.exp(F.col(V) - F.col("m")))) + F.first("m")).alias(V))


def softmax_axis(values: DataFrame, axis: str) -> DataFrame:
    w = _line(values, axis)
    m = _finite_only(values).withColumn(V, F.exp(F.col(V) - F.max(V).over(w)))
    return m.withColumn(V, F.col(V) / F.sum(V).over(w)).select(values.columns)


def cumulative_product_axis(values: DataFrame, axis: str, initial: float) -> DataFrame:
    w = _line(values, axis).orderBy(axis).rowsBetween(Window.unboundedPreceding, 0)
    return values.withColumn(V, F.lit(float(initial)) * F.product(V).over(w))


def cumulative_max_axis(values: DataFrame, axis: str, initial: float) -> DataFrame:
    if initial != initial:
        return values.withColumn(V, nan())
    w = _line(values, axis).orderBy(axis).rowsBetween(Window.unboundedPreceding, 0)
    best = F.max(F.when(~F.isnan(V), F.col(V))).over(w)
    return values.withColumn(V, F.greatest(F.lit(float(initial)), F.coalesce(best, F.lit(float(initial)))))


def quantiles_axis(values: DataFrame, probabilities: list[float], axis: str) -> DataFrame:
    """One row a line and probability, with the index ``q``."""
    p = F.array(*[F.lit(float(x)) for x in probabilities])
    rest = _rest(values, axis)
    lines = values.groupBy(*rest).agg(F.percentile(V, p).alias("all"))
    return lines.select(*rest, F.posexplode("all").alias("q", V)).withColumn("q", F.col("q").cast("long"))


def transpose(values: DataFrame) -> DataFrame:
    return swap_axes(values, "i", "j")


def swap_axes(values: DataFrame, axis1: str, axis2: str) -> DataFrame:
    swap = {axis1: axis2, axis2: axis1}
    return values.select(*[F.col(c).alias(swap.get(c, c)) for c in values.columns]).select(values.columns)


def take_axis(values: DataFrame, picks: DataFrame, axis: str) -> DataFrame:
    """Lines ``pick`` of an axis, numbered by ``pos`` of the picks (pos, pick); every pick must exist."""
    extent = values.agg(F.max(axis).alias("n"))
    ok = picks.crossJoin(F.broadcast(extent)).withColumn("pick", _raise_if((F.col("pick") < 0) | (F.col("pick") > F.col("n")), "INDEX_OUT_OF_RANGE", F.col("pick")))
    out = values.withColumnRenamed(axis, "pick").join(ok.select("pos", "pick"), "pick").withColumnRenamed("pos", axis)
    return out.select(values.columns)


def slice_axis(values: DataFrame, axis: str, start: int, stop: int, step: int = 1) -> DataFrame:
    if start < 0 or stop < start or step < 1:
        raise ValueError("0 <= start <= stop and step >= 1")
    at = F.col(axis) - start
    return values.where((F.col(axis) >= start) & (F.col(axis) < stop) & (at % step == 0)).withColumn(axis, F.floor(at / step).cast("long"))


def concatenate(lhs: DataFrame, rhs: DataFrame, axis: str) -> DataFrame:
    shift = lhs.agg(F.coalesce(F.max(axis) + 1, F.lit(0)).alias("n"))
    moved = rhs.crossJoin(F.broadcast(shift)).withColumn(axis, F.col(axis) + F.col("n")).select(lhs.columns)
    return lhs.unionByName(moved)


def stack(lhs: DataFrame, rhs: DataFrame, axis: str = "component") -> DataFrame:
    return lhs.withColumn(axis, F.lit(0).cast("long")).unionByName(rhs.withColumn(axis, F.lit(1).cast("long")))


def broadcast_like(values: DataFrame, template: DataFrame) -> DataFrame:
    """The values at every cell of the template; axes that the values lack, or have one line of, are repeated."""
    shared = [c for c in indices(values) if c in indices(template)]
    if not shared:
        return template.select(indices(template)).crossJoin(values.select(V))
    # an axis with one line gets the same key on both sides; one row tells which those are
    single = F.broadcast(values.agg(*[(F.min(c) == F.max(c)).alias(f"_{c}") for c in shared]))
    key = [F.when(~F.col(f"_{c}"), F.col(c)).otherwise(F.lit(-1)).alias(f"_k{c}") for c in shared]
    own = values.crossJoin(single).select(*key, V)
    cells = template.select(indices(template)).crossJoin(single).select(*indices(template), *key)
    return cells.join(own, [f"_k{c}" for c in shared]).select(*indices(template), V)


def scatter_rows(values: DataFrame, places: DataFrame, length: int, fill: float = float("nan")) -> DataFrame:
    """Row i of a matrix goes to the ``place`` that ``places`` (i, place) gives; other rows hold ``fill``.  Places are unique."""
    spark = values.sparkSession
    own = places.groupBy("place").agg(F.count("*").alias("n"), F.min("i").alias("i"))
    bad = (F.col("n") > 1) | (F.col("place") < 0) | (F.col("place") >= length)
    own = own.select("i", _raise_if(bad, "INDEX_OUT_OF_RANGE", F.col("place")).alias("place"))
    grid = spark.range(length).select(F.col("id").alias("place")).join(values.select("j").distinct())
    out = grid.join(values.join(own, "i").select("place", "j", V), ["place", "j"], "left")
    return out.select(F.col("place").alias("i"), "j", F.coalesce(V, F.lit(float(fill))).alias(V))


def one_hot(codes: DataFrame, states: int) -> DataFrame:
    """(pos, code) -> (i, j, v)."""
    return codes.select(F.col("pos").alias("i"), "code", F.explode(F.sequence(F.lit(0), F.lit(states - 1))).alias("j")).select(
        "i", F.col("j").cast("long").alias("j"), F.when(F.col("code") == F.col("j"), 1.0).otherwise(0.0).alias(V)
    )


def transition_counts(codes: DataFrame, states: int, by: list[str] | None = None) -> DataFrame:
    """Counts of adjacent valid codes: [by,] i, j, v over the whole states x states grid."""
    by = by or []
    before = codes.withColumn("prev", F.lag("code").over(Window.partitionBy(*by).orderBy("pos")))
    seen = before.where("prev >= 0 AND code >= 0").groupBy(*by, F.col("prev").cast("long").alias("i"), F.col("code").cast("long").alias("j")).agg(F.count("*").cast("double").alias(V))
    grid = codes.sparkSession.range(states * states).select(F.expr(f"id div {states}").alias("i"), (F.col("id") % states).alias("j"))
    full = codes.select(*by).distinct().crossJoin(F.broadcast(grid)) if by else grid
    return full.join(seen, [*by, "i", "j"], "left").select(*by, "i", "j", F.coalesce(V, F.lit(0.0)).alias(V))


def partition_mean(values: DataFrame, order: DataFrame, partitions: int) -> DataFrame:
    """Means of the rows of a matrix in ``partitions`` near-equal runs of the order (pos, i): c, j, v; run c ends before floor(n (c+1) / k)."""
    n = order.agg(F.count("*").alias("n"))
    at = order.crossJoin(F.broadcast(n)).select("i", F.floor((F.col("pos") * partitions + partitions - 1) / F.col("n")).cast("long").alias("guess"), "pos", "n")
    edge = lambda c: F.floor(F.col("n") * c / partitions)
    c = F.col("guess")
    fixed = F.when(F.col("pos") < edge(c), c - 1).when(F.col("pos") >= edge(c + 1), c + 1).otherwise(c)
    return _finite_only(values).join(at.select("i", fixed.alias("c")), "i").groupBy("c", "j").agg(F.avg(V).alias(V))
