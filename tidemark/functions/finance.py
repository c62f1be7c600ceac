"""Return statistics per product on a long frame: product, pos (row of the shared calendar), ts, value.

NaN values are missing.  The behaviour of the published functions is kept with its peculiarities, which the docstrings name.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.scalar import nan

#: Fixed value: the recovery length of a drawdown that isn't recovered.
NOT_RECOVERED = 1_000_000


def _valid(c: str | Column = "value") -> Column:
    c = F.col(c) if isinstance(c, str) else c
    return F.when(~F.isnan(c), c)


def _rows() -> Window:
    return Window.partitionBy("product").orderBy("pos")


def _prefix():  # noqa: ANN202
    return _rows().rowsBetween(Window.unboundedPreceding, 0)


def _day(c: str | Column) -> Column:
    return F.date_format(c, "yyyyMMdd")


def cal_std_mean(values: DataFrame) -> DataFrame:
    """Sample deviation per product, NaN for fewer than two values (the name promises more than it gives)."""
    return values.groupBy("product").agg(F.coalesce(F.stddev_samp(_valid()), nan()).alias("std"))


def cal_std_mean_simd(values: DataFrame) -> DataFrame:
    """Mean and sample deviation, both NaN for fewer than two values."""
    n = F.count(_valid())
    return values.groupBy("product").agg(
        F.when(n > 1, F.avg(_valid())).otherwise(nan()).alias("mean"), F.when(n > 1, F.stddev_samp(_valid())).otherwise(nan()).alias("std")
    )


def cal_cpr(values: DataFrame) -> DataFrame:
    """Transitions that stay on one side of the daily median of the product's type, over those that change it."""
    day = Window.partitionBy("type", "pos")
    rows = values.withColumn("side", F.col("value") >= F.percentile(_valid(), F.lit(0.5)).over(day)).where(~F.isnan("value"))
    rows = rows.withColumn("before", F.lag("side").over(_rows()))
    same, changed = F.count(F.when(F.col("side") == F.col("before"), 1)), F.count(F.when(F.col("side") != F.col("before"), 1))
    found = rows.groupBy("product").agg(F.when(changed > 0, same / F.when(changed > 0, changed)).otherwise(nan()).alias("cpr"))
    return values.select("product").distinct().join(found, "product", "left").select("product", F.coalesce("cpr", nan()).alias("cpr"))


def _growth(values: DataFrame) -> DataFrame:
    """level: the product of 1 + value over the rows so far, NaN rows skipped."""
    return values.withColumn("level", F.coalesce(F.product(_valid() + 1.0).over(_prefix()), F.lit(1.0)))


def cal_longest_dd_recover(values: DataFrame) -> DataFrame:
    """The longest run of rows below the running peak, which starts at 1."""
    rows = _growth(values)
    rows = rows.withColumn("peak", F.greatest(F.lit(1.0), F.max("level").over(_prefix())))
    rows = rows.withColumn("under", (F.col("level") - F.col("peak")) / F.col("peak") != 0)
    rows = rows.withColumn("run", F.sum(F.when(F.col("under"), 0).otherwise(1)).over(_prefix()))
    runs = rows.groupBy("product", "run").agg(F.count(F.when(F.col("under"), 1)).alias("n"))
    return runs.groupBy("product").agg(F.max("n").alias("longest"))


def cal_max_dd(values: DataFrame) -> DataFrame:
    """Largest drawdown, its day and the rows to recovery (1,000,000 if none, 0 if the low is the first row).

    The level of a NaN row is that of the next row with a value; without any the drawdown is 0.
    """
    rows = _growth(values).withColumn("own", F.when(~F.isnan("value"), F.col("level")))
    later = _rows().rowsBetween(0, Window.unboundedFollowing)
    rows = rows.withColumn("level", F.first("own", True).over(later))
    rows = rows.withColumn("peak", F.max("level").over(_prefix()))
    rows = rows.withColumn("dd", F.least(F.lit(0.0), (F.col("level") - F.col("peak")) / F.col("peak")))
    first = F.min(F.struct(F.coalesce("dd", F.lit(0.0)).alias("dd"), "pos", "ts")).over(Window.partitionBy("product"))
    rows = rows.withColumn("low", first)
    back = F.min(F.when((F.col("pos") > F.col("low.pos")) & (F.col("level") >= F.col("peak")), F.col("pos")))
    has = F.count("own") > 0
    low = F.first("low")
    start = F.min("pos")
    return rows.groupBy("product").agg(
        F.abs(low["dd"]).alias("max_drawdown"),
        _day(low["ts"]).alias("low_day"),
        F.when(~has, F.lit(NOT_RECOVERED)).when(low["pos"] == start, 0).otherwise(F.coalesce(back - low["pos"], F.lit(NOT_RECOVERED))).cast("long").alias("recovery"),
    )


def cal_all_largest_indicators(values: DataFrame, positive: bool = True) -> DataFrame:
    """The best streak of selected rows: ratio - 1, length, first and last day; the later of equals.

    Both modes select rows with value > 0; the negative one multiplies by 1 - value and takes the least ratio.
    """
    chosen = F.coalesce(F.col("value") > 0, F.lit(False)) & ~F.isnan("value")
    rows = values.withColumn("on", chosen).withColumn("run", F.sum(F.when(chosen, 0).otherwise(1)).over(_prefix()))
    factor = F.when(F.col("on"), 1.0 + F.col("value") * (1.0 if positive else -1.0))
    inside = Window.partitionBy("product", "run").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumn("ratio", F.product(factor).over(inside)).withColumn("n", F.count(factor).over(inside))
    rows = rows.withColumn("first_ts", F.min(F.when(F.col("on"), F.col("ts"))).over(inside))
    key = F.col("ratio") if positive else -F.col("ratio")
    best = F.max(F.when(F.col("on") & (F.col("ratio") != 1.0), F.struct(key.alias("k"), "pos", "ratio", "n", "first_ts", "ts")))
    out = rows.groupBy("product").agg(best.alias("b"))
    return out.select(
        "product", F.coalesce(F.col("b.ratio") - 1.0, F.lit(0.0)).alias("r"), F.coalesce("b.n", F.lit(0)).cast("long").alias("p"), _day("b.first_ts").alias("s"), _day("b.ts").alias("l")
    )


def cal_all_longest_indicators(values: DataFrame, positive: bool = True) -> DataFrame:
    """The longest run of rows with value > 0, the last of equals, and its return on the level before it.

    A run from the first row on is measured on the level of the last row.
    """
    on = F.coalesce(F.col("value") > 0, F.lit(False)) & ~F.isnan("value")
    sign = 1.0 if positive else -1.0
    rows = values.withColumn("on", on).withColumn("run", F.sum(F.when(on, 0).otherwise(1)).over(_prefix()))
    rows = rows.withColumn("level", F.coalesce(F.product(1.0 + _valid() * sign).over(_prefix()), F.lit(1.0)))
    whole = _rows().rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    rows = rows.withColumn("before", F.coalesce(F.lag("level").over(_rows()), F.last("level").over(whole)))
    runs = rows.where("on").groupBy("product", "run").agg(F.count("*").alias("n"), F.min_by("before", "pos").alias("b"), F.max_by("level", "pos").alias("e"), F.min("ts").alias("s"), F.max("ts").alias("l"))
    best = runs.groupBy("product").agg(F.max(F.struct("n", "run", "b", "e", "s", "l")).alias("x"))
    all_ = values.select("product").distinct().join(best, "product", "left")
    ratio = F.when(F.col("x").isNull(), 0.0).when(F.col("x.b") != 0, F.col("x.e") / F.when(F.col("x.b") != 0, F.col("x.b")) - 1.0).otherwise(nan())
    return all_.select("product", ratio.alias("r"), F.coalesce("x.n", F.lit(0)).cast("long").alias("p"), _day("x.s").alias("s"), _day("x.l").alias("l"))


def months(period: str) -> int:
    m = re.fullmatch(r"(\d+)([MY])", period)
    if not m:
        raise ValueError("a period is like 1M, 3M or 1Y")
    return int(m[1]) * (12 if m[2] == "Y" else 1)


def cal_rolling_gain_loss(values: DataFrame, period: str) -> DataFrame:
    """Returns of holding for some months from every day on: mean, median, share of gains and of six classes.

    The day of sale is the first day of the calendar not before the target (month ends clamped), else the last; days from
    the first such ``else`` day, less one, on are left out.  ``start`` and ``end`` columns bound a product's rows.
    """
    days = values.groupBy("pos").agg(F.min("ts").alias("ts"))
    target = F.add_months(F.to_date("ts"), months(period)).cast("timestamp") + (F.col("ts") - F.date_trunc("day", "ts"))
    marks = days.select(F.col("ts").alias("at"), F.lit(1).alias("k"), "pos").union(days.select(target.alias("at"), F.lit(0).alias("k"), "pos"))
    # the calendar alone is ordered in one task: a row a day, whatever the number of products
    ahead = Window.orderBy("at", "k", "pos").rowsBetween(0, Window.unboundedFollowing)
    marks = marks.withColumn("sale", F.first(F.when(F.col("k") == 1, F.col("pos")), True).over(ahead))
    last = days.agg(F.max("pos").alias("last"))
    sales = marks.where("k = 0").crossJoin(F.broadcast(last)).select("pos", F.coalesce("sale", "last").alias("sale"), "last")
    tail = sales.agg(F.count(F.when(F.col("sale") == F.col("last"), 1)).alias("tail"))
    sales = sales.crossJoin(F.broadcast(tail)).withColumn("cut", F.greatest(F.col("last") + 1 - F.col("tail") - 1, F.lit(0)))
    inside = F.lit(True)
    if "start" in values.columns:
        inside = (F.col("pos") >= F.col("start")) & (F.col("pos") <= F.col("end"))
    net = values.where(inside).withColumn("net", F.coalesce(F.product(_valid() + 1.0).over(_prefix()), F.lit(1.0))).select("product", "pos", "net")
    held = net.join(sales, "pos").where("pos < cut").join(net.select("product", F.col("pos").alias("sale"), F.col("net").alias("sold")), ["product", "sale"])
    r = F.col("r")
    held = held.withColumn("r", F.col("sold") / F.col("net") - 1.0).where(~F.isnan("r"))
    share = lambda c: F.count(F.when(c, 1)) / F.count("*")
    out = held.groupBy("product").agg(
        F.avg(r).alias("mean"), F.percentile(r, F.lit(0.5)).alias("median"), share(r > 0).alias("win"),
        share((r > 0) & (r <= 0.05)).alias("gain_5"), share((r > 0.05) & (r <= 0.10)).alias("gain_10"), share(r > 0.10).alias("gain_more"),
        share((r >= -0.05) & (r <= 0)).alias("loss_5"), share((r >= -0.10) & (r < -0.05)).alias("loss_10"), share(r < -0.10).alias("loss_more"),
    )
    names = [c for c in out.columns if c != "product"]
    return values.select("product").distinct().join(out, "product", "left").select("product", *[F.coalesce(c, nan()).alias(c) for c in names])
