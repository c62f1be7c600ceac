"""Causal operators over unbounded streams: state per product, updated in event-time order.

A micro-batch is sorted by time inside a key.  Rows older than the last one that the state has seen are dropped, since a recurrence
can't be revised without its history; the count of dropped rows goes along.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from tidemark.operators.latent import NORM_FLOOR

Step = Callable[[tuple, float], tuple[tuple, float]]


def exponential(alpha: float) -> tuple[Step, tuple]:
    """recursive_filter that is seeded by the first finite value and holds on missing ones."""

    def step(state: tuple, x: float) -> tuple[tuple, float]:
        (s,) = state
        if math.isfinite(x):
            s = x if math.isnan(s) else (1.0 - alpha) * s + alpha * x
        return (s,), s

    return step, (float("nan"),)


def hysteresis(upper_enter: float, upper_exit: float, lower_enter: float, lower_exit: float) -> tuple[Step, tuple]:
    from tidemark.operators.kernels import UNKNOWN

    def step(state: tuple, x: float) -> tuple[tuple, float]:
        (s,) = state
        if not math.isfinite(x):
            return (s,), float(UNKNOWN)
        up, down = x >= upper_enter, x <= lower_enter
        if s == 0.0:
            s = 2.0 if down else 1.0 if x <= upper_exit else 0.0
        elif s == 2.0:
            s = 0.0 if up else 1.0 if x >= lower_exit else 2.0
        else:
            s = 0.0 if up else 2.0 if down else 1.0
        return (s,), s

    return step, (1.0,)


def drawdown() -> tuple[Step, tuple]:
    def step(state: tuple, x: float) -> tuple[tuple, float]:
        peak = max(state[0], x)
        return (peak,), x / peak - 1.0

    return step, (float("-inf"),)


def kalman(process_variance: float, measurement_variance: float, initial_variance: float) -> tuple[Step, tuple]:
    """scalar_kalman's estimate; missing observations change nothing and give NaN."""

    def step(state: tuple, x: float) -> tuple[tuple, float]:
        m, p = state
        if not math.isfinite(x):
            return state, float("nan")
        if math.isnan(m):
            return (x, p), x
        p += process_variance
        gain = p / (p + measurement_variance)
        m += gain * (x - m)
        return (m, p * (1.0 - gain)), m

    return step, (float("nan"), initial_variance)


def confirm(confirmation: int, min_hold: int) -> tuple[Step, tuple]:
    """state_confirm over codes: state, candidate, rows held, candidate's run.  A missing code is unknown."""

    def step(state: tuple, x: float) -> tuple[tuple, float]:
        active, wanted, held, run = state
        held += active >= 0
        if not x >= 0:
            return (active, -1.0, held, 0.0), -1.0
        if x == active:
            return (active, -1.0, held, 0.0), active
        run = run + 1 if x == wanted else 1.0
        if run < confirmation or (active >= 0 and held <= min_hold):
            return (active, x, held, run), active
        return (x, x, 1.0, run) if active < 0 else (x, -1.0, 1.0, 0.0), x

    return step, (-1.0, -1.0, 0.0, 0.0)


def markov(initial: list[float], transition: list[list[float]], means: list[float], variances: list[float], report: int) -> tuple[Step, tuple]:
    """hmm_filter with Gaussian emissions: the probability of state ``report``.  A missing observation moves the states on unseen."""
    pi, a = np.array(initial, float), np.array(transition, float)
    m, v = np.array(means, float), np.array(variances, float)

    def step(state: tuple, x: float) -> tuple[tuple, float]:
        started, p = state[0], np.array(state[1:])
        p = p @ a if started else p
        if math.isfinite(x):
            e = -0.5 * (np.log(2 * math.pi * v) + (x - m) ** 2 / v)
            p = p * np.exp(e - e.max())
            p = p / max(p.sum(), NORM_FLOOR)
        return (1.0, *p.tolist()), float(p[report])

    return step, (0.0, *pi.tolist())


def apply_causal(stream: DataFrame, key: str, time: str, value: str, operator: tuple[Step, tuple]) -> DataFrame:
    """key, ts, value, out, dropped: a row for every row that isn't late."""
    step, start = operator
    state_schema = ", ".join(f"s{i} double" for i in range(len(start))) + ", last long, dropped long"

    def run(k: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        *s, last, dropped = state.get if state.exists else (*start, -(2**62), 0)
        s = tuple(s)
        rows = pd.concat(list(frames)).sort_values("ts", kind="stable")
        out = []
        for ts, x in zip(rows["ts"], rows["value"], strict=True):
            at = ts.value
            if at < last:
                dropped += 1
                continue
            s, y = step(s, float(x))
            last = at
            out.append((k[0], ts, float(x), float(y), dropped))
        state.update((*s, last, dropped))
        yield pd.DataFrame(out, columns=["key", "ts", "value", "out", "dropped"])

    src = stream.select(F.col(key).cast("string").alias("key"), F.col(time).alias("ts"), F.col(value).cast("double").alias("value"))
    return src.groupBy("key").applyInPandasWithState(run, "key string, ts timestamp, value double, out double, dropped long", state_schema, "append", GroupStateTimeout.NoTimeout)


def windowed_metrics(stream: DataFrame, key: str, time: str, value: str, width: str, lateness: str, slide: str | None = None) -> DataFrame:
    """Count, mean and deviation of tumbling or sliding event-time windows, complete once the watermark passes."""
    w = F.window(time, width, slide) if slide else F.window(time, width)
    out = stream.withWatermark(time, lateness).groupBy(key, w.alias("w")).agg(F.count("*").alias("n"), F.avg(value).alias("mean"), F.stddev_samp(value).alias("std"))
    return out.select(key, F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n", "mean", "std")
