"""Sequential operators: feedback from row to row, one ordered interval at a time.

Every kernel takes NumPy arrays of one interval and gives arrays of the same length; ``KERNELS`` names
their series inputs, parameters with defaults and outputs.  They run in grouped Arrow tasks, so a group must fit one worker.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import dataclass, field

import numpy as np

UNKNOWN, MISSING = -1, -2
NAN = float("nan")


def price_ok(x: float) -> bool:
    return math.isfinite(x) and x > 0


def recursive_smooth(x, periods, initial):
    out, s = np.full(len(x), NAN), initial
    for i in np.flatnonzero(np.isfinite(x)):
        s = ((periods - 1.0) * s + x[i]) / periods
        out[i] = s
    return out


def recursive_filter(x, update, alpha, initial, seed_mode, emit_policy):
    out, s, started = np.full(len(x), NAN), initial, seed_mode != 2
    for i, v in enumerate(x):
        if i == 0 and seed_mode == 1:
            out[i] = s
        elif update[i] and math.isfinite(v):
            s, started = (1.0 - alpha) * s + alpha * v if started else v, True
            out[i] = s
        elif started and emit_policy != 1:
            out[i] = s
    return out


def recursive_filter_adaptive(x, alpha, update, reset, initial, seed_mode, min_periods, emit_policy):
    out = np.full(len(x), NAN)
    s, started, seen = initial, seed_mode == 0, 0
    for i, v in enumerate(x):
        if reset[i]:
            s, started, seen = initial, seed_mode == 0, 0
        fresh = False
        if math.isfinite(v):
            seen += 1
            if started and update[i]:
                if not 0 <= alpha[i] <= 1:
                    raise ValueError("INVALID_PARAMETER")
                s += alpha[i] * (v - s)
                fresh = True
            elif not started and (seed_mode == 1 or update[i]):
                s, started, fresh = v, True, True
        if started and seen >= min_periods and (fresh or emit_policy == 0):
            out[i] = s
    return out


def linear_filter2(x, reset, b0, b1, a1, a2, min_periods, bootstrap):
    out = np.full(len(x), NAN)
    px = y1 = y2 = 0.0
    seen = 0
    for i, v in enumerate(x):
        if reset[i]:
            px = y1 = y2 = 0.0
            seen = 0
        if not math.isfinite(v):
            continue
        y = v if bootstrap == 1 and seen < 2 else b0 * v + b1 * px + a1 * y1 + a2 * y2
        if not math.isfinite(y):
            px = y1 = y2 = 0.0
            seen = 0
            continue
        px, y1, y2 = v, y, y1
        seen += 1
        if seen >= min_periods:
            out[i] = y
    return out


def scalar_kalman(x, process_variance, measurement_variance, initial_variance):
    est, var = np.full(len(x), NAN), np.full(len(x), NAN)
    m, p = None, initial_variance
    for i in np.flatnonzero(np.isfinite(x)):
        if m is None:
            m = x[i]
        else:
            p += process_variance
            gain = p / (p + measurement_variance)
            m += gain * (x[i] - m)
            p *= 1.0 - gain
        est[i], var[i] = m, p
    return est, var


def state_hysteresis(x, upper_enter, upper_exit, lower_enter, lower_exit):
    out, s = np.full(len(x), UNKNOWN, np.int64), 1
    for i in np.flatnonzero(np.isfinite(x)):
        v = x[i]
        if s == 0:
            s = 2 if v <= lower_enter else 1 if v <= upper_exit else 0
        elif s == 2:
            s = 0 if v >= upper_enter else 1 if v >= lower_exit else 2
        else:
            s = 0 if v >= upper_enter else 2 if v <= lower_enter else 1
        out[i] = s
    return out


def state_confirm(codes, confirmation, min_hold):
    out = np.full(len(codes), UNKNOWN, np.int64)
    active = wanted = -1
    held = run = 0
    for i, c in enumerate(codes):
        held += active >= 0
        if c < 0:
            wanted, run = -1, 0
            continue
        if c == active:
            wanted, run = -1, 0
        else:
            run = run + 1 if c == wanted else 1
            wanted = c
            if run >= confirmation and (active < 0 or held > min_hold):
                first = active < 0
                active, held = c, 1
                if not first:
                    wanted, run = -1, 0
        out[i] = active
    return out


def state_continuous(candidate, initial, observed, confirmation, state_count):
    n = len(candidate)
    state, evidence, pending = (np.zeros(n, np.int64) for _ in range(3))
    active, wanted, run, sure = -1, -1, 0, False
    for i, c in enumerate(candidate):
        if i == 0:
            active = initial[0]
        e = 2 if sure else 0
        if c < 0 or c == active:
            wanted, run = -1, 0
            if c >= 0:
                sure, e = True, 1
        else:
            run = run + 1 if c == wanted else 1
            wanted, e = c, 3
            if run >= confirmation:
                active, wanted, run, sure, e = c, -1, 0, True, 1
        state[i], evidence[i], pending[i] = active, e, run
    return state, evidence, pending


def drawdown_cycle_state(price, drawdown, valid, stress, rebound, exit_):
    out = np.full(len(price), UNKNOWN, np.int64)
    s, low = 0, NAN
    for i, (p, d) in enumerate(zip(price, drawdown, strict=True)):
        if not (valid[i] and price_ok(p) and math.isfinite(d)):
            s, low = -1, NAN
            continue
        if s <= 0:
            if d <= -stress:
                s, low = 2, p
            elif s < 0 and d >= -exit_:
                s, low = 0, p
        elif s == 2:
            if not math.isfinite(low) or p < low:
                low = p
            elif p / low - 1.0 >= rebound:
                s = 1
        elif p < low:
            s, low = 2, p
        elif d >= -exit_:
            s, low = 0, p
        out[i] = s
    return out


def _runs(ok: np.ndarray) -> list[tuple[int, int]]:
    edge = np.flatnonzero(np.diff(np.concatenate([[False], ok, [False]]).astype(np.int8)))
    return [(int(a), int(b)) for a, b in edge.reshape(-1, 2)]


def local_extrema(price, left, right, head, tail):
    left, right = int(left), int(right)
    ok = np.isfinite(price) & (price > 0)
    out = np.where(ok, 0, MISSING).astype(np.int64)
    for a, b in _runs(ok):
        prev, kind_before = None, 0
        for t in range(a + max(left, int(head)), b - max(right, int(tail))):
            before, after = price[t - left : t], price[t + 1 : t + right + 1]
            kind = 1 if (price[t] > before).all() and (price[t] >= after).all() else -1 if (price[t] < before).all() and (price[t] <= after).all() else 0
            if not kind or (prev is not None and kind * (price[t] - price[prev]) <= 0):
                continue
            if kind == kind_before:
                out[prev] = 0
            out[t], prev, kind_before = kind, t, kind
    return out


def _alternate(price, events, turns: list[int]) -> list[int]:
    kept: list[int] = []
    for t in turns:
        stronger = not kept or events[t] * (price[t] - price[kept[-1]]) > 0
        if stronger and kept and events[t] == events[kept[-1]]:
            kept[-1] = t
        elif stronger:
            kept.append(t)
    return kept


def _censor(price, events, turns: list[int], a: int, b: int, min_phase, min_cycle, amplitude) -> bool:
    """One deletion, by the first rule that applies; False at the fixed point.  ``turns`` changes in place."""
    for end, outside in ((0, range(a, turns[0])), (-1, range(turns[-1] + 1, b))):
        t = turns[end]
        if any(events[t] * (price[j] - price[t]) > 0 for j in outside):
            del turns[end]
            return True
    for j in range(len(turns) - 2):
        if turns[j + 2] - turns[j] < min_cycle:
            at = j if events[turns[j]] * (price[turns[j + 2]] - price[turns[j]]) > 0 else j + 1
            del turns[at : at + 2]
            turns[:] = _alternate(price, events, turns)
            return True
    for j in range(len(turns) - 1):
        x, y = turns[j], turns[j + 1]
        if y - x >= min_phase or abs(price[y] / price[x] - 1.0) > amplitude:
            continue
        at = j
        if j + 2 == len(turns):
            at = j + 1
        elif j and abs(math.log(price[x]) - math.log(price[turns[j - 1]])) >= abs(math.log(price[turns[j + 2]]) - math.log(price[y])):
            at = j + 1
        del turns[at]
        turns[:] = _alternate(price, events, turns)
        return True
    return False


def ps_filter(price, events, min_phase, min_cycle, amplitude):
    ok = np.isfinite(price) & (price > 0) & (events != MISSING)
    out = np.where(ok, 0, MISSING).astype(np.int64)
    for a, b in _runs(ok):
        turns = _alternate(price, events, [t for t in range(a, b) if abs(events[t]) == 1])
        while turns and _censor(price, events, turns, a, b, min_phase, min_cycle, amplitude):
            pass
        out[turns] = events[turns]
    return out


@dataclass(frozen=True)
class Kernel:
    run: Callable
    series: int  # leading series inputs
    outputs: tuple[str, ...] = ("value",)
    integer: bool = False
    #: where the operator's arguments go: indices into (series..., parameters...)
    order: tuple[int, ...] = ()
    defaults: dict[int, float] = field(default_factory=dict)


#: order: argument positions of the operator that are the kernel's arguments, series first
KERNELS: dict[str, Kernel] = {
    "recursive_smooth": Kernel(recursive_smooth, 1, order=(0, 1, 2)),
    "recursive_filter": Kernel(recursive_filter, 2, order=(0, 3, 1, 2, 4, 5), defaults={4: 0.0, 5: 0.0}),
    "recursive_filter_adaptive": Kernel(recursive_filter_adaptive, 4, order=(0, 1, 2, 3, 4, 5, 6, 7), defaults={4: 0.0, 5: 1.0, 6: 1.0, 7: 1.0}),
    "linear_filter2": Kernel(linear_filter2, 2, order=(0, 5, 1, 2, 3, 4, 6, 7), defaults={6: 1.0, 7: 1.0}),
    "scalar_kalman": Kernel(scalar_kalman, 1, ("estimate", "variance"), order=(0, 1, 2, 3), defaults={3: 1.0}),
    "state_hysteresis": Kernel(state_hysteresis, 1, integer=True, order=(0, 1, 2, 3, 4)),
    "state_confirm": Kernel(state_confirm, 1, integer=True, order=(0, 1, 2)),
    "state_continuous": Kernel(state_continuous, 3, ("state", "evidence", "pending_count"), True, (0, 1, 2, 3, 4)),
    "drawdown_cycle_state": Kernel(drawdown_cycle_state, 3, integer=True, order=(0, 1, 2, 3, 4, 5)),
    "local_extrema": Kernel(local_extrema, 1, integer=True, order=(0, 1, 2, 3, 4)),
    "ps_filter": Kernel(ps_filter, 2, integer=True, order=(0, 1, 2, 3, 4)),
}
