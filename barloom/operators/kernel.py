"""The position state machine over plain arrays: one position at a time, path-dependent exits. No Spark in here."""

from __future__ import annotations

import dataclasses

import numpy as np


@dataclasses.dataclass(frozen=True)
class Rules:
    """Exits in multiples of the entry's ATR; 0 turns an exit off. ``cost`` is the share lost on entry and on exit."""

    direction: str = "LONG"
    tp: float = 0.0
    sl: float = 1.5
    trail: float = 0.0
    cost: float = 0.0008
    hold: int = 960
    target_first: bool = False  # whether a bar that touches both exits at the target


@dataclasses.dataclass
class Trade:
    entry: int
    exit: int
    entry_price: float
    exit_price: float
    pnl: float
    kind: str
    equity: float


CHUNK = 64  # bars that an exit is first looked for in; twice as many each time


def _exit(adverse: np.ndarray, favour: np.ndarray, since: int, entry: float, size: float, rules: Rules) -> tuple[int, float, str] | None:
    """(bar, raw price, kind) of the exit of a position opened at the close of ``since``; None if it stays open. The price is NaN at a time exit."""
    side = 1 if rules.direction == "LONG" else -1
    stop, target = entry - side * rules.sl * size, entry + side * rules.tp * size
    first, best, step = stop, entry, CHUNK
    up, until = (np.fmax, np.greater_equal) if side > 0 else (np.fmin, np.less_equal)
    below = np.less_equal if side > 0 else np.greater_equal
    at, n = since + 1, len(adverse)
    while at < n:
        end = min(n, at + step)
        if rules.trail > 0:
            reach = up(up.accumulate(favour[at:end]), best)
            stops = up(reach - side * rules.trail * size, stop)
        else:
            stops = np.full(end - at, stop)
        stopped = below(adverse[at:end], stops)
        reached = until(favour[at:end], target) if rules.tp > 0 else np.zeros(end - at, bool)
        hit = stopped | reached
        late = since + rules.hold - at
        if late < end - at:
            hit[max(late, 0) :] = True
        k = int(hit.argmax())
        if hit[k]:
            if stopped[k] and not (rules.target_first and reached[k]):
                return at + k, float(stops[k]), "trail" if rules.trail > 0 and stops[k] != first else "stop"
            return (at + k, target, "target") if reached[k] else (at + k, float("nan"), "time")
        if rules.trail > 0:
            best, stop = float(reach[-1]), float(stops[-1])
        at, step = end, 2 * step
    return None


def run(high: np.ndarray, low: np.ndarray, close: np.ndarray, atr: np.ndarray, signal: np.ndarray, rules: Rules, equity: float = 100.0) -> tuple[np.ndarray, list[Trade]]:
    """Equity after each bar and the trades.

    A bar first moves the best price and the trailing stop, then tests stop, target and time; a position is opened
    at the close of a bar that began flat, if its signal is true and its ATR is known and positive. What is open at
    the end closes at the last close as ``eod``. The cost is one search for each trade, not a step for each bar.
    """
    side = 1 if rules.direction == "LONG" else -1
    pay_in, pay_out = 1 + side * rules.cost, 1 - side * rules.cost
    adverse, favour = (low, high) if side > 0 else (high, low)
    with np.errstate(invalid="ignore"):
        starts = np.flatnonzero(signal & (atr > 0))  # a missing ATR is NaN here, which is not above 0
    n, curve, trades = len(close), np.full(len(close), equity), []
    k = 0
    while k < len(starts):
        since = int(starts[k])
        entry, size = float(close[since] * pay_in), float(atr[since])
        found = _exit(adverse, favour, since, entry, size, rules)
        at, raw, kind = found or (n - 1, float(close[-1]), "eod")
        price = (float(close[at]) if kind == "time" else raw) * pay_out
        pnl = side * (price - entry) / entry
        equity *= 1 + pnl
        trades.append(Trade(since, at, entry, price, pnl, kind, equity))
        curve[at:] = equity
        k = int(np.searchsorted(starts, at + 1)) if found else len(starts)
    return curve, trades
