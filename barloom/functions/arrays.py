"""The indicators on one ordered series as arrays, for populations: a task that has the bars anyway values hundreds of calls at once,
where a plan of as many columns would take longer to compile than to run. Tests hold every one against its column.

Missing is NaN. A rolling figure needs its full window, as on columns.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd

PRICES = ("open", "high", "low", "close", "volume")


def _over(a: np.ndarray, b: np.ndarray | float) -> np.ndarray:
    return np.divide(a, b, out=np.full(len(a), np.nan), where=np.asarray(b) != 0)


def _lag(x: np.ndarray, k: int = 1) -> np.ndarray:
    out = np.full(len(x), np.nan)
    out[k:] = x[: max(len(x) - k, 0)]
    return out


def _roll(x: np.ndarray, n: int, f: Callable, least: int | None = None) -> np.ndarray:
    """``f`` over the last ``n`` values; NaN under ``least`` (by default ``n``) known ones."""
    out = np.full(len(x), np.nan)
    if least is not None and least < n:
        name = {np.mean: "mean", np.max: "max", np.std: "std"}[f]
        return getattr(pd.Series(x).rolling(n, min_periods=least), name)().to_numpy()
    if len(x) >= n:
        views = np.lib.stride_tricks.sliding_window_view(x, n)
        for k in range(0, len(views), 65536):
            part = views[k : k + 65536]
            out[n - 1 + k : n - 1 + k + len(part)] = np.std(part, axis=1, ddof=1) if f is np.std and n > 1 else np.full(len(part), np.nan) if f is np.std else f(part, axis=1)
    return out


def _ewm(x: np.ndarray, alpha: float, least: int = 0) -> np.ndarray:
    return pd.Series(x).ewm(alpha=alpha, adjust=False, min_periods=least).mean().to_numpy()


class Series:
    """A symbol's bars of one timeframe; what is computed is kept."""

    def __init__(self, columns: dict[str, np.ndarray]):
        self.columns, self.known = columns, {}

    def __getitem__(self, name: str) -> np.ndarray:
        return self.columns[name]

    def of(self, name: str, *args) -> np.ndarray:
        key = (name, *args)
        if key not in self.known:
            with np.errstate(invalid="ignore", divide="ignore"):
                self.known[key] = ARRAYS[name](self, *args)
        return self.known[key]


def _true_range(s: Series) -> np.ndarray:
    before = _lag(s["close"])
    return np.fmax(np.fmax(s["high"] - s["low"], np.abs(s["high"] - before)), np.abs(s["low"] - before))


def _atr(s: Series, n: int) -> np.ndarray:
    return _ewm(_true_range(s), 2 / (n + 1))


def _rsi(s: Series, src: str, n: int) -> np.ndarray:
    change = s[src] - _lag(s[src])
    gain, loss = _ewm(np.maximum(change, 0), 1 / n, n), _ewm(np.maximum(-change, 0), 1 / n, n)
    return 100 - 100 / (1 + _over(gain, loss))


def _stoch_k(s: Series, n: int) -> np.ndarray:
    low, high = _roll(s["low"], n, np.min), _roll(s["high"], n, np.max)
    return 100 * _over(s["close"] - low, high - low)


def _bands(s: Series, n: int, k: float) -> tuple[np.ndarray, np.ndarray]:
    return _roll(s["close"], n, np.mean), _roll(s["close"], n, np.std)


def _pct_b(s: Series, n: int, k: float) -> np.ndarray:
    mid, sd = _bands(s, n, k)
    return 100 * _over(s["close"] - (mid - k * sd), (mid + k * sd) - (mid - k * sd))


def _bbwidth(s: Series, n: int, k: float) -> np.ndarray:
    mid, sd = _bands(s, n, k)
    return 100 * _over(2 * k * sd, mid)


def _macd(s: Series, fast: int, slow: int, signal: int) -> tuple[np.ndarray, np.ndarray]:
    line = _ewm(s["close"], 2 / (fast + 1), fast) - _ewm(s["close"], 2 / (slow + 1), slow)
    return line, _ewm(line, 2 / (signal + 1), signal)


def _macd_norm(s: Series, fast: int, slow: int, signal: int) -> np.ndarray:
    line, mean = _macd(s, fast, slow, signal)
    return _over(line - mean, s.of("ATR", 14))


def _adx(s: Series, n: int) -> np.ndarray:
    up, down = s["high"] - _lag(s["high"]), _lag(s["low"]) - s["low"]
    plus, minus = np.where((up > down) & (up > 0), up, 0.0), np.where((down > up) & (down > 0), down, 0.0)
    size, p, m = (_ewm(x, 1 / n, n) for x in (_true_range(s), plus, minus))
    pdi, mdi = 100 * _over(p, size), 100 * _over(m, size)
    return np.clip(_ewm(100 * _over(np.abs(pdi - mdi), pdi + mdi), 1 / n, n), 0, 100)


def _mfi(s: Series, n: int) -> np.ndarray:
    typical = (s["high"] + s["low"] + s["close"]) / 3
    change, flow = typical - _lag(typical), typical * s["volume"]
    a, b = (_roll(np.where(side, flow, 0.0), n, np.sum) for side in (change > 0, change < 0))
    return 100 - 100 / (1 + _over(a, b))


def _recent(hit: np.ndarray, n: int) -> np.ndarray:
    """100 where one of the last bars was a hit, else 0."""
    return _roll(np.where(hit, 100.0, 0.0), max(1, min(n // 2, 8)), np.max, 1) if max(1, min(n // 2, 8)) > 1 else np.where(hit, 100.0, 0.0)


def _breakout(s: Series, n: int, up: bool) -> np.ndarray:
    edge = _lag(_roll(s["high" if up else "low"], n, np.max if up else np.min))
    return _recent(s["close"] > edge if up else s["close"] < edge, n)


def _rolling_rank(x: np.ndarray, n: int, least: int) -> np.ndarray:
    """Average-tie percentile rank of the current value among the known ones of the last ``n``."""
    padded = np.concatenate((np.full(n - 1, np.nan), x))
    views, out = np.lib.stride_tricks.sliding_window_view(padded, n), np.full(len(x), np.nan)
    for k in range(0, len(x), 16384):
        part, now = views[k : k + 16384], x[k : k + 16384, None]
        known = (~np.isnan(part)).sum(axis=1)
        rank = ((part < now).sum(axis=1) + ((part == now).sum(axis=1) + 1) / 2) / np.maximum(known, 1)
        out[k : k + 16384] = np.where((known >= least) & ~np.isnan(now[:, 0]), rank, np.nan)
    return out


def _oscillator(s: Series, which: str, p: int) -> np.ndarray:
    which = which.upper()
    return s.of(which, p) if which in ("MFI", "STOCH_K") else s.of("RSI", "close", p)


def _trending(s: Series, which: str, p: int, n: int) -> np.ndarray:
    y = _oscillator(s, which, p)
    t = np.arange(n) - (n - 1) / 2
    slope = np.full(len(y), np.nan)
    if len(y) >= n and n > 1:
        slope[n - 1 :] = np.lib.stride_tricks.sliding_window_view(y, n) @ t / (t @ t)
    return np.clip(50 * _over(slope, _roll(y, n, np.std)), -100, 100)


def _divergence(s: Series, which: str, p: int, n: int, bull: bool) -> np.ndarray:
    y, edge = _oscillator(s, which, p), np.min if bull else np.max
    price, osc = _lag(_roll(s["close"], n, edge)), _lag(_roll(y, n, edge))
    return _recent((s["close"] < price) & (y > osc) if bull else (s["close"] > price) & (y < osc), n)


ARRAYS: dict[str, Callable[..., np.ndarray]] = {
    "SMA": lambda s, src, n: _roll(s[src], n, np.mean),
    "EMA": lambda s, src, n: _ewm(s[src], 2 / (n + 1), n),
    "RSI": _rsi,
    "ATR": _atr,
    "STOCH_K": _stoch_k,
    "STOCH_D": lambda s, n: _roll(s.of("STOCH_K", n), 3, np.mean),
    "PCT_B": _pct_b,
    "MACD_NORM": _macd_norm,
    "PRICE_POS": lambda s, n: _over(s["close"] - _roll(s["close"], n, np.mean), s.of("ATR", min(n, 14))),
    "ROC": lambda s, n: 100 * (_over(s["close"], _lag(s["close"], n)) - 1),
    "VOL_RATIO": lambda s, n: _over(s["volume"], _roll(s["volume"], n, np.mean)),
    "BBWIDTH": _bbwidth,
    "ATR_PCT": lambda s, n: 100 * _over(s.of("ATR", n), s["close"]),
    "ADX": _adx,
    "MFI": _mfi,
    "BREAKOUT_UP": lambda s, n: _breakout(s, n, True),
    "BREAKOUT_DOWN": lambda s, n: _breakout(s, n, False),
    "SQUEEZE": lambda s, n, k: 100 * (1 - _rolling_rank(s.of("BBWIDTH", n, k), 2 * n, n)),
    "TRENDING": _trending,
    "DIVERGENCE_BULL": lambda s, which, p, n: _divergence(s, which, p, n, True),
    "DIVERGENCE_BEAR": lambda s, which, p, n: _divergence(s, which, p, n, False),
    "MACD_LINE": lambda s, *a: _macd(s, *a)[0],
    "MACD_SIGNAL": lambda s, *a: _macd(s, *a)[1],
    "MACD_HIST": lambda s, *a: np.subtract(*_macd(s, *a)),
    "BBAND_UPPER": lambda s, n, k: _bands(s, n, k)[0] + k * _bands(s, n, k)[1],
    "BBAND_LOWER": lambda s, n, k: _bands(s, n, k)[0] - k * _bands(s, n, k)[1],
    "VOLUME_SMA": lambda s, n: _roll(s["volume"], n, np.mean),
    "ATR_SMA": lambda s, n: _roll(_true_range(s), n, np.mean),
}


class Frames:
    """A symbol's bars and its longer timeframes, made when asked for: gaps stay as buckets without prices, and a base bar sees the last bucket that had ended."""

    def __init__(self, ts: np.ndarray, columns: dict[str, np.ndarray]):
        self.ts, self.base = ts, Series(columns)
        self.longer: dict[int, tuple[Series, np.ndarray]] = {}

    def _frame(self, seconds: int) -> tuple[Series, np.ndarray]:
        if seconds not in self.longer:
            c = self.base.columns
            at = self.ts // seconds
            at = at - at[0] if len(at) else at
            n = int(at[-1]) + 1 if len(at) else 0
            first = np.flatnonzero(np.diff(at, prepend=-1))
            where, last = at[first], np.append(first[1:], len(at)) - 1
            made = {k: np.full(n, np.nan) for k in PRICES}
            made["volume"] = np.zeros(n)
            if n:
                made["open"][where], made["close"][where] = c["open"][first], c["close"][last]
                made["high"][where], made["low"][where] = np.maximum.reduceat(c["high"], first), np.minimum.reduceat(c["low"], first)
                made["volume"][where] = np.add.reduceat(c["volume"], first)
            self.longer[seconds] = Series(made), at
        return self.longer[seconds]

    def value(self, name: str, args: tuple, seconds: int | None) -> np.ndarray:
        """A call on the base bars, or on a longer timeframe."""
        if seconds is None:
            return self.base.of(name, *args)
        series, at = self._frame(seconds)
        return _lag(series.of(name, *args))[at] if len(at) else np.empty(0)
