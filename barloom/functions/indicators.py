"""Indicators on bars, compiled to staged window columns and one grouped pass for each level of recursion.

An indicator is a generator function of a :class:`Stage`: ``stage.col(expr)`` adds a helper column at once, and
``yield ewm(...)`` asks for an exponential mean and receives its column. :func:`add` runs the generators of all
asked-for indicators in step, so that all exponential means of one level share one grouped pass, and all windows
share one partitioning by symbol.

Missing is NULL, never NaN. A rolling figure needs its full window; an exponential one its minimum of values.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Generator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

def order() -> W:
    """A symbol's rows in time. Made on each use: a window spec needs a running session."""
    return W.partitionBy("symbol").orderBy("ts")


def rows(n: int) -> W:
    return order().rowsBetween(-(n - 1), 0)


def guarded(agg: Callable[[str], Column], x: str, n: int, least: int | None = None) -> Column:
    """An aggregate over the last ``n`` rows, NULL under ``least`` values."""
    return F.when(F.count(x).over(rows(n)) >= (n if least is None else least), agg(x).over(rows(n)))


def over(a: Column, b: Column) -> Column:
    return a / F.nullif(b, F.lit(0.0))


class Stage:
    """Helper columns in as few projections as what they name allows: a column waits with all others of its level, one above those it names."""

    def __init__(self, df: DataFrame):
        self.df, self.keep, self.n = df, df.columns, 0
        self.level: dict[str, int] = {}
        self.waiting: list[list[Column]] = []
        self.same: dict[str, str] = {}

    def name(self) -> str:
        self.n += 1
        return f"_s{self.n}"

    def col(self, expr: Column) -> str:
        text = str(expr)
        if text not in self.same:
            name = self.same[text] = self.name()
            at = max((self.level.get(x, -1) for x in HELPER.findall(text)), default=-1) + 1
            self.level[name] = at
            if at == len(self.waiting):
                self.waiting.append([])
            self.waiting[at].append(expr.alias(name))
        return self.same[text]

    def flush(self) -> DataFrame:
        """All waiting columns in place; those made from here on start at the first level again."""
        for columns in self.waiting:
            self.df = self.df.select("*", *columns)
        self.waiting, self.level = [], {}
        return self.df

    def lag(self, x: str, k: int = 1) -> str:
        return self.col(F.lag(x, k).over(order()))


HELPER = re.compile(r"\b_s\d+\b")


def ewm(source: str, alpha: float, least: int = 0) -> tuple[str, float, int]:
    return source, alpha, least


def ewm_pass(df: DataFrame, wanted: list[tuple[str, float, int, str]], by: list[str] | None = None) -> DataFrame:
    """Adds exponential means ``(source, alpha, least, name)``: a recursion over each symbol's ordered bars, in one pass.

    Through missing values the last mean is carried and the old weight keeps decaying.
    """
    by = by or ["symbol"]
    schema = f"{', '.join(f'`{f.name}` {f.dataType.simpleString()}' for f in df.schema)}, {', '.join(f'{w[3]} double' for w in wanted)}"

    def run(bars: pa.Table) -> pa.Table:
        bars = bars.take(pc.sort_indices(bars, [("ts", "ascending")]))
        for source, alpha, least, name in wanted:
            x = pd.Series(bars.column(source).cast(pa.float64()).to_numpy())
            mean = x.ewm(alpha=alpha, adjust=False, min_periods=least).mean().to_numpy()
            bars = bars.append_column(name, pa.array(mean, pa.float64(), mask=np.isnan(mean)))
        return bars

    return df.groupBy(*by).applyInArrow(run, schema)


Gen = Generator[tuple[str, float, int], str, str]


def _true_range(s: Stage) -> str:
    before = F.lag("close", 1).over(order())
    return s.col(F.greatest(F.col("high") - F.col("low"), F.abs(F.col("high") - before), F.abs(F.col("low") - before)))


def _atr(s: Stage, n: int) -> Gen:
    return (yield ewm(_true_range(s), 2 / (n + 1)))


def sma(s: Stage, src: str, n: int) -> Gen:
    return s.col(guarded(F.avg, src, n))
    yield


def ema(s: Stage, src: str, n: int) -> Gen:
    return (yield ewm(src, 2 / (n + 1), n))


def rsi(s: Stage, src: str, n: int) -> Gen:
    change = s.col(F.col(src) - F.lag(src, 1).over(order()))
    gain = yield ewm(s.col(F.greatest(F.col(change), F.lit(0.0)) + F.col(change) * 0), 1 / n, n)
    loss = yield ewm(s.col(F.greatest(-F.col(change), F.lit(0.0)) + F.col(change) * 0), 1 / n, n)
    return s.col(100 - 100 / (1 + over(F.col(gain), F.col(loss))))


def atr(s: Stage, n: int) -> Gen:
    return (yield from _atr(s, n))


def stoch_k(s: Stage, n: int) -> Gen:
    low, high = s.col(guarded(F.min, "low", n)), s.col(guarded(F.max, "high", n))
    return s.col(100 * over(F.col("close") - F.col(low), F.col(high) - F.col(low)))
    yield


def stoch_d(s: Stage, n: int) -> Gen:
    k = yield from stoch_k(s, n)
    return s.col(guarded(F.avg, k, 3))


def _bands(s: Stage, n: int, k: float) -> tuple[str, str]:
    return s.col(guarded(F.avg, "close", n)), s.col(guarded(F.stddev_samp, "close", n))


def pct_b(s: Stage, n: int, k: float) -> Gen:
    mid, sd = _bands(s, n, k)
    low, high = F.col(mid) - k * F.col(sd), F.col(mid) + k * F.col(sd)
    return s.col(100 * over(F.col("close") - low, high - low))
    yield


def macd_norm(s: Stage, fast: int, slow: int, signal: int) -> Gen:
    a = yield ewm("close", 2 / (fast + 1), fast)
    b = yield ewm("close", 2 / (slow + 1), slow)
    line = s.col(F.col(a) - F.col(b))
    mean = yield ewm(line, 2 / (signal + 1), signal)
    size = yield from _atr(s, 14)
    return s.col(over(F.col(line) - F.col(mean), F.col(size)))


def price_pos(s: Stage, n: int) -> Gen:
    size = yield from _atr(s, min(n, 14))
    mid = s.col(guarded(F.avg, "close", n))
    return s.col(over(F.col("close") - F.col(mid), F.col(size)))


def roc(s: Stage, n: int) -> Gen:
    return s.col(100 * (over(F.col("close"), F.lag("close", n).over(order())) - 1))
    yield


def vol_ratio(s: Stage, n: int) -> Gen:
    return s.col(over(F.col("volume"), guarded(F.avg, "volume", n)))
    yield


def bbwidth(s: Stage, n: int, k: float) -> Gen:
    mid, sd = _bands(s, n, k)
    return s.col(100 * over(2 * k * F.col(sd), F.col(mid)))
    yield


def atr_pct(s: Stage, n: int) -> Gen:
    size = yield from _atr(s, n)
    return s.col(100 * over(F.col(size), F.col("close")))


def adx(s: Stage, n: int) -> Gen:
    up, down = s.col(F.col("high") - F.lag("high", 1).over(order())), s.col(F.lag("low", 1).over(order()) - F.col("low"))
    u, d = F.col(up), F.col(down)
    plus = s.col(F.when((u > d) & (u > 0), u).otherwise(0.0))
    minus = s.col(F.when((d > u) & (d > 0), d).otherwise(0.0))
    alpha = 1 / n
    size = yield ewm(_true_range(s), alpha, n)
    p = yield ewm(plus, alpha, n)
    m = yield ewm(minus, alpha, n)
    pdi, mdi = s.col(100 * over(F.col(p), F.col(size))), s.col(100 * over(F.col(m), F.col(size)))
    dx = s.col(100 * over(F.abs(F.col(pdi) - F.col(mdi)), F.col(pdi) + F.col(mdi)))
    out = yield ewm(dx, alpha, n)
    return s.col(F.least(F.greatest(F.col(out), F.lit(0.0)), F.lit(100.0)) + F.col(out) * 0)


def mfi(s: Stage, n: int) -> Gen:
    typical = s.col((F.col("high") + F.col("low") + F.col("close")) / 3)
    change = s.col(F.col(typical) - F.lag(typical, 1).over(order()))
    flow = F.col(typical) * F.col("volume")
    up, down = s.col(F.when(F.col(change) > 0, flow).otherwise(0.0)), s.col(F.when(F.col(change) < 0, flow).otherwise(0.0))
    a, b = s.col(guarded(F.sum, up, n)), s.col(guarded(F.sum, down, n))
    return s.col(100 - 100 / (1 + over(F.col(a), F.col(b))))
    yield


def _breakout(s: Stage, n: int, up: bool) -> str:
    edge = s.col(guarded(F.max if up else F.min, "high" if up else "low", n))
    before = s.lag(edge)
    hit = F.col("close") > F.col(before) if up else F.col("close") < F.col(before)
    event = s.col(F.when(F.coalesce(hit, F.lit(False)), 100.0).otherwise(0.0))
    return s.col(F.max(event).over(rows(max(1, min(n // 2, 8)))))


def breakout_up(s: Stage, n: int) -> Gen:
    return _breakout(s, n, True)
    yield


def breakout_down(s: Stage, n: int) -> Gen:
    return _breakout(s, n, False)
    yield


def rolling_rank(x: str, n: int, least: int) -> Column:
    """Average-tie percentile rank of the current value among the last ``n``."""
    seen = F.collect_list(x).over(rows(n))
    below, same = F.size(F.filter(seen, lambda v: v < F.col(x))), F.size(F.filter(seen, lambda v: v == F.col(x)))
    return F.when((F.count(x).over(rows(n)) >= least) & F.col(x).isNotNull(), (below + (same + 1) / 2) / F.size(seen))


def squeeze(s: Stage, n: int, k: float) -> Gen:
    width = yield from bbwidth(s, n, k)
    return s.col(100 * (1 - rolling_rank(width, 2 * n, n)))


def _oscillator(s: Stage, which: str, p: int) -> Gen:
    if which.upper() == "MFI":
        return (yield from mfi(s, p))
    if which.upper() == "STOCH_K":
        return (yield from stoch_k(s, p))
    return (yield from rsi(s, "close", p))


def trending(s: Stage, which: str, p: int, n: int) -> Gen:
    y = yield from _oscillator(s, which, p)
    at = s.col(F.row_number().over(order()).cast("double"))
    slope = F.when(F.count(y).over(rows(n)) >= n, F.regr_slope(F.col(y), F.col(at)).over(rows(n)))
    out = s.col(50 * over(slope, guarded(F.stddev_samp, y, n)))
    return s.col(F.when(F.col(out).isNotNull(), F.least(F.greatest(F.col(out), F.lit(-100.0)), F.lit(100.0))))


def _divergence(s: Stage, which: str, p: int, n: int, bull: bool) -> Gen:
    y = yield from _oscillator(s, which, p)
    edge = F.min if bull else F.max
    price, osc = s.lag(s.col(guarded(edge, "close", n))), s.lag(s.col(guarded(edge, y, n)))
    hit = (F.col("close") < F.col(price)) & (F.col(y) > F.col(osc)) if bull else (F.col("close") > F.col(price)) & (F.col(y) < F.col(osc))
    event = s.col(F.when(F.coalesce(hit, F.lit(False)), 100.0).otherwise(0.0))
    return s.col(F.max(event).over(rows(max(1, min(n // 2, 8)))))


def divergence_bull(s: Stage, which: str, p: int, n: int) -> Gen:
    return (yield from _divergence(s, which, p, n, True))


def divergence_bear(s: Stage, which: str, p: int, n: int) -> Gen:
    return (yield from _divergence(s, which, p, n, False))


def _z(s: Stage, x: str, n: int, least: int) -> str:
    mean, sd = s.col(guarded(F.avg, x, n, least)), s.col(guarded(F.stddev_samp, x, n, least))
    return s.col(over(F.col(x) - F.col(mean), F.col(sd)))


def funding_zscore(s: Stage, n: int) -> Gen:
    return _z(s, "funding_rate", n, max(1, n // 2))
    yield


def oi_change(s: Stage, n: int) -> Gen:
    return s.col(100 * (over(F.col("open_interest"), F.lag("open_interest", n).over(order())) - 1))
    yield


def oi_price_div(s: Stage, n: int) -> Gen:
    change = lambda x: over(F.col(x), F.lag(x, n).over(order())) - 1
    return _z(s, s.col(change("open_interest") - change("close")), 4 * n, n)
    yield


def ls_ratio_change(s: Stage, n: int) -> Gen:
    return _z(s, s.col(F.col("ls_ratio") - F.lag("ls_ratio", n).over(order())), 4 * n, n)
    yield


def taker_imbalance(s: Stage, n: int) -> Gen:
    return _z(s, s.col(guarded(F.avg, "taker_buy_sell_ratio", n)), 4 * n, n)
    yield


def _macd(s: Stage, fast: int, slow: int, signal: int) -> Gen:
    a = yield ewm("close", 2 / (fast + 1), fast)
    b = yield ewm("close", 2 / (slow + 1), slow)
    line = s.col(F.col(a) - F.col(b))
    mean = yield ewm(line, 2 / (signal + 1), signal)
    return f"{line} {mean}"


def macd_line(s: Stage, fast: int, slow: int, signal: int) -> Gen:
    return (yield from _macd(s, fast, slow, signal)).split()[0]


def macd_signal(s: Stage, fast: int, slow: int, signal: int) -> Gen:
    return (yield from _macd(s, fast, slow, signal)).split()[1]


def macd_hist(s: Stage, fast: int, slow: int, signal: int) -> Gen:
    line, mean = (yield from _macd(s, fast, slow, signal)).split()
    return s.col(F.col(line) - F.col(mean))


def bband_upper(s: Stage, n: int, k: float) -> Gen:
    mid, sd = _bands(s, n, k)
    return s.col(F.col(mid) + k * F.col(sd))
    yield


def bband_lower(s: Stage, n: int, k: float) -> Gen:
    mid, sd = _bands(s, n, k)
    return s.col(F.col(mid) - k * F.col(sd))
    yield


def volume_sma(s: Stage, n: int) -> Gen:
    return s.col(guarded(F.avg, "volume", n))
    yield


def atr_sma(s: Stage, n: int) -> Gen:
    return s.col(guarded(F.avg, _true_range(s), n))
    yield


#: call name to generator; extend with :func:`register`
INDICATORS: dict[str, Callable[..., Gen]] = {
    f.__name__.upper(): f
    for f in (
        sma, ema, rsi, atr, stoch_k, stoch_d, pct_b, macd_norm, price_pos, roc, vol_ratio, bbwidth, atr_pct, adx, mfi, breakout_up, breakout_down, squeeze, trending,
        divergence_bull, divergence_bear, funding_zscore, oi_change, oi_price_div, ls_ratio_change, taker_imbalance, macd_line, macd_signal, macd_hist, bband_upper,
        bband_lower, volume_sma, atr_sma,
    )
}


def register(name: str, fn: Callable[..., Gen]) -> None:
    INDICATORS[name.upper()] = fn


CALL = re.compile(r"\s*([A-Za-z_][A-Za-z_0-9]*)\s*(?:\((.*)\))?\s*$", re.S)


def split_arguments(text: str) -> list[str]:
    """Arguments at the top level of parentheses."""
    out, depth, now = [], 0, ""
    for c in text:
        depth += (c == "(") - (c == ")")
        if c == "," and depth == 0:
            out.append(now.strip())
            now = ""
        else:
            now += c
    return [*out, now.strip()] if now.strip() or out else out


def parse_call(text: str) -> tuple[str, tuple, str | None]:
    """(name, arguments, timeframe) of a call such as ``RSI(close,14,1h)``; raises ValueError for anything else."""
    m = CALL.match(text)
    if not m:
        raise ValueError(f"not an indicator call: {text!r}")
    parts = split_arguments(m[2]) if m[2] is not None else []
    frame = parts.pop() if parts and parts[-1] in ("15m", "1h", "4h", "1d") else None
    values = tuple(float(p) if re.fullmatch(r"-?\d*\.\d+", p) else int(p) if re.fullmatch(r"-?\d+", p) else p.lower() if p.lower() in ("open", "high", "low", "close", "volume") else p for p in parts)
    if m[1].upper() not in INDICATORS:
        raise ValueError(f"unknown indicator {m[1]!r}")
    return m[1].upper(), values, frame


def add(df: DataFrame, calls: dict[str, tuple[str, tuple]]) -> DataFrame:
    """``df`` with a column for each ``name: (indicator, arguments)``."""
    stage = Stage(df)
    running = {name: INDICATORS[fn](stage, *args) for name, (fn, args) in calls.items()}
    done: dict[str, str] = {}
    asked: dict[str, tuple[str, float, int]] = {}
    reply: dict[str, str | None] = dict.fromkeys(running)
    while running:
        for name, gen in list(running.items()):
            try:
                asked[name] = gen.send(reply[name])
            except StopIteration as end:
                done[name] = end.value
                del running[name]
                asked.pop(name, None)
        if asked:
            unique = {spec: stage.name() for spec in dict.fromkeys(asked.values())}
            stage.df = ewm_pass(stage.flush(), [(*spec, name) for spec, name in unique.items()])
            reply = {name: unique[spec] for name, spec in asked.items()}
            asked = {}
    return stage.flush().select(*stage.keep, *[F.col(done[n]).alias(n) for n in calls])
