"""Back-tests as grouped maps over (window, symbol): a series is sequential and read once for all strategies; all series run side by side."""

from __future__ import annotations

import itertools

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from barloom.operators.kernel import Rules, run

TRADE = (
    "strategy_id string, window_id string, symbol string, entry_ts bigint, exit_ts bigint, entry_bar bigint, exit_bar bigint, "
    "entry_price double, exit_price double, pnl double, kind string, bars_held bigint, equity double"
)
CURVE = "strategy_id string, window_id string, symbol string, ts bigint, equity double"


BARS = ["ts", "high", "low", "close", "atr"]
SPLITS = 10  # splits that one task runs over a series
CHUNK = 250  # strategies of a population that one task runs over a series


def bar_form(signals: DataFrame, names: list[str], window: Column | None = None) -> DataFrame:
    """One row a bar: its window and symbol, prices, and a boolean column for each strategy; bars aren't repeated for strategies."""
    at = (window if window is not None else F.lit("all")).alias("window_id")
    return signals.select(at, "symbol", "ts", *[F.col(c).cast("double").alias(c) for c in BARS[1:]], *[F.coalesce(F.col(n), F.lit(False)).alias(n) for n in names])


def _series(table: pa.Table) -> tuple[pa.Table, list[np.ndarray]]:
    table = table.take(pc.sort_indices(table, [("ts", "ascending")]))
    return table, [table.column(c).to_numpy() for c in BARS]


def _trade_rows(key: tuple[str, str], names: list[str], rules: dict[str, Rules], arrays: list[np.ndarray], signal) -> list[tuple]:
    ts, high, low, close, atr = arrays
    rows = []
    for name in names:
        _, done = run(high, low, close, atr, signal(name), rules[name])
        rows += [(name, *key, int(ts[t.entry]), int(ts[t.exit]), t.entry, t.exit, t.entry_price, t.exit_price, t.pnl, t.kind, t.exit - t.entry, t.equity) for t in done]
    return rows


_KINDS = {"string": pa.string(), "bigint": pa.int64(), "double": pa.float64()}


def _table(rows: list[tuple], schema: str) -> pa.Table:
    fields = [x.split() for x in schema.split(", ")]
    columns = list(zip(*rows, strict=True)) or [()] * len(fields)
    return pa.table([pa.array(c, _KINDS[k]) for c, (_, k) in zip(columns, fields, strict=True)], names=[n for n, _ in fields])


def trades(rows: DataFrame, rules: dict[str, Rules]) -> DataFrame:
    """The trades of each strategy of ``rules`` on each (window, symbol) of :func:`bar_form` rows."""

    def one(key: tuple, table: pa.Table) -> pa.Table:
        table, arrays = _series(table)
        signal = lambda name: table.column(name).to_numpy()
        return _table(_trade_rows((key[0].as_py(), key[1].as_py()), list(rules), rules, arrays, signal), TRADE)

    return rows.groupBy("window_id", "symbol").applyInArrow(one, TRADE)


def curves(rows: DataFrame, rules: dict[str, Rules]) -> DataFrame:
    """Equity after each bar of each strategy of ``rules``."""

    def one(key: tuple, table: pa.Table) -> pa.Table:
        table, (ts, high, low, close, atr) = _series(table)
        names = [k for k in rules for _ in range(len(ts))]
        equity = [run(high, low, close, atr, table.column(name).to_numpy(), rules[name])[0] for name in rules]
        columns = [pa.array(names, pa.string()), *[pa.array([x.as_py()] * len(names), pa.string()) for x in key], pa.array(np.tile(ts, len(rules))), pa.array(np.concatenate(equity))]
        return pa.table(columns, names=[c.split()[0] for c in CURVE.split(", ")])

    return rows.groupBy("window_id", "symbol").applyInArrow(one, CURVE)


def split_trades(rows: DataFrame, rules: dict[str, Rules], groups: int, held_out: int, embargo: int) -> DataFrame:
    """The trades on the test bars of every way to hold out ``held_out`` of ``groups`` groups (``grp`` of each bar), one after another;
    the window is the split's number. A test group behind a training group loses its first ``embargo`` bars.

    Splits are masks on one series, so bars aren't repeated for them; a series goes to a task once for each ``SPLITS`` splits.
    """
    ways = list(enumerate(itertools.combinations(range(groups), held_out)))
    chunks = [ways[k : k + SPLITS] for k in range(0, len(ways), SPLITS)]
    part = F.explode(F.sequence(F.lit(0), F.lit(len(chunks) - 1)))
    names = list(rules)
    rows = rows.select("symbol", "ts", "grp", *[F.col(c).cast("double").alias(c) for c in BARS[1:]], *[F.coalesce(F.col(n), F.lit(False)).alias(n) for n in names]).withColumn("part", part)

    def one(key: tuple, table: pa.Table) -> pa.Table:
        table, arrays = _series(table)
        grp = table.column("grp").to_numpy()
        place = np.arange(len(grp)) - np.searchsorted(grp, grp)  # groups follow one another in time
        out = []
        for number, test in chunks[key[1].as_py()]:
            is_test = np.zeros(groups + 1, bool)  # the last one stands before the first group
            is_test[list(test)] = True
            behind = (grp > 0) & ~is_test[grp - 1]
            keep = is_test[grp] & ~(behind & (place < embargo))
            signal = lambda name, keep=keep: table.column(name).to_numpy()[keep]
            if keep.any():
                out += _trade_rows((str(number), key[0].as_py()), names, rules, [a[keep] for a in arrays], signal)
        return _table(out, TRADE)

    return rows.groupBy("symbol", "part").applyInArrow(one, TRADE)


def population_trades(bars: DataFrame, strategies: dict, rules: dict[str, Rules], seconds: int) -> DataFrame:
    """The trades of many strategies on all symbols of ``bars``.

    Bars go to their group once for each ``CHUNK`` strategies; longer timeframes, indicators, conditions, signals and positions are
    array operations there, each computed once for all strategies that name it. Indicators without an array form
    (those registered from outside) come as Spark columns.
    """
    from barloom.functions.arrays import ARRAYS, PRICES, Frames
    from barloom.plans.strategy import array_signals, calls, indicator_columns

    sides, wanted = calls(strategies, bars.columns, seconds)
    arrays = all(name in ARRAYS for name, _, _ in wanted.values())
    if arrays:
        df = bars
    else:
        df, sides = indicator_columns(bars, strategies, seconds, {"atr": ("ATR", (14,))})
        wanted = {}
    used = sorted({c for c in sides.values() if isinstance(c, str)} - set(wanted))
    columns = [*(PRICES if arrays else BARS[1:]), *used]
    names = list(strategies)
    chunks = [names[k : k + CHUNK] for k in range(0, len(names), CHUNK)]
    part = F.explode(F.sequence(F.lit(0), F.lit(len(chunks) - 1)))
    rows = df.select("symbol", "ts", *[F.col(c).cast("double").alias(c) for c in dict.fromkeys(columns)]).withColumn("part", part)

    def one(key: tuple, table: pa.Table) -> pa.Table:
        table = table.take(pc.sort_indices(table, [("ts", "ascending")]))
        got = {c: table.column(c).to_numpy() for c in table.column_names if c not in ("symbol", "part")}
        frames = Frames(got["ts"], got)
        column = lambda c: frames.value(*wanted[c]) if c in wanted else got[c]
        series = [got[c] if c in got else frames.value("ATR", (14,), None) for c in BARS]
        rows_ = _trade_rows(("all", key[0].as_py()), chunks[key[1].as_py()], rules, series, array_signals(strategies, sides, column))
        return _table(rows_, TRADE)

    return rows.groupBy("symbol", "part").applyInArrow(one, TRADE)


# stateless pieces of the machine, as columns

def costed(price: Column, direction: str, entry: bool, cost: float) -> Column:
    """A price after costs: worse for the holder on either side."""
    up = (direction == "LONG") == entry
    return price * (1 + cost if up else 1 - cost)


def exit_levels(entry: Column, atr: Column, direction: str, tp: float, sl: float) -> tuple[Column, Column]:
    side = 1 if direction == "LONG" else -1
    return entry - side * sl * atr, entry + side * tp * atr


def exit_kind(high: Column, low: Column, stop: Column, target: Column, direction: str) -> Column:
    """``stop`` before ``target`` where a bar touches both; NULL if neither."""
    stopped, reached = (low <= stop, high >= target) if direction == "LONG" else (high >= stop, low <= target)
    return F.when(stopped, "stop").when(reached, "target")


def position_size(equity: Column, risk: float, entry: Column, stop: Column, leverage: float, margin_cap: float = 0.95) -> tuple[Column, Column, Column]:
    """(notional, margin, contracts): the risked money over the stop's distance, within leverage and margin."""
    distance = F.abs(entry - stop) / entry
    notional = F.least(equity * risk / F.nullif(distance, F.lit(0.0)), equity * leverage, equity * margin_cap * leverage)
    return notional, notional / leverage, notional / entry


def compounded(trades_: DataFrame, start: float, keys: list[str], order: str = "exit_ts") -> DataFrame:
    """``usd`` after each trade, from ``start`` and the trades' shares; a trade never loses everything."""
    w = W.partitionBy(*keys).orderBy(order).rowsBetween(W.unboundedPreceding, 0)
    return trades_.withColumn("usd", start * F.exp(F.sum(F.log(1 + F.col("pnl"))).over(w)))
