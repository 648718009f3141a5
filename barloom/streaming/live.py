"""The live loop on Structured Streaming: closed candles, compiled strategies on each new bar, one portfolio with exact state."""

from __future__ import annotations

import dataclasses
import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from barloom.operators.kernel import Rules
from barloom.plans.strategy import Strategy, with_signals
from barloom.sources import cache

TICK = "symbol string, ts timestamp, px double"
LOOKBACK = 672  # bars of each symbol that strategies are evaluated on when a new one arrives


def closed_candles(ticks: DataFrame, minutes: int = 60) -> DataFrame:
    """Tumbling bars of a stream ``symbol, ts, px``; a bar comes out once the watermark, one bar behind, has passed its end."""
    at = F.window("ts", f"{minutes} minutes")
    bars = ticks.withWatermark("ts", f"{minutes} minutes").groupBy("symbol", at).agg(
        F.min_by("px", "ts").alias("open"), F.max("px").alias("high"), F.min("px").alias("low"), F.max_by("px", "ts").alias("close"), F.count("*").cast("double").alias("volume")
    )
    return bars.select("symbol", F.col("window.start").cast("bigint").alias("ts"), "open", "high", "low", "close", "volume")


def newest(bars: DataFrame, n: int) -> DataFrame:
    """The last ``n`` bars of each symbol."""
    place = F.row_number().over(W.partitionBy("symbol").orderBy(F.desc("ts")))
    return bars.withColumn("_n", place).where(F.col("_n") <= n).drop("_n")


def signals(bars: DataFrame, strategies: dict[str, Strategy], seconds: int, path: str, checkpoint: str, lookback: int = LOOKBACK) -> DataFrame:
    """Strategies on each bar as it arrives: a batch's bars join the tail that is kept of those before, and only the new bars' rows
    are written. A batch that runs again overwrites what it wrote. Returns the written table, with ``atr`` and the symbol's
    latest signals; ``new_<name>`` tells where a signal begins."""
    spark = bars.sparkSession
    schema = bars.schema

    def batch(new: DataFrame, number: int) -> None:
        new = new.dropDuplicates(["symbol", "ts"]).persist()
        try:
            before = spark.read.schema(schema).parquet(f"{path}/tail/{number - 1}") if number and cache.exists(spark, f"{path}/tail/{number - 1}") else new.where("false")
            new_ = new.join(before.groupBy("symbol").agg(F.max("ts").alias("_last")), "symbol", "left").where("_last is null or ts > _last").drop("_last")
            every = before.select(*schema.names).unionByName(new_.select(*schema.names))
            out = with_signals(every, strategies, seconds, {"atr": ("ATR", (14,))})
            for name in strategies:
                was = F.lag(name, 1).over(W.partitionBy("symbol").orderBy("ts"))
                out = out.withColumn(f"new_{name}", F.col(name) & ~F.coalesce(was, F.lit(False)))
            out = out.join(new_.select("symbol", "ts"), ["symbol", "ts"], "left_semi")
            out.write.mode("overwrite").parquet(f"{path}/signals/batch={number}")
            newest(every, lookback).write.mode("overwrite").parquet(f"{path}/tail/{number}")
        finally:
            new.unpersist()

    query = bars.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    try:
        query.awaitTermination()
    finally:
        query.stop()
    return spark.read.option("basePath", f"{path}/signals").parquet(f"{path}/signals").drop("batch")


# one portfolio

@dataclasses.dataclass(frozen=True)
class Limits:
    """What a portfolio may do; shares are of its capital."""

    capital: float = 1000.0
    weight: float = 0.2  # of the capital a position's margin takes
    leverage: float = 5.0
    max_positions: int = 3
    min_order: float = 10.0
    max_drawdown: float = 0.2
    max_daily_loss: float = 0.05
    cost: float = 0.0002


INTENT = "ts bigint, symbol string, strategy string, intent string, price double, notional double, pnl double, capital double, stop double"


class Portfolio:
    """Positions by (strategy, symbol) of compiled strategies under common limits. The state is plain data, so it can be kept anywhere."""

    def __init__(self, rules: dict[str, Rules], limits: Limits, state: dict | None = None):
        self.rules, self.limits = rules, limits
        self.state = state or {"capital": limits.capital, "peak": limits.capital, "day": None, "day_start": limits.capital, "halted": "", "open": {}, "last": {}, "trades": 0, "wins": 0}

    def _close(self, key: str, bar: dict, raw: float, kind: str) -> tuple:
        s, p = self.state, self.state["open"].pop(key)
        name, symbol = key.split("|", 1)
        side = 1 if self.rules[name].direction == "LONG" else -1
        price = raw * (1 - side * self.limits.cost)
        pnl = p["notional"] * side * (price - p["entry"]) / p["entry"]
        s["capital"] += pnl
        s["peak"] = max(s["peak"], s["capital"])
        s["trades"], s["wins"] = s["trades"] + 1, s["wins"] + (pnl > 0)
        return bar["ts"], symbol, name, kind, price, p["notional"], pnl, s["capital"], p["stop"]

    def _manage(self, key: str, bar: dict) -> Iterator[tuple]:
        """Ratchet the stop by the close's best, then leave at stop, target or time."""
        p, r = self.state["open"][key], self.rules[key.split("|", 1)[0]]
        side = 1 if r.direction == "LONG" else -1
        p["bars"] += 1
        adverse, favour = (bar["low"], bar["high"]) if side > 0 else (bar["high"], bar["low"])
        if side * (adverse - p["stop"]) <= 0:
            yield self._close(key, bar, p["stop"], "exit_stop")
        elif r.tp > 0 and side * (favour - p["target"]) >= 0:
            yield self._close(key, bar, p["target"], "exit_target")
        elif p["bars"] >= r.hold:
            yield self._close(key, bar, bar["close"], "exit_time")
        elif r.trail > 0:
            p["best"] = max(p["best"], bar["close"]) if side > 0 else min(p["best"], bar["close"])
            stop = p["best"] - side * r.trail * p["size"]
            if side * (stop - p["stop"]) > 0:
                p["stop"] = stop
                yield bar["ts"], bar["symbol"], key.split("|", 1)[0], "trail", bar["close"], p["notional"], 0.0, self.state["capital"], stop

    def _breakers(self, ts: int) -> Iterator[tuple]:
        s, limits = self.state, self.limits
        if s["halted"]:
            return
        if s["capital"] < s["peak"] * (1 - limits.max_drawdown):
            s["halted"] = "portfolio_drawdown"
        elif s["capital"] - s["day_start"] < -limits.max_daily_loss * limits.capital:
            s["halted"] = "daily_loss"
        if s["halted"]:
            yield ts, "", "", f"halt_{s['halted']}", 0.0, 0.0, 0.0, s["capital"], 0.0

    def _enter(self, name: str, bar: dict) -> Iterator[tuple]:
        s, limits, r = self.state, self.limits, self.rules[name]
        key = f"{name}|{bar['symbol']}"
        notional = s["capital"] * limits.weight * limits.leverage
        if s["halted"] or key in s["open"] or len(s["open"]) >= limits.max_positions or notional < limits.min_order or not bar["atr"] or not bar["atr"] > 0:
            return
        side = 1 if r.direction == "LONG" else -1
        entry = bar["close"] * (1 + side * limits.cost)
        stop = entry - side * r.sl * bar["atr"]
        s["open"][key] = {"entry": entry, "stop": stop, "target": entry + side * r.tp * bar["atr"], "best": bar["close"], "size": bar["atr"], "notional": notional, "bars": 0}
        yield bar["ts"], bar["symbol"], name, "enter", entry, notional, 0.0, s["capital"], stop

    def step(self, ts: int, bars: list[dict]) -> list[tuple]:
        """What to do at one time, when all symbols' bars of that time are known: exits, breakers, entries. A bar seen before does
        nothing. A bar with ``close_all`` is a control event: its symbol's positions are closed at once and nothing is opened."""
        s, out = self.state, []
        fresh = [b for b in sorted(bars, key=lambda b: b["symbol"]) if s["last"].get(b["symbol"], -1) < ts]
        if s["day"] != ts // 86400:
            s["day"], s["day_start"] = ts // 86400, s["capital"]
            if s["halted"] == "daily_loss":
                s["halted"] = ""
        for bar in fresh:
            s["last"][bar["symbol"]] = ts
            for key in sorted(k for k in s["open"] if k.split("|", 1)[1] == bar["symbol"]):
                out += [self._close(key, bar, bar["close"], "exit_emergency")] if bar.get("close_all") else self._manage(key, bar)
        out += self._breakers(ts)
        for bar in fresh:
            for name in self.rules:
                if bar.get(f"new_{name}") and not bar.get("close_all"):
                    out += self._enter(name, bar)
        return out


def _steps(portfolio: Portfolio, rows: list[dict]) -> Iterator[tuple]:
    """All intents of ``rows`` in order of time."""
    times: dict[int, list[dict]] = {}
    for row in rows:
        times.setdefault(int(row["ts"]), []).append(row)
    for ts in sorted(times):
        yield from portfolio.step(ts, times[ts])


def intents(rows: DataFrame, rules: dict[str, Rules], limits: Limits = Limits()) -> DataFrame:  # noqa: B008
    """What one portfolio does on a stream of bars with signals (``symbol, ts, high, low, close, atr, new_<name>`` and, if there,
    ``close_all``). Its limits are common to all symbols, so it is one sequence with one state; bars are few beside ticks."""
    names = [c for c in rows.columns if c in ("symbol", "ts", "high", "low", "close", "atr", "close_all") or c.startswith("new_")]

    def run(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        portfolio = Portfolio(rules, limits, json.loads(state.get[0]) if state.exists else None)
        out = list(_steps(portfolio, [r for batch in batches for r in batch.to_dict("records")]))
        state.update((json.dumps(portfolio.state),))
        yield pd.DataFrame(out, columns=[c.split()[0] for c in INTENT.split(", ")])

    one = rows.select(F.lit("portfolio").alias("portfolio"), *names)
    return one.groupBy("portfolio").applyInPandasWithState(run, INTENT, "json string", "append", GroupStateTimeout.NoTimeout)


def reconcile(state: DataFrame, held: DataFrame) -> DataFrame:
    """``symbol, status`` of positions on one side only: ``gone`` at the exchange or ``unknown`` to the state."""
    both = state.select("symbol", F.lit(True).alias("ours")).join(held.select("symbol", F.lit(True).alias("theirs")), "symbol", "full")
    return both.where("ours is null or theirs is null").select("symbol", F.when(F.col("theirs").isNull(), "gone").otherwise("unknown").alias("status"))


def run_to_end(out: DataFrame, path: str, checkpoint: str) -> DataFrame:
    """Everything that is there now, through a file sink: the table below ``path``."""
    query = out.writeStream.format("parquet").option("path", path).outputMode("append").option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    try:
        query.awaitTermination()
    finally:
        query.stop()
    return out.sparkSession.read.schema(out.schema).parquet(path)
