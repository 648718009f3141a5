"""Streaming operators, run to the end of what is there."""

from __future__ import annotations

from pyspark.sql import functions as F

from barloom.operators.kernel import Rules
from barloom.plans.strategy import small_strategies
from barloom.queries import register
from barloom.queries import sql as S
from barloom.queries.backtests import SIGNAL
from barloom.queries.indicators import rnd
from barloom.sources import bars as B
from barloom.sources import cache
from barloom.streaming import live


def ticks(spark, sf_dir):
    """The walk prices as a file stream."""
    path = cache.fresh(spark, "ticks")
    px = B.walk_prices(B.table(spark, sf_dir, "events"))
    px.select("symbol", F.timestamp_micros("us").alias("ts"), "px").write.parquet(path)
    return spark.readStream.schema(live.TICK).parquet(path)


def bar_stream(spark, sf_dir):
    path = cache.fresh(spark, "bars")
    df = B.event_bars(spark, sf_dir)
    df.write.parquet(path)
    return spark.readStream.schema(df.schema).parquet(path)


def finished(spark, out):
    return live.run_to_end(out, cache.fresh(spark, "stream"), cache.fresh(spark, "checkpoint"))


_CLOSED = f"SELECT symbol, ts, {S.rnd('open')} AS open, {S.rnd('high')} AS high, {S.rnd('low')} AS low, {S.rnd('close')} AS close, volume FROM bars WHERE ts + 3600 <= (SELECT max(us)//1000000 - 3600 FROM px)"


@register("str_closed_candle", S.query(S.BARS, select=_CLOSED))
def str_closed_candle(spark, sf_dir):
    out = finished(spark, live.closed_candles(ticks(spark, sf_dir)))
    return out.select("symbol", "ts", *[rnd(c).alias(c) for c in ("open", "high", "low", "close")], "volume")


@register("str_new_candle_gate", S.query(S.BARS, select="SELECT symbol, count(*) AS n, max(ts) AS last FROM bars GROUP BY 1"))
def str_new_candle_gate(spark, sf_dir):
    bars = bar_stream(spark, sf_dir)
    doubled = bars.unionByName(bars)  # every candle arrives twice
    once = doubled.withColumn("at", F.timestamp_seconds("ts")).withWatermark("at", "40 days").dropDuplicates(["symbol", "at"]).drop("at")
    return finished(spark, once).groupBy("symbol").agg(F.count("*").alias("n"), F.max("ts").alias("last"))


MADE = small_strategies()
NAMES = ("s1", "s2", "s4")
LIVE = {k: MADE[k] for k in NAMES}
RULES = {k: Rules(x.direction, x.tp, x.sl or 1.5, x.trail, 0.0002, 48) for k, x in LIVE.items()}
TIGHT = live.Limits(weight=0.4, leverage=10.0, max_daily_loss=0.02, max_drawdown=0.1)


def live_signals(spark, sf_dir):
    """Bars in a stream of four files, strategies compiled and evaluated as they arrive."""
    path = cache.fresh(spark, "bars")
    df = B.event_bars(spark, sf_dir)
    first, last = df.agg(F.min("ts"), F.max("ts")).first()
    width = max(1, ((last or 0) - (first or 0)) // 4 + 1)
    for k in range(4):  # a file each, in order of time
        df.where(F.expr(f"(ts - {first or 0}) div {width}") == k).coalesce(1).write.mode("append").parquet(path)
    stream = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(path)
    return live.signals(stream, LIVE, B.HOUR, cache.fresh(spark, "live"), cache.fresh(spark, "checkpoint"))


_EDGE = S.staged("z", {"e1": f"sig AND NOT coalesce({S.lag('sig')}, false)", "e2": f"sig_short AND NOT coalesce({S.lag('sig_short')}, false)"}).replace("z AS", "ze AS", 1)


@register("str_signals", S.query(S.BARS, SIGNAL, _EDGE, select="SELECT symbol, ts, sig AS s1, sig_short AS s2, e1 AS new_s1, e2 AS new_s2 FROM ze"))
def str_signals(spark, sf_dir):
    return live_signals(spark, sf_dir).select("symbol", "ts", "s1", "s2", "new_s1", "new_s2")


def _intents(spark, sf_dir, limits=live.Limits(), control=None):  # noqa: B008
    path = cache.fresh(spark, "signals")
    rows = live_signals(spark, sf_dir)
    if control is not None:
        rows = rows.withColumn("close_all", control)
    rows.repartitionByRange(4, "ts").sortWithinPartitions("ts").write.parquet(path)
    return finished(spark, live.intents(spark.readStream.schema(rows.schema).parquet(path), RULES, limits))


@register("str_entry")
def str_entry(spark, sf_dir):
    return _intents(spark, sf_dir).where("intent = 'enter'").select("ts", "symbol", "strategy", rnd("price").alias("price"), rnd("notional", 4).alias("notional"))


@register("str_trailing")
def str_trailing(spark, sf_dir):
    return _intents(spark, sf_dir).where("intent = 'trail'").select("ts", "symbol", "strategy", rnd("stop").alias("stop"))


@register("str_pnl")
def str_pnl(spark, sf_dir):
    out = _intents(spark, sf_dir).where("intent like 'exit%'")
    return out.groupBy("strategy").agg(F.count("*").alias("trades"), F.count(F.when(F.col("pnl") > 0, 1)).alias("wins"), rnd(F.sum("pnl"), 4).alias("pnl"), rnd(F.avg((F.col("pnl") > 0).cast("double"))).alias("win_rate"))


@register("str_breakers")
def str_breakers(spark, sf_dir):
    """Halts of a portfolio under tight limits."""
    return _intents(spark, sf_dir, TIGHT).where("intent like 'halt%'").select("ts", "intent", rnd("capital", 4).alias("capital"))


@register("str_emergency")
def str_emergency(spark, sf_dir):
    """Control events, here at noon of every day, close what is open."""
    out = _intents(spark, sf_dir, control=F.col("ts") % 86400 == 43200)
    return out.where("intent = 'exit_emergency'").select("ts", "symbol", "strategy", rnd("price").alias("price"), rnd("pnl", 4).alias("pnl"))


@register("str_reconcile", S.query(S.BARS, select="SELECT symbol, CASE WHEN symbol = 'click' THEN 'gone' ELSE 'unknown' END AS status FROM (SELECT DISTINCT symbol FROM bars) WHERE symbol IN ('click', 'view')"))
def str_reconcile(spark, sf_dir):
    symbols = B.event_bars(spark, sf_dir).select("symbol").distinct()
    return live.reconcile(symbols.where("symbol <> 'view'"), symbols.where("symbol <> 'click'"))


_LAST = "SELECT symbol, ts, close FROM (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY ts DESC) AS rn FROM bars WHERE ts + 3600 <= (SELECT max(us)//1000000 - 3600 FROM px)) WHERE rn <= 50"


@register("src_live_candles", S.query(S.BARS, select=f"SELECT symbol, ts, {S.rnd('close')} AS close FROM ({_LAST})"))
def src_live_candles(spark, sf_dir):
    """The last fifty closed candles of a tick stream; the one that still forms is not among them."""
    return live.newest(finished(spark, live.closed_candles(ticks(spark, sf_dir))), 50).select("symbol", "ts", rnd("close").alias("close"))
