"""Bar tables: ``symbol string, ts bigint, open, high, low, close, volume double``.

``ts`` is the bar's start in epoch seconds, so no session time zone can move it. A bar table is ordered by
(symbol, ts); every operator that needs order says so in its window.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

HOUR, DAY = 3600, 86400
TIMEFRAMES = {"1m": 60, "5m": 300, "15m": 900, "30m": 1800, "1h": HOUR, "4h": 4 * HOUR, "1d": DAY}
OHLCV = ["open", "high", "low", "close", "volume"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def epoch_micros(ts: Column | str) -> Column:
    """Microseconds since 1970 of a zone-less timestamp."""
    return F.timestamp_diff("MICROSECOND", F.expr("timestamp_ntz'1970-01-01 00:00:00'"), F.col(ts) if isinstance(ts, str) else ts)


def bucket(ts: Column, seconds: int) -> Column:
    return ts - F.pmod(ts, F.lit(seconds))


def walk_prices(events: DataFrame, all_symbols: bool = False) -> DataFrame:
    """``symbol, us, event_id, px``: a price walk from event values, 100 at the start of each symbol."""
    symbol = F.lit("ALL") if all_symbols else F.col("event_type")
    ev = events.select(symbol.alias("symbol"), epoch_micros("ts").alias("us"), "event_id", "value")
    by = W.partitionBy("symbol")
    ev = ev.withColumn("m", F.avg("value").over(by))
    step = (F.col("value") - F.col("m")) / F.col("m")
    return ev.select("symbol", "us", "event_id", (100 * F.exp(0.004 * F.sum(step).over(by.orderBy("us", "event_id")))).alias("px"))


def tumble(px: DataFrame, seconds: int, price: str = "px", order: list[str] | None = None) -> DataFrame:
    """Tumbling bars of ticks ``symbol, us, price``; volume is the number of ticks. Empty buckets give no bar."""
    at = F.struct(*(order or ["us", "event_id"]))
    return px.groupBy("symbol", bucket(F.floor(F.col("us") / 1_000_000), seconds).alias("ts")).agg(
        F.min_by(price, at).alias("open"),
        F.max(price).alias("high"),
        F.min(price).alias("low"),
        F.max_by(price, at).alias("close"),
        F.count("*").cast("double").alias("volume"),
    )


def event_bars(spark: SparkSession, sf_dir: str, seconds: int = HOUR, all_symbols: bool = False) -> DataFrame:
    return tumble(walk_prices(table(spark, sf_dir, "events"), all_symbols), seconds)


def order_bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Daily bars of raw order prices by priority."""
    orders = table(spark, sf_dir, "orders")
    ticks = orders.select(F.col("o_orderpriority").alias("symbol"), epoch_micros("o_orderdate").alias("us"), F.col("o_orderkey").alias("event_id"), F.col("o_totalprice").alias("px"))
    return tumble(ticks, DAY)


def fill_calendar(bars: DataFrame, seconds: int, carry: bool = False) -> DataFrame:
    """A row for every calendar bucket between a symbol's first and last bar; empty ones have NULL prices and volume 0."""
    span = bars.groupBy("symbol").agg(F.min("ts").alias("a"), F.max("ts").alias("b"))
    grid = span.select("symbol", F.explode(F.sequence("a", "b", F.lit(seconds).cast("bigint"))).alias("ts"))
    out = grid.join(bars, ["symbol", "ts"], "left").withColumn("volume", F.coalesce("volume", F.lit(0.0)))
    return out


def resample(bars: DataFrame, seconds: int) -> DataFrame:
    """Bars of a longer timeframe, gaps kept as empty buckets (NULL prices, volume 0)."""
    up = bars.groupBy("symbol", bucket(F.col("ts"), seconds).alias("ts")).agg(
        F.min_by("open", "ts").alias("open"), F.max("high").alias("high"), F.min("low").alias("low"), F.max_by("close", "ts").alias("close"), F.sum("volume").alias("volume")
    )
    return fill_calendar(up, seconds)


def align(base: DataFrame, higher: DataFrame, seconds: int, columns: list[str]) -> DataFrame:
    """``columns`` of a longer timeframe on base bars, from the last bucket that had ended: no look-ahead."""
    w = W.partitionBy("symbol").orderBy("ts")
    past = higher.select("symbol", F.col("ts").alias("_bucket"), *[F.lag(c, 1).over(w).alias(c) for c in columns])
    return base.withColumn("_bucket", bucket(F.col("ts"), seconds)).join(past, ["symbol", "_bucket"], "left").drop("_bucket")


def asof_backward(left: DataFrame, right: DataFrame, value: str) -> DataFrame:
    """The latest ``value`` of ``right`` at or before each left row, by symbol: one union, one window."""
    mark = left.withColumn(value, F.lit(None).cast("double")).withColumn("_right", F.lit(0))
    cols = mark.columns
    other = right.select("symbol", "ts", value).withColumn("_right", F.lit(-1))
    both = mark.unionByName(other, allowMissingColumns=True).select(*cols)
    w = W.partitionBy("symbol").orderBy("ts", "_right").rowsBetween(W.unboundedPreceding, 0)
    return both.withColumn(value, F.last(value, ignorenulls=True).over(w)).where("_right = 0").drop("_right")


def side_series(spark: SparkSession, sf_dir: str, hours: int = 8) -> DataFrame:
    """A funding-like series: the mean of raw event values by bucket less the mean of all, over 1000."""
    ev = table(spark, sf_dir, "events").select(F.col("event_type").alias("symbol"), F.floor(epoch_micros("ts") / 1_000_000).alias("s"), "value")
    mean = ev.agg(F.avg("value").alias("m"))
    out = ev.groupBy("symbol", bucket(F.col("s"), hours * HOUR).alias("ts")).agg(F.avg("value").alias("v"))
    return out.crossJoin(mean).select("symbol", "ts", ((F.col("v") - F.col("m")) / 1000).alias("funding_rate"))


def dedup_first(df: DataFrame, keys: list[str], arrival: str) -> DataFrame:
    """The first row to arrive of each key."""
    w = W.partitionBy(*keys).orderBy(arrival)
    return df.withColumn("_rn", F.row_number().over(w)).where("_rn = 1").drop("_rn")
