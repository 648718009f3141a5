"""Figures of equity curves ``(keys, ts, equity)`` and of trades, as plain aggregates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def returns(curve: DataFrame, keys: list[str], value: str = "equity") -> DataFrame:
    """Adds ``r`` (NULL on the first point) and ``dd``, the drawdown from the peak so far."""
    w = W.partitionBy(*keys).orderBy("ts")
    peak = F.max(value).over(w.rowsBetween(W.unboundedPreceding, 0))
    return curve.withColumn("r", F.col(value) / F.nullif(F.lag(value, 1).over(w), F.lit(0.0)) - 1).withColumn("dd", (F.col(value) - peak) / peak)


def cagr(value: str, periods: float) -> Column:
    """Growth a year; the exponent counts points."""
    return F.pow(F.max_by(value, "ts") / F.min_by(value, "ts"), F.lit(float(periods)) / F.count("*")) - 1


def ulcer() -> Column:
    return F.sqrt(F.avg(F.col("dd") * F.col("dd")))


def sharpe(periods: float, rf: float = 0.0) -> Column:
    sd = F.stddev_samp("r")
    return F.coalesce(F.when(sd > 0, (F.avg("r") * periods - rf) / (sd * periods**0.5)), F.lit(0.0))


def sortino(periods: float) -> Column:
    """Over the sample deviation of losses; 999 with no loss, or only one."""
    sd = F.stddev_samp(F.when(F.col("r") < 0, F.col("r")))
    return F.when(sd > 0, F.avg("r") / sd * periods**0.5).otherwise(999.0)


def sortino_rms(periods: float) -> Column:
    """Over the root mean square of losses: another number under the same name elsewhere."""
    rms = F.sqrt(F.avg(F.when(F.col("r") < 0, F.col("r") * F.col("r"))))
    return F.when(rms > 0, F.avg("r") / rms * periods**0.5).otherwise(0.0)


def calmar(growth: Column, worst: Column) -> Column:
    return F.when(growth <= 0, 0.0).when(worst >= -0.01, growth * 100).otherwise(growth / F.abs(worst))


def upi(growth: Column, index: Column) -> Column:
    return F.when(index > 0, growth / index).otherwise(F.when(growth > 0, 100.0).otherwise(0.0))


def bundle(curve: DataFrame, keys: list[str], periods: float, value: str = "equity") -> DataFrame:
    """All curve figures in one aggregation after one window pass."""
    out = returns(curve, keys, value).groupBy(*keys).agg(
        F.count("*").alias("n"), cagr(value, periods).alias("cagr"), F.min("dd").alias("max_dd"), ulcer().alias("ulcer"), sharpe(periods).alias("sharpe"), sortino(periods).alias("sortino"),
        sortino_rms(periods).alias("sortino_rms"), (F.stddev_samp("r") * periods**0.5).alias("volatility"), (F.max_by(value, "ts") / F.min_by(value, "ts") - 1).alias("total_return"),
        F.avg(F.when(F.col("r").isNotNull(), (F.col("r") > 0).cast("double"))).alias("win_rate"),
        F.sum(F.when(F.col("r") > 0, F.col("r"))).alias("gain"), (-F.sum(F.when(F.col("r") < 0, F.col("r")))).alias("loss"),
    )
    out = out.withColumn("calmar", calmar(F.col("cagr"), F.col("max_dd"))).withColumn("upi", upi(F.col("cagr"), F.col("ulcer")))
    return out.withColumn("profit_factor", profit_factor(F.col("gain"), F.col("loss"))).drop("gain", "loss")


def profit_factor(gain: Column, loss: Column, none: float = 999.0) -> Column:
    return F.when(F.coalesce(loss, F.lit(0.0)) > 0, F.coalesce(gain, F.lit(0.0)) / loss).otherwise(none)


def trade_figures(trades: DataFrame, keys: list[str], pnl: str = "pnl") -> DataFrame:
    """``n_trades, win_rate, profit_factor, expectancy, avg_win, avg_loss`` by key; the loss has a floor of 1e-10."""
    p = F.col(pnl)
    out = trades.groupBy(*keys).agg(
        F.count("*").alias("n_trades"), F.count(F.when(p > 0, 1)).alias("wins"), F.coalesce(F.sum(F.when(p > 0, p)), F.lit(0.0)).alias("won"), F.abs(F.coalesce(F.sum(F.when(p < 0, p)), F.lit(0.0))).alias("lost")
    )
    out = out.withColumn("win_rate", F.col("wins") / F.col("n_trades")).withColumn("profit_factor", F.col("won") / F.greatest("lost", F.lit(1e-10)))
    out = out.withColumn("avg_win", F.col("won") / F.greatest("wins", F.lit(1))).withColumn("avg_loss", F.col("lost") / F.greatest(F.col("n_trades") - F.col("wins"), F.lit(1)))
    return out.withColumn("expectancy", F.col("win_rate") * F.col("avg_win") - (1 - F.col("win_rate")) * F.col("avg_loss"))


def composite(sortino_: Column, ret_pct: Column, dd: Column, pf: Column, expectancy: Column) -> Column:
    """A window's fitness: capped Sortino with bonuses for growth, drawdown, profit factor and expectancy."""
    grow = F.greatest(ret_pct / 100, F.lit(0.0)) * 10
    ratio = F.when(ret_pct > 0, (ret_pct / 100) / F.greatest(F.abs(dd), F.lit(0.01))).otherwise(0.0)
    return (
        F.least(sortino_, F.lit(5.0)) + grow + F.greatest(F.least(ratio, F.lit(5.0)), F.lit(0.0)) * 0.3 + F.when(pf > 1, F.least(pf - 1, F.lit(3.0))).otherwise(0.0)
        + F.when(expectancy > 0, F.least(F.greatest(expectancy + 0.5 - 1, F.lit(0.0)), F.lit(3.0))).otherwise(0.0)
    )


def objectives(windows: DataFrame, key: str = "strategy_id") -> DataFrame:
    """``obj1``: the upper median of ``composite`` less 0.3 of a negative worst; ``obj2``: the share of windows with a positive Sortino; ``stability``."""
    out = windows.groupBy(key).agg(
        F.sort_array(F.collect_list("composite")).alias("c"), F.avg((F.col("sortino") > 0).cast("double")).alias("obj2"), F.coalesce(-F.stddev_samp("sortino"), F.lit(0.0)).alias("stability")
    )
    return out.select(key, (F.expr("get(c, size(c) div 2)") - F.greatest(-F.expr("get(c, 0)"), F.lit(0.0)) * 0.3).alias("obj1"), "obj2", "stability")


def correlations(rows: DataFrame, key: str = "symbol", at: str = "ts", value: str = "r") -> DataFrame:
    """``a, b, corr`` over the shared times of every pair of series with a < b."""
    left = rows.select(F.col(key).alias("a"), at, F.col(value).alias("x"))
    right = rows.select(F.col(key).alias("b"), at, F.col(value).alias("y"))
    return left.join(right, at).where("a < b").groupBy("a", "b").agg(F.coalesce(F.corr("x", "y"), F.lit(0.0)).alias("corr"))


def moments(df: DataFrame, keys: list[str], x: str) -> DataFrame:
    """Mean, deviation, and bias-corrected skew and excess kurtosis."""
    out = df.where(F.col(x).isNotNull()).groupBy(*keys).agg(F.count("*").cast("double").alias("n"), F.avg(x).alias("mean"), F.stddev_samp(x).alias("sd"), F.skewness(x).alias("g1"), F.kurtosis(x).alias("g2"))
    n = F.col("n")
    skew = F.when(n > 2, F.col("g1") * F.sqrt(n * (n - 1)) / (n - 2))
    kurt = F.when(n > 3, (n - 1) / ((n - 2) * (n - 3)) * ((n + 1) * F.col("g2") + 6))
    return out.select(*keys, "mean", "sd", skew.alias("skew"), kurt.alias("kurt"))


def histogram(df: DataFrame, keys: list[str], x: str, bins: int) -> DataFrame:
    """``bin, n`` of equal widths between each key's least and greatest value; the greatest falls into the last bin.

    The bounds come from the very rows that are counted: computed a second time, sums in another order could move them past a row.
    """
    by = W.partitionBy(*keys)
    for c in [*keys, x]:
        df = df.where(F.col(c).isNotNull())
    df = df.select(*keys, F.col(x).alias("_x"), F.min(x).over(by).alias("_lo"), F.max(x).over(by).alias("_hi"))
    at = F.least(F.floor((F.col("_x") - F.col("_lo")) / F.nullif(F.col("_hi") - F.col("_lo"), F.lit(0.0)) * bins), F.lit(bins - 1))
    return df.groupBy(*keys, F.coalesce(at, F.lit(0)).cast("bigint").alias("bin")).agg(F.count("*").alias("n"))
