"""Resampling tests and significance figures. Randomness is a hash of (seed, iteration, index), so every engine draws the same."""

from __future__ import annotations

import math

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from barloom.operators.distributions import normal_cdf, student_upper
from barloom.operators.splits import hashed


def numbered(rows: DataFrame, keys: list[str], order: str, value: str) -> DataFrame:
    """``keys, i, x``: values by place from 0."""
    w = W.partitionBy(*keys) if keys else W.partitionBy(F.lit(1))
    return rows.where(F.col(value).isNotNull()).select(*keys, (F.row_number().over(w.orderBy(order)) - 1).cast("bigint").alias("i"), F.col(value).alias("x"))


def block_draws(series: DataFrame, block: int, iterations: int, seed: int, keys: list[str]) -> DataFrame:
    """``keys, iter, n, k, s, len``: the blocks of each resample of ``n`` rows: ``len`` rows from row ``s``, to stand from place ``k``. Starts are hashed.

    Series of one length have the same draws. A series shorter than a block is one block.
    """
    sizes = series.groupBy(*keys).agg(F.count("*").alias("n")).where("n > 0")  # one row a series
    draws = sizes.crossJoin(F.broadcast(series.sparkSession.range(iterations).select(F.col("id").alias("iter"))))  # a stated number of iterations
    draws = draws.withColumn("b", F.explode(F.expr(f"sequence(0L, (n - 1) div {block})")))
    start = F.pmod(hashed(seed, F.col("iter").cast("string"), F.col("b").cast("string")), F.greatest(F.lit(1), F.col("n") - block + 1))
    length = F.least(F.lit(block), F.col("n") - F.col("b") * block)
    return draws.select(*keys, "iter", "n", (F.col("b") * block).alias("k"), start.alias("s"), length.alias("len"))


def resampled(series: DataFrame, draws: DataFrame, keys: list[str]) -> DataFrame:
    """``keys, iter, k, x``: the values of ``series`` (``i, x`` and keys) in the order of each resample."""
    rows = draws.withColumn("o", F.explode(F.expr("sequence(0L, len - 1)")))
    rows = rows.select(*keys, "iter", (F.col("k") + F.col("o")).alias("k"), (F.col("s") + F.col("o")).alias("i"))
    return rows.join(series, [*keys, "i"])


def block_sums(series: DataFrame, draws: DataFrame, keys: list[str]) -> DataFrame:
    """``keys, iter, n, m, q``: number, mean and mean square of each resample, from running sums: a row a block, not a row a value."""
    w = (W.partitionBy(*keys) if keys else W.partitionBy(F.lit(1))).orderBy("i").rowsBetween(W.unboundedPreceding, 0)
    sums = series.select(*keys, (F.col("i") + 1).alias("i"), F.sum("x").over(w).alias("a"), F.sum(F.col("x") * F.col("x")).over(w).alias("b"))
    upto = draws.withColumn("i", F.explode(F.array(F.col("s"), F.col("s") + F.col("len")))).withColumn("sign", F.when(F.col("i") > F.col("s"), 1.0).otherwise(-1.0))
    found = upto.join(sums, [*keys, "i"])  # nothing runs before the first row
    out = found.groupBy(*keys, "iter", "n").agg(F.sum(F.col("sign") * F.col("a")).alias("a"), F.sum(F.col("sign") * F.col("b")).alias("b"))
    return out.select(*keys, "iter", "n", (F.col("a") / F.col("n")).alias("m"), (F.col("b") / F.col("n")).alias("q"))


def spa(d: DataFrame, iterations: int, seed: int) -> DataFrame:
    """``t, p`` of the mean of ``d`` (``i, x``) being above 0: studentised, against centred resamples."""
    size = F.sqrt(F.count("x"))
    seen = d.agg(F.avg("x").alias("mean"), (F.avg("x") / F.nullif(F.stddev_samp("x"), F.lit(0.0)) * size).alias("t"))
    boot = block_sums(d, block_draws(d, 1, iterations, seed, []), []).crossJoin(F.broadcast(seen))  # one row
    var = F.col("q") - F.col("m") * F.col("m")
    b = (F.col("m") - F.col("mean")) / F.when(var > 0, F.sqrt(var)) * F.sqrt("n")
    return boot.groupBy("t").agg(F.avg((b >= F.col("t")).cast("double")).alias("p"))


def reality_check(d: DataFrame, block: int, iterations: int, seed: int) -> DataFrame:
    """``best, p``: the best mean over all series ``key``, against the best centred mean of block resamples."""
    seen = d.groupBy("key").agg(F.avg("x").alias("mean"))
    top = seen.agg(F.max("mean").alias("best"))
    boot = block_sums(d, block_draws(d, block, iterations, seed, ["key"]), ["key"])
    each = boot.join(seen, "key").groupBy("iter").agg(F.max(F.col("m") - F.col("mean")).alias("b"))
    return each.crossJoin(F.broadcast(top)).groupBy("best").agg(F.avg((F.col("b") >= F.col("best")).cast("double")).alias("p"))  # one row


def shuffled(series: DataFrame, iterations: int, seed: int, keys: list[str]) -> DataFrame:
    """``iter, keys, place, x``: each iteration's values in the order of their hashes."""
    spark = series.sparkSession
    out = series.crossJoin(F.broadcast(spark.range(iterations).select(F.col("id").alias("iter"))))  # a stated number of iterations
    order = hashed(seed, F.col("iter").cast("string"), F.col("i").cast("string"))
    return out.withColumn("place", (F.row_number().over(W.partitionBy("iter", *keys).orderBy(order, "i")) - 1).cast("bigint"))


def path_figures(shuffled_: DataFrame, keys: list[str], start: float, multiply: bool) -> DataFrame:
    """``iter, keys, final, max_dd`` of the path that values make in their order."""
    w = W.partitionBy("iter", *keys).orderBy("place").rowsBetween(W.unboundedPreceding, 0)
    value = start * F.exp(F.sum(F.log(1 + F.col("x"))).over(w)) if multiply else start + F.sum("x").over(w)
    df = shuffled_.withColumn("v", value)
    df = df.withColumn("peak", F.greatest(F.max("v").over(w), F.lit(float(start))))
    return df.groupBy("iter", *keys).agg(F.max_by("v", "place").alias("final"), F.min((F.col("v") - F.col("peak")) / F.col("peak")).alias("max_dd"))


def pbo(splits: DataFrame, keys: list[str]) -> DataFrame:
    """``pbo, verdict``: the share of splits without a positive Sortino; 1 without splits."""
    out = splits.groupBy(*keys).agg(F.coalesce(F.avg((F.col("sortino") <= 0).cast("double")), F.lit(1.0)).alias("pbo"))
    return out.withColumn("verdict", F.when(F.col("pbo") < 0.3, "low").when(F.col("pbo") < 0.6, "moderate").otherwise("high"))


def student_p(t: Column, df: Column) -> Column:
    """One-sided p of a t statistic; one value a series, so a Python function of few rows."""

    def of(t: pd.Series, df: pd.Series) -> pd.Series:
        return pd.Series([student_upper(float(a), float(b)) if pd.notna(a) and pd.notna(b) else None for a, b in zip(t, df, strict=True)], dtype="float64")

    return F.pandas_udf(of, "double")(t, df)


def t_statistic(x: str) -> Column:
    return F.avg(x) / F.nullif(F.stddev_samp(x), F.lit(0.0)) * F.sqrt(F.count(x))


def wilcoxon(df: DataFrame, keys: list[str], x: str) -> DataFrame:
    """``w``: the sum of the average ranks of positive values; zeros are left out. ``p``: that of a greater sum, by the normal approximation."""
    df = df.where((F.col(x) != 0) & F.col(x).isNotNull())
    by = W.partitionBy(*keys)
    rank = F.rank().over(by.orderBy(F.abs(x))) + (F.count("*").over(W.partitionBy(*keys, F.abs(x))) - 1) / 2
    out = df.withColumn("_r", rank).groupBy(*keys).agg(F.coalesce(F.sum(F.when(F.col(x) > 0, F.col("_r"))), F.lit(0.0)).alias("w"), F.count("*").alias("n"))
    n = F.col("n")
    return out.withColumn("p", 1 - normal_cdf((F.col("w") - n * (n + 1) / 4) / F.sqrt(n * (n + 1) * (2 * n + 1) / 24)))


def expected_best(trials: Column, points: Column, periods: float) -> Column:
    """The expected best annual Sharpe ratio of that many strategies without skill."""
    log = F.log(trials)
    best = F.sqrt(2 * log) - (F.log(F.lit(math.pi)) + F.log(log)) / (2 * F.sqrt(2 * log))
    return F.when(trials > 1, best * F.sqrt(periods / (points - 1))).otherwise(0.0)


def deflated(df: DataFrame, sharpe: str, trials: Column, points: Column, periods: float) -> DataFrame:
    """Adds ``dsr``: the probability that the ratio is above the expected best of its trials."""
    z = (F.col(sharpe) - expected_best(trials, points, periods)) / F.sqrt(periods / (points - 1))
    return df.withColumn("dsr", normal_cdf(z))
