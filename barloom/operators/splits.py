"""Windows, splits and samples of bars. Interval tables are tiny (one row a window) and made on the driver."""

from __future__ import annotations

import itertools
import random

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from barloom.functions.indicators import order


def hashed(*parts: object) -> Column:
    """A 32-bit number from the parts' text: the same in any engine that has md5."""
    text = F.concat_ws(":", *[p if isinstance(p, Column) else F.lit(str(p)) for p in parts])
    return F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("bigint")


def groups(bars: DataFrame, n: int) -> DataFrame:
    """``grp``: ``n`` contiguous groups a symbol; the last takes the remainder."""
    df = bars.withColumn("_p", F.row_number().over(order()) - 1).withColumn("_n", F.count("*").over(W.partitionBy("symbol")))
    return df.withColumn("grp", F.expr(f"least(_p div greatest(_n div {n}, 1), {n - 1})")).drop("_p", "_n")


def combinations(spark: SparkSession, n: int, k: int) -> DataFrame:
    """``split_id, test``: every choice of ``k`` test groups out of ``n``."""
    return spark.createDataFrame([(i, list(c)) for i, c in enumerate(itertools.combinations(range(n), k))], "split_id bigint, test array<bigint>")


def purged(grouped: DataFrame, combos: DataFrame, purge: int, embargo: int) -> DataFrame:
    """Rows by split with their role. A training group right before a test group loses its last ``purge`` rows, a test
    group right after a training group its first ``embargo`` rows; groups left without rows are gone."""
    of = W.partitionBy("symbol", "grp")
    df = grouped.withColumn("_q", F.row_number().over(of.orderBy("ts")) - 1).withColumn("_m", F.count("*").over(of))
    df = df.crossJoin(F.broadcast(combos))  # one row a split
    test = F.expr("array_contains(test, grp)")
    cut = F.when(test, (F.col("grp") > 0) & ~F.expr("array_contains(test, grp - 1)") & (F.col("_q") < embargo)).otherwise(F.expr("array_contains(test, grp + 1)") & (F.col("_q") >= F.col("_m") - purge))
    return df.withColumn("role", F.when(test, "test").otherwise("train")).where(~cut).drop("_q", "_m")


def walk_forward(spark: SparkSession, start: int, n: int, train: int, gap: int, test: int, step: int, expanding: bool = False) -> DataFrame:
    """``window_id, a, b, c, d``: training from a to b and testing from c to d, in epoch seconds."""
    made = [(k, start if expanding else start + k * step, start + k * step + train, start + k * step + train + gap, start + k * step + train + gap + test) for k in range(n)]
    return spark.createDataFrame(made, "window_id bigint, a bigint, b bigint, c bigint, d bigint")


def in_windows(bars: DataFrame, windows: DataFrame, half_open: bool = False) -> DataFrame:
    """Rows by window and role; the bounds count in, or only the first with ``half_open``."""
    t = F.col("ts")
    inside = (lambda x, y: (t >= F.col(x)) & (t < F.col(y))) if half_open else (lambda x, y: t.between(F.col(x), F.col(y)))
    role = F.when(inside("a", "b"), "train").when(inside("c", "d"), "test")
    return bars.join(F.broadcast(windows), t.between(F.col("a"), F.col("d"))).withColumn("role", role)


def no_lookahead(rows: DataFrame) -> DataFrame:
    """``window_id, ok``: whether all testing lies after all training."""
    last, first = F.max(F.when(F.col("role") == "train", F.col("ts"))), F.min(F.when(F.col("role") == "test", F.col("ts")))
    return rows.groupBy("window_id").agg((last < first).alias("ok"))


def periods(bars: DataFrame, named: list[tuple[str, int, int]]) -> DataFrame:
    table = bars.sparkSession.createDataFrame(named, "period string, a bigint, b bigint")
    return bars.join(F.broadcast(table), (F.col("ts") >= F.col("a")) & (F.col("ts") < F.col("b")))


def hashed_starts(spark: SparkSession, n: int, stride: int, keep: int, seed: int) -> DataFrame:
    """``start``: ``keep`` of the grid's starts, in the order of their hashes."""
    grid = spark.range(n).select((F.col("id") * stride).alias("start"))
    return grid.orderBy(hashed(seed, F.col("start").cast("string")), "start").limit(keep)


def random_starts(spark: SparkSession, total: int, length: int, n: int, seed: int, tries: int = 10) -> DataFrame:
    """``start``: windows at random places, apart from each other where ``tries`` draws allow it."""
    draw, chosen = random.Random(seed), []
    for _ in range(n):
        for _ in range(tries):
            s = draw.randrange(max(1, total - length + 1))
            if all(abs(s - c) >= length for c in chosen):
                break
        chosen.append(s)
    return spark.createDataFrame([(s,) for s in chosen], "start bigint")


def position_windows(bars: DataFrame, starts: DataFrame, length: int) -> DataFrame:
    """Rows by window ``w_{start}_{length}``: ``length`` bars of each symbol from position ``start``."""
    df = bars.withColumn("_p", F.row_number().over(order()) - 1)
    df = df.join(F.broadcast(starts), (F.col("_p") >= F.col("start")) & (F.col("_p") < F.col("start") + length))
    return df.withColumn("window_id", F.concat(F.lit("w_"), F.col("start"), F.lit(f"_{length}"))).drop("_p")


def chunks(bars: DataFrame, seconds: int, least: int) -> DataFrame:
    """``symbol, chunk, n, vol`` of calendar chunks with more than ``least`` bars; vol is the deviation of returns."""
    df = bars.withColumn("r", F.col("close") / F.lag("close", 1).over(order()) - 1)
    return df.groupBy("symbol", F.expr(f"ts div {seconds}").alias("chunk")).agg(F.count("*").alias("n"), F.stddev_samp("r").alias("vol")).where(F.col("n") > least)


def sampled_chunks(found: DataFrame, k: int, seed: int) -> DataFrame:
    order = W.partitionBy("symbol").orderBy(hashed(seed, F.col("symbol"), F.col("chunk").cast("string")), "chunk")
    return found.withColumn("_rn", F.row_number().over(order)).where(F.col("_rn") <= k).drop("_rn")


def stratified_chunks(found: DataFrame, k: int, seed: int) -> DataFrame:
    """``stratum``: thirds by position in order of volatility; ``k`` chunks of each, by hash. One row a chunk, so one small window."""
    ranked = found.withColumn("_k", F.row_number().over(W.orderBy("vol", "symbol", "chunk")) - 1).withColumn("_m", F.count("*").over(W.partitionBy()))
    ranked = ranked.withColumn("stratum", F.expr("cast(case when _k < _m div 3 then 0 when _k < 2*(_m div 3) then 1 else 2 end as bigint)"))
    order = W.partitionBy("stratum").orderBy(hashed(seed, F.col("symbol"), F.col("chunk").cast("string")), "symbol", "chunk")
    return ranked.withColumn("_rn", F.row_number().over(order)).where(F.col("_rn") <= k).drop("_rn", "_k", "_m")


def volatility_strata(found: DataFrame) -> DataFrame:
    cut = found.agg(F.percentile("vol", F.array(F.lit(1 / 3), F.lit(2 / 3))).alias("p"))
    label = F.when(F.col("vol") <= F.col("p")[0], "low").when(F.col("vol") <= F.col("p")[1], "mid").otherwise("high")
    return found.crossJoin(F.broadcast(cut)).withColumn("stratum", label).drop("p")  # one row of cuts
