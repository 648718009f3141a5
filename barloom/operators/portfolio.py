"""Portfolios of member series ``(symbol, ts, r)``, fitness rules and population upkeep."""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from barloom.operators import metrics as M

MEMBERS = 500  # members whose covariance the driver optimises at most


def label_trades(trades: DataFrame, labels: DataFrame) -> DataFrame:
    """Trades with the regime of their own entry bar."""
    return trades.join(labels.withColumnRenamed("ts", "entry_ts"), ["symbol", "entry_ts"])


def mean_of(rows: DataFrame, x: Column, digits: int) -> DataFrame:
    return rows.groupBy("ts").agg((F.round(F.avg(x), digits) + F.lit(0.0)).alias("v"))


def filtered_mean(rows: DataFrame, wanted: Column) -> DataFrame:
    """The mean over wanted members at each time; over all of them where none is wanted."""
    some, all_ = F.avg(F.when(wanted, F.col("r"))), F.avg(F.coalesce("r", F.lit(0.0)))
    return rows.groupBy("ts").agg((F.round(F.coalesce(some, all_), 8) + F.lit(0.0)).alias("v"))


def inverse_vol(rows: DataFrame) -> DataFrame:
    """``symbol, w``: weights by inverse deviation, summing to 1."""
    out = rows.groupBy("symbol").agg((1 / F.stddev_samp("r")).alias("i"))  # one row a member
    return out.select("symbol", (F.col("i") / F.sum("i").over(W.partitionBy())).alias("w"))


def weighted(rows: DataFrame, weights: DataFrame) -> DataFrame:
    return rows.join(weights, "symbol").groupBy("ts").agg((F.round(F.sum(F.col("w") * F.coalesce("r", F.lit(0.0))), 8) + F.lit(0.0)).alias("v"))


def quality(strategies: DataFrame, growth: float, factor: float) -> DataFrame:
    """The keys of strategies that grow by more than ``growth`` a year with a profit factor above ``factor``."""
    return strategies.where((F.col("cagr") > growth) & (F.col("profit_factor") > factor)).select("symbol", "week")


def balanced(strategies: DataFrame, n: int) -> DataFrame:
    """The ``n`` strategies of greatest growth of each direction."""
    place = F.row_number().over(W.partitionBy("direction").orderBy(F.desc(F.round("cagr", 9)), "symbol", "week"))
    return strategies.withColumn("_k", place).where(F.col("_k") <= n).select("direction", "symbol", "week")


COMBINATIONS = 50_000  # of members that are tried at most


def exhaustive(rows: DataFrame, periods: float, largest: int = 8, worst: float = -0.15) -> DataFrame:
    """``members, sortino, max_dd, allowed``: every combination of 2 to ``largest`` members, equally weighted, and whether its
    drawdown stays above ``worst``; the number of combinations is checked first."""
    n = rows.select("symbol").distinct().count()
    if sum(math.comb(n, k) for k in range(2, min(largest, n) + 1)) > COMBINATIONS:
        raise ValueError(f"{n} members have more than {COMBINATIONS} combinations: choose among them first")
    names = rows.select("symbol").distinct().withColumn("k", F.row_number().over(W.orderBy("symbol")) - 1)  # one row a member
    combos = rows.sparkSession.range(1 << n).where(F.bit_count("id").between(2, largest))
    member = combos.join(F.broadcast(names), F.expr("(shiftright(id, k) & 1) = 1")).select("id", "symbol")
    mixed = rows.join(F.broadcast(member), "symbol").groupBy("id", "ts").agg(F.avg(F.coalesce("r", F.lit(0.0))).alias("r"))
    w = W.partitionBy("id").orderBy("ts").rowsBetween(W.unboundedPreceding, 0)
    path = mixed.withColumn("eq", F.exp(F.sum(F.log(1 + F.col("r"))).over(w)))
    path = path.withColumn("dd", F.col("eq") / F.max("eq").over(w) - 1)
    scored = path.groupBy("id").agg(M.sortino_rms(periods).alias("sortino"), F.min("dd").alias("max_dd"))
    said = member.groupBy("id").agg(F.array_join(F.array_sort(F.collect_list("symbol")), ",").alias("members"))
    return scored.join(said, "id").select("members", "sortino", "max_dd", (F.col("max_dd") > worst).alias("allowed"))


def _moments(rows: DataFrame) -> tuple[list[str], np.ndarray, np.ndarray]:
    """Member names, means and covariances over shared times. The number of members is checked first; each time is one row of
    an array of members, and products are summed by member pair within partitions, so no join by time is made."""
    names = sorted(x["symbol"] for x in rows.select("symbol").distinct().limit(MEMBERS + 1).collect())
    if len(names) > MEMBERS:
        raise ValueError(f"more than {MEMBERS} members: choose among them first")
    n = len(names)
    wide = rows.groupBy("ts").pivot("symbol", names).agg(F.first("r")).select(*[F.coalesce(F.col(f"`{c}`"), F.lit(0.0)).cast("double").alias(f"m{k}") for k, c in enumerate(names)])

    def sums(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        gram, total, count = np.zeros((n, n)), np.zeros(n), 0
        for batch in batches:
            x = np.column_stack([c.to_numpy() for c in batch.columns]) if n else np.zeros((batch.num_rows, 0))
            gram, total, count = gram + x.T @ x, total + x.sum(axis=0), count + len(x)
        yield pa.RecordBatch.from_arrays([pa.array([np.concatenate((gram.ravel(), total, [float(count)])).tolist()], pa.list_(pa.float64()))], names=["sums"])

    parts = wide.mapInArrow(sums, "sums array<double>").select(F.posexplode("sums").alias("k", "v")).groupBy("k").agg(F.sum("v").alias("v"))
    found = np.zeros(n * n + n + 1)
    for r in parts.collect():  # members squared
        found[r["k"]] = r["v"]
    gram, total, count = found[: n * n].reshape(n, n), found[n * n : -1], max(found[-1], 2.0)
    mean = total / count
    return names, mean, (gram - count * np.outer(mean, mean)) / (count - 1)


def _simplex(w: np.ndarray) -> np.ndarray:
    """The nearest weights that are not negative and sum to 1."""
    u = np.sort(w)[::-1]
    total = np.cumsum(u) - 1
    k = np.flatnonzero(u - total / np.arange(1, len(u) + 1) > 0)[-1]
    return np.maximum(w - total[k] / (k + 1), 0)


def optimised(rows: DataFrame, goal: str, steps: int = 500) -> DataFrame:
    """``symbol, w``: long-only weights of greatest mean over deviation, or of least variance, by projected gradient."""
    names, mean, cov = _moments(rows)
    w = np.full(len(names), 1 / len(names))
    scale = 1 / max(np.trace(cov) / len(names), 1e-18)
    for k in range(steps):
        var = max(w @ cov @ w, 1e-18)
        grad = cov @ w * scale if goal == "variance" else -(mean / var**0.5 - (mean @ w) * (cov @ w) / var**1.5) * var**0.5 * scale**0.5
        w = _simplex(w - grad / (5 + k) / max(np.abs(grad).max(), 1e-12))
    return rows.sparkSession.createDataFrame([(n, round(float(x), 6)) for n, x in zip(names, w, strict=True)], "symbol string, w double")


def greedy(rows: DataFrame, forward: bool, tolerance: float = 0.05) -> DataFrame:
    """``step, symbol, score``: members added (or taken away) while the mix's mean over deviation doesn't fall by more than ``tolerance``."""
    names, mean, cov = _moments(rows)

    def score(members: list[int]) -> float:
        w = np.zeros(len(names))
        w[members] = 1 / len(members)
        return float(mean @ w / max(w @ cov @ w, 1e-18) ** 0.5)

    chosen = [] if forward else list(range(len(names)))
    said, now = [], -np.inf if forward else score(chosen)
    while (len(chosen) < len(names)) if forward else (len(chosen) > 1):
        options = [[*chosen, k] for k in range(len(names)) if k not in chosen] if forward else [[x for x in chosen if x != k] for k in chosen]
        best = max(options, key=score)
        if score(best) < now - abs(now) * tolerance:
            break
        moved = (set(best) ^ set(chosen)).pop()
        chosen, now = best, score(best)
        said.append((len(said), names[moved], round(now, 6)))
    return rows.sparkSession.createDataFrame(said, "step bigint, symbol string, score double")


def fitness_v1() -> Column:
    c = F.col
    ratio = F.when(c("return_pct") > 0, (c("return_pct") / 100) / F.greatest(F.abs("max_dd"), F.lit(0.01))).otherwise(0.0)
    score = 0.4 * F.least(c("sortino") / 3, F.lit(1.0)) + 0.4 * F.least(ratio / 2, F.lit(1.0)) + 0.2 * c("win_rate") - F.when(c("n_trades") > 160, 0.1).otherwise(0.0)
    return F.when(c("n_trades") < 20, -999.0).otherwise(score)


def soft_fitness() -> Column:
    """A fitness without cliffs: shortfalls cost in proportion."""
    return F.col("composite") - 2 * F.greatest(F.abs("max_dd") - 0.1, F.lit(0.0)) - 0.05 * F.greatest(30 - F.col("n_trades"), F.lit(0))


def tuning(windows: DataFrame) -> DataFrame:
    """Each window against the one before: ``status``."""
    before = F.lag("composite", 1).over(W.partitionBy("strategy_id").orderBy("window_id"))
    out = windows.withColumn("before", before).where("before is not null").withColumn("d", F.col("composite") - F.col("before"))
    status = F.when(F.col("d") > 0.001, "BETTER").when(F.col("d") < -0.001, "WORSE").otherwise("SAME")
    return out.withColumn("status", status)


def reverts(before: DataFrame, after: DataFrame) -> DataFrame:
    """``strategy_id, pbo, revert`` from ``strategy_id, pbo, cpcv, passed`` of an original and its tuned strategy."""
    a = before.select("strategy_id", F.col("pbo").alias("pbo0"), F.col("cpcv").alias("cpcv0"), F.col("passed").alias("passed0"))
    b = after.select("strategy_id", "pbo", "cpcv", "passed")
    worse = (F.col("pbo") > F.col("pbo0") + 0.15) | (F.col("cpcv") < F.col("cpcv0") - 0.1) | (F.col("passed0") & ~F.col("passed"))
    return a.join(b, "strategy_id").select("strategy_id", "pbo", worse.alias("revert"))


def managed(population: DataFrame, group: list[str], same: list[str], quota: str, size: int, share: float) -> DataFrame:
    """Adds ``chosen, place`` to the members that stay: of equal ones (``same``) the best, ``share`` of the places for the best of each
    ``quota`` group, the places left for the best of the rest."""
    order = [F.desc("fitness"), F.col("id")]
    one = population.withColumn("_d", F.row_number().over(W.partitionBy(*group, *same).orderBy(*order))).where("_d = 1").drop("_d")
    one = one.withColumn("chosen", F.row_number().over(W.partitionBy(*group, quota).orderBy(*order)) <= int(size * share))
    return one.withColumn("place", F.row_number().over(W.partitionBy(*group).orderBy(F.desc("chosen"), *order))).where(F.col("place") <= size)
