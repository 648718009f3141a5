"""Market regimes: by moving average, by return, by vote, and by a hidden Markov model."""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from barloom.functions.indicators import guarded, order, over
from barloom.operators.hmm import Model, fit_hmm

LABELS = ("bull", "bear", "sideways")


def _running_median(df: DataFrame, of: str, name: str) -> DataFrame:
    """Adds the median of what a symbol has shown so far, in one pass that keeps the values ordered."""
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema) + f", `{name}` double"

    def run(bars: pa.Table) -> pa.Table:
        bars = bars.take(pc.sort_indices(bars, [("ts", "ascending")]))
        median = pd.Series(bars.column(of).to_numpy()).expanding().median().to_numpy()
        return bars.append_column(name, pa.array(median, pa.float64(), mask=np.isnan(median)))

    return df.groupBy("symbol").applyInArrow(run, schema)


def by_average(bars: DataFrame, n: int = 50, vol_n: int = 20, slope: float = 0.005, calm: float = 1.5, warm: int = 100, causal: bool = False) -> DataFrame:
    """``regime`` from the average's slope over five bars; wild bars are sideways, as are the first ``warm``.

    Wild is above ``calm`` times the median volatility: of the whole series, or with ``causal`` of the past only.
    """
    df = bars.withColumn("_m", guarded(F.avg, "close", n)).withColumn("_r", F.log(F.col("close") / F.lag("close", 1).over(order())))
    df = df.withColumn("_s", over(F.col("_m") - F.lag("_m", 5).over(order()), F.col("_m"))).withColumn("_v", guarded(F.stddev_samp, "_r", vol_n))
    df = _running_median(df, "_v", "_d") if causal else df.withColumn("_d", F.percentile("_v", F.lit(0.5)).over(W.partitionBy("symbol")))
    df = df.withColumn("_n", F.row_number().over(order()))
    aside = (F.col("_n") <= warm) | F.col("_s").isNull() | F.col("_v").isNull() | (F.col("_v") > calm * F.col("_d"))
    label = F.when(aside, "sideways").when(F.col("_s") > slope, "bull").when(F.col("_s") < -slope, "bear").otherwise("sideways")
    return df.withColumn("regime", label).drop("_m", "_r", "_s", "_v", "_d", "_n")


def summary(labelled: DataFrame) -> DataFrame:
    """``symbol, regime, n, share`` with every label present."""
    spark = labelled.sparkSession
    total = labelled.groupBy("symbol").agg(F.count("*").alias("t"))
    frame = total.crossJoin(F.broadcast(spark.createDataFrame([(x,) for x in LABELS], "regime string")))
    n = labelled.groupBy("symbol", "regime").agg(F.count("*").alias("n"))
    out = frame.join(n, ["symbol", "regime"], "left").withColumn("n", F.coalesce("n", F.lit(0).cast("bigint")))
    return out.withColumn("share", F.col("n").cast("double") / F.col("t"))


def by_return(bars: DataFrame, seconds: int, limit: float) -> DataFrame:
    """``symbol, chunk, ret, regime`` of calendar chunks by their buy-and-hold return."""
    out = bars.groupBy("symbol", F.expr(f"ts div {seconds}").alias("chunk")).agg(F.min_by("close", "ts").alias("a"), F.max_by("close", "ts").alias("b"))
    out = out.withColumn("ret", F.col("b") / F.col("a") - 1)
    return out.withColumn("regime", F.when(F.col("ret") > limit, "bull").when(F.col("ret") < -limit, "bear").otherwise("sideways")).drop("a", "b")


def vote(bars: DataFrame, scales: tuple[int, ...]) -> DataFrame:
    """``symbol, regime, confidence`` of the last bar: the side of each scale's average on which it closes."""
    parts = [F.coalesce(F.signum(F.col("close") - guarded(F.avg, "close", n)), F.lit(0.0)) for n in scales]
    df = bars.withColumn("_s", sum(parts[1:], parts[0]))
    out = df.groupBy("symbol").agg(F.max_by("_s", "ts").alias("s"))
    need = len(scales) // 2 + 1
    return out.select("symbol", F.when(F.col("s") >= need, "bull").when(F.col("s") <= -need, "bear").otherwise("sideways").alias("regime"), (F.abs("s") / len(scales)).alias("confidence"))


def affinity(labelled: DataFrame, signal: str) -> DataFrame:
    """``symbol, regime, n, share`` of signals by regime."""
    out = labelled.groupBy("symbol", "regime").agg(F.count(F.when(F.col(signal), 1)).alias("n"))
    return out.withColumn("share", over(F.col("n").cast("double"), F.sum("n").over(W.partitionBy("symbol")).cast("double")))


FEATURES = ("ret", "vol", "vr", "slope", "vov")
VOL_STATES = ("calm", "normal", "volatile")


def features(bars: DataFrame, causal: bool = False) -> DataFrame:
    """Log return, its deviation over 20 bars, volume to its mean over 20, the strength of the 50-bar average's slope over five bars,
    and the deviation of the deviation over 40; each cut to five deviations around its mean."""
    df = bars.withColumn("ret", F.log(F.col("close") / F.lag("close", 1).over(order()))).withColumn("_a", guarded(F.avg, "close", 50))
    df = df.withColumn("vol", guarded(F.stddev_samp, "ret", 20)).withColumn("vr", over(F.col("volume"), guarded(F.avg, "volume", 20)))
    df = df.withColumn("slope", F.abs(over(F.col("_a") - F.lag("_a", 5).over(order()), F.col("_a")))).withColumn("vov", guarded(F.stddev_samp, "vol", 40)).drop("_a")
    span = order().rowsBetween(W.unboundedPreceding, 0) if causal else W.partitionBy("symbol")
    sums = [f(c).over(span).alias(f"_{n}_{c}") for c in FEATURES for n, f in (("m", F.avg), ("s", F.stddev_samp))]
    df = df.select("*", *sums)
    cut = lambda c: F.least(F.greatest(F.col(c), F.col(f"_m_{c}") - 5 * F.col(f"_s_{c}")), F.col(f"_m_{c}") + 5 * F.col(f"_s_{c}"))
    return df.select(*bars.columns, *[F.when(F.col(c).isNotNull(), cut(c)).alias(c) for c in FEATURES])


def _rows(bars: pd.DataFrame) -> pd.DataFrame:
    bars = bars.sort_values("ts")
    return bars[bars[list(FEATURES)].notna().all(axis=1)]


def fit_models(feats: DataFrame, states: int = 3) -> DataFrame:
    """``symbol, states, parameters``: a model a symbol, null where bars are few; plain numbers, so any table format keeps them. A
    symbol's bars are one group: a series is a sequence."""

    def run(bars: pd.DataFrame) -> pd.DataFrame:
        known = _rows(bars)
        made = fit_hmm(known[list(FEATURES)].to_numpy(float), states).flat() if len(known) >= 10 * states else None
        return pd.DataFrame({"symbol": [bars["symbol"].iloc[0]], "states": [states], "parameters": [made]})

    return feats.select("symbol", "ts", *FEATURES).groupBy("symbol").applyInPandas(run, "symbol string, states int, parameters array<double>")


def predict(feats: DataFrame, models: DataFrame) -> DataFrame:
    """``symbol, ts, vol, state, confidence, probabilities`` of the bars with all features; state 0 is the calmest."""

    def run(key: tuple, bars: pd.DataFrame, model: pd.DataFrame) -> pd.DataFrame:
        known = _rows(bars)
        out = known[["symbol", "ts", "vol"]].copy()
        values = model["parameters"].iloc[0] if len(model) else None
        if values is None or not len(known):
            out["state"], out["confidence"], out["probabilities"] = 1, 0.0, None
            return out
        p = Model.of(list(values), int(model["states"].iloc[0]), len(FEATURES)).posterior(known[list(FEATURES)].to_numpy(float))
        out["state"], out["confidence"], out["probabilities"] = p.argmax(axis=1), p.max(axis=1), p.tolist()
        return out

    schema = "symbol string, ts bigint, vol double, state bigint, confidence double, probabilities array<double>"
    return feats.select("symbol", "ts", *FEATURES).groupBy("symbol").cogroup(models.groupBy("symbol")).applyInPandas(run, schema)


def hmm(feats: DataFrame, states: int = 3) -> DataFrame:
    """Fit and predict on the same bars."""
    return predict(feats, fit_models(feats, states))


def stability(predicted: DataFrame) -> DataFrame:
    """``symbol, vol_state, stability, transition_risk`` of each symbol's last bar."""
    names = F.array(*[F.lit(x) for x in VOL_STATES])
    last = predicted.groupBy("symbol").agg(F.max_by(F.struct("state", "confidence"), "ts").alias("l"))
    name = F.coalesce(F.get(names, F.col("l.state").cast("int")), F.lit("normal"))
    return last.select("symbol", name.alias("vol_state"), F.round("l.confidence", 3).alias("stability"), F.round(1 - F.col("l.confidence"), 3).alias("transition_risk"))


def sizing(a: Column, b: Column, against: Column) -> Column:
    """Position size factor: the mean of two confidences, lowered against the regime and raised with it, within 0.3 and 1."""
    return F.least(F.greatest((a + b) / 2 * F.when(against, 0.7).otherwise(1.1), F.lit(0.3)), F.lit(1.0))


def combined(bars: DataFrame, labelled: DataFrame, states: DataFrame, scales: tuple[int, ...] = (10, 30, 60)) -> DataFrame:
    """``symbol, regime, confidence, vol_state, stability, transition_risk, sizing``: both detectors on each symbol's last bar, and
    the position size they allow: less when volatile, more when calm."""
    said = vote(bars, scales)
    now = labelled.groupBy("symbol").agg(F.max_by("regime", "ts").alias("label"))
    out = said.join(stability(states), "symbol").join(now, "symbol")
    base = (F.col("confidence") + F.col("stability")) / 2
    size = base * F.when(F.col("vol_state") == "volatile", 0.7).when(F.col("vol_state") == "calm", 1.1).otherwise(1.0)
    return out.withColumn("sizing", F.round(F.least(F.greatest(size, F.lit(0.3)), F.lit(1.0)), 2))
