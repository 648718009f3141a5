"""A histogram's bounds belong to the rows that it counts."""

import random

from pyspark.sql import functions as F


def test_bounds_and_rows_come_from_one_evaluation(spark):
    from barloom.operators.metrics import histogram

    # stands for sums whose last digits depend on the order of rows: another value at every evaluation
    moving = F.udf(lambda i: i + random.uniform(-0.4, 0.4), "double").asNondeterministic()
    df = spark.range(200).select(F.lit("a").alias("symbol"), moving("id").alias("r"))
    for _ in range(3):
        got = {r["bin"]: r["n"] for r in histogram(df, ["symbol"], "r", 50).collect()}
        assert sum(got.values()) == 200
        assert min(got) == 0 and max(got) == 49


def test_flat_and_missing_values(spark):
    from barloom.operators.metrics import histogram

    df = spark.createDataFrame([("flat", 2.0), ("flat", 2.0), ("none", None), ("two", 1.0), ("two", 3.0), ("two", None)], "symbol string, r double")
    got = {(r["symbol"], r["bin"]): r["n"] for r in histogram(df, ["symbol"], "r", 4).collect()}
    assert got == {("flat", 3): 2, ("two", 0): 1, ("two", 3): 1}


def test_plots_are_drawn_from_one_curve(spark, tmp_path):
    """The walk is computed once: every plot counts the same returns, even when values change between evaluations."""
    import datetime

    from barloom.queries import load, reports

    rows = [(i, i % 7, "click", float(1 + i * 37 % 101), datetime.datetime(2024, 1, 1) + datetime.timedelta(minutes=20 * i)) for i in range(300)]
    spark.createDataFrame(rows, "event_id long, user_id long, event_type string, value double, ts timestamp_ntz").write.parquet(f"{tmp_path}/events.parquet")
    moving = F.udf(lambda v: v * random.uniform(0.99, 1.01), "double").asNondeterministic()
    plain, reports.curve = reports.curve, lambda s, d: plain(s, d).withColumn("equity", moving("equity"))
    try:
        out = load()[0]["snk_plots"](spark, str(tmp_path))
        falls = [sorted((r["x"], r["y"]) for r in out.where("plot = 'drawdown'").collect()) for _ in range(2)]
        bins = {int(r["x"]): r["y"] for r in out.where("plot = 'returns'").collect()}
    finally:
        reports.curve = plain
    assert falls[0] == falls[1]
    assert sum(bins.values()) == len(falls[0]) - 1 and min(bins) == 0 and max(bins) == 49
