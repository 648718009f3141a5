"""Resampling reads whole series and resamples have the series' own length."""

import hashlib

import pytest


def start(it, b, n, block):
    return int(hashlib.md5(f"13:{it}:{b}".encode()).hexdigest()[:8], 16) % max(1, n - block + 1)


def test_resamples_have_the_length_of_their_series(spark):
    from barloom.operators import statistics as T

    lengths = {"a": 450, "b": 170, "c": 7}
    series = {s: [((k * 37) % 101) / 100 for k in range(n)] for s, n in lengths.items()}
    d = spark.createDataFrame([(s, i, x) for s, v in series.items() for i, x in enumerate(v)], "symbol string, i bigint, x double")
    got = T.resampled(d, T.block_draws(d, 20, 3, 13, ["symbol"]), ["symbol"]).groupBy("iter", "symbol").agg({"x": "avg", "i": "count"}).collect()
    assert len(got) == 9
    for r in got:
        v = series[r["symbol"]]
        n = len(v)
        want = [v[(start(r["iter"], k // 20, n, 20) + k % 20) % n] for k in range(n)]
        assert r["count(i)"] == n and r["avg(x)"] == pytest.approx(sum(want) / n)


def test_queries_number_the_whole_series(spark, monkeypatch):
    from barloom.operators import metrics as M
    from barloom.queries import statistics as Q

    rows = spark.createDataFrame([("a", k, 0.01 * (k % 5)) for k in range(450)], "symbol string, ts bigint, r double")
    monkeypatch.setattr(Q, "curve", lambda spark, sf_dir: None)
    monkeypatch.setattr(M, "returns", lambda rows_, keys: rows)
    assert Q.series(spark, "").count() == 450
    assert {r["n"] for r in Q.st_block_bootstrap(spark, "").collect()} == {450}
