"""The portfolio, distributions, settings and pages, by hand."""

import math
import statistics

import pytest


def bar(symbol, close, low=None, high=None, **more):
    return {"symbol": symbol, "ts": 0, "close": close, "low": close if low is None else low, "high": close if high is None else high, "atr": 1.0, **more}


def portfolio(**limits):
    from barloom.operators.kernel import Rules
    from barloom.streaming.live import Limits, Portfolio

    return Portfolio({"a": Rules("LONG", 3.0, 1.0, 2.0, 0.0, 100), "b": Rules("SHORT", 0.0, 1.0, 0.0, 0.0, 100)}, Limits(cost=0.0, **limits))


def test_entry_size_stop_and_ratchet():
    p = portfolio()
    (e,) = p.step(0, [bar("x", 100.0, new_a=True)])
    assert e[3] == "enter" and e[5] == 1000.0 and e[8] == 99.0  # 1000 * 0.2 * 5; one ATR below
    (t,) = p.step(60, [bar("x", 102.0, 101.5, 102.5)])
    assert t[3] == "trail" and t[8] == 100.0
    assert p.step(60, [bar("x", 1.0, 1.0)]) == []  # a bar seen before
    (x,) = p.step(120, [bar("x", 99.5, 99.4, 101.0)])
    assert x[3] == "exit_stop" and x[4] == 100.0 and x[6] == pytest.approx(0.0)
    assert p.state["trades"] == 1 and not p.state["open"]


def test_limits_and_breakers():
    p = portfolio(max_positions=1, max_daily_loss=0.005)
    assert [i[1] for i in p.step(0, [bar("y", 50.0, new_b=True), bar("x", 100.0, new_a=True)])] == ["x"]
    out = p.step(60, [bar("x", 98.0, 97.0, 98.0, new_a=True)])
    assert [i[3] for i in out] == ["exit_stop", "halt_daily_loss"]
    assert p.step(120, [bar("x", 98.0, new_a=True)]) == []  # halted
    assert [i[3] for i in p.step(86400, [bar("x", 98.0, new_a=True)])] == ["enter"]  # the next day
    p = portfolio(min_order=5000.0)
    assert p.step(0, [bar("x", 100.0, new_a=True)]) == []
    p = portfolio(max_drawdown=0.005)
    p.step(0, [bar("x", 100.0, new_a=True)])
    assert [i[3] for i in p.step(60, [bar("x", 98.0, 97.0, 98.0)])] == ["exit_stop", "halt_portfolio_drawdown"]
    assert p.step(86400, [bar("x", 98.0, new_a=True)]) == []  # not lifted by a new day


def test_a_control_event_closes_everything_of_its_symbols():
    p = portfolio()
    p.step(0, [bar("x", 100.0, new_a=True, new_b=True), bar("y", 10.0, new_b=True)])
    out = p.step(60, [bar("x", 101.0, close_all=True, new_a=True)])
    assert sorted((i[2], i[3]) for i in out) == [("a", "exit_emergency"), ("b", "exit_emergency")] and list(p.state["open"]) == ["b|y"]


def test_state_survives_as_json():
    import json

    from barloom.streaming.live import Portfolio

    p = portfolio()
    p.step(0, [bar("x", 100.0, new_a=True)])
    again = Portfolio(p.rules, p.limits, json.loads(json.dumps(p.state)))
    assert again.step(60, [bar("x", 90.0)]) == p.step(60, [bar("x", 90.0)])


def test_distributions(spark):
    from pyspark.sql import functions as F

    from barloom.operators import distributions as D

    normal = statistics.NormalDist()
    zs = [-9.0, -8.0, -3.2, -1.0, -1e-6, 0.0, 0.3, 1.96, 4.0, 7.9, 12.0]
    got = spark.createDataFrame([(z,) for z in zs], "z double").select("z", D.normal_cdf(F.col("z")).alias("p")).collect()
    assert all(r["p"] == pytest.approx(normal.cdf(r["z"]), abs=1e-12) for r in got)
    ps = [1e-6, 0.01, 0.024, 0.3, 0.5, 0.8, 0.99, 1 - 1e-6]
    got = spark.createDataFrame([(p,) for p in ps], "p double").select("p", D.normal_quantile(F.col("p")).alias("z")).collect()
    assert all(r["z"] == pytest.approx(normal.inv_cdf(r["p"]), abs=1e-7) for r in got)
    for t, df in ((0.0, 5), (1.2, 3), (-2.5, 30), (2.0, 718), (6.0, 10)):
        c = math.exp(math.lgamma((df + 1) / 2) - math.lgamma(df / 2)) / math.sqrt(df * math.pi)
        step, area = 1e-3, 0.0
        for k in range(int(60 / step)):
            x = t + (k + 0.5) * step
            area += step * c * (1 + x * x / df) ** (-(df + 1) / 2)
        assert D.student_upper(t, df) == pytest.approx(area, abs=2e-4 if df < 5 else 1e-6)


def test_settings():
    from barloom.sources.config import flatten

    assert flatten("a:\n  b: 1\n  c: [x, 'y z']\n# note\nd:\n- p\n- q\ne: t # said") == {"a.b": "1", "a.c.0": "x", "a.c.1": "y z", "d.0": "p", "d.1": "q", "e": "t"}
    with pytest.raises(ValueError):
        flatten("just words")


def test_pages_are_asked_for_again(spark):
    from barloom.sources import cache

    reader = cache._PageReader({"bars": "10", "page": "5", "fail": "2", "backoff": "0.001", "rate": "1000"})
    assert len(list(reader.read(reader.partitions()[0]))) == 5 and reader.asked == 3
    reader = cache._PageReader({"bars": "10", "fail": "3", "backoff": "0.001", "rate": "1000"})
    with pytest.raises(OSError):
        reader.read(reader.partitions()[0])


def test_hidden_states_are_found():
    import numpy as np

    from barloom.operators.hmm import Model, fit_hmm

    draw = np.random.default_rng(2)
    state = np.repeat([0, 2, 1, 0, 2, 1], 80)
    x = np.column_stack([draw.normal(0, 1, 480), draw.normal(state * 4.0, 0.5), draw.normal(state, 0.3)])
    model = fit_hmm(x)
    p = Model.of(model.flat(), 3, 3).posterior(x)
    assert (p.argmax(axis=1) == state).mean() > 0.98 and np.allclose(p.sum(axis=1), 1)
