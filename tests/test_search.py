"""Back-tests, the grammar, parameters and evolutionary search against slow versions of themselves."""

import math
import random
import re

import numpy as np
import pytest


def slow_run(high, low, close, atr, signal, r, equity=100.0):
    """The position machine, one bar after another."""
    side = 1 if r.direction == "LONG" else -1
    out, curve, held = [], [], False
    for i in range(len(close)):
        if held:
            if r.trail > 0:
                best = max(best, high[i]) if side > 0 else min(best, low[i])  # noqa: F821
                if side * (best - side * r.trail * size - stop) > 0:  # noqa: F821
                    stop, moved = best - side * r.trail * size, True
            hit = low[i] <= stop if side > 0 else high[i] >= stop
            goal = r.tp > 0 and (high[i] >= target if side > 0 else low[i] <= target)  # noqa: F821
            if r.target_first and goal:
                hit = False
            kind = ("trail" if r.trail > 0 and moved else "stop") if hit else "target" if goal else "time" if i - since >= r.hold else None  # noqa: F821
            if kind:
                raw = stop if hit else target if goal else close[i]  # noqa: F821
                pnl = side * (raw * (1 - side * r.cost) - entry) / entry  # noqa: F821
                equity *= 1 + pnl
                out.append((since, i, kind, pnl))
                held = False
        elif signal[i] and atr[i] > 0:
            entry, size, since, moved, held = close[i] * (1 + side * r.cost), atr[i], i, False, True
            stop, target, best = entry - side * r.sl * size, entry + side * r.tp * size, entry
        curve.append(equity)
    if held:
        pnl = side * (close[-1] * (1 - side * r.cost) - entry) / entry
        out.append((since, len(close) - 1, "eod", pnl))
        curve[-1] = equity * (1 + pnl)
    return curve, out


@pytest.mark.parametrize("seed", range(12))
def test_exit_searches_equal_the_bar_by_bar_machine(seed):
    from barloom.operators.kernel import Rules, run

    draw = np.random.default_rng(seed)
    n = int(draw.integers(1, 700))
    close = 100 * np.exp(np.cumsum(draw.normal(0, 0.01, n)))
    high, low = close * (1 + np.abs(draw.normal(0, 0.006, n))), close * (1 - np.abs(draw.normal(0, 0.006, n)))
    atr = np.where(draw.random(n) < 0.05, np.nan, np.abs(draw.normal(1, 0.4, n)))
    signal = draw.random(n) < draw.choice([0.02, 0.3, 1.0])
    for direction in ("LONG", "SHORT"):
        for tp, sl, trail, hold, first in ((3, 1.5, 0, 960, False), (0, 2, 1.5, 30, False), (1, 1, 0.5, 5, True), (8, 4, 3, 200, False)):
            rules = Rules(direction, tp, sl, trail, 0.0003, hold, first)
            curve, trades = run(high, low, close, atr, signal, rules)
            want_curve, want = slow_run(high, low, close, atr, signal, rules)
            assert [(t.entry, t.exit, t.kind) for t in trades] == [w[:3] for w in want]
            assert np.allclose([t.pnl for t in trades], [w[3] for w in want]) and np.allclose(curve, want_curve)


def test_population_trades_equal_single_back_tests(spark, sf_dir):
    from barloom.operators import backtest as BT
    from barloom.plans.strategy import small_strategies, with_signals
    from barloom.queries.backtests import small_rules
    from barloom.sources import bars as B

    bars, made = B.event_bars(spark, sf_dir), small_strategies()
    one = BT.trades(BT.bar_form(with_signals(bars, made, B.HOUR, {"atr": ("ATR", (14,))}), list(made)), small_rules())
    BT.CHUNK, before = 3, BT.CHUNK
    try:
        many = BT.population_trades(bars, made, small_rules(), B.HOUR)
        said = lambda d: sorted((r["strategy_id"], r["symbol"], r["entry_ts"], r["exit_ts"], r["kind"], round(r["pnl"], 9)) for r in d.collect())
        assert said(many) == said(one)
    finally:
        BT.CHUNK = before


def test_array_indicators_equal_their_columns(spark, sf_dir):
    from pyspark.sql import functions as F

    from barloom.functions.arrays import ARRAYS, Frames
    from barloom.plans.strategy import indicator_columns, parse
    from barloom.sources import bars as B

    said = ["SMA(close,5)", "EMA(high,9)", "RSI(close,14)", "RSI(low,7)", "ATR(10)", "STOCH_K(9)", "STOCH_D(14)", "PCT_B(20,2.0)", "MACD_NORM(8,21,5)", "PRICE_POS(8)", "ROC(5)", "VOL_RATIO(10)", "BBWIDTH(14,1.5)",
            "ATR_PCT(7)", "ADX(10)", "MFI(7)", "BREAKOUT_UP(20)", "BREAKOUT_DOWN(10)", "SQUEEZE(10,2.0)", "TRENDING(RSI,7,5)", "TRENDING(MFI,7,8)", "TRENDING(STOCH_K,9,13)", "DIVERGENCE_BULL(RSI,7,10)",
            "DIVERGENCE_BEAR(RSI,9,14)", "MACD_LINE(8,21,5)", "MACD_SIGNAL(8,21,5)", "MACD_HIST(8,21,5)", "BBAND_UPPER(20,2.0)", "BBAND_LOWER(20,2.0)", "VOLUME_SMA(10)", "ATR_SMA(14)"]
    frames = ["RSI(close,7,4h)", "STOCH_K(5,4h)", "SQUEEZE(10,2.0,4h)", "MFI(7,1d)", "BREAKOUT_UP(10,4h)", "ADX(7,4h)"]
    assert {x.split("(")[0] for x in said} == set(ARRAYS)
    made = {f"s{k}": parse(f"LONG WHEN {x} _GT_ 0 EXIT SL=1") for k, x in enumerate(said + frames)}
    # a gap of a day and a half, and bars without trades
    bars = B.event_bars(spark, sf_dir).where("not (ts between 1705000000 and 1705130000)").withColumn("volume", F.when(F.col("ts") % 18000 == 0, 0.0).otherwise(F.col("volume"))).persist()
    df, sides = indicator_columns(bars, made, B.HOUR)
    every = df.toPandas()
    for symbol, rows in every.groupby("symbol"):
        rows = rows.sort_values("ts")
        f = Frames(rows["ts"].to_numpy(), {c: rows[c].to_numpy(float) for c in ("open", "high", "low", "close", "volume")})
        from barloom.functions.indicators import parse_call

        for text in said + frames:
            name, args, frame = parse_call(text)
            got, want = f.value(name, args, {None: None, "4h": 14400, "1d": 86400}[frame]), rows[sides[text.strip()]].to_numpy(float)
            assert np.array_equal(np.isnan(got), np.isnan(want)), (text, symbol)
            assert np.allclose(got, want, rtol=1e-7, atol=1e-7, equal_nan=True), (text, symbol)
    bars.unpersist()


def slow_decode(genome, wraps=2):
    from barloom.plans.grammar import RULES

    text, used = "<strategy>", 0
    while m := re.search(r"<[^>]+>", text):
        if used == len(genome) * (wraps + 1):
            return None
        options = RULES[m[0]]
        text = text[: m.start()] + options[genome[used % len(genome)] % len(options)] + text[m.end() :]
        used += 1
    return text


def test_genomes_decode_to_strategies_that_parse():
    from barloom.plans.evolve import random_genome
    from barloom.plans.grammar import RULES, check, decode, rules_of
    from barloom.plans.parameters import parameters, rebuild, tighten
    from barloom.plans.strategy import parse

    check(RULES)
    assert len(RULES) == 32
    for bad in ("<strategy> ::= <a>", "<strategy> ::= x\n<b> ::= y"):
        with pytest.raises(ValueError):
            rules_of(bad)
    draw, seen = random.Random(3), 0
    for _ in range(300):
        g = random_genome(draw)[: draw.randint(1, 50)]
        text = decode(g)
        assert text == slow_decode(g)
        if text:
            s = parse(text)
            assert parse(s.expression).conditions == s.conditions
            found = parameters(s)
            assert all(p.low <= p.value <= p.high for p in found)
            tight = tighten(found)
            assert all(a.low <= b.low <= b.value <= b.high <= a.high for a, b in zip(found, tight, strict=True))
            again = parameters(rebuild(s, tight, [p.high for p in tight]))
            assert [p.name for p in again] == [p.name for p in found]
            seen += 1
    assert seen > 100 and decode([]) is None


def test_simplify_keeps_the_meaning():
    from barloom.functions.predicates import logic
    from barloom.plans.strategy import parse, simplify

    for text in ("a _GT_ 1 AND a _GT_ 1 AND b _LT_ 2", "( a _GT_ 1 OR b _LT_ 2 ) AND ( a _GT_ 1 OR b _LT_ 2 )", "a _GT_ a OR b _LT_ 2 OR c _GT_ 0", "( a _GT_ 1 AND b _LT_ 2 ) OR c _GT_ 0"):
        s = parse(f"LONG WHEN {text} EXIT SL=1")
        t = simplify(s)
        for bits in range(8):
            value = {"a _GT_ 1": bits & 1, "b _LT_ 2": bits >> 1 & 1, "c _GT_ 0": bits >> 2, "a _GT_ a": 0}
            of = lambda x: logic(x.logic, [bool(value[f"{c.left} {c.op} {c.right}"]) for c in x.conditions])  # noqa: B023, E731
            assert bool(of(s)) == bool(of(t))
        assert len(t.conditions) == len(set(t.conditions)) and not any(c.left == c.right for c in t.conditions)


def test_fronts_and_crowding():
    from barloom.plans.evolve import crowding, fronts

    draw = np.random.default_rng(1)
    x, v = draw.integers(0, 6, (60, 2)).astype(float), draw.choice([0, 0, 0, 1, 2], 60).astype(float)

    def beats(a, b):
        if v[a] > 0 or v[b] > 0:
            return v[a] < v[b]
        return (x[a] >= x[b]).all() and (x[a] > x[b]).any()

    rank = {}
    left = set(range(60))
    while left:
        now = {a for a in left if not any(beats(b, a) for b in left)}
        rank |= dict.fromkeys(now, max(rank.values(), default=0) + 1)
        left -= now
    assert fronts(x, v).tolist() == [rank[k] for k in range(60)]
    far = crowding(np.array([[0, 4], [1, 3], [3, 1], [4, 0.0]]))
    assert far[0] == far[3] == math.inf and far[1] == pytest.approx(3 / 4 + 3 / 4)


def test_cmaes_finds_a_minimum():
    from barloom.plans.evolve import Cmaes

    target = np.array([0.4, -0.7, 0.2, 0.9])
    search = Cmaes(4, 12, 3)
    for _ in range(80):
        asked = search.ask()
        search.tell([-float((((x - target) * [1, 5, 2, 9]) ** 2).sum()) for x in asked])
    assert np.allclose(search.mean, target, atol=1e-2)


def test_searches_keep_what_is_good(spark, sf_dir):
    from barloom.plans import evolve
    from barloom.plans.strategy import parse
    from barloom.sources.bars import event_bars

    bars = event_bars(spark, sf_dir).persist()
    niched = evolve.Niched(bars, 3600, 5)
    last = niched.run(9, 2)
    assert len(last) == 9 and niched.history[1][1] >= niched.history[0][1] and len({m.expression for m in last if m.expression}) == sum(m.expression is not None for m in last)
    tuned = evolve.tune(bars, parse(evolve.BASE), rounds=1, size=4, seeds=1, resamples=2)
    assert tuned.accepted == (tuned.strategy.expression != parse(evolve.BASE).expression) or tuned.accepted
    assert not tuned.accepted or tuned.after >= tuned.before
    bars.unpersist()


def test_mutation_and_crossover_of_lists():
    from barloom.plans.evolve import crossover, mutate

    draw = random.Random(1)
    a, b = [0] * 50, [1] * 50
    for _ in range(50):
        c, d = crossover(a, b, draw, 10)
        assert [x + y for x, y in zip(c, d, strict=True)] == [1] * 50 and 0 < sum(c) < 50
    assert mutate(a, 0.0, 0.0, draw, 50) == a
    changed = [sum(x != 0 for x in mutate(a, 0.1, 0.5, draw, 25)[:25]) for _ in range(300)]
    assert 0.15 < sum(changed) / 300 / 25 < 0.25
