"""Signals and back-tests; the oracle runs the position machine as one recursive CTE."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from barloom.functions.indicators import add, order
from barloom.operators import backtest as BT
from barloom.operators.kernel import Rules
from barloom.operators.splits import hashed
from barloom.plans.strategy import parse, small_strategies, with_signals
from barloom.queries import register
from barloom.queries import sql as S
from barloom.queries.indicators import rnd
from barloom.sources import bars as B

COST = 0.0002

SIGNAL = S.staged(
    "bars",
    {"lo14": S.g("min", "low", 14), "hi14": S.g("max", "high", 14), "tr": S.TR, "va": S.g("avg", "volume", 10), "n": f"row_number() OVER ({S.O})"},
    {"k": "100*(close - lo14)/nullif(hi14 - lo14, 0)", "atr": S.ewm("tr", 2 / 15)},
    {"sig": "coalesce(k < 20, false) AND coalesce(volume/nullif(va, 0) > 1.0, false)", "sig_short": "coalesce(k > 80, false)"},
)


def machine(signal: str, rules: Rules, source: str = "z", tag: str = "") -> str:
    """CTEs ``r`` (the state after each bar) and ``t`` (trades) of the position machine over ``source``; ``tag`` is put behind their names."""
    s = 1 if rules.direction == "LONG" else -1
    bad, good = ("low", "high") if s > 0 else ("high", "low")
    better = "greatest" if s > 0 else "least"
    d = lambda x: f"({x!r})::DOUBLE"
    enter, leave = d(1 + s * rules.cost), d(1 - s * rules.cost)
    trail, tp, sl = d(float(rules.trail)), d(float(rules.tp)), d(float(rules.sl))
    target = f"p.tp > 0 AND {s}*(b.{good} - p.target) >= 0" if rules.tp > 0 else "false"
    stop = f"{s}*(b.{bad} - y.stop2) <= 0"
    first = f"WHEN {target} THEN 'target' WHEN {stop} THEN" if rules.target_first else f"WHEN {stop} THEN"
    go = f"b.{signal} AND coalesce(b.atr > 0, false)"
    state, last, out = f"r{tag}", f"last_bar{tag}", f"t{tag}"
    return f"""
{state} AS (
  SELECT symbol, n, {signal} AND coalesce(atr > 0, false) AS held, close*{enter} AS entry, close*{enter} - {s}*{sl}*atr AS stop, close*{enter} + {s}*{tp}*atr AS target, {tp} AS tp,
    close*{enter} AS best, atr AS size, n AS since, false AS moved, 100.0::DOUBLE AS eq, NULL::VARCHAR AS kind, NULL::DOUBLE AS pnl, NULL::DOUBLE AS px, 0::BIGINT AS t_entry, 0.0::DOUBLE AS t_price
  FROM {source} WHERE n = 1
  UNION ALL
  SELECT b.symbol, b.n, CASE WHEN p.held THEN w.kind IS NULL ELSE {go} END,
    CASE WHEN p.held THEN p.entry ELSE b.close*{enter} END,
    CASE WHEN p.held THEN y.stop2 ELSE b.close*{enter} - {s}*{sl}*b.atr END,
    CASE WHEN p.held THEN p.target ELSE b.close*{enter} + {s}*{tp}*b.atr END, p.tp,
    CASE WHEN p.held THEN x.best2 ELSE b.close*{enter} END,
    CASE WHEN p.held THEN p.size ELSE b.atr END,
    CASE WHEN p.held THEN p.since ELSE b.n END,
    CASE WHEN p.held THEN y.moved2 ELSE false END,
    CASE WHEN w.kind IS NULL THEN p.eq ELSE p.eq*(1 + {s}*(v.raw*{leave} - p.entry)/p.entry) END,
    w.kind, CASE WHEN w.kind IS NOT NULL THEN {s}*(v.raw*{leave} - p.entry)/p.entry END, CASE WHEN w.kind IS NOT NULL THEN v.raw*{leave} END, p.since, p.entry
  FROM {state} p JOIN {source} b ON b.symbol = p.symbol AND b.n = p.n + 1,
  LATERAL (SELECT {better}(p.best, b.{good}) AS best2) x,
  LATERAL (SELECT CASE WHEN {trail} > 0 AND {s}*((x.best2 - {s}*{trail}*p.size) - p.stop) > 0 THEN x.best2 - {s}*{trail}*p.size ELSE p.stop END AS stop2,
    p.moved OR ({trail} > 0 AND {s}*((x.best2 - {s}*{trail}*p.size) - p.stop) > 0) AS moved2) y,
  LATERAL (SELECT CASE WHEN NOT p.held THEN NULL {first} (CASE WHEN {trail} > 0 AND y.moved2 THEN 'trail' ELSE 'stop' END) {'' if rules.target_first else f"WHEN {target} THEN 'target'"} WHEN b.n - p.since >= {rules.hold} THEN 'time' END AS kind) w,
  LATERAL (SELECT CASE w.kind WHEN 'target' THEN p.target WHEN 'time' THEN b.close ELSE y.stop2 END AS raw) v
),
{last} AS (SELECT symbol, max(n) AS n FROM {source} GROUP BY 1),
{out} AS (
  SELECT symbol, t_entry - 1 AS entry_bar, n - 1 AS exit_bar, kind, pnl, t_price AS entry_price, px AS exit_price FROM {state} WHERE kind IS NOT NULL
  UNION ALL
  SELECT {state}.symbol, since - 1, {state}.n - 1, 'eod', {s}*(b.close*{leave} - entry)/entry, entry, b.close*{leave}
  FROM {state} JOIN {last} USING (symbol, n) JOIN {source} b ON b.symbol = {state}.symbol AND b.n = {state}.n WHERE held
)"""


TRADES_OUT = f"symbol, entry_bar, exit_bar, kind, {S.rnd('pnl')} AS pnl"


def recursive(*ctes: str, select: str) -> str:
    return S.query(*ctes, select=select).replace("WITH ", "WITH RECURSIVE ", 1)


def signals(spark, sf_dir) -> DataFrame:
    """Hourly bars with ``atr`` and two signals."""
    made = {"s1": parse("LONG WHEN STOCH_K(14) _LT_ 20 AND VOL_RATIO(10) _GT_ 1.0 EXIT TP=3.0 SL=1.5"), "s2": parse("SHORT WHEN STOCH_K(14) _GT_ 80 EXIT TP=3.0 SL=1.5")}
    return with_signals(B.event_bars(spark, sf_dir), made, B.HOUR, {"atr": ("ATR", (14,))})


@register("sig_generate", S.query(S.BARS, SIGNAL, select="SELECT symbol, ts, sig AS s1, sig_short AS s2 FROM z"))
def sig_generate(spark, sf_dir):
    return signals(spark, sf_dir).select("symbol", "ts", "s1", "s2")


def _bt(name: str, signal: str, column: str, rules: Rules) -> None:
    @register(name, recursive(S.BARS, SIGNAL, machine(column, rules), select=f"SELECT {TRADES_OUT} FROM t"))
    def run(spark, sf_dir):
        rows = BT.bar_form(signals(spark, sf_dir), [signal])
        return BT.trades(rows, {signal: rules}).select("symbol", "entry_bar", "exit_bar", "kind", rnd("pnl").alias("pnl"))


_bt("bt_single_window", "s1", "sig", Rules("LONG", 3.0, 1.5, 0.0, COST))
_bt("bt_single_window_trail", "s1", "sig", Rules("LONG", 3.0, 1.5, 2.0, COST))
_bt("bt_single_window_short", "s2", "sig_short", Rules("SHORT", 0.0, 1.5, 2.0, COST))
_bt("bt_v1", "s1", "sig", Rules("LONG", 2.0, 2.0, 0.0, 0.001, hold=12))
_bt("bt_futures_target_first", "s1", "sig", Rules("LONG", 1.0, 1.0, 0.0, COST, target_first=True))


def _shuffled(name: str, rules: Rules) -> None:
    """Signals dealt to bars in the order of a hash: as many signals as before, at random places."""
    order_sql = "PARTITION BY symbol ORDER BY ('0x' || substr(md5('1:0:' || ts), 1, 8))::BIGINT, ts"
    place = S.staged("z", {"place": f"row_number() OVER ({order_sql})", "total": "count(*) FILTER (WHERE sig) OVER (PARTITION BY symbol)"}).replace("z AS", "zs AS", 1)
    shuffled = "zz AS (SELECT *, place <= total AS sh FROM zs)"

    @register(name, recursive(S.BARS, SIGNAL, place, shuffled, machine("sh", rules, "zz"), select=f"SELECT {TRADES_OUT} FROM t"))
    def run(spark, sf_dir):
        from pyspark.sql import Window as W

        df = signals(spark, sf_dir)
        by = W.partitionBy("symbol")
        df = df.withColumn("place", F.row_number().over(by.orderBy(hashed(1, 0, F.col("ts").cast("string")), "ts")))
        df = df.withColumn("total", F.count(F.when(F.col("s1"), 1)).over(by)).withColumn("sh", F.col("place") <= F.col("total"))
        return BT.trades(BT.bar_form(df, ["sh"]), {"sh": rules}).select("symbol", "entry_bar", "exit_bar", "kind", rnd("pnl").alias("pnl"))


_shuffled("bt_shuffled", Rules("LONG", 3.0, 1.5, 0.0, COST))
_shuffled("bt_shuffled_full", Rules("LONG", 3.0, 1.5, 2.0, COST))


def small_rules() -> dict[str, Rules]:
    return {k: Rules(s.direction, s.tp, s.sl or 1.5, s.trail, COST) for k, s in small_strategies().items()}


def small_rows(spark, sf_dir) -> DataFrame:
    made = small_strategies()
    return BT.bar_form(with_signals(B.event_bars(spark, sf_dir), made, B.HOUR, {"atr": ("ATR", (14,))}), list(made))


@register("bt_strategies_small")
def bt_strategies_small(spark, sf_dir):
    out = BT.trades(small_rows(spark, sf_dir), small_rules())
    return out.groupBy("strategy_id", "symbol").agg(F.count("*").alias("n_trades"), F.round(F.sum("pnl"), 4).alias("pnl"))


# stateless pieces

@register("bt_cost", S.query(S.BARS, select=f"SELECT symbol, ts, {S.rnd('close*1.0002')} AS le, {S.rnd('close*0.9998')} AS lx, {S.rnd('close*0.9998')} AS se, {S.rnd('close*1.0002')} AS sx FROM bars"))
def bt_cost(spark, sf_dir):
    c = F.col("close")
    made = {"le": ("LONG", True), "lx": ("LONG", False), "se": ("SHORT", True), "sx": ("SHORT", False)}
    return B.event_bars(spark, sf_dir).select("symbol", "ts", *[rnd(BT.costed(c, d, e, COST)).alias(k) for k, (d, e) in made.items()])


@register("bt_exit_levels", S.query(S.BARS, SIGNAL, select=f"SELECT symbol, ts, {S.rnd('close - 1.5*atr')} AS ls, {S.rnd('close + 3*atr')} AS lt, {S.rnd('close + 1.5*atr')} AS ss, {S.rnd('close - 3*atr')} AS st FROM z"))
def bt_exit_levels(spark, sf_dir):
    df = add(B.event_bars(spark, sf_dir), {"atr": ("ATR", (14,))})
    ls, lt = BT.exit_levels(F.col("close"), F.col("atr"), "LONG", 3.0, 1.5)
    ss, st = BT.exit_levels(F.col("close"), F.col("atr"), "SHORT", 3.0, 1.5)
    return df.select("symbol", "ts", rnd(ls).alias("ls"), rnd(lt).alias("lt"), rnd(ss).alias("ss"), rnd(st).alias("st"))


@register("bt_exit_check", S.query(S.BARS, S.staged("bars", {"pc": S.lag("close")}), select="SELECT symbol, ts, CASE WHEN low <= pc*0.99 THEN 'stop' WHEN high >= pc*1.01 THEN 'target' END AS kind FROM z"))
def bt_exit_check(spark, sf_dir):
    df = B.event_bars(spark, sf_dir).withColumn("pc", F.lag("close", 1).over(order()))
    return df.select("symbol", "ts", BT.exit_kind(F.col("high"), F.col("low"), F.col("pc") * 0.99, F.col("pc") * 1.01, "LONG").alias("kind"))


@register("bt_time_exit", S.query(S.BARS, select=f"SELECT symbol, ts, row_number() OVER ({S.O}) - 1 + 12 AS exit_bar FROM bars"))
def bt_time_exit(spark, sf_dir):
    return B.event_bars(spark, sf_dir).select("symbol", "ts", (F.row_number().over(order()) - 1 + 12).cast("bigint").alias("exit_bar"))


_SIZE = "least(1000*0.02/nullif(abs(close - low*0.98)/close, 0), 1000*10.0, 1000*0.95*10.0)"


@register("bt_position_size", S.query(S.BARS, select=f"SELECT symbol, ts, {S.rnd(_SIZE)} AS notional, {S.rnd(_SIZE + '/10')} AS margin, {S.rnd(_SIZE + '/close')} AS contracts FROM bars"))
def bt_position_size(spark, sf_dir):
    n, m, c = BT.position_size(F.lit(1000.0), 0.02, F.col("close"), F.col("low") * 0.98, 10.0)
    return B.event_bars(spark, sf_dir).select("symbol", "ts", rnd(n).alias("notional"), rnd(m).alias("margin"), rnd(c).alias("contracts"))


_TRADES = [S.BARS, SIGNAL, machine("sig", Rules("LONG", 3.0, 1.5, 0.0, COST))]


def base_trades(spark, sf_dir) -> DataFrame:
    return BT.trades(BT.bar_form(signals(spark, sf_dir), ["s1"]), {"s1": Rules("LONG", 3.0, 1.5, 0.0, COST)})


@register("bt_futures", recursive(*_TRADES, select=f"SELECT symbol, exit_bar, kind, {S.rnd('500*pnl')} AS usd, {S.rnd('5000*pnl')} AS on_margin FROM t"))
def bt_futures(spark, sf_dir):
    t = base_trades(spark, sf_dir)
    return t.select("symbol", "exit_bar", "kind", rnd(500 * F.col("pnl")).alias("usd"), rnd(5000 * F.col("pnl")).alias("on_margin"))


@register("bt_futures_close", recursive(*_TRADES, select=f"SELECT symbol, entry_bar, {S.rnd('entry_price')} AS entry_price, {S.rnd('exit_price')} AS exit_price, exit_bar - entry_bar AS held FROM t"))
def bt_futures_close(spark, sf_dir):
    t = base_trades(spark, sf_dir)
    return t.select("symbol", "entry_bar", rnd("entry_price").alias("entry_price"), rnd("exit_price").alias("exit_price"), F.col("bars_held").alias("held"))


@register("bt_futures_equity", recursive(*_TRADES, select=f"SELECT symbol, exit_bar, {S.rnd('1000 + sum(500*pnl) OVER (PARTITION BY symbol ORDER BY exit_bar)')} AS equity FROM t"))
def bt_futures_equity(spark, sf_dir):
    from pyspark.sql import Window as W

    w = W.partitionBy("symbol").orderBy("exit_bar").rowsBetween(W.unboundedPreceding, 0)
    return base_trades(spark, sf_dir).select("symbol", "exit_bar", rnd(1000 + F.sum(500 * F.col("pnl")).over(w)).alias("equity"))


@register("bt_futures_metrics", recursive(*_TRADES, select="SELECT symbol, count(*) AS n, round(avg(CASE WHEN pnl > 0 THEN 1.0::DOUBLE ELSE 0.0 END), 6) AS win_rate, round(CASE WHEN sum(CASE WHEN pnl < 0 THEN -pnl ELSE 0 END) > 0 THEN sum(CASE WHEN pnl > 0 THEN pnl ELSE 0 END)/sum(CASE WHEN pnl < 0 THEN -pnl ELSE 0 END) ELSE 0 END, 6)::DOUBLE AS pf FROM t GROUP BY 1"))
def bt_futures_metrics(spark, sf_dir):
    from barloom.operators.metrics import profit_factor

    p = F.col("pnl")
    out = base_trades(spark, sf_dir).groupBy("symbol").agg(F.count("*").alias("n"), F.round(F.avg((p > 0).cast("double")), 6).alias("win_rate"), F.sum(F.when(p > 0, p).otherwise(0.0)).alias("g"), F.sum(F.when(p < 0, -p).otherwise(0.0)).alias("l"))
    return out.select("symbol", "n", "win_rate", F.round(profit_factor(F.col("g"), F.col("l"), 0.0), 6).alias("pf"))


@register("bt_usd", recursive(*_TRADES, select=f"SELECT symbol, exit_bar, {S.rnd('1000*exp(sum(ln(1 + pnl)) OVER (PARTITION BY symbol ORDER BY exit_bar))', 4)} AS usd FROM t"))
def bt_usd(spark, sf_dir):
    return BT.compounded(base_trades(spark, sf_dir), 1000.0, ["symbol"], "exit_bar").select("symbol", "exit_bar", rnd("usd", 4).alias("usd"))
