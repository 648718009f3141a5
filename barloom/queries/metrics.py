"""Figures of curves and trades, fitness, reports and portfolios."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from barloom.functions.indicators import order
from barloom.operators import backtest as BT
from barloom.operators import distributions as D
from barloom.operators import metrics as M
from barloom.operators import portfolio as P
from barloom.queries import register
from barloom.queries import sql as S
from barloom.queries.backtests import COST, SIGNAL, _TRADES, base_trades, machine, recursive, signals
from barloom.operators.kernel import Rules
from barloom.plans import explain as E
from barloom.queries.indicators import rnd
from barloom.sources import bars as B

YEAR = 8760.0  # hourly bars
RET = S.staged("bars", {"r": f"close/nullif({S.lag('close')}, 0) - 1", "pk": f"max(close) OVER {S.ALL}"}, {"dd": "(close - pk)/pk"})


def q(select: str, *ctes: str) -> str:
    return S.query(S.BARS, *ctes, select=select)


def curve(spark, sf_dir):
    return B.event_bars(spark, sf_dir).select("symbol", "ts", "close", F.col("close").alias("equity"))


FIG = {
    "cagr": f"pow(arg_max(close, ts)/arg_min(close, ts), {YEAR}/count(*)) - 1",
    "max_dd": "min(dd)",
    "ulcer": "sqrt(avg(dd*dd))",
    "sharpe": f"coalesce(CASE WHEN stddev_samp(r) > 0 THEN avg(r)*{YEAR}/(stddev_samp(r)*sqrt({YEAR})) END, 0.0)",
    "sortino": f"CASE WHEN stddev_samp(CASE WHEN r < 0 THEN r END) > 0 THEN avg(r)/stddev_samp(CASE WHEN r < 0 THEN r END)*sqrt({YEAR}) ELSE 999.0 END",
    "sortino_rms": f"CASE WHEN sqrt(avg(CASE WHEN r < 0 THEN r*r END)) > 0 THEN avg(r)/sqrt(avg(CASE WHEN r < 0 THEN r*r END))*sqrt({YEAR}) ELSE 0.0 END",
    "volatility": f"stddev_samp(r)*sqrt({YEAR})",
    "total_return": "arg_max(close, ts)/arg_min(close, ts) - 1",
    "win_rate": "avg(CASE WHEN r IS NOT NULL THEN (r > 0)::INT::DOUBLE END)",
    "profit_factor": "CASE WHEN sum(CASE WHEN r < 0 THEN -r END) > 0 THEN sum(CASE WHEN r > 0 THEN r END)/sum(CASE WHEN r < 0 THEN -r END) ELSE 999.0 END",
}
_AGG = "f AS (SELECT symbol, count(*) AS n, " + ", ".join(f"{e} AS {k}" for k, e in FIG.items()) + " FROM z GROUP BY 1)"
DERIVED = {
    "calmar": "CASE WHEN cagr <= 0 THEN 0.0 WHEN max_dd >= -0.01 THEN cagr*100 ELSE cagr/abs(max_dd) END",
    "upi": "CASE WHEN ulcer > 0 THEN cagr/ulcer WHEN cagr > 0 THEN 100.0 ELSE 0.0 END",
}


def _figure(name: str, *columns: str) -> None:
    made = ", ".join(f"{S.rnd(DERIVED.get(c, c))} AS {c}" for c in columns)

    @register(name, q(f"SELECT symbol, {made} FROM f", RET, _AGG))
    def run(spark, sf_dir):
        return M.bundle(curve(spark, sf_dir), ["symbol"], YEAR).select("symbol", *[rnd(c).alias(c) for c in columns])


_figure("met_ulcer", "ulcer")
_figure("met_upi", "upi")
_figure("met_sharpe", "sharpe")
_figure("met_max_dd", "max_dd")
_figure("met_cagr", "cagr")
_figure("met_sortino", "sortino")
_figure("met_sortino_rms", "sortino_rms")
_figure("met_calmar", "calmar")
_figure("met_volatility", "volatility")
_figure("met_total_return", "total_return")
_figure("met_all", *FIG, *DERIVED)


@register("met_returns", q(f"SELECT symbol, ts, {S.rnd('r', 8)} AS r FROM z", RET))
def met_returns(spark, sf_dir):
    return M.returns(curve(spark, sf_dir), ["symbol"]).select("symbol", "ts", rnd("r", 8).alias("r"))


@register("met_drawdown", q(f"SELECT symbol, ts, {S.rnd('dd', 8)} AS dd FROM z", RET))
def met_drawdown(spark, sf_dir):
    return M.returns(curve(spark, sf_dir), ["symbol"]).select("symbol", "ts", rnd("dd", 8).alias("dd"))


_TF = """tf AS (SELECT symbol, count(*) AS n_trades, count(*) FILTER (WHERE pnl > 0) AS wins, coalesce(sum(CASE WHEN pnl > 0 THEN pnl END), 0.0) AS won, abs(coalesce(sum(CASE WHEN pnl < 0 THEN pnl END), 0.0)) AS lost FROM t GROUP BY 1),
tg AS (SELECT *, wins::DOUBLE/n_trades AS win_rate, won/greatest(lost, 1e-10) AS profit_factor, won/greatest(wins, 1) AS avg_win, lost/greatest(n_trades - wins, 1) AS avg_loss FROM tf)"""


@register("met_winrate_pf", recursive(*_TRADES, _TF, select=f"SELECT symbol, n_trades, {S.rnd('win_rate')} AS win_rate, {S.rnd('profit_factor')} AS profit_factor FROM tg"))
def met_winrate_pf(spark, sf_dir):
    return M.trade_figures(base_trades(spark, sf_dir), ["symbol"]).select("symbol", "n_trades", rnd("win_rate").alias("win_rate"), rnd("profit_factor").alias("profit_factor"))


@register("met_window", recursive(*_TRADES, _TF, select=f"SELECT symbol, n_trades, {S.rnd('win_rate')} AS win_rate, {S.rnd('profit_factor')} AS profit_factor, {S.rnd('win_rate*avg_win - (1 - win_rate)*avg_loss')} AS expectancy, {S.rnd('100*(eq/100.0 - 1)')} AS return_pct FROM tg JOIN (SELECT symbol, 100*exp(sum(ln(1 + pnl))) AS eq FROM t GROUP BY 1) USING (symbol)"))
def met_window(spark, sf_dir):
    t = base_trades(spark, sf_dir)
    out = M.trade_figures(t, ["symbol"]).join(t.groupBy("symbol").agg(F.max_by("equity", "exit_bar").alias("eq")), "symbol")
    return out.select("symbol", "n_trades", *[rnd(c).alias(c) for c in ("win_rate", "profit_factor", "expectancy")], rnd(100 * (F.col("eq") / 100 - 1)).alias("return_pct"))


@register("met_usd", recursive(*_TRADES, select=f"SELECT symbol, count(*) AS n, {S.rnd('sum(500*pnl)')} AS total, {S.rnd('max(500*pnl)')} AS best, {S.rnd('min(500*pnl)')} AS worst, {S.rnd('avg(500*pnl)')} AS mean FROM t GROUP BY 1"))
def met_usd(spark, sf_dir):
    usd = 500 * F.col("pnl")
    return base_trades(spark, sf_dir).groupBy("symbol").agg(F.count("*").alias("n"), rnd(F.sum(usd)).alias("total"), rnd(F.max(usd)).alias("best"), rnd(F.min(usd)).alias("worst"), rnd(F.avg(usd)).alias("mean"))


_REG = "tr2 AS (SELECT t.*, CASE WHEN b.close > b.open THEN 'up' ELSE 'down' END AS regime FROM t JOIN z b ON b.symbol = t.symbol AND b.n - 1 = t.entry_bar)"


@register("join_regime_entry", recursive(*_TRADES, _REG, select=f"SELECT symbol, entry_bar, regime, {S.rnd('pnl')} AS pnl FROM tr2"))
def join_regime_entry(spark, sf_dir):
    return P.label_trades(base_trades(spark, sf_dir), _labels(spark, sf_dir)).select("symbol", "entry_bar", "regime", rnd("pnl").alias("pnl"))


def _labels(spark, sf_dir):
    return B.event_bars(spark, sf_dir).select("symbol", "ts", F.when(F.col("close") > F.col("open"), "up").otherwise("down").alias("regime"))


@register("met_regime_pf", recursive(*_TRADES, _REG, select="SELECT symbol, regime, round(CASE WHEN sum(CASE WHEN pnl < 0 THEN -pnl ELSE 0 END) > 0 THEN sum(CASE WHEN pnl > 0 THEN pnl ELSE 0 END)/sum(CASE WHEN pnl < 0 THEN -pnl ELSE 0 END) ELSE 10.0 END, 6)::DOUBLE AS pf FROM tr2 GROUP BY 1, 2"))
def met_regime_pf(spark, sf_dir):
    t = P.label_trades(base_trades(spark, sf_dir), _labels(spark, sf_dir))
    p = F.col("pnl")
    out = t.groupBy("symbol", "regime").agg(F.sum(F.when(p > 0, p).otherwise(0.0)).alias("g"), F.sum(F.when(p < 0, -p).otherwise(0.0)).alias("l"))
    return out.select("symbol", "regime", F.round(M.profit_factor(F.col("g"), F.col("l"), 10.0), 6).alias("pf"))


_CORR = "cr AS (SELECT a.symbol AS a, b.symbol AS b, coalesce(corr(a.r, b.r), 0.0) AS corr FROM z a JOIN z b ON a.ts = b.ts AND a.symbol < b.symbol GROUP BY 1, 2)"


def corr_rows(spark, sf_dir):
    return M.correlations(M.returns(curve(spark, sf_dir), ["symbol"]))


@register("met_corr_matrix", q(f"SELECT a, b, {S.rnd('corr')} AS corr FROM cr", RET, _CORR))
def met_corr_matrix(spark, sf_dir):
    return corr_rows(spark, sf_dir).select("a", "b", rnd("corr").alias("corr"))


@register("met_avg_pairwise", q(f"SELECT {S.rnd('avg(corr)')} AS corr FROM cr", RET, _CORR))
def met_avg_pairwise(spark, sf_dir):
    return corr_rows(spark, sf_dir).agg(rnd(F.avg("corr")).alias("corr"))


# generations: one event type a module, one day a generation

GEN = "gen AS (SELECT epoch_us(ts)//86400000000 AS g, event_id AS id, value AS fitness, event_type AS module, user_id FROM events)"


def generations(spark, sf_dir):
    ev = B.table(spark, sf_dir, "events")
    return ev.select(F.expr("cast(floor(0) as bigint)").alias("_"), F.floor(B.epoch_micros("ts") / 86_400_000_000).alias("g"), F.col("event_id").alias("id"), F.col("value").alias("fitness"), F.col("event_type").alias("module"), "user_id").drop("_")


@register("met_evo_stats", S.query(GEN, select="SELECT g, count(*) AS n, round(avg(fitness), 6) AS mean, round(stddev_pop(fitness), 6) AS sd, min(fitness) AS lo, max(fitness) AS hi, round(median(fitness), 6) AS med, round(quantile_cont(fitness, 0.25), 6) AS q25, round(quantile_cont(fitness, 0.75), 6) AS q75, round(count(DISTINCT user_id)::DOUBLE/count(*), 6) AS diversity FROM gen GROUP BY 1"))
def met_evo_stats(spark, sf_dir):
    p = F.percentile("fitness", F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75)))
    out = generations(spark, sf_dir).groupBy("g").agg(F.count("*").alias("n"), F.round(F.avg("fitness"), 6).alias("mean"), F.round(F.stddev_pop("fitness"), 6).alias("sd"), F.min("fitness").alias("lo"), F.max("fitness").alias("hi"), p.alias("p"), F.round(F.count_distinct("user_id") / F.count("*"), 6).alias("diversity"))
    return out.select("g", "n", "mean", "sd", "lo", "hi", F.round(F.col("p")[1], 6).alias("med"), F.round(F.col("p")[0], 6).alias("q25"), F.round(F.col("p")[2], 6).alias("q75"), "diversity")


_BEST = "best AS (SELECT g, max(fitness) AS m FROM gen GROUP BY 1), bl AS (SELECT *, m - lag(m) OVER (ORDER BY g) AS d FROM best)"


@register("met_stagnation", S.query(GEN, _BEST, select="SELECT count(*) FILTER (WHERE d < 0.01) AS n FROM bl"))
def met_stagnation(spark, sf_dir):
    best = generations(spark, sf_dir).groupBy("g").agg(F.max("fitness").alias("m"))  # one row a generation
    return best.withColumn("d", F.col("m") - F.lag("m", 1).over(W.orderBy("g"))).agg(F.count(F.when(F.col("d") < 0.01, 1)).alias("n"))


@register("met_diversity", S.query(GEN, select="SELECT g, round(count(DISTINCT mods)::DOUBLE/count(*), 6) AS v FROM (SELECT g, user_id, list_sort(list_distinct(list(module))) AS mods FROM gen GROUP BY 1, 2) GROUP BY 1"))
def met_diversity(spark, sf_dir):
    sets = generations(spark, sf_dir).groupBy("g", "user_id").agg(F.array_sort(F.collect_set("module")).alias("mods"))
    return sets.groupBy("g").agg(F.round(F.count_distinct("mods") / F.count("*"), 6).alias("v"))


@register("met_module_trends", S.query(GEN, select="SELECT module, max(n) AS peak FROM (SELECT g, module, count(*) AS n FROM gen GROUP BY 1, 2) GROUP BY 1 ORDER BY peak DESC, module LIMIT 10"))
def met_module_trends(spark, sf_dir):
    used = generations(spark, sf_dir).groupBy("g", "module").agg(F.count("*").alias("n"))
    return used.groupBy("module").agg(F.max("n").alias("peak")).orderBy(F.desc("peak"), "module").limit(10)


# fitness; a window is a week of a symbol, its trades are its bars' returns

WEEK = """wk AS (SELECT symbol AS strategy_id, ts//604800 AS window_id, count(r) AS n_trades, avg(r)/nullif(stddev_samp(r), 0)*10 AS sortino, 100*(arg_max(close, ts)/arg_min(close, ts) - 1) AS return_pct, min(dd) AS max_dd,
  avg(CASE WHEN r IS NOT NULL THEN (r > 0)::INT::DOUBLE END) AS win_rate, coalesce(sum(CASE WHEN r > 0 THEN r END), 0)/greatest(coalesce(sum(CASE WHEN r < 0 THEN -r END), 0), 1e-10) AS profit_factor, avg(r) AS expectancy FROM z GROUP BY 1, 2),
wc AS (SELECT *, least(sortino, 5.0) + greatest(return_pct/100, 0.0)*10 + greatest(least(CASE WHEN return_pct > 0 THEN (return_pct/100)/greatest(abs(max_dd), 0.01) ELSE 0.0 END, 5.0), 0.0)*0.3
  + CASE WHEN profit_factor > 1 THEN least(profit_factor - 1, 3.0) ELSE 0.0 END + CASE WHEN expectancy > 0 THEN least(greatest(expectancy + 0.5 - 1, 0.0), 3.0) ELSE 0.0 END AS composite FROM wk)"""


def weeks(spark, sf_dir):
    r = F.col("r")
    df = M.returns(curve(spark, sf_dir), ["symbol"]).groupBy(F.col("symbol").alias("strategy_id"), F.expr("ts div 604800").alias("window_id")).agg(
        F.count("r").alias("n_trades"), (F.avg("r") / F.nullif(F.stddev_samp("r"), F.lit(0.0)) * 10).alias("sortino"), (100 * (F.max_by("close", "ts") / F.min_by("close", "ts") - 1)).alias("return_pct"), F.min("dd").alias("max_dd"),
        F.avg(F.when(r.isNotNull(), (r > 0).cast("double"))).alias("win_rate"), (F.coalesce(F.sum(F.when(r > 0, r)), F.lit(0.0)) / F.greatest(F.coalesce(F.sum(F.when(r < 0, -r)), F.lit(0.0)), F.lit(1e-10))).alias("profit_factor"), F.avg("r").alias("expectancy"),
    )
    return df.withColumn("composite", M.composite(*[F.col(c) for c in ("sortino", "return_pct", "max_dd", "profit_factor", "expectancy")]))


@register("fit_v2", q(f"SELECT strategy_id, window_id, {S.rnd('CASE WHEN n_trades < 20 OR win_rate < 0.15 OR abs(max_dd) > 0.35 OR expectancy <= 0 THEN -999.0 ELSE composite END')} AS fitness FROM wc", RET, WEEK))
def fit_v2(spark, sf_dir):
    failed = (F.col("n_trades") < 20) | (F.col("win_rate") < 0.15) | (F.abs("max_dd") > 0.35) | (F.col("expectancy") <= 0)
    return weeks(spark, sf_dir).select("strategy_id", "window_id", rnd(F.when(failed, -999.0).otherwise(F.col("composite"))).alias("fitness"))


@register("fit_objectives", q(f"SELECT strategy_id, {S.rnd('c[len(c)//2 + 1] - greatest(-c[1], 0.0)*0.3')} AS obj1, {S.rnd('obj2')} AS obj2, {S.rnd('st')} AS stability FROM (SELECT strategy_id, list_sort(list(composite)) AS c, avg((sortino > 0)::INT::DOUBLE) AS obj2, coalesce(-stddev_samp(sortino), 0.0) AS st FROM wc GROUP BY 1)", RET, WEEK))
def fit_objectives(spark, sf_dir):
    return M.objectives(weeks(spark, sf_dir)).select("strategy_id", *[rnd(c).alias(c) for c in ("obj1", "obj2", "stability")])


_V1 = "0.4*least(sortino/3, 1.0) + 0.4*least(CASE WHEN return_pct > 0 THEN (return_pct/100)/greatest(abs(max_dd), 0.01) ELSE 0.0 END/2, 1.0) + 0.2*win_rate - CASE WHEN n_trades > 160 THEN 0.1 ELSE 0.0 END"


@register("fit_v1", q(f"SELECT strategy_id, window_id, {S.rnd(f'CASE WHEN n_trades < 20 THEN -999.0 ELSE {_V1} END')} AS fitness FROM wk", RET, WEEK))
def fit_v1(spark, sf_dir):
    return weeks(spark, sf_dir).select("strategy_id", "window_id", rnd(P.fitness_v1()).alias("fitness"))


_LONG, _SHORT = Rules("LONG", 3.0, 1.5, 0.0, COST), Rules("SHORT", 3.0, 1.5, 0.0, COST)
_SIDES = """td AS (SELECT 'LONG' AS direction, * FROM tl UNION ALL SELECT 'SHORT', * FROM ts),
te AS (SELECT *, exp(sum(ln(1 + pnl)) OVER (PARTITION BY symbol, direction ORDER BY exit_bar)) AS eq FROM td),
tp AS (SELECT *, eq/greatest(max(eq) OVER (PARTITION BY symbol, direction ORDER BY exit_bar), 1.0) - 1 AS dd FROM te),
tf AS (SELECT symbol, direction, count(*) AS n_trades, avg(pnl)/nullif(stddev_samp(pnl), 0)*10 AS sortino, 100*(arg_max(eq, exit_bar) - 1) AS return_pct, min(dd) AS max_dd, avg((pnl > 0)::INT::DOUBLE) AS win_rate FROM tp GROUP BY 1, 2),
fd AS (SELECT *, coalesce(CASE WHEN n_trades < 20 THEN -999.0 ELSE """ + _V1 + """ END, -999.0) AS fitness FROM tf)"""


@register("fit_v1_bidir", recursive(S.BARS, SIGNAL, machine("sig", _LONG, "z", "l"), machine("sig", _SHORT, "z", "s"), _SIDES, select=f"SELECT symbol, direction, n_trades, {S.rnd('fitness')} AS fitness FROM (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY round(fitness, 9) DESC, direction) AS k FROM fd) WHERE k = 1"))
def fit_v1_bidir(spark, sf_dir):
    """The signal back-tested as a long and as a short entry; the better fitness, the long one on a tie."""
    rows = BT.bar_form(signals(spark, sf_dir).withColumn("LONG", F.col("s1")).withColumn("SHORT", F.col("s1")), ["LONG", "SHORT"])
    t = BT.trades(rows, {"LONG": _LONG, "SHORT": _SHORT}).withColumnRenamed("strategy_id", "direction")
    w = W.partitionBy("symbol", "direction").orderBy("exit_bar").rowsBetween(W.unboundedPreceding, 0)
    t = t.withColumn("eq", F.exp(F.sum(F.log(1 + F.col("pnl"))).over(w)))
    t = t.withColumn("dd", F.col("eq") / F.greatest(F.max("eq").over(w), F.lit(1.0)) - 1)
    each = t.groupBy("symbol", "direction").agg(
        F.count("*").alias("n_trades"), (F.avg("pnl") / F.nullif(F.stddev_samp("pnl"), F.lit(0.0)) * 10).alias("sortino"), (100 * (F.max_by("eq", "exit_bar") - 1)).alias("return_pct"),
        F.min("dd").alias("max_dd"), F.avg((F.col("pnl") > 0).cast("double")).alias("win_rate"),
    ).withColumn("fitness", F.coalesce(P.fitness_v1(), F.lit(-999.0)))
    best = F.row_number().over(W.partitionBy("symbol").orderBy(F.desc(F.round("fitness", 9)), "direction"))
    return each.withColumn("k", best).where("k = 1").select("symbol", "direction", "n_trades", rnd("fitness").alias("fitness"))


@register("fit_soft", q(f"SELECT strategy_id, window_id, {S.rnd('composite - 2*greatest(abs(max_dd) - 0.1, 0.0) - 0.05*greatest(30 - n_trades, 0)')} AS fitness FROM wc", RET, WEEK))
def fit_soft(spark, sf_dir):
    return weeks(spark, sf_dir).select("strategy_id", "window_id", rnd(P.soft_fitness()).alias("fitness"))


@register("eq_chain", q(f"SELECT strategy_id, window_id, {S.rnd('100*exp(sum(ln(1 + return_pct/100)) OVER (PARTITION BY strategy_id ORDER BY window_id))')} AS equity FROM wk", RET, WEEK))
def eq_chain(spark, sf_dir):
    w = W.partitionBy("strategy_id").orderBy("window_id").rowsBetween(W.unboundedPreceding, 0)
    return weeks(spark, sf_dir).select("strategy_id", "window_id", rnd(100 * F.exp(F.sum(F.log(1 + F.col("return_pct") / 100)).over(w))).alias("equity"))


# reports

_N = "SELECT symbol, sum(n)::BIGINT AS n FROM x GROUP BY 1"
_H = "SELECT z.symbol, least(floor((r - lo)/nullif(hi - lo, 0)*50), 49)::BIGINT AS bin, count(*) AS n FROM z JOIN (SELECT symbol, min(r) AS lo, max(r) AS hi FROM z GROUP BY 1) x ON x.symbol = z.symbol WHERE r IS NOT NULL GROUP BY 1, 2"


@register("rep_hist", q(_H, RET))
def rep_hist(spark, sf_dir):
    return M.histogram(M.returns(curve(spark, sf_dir), ["symbol"]), ["symbol"], "r", 50)


@register("rep_moments", q(f"SELECT symbol, {S.rnd('avg(r)', 8)} AS mean, {S.rnd('stddev_samp(r)', 8)} AS sd, {S.rnd('skewness(r)')} AS skew, {S.rnd('kurtosis(r)')} AS kurt FROM z GROUP BY 1", RET))
def rep_moments(spark, sf_dir):
    out = M.moments(M.returns(curve(spark, sf_dir), ["symbol"]), ["symbol"], "r")
    return out.select("symbol", rnd("mean", 8).alias("mean"), rnd("sd", 8).alias("sd"), rnd("skew").alias("skew"), rnd("kurt").alias("kurt"))


@register("rep_qq", q(f"SELECT symbol, i, round(r, 8) + 0.0 AS observed, round(m + sd*({D.normal_quantile_sql('p')}), 7) + 0.0 AS expected FROM (SELECT *, (i - 0.5)/n AS p FROM (SELECT symbol, r, row_number() OVER (PARTITION BY symbol ORDER BY r, ts) AS i, count(*) OVER (PARTITION BY symbol) AS n, avg(r) OVER (PARTITION BY symbol) AS m, stddev_samp(r) OVER (PARTITION BY symbol) AS sd FROM z WHERE r IS NOT NULL))", RET))
def rep_qq(spark, sf_dir):
    """Ordered returns beside the quantiles of a normal distribution of their mean and deviation."""
    by = W.partitionBy("symbol")
    df = M.returns(curve(spark, sf_dir), ["symbol"]).where("r is not null")
    df = df.select("symbol", "r", F.row_number().over(by.orderBy("r", "ts")).cast("bigint").alias("i"), F.count("*").over(by).alias("n"), F.avg("r").over(by).alias("m"), F.stddev_samp("r").over(by).alias("sd"))
    z = D.normal_quantile((F.col("i") - 0.5) / F.col("n"))
    return df.select("symbol", "i", rnd("r", 8).alias("observed"), rnd(F.col("m") + F.col("sd") * z, 7).alias("expected"))


@register("rep_compare", q(f"SELECT f.symbol, {S.rnd('100*(f.total_return - m.v)')} AS diff_pp FROM f, (SELECT avg(total_return) AS v FROM f) m", RET, _AGG))
def rep_compare(spark, sf_dir):
    out = M.bundle(curve(spark, sf_dir), ["symbol"], YEAR).select("symbol", "total_return")
    return out.crossJoin(F.broadcast(out.agg(F.avg("total_return").alias("v")))).select("symbol", rnd(100 * (F.col("total_return") - F.col("v"))).alias("diff_pp"))  # one row


@register("rep_wf_consistency", q(f"SELECT strategy_id, count(*) FILTER (WHERE return_pct > 0) AS positive, {S.rnd('avg(return_pct)')} AS mean, {S.rnd('stddev_pop(return_pct)')} AS sd, {S.rnd('min(return_pct)')} AS worst, sum(n_trades)::BIGINT AS trades FROM wk GROUP BY 1 ORDER BY avg(return_pct) DESC LIMIT 20", RET, WEEK))
def rep_wf_consistency(spark, sf_dir):
    x = F.col("return_pct")
    out = weeks(spark, sf_dir).groupBy("strategy_id").agg(F.count(F.when(x > 0, 1)).alias("positive"), F.avg(x).alias("m"), rnd(F.stddev_pop(x)).alias("sd"), rnd(F.min(x)).alias("worst"), F.sum("n_trades").alias("trades"))
    return out.orderBy(F.desc("m")).limit(20).select("strategy_id", "positive", rnd("m").alias("mean"), "sd", "worst", "trades")


_PREV = f"wp AS (SELECT *, lag(composite) OVER (PARTITION BY strategy_id ORDER BY window_id) AS before FROM wc)"


@register("rep_tuning_status", q("SELECT status, count(*) AS n FROM (SELECT CASE WHEN composite - before > 0.001 THEN 'BETTER' WHEN composite - before < -0.001 THEN 'WORSE' ELSE 'SAME' END AS status FROM wp WHERE before IS NOT NULL) GROUP BY 1", RET, WEEK, _PREV))
def rep_tuning_status(spark, sf_dir):
    return P.tuning(weeks(spark, sf_dir)).groupBy("status").agg(F.count("*").alias("n"))


_HALVES = """hv AS (SELECT *, row_number() OVER (PARTITION BY strategy_id ORDER BY window_id)*2 > count(*) OVER (PARTITION BY strategy_id) AS late FROM wc),
vd AS (SELECT strategy_id, late, avg((coalesce(sortino, 0) <= 0)::INT::DOUBLE) AS pbo, avg(coalesce(sortino, 0)) AS cpcv FROM hv GROUP BY 1, 2),
vp AS (SELECT *, pbo < 0.5 AND cpcv > 0 AS pass FROM vd)"""


@register("rep_tuning_revert", q("SELECT a.strategy_id, round(b.pbo, 6) AS pbo, b.pbo > a.pbo + 0.15 OR b.cpcv < a.cpcv - 0.1 OR (a.pass AND NOT b.pass) AS revert FROM vp a JOIN vp b USING (strategy_id) WHERE NOT a.late AND b.late", RET, WEEK, _HALVES))
def rep_tuning_revert(spark, sf_dir):
    """A tuned strategy goes back if its overfitting probability rises by 0.15, its score falls by 0.1, or it no longer passes; the
    windows' first half stands for the original, the second for the tuned one."""
    by = W.partitionBy("strategy_id")
    late = F.row_number().over(by.orderBy("window_id")) * 2 > F.count("*").over(by)
    s = F.coalesce("sortino", F.lit(0.0))
    v = weeks(spark, sf_dir).withColumn("late", late).groupBy("strategy_id", "late").agg(F.avg((s <= 0).cast("double")).alias("pbo"), F.avg(s).alias("cpcv"))
    v = v.withColumn("passed", (F.col("pbo") < 0.5) & (F.col("cpcv") > 0))
    return P.reverts(v.where("not late"), v.where("late")).select("strategy_id", F.round("pbo", 6).alias("pbo"), "revert")


@register("rep_ots_summary", q("SELECT count(*) AS n, count(*) FILTER (WHERE return_pct > 0) AS positive, count(*) FILTER (WHERE return_pct > 0 AND abs(max_dd) < 0.3 AND n_trades >= 5) AS passed, round(min(return_pct), 6) AS lo, round(max(return_pct), 6) AS hi, round(avg(return_pct), 6) AS mean, round(median(return_pct), 6) AS med FROM wk", RET, WEEK))
def rep_ots_summary(spark, sf_dir):
    x = F.col("return_pct")
    passed = (x > 0) & (F.abs("max_dd") < 0.3) & (F.col("n_trades") >= 5)
    return weeks(spark, sf_dir).agg(F.count("*").alias("n"), F.count(F.when(x > 0, 1)).alias("positive"), F.count(F.when(passed, 1)).alias("passed"), F.round(F.min(x), 6).alias("lo"), F.round(F.max(x), 6).alias("hi"), F.round(F.avg(x), 6).alias("mean"), F.round(F.median(x), 6).alias("med"))


@register("rep_multi_asset", q("SELECT strategy_id, count(*) AS windows, sum(n_trades)::BIGINT AS trades, arg_max(window_id, composite) AS best FROM wc GROUP BY 1", RET, WEEK))
def rep_multi_asset(spark, sf_dir):
    return weeks(spark, sf_dir).groupBy("strategy_id").agg(F.count("*").alias("windows"), F.sum("n_trades").alias("trades"), F.max_by("window_id", "composite").alias("best"))


_DIRECTION = "CASE WHEN user_id % 2 = 0 THEN 'LONG' ELSE 'SHORT' END"


def direction():
    return F.when(F.pmod("user_id", F.lit(2)) == 0, "LONG").otherwise("SHORT")


@register("rep_top_per_direction", S.query(GEN, select=f"SELECT g, direction, rn AS place, id FROM (SELECT *, row_number() OVER (PARTITION BY g, direction ORDER BY fitness DESC, id) AS rn FROM (SELECT *, {_DIRECTION} AS direction FROM gen WHERE fitness > 0)) WHERE rn <= 5"))
def rep_top_per_direction(spark, sf_dir):
    rn = F.row_number().over(W.partitionBy("g", "direction").orderBy(F.desc("fitness"), "id"))
    valid = generations(spark, sf_dir).where("fitness > 0").withColumn("direction", direction())
    return valid.withColumn("place", rn.cast("bigint")).where("place <= 5").select("g", "direction", "place", "id")


@register("rep_first_last", S.query(GEN, _BEST, select="SELECT arg_min(m, g) AS first, arg_max(m, g) AS last, round(100*(arg_max(m, g) - arg_min(m, g))/nullif(abs(arg_min(m, g)), 0), 6) + 0.0 AS pct FROM best"))
def rep_first_last(spark, sf_dir):
    best = generations(spark, sf_dir).groupBy("g").agg(F.max("fitness").alias("m")).agg(F.min_by("m", "g").alias("first"), F.max_by("m", "g").alias("last"))
    return best.select("first", "last", rnd(100 * (F.col("last") - F.col("first")) / F.nullif(F.abs("first"), F.lit(0.0))).alias("pct"))


_SHOWN = [*FIG, *DERIVED]


def _latex_sql(text: str) -> str:
    for char, escaped in E.LATEX:
        text = f"replace({text}, '{char}', '{escaped}')"
    return text


@register("rep_format", q(
    "SELECT symbol, name, " + _latex_sql("symbol || ' & ' || name") + " AS latex, CASE WHEN name IN ('cagr', 'total_return', 'max_dd') THEN printf('%.2f%%', value*100) WHEN name IN ('profit_factor', 'win_rate') THEN printf('%.2f', value) ELSE printf('%.4f', value) END AS shown "
    "FROM (" + " UNION ALL ".join(f"SELECT symbol, '{c}' AS name, {DERIVED.get(c, c)} AS value FROM f" for c in _SHOWN) + ")", RET, _AGG))  # fmt: skip
def rep_format(spark, sf_dir):
    """Each figure as reports show it, and its name escaped for a LaTeX table."""
    df = M.bundle(curve(spark, sf_dir), ["symbol"], YEAR)
    df = df.select("symbol", F.explode(F.array(*[F.struct(F.lit(c).alias("name"), F.col(c).cast("double").alias("value")) for c in _SHOWN])).alias("x")).select("symbol", "x.*")
    return df.select("symbol", "name", E.latex(F.concat_ws(" & ", "symbol", "name")).alias("latex"), E.figure(F.col("name"), F.col("value")).alias("shown"))


_POPULATION = f"""ch AS (SELECT g, user_id AS id, list_sort(list_distinct(list(module))) AS modules, max(fitness) AS fitness, {_DIRECTION} AS direction FROM gen GROUP BY g, user_id),
dd AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY g, direction, modules ORDER BY fitness DESC, id) AS dn FROM ch) WHERE dn = 1),
qd AS (SELECT *, row_number() OVER (PARTITION BY g, direction ORDER BY fitness DESC, id) <= 8 AS chosen FROM dd),
rf AS (SELECT *, row_number() OVER (PARTITION BY g ORDER BY chosen DESC, fitness DESC, id) AS place FROM qd)"""


@register("pop_manage", S.query(GEN, _POPULATION, select="SELECT g, id, direction, chosen, place FROM rf WHERE place <= 20"))
def pop_manage(spark, sf_dir):
    """Each generation: one member a direction and module set, the best 40 % of the places for either direction, the rest by fitness."""
    members = generations(spark, sf_dir).groupBy("g", F.col("user_id").alias("id")).agg(F.array_sort(F.collect_set("module")).alias("modules"), F.max("fitness").alias("fitness"))
    members = members.withColumn("direction", F.when(F.pmod("id", F.lit(2)) == 0, "LONG").otherwise("SHORT"))
    return P.managed(members, ["g"], ["direction", "modules"], "direction", 20, 0.4).select("g", "id", "direction", "chosen", F.col("place").cast("bigint").alias("place"))


# portfolios of the symbols' curves

_PR = "pr AS (SELECT symbol, ts, r, close, close/first_value(close) OVER (PARTITION BY symbol ORDER BY ts)*100 AS eq FROM z)"


def member_returns(spark, sf_dir):
    first = F.first("close").over(order().rowsBetween(W.unboundedPreceding, 0))
    return M.returns(curve(spark, sf_dir), ["symbol"]).withColumn("eq", F.col("close") / first * 100)


def _weekly(d):
    """A strategy a symbol and week, with its figures."""
    r, direction_ = F.col("r"), F.when(F.col("symbol") < "q", "LONG").otherwise("SHORT")
    out = d.groupBy("symbol", F.expr("ts div 604800").alias("week"), direction_.alias("direction")).agg(M.cagr("close", YEAR).alias("cagr"), F.sum(F.when(r > 0, r).otherwise(0.0)).alias("gain"), F.sum(F.when(r < 0, -r).otherwise(0.0)).alias("loss"))
    return out.withColumn("profit_factor", M.profit_factor(F.col("gain"), F.col("loss")))


def _portfolio(name: str, sql_select: str, build, *more: str) -> None:
    @register(name, q(sql_select, RET, _PR, *more))
    def run(spark, sf_dir):
        return build(member_returns(spark, sf_dir))


_portfolio("ens_equal_returns", f"SELECT ts, {S.rnd('avg(coalesce(r, 0.0))', 8)} AS v FROM pr GROUP BY 1", lambda d: P.mean_of(d, F.coalesce("r", F.lit(0.0)), 8))
_portfolio("ens_equal_equity", f"SELECT ts, {S.rnd('avg(eq)')} AS v FROM pr GROUP BY 1", lambda d: P.mean_of(d, F.col("eq"), 6))
_portfolio("ens_bh", f"SELECT symbol, ts, {S.rnd('eq')} AS v FROM pr", lambda d: d.select("symbol", "ts", rnd("eq").alias("v")))
_portfolio("ens_subportfolio", f"SELECT symbol, ts//86400 AS day, {S.rnd('avg(r)', 8)} AS v FROM pr GROUP BY 1, 2", lambda d: d.groupBy("symbol", F.expr("ts div 86400").alias("day")).agg(rnd(F.avg("r"), 8).alias("v")))
# members: the symbols of the alphabet's first half held long, the others short; the market's week before tells the regime
_REGIME = """mb AS (SELECT symbol, ts, ts//604800 AS week, CASE WHEN symbol < 'q' THEN 'LONG' ELSE 'SHORT' END AS direction, coalesce(CASE WHEN symbol < 'q' THEN r ELSE -r END, 0.0) AS x FROM pr),
wr AS (SELECT week, avg(ret) AS ret FROM (SELECT symbol, ts//604800 AS week, arg_max(close, ts)/arg_min(close, ts) - 1 AS ret FROM pr GROUP BY 1, 2) GROUP BY 1),
wl AS (SELECT week, CASE WHEN lag(ret) OVER (ORDER BY week) > 0.03 THEN 'LONG' WHEN lag(ret) OVER (ORDER BY week) < -0.03 THEN 'SHORT' END AS wanted FROM wr)"""


def _regime_filter(d):
    long = F.col("symbol") < "q"
    member = d.select("symbol", "ts", F.expr("ts div 604800").alias("week"), F.when(long, "LONG").otherwise("SHORT").alias("direction"), F.coalesce(F.when(long, F.col("r")).otherwise(-F.col("r")), F.lit(0.0)).alias("r"))
    ret = d.groupBy("symbol", F.expr("ts div 604800").alias("week")).agg((F.max_by("close", "ts") / F.min_by("close", "ts") - 1).alias("ret")).groupBy("week").agg(F.avg("ret").alias("ret"))
    before = F.lag("ret", 1).over(W.orderBy("week"))  # one row a week
    wanted = ret.select("week", F.when(before > 0.03, "LONG").when(before < -0.03, "SHORT").alias("wanted"))
    return P.filtered_mean(member.join(F.broadcast(wanted), "week"), F.col("wanted").isNull() | (F.col("direction") == F.col("wanted")))


_portfolio("ens_regime_filter", f"SELECT ts, {S.rnd('coalesce(avg(CASE WHEN wanted IS NULL OR wanted = direction THEN x END), avg(x))', 8)} AS v FROM mb JOIN wl USING (week) GROUP BY 1", _regime_filter, _REGIME)
_WT = "wt AS (SELECT symbol, (1/stddev_samp(r))/sum(1/stddev_samp(r)) OVER () AS w FROM pr GROUP BY 1)"
_portfolio("ens_inverse_vol", f"SELECT symbol, {S.rnd('w')} AS w FROM wt", lambda d: P.inverse_vol(d).select("symbol", rnd("w").alias("w")), _WT)
_portfolio("ens_weighted", f"SELECT ts, {S.rnd('sum(w*coalesce(r, 0.0))', 8)} AS v FROM pr JOIN wt USING (symbol) GROUP BY 1", lambda d: P.weighted(d, P.inverse_vol(d)), _WT)
_portfolio("ens_balanced", "SELECT direction, symbol, week FROM (SELECT *, row_number() OVER (PARTITION BY direction ORDER BY cagr DESC, symbol, week) AS rn FROM mw) WHERE rn <= 3", lambda d: P.balanced(_weekly(d), 3), "mw AS (SELECT symbol, ts//604800 AS week, CASE WHEN symbol < 'q' THEN 'LONG' ELSE 'SHORT' END AS direction, round(pow(arg_max(close, ts)/arg_min(close, ts), 8760.0/count(*)) - 1, 9) AS cagr FROM pr GROUP BY 1, 2, 3)")
_portfolio("ens_quality", "SELECT symbol, week FROM (SELECT symbol, ts//604800 AS week, pow(arg_max(close, ts)/arg_min(close, ts), 8760.0/count(*)) - 1 AS cagr, sum(CASE WHEN r > 0 THEN r ELSE 0 END)/nullif(sum(CASE WHEN r < 0 THEN -r ELSE 0 END), 0) AS pf FROM pr GROUP BY 1, 2) WHERE cagr > 0.05 AND coalesce(pf, 999.0) > 1.2", lambda d: P.quality(_weekly(d), 0.05, 1.2))
_portfolio("met_portfolio", f"SELECT {S.rnd('avg(v)*8760/(stddev_samp(v)*sqrt(8760))')} AS sharpe, {S.rnd('CASE WHEN sqrt(avg(CASE WHEN v < 0 THEN v*v END)) > 0 THEN avg(v)/sqrt(avg(CASE WHEN v < 0 THEN v*v END))*sqrt(8760) ELSE 0.0 END')} AS sortino FROM (SELECT ts, avg(coalesce(r, 0.0)) AS v FROM pr GROUP BY 1)",
    lambda d: d.groupBy("ts").agg(F.avg(F.coalesce("r", F.lit(0.0))).alias("r")).agg(rnd(M.sharpe(YEAR)).alias("sharpe"), rnd(M.sortino_rms(YEAR)).alias("sortino")))
_COMBO = """sy AS (SELECT symbol, row_number() OVER (ORDER BY symbol) - 1 AS k FROM (SELECT DISTINCT symbol FROM pr)),
cb AS (SELECT m, symbol FROM range((SELECT 1 << count(*) FROM sy)) c(m), sy WHERE (m >> k) & 1 = 1 AND bit_count(m) BETWEEN 2 AND 8),
cv AS (SELECT m, ts, avg(coalesce(r, 0.0)) AS v FROM cb JOIN pr USING (symbol) GROUP BY 1, 2),
ce AS (SELECT *, exp(sum(ln(1 + v)) OVER (PARTITION BY m ORDER BY ts)) AS eq FROM cv),
cd AS (SELECT *, eq/max(eq) OVER (PARTITION BY m ORDER BY ts) - 1 AS dd FROM ce),
sc AS (SELECT m, min(dd) AS max_dd, CASE WHEN sqrt(avg(CASE WHEN v < 0 THEN v*v END)) > 0 THEN avg(v)/sqrt(avg(CASE WHEN v < 0 THEN v*v END))*sqrt(8760) ELSE 0.0 END AS sortino FROM cd GROUP BY 1),
nm AS (SELECT m, string_agg(symbol, ',' ORDER BY symbol) AS members FROM cb GROUP BY 1)"""
_portfolio("ens_exhaustive", f"SELECT members, {S.rnd('sortino')} AS sortino, {S.rnd('max_dd')} AS max_dd, max_dd > -0.15 AS allowed FROM sc JOIN nm USING (m)", lambda d: P.exhaustive(d, YEAR).select("members", rnd("sortino").alias("sortino"), rnd("max_dd").alias("max_dd"), "allowed"), _COMBO)


@register("ens_greedy_forward")
def ens_greedy_forward(spark, sf_dir):
    return P.greedy(member_returns(spark, sf_dir), forward=True)


@register("ens_greedy_backward")
def ens_greedy_backward(spark, sf_dir):
    return P.greedy(member_returns(spark, sf_dir), forward=False)


@register("ens_max_sharpe")
def ens_max_sharpe(spark, sf_dir):
    return P.optimised(member_returns(spark, sf_dir), "sharpe")


@register("ens_min_var")
def ens_min_var(spark, sf_dir):
    return P.optimised(member_returns(spark, sf_dir), "variance")
