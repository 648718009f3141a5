"""Resampling statistics, cross-validated back-tests and gates."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from barloom.operators import backtest as BT
from barloom.operators import distributions as D
from barloom.operators import metrics as M
from barloom.operators import splits
from barloom.operators import statistics as T
from barloom.operators.kernel import Rules
from barloom.queries import register
from barloom.queries import sql as S
from barloom.queries.backtests import _TRADES, COST, SIGNAL, base_trades, machine, recursive, signals
from barloom.queries.indicators import rnd
from barloom.queries.metrics import _AGG, RET, WEEK, curve, q, weeks
from barloom.sources import bars as B

ITER, SEED = 1000, 13  # resamples of a test
METRIC_ITER = 200  # resamples whose whole paths are valued


def _hash(text: str) -> str:
    return f"('0x' || substr(md5({text}), 1, 8))::BIGINT"


_SER = "ser AS (SELECT symbol, row_number() OVER (PARTITION BY symbol ORDER BY ts) - 1 AS i, r AS x FROM z WHERE r IS NOT NULL)"


def _draws(block: int, iterations: int = ITER, key: str = "symbol") -> str:
    """Block draws over each whole series of ``ser``, one row a place."""
    start = _hash(f"'{SEED}:' || iter || ':' || b")
    sizes = "SELECT symbol, count(*) AS n FROM ser GROUP BY 1" if key == "symbol" else "SELECT count(*) AS n FROM ser"
    keyed = "symbol, " if key == "symbol" else ""
    return (
        f"dr AS (SELECT {keyed}iter, n, b*{block} + o AS k, s + o AS i FROM (SELECT *, ({start}) % greatest(1, n - {block} + 1) AS s FROM (SELECT *, unnest(range((n - 1)//{block} + 1)) AS b "
        f"FROM ({sizes}), range({iterations}) it(iter))), range({block}) oo(o) WHERE b*{block} + o < n)"
    )


def series(spark, sf_dir):
    rows = M.returns(curve(spark, sf_dir), ["symbol"])
    return T.numbered(rows, ["symbol"], "ts", "r")


@register("st_block_bootstrap", q(f"SELECT iter, symbol, any_value(n) AS n, {S.rnd('avg(x)', 8)} AS m FROM dr JOIN ser USING (symbol, i) GROUP BY 1, 2", RET, _SER, _draws(20)))
def st_block_bootstrap(spark, sf_dir):
    d = series(spark, sf_dir)
    return T.block_sums(d, T.block_draws(d, 20, ITER, SEED, ["symbol"]), ["symbol"]).select("iter", "symbol", "n", rnd("m", 8).alias("m"))


_PATH = """pt AS (SELECT iter, symbol, k, x, exp(sum(ln(1 + x)) OVER (PARTITION BY iter, symbol ORDER BY k)) AS eq FROM dr JOIN ser USING (symbol, i)),
pd AS (SELECT *, eq/greatest(max(eq) OVER (PARTITION BY iter, symbol ORDER BY k), 1.0) - 1 AS dd FROM pt),
pm AS (SELECT iter, symbol, avg(x)*8760/(stddev_samp(x)*sqrt(8760)) AS sharpe, pow(arg_max(eq, k), 8760.0/(count(*) + 1)) - 1 AS cagr, sqrt(sum(dd*dd)/(count(*) + 1)) AS ulcer, min(dd) AS max_dd FROM pd GROUP BY 1, 2),
pu AS (SELECT *, CASE WHEN ulcer > 0 THEN cagr/ulcer WHEN cagr > 0 THEN 100.0 ELSE 0.0 END AS upi FROM pm),
pl AS (SELECT symbol, name, v FROM (SELECT symbol, unnest(['sharpe', 'cagr', 'upi', 'max_dd']) AS name, unnest([sharpe, cagr, upi, max_dd]) AS v FROM pu WHERE abs(upi) <= 1e6 AND abs(cagr) <= 1e6))"""


@register("st_bootstrap_ci", q(f"SELECT symbol, name, count(*) AS n, {S.rnd('avg(v)', 5)} AS mean, {S.rnd('median(v)', 5)} AS med, {S.rnd('stddev_pop(v)', 5)} AS sd, {S.rnd('quantile_cont(v, 0.025)', 5)} AS lo, {S.rnd('quantile_cont(v, 0.975)', 5)} AS hi FROM pl GROUP BY 1, 2", RET, _SER, _draws(20, METRIC_ITER), _PATH))
def st_bootstrap_ci(spark, sf_dir):
    """Figures of resampled equity paths: their mean, median, deviation and interval; paths of absurd growth don't count."""
    d = series(spark, sf_dir)
    rows = T.resampled(d, T.block_draws(d, 20, METRIC_ITER, SEED, ["symbol"]), ["symbol"])
    w = W.partitionBy("iter", "symbol").orderBy("k").rowsBetween(W.unboundedPreceding, 0)
    rows = rows.withColumn("eq", F.exp(F.sum(F.log(1 + F.col("x"))).over(w)))
    rows = rows.withColumn("dd", F.col("eq") / F.greatest(F.max("eq").over(w), F.lit(1.0)) - 1)
    points = F.count("*") + 1  # with the path's start
    each = rows.groupBy("iter", "symbol").agg(
        (F.avg("x") * 8760 / (F.stddev_samp("x") * 8760**0.5)).alias("sharpe"), (F.pow(F.max_by("eq", "k"), F.lit(8760.0) / points) - 1).alias("cagr"),
        F.sqrt(F.sum(F.col("dd") * F.col("dd")) / points).alias("ulcer"), F.min("dd").alias("max_dd"),
    )
    each = each.withColumn("upi", M.upi(F.col("cagr"), F.col("ulcer"))).where((F.abs("upi") <= 1e6) & (F.abs("cagr") <= 1e6))
    names = ["sharpe", "cagr", "upi", "max_dd"]
    long = each.select("symbol", F.explode(F.array(*[F.struct(F.lit(n).alias("name"), F.col(n).alias("v")) for n in names])).alias("z")).select("symbol", "z.*")
    p = F.percentile("v", F.array(F.lit(0.025), F.lit(0.5), F.lit(0.975)))
    out = long.groupBy("symbol", "name").agg(F.count("*").alias("n"), F.avg("v").alias("mean"), F.stddev_pop("v").alias("sd"), p.alias("p"))
    return out.select("symbol", "name", "n", rnd("mean", 5).alias("mean"), rnd(F.col("p")[1], 5).alias("med"), rnd("sd", 5).alias("sd"), rnd(F.col("p")[0], 5).alias("lo"), rnd(F.col("p")[2], 5).alias("hi"))


_REL = "rel AS (SELECT a.ts, a.r - b.r AS d FROM z a JOIN z b ON a.ts = b.ts WHERE a.symbol = 'click' AND b.symbol = 'view' AND a.r IS NOT NULL AND b.r IS NOT NULL)"


def relative(spark, sf_dir):
    r = M.returns(curve(spark, sf_dir), ["symbol"]).where("r is not null")
    both = r.where("symbol in ('click', 'view')").groupBy("ts").agg(F.max(F.when(F.col("symbol") == "click", F.col("r"))).alias("a"), F.max(F.when(F.col("symbol") == "view", F.col("r"))).alias("b"))
    return both.select("ts", (F.col("a") - F.col("b")).alias("d")).where("d is not null")


@register("st_rel_perf", q(f"SELECT ts, {S.rnd('d', 8)} AS d FROM rel", RET, _REL))
def st_rel_perf(spark, sf_dir):
    return relative(spark, sf_dir).select("ts", rnd("d", 8).alias("d"))


_RSER = "ser AS (SELECT row_number() OVER (ORDER BY ts) - 1 AS i, d AS x FROM rel)"
_SPA = "SELECT iter, t, avg(x - m)/nullif(stddev_pop(x), 0)*sqrt(count(*)) AS b FROM dr JOIN ser USING (i), (SELECT avg(x) AS m, avg(x)/nullif(stddev_samp(x), 0)*sqrt(count(*)) AS t FROM ser) s GROUP BY 1, 2"


@register("st_spa", q(f"SELECT {S.rnd('t')} AS t, round(avg((b >= t)::INT::DOUBLE), 6) AS p FROM ({_SPA}) GROUP BY t", RET, _REL, _RSER, _draws(1, ITER, "")))
def st_spa(spark, sf_dir):
    d = T.numbered(relative(spark, sf_dir), [], "ts", "d")
    return T.spa(d, ITER, SEED).select(rnd("t").alias("t"), F.round("p", 6).alias("p"))


_WHITE = "SELECT best, avg((b >= best)::INT::DOUBLE) AS p FROM (SELECT iter, max(b - m) AS b FROM (SELECT iter, symbol, avg(x) AS b FROM dr JOIN ser USING (symbol, i) GROUP BY 1, 2) JOIN (SELECT symbol, avg(x) AS m FROM ser GROUP BY 1) USING (symbol) GROUP BY 1), (SELECT max(m) AS best FROM (SELECT avg(x) AS m FROM ser GROUP BY symbol)) GROUP BY best"


@register("st_white_rc", q(f"SELECT {S.rnd('best', 8)} AS best, round(p, 6) AS p FROM ({_WHITE})", RET, _SER, _draws(20)))
def st_white_rc(spark, sf_dir):
    out = T.reality_check(series(spark, sf_dir).withColumnRenamed("symbol", "key"), 20, ITER, SEED)
    return out.select(rnd("best", 8).alias("best"), F.round("p", 6).alias("p"))


def _renamed(text: str, *names: str) -> str:
    import re

    return re.sub(rf"\b({'|'.join(names)})\b", r"\1_b", text)


@register("st_suite", q(f"SELECT 'spa' AS test, round(avg((b >= t)::INT::DOUBLE), 6) AS p FROM ({_SPA}) GROUP BY t UNION ALL SELECT 'reality_check', round(p, 6) FROM ({_renamed(_WHITE, 'dr', 'ser')})",
    RET, _REL, _RSER, _draws(1, ITER, ""), _renamed(_SER, "ser"), _renamed(_draws(20), "dr", "ser")))
def st_suite(spark, sf_dir):
    d = T.numbered(relative(spark, sf_dir), [], "ts", "d")
    a = T.spa(d, ITER, SEED).select(F.lit("spa").alias("test"), F.round("p", 6).alias("p"))
    return a.unionByName(T.reality_check(series(spark, sf_dir).withColumnRenamed("symbol", "key"), 20, ITER, SEED).select(F.lit("reality_check").alias("test"), F.round("p", 6).alias("p")))


# cross-validation: the test groups of each split, one after another, through the position machine

RULES = Rules("LONG", 3.0, 1.5, 0.0, COST)


def cpcv_trades(spark, sf_dir):
    return BT.split_trades(splits.groups(signals(spark, sf_dir), 6), {"s1": RULES}, 6, 3, 2)


LEAST_BARS = 100  # a split with fewer test bars isn't scored


def cpcv_scores(spark, sf_dir):
    """``symbol, split_id, n, sortino, calmar``: both cut to ten on either side, 0 under three trades; splits of few bars are left out."""
    t = cpcv_trades(spark, sf_dir).withColumn("split_id", F.col("window_id").cast("bigint"))
    w = W.partitionBy("symbol", "split_id").orderBy("exit_bar").rowsBetween(W.unboundedPreceding, 0)
    t = t.withColumn("eq", F.exp(F.sum(F.log(1 + F.col("pnl"))).over(w)))
    t = t.withColumn("dd", F.col("eq") / F.greatest(F.max("eq").over(w), F.lit(1.0)) - 1)
    cut = lambda x: F.when(F.count("*") >= 3, F.least(F.greatest(x, F.lit(-10.0)), F.lit(10.0))).otherwise(0.0)
    down = F.stddev_samp(F.when(F.col("pnl") < 0, F.col("pnl")))
    sortino = F.when(down > 0, F.avg("pnl") / down).otherwise(999.0)
    growth = F.max_by("eq", "exit_bar") - 1
    scored = t.groupBy("symbol", "split_id").agg(F.count("*").alias("n"), cut(sortino).alias("sortino"), cut(M.calmar(growth, F.min("dd"))).alias("calmar"))
    sizes = splits.groups(signals(spark, sf_dir), 6).groupBy("symbol").agg((F.count("*") / 2).alias("bars"))  # three of six groups
    return scored.join(F.broadcast(sizes.where(F.col("bars") >= LEAST_BARS).select("symbol")), "symbol")  # one row a symbol


_CPCV = """zg AS (SELECT *, least((n - 1)//(cnt//6), 5) AS g FROM (SELECT *, count(*) OVER (PARTITION BY symbol) AS cnt FROM z)),
zq AS (SELECT *, row_number() OVER (PARTITION BY symbol, g ORDER BY ts) - 1 AS qq FROM zg),
cs AS (SELECT row_number() OVER (ORDER BY a, b, c) - 1 AS split_id, a, b, c FROM (SELECT x.i AS a, y.i AS b, w.i AS c FROM range(6) x(i), range(6) y(i), range(6) w(i) WHERE x.i < y.i AND y.i < w.i)),
zt AS (SELECT symbol || '|' || split_id AS symbol, row_number() OVER (PARTITION BY symbol, split_id ORDER BY ts) AS n, ts, high, low, close, atr, sig FROM zq, cs WHERE g IN (a, b, c) AND NOT (g > 0 AND (g - 1) NOT IN (a, b, c) AND qq < 2))"""
_SCORES = """ce AS (SELECT split_part(symbol, '|', 1) AS symbol, split_part(symbol, '|', 2)::BIGINT AS split_id, exit_bar, pnl, exp(sum(ln(1 + pnl)) OVER (PARTITION BY symbol ORDER BY exit_bar)) AS eq FROM t),
cd AS (SELECT *, eq/greatest(max(eq) OVER (PARTITION BY symbol, split_id ORDER BY exit_bar), 1.0) - 1 AS dd FROM ce),
cf AS (SELECT symbol, split_id, count(*) AS n, CASE WHEN stddev_samp(CASE WHEN pnl < 0 THEN pnl END) > 0 THEN avg(pnl)/stddev_samp(CASE WHEN pnl < 0 THEN pnl END) ELSE 999.0 END AS so, arg_max(eq, exit_bar) - 1 AS gr, min(dd) AS dd FROM cd GROUP BY 1, 2),
sc AS (SELECT symbol, split_id, n, CASE WHEN n >= 3 THEN least(greatest(so, -10.0), 10.0) ELSE 0.0 END AS sortino,
  CASE WHEN n >= 3 THEN least(greatest(CASE WHEN gr <= 0 THEN 0.0 WHEN dd >= -0.01 THEN gr*100 ELSE gr/abs(dd) END, -10.0), 10.0) ELSE 0.0 END AS calmar
  FROM cf WHERE symbol IN (SELECT symbol FROM bars GROUP BY 1 HAVING count(*)/2 >= 100))"""
_CV = [S.BARS, SIGNAL, _CPCV, machine("sig", RULES, "zt"), _SCORES]


@register("st_cpcv_eval", recursive(*_CV, select=f"SELECT symbol, split_id, n, {S.rnd('sortino')} AS sortino, {S.rnd('calmar')} AS calmar FROM sc"))
def st_cpcv_eval(spark, sf_dir):
    return cpcv_scores(spark, sf_dir).select("symbol", "split_id", "n", rnd("sortino").alias("sortino"), rnd("calmar").alias("calmar"))


@register("st_pbo", recursive(*_CV, select="SELECT symbol, round(v, 6) AS pbo, CASE WHEN v < 0.3 THEN 'low' WHEN v < 0.6 THEN 'moderate' ELSE 'high' END AS verdict FROM (SELECT symbol, avg((sortino <= 0)::INT::DOUBLE) AS v FROM sc GROUP BY 1)"))
def st_pbo(spark, sf_dir):
    return T.pbo(cpcv_scores(spark, sf_dir), ["symbol"]).select("symbol", F.round("pbo", 6).alias("pbo"), "verdict")


_BEST = "(sqrt(2*ln(20.0)) - (ln(pi()) + ln(ln(20.0)))/(2*sqrt(2*ln(20.0))))*sqrt(8760.0/(n - 1))"


@register("st_dsr", q(f"SELECT symbol, round({D.normal_cdf_sql(f'((sharpe - {_BEST})/sqrt(8760.0/(n - 1)))')}, 6) AS dsr FROM f", RET, _AGG))
def st_dsr(spark, sf_dir):
    out = M.bundle(curve(spark, sf_dir), ["symbol"], 8760.0)
    return T.deflated(out, "sharpe", F.lit(20.0), F.col("n"), 8760.0).select("symbol", F.round("dsr", 6).alias("dsr"))


@register("st_ttest", q(f"SELECT symbol, {S.rnd('avg(r)/nullif(stddev_samp(r), 0)*sqrt(count(r))')} AS t, count(r) - 1 AS df FROM z GROUP BY 1", RET))
def st_ttest(spark, sf_dir):
    return ttest(spark, sf_dir).select("symbol", rnd("t").alias("t"), "df")


def ttest(spark, sf_dir):
    return M.returns(curve(spark, sf_dir), ["symbol"]).groupBy("symbol").agg(T.t_statistic("r").alias("t"), (F.count("r") - 1).alias("df"))


@register("st_ttest_p")
def st_ttest_p(spark, sf_dir):
    """One-sided p; SQL has no Student distribution, a test holds it against numeric integration."""
    return ttest(spark, sf_dir).select("symbol", F.round(T.student_p(F.col("t"), F.col("df").cast("double")), 8).alias("p"))


_WX = "SELECT symbol, sum(CASE WHEN r > 0 THEN rk ELSE 0 END)::DOUBLE AS w, count(*) AS n FROM (SELECT symbol, r, rank() OVER (PARTITION BY symbol ORDER BY abs(r)) + (count(*) OVER (PARTITION BY symbol, abs(r)) - 1)/2 AS rk FROM z WHERE r <> 0) GROUP BY 1"


@register("st_wilcoxon", q(f"SELECT symbol, w, n, round(1 - {D.normal_cdf_sql('((w - n*(n + 1)/4.0)/sqrt(n*(n + 1)*(2*n + 1)/24.0))')}, 6) AS p FROM ({_WX})", RET))
def st_wilcoxon(spark, sf_dir):
    return T.wilcoxon(M.returns(curve(spark, sf_dir), ["symbol"]), ["symbol"], "r").select("symbol", "w", "n", F.round("p", 6).alias("p"))


# permutations and Monte Carlo

PERMS = 100  # shuffles of a strategy's signals

_PERM = f"""zi AS (SELECT z.*, it.i AS iter, row_number() OVER (PARTITION BY symbol, it.i ORDER BY {_hash("'21:' || it.i || ':' || ts")}, ts) AS place, count(*) FILTER (WHERE sig) OVER (PARTITION BY symbol, it.i) AS total FROM z, range({PERMS}) it(i)),
zp AS (SELECT symbol || '|' || iter AS symbol, n, ts, high, low, close, atr, CASE WHEN iter = 0 THEN sig ELSE place <= total END AS sh FROM zi)"""
_PS = """ps AS (SELECT symbol, iter, total, coalesce(v, 0.0) AS v, coalesce(n, 0) AS n FROM (SELECT DISTINCT symbol, iter, total FROM zi) LEFT JOIN
  (SELECT split_part(symbol, '|', 1) AS symbol, split_part(symbol, '|', 2)::BIGINT AS iter, count(*) AS n, exp(sum(ln(1 + pnl))) - 1 AS v FROM t GROUP BY 1, 2) USING (symbol, iter)),
pp AS (SELECT a.symbol, a.total AS n_signals, a.n AS n_trades, a.v AS return, CASE WHEN a.total < 3 OR a.n < 3 THEN 1.0 ELSE avg((round(b.v, 9) >= round(a.v, 9))::INT::DOUBLE) END AS p FROM ps a JOIN ps b ON b.symbol = a.symbol AND b.iter > 0 WHERE a.iter = 0 GROUP BY 1, 2, 3, 4)"""


def permuted(rows, rules):
    """``symbol, n_signals, n_trades, return, p``: the share of shuffles of the signals over the bars that gain as much as the
    strategy; 1 under three signals or trades. Bars are repeated a stated number of times, shuffle 0 being the strategy itself."""
    df = rows.crossJoin(F.broadcast(rows.sparkSession.range(PERMS).select(F.col("id").alias("iter"))))
    by = W.partitionBy("symbol", "iter")
    df = df.withColumn("place", F.row_number().over(by.orderBy(splits.hashed(21, F.col("iter").cast("string"), F.col("ts").cast("string")), "ts")))
    total = F.count(F.when(F.col("s1"), 1)).over(by)
    df = df.withColumn("sh", F.when(F.col("iter") == 0, F.col("s1")).otherwise(F.col("place") <= total))
    t = BT.trades(BT.bar_form(df, ["sh"], F.col("iter").cast("string")), {"sh": rules})
    gains = t.groupBy("symbol", F.col("window_id").cast("bigint").alias("iter")).agg(F.count("*").alias("n"), (F.exp(F.sum(F.log(1 + F.col("pnl")))) - 1).alias("v"))
    every = rows.groupBy("symbol").agg(F.count(F.when(F.col("s1"), 1)).alias("total")).withColumn("iter", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(PERMS - 1).cast("bigint"))))
    ps = every.join(gains, ["symbol", "iter"], "left").select("symbol", "iter", "total", F.coalesce("v", F.lit(0.0)).alias("v"), F.coalesce("n", F.lit(0)).alias("n"))
    real = ps.where("iter = 0").select("symbol", "total", F.col("n").alias("n_trades"), F.col("v").alias("return"))
    each = ps.where("iter > 0").select("symbol", "v").join(F.broadcast(real), "symbol")  # one row a symbol
    share = F.avg((F.round("v", 9) >= F.round("return", 9)).cast("double"))
    out = each.groupBy("symbol", F.col("total").alias("n_signals"), "n_trades", "return").agg(share.alias("p"))
    return out.withColumn("p", F.when((F.col("n_signals") < 3) | (F.col("n_trades") < 3), 1.0).otherwise(F.col("p")))


for _name, _rules in (("st_perm_signal", RULES), ("st_perm_return", Rules("LONG", 3.0, 1.5, 2.0, COST))):

    def _perm(spark, sf_dir, rules=_rules):
        return permuted(signals(spark, sf_dir), rules).select("symbol", "n_signals", "n_trades", rnd("return").alias("return"), F.round("p", 6).alias("p"))

    register(_name, recursive(S.BARS, SIGNAL, _PERM, machine("sh", _rules, "zp"), _PS, select=f"SELECT symbol, n_signals, n_trades, {S.rnd('return')} AS return, round(p, 6) AS p FROM pp"))(_perm)


_MC = f"""mc AS (SELECT t.symbol, it.i AS iter, pnl AS x, row_number() OVER (PARTITION BY t.symbol, it.i ORDER BY {_hash("'31:' || it.i || ':' || tn")}, tn) - 1 AS place FROM (SELECT symbol, pnl, row_number() OVER (PARTITION BY symbol ORDER BY exit_bar) - 1 AS tn FROM t) t, range(20) it(i))"""


def _mc_sql(value: str) -> str:
    return recursive(
        *_TRADES, _MC, f"pv AS (SELECT *, {value} AS v FROM mc)", "pk AS (SELECT *, greatest(max(v) OVER (PARTITION BY symbol, iter ORDER BY place), 1000.0) AS peak FROM pv)",
        select=f"SELECT symbol, iter, {S.rnd('arg_max(v, place)', 4)} AS final, {S.rnd('min((v - peak)/peak)')} AS max_dd FROM pk GROUP BY 1, 2",
    )


def _mc(spark, sf_dir, multiply):
    t = T.numbered(base_trades(spark, sf_dir), ["symbol"], "exit_bar", "pnl")
    t = t if multiply else t.withColumn("x", 500 * F.col("x"))
    out = T.path_figures(T.shuffled(t, 20, 31, ["symbol"]), ["symbol"], 1000.0, multiply)
    return out.select("symbol", "iter", rnd("final", 4).alias("final"), rnd("max_dd").alias("max_dd"))


register("st_mc_trades", _mc_sql("1000 + sum(500*x) OVER (PARTITION BY symbol, iter ORDER BY place)"))(lambda spark, sf_dir: _mc(spark, sf_dir, False))
register("st_mc_pct", _mc_sql("1000*exp(sum(ln(1 + x)) OVER (PARTITION BY symbol, iter ORDER BY place))"))(lambda spark, sf_dir: _mc(spark, sf_dir, True))


BANDS = {"p5": 0.05, "p25": 0.25, "p50": 0.5, "p75": 0.75, "p95": 0.95}


@register("rep_mc_bands", recursive(*_TRADES, _MC, "pv AS (SELECT *, 1000 + sum(500*x) OVER (PARTITION BY symbol, iter ORDER BY place) AS v FROM mc)", select=f"SELECT symbol, place, {', '.join(f"{S.rnd(f'quantile_cont(v, {x})', 4)} AS {n}" for n, x in BANDS.items())} FROM pv GROUP BY 1, 2"))
def rep_mc_bands(spark, sf_dir):
    t = T.shuffled(T.numbered(base_trades(spark, sf_dir), ["symbol"], "exit_bar", "pnl"), 20, 31, ["symbol"])
    w = W.partitionBy("iter", "symbol").orderBy("place").rowsBetween(W.unboundedPreceding, 0)
    out = t.withColumn("v", 1000 + F.sum(500 * F.col("x")).over(w)).groupBy("symbol", "place").agg(F.percentile("v", F.array(*[F.lit(x) for x in BANDS.values()])).alias("p"))
    return out.select("symbol", "place", *[rnd(F.col("p")[k], 4).alias(n) for k, n in enumerate(BANDS)])


# gates and walk-forward

_GATES = """tq AS (SELECT t.symbol, least((b.ts - lo)*4//greatest(hi - lo, 1), 3) AS period, exit_bar, pnl FROM t0 t JOIN z b ON b.symbol = t.symbol AND b.n = t.entry_bar + 1, (SELECT min(ts) AS lo, max(ts) AS hi FROM bars)),
te AS (SELECT *, exp(sum(ln(1 + pnl)) OVER (PARTITION BY symbol, period ORDER BY exit_bar)) AS eq FROM tq),
td AS (SELECT *, eq/greatest(max(eq) OVER (PARTITION BY symbol, period ORDER BY exit_bar), 1.0) - 1 AS dd FROM te),
tg AS (SELECT symbol, period, count(*) AS n, arg_max(eq, exit_bar) - 1 AS ret, min(dd) AS dd FROM td GROUP BY 1, 2),
gt AS (SELECT symbol, coalesce(bool_or(period = 3 AND ret > 0 AND n >= 5), false) AS ots, count(*) FILTER (WHERE ret > 0) >= 2 AS regimes, sum(n) >= 20 AS trades, coalesce(max(abs(dd)), 0) < 0.3 AS drawdown FROM tg GROUP BY 1)"""


@register("st_gates", recursive(S.BARS, SIGNAL, machine("sig", RULES, "z", "0"), _GATES, _PERM, machine("sh", RULES, "zp"), _PS,
    select="SELECT gt.symbol, ots, regimes, trades, drawdown, CASE WHEN ots AND regimes AND trades AND drawdown THEN p < 0.05 ELSE false END AS permutation, CASE WHEN ots AND regimes AND trades AND drawdown THEN p < 0.05 ELSE false END AS passed FROM gt JOIN pp USING (symbol)"))
def st_gates(spark, sf_dir):
    """Five gates over four periods of the series: the last one gains on five trades at least, two periods gain, twenty trades, no
    period loses 30 %, and, for those that pass all these only, the permutation test."""
    bars = signals(spark, sf_dir)
    span = bars.agg(F.min("ts").alias("lo"), F.max("ts").alias("hi"))
    t = BT.trades(BT.bar_form(bars, ["s1"]), {"s1": RULES}).crossJoin(F.broadcast(span))  # one row
    t = t.withColumn("period", F.expr("least((entry_ts - lo) * 4 div greatest(hi - lo, 1), 3)"))
    w = W.partitionBy("symbol", "period").orderBy("exit_bar").rowsBetween(W.unboundedPreceding, 0)
    t = t.withColumn("eq", F.exp(F.sum(F.log(1 + F.col("pnl"))).over(w)))
    t = t.withColumn("dd", F.col("eq") / F.greatest(F.max("eq").over(w), F.lit(1.0)) - 1)
    each = t.groupBy("symbol", "period").agg(F.count("*").alias("n"), (F.max_by("eq", "exit_bar") - 1).alias("ret"), F.min("dd").alias("dd"))
    c = F.col
    gates = each.groupBy("symbol").agg(
        F.coalesce(F.bool_or((c("period") == 3) & (c("ret") > 0) & (c("n") >= 5)), F.lit(False)).alias("ots"), (F.count(F.when(c("ret") > 0, 1)) >= 2).alias("regimes"),
        (F.sum("n") >= 20).alias("trades"), (F.max(F.abs("dd")) < 0.3).alias("drawdown"),
    )
    survivors = gates.where("ots and regimes and trades and drawdown").select("symbol")
    p = permuted(bars.join(F.broadcast(survivors), "symbol", "left_semi"), RULES).select("symbol", "p")  # one row a symbol
    passed = F.coalesce(c("p") < 0.05, F.lit(False))
    return gates.join(p, "symbol", "left").select("symbol", "ots", "regimes", "trades", "drawdown", passed.alias("permutation"), passed.alias("passed"))


_BENCH = """bm AS (SELECT window_id, avg(return_pct) AS market FROM wk GROUP BY 1),
wb AS (SELECT wk.*, market, CASE WHEN market > 3 THEN 'bull' WHEN market < -3 THEN 'bear' ELSE 'sideways' END AS regime, row_number() OVER (PARTITION BY strategy_id ORDER BY window_id) AS k, count(*) OVER (PARTITION BY strategy_id) AS n FROM wk JOIN bm USING (window_id))"""
_REGIMES = ("bull", "bear", "sideways")


def _in(regime: str) -> str:
    return f"avg(CASE WHEN regime = '{regime}' THEN return_pct END)"


def with_market(w):
    """Windows with the market's return (the mean over strategies), its regime, and their place."""
    market = w.groupBy("window_id").agg(F.avg("return_pct").alias("market"))  # one row a window
    out = w.join(F.broadcast(market), "window_id")
    out = out.withColumn("regime", F.when(F.col("market") > 3, "bull").when(F.col("market") < -3, "bear").otherwise("sideways"))
    by = W.partitionBy("strategy_id")
    return out.withColumn("k", F.row_number().over(by.orderBy("window_id"))).withColumn("n", F.count("*").over(by))


@register("st_wf_aggregate", q(
    f"SELECT strategy_id, {S.rnd('avg((return_pct > 0)::INT::DOUBLE)')} AS consistency, {S.rnd('avg((return_pct > market)::INT::DOUBLE)')} AS alpha_rate, {S.rnd('exp(sum(ln(1 + return_pct/100))) - 1')} AS compounded, "
    + ", ".join(f"{S.rnd(_in(r))} AS in_{r}" for r in _REGIMES)
    + f", {S.rnd('coalesce(avg(CASE WHEN k*2 > n THEN return_pct END), 0) - coalesce(avg(CASE WHEN k*2 <= n THEN return_pct END), 0)')} AS decay FROM wb GROUP BY 1", RET, WEEK, _BENCH))
def st_wf_aggregate(spark, sf_dir):
    x = F.col("return_pct")
    half = lambda c: F.coalesce(F.avg(F.when(c, x)), F.lit(0.0))
    return with_market(weeks(spark, sf_dir)).groupBy("strategy_id").agg(
        rnd(F.avg((x > 0).cast("double"))).alias("consistency"), rnd(F.avg((F.round(x, 9) > F.round("market", 9)).cast("double"))).alias("alpha_rate"), rnd(F.exp(F.sum(F.log(1 + x / 100))) - 1).alias("compounded"),
        *[rnd(F.avg(F.when(F.col("regime") == r, x))).alias(f"in_{r}") for r in _REGIMES], rnd(half(F.col("k") * 2 > F.col("n")) - half(F.col("k") * 2 <= F.col("n"))).alias("decay"),
    )


@register("st_wf_stability")
def st_wf_stability(spark, sf_dir):
    """Each strategy in each window, and the ensembles: all of them, and those that the market of the window before calls for."""
    bars = signals(spark, sf_dir)
    first = bars.agg(F.min("ts")).first()[0] or 0
    windows = splits.walk_forward(spark, first - first % 86400, 4, 864000, 86400, 432000, 432000)
    rows = splits.in_windows(bars, windows).where("role = 'test'")
    t = BT.trades(BT.bar_form(rows, ["s1", "s2"], F.col("window_id").cast("string")), {"s1": RULES, "s2": Rules("SHORT", 3.0, 1.5, 0.0, COST)})
    each = t.groupBy("strategy_id", F.col("window_id").cast("int").alias("window_id")).agg(F.count("*").alias("n"), F.sum("pnl").alias("pnl"))
    market = rows.groupBy("symbol", F.col("window_id").cast("int").alias("window_id")).agg((F.max_by("close", "ts") / F.min_by("close", "ts") - 1).alias("r")).groupBy("window_id").agg(F.avg("r").alias("r"))
    before = F.lag("r", 1).over(W.orderBy("window_id"))  # one row a window
    wanted = market.select("window_id", F.when(before > 0.03, "s1").when(before < -0.03, "s2").alias("wanted"))
    every = each.join(F.broadcast(wanted), "window_id")
    fits = F.col("wanted").isNull() | (F.col("wanted") == F.col("strategy_id"))
    mixes = every.groupBy("window_id").agg(F.sum("n").alias("n"), F.avg("pnl").alias("all"), F.coalesce(F.avg(F.when(fits, F.col("pnl"))), F.avg("pnl")).alias("regime"))
    named = mixes.select("window_id", "n", F.explode(F.create_map(F.lit("ensemble"), F.col("all"), F.lit("ensemble_regime"), F.col("regime"))).alias("strategy_id", "pnl"))
    return each.unionByName(named).select("strategy_id", "window_id", "n", rnd("pnl", 5).alias("pnl"))


def wf_windows(bars, seconds: int = 864000) -> list[tuple[int, int]]:
    """Windows of ten days from the first bar to the last; the last one is longer or shorter by half at most."""
    first, last = bars.agg(F.min("ts"), F.max("ts")).first()
    if first is None:
        return [(0, 0)]
    n = max(1, round((last - first) / seconds))
    return [(first + k * seconds, first + (k + 1) * seconds if k < n - 1 else last) for k in range(n)]


for _name in ("st_wf_evolve", "st_wf_cmaes"):

    def _wf(spark, sf_dir, name=_name):
        from barloom.plans import evolve

        out, every = None, B.event_bars(spark, sf_dir)
        for k, (a, b) in enumerate(wf_windows(every)):
            bars = every.where(F.col("ts").between(a, b))
            found = evolve.search(spark, bars, "ge_islands" if name == "st_wf_evolve" else "ge_cmaes").withColumn("window_id", F.lit(k).cast("bigint"))
            out = found if out is None else out.unionByName(found)
        return out

    register(_name)(_wf)
