"""Sources, cleaning, resampling, joins, window functions, splits and regimes."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from barloom.functions.indicators import order, add, ewm_pass, guarded, rolling_rank, rows
from barloom.operators import regimes, splits
from barloom.queries import register
from barloom.queries import sql as S
from barloom.queries.indicators import rnd
from barloom.sources import bars as B
from barloom.sources import cache

OHLCV = ["open", "high", "low", "close", "volume"]
_SEL = "symbol, ts, " + ", ".join(f"{S.rnd(c)} AS {c}" for c in OHLCV)
MID = 1705276800  # 2024-01-15


def bars_out(df):
    return df.select("symbol", "ts", *[rnd(c).alias(c) for c in OHLCV])


def q(select: str, *ctes: str) -> str:
    return S.query(S.BARS, *ctes, select=select)


# sources

@register("src_csv_cache", q(f"SELECT {_SEL} FROM bars"))
def src_csv_cache(spark, sf_dir):
    return bars_out(cache.read_through(spark, cache.fresh(spark, "csv"), lambda: B.event_bars(spark, sf_dir), "csv"))


@register("src_parquet_cache", q(f"SELECT {_SEL} FROM bars WHERE symbol = 'click'"))
def src_parquet_cache(spark, sf_dir):
    return bars_out(cache.read_through(spark, cache.fresh(spark, "bars"), lambda: B.event_bars(spark, sf_dir)).where("symbol = 'click'"))


@register("src_multi_asset", S.query(S.bars(900), select=f"SELECT {_SEL} FROM bars WHERE symbol IN (SELECT symbol FROM bars GROUP BY 1 HAVING count(*) >= 190)"))
def src_multi_asset(spark, sf_dir):
    return bars_out(cache.with_enough(B.event_bars(spark, sf_dir, 900), 190))


@register("src_ohlcv_api", "WITH p AS (SELECT unnest(range(2500)) AS i), x AS (SELECT i, 100.0::DOUBLE + (i*7919 % 1000)/100 AS o, 100.0::DOUBLE + ((i+1)*7919 % 1000)/100 AS c FROM p) "
          "SELECT 'BTC' AS symbol, i*900 AS ts, round(o,6) AS open, round(greatest(o,c)+0.5,6) AS high, round(least(o,c)-0.5,6) AS low, round(c,6) AS close, (i % 17)::DOUBLE AS volume FROM x")  # fmt: skip
def src_ohlcv_api(spark, sf_dir):
    spark.dataSource.register(cache.PagedBars)
    return bars_out(spark.read.format("paged_bars").options(symbol="BTC", bars=2500, page=1000, seconds=900).load())


def _side(name: str, spark_value: str, sql_value: str) -> None:
    @register(name, f"WITH s AS (SELECT event_type AS symbol, epoch_us(ts)//1000000 AS ts, event_id, {sql_value} AS v FROM events), "
              "d AS (SELECT *, row_number() OVER (PARTITION BY symbol, ts ORDER BY event_id) AS rn FROM s) SELECT symbol, ts, floor(v*1000000 + 0.5000001)/1000000 AS v FROM d WHERE rn = 1 AND ts >= 1704153600")  # fmt: skip
    def run(spark, sf_dir):
        ev = B.table(spark, sf_dir, "events").select(F.col("event_type").alias("symbol"), F.floor(B.epoch_micros("ts") / 1_000_000).alias("ts"), "event_id", F.expr(spark_value).alias("v"))
        return B.dedup_first(ev, ["symbol", "ts"], "event_id").where("ts >= 1704153600").select("symbol", "ts", (F.floor(F.col("v") * 1000000 + 0.5000001) / 1000000).alias("v"))


_side("src_funding", "try_cast(cast(value as string) as double) / 1000", "TRY_CAST(value::VARCHAR AS DOUBLE) / 1000")
_side("src_oi", "try_cast(get_json_object(props, '$.k') as double)", "TRY_CAST(props->>'$.k' AS DOUBLE)")
_side("src_lsratio", "try_cast(get_json_object(props, '$.k') as double) / 50", "TRY_CAST(props->>'$.k' AS DOUBLE) / 50")
_side("src_taker", "value / (1 + try_cast(get_json_object(props, '$.k') as double))", "value / (1 + TRY_CAST(props->>'$.k' AS DOUBLE))")


_WEEKS = "ws AS (SELECT row_number() OVER (ORDER BY symbol, ts//604800) - 1 AS strategy_index, symbol, ts//604800 AS week, 100*(arg_max(close, ts)/arg_min(close, ts) - 1) AS cagr, count(*) AS n_trades FROM bars GROUP BY symbol, ts//604800)"


def _week_strategies(spark, sf_dir):
    w = B.event_bars(spark, sf_dir).groupBy("symbol", F.expr("ts div 604800").alias("week")).agg((100 * (F.max_by("close", "ts") / F.min_by("close", "ts") - 1)).alias("cagr"), F.count("*").alias("n_trades"))
    return w.withColumn("strategy_index", (F.row_number().over(W.orderBy("symbol", "week")) - 1).cast("bigint"))  # one row a symbol and week


@register("src_json_results", q("SELECT strategy_index, symbol, round(cagr, 6) AS cagr, n_trades FROM ws WHERE strategy_index % 3 <> 1 AND cagr > 0 AND n_trades >= 5", _WEEKS))
def src_json_results(spark, sf_dir):
    """Strategies and their validations as documents of many lines, a file a symbol, read back and joined by their index."""
    w = _week_strategies(spark, sf_dir).persist()
    try:
        paths = {}
        for name, columns in (("strategies", ["strategy_index", "symbol"]), ("validation", ["strategy_index", "cagr", "n_trades", (F.col("strategy_index") % 3 != 1).alias("passes_all")])):
            paths[name] = cache.fresh(spark, name)
            docs = w.groupBy(F.col("symbol").alias("_s")).agg(F.collect_list(F.struct(*columns)).alias("results")).select(F.to_json(F.struct("results"), {"pretty": "true"}).alias("value"))
            docs.write.option("maxRecordsPerFile", 1).text(paths[name])
    finally:
        w.unpersist()
    read = lambda name, fields: spark.read.schema(f"results array<struct<{fields}>>").json(paths[name], multiLine=True).select(F.inline("results"))
    found = read("strategies", "strategy_index:bigint,symbol:string").join(read("validation", "strategy_index:bigint,cagr:double,n_trades:bigint,passes_all:boolean"), "strategy_index")
    return found.where("passes_all and cagr > 0 and n_trades >= 5").select("strategy_index", "symbol", F.round("cagr", 6).alias("cagr"), "n_trades")


_SNAP = "sn AS (SELECT epoch_us(ts)//86400000000 AS generation, max(value) AS best, count(*) AS n, CASE WHEN (epoch_us(ts)//86400000000) % 3 = 0 THEN NULL ELSE avg(value) END AS mean FROM events GROUP BY 1, (epoch_us(ts)//86400000000) % 3)"


@register("src_snapshots", f"WITH {_SNAP} SELECT generation, best, n, round(mean, 6) AS mean FROM sn")
def src_snapshots(spark, sf_dir):
    """A document a generation, in two formats, one of which may lack a figure."""
    ev = B.table(spark, sf_dir, "events").groupBy(F.floor(B.epoch_micros("ts") / 86_400_000_000).alias("g")).agg(F.max("value").alias("best"), F.count("*").alias("n"), F.avg("value").alias("mean"))
    mean = F.when(F.col("g") % 3 != 0, F.col("mean"))
    old = F.to_json(F.struct(F.col("g").alias("generation"), F.col("best").alias("best_fitness"), F.col("n").alias("population"), mean.alias("mean_fitness")))
    new = F.to_json(F.struct(F.struct(F.col("g").alias("number")).alias("generation_info"), F.struct("best", "n", mean.alias("mean")).alias("statistics")))
    path = cache.fresh(spark, "snapshots")
    ev.select(F.when(F.col("g") % 2 == 0, old).otherwise(new).alias("value")).write.option("maxRecordsPerFile", 1).text(path)
    schema = "generation bigint, best_fitness double, population bigint, mean_fitness double, generation_info struct<number:bigint>, statistics struct<best:double,n:bigint,mean:double>"
    d = spark.read.schema(schema).json(path, multiLine=True)
    return d.select(F.coalesce("generation", "generation_info.number").alias("generation"), F.coalesce("best_fitness", "statistics.best").alias("best"), F.coalesce("population", "statistics.n").alias("n"), F.round(F.coalesce("mean_fitness", "statistics.mean"), 6).alias("mean"))


_PAGED = "WITH p AS (SELECT unnest(range(2500)) AS i), x AS (SELECT i, 100.0::DOUBLE + (i*7919 % 1000)/100 AS o, 100.0::DOUBLE + ((i+1)*7919 % 1000)/100 AS c FROM p) "


@register("src_ohlcv_api_v2", _PAGED + "SELECT 'ETH' AS symbol, i*900 AS ts, round(o,6) AS open, round(greatest(o,c)+0.5,6) AS high, round(least(o,c)-0.5,6) AS low, round(c,6) AS close, (i % 17)::DOUBLE AS volume FROM x WHERE i*900 >= 90000 AND i*900 < 1800000")
def src_ohlcv_api_v2(spark, sf_dir):
    """The second version of the interface: times in milliseconds, prices as text; pages that fail at first are asked for again."""
    spark.dataSource.register(cache.PagedBars)
    raw = spark.read.format("paged_bars").options(version="2", symbol="ETH", bars=2500, page=1000, seconds=900, fail="2", backoff="0.01", rate="50").load()
    df = raw.select("symbol", (F.col("open_time") / 1000).cast("bigint").alias("ts"), *[F.expr(f"try_cast({c} as double)").alias(c) for c in OHLCV])
    return bars_out(B.dedup_first(df, ["symbol", "ts"], "open").where("ts >= 90000 and ts < 1800000"))


CONFIG = """
data:
  symbols: [BTC, ETH]
  timeframe: 15m
  start: 2024-01-01
search:
  population: 200
  rates:
    mutation: 0.1
    crossover: 0.8
  elitist: true
paths:
  - results
  - cache
"""


@register("src_config", "SELECT * FROM (VALUES ('data.start', '2024-01-01'), ('data.symbols.0', 'BTC'), ('data.symbols.1', 'ETH'), ('data.timeframe', '15m'), ('paths.0', 'results'), ('paths.1', 'cache'), ('search.elitist', 'true'), ('search.population', '200'), ('search.rates.crossover', '0.8'), ('search.rates.mutation', '0.1')) t(name, value)")
def src_config(spark, sf_dir):
    """A settings file, read from where Spark reads and given as names and values."""
    from barloom.sources.config import load_config

    path = cache.fresh(spark, "config")
    spark.createDataFrame([(CONFIG,)], "value string").coalesce(1).write.text(path)
    return spark.createDataFrame(sorted(load_config(spark, path).items()), "name string, value string")


def _sink(name: str, kind: str) -> None:
    @register(name, q("SELECT symbol, count(*) AS n, round(sum(volume), 6) AS volume FROM bars GROUP BY 1"))
    def run(spark, sf_dir):
        path = cache.fresh(spark, kind)
        df = B.event_bars(spark, sf_dir)
        writer = df.write.option("header", True)
        (writer.csv if kind == "csv" else writer.json if kind == "json" else writer.parquet)(path)
        back = spark.read.schema(df.schema).option("header", True).format(kind).load(path)
        return back.groupBy("symbol").agg(F.count("*").alias("n"), F.round(F.sum("volume"), 6).alias("volume"))


_sink("snk_csv", "csv")
_sink("snk_json", "json")


@register("snk_snapshot", "SELECT epoch_us(ts)//86400000000 AS g, count(*) AS n, max(value) AS best FROM events GROUP BY 1")
def snk_snapshot(spark, sf_dir):
    """Generations appended one after another to a table by generation; a generation that is written again replaces itself."""
    ev = B.table(spark, sf_dir, "events").select(F.floor(B.epoch_micros("ts") / 86_400_000_000).alias("g"), "event_id", "value").persist()
    path = cache.fresh(spark, "generations")
    try:
        for part in (F.col("g") % 2 == 0, F.col("g") % 2 == 1, F.col("g") % 2 == 1):  # the last one again
            cache.write_generations(ev.where(part), path, "g")
    finally:
        ev.unpersist()
    back = spark.read.schema("g bigint, event_id bigint, value double").parquet(path)
    return back.groupBy("g").agg(F.count("*").alias("n"), F.max("value").alias("best"))


@register("snk_state_atomic", q("SELECT symbol, count(*) AS bars, max(ts) AS last FROM bars GROUP BY 1"))
def snk_state_atomic(spark, sf_dir):
    """A state file written beside its place and renamed onto it, twice; readers see one state or the other."""
    import json

    rows = B.event_bars(spark, sf_dir).groupBy("symbol").agg(F.count("*").alias("bars"), F.max("ts").alias("last")).collect()  # one row a symbol
    path = cache.fresh(spark, "state") + "/state.json"
    cache.write_atomic(spark, path, json.dumps({"symbols": []}))
    cache.write_atomic(spark, path, json.dumps({"symbols": [r.asDict() for r in rows]}))
    return spark.read.schema("symbols array<struct<symbol:string,bars:bigint,last:bigint>>").json(path, multiLine=True).select(F.inline("symbols"))


# cleaning

@register("rel_range_filter", q(f"SELECT {_SEL} FROM bars WHERE ts BETWEEN {MID} AND {MID + 604800}"))
def rel_range_filter(spark, sf_dir):
    return bars_out(B.event_bars(spark, sf_dir).where(F.col("ts").between(MID, MID + 604800)))


@register("rel_ots_split", q(f"SELECT symbol, CASE WHEN ts < {MID} THEN 'train' ELSE 'holdout' END AS part, count(*) AS n, round(avg(close), 6) AS close FROM bars GROUP BY 1, 2"))
def rel_ots_split(spark, sf_dir):
    part = F.when(F.col("ts") < MID, "train").otherwise("holdout")
    return B.event_bars(spark, sf_dir).groupBy("symbol", part.alias("part")).agg(F.count("*").alias("n"), F.round(F.avg("close"), 6).alias("close"))


@register("rel_dedup_first", "SELECT user_id, event_type, event_id FROM (SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY event_id) AS rn FROM events) WHERE rn = 1")
def rel_dedup_first(spark, sf_dir):
    return B.dedup_first(B.table(spark, sf_dir, "events").select("user_id", "event_type", "event_id"), ["user_id", "event_type"], "event_id")


@register("rel_sort", q(f"SELECT {_SEL} FROM bars ORDER BY symbol, ts"))
def rel_sort(spark, sf_dir):
    return bars_out(B.event_bars(spark, sf_dir)).orderBy("symbol", "ts")


_CHK = S.staged("bars", {"r": f"close/nullif({S.lag('close')}, 0) - 1", "dup": f"CASE WHEN {S.lag('ts')} = ts THEN 1 ELSE 0 END"})


@register(
    "chk_ohlc_strict",
    q("SELECT z.symbol, sum(CASE WHEN high < greatest(open, close) OR low > least(open, close) THEN 1 ELSE 0 END)::BIGINT AS bad, sum(dup)::BIGINT AS dups, "
      "sum(CASE WHEN abs(r) > m + 10*s THEN 1 ELSE 0 END)::BIGINT AS jumps, sum(CASE WHEN close IS NULL THEN 1 ELSE 0 END)::BIGINT AS nulls "
      "FROM z JOIN (SELECT symbol, avg(abs(r)) AS m, stddev_samp(abs(r)) AS s FROM z GROUP BY 1) x ON z.symbol = x.symbol GROUP BY 1", _CHK),
)
def chk_ohlc_strict(spark, sf_dir):
    df = B.event_bars(spark, sf_dir).withColumn("r", F.col("close") / F.nullif(F.lag("close", 1).over(order()), F.lit(0.0)) - 1)
    df = df.withColumn("dup", F.coalesce((F.lag("ts", 1).over(order()) == F.col("ts")).cast("int"), F.lit(0)))
    by = W.partitionBy("symbol")
    df = df.withColumn("m", F.avg(F.abs("r")).over(by)).withColumn("s", F.stddev_samp(F.abs("r")).over(by))
    count = lambda c: F.sum(F.coalesce(c, F.lit(False)).cast("bigint"))
    bad = (F.col("high") < F.greatest("open", "close")) | (F.col("low") > F.least("open", "close"))
    return df.groupBy("symbol").agg(count(bad).alias("bad"), F.sum(F.col("dup").cast("bigint")).alias("dups"), count(F.abs("r") > F.col("m") + 10 * F.col("s")).alias("jumps"), count(F.col("close").isNull()).alias("nulls"))


GRID = """grid AS (SELECT symbol, unnest(range(min(ts), max(ts) + 3600, 3600)) AS ts FROM bars GROUP BY symbol),
filled AS (SELECT g.symbol, g.ts, open, high, low, close, coalesce(volume, 0.0) AS volume FROM grid g LEFT JOIN bars b ON g.symbol = b.symbol AND g.ts = b.ts)"""


@register(
    "fix_ohlc",
    q(f"SELECT symbol, ts, {S.rnd('o')} AS open, {S.rnd('greatest(h, o, c)')} AS high, {S.rnd('least(l, o, c)')} AS low, {S.rnd('c')} AS close, volume FROM z", GRID,
      S.staged("filled", {a: f"last_value({b} IGNORE NULLS) OVER {S.ALL}" for a, b in (("o", "open"), ("h", "high"), ("l", "low"), ("c", "close"))})),
)
def fix_ohlc(spark, sf_dir):
    df = B.fill_calendar(B.event_bars(spark, sf_dir), 3600)
    past = order().rowsBetween(W.unboundedPreceding, 0)
    for c in OHLCV[:4]:
        df = df.withColumn(c, F.last(c, ignorenulls=True).over(past))
    return bars_out(df.withColumn("high", F.greatest("high", "open", "close")).withColumn("low", F.least("low", "open", "close")))


@register(
    "chk_asset",
    q("SELECT symbol, count(*) AS n_bars, (max(ts) - min(ts))//86400 AS days, round(count(*)::DOUBLE/nullif((max(ts) - min(ts))//86400*24, 0), 6) AS coverage, "
      "round(100.0*sum(CASE WHEN volume = 0 THEN 1 ELSE 0 END)/count(*), 6)::DOUBLE AS zero_vol_pct, round(min(low), 6) AS lo, round(max(high), 6) AS hi, "
      "count(*)::DOUBLE/nullif((max(ts) - min(ts))//86400*24, 0) > 0.95 AND 100.0*sum(CASE WHEN volume = 0 THEN 1 ELSE 0 END)/count(*) < 5 AS valid FROM bars GROUP BY 1"),
)
def chk_asset(spark, sf_dir):
    days = F.expr("(max(ts) - min(ts)) div 86400")
    out = B.event_bars(spark, sf_dir).groupBy("symbol").agg(F.count("*").alias("n_bars"), days.alias("days"), (100.0 * F.sum((F.col("volume") == 0).cast("int")) / F.count("*")).alias("z"), F.min("low").alias("lo"), F.max("high").alias("hi"))
    cover = F.col("n_bars").cast("double") / F.nullif(F.col("days") * 24, F.lit(0).cast("bigint"))
    return out.select("symbol", "n_bars", "days", F.round(cover, 6).alias("coverage"), F.round("z", 6).alias("zero_vol_pct"), F.round("lo", 6).alias("lo"), F.round("hi", 6).alias("hi"), ((cover > 0.95) & (F.col("z") < 5)).alias("valid"))


# resampling and alignment

_UP = """up AS (SELECT symbol, ts - ts%14400 AS ts, arg_min(open, ts) AS open, max(high) AS high, min(low) AS low, arg_max(close, ts) AS close, sum(volume) AS volume FROM bars GROUP BY 1, 2),
cal AS (SELECT symbol, unnest(range(min(ts), max(ts) + 14400, 14400)) AS ts FROM up GROUP BY symbol),
htf AS (SELECT c.symbol, c.ts, open, high, low, close, coalesce(volume, 0.0) AS volume FROM cal c LEFT JOIN up u ON c.symbol = u.symbol AND c.ts = u.ts)"""


@register("rsm_ohlcv", q(f"SELECT {_SEL} FROM htf", _UP))
def rsm_ohlcv(spark, sf_dir):
    return bars_out(B.resample(B.event_bars(spark, sf_dir), 14400))


@register("rsm_multi_tf", q("SELECT '1h' AS tf, symbol, count(*) AS n, round(sum(volume), 6) AS v FROM bars GROUP BY 2 UNION ALL SELECT '4h', symbol, count(*), round(sum(volume), 6) FROM htf GROUP BY 2", _UP))
def rsm_multi_tf(spark, sf_dir):
    base = B.event_bars(spark, sf_dir)
    total = lambda df, tf: df.groupBy("symbol").agg(F.count("*").alias("n"), F.round(F.sum("volume"), 6).alias("v")).select(F.lit(tf).alias("tf"), "symbol", "n", "v")
    return total(base, "1h").unionByName(total(B.resample(base, 14400), "4h"))


_PAST = f"past AS (SELECT symbol, ts AS b, {S.lag('close')} AS pc, {S.lag('sm')} AS ps FROM hz)"
_HSMA = f"hz AS (SELECT *, {S.g('avg', 'close', 5)} AS sm FROM htf)"


@register("rsm_align", q(f"SELECT x.symbol, x.ts, {S.rnd('pc')} AS v FROM bars x LEFT JOIN past p ON x.symbol = p.symbol AND x.ts - x.ts%14400 = p.b", _UP, _HSMA, _PAST))
def rsm_align(spark, sf_dir):
    base = B.event_bars(spark, sf_dir)
    higher = B.resample(base, 14400).withColumn("pc", F.col("close"))
    return B.align(base, higher, 14400, ["pc"]).select("symbol", "ts", rnd("pc").alias("v"))


@register("rsm_unified", q(f"SELECT x.symbol, x.ts, {S.rnd('x.sm')} AS sma_1h, {S.rnd('pc')} AS close_4h, {S.rnd('ps')} AS sma_4h FROM (SELECT *, {S.g('avg', 'close', 5)} AS sm FROM bars) x LEFT JOIN past p ON x.symbol = p.symbol AND x.ts - x.ts%14400 = p.b", _UP, _HSMA, _PAST))
def rsm_unified(spark, sf_dir):
    base = B.event_bars(spark, sf_dir)
    higher = add(B.resample(base, 14400), {"sma_4h": ("SMA", ("close", 5))}).withColumn("close_4h", F.col("close"))
    out = B.align(add(base, {"sma_1h": ("SMA", ("close", 5))}), higher, 14400, ["close_4h", "sma_4h"])
    return out.select("symbol", "ts", *[rnd(c).alias(c) for c in ("sma_1h", "close_4h", "sma_4h")])


@register("tf_resolve", q(f"SELECT x.symbol, x.ts, {S.rnd('ps')} AS v FROM bars x LEFT JOIN past p ON x.symbol = p.symbol AND x.ts - x.ts%14400 = p.b", _UP, _HSMA, _PAST))
def tf_resolve(spark, sf_dir):
    from barloom.functions.indicators import parse_call

    name, args, frame = parse_call("SMA(close,5,4h)")
    base = B.event_bars(spark, sf_dir)
    seconds = B.TIMEFRAMES[frame]
    return B.align(base, add(B.resample(base, seconds), {"v": (name, args)}), seconds, ["v"]).select("symbol", "ts", rnd("v").alias("v"))


@register("join_asof_backward", q(f"SELECT symbol, ts, round(funding_rate, 8) + 0.0 AS v FROM sided", S.SIDES.strip().lstrip(",")))
def join_asof_backward(spark, sf_dir):
    return B.asof_backward(B.event_bars(spark, sf_dir), B.side_series(spark, sf_dir), "funding_rate").select("symbol", "ts", rnd("funding_rate", 8).alias("v"))


# joins

@register("join_align_inner", q(f"SELECT a.ts, {S.rnd('a.close')} AS a, {S.rnd('b.close')} AS b FROM bars a JOIN bars b ON a.ts = b.ts WHERE a.symbol = 'click' AND b.symbol = 'view'"))
def join_align_inner(spark, sf_dir):
    bars = B.event_bars(spark, sf_dir)
    a = bars.where("symbol = 'click'").select("ts", rnd("close").alias("a"))
    return a.join(bars.where("symbol = 'view'").select("ts", rnd("close").alias("b")), "ts")


@register("join_intersect_index", q("SELECT ts, count(*) AS n, round(avg(close), 6) AS v FROM bars GROUP BY 1 HAVING count(*) = (SELECT count(DISTINCT symbol) FROM bars)"))
def join_intersect_index(spark, sf_dir):
    bars = B.event_bars(spark, sf_dir)
    n = bars.agg(F.count_distinct("symbol").alias("all"))
    out = bars.groupBy("ts").agg(F.count("*").alias("n"), F.round(F.avg("close"), 6).alias("v"))
    return out.crossJoin(F.broadcast(n)).where("n = all").drop("all")  # one row


@register(
    "join_nearest",
    q("SELECT a.ts, round(arg_min(b.close, (abs(b.ts - a.ts), b.ts)), 6) AS v FROM bars a JOIN bars b ON b.ts BETWEEN a.ts - 86400 AND a.ts + 86400 WHERE a.symbol = 'click' AND b.symbol = 'view' GROUP BY 1"),
)
def join_nearest(spark, sf_dir):
    bars = B.event_bars(spark, sf_dir)
    left = bars.where("symbol = 'click'").select(F.lit("p").alias("symbol"), "ts", F.lit(None).cast("double").alias("v"), F.lit(None).cast("bigint").alias("at"), F.lit(1).alias("own"))
    right = bars.where("symbol = 'view'").select(F.lit("p").alias("symbol"), "ts", F.col("close").alias("v"), F.col("ts").alias("at"), F.lit(0).alias("own"))
    both = left.unionByName(right)
    back = W.partitionBy("symbol").orderBy("ts", "own").rowsBetween(W.unboundedPreceding, 0)
    ahead = W.partitionBy("symbol").orderBy(F.desc("ts"), F.asc("own")).rowsBetween(W.unboundedPreceding, 0)
    for c in ("v", "at"):
        both = both.withColumn(f"{c}0", F.last(c, ignorenulls=True).over(back)).withColumn(f"{c}1", F.last(c, ignorenulls=True).over(ahead))
    first = F.col("at1").isNull() | (F.col("ts") - F.col("at0") <= F.col("at1") - F.col("ts"))
    near = F.when(F.col("at0").isNull() | ~F.coalesce(first, F.lit(True)), F.col("v1")).otherwise(F.col("v0"))
    gap = F.least(F.col("ts") - F.col("at0"), F.col("at1") - F.col("ts"))
    return both.where("own = 1").where(gap <= 86400).select("ts", F.round(near, 6).alias("v"))


@register("join_outer_fill", q("SELECT coalesce(a.ts, b.ts) AS ts, round(coalesce(a.volume, 0.0), 6) AS a, round(coalesce(b.volume, 0.0), 6) AS b FROM (SELECT * FROM bars WHERE symbol = 'click') a FULL JOIN (SELECT * FROM bars WHERE symbol = 'view') b ON a.ts = b.ts"))
def join_outer_fill(spark, sf_dir):
    bars = B.event_bars(spark, sf_dir)
    a, b = (bars.where(f"symbol = '{s}'").select("ts", F.col("volume").alias(n)) for s, n in (("click", "a"), ("view", "b")))
    return a.join(b, "ts", "full").select("ts", F.coalesce("a", F.lit(0.0)).alias("a"), F.coalesce("b", F.lit(0.0)).alias("b"))


@register("join_by_index", "SELECT o_orderkey, c_custkey, round(o_totalprice, 2) AS price FROM orders LEFT JOIN customer ON o_custkey = c_custkey")
def join_by_index(spark, sf_dir):
    o, c = B.table(spark, sf_dir, "orders"), B.table(spark, sf_dir, "customer").select("c_custkey")
    return o.join(c, o.o_custkey == c.c_custkey, "left").select("o_orderkey", "c_custkey", F.round("o_totalprice", 2).alias("price"))


@register("join_anti_cache", "SELECT c_custkey FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_totalprice > 200000)")
def join_anti_cache(spark, sf_dir):
    o = B.table(spark, sf_dir, "orders").where("o_totalprice > 200000").select(F.col("o_custkey").alias("c_custkey"))
    return B.table(spark, sf_dir, "customer").select("c_custkey").join(o, "c_custkey", "left_anti")


@register("join_semi_validated", "SELECT c_custkey FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders WHERE o_totalprice > 200000)")
def join_semi_validated(spark, sf_dir):
    o = B.table(spark, sf_dir, "orders").where("o_totalprice > 200000").select(F.col("o_custkey").alias("c_custkey"))
    return B.table(spark, sf_dir, "customer").select("c_custkey").join(o, "c_custkey", "left_semi")


@register("set_isin", "SELECT o_orderkey FROM orders WHERE o_orderpriority IN ('1-URGENT', '2-HIGH')")
def set_isin(spark, sf_dir):
    return B.table(spark, sf_dir, "orders").where(F.col("o_orderpriority").isin("1-URGENT", "2-HIGH")).select("o_orderkey")


@register("set_union_all", "SELECT 'o' AS t, o_custkey AS k FROM orders UNION ALL SELECT 'c', c_custkey FROM customer")
def set_union_all(spark, sf_dir):
    o = B.table(spark, sf_dir, "orders").select(F.lit("o").alias("t"), F.col("o_custkey").alias("k"))
    return o.unionByName(B.table(spark, sf_dir, "customer").select(F.lit("c").alias("t"), F.col("c_custkey").alias("k")))


@register("set_intersect_idx", "SELECT o_custkey AS k FROM orders INTERSECT SELECT c_custkey FROM customer")
def set_intersect_idx(spark, sf_dir):
    return B.table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("k")).intersect(B.table(spark, sf_dir, "customer").select("c_custkey"))


@register("set_except", "SELECT c_custkey AS k FROM customer EXCEPT SELECT o_custkey FROM orders WHERE o_totalprice > 200000")
def set_except(spark, sf_dir):
    return B.table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("k")).subtract(B.table(spark, sf_dir, "orders").where("o_totalprice > 200000").select("o_custkey"))


# windows

def _window(name: str, made: dict, stages: list[dict[str, str]], columns: dict[str, str]) -> None:
    @register(name, q("SELECT symbol, ts, " + ", ".join(f"{S.rnd(v)} AS {k}" for k, v in columns.items()) + " FROM z", S.staged("bars", *stages)))
    def run(spark, sf_dir):
        df = B.event_bars(spark, sf_dir)
        for k, e in made.items():
            df = df.withColumn(k, e() if callable(e) else e)
        return df.select("symbol", "ts", *[rnd(k).alias(k) for k in columns])


def _past():
    return order().rowsBetween(W.unboundedPreceding, 0)


_window("win_lag_lead", {"a": lambda: F.lag("close", 1).over(order()), "b": lambda: F.lead("close", 1).over(order()), "d": lambda: F.col("close") - F.lag("close", 5).over(order())},
        [{"a": S.lag("close"), "b": f"lead(close) OVER ({S.O})", "d": f"close - {S.lag('close', 5)}"}], {"a": "a", "b": "b", "d": "d"})
_window("win_rows_frame", {k: (lambda f=f: guarded(f, "close", 10, 5)) for k, f in (("a", F.avg), ("s", F.stddev_samp), ("lo", F.min), ("hi", F.max), ("t", F.sum))},
        [{k: S.g(f, "close", 10, 5) for k, f in (("a", "avg"), ("s", "stddev_samp"), ("lo", "min"), ("hi", "max"), ("t", "sum"))}], {k: k for k in ("a", "s", "lo", "hi", "t")})
_window("win_rolling_rank", {"v": lambda: rolling_rank("volume", 20, 10)},
        [{"l": f"list(volume) OVER {S.w(20)}", "c": f"count(volume) OVER {S.w(20)}"}, {"v": "CASE WHEN c >= 10 THEN (len(list_filter(l, lambda x: x < volume)) + (len(list_filter(l, lambda x: x = volume)) + 1)/2)/len(l) END"}], {"v": "v"})
_window("win_expanding_max", {"v": lambda: F.max("close").over(_past())}, [{"v": f"max(close) OVER {S.ALL}"}], {"v": "v"})
_window("win_cumprod", {"r": lambda: F.col("close") / F.lag("close", 1).over(order()) - 1, "v": lambda: 100 * F.exp(F.sum(F.log(1 + F.coalesce(F.col("r"), F.lit(0.0)))).over(_past()))},
        [{"r": f"close/{S.lag('close')} - 1"}, {"v": f"100*exp(sum(ln(1 + coalesce(r, 0.0))) OVER {S.ALL})"}], {"v": "v"})
_window("win_cumsum", {"v": lambda: F.sum("volume").over(_past())}, [{"v": f"sum(volume) OVER {S.ALL}"}], {"v": "v"})


@register("win_ffill", q(f"SELECT symbol, ts, {S.rnd('v')} AS v FROM z", GRID, S.staged("filled", {"v": f"last_value(close IGNORE NULLS) OVER {S.ALL}"})))
def win_ffill(spark, sf_dir):
    df = B.fill_calendar(B.event_bars(spark, sf_dir), 3600)
    return df.select("symbol", "ts", rnd(F.last("close", ignorenulls=True).over(_past())).alias("v"))


@register("win_ewm", q(f"SELECT symbol, ts, {S.rnd('v')} AS v FROM z", S.staged("bars", {"v": S.ewm("volume", 0.2, 3)})))
def win_ewm(spark, sf_dir):
    return ewm_pass(B.event_bars(spark, sf_dir), [("volume", 0.2, 3, "v")]).select("symbol", "ts", rnd("v").alias("v"))


@register("win_rank_topk", q("SELECT symbol, ts, round(close, 6) AS close FROM (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY close DESC, ts) AS rn FROM bars) WHERE rn <= 10"))
def win_rank_topk(spark, sf_dir):
    rank = F.row_number().over(W.partitionBy("symbol").orderBy(F.desc("close"), "ts"))
    return B.event_bars(spark, sf_dir).withColumn("rn", rank).where("rn <= 10").select("symbol", "ts", F.round("close", 6).alias("close"))


@register("win_qcut3", q("SELECT symbol, ts, CASE WHEN volume <= a THEN 0 WHEN volume <= b THEN 1 ELSE 2 END::BIGINT AS v FROM bars JOIN (SELECT symbol AS s, quantile_cont(volume, 1.0::DOUBLE/3) AS a, quantile_cont(volume, 2.0::DOUBLE/3) AS b FROM bars GROUP BY 1) ON s = symbol"))
def win_qcut3(spark, sf_dir):
    bars = B.event_bars(spark, sf_dir)
    cut = bars.groupBy("symbol").agg(F.percentile("volume", F.array(F.lit(1 / 3), F.lit(2 / 3))).alias("p"))
    v = F.when(F.col("volume") <= F.col("p")[0], 0).when(F.col("volume") <= F.col("p")[1], 1).otherwise(2).cast("bigint")
    return bars.join(cut, "symbol").select("symbol", "ts", v.alias("v"))


@register("win_tercile_pos", q("SELECT symbol, ts, CASE WHEN rn < n//3 THEN 0 WHEN rn < 2*(n//3) THEN 1 ELSE 2 END::BIGINT AS v FROM (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY volume, ts) - 1 AS rn, count(*) OVER (PARTITION BY symbol) AS n FROM bars)"))
def win_tercile_pos(spark, sf_dir):
    rn = F.row_number().over(W.partitionBy("symbol").orderBy("volume", "ts")) - 1
    df = B.event_bars(spark, sf_dir).withColumn("rn", rn).withColumn("n", F.count("*").over(W.partitionBy("symbol")))
    return df.select("symbol", "ts", F.expr("cast(case when rn < n div 3 then 0 when rn < 2*(n div 3) then 1 else 2 end as bigint)").alias("v"))


# splits

_POS = f"pos AS (SELECT *, row_number() OVER ({S.O}) - 1 AS p, count(*) OVER (PARTITION BY symbol) AS n FROM bars)"


@register("spl_cpcv_groups", q("SELECT symbol, least(p // (n // 6), 5) AS grp, count(*) AS n, min(ts) AS a, max(ts) AS b FROM pos GROUP BY 1, 2", _POS))
def spl_cpcv_groups(spark, sf_dir):
    return splits.groups(B.event_bars(spark, sf_dir), 6).groupBy("symbol", "grp").agg(F.count("*").alias("n"), F.min("ts").alias("a"), F.max("ts").alias("b"))


_SPLITS = "SELECT row_number() OVER (ORDER BY a, b, c) - 1 AS split_id, a, b, c FROM (SELECT x.i AS a, y.i AS b, z.i AS c FROM range(6) x(i), range(6) y(i), range(6) z(i) WHERE x.i < y.i AND y.i < z.i)"


@register("spl_cpcv_combos", _SPLITS)
def spl_cpcv_combos(spark, sf_dir):
    return splits.combinations(spark, 6, 3).select("split_id", *[F.col("test")[k].alias(c) for k, c in enumerate("abc")])


@register(
    "spl_cpcv_purge",
    q(
        "SELECT symbol, split_id, role, count(*) AS n FROM (SELECT symbol, split_id, CASE WHEN g IN (a, b, c) THEN 'test' ELSE 'train' END AS role, "
        "CASE WHEN g IN (a, b, c) AND g > 0 AND (g - 1) NOT IN (a, b, c) AND q < 2 THEN false WHEN g NOT IN (a, b, c) AND (g + 1) IN (a, b, c) AND q >= m - 4 THEN false ELSE true END AS keep "
        "FROM (SELECT *, row_number() OVER (PARTITION BY symbol, g ORDER BY ts) - 1 AS q, count(*) OVER (PARTITION BY symbol, g) AS m FROM (SELECT *, least(p // (n // 6), 5) AS g FROM pos)), splits) WHERE keep GROUP BY 1, 2, 3",
        _POS, f"splits AS ({_SPLITS})",
    ),
)
def spl_cpcv_purge(spark, sf_dir):
    rows_ = splits.purged(splits.groups(B.event_bars(spark, sf_dir), 6), splits.combinations(spark, 6, 3), purge=4, embargo=2)
    return rows_.groupBy("symbol", "split_id", "role").agg(F.count("*").alias("n"))


_WF = "wf AS (SELECT k AS window_id, 1704067200 + k*432000 AS a, 1704067200 + k*432000 + 864000 AS b, 1704067200 + k*432000 + 864000 + 86400 AS c, 1704067200 + k*432000 + 864000 + 86400 + 432000 AS d FROM range(4) t(k))"


@register("spl_wf_v1", q("SELECT symbol, window_id, count(*) FILTER (WHERE ts BETWEEN a AND b) AS train, count(*) FILTER (WHERE ts BETWEEN c AND d) AS test FROM bars JOIN wf ON ts BETWEEN a AND d GROUP BY 1, 2", _WF))
def spl_wf_v1(spark, sf_dir):
    windows = splits.walk_forward(spark, 1704067200, 4, train=864000, gap=86400, test=432000, step=432000)
    both = splits.in_windows(B.event_bars(spark, sf_dir), windows)
    return both.groupBy("symbol", "window_id").agg(F.count(F.when(F.col("role") == "train", 1)).alias("train"), F.count(F.when(F.col("role") == "test", 1)).alias("test"))


@register("spl_wf_v2", q("SELECT symbol, window_id, count(*) FILTER (WHERE ts >= 1704067200 AND ts < b) AS train, count(*) FILTER (WHERE ts >= c AND ts < d) AS test FROM bars JOIN wf ON ts < d GROUP BY 1, 2 HAVING count(*) FILTER (WHERE ts >= 1704067200 AND ts < b) >= 50 AND count(*) FILTER (WHERE ts >= c AND ts < d) >= 10", _WF))
def spl_wf_v2(spark, sf_dir):
    windows = splits.walk_forward(spark, 1704067200, 4, train=864000, gap=86400, test=432000, step=432000, expanding=True)
    both = splits.in_windows(B.event_bars(spark, sf_dir), windows, half_open=True)
    out = both.groupBy("symbol", "window_id").agg(F.count(F.when(F.col("role") == "train", 1)).alias("train"), F.count(F.when(F.col("role") == "test", 1)).alias("test"))
    return out.where("train >= 50 and test >= 10")


@register("spl_wf_assert", q("SELECT window_id, max(ts) FILTER (WHERE ts BETWEEN a AND b) < min(ts) FILTER (WHERE ts BETWEEN c AND d) AS ok FROM bars JOIN wf ON ts BETWEEN a AND d GROUP BY 1", _WF))
def spl_wf_assert(spark, sf_dir):
    windows = splits.walk_forward(spark, 1704067200, 4, train=864000, gap=86400, test=432000, step=432000)
    return splits.no_lookahead(splits.in_windows(B.event_bars(spark, sf_dir), windows))


@register("spl_period_gates", q("SELECT symbol, CASE WHEN ts < 1704672000 THEN 'p1' WHEN ts < 1705276800 THEN 'p2' WHEN ts < 1705881600 THEN 'p3' ELSE 'p4' END AS period, count(*) AS n FROM bars GROUP BY 1, 2"))
def spl_period_gates(spark, sf_dir):
    edges = [0, 1704672000, 1705276800, 1705881600, 9_999_999_999]
    return splits.periods(B.event_bars(spark, sf_dir), [(f"p{k + 1}", edges[k], edges[k + 1]) for k in range(4)]).groupBy("symbol", "period").agg(F.count("*").alias("n"))


def _h(text: str) -> str:
    return f"('0x' || substr(md5({text}), 1, 8))::BIGINT"


@register("spl_rotation", q("SELECT symbol, 'w_' || st || '_96' AS window_id, count(*) AS n, round(avg(close), 6) AS close FROM pos JOIN (SELECT k*96 AS st FROM range(40) t(k) ORDER BY " + _h("'7:' || (k*96)") + ", k LIMIT 6) ON p >= st AND p < st + 96 GROUP BY 1, 2", _POS))
def spl_rotation(spark, sf_dir):
    starts = splits.hashed_starts(spark, n=40, stride=96, keep=6, seed=7)
    return splits.position_windows(B.event_bars(spark, sf_dir), starts, 96).groupBy("symbol", "window_id").agg(F.count("*").alias("n"), F.round(F.avg("close"), 6).alias("close"))


def longest(bars) -> int:
    """Bars of the longest symbol."""
    return bars.groupBy("symbol").count().agg(F.coalesce(F.max("count"), F.lit(0))).first()[0]


@register("spl_rand_windows")
def spl_rand_windows(spark, sf_dir):
    bars = B.event_bars(spark, sf_dir)
    starts = splits.random_starts(spark, total=longest(bars), length=96, n=5, seed=11)
    return splits.position_windows(bars, starts, 96).groupBy("symbol", "window_id").agg(F.count("*").alias("n"))


@register("spl_cma_windows")
def spl_cma_windows(spark, sf_dir):
    bars = B.event_bars(spark, sf_dir)
    starts = splits.random_starts(spark, total=longest(bars), length=48, n=5, seed=3)
    return splits.position_windows(bars, starts, 48).groupBy("symbol", "window_id").agg(F.count("*").alias("n"))


_CH = "ch AS (SELECT symbol, ts//604800 AS c, count(*) AS n, stddev_samp(r) AS vol FROM (SELECT *, close/" + S.lag("close") + " - 1 AS r FROM bars) GROUP BY 1, 2 HAVING count(*) > 20)"


@register("spl_month_chunks", q("SELECT symbol, c AS chunk, n FROM (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY " + _h("'5:' || symbol || ':' || c") + ", c) AS rn FROM ch) WHERE rn <= 3", _CH))
def spl_month_chunks(spark, sf_dir):
    return splits.sampled_chunks(splits.chunks(B.event_bars(spark, sf_dir), 604800, 20), 3, seed=5).select("symbol", "chunk", "n")


@register("spl_vol_strata", q("SELECT symbol, chunk, stratum FROM (SELECT *, row_number() OVER (PARTITION BY stratum ORDER BY " + _h("'5:' || symbol || ':' || chunk") + ", symbol, chunk) AS rn FROM (SELECT symbol, c AS chunk, CASE WHEN k < m//3 THEN 0 WHEN k < 2*(m//3) THEN 1 ELSE 2 END::BIGINT AS stratum FROM (SELECT *, row_number() OVER (ORDER BY vol, symbol, c) - 1 AS k, count(*) OVER () AS m FROM ch))) WHERE rn <= 3", _CH))
def spl_vol_strata(spark, sf_dir):
    return splits.stratified_chunks(splits.chunks(B.event_bars(spark, sf_dir), 604800, 20), 3, seed=5).select("symbol", "chunk", "stratum")


@register("spl_wf_strata", q("SELECT stratum, count(*) AS n FROM (SELECT CASE WHEN vol <= a THEN 'low' WHEN vol <= b THEN 'mid' ELSE 'high' END AS stratum FROM ch, (SELECT quantile_cont(vol, 1.0::DOUBLE/3) AS a, quantile_cont(vol, 2.0::DOUBLE/3) AS b FROM ch)) GROUP BY 1", _CH))
def spl_wf_strata(spark, sf_dir):
    return splits.volatility_strata(splits.chunks(B.event_bars(spark, sf_dir), 604800, 20)).groupBy("stratum").agg(F.count("*").alias("n"))


# regimes

_RG = S.staged(
    "bars",
    {"sm": S.g("avg", "close", 50), "lr": f"ln(close/{S.lag('close')})"},
    {"sl": f"(sm - {S.lag('sm', 5)})/nullif(sm, 0)", "vo": S.g("stddev_samp", "lr", 20)},
    {"md": "quantile_cont(vo, 0.5) OVER (PARTITION BY symbol)", "rn": f"row_number() OVER ({S.O})"},
)
_LABEL = "CASE WHEN rn <= 100 OR sl IS NULL OR vo IS NULL OR vo > 1.5*md THEN 'sideways' WHEN sl > 0.005 THEN 'bull' WHEN sl < -0.005 THEN 'bear' ELSE 'sideways' END"


@register("rg_sma", q(f"SELECT symbol, ts, {_LABEL} AS regime FROM z", _RG))
def rg_sma(spark, sf_dir):
    return regimes.by_average(B.event_bars(spark, sf_dir)).select("symbol", "ts", "regime")


@register("met_regime_summary", q(f"SELECT s.symbol, l.regime, coalesce(n, 0) AS n, round(coalesce(n, 0)::DOUBLE/t, 6) AS share FROM (SELECT symbol, count(*) AS t FROM z GROUP BY 1) s CROSS JOIN (VALUES ('bull'), ('bear'), ('sideways')) l(regime) LEFT JOIN (SELECT symbol, {_LABEL} AS regime, count(*) AS n FROM z GROUP BY 1, 2) x ON x.symbol = s.symbol AND x.regime = l.regime", _RG))
def met_regime_summary(spark, sf_dir):
    return regimes.summary(regimes.by_average(B.event_bars(spark, sf_dir))).select("symbol", "regime", "n", F.round("share", 6).alias("share"))


_FL = "fl AS (SELECT symbol, ts//604800 AS chunk, arg_min(close, ts) AS a, arg_max(close, ts) AS b, count(*) AS n FROM bars GROUP BY 1, 2)"


def _label(name: str, limit: float) -> None:
    @register(name, q(f"SELECT symbol, chunk, round(b/a - 1, 6) + 0.0 AS ret, CASE WHEN b/a - 1 > {limit} THEN 'bull' WHEN b/a - 1 < -{limit} THEN 'bear' ELSE 'sideways' END AS regime FROM fl", _FL))
    def run(spark, sf_dir):
        return regimes.by_return(B.event_bars(spark, sf_dir), 604800, limit).select("symbol", "chunk", rnd("ret").alias("ret"), "regime")


_label("rg_window_return", 0.15)
_label("rg_window_20", 0.20)


@register("rg_confidence", q("SELECT symbol, CASE WHEN s >= 2 THEN 'bull' WHEN s <= -2 THEN 'bear' ELSE 'sideways' END AS regime, round(abs(s)/3.0, 6)::DOUBLE AS confidence FROM (SELECT symbol, arg_max(coalesce(sign(close - a), 0) + coalesce(sign(close - b), 0) + coalesce(sign(close - c), 0), ts)::BIGINT AS s FROM z GROUP BY 1)", S.staged("bars", {"a": S.g("avg", "close", 10), "b": S.g("avg", "close", 30), "c": S.g("avg", "close", 60)})))
def rg_confidence(spark, sf_dir):
    out = regimes.vote(B.event_bars(spark, sf_dir), (10, 30, 60))
    return out.select("symbol", "regime", F.round("confidence", 6).alias("confidence"))


@register("rg_from_window_metrics", q("SELECT CASE WHEN b/a - 1 > 0.03 THEN 'bull' WHEN b/a - 1 < -0.03 THEN 'bear' ELSE 'sideways' END AS regime, count(*) AS n, round(avg(b/a - 1), 6) + 0.0 AS ret FROM fl GROUP BY 1", _FL))
def rg_from_window_metrics(spark, sf_dir):
    return regimes.by_return(B.event_bars(spark, sf_dir), 604800, 0.03).groupBy("regime").agg(F.count("*").alias("n"), rnd(F.avg("ret")).alias("ret"))


@register("rg_signal_affinity", q(f"SELECT symbol, regime, count(*) FILTER (WHERE sg) AS n, round(count(*) FILTER (WHERE sg)::DOUBLE/nullif(sum(count(*) FILTER (WHERE sg)) OVER (PARTITION BY symbol), 0), 6) AS share FROM (SELECT symbol, {_LABEL} AS regime, close > open AS sg FROM z) GROUP BY 1, 2", _RG))
def rg_signal_affinity(spark, sf_dir):
    df = regimes.by_average(B.event_bars(spark, sf_dir)).withColumn("sg", F.col("close") > F.col("open"))
    return regimes.affinity(df, "sg").select("symbol", "regime", "n", F.round("share", 6).alias("share"))


_FEAT = regimes.FEATURES


@register("rg_hmm_features", q("SELECT symbol, ts, " + ", ".join(f"CASE WHEN {c} IS NOT NULL THEN {S.rnd(f'least(greatest({c}, m_{c} - 5*s_{c}), m_{c} + 5*s_{c})')} END AS {c}" for c in _FEAT) + " FROM zz",
    S.staged("bars", {"ret": f"ln(close/{S.lag('close')})", "av": S.g("avg", "close", 50)}, {"vol": S.g("stddev_samp", "ret", 20), "vr": f"volume/nullif({S.g('avg', 'volume', 20)}, 0)", "slope": f"abs((av - {S.lag('av', 5)})/nullif(av, 0))"}, {"vov": S.g("stddev_samp", "vol", 40)}),
    "zz AS (SELECT *, " + ", ".join(f"avg({c}) OVER (PARTITION BY symbol) AS m_{c}, stddev_samp({c}) OVER (PARTITION BY symbol) AS s_{c}" for c in _FEAT) + " FROM z)"))
def rg_hmm_features(spark, sf_dir):
    df = regimes.features(B.event_bars(spark, sf_dir))
    return df.select("symbol", "ts", *[rnd(c).alias(c) for c in _FEAT])


def _features(spark, sf_dir):
    return regimes.features(B.event_bars(spark, sf_dir))


@register("rg_hmm_fit")
def rg_hmm_fit(spark, sf_dir):
    return regimes.fit_models(_features(spark, sf_dir)).select("symbol", "states", F.transform("parameters", lambda x: F.round(x, 6)).alias("parameters"))


@register("rg_predict")
def rg_predict(spark, sf_dir):
    return regimes.hmm(_features(spark, sf_dir)).groupBy("symbol", "state").agg(F.count("*").alias("n"), F.round(F.avg("vol"), 8).alias("vol"))


@register("rg_stability")
def rg_stability(spark, sf_dir):
    return regimes.stability(regimes.hmm(_features(spark, sf_dir)))


@register("src_model_load", q("SELECT DISTINCT symbol, true AS same FROM bars"))
def src_model_load(spark, sf_dir):
    """Models saved as a table and read back give the same states as the ones that were fitted."""
    feats = _features(spark, sf_dir)
    models = regimes.fit_models(feats).persist()
    try:
        path = cache.fresh(spark, "models")
        models.write.parquet(path)
        back = spark.read.schema(models.schema).parquet(path)
        a, b = (regimes.predict(feats, m).select("symbol", "ts", "state") for m in (models, back))
        both = a.join(b.withColumnRenamed("state", "again"), ["symbol", "ts"], "full").groupBy("symbol").agg(F.bool_and(F.col("state").eqNullSafe(F.col("again"))).alias("same"))
        every = feats.select("symbol").distinct()
        return every.join(both, "symbol", "left").select("symbol", F.coalesce("same", F.lit(True)).alias("same"))
    finally:
        models.unpersist()


@register("rg_combined")
def rg_combined(spark, sf_dir):
    bars = B.event_bars(spark, sf_dir)
    return regimes.combined(bars, regimes.by_average(bars), regimes.hmm(regimes.features(bars)))


@register("rg_sizing_mult", q("SELECT symbol, ts, round(least(greatest((least(volume/10, 1.0) + 0.5)/2*CASE WHEN close < open THEN 0.7 ELSE 1.1 END, 0.3), 1.0), 6) AS v FROM bars"))
def rg_sizing_mult(spark, sf_dir):
    conf = F.least(F.col("volume") / 10, F.lit(1.0))
    return B.event_bars(spark, sf_dir).select("symbol", "ts", F.round(regimes.sizing(conf, F.lit(0.5), F.col("close") < F.col("open")), 6).alias("v"))


__all__ = ["rows"]
