"""Indicators, pattern modules and predicates."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from barloom.functions import predicates as P
from barloom.functions.indicators import order, add, atr_sma, guarded, over, parse_call, rows
from barloom.plans import patterns
from barloom.queries import register
from barloom.queries import sql as S
from barloom.sources.bars import asof_backward, event_bars, side_series


def rnd(x, digits: int = 6):
    return F.round(x, digits) + F.lit(0.0)


def with_sides(bars: DataFrame, funding: DataFrame) -> DataFrame:
    """Bars with funding as of their start, and stand-ins for open interest and the two ratios."""
    out = asof_backward(bars, funding, "funding_rate")
    return (
        out.withColumn("open_interest", 1000 + F.sum("volume").over(order()))
        .withColumn("ls_ratio", 1 + (F.col("close") - F.col("open")) / F.col("open"))
        .withColumn("taker_buy_sell_ratio", (F.col("high") - F.col("open") + 1) / (F.col("open") - F.col("low") + 1))
    )


def _z(x: str, n: int, least: int) -> list[dict[str, str]]:
    return [{"mu": S.g("avg", x, n, least), "sd": S.g("stddev_samp", x, n, least)}, {"v": f"({x} - mu)/nullif(sd, 0)"}]


def _rsi(x: str, n: int) -> list[dict[str, str]]:
    return [
        {"ch": f"{x} - {S.lag(x)}"},
        {"up": "CASE WHEN ch IS NOT NULL THEN greatest(ch, 0.0) END", "dn": "CASE WHEN ch IS NOT NULL THEN greatest(-ch, 0.0) END"},
        {"gu": S.ewm("up", 1 / n, n), "gd": S.ewm("dn", 1 / n, n)},
        {"rsi": "100 - 100/(1 + gu/nullif(gd, 0))"},
    ]


def _band(n: int, k: float) -> dict[str, str]:
    return {"mid": S.g("avg", "close", n), "sd": S.g("stddev_samp", "close", n)}


def _stoch(n: int) -> list[dict[str, str]]:
    return [{"lo": S.g("min", "low", n), "hi": S.g("max", "high", n)}, {"k": "100*(close - lo)/nullif(hi - lo, 0)"}]


def _held(n: int) -> str:
    return f"max(hit) OVER {S.w(max(1, min(n // 2, 8)))}"


def _breakout(up: bool) -> list[dict[str, str]]:
    edge = S.g("max", "high", 20) if up else S.g("min", "low", 20)
    return [{"edge": edge}, {"prev": S.lag("edge")}, {"hit": f"CASE WHEN close {'>' if up else '<'} prev THEN 100.0::DOUBLE ELSE 0.0::DOUBLE END"}, {"v": _held(20)}]


def _divergence(bull: bool) -> list[dict[str, str]]:
    f, a, b = ("min", "<", ">") if bull else ("max", ">", "<")
    return [
        *_rsi("close", 14),
        {"pe": S.g(f, "close", 10), "oe": S.g(f, "rsi", 10)},
        {"pp": S.lag("pe"), "oo": S.lag("oe")},
        {"hit": f"CASE WHEN close {a} pp AND rsi {b} oo THEN 100.0::DOUBLE ELSE 0.0::DOUBLE END"},
        {"v": _held(10)},
    ]


_MACD = [{"fa": S.ewm("close", 2 / 13, 12), "sl": S.ewm("close", 2 / 27, 26)}, {"line": "fa - sl"}, {"sg": S.ewm("line", 2 / 10, 9)}]
_DM = [
    {"tr": S.TR, "u": f"high - {S.lag('high')}", "d": f"{S.lag('low')} - low"},
    {"pl": "CASE WHEN u > d AND u > 0 THEN u ELSE 0.0 END", "mi": "CASE WHEN d > u AND d > 0 THEN d ELSE 0.0 END"},
    {"a": S.ewm("tr", 1 / 14), "p": S.ewm("pl", 1 / 14, 14), "m": S.ewm("mi", 1 / 14, 14)},
]
_ADX = [
    _DM[0], _DM[1], {"a": S.ewm("tr", 1 / 14, 14), "p": S.ewm("pl", 1 / 14, 14), "m": S.ewm("mi", 1 / 14, 14)},
    {"pd": "100*p/nullif(a, 0)", "md": "100*m/nullif(a, 0)"}, {"dx": "100*abs(pd - md)/nullif(pd + md, 0)"}, {"ax": S.ewm("dx", 1 / 14, 14)},
    {"v": "CASE WHEN ax IS NOT NULL THEN least(greatest(ax, 0.0), 100.0) END"},
]

#: query: (call, oracle stages that end in v, oracle source)
CALLS: dict[str, tuple[str, list[dict[str, str]]]] = {
    "ind_sma": ("SMA(close,20)", [{"v": S.g("avg", "close", 20)}]),
    "ind_ema": ("EMA(close,20)", [{"v": S.ewm("close", 2 / 21, 20)}]),
    "ind_rsi": ("RSI(close,14)", [*_rsi("close", 14), {"v": "rsi"}]),
    "ind_atr": ("ATR(14)", [{"tr": S.TR}, {"v": S.ewm("tr", 2 / 15)}]),
    "ind_stoch_k": ("STOCH_K(14)", [*_stoch(14), {"v": "k"}]),
    "ind_stoch_d": ("STOCH_D(14)", [*_stoch(14), {"v": S.g("avg", "k", 3)}]),
    "ind_pct_b": ("PCT_B(20,2.0)", [_band(20, 2), {"v": "100*(close - (mid - 2*sd))/nullif((mid + 2*sd) - (mid - 2*sd), 0)"}]),
    "ind_macd_norm": ("MACD_NORM(12,26,9)", [*_MACD, {"tr": S.TR}, {"a": S.ewm("tr", 2 / 15)}, {"v": "(line - sg)/nullif(a, 0)"}]),
    "ind_price_pos": ("PRICE_POS(20)", [{"tr": S.TR, "mid": S.g("avg", "close", 20)}, {"a": S.ewm("tr", 2 / 15)}, {"v": "(close - mid)/nullif(a, 0)"}]),
    "ind_roc": ("ROC(10)", [{"v": f"100*(close/nullif({S.lag('close', 10)}, 0) - 1)"}]),
    "ind_vol_ratio": ("VOL_RATIO(20)", [{"v": f"volume/nullif({S.g('avg', 'volume', 20)}, 0)"}]),
    "ind_bbwidth": ("BBWIDTH(20,2.0)", [_band(20, 2), {"v": "100*2*2*sd/nullif(mid, 0)"}]),
    "ind_atr_pct": ("ATR_PCT(14)", [{"tr": S.TR}, {"a": S.ewm("tr", 2 / 15)}, {"v": "100*a/nullif(close, 0)"}]),
    "ind_adx": ("ADX(14)", _ADX),
    "ind_mfi": (
        "MFI(14)",
        [
            {"tp": "(high + low + close)/3"}, {"ch": f"tp - {S.lag('tp')}"},
            {"up": "CASE WHEN ch > 0 THEN tp*volume ELSE 0.0 END", "dn": "CASE WHEN ch < 0 THEN tp*volume ELSE 0.0 END"},
            {"v": f"100 - 100/(1 + ({S.g('sum', 'up', 14)})/nullif({S.g('sum', 'dn', 14)}, 0))"},
        ],
    ),
    "ind_breakout_up": ("BREAKOUT_UP(20)", _breakout(True)),
    "ind_breakout_down": ("BREAKOUT_DOWN(20)", _breakout(False)),
    "ind_squeeze": (
        "SQUEEZE(20,2.0)",
        [
            _band(20, 2), {"wd": "100*2*2*sd/nullif(mid, 0)"},
            {"l": f"list_filter(list(wd) OVER {S.w(40)}, lambda z: z IS NOT NULL)", "c": f"count(wd) OVER {S.w(40)}"},
            {"v": "CASE WHEN c >= 20 AND wd IS NOT NULL THEN 100*(1 - (len(list_filter(l, lambda z: z < wd)) + (len(list_filter(l, lambda z: z = wd)) + 1)/2)/len(l)) END"},
        ],
    ),
    "ind_trending": (
        "TRENDING(RSI,14,10)",
        [
            *_rsi("close", 14), {"n": f"(row_number() OVER ({S.O}))::DOUBLE"},
            {"sl": f"CASE WHEN count(rsi) OVER {S.w(10)} >= 10 THEN regr_slope(rsi, n) OVER {S.w(10)} END", "sd": S.g("stddev_samp", "rsi", 10)},
            {"t": "50*sl/nullif(sd, 0)"}, {"v": "CASE WHEN t IS NOT NULL THEN least(greatest(t, -100.0), 100.0) END"},
        ],
    ),
    "ind_divergence_bull": ("DIVERGENCE_BULL(RSI,14,10)", _divergence(True)),
    "ind_divergence_bear": ("DIVERGENCE_BEAR(RSI,14,10)", _divergence(False)),
    "ind_funding_zscore": ("FUNDING_ZSCORE(24)", _z("funding_rate", 24, 12)),
    "ind_oi_change": ("OI_CHANGE(10)", [{"v": f"100*(open_interest/nullif({S.lag('open_interest', 10)}, 0) - 1)"}]),
    "ind_oi_price_div": (
        "OI_PRICE_DIV(10)",
        [{"dv": f"(open_interest/nullif({S.lag('open_interest', 10)}, 0) - 1) - (close/nullif({S.lag('close', 10)}, 0) - 1)"}, *_z("dv", 40, 10)],
    ),
    "ind_ls_ratio_change": ("LS_RATIO_CHANGE(10)", [{"dv": f"ls_ratio - {S.lag('ls_ratio', 10)}"}, *_z("dv", 40, 10)]),
    "ind_taker_imbalance": ("TAKER_IMBALANCE(10)", [{"dv": S.g("avg", "taker_buy_sell_ratio", 10)}, *_z("dv", 40, 10)]),
    "ind_macd_line": ("MACD_LINE(12,26,9)", [*_MACD, {"v": "line"}]),
    "ind_macd_signal": ("MACD_SIGNAL(12,26,9)", [*_MACD, {"v": "sg"}]),
    "ind_macd_hist": ("MACD_HIST(12,26,9)", [*_MACD, {"v": "line - sg"}]),
    "ind_bband_upper": ("BBAND_UPPER(20,2.0)", [_band(20, 2), {"v": "mid + 2*sd"}]),
    "ind_bband_lower": ("BBAND_LOWER(20,2.0)", [_band(20, 2), {"v": "mid - 2*sd"}]),
    "ind_volume_sma": ("VOLUME_SMA(20)", [{"v": S.g("avg", "volume", 20)}]),
    "ind_atr_sma_final": ("ATR_SMA(14)", [{"tr": S.TR}, {"v": S.g("avg", "tr", 14)}]),
}
SIDED = {"ind_funding_zscore", "ind_oi_change", "ind_oi_price_div", "ind_ls_ratio_change", "ind_taker_imbalance"}


def _indicator(name: str, call: str, stages: list[dict[str, str]]) -> None:
    source = [S.BARS + S.SIDES] if name in SIDED else [S.BARS]
    sql = S.query(*source, S.staged("sided" if name in SIDED else "bars", *stages), select=f"SELECT symbol, ts, {S.rnd('v')} AS v FROM z")

    @register(name, sql)
    def run(spark, sf_dir):
        df = event_bars(spark, sf_dir)
        if name in SIDED:
            df = with_sides(df, side_series(spark, sf_dir))
        fn, args, _ = parse_call(call)
        return add(df, {"v": (fn, args)}).select("symbol", "ts", rnd("v").alias("v"))


for _name, (_call, _stages) in CALLS.items():
    _indicator(_name, _call, _stages)


@register("ind_const", S.query(S.BARS, select="SELECT symbol, ts, 42.5::DOUBLE AS v FROM bars"))
def ind_const(spark, sf_dir):
    return event_bars(spark, sf_dir).select("symbol", "ts", F.lit(42.5).alias("v"))


# pattern modules and tokens

PACK_SQL = [
    {"body_pct": "abs(close - open)/nullif(open, 0)", "range_pct": "(high - low)/nullif(low, 0)", "close_pos": "coalesce((close - low)/nullif(high - low, 0), 0.5)", "ch": f"close - {S.lag('close')}", "tr": S.TR, "rn": f"row_number() OVER ({S.O}) - 1"},
    {"up": "CASE WHEN ch > 0 THEN ch ELSE 0.0 END", "dn": "CASE WHEN ch < 0 THEN -ch ELSE 0.0 END", "sma_20": S.g("avg", "close", 20), "sma_50": S.g("avg", "close", 50), "sma_v_20": S.g("avg", "volume", 20), "sd": S.g("stddev_samp", "close", 20), "atr_14": S.g("avg", "tr", 14), "lo": S.g("min", "low", 14), "hi": S.g("max", "high", 14), "fa": S.ewm("close", 2 / 13), "sl": S.ewm("close", 2 / 27)},
    {"rsi_14": f"100 - 100/(1 + ({S.g('avg', 'up', 14)})/nullif({S.g('avg', 'dn', 14)}, 0))", "bb_upper": "sma_20 + 2*sd", "bb_lower": "sma_20 - 2*sd", "atr_sma_20": S.g("avg", "atr_14", 20), "fk": "100*(close - lo)/nullif(hi - lo, 0)", "macd": "fa - sl"},
    {"bb_width": "bb_upper - bb_lower", "stoch_k": S.g("avg", "fk", 3), "macd_signal": S.ewm("macd", 2 / 10)},
    {"bb_width_sma_20": S.g("avg", "bb_width", 20), "stoch_d": S.g("avg", "stoch_k", 3), "macd_hist": "macd - macd_signal"},
]


@register("ind_v1_pack", S.query(S.BARS, S.staged("bars", *PACK_SQL), select="SELECT symbol, ts, " + ", ".join(f"{S.rnd(c)} AS {c}" for c in patterns.PACK) + " FROM z"))
def ind_v1_pack(spark, sf_dir):
    return patterns.indicator_pack(event_bars(spark, sf_dir)).select("symbol", "ts", *[rnd(c).alias(c) for c in patterns.PACK])


def _token_sql(text: str) -> str:
    used: list[str] = []

    def one(m):
        column, k = patterns.token(m)
        used.append(f"(lag({column}, {k}) OVER ({S.O}))" if k else column)
        return used[-1]

    body = patterns.TOKEN.sub(one, text)
    known = " AND ".join(f"{u} IS NOT NULL" for u in dict.fromkeys(used))
    return f"coalesce(({body}) AND {known} AND rn >= {patterns.lookback(text)}, false)"


def _module(name: str, text: str) -> None:
    needs = any(patterns.token(m)[0] in patterns.PACK for m in patterns.TOKEN.finditer(text))
    stages = PACK_SQL if needs else PACK_SQL[:1]

    @register(f"mod_{name}", S.query(S.BARS, S.staged("bars", *stages), select=f"SELECT symbol, ts, {_token_sql(text)} AS v FROM z"))
    def run(spark, sf_dir):
        bars = event_bars(spark, sf_dir)
        df = patterns.indicator_pack(bars) if needs else patterns.basic_features(bars)
        if needs:
            df = patterns.basic_features(df)
        return df.select("symbol", "ts", patterns.compile_tokens(text).alias("v"))


for _name, _text in patterns.MODULES.items():
    _module(_name, _text)

_EXPR = "(C[0] > C[1] OR V[0] > V[2] * 1.5) AND NOT Body%[0] > 0.02 AND H[0] - L[0] < C[3] * 0.05"


@register("tok_expr", S.query(S.BARS, S.staged("bars", PACK_SQL[0]), select=f"SELECT symbol, ts, {_token_sql(_EXPR)} AS v FROM z"))
def tok_expr(spark, sf_dir):
    return patterns.basic_features(event_bars(spark, sf_dir)).select("symbol", "ts", patterns.compile_tokens(_EXPR).alias("v"))


@register("tok_lookback", S.query(S.BARS, select=f"SELECT symbol, count(*) FILTER (WHERE rn >= 14) AS n FROM (SELECT symbol, row_number() OVER ({S.O}) - 1 AS rn FROM bars) GROUP BY 1"))
def tok_lookback(spark, sf_dir):
    at = event_bars(spark, sf_dir).withColumn("rn", F.row_number().over(order()) - 1)
    return at.groupBy("symbol").agg(F.count(F.when(F.col("rn") >= patterns.lookback("RSI[14][0] < 30"), 1)).alias("n"))


@register("sig_v1_warmup", S.query(S.BARS, S.staged("bars", PACK_SQL[0]), select=f"SELECT symbol, ts, ({_token_sql('C[0] > C[1]')}) AND rn >= 34 AS v FROM z"))
def sig_v1_warmup(spark, sf_dir):
    late = F.row_number().over(order()) - 1 >= 14 + 20
    return event_bars(spark, sf_dir).select("symbol", "ts", (patterns.compile_tokens("C[0] > C[1]") & late).alias("v"))


_MODS = ["momentum_up_2bar", "volume_spike_short", "close_near_high", "breakout_high_short"]
_M = [_token_sql(patterns.MODULES[m]) for m in _MODS]


@register(
    "chr_compose",
    S.query(
        S.BARS, S.staged("bars", PACK_SQL[0], {f"m{k}": m for k, m in enumerate(_M)}),
        select="SELECT symbol, ts, m0 AND m1 AND m2 AS a, m0 OR m1 OR m2 AS o, (m0 AND m1) OR (m0 AND m2) OR (m1 AND m2) AS k2, "
        "(m0 AND m1 AND m2) OR (m0 AND m1 AND m3) OR (m0 AND m2 AND m3) OR (m1 AND m2 AND m3) AS k3, m0 AND m1 AS two FROM z",
    ),
)
def chr_compose(spark, sf_dir):
    df = patterns.basic_features(event_bars(spark, sf_dir))
    df = df.select("symbol", "ts", *[patterns.compile_tokens(patterns.MODULES[m]).alias(f"m{k}") for k, m in enumerate(_MODS)])
    m = [F.col(f"m{k}") for k in range(4)]
    c = patterns.compose
    return df.select("symbol", "ts", c(m[:3], "AND").alias("a"), c(m[:3], "OR").alias("o"), c(m[:3], "2of3").alias("k2"), c(m, "3of4").alias("k3"), c(m[:2], "2of3").alias("two"))


@register("feat_basic", S.query(S.BARS, S.staged("bars", PACK_SQL[0]), select=f"SELECT symbol, ts, {S.rnd('body_pct')} AS body_pct, {S.rnd('range_pct')} AS range_pct, {S.rnd('close_pos')} AS close_pos FROM z"))
def feat_basic(spark, sf_dir):
    return patterns.basic_features(event_bars(spark, sf_dir)).select("symbol", "ts", *[rnd(c).alias(c) for c in ("body_pct", "range_pct", "close_pos")])


# predicates

@register("prd_registry", "SELECT * FROM (VALUES " + ", ".join(f"('{n}')" for n in sorted(P.PREDICATES)) + ") t(name)")
def prd_registry(spark, sf_dir):
    """The names that predicates are registered under; each builds a Column of bars."""
    bars = event_bars(spark, sf_dir)
    every = bars.select(*[build().alias(name) for name, build in P.PREDICATES.items()])
    return spark.createDataFrame([(c,) for c in every.columns], "name string")


_PRD_SQL = {
    **{f"prd_{x}": f"coalesce({S.lag(x, 1)}, 0.0)" for x in ("close", "open", "high", "low", "volume")},
    "prd_price_change_pct": f"coalesce((close - {S.lag('close', 3)})/nullif({S.lag('close', 3)}, 0), 0.0)",
    "prd_volume_change_pct": f"coalesce((volume - {S.lag('volume', 3)})/nullif({S.lag('volume', 3)}, 0), 0.0)",
    "prd_body_pct": "coalesce(abs(close - open)/nullif(open, 0), 0.0)",
    "prd_range_pct": "coalesce((high - low)/nullif(low, 0), 0.0)",
    "prd_close_pos": "coalesce((close - low)/nullif(high - low, 0), 0.5)",
    "prd_body_ratio": "coalesce(abs(close - open)/nullif(high - low, 0), 0.0)",
    "prd_price_vs_ma_pct": f"coalesce((close - {S.g('avg', 'close', 20)})/nullif({S.g('avg', 'close', 20)}, 0), 0.0)",
}


def _predicate(name: str, text: str) -> None:
    @register(name, S.query(S.BARS, select=f"SELECT symbol, ts, {S.rnd(text)} AS v FROM bars"))
    def run(spark, sf_dir):
        return event_bars(spark, sf_dir).select("symbol", "ts", rnd(P.PREDICATES[name]()).alias("v"))


for _name, _text in _PRD_SQL.items():
    _predicate(_name, _text)


@register(
    "prd_rsi",
    S.query(S.BARS, S.staged("bars", {"ch": f"close - {S.lag('close')}"}, {"up": "CASE WHEN ch > 0 THEN ch ELSE 0.0 END", "dn": "CASE WHEN ch < 0 THEN -ch ELSE 0.0 END"},
      {"v": f"coalesce(100 - 100/(1 + ({S.g('avg', 'up', 14)})/nullif({S.g('avg', 'dn', 14)}, 0)), 50.0)"}), select=f"SELECT symbol, ts, {S.rnd('v')} AS v FROM z"),
)
def prd_rsi(spark, sf_dir):
    df = event_bars(spark, sf_dir).withColumn("ch", F.col("close") - F.lag("close", 1).over(order()))
    df = df.withColumn("up", F.when(F.col("ch") > 0, F.col("ch")).otherwise(0.0)).withColumn("dn", F.when(F.col("ch") < 0, -F.col("ch")).otherwise(0.0))
    v = 100 - 100 / (1 + over(guarded(F.avg, "up", 14), guarded(F.avg, "dn", 14)))
    return df.select("symbol", "ts", rnd(F.coalesce(v, F.lit(50.0))).alias("v"))


@register("cmp_ops", S.query(S.BARS, select="SELECT symbol, ts, close > open AS gt, close >= open AS ge, close < open AS lt, close <= open AS le FROM bars"))
def cmp_ops(spark, sf_dir):
    c, o = F.col("close"), F.col("open")
    return event_bars(spark, sf_dir).select("symbol", "ts", *[P.compare(c, op, o).alias(n) for op, n in ((">", "gt"), (">=", "ge"), ("<", "lt"), ("<=", "le"))])


@register("lgc_and_or_not", S.query(S.BARS, select="SELECT symbol, ts, close > open AND volume > 1 AS a, close > open OR volume > 1 AS o, NOT close > open AS n FROM bars"))
def lgc_and_or_not(spark, sf_dir):
    a, b = P.compare(F.col("close"), ">", F.col("open")), P.compare(F.col("volume"), ">", F.lit(1.0))
    return event_bars(spark, sf_dir).select("symbol", "ts", P.logic("c0 AND c1", [a, b]).alias("a"), P.logic("c0 OR c1", [a, b]).alias("o"), P.logic("NOT c0", [a, b]).alias("n"))


_SMA = {"f": S.g("avg", "close", 5), "s": S.g("avg", "close", 20)}
for _name, _op in (("cond_gt", ">"), ("cond_lt", "<")):

    def _cond(spark, sf_dir, op=_op):
        df = add(event_bars(spark, sf_dir), {"f": ("SMA", ("close", 5)), "s": ("SMA", ("close", 20))})
        return df.select("symbol", "ts", P.compare(F.col("f"), op, F.col("s")).alias("v"))

    register(_name, S.query(S.BARS, S.staged("bars", _SMA), select=f"SELECT symbol, ts, coalesce(f {_op} s, false) AS v FROM z"))(_cond)

for _name, _a, _b in (("cond_crosses_above", ">", "<="), ("cond_crosses_below", "<", ">=")):

    def _cross(spark, sf_dir, above=_a == ">"):
        df = add(event_bars(spark, sf_dir), {"f": ("SMA", ("close", 5)), "s": ("SMA", ("close", 20))})
        return P.crosses(df, "f", "s", above, "v").select("symbol", "ts", "v")

    register(
        _name,
        S.query(S.BARS, S.staged("bars", _SMA, {"e": f"CASE WHEN f {_a} s AND {S.lag('f')} {_b} {S.lag('s')} THEN 1 ELSE 0 END"}, {"h": f"max(e) OVER {S.w(6)}"}), select=f"SELECT symbol, ts, h = 1 AND coalesce(f {_a} s, false) AS v FROM z"),
    )(_cross)

_C3 = {"c0": "close > open", "c1": "volume > 1", "c2": f"coalesce(close < {S.lag('close')}, false)"}


@register("lgc_expr", S.query(S.BARS, S.staged("bars", _C3), select="SELECT symbol, ts, (c0 AND c1) OR c2 AS a, c0 OR c1 AND c2 AS b, c0 AND (c1 OR c2) AS c FROM z"))
def lgc_expr(spark, sf_dir):
    cs = [P.compare(F.col("close"), ">", F.col("open")), P.compare(F.col("volume"), ">", F.lit(1.0)), P.compare(F.col("close"), "<", F.lag("close", 1).over(order()))]
    return event_bars(spark, sf_dir).select("symbol", "ts", P.logic("(c0 AND c1) OR c2", cs).alias("a"), P.logic("c0 OR c1 AND c2", cs).alias("b"), P.logic("c0 AND (c1 OR c2)", cs).alias("c"))


__all__ = ["atr_sma", "rnd", "rows", "with_sides"]
