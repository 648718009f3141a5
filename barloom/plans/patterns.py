"""Pattern modules: named boolean expressions over bar tokens, and their combination."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from barloom.functions.indicators import order, Stage, ewm_pass, guarded, over, rows

# The pattern modules and their expressions.
MODULES = {
    "momentum_up_2bar": "C[0] > C[1] AND C[1] > C[2]",
    "momentum_up_3bar": "C[0] > C[1] AND C[1] > C[2] AND C[2] > C[3]",
    "momentum_up_5bar": "C[0] > C[1] AND C[1] > C[2] AND C[2] > C[3] AND C[3] > C[4] AND C[4] > C[5]",
    "momentum_down_2bar": "C[0] < C[1] AND C[1] < C[2]",
    "momentum_down_3bar": "C[0] < C[1] AND C[1] < C[2] AND C[2] < C[3]",
    "momentum_down_5bar": "C[0] < C[1] AND C[1] < C[2] AND C[2] < C[3] AND C[3] < C[4] AND C[4] < C[5]",
    "volume_spike_short": "V[0] > V[3] AND V[0] > V[5]",
    "volume_spike_long": "V[0] > V[10] AND V[0] > V[15]",
    "volume_declining": "V[0] < V[1] AND V[1] < V[2] AND V[2] < V[3]",
    "volume_climax": "V[0] > V[1] * 2.0",
    "breakout_high_short": "H[0] > H[1] AND H[0] > H[2] AND H[0] > H[3]",
    "breakout_high_long": "H[0] >= H[5] AND H[0] >= H[10] AND H[0] >= H[15]",
    "breakout_low_short": "L[0] < L[1] AND L[0] < L[2] AND L[0] < L[3]",
    "breakout_low_long": "L[0] <= L[5] AND L[0] <= L[10] AND L[0] <= L[15]",
    "large_body": "Body%[0] > 0.012",
    "medium_body": "Body%[0] >= 0.006 AND Body%[0] <= 0.012",
    "small_body": "Body%[0] < 0.004",
    "gap_up": "L[0] > H[1]",
    "gap_down": "H[0] < L[1]",
    "volatility_high": "Range%[0] > 0.02",
    "volatility_low": "Range%[0] < 0.008",
    "volatility_expansion": "Range%[0] > Range%[1] AND Range%[1] > Range%[2]",
    "volatility_contraction": "Range%[0] < Range%[1] AND Range%[1] < Range%[2]",
    "close_near_high": "ClosePos[0] > 0.75",
    "close_near_low": "ClosePos[0] < 0.25",
    "close_middle": "ClosePos[0] >= 0.4 AND ClosePos[0] <= 0.6",
    "overbought_pullback_short": "C[0] > C[1] AND C[1] > C[2] AND RSI[14][0] > 65 AND C[0] < H[0] * 0.998",
    "exhaustion_top_short": "C[0] < O[0] AND Body%[0] > 0.008 AND H[0] > H[1] AND H[0] > H[2]",
    "failed_breakout_short": "H[0] > H[1] AND H[1] > H[2] AND C[0] < C[1] AND V[0] < V[1]",
    "volume_climax_short": "V[0] > SMA_V[20][0] * 2.0 AND C[0] < O[0] AND Range%[0] > 0.015",
    "rejection_from_resistance_short": "H[0] > SMA[20][0] AND C[0] < SMA[20][0] AND Body%[0] > 0.006",
    "momentum_down_strong": "C[0] < C[1] * 0.995 AND C[1] < C[2] * 0.995",
    "weak_bounce_short": "C[0] > C[1] AND C[1] < C[2] AND C[0] < C[2] AND V[0] < V[1]",
    "lower_highs_short": "H[0] < H[1] AND H[1] < H[2]",
    "rsi_oversold_30": "RSI[14][0] < 30",
    "rsi_oversold_40": "RSI[14][0] < 40",
    "rsi_overbought_60": "RSI[14][0] > 60",
    "rsi_overbought_70": "RSI[14][0] > 70",
    "rsi_rising": "RSI[14][0] > RSI[14][1] AND RSI[14][1] > RSI[14][2]",
    "rsi_falling": "RSI[14][0] < RSI[14][1] AND RSI[14][1] < RSI[14][2]",
    "price_above_sma20": "C[0] > SMA[20][0]",
    "price_below_sma20": "C[0] < SMA[20][0]",
    "price_above_sma50": "C[0] > SMA[50][0]",
    "price_below_sma50": "C[0] < SMA[50][0]",
    "volume_above_sma": "V[0] > SMA_V[20][0]",
    "macd_bullish_cross": "MACD[0] > Signal[0] AND MACD[1] <= Signal[1]",
    "macd_bearish_cross": "MACD[0] < Signal[0] AND MACD[1] >= Signal[1]",
    "macd_positive": "MACD[0] > 0",
    "macd_histogram_growing": "MACDHist[0] > MACDHist[1] AND MACDHist[1] > MACDHist[2]",
    "bb_lower_touch": "C[0] < BB_Lower[0] * 1.01",
    "bb_upper_touch": "C[0] > BB_Upper[0] * 0.99",
    "bb_squeeze": "BB_Width[0] < BB_Width_SMA[20][0] * 0.7",
    "bb_expansion": "BB_Width[0] > BB_Width_SMA[20][0] * 1.3",
    "atr_high": "ATR[14][0] > ATR_SMA[20][0] * 1.5",
    "atr_low": "ATR[14][0] < ATR_SMA[20][0] * 0.7",
    "atr_expanding": "ATR[14][0] > ATR[14][1] AND ATR[14][1] > ATR[14][2]",
    "stoch_oversold": "Stoch_K[0] < 20 AND Stoch_D[0] < 20",
    "stoch_overbought": "Stoch_K[0] > 80 AND Stoch_D[0] > 80",
    "stoch_cross_bull": "Stoch_K[0] > Stoch_D[0] AND Stoch_K[1] <= Stoch_D[1]",
}

#: token to the column it reads; a first bracket of two is the period
COLUMNS = {
    "C": "close", "O": "open", "H": "high", "L": "low", "V": "volume", "Body%": "body_pct", "Range%": "range_pct", "ClosePos": "close_pos", "RSI": "rsi_14", "SMA": "sma_{n}",
    "SMA_V": "sma_v_20", "MACD": "macd", "Signal": "macd_signal", "MACDHist": "macd_hist", "BB_Upper": "bb_upper", "BB_Lower": "bb_lower", "BB_Width": "bb_width",
    "BB_Width_SMA": "bb_width_sma_20", "ATR": "atr_14", "ATR_SMA": "atr_sma_20", "Stoch_K": "stoch_k", "Stoch_D": "stoch_d",
}
PACK = ["rsi_14", "sma_20", "sma_50", "sma_v_20", "macd", "macd_signal", "macd_hist", "bb_upper", "bb_lower", "bb_width", "bb_width_sma_20", "atr_14", "atr_sma_20", "stoch_k", "stoch_d"]
TOKEN = re.compile(r"([A-Za-z_]+%?)\[(\d+)\](?:\[(\d+)\])?")


def basic_features(df: DataFrame) -> DataFrame:
    """Body and range shares and the close's place in the range (0.5 where there is no range)."""
    span = F.col("high") - F.col("low")
    return (
        df.withColumn("body_pct", over(F.abs(F.col("close") - F.col("open")), F.col("open")))
        .withColumn("range_pct", over(span, F.col("low")))
        .withColumn("close_pos", F.coalesce(over(F.col("close") - F.col("low"), span), F.lit(0.5)))
    )


def indicator_pack(df: DataFrame) -> DataFrame:
    """The basic features and the fifteen indicator columns that tokens read; one window partitioning, two recursive passes."""
    s = Stage(basic_features(df))
    col = s.col
    of: dict[str, str] = {}
    change = col(F.col("close") - F.lag("close", 1).over(order()))
    gain = col(F.when(F.col(change) > 0, F.col(change)).otherwise(0.0))
    loss = col(F.when(F.col(change) < 0, -F.col(change)).otherwise(0.0))
    of["rsi_14"] = col(100 - 100 / (1 + over(guarded(F.avg, gain, 14), guarded(F.avg, loss, 14))))
    of["sma_20"], of["sma_50"] = col(guarded(F.avg, "close", 20)), col(guarded(F.avg, "close", 50))
    of["sma_v_20"] = col(guarded(F.avg, "volume", 20))
    sd = col(guarded(F.stddev_samp, "close", 20))
    of["bb_upper"], of["bb_lower"] = col(F.col(of["sma_20"]) + 2 * F.col(sd)), col(F.col(of["sma_20"]) - 2 * F.col(sd))
    of["bb_width"] = col(F.col(of["bb_upper"]) - F.col(of["bb_lower"]))
    of["bb_width_sma_20"] = col(guarded(F.avg, of["bb_width"], 20))
    before = F.lag("close", 1).over(order())
    tr = col(F.greatest(F.col("high") - F.col("low"), F.abs(F.col("high") - before), F.abs(F.col("low") - before)))
    of["atr_14"] = col(guarded(F.avg, tr, 14))
    of["atr_sma_20"] = col(guarded(F.avg, of["atr_14"], 20))
    low, high = col(guarded(F.min, "low", 14)), col(guarded(F.max, "high", 14))
    fast = col(100 * over(F.col("close") - F.col(low), F.col(high) - F.col(low)))
    of["stoch_k"] = col(guarded(F.avg, fast, 3))
    of["stoch_d"] = col(guarded(F.avg, of["stoch_k"], 3))
    short, long, signal = s.name(), s.name(), s.name()
    s.df = ewm_pass(s.flush(), [("close", 2 / 13, 0, short), ("close", 2 / 27, 0, long)])
    of["macd"] = col(F.col(short) - F.col(long))
    s.df = ewm_pass(s.flush(), [(of["macd"], 2 / 10, 0, signal)])
    of["macd_signal"], of["macd_hist"] = signal, col(F.col(of["macd"]) - F.col(signal))
    return s.flush().select(*s.keep, *[F.col(of[n]).alias(n) for n in PACK])


def token(m: re.Match) -> tuple[str, int]:
    """(column, bars back) of a token."""
    if m[1] not in COLUMNS:
        raise ValueError(f"unknown token {m[0]!r}")
    return COLUMNS[m[1]].format(n=m[2]), int(m[3] if m[3] is not None else m[2])


def lookback(text: str) -> int:
    """The largest bracketed number, periods included: rows before it give false."""
    return max((int(x) for m in TOKEN.finditer(text) for x in m.groups()[1:] if x is not None), default=0)


def compile_tokens(text: str) -> Column:
    """A boolean Column, never NULL; any missing operand and any row before the lookback gives false."""
    names: dict[str, Column] = {}
    shape = TOKEN.sub(lambda m: names.setdefault(m[0], None) or f"§{list(names).index(m[0])}§", text)
    if not re.fullmatch(r"(?:§\d+§|\d+(?:\.\d+)?|[<>]=?|[()*+\-/]|AND|OR|NOT|\s)+", shape):
        raise ValueError(f"not a token expression: {text!r}")
    columns = [F.lag(c, k).over(order()) if k else F.col(c) for c, k in (token(TOKEN.fullmatch(t)) for t in names)]
    tokens = re.findall(r"§\d+§|\d+(?:\.\d+)?|[<>]=?|[()*+\-/]|AND|OR|NOT", shape)
    value = _Parser(tokens, columns).either()
    known = None
    for c in columns:
        known = c.isNotNull() if known is None else known & c.isNotNull()
    far = F.row_number().over(order()) - 1 >= lookback(text)
    return F.coalesce(value & far & (known if known is not None else F.lit(True)), F.lit(False))


class _Parser:
    """Precedence climbing over the token list: OR, AND, NOT, comparison, sums, products."""

    def __init__(self, tokens: list[str], columns: list[Column]):
        self.tokens, self.columns, self.at = tokens, columns, 0

    def next(self, *wanted: str) -> str | None:
        if self.at < len(self.tokens) and self.tokens[self.at] in wanted:
            self.at += 1
            return self.tokens[self.at - 1]
        return None

    def either(self) -> Column:
        out = self.both()
        while self.next("OR"):
            out = out | self.both()
        return out

    def both(self) -> Column:
        out = self.negated()
        while self.next("AND"):
            out = out & self.negated()
        return out

    def negated(self) -> Column:
        return ~self.negated() if self.next("NOT") else self.compared()

    def compared(self) -> Column:
        left = self.summed()
        op = self.next(">", ">=", "<", "<=")
        if not op:
            return left
        right = self.summed()
        return {">": left > right, ">=": left >= right, "<": left < right, "<=": left <= right}[op]

    def summed(self) -> Column:
        out = self.product()
        while op := self.next("+", "-"):
            out = out + self.product() if op == "+" else out - self.product()
        return out

    def product(self) -> Column:
        out = self.unit()
        while op := self.next("*", "/"):
            out = out * self.unit() if op == "*" else over(out, self.unit())
        return out

    def unit(self) -> Column:
        if self.next("("):
            out = self.either()
            if not self.next(")"):
                raise ValueError("a parenthesis is not closed")
            return out
        t = self.tokens[self.at]
        self.at += 1
        return self.columns[int(t[1:-1])] if t[0] == "§" else F.lit(float(t))


def compose(modules: list[Column], how: str) -> Column:
    """AND, OR, or k of n (``2of3``, ``3of4``); with fewer than k modules all must hold."""
    if not modules:
        return F.lit(False)
    total = sum((m.cast("int") for m in modules[1:]), modules[0].cast("int"))
    need = {"AND": len(modules), "OR": 1, "2of3": min(2, len(modules)), "3of4": min(3, len(modules))}
    if how not in need:
        raise ValueError(f"unknown combination {how!r}")
    return total >= need[how]


__all__ = ["MODULES", "PACK", "basic_features", "compile_tokens", "compose", "indicator_pack", "lookback", "rows"]
