"""Strategies and patterns in words, and figures as reports show them. Columns only: nothing here collects."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# fixed values: the words of a pattern's explanation
PREDICATES = {
    "close": "close price", "open": "open price", "high": "high price", "low": "low price", "volume": "volume", "price_change_pct": "price change", "body_pct": "candle body",
    "range_pct": "candle range", "volume_change_pct": "volume change", "close_position_in_range": "close position in range", "body_ratio": "body-to-range ratio", "rsi": "RSI",
    "price_vs_ma_pct": "price vs moving average",
}
OPERATORS = {">": "is greater than", ">=": "is at least", "<=": "is at most", "<": "is less than", "==": "equals"}

# fixed values: what a strategy's expression must hold for each remark; of a group only the first that holds is made
REMARKS: list[list[tuple[tuple[str, ...], str]]] = [
    [(("RSI", "_LT_ 20"), "Oversold RSI (<20) as entry filter"), (("RSI", "_GT_ 80"), "Overbought RSI (>80) as entry filter"), (("RSI", "_GT_ 50"), "Bullish RSI momentum (>50)"), (("RSI", "_LT_ 50"), "Bearish RSI momentum (<50)")],
    [(("MFI", "_GT_ 90"), "Very high money flow (>90) — strong buying pressure"), (("MFI", "_GT_ 70"), "High money flow — buying pressure"), (("MFI",), "Money flow index as momentum filter")],
    [(("ADX",), "ADX trend strength filter")],
    [(("STOCH_K", "CROSSES_ABOVE"), "Stochastic bullish crossover (momentum turning up)"), (("STOCH_K", "CROSSES_BELOW"), "Stochastic bearish crossover"), (("STOCH",), "Stochastic oscillator for momentum")],
    [(("BBWIDTH",), "Bollinger Band width — volatility expansion/squeeze")],
    [(("VOL_RATIO", "_GT_"), "Above-average volume confirmation"), (("VOL_RATIO",), "Volume ratio filter")],
    [(("ROC", "CROSSES_ABOVE"), "Rate of change crossover — momentum shift"), (("ROC",), "Rate of change for momentum")],
    [(("PCT_B",), "Bollinger %B position within bands")],
    [(("PRICE_POS",), "Price position relative to moving average")],
    [(("MACD_NORM",), "Normalized MACD for momentum")],
    [(("TRAIL",), "Uses trailing stop (rides trends)")],
]
SHORT_EXTREME = "CONTRARIAN: shorts after extreme oversold (expecting dead cat bounce failure)"
SHORT_FADE = "Fades upward momentum spikes (mean-reversion short)"
PLAIN = "Simple indicator comparison"

# fixed values: which figures are shares, and which have two digits
SHARES, TWO_DIGITS = ("cagr", "total_return", "max_dd"), ("profit_factor", "win_rate")
LATEX = [("\\", r"\textbackslash{}"), ("%", r"\%"), ("$", r"\$"), ("#", r"\#"), ("_", r"\_"), ("{", r"\{"), ("}", r"\}"), ("&", r"\&"), ("~", r"\textasciitilde{}"), ("^", r"\textasciicircum{}")]


def remarks(expression: Column, direction: Column) -> Column:
    """What an expression says, in words, joined by semicolons."""
    holds = lambda words: _every([expression.contains(w) for w in words])
    said = []
    for group in REMARKS:
        first = F.lit(None).cast("string")
        for words, text in reversed(group):
            first = F.when(holds(words), text).otherwise(first)
        said.append(first)
    extreme = holds(["RSI"]) & (expression.contains("_LT_ 20") | expression.contains("_LT_ 30"))
    said.append(F.when(direction == "SHORT", F.when(extreme, SHORT_EXTREME).when(holds(["ROC", "CROSSES_ABOVE"]), SHORT_FADE)))
    n = F.regexp_count(expression, F.lit(" AND | OR ")) + 1
    said.append(F.when(n >= 3, F.format_string("Multi-condition (%d filters) — highly selective", n)))
    out = F.concat_ws("; ", *said)
    return F.when(out == "", PLAIN).otherwise(out)


def _every(conditions: list[Column]) -> Column:
    out = conditions[0]
    for c in conditions[1:]:
        out = out & c
    return out


def _words(of: dict[str, str], x: Column) -> Column:
    table = F.create_map(*[F.lit(v) for pair in of.items() for v in pair])
    return F.coalesce(F.try_element_at(table, x), x)


def _back(k: Column, now: bool) -> Column:
    out = F.when(k == 1, "previous").when(k == 2, "2 bars ago").otherwise(F.concat(k.cast("string"), F.lit(" bars ago")))
    return F.when(k == 0, "current").otherwise(out) if now else out


def predicate(name: Column, operator: Column, offset: Column, other: Column, threshold: Column) -> Column:
    """A comparison of a predicate with itself ``other`` bars back, or with a threshold where ``other`` is null."""
    word = _words(PREDICATES, name)
    limit = (
        F.when(name.contains("pct") | name.contains("change"), F.format_string("%.2f%%", threshold * 100))
        .when(name.contains("ratio") | name.contains("position"), F.format_string("%.3f", threshold))
        .when(name.contains("rsi"), F.format_string("%.1f", threshold))
        .otherwise(F.format_string("%.2f", threshold))
    )
    right = F.when(other.isNotNull(), F.concat(word, F.lit(" ("), _back(other, False), F.lit(")"))).otherwise(limit)
    return F.concat(word, F.lit(" ("), _back(offset, True), F.lit(") "), _words(OPERATORS, operator), F.lit(" "), right)


def joined(parts: Column, operator: Column) -> Column:
    """Explanations under AND or OR: two in a line, more as a list."""
    head = F.when(operator == "AND", "ALL").otherwise("ANY")
    many = F.concat(head, F.lit(" of the following:\n  - "), F.array_join(parts, "\n  - "))
    return F.when(F.size(parts) == 1, parts[0]).when(F.size(parts) == 2, F.concat(parts[0], F.lit(" "), operator, F.lit(" "), parts[1])).otherwise(many)


def pattern(direction: Column, window: Column, fitness: Column, condition: Column) -> Column:
    """A whole pattern's explanation."""
    line = lambda c: F.lit(c * 60 + "\n")
    return F.concat(
        F.lit("Pattern Description\n"), line("="), F.lit("Direction: "), direction, F.lit("\nWindow: "), window.cast("string"), F.lit(" bars\nFitness: "), F.format_string("%.4f", fitness),
        F.lit("\n\nEntry Condition:\n"), line("-"), condition, F.lit("\n"), line("-"), F.lit("\nInterpretation:\nWhen this condition is met, the strategy opens a "), direction,
        F.lit(" position.\nThe pattern looks at the last "), window.cast("string"), F.lit(" bars to evaluate the condition.\n"),
    )


def latex(text: Column) -> Column:
    """Special characters escaped one after another, in the table's order."""
    for char, escaped in LATEX:
        text = F.replace(text, F.lit(char), F.lit(escaped))
    return text


def figure(name: Column, value: Column) -> Column:
    """A figure as a report shows it."""
    return F.when(name.isin(*SHARES), F.format_string("%.2f%%", value * 100)).when(name.isin(*TWO_DIGITS), F.format_string("%.2f", value)).otherwise(F.format_string("%.4f", value))
