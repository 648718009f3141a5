"""Boolean building blocks: comparisons, crossings, logic expressions, bar predicates and pattern tokens."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from barloom.functions.indicators import order, guarded, over, rows

PERSIST = 6  # bars that a crossing stays true, while its condition holds


def compare(left: Column, op: str, right: Column) -> Column:
    made = {">": left > right, ">=": left >= right, "<": left < right, "<=": left <= right}
    return F.coalesce(made[op], F.lit(False))


def cross_of(left: Column, right: Column, above: bool = True) -> Column:
    """The bar on which ``left`` comes to stand above (below) ``right``."""
    l1, r1 = F.lag(left, 1).over(order()), F.lag(right, 1).over(order())
    return F.coalesce((left > right) & (l1 <= r1) if above else (left < right) & (l1 >= r1), F.lit(False))


def cross_event(left: str, right: str, above: bool = True) -> Column:
    return cross_of(F.col(left), F.col(right), above)


def still_crossed(event: Column, left: Column, right: Column, above: bool, persist: int = PERSIST) -> Column:
    """Whether a crossing (``event`` is 1) lies within the last ``persist`` bars and still holds."""
    return (F.max(event).over(rows(persist)) == 1) & compare(left, ">" if above else "<", right)


def crosses(df: DataFrame, left: str, right: str, above: bool, name: str, persist: int = PERSIST) -> DataFrame:
    """Adds ``name``: a crossing within the last ``persist`` bars that still holds."""
    df = df.withColumn("_event", cross_event(left, right, above).cast("int"))
    return df.withColumn(name, still_crossed(F.col("_event"), F.col(left), F.col(right), above, persist)).drop("_event")


LOGIC = re.compile(r"\(|\)|\bAND\b|\bOR\b|\bNOT\b|c\d+", re.I)


def logic(text: str, conditions: list[Column]) -> Column:
    """A logic string over c0, c1, ...: NOT binds before AND before OR. Anything malformed raises ValueError."""
    tokens = LOGIC.findall(text)
    if "".join(tokens).replace(" ", "").lower() != re.sub(r"\s", "", text).lower():
        raise ValueError(f"not a logic expression: {text!r}")
    at = 0

    def peek() -> str:
        return tokens[at].upper() if at < len(tokens) else ""

    def take() -> str:
        nonlocal at
        if at == len(tokens):
            raise ValueError("the expression ends early")
        at += 1
        return tokens[at - 1].upper()

    def unit() -> Column:
        t = take()
        if t == "NOT":
            return ~unit()
        if t == "(":
            inner = either()
            if take() != ")":
                raise ValueError("a parenthesis is not closed")
            return inner
        if t[0] != "C" or int(t[1:]) >= len(conditions):
            raise ValueError(f"unknown condition {t}")
        return conditions[int(t[1:])]

    def both() -> Column:
        out = unit()
        while peek() == "AND":
            take()
            out = out & unit()
        return out

    def either() -> Column:
        out = both()
        while peek() == "OR":
            take()
            out = out | both()
        return out

    out = either()
    if at != len(tokens):
        raise ValueError(f"unexpected {tokens[at]!r}")
    return out


# predicates on a bar and its past; a value out of range is 0

def shifted(x: str, k: int = 0) -> Column:
    return F.coalesce(F.lag(x, k).over(order()) if k else F.col(x), F.lit(0.0))


def change_pct(x: str, k: int) -> Column:
    before = F.lag(x, k).over(order())
    return F.coalesce(over(F.col(x) - before, before), F.lit(0.0))


def _ratio(a: Column, b: Column, none: float = 0.0) -> Column:
    return F.coalesce(over(a, b), F.lit(none))


BODY, RANGE = F.abs, lambda: F.col("high") - F.col("low")

#: name to a builder of a Column; extend with :func:`register`
PREDICATES: dict[str, Callable[..., Column]] = {
    "prd_close": lambda k=1: shifted("close", k),
    "prd_open": lambda k=1: shifted("open", k),
    "prd_high": lambda k=1: shifted("high", k),
    "prd_low": lambda k=1: shifted("low", k),
    "prd_volume": lambda k=1: shifted("volume", k),
    "prd_price_change_pct": lambda k=3: change_pct("close", k),
    "prd_volume_change_pct": lambda k=3: change_pct("volume", k),
    "prd_body_pct": lambda: _ratio(F.abs(F.col("close") - F.col("open")), F.col("open")),
    "prd_range_pct": lambda: _ratio(RANGE(), F.col("low")),
    "prd_close_pos": lambda: _ratio(F.col("close") - F.col("low"), RANGE(), 0.5),
    "prd_body_ratio": lambda: _ratio(F.abs(F.col("close") - F.col("open")), RANGE()),
    "prd_price_vs_ma_pct": lambda n=20: F.coalesce(over(F.col("close") - guarded(F.avg, "close", n), guarded(F.avg, "close", n)), F.lit(0.0)),
}


def register(name: str, build: Callable[..., Column]) -> None:
    PREDICATES[name] = build
