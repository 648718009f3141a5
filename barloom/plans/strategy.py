"""The strategy language: ``LONG WHEN <conditions> EXIT TP=3.0 SL=1.5 TRAIL=2.0`` compiled to one boolean column.

Conditions are ``left _OP_ right`` atoms joined by AND, OR and parentheses; sides are numbers, bar columns or
indicator calls, the latter with an optional timeframe. All calls of all strategies are collected first, so equal
calls are computed once, and each timeframe is resampled once.
"""

from __future__ import annotations

import dataclasses
import re

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from barloom.functions.indicators import add, parse_call
from barloom.functions.predicates import PERSIST, compare, cross_of, logic, still_crossed
from barloom.sources.bars import TIMEFRAMES, align, bucket, resample

OPERATORS = {"_GT_": ">", "_LT_": "<", "_CA_": "above", "_CB_": "below", "CROSSES_ABOVE": "above", "CROSSES_BELOW": "below", ">": ">", "<": "<"}
NUMBER = re.compile(r"-?\d+(\.\d+)?$")


@dataclasses.dataclass(frozen=True)
class Condition:
    left: str
    op: str
    right: str


@dataclasses.dataclass(frozen=True)
class Strategy:
    direction: str
    conditions: tuple[Condition, ...]
    logic: str
    tp: float = 0.0
    sl: float = 0.0
    trail: float = 0.0

    @property
    def expression(self) -> str:
        text = re.sub(r"c(\d+)", lambda m: "{0.left} {0.op} {0.right}".format(self.conditions[int(m[1])]), self.logic)
        exits = " ".join(f"{k}={v:g}" for k, v in (("TP", self.tp), ("SL", self.sl), ("TRAIL", self.trail)) if v)
        return f"{self.direction} WHEN {text} EXIT {exits}"


ATOM = re.compile(r"\s*(.+?)\s+(_GT_|_LT_|_CA_|_CB_|CROSSES_ABOVE|CROSSES_BELOW|>|<)\s+(.+?)\s*$", re.S)


def parse(text: str) -> Strategy:
    """Raises ValueError for text outside the language."""
    m = re.match(r"\s*(LONG|SHORT)\s+WHEN\s+(.*?)\s+EXIT\s+(.*)$", text, re.S)
    if not m:
        raise ValueError(f"not a strategy: {text!r}")
    exits = {k: float(v) for k, v in re.findall(r"\b(TP|SL|TRAIL)\s*=\s*(\d+(?:\.\d+)?)", m[3])}
    conditions: list[Condition] = []
    shape, atom, depth = [], "", 0

    def close() -> None:
        nonlocal atom
        if atom.strip():
            a = ATOM.match(atom)
            if not a:
                raise ValueError(f"not a condition: {atom!r}")
            c = Condition(a[1], a[2], a[3])
            if c not in conditions:
                conditions.append(c)
            shape.append(f"c{conditions.index(c)}")
        atom = ""

    for token in re.findall(r"\bAND\b|\bOR\b|\(|\)|[^()\s]+|\s+", m[2]):
        if depth == 0 and token in ("AND", "OR"):
            close()
            shape.append(token)
        elif token == "(" and depth == 0 and not atom.strip():
            shape.append("(")
        elif token == "(":
            depth += 1
            atom += token
        elif token == ")" and depth:
            depth -= 1
            atom += token
        elif token == ")":
            close()
            shape.append(")")
        else:
            atom += token
    close()
    return Strategy(m[1], tuple(conditions), " ".join(shape).replace("( ", "(").replace(" )", ")"), exits.get("TP", 0.0), exits.get("SL", 0.0), exits.get("TRAIL", 0.0))


def _tree(text: str) -> tuple:
    """A logic string as nested tuples (operator, parts...), or a condition's number."""
    tokens = re.findall(r"\(|\)|AND|OR|c\d+", text)

    def unit(at: int) -> tuple:
        if tokens[at] == "(":
            inner, at = chain(at + 1, "OR")
            return inner, at + 1
        return int(tokens[at][1:]), at + 1

    def chain(at: int, op: str) -> tuple:
        below = unit if op == "AND" else lambda k: chain(k, "AND")
        first, at = below(at)
        parts = [first]
        while at < len(tokens) and tokens[at] == op:
            part, at = below(at + 1)
            parts.append(part)
        return (parts[0] if len(parts) == 1 else (op, *parts)), at

    return chain(0, "OR")[0]


def simplify(s: Strategy) -> Strategy:
    """Without conditions that compare a side with itself and without repeats under one operator; conditions are numbered anew in
    order of use. A strategy that would lose all its conditions stays as it is."""

    def lean(node) -> object:
        if isinstance(node, int):
            return None if s.conditions[node].left == s.conditions[node].right else node
        parts: list = []
        for part in map(lean, node[1:]):
            for x in part[1:] if isinstance(part, tuple) and part[0] == node[0] else [part]:
                if x is not None and x not in parts:
                    parts.append(x)
        return None if not parts else parts[0] if len(parts) == 1 else (node[0], *parts)

    used: list[int] = []

    def text(node, above: str = "") -> str:
        if isinstance(node, int):
            if node not in used:
                used.append(node)
            return f"c{used.index(node)}"
        said = f" {node[0]} ".join(text(x, node[0]) for x in node[1:])
        return f"({said})" if above else said

    tree = lean(_tree(s.logic))
    if tree is None:
        return s
    logic_ = text(tree)
    return dataclasses.replace(s, conditions=tuple(s.conditions[k] for k in used), logic=logic_)


def _sides(strategies: dict[str, Strategy]) -> list[str]:
    return list(dict.fromkeys(side for s in strategies.values() for c in s.conditions for side in (c.left, c.right)))


def calls(strategies: dict[str, Strategy], columns: list[str], base_seconds: int) -> tuple[dict[str, str | float], dict[str, tuple[str, tuple, int | None]]]:
    """What each side of a condition is, a column or a number, and the distinct indicator calls by column: name, arguments, and the
    timeframe's seconds if it is longer than the bars'."""
    sides: dict[str, str | float] = {}
    known: dict[tuple, str] = {}
    for side in _sides(strategies):
        if NUMBER.match(side):
            sides[side] = float(side)
        elif side.lower() in columns:
            sides[side] = side.lower()
        else:
            name, args, frame = parse_call(side)
            seconds = TIMEFRAMES[frame] if frame and TIMEFRAMES[frame] > base_seconds else None
            sides[side] = known.setdefault((name, args, seconds), f"_i{len(known)}")
    return sides, {column: key for key, column in known.items()}


def indicator_columns(bars: DataFrame, strategies: dict[str, Strategy], base_seconds: int, extra: dict | None = None) -> tuple[DataFrame, dict[str, str | float]]:
    """``bars`` with a column for each ``extra`` call and each distinct indicator of the strategies, and what each side of a condition is: a column or a number."""
    sides, wanted = calls(strategies, bars.columns, base_seconds)
    by_frame: dict[int | None, dict[str, tuple]] = {}
    for column, (name, args, seconds) in wanted.items():
        by_frame.setdefault(seconds, {})[column] = (name, args)
    base = dict(extra or {}) | by_frame.pop(None, {})
    df = add(bars, base) if base else bars
    for seconds, asked in sorted(by_frame.items()):
        higher = add(resample(bars, seconds), asked)
        df = align(df, higher, seconds, list(asked))
    return df, sides


def with_signals(bars: DataFrame, strategies: dict[str, Strategy], base_seconds: int, extra: dict | None = None) -> DataFrame:
    """``bars`` with a boolean column for each strategy, never NULL, and a column for each ``extra`` indicator call.

    Equal conditions are computed once; all comparisons, crossings and strategies take one projection each.
    """
    df, sides = indicator_columns(bars, strategies, base_seconds, extra)
    side = lambda x: F.col(sides[x]) if isinstance(sides[x], str) else F.lit(sides[x])
    distinct = {c: f"_c{k}" for k, c in enumerate(dict.fromkeys(c for s in strategies.values() for c in s.conditions))}
    plain = {n: compare(side(c.left), OPERATORS[c.op], side(c.right)) for c, n in distinct.items() if OPERATORS[c.op] in (">", "<")}
    turns = {n: (side(c.left), side(c.right), OPERATORS[c.op] == "above") for c, n in distinct.items() if n not in plain}
    keep = df.columns
    if turns:
        df = df.select(*keep, *[cross_of(a, b, up).cast("int").alias(f"{n}_event") for n, (a, b, up) in turns.items()])
        plain |= {n: still_crossed(F.col(f"{n}_event"), a, b, up) for n, (a, b, up) in turns.items()}
    df = df.select(*keep, *[e.alias(n) for n, e in plain.items()])
    made = {name: logic(s.logic, [F.col(distinct[c]) for c in s.conditions]) for name, s in strategies.items()}
    return df.select(*bars.columns, *[F.col(n) for n in extra or {}], *[e.alias(n) for n, e in made.items()])


def array_signals(strategies: dict[str, Strategy], sides: dict[str, str | float], column):
    """A function from a strategy's name to its signals on one ordered series; ``column`` gives a column's array, with NaN for NULL."""
    arrays: dict[str, np.ndarray | float] = {}
    conditions: dict[Condition, np.ndarray] = {}

    def side(text: str) -> np.ndarray | float:
        of = sides[text]
        if not isinstance(of, str):
            return of
        if of not in arrays:
            arrays[of] = column(of)
        return arrays[of]

    def holds(c: Condition) -> np.ndarray:
        if c not in conditions:
            a, b = np.broadcast_arrays(np.atleast_1d(side(c.left)), np.atleast_1d(side(c.right)))
            with np.errstate(invalid="ignore"):
                op = OPERATORS[c.op]
                now = a > b if op in (">", "above") else a < b
                if op in ("above", "below"):
                    event = np.zeros(len(a), bool)
                    event[1:] = now[1:] & (a[:-1] <= b[:-1] if op == "above" else a[:-1] >= b[:-1])
                    recent = np.cumsum(event)
                    recent[PERSIST:] -= recent[:-PERSIST].copy()
                    now = now & (recent > 0)
            conditions[c] = now
        return conditions[c]

    return lambda name: logic(strategies[name].logic, [holds(c) for c in strategies[name].conditions])


#: eight strategies that cover comparison, both crossings, logic, timeframes, exits and directions
SMALL = {
    "s1": "LONG WHEN STOCH_K(14) _LT_ 20 AND VOL_RATIO(10) _GT_ 1.0 EXIT TP=3.0 SL=1.5",
    "s2": "SHORT WHEN STOCH_K(14) _GT_ 80 EXIT TP=3.0 SL=1.5",
    "s3": "LONG WHEN ROC(5) _GT_ 1.0 OR ROC(10) _LT_ -2.0 EXIT TP=2.0 SL=2.0 TRAIL=2.0",
    "s4": "LONG WHEN SMA(close,5) _CA_ SMA(close,20) EXIT SL=1.5 TRAIL=2.5",
    "s5": "SHORT WHEN SMA(close,5) _CB_ SMA(close,20) EXIT TP=4.0 SL=2.0",
    "s6": "LONG WHEN (STOCH_K(14) _LT_ 30 AND ROC(3) _GT_ 0) OR PCT_B(20,2.0) _LT_ 5 EXIT TP=3.0 SL=1.5 TRAIL=2.0",
    "s7": "LONG WHEN ROC(3,4h) _GT_ 0 AND STOCH_K(14) _LT_ 40 EXIT TP=2.5 SL=1.5",
    "s8": "SHORT WHEN STOCH_D(14) _GT_ 70 AND ROC(6) _LT_ 0 EXIT TP=3.0 SL=1.5 TRAIL=1.5",
}


def small_strategies() -> dict[str, Strategy]:
    return {k: parse(v) for k, v in SMALL.items()}


__all__ = ["Condition", "Strategy", "parse", "simplify", "indicator_columns", "array_signals", "with_signals", "small_strategies", "SMALL", "bucket"]
