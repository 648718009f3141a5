"""The numbers of a strategy as typed parameters: what an optimiser may move, how far, and the strategy rebuilt from a vector."""

from __future__ import annotations

import dataclasses

from barloom.functions.indicators import split_arguments
from barloom.plans.strategy import NUMBER, Condition, Strategy

# fixed values: an indicator's numeric arguments by place, and the bounds of each kind of parameter
PERIODS = {
    "RSI": {1: "period"}, "STOCH_K": {0: "period"}, "STOCH_D": {0: "period"}, "ADX": {0: "period"}, "MFI": {0: "period"}, "PCT_B": {0: "period", 1: "std_dev"},
    "MACD_NORM": {0: "fast", 1: "slow", 2: "signal"}, "PRICE_POS": {0: "period"}, "ROC": {0: "period"}, "VOL_RATIO": {0: "period"}, "BBWIDTH": {0: "period", 1: "std_dev"}, "ATR_PCT": {0: "period"},
}
BOUNDS = {"period": (2.0, 100.0), "std": (0.5, 5.0), "osc_threshold": (0.0, 100.0), "norm_threshold": (-5.0, 5.0), "tp": (0.5, 15.0), "sl": (0.2, 5.0), "trail": (0.5, 10.0)}
#: indicators from 0 to 100, with thresholds of that scale
OSCILLATORS = ("RSI", "STOCH_K", "STOCH_D", "ADX", "MFI", "BREAKOUT_UP", "BREAKOUT_DOWN", "SQUEEZE", "DIVERGENCE_BULL", "DIVERGENCE_BEAR")
#: how far a parameter may move from its value: a share of it, and at least so much
REACH = {"period": (0.6, 2.0), "std": (0.4, 0.3), "osc_threshold": (0.0, 25.0), "norm_threshold": (0.0, 2.0), "tp": (0.5, 0.3), "sl": (0.5, 0.3), "trail": (0.5, 0.3)}
EXITS = ("tp", "sl", "trail")


@dataclasses.dataclass(frozen=True)
class Parameter:
    name: str
    value: float
    kind: str
    low: float
    high: float


def _call(side: str) -> tuple[str, list[str]]:
    name, _, rest = side.partition("(")
    return name.strip().upper(), split_arguments(rest.rstrip().removesuffix(")")) if rest else []


def _made(name: str, value: float, kind: str) -> Parameter:
    return Parameter(name, value, kind, *BOUNDS[kind])


def _of_side(s: Condition, side: str, where: str) -> list[Parameter]:
    text, other = getattr(s, side), s.right if side == "left" else s.left
    if NUMBER.match(text):
        return [_made(f"{where}_{side}_threshold", float(text), "osc_threshold" if _call(other)[0] in OSCILLATORS else "norm_threshold")]
    name, arguments = _call(text)
    places = PERIODS.get(name, {})
    return [_made(f"{where}_{side}_{name}_{what}", float(arguments[k]), "std" if what == "std_dev" else "period") for k, what in places.items() if k < len(arguments) and NUMBER.match(arguments[k])]


def parameters(s: Strategy) -> list[Parameter]:
    """In order of conditions, left before right, then exits that are on (the stop always)."""
    out = [p for k, c in enumerate(s.conditions) for side in ("left", "right") for p in _of_side(c, side, f"c{k}")]
    return out + [_made(f"{e}_mult", getattr(s, e), e) for e in EXITS if e == "sl" or getattr(s, e) > 0]


def tighten(found: list[Parameter]) -> list[Parameter]:
    """Bounds around each value, within the bounds of its kind."""
    out = []
    for p in found:
        share, least = REACH[p.kind]
        reach = max(abs(p.value) * share, least)
        out.append(dataclasses.replace(p, low=max(p.low, p.value - reach), high=min(p.high, p.value + reach)))
    return out


def _number(p: Parameter, value: float) -> str:
    if p.kind == "period":
        return str(round(value))
    if p.kind.endswith("threshold") and abs(value) >= 10:
        return str(round(value))
    return f"{value:.1f}"


def rebuild(s: Strategy, found: list[Parameter], values: list[float]) -> Strategy:
    """The strategy with other numbers, each held within its bounds; structure, sources and timeframes stay."""
    new = {p.name: _number(p, min(max(v, p.low), p.high)) for p, v in zip(found, values, strict=True)}
    conditions = []
    for k, c in enumerate(s.conditions):
        sides = {}
        for side in ("left", "right"):
            text, where = getattr(c, side), f"c{k}_{side}"
            if NUMBER.match(text):
                sides[side] = new.get(f"{where}_threshold", text)
                continue
            name, arguments = _call(text)
            for at, what in PERIODS.get(name, {}).items():
                if at < len(arguments):
                    arguments[at] = new.get(f"{where}_{name}_{what}", arguments[at])
            sides[side] = f"{name}({', '.join(arguments)})" if arguments else text
        conditions.append(Condition(sides["left"], c.op, sides["right"]))
    exits = {e: float(new.get(f"{e}_mult", getattr(s, e))) for e in EXITS}
    return dataclasses.replace(s, conditions=tuple(conditions), **exits)
