"""SQL fragments for the oracles: the bar tables, rolling figures and exponential means."""

from __future__ import annotations


def bars(seconds: int = 3600, all_symbols: bool = False, name: str = "bars") -> str:
    symbol = "'ALL'" if all_symbols else "event_type"
    return f"""
ev AS (SELECT {symbol} AS symbol, epoch_us(ts) AS us, event_id, user_id, value FROM events),
wm AS (SELECT *, avg(value) OVER (PARTITION BY symbol) AS m FROM ev),
px AS (SELECT symbol, us, event_id, 100*exp(0.004*sum((value-m)/m) OVER (PARTITION BY symbol ORDER BY us, event_id)) AS px FROM wm),
{name} AS (SELECT symbol, us//1000000 - (us//1000000)%{seconds} AS ts, arg_min(px,(us,event_id)) AS open, max(px) AS high, min(px) AS low,
  arg_max(px,(us,event_id)) AS close, count(*)::DOUBLE AS volume FROM px GROUP BY 1,2)"""


BARS = bars()
SIDES = """
, side_mean AS (SELECT avg(value) AS m FROM ev),
funding AS (SELECT symbol, us//1000000 - (us//1000000)%28800 AS ts, (avg(value) - any_value(m))/1000 AS funding_rate FROM ev, side_mean GROUP BY 1,2),
sided AS (SELECT b.*, f.funding_rate, 1000 + sum(b.volume) OVER (PARTITION BY b.symbol ORDER BY b.ts) AS open_interest, 1 + (b.close-b.open)/b.open AS ls_ratio,
  (b.high-b.open+1)/(b.open-b.low+1) AS taker_buy_sell_ratio
  FROM bars b ASOF LEFT JOIN funding f ON b.symbol = f.symbol AND b.ts >= f.ts)"""

O = "PARTITION BY symbol ORDER BY ts"  # noqa: E741
ALL = f"({O} ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)"


def w(n: int) -> str:
    return f"({O} ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW)"


def g(agg: str, x: str, n: int, least: int | None = None) -> str:
    return f"CASE WHEN count({x}) OVER {w(n)} >= {n if least is None else least} THEN {agg}({x}) OVER {w(n)} END"


def lag(x: str, k: int = 1) -> str:
    return f"lag({x}, {k}) OVER ({O})"


def ewm(x: str, alpha: float, least: int = 0) -> str:
    return (
        f"CASE WHEN count({x}) OVER {ALL} >= {max(1, least)} THEN list_reduce(list_filter(list({x}) OVER {ALL}, lambda z: z IS NOT NULL), "
        f"lambda a, v: a + (v - a) * ({alpha!r})::DOUBLE) END"
    )


TR = f"greatest(high-low, abs(high - {lag('close')}), abs(low - {lag('close')}))"


def staged(source: str, *stages: dict[str, str]) -> str:
    """CTEs that add each stage's columns to the one before; the last is ``z``."""
    out, before = [], source
    for k, stage in enumerate(stages):
        name = f"z{k}" if k < len(stages) - 1 else "z"
        out.append(f"{name} AS (SELECT *, {', '.join(f'{e} AS {c}' for c, e in stage.items())} FROM {before})")
        before = name
    return ",\n".join(out)


def rnd(x: str, digits: int = 6) -> str:
    return f"round({x}, {digits}) + 0.0"


def query(*ctes: str, select: str) -> str:
    return "WITH " + ",\n".join(c.strip().strip(",") for c in ctes) + "\n" + select
