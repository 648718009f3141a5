"""Genomes to strategies by grammatical evolution."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame

# fixed values: the grammar of strategies. A rule's alternatives are told apart by "|"; codons choose among them.
# Repeated alternatives weigh twice.
GRAMMAR = """
<strategy> ::= <direction> WHEN <entry_rule> EXIT <exit_params>
<direction> ::= LONG | SHORT
<entry_rule> ::= <condition> | <condition> <logical_op> <condition> | <condition> <logical_op> <condition> <logical_op> <condition> | ( <condition> <logical_op> <condition> ) <logical_op> <condition>
<logical_op> ::= AND | OR
<condition> ::= <osc> <comparator> <osc> | <osc> <comparator> <osc_thresh> | <osc> <comparator> <osc> | <osc> <comparator> <osc_thresh> | <norm> <comparator> <norm> | <norm> <comparator> <norm_thresh> | <norm> <comparator> <norm> | <norm> <comparator> <norm_thresh> | <osc> CROSSES_ABOVE <osc> | <osc> CROSSES_BELOW <osc> | <norm> CROSSES_ABOVE <norm> | <norm> CROSSES_BELOW <norm> | <norm> CROSSES_ABOVE <norm_thresh> | <norm> CROSSES_BELOW <norm_thresh>
<osc> ::= RSI(<rsi_source>, <rsi_period>) | RSI(<rsi_source>, <rsi_period>, <timeframe>) | STOCH_K(<stoch_period>) | STOCH_K(<stoch_period>, <timeframe>) | STOCH_D(<stoch_period>) | STOCH_D(<stoch_period>, <timeframe>) | ADX(<adx_period>) | ADX(<adx_period>, <timeframe>) | MFI(<mfi_period>) | MFI(<mfi_period>, <timeframe>) | BREAKOUT_UP(<breakout_period>) | BREAKOUT_UP(<breakout_period>, <timeframe>) | BREAKOUT_DOWN(<breakout_period>) | BREAKOUT_DOWN(<breakout_period>, <timeframe>) | SQUEEZE(<bb_period>, <bb_std>) | SQUEEZE(<bb_period>, <bb_std>, <timeframe>) | DIVERGENCE_BULL(RSI, <rsi_period>, <div_period>) | DIVERGENCE_BEAR(RSI, <rsi_period>, <div_period>)
<norm> ::= PCT_B(<bb_period>, <bb_std>) | PCT_B(<bb_period>, <bb_std>, <timeframe>) | MACD_NORM(<macd_fast>, <macd_slow>, <macd_signal>) | MACD_NORM(<macd_fast>, <macd_slow>, <macd_signal>, <timeframe>) | PRICE_POS(<pos_period>) | PRICE_POS(<pos_period>, <timeframe>) | ROC(<roc_period>) | ROC(<roc_period>, <timeframe>) | VOL_RATIO(<vol_period>) | VOL_RATIO(<vol_period>, <timeframe>) | BBWIDTH(<bb_period>, <bb_std>) | BBWIDTH(<bb_period>, <bb_std>, <timeframe>) | ATR_PCT(<atr_period>) | ATR_PCT(<atr_period>, <timeframe>) | TRENDING(RSI, <rsi_period>, <trend_period>) | TRENDING(RSI, <rsi_period>, <trend_period>, <timeframe>) | TRENDING(MFI, <mfi_period>, <trend_period>) | TRENDING(STOCH_K, <stoch_period>, <trend_period>)
<timeframe> ::= 15m | 1h | 4h
<rsi_source> ::= close | open | high | low
<rsi_period> ::= 7 | 9 | 14 | 21
<stoch_period> ::= 5 | 9 | 14 | 21
<adx_period> ::= 7 | 10 | 14 | 21
<mfi_period> ::= 7 | 10 | 14 | 21
<bb_period> ::= 10 | 14 | 20 | 30
<bb_std> ::= 1.5 | 2.0 | 2.5 | 3.0
<macd_fast> ::= 8 | 12 | 16
<macd_slow> ::= 21 | 26 | 34
<macd_signal> ::= 5 | 9 | 13
<pos_period> ::= 5 | 8 | 13 | 21 | 34 | 55
<roc_period> ::= 3 | 5 | 8 | 13 | 21
<vol_period> ::= 5 | 10 | 20 | 50
<atr_period> ::= 7 | 10 | 14 | 21
<breakout_period> ::= 10 | 20 | 30 | 50
<div_period> ::= 10 | 14 | 20 | 30
<trend_period> ::= 5 | 8 | 13 | 21
<osc_thresh> ::= 10 | 20 | 30 | 40 | 50 | 60 | 70 | 80 | 90
<norm_thresh> ::= -2.0 | -1.5 | -1.0 | -0.5 | 0.0 | 0.5 | 1.0 | 1.5 | 2.0
<comparator> ::= _GT_ | _LT_
<exit_params> ::= TP=<tp_mult> SL=<sl_mult> | SL=<sl_mult> TRAIL=<trail_mult> | TP=<tp_mult> SL=<sl_mult> TRAIL=<trail_mult>
<tp_mult> ::= 1.5 | 2.0 | 2.5 | 3.0 | 4.0 | 5.0 | 6.0 | 8.0
<sl_mult> ::= 0.75 | 1.0 | 1.5 | 2.0 | 2.5
<trail_mult> ::= 1.0 | 1.5 | 2.0 | 2.5 | 3.0 | 4.0 | 5.0
"""
START, WRAPS = "<strategy>", 2
NAME = re.compile(r"<[^>]+>")


def rules_of(text: str) -> dict[str, list[str]]:
    """Rules of a grammar's text; raises ValueError if a rule is missing, empty or never used."""
    rules = {}
    for line in text.strip().splitlines():
        name, _, body = line.partition("::=")
        rules[name.strip()] = [x.strip() for x in body.split(" | ") if x.strip()]
    check(rules)
    return rules


def check(rules: dict[str, list[str]], start: str = START) -> None:
    """Every rule that is named exists, has alternatives and can be reached by name."""
    named = {start}
    for name, alternatives in rules.items():
        if not alternatives:
            raise ValueError(f"{name} has no alternative")
        for word in (w for a in alternatives for w in NAME.findall(a)):
            if word not in rules:
                raise ValueError(f"{name} names {word}, which doesn't exist")
            named.add(word)
    if unused := set(rules) - named:
        raise ValueError(f"never named: {sorted(unused)}")


RULES = rules_of(GRAMMAR)


def derive(genome: list[int], start: str = START, wraps: int = WRAPS) -> tuple[str, int] | None:
    """The text that codons choose, leftmost rule first, ``codon % alternatives``, and the number of codons read; a genome is read
    again from its start ``wraps`` times at most, else None. A rule with one alternative reads a codon as well."""
    done, left, used = [], [start], 0
    while left:
        part = left.pop()
        m = NAME.search(part)
        if m is None:
            done.append(part)
            continue
        if used >= len(genome) * (wraps + 1):
            return None
        options = RULES[m[0]]
        done.append(part[: m.start()])
        left += [part[m.end() :], options[genome[used % len(genome)] % len(options)]]
        used += 1
    return "".join(done), used


def decode(genome: list[int], start: str = START, wraps: int = WRAPS) -> str | None:
    found = derive(genome, start, wraps) if genome else None
    return found[0] if found else None


def decoded(genomes: DataFrame) -> DataFrame:
    """``id, expression, n_conditions, codons`` of rows ``id, genome``; a genome that doesn't end gives a NULL expression."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from barloom.plans.strategy import parse

        for batch in batches:
            found = [derive([int(c) for c in g]) if g is not None and len(g) else None for g in batch["genome"]]
            texts = [f[0] if f else None for f in found]
            sizes = [len(parse(t).conditions) if t else 0 for t in texts]
            yield pd.DataFrame({"id": batch["id"], "expression": texts, "n_conditions": sizes, "codons": [f[1] if f else 0 for f in found]})

    kind = genomes.schema["id"].dataType.simpleString()
    return genomes.select("id", "genome").mapInPandas(run, f"id {kind}, expression string, n_conditions bigint, codons bigint")
