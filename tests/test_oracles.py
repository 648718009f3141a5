"""Every query against its SQL; ``FEW_QUERIES=1`` runs one of each family."""

import os

import pytest

from barloom.queries import load

QUERIES, SQL = load()
CHOSEN = [
    "ind_rsi", "ind_adx", "ind_squeeze", "ind_trending", "ind_funding_zscore", "ind_v1_pack", "mod_macd_bullish_cross", "tok_expr", "chr_compose", "cond_crosses_above", "lgc_expr", "fix_ohlc",
    "rsm_align", "join_asof_backward", "join_nearest", "bt_single_window_trail", "bt_single_window_short", "bt_shuffled", "met_all", "rep_moments", "fit_objectives", "spl_cpcv_purge", "rg_sma",
    "sel_nds_ranks", "win_crowding", "st_spa", "st_white_rc", "st_cpcv_eval", "st_mc_trades", "str_closed_candle",
]
NAMES = CHOSEN if os.environ.get("FEW_QUERIES") else sorted(SQL)


@pytest.mark.parametrize("name", NAMES)
def test_query_agrees_with_sql(name, spark, sf_dir, duck, same):
    same(QUERIES[name](spark, sf_dir).toPandas(), duck.execute(SQL[name]).df())


def test_every_sql_has_a_query():
    assert set(SQL) <= set(QUERIES)
