"""Selection queries over one population: a strategy is a (user, event type) pair, scored from its events."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from barloom.operators import selection as X
from barloom.queries import register
from barloom.queries import sql as S
from barloom.queries.indicators import rnd
from barloom.queries.metrics import _CORR, RET, corr_rows, curve
from barloom.operators import metrics as M
from barloom.sources import bars as B

POP = """pop AS (SELECT row_number() OVER (ORDER BY user_id, event_type) - 1 AS id, user_id, event_type AS direction, count(*) AS n, avg(value) AS f1, max(value) AS f2, min(value) AS f3,
  list_sort(list_distinct(list(CAST(props->>'$.k' AS BIGINT) % 5))) AS modules FROM events GROUP BY user_id, event_type),
p AS (SELECT *, round(f1, 6) AS o1, round(f2, 6) AS o2, CASE WHEN n < 3 THEN 3 - n ELSE 0 END AS viol FROM pop)"""


def population(spark, sf_dir):
    k = F.pmod(F.get_json_object("props", "$.k").cast("bigint"), F.lit(5))
    ev = B.table(spark, sf_dir, "events")
    pop = ev.groupBy("user_id", F.col("event_type").alias("direction")).agg(F.count("*").alias("n"), F.avg("value").alias("f1"), F.max("value").alias("f2"), F.min("value").alias("f3"), F.array_sort(F.collect_set(k)).alias("modules"))
    pop = pop.withColumn("id", (F.row_number().over(W.orderBy("user_id", "direction")) - 1).cast("bigint"))
    return pop.withColumn("o1", F.round("f1", 6)).withColumn("o2", F.round("f2", 6)).withColumn("viol", F.when(F.col("n") < 3, 3 - F.col("n")).otherwise(0))


def q(select: str, *ctes: str) -> str:
    return S.query(POP, *ctes, select=select)


def _sel(name: str, sql: str, build, *ctes: str) -> None:
    @register(name, q(sql, *ctes) if sql else None)
    def run(spark, sf_dir):
        return build(population(spark, sf_dir))


_DOM = "b.o1 >= a.o1 AND b.o2 >= a.o2 AND (b.o1 > a.o1 OR b.o2 > a.o2)"
_sel("join_theta_dominance", f"SELECT a.id, count(*) AS n FROM p a JOIN p b ON {_DOM} AND a.id <> b.id GROUP BY 1", lambda d: X.dominators(d, ["o1", "o2"]))
_sel("sel_pareto_front", f"SELECT id FROM p a WHERE NOT EXISTS (SELECT 1 FROM p b WHERE {_DOM} AND a.id <> b.id)", lambda d: X.pareto_front(d, ["o1", "o2"]).select("id"))
_CDOM = f"CASE WHEN a.viol > 0 OR b.viol > 0 THEN b.viol < a.viol ELSE {_DOM} END"
_RANKS = f"""pairs AS (SELECT a.id, b.id AS "by" FROM p a JOIN p b ON a.id <> b.id AND {_CDOM}),
chain AS (SELECT id, 0::BIGINT AS rank FROM p UNION SELECT pairs.id, chain.rank + 1 FROM chain JOIN pairs ON pairs."by" = chain.id),
rk AS (SELECT id, max(rank) AS rank FROM chain GROUP BY 1)"""


def ranked(d):
    from barloom.sources.cache import shared_folder

    shared_folder(d.sparkSession)
    return X.front_ranks(d.select("id", "o1", "o2", "viol"), ["o1", "o2"], "viol")


@register("sel_nds_ranks", q("SELECT id, rank FROM rk", _RANKS).replace("WITH ", "WITH RECURSIVE ", 1))
def sel_nds_ranks(spark, sf_dir):
    return ranked(population(spark, sf_dir)).select("id", "rank")


_CW = ", ".join(f"coalesce(CASE WHEN max({c}) OVER (PARTITION BY rank) > min({c}) OVER (PARTITION BY rank) THEN (lead({c}) OVER (PARTITION BY rank ORDER BY {c}, id) - lag({c}) OVER (PARTITION BY rank ORDER BY {c}, id))/(max({c}) OVER (PARTITION BY rank) - min({c}) OVER (PARTITION BY rank)) WHEN lead({c}) OVER (PARTITION BY rank ORDER BY {c}, id) IS NOT NULL AND lag({c}) OVER (PARTITION BY rank ORDER BY {c}, id) IS NOT NULL THEN 0.0 END, 999999.0) AS c_{c}" for c in ("o1", "o2"))


@register("win_crowding", q(f"SELECT id, {S.rnd('least(CASE WHEN cnt <= 2 THEN 999999.0 ELSE c_o1 + c_o2 END, 999999.0)')} AS v FROM (SELECT id, count(*) OVER (PARTITION BY rank) AS cnt, {_CW} FROM p JOIN rk USING (id))", _RANKS).replace("WITH ", "WITH RECURSIVE ", 1))
def win_crowding(spark, sf_dir):
    out = X.crowding(ranked(population(spark, sf_dir)), ["o1", "o2"])
    return out.select("id", rnd(F.least("crowding", F.lit(999999.0))).alias("v"))


def _hash(text: str) -> str:
    return f"('0x' || substr(md5({text}), 1, 8))::BIGINT"


def _tournament(k: int, by: str) -> str:
    return (
        f"SELECT round, arg_min(id, ({by}, id)) AS id FROM (SELECT r.i AS round, ({_hash(chr(39) + '9:' + chr(39) + ' || r.i || ' + chr(39) + ':' + chr(39) + ' || j.i')}) % (SELECT count(*) FROM p) AS pick "
        f"FROM range(50) r(i), range({k}) j(i)) d JOIN p ON p.id = d.pick GROUP BY 1"
    )


_CROWD = f"cw AS (SELECT p.*, rank, -least(CASE WHEN cnt <= 2 THEN 999999.0 ELSE c_o1 + c_o2 END, 999999.0) AS far FROM (SELECT id, rank, count(*) OVER (PARTITION BY rank) AS cnt, {_CW} FROM p JOIN rk USING (id)) JOIN p USING (id))"


@register("sel_tournament_bin", q(_tournament(2, "rank, round(far, 6)").replace("JOIN p ON p.id", "JOIN cw p ON p.id"), _RANKS, _CROWD).replace("WITH ", "WITH RECURSIVE ", 1))
def sel_tournament_bin(spark, sf_dir):
    """Of two drawn members the one of the lower front, then the less crowded one."""
    d = X.crowding(ranked(population(spark, sf_dir)), ["o1", "o2"])
    return X.tournament(d.withColumn("far", -F.round(F.least("crowding", F.lit(999999.0)), 6)), 50, 2, ["rank", "far"], 9)


_sel("sel_tournament_k", _tournament(5, "-o1"), lambda d: X.tournament(d.withColumn("neg", -F.col("o1")), 50, 5, ["neg"], 9))
CRITERIA = X.shuffled_names(["f1", "f2", "f3", "n"], 17)


def _lexicase_sql() -> list[str]:
    out, before = [], "p"
    for k, c in enumerate(CRITERIA):
        out.append(f"l{k} AS (SELECT * FROM {before} WHERE {c} >= (SELECT list_sort(list({c}))[count({c})//2 + 1] FROM {before}))")
        before = f"l{k}"
    return out


_sel("sel_lexicase", f"SELECT id FROM l{len(CRITERIA) - 1}", lambda d: X.lexicase(d, CRITERIA).select("id"), *_lexicase_sql())
_sel("sel_topk", "SELECT id FROM p ORDER BY f1 DESC, id LIMIT 25", lambda d: d.orderBy(F.desc("f1"), "id").limit(25).select("id"))
_sel("sel_dedup_key", "SELECT id FROM (SELECT *, row_number() OVER (PARTITION BY direction, modules ORDER BY f1 DESC, id) AS rn FROM p) WHERE rn = 1", lambda d: X.best_by(d, ["direction", "modules"], [F.desc("f1"), F.col("id")]).select("id"))
_sel("sel_dedup_modules", "SELECT modules::VARCHAR AS m, arg_max(id, (f1, -id)) AS id FROM p GROUP BY 1", lambda d: X.best_by(d, ["modules"], [F.desc("f1"), F.col("id")]).select(F.concat(F.lit("["), F.array_join(F.col("modules").cast("array<string>"), ", "), F.lit("]")).alias("m"), "id"))
_sel("sel_combo_best", "SELECT id FROM (SELECT *, row_number() OVER (PARTITION BY user_id % 5, direction ORDER BY f1 DESC, id) AS rn FROM p) WHERE rn = 1", lambda d: X.best_by(d.withColumn("s", F.col("user_id") % 5), ["s", "direction"], [F.desc("f1"), F.col("id")]).select("id"))
_sel("sel_phenotype_cap", "SELECT id FROM (SELECT *, row_number() OVER (PARTITION BY modules ORDER BY f1 DESC, id) AS rn FROM p) WHERE rn <= 2", lambda d: X.best_by(d, ["modules"], [F.desc("f1"), F.col("id")], 2).select("id"))
_sel("sel_filter_quality", "SELECT id FROM p WHERE n >= 2 AND f1 > 30 AND f2 > 60 AND f3 < 60 AND viol <= 1 AND o1 < 90 AND o2 < 400 AND f3 > 0", lambda d: d.where("n >= 2 and f1 > 30 and f2 > 60 and f3 < 60 and viol <= 1 and o1 < 90 and o2 < 400 and f3 > 0").select("id"))
_CELL = "cell AS (SELECT id, f1 AS objective, least(n//2, 2) AS freq, least(len(modules)//2, 2) AS complexity, direction AS regime FROM p), arch AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY freq, complexity, regime ORDER BY objective DESC, id) AS rn FROM cell) WHERE rn = 1)"


def archive(d):
    return X.archive_cells(d.selectExpr("id", "f1 as objective", "least(n div 2, 2) as freq", "least(size(modules) div 2, 2) as complexity", "direction as regime"))


_sel("sel_mapelites", "SELECT id, freq, complexity, regime FROM arch", lambda d: archive(d).selectExpr("id", "freq", "cast(complexity as bigint) as complexity", "regime"), _CELL)
_sel("sel_archive_summary", "SELECT count(*) AS cells, round(count(*)/45.0::DOUBLE, 6) AS coverage, round(max(objective), 6) AS top, round(avg(objective), 6) AS mean FROM arch", lambda d: archive(d).agg(F.count("*").alias("cells"), F.round(F.count("*") / 45.0, 6).alias("coverage"), F.round(F.max("objective"), 6).alias("top"), F.round(F.avg("objective"), 6).alias("mean")), _CELL)
_sel("sel_best_per_regime", "SELECT regime, arg_max(id, (objective, -id)) AS id FROM arch GROUP BY 1", lambda d: X.best_by(archive(d), ["regime"], [F.desc("objective"), F.col("id")]).select("regime", "id"), _CELL)


@register("sel_greedy_decorr", S.query(S.BARS, RET, _CORR, "rk AS (SELECT symbol, row_number() OVER (ORDER BY sum(r) DESC, symbol) AS k FROM z GROUP BY 1)",
    "pick AS (SELECT 1 AS k, [symbol] AS kept FROM rk WHERE k = 1 UNION ALL SELECT pick.k + 1, CASE WHEN len(kept) < 3 AND NOT EXISTS (SELECT 1 FROM cr WHERE abs(corr) >= 0.05 AND ((a = rk.symbol AND list_contains(kept, b)) OR (b = rk.symbol AND list_contains(kept, a)))) THEN list_append(kept, rk.symbol) ELSE kept END FROM pick JOIN rk ON rk.k = pick.k + 1)",
    select="SELECT unnest(kept) AS id FROM pick WHERE k = (SELECT max(k) FROM pick)").replace("WITH ", "WITH RECURSIVE ", 1))
def sel_greedy_decorr(spark, sf_dir):
    fit = M.returns(curve(spark, sf_dir), ["symbol"]).groupBy(F.col("symbol").alias("id")).agg(F.sum("r").alias("fitness"))
    return X.greedy_decorrelated(fit, corr_rows(spark, sf_dir), 0.05, 3).select("id")


@register("sel_dedup_corr", S.query(S.BARS, RET, _CORR, "rk AS (SELECT symbol, row_number() OVER (ORDER BY sum(r) DESC, symbol) AS k FROM z GROUP BY 1)",
    "pick AS (SELECT 1 AS k, [symbol] AS kept FROM rk WHERE k = 1 UNION ALL SELECT pick.k + 1, CASE WHEN NOT EXISTS (SELECT 1 FROM cr WHERE abs(corr) >= 0.04 AND ((a = rk.symbol AND list_contains(kept, b)) OR (b = rk.symbol AND list_contains(kept, a)))) THEN list_append(kept, rk.symbol) ELSE kept END FROM pick JOIN rk ON rk.k = pick.k + 1)",
    select="SELECT unnest(kept) AS id FROM pick WHERE k = (SELECT max(k) FROM pick)").replace("WITH ", "WITH RECURSIVE ", 1))
def sel_dedup_corr(spark, sf_dir):
    fit = M.returns(curve(spark, sf_dir), ["symbol"]).groupBy(F.col("symbol").alias("id")).agg(F.sum("r").alias("fitness"))
    return X.greedy_decorrelated(fit, corr_rows(spark, sf_dir), 0.04, X.CANDIDATES).select("id")
