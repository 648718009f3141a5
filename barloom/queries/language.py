"""The strategy language and evolution, over tables: a strategy a customer, a genome a customer, a bar table for the searches."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import functions as F

from barloom.operators import genetics as G
from barloom.plans import explain as E
from barloom.plans.patterns import MODULES
from barloom.queries import register
from barloom.queries import sql as S
from barloom.sources import bars as B

# a strategy a customer, of stated parts
STRATEGY = """st AS (SELECT c_custkey AS id, CASE WHEN c_custkey % 2 = 0 THEN 'LONG' ELSE 'SHORT' END AS side, 5 + c_custkey % 17 AS period, 20 + c_custkey % 60 AS level, 3 + c_custkey % 9 AS n,
  (c_custkey % 5 - 2)::DOUBLE AS change, CASE WHEN c_custkey % 3 = 0 THEN 'OR' ELSE 'AND' END AS word, 1.5 + (c_custkey % 8)*0.5::DOUBLE AS tp, 0.75 + (c_custkey % 4)*0.25::DOUBLE AS sl,
  CASE WHEN c_custkey % 4 = 0 THEN 1.0 + (c_custkey % 6)*0.5 ELSE 0.0 END::DOUBLE AS trail FROM customer),
tx AS (SELECT *, 'RSI(close, ' || period || ') _LT_ ' || level AS a, 'ROC(' || n || ', 4h) _GT_ ' || printf('%.1f', change) AS b,
  ' EXIT TP=' || printf('%.2f', tp) || ' SL=' || printf('%.2f', sl) || CASE WHEN trail > 0 THEN ' TRAIL=' || printf('%.2f', trail) ELSE '' END AS ex FROM st)"""


def strategies(spark, sf_dir):
    k = F.col("c_custkey")
    mod = lambda n: F.pmod(k, F.lit(n))
    df = B.table(spark, sf_dir, "customer").select(
        k.alias("id"), F.when(mod(2) == 0, "LONG").otherwise("SHORT").alias("side"), (5 + mod(17)).alias("period"), (20 + mod(60)).alias("level"), (3 + mod(9)).alias("n"),
        (mod(5) - 2).cast("double").alias("change"), F.when(mod(3) == 0, "OR").otherwise("AND").alias("word"), (1.5 + mod(8) * 0.5).alias("tp"), (0.75 + mod(4) * 0.25).alias("sl"),
        F.when(mod(4) == 0, 1.0 + mod(6) * 0.5).otherwise(0.0).alias("trail"),
    )
    trail = F.when(F.col("trail") > 0, F.format_string(" TRAIL=%.2f", "trail")).otherwise("")
    return df.withColumn("a", F.format_string("RSI(close, %d) _LT_ %d", "period", "level")).withColumn("b", F.format_string("ROC(%d, 4h) _GT_ %.1f", "n", "change")).withColumn("ex", F.concat(F.format_string(" EXIT TP=%.2f SL=%.2f", "tp", "sl"), trail))


def expressions(df, *parts):
    return df.select("id", F.concat("side", F.lit(" WHEN "), *parts, "ex").alias("expression"))


def both(df):
    return expressions(df, F.col("a"), F.lit(" "), F.col("word"), F.lit(" "), F.col("b"))


def mapped(df, schema: str, one):
    """Rows that ``one(id, strategy)`` gives for each parsed expression, in Arrow batches."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from barloom.plans.strategy import parse

        names = [c.split()[0] for c in schema.split(", ")]
        for batch in batches:
            rows = [row for k, text in zip(batch["id"], batch["expression"], strict=True) for row in one(k, parse(text))]
            yield pd.DataFrame(rows, columns=names)

    return df.mapInPandas(run, schema)


def q(select: str, *ctes: str) -> str:
    return S.query(STRATEGY, *ctes, select=select)


@register("ge_parse", q("SELECT id, side AS direction, 2 AS n_conditions, 'c0 ' || word || ' c1' AS logic, 'RSI(close, ' || period || ')' AS left0, printf('%.1f', change) AS right1, tp, sl, trail FROM tx"))
def ge_parse(spark, sf_dir):
    one = lambda k, s: [(k, s.direction, len(s.conditions), s.logic, s.conditions[0].left, s.conditions[1].right, s.tp, s.sl, s.trail)]
    return mapped(both(strategies(spark, sf_dir)), "id bigint, direction string, n_conditions bigint, logic string, left0 string, right1 string, tp double, sl double, trail double", one)


_EX = "' EXIT TP=' || format('{:g}', tp) || ' SL=' || format('{:g}', sl) || CASE WHEN trail > 0 THEN ' TRAIL=' || format('{:g}', trail) ELSE '' END"


@register("ge_simplify", q(f"SELECT id, side || ' WHEN ' || CASE WHEN id % 3 = 0 THEN a WHEN id % 3 = 1 THEN a || ' AND ' || b ELSE '(' || a || ' AND ' || b || ') OR ' || b END || {_EX} AS expression FROM tx"))
def ge_simplify(spark, sf_dir):
    from barloom.plans.strategy import simplify

    a, b, k = F.col("a"), F.col("b"), F.pmod("id", F.lit(3))
    said = F.when(k == 0, F.concat(a, F.lit(" OR "), a)).when(k == 1, F.concat(a, F.lit(" AND MFI(9) _GT_ MFI(9) AND "), b, F.lit(" AND "), a)).otherwise(F.concat(F.lit("( "), a, F.lit(" AND "), b, F.lit(" AND "), a, F.lit(" ) OR "), b))
    return mapped(expressions(strategies(spark, sf_dir), said), "id bigint, expression string", lambda k, s: [(k, simplify(s).expression)])


_PARAMS = """pa AS (SELECT id, 0 AS place, 'c0_left_RSI_period' AS name, period::DOUBLE AS v, 'period' AS kind, 2.0 AS lo, 100.0 AS hi FROM tx UNION ALL
SELECT id, 1, 'c0_right_threshold', level::DOUBLE, 'osc_threshold', 0.0, 100.0 FROM tx UNION ALL SELECT id, 2, 'c1_left_ROC_period', n::DOUBLE, 'period', 2.0, 100.0 FROM tx UNION ALL
SELECT id, 3, 'c1_right_threshold', change, 'norm_threshold', -5.0, 5.0 FROM tx UNION ALL SELECT id, 4, 'tp_mult', tp, 'tp', 0.5, 15.0 FROM tx UNION ALL
SELECT id, 5, 'sl_mult', sl, 'sl', 0.2, 5.0 FROM tx UNION ALL SELECT id, 6, 'trail_mult', trail, 'trail', 0.5, 10.0 FROM tx WHERE trail > 0),
ti AS (SELECT *, CASE kind WHEN 'period' THEN greatest(v*0.6, 2.0) WHEN 'osc_threshold' THEN 25.0 WHEN 'norm_threshold' THEN 2.0 ELSE greatest(v*0.5, 0.3) END AS reach FROM pa)"""


@register("ge_params", q("SELECT id, place::BIGINT AS place, name, v AS value, kind, lo::DOUBLE AS lo, hi::DOUBLE AS hi FROM pa", _PARAMS))
def ge_params(spark, sf_dir):
    from barloom.plans.parameters import parameters

    one = lambda k, s: [(k, i, p.name, p.value, p.kind, p.low, p.high) for i, p in enumerate(parameters(s))]
    return mapped(both(strategies(spark, sf_dir)), "id bigint, place bigint, name string, value double, kind string, lo double, hi double", one)


@register("ge_tighten", q("SELECT id, place::BIGINT AS place, round(greatest(lo, v - reach), 6)::DOUBLE AS lo, round(least(hi, v + reach), 6)::DOUBLE AS hi FROM ti", _PARAMS))
def ge_tighten(spark, sf_dir):
    from barloom.plans.parameters import parameters, tighten

    one = lambda k, s: [(k, i, round(p.low, 6), round(p.high, 6)) for i, p in enumerate(tighten(parameters(s)))]
    return mapped(both(strategies(spark, sf_dir)), "id bigint, place bigint, lo double, hi double", one)


_NEW = "least(hi, v + CASE WHEN kind IN ('period', 'osc_threshold') THEN 3.0 ELSE 0.5 END)"


@register("ge_rebuild", q(
    "SELECT id, side || ' WHEN RSI(close, ' || printf('%d', w0::BIGINT) || ') _LT_ ' || printf('%d', w1::BIGINT) || ' ' || word || ' ROC(' || printf('%d', w2::BIGINT) || ', 4h) _GT_ ' || printf('%.1f', w3) || ' EXIT TP=' || format('{:g}', w4) || ' SL=' || format('{:g}', printf('%.1f', w5)::DOUBLE) || CASE WHEN trail > 0 THEN ' TRAIL=' || format('{:g}', w6) ELSE '' END AS expression FROM tx JOIN nw USING (id)",
    _PARAMS, f"nw AS (SELECT id, {', '.join(f'max({_NEW}) FILTER (WHERE place = {k}) AS w{k}' for k in range(7))} FROM pa GROUP BY 1)"))
def ge_rebuild(spark, sf_dir):
    from barloom.plans.parameters import parameters, rebuild

    def one(k, s):
        found = parameters(s)
        return [(k, rebuild(s, found, [p.value + (3.0 if p.kind in ("period", "osc_threshold") else 0.5) for p in found]).expression)]

    return mapped(both(strategies(spark, sf_dir)), "id bigint, expression string", one)


# genomes: hashes, so that SQL draws the same

def _h(seed: int, *parts: str) -> str:
    return "('0x' || substr(md5('" + f"{seed}:' || " + " || ':' || ".join(parts) + "), 1, 8))::BIGINT"


GENOMES = f"g AS (SELECT c_custkey AS id, list_transform(range({G.LENGTH}), lambda i: {_h(42, 'c_custkey', 'i')} % {G.CODONS}) AS genome FROM customer)"
_TEXT = "array_to_string(genome, ',') AS genome"


def genomes(spark, sf_dir):
    return G.random_genomes(B.table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id")), 42)


def _shown(df):
    return df.select("id", F.array_join(F.col("genome").cast("array<string>"), ",").alias("genome"))


@register("ge_random", S.query(GENOMES, select=f"SELECT id, {_TEXT} FROM g"))
def ge_random(spark, sf_dir):
    return _shown(genomes(spark, sf_dir))


_CROSS = f"""cut AS (SELECT p, least(a, b) AS lo, greatest(a, b) AS hi FROM (SELECT p, a, CASE WHEN b >= a THEN b + 1 ELSE b END AS b FROM
  (SELECT p, 1 + {_h(43, 'p', '0')} % {G.LENGTH - 1} AS a, 1 + {_h(43, 'p', '1')} % {G.LENGTH - 2} AS b FROM (SELECT DISTINCT id//2 AS p FROM g)))),
xs AS (SELECT x.id, list_transform(range({G.LENGTH}), lambda i: CASE WHEN y.genome IS NOT NULL AND i >= lo AND i < hi THEN y.genome[i + 1] ELSE x.genome[i + 1] END) AS genome
  FROM g x JOIN cut ON cut.p = x.id//2 LEFT JOIN g y ON y.id = CASE WHEN x.id % 2 = 0 THEN x.id + 1 ELSE x.id - 1 END)"""


@register("ge_crossover", S.query(GENOMES, _CROSS, select=f"SELECT id, {_TEXT} FROM xs"))
def ge_crossover(spark, sf_dir):
    return _shown(G.crossover(genomes(spark, sf_dir), 43))


_STEP = "[" + ", ".join(map(str, G.STEPS)) + "]"
_RATE = "CASE WHEN i < 10 + id % 30 THEN 0.2 ELSE 0.1 END"
_MUTATE = f"""mu AS (SELECT id, list_transform(range({G.LENGTH}), lambda i: CASE WHEN ({_h(50, 'id', 'i')} % 10000)/10000.0 >= {_RATE} THEN genome[i + 1]
  WHEN ({_h(51, 'id', 'i')} % 10000)/10000.0 < greatest(0.35, 0.6 - 0.25*(id % 5)/4.0) THEN {_h(52, 'id', 'i')} % 256
  ELSE (genome[i + 1] + {_STEP}[{_h(53, 'id', 'i')} % 10 + 1] + 256) % 256 END) AS genome FROM g)"""


@register("ge_mutate", S.query(GENOMES, _MUTATE, select=f"SELECT id, {_TEXT} FROM mu"))
def ge_mutate(spark, sf_dir):
    return _shown(G.mutate(genomes(spark, sf_dir), 50, 0.1, F.pmod("id", F.lit(5)) / 4.0, 10 + F.pmod("id", F.lit(30))))


NAMES = sorted(MODULES)
_SETS = f"""nm AS (SELECT unnest([{', '.join(f"'{n}'" for n in NAMES)}]) AS name),
ra AS (SELECT id, list_sort(list_transform(list_sort(list({{'h': h, 'name': name}}))[1:(2 + any_value(sz))::INT], lambda x: x.name)) AS modules
  FROM (SELECT c_custkey AS id, name, {_h(60, 'c_custkey', 'name')} AS h, {_h(61, 'c_custkey')} % 3 AS sz FROM customer, nm) GROUP BY 1),
cr AS (SELECT x.id//2 AS id, list_sort(list_distinct(list_concat(x.modules[1:len(x.modules)//2], y.modules[len(y.modules)//2 + 1:]))) AS modules FROM ra x JOIN ra y ON x.id % 2 = 0 AND y.id = x.id + 1),
ch AS (SELECT id, list_sort(list_distinct(list_transform(modules, lambda m, i: CASE WHEN i - 1 = spot THEN fresh ELSE m END))) AS modules
  FROM (SELECT *, {_h(62, 'id')} % len(modules) AS spot, (SELECT list_sort(list(name)) FROM nm)[{_h(63, 'id')} % {len(NAMES)} + 1] AS fresh FROM cr))"""


@register("ge_v1_ops", S.query(_SETS, select="SELECT kind, id, array_to_string(modules, ',') AS modules FROM (SELECT 'random' AS kind, * FROM ra UNION ALL SELECT 'child', * FROM cr UNION ALL SELECT 'changed', * FROM ch)"))
def ge_v1_ops(spark, sf_dir):
    made = G.random_sets(B.table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id")), NAMES, 60)
    child = G.cross_sets(made)
    every = [made.withColumn("kind", F.lit("random")), child.withColumn("kind", F.lit("child")), G.change_sets(child, NAMES, 62).withColumn("kind", F.lit("changed"))]
    out = every[0].unionByName(every[1]).unionByName(every[2])
    return out.select("kind", "id", F.array_join("modules", ",").alias("modules"))


@register("ge_grammar")
def ge_grammar(spark, sf_dir):
    """The rules as a table, checked."""
    from barloom.plans.grammar import RULES, check

    check(RULES)
    return spark.createDataFrame([(rule, k, text) for rule, options in RULES.items() for k, text in enumerate(options)], "rule string, place bigint, alternative string")


@register("ge_decode")
def ge_decode(spark, sf_dir):
    from barloom.plans.grammar import decoded

    return decoded(genomes(spark, sf_dir))


for _name in ("ge_islands", "ge_nsga_niched", "ge_cmaes"):

    def _loop(spark, sf_dir, name=_name):
        from barloom.plans import evolve
        from barloom.sources.bars import event_bars

        return evolve.search(spark, event_bars(spark, sf_dir), name)

    register(_name)(_loop)


# in words

POOL = ["RSI(close, 9) _LT_ 20", "RSI(close, 14) _GT_ 80", "MFI(9) _GT_ 90", "ADX(14) _GT_ 30", "STOCH_K(9) CROSSES_ABOVE STOCH_D(9)", "BBWIDTH(20, 2.0) _LT_ 1.0", "VOL_RATIO(20) _GT_ 1.5", "ROC(5) CROSSES_ABOVE 0.5", "PCT_B(20, 2.0) _LT_ 0.0"]
_POOL = "[" + ", ".join(f"'{p}'" for p in POOL) + "]"
_LIKE = f"le AS (SELECT id, side, {_POOL}[id % 9 + 1] || ' AND ' || {_POOL}[id % 7 + 1] || CASE WHEN id % 2 = 0 THEN ' OR ' || b ELSE '' END || ex AS expression FROM tx)"


def _like_sql() -> str:
    has = lambda words: " AND ".join(f"contains(expression, '{w}')" for w in words)
    said = ["CASE " + " ".join(f"WHEN {has(words)} THEN '{text}'" for words, text in group) + " END" for group in E.REMARKS]
    said.append(f"CASE WHEN side = 'SHORT' THEN CASE WHEN contains(expression, 'RSI') AND (contains(expression, '_LT_ 20') OR contains(expression, '_LT_ 30')) THEN '{E.SHORT_EXTREME}' WHEN {has(['ROC', 'CROSSES_ABOVE'])} THEN '{E.SHORT_FADE}' END END")
    n = "len(regexp_extract_all(expression, ' AND | OR ')) + 1"
    said.append(f"CASE WHEN {n} >= 3 THEN 'Multi-condition (' || ({n}) || ' filters) — highly selective' END")
    return f"SELECT id, coalesce(nullif(concat_ws('; ', {', '.join(said)}), ''), '{E.PLAIN}') AS said FROM le"


@register("rep_explain_like", q(_like_sql(), _LIKE))
def rep_explain_like(spark, sf_dir):
    pool = F.array(*[F.lit(p) for p in POOL])
    pick = lambda n: F.element_at(pool, (F.pmod("id", F.lit(n)) + 1).cast("int"))
    text = F.concat(pick(9), F.lit(" AND "), pick(7), F.when(F.pmod("id", F.lit(2)) == 0, F.concat(F.lit(" OR "), F.col("b"))).otherwise(""), F.col("ex"))
    return strategies(spark, sf_dir).select("id", E.remarks(text, F.col("side")).alias("said"))


_NAMES, _OPS = list(E.PREDICATES), list(E.OPERATORS)


def _node_sql(shift: int) -> str:
    k = f"(id + {shift})"
    name = f"[{', '.join(repr(n) for n in _NAMES)}][{k} % {len(_NAMES)} + 1]"
    word = f"[{', '.join(repr(E.PREDICATES[n]) for n in _NAMES)}][{k} % {len(_NAMES)} + 1]"
    op = f"[{', '.join(repr(E.OPERATORS[o]) for o in _OPS)}][{k} % {len(_OPS)} + 1]"
    back = lambda x, now: (f"CASE {x} " + ("WHEN 0 THEN 'current' " if now else "") + f"WHEN 1 THEN 'previous' WHEN 2 THEN '2 bars ago' ELSE {x} || ' bars ago' END")
    t = f"(({k} % 40)*0.03::DOUBLE + 0.011::DOUBLE)"
    limit = f"CASE WHEN {name} LIKE '%pct%' OR {name} LIKE '%change%' THEN printf('%.2f%%', {t}*100) WHEN {name} LIKE '%ratio%' OR {name} LIKE '%position%' THEN printf('%.3f', {t}) WHEN {name} LIKE '%rsi%' THEN printf('%.1f', {t}) ELSE printf('%.2f', {t}) END"
    right = f"CASE WHEN {k} % 3 = 0 THEN {word} || ' (' || {back(f'(1 + {k} % 4)', False)} || ')' ELSE {limit} END"
    return f"{word} || ' (' || {back(f'({k} % 4)', True)} || ') ' || {op} || ' ' || {right}"


_LINE = chr(10)


@register("rep_explain", q(
    "SELECT id, 'Pattern Description' || chr(10) || repeat('=', 60) || chr(10) || 'Direction: ' || side || chr(10) || 'Window: ' || period || ' bars' || chr(10) || 'Fitness: ' || printf('%.4f', sl) || chr(10) || chr(10) || 'Entry Condition:' || chr(10) || repeat('-', 60) || chr(10) || "
    "CASE id % 3 WHEN 0 THEN n0 WHEN 1 THEN n0 || ' ' || word || ' ' || n1 ELSE CASE word WHEN 'AND' THEN 'ALL' ELSE 'ANY' END || ' of the following:' || chr(10) || '  - ' || n0 || chr(10) || '  - ' || n1 || chr(10) || '  - ' || n2 END || chr(10) || repeat('-', 60) || chr(10) || chr(10) || "
    "'Interpretation:' || chr(10) || 'When this condition is met, the strategy opens a ' || side || ' position.' || chr(10) || 'The pattern looks at the last ' || period || ' bars to evaluate the condition.' || chr(10) AS said FROM nd",
    f"nd AS (SELECT *, {', '.join(f'{_node_sql(7 * k)} AS n{k}' for k in range(3))} FROM tx)"))
def rep_explain(spark, sf_dir):
    df = strategies(spark, sf_dir)

    def node(shift: int):
        k = F.col("id") + shift
        at = lambda names: F.element_at(F.array(*[F.lit(n) for n in names]), (F.pmod(k, F.lit(len(names))) + 1).cast("int"))
        other = F.when(F.pmod(k, F.lit(3)) == 0, 1 + F.pmod(k, F.lit(4)))
        return E.predicate(at(_NAMES), at(_OPS), F.pmod(k, F.lit(4)), other, F.pmod(k, F.lit(40)) * 0.03 + 0.011)

    parts = F.slice(F.array(node(0), node(7), node(14)), F.lit(1), (F.pmod("id", F.lit(3)) + 1).cast("int"))
    return df.select("id", E.pattern(F.col("side"), F.col("period"), F.col("sl"), E.joined(parts, F.col("word"))).alias("said"))
