"""Reports as tables of lines and of points: what is drawn or printed is written by Spark and read back."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from barloom.operators import metrics as M
from barloom.plans import explain as E
from barloom.queries import register
from barloom.queries import sql as S
from barloom.queries.indicators import rnd
from barloom.queries.metrics import _AGG, _H, RET, YEAR, curve, q
from barloom.sources import cache

SHOWN = ["total_return", "max_dd", "sharpe", "win_rate"]
_FIGURES = [f"printf('%.2f%%', {c}*100)" if c in E.SHARES else f"printf('%.2f', {c})" if c in E.TWO_DIGITS else f"printf('%.4f', {c})" for c in SHOWN]


def rows(spark, sf_dir):
    df = M.bundle(curve(spark, sf_dir), ["symbol"], YEAR)
    return df.select("symbol", *[E.figure(F.lit(c), F.col(c)).alias(c) for c in SHOWN])


def lines(body, head: list[str], tail: list[str]):
    """``place, line``: head, a line a row of ``body`` (``symbol, line``) in order of symbols, and tail."""
    spark = body.sparkSession
    first = spark.createDataFrame([(k, x) for k, x in enumerate(head)], "place bigint, line string")
    numbered = body.select((F.row_number().over(W.orderBy("symbol")) - 1 + len(head)).cast("bigint").alias("place"), "line")  # one row a symbol
    out = first.unionByName(numbered)
    if not tail:
        return out
    n = body.agg(F.count("*").alias("n"))  # one row
    last = spark.createDataFrame([(k, x) for k, x in enumerate(tail)], "k bigint, line string").crossJoin(F.broadcast(n))
    return out.unionByName(last.select((F.col("k") + F.col("n") + len(head)).alias("place"), "line"))


def written(out, kind: str):
    """One file of lines in the shared folder, read back."""
    path = cache.fresh(out.sparkSession, kind)
    out.orderBy("place").coalesce(1).sortWithinPartitions("place").select(F.col("line").alias("value")).write.text(path)
    return out.sparkSession.read.text(path).select(F.col("value").alias("line"))


def _register(name: str, kind: str, head: list[str], tail: list[str], sql_line: str, line) -> None:
    union = " UNION ALL ".join(f"SELECT '{x}' AS line" for x in head + tail)

    @register(name, q(f"SELECT {sql_line} AS line FROM f UNION ALL {union}", RET, _AGG))
    def run(spark, sf_dir):
        body = rows(spark, sf_dir)
        return written(lines(body.select("symbol", line.alias("line") if not callable(line) else line(body).alias("line")), head, tail), kind)


_register("snk_report_md", "report", ["# Results", "", "| symbol | " + " | ".join(SHOWN) + " |", "|" + "-|" * (len(SHOWN) + 1)], [], "'| ' || symbol || ' | ' || " + " || ' | ' || ".join(_FIGURES) + " || ' |'",
          lambda d: F.concat(F.lit("| "), F.concat_ws(" | ", "symbol", *SHOWN), F.lit(" |")))


def _tex_sql(text: str) -> str:
    for char, escaped in E.LATEX:
        text = f"replace({text}, '{char}', '{escaped}')"
    return text


_register("snk_latex", "latex", ["\\begin{tabular}{lrrrr}", "\\hline"], ["\\hline", "\\end{tabular}"], " || ' & ' || ".join([_tex_sql("symbol"), *[_tex_sql(f) for f in _FIGURES]]) + " || ' \\\\'",
          lambda d: F.concat(F.concat_ws(" & ", E.latex(F.col("symbol")), *[E.latex(F.col(c)) for c in SHOWN]), F.lit(" \\\\")))
_register("snk_html", "html", ["<!DOCTYPE html>", "<html><head><meta charset=\"utf-8\"><title>Results</title></head><body><table>", "<tr><th>symbol</th>" + "".join(f"<th>{c}</th>" for c in SHOWN) + "</tr>"], ["</table></body></html>"],
          "'<tr><td>' || symbol || '</td><td>' || " + " || '</td><td>' || ".join(_FIGURES) + " || '</td></tr>'", lambda d: F.concat(F.lit("<tr><td>"), F.concat_ws("</td><td>", "symbol", *SHOWN), F.lit("</td></tr>")))


@register("snk_plots", q(
    f"SELECT 'equity' AS plot, symbol, ts::DOUBLE AS x, {S.rnd('close/first_value(close) OVER (PARTITION BY symbol ORDER BY ts)*100')} AS y FROM z UNION ALL SELECT 'drawdown', symbol, ts::DOUBLE, {S.rnd('dd')} FROM z UNION ALL SELECT 'returns', symbol, bin::DOUBLE, n::DOUBLE FROM ({_H})", RET))
def snk_plots(spark, sf_dir):
    """The points that plots are drawn from: equity and drawdown over time, and the histogram of returns; the curve is computed once for all three."""
    path = cache.fresh(spark, "curve")
    M.returns(curve(spark, sf_dir), ["symbol"]).write.parquet(path)
    df = spark.read.schema("symbol string, ts bigint, close double, equity double, r double, dd double").parquet(path)
    first = F.first("close").over(W.partitionBy("symbol").orderBy("ts").rowsBetween(W.unboundedPreceding, 0))
    at = F.col("ts").cast("double").alias("x")
    equity = df.select(F.lit("equity").alias("plot"), "symbol", at, rnd(F.col("close") / first * 100).alias("y"))
    falls = df.select(F.lit("drawdown").alias("plot"), "symbol", at, rnd("dd").alias("y"))
    bins = M.histogram(df, ["symbol"], "r", 50).select(F.lit("returns").alias("plot"), "symbol", F.col("bin").cast("double").alias("x"), F.col("n").cast("double").alias("y"))
    return equity.unionByName(falls).unionByName(bins)
