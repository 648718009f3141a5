"""Selection of strategies: fronts, crowding, archives, greedy decorrelation, tournaments."""

from __future__ import annotations

import hashlib
from bisect import bisect_left
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from barloom.operators.splits import hashed
from barloom.sources import cache

POPULATION = 50_000  # strategies that are compared pair by pair at most: with one objective, or more than two
SLAB, SLABS = 50_000, 500  # points in memory at a time, and parts of them: beyond both, parts grow
CANDIDATES = 2000  # candidates of a greedy choice; its pairs reach the driver only within this bound


def best_by(df: DataFrame, keys: list[str], order: list[Column], k: int = 1) -> DataFrame:
    """The first ``k`` rows of each key in an order that leaves no ties."""
    return df.withColumn("_rn", F.row_number().over(W.partitionBy(*keys).orderBy(*order))).where(F.col("_rn") <= k).drop("_rn")


def dominated_pairs(df: DataFrame, objectives: list[str], violation: str | None = None) -> DataFrame:
    """``id, by``: rows that another row dominates: no objective worse and one better; with ``violation``, the smaller one wins first.

    Pairs grow with the square of the population, so its size is checked first; :func:`dominators`, :func:`pareto_front` and
    :func:`front_ranks` need no pairs where there are two objectives.
    """
    if df.limit(POPULATION + 1).count() > POPULATION:
        raise ValueError(f"more than {POPULATION} strategies: choose among them first")
    cols = [*objectives, *([violation] if violation else [])]
    a = df.select(F.col("id"), *[F.col(c).alias(f"a_{c}") for c in cols])
    b = df.select(F.col("id").alias("by"), *[F.col(c).alias(f"b_{c}") for c in cols])
    ge = [F.col(f"b_{c}") >= F.col(f"a_{c}") for c in objectives]
    gt = [F.col(f"b_{c}") > F.col(f"a_{c}") for c in objectives]
    better = ge[0]
    for e in ge[1:]:
        better = better & e
    some = gt[0]
    for e in gt[1:]:
        some = some | e
    cond = better & some
    if violation:
        va, vb = F.col(f"a_{violation}"), F.col(f"b_{violation}")
        cond = F.when((va > 0) | (vb > 0), vb < va).otherwise(cond)
    return a.join(b, cond & (F.col("id") != F.col("by"))).select("id", "by")


def _stored(df: DataFrame, name: str) -> DataFrame:
    """``df`` written to the shared folder and read back: computed once, so that its parts agree."""
    path = cache.fresh(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def _points(df: DataFrame, objectives: list[str]) -> DataFrame:
    """``x, y, w``: the distinct pairs of two objectives and how many rows have each. A missing objective compares with nothing."""
    x, y = (F.col(c) for c in objectives)
    return df.where(x.isNotNull() & y.isNotNull()).groupBy(x.alias("x"), y.alias("y")).agg(F.count("*").alias("w"))


def _places(first: pa.ChunkedArray, second: pa.ChunkedArray) -> np.ndarray:
    """Each row's place by falling ``first``, then falling ``second``."""
    a, b = (np.unique(c.to_numpy(), return_inverse=True)[1] for c in (first, second))  # NaN is the greatest, as in Spark
    place = np.empty(len(a), np.int64)
    place[np.lexsort((-b, -a))] = np.arange(len(a))
    return place


def _smaller_before(values: np.ndarray, weights: np.ndarray) -> np.ndarray:
    """For each entry the weight of those before it with a smaller value; values are 0, 1, ... in any order. Bottom-up merges."""
    n = len(values)
    at, out, half = np.arange(n), np.zeros(n, np.int64), 1
    while half < n:
        pair, right = at // (2 * half), at // half % 2 == 1
        order = np.argsort(pair * n + values)
        late = right[order]
        sums = np.concatenate([[0], np.cumsum(np.where(late, 0, weights[order]))])
        out[order[late]] += (sums[1:] - sums[pair * (2 * half)])[late]
        half *= 2
    return out


def _above(points: DataFrame) -> DataFrame:
    """``x, y, n`` of the points ``x, y, w`` that others dominate: the weight ``n`` of those.

    A point dominates another if it comes before it both by falling (x, y) and by falling (y, x). Both orders are cut into
    parts. Pairs of one part of the first order are counted there, pairs of one part of the second in that, and all others
    by a table of the weights of the parts' crossings.
    """
    points = _stored(points, "points")
    size = points.count()
    parts = max(1, min(SLABS, -(-size // SLAB)))
    x, y = (f"{c} {points.schema[c].dataType.simpleString()}" for c in "xy")

    def first(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if held := list(batches):
            rows = pa.Table.from_batches(held)
            rows = rows.take(np.argsort(_places(rows["x"], rows["y"])))
            n = _smaller_before(_places(rows["y"], rows["x"]), rows["w"].to_numpy())
            yield from rows.append_column("n", pa.array(n)).to_batches()

    def second(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if held := list(batches):
            rows = pa.Table.from_batches(held)
            place = _places(rows["y"], rows["x"])
            order = np.lexsort((-place, rows["i"].to_numpy()))  # within a part of the first order none is before a greater one
            rows = rows.take(order)
            n = rows["n"].to_numpy() + _smaller_before(place[order], rows["w"].to_numpy())
            yield from rows.set_column(rows.schema.get_field_index("n"), "n", pa.array(n)).to_batches()

    rows = points.repartitionByRange(parts, F.desc("x"), F.desc("y")).select("x", "y", "w", F.spark_partition_id().alias("i"))
    rows = _stored(rows.mapInArrow(first, f"{x}, {y}, w long, i int, n long"), "slabs")
    if parts == 1:
        return rows.where("n > 0").select("x", "y", "n")
    rows = rows.repartitionByRange(parts, F.desc("y"), F.desc("x")).select("x", "y", "w", "i", F.spark_partition_id().alias("j"), "n")
    rows = _stored(rows.mapInArrow(second, f"{x}, {y}, w long, i int, j int, n long"), "stripes")
    table = np.zeros((parts + 1, parts + 1), np.int64)
    for r in rows.groupBy("i", "j").agg(F.sum("w").alias("w")).collect():  # SLABS squared at most
        table[r["i"] + 1, r["j"] + 1] = r["w"]
    before = table.cumsum(0).cumsum(1)
    cells = points.sparkSession.createDataFrame([(i, j, int(before[i, j])) for i in range(parts) for j in range(parts) if before[i, j]], "i int, j int, more long")
    rows = rows.join(F.broadcast(cells), ["i", "j"], "left").withColumn("n", F.col("n") + F.coalesce("more", F.lit(0)))
    return rows.where("n > 0").select("x", "y", "n")


def dominators(df: DataFrame, objectives: list[str]) -> DataFrame:
    """``id, n``: rows that ``n`` other rows dominate, where there are any."""
    if len(objectives) != 2:
        return dominated_pairs(df, objectives).groupBy("id").agg(F.count("*").alias("n"))
    df = _stored(df.select("id", *objectives), "population")
    x, y = objectives
    return df.join(_above(_points(df, objectives)), (F.col(x) == F.col("x")) & (F.col(y) == F.col("y"))).select("id", "n")


def pareto_front(df: DataFrame, objectives: list[str]) -> DataFrame:
    """The rows that none dominates."""
    df = _stored(df, "population")
    if len(objectives) != 2:
        return df.join(dominated_pairs(df, objectives).select("id").distinct(), "id", "left_anti")
    x, y = objectives
    return df.join(_above(_points(df, objectives)), (F.col(x) == F.col("x")) & (F.col(y) == F.col("y")), "left_anti")


def _chains(points: DataFrame) -> DataFrame:
    """``x, y, rank``: the longest chain of points that dominate one another above each.

    With points in falling order of (x, y), that is the longest rising run of their places by falling (y, x): one pass with
    the least last place of the chains of each length. The pass is one task over distinct points, and holds a number a front.
    """

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last: list[int] = []
        for batch in batches:
            ranks = []
            for place in batch.column(2).to_pylist():
                k = bisect_left(last, place)
                last[k : k + 1] = [place]
                ranks.append(k)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(ranks, pa.int64())], names=["x", "y", "rank"])

    x, y = (f"{c} {points.schema[c].dataType.simpleString()}" for c in "xy")
    placed = points.select("x", "y", F.row_number().over(W.orderBy(F.desc("y"), F.desc("x"))).alias("place"))
    return placed.repartition(1).sortWithinPartitions(F.desc("x"), F.desc("y")).mapInArrow(run, f"{x}, {y}, rank long")


def front_ranks(df: DataFrame, objectives: list[str], violation: str | None = None) -> DataFrame:
    """``rank`` of each row's front, 0 first: 1 more than the highest rank among its dominators.

    Rows that violate follow behind all that don't, a front for each size of violation.
    """
    df = _stored(df, "population")
    if len(objectives) != 2:
        return _peeled(df, objectives, violation)
    x, y = objectives
    bad = F.coalesce(F.col(violation) > 0, F.lit(False)) if violation else F.lit(False)
    ranks = _chains(_points(df.where(~bad), objectives))
    out = df.where(~bad).join(ranks, (F.col(x) == F.col("x")) & (F.col(y) == F.col("y")), "left").withColumn("rank", F.coalesce("rank", F.lit(0)).cast("bigint"))
    out = _stored(out.select(*df.columns, "rank"), "ranks")
    if not violation:
        return out
    # rows of unknown violation aren't ahead of any that violate
    ahead = out.where(F.col(violation) <= 0).agg(F.coalesce(F.max("rank") + 1, F.lit(0)).alias("ahead"))  # one row
    sizes = df.where(bad).select(F.col(violation).alias("size")).distinct()
    sizes = sizes.select("size", (F.row_number().over(W.orderBy("size")) - 1).alias("step")).crossJoin(F.broadcast(ahead))
    late = df.where(bad).join(sizes, F.col(violation) == F.col("size")).withColumn("rank", (F.col("step") + F.col("ahead")).cast("bigint"))
    return _stored(out.unionByName(late.select(*df.columns, "rank")), "ranks")


def _peeled(df: DataFrame, objectives: list[str], violation: str | None) -> DataFrame:
    """:func:`front_ranks` for any number of objectives, from all pairs, a front at a time."""
    pairs = _stored(dominated_pairs(df, objectives, violation), "pairs")
    left, rank, out = df, 0, None
    while not left.isEmpty():
        beaten = pairs.join(left.select(F.col("id").alias("by")), "by", "left_semi").select("id").distinct()
        front = _stored(left.join(beaten, "id", "left_anti").withColumn("rank", F.lit(rank).cast("bigint")), "front")
        out = front if out is None else out.unionByName(front)
        left, rank = _stored(left.join(beaten, "id", "left_semi"), "left"), rank + 1
    return out if out is not None else df.withColumn("rank", F.lit(0).cast("bigint"))


def crowding(df: DataFrame, objectives: list[str], front: str = "rank") -> DataFrame:
    """``crowding`` within each front: the sum over objectives of the neighbours' gap over the front's range; ends are infinite."""
    by = W.partitionBy(front)
    total = F.lit(0.0)
    for c in objectives:
        w = by.orderBy(c, "id")
        gap = F.lead(c, 1).over(w) - F.lag(c, 1).over(w)
        span = F.max(c).over(by) - F.min(c).over(by)
        total = total + F.coalesce(F.when(span > 0, gap / span).otherwise(F.when(gap.isNotNull(), 0.0)), F.lit(float("inf")))
    return df.withColumn("crowding", F.when(F.count("*").over(by) <= 2, float("inf")).otherwise(total))


def tournament(df: DataFrame, rounds: int, k: int, order: list[str], seed: int) -> DataFrame:
    """``round, id``: the best in ``order`` of ``k`` rows drawn by hash, once a round."""
    n = df.count()
    base = df.withColumn("_i", F.row_number().over(W.orderBy("id")) - 1)  # a population: one generation
    draws = df.sparkSession.range(rounds).select(F.col("id").alias("round"), F.explode(F.sequence(F.lit(0), F.lit(k - 1))).alias("j"))
    draws = draws.withColumn("_i", F.pmod(hashed(seed, F.col("round").cast("string"), F.col("j").cast("string")), F.lit(max(1, n))).cast("int"))
    won = draws.join(base, "_i").groupBy("round").agg(F.min(F.struct(*order, "id")).alias("b"))
    return won.select("round", F.col("b.id").alias("id"))


def shuffled_names(names: list[str], seed: int) -> list[str]:
    """Names in an order drawn by the seed."""
    return sorted(names, key=lambda n: hashlib.md5(f"{seed}:{n}".encode()).hexdigest())  # noqa: S324


def lexicase(df: DataFrame, criteria: list[str]) -> DataFrame:
    """Rows that survive the criteria in turn: each keeps rows at or above the upper median of those left."""
    for c in criteria:
        cut = df.agg(F.expr(f"percentile_disc(0.5) within group (order by {c} desc)").alias("_cut"))  # the upper median; one row
        df = df.crossJoin(F.broadcast(cut)).where(F.col(c) >= F.col("_cut")).drop("_cut")
    return df


def greedy_decorrelated(ranked: DataFrame, corr: DataFrame, limit: float, k: int) -> DataFrame:
    """``id, place``: ids by falling fitness, each kept if no kept one correlates above ``limit`` in size, up to ``k``."""
    rows = [(r["id"], r["fitness"]) for r in ranked.orderBy(F.desc("fitness"), "id").limit(CANDIDATES + 1).collect()]
    if len(rows) > CANDIDATES:
        raise ValueError(f"more than {CANDIDATES} candidates: filter them first")
    ids = F.broadcast(ranked.sparkSession.createDataFrame([(i,) for i, _ in rows], f"id {ranked.schema['id'].dataType.simpleString()}"))
    close = corr.where(F.abs("corr") >= limit).join(ids, F.col("a") == F.col("id"), "left_semi").join(ids, F.col("b") == F.col("id"), "left_semi")
    near = {frozenset((r["a"], r["b"])) for r in close.select("a", "b").collect()}  # pairs of candidates only
    kept: list = []
    for i, _ in rows:
        if len(kept) < k and not any(frozenset((i, j)) in near for j in kept):
            kept.append(i)
    kind = ranked.schema["id"].dataType.simpleString()
    return ranked.sparkSession.createDataFrame([(i, n) for n, i in enumerate(kept)], f"id {kind}, place bigint")


def archive_cells(df: DataFrame) -> DataFrame:
    """The best of each (freq, complexity, regime) cell; the earlier one on equal objectives."""
    return best_by(df, ["freq", "complexity", "regime"], [F.desc("objective"), F.col("id")])
