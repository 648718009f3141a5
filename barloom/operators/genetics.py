"""Genetic operators on columns: genomes are arrays of codons 0 to 255, draws are hashes of (seed, id, place).

A population is a table, so an operator is one projection (or one join of mates) whatever its size, and every engine draws the same.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from barloom.operators.splits import hashed

LENGTH, CODONS = 50, 256
STEPS = (-5, -4, -3, -2, -1, 1, 2, 3, 4, 5)


def draw(seed: int, *parts: Column | str) -> Column:
    """32 random bits."""
    return hashed(seed, *[(F.col(p) if isinstance(p, str) else p).cast("string") for p in parts])


def random_genomes(ids: DataFrame, seed: int, length: int = LENGTH) -> DataFrame:
    """``id, genome`` for every ``id``."""
    return ids.select("id", F.transform(F.sequence(F.lit(0), F.lit(length - 1)), lambda i: F.pmod(draw(seed, "id", i), F.lit(CODONS))).alias("genome"))


def crossover(genomes: DataFrame, seed: int) -> DataFrame:
    """Mates ``2k`` and ``2k + 1`` exchange the codons between two cuts; an id without a mate stays as it is."""
    pair = F.expr("id div 2")
    a = genomes.where("id % 2 = 0").select(pair.alias("pair"), F.col("id").alias("a"), F.col("genome").alias("x"))
    b = genomes.where("id % 2 = 1").select(pair.alias("pair"), F.col("id").alias("b"), F.col("genome").alias("y"))
    both = a.join(b, "pair", "full").withColumn("n", F.least(F.size("x"), F.size("y")))
    first = 1 + F.pmod(draw(seed, "pair", F.lit(0)), F.col("n") - 1)
    second = 1 + F.pmod(draw(seed, "pair", F.lit(1)), F.col("n") - 2)
    both = both.withColumn("first", first).withColumn("second", second)
    both = both.withColumn("second", F.when(F.col("second") >= F.col("first"), F.col("second") + 1).otherwise(F.col("second")))
    both = both.withColumn("lo", F.least("first", "second")).withColumn("hi", F.greatest("first", "second"))
    mixed = lambda own, other: F.expr(f"if(n > 2, transform({own}, (v, i) -> if(i >= lo and i < hi, {other}[i], v)), {own})")
    whole = both.withColumn("p", F.when(F.col("x").isNull() | F.col("y").isNull(), F.coalesce("x", "y")))
    out = whole.select("a", "b", F.coalesce("p", mixed("x", "y")).alias("u"), F.coalesce("p", mixed("y", "x")).alias("v"))
    return out.select(F.explode(F.array(F.struct(F.col("a").alias("id"), F.col("u").alias("genome")), F.struct(F.col("b").alias("id"), F.col("v").alias("genome")))).alias("z")).select("z.*").where("id is not null")


def mutate(genomes: DataFrame, seed: int, rate: float, progress: Column, active: Column) -> DataFrame:
    """Codons change with probability ``rate``, the ``active`` first ones with twice that (0.4 at most): to any codon, in a share of
    cases that falls from 0.6 to 0.35 with ``progress``, else by a step of up to five."""
    df = genomes.withColumn("_p", progress).withColumn("_a", active)
    explore = F.greatest(F.lit(0.35), 0.6 - 0.25 * F.least(F.col("_p"), F.lit(1.0)))
    share = lambda k, i: F.pmod(draw(seed + k, "id", i), F.lit(10_000)) / 10_000
    steps = F.array(*[F.lit(x) for x in STEPS])

    def one(codon: Column, i: Column) -> Column:
        step = F.element_at(steps, (F.pmod(draw(seed + 3, "id", i), F.lit(len(STEPS))) + 1).cast("int"))
        fresh = F.when(share(1, i) < explore, F.pmod(draw(seed + 2, "id", i), F.lit(CODONS))).otherwise(F.pmod(codon + step, F.lit(CODONS)))
        return F.when(share(0, i) < F.when(i < F.col("_a"), F.least(F.lit(rate * 2), F.lit(0.4))).otherwise(rate), fresh).otherwise(codon)

    return df.select("id", F.transform("genome", one).alias("genome"))


def random_sets(ids: DataFrame, names: list[str], seed: int, least: int = 2, most: int = 4) -> DataFrame:
    """``id, modules``: between ``least`` and ``most`` names, sorted."""
    every = F.array(*[F.lit(n) for n in sorted(names)])
    ranked = F.array_sort(F.transform(every, lambda n: F.struct(draw(seed, "id", n).alias("h"), n.alias("name"))))
    size = (least + F.pmod(draw(seed + 1, "id"), F.lit(most - least + 1))).cast("int")
    return ids.select("id", F.array_sort(F.transform(F.slice(ranked, F.lit(1), size), lambda x: x["name"])).alias("modules"))


def cross_sets(sets: DataFrame) -> DataFrame:
    """The child of mates ``2k`` and ``2k + 1``: the first half of one's modules and the second half of the other's."""
    pair = F.expr("id div 2")
    a = sets.where("id % 2 = 0").select(pair.alias("id"), F.col("modules").alias("x"))
    b = sets.where("id % 2 = 1").select(pair.alias("id"), F.col("modules").alias("y"))
    half = F.expr("slice(x, 1, size(x) div 2)"), F.expr("slice(y, size(y) div 2 + 1, size(y))")
    return a.join(b, "id").select("id", F.array_sort(F.array_distinct(F.concat(*half))).alias("modules"))


def change_sets(sets: DataFrame, names: list[str], seed: int) -> DataFrame:
    """One module, drawn, is replaced by one drawn from all names."""
    every = F.array(*[F.lit(n) for n in sorted(names)])
    df = sets.withColumn("_at", F.pmod(draw(seed, "id"), F.size("modules")).cast("int")).withColumn("_new", F.element_at(every, (F.pmod(draw(seed + 1, "id"), F.lit(len(names))) + 1).cast("int")))
    return df.select("id", F.array_sort(F.array_distinct(F.expr("transform(modules, (m, i) -> if(i = _at, _new, m))"))).alias("modules"))
