"""Helpers that the corpus operators share: the shared folder, durable tables, connected components."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``. Where it is unset, as in tests, a new local folder
    serves a local master; on a cluster there is none to fall back on."""
    where = spark.conf.get("spark.checkpoint.dir", None)
    if where:
        return where.rstrip("/")
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        if not context.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        context.setCheckpointDir(tempfile.mkdtemp(prefix="barloom-"))
    return context.getCheckpointDir().rstrip("/")


def fresh_path(spark: SparkSession, name: str) -> str:
    """A new folder below the shared one; it goes when the driver ends."""
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    files = place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    files.mkdirs(place)
    files.deleteOnExit(place)
    return f"{path}/data"


def stash(df: DataFrame, name: str, compression: str | None = None) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: cuts the lineage and survives lost executors."""
    spark = df.sparkSession
    path = fresh_path(spark, name)
    df.write.parquet(path, compression=compression)
    return spark.read.schema(df.schema).parquet(path)


def drop_stash(df: DataFrame) -> None:
    """Delete the files below a stashed table once nothing reads it any more."""
    spark = df.sparkSession
    jvm = spark.sparkContext._jvm
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    for folder in {f.rpartition("/")[0] for f in df.inputFiles()}:
        path = jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(conf).delete(path, True)


SHARE, LEAST = 1000, 64  # a key of more than a thousandth of all rows is dealt to several tasks, of 64 rows at least


def hot_keys(sizes: DataFrame, on: list[str]) -> DataFrame:
    """``on..., _parts`` of the keys with more than a thousandth of all rows, which are less than a thousand; ``sizes`` has ``on..., n``."""
    total = sizes.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    part = max(total / SHARE, LEAST)
    return sizes.where(F.col("n") > part).select(*on, F.ceil(F.col("n") / part).cast("int").alias("_parts"))


def spread_join(left: DataFrame, right: DataFrame, on: list[str], hot: DataFrame, how: str = "inner") -> DataFrame:
    """``left`` joined with ``right`` by ``on`` (never null), where ``hot`` keys of ``left`` are dealt to ``_parts`` tasks.

    ``right`` repeats its rows of a hot key in each part. ``left`` reads files, so its rows keep their parts when a task runs again.
    """
    few = F.broadcast(hot)
    parts = F.coalesce("_parts", F.lit(1))
    dealt = left.withColumn("_row", F.monotonically_increasing_id()).join(few, on, "left").withColumn("_part", F.pmod(F.xxhash64("_row"), parts).cast("int")).drop("_row", "_parts")
    copies = right.join(few, on, "left").withColumn("_part", F.explode(F.sequence(F.lit(0), parts - 1))).drop("_parts")
    return dealt.join(copies, [*on, "_part"], how).drop("_part")


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """Connected components of an edge list, as rows ``(node, label)`` with the smallest node as label.

    Alternating large-star and small-star rounds. Minima are partial aggregations; the joins that follow
    meet a hub's edges by their key, which adaptive execution splits when they outgrow a task. Only a change
    count reaches the driver.
    Null ends and self-loops are ignored; an empty edge list gives an empty result.
    """
    now = stash(
        edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where("u <> v").distinct(), "cc"
    )
    # (u, v) with u > v throughout: v is the node that u hangs from
    for _ in range(60):
        least = now.groupBy("u").agg(F.min("v").alias("m"))
        # small star: every lower neighbour of u, and u, hang from the least of them
        small = (
            now.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v")
            .unionByName(least.select("u", F.col("m").alias("v")))
            .distinct()
        )
        # large star: every higher neighbour of u hangs from the least neighbour of u
        root = small.groupBy("u").agg(F.min("v").alias("m"))
        large = (
            small.join(root.select(F.col("u").alias("v"), F.col("m").alias("up")), "v", "left")
            .select("u", F.coalesce("up", "v").alias("v"))
            .distinct()
        )
        new = stash(large, "cc")
        state = lambda d: d.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        done = state(new) == state(now)
        drop_stash(now)
        now = new
        if done:
            break
    else:
        raise RuntimeError("components did not converge")
    return now.select(F.col("u").alias("node"), F.col("v").alias("label")).unionByName(
        now.select(F.col("v").alias("node"), F.col("v").alias("label"))
    ).distinct()
