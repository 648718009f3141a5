"""Read-through caches, result tables and an offline page reader."""

from __future__ import annotations

import tempfile
import time
import uuid
from collections.abc import Callable, Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition


def shared_folder(spark: SparkSession) -> str:
    """``spark.checkpoint.dir``; where it is unset, a new local folder for a local master, and an error on a cluster."""
    where = spark.conf.get("spark.checkpoint.dir", None)
    if where:
        return where.rstrip("/")
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        if not context.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        context.setCheckpointDir(tempfile.mkdtemp(prefix="barloom-"))
    return context.getCheckpointDir().rstrip("/")


def fresh(spark: SparkSession, name: str) -> str:
    """A new folder below the shared one; it goes when the driver ends."""
    path = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    files = place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    files.mkdirs(place)
    files.deleteOnExit(place)
    return f"{path}/data"


def exists(spark: SparkSession, path: str) -> bool:
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    return bool(p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p))


def read_through(spark: SparkSession, path: str, make: Callable[[], DataFrame], kind: str = "parquet") -> DataFrame:
    """What is stored at ``path``, after storing what ``make`` gives if nothing is there; parquet is partitioned by symbol."""
    if not exists(spark, f"{path}/_SUCCESS"):
        df = make()
        if kind == "parquet":
            df.write.mode("overwrite").partitionBy("symbol").parquet(path)
        else:
            df.write.mode("overwrite").option("header", True).csv(path)
        schema = df.schema
    else:
        schema = None
    reader = spark.read.schema(schema) if schema is not None else spark.read
    return reader.parquet(path) if kind == "parquet" else reader.option("header", True).csv(path)


def with_enough(bars: DataFrame, least: int) -> DataFrame:
    """Bars of the symbols that have ``least`` bars."""
    enough = bars.groupBy("symbol").count().where(F.col("count") >= least).select("symbol")
    return bars.join(enough, "symbol", "left_semi")


def write_generations(rows: DataFrame, path: str, key: str) -> None:
    """Write the generations in ``rows``; others that are there stay."""
    rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(key).parquet(path)


def write_atomic(spark: SparkSession, path: str, text: str) -> None:
    """Write a small file beside its place, then rename it onto it, on whatever file system the path is on."""
    jvm = spark.sparkContext._jvm
    place, beside = jvm.org.apache.hadoop.fs.Path(path), jvm.org.apache.hadoop.fs.Path(f"{path}.{uuid.uuid4().hex}.tmp")
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(place.toUri(), conf)
    files = place.getFileSystem(conf)
    out = files.create(beside, True)
    try:
        out.write(bytearray(text.encode("utf-8")))
    finally:
        out.close()
    rename = jvm.org.apache.hadoop.fs.Options.Rename
    options = spark.sparkContext._gateway.new_array(rename, 1)
    options[0] = rename.OVERWRITE
    context.rename(beside, place, options)


class PagedBars(DataSource):
    """Bars in pages, a partition each: the shape of an exchange's paginated API, served offline from a formula.

    Options: ``symbol``, ``start`` (epoch seconds), ``bars``, ``seconds``, ``page`` (rows a page), ``version`` (2 gives times in
    milliseconds and prices as text). Pages are asked for at ``rate`` a second at most in a task; one that fails is asked for
    ``retries`` times, each time after twice the wait, ``backoff`` seconds first; one that keeps failing fails its task, which
    Spark runs again. ``fail`` makes the first so many requests of each page fail.
    """

    @classmethod
    def name(cls) -> str:
        return "paged_bars"

    def schema(self) -> str:
        if self.options.get("version") == "2":
            return "symbol string, open_time bigint, open string, high string, low string, close string, volume string"
        return "symbol string, ts bigint, open double, high double, low double, close double, volume double"

    def reader(self, schema) -> DataSourceReader:
        return _PageReader(self.options)


class _PageReader(DataSourceReader):
    def __init__(self, options):
        of = options.get
        self.symbol, self.version = of("symbol", "X"), of("version", "1")
        self.start, self.bars = int(of("start", 0)), int(of("bars", 1000))
        self.seconds, self.page, self.retries = int(of("seconds", 900)), int(of("page", 1000)), int(of("retries", 3))
        self.rate, self.backoff, self.fail = float(of("rate", 10.0)), float(of("backoff", 1.0)), int(of("fail", 0))
        self.asked = 0

    def partitions(self) -> list[InputPartition]:
        return [InputPartition(k) for k in range(0, self.bars, self.page)]

    def fetch(self, first: int) -> list[tuple]:
        self.asked += 1
        if self.asked <= self.fail:
            raise OSError("the page is not there yet")
        out = []
        for i in range(first, min(first + self.page, self.bars)):
            o = 100.0 + (i * 7919 % 1000) / 100
            c = 100.0 + ((i + 1) * 7919 % 1000) / 100
            row = (self.start + i * self.seconds, o, max(o, c) + 0.5, min(o, c) - 0.5, c, float(i % 17))
            out.append((self.symbol, row[0] * 1000, *map(repr, row[1:])) if self.version == "2" else (self.symbol, *row))
        return out

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        for attempt in range(self.retries):
            time.sleep(1 / self.rate)
            try:
                return iter(self.fetch(partition.value))
            except OSError:
                if attempt == self.retries - 1:
                    raise
                time.sleep(self.backoff * 2**attempt)
        return iter(())
