"""Helpers shared by the training-data operators."""

from __future__ import annotations

import contextlib
import ctypes
import functools
import tempfile
import uuid
from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

ROWS_PER_SALT = 20_000
LEAST_SALTS = 64
RADIX = 64
HOT_KEYS = 10_000
HOT_ROWS = 1_000
ROWS_PER_FILE = 10_000


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share, as the session names it.

    Only a local master may fall back to a temporary folder; on a cluster a missing setting is an error.
    """
    sc = spark.sparkContext
    named = sc.getConf().get("spark.checkpoint.dir") or sc.getCheckpointDir()
    if named:
        return named.rstrip("/")
    if not sc.master.startswith("local[") and sc.master != "local":
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    own = "file://" + tempfile.mkdtemp(prefix="loomtext-")
    sc.setCheckpointDir(own)
    return own


def scratch(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder."""
    return f"{shared_dir(spark)}/loomtext/{name}-{uuid.uuid4().hex}"


def remove(spark: SparkSession, path: str) -> None:
    """Deletes a file or folder of any store that Spark writes to."""
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


def clean(spark: SparkSession) -> None:
    """Removes every table that operators left in the shared folder; results not yet read are lost with them."""
    remove(spark, f"{shared_dir(spark)}/loomtext")


class Workspace:
    """Tables that one call writes to the shared folder and reads back.

    Lineage ends at each of them, so lost executors cost nothing. ``drop`` removes those that nothing reads
    any more; what a lazy result still needs stays until :func:`clean`. Once ``sized`` by the rows of the
    input, tables of its order are not written by more tasks than those rows are worth.
    """

    def __init__(self, spark: SparkSession, name: str):
        self.spark, self.root, self.paths, self.written, self.tasks = spark, scratch(spark, name), {}, 0, None

    def sized(self, rows: int) -> Workspace:
        self.tasks = max(self.spark.sparkContext.defaultParallelism, rows // ROWS_PER_FILE)
        return self

    def write(self, df: DataFrame, name: str, batch_rows: int | None = None) -> DataFrame:
        """``batch_rows`` bounds the rows of an Arrow batch while this table is made."""
        path, self.written = f"{self.root}/{name}-{self.written}", self.written + 1
        with batches(self.spark, batch_rows):
            (df.coalesce(self.tasks) if self.tasks else df).write.parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        self.paths[id(out)] = (out, path)
        return out

    def drop(self, *tables: DataFrame) -> None:
        for t in tables:
            remove(self.spark, self.paths.pop(id(t))[1])


def materialize(df: DataFrame, name: str, batch_rows: int | None = None) -> DataFrame:
    return Workspace(df.sparkSession, name).write(df, name, batch_rows)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@contextlib.contextmanager
def batches(spark: SparkSession, rows: int | None) -> Iterator[None]:
    """Smaller Arrow batches for the jobs started inside; the session's own setting returns afterwards.

    Whole texts of 10,000 rows make batches of tens of MB on both sides of every Python worker.
    """
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    held = spark.conf.get(key)
    if rows is not None and not 0 < int(held) <= rows:
        spark.conf.set(key, str(rows))
    try:
        yield
    finally:
        spark.conf.set(key, held)


def tidy(run: Callable) -> Callable:
    """For functions of mapInArrow: a worker outlives its tasks, so what a task took is given back when it ends."""

    @functools.wraps(run)
    def wrapped(given: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(given)
        finally:
            pa.default_memory_pool().release_unused()
            with contextlib.suppress(OSError, AttributeError):  # glibc only
                ctypes.CDLL(None).malloc_trim(0)

    return wrapped


def salts_for(rows: int) -> int:
    """As many salts as leave ROWS_PER_SALT rows of one key to a task, however many there are."""
    return max(LEAST_SALTS, -(-rows // ROWS_PER_SALT))


def salt_of(column: Column | str, salts: int) -> Column:
    """A stable salt in [0, salts): recomputed tasks deal the same rows alike."""
    return F.pmod(F.xxhash64(F.lit("salt"), column), F.lit(salts)).cast("int")


def merge_levels(
    rows: DataFrame, key: str, aggs: Callable[[], list[Column]], salts: int, radix: int = RADIX
) -> tuple[DataFrame, DataFrame]:
    """Aggregate (key, _salt) in rounds of ``radix`` until one row per key is left.

    Returns the first level (one row per key and salt) and the last (one row per key). ``aggs`` must be
    closed under repetition: each output column aggregates the column of the same name.
    """
    first = rows.groupBy(key, "_salt").agg(*aggs())
    level, n = first, salts
    while n > 1:
        n = -(-n // radix)
        level = level.withColumn("_salt", F.expr(f"_salt div {radix}") if n > 1 else F.lit(0))
        level = level.groupBy(key, "_salt").agg(*aggs())
    return first, level.drop("_salt")


class Hot:
    """Splits the keys that hold more than a ten-thousandth of a table's rows (and more than HOT_ROWS).

    ``counts`` has the table's rows per key as ``n``. At most HOT_KEYS keys can hold such a share, so the list
    of them, which is broadcast, is bounded whatever the input. Rows of a hot key are dealt to parts, and the
    row that they are to meet is sent to each part.
    """

    def __init__(self, counts: DataFrame, keys: list[str]):
        total, most = counts.agg(F.coalesce(F.sum("n"), F.lit(0)), F.coalesce(F.max("n"), F.lit(0))).first()
        self.keys, each = keys, max(HOT_ROWS, total // HOT_KEYS)
        parts = F.ceil(F.col("n") / each).cast("int").alias("_parts")
        self.hot = counts.filter(F.col("n") > each).select(*keys, parts) if most > each else None

    def deal(self, rows: DataFrame, by: list[str]) -> DataFrame:
        """Adds ``_part``, by the hash of the columns ``by``."""
        if self.hot is None:
            return rows.withColumn("_part", F.lit(0))
        part = F.coalesce(F.pmod(F.xxhash64(*by), "_parts"), F.lit(0)).cast("int")
        return rows.join(F.broadcast(self.hot), self.keys, "left").withColumn("_part", part).drop("_parts")

    def send(self, rows: DataFrame) -> DataFrame:
        """Every row once per part of its key."""
        if self.hot is None:
            return rows.withColumn("_part", F.lit(0))
        every = F.explode(F.sequence(F.lit(0), F.coalesce("_parts", F.lit(1)) - 1))
        return rows.join(F.broadcast(self.hot), self.keys, "left").withColumn("_part", every).drop("_parts")

    def join(self, left: DataFrame, right: DataFrame, by: list[str], how: str = "inner") -> DataFrame:
        """``left.join(right, keys, how)``, hot keys of ``left`` in parts."""
        if self.hot is None:
            return left.join(right, self.keys, how)
        return self.deal(left, by).join(self.send(right), [*self.keys, "_part"], how).drop("_part")
