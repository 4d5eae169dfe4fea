"""What the corpus operators share: the contract's text classes, scratch tables, Arrow access."""

from __future__ import annotations

import atexit
import gc
import shutil
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Space and \t \n \v \f \r, the only characters the contracts treat as white space.
WS_CHARS = " \t\n\x0b\x0c\r"
WS_RUN = "[\\x20\\x09-\\x0D]+"
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
LOWER = UPPER.lower()


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def ascii_lower(c: Column) -> Column:
    """Lower-cases A-Z only. lower() is byte-wise for pure ASCII; other texts take the slower exact way."""
    return F.when(F.length(c) == F.octet_length(c), F.lower(c)).otherwise(F.translate(c, UPPER, LOWER))


def let(value: Column, body) -> Column:
    """Binds a value once for use inside lambdas, where Spark would evaluate it again for each element."""
    return F.transform(F.array(value), body)[0]


def free_name(df: DataFrame, name: str) -> str:
    """The name, with underscores after it while df has such a column: outputs never hide or clash with the caller's columns."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


#: Rows of one or two numbers that may be broadcast (some 50 MB); they are counted first.
BROADCAST_ROWS = 1_000_000


def if_small(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """df (a saved table, so the count is cheap), to be broadcast if it has `rows` rows at most; joins with a longer one shuffle."""
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df


def hot_join(rows: DataFrame, values: DataFrame, keys: list[str], share: int, how: str = "inner", most: int = BROADCAST_ROWS) -> DataFrame:
    """rows joined on keys with a saved table of keys, __c (how many rows have them) and further columns.

    The rows of keys that more than `share` rows have don't meet in one task: these entries are broadcast, unless there
    are more than `most` of them, when adaptive execution splits what is skewed.
    """
    hot = values.filter(F.col("__c") > share)
    if hot.isEmpty() or hot.limit(most + 1).count() > most:
        return rows.join(values.drop("__c"), keys, how)
    new = [c for c in values.columns if c not in (*keys, "__c")]
    marked = hot.select(*keys, F.struct(*new).alias("__hot"))
    first = rows.join(F.broadcast(marked), keys, "left")
    there = first.filter("__hot is not null").select(*rows.columns, "__hot.*")
    rest = first.filter("__hot is null").drop("__hot").join(values.filter(F.col("__c") <= share).drop("__c"), keys, how)
    return there.unionByName(rest.select(*rows.columns, *new))


@contextmanager
def small_batches(spark: SparkSession, rows: int) -> Iterator[None]:
    """Jobs inside send at most `rows` rows at once to Python, which bounds the memory of long rows on both sides."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    spark.conf.set(name, str(rows))
    try:
        yield
    finally:
        spark.conf.set(name, before)


class Scratch:
    """Tables in the folder that all executors share (spark.checkpoint.dir).

    Where no folder is set a temporary one is taken in local mode; on a cluster that is an error, as each machine
    would write to a disk of its own. A written table cuts the lineage: a lost executor costs one stage, not the whole job.
    Tables that a result is read from stay until the application ends; drop() takes the others.
    """

    def __init__(self, spark: SparkSession, label: str):
        self.spark = spark
        base = spark.conf.get("spark.checkpoint.dir", None)
        if not base:
            base = spark.sparkContext.getCheckpointDir()
        if not base:
            if not spark.sparkContext.master.startswith(("local[", "local*")) and spark.sparkContext.master != "local":
                raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
            own = tempfile.mkdtemp(prefix="helixframe-")
            atexit.register(shutil.rmtree, own, ignore_errors=True)
            base = f"file://{own}"
            spark.sparkContext.setCheckpointDir(base)
        self.root = f"{base.rstrip('/')}/{label}-{uuid.uuid4().hex}"

    def path(self, name: str) -> str:
        return f"{self.root}/{name}"

    def save(self, df: DataFrame, name: str, partition_by: str | None = None) -> DataFrame:
        writer = df.write.mode("overwrite")
        if partition_by:
            writer = writer.partitionBy(partition_by)
        # Shuffle files of finished jobs go when the driver's JVM collects their plans.
        gc.collect()
        self.spark._jvm.System.gc()
        writer.parquet(self.path(name))
        return self.spark.read.schema(df.schema).parquet(self.path(name))

    def drop(self, name: str) -> None:
        jvm = self.spark._jvm
        path = jvm.org.apache.hadoop.fs.Path(self.path(name))
        path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)
