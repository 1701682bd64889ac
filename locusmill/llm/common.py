"""Small helpers that several operators of this subpackage share."""

from __future__ import annotations

import atexit
import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

#: Scratch tables that are still there, in the order they were written: (session, path).
_tables: list[tuple[SparkSession, str]] = []


def shared_dir(spark: SparkSession) -> str:
    """The folder that the driver and all executors see (``spark.checkpoint.dir``).

    Only a local session, which has one machine, may leave it out; it gets a folder of its own. On a cluster that is an error.
    """
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors see")
        found = tempfile.mkdtemp(prefix="locusmill-")
        spark.sparkContext.setCheckpointDir(found)
    return found.rstrip("/")


def saved(df: DataFrame) -> DataFrame:
    """``df`` written as a table in the shared folder and read again: cuts the lineage and survives executors.

    The table goes with ``dropped`` or ``only``, at the latest when the driver's Python ends.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/locusmill-{uuid.uuid4().hex}"
    df.write.parquet(path)
    if not _tables:
        atexit.register(_drop_all)
    _tables.append((spark, path))
    out = spark.read.schema(df.schema).parquet(path)
    out._saved_at = path
    return out


def dropped(df: DataFrame) -> None:
    """Deletes the table of a ``saved`` DataFrame that nothing reads any more."""
    for entry in [t for t in _tables if t[1] == getattr(df, "_saved_at", None)]:
        _tables.remove(entry)
        _drop(*entry)


def only(make: Callable[[], DataFrame]) -> DataFrame:
    """``saved(make())`` without the scratch tables that were written for it."""
    mark = len(_tables)
    out = saved(make())
    for entry in _tables[mark:-1]:
        _drop(*entry)
    del _tables[mark:-1]
    return out


def _drop_all() -> None:
    while _tables:
        _drop(*_tables.pop())


def _drop(spark: SparkSession, path: str) -> None:
    if spark.sparkContext._jsc is not None:  # the session is still up
        where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


#: Rows of an Arrow batch of texts: a worker and the JVM hold a batch as a whole.
TEXT_ROWS = 2_000


def text_batches(df: DataFrame) -> DataFrame:
    """``df``, whose texts go to Python in batches of TEXT_ROWS rows unless the session has a number of its own."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if df.sparkSession.conf.get(name) == "10000":  # Spark's own number
        df.sparkSession.conf.set(name, str(TEXT_ROWS))
    return df


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(df: DataFrame, rows: float = 0, task_rows: int = 500_000) -> int:
    """Partitions for a shuffle: the session's own number, or more if ``rows`` would give a task more than ``task_rows``."""
    return max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-int(rows) // task_rows))


def bytes_of(docs: DataFrame, text: str = "text") -> int:
    """UTF-8 bytes of all texts: what sizes the shuffles of their parts."""
    return docs.agg(F.sum(F.octet_length(text))).first()[0] or 0


def hot_join(rows: DataFrame, side: DataFrame, on: list[str], count: str, total: int) -> DataFrame:
    """Left join of ``rows`` to ``side``, which has a row for each key with the number of ``rows`` that have it.

    Keys with more than a thousandth of all ``total`` rows are fewer than a thousand: they are broadcast and their rows stay where
    they are. All other keys meet in a shuffled join, where none of them is large. Keys must not be null.
    """
    hot = F.broadcast(side.where(F.col(count) * 1000 > total))
    cold = rows.join(hot.select(*on), on, "left_anti").join(side.where(F.col(count) * 1000 <= total), on, "left")
    return rows.join(hot, on).unionByName(cold)


def running(df: DataFrame, order: list[str], **weights: Column) -> DataFrame:
    """``df`` with, under each name, the sum of that weight over all rows that come before in ``order``.

    Rows are range-partitioned; the sums of whole partitions, a row each, are carried over. Rows that tie are in any order.
    """
    placed = saved(df.repartitionByRange(spread(df), *order).withColumn("__part", F.spark_partition_id()).withColumns(weights))
    sums = sorted(placed.groupBy("__part").agg(*[F.sum(w).alias(w) for w in weights]).collect())  # a row for each partition
    carry, total = [], [0] * len(weights)
    for part, *own in sums:
        carry.append((part, *total))
        total = [a + b for a, b in zip(total, own, strict=True)]
    begin = df.sparkSession.createDataFrame(carry or [(0, *total)], "__part int, " + ", ".join(f"__{w} long" for w in weights))
    before = Window.partitionBy("__part").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    added = {w: F.col(f"__{w}") + F.coalesce(F.sum(w).over(before), F.lit(0)) for w in weights}
    return placed.join(F.broadcast(begin), "__part").withColumns(added).drop("__part", *[f"__{w}" for w in weights])


def ascii_lower(col):
    """A-Z to a-z and nothing else. ``lower`` does just that where every character is one byte."""
    return F.when(F.length(col) == F.octet_length(col), F.lower(col)).otherwise(
        F.translate(col, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    )
