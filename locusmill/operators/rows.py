"""Projections, filters, unions and sorts over whole tables."""

from __future__ import annotations

import atexit
import tempfile
from collections.abc import Iterable, Mapping
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F


def shaped(df: DataFrame, keep: Iterable[str] = (), rename: Mapping[str, str] | None = None, first: Iterable[str] = (), drop: Iterable[str] = ()) -> DataFrame:
    """Selects, drops, renames and moves columns by list; ``first`` goes to the front (new names)."""
    own = [c for c in (list(keep) or df.columns) if c not in set(drop)]
    names = {c: (rename or {}).get(c, c) for c in own}
    back = {v: k for k, v in names.items()}
    front = list(first)
    return df.select(*[F.col(f"`{back[n]}`").alias(n) for n in [*front, *[n for n in names.values() if n not in front]]])


def where_all(df: DataFrame, *conditions: Column) -> DataFrame:
    return df.where(reduce(lambda a, b: a & b, conditions))


def where_any(df: DataFrame, *conditions: Column) -> DataFrame:
    """Rows for which a condition is true; null counts as not true."""
    return df.where(reduce(lambda a, b: a | b, conditions))


def in_keys(df: DataFrame, other: DataFrame, on: list[str]) -> DataFrame:
    return df.join(other.select(*on), on, "left_semi")


def not_in_keys(df: DataFrame, other: DataFrame, on: list[str]) -> DataFrame:
    """Rows whose key isn't in ``other``; rows of null key stay."""
    return df.join(other.select(*on), on, "left_anti")


def cast_all(df: DataFrame, kinds: Mapping[str, str]) -> DataFrame:
    return df.withColumns({c: F.col(c).cast(k) for c, k in kinds.items()})


def complete(df: DataFrame, columns: Iterable[str] | None = None) -> DataFrame:
    return df.na.drop("any", subset=list(columns) if columns else None)


def outside_sd(df: DataFrame, column: str, k: float = 3.0) -> DataFrame:
    """Rows farther than ``k`` standard deviations from the column's mean; the two numbers come from one small aggregate."""
    stats = df.agg(F.avg(column).alias("__m"), F.stddev_samp(column).alias("__s"))
    return df.crossJoin(F.broadcast(stats)).where(F.abs(F.col(column) - F.col("__m")) > k * F.col("__s")).drop("__m", "__s")


def columns_like(df: DataFrame, prefix: str = "", suffix: str = "", complement: bool = False) -> list[str]:
    return [c for c in df.columns if (c.startswith(prefix) and c.endswith(suffix)) != complement]


def shared_dir(spark: SparkSession) -> str:
    """The folder that the driver and all executors see (``spark.checkpoint.dir``).

    Only a local session, which has one machine, may leave it out; it gets a folder of its own. On a cluster that is an error.
    """
    context = spark.sparkContext
    found = spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if not found:
        if not context.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors see")
        found = tempfile.mkdtemp(prefix="locusmill-")
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(found)
    gone_at_exit(spark, context.getCheckpointDir())  # a folder that Spark made for this application alone
    return found.rstrip("/")


_leftovers: dict[str, SparkSession] = {}


def gone_at_exit(spark: SparkSession, path: str) -> str:
    """``path``, which is deleted when the driver's Python ends, if the session is still up then."""
    if not _leftovers:
        atexit.register(_delete_leftovers)
    _leftovers[path] = spark
    return path


def _delete_leftovers() -> None:
    while _leftovers:
        path, spark = _leftovers.popitem()
        if spark.sparkContext._jsc is not None:
            where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
            where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


def settled(df: DataFrame) -> DataFrame:
    """``df`` written to the shared folder as it is partitioned: survives lost executors and holds no cache."""
    shared_dir(df.sparkSession)
    return df.checkpoint()


#: Rows of a partition of ``dealt``, about.
DEALT_ROWS = 250_000


def dealt(df: DataFrame, n_rows: int, *keys: str) -> DataFrame:
    """``df`` by hash of the keys, in as many partitions as ``n_rows`` rows need, so that tasks get more with the table and not larger.

    Groupings and joins on the keys, alone or with other columns, then need no further shuffle.
    """
    return df.repartition(-(-n_rows // DEALT_ROWS) or 1, *keys)


def numbered(df: DataFrame, order: list[str], name: str = "id", within: list[str] | None = None) -> DataFrame:
    """Row numbers 1..n over a total order, within groups if given.

    Over the whole table: the rows are range-partitioned by the order and counted by partition, and only a number for
    each partition meets in one place, so no task has to number all rows.
    """
    if within:
        return df.withColumn(name, F.row_number().over(Window.partitionBy(*within).orderBy(*order)))
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    parts = settled(df.repartitionByRange(n, *order).withColumn("__part", F.spark_partition_id()))
    sizes = parts.groupBy("__part").count().orderBy("__part").collect()
    starts, total = [], 0
    for part, size in sizes:
        starts.append((part, total))
        total += size
    begin = F.broadcast(df.sparkSession.createDataFrame(starts or [(0, 0)], "__part int, __start long"))
    place = F.col("__start") + F.row_number().over(Window.partitionBy("__part").orderBy(*order))
    return parts.join(begin, "__part").withColumn(name, place).drop("__part", "__start")


def tagged_union(tables: Mapping[str, DataFrame], tag: str = "source") -> DataFrame:
    """All rows by column name, with the table's name; missing columns are null."""
    parts = [df.withColumn(tag, F.lit(name)) for name, df in tables.items()]
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)


def side_by_side(lists: Mapping[str, DataFrame]) -> DataFrame:
    """One-column tables of distinct sorted values as the columns of one, padded with null; ``pos`` counts rows from 1."""
    long_ = reduce(DataFrame.unionByName, [numbered(df.toDF("value").distinct(), ["value"], "pos").withColumn("list", F.lit(n)) for n, df in lists.items()])
    return long_.groupBy("pos").pivot("list", list(lists)).agg(F.first("value"))


def best(df: DataFrame, score: str, *ties: str) -> DataFrame:
    """The row of the largest score; ties to the smallest of ``ties``."""
    return df.orderBy(F.desc_nulls_last(score), *ties).limit(1)


def ends(df: DataFrame, order: list[str], k: int) -> DataFrame:
    """The first and the last ``k`` rows of the order, marked in ``part``."""
    head = df.orderBy(*order).limit(k).withColumn("part", F.lit("first"))
    tail = df.orderBy(*[F.desc(c) for c in order]).limit(k).withColumn("part", F.lit("last"))
    return head.unionByName(tail)
