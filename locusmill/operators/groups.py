"""Aggregations and reshaping."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, Window, functions as F

from locusmill.operators.ranks import group_quantiles


def counted(df: DataFrame, *by: str, name: str = "n") -> DataFrame:
    return df.groupBy(*by).agg(F.count("*").alias(name))


def summary(df: DataFrame, by: list[str], value: str) -> DataFrame:
    """n, mean, largest and median absolute value of each group."""
    size = F.abs(F.col(value))
    return group_quantiles(df, by, size, {"median_abs": 0.5}, F.count(value).alias("n"), F.avg(size).alias("mean_abs"), F.max(size).alias("max_abs"))


def six_numbers(df: DataFrame, by: list[str], value: str) -> DataFrame:
    """min, q1, median, mean, q3, max; quantiles by linear interpolation."""
    return group_quantiles(df, by, F.col(value), {"q1": 0.25, "median": 0.5, "q3": 0.75}, F.min(value).alias("min"), F.avg(value).alias("mean"), F.max(value).alias("max"))


def frequencies(df: DataFrame, *by: str) -> DataFrame:
    """Count and share of all rows; the total is one number, joined back."""
    counts = counted(df, *by)
    total = counts.agg(F.sum("n").alias("__t"))
    return counts.crossJoin(F.broadcast(total)).withColumn("share", F.try_divide(F.col("n").cast("double"), F.col("__t"))).drop("__t")


def counts_of_counts(df: DataFrame, *by: str) -> DataFrame:
    return counted(counted(df, *by, name="size"), "size")


def repeated(df: DataFrame, on: list[str]) -> DataFrame:
    """All rows whose key has more than one."""
    return df.join(counted(df, *on).where("n > 1").drop("n"), on, "left_semi")


def wider(df: DataFrame, ids: list[str], name: str, value: str, names: Iterable, fill=None) -> DataFrame:
    """A column for each of the stated ``names``; the largest of several values."""
    out = df.groupBy(*ids).pivot(name, list(names)).agg(F.max(value))
    return out if fill is None else out.na.fill(fill)


def longer(df: DataFrame, ids: list[str], values: list[str], name: str = "name", value: str = "value") -> DataFrame:
    return df.unpivot(ids, values, name, value)


def row_means(df: DataFrame, row: str, value: str) -> DataFrame:
    """Mean over a row's cells, kept long; nulls don't count."""
    return df.groupBy(row).agg(F.avg(value).alias("mean"))


def arg_max(df: DataFrame, row: str, column: str, value: str) -> DataFrame:
    """Each row's largest value and its column, the first column on ties."""
    best = F.max(F.struct(F.col(value).alias("v"), (-F.col(column)).alias("c")))
    return df.where(F.col(value).isNotNull()).groupBy(row).agg(best.alias("b")).select(row, (-F.col("b.c")).alias(column), F.col("b.v").alias(value))


def histogram(df: DataFrame, bin_: Column) -> DataFrame:
    return df.select(bin_.alias("bin")).where("bin is not null").groupBy("bin").agg(F.count("*").alias("n"))


def set_sizes(left: DataFrame, right: DataFrame, on: str) -> DataFrame:
    """Sizes of a two-set Venn diagram: both, left only, right only."""
    sides = left.select(on).distinct().withColumn("__s", F.lit(1)).union(right.select(on).distinct().withColumn("__s", F.lit(2)))
    each = sides.groupBy(on).agg(F.sum("__s").alias("s"))
    return each.agg(F.count_if(F.col("s") == 3).alias("n_both"), F.count_if(F.col("s") == 1).alias("n_left"), F.count_if(F.col("s") == 2).alias("n_right"))


def mean_arrays(df: DataFrame, by: list[str], values: str, width: int) -> DataFrame:
    """Element-wise mean of arrays of one ``width``: a plain sum for each element, so only one array a group is shuffled."""
    sums = [F.avg(F.col(values)[i].cast("double")) for i in range(width)]
    return df.groupBy(*by).agg(F.array(*sums).alias(values))


def checked_matrix(df: DataFrame, values: str, width: int) -> DataFrame:
    """Rows without null arrays; fails if an array has another width."""
    kept = df.where(F.col(values).isNotNull())
    return kept.where(F.assert_true(F.size(values) == width, "a row has another width").isNull())


def against_reference(df: DataFrame, reference: DataFrame, value: str) -> DataFrame:
    """Each row with the one value of a one-row table, and whether it is above it."""
    one = reference.select(F.col(value).alias("reference"))
    return df.crossJoin(F.broadcast(one.limit(1))).withColumn("above", F.col(value) > F.col("reference"))


def transposed(df: DataFrame, row: str, column: str, rows: DataFrame | None = None, columns: DataFrame | None = None) -> DataFrame:
    """A long matrix with rows and columns exchanged, cut to the given keys."""
    out = df if rows is None else df.join(rows.select(row), row, "left_semi")
    out = out if columns is None else out.join(columns.select(column), column, "left_semi")
    names = {row: column, column: row}
    return out.select(*[F.col(c).alias(names.get(c, c)) for c in out.columns])


def list_cell(df: DataFrame, by: list[str], value: str, separator: str = ",") -> DataFrame:
    """Sorted values of each group in one cell; for groups whose size is bounded."""
    return df.groupBy(*by).agg(F.array_join(F.array_sort(F.collect_list(F.col(value).cast("string"))), separator).alias(value))


def list_rows(df: DataFrame, value: str, pattern: str = ",") -> DataFrame:
    return df.withColumn(value, F.explode(F.split(value, pattern)))
