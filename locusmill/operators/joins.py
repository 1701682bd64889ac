"""Equality joins and what goes with them. Strategy is left to Spark, apart from sides of a bounded size."""

from __future__ import annotations

from collections.abc import Mapping
from functools import reduce

from pyspark.sql import DataFrame, functions as F


def joined(left: DataFrame, right: DataFrame, on: Mapping[str, str], how: str = "inner", suffixes: tuple[str, str] = ("_x", "_y")) -> DataFrame:
    """Join on differently named keys; the left key stays, and other names that both sides have get suffixes."""
    clash = (set(left.columns) - set(on)) & (set(right.columns) - set(on.values()))
    a = left.withColumnsRenamed({c: c + suffixes[0] for c in clash})
    b = right.withColumnsRenamed({c: c + suffixes[1] for c in clash} | {v: f"__{k}" for k, v in on.items()})
    both = a.join(b, reduce(lambda x, y: x & y, [a[k] == b[f"__{k}"] for k in on]), how)
    if how in ("full", "right"):
        both = both.withColumns({k: F.coalesce(a[k], b[f"__{k}"]) for k in on})
    return both.drop(*[f"__{k}" for k in on])


def first_match(left: DataFrame, right: DataFrame, on: list[str], order: list[str]) -> DataFrame:
    """Left join to the first row of each key on the right, in ``order``."""
    rest = [c for c in right.columns if c not in on]
    least = right.groupBy(*on).agg(F.min_by(F.struct(*rest), F.struct(*order)).alias("__r"))  # map-side, whatever a key's size
    return left.join(least.select(*on, "__r.*"), on, "left")


def all_joined(tables: Mapping[str, DataFrame], key: str, value: str) -> DataFrame:
    """Full join of many (key, value) tables, a column for each: one grouping over their union instead of many joins."""
    long_ = reduce(DataFrame.unionByName, [df.select(key, F.col(value).alias("__v")).withColumn("__t", F.lit(n)) for n, df in tables.items()])
    return long_.groupBy(key).agg(*[F.max(F.when(F.col("__t") == n, F.col("__v"))).alias(n) for n in tables])


def provenance(left: DataFrame, right: DataFrame, on: list[str], names: tuple[str, str, str] = ("both", "left", "right")) -> DataFrame:
    """Each distinct key and whether it is on both sides, the left or the right only."""
    sides = left.select(*on).distinct().withColumn("__s", F.lit(1)).unionByName(right.select(*on).distinct().withColumn("__s", F.lit(2)))
    label = F.element_at(F.array(*[F.lit(names[i]) for i in (1, 2, 0)]), F.sum("__s").cast("int"))
    return sides.groupBy(*on).agg(label.alias("provenance"))


def exploding(left: DataFrame, right: DataFrame, on: list[str], limit: int) -> DataFrame:
    """Many-to-many join that fails if a key would make more than ``limit`` rows."""
    sizes = left.groupBy(*on).agg(F.count("*").alias("__a")).join(right.groupBy(*on).agg(F.count("*").alias("__b")), on)
    fine = sizes.where(F.assert_true(F.col("__a") * F.col("__b") <= limit, "a key makes too many rows").isNull()).select(*on)
    return left.join(fine, on).join(right, on)


def neighbours(df: DataFrame, by: list[str], at: str, width: int) -> DataFrame:
    """(by..., a, b): places of all pairs of rows of one group with a <= b and b - a < ``width``; a row pairs with itself.

    Pairs meet by an equality key: the bin of ``width`` places that b is in, which is a's own or the next. So the work follows the pairs, not
    the group's square. Rows with a null group or place have no pairs.
    """
    bin_ = F.floor(F.col(at) / width)
    low = df.select(*by, F.col(at).alias("a"), F.explode(F.array(bin_, bin_ + 1)).alias("__bin"))
    high = df.select(*by, F.col(at).alias("b"), bin_.alias("__bin"))
    return low.join(high, [*by, "__bin"]).where((F.col("a") <= F.col("b")) & (F.col("b") - F.col("a") < width)).drop("__bin")


def common_keys(tables: list[DataFrame], on: list[str]) -> DataFrame:
    """The keys that all tables have."""
    long_ = reduce(DataFrame.union, [df.select(*on).distinct() for df in tables])
    return long_.groupBy(*on).count().where(F.col("count") == len(tables)).drop("count")


def flagged(df: DataFrame, other: DataFrame, on: list[str], name: str) -> DataFrame:
    """Every row with a boolean: is its key in ``other``? Null keys are not."""
    return df.join(other.select(*on).distinct().withColumn(name, F.lit(True)), on, "left").withColumn(name, F.coalesce(name, F.lit(False)))


def grid(*tables: DataFrame) -> DataFrame:
    """All combinations of small parameter tables."""
    return reduce(DataFrame.crossJoin, tables)


def formatted_model(cells: DataFrame, feature, annotation: DataFrame) -> DataFrame:
    """(locus, score, annotation...) of one model's cells(locus, feature, score); loci without annotation(locus, ...) keep nulls."""
    return cells.where(F.col("feature") == feature).select("locus", "score").join(annotation, "locus", "left")
