"""Window functions, ranks and multiple testing.

Ranks over a whole table (``by`` empty) don't use a window over all rows: values are counted first, and ranks come
from cumulative counts of the distinct values in range-partitioned pieces.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window, functions as F

from locusmill.functions.distributions import normal_quantile
from locusmill.operators.rows import numbered, settled


def carried(df: DataFrame, keys: list, **weights: Column) -> tuple[DataFrame, dict[int, list], list]:
    """(rows with their range partition ``__part``, sums of the weights before each partition, totals).

    A row for each partition comes to the driver. The rows are written once, so that partitions stay as they are.
    """
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    parts = settled(df.repartitionByRange(n, *keys).withColumn("__part", F.spark_partition_id()))
    total: list = [0] * len(weights)
    before = {}
    for part, *sums in sorted(parts.groupBy("__part").agg(*[F.sum(w) for w in weights.values()]).collect()):
        before[part] = total
        total = [a + (b or 0) for a, b in zip(total, sums, strict=True)]
    return parts, before, total


def _starts(df: DataFrame, values: dict[int, list], kinds: dict[str, str]) -> DataFrame:
    rows = [(p, *[float(x) if k == "double" else int(x) for x, k in zip(v, kinds.values(), strict=True)]) for p, v in values.items()]
    return F.broadcast(df.sparkSession.createDataFrame(rows, "__part int, " + ", ".join(f"{n} {k}" for n, k in kinds.items())))


def placed(df: DataFrame, by: list[str], order: list[Column], counted: Column | None = None) -> DataFrame:
    """``df`` with ``__place`` (1..n in its group, in a total order), ``__size`` (the group's rows, or those with ``counted``) and ``__part``.

    Rows are range-partitioned and sorted by (group, order), so a group of any size is spread over partitions; a row's place is its
    number in its partition and the group's rows in the partitions before, from a table with a row for each group and partition.
    """
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    keys = [*[F.col(c) for c in by], *order]
    rows = settled(df.repartitionByRange(n, *keys).sortWithinPartitions(*keys).withColumn("__number", F.monotonically_increasing_id()))
    rows = rows.withColumn("__part", F.shiftright("__number", 33))
    spans = rows.groupBy("__part", *by).agg(F.min("__number").alias("__first"), F.count("*").alias("__n"), F.count("*" if counted is None else counted).alias("__k"))
    group = Window.partitionBy(*by)
    before = F.coalesce(F.sum("__n").over(group.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    own = spans.select(F.col("__part").alias("__p"), *[F.col(c).alias(f"__by{i}") for i, c in enumerate(by)], (before - F.col("__first") + 1).alias("__start"), F.sum("__k").over(group).alias("__size"))
    same = reduce(lambda x, y: x & y, [F.col(c).eqNullSafe(F.col(f"__by{i}")) for i, c in enumerate(by)], F.col("__part") == F.col("__p"))
    return rows.join(own, same).select(*df.columns, "__part", (F.col("__number") + F.col("__start")).alias("__place"), "__size")


def group_quantiles(df: DataFrame, by: list[str], value: Column, wanted: dict[str, float], *more: Column) -> DataFrame:
    """(by..., quantiles by name..., ``more`` aggregates): exact quantiles by linear interpolation; nulls don't count.

    The rows at the two places that each quantile lies between are picked in a grouping that is summed on the map side, so no group is
    gathered, however large.
    """
    rows = placed(df.withColumn("__v", value.cast("double")), by, [F.asc_nulls_last("__v"), F.xxhash64(*df.columns)], F.col("__v"))
    at = {name: (F.col("__size") - 1) * F.lit(float(q)) + 1 for name, q in wanted.items()}
    picked = [F.max(F.when((F.col("__place") == f(h)) & (F.col("__place") <= F.col("__size")), F.col("__v"))).alias(f"__{name}_{end}") for name, h in at.items() for f, end in ((F.floor, "low"), (F.ceil, "high"))]
    found = rows.groupBy(*by).agg(*picked, F.max("__size").alias("__size"), *more)
    between = lambda name, h: F.col(f"__{name}_low") + (h - F.floor(h)) * (F.col(f"__{name}_high") - F.col(f"__{name}_low"))
    return found.withColumns({name: between(name, h) for name, h in at.items()}).drop("__size", *[f"__{name}_{end}" for name in at for end in ("low", "high")])


def average_rank(df: DataFrame, value: str, by: list[str], name: str = "rank", descending: bool = False) -> DataFrame:
    """Rank 1 for the smallest (or largest), ties get the mean of their places; in groups. Rows of null value have no rank and drop out.

    Groups and values of any number of rows are spread over range partitions of (group, value, hash). Over the whole table only
    values that go on over a partition's end, at most one a partition, are settled by a small table; in groups a row for each
    value and partition tells where the value begins and ends.
    """
    df = df.where(F.col(value).isNotNull())
    order = F.desc(value) if descending else F.asc(value)
    if by:
        rows = placed(df, by, [order, F.xxhash64(*df.columns)])
        here = rows.groupBy("__part", *by, value).agg(F.min("__place").alias("__low"), F.max("__place").alias("__high"))
        ties = Window.partitionBy(*by, value)
        mean = (F.min("__low").over(ties) + F.max("__high").over(ties)) / F.lit(2.0)
        ranks = here.select(F.col("__part").alias("__p"), *[F.col(c).alias(f"__by{i}") for i, c in enumerate([*by, value])], mean.alias(name))
        same = reduce(lambda x, y: x & y, [F.col(c).eqNullSafe(F.col(f"__by{i}")) for i, c in enumerate([*by, value])], F.col("__part") == F.col("__p"))
        return rows.join(ranks, same).select(*df.columns, name)
    parts, before, _ = carried(df.withColumn("__h", F.xxhash64(*df.columns)), [order, F.col("__h")], n=F.lit(1))
    counts = parts.groupBy("__part", value).agg(F.count("*").alias("__n"))
    first = counts.join(_starts(df, before, {"__s": "bigint"}), "__part").withColumn("__c", F.col("__s") + F.sum("__n").over(Window.partitionBy("__part").orderBy(order)))
    split = parts.groupBy("__part").agg(F.min(value).alias("a"), F.max(value).alias("b")).collect()
    edges = sorted({v for r in split for v in (r["a"], r["b"]) if v is not None})  # two values a partition at most
    edge = F.col(value).isin(edges)
    whole = first.where(edge).groupBy(value).agg(F.sum("__n").alias("__all"), F.max("__c").alias("__last"))
    ranks = first.join(F.broadcast(whole), value, "left").select("__part", F.col(value).alias("__v"), (F.coalesce("__last", "__c") - (F.coalesce("__all", "__n") - 1) / F.lit(2.0)).alias(name))
    return parts.join(ranks, (parts["__part"] == ranks["__part"]) & parts[value].eqNullSafe(ranks["__v"])).select(*df.columns, name)


def cumulative(df: DataFrame, value: str, order: list[str], name: str, descending: bool = False) -> DataFrame:
    """Running sum over the whole table: range partitions, their sums (one row each), and a window within each."""
    keys = [F.desc(c) if descending else F.asc(c) for c in order]
    parts, before, _ = carried(df, keys, s=F.col(value))
    kind = "double" if df.schema[value].dataType.simpleString() in ("double", "float") else "bigint"
    run = F.sum(value).over(Window.partitionBy("__part").orderBy(*keys).rowsBetween(Window.unboundedPreceding, 0))
    return parts.join(_starts(df, before, {"__start": kind}), "__part").withColumn(name, F.col("__start") + run).drop("__part", "__start")


def top_rows(df: DataFrame, by: list[str], n: int, *order: Column) -> DataFrame:
    """The first ``n`` rows of each group; the order must be total."""
    return df.withColumn("__n", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).where(F.col("__n") <= n).drop("__n")


def sampled_rows(df: DataFrame, by: list[str], key: str, n: int, seed: int) -> DataFrame:
    """``n`` rows of each group in the order of a seeded hash: the same rows on every run and at every parallelism."""
    return top_rows(df, by, n, F.xxhash64(F.col(key), F.lit(seed)), F.col(key))


def with_total(df: DataFrame, name: str = "n_total") -> DataFrame:
    return df.crossJoin(F.broadcast(df.agg(F.count("*").alias(name))))


def qq_uniform(df: DataFrame, p: str, ties: list[str]) -> DataFrame:
    """Each p with the uniform quantile i / (n + 1) that its rank i expects."""
    return _expected(df, [p, *ties])


def qq_normal(df: DataFrame, z: str, ties: list[str]) -> DataFrame:
    """Each value with the standard normal quantile of (i - 1/2) / n that its rank i expects."""
    return _expected(df, [z, *ties], 0.5, 0.0).withColumn("expected", normal_quantile(F.col("expected")))


def _expected(df: DataFrame, order: list[str], less: float = 0.0, more: float = 1.0) -> DataFrame:
    """``expected``: (i - less) / (n + more) of the row's place i; the number of rows comes from the partitions' counts."""
    parts, before, (total,) = carried(df, [F.col(c) for c in order], n=F.lit(1))
    place = F.col("__start") + F.row_number().over(Window.partitionBy("__part").orderBy(*order))
    return parts.join(_starts(df, before, {"__start": "bigint"}), "__part").withColumn("expected", (place - F.lit(less)) / F.lit(float(total) + more)).drop("__part", "__start")


def qq_two_samples(a: DataFrame, b: DataFrame, value: str) -> DataFrame:
    """Quantiles of the smaller sample against the larger one's, interpolated at matching places: (i, x, y), x of ``a``."""
    n_a, n_b = a.count(), b.count()
    small, large, flip = (a, b, False) if n_a <= n_b else (b, a, True)
    n, big = min(n_a, n_b), max(n_a, n_b)
    few = numbered(small.select(value), [value], "i").withColumn("pos", 1 + (F.col("i") - 1) * F.lit((big - 1) / max(n - 1, 1)))
    many = numbered(large.select(F.col(value).alias("v")), ["v"], "r")
    low, high = many.select(F.col("r").alias("lo"), F.col("v").alias("v_lo")), many.select(F.col("r").alias("hi"), F.col("v").alias("v_hi"))
    at = few.withColumns({"lo": F.floor("pos").cast("int"), "hi": F.least(F.floor("pos").cast("int") + 1, F.lit(big))})
    y = F.col("v_lo") + (F.col("pos") - F.col("lo")) * (F.col("v_hi") - F.col("v_lo"))
    out = at.join(low, "lo").join(high, "hi").select("i", F.col(value).alias("x"), y.alias("y"))
    return out.select("i", F.col("y").alias("x"), F.col("x").alias("y")) if flip else out


def bonferroni(df: DataFrame, p: str, alpha: float = 0.05, n_tests: int | None = None) -> DataFrame:
    """``significant``: p below alpha over the number of tests, by default the rows of ``df``."""
    if n_tests is not None:
        return df.withColumn("significant", F.col(p) < F.lit(alpha / n_tests))
    return with_total(df, "__n").withColumn("significant", F.col(p) < F.lit(alpha) / F.col("__n")).drop("__n")


def q_values(df: DataFrame, p: str, pi0: float = 1.0) -> DataFrame:
    """Step-up q-values: the least pi0 * p * m / rank over all p at least as large, at most 1; null p have none.

    One range exchange by (p, hash): a row's place is its partition's start and its place there, and the running minimum from
    the largest p takes the partition's own and, from a table with a row for each partition, the later ones'. Among equal
    p the last place gives the least value, which the running minimum carries to the others, so nothing is joined on p.
    """
    some = df.where(F.col(p).isNotNull()).withColumn("__h", F.xxhash64(*df.columns))
    order = [F.col(p), F.col("__h")]
    parts, before, (m,) = carried(some, order, n=F.lit(1))
    place = F.col("__start") + F.row_number().over(Window.partitionBy("__part").orderBy(*order))
    raw = parts.join(_starts(df, before, {"__start": "bigint"}), "__part").withColumn("__q", F.least(F.lit(1.0), F.lit(pi0 * m) * F.col(p) / place))
    least, later = {}, 1.0
    for part, q in sorted(raw.groupBy("__part").agg(F.min("__q").alias("q")).collect(), reverse=True):
        least[part] = [later]
        later = min(later, q)
    own = F.min("__q").over(Window.partitionBy("__part").orderBy(F.desc(p), F.desc("__h")).rowsBetween(Window.unboundedPreceding, 0))
    found = raw.join(_starts(df, least, {"__after": "double"}), "__part").withColumn("qvalue", F.least(own, "__after")).select(*df.columns, "qvalue")
    return found.unionByName(df.where(F.col(p).isNull()).withColumn("qvalue", F.lit(None).cast("double")))


def share_of_total(df: DataFrame, value: str) -> DataFrame:
    return df.crossJoin(F.broadcast(df.agg(F.sum(value).alias("__t")))).withColumn("percent", F.try_divide(F.col(value) * F.lit(100.0), F.col("__t"))).drop("__t")


def scaled(df: DataFrame, by: list[str], value: str, name: str) -> DataFrame:
    """(value - mean) / sample sd in each group; null if the sd is 0."""
    stats = df.groupBy(*by).agg(F.avg(value).alias("__m"), F.stddev_samp(value).alias("__s"))  # map-side, whatever a group's size
    return df.join(stats, by).withColumn(name, F.try_divide(F.col(value) - F.col("__m"), F.col("__s"))).drop("__m", "__s")


def extreme_rows(df: DataFrame, by: list[str], value: str, largest: bool = True) -> DataFrame:
    """The rows that hold their group's largest (or smallest) value."""
    top = df.groupBy(*by).agg((F.max if largest else F.min)(value).alias("__v"))  # map-side, whatever a group's size
    return df.join(top, by).where(F.col(value) == F.col("__v")).drop("__v")


def genome_position(df: DataFrame, chrom: str, pos: str) -> tuple[DataFrame, DataFrame]:
    """Rows with ``genome_pos`` (the lengths of the chromosomes before are added), and each chromosome's centre.

    A chromosome's length is its largest position. The table of chromosomes is small, as there are few.
    """
    lengths = df.groupBy(chrom).agg(F.max(pos).alias("__len"))
    w = Window.orderBy(chrom).rowsBetween(Window.unboundedPreceding, -1)
    offsets = lengths.select(chrom, F.coalesce(F.sum("__len").over(w), F.lit(0)).alias("__offset"))
    placed = df.join(F.broadcast(offsets), chrom).withColumn("genome_pos", F.col(pos) + F.col("__offset")).drop("__offset")
    return placed, placed.groupBy(chrom).agg(F.avg("genome_pos").alias("centre"))
