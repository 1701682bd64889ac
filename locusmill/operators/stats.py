"""Tests and estimates: statistics from one grouping's sufficient sums, tail probabilities by group."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from locusmill.functions.distributions import t_two_sided
from locusmill.operators.ranks import cumulative, placed
from locusmill.operators.rows import dealt, settled
from locusmill.operators.tiles import row_products


def welch(df: DataFrame, by: list[str], in_class: Column, value: str, p_values: bool = True) -> DataFrame:
    """Welch's t of class against the rest in each group: t, df and (two-sided) p, p_greater. Null for a class of under two rows or no spread."""
    a, b = F.when(in_class, F.col(value)), F.when(~in_class, F.col(value))
    s = df.groupBy(*by).agg(*[f(x).alias(n + k) for x, k in ((a, "1"), (b, "0")) for f, n in ((F.count, "n"), (F.avg, "m"), (F.var_samp, "v"))])
    e1, e0 = F.try_divide(F.col("v1"), F.col("n1").cast("double")), F.try_divide(F.col("v0"), F.col("n0").cast("double"))
    t = F.try_divide(F.col("m1") - F.col("m0"), F.sqrt(e1 + e0))
    dof = F.try_divide((e1 + e0) * (e1 + e0), F.try_divide(e1 * e1, F.col("n1") - 1.0) + F.try_divide(e0 * e0, F.col("n0") - 1.0))
    out = s.select(*by, "n1", "n0", t.alias("t"), dof.alias("df"))
    if not p_values:
        return out
    two = t_two_sided(F.col("t"), F.col("df"))
    return out.withColumn("p", two).withColumn("p_greater", F.when(F.col("t") >= 0, F.col("p") / 2).otherwise(1 - F.col("p") / 2))


def pearson(df: DataFrame, by: list[str], x: str, y: str, p_values: bool = True) -> DataFrame:
    """Pearson's r, n, t and p of each group; null for a constant group."""
    s = df.where(F.col(x).isNotNull() & F.col(y).isNotNull()).groupBy(*by).agg(F.count("*").alias("n"), F.covar_samp(x, y).alias("c"), F.stddev_samp(x).alias("sx"), F.stddev_samp(y).alias("sy"))
    out = s.withColumn("r", F.try_divide("c", F.col("sx") * F.col("sy"))).withColumn("t", F.col("r") * F.sqrt(F.try_divide(F.col("n") - 2.0, 1 - F.col("r") * F.col("r"))))
    out = out.select(*by, "n", "r", "t")
    return out.withColumn("p", t_two_sided(F.col("t"), F.col("n") - 2.0)) if p_values else out


def row_correlations(df: DataFrame, row: str, column: str, value: str) -> DataFrame:
    """(a, b, r): Pearson's r of all pairs of rows a < b of a long matrix, by tiles of rows (``row_products``).

    Rows are scaled by their own mean and deviation; a missing cell counts as the row's mean. Null for a constant row.
    """
    stats = df.groupBy(row).agg(F.avg(value).alias("__m"), F.stddev_samp(value).alias("__s"), F.count(value).alias("__k"))
    scaled = F.coalesce(F.try_divide(F.col(value) - F.col("__m"), F.col("__s")), F.when(F.col(value).isNotNull(), F.lit(0.0)))
    z = df.join(stats, row).select(row, column, scaled.alias("__value"))
    # a row's product with itself is its count less one, or nothing if it is constant
    products = settled(row_products(z, row, column, "__value"))
    own = products.where("a = b")
    sizes = stats.select(F.col(row).alias("a"), F.greatest("__k", F.lit(2)).alias("__k"))
    varied = own.select("a", (F.col("s") > 0).alias("__fine")).join(sizes, "a")
    pairs = products.where("a < b").join(varied, "a").join(varied.select(F.col("a").alias("b"), F.col("__fine").alias("__other")), "b")
    return pairs.select("a", "b", F.when(F.col("__fine") & F.col("__other"), F.col("s") / (F.col("__k") - 1.0)).alias("r"))


LAMBDAS = [round(0.05 * i, 2) for i in range(1, 20)]


def pi0_grid(df: DataFrame, p: str) -> DataFrame:
    """(lambda, n_above, m, pi0) for the grid of lambdas, counted in one pass over the data."""
    counts = df.where(F.col(p).isNotNull()).agg(F.count("*").alias("m"), *[F.count_if(F.col(p) > v).alias(f"c{i}") for i, v in enumerate(LAMBDAS)])
    grid = F.explode(F.array(*[F.struct(F.lit(v).alias("lambda"), F.col(f"c{i}").alias("n_above")) for i, v in enumerate(LAMBDAS)]))
    rows = counts.select("m", grid.alias("g")).select("g.lambda", "g.n_above", "m")
    return rows.withColumn("pi0", F.try_divide(F.col("n_above").cast("double"), F.col("m") * (1 - F.col("lambda"))))


def pi0(df: DataFrame, p: str) -> DataFrame:
    """One row (pi0, pi1): the grid value of least estimated squared error around the grid's tenth percentile."""
    grid = pi0_grid(df, p)
    low = grid.agg(F.percentile("pi0", F.lit(0.1)).alias("__low"))
    w, m, lam = F.col("n_above").cast("double"), F.col("m").cast("double"), F.col("lambda")
    error = w / (m * m * (1 - lam) * (1 - lam)) * (1 - w / m) + (F.col("pi0") - F.col("__low")) * (F.col("pi0") - F.col("__low"))
    best = grid.crossJoin(F.broadcast(low)).withColumn("e", error).agg(F.min_by("pi0", F.struct("e", "lambda")).alias("pi0"))
    return best.select(F.least("pi0", F.lit(1.0)).alias("pi0")).withColumn("pi1", 1 - F.col("pi0"))


def spline_weights(x: list[float], freedom: float) -> np.ndarray:
    """Weights of the values at ``x`` in the last fitted value of their natural cubic smoothing spline with so many degrees of freedom.

    Fitted values are (I + a K) ** -1 y with the roughness matrix K of the natural spline; a is the one whose trace is ``freedom``.
    """
    h = np.diff(x)
    n = len(x)
    q, r = np.zeros((n, n - 2)), np.zeros((n - 2, n - 2))
    for j in range(n - 2):
        q[j : j + 3, j] = 1 / h[j], -1 / h[j] - 1 / h[j + 1], 1 / h[j + 1]
        r[j, j] = (h[j] + h[j + 1]) / 3
        if j:
            r[j, j - 1] = r[j - 1, j] = h[j] / 6
    values, vectors = np.linalg.eigh(q @ np.linalg.solve(r, q.T))
    values = np.where(values < 1e-9 * values.max(), 0.0, values)  # straight lines have no roughness
    low, high = -60.0, 60.0
    for _ in range(200):
        a = (low + high) / 2
        low, high = (a, high) if (1 / (1 + np.exp(a) * values)).sum() > freedom else (low, a)
    return vectors @ ((1 / (1 + np.exp(low) * values)) * vectors[-1])


def pi0_smoothed(df: DataFrame, p: str, freedom: float = 3.0) -> DataFrame:
    """One row (pi0, pi1): the value at the largest lambda of a natural cubic smoothing spline over the grid, between 0 and 1."""
    weights = spline_weights(LAMBDAS, freedom)
    at = F.element_at(F.array([F.lit(float(w)) for w in weights]), F.round(F.col("lambda") / LAMBDAS[0]).cast("int"))
    fit = pi0_grid(df, p).agg(F.sum(F.col("pi0") * at).alias("pi0"))
    return fit.select(F.greatest(F.least(F.col("pi0"), F.lit(1.0)), F.lit(0.0)).alias("pi0")).withColumn("pi1", 1 - F.col("pi0"))


def truncated(df: DataFrame, p: str, most: float) -> DataFrame:
    """p-values up to ``most``, stretched to (0, 1] by their largest."""
    kept = df.where(F.col(p) <= most)
    return kept.crossJoin(F.broadcast(kept.agg(F.max(p).alias("__top")))).withColumn(p, F.try_divide(F.col(p), F.col("__top"))).drop("__top")


def auroc(df: DataFrame, positive: str, score: str) -> DataFrame:
    """One row: auc, DeLong standard error, low and high of the 95 % interval, n1, n0. Null for a single class.

    Placements: a positive's share of negatives below it (ties half), from its rank among all and among its class. Both
    ranks come from cumulative counts of the distinct scores.
    """
    one = df.where(F.col(score).isNotNull() & F.col(positive).isNotNull()).select((F.col(positive) > 0).alias("__y"), F.col(score).alias("s"))
    counts = one.groupBy("s").agg(F.count("*").alias("n"), F.count_if("__y").alias("k"))
    run = cumulative(cumulative(counts, "n", ["s"], "cn"), "k", ["s"], "ck")
    totals = counts.agg(F.sum("k").cast("double").alias("n1"), F.sum(F.col("n") - F.col("k")).cast("double").alias("n0"))
    below_neg = F.col("cn") - F.col("ck") - (F.col("n") - F.col("k")) / 2.0
    above_pos = F.col("n1") - F.col("ck") + F.col("k") / 2.0
    rows = run.crossJoin(F.broadcast(totals)).select("n1", "n0", "k", (F.col("n") - F.col("k")).alias("j"), F.try_divide(below_neg, F.col("n0")).alias("v1"), F.try_divide(above_pos, F.col("n1")).alias("v0"))
    s = rows.agg(F.max("n1").alias("n1"), F.max("n0").alias("n0"), *[f(F.col(w) * F.col(v) * (F.col(v) if sq else F.lit(1.0))).alias(a) for f, w, v, sq, a in ((F.sum, "k", "v1", False, "a1"), (F.sum, "k", "v1", True, "b1"), (F.sum, "j", "v0", False, "a0"), (F.sum, "j", "v0", True, "b0"))])
    var = lambda b, a, n: F.try_divide(F.greatest(F.col(b) - F.try_divide(F.col(a) * F.col(a), F.col(n)), F.lit(0.0)), F.col(n) - 1.0)
    auc = F.try_divide(F.col("a1"), F.col("n1"))
    se = F.sqrt(F.try_divide(var("b1", "a1", "n1"), F.col("n1")) + F.try_divide(var("b0", "a0", "n0"), F.col("n0")))
    z = 1.959963984540054
    return s.select(auc.alias("auc"), se.alias("se"), F.greatest(auc - z * se, F.lit(0.0)).alias("low"), F.least(auc + z * se, F.lit(1.0)).alias("high"), F.col("n1").cast("long").alias("n1"), F.col("n0").cast("long").alias("n0"))


def enrichment_grid(df: DataFrame, group: str, indicators: list[str], value: str, p_values: bool = True) -> DataFrame:
    """Welch tests of every group's value between members and others of every indicator."""
    long_ = df.unpivot([group, value], indicators, "indicator", "member")
    return welch(long_, [group, "indicator"], F.col("member") > 0, value, p_values)


def sign_consistency(df: DataFrame, a: str, b: str, significant: Column) -> DataFrame:
    """Among significant rows, how often two effects have one sign: n, n_same, share."""
    return df.where(significant).agg(F.count("*").alias("n"), F.count_if(F.signum(a) == F.signum(b)).alias("n_same")).withColumn("share", F.try_divide(F.col("n_same").cast("double"), F.col("n")))


def log_factorial(n: Column) -> Column:
    """log(n!) of whole numbers as an expression: exact up to 20, beyond by Stirling's series (off by less than 1e-13 of it)."""
    x = F.greatest(n, F.lit(20)).cast("double")
    series = (x + 0.5) * F.log(x) - x + 0.9189385332046727 + 1 / (12 * x) - 1 / (360 * x * x * x) + 1 / (1260 * x * x * x * x * x)
    return F.when(n <= 20, F.log(F.factorial(F.greatest(F.least(n, F.lit(20)), F.lit(0)).cast("int")).cast("double"))).otherwise(series)


def hypergeometric_tail(x: Column, k: Column, m: Column, n: Column) -> Column:
    """P(at least x of k drawn from n are among m marked ones): the first term, and the others from it by their ratios."""
    x = F.greatest(x, k + m - n, F.lit(0).cast("long"))
    last = F.least(k, m)
    first = log_factorial(m) - log_factorial(x) - log_factorial(m - x) + log_factorial(n - m) - log_factorial(k - x) - log_factorial(n - m - k + x) - log_factorial(n) + log_factorial(k) + log_factorial(n - k)
    steps = F.when(x < last, F.sequence(x, last - 1)).otherwise(F.array().cast("array<bigint>"))
    start = F.struct(F.lit(1.0).alias("term"), F.lit(1.0).alias("total"))

    def further(done: Column, i: Column) -> Column:
        term = done.term * ((m - i).cast("double") * (k - i)) / ((i + 1).cast("double") * (n - m - k + i + 1))
        return F.struct(term.alias("term"), (done.total + term).alias("total"))

    total = F.aggregate(steps, start, further, lambda done: done.total)
    return F.when(x > last, F.lit(0.0)).otherwise(F.least(F.exp(first + F.log(total)), F.lit(1.0)))


def over_representation(query: DataFrame, terms: DataFrame, background: DataFrame) -> DataFrame:
    """Hypergeometric tail of each (query, term): query(query, member), terms(term, member), background(member).

    x hits of k query members in m term members of N. The tail is an expression over these counts: nothing is joined or
    shuffled after them. Rows are dealt by member first, by their number; what follows up to the counts is done where they are.
    """
    n_rows = query.count() + terms.count() + background.count()
    world = dealt(background.select("member"), n_rows, "member")
    q = dealt(query.select("query", "member"), n_rows, "member").join(world, "member", "left_semi").select("query", "member").distinct()
    t = dealt(terms.select("term", "member"), n_rows, "member").join(world, "member", "left_semi").select("term", "member").distinct()
    n_all = F.lit(world.distinct().count()).cast("long")
    k, m = q.groupBy("query").agg(F.count("*").alias("k")), t.groupBy("term").agg(F.count("*").alias("m"))
    tests = m.count()
    x = q.join(t, "member").groupBy("query", "term").agg(F.count("*").alias("x")).join(k, "query").join(m, "term")
    out = x.select("query", "term", "x", "k", "m", hypergeometric_tail(F.col("x"), F.col("k"), F.col("m"), n_all).alias("p"))
    return out.withColumn("p_adjusted", F.least(F.col("p") * tests, F.lit(1.0)))


def compared(a: DataFrame, b: DataFrame, key: str, z: str, p: str, alpha: float) -> DataFrame:
    """Both result sets side by side with who finds the key significant: both, a, b, none. One row a key on each side."""
    left, right = a.select(key, F.col(z).alias("z_a"), F.col(p).alias("p_a")), b.select(key, F.col(z).alias("z_b"), F.col(p).alias("p_b"))
    sa, sb = F.col("p_a") < alpha, F.col("p_b") < alpha
    return left.join(right, key).withColumn("found_by", F.when(sa & sb, "both").when(sa, "a").when(sb, "b").otherwise("none"))


def permuted(df: DataFrame, by: str, x: str, y: str, key: str, seed: int) -> DataFrame:
    """A null data set: in each group, x paired with the y of another row by the order of seeded MD5 sums. Groups may have any size."""
    a = placed(df.select(by, x, key), [by], [F.col(key)]).select(by, x, F.col("__place").alias("__i"))
    b = placed(df.select(by, y, key), [by], [F.md5(F.concat_ws("/", F.col(key), F.lit(seed))), F.col(key)]).select(by, y, F.col("__place").alias("__i"))
    return a.join(b, [by, "__i"]).drop("__i")


def guarded(df: DataFrame, by: list[str], fit: Callable[[pd.DataFrame], dict], fields: str) -> DataFrame:
    """One row a group from ``fit``; if it raises, nulls and the message in ``error``. A group must fit in a task: it is one model's data."""
    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in df.select(*by).schema)
    names = [x.split()[0] for x in fields.split(",")]

    def run(key: tuple, group: pd.DataFrame) -> pd.DataFrame:
        try:
            row = {**fit(group), "error": None}
        except Exception as e:  # noqa: BLE001  a failed model is a result here
            row = {**{n: None for n in names}, "error": f"{type(e).__name__}: {e}"}
        return pd.DataFrame([{**dict(zip(by, key, strict=True)), **row}])

    return df.groupBy(*by).applyInPandas(run, f"{kinds}, {fields}, error string")
