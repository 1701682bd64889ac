"""Bins by running sums, intervals of all lengths in one join, tails and splines, each against a plain reading."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from locusmill.operators import intervals as I, stats as S


@pytest.mark.parametrize("parts", [1, 3, 11])
def test_bin_sums_equal_plain_sums(spark, parts):
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", parts)
    try:
        rng = random.Random(parts)
        bins = [(c, b, [float(rng.randint(-9, 9)), float(b)] if rng.random() < 0.9 else None) for c in ("a", "b", "c") for b in range(-5, 60) for _ in range(rng.choice([0, 1, 1, 2]))]
        loci = [(i, rng.choice("abcd"), rng.randint(-20, 70), rng.randint(-20, 70)) for i in range(150)] + [(900, "a", -100, 100), (901, "b", 3, 4), (902, None, 0, 9), (903, "c", None, 4), (None, "c", 0, 40)]
        left = spark.createDataFrame(loci, "id long, chrom string, low long, high long").repartition(2)
        right = spark.createDataFrame(bins, "chrom string, bin int, v array<double>").repartition(3)
        want = {}
        for i, c, low, high in loci:
            own = [v for d, b, v in bins if d == c and v is not None and low is not None and high is not None and low <= b < high]
            if own:
                want[i] = (len(own), [sum(x) for x in zip(*own, strict=True)])
        got = {r.id: (r.n, list(r.sums)) for r in I.bin_sums(left, right, ["id"], "v").collect()}
        assert got.keys() == want.keys()
        assert all(got[k][0] == want[k][0] and np.allclose(got[k][1], want[k][1]) for k in want)
        means = {r.id: list(r.v) for r in I.bin_means(left, right, ["id"], "v").collect()}
        assert np.allclose(means[900], np.array(want[900][1]) / want[900][0])
        assert I.bin_sums(left.limit(0), right, ["id"], "v").count() == 0 and I.bin_sums(left, right.limit(0), ["id"], "v").count() == 0
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)


@pytest.mark.parametrize("gap,width", [(-1, None), (0, None), (1000, None), (-1, 7), (25, 100_000)])
def test_intervals_of_all_lengths_in_one_join(spark, gap, width):
    rng = random.Random(gap)

    def some(n):
        out = []
        for i in range(n):
            size = int(10 ** rng.uniform(0, 8.3))
            start = rng.randint(-1000, 200_000_000)
            out.append((i, rng.choice(["1", "2", None]) if rng.random() < 0.9 else "3", start, start + size - 1))
        return out + [(n, "1", 5, 5), (n + 1, "1", 0, 250_000_000), (n + 2, "1", 9, 3), (n + 3, "2", None, 4)]

    a, b = some(120), some(140)
    left = spark.createDataFrame(a, "i int, chrom string, start long, stop long")
    right = spark.createDataFrame(b, "j int, chrom string, r_start long, r_stop long")
    want = sorted((i, j) for i, c, s, e in a for j, d, t, f in b if c is not None and c == d and None not in (s, t) and s <= e and t <= f and max(s, t) - min(e, f) - 1 <= gap)
    got = I.overlap_join(left, right, width, max_gap=gap)
    assert got.columns == ["chrom", "i", "start", "stop", "j", "r_start", "r_stop"]
    assert sorted((r.i, r.j) for r in got.select("i", "j").collect()) == want and len(want) > 100
    assert I.overlap_join(left.limit(0), right).count() == 0 and I.overlap_join(left, right.limit(0)).count() == 0


def test_rows_of_an_interval_stay_few(spark):
    """One row or two for each level, however long the interval is."""
    wide = spark.createDataFrame([("1", 1, 3_000_000_000)], "chrom string, start long, stop long")
    points = spark.range(1000).select(F.lit("1").alias("chrom"), (F.col("id") * 2_000_000).alias("r_start"), (F.col("id") * 2_000_000).alias("r_stop"))
    assert I.usual_length(points, "r_start", "r_stop") == 1
    assert I.overlap_join(wide, points).count() == 999


def tail(x, k, m, n):
    return sum(math.comb(m, i) * math.comb(n - m, k - i) for i in range(max(x, 0), min(k, m) + 1) if k - i <= n - m) / math.comb(n, k)


def test_hypergeometric_tails(spark):
    rng = random.Random(8)
    rows = [(0, 0, 0, 5), (0, 5, 5, 5), (5, 5, 5, 5), (3, 2, 9, 20), (1, 1, 1, 10**6)]
    for _ in range(300):
        n = rng.choice([3, 12, 60, 900, 20_000])
        k, m = rng.randint(0, n), rng.randint(0, n)
        rows.append((rng.randint(0, min(k, m)), k, m, n) if n < 5000 else (rng.randint(0, 40), rng.randint(40, 300), rng.randint(40, 300), n))
    df = spark.createDataFrame(rows, "x long, k long, m long, n long")
    for r in df.withColumn("p", S.hypergeometric_tail(*[F.col(c) for c in "xkmn"])).collect():
        want = tail(r.x, r.k, r.m, r.n)
        assert math.isclose(r.p, want, rel_tol=1e-9, abs_tol=1e-290), r
    big = df.limit(1).select(S.log_factorial(F.lit(10**12).cast("long")).alias("l"), S.log_factorial(F.lit(21).cast("long")).alias("s")).first()
    assert math.isclose(big.l, math.lgamma(10**12 + 1), rel_tol=1e-13) and math.isclose(big.s, math.lgamma(22), rel_tol=1e-13)


def test_over_representation_plan_ends_with_the_counts(spark):
    q = spark.createDataFrame([("q", i) for i in range(6)], "query string, member int")
    t = spark.createDataFrame([("t", i) for i in range(3, 12)], "term string, member int")
    plan = S.over_representation(q, t, spark.range(20).select(F.col("id").cast("int").alias("member")))._jdf.queryExecution().optimizedPlan().toString()
    assert "Generate" not in plan and "Window" not in plan


def test_spline_equals_penalised_least_squares():
    """The weights against a spline of truncated cubes, fitted by least squares with the integral of its squared second derivative."""
    x = np.array(S.LAMBDAS)
    n, knots = len(x), np.array(S.LAMBDAS)
    d = lambda v, k: (np.maximum(v - knots[k], 0) ** 3 - np.maximum(v - knots[-1], 0) ** 3) / (knots[-1] - knots[k])
    basis = lambda v: np.column_stack([np.ones_like(v), v, *[d(v, k) - d(v, n - 2) for k in range(n - 2)]])
    bend = lambda v: np.column_stack([np.zeros_like(v), np.zeros_like(v), *[6 * ((np.maximum(v - knots[k], 0) - np.maximum(v - knots[-1], 0)) / (knots[-1] - knots[k]) - (np.maximum(v - knots[n - 2], 0) - np.maximum(v - knots[-1], 0)) / (knots[-1] - knots[n - 2])) for k in range(n - 2)]])
    edges = np.linspace(x[0], x[-1], 18 * 2000 + 1)
    fine = (edges[1:] + edges[:-1]) / 2
    b, g = basis(x), bend(fine)
    rough = g.T @ g * (edges[1] - edges[0])
    smooth = lambda a: b @ np.linalg.solve(b.T @ b + a * rough, b.T)
    low, high = 1e-12, 1e3
    for _ in range(200):
        a = math.sqrt(low * high)
        low, high = (a, high) if np.trace(smooth(a)) > 3 else (low, a)
    assert np.allclose(S.spline_weights(S.LAMBDAS, 3.0), smooth(low)[-1], atol=1e-4)
    line = 2 - 0.7 * x
    assert math.isclose(S.spline_weights(S.LAMBDAS, 3.0) @ line, line[-1], rel_tol=1e-9)


def test_smoothed_pi0(spark):
    rng = np.random.default_rng(9)
    p = np.append(rng.random(4000), rng.beta(0.2, 6, 1000))
    got = S.pi0_smoothed(spark.createDataFrame([(float(v),) for v in p] + [(None,)], "p double"), "p").first()
    assert abs(got.pi0 - 0.8) < 0.06 and math.isclose(got.pi0 + got.pi1, 1)
