import math
import random

import numpy as np
import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from locusmill.functions import columns as C
from locusmill.functions.distributions import beta_fraction, normal_quantile, normal_two_sided, t_two_sided
from locusmill.operators import models as M, programs as P, ranks as W, rows as R, stats as S


def test_student_tail_at_known_quantiles(spark):
    rows = spark.createDataFrame([(2.228139, 10.0, 0.05), (12.7062, 1.0, 0.05), (1.959964, 1e6, 0.05), (0.0, 5.0, 1.0), (-4.032143, 5.0, 0.01), (None, 3.0, None)], "t double, df double, want double")
    for r in rows.withColumn("p", t_two_sided("t", "df")).collect():
        assert (r.p is None) if r.want is None else math.isclose(r.p, r.want, rel_tol=2e-5)
    assert abs(beta_fraction(np.array([2.0]), np.array([3.0]), np.array([0.4]))[0] - 0.5248) < 1e-9


def test_normal_tail(spark):
    rows = spark.createDataFrame([(1.959964,), (0.0,), (None,)], "z double").select(normal_two_sided("z").alias("p")).collect()
    assert math.isclose(rows[0].p, 0.05, rel_tol=1e-6) and rows[1].p == 1.0 and rows[2].p is None


def test_cauchy_combination(spark):
    def acat(*p):
        return spark.createDataFrame([(x,) for x in p], "p double").agg(C.p_combined(F.col("p"))).first()[0]

    assert math.isclose(acat(0.03, 0.03, 0.03), 0.03, rel_tol=1e-9)
    assert acat(0.0, 0.5) == 0.0
    assert math.isclose(acat(1e-300), 1e-300, rel_tol=1e-6)
    assert 0.5 < acat(1.0, 0.5) <= 1.0
    assert acat(None) is None
    assert math.isclose(acat(0.2, None), 0.2, rel_tol=1e-9)


def test_constant_groups_give_null(spark):
    df = spark.createDataFrame([("a", 1.0, 2.0), ("a", 1.0, 3.0), ("b", 1.0, 2.0), ("b", 2.0, 4.0), ("b", 3.0, 7.0)], "g string, x double, y double")
    got = {r.g: r.r for r in S.pearson(df, ["g"], "x", "y").collect()}
    assert got["a"] is None and math.isclose(got["b"], np.corrcoef([1, 2, 3], [2, 4, 7])[0, 1])
    one = S.welch(df, ["g"], F.col("y") > 3, "x").where("g = 'a'").first()
    assert one.t is None and one.p is None


def test_auroc_brute_force_and_single_class(spark):
    rng = random.Random(2)
    rows = [(rng.randint(0, 1), rng.randint(0, 12) / 3) for _ in range(150)]
    got = S.auroc(spark.createDataFrame(rows, "y int, s double"), "y", "s").first()
    pos, neg = [s for y, s in rows if y], [s for y, s in rows if not y]
    kernel = np.array([[1.0 if p > n else 0.5 if p == n else 0.0 for n in neg] for p in pos])
    assert math.isclose(got.auc, kernel.mean(), rel_tol=1e-12)
    se = math.sqrt(kernel.mean(axis=1).var(ddof=1) / len(pos) + kernel.mean(axis=0).var(ddof=1) / len(neg))
    assert math.isclose(got.se, se, rel_tol=1e-9)
    assert S.auroc(spark.createDataFrame([(1, 2.0), (1, 3.0)], "y int, s double"), "y", "s").first().auc is None


def test_q_values_are_monotone(spark):
    rng = random.Random(3)
    df = spark.createDataFrame([(i, round(rng.random() ** 2, 3)) for i in range(200)], "i int, p double")
    rows = sorted(W.q_values(df, "p", 0.7).collect(), key=lambda r: r.p)
    assert all(a.qvalue <= b.qvalue for a, b in zip(rows, rows[1:], strict=False))
    assert all(r.qvalue >= 0.7 * r.p - 1e-12 and r.qvalue <= 1 for r in rows)


def test_tied_ranks_whole_table(spark):
    df = spark.createDataFrame([(1, 5.0), (2, 5.0), (3, 1.0), (4, 9.0)], "i int, x double")
    assert {r.i: r["rank"] for r in W.average_rank(df, "x", []).collect()} == {3: 1.0, 1: 2.5, 2: 2.5, 4: 4.0}


def test_row_numbers_are_gapless(spark):
    df = spark.range(1000).withColumn("k", F.pmod(F.xxhash64("id"), F.lit(50)))
    rows = R.numbered(df, ["k", "id"], "n").orderBy("n").collect()
    assert [r.n for r in rows] == list(range(1, 1001))
    assert rows == sorted(rows, key=lambda r: (r.k, r.id))
    assert R.numbered(df.limit(0), ["k"], "n").count() == 0


def test_probability_rejects_null(spark):
    with pytest.raises(PySparkException):
        spark.createDataFrame([(None,)], "x double").select(C.probability(F.col("x"))).collect()


def test_finite(spark):
    df = spark.createDataFrame([(1.0,), (float("inf"),), (float("nan"),), (None,)], "x double")
    assert [r.x for r in df.where(C.finite(F.col("x"))).collect()] == [1.0]


def test_over_representation_brute_force(spark):
    q = spark.createDataFrame([("q", i) for i in range(6)], "query string, member int")
    t = spark.createDataFrame([("t", i) for i in range(3, 12)], "term string, member int")
    bg = spark.createDataFrame([(i,) for i in range(20)], "member int")
    r = S.over_representation(q, t, bg).first()
    want = sum(math.comb(9, i) * math.comb(11, 6 - i) for i in range(3, 7)) / math.comb(20, 6)
    assert (r.x, r.k, r.m) == (3, 6, 9) and math.isclose(r.p, want, rel_tol=1e-9)


def test_heritability_recovers_simulation(spark):
    rng = np.random.default_rng(1)
    n, m = 300, 600
    x = rng.standard_normal((n, m))
    k = x @ x.T / m
    grm = spark.createDataFrame([(str(i), str(j), float(k[i, j])) for i in range(n) for j in range(i, n)], "id1 string, id2 string, value double")
    rows = [(f"p{r}", str(i), float(v)) for r in range(8) for i, v in enumerate(x @ rng.standard_normal(m) * math.sqrt(0.5 / m) + rng.standard_normal(n) * math.sqrt(0.5))]
    rows += [("flat", str(i), 1.0) for i in range(n)]
    got = {r.phenotype: r for r in M.heritability(spark.createDataFrame(rows, "phenotype string, id string, y double"), grm, ["phenotype"]).collect()}
    assert got["flat"].h2 is None and got["flat"].error
    assert abs(np.mean([got[f"p{r}"].h2 for r in range(8)]) - 0.5) < 0.15


def test_medoids_find_the_groups(spark):
    rng = np.random.default_rng(2)
    rows = [(f"p{c}_{i}", (np.eye(3)[c] * 10 + rng.random(3)).tolist()) for c in range(3) for i in range(7)]
    vectors = spark.createDataFrame(rows, "program string, vector array<double>")
    scores = {r.k: r.silhouette for r in P.choose_k(vectors, [2, 3, 4, 5]).collect()}
    assert max(scores, key=scores.get) == 3 and scores[3] > 0.8
    got = {r.program: r.cluster for r in P.clustered(vectors, 3).collect()}
    assert all(len({got[f"p{c}_{i}"] for i in range(7)}) == 1 for c in range(3)) and len(set(got.values())) == 3


def test_snp_models_from_sums_equal_nets_on_rows(spark):
    rng = np.random.default_rng(6)
    x = rng.integers(0, 3, (200, 5)).astype(float)
    y = x[:, 1] * 0.8 - x[:, 4] * 0.3 + rng.standard_normal(200) * 0.3
    z = (x - x.mean(0)) / x.std(0)
    w = M.elastic_net(z, y, 0.05)
    assert np.allclose(M.gram_net(z.T @ z / 200, z.T @ (y - y.mean()) / 200, 0.05), w, atol=1e-4)
    rows = [("a", i, float(y[i]), v, int(x[i, v])) for i in range(200) for v in range(5)] + [("flat", i, 1.0, 0, i % 3) for i in range(50)]
    got = {(r.locus, r.variant): r for r in M.snp_models(spark.createDataFrame(rows, "locus string, sample long, y double, variant int, dosage int"), lambdas=(0.05,)).collect()}
    assert np.allclose([got["a", v].weight for v in range(5)], w / x.std(0), atol=1e-3) and got["a", 0].cv_r2 > 0.8
    assert got["flat", 0].weight == 0 and got["flat", 0].cv_r2 is None or math.isnan(got["flat", 0].cv_r2)


@pytest.mark.parametrize("parts", [2, 7])
def test_ranks_and_q_values_with_a_hot_value(spark, parts):
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", parts)
    try:
        rng = np.random.default_rng(3)
        p = np.where(rng.random(300) < 0.4, 1.0, np.round(rng.random(300), 2))
        df = spark.createDataFrame([(i, float(v)) for i, v in enumerate(p)] + [(999, None)], "id long, p double")
        ranks = {r.id: r["rank"] for r in W.average_rank(df, "p", []).collect()}
        want = {i: (p < v).sum() + ((p == v).sum() + 1) / 2 for i, v in enumerate(p)}
        assert ranks == want
        down = {r.id: r["rank"] for r in W.average_rank(df, "p", [], descending=True).collect()}
        assert down == {i: 301 - v for i, v in want.items()}
        order = np.argsort(p, kind="stable")
        q = np.minimum.accumulate((np.minimum(1, p[order] * 300 / np.arange(1, 301)))[::-1])[::-1]
        for v in set(p):
            q[p[order] == v] = q[p[order] == v].min()
        got = {r.id: r.qvalue for r in W.q_values(df, "p").collect()}
        assert got.pop(999) is None and all(abs(got[int(i)] - x) < 1e-12 for i, x in zip(order, q, strict=True))
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)


def test_qq_against_the_normal(spark):
    df = spark.createDataFrame([(i, float(i)) for i in range(9)], "id long, z double")
    got = [r.expected for r in W.qq_normal(df, "z", ["id"]).orderBy("id").collect()]
    assert abs(got[4]) < 1e-12 and abs(got[0] + got[8]) < 1e-9 and abs(got[8] - 1.5932188) < 1e-6


def test_elastic_net_recovers_sparse_weights():
    rng = np.random.default_rng(4)
    x = rng.standard_normal((400, 20))
    w = M.elastic_net((x - x.mean(0)) / x.std(0), x[:, 3] * 2 - x[:, 7], 0.05)
    assert abs(w[3]) > 1.5 and w[7] < -0.7 and np.abs(np.delete(w, [3, 7])).max() < 0.1


def test_unknown_strategies_fail(spark):
    with pytest.raises(ValueError):
        P.normalised(spark.createDataFrame([], "iter long, kind string, key string, k int, value double"), "l3")


def test_guarded_fit_keeps_failures(spark):
    df = spark.createDataFrame([("a", 1.0), ("b", -1.0)], "g string, x double")

    def fit(group):
        return {"y": math.sqrt(group.x.iloc[0])}

    got = {r.g: (r.y, r.error) for r in S.guarded(df, ["g"], fit, "y double").collect()}
    assert got["a"] == (1.0, None) and got["b"][0] is None and "ValueError" in got["b"][1]


def test_normal_quantile(spark):
    """The middle, both tails, the places where one approximation follows another, and what has no quantile."""
    from statistics import NormalDist

    ps = [1e-300, 1e-20, 1.3887943864964e-11, 1.38879438649641e-11, 1e-6, 0.0749999, 0.075, 0.0750001, 0.3, 0.5, 0.7, 0.925, 0.9250001, 1 - 1e-9]
    got = spark.createDataFrame([(p,) for p in ps], "p double").select("p", normal_quantile(F.col("p")).alias("z")).collect()
    assert all(r.z == pytest.approx(NormalDist().inv_cdf(r.p), rel=1e-14, abs=1e-15) for r in got)
    none = spark.createDataFrame([(0.0,), (1.0,), (-1.0,), (2.0,), (float("nan"),), (None,)], "p double")
    assert {r.z for r in none.select(normal_quantile(F.col("p")).alias("z")).collect()} == {None}
