"""Empirical-Bayes factorisation: posteriors against integrals, evidence that never falls, recovery of a simulated matrix."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from locusmill.functions import normal_means as N
from locusmill.operators import programs as P
from locusmill.operators.sums import tree_sum


def density(family, prior):
    """(weight at 0, density elsewhere) of a prior."""
    half = lambda t, a: np.where(t >= 0, a * np.exp(-a * np.abs(t)), 0)
    normal = lambda t, v: np.exp(-0.5 * t * t / v) / math.sqrt(2 * math.pi * v)
    return {
        "normal": lambda: (0.0, lambda t: normal(t, prior[0])),
        "point_normal": lambda: (1 - prior[0], lambda t: prior[0] * normal(t, prior[1])),
        "point_exponential": lambda: (1 - prior[0], lambda t: prior[0] * half(t, prior[1])),
        "point_laplace": lambda: (1 - prior[0], lambda t: prior[0] * (half(t, prior[1]) + half(-t, prior[1])) / 2),
        "normal_scale_mixture": lambda: (prior[1], lambda t: sum(w * normal(t, (prior[0] / 2 ** (9 - i)) ** 2) for i, w in enumerate(prior[2:]))),
    }[family]()


@pytest.mark.parametrize("family", sorted(N.FAMILIES))
def test_posterior_equals_the_integral(family):
    own, s = N.FAMILIES[family], 0.8
    prior, x = own.start(2.0), np.array([-6.0, -0.3, 0.0, 1.2, 8.0])
    post = own.posterior(x, s, prior)
    edges = np.linspace(-60, 60, 1_200_001)
    t = (edges[1:] + edges[:-1]) / 2
    at_zero, rest = density(family, prior)
    for i, v in enumerate(x):
        like = np.exp(-0.5 * ((v - t) / s) ** 2) / math.sqrt(2 * math.pi) / s * rest(t) * (edges[1] - edges[0])
        total = like.sum() + at_zero * math.exp(-0.5 * (v / s) ** 2) / math.sqrt(2 * math.pi) / s
        assert np.allclose([post.loglik[i], post.mean[i], post.second[i]], [math.log(total), (like * t).sum() / total, (like * t * t).sum() / total], atol=1e-5)


@pytest.mark.parametrize("family", sorted(N.FAMILIES))
def test_likelihood_never_falls_and_finds_the_sparsity(family):
    rng = np.random.default_rng(1)
    theta = rng.exponential(2, 3000) * (rng.random(3000) < 0.2) * (1 if N.FAMILIES[family].positive else rng.choice([-1, 1], 3000))
    x = theta + 0.4 * rng.standard_normal(3000)
    own = N.FAMILIES[family]
    prior, last = own.start(1.0), -np.inf
    for _ in range(80):
        post = own.posterior(x, 0.4, prior)
        assert post.loglik.sum() >= last - 1e-8
        last, prior = post.loglik.sum(), own.renewed(post.sums, len(x), prior)
    assert np.mean((post.mean - theta) ** 2) < 0.95 * np.mean((x - theta) ** 2)
    if family in ("point_exponential", "point_laplace"):
        assert abs(prior[0] - 0.2) < 0.05 and abs(prior[1] - 0.5) < 0.1
    assert N.relative_entropy(post, x, 0.4) <= 0


def test_far_tails_are_finite():
    z = np.array([-1e6, -60.0, -37.5, -36.99, 0.0, 8.99, 50.0])
    assert np.isfinite(N.log_phi(z)).all() and np.isclose(N.log_phi(z)[3], math.log(0.5 * math.erfc(36.99 / math.sqrt(2))), rtol=1e-10)
    first, second = N.above_zero(np.array([-1e5, -40.0, -3.0, 5.0]), 1.0)
    assert (first > 0).all() and (second >= first**2).all() and abs(first[0] - 1e-5) < 1e-9


@pytest.fixture(scope="module")
def simulated(spark):
    rng = np.random.default_rng(0)
    l = rng.exponential(2, (300, 3)) * (rng.random((300, 3)) < 0.3)  # noqa: E741
    f = rng.exponential(1, (20, 3)) * (rng.random((20, 3)) < 0.4)
    x = l @ f.T + 0.3 * rng.standard_normal((300, 20))
    cells = spark.createDataFrame([(i, j, float(x[i, j])) for i in range(300) for j in range(20)], "locus long, feature int, v double").repartition(5)
    picks = spark.range(300).selectExpr("id as locus", "0L as iter").union(spark.range(200).selectExpr("id as locus", "7L as iter"))
    return cells, picks, l, f


def matrices(rows, prior, i):
    own = rows[(rows.prior == prior) & (rows.iter == i)]
    return [own[own.kind == kind].assign(key=lambda d: d.key.astype(int)).pivot(index="key", columns="k", values="value").to_numpy() for kind in "LF"]


def test_factors_are_recovered_under_every_prior(spark, simulated, monkeypatch):
    cells, picks, l, f = simulated  # noqa: E741
    traces, fit = [], P._fit

    def told(*given):
        states = fit(*given)
        traces.extend(s["trace"] for s in states.values())
        return states

    monkeypatch.setattr(P, "_fit", told)
    priors = ["point_exponential", "point_normal/point_exponential", "normal", "point_laplace", "normal_scale_mixture/point_normal"]
    rows = P.factorised(cells, picks, "locus", "feature", "v", 4, priors).toPandas()
    assert len(traces) == 10
    for trace in traces:
        for (a, x), (b, y) in zip(trace, trace[1:], strict=False):
            assert a != b or y >= x
        assert trace[-1][1] == max(v for _, v in trace)
    for prior in priors:
        for i, n in ((0, 300), (7, 200)):
            left, right = matrices(rows, prior, i)
            assert left.shape[0] == n and right.shape[0] == 20 and left.shape[1] == right.shape[1] in (3, 4)
            assert ((left @ right.T - l[:n] @ f.T) ** 2).sum() < 0.005 * ((l[:n] @ f.T) ** 2).sum()
    found = np.abs(np.corrcoef(np.hstack([f, matrices(rows, "point_exponential", 0)[1]]).T)[:3, 3:])
    assert found.max(axis=1).min() > 0.995
    own = rows[rows.prior == "point_exponential"]
    assert (own.value >= 0).all() and own.groupby(["iter", "k"]).pve.first().groupby("iter").sum().between(0.9, 1).all()
    assert (own[own.kind == "L"].value < 0.15).mean() > 0.6  # sparse, as the truth is
    best = rows.groupby("prior").evidence.max()
    assert best["point_exponential"] == best.max() and best["normal"] == best.min()


def test_a_block_for_each_subsample_gives_the_same(spark, simulated, monkeypatch):
    cells, picks, *_ = simulated
    whole = P.factorised(cells, picks, "locus", "feature", "v", 2, "normal").toPandas()
    monkeypatch.setattr(P, "STATE_BYTES", 1)
    parts = P.factorised(cells, picks, "locus", "feature", "v", 2, "normal").toPandas()
    order = ["iter", "kind", "key", "k"]
    assert np.allclose(whole.sort_values(order).value, parts.sort_values(order).value, atol=1e-6)


def test_edges_of_factorisation(spark):
    cells = spark.createDataFrame([(1, "a", 1.0), (1, "b", None), (2, "b", 0.0), (3, "a", 2.0), (3, "a", 1.0)], "locus long, feature string, v double")
    picks = spark.createDataFrame([(1, 0), (3, 0), (3, 0), (2, 1), (99, 0), (1, 2)], "locus long, iter int")
    rows = P.factorised(cells, picks, "locus", "feature", "v", 3).toPandas()
    assert set(rows.iter) == {0, 2}  # subsample 1 has zeros only
    assert np.isfinite(rows.value).all() and set(rows[rows.kind == "L"].key) == {"1", "3"}
    assert P.factorised(cells, picks.limit(0), "locus", "feature", "v", 3).count() == 0
    for prior in ("cauchy", "normal/cauchy", "normal/normal/normal"):
        with pytest.raises(ValueError):
            P.factorised(cells, picks, "locus", "feature", "v", 1, prior)


def test_arrays_are_summed_as_a_tree(spark):
    parts = spark.range(500).select((F.col("id") % 3).alias("g"), F.col("id").alias("part"), F.array(F.col("id").cast("double"), F.lit(1.0)).alias("s"))
    got = {r.g: list(r.s) for r in tree_sum(parts, ["g"]).collect()}
    assert got == {g: [float(sum(range(g, 500, 3))), float(len(range(g, 500, 3)))] for g in range(3)}
