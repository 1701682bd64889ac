"""Medoids of bounded samples: equal to full medoids on small data, good on 11,000 programs, and no task with all of them."""

import itertools

import numpy as np
import pytest

from locusmill.operators import programs as P


def frame(spark, x, parts=4):
    return spark.createDataFrame([(f"p{i:05d}", v.tolist()) for i, v in enumerate(x)], "program string, vector array<double>").repartition(parts)


@pytest.mark.parametrize("seed", range(4))
def test_medoids_equal_all_subsets(seed):
    rng = np.random.default_rng(seed)
    x = rng.standard_normal((14, 3)) + 3 * np.eye(3)[rng.integers(0, 3, 14)]
    d = P.distances(x, x)
    for k in (1, 2, 3):
        best = min(d[:, list(m)].min(axis=1).sum() for m in itertools.combinations(range(14), k))
        assert d[:, P.medoids_of(d, k)].min(axis=1).sum() <= best * 1.02 + 1e-9


def silhouette(x, label):
    d = P.distances(x, x)
    np.fill_diagonal(d, 0)
    out = []
    for i, c in enumerate(label):
        own = [j for j in range(len(x)) if label[j] == c and j != i]
        if not own:
            out.append(0.0)
            continue
        a, b = d[i, own].mean(), min(d[i, label == o].mean() for o in set(label) - {c})
        out.append((b - a) / max(a, b))
    return np.mean(out)


def test_small_data_equal_full_medoids(spark):
    rng = np.random.default_rng(3)
    x = rng.standard_normal((120, 4)) + 5 * np.eye(4)[rng.integers(0, 4, 120)]
    vectors = frame(spark, x)
    d = P.distances(x, x)
    np.fill_diagonal(d, 0)
    scores = {r.k: r.silhouette for r in P.choose_k(vectors, [2, 3, 4, 5]).collect()}
    for k in (2, 3, 4, 5):
        m = P.medoids_of(d, k)
        label = P.distances(x, x[m]).argmin(axis=1)
        got = {r.program: r.cluster for r in P.clustered(vectors, k).collect()}
        assert [got[f"p{i:05d}"] for i in range(120)] == label.tolist()
        assert abs(scores[k] - silhouette(x, label)) < 1e-6
    assert max(scores, key=scores.get) == 4


def test_eleven_thousand_programs(spark):
    """As many as 1,000 subsamples of 11 factors give; samples of 300 come near the medoids of all."""
    rng = np.random.default_rng(4)
    truth = rng.integers(0, 11, 11_000)
    x = rng.standard_normal((11_000, 30)) * 0.2 + 2 * np.eye(30)[truth]
    vectors = frame(spark, x, 8)
    scores = {r.k: r.silhouette for r in P.choose_k(vectors, [6, 11, 16], draws=3).collect()}
    assert max(scores, key=scores.get) == 11 and scores[11] > 0.3
    got = {r.program: r.cluster for r in P.clustered(vectors, 11, draws=3).collect()}
    pairs = {(t, got[f"p{i:05d}"]) for i, t in enumerate(truth)}
    assert len(got) == 11_000 and len(pairs) == 11 and len({c for _, c in pairs}) == 11


def test_few_equal_and_no_programs(spark):
    same = frame(spark, np.ones((5, 2)))
    assert P.clustered(same, 3).count() == 5
    assert [r.silhouette for r in P.choose_k(same, [2]).collect()] == [0.0]
    assert {r.cluster for r in P.clustered(frame(spark, np.array([[1.0], [9.0]])), 5).collect()} == {0, 1}
    assert P.clustered(same.limit(0), 2).count() == 0 and P.choose_k(same.limit(0), [2]).count() == 0
