"""Regularisation paths and SNP models from sums against fits on the rows; tiled products against plain ones."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from locusmill.operators import linear as L, models as M, stats as S, tiles


def rows_of(spark, x, y, parts=5):
    return spark.createDataFrame([(i, v.tolist(), None if t is None else float(t)) for i, (v, t) in enumerate(zip(x, y, strict=True))], "id long, x array<double>, y double").repartition(parts)


def test_gaussian_path_equals_nets_on_rows(spark):
    rng = np.random.default_rng(1)
    x = rng.standard_normal((300, 6)) * [1, 2, 3, 1, 1, 0] + 4
    y = x[:, 0] - 0.5 * x[:, 2] + 0.3 * rng.standard_normal(300)
    df = rows_of(spark, x, y)
    metrics, weights = M.regularised_path(df, "id", "x", "y", "gaussian", n_lambdas=20)
    got = metrics.toPandas()
    assert got["lambda"].nunique() == 20 and set(got.fold) == set(range(5)) and len(got) == 100
    fold = {r.id: r.fold for r in M.with_folds(df, "id", 5, 1).collect()}
    of = np.array([fold[i] for i in range(300)])
    sd = x.std(axis=0)
    sd[5] = 1
    for lam in sorted(got["lambda"].unique())[::7]:
        for f in range(5):
            train = of != f
            centre = x[train].mean(axis=0)
            z = (x - centre) / sd
            # a net on columns of the training rows' own mean, scaled by the spread of all rows
            w = M.gram_net(z[train].T @ z[train] / train.sum(), z[train].T @ (y[train] - y[train].mean()) / train.sum(), lam)
            error = np.mean((y[~train] - y[train].mean() - z[~train] @ w) ** 2)
            assert math.isclose(got[(got["lambda"] == lam) & (got.fold == f)].metric.iloc[0], error, rel_tol=1e-3)
    top = got["lambda"].max()
    assert weights.where((F.col("lambda") >= top * 0.999999) & (F.col("feature") >= 0) & (F.abs("weight") > 1e-9)).count() == 0
    last = {r.feature: r.weight for r in weights.where(F.col("lambda") < top / 99).collect()}
    assert abs(last[0] - 1) < 0.1 and abs(last[2] + 0.5) < 0.05 and 5 not in last
    chosen = {r.rule: r["lambda"] for r in M.chosen_lambda(metrics, larger_is_better=False).collect()}
    assert chosen["1se"] >= chosen["best"]


def objective(x, y, w, b, lam, alpha=0.5):
    eta = x @ w + b
    return np.mean(np.logaddexp(0, eta) - y * eta) + lam * (alpha * np.abs(w).sum() + (1 - alpha) / 2 * (w * w).sum())


def test_logistic_path_is_optimal(spark):
    rng = np.random.default_rng(2)
    x = rng.standard_normal((400, 5))
    y = (rng.random(400) < 1 / (1 + np.exp(-(1.5 * x[:, 0] - x[:, 1] + 0.3)))).astype(float)
    metrics, weights = M.regularised_path(rows_of(spark, x, y), "id", "x", "y", n_lambdas=15)
    got = metrics.toPandas()
    assert len(got) == 75 and got.metric.between(0.4, 1).all() and got[got["lambda"] < 0.05].metric.mean() > 0.75
    sd, own = x.std(axis=0), weights.toPandas()
    for lam in sorted(own["lambda"].unique())[::4]:
        w, b = np.zeros(5), 0.0
        for r in own[own["lambda"] == lam].itertuples():
            if r.feature < 0:
                b = r.weight
            else:
                w[r.feature] = r.weight
        best = objective(x / sd, y, w * sd, b, lam)
        for _ in range(200):
            step = rng.standard_normal(6) * rng.choice([1e-3, 1e-2, 1e-1])
            assert objective(x / sd, y, w * sd + step[:5], b + step[5], lam) > best - 1e-6


def test_area_under_the_curve_of_held_out_rows(spark):
    rng = np.random.default_rng(3)
    x = rng.standard_normal((500, 1))
    y = (x[:, 0] + rng.standard_normal(500) > 0).astype(float)
    df = rows_of(spark, x, y)
    got = {r.fold: r.metric for r in M.cross_validated(df, "id", "x", "y", [0.01]).collect()}
    fold = {r.id: r.fold for r in M.with_folds(df, "id", 5, 1).collect()}
    for f in range(5):
        own = [i for i in range(500) if fold[i] == f]
        a, b = x[[i for i in own if y[i] == 1], 0], x[[i for i in own if y[i] == 0], 0]
        assert abs(got[f] - np.mean(a[:, None] > b[None, :])) < 0.01


def test_paths_at_the_edges(spark):
    nan = float("nan")
    df = rows_of(spark, np.array([[1.0, nan], [2.0, 1.0], [3.0, 1.0], [4.0, 2.0]]), [1, 1, None, 1])
    for family in ("binomial", "gaussian"):
        metrics, _ = M.regularised_path(df.limit(0), "id", "x", "y", family)
        assert metrics.count() == 0
    assert M.cross_validated(df, "id", "x", "y").count() == 0  # one class
    assert M.cross_validated(df, "id", "x", "y", [0.1], family="gaussian").count() >= 1
    with pytest.raises(ValueError):
        M.cross_validated(df, "id", "x", "y", family="poisson")


def test_nested_folds_tell_signal_from_noise(spark):
    rng = np.random.default_rng(6)
    x = rng.integers(0, 3, (250, 8))
    y = {"signal": x[:, 2] * 0.8 + rng.standard_normal(250), "noise": rng.standard_normal(250)}
    rows = [(locus, i, float(y[locus][i]), v, int(x[i, v])) for locus in y for i in range(250) for v in range(8) if (i + v) % 17]
    got = M.snp_models(spark.createDataFrame(rows, "locus string, sample long, y double, variant int, dosage int")).toPandas()
    by = got.groupby("locus").first()
    assert len(got) == 16 and by.nested_r2["signal"] > 0.2 and by.nested_p["signal"] < 1e-8 and by.nested_r2["noise"] < 0.08 and by.nested_p["noise"] > 1e-3
    signal = got[got.locus == "signal"].set_index("variant").weight
    assert signal.abs().idxmax() == 2


@pytest.mark.parametrize("tile,block,by", [(256, 4096, []), (7, 5, []), (7, 5, ["g"]), (256, 4096, ["g"])])
def test_tiles_equal_plain_products(spark, monkeypatch, tile, block, by):
    monkeypatch.setattr(tiles, "TILE", tile)
    monkeypatch.setattr(tiles, "BLOCK", block)
    rng = np.random.default_rng(7)
    x = rng.standard_normal((2, 23, 31)) * (rng.random((2, 23, 31)) < 0.6)
    groups = range(2) if by else [0]
    cells = [(g, f"r{i:02d}", j, float(x[g, i, j])) for g in groups for i in range(23) for j in range(31) if x[g, i, j]] + [(0, None, 1, 1.0), (0, "r00", 2, None)]
    df = spark.createDataFrame(cells, "g int, row string, c int, v double").repartition(3)
    got = {tuple(r[:-1]): r.s for r in tiles.row_products(df, "row", "c", "v", by).collect()}
    want = {(*([g] if by else []), f"r{i:02d}", f"r{j:02d}"): x[g, i] @ x[g, j] for g in groups for i in range(23) for j in range(i, 23)}
    assert got.keys() == want.keys() and all(math.isclose(got[k], want[k], abs_tol=1e-9) for k in want)
    assert tiles.row_products(df.limit(0), "row", "c", "v", by).count() == 0


def test_relationship_of_more_than_five_thousand_samples(spark):
    n = 5_100
    df = spark.range(n * 4).select(F.floor(F.col("id") / 4).alias("sample"), (F.col("id") % 4).alias("variant"), F.pmod(F.xxhash64("id"), F.lit(3)).alias("dosage"))
    got = L.relationship(df)
    x = np.array([r[0] for r in df.orderBy("sample", "variant").select("dosage").collect()], float).reshape(n, 4)
    z = (x - x.mean(0)) / x.std(0, ddof=1)
    assert got.count() == n * (n + 1) // 2
    for r in got.where("(id1 * 7919 + id2) % 1000003 = 5").collect():
        assert math.isclose(r.value, z[r.id1] @ z[r.id2] / 4, abs_tol=1e-9)


def test_correlations_with_a_constant_row(spark):
    rows = [("a", i, float(i)) for i in range(5)] + [("b", i, 5.0 - i * i) for i in range(5)] + [("flat", i, 2.0) for i in range(5)]
    got = {(r.a, r.b): r.r for r in S.row_correlations(spark.createDataFrame(rows, "row string, c int, v double"), "row", "c", "v").collect()}
    assert got["a", "flat"] is None and got["b", "flat"] is None and math.isclose(got["a", "b"], np.corrcoef(range(5), [5 - i * i for i in range(5)])[0, 1])
