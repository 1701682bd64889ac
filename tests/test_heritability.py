"""Heritability from products with vectors alone, against eigenvectors and against what was simulated."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from locusmill.operators import models as M


def long_form(k, spark, **more):
    n = len(k)
    return spark.createDataFrame([(*more.values(), f"s{i:03d}", f"s{j:03d}", float(k[i, j])) for i in range(n) for j in range(i, n)], "".join(f"{c} string, " for c in more) + "id1 string, id2 string, value double")


def test_products_give_what_eigenvectors_give(spark, monkeypatch):
    rng = np.random.default_rng(1)
    rows, grm = [], None
    for chrom, n in (("a", 130), ("b", 90)):
        x = rng.standard_normal((n, 200))
        k = x @ x.T / 200
        grm = long_form(k, spark, chrom=chrom) if grm is None else grm.unionByName(long_form(k, spark, chrom=chrom))
        for r in range(3):
            y = x @ rng.standard_normal(200) * math.sqrt(0.6 / 200) + rng.standard_normal(n) * math.sqrt(0.4)
            rows += [(chrom, f"p{r}", f"s{i:03d}", float(v)) for i, v in enumerate(y)]
        rows += [(chrom, "flat", f"s{i:03d}", 1.0) for i in range(n)] + [(chrom, "hole", f"s{i:03d}", None if i == 4 else float(i % 7)) for i in range(n)]
    phenotypes = spark.createDataFrame(rows, "chrom string, phenotype string, id string, y double")
    exact = {(r.chrom, r.phenotype): r for r in M.heritability(phenotypes, grm, ["chrom", "phenotype"]).collect()}
    monkeypatch.setattr(M, "MAX_SAMPLES", 100)  # chromosome a only is too large
    monkeypatch.setattr(M, "ROWS", 32)
    monkeypatch.setattr(M, "PROBES", 60)
    monkeypatch.setattr(M, "LANCZOS", 16)
    got = {(r.chrom, r.phenotype): r for r in M.heritability(phenotypes, grm, ["chrom", "phenotype"]).collect()}
    assert got.keys() == exact.keys() and len(got) == 10
    for key, r in got.items():
        if key[1] in ("flat", "hole"):
            assert r.h2 is None and r.error
        else:
            assert abs(r.h2 - exact[key].h2) < (1e-6 if key[0] == "b" else 0.1) and r.error is None


def test_twenty_thousand_samples_in_families(spark):
    """Brothers and sisters share half: 5,000 families of four, never a matrix of 20,000 rows in one place."""
    rng = np.random.default_rng(2)
    n, families = 20_000, 5_000
    people = spark.range(n).select(F.col("id"), F.floor(F.col("id") / 4).alias("f"))
    other = people.select(F.col("id").alias("id2"), "f")
    grm = people.withColumnRenamed("id", "id1").join(other, "f").where("id1 <= id2").select("id1", "id2", F.when(F.col("id1") == F.col("id2"), 1.0).otherwise(0.5).alias("value"))
    rows = []
    for h in (0.3, 0.7):
        shared = np.repeat(rng.standard_normal(families), 4) * math.sqrt(h / 2)
        y = shared + rng.standard_normal(n) * math.sqrt(h / 2) + rng.standard_normal(n) * math.sqrt(1 - h)
        rows += [(f"h{h}", i, float(v)) for i, v in enumerate(y)]
    got = {r.phenotype: r for r in M.heritability(spark.createDataFrame(rows, "phenotype string, id long, y double"), grm, ["phenotype"]).collect()}
    for h in (0.3, 0.7):
        r = got[f"h{h}"]
        assert r.error is None and 0 < r.se < 0.05 and abs(r.h2 - h) < 3 * r.se and r.p < 1e-6


def test_no_samples_in_common(spark):
    grm = spark.createDataFrame([("a", "a", 1.0)], "id1 string, id2 string, value double")
    one = spark.createDataFrame([("p", "z", 1.0)], "phenotype string, id string, y double")
    got = M.heritability(one, grm, ["phenotype"]).collect()
    assert len(got) == 1 and got[0].h2 is None and got[0].error
    assert M.heritability(one.limit(0), grm, ["phenotype"]).count() == 0


def test_quadrature_fit_equals_the_sum_over_eigenvalues():
    rng = np.random.default_rng(3)
    values, squares = rng.exponential(1, 200), rng.exponential(1, 200)
    a = M.heritability_fit(values, squares)
    b = M.heritability_fit(values, squares, False, values, np.ones(200))
    assert a == pytest.approx(b)
