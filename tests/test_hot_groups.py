"""Ranks, quantiles and places inside groups of which one holds most rows, with ties and nulls."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from locusmill.operators import groups as G, ranks as W, stats as S


@pytest.fixture(params=[1, 3, 9])
def parts(spark, request):
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", request.param)
    yield request.param
    spark.conf.set("spark.sql.shuffle.partitions", before)


def rows():
    rng = np.random.default_rng(4)
    out = [(g, i, None if rng.random() < 0.05 else float(v)) for g, n in (("hot", 900), ("b", 30), (None, 40), ("one", 1)) for i, v in enumerate(np.where(rng.random(n) < 0.4, 7.0, rng.integers(0, 60, n)))]
    return out + [("void", 0, None)]


def test_average_ranks_in_groups(spark, parts):
    df = spark.createDataFrame(rows(), "g string, i int, x double")
    want = {}
    for g in {r[0] for r in rows()}:
        own = [r for r in rows() if r[0] == g and r[2] is not None]
        v = np.array([r[2] for r in own])
        want |= {(g, r[1]): (v < r[2]).sum() + ((v == r[2]).sum() + 1) / 2 for r in own}
    assert {(r.g, r.i): r["rank"] for r in W.average_rank(df, "x", ["g"]).collect()} == want
    sizes = {g: sum(1 for k in want if k[0] == g) for g, _ in want}
    down = {(r.g, r.i): r["rank"] for r in W.average_rank(df, "x", ["g"], descending=True).collect()}
    assert down == {k: sizes[k[0]] + 1 - v for k, v in want.items()}
    assert W.average_rank(df.limit(0), "x", ["g"]).count() == 0


def test_six_numbers_and_summaries(spark, parts):
    df = spark.createDataFrame(rows(), "g string, i int, x double")
    six, few = {r.g: r for r in G.six_numbers(df, ["g"], "x").collect()}, {r.g: r for r in G.summary(df.withColumn("x", -F.col("x")), ["g"], "x").collect()}
    assert six.keys() == few.keys() == {r[0] for r in rows()}
    for g, r in six.items():
        v = [x for h, _, x in rows() if h == g and x is not None]
        if not v:
            assert r.median is None and few[g].n == 0 and few[g].median_abs is None
            continue
        assert np.allclose([r.min, r.q1, r.median, r.mean, r.q3, r.max], [min(v), *np.quantile(v, [0.25, 0.5]), np.mean(v), np.quantile(v, 0.75), max(v)])
        assert few[g].n == len(v) and np.isclose(few[g].median_abs, np.median(v)) and few[g].max_abs == max(v)


def test_a_hot_group_is_on_many_parts(spark):
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", 6)
    try:
        df = spark.range(5000).select(F.lit("all").alias("g"), F.col("id"))
        out = W.placed(df, ["g"], [F.col("id")])
        assert [r[0] for r in out.orderBy("id").select("__place").collect()] == list(range(1, 5001)) and out.select("__part").distinct().count() >= 4
        assert out.select("__size").distinct().collect()[0][0] == 5000
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)


def test_permuted_pairs_keep_both_columns(spark, parts):
    df = spark.createDataFrame([(r[0] or "n", r[1], float(r[1]), -float(r[1])) for r in rows()], "g string, k int, x double, y double")
    got = S.permuted(df, "g", "x", "y", "k", 3).toPandas()
    for g, own in got.groupby("g"):
        v = sorted(r[1] for r in rows() if (r[0] or "n") == g)
        assert sorted(own.x) == v and sorted(-own.y) == v
    assert (got[got.g == "hot"].x != -got[got.g == "hot"].y).mean() > 0.9
