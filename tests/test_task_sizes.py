"""Larger tables give more tasks, not larger ones."""

import math
import random
import re
from types import SimpleNamespace

import pytest
from pyspark.sql import functions as F

from locusmill.operators import intervals as I, rows as R, stats as S
from locusmill.plans import queries_intervals


@pytest.fixture
def small(monkeypatch):
    monkeypatch.setattr(I, "PART_ROWS", 300)
    monkeypatch.setattr(R, "DEALT_ROWS", 100)


def largest(df):
    """Most rows of a partition."""
    return df.groupBy(F.spark_partition_id()).count().agg(F.max("count")).first()[0]


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_dealt_by_number(spark, small):
    df = spark.range(2000)
    assert R.dealt(df, 2000, "id").rdd.getNumPartitions() == 20 and R.dealt(df, 0, "id").rdd.getNumPartitions() == 1
    grouped = R.dealt(df, 2000, "id").groupBy("id", (F.col("id") + 1).alias("b")).count()
    assert plan_of(grouped).count("Exchange") == 1 and grouped.count() == 2000


def test_nearest_join_deals_by_number(spark, small):
    """3,000 queries of one chromosome and 1,000 subjects, with 4 shuffle partitions."""
    q = spark.range(3000).select("id", F.lit("a").alias("chrom"), (F.col("id") * 10).alias("start"), (F.col("id") * 10 + 1).alias("stop"))
    s = spark.range(1000).select(F.lit("a").alias("chrom"), (F.col("id") * 30 + 4).alias("r_start"), (F.col("id") * 30 + 5).alias("r_stop"))
    found = I.nearest_join(q, s, "id")
    assert largest(found) < 200
    assert plan_of(found).count("shufflepartitionidpassthrough") == 1  # a range is not dealt anew by the hash of its number
    assert found.where("distance = 2").count() == 1000 and found.count() == 3000


def test_distance_matrix_deals_by_number_and_keeps_a_null_id(spark, small):
    peaks = spark.range(1000).select(F.when(F.col("id") > 0, F.col("id")).alias("id"), (F.col("id") % 2).alias("chrom"), (F.col("id") * 10).alias("start"), (F.col("id") * 10 + 1).alias("stop"))
    genes = spark.createDataFrame([(3, 0, 5, 5), (4, 0, 50, 60), (7, 1, -3, -3)], "gene long, chrom long, start long, stop long")
    out = queries_intervals.x28(SimpleNamespace(spark=spark, peaks=peaks, genes=genes))
    assert largest(out) < 200
    got = {r.id: (r.tf0, r.tf1, r.tf2) for r in out.collect()}
    assert len(got) == 1000 and got[None] == (3, 48, None) and got[1] == (None, 12, None) and got[4] == (34, 8, None)


def test_over_representation_deals_by_number(spark, small):
    """Repeated rows, nulls and members outside the background."""
    rng = random.Random(10)
    query = [(rng.choice(["q", "r", None]), rng.choice([None, *range(60)])) for _ in range(900)]
    terms = [(rng.choice(["s", "t", None]), rng.choice([None, *range(80)])) for _ in range(120)]
    world = [(i,) for i in range(5, 50)] * 2
    frames = (spark.createDataFrame(rows, f"{name}member int") for rows, name in ((query, "query string, "), (terms, "term string, "), (world, "")))
    out = S.over_representation(*frames)
    text = plan_of(out)
    assert re.search(r"hashpartitioning\(member#\d+, 12\), REPARTITION_BY_NUM", text)
    assert not re.search(r"hashpartitioning\((query|term)#\d+, member", text)  # rows are made distinct where they were dealt to
    sets = lambda rows, name: {i for n, i in rows if n == name and i is not None and 5 <= i < 50}
    want = {(q, t): (len(sets(query, q) & sets(terms, t)), len(sets(query, q)), len(sets(terms, t))) for q in "qr" for t in "st"}
    got = {(r.query, r.term): r for r in out.collect()}
    assert {key: (r.x, r.k, r.m) for key, r in got.items()} == want
    for x, k, m, p in ((r.x, r.k, r.m, r.p) for r in got.values()):
        assert math.isclose(p, sum(math.comb(m, i) * math.comb(45 - m, k - i) for i in range(x, min(k, m) + 1)) / math.comb(45, k), rel_tol=1e-9)
