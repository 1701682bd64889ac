"""Steps whose work or memory grew faster than the input."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from locusmill.operators import intervals as I, joins as J, linear as L, tiles
from locusmill.plans import queries_stats
from locusmill.plans.base import STANDINS, Tables


def plan_of(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_neighbours_equal_brute_force(spark):
    rng = random.Random(3)
    rows = [(rng.choice(["a", "b", None]), rng.choice([None, *range(-40, 200)])) for _ in range(150)]
    df = spark.createDataFrame(rows, "gene string, variant long")
    got = sorted(tuple(r) for r in J.neighbours(df, ["gene"], "variant", 16).collect())
    want = sorted((g, a, b) for g, a in rows for h, b in rows if g is not None and g == h and a is not None and b is not None and a <= b < a + 16)
    assert got == want


def test_neighbours_of_one_large_group(spark):
    """All 400,000 places are in one group, whose square has 1.6e11 pairs."""
    df = spark.range(400_000).select(F.lit("a").alias("gene"), F.col("id").alias("variant"))
    assert J.neighbours(df, ["gene"], "variant", 3).count() == 3 * 400_000 - 3


def test_covariance_is_that_of_the_sql(spark):
    t = Tables(spark, "/root/testdata/sf0.01")
    mine, sql = queries_stats.covariance(t), t.sql(queries_stats.COVARIANCE)
    assert sorted(mine.columns) == sorted(sql.columns)
    assert mine.exceptAll(sql.select(*mine.columns)).count() == 0 and sql.select(*mine.columns).exceptAll(mine).count() == 0
    assert "__bin" in plan_of(mine)  # variants meet by gene and place, not by gene alone


def nearest(spark, left, right, kind="string"):
    a = spark.createDataFrame(left, f"id long, chrom {kind}, start long, stop long")
    b = spark.createDataFrame(right, f"chrom {kind}, r_start long, r_stop long")
    return {r.id: (r.distance, r.r_start, r.r_stop) for r in I.nearest_join(a, b, "id", 16).collect()}


def by_hand(left, right):
    out = {}
    for i, c, s, e in left:
        all_ = [(max(0, max(s, s2) - min(e, e2) - 1), s2, e2) for c2, s2, e2 in right if c == c2 and c is not None and s2 <= e2] if None not in (s, e) else []
        out[i] = min(all_) if all_ else (None, None, None)
    return out


@pytest.mark.parametrize("crowd", [30, 400, 4000])
def test_nearest_equals_brute_force_with_ties(spark, crowd):
    """Positions that many share, nested, touching and inverted intervals, nulls."""
    rng = random.Random(crowd)
    span = lambda: (lambda s: (s, s + rng.choice([0, 1, 5, crowd // 4, -2])))(rng.randint(-crowd, crowd))
    left = [(i, rng.choice(["a", "b", "lonely", None]), *span()) for i in range(300)] + [(900, "a", None, 5), (901, "b", 5, None)]
    right = [(rng.choice(["a", "b", None]), *span()) for _ in range(150)]
    assert nearest(spark, left, right) == by_hand(left, right)
    assert nearest(spark, left, []) == by_hand(left, []) and nearest(spark, [], right) == {}


def test_nearest_lists_no_overlaps(spark):
    """30,000 queries that each overlap 30,000 subjects, at one place."""
    q = spark.range(30_000).select("id", F.lit("a").alias("chrom"), F.lit(5).cast("long").alias("start"), (F.col("id") + 6).alias("stop"))
    s = spark.range(30_000).select(F.lit("a").alias("chrom"), (-F.col("id")).alias("r_start"), F.lit(10).cast("long").alias("r_stop"))
    found = I.nearest_join(q, s, "id", 4096, coarse=200_000)
    assert plan_of(found).count("Join") == 2  # what other partitions hold, and the result
    assert found.groupBy("distance", "r_start", "r_stop").count().collect() == [(0, -29_999, 10, 30_000)]


def test_pop_dosage_is_the_stand_in_of_the_sql(spark):
    t = Tables(spark, "/root/testdata/sf0.01")
    mine, sql = t.pop_dosage, t.sql(STANDINS["pop_dosage"])
    assert mine.schema.simpleString() == sql.schema.simpleString()
    assert mine.exceptAll(sql).count() == 0 and sql.exceptAll(mine).count() == 0


def test_dosages_are_read_once(spark):
    """Each pass over the given rows counts them."""
    seen = spark.sparkContext.accumulator(0)

    def passed(batches):
        for batch in batches:
            seen.add(len(batch))
            yield batch

    rows = [(chrom, s, f"{chrom}{v}", (s * 7 + v * v + len(chrom)) % 3) for chrom in ("a", "bb") for s in range(6) for v in range(30)]
    df = spark.createDataFrame(rows, "chrom string, sample int, variant string, dosage long").mapInPandas(passed, "chrom string, sample int, variant string, dosage long")
    got = {(r.chrom, r.id1, r.id2): r.value for r in L.relationship(df, ["chrom"]).collect()}
    assert seen.value <= 2 * len(rows)  # a checkpoint may compute the rows twice, nothing else does
    for chrom in ("a", "bb"):
        x = np.array([[d for c, s, _, d in rows if c == chrom and s == i] for i in range(6)], float)
        x = x[:, x.std(axis=0) > 0]
        z = (x - x.mean(axis=0)) / x.std(axis=0, ddof=1)
        k = z @ z.T / z.shape[1]
        assert len([g for g in got if g[0] == chrom]) == 21 and all(abs(got[chrom, i, j] - k[i, j]) < 1e-9 for i in range(6) for j in range(i, 6))


def test_tiles_are_no_larger_than_the_largest_group(spark, monkeypatch):
    """40 groups of 3 rows: a partial product has 9 numbers, not those of a tile over all groups' rows."""
    sizes = []
    real = tiles.tree_sum
    monkeypatch.setattr(tiles, "tree_sum", lambda parts, *a, **k: sizes.append(parts.agg(F.max(F.size("s"))).first()[0]) or real(parts, *a, **k))
    df = spark.createDataFrame([(g, r, c, float(g + r * c)) for g in range(40) for r in range(3) for c in range(4)], "g int, row int, c int, v double")
    got = {(r.g, r.a, r.b): r.s for r in tiles.row_products(df, "row", "c", "v", ["g"]).collect()}
    assert sizes == [9] and len(got) == 40 * 6
    assert all(got[g, a, b] == sum((g + a * c) * (g + b * c) for c in range(4)) for g, a, b in got)


def test_points_go_only_to_levels_that_windows_have(spark):
    points = spark.range(100).select("id", F.lit("a").alias("chrom"), F.col("id").alias("start"), F.col("id").alias("stop"))
    wide = spark.createDataFrame([("a", 10, 59)], "chrom string, r_start long, r_stop long")
    found = I.overlap_join(points, wide, 10)
    assert "__from" not in plan_of(found)  # a row carries its ends once
    assert "__own" in plan_of(found) and ">= 1" in plan_of(found)  # the points' own level, 0, holds no windows
    assert found.count() == 50
