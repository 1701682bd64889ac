import random

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from locusmill.operators import intervals as I


def frames(spark, left, right):
    a = spark.createDataFrame(left, "id long, chrom string, start long, stop long")
    b = spark.createDataFrame(right, "chrom string, r_start long, r_stop long")
    return a, b


def test_overlap_edges(spark):
    a, b = frames(spark, [(1, "1", 10, 20), (2, "1", 30, 30), (3, "2", 1, 100), (4, "1", None, 5), (5, "1", 9, 2)], [("1", 20, 25), ("1", 21, 29), ("1", 30, 30), ("2", 40, 50), ("2", 200, 300), ("3", 1, 1)])
    got = sorted((r.id, r.r_start, r.r_stop) for r in I.overlap_join(a, b, 7).collect())
    assert got == [(1, 20, 25), (2, 30, 30), (3, 40, 50)]
    near = sorted((r.id, r.r_start) for r in I.overlap_join(a, b, 7, max_gap=0).collect())
    assert near == [(1, 20), (1, 21), (2, 21), (2, 30), (3, 40)]  # touching counts at gap 0


@pytest.mark.parametrize("gap", [-1, 0, 5])
def test_overlap_equals_brute_force(spark, gap):
    rng = random.Random(gap)
    span = lambda: (lambda s: (s, s + rng.randint(0, 40)))(rng.randint(-50, 400))
    left = [(i, rng.choice("ab"), *span()) for i in range(80)]
    right = list({(rng.choice("abc"), *span()) for _ in range(80)})
    got = sorted((r.id, r.r_start, r.r_stop) for r in I.overlap_join(*frames(spark, left, right), 16, gap).collect())
    want = sorted((i, s2, e2) for i, c, s, e in left for c2, s2, e2 in right if c == c2 and max(s, s2) - min(e, e2) - 1 <= gap)
    assert got == want


def test_overlap_has_no_nested_loop(spark):
    a, b = frames(spark, [(1, "1", 10, 20)], [("1", 20, 25)])
    plan = I.overlap_join(a, b, 7)._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan


def test_narrow_bins_take_long_intervals(spark):
    a, b = frames(spark, [(1, "1", 0, 1_000_000)], [("1", 20, 25)])
    assert I.overlap_join(a, b, 1).count() == 1


def test_nearest_equals_brute_force(spark):
    rng = random.Random(5)
    span = lambda: (lambda s: (s, s + rng.randint(0, 30)))(rng.randint(0, 3000))
    left = [(i, rng.choice(["a", "b", "lonely"]), *span()) for i in range(120)]
    right = [(rng.choice("ab"), *span()) for _ in range(40)]
    a, b = frames(spark, left, right)
    got = {r.id: (r.distance, r.r_start, r.r_stop) for r in I.nearest_join(a, b, "id", 16, coarse=200).collect()}
    for i, c, s, e in left:
        all_ = [(max(0, max(s, s2) - min(e, e2) - 1), s2, e2) for c2, s2, e2 in right if c2 == c]
        assert got[i] == (min(all_) if all_ else (None, None, None))


def test_lift_over_counts_blocks(spark):
    spans = spark.createDataFrame([(1, "1", 50, 60), (2, "1", 95, 105), (3, "1", 150, 160), (4, "1", 320, 330)], "id long, chrom string, start long, stop long")
    blocks = spark.createDataFrame([("1", 0, 99, "7", 1000, "+"), ("1", 100, 119, "7", 1000, "+"), ("1", 300, 399, "9", 0, "-")], "chrom string, src_start long, src_stop long, dst_chrom string, shift long, strand string")
    mapped, unmapped = I.lifted(spans, blocks, "id", 50)
    whole = {r.id: (r.chrom, r.start, r.stop, r.n_fragments) for r in I.merged_fragments(mapped, "id").collect()}
    assert whole == {1: ("7", 1050, 1060, 1), 2: ("7", 1095, 1105, 2), 4: ("9", 369, 379, 1)}
    assert [r.id for r in unmapped.collect()] == [3]


def test_bin_window_hand_values(spark):
    """Centre 100064 is in bin 781; the window starts in bin 333 at position 42720."""
    one = spark.createDataFrame([(100000, 100128), (100000, 100001), (100000, 101000)], "start long, stop long")
    low, high = I.bin_window(F.col("start"), F.col("stop"), pad=0)
    got = [tuple(r) for r in one.select(low, high).collect()]

    def by_hand(start, stop, size=128, n=896):
        mid = -(-(start + stop) // 2)
        b0 = (mid - 1) // size - n // 2
        s = start - (mid - size * n / 2)
        out = [int(s // size) + 1, int((s + stop - start - 1) // size) + 1]
        out[1] += (stop - start) > size
        out[1] += out[0] == out[1]
        return b0 + out[0], b0 + out[1]

    assert got == [by_hand(100000, 100128), by_hand(100000, 100001), by_hand(100000, 101000)]
