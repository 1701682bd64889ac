"""Points in windows: all pairs, in tasks of bounded size and in an order that takes few bytes."""

import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from locusmill.operators import intervals as I

POINT, WINDOW = "id long, chrom string, pos long, note string", "chrom string, r_start long, r_stop long, gene long"


@pytest.fixture
def small(monkeypatch):
    monkeypatch.setattr(I, "CELL_ROWS", 100, raising=False)
    monkeypatch.setattr(I, "CHUNK_ROWS", 8, raising=False)


def pairs(points, windows, flank):
    return Counter((c, i, p, note, g, a, b) for i, c, p, note in points for c2, a, b, g in windows if c == c2 and None not in (c, p, a, b) and a - flank <= p <= b + flank)


@pytest.mark.parametrize("flank,width", [(0, None), (7, 20), (-3, 4)])
def test_equals_brute_force(spark, small, flank, width):
    """Nulls, repeated rows, a hot place, windows of one position and of whole chromosomes, start > stop, chromosomes of one side."""
    rng = random.Random(flank)
    place = lambda: rng.choice([None, 50, 50, rng.randint(-100, 4000)])
    points = [(rng.choice([None, i]), rng.choice(["a", "a", "b", "lonely", None]), place(), rng.choice(["x", None])) for i in range(900)] + [(1, "a", 50, "twice")] * 20

    def window(i):
        a = place()
        return rng.choice(["a", "b", "empty", None]), a, None if a is None else a + rng.choice([-9, 0, 3, 60, 10_000]), i

    windows = [window(i) for i in range(500)] + [("a", 40, 60, 7)] * 20
    found = I.point_in_window(spark.createDataFrame(points, POINT), spark.createDataFrame(windows, WINDOW), flank, width)
    assert found.columns == ["chrom", "id", "pos", "note", "r_start", "r_stop", "gene"]
    got = Counter((r.chrom, r.id, r.pos, r.note, r.gene, r.r_start, r.r_stop) for r in found.collect())
    assert got == pairs(points, windows, flank) and len(got) > 2_500


@pytest.mark.parametrize("n_points,n_windows", [(0, 0), (0, 3), (3, 0)])
def test_empty_tables(spark, n_points, n_windows):
    points = spark.createDataFrame([(i, "a", i, None) for i in range(n_points)], POINT)
    windows = spark.createDataFrame([("a", 0, 9, i) for i in range(n_windows)], WINDOW)
    assert I.point_in_window(points, windows, 5).count() == 0


def test_a_hot_place_is_on_many_tasks(spark, small):
    """2,000 points and 1,000 windows of one place: before, a task had 500,000 of their pairs, or all if both sides were shuffled."""
    points = spark.range(2000).select("id", F.lit("a").alias("chrom"), F.lit(5).cast("long").alias("pos"))
    windows = spark.range(1000).select(F.lit("a").alias("chrom"), F.lit(1).cast("long").alias("r_start"), F.lit(9).cast("long").alias("r_stop"), F.col("id").alias("gene"))
    sizes = [r["count"] for r in I.point_in_window(points, windows, 3).groupBy(F.spark_partition_id()).count().collect()]
    assert sum(sizes) == 2_000_000 and max(sizes) < 60_000


def test_written_pairs_take_few_bytes(spark, tmp_path):
    """16,000 points, and 2,000 windows that hold some 2,000 of them each: before, the pairs were written with 4.2 bytes each."""
    place = lambda n: F.xxhash64("id") % n + n
    points = spark.range(16_000).select("id", F.lit("a").alias("chrom"), place(160_000).alias("pos"))
    windows = spark.range(2000).select(F.col("id").alias("gene"), F.lit("a").alias("chrom"), place(160_000).alias("r_start"), (place(160_000) + F.col("id") % 1000).alias("r_stop"))
    I.point_in_window(points, windows, 20_000, 40_000).select("id", "gene", "r_start", "r_stop").write.parquet(str(tmp_path / "out"))
    n, size = spark.read.parquet(str(tmp_path / "out")).count(), sum(f.stat().st_size for f in (tmp_path / "out").glob("*.parquet"))
    assert n > 3_000_000 and size < 0.6 * n, (n, size)


def test_chunks_are_gathered_by_range(spark, small, monkeypatch):
    """3,000 points with 4 shuffle partitions: 30 tasks gather them, each those of its range."""
    made = []
    monkeypatch.setattr(I, "settled", lambda df, settled=I.settled: made.append(settled(df)) or made[-1])
    points = spark.range(3000).select("id", F.lit("a").alias("chrom"), F.col("id").alias("pos"))
    windows = spark.createDataFrame([("a", 10, 19, 1)], WINDOW)
    assert I.point_in_window(points, windows, 0).count() == 10
    sizes = [r["sum(n)"] for r in made[0].select(F.size("__points").alias("n")).groupBy(F.spark_partition_id()).sum("n").collect()]
    assert sum(sizes) == 3000 and len(sizes) == 30 and max(sizes) < 200
    assert made[0].where("__high - __low > 7").count() == 0  # neighbours
