"""Joins of closed intervals (chrom, start, stop), through bins and equality keys instead of nested loops."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F

from locusmill.operators.rows import dealt, settled

#: A level's bins are so many times as wide as those of the level below.
STEP = 8


def _widths(width: int) -> list[int]:
    """Bin widths of the levels, up to the longest interval that positions can tell."""
    out = [max(1, width)]
    while out[-1] < 1 << 40:
        out.append(out[-1] * STEP)
    return out


def _level(start: Column, stop: Column, widths: list[int]) -> Column:
    """The first level whose bins are as wide as the interval, so that it fills two of them at most."""
    return F.size(F.filter(F.array([F.lit(w) for w in widths[:-1]]), lambda w: w < stop - start + 1))


def usual_length(df: DataFrame, start: str, stop: str) -> int:
    """About the median length of the intervals, 1 at least."""
    return max(1, int(df.where(F.col(start) <= F.col(stop)).agg(F.percentile_approx(F.col(stop) - F.col(start) + 1, 0.5, 1000)).first()[0] or 1))


def overlap_join(left: DataFrame, right: DataFrame, width: int | None = None, max_gap: int = -1, on: str = "chrom") -> DataFrame:
    """Pairs of intervals on one chromosome that overlap, or lie within ``max_gap`` positions of each other.

    ``left`` has (chrom, start, stop, ...), ``right`` (chrom, r_start, r_stop, ...) and no other common name. Each interval has the
    level of its length: bins of ``width`` (the usual length of ``right``, if not given), 8 times that, and so on, so that it
    fills two bins of its level at most. Two intervals meet in the bins of the longer one's level: an interval goes to its own
    level and to each higher one that the other side has, with two rows at most. So intervals of one position and of whole
    chromosomes may be joined at once. A pair counts in the first bin that both fill only, so no distinct is needed. Intervals
    with start > stop or nulls match nothing.
    """
    widths = _widths(width or usual_length(right, "r_start", "r_stop"))
    from_, to = F.col("start") - (max_gap + 1), F.col("stop") + (max_gap + 1)
    a = left.where("start <= stop").withColumn("__own", _level(from_, to, widths))
    b = right.where("r_start <= r_stop").withColumn("__rown", _level(F.col("r_start"), F.col("r_stop"), widths))
    levels = [set(df.agg(F.collect_set(c)).first()[0]) for df, c in ((a, "__own"), (b, "__rown"))]  # one number for each level

    def placed(df: DataFrame, start: Column, stop: Column, own: str, other: set[int], low: str) -> DataFrame:
        least = min(other, default=len(widths))  # at its own level an interval meets none longer, so it goes there only if some aren't
        some = F.array_union(F.filter(F.array(own), lambda x: x >= least), F.filter(F.array([F.lit(x) for x in sorted(other)]).cast("array<int>"), lambda x: x > F.col(own)))
        at = df.withColumn("__level", F.explode(some)).withColumn("__w", F.element_at(F.array([F.lit(w).cast("long") for w in widths]), F.col("__level") + 1))
        at = at.withColumn(low, F.floor(start / F.col("__w")))
        return at.withColumn("__bin", F.explode(F.sequence(low, F.floor(stop / F.col("__w"))))).drop("__w")

    both = placed(a, from_, to, "__own", levels[1], "__lo").join(placed(b, F.col("r_start"), F.col("r_stop"), "__rown", levels[0], "__rlo"), [on, "__level", "__bin"])
    hit = (from_ <= F.col("r_stop")) & (F.col("r_start") <= to)
    longer = F.greatest("__own", "__rown") == F.col("__level")
    return both.where(hit & longer & (F.col("__bin") == F.greatest("__lo", "__rlo"))).drop("__bin", "__lo", "__rlo", "__level", "__own", "__rown")


def distance(start: Column, stop: Column, r_start: Column, r_stop: Column) -> Column:
    """Positions between two intervals; 0 if they touch or overlap."""
    return F.greatest(F.lit(0), F.greatest(start, r_start) - F.least(stop, r_stop) - 1)


#: Points, and windows, of a cell of ``point_in_window``, about; points of a chunk, a multiple of 8, as Parquet packs values by eights.
CELL_ROWS, CHUNK_ROWS = 8_192, 256


def point_in_window(points: DataFrame, windows: DataFrame, flank: int, width: int | None = None) -> DataFrame:
    """(chrom, pos, ...) with each (chrom, r_start, r_stop, ...) that holds the position once widened by ``flank``.

    The result may have the square of the rows, so tasks and the order of pairs are made for that. Points are range-partitioned by place and
    gathered in chunks of neighbours. A window goes to the ranges that it meets, not to points, and a range of many windows is dealt out, so
    that a cell, which is a task, has ``CELL_ROWS`` points and windows, about, and none holds a hot place. A cell lists chunk by chunk, in a chunk
    window by window, first where the window holds the whole chunk: a window's columns stay the same over a chunk and the points repeat from window
    to window, so that a format that encodes repeats needs a fraction of a byte for a pair. ``width``: of the bins in which windows meet ranges.
    """
    wide = windows.withColumns({"r_start": F.col("r_start") - flank, "r_stop": F.col("r_stop") + flank})
    own, theirs = ([c for c in df.columns if c != "chrom"] for df in (points, windows))
    some = points.where("chrom is not null and pos is not null")
    n = max(int(some.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-some.count() // CELL_ROWS))
    ranged = some.repartitionByRange(n, "chrom", "pos", F.xxhash64(*own)).sortWithinPartitions("chrom", "pos").withColumn("__part", F.spark_partition_id())
    chunked = ranged.withColumn("__chunk", F.expr(f"monotonically_increasing_id() div {CHUNK_ROWS}"))  # these ids number the rows of a partition
    chunks = settled(chunked.repartitionById(n, F.col("__part")).groupBy("chrom", "__part", "__chunk").agg(F.min("pos").alias("__low"), F.max("pos").alias("__high"), F.collect_list(F.struct(*own)).alias("__points")))
    ranges = chunks.groupBy("chrom", "__part").agg(F.min("__low").alias("start"), F.max("__high").alias("stop"), F.min("__chunk").alias("__from"), F.max("__chunk").alias("__to"))
    met = settled(overlap_join(F.broadcast(ranges), wide, width).drop("start", "stop"))
    by_range = met.groupBy("chrom", "__part").agg(F.ceil(F.count("*") / CELL_ROWS).cast("int").alias("__n"))
    cells = F.broadcast(by_range.withColumn("__last", F.sum("__n").over(Window.orderBy("chrom", "__part")).cast("int")))  # a row for each range
    n_cells = cells.agg(F.max("__last")).first()[0] or 1
    ours = chunks.join(cells, ["chrom", "__part"]).select(F.explode(F.sequence(F.col("__last") - F.col("__n"), F.col("__last") - 1)).alias("__cell"), "__chunk", "__low", "__high", "__points")
    one_of = (F.col("__last") - 1 - F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.col("__n"))).cast("int")
    held = met.join(cells, ["chrom", "__part"]).select(one_of.alias("__cell"), "chrom", "__from", "__to", *theirs).repartitionById(n_cells, F.col("__cell"))
    # windows stream past one chunk, so that Spark holds a chunk's pairs at a time and not those of all windows
    both = held.withColumn("__chunk", F.explode(F.sequence("__from", "__to"))).join(ours.repartitionById(n_cells, F.col("__cell")).hint("merge"), ["__cell", "__chunk"])
    listed = lambda pairs: pairs.select("chrom", *theirs, F.explode("__points").alias("__point"))
    whole, meets = "r_start <= __low and __high <= r_stop", "r_start <= __high and __low <= r_stop"
    found = listed(both.where(whole)).unionByName(listed(both.where(f"{meets} and not ({whole})")).where("__point.pos between r_start and r_stop"))
    return found.select("chrom", *[f"__point.{c}" for c in own], *theirs).withColumns({"r_start": F.col("r_start") + flank, "r_stop": F.col("r_stop") - flank})


#: Rows of a range partition of ``nearest_join``, about.
PART_ROWS = 100_000


def nearest_join(queries: DataFrame, subjects: DataFrame, key: str, width: int = 0, coarse: int = 0) -> DataFrame:
    """Each query (key, chrom, start, stop) with its nearest subject (chrom, r_start, r_stop): r_start, r_stop, distance.

    Ties go to the smallest (distance, r_start, r_stop); queries without a subject on the chromosome stay, with nulls. Overlapping
    pairs are never listed: of the subjects that end at start - 1 or later, the first by (r_start, r_stop) is the best one that overlaps, if any
    does, and else the first that starts after the query; of the others, the one that ends last is best. Both are running values
    over the subjects' ends and the queries' starts in one order. Rows are range-partitioned by that order, and the
    best of each partition is carried into the others through a small table, so that no task holds a chromosome or a hot place. Each range
    stays one task's, and queries are dealt by number: larger tables have more tasks, not larger ones.
    ``width`` and ``coarse``, which sized bins before, are accepted and not needed.
    """
    q = queries.select(key, "chrom", F.col("start").cast("long").alias("start"), F.col("stop").cast("long").alias("stop")).where("chrom is not null and start is not null and stop is not null")
    s = subjects.select("chrom", F.col("r_start").cast("long").alias("r_start"), F.col("r_stop").cast("long").alias("r_stop")).where("chrom is not null and r_start <= r_stop")
    none = lambda kind: F.lit(None).cast(kind)
    rows = s.select("chrom", F.col("r_stop").alias("at"), F.lit(1).alias("side"), "r_start", "r_stop", none(q.schema[key].dataType).alias(key), none("long").alias("start"), none("long").alias("stop")).unionByName(
        q.select("chrom", F.least(F.col("start") - 1, "stop").alias("at"), F.lit(0).alias("side"), none("long").alias("r_start"), none("long").alias("r_stop"), key, "start", "stop")
    )
    n_queries = queries.count()
    n = max(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-(n_queries + s.count()) // PART_ROWS))
    order = ["chrom", "at", "side"]
    parts = settled(rows.repartitionByRange(n, *order, F.xxhash64("r_start", key)).withColumn("__part", F.spark_partition_id()))
    ended = F.when(F.col("side") == 1, F.struct(F.col("r_stop").alias("a"), (-F.col("r_start")).alias("b")))
    first = F.when(F.col("side") == 1, F.struct(F.col("r_start").alias("a"), F.col("r_stop").alias("b")))
    whole = parts.groupBy("chrom", "__part").agg(F.max(ended).alias("ended"), F.min(first).alias("first"))
    by_part = Window.partitionBy("chrom").rowsBetween(Window.unboundedPreceding, -1)
    carried = whole.select("chrom", "__part", F.max("ended").over(by_part.orderBy("__part")).alias("__ended"), F.min("first").over(by_part.orderBy(F.desc("__part"))).alias("__first"))
    here = Window.partitionBy("chrom", "__part").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    found = parts.repartitionById(n, F.col("__part")).withColumn("ended", F.max(ended).over(here.orderBy("at", "side"))).withColumn("first", F.min(first).over(here.orderBy(F.desc("at"), F.desc("side"))))
    found = found.where("side = 0").join(F.broadcast(carried), ["chrom", "__part"]).select(key, "start", "stop", F.greatest("ended", "__ended").alias("ended"), F.least("first", "__first").alias("first"))

    def judged(r_start: Column, r_stop: Column) -> Column:
        far = distance(F.col("start"), F.col("stop"), r_start, r_stop).cast("long")
        return F.when(r_start.isNotNull(), F.struct(far.alias("distance"), r_start.alias("r_start"), r_stop.alias("r_stop")))

    nearest = F.least(judged(-F.col("ended.b"), F.col("ended.a")), judged(F.col("first.a"), F.col("first.b")))
    best = dealt(found.select(key, nearest.alias("n")), n_queries, key).groupBy(key).agg(F.min("n").alias("n"))
    return dealt(queries, n_queries, key).join(best, key, "left").select(*queries.columns, "n.r_start", "n.r_stop", "n.distance")


def lifted(df: DataFrame, blocks: DataFrame, key: str, width: int) -> tuple[DataFrame, DataFrame]:
    """(mapped, unmapped) for intervals (key, chrom, start, stop) by a table of aligned blocks.

    ``blocks``: chrom, src_start, src_stop, dst_chrom, shift, strand. On ``+`` positions move by ``shift``; on ``-`` they
    are mirrored in the block first. Each piece of an interval that lies in a block is lifted (its part within the block); an
    interval in no block is unmapped. Fragments of one interval are merged by ``merged_fragments``.
    """
    side = blocks.select("chrom", F.col("src_start").alias("r_start"), F.col("src_stop").alias("r_stop"), "dst_chrom", "shift", "strand")
    hits = overlap_join(df.select(key, "chrom", "start", "stop"), side, width)
    a, b = F.greatest("start", "r_start"), F.least("stop", "r_stop")
    mirror = F.col("r_start") + F.col("r_stop")
    low = F.when(F.col("strand") == "-", mirror - b).otherwise(a) + F.col("shift")
    high = F.when(F.col("strand") == "-", mirror - a).otherwise(b) + F.col("shift")
    mapped = hits.select(key, F.col("dst_chrom").alias("chrom"), low.alias("start"), high.alias("stop"), "strand")
    return mapped, df.join(mapped.select(key), key, "left_anti")


def merged_fragments(df: DataFrame, key: str) -> DataFrame:
    """Least start and largest stop of each key and chromosome, and the number of fragments."""
    return df.groupBy(key, "chrom").agg(F.min("start").alias("start"), F.max("stop").alias("stop"), F.count("*").alias("n_fragments"))


def bin_window(start: Column, stop: Column, size: int = 128, n_bins: int = 896, pad: int = 1) -> tuple[Column, Column]:
    """(first, last exclusive) bin of the genome for an interval: its bins within the window around its centre, padded.

    The window starts ``n_bins // 2`` bins before the bin of the centre, but offsets within it count from the unrounded
    window start; an offset in bin i of the window is numbered i + 1.
    """
    middle = F.ceil((start + stop) / F.lit(2.0))
    window = F.floor((middle - 1) / size) - n_bins // 2
    begin = start - (middle - F.lit(size * n_bins / 2.0))
    place = lambda x: F.floor(x / size) + 1
    low, high = place(begin), place(begin + (stop - start) - 1)
    high = high + F.when(stop - start > size, 1).otherwise(0)
    high = F.when(high == low, high + 1).otherwise(high)
    return (window + low - pad).cast("long"), (window + high + pad).cast("long")


def bin_sums(loci: DataFrame, bins: DataFrame, key: list[str], values: str) -> DataFrame:
    """(key..., n, sums) for loci (key..., chrom, low, high): how many rows of ``bins`` (chrom, bin, values) lie in [low, high), and their sum.

    ``values`` is an array of one width; rows where it is null don't count, nor do null elements in a sum. Loci without bins,
    with low >= high or nulls have no row. No bin is repeated for a locus: bins and the loci's ends are range-partitioned
    by place, a running sum gives what lies before each end, and a locus is the difference of two of them. Sums begin anew with each
    partition and chromosome; a locus across partitions gets the totals of those in between, a row for each partition.
    """
    loci = settled(loci.where("low < high").select(*key, "chrom", "low", "high").withColumn("__id", F.monotonically_increasing_id()))
    end = F.explode(F.array(F.struct(F.col("low").cast("long").alias("at"), F.lit(0).alias("side")), F.struct(F.col("high").cast("long").alias("at"), F.lit(1).alias("side")))).alias("e")
    ends = loci.select("__id", "chrom", end).select("__id", "chrom", "e.at", "e.side", F.lit(None).cast("array<double>").alias("v"))
    own = bins.where(F.col(values).isNotNull()).select(F.lit(-1).cast("long").alias("__id"), "chrom", F.col("bin").cast("long").alias("at"), F.lit(2).alias("side"), F.col(values).cast("array<double>").alias("v"))
    order = ["chrom", "at", "side"]
    n = int(loci.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = ends.unionByName(own).repartitionByRange(n, *order).sortWithinPartitions(*order).withColumn("part", F.spark_partition_id())

    def run(batches):
        chrom, total, part = None, None, 0
        for batch in batches:
            out = []
            part = int(batch.part.iloc[0]) if len(batch) else part
            for _, own in batch.groupby((batch.chrom != batch.chrom.shift()).cumsum(), sort=False):
                if own.chrom.iloc[0] != chrom:
                    if total is not None:
                        out.append(pd.DataFrame({"__id": [-1], "chrom": chrom, "side": 2, "part": part, "s": [total]}))
                    chrom, total = own.chrom.iloc[0], None
                is_bin = (own.side == 2).to_numpy()
                if is_bin.any():
                    v = np.stack(own.v[is_bin].to_numpy())
                    run_ = np.cumsum(np.column_stack([np.nan_to_num(v.astype(float)), np.ones(len(v))]), axis=0)
                    run_ = np.vstack([np.zeros(run_.shape[1]), run_]) + (0.0 if total is None else total)
                else:
                    run_ = None if total is None else total[None, :]
                points = own[~is_bin]
                if len(points):
                    seen = np.cumsum(is_bin)[~is_bin]
                    out.append(points[["__id", "chrom", "side", "part"]].assign(s=[None] * len(points) if run_ is None else list(run_[seen])))
                total = total if run_ is None else run_[-1]
            if out:
                yield pd.concat(out)
        if total is not None:
            yield pd.DataFrame({"__id": [-1], "chrom": chrom, "side": 2, "part": part, "s": [total]})

    made = settled(dealt.mapInPandas(run, f"__id bigint, chrom {loci.schema['chrom'].dataType.simpleString()}, side int, part int, s array<double>"))
    less = lambda x, y: F.zip_with(x, y, lambda p, q: p - q)
    plus = lambda x, y: F.zip_with(x, y, lambda p, q: p + q)
    pick = lambda name, side: F.first(F.when(F.col("side") == side, F.col(name)), ignorenulls=True)
    both = made.where("side < 2").groupBy("__id", "chrom").agg(pick("part", 0).alias("p0"), pick("s", 0).alias("s0"), pick("part", 1).alias("p1"), pick("s", 1).alias("s1"))
    totals = made.where("side = 2").select("chrom", "part", F.col("s").alias("total"))
    across = both.where("p0 < p1").select("__id", "chrom", F.explode(F.sequence("p0", F.col("p1") - 1)).alias("part")).join(totals, ["chrom", "part"])
    found = both.join(across.groupBy("__id").agg(F.collect_list("total").alias("totals")), "__id", "left")
    zero = F.transform(F.coalesce("s1", "s0", F.col("totals")[0]), lambda _: F.lit(0.0))
    up_to = F.aggregate(F.coalesce("totals", F.array().cast("array<array<double>>")), F.coalesce("s1", zero), plus)
    whole = found.select("__id", less(up_to, F.coalesce("s0", zero)).alias("s")).join(loci, "__id")
    return whole.select(*key, F.element_at("s", -1).cast("long").alias("n"), F.slice("s", 1, F.size("s") - 1).alias("sums")).where("n > 0")


def bin_means(loci: DataFrame, bins: DataFrame, key: list[str], values: str) -> DataFrame:
    """(key..., n, values): means of the arrays of ``bin_sums``; all rows of ``bins`` have a value in each place."""
    return bin_sums(loci, bins, key, values).select(*key, "n", F.transform("sums", lambda v: F.try_divide(v, F.col("n"))).alias(values))


def window_around(locus: Column, flank: int) -> list[Column]:
    """``chr:pos`` as chrom, start, stop of ``flank`` on each side; start is 1 at least."""
    parts = F.split(locus, ":")
    pos = F.try_element_at(parts, F.lit(2)).try_cast("long")
    return [F.try_element_at(parts, F.lit(1)).alias("chrom"), F.greatest(pos - flank, F.lit(1)).alias("start"), (pos + flank).alias("stop")]
