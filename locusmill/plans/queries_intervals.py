"""Queries: intervals (j9-j16, x28, x29, x31, x33, g20)."""

from __future__ import annotations

from pyspark.sql import functions as F

from locusmill.functions import columns as C
from locusmill.operators import groups as G, intervals as I, rows as R
from locusmill.operators.ranks import share_of_total, top_rows
from locusmill.plans.base import query, rounded

_RIGHT = {"start": "r_start", "stop": "r_stop"}


@query("j9_overlap", "SELECT a.id, a.chrom, b.start AS r_start, b.stop AS r_stop FROM {peaks} a JOIN {blocks} b ON a.chrom = b.chrom AND a.start <= b.stop AND b.start <= a.stop")
def j9(t):
    return I.overlap_join(t.peaks, t.blocks.withColumnsRenamed(_RIGHT), 21_600).select("id", "chrom", "r_start", "r_stop")


@query("j10_overlap_with_gap", "SELECT a.id, b.gene FROM {peaks} a JOIN {genes} b ON a.chrom = b.chrom AND greatest(a.start, b.start) - least(a.stop, b.stop) - 1 <= 5000")
def j10(t):
    return I.overlap_join(t.peaks, t.genes.withColumnsRenamed(_RIGHT), 8_192, max_gap=5_000).select("id", "gene")


@query("j11_point_in_window", "SELECT s.snp, g.gene, g.start, g.stop FROM {snps} s JOIN {genes} g ON s.chrom = g.chrom AND s.pos BETWEEN g.start - 20000 AND g.stop + 20000")
def j11(t):
    found = I.point_in_window(t.snps, t.genes.withColumnsRenamed(_RIGHT), 20_000, 40_000)
    return found.select("snp", "gene", F.col("r_start").alias("start"), F.col("r_stop").alias("stop"))


_NEAREST = """SELECT q.id, q.chrom, n.r_start, n.r_stop, n.distance FROM (SELECT id, chrom, start, stop FROM {peaks}) q LEFT JOIN (SELECT * FROM (
SELECT a.id, b.start AS r_start, b.stop AS r_stop, greatest(0, greatest(a.start, b.start) - least(a.stop, b.stop) - 1) AS distance,
row_number() OVER (PARTITION BY a.id ORDER BY greatest(0, greatest(a.start, b.start) - least(a.stop, b.stop) - 1), b.start, b.stop) AS k FROM {peaks} a JOIN {genes} b USING (chrom)) w WHERE k = 1) n ON q.id = n.id"""


@query("j12_nearest", _NEAREST)
def j12(t):
    return I.nearest_join(t.peaks, t.genes.withColumnsRenamed(_RIGHT), "id", 4_096, coarse=200_000).select("id", "chrom", "r_start", "r_stop", "distance")


_LIFT = """h AS (SELECT p.id, b.dst_chrom AS chrom, b.strand, b.src_start + b.src_stop AS mirror, greatest(p.start, b.src_start) AS lo, least(p.stop, b.src_stop) AS hi, b.shift
FROM {peaks} p JOIN {lift} b ON p.chrom = b.chrom AND p.start <= b.src_stop AND b.src_start <= p.stop),
m AS (SELECT id, chrom, CASE WHEN strand = '-' THEN mirror - hi ELSE lo END + shift AS start, CASE WHEN strand = '-' THEN mirror - lo ELSE hi END + shift AS stop FROM h)"""


@query("j13_lift_over", f"WITH {_LIFT} SELECT id, chrom, start, stop, true AS mapped FROM m UNION ALL SELECT id, chrom, start, stop, false FROM {{peaks}} p WHERE NOT EXISTS (SELECT 1 FROM m WHERE m.id = p.id)")
def j13(t):
    mapped, unmapped = I.lifted(t.peaks, t.lift, "id", 86_400)
    both = {"true": mapped.select("id", "chrom", "start", "stop"), "false": unmapped.select("id", "chrom", "start", "stop")}
    return R.tagged_union(both, "mapped").withColumn("mapped", F.col("mapped") == "true")


@query("j14_merge_fragments", f"WITH {_LIFT} SELECT id, chrom, min(start) AS start, max(stop) AS stop, count(*) AS n_fragments FROM m GROUP BY id, chrom")
def j14(t):
    return I.merged_fragments(I.lifted(t.peaks, t.lift, "id", 86_400)[0], "id")


@query("j15_in_own_peak", "SELECT chrom, sum((pos % 4000 BETWEEN 1000 AND 2500)::INTEGER)::BIGINT AS n_in, sum((pos % 4000 NOT BETWEEN 1000 AND 2500)::INTEGER)::BIGINT AS n_out FROM {snps} GROUP BY chrom")
def j15(t):
    side = t.snps.select("chrom", F.when((F.col("pos") % 4000).between(1000, 2500), "n_in").otherwise("n_out").alias("side")).groupBy("chrom", "side").count()
    return G.wider(side, ["chrom"], "side", "count", ["n_in", "n_out"], 0)


_WINDOW = """w AS (SELECT id, chrom, start, stop, ceil((start + stop) / 2e0)::BIGINT AS mid FROM {peaks}),
o AS (SELECT *, floor((mid - 1) / 128e0)::BIGINT - 448 AS b0, start - (mid - 57344) AS s0 FROM w),
d AS (SELECT *, floor(s0 / 128e0)::BIGINT + 1 AS lo, floor((s0 + stop - start - 1) / 128e0)::BIGINT + 1 + (stop - start > 128)::INTEGER AS hi FROM o),
e AS (SELECT id, chrom, b0 + lo - 1 AS low, b0 + CASE WHEN hi = lo THEN hi + 1 ELSE hi END + 1 AS high FROM d)"""


@query("j16_bin_range", f"WITH {_WINDOW} SELECT id, low, high, (high - low)::BIGINT AS n_bins, count(x) AS n_found, round(avg(x), 6) + 0e0 AS mean FROM e LEFT JOIN {{tracks}} b ON b.chrom = e.chrom AND bin >= low AND bin < high GROUP BY id, low, high")
def j16(t):
    low, high = I.bin_window(F.col("start"), F.col("stop"))
    loci = t.peaks.select("id", "chrom", low.alias("low"), high.alias("high"))
    tracks = t.tracks.where("x is not null").select("chrom", "bin", F.array("x").alias("values"))
    found = I.bin_means(loci, tracks, ["id"], "values").select("id", F.col("n").alias("n_found"), F.col("values")[0].alias("mean"))
    out = loci.join(found, "id", "left").select("id", "low", "high", (F.col("high") - F.col("low")).alias("n_bins"), F.coalesce("n_found", F.lit(0)).alias("n_found"), "mean")
    return rounded(out, "mean")


@query("g20_mean_bins", "WITH l AS (SELECT DISTINCT label AS chrom, (vec_id // 10) % 40 AS low FROM embeddings) SELECT l.chrom, l.low, feature, round(avg(x), 6) + 0e0 AS x FROM l JOIN {bins} b ON b.chrom = l.chrom AND b.bin >= l.low AND b.bin < l.low + 4 GROUP BY l.chrom, l.low, feature")
def g20(t):
    loci = t.embeddings.select(F.col("label").alias("chrom"), (F.floor(F.col("vec_id") / 10) % 40).cast("long").alias("low")).distinct()
    bins = t.embeddings.select(F.col("label").alias("chrom"), F.floor(F.col("vec_id") / 10).cast("long").alias("bin"), "embedding")
    loci = loci.select(F.concat_ws(":", "chrom", "low").alias("locus"), "chrom", "low", (F.col("low") + 4).alias("high"))
    mean = I.bin_means(loci, bins, ["locus"], "embedding").withColumns({n: F.split("locus", ":")[i].cast("long") for i, n in enumerate(("chrom", "low"))})
    return rounded(mean.select("chrom", "low", F.posexplode("embedding").alias("feature", "x")), "x")


@query("x28_distance_matrix", """SELECT id, max(CASE WHEN tf = 0 THEN d END) AS tf0, max(CASE WHEN tf = 1 THEN d END) AS tf1, max(CASE WHEN tf = 2 THEN d END) AS tf2 FROM (
SELECT a.id, b.gene % 3 AS tf, min(greatest(0, greatest(a.start, b.start) - least(a.stop, b.stop) - 1)) AS d FROM {peaks} a JOIN {genes} b USING (chrom) GROUP BY a.id, b.gene % 3) q GROUP BY id""")
def x28(t):
    """All factors in one job: the chromosome key also carries the factor."""
    tfs = t.spark.range(3).select(F.col("id").alias("tf"))
    q = t.peaks.crossJoin(F.broadcast(tfs)).select(F.struct("id", "tf").alias("key"), (F.col("chrom") * 8 + F.col("tf")).alias("chrom"), "start", "stop")
    s = t.genes.select((F.col("chrom") * 8 + F.col("gene") % 3).alias("chrom"), F.col("start").alias("r_start"), F.col("stop").alias("r_stop"))
    near = I.nearest_join(q, s, "key", 4_096, coarse=200_000).where("distance is not null").select("key.id", F.concat(F.lit("tf"), "key.tf").alias("tf"), "distance")
    near = R.dealt(near, 3 * t.peaks.count(), "id")
    return G.wider(near, ["id"], "tf", "distance", ["tf0", "tf1", "tf2"])


@query("x29_candidate_windows", "SELECT snp, 'chr' || chrom AS chrom, greatest(pos - 500, 1) AS start, pos + 500 AS stop FROM {snps}")
def x29(t):
    key = F.format_string("chr%d:%d", "chrom", "pos")
    return t.snps.select("snp", *I.window_around(key, 500))


@query("x31_distance_effect", """SELECT bin, count(*) AS n, round(avg(abs(beta)), 6) AS mean_abs, round(count(*) * 1e2 / sum(count(*)) OVER (), 6) AS percent FROM (
SELECT beta, CASE WHEN ceil(abs(distance) / 1e5)::BIGINT BETWEEN 1 AND 5 THEN ceil(abs(distance) / 1e5)::BIGINT END AS bin FROM {effects} WHERE beta <> 0) q WHERE bin IS NOT NULL GROUP BY bin""")
def x31(t):
    rows = t.effects.where("beta <> 0").withColumn("bin", C.cut_bin(F.col("distance"), 1e5, 5)).where("bin is not null")
    by = rows.groupBy("bin").agg(F.count("*").alias("n"), F.avg(F.abs("beta")).alias("mean_abs"))
    return rounded(share_of_total(by, "n"), "mean_abs", "percent")


@query("x33_locus_zoom", """SELECT g.gene, s.snp, s.pos, s.pos - g.start AS offset_ FROM (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY chrom ORDER BY start, gene) AS k FROM {genes}) q WHERE k = 1) g
JOIN {snps} s ON g.chrom = s.chrom AND s.pos BETWEEN g.start - 50000 AND g.stop + 50000""")
def x33(t):
    """The chosen genes are each chromosome's first ones."""
    chosen = top_rows(t.genes, ["chrom"], 1, F.col("start"), F.col("gene")).withColumnsRenamed(_RIGHT)
    return I.point_in_window(t.snps, chosen, 50_000, 100_000).select("gene", "snp", "pos", (F.col("pos") - F.col("r_start")).alias("offset_"))
