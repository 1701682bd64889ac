"""Queries: aggregation and reshaping (g), windows and ranks (w)."""

from __future__ import annotations

from pyspark.sql import functions as F

from locusmill.functions import columns as C
from locusmill.operators import groups as G, ranks as W, rows as R
from locusmill.plans.base import query, r, rounded


@query("g1_counts", "SELECT l_returnflag, l_linestatus, count(*) AS n FROM lineitem GROUP BY l_returnflag, l_linestatus")
def g1(t):
    return G.counted(t.lineitem, "l_returnflag", "l_linestatus").orderBy(F.desc("n"))


@query("g2_summary", "SELECT tf, count(zscore) AS n, round(avg(abs(zscore)), 6) AS mean_abs, round(max(abs(zscore)), 6) AS max_abs, round(median(abs(zscore)), 6) AS median_abs FROM {assoc} GROUP BY tf")
def g2(t):
    return rounded(G.summary(t.assoc, ["tf"], "zscore"), "mean_abs", "max_abs", "median_abs")


@query("g3_distinct_counts", "SELECT tissue, count(DISTINCT tf) AS n_tf, count(DISTINCT locus) AS n_loci FROM {assoc} GROUP BY tissue")
def g3(t):
    return t.assoc.groupBy("tissue").agg(F.countDistinct("tf").alias("n_tf"), F.countDistinct("locus").alias("n_loci"))


@query("g4_frequencies", "SELECT tissue, pvalue < 5e-2 AS small, count(*) AS n, round(count(*) / (sum(count(*)) OVER ())::DOUBLE, 6) AS share FROM {assoc} GROUP BY 1, 2")
def g4(t):
    return rounded(G.frequencies(t.assoc.withColumn("small", F.col("pvalue") < 0.05), "tissue", "small"), "share")


@query("g5_count_of_counts", "SELECT size, count(*) AS n FROM (SELECT l_orderkey, count(*) AS size FROM lineitem GROUP BY l_orderkey) q GROUP BY size")
def g5(t):
    return G.counts_of_counts(t.lineitem, "l_orderkey")


@query("g6_repeated_keys", "SELECT l_orderkey, l_linenumber, l_partkey FROM lineitem WHERE (l_orderkey, l_linenumber) IN (SELECT (l_orderkey, l_linenumber) FROM lineitem GROUP BY l_orderkey, l_linenumber HAVING count(*) > 1)")
def g6(t):
    return G.repeated(t.lineitem.select("l_orderkey", "l_linenumber", "l_partkey"), ["l_orderkey", "l_linenumber"])


@query("g7_six_numbers", "SELECT l_returnflag, min(l_extendedprice) AS min, round(quantile_cont(l_extendedprice, 0.25), 4) AS q1, round(median(l_extendedprice), 4) AS median, round(avg(l_extendedprice), 4) AS mean, round(quantile_cont(l_extendedprice, 0.75), 4) AS q3, max(l_extendedprice) AS max FROM lineitem GROUP BY l_returnflag")
def g7(t):
    return rounded(G.six_numbers(t.lineitem, ["l_returnflag"], "l_extendedprice"), "q1", "median", "mean", "q3", digits=4)


@query("g8_fractions", "SELECT round(avg((zscore > 0)::INTEGER), 6) AS share_positive, count_if(pvalue < 1e-2)::BIGINT AS n_small FROM {assoc}")
def g8(t):
    return t.assoc.agg(r(F.avg((F.col("zscore") > 0).cast("int"))).alias("share_positive"), F.count_if(F.col("pvalue") < 0.01).alias("n_small"))


_TISSUES = ["ECONOMY", "PROMO", "STANDARD"]


@query("g9_pivot_wider", "SELECT locus, coalesce(max(CASE WHEN tissue = 'ECONOMY' THEN l_partkey END), 0) AS \"ECONOMY\", coalesce(max(CASE WHEN tissue = 'PROMO' THEN l_partkey END), 0) AS \"PROMO\", coalesce(max(CASE WHEN tissue = 'STANDARD' THEN l_partkey END), 0) AS \"STANDARD\" FROM {assoc} GROUP BY locus")
def g9(t):
    return G.wider(t.assoc, ["locus"], "tissue", "l_partkey", _TISSUES, 0)


@query("g10_pivot_longer", "SELECT l_orderkey, l_linenumber, name, value FROM (SELECT l_orderkey, l_linenumber, l_quantity, l_discount, l_tax FROM lineitem) q UNPIVOT INCLUDE NULLS (value FOR name IN (l_quantity, l_discount, l_tax))")
def g10(t):
    return G.longer(t.lineitem, ["l_orderkey", "l_linenumber"], ["l_quantity", "l_discount", "l_tax"])


@query("g11_histogram", "SELECT floor((l_extendedprice - 1e3) / 5e3)::BIGINT AS bin, count(*) AS n FROM lineitem GROUP BY 1")
def g11(t):
    return G.histogram(t.lineitem, C.bin_number(F.col("l_extendedprice"), 5e3, 1e3))


@query("g12_cut_bins", "SELECT bin, count(*) AS n FROM (SELECT ceil(abs(distance) / 5e4)::BIGINT AS bin FROM {effects}) q WHERE bin BETWEEN 1 AND 8 GROUP BY bin")
def g12(t):
    return G.histogram(t.effects, C.cut_bin(F.col("distance"), 5e4, 8))


@query("g13_row_means", "SELECT vec_id, round(avg(CASE WHEN x > -1e-1 THEN x END), 6) + 0e0 AS mean FROM {x_long} GROUP BY vec_id")
def g13(t):
    return rounded(G.row_means(t.x_long.withColumn("x", F.when(F.col("x") > -0.1, F.col("x"))), "vec_id", "x"), "mean")


@query("g14_arg_max", "SELECT vec_id, feature, round(x, 6) + 0e0 AS x FROM (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY x DESC, feature) AS n FROM {x_long}) q WHERE n = 1")
def g14(t):
    return rounded(G.arg_max(t.x_long, "vec_id", "feature", "x"), "x")


@query("g15_totals_joined", "SELECT p.p_partkey, p.p_brand, n FROM part p JOIN (SELECT p_brand, count(*) AS n FROM part GROUP BY p_brand) q USING (p_brand)")
def g15(t):
    return t.part.select("p_partkey", "p_brand").join(G.counted(t.part, "p_brand"), "p_brand")


@query("g16_sums", "SELECT tissue, round(sum(zscore), 4) + 0e0 AS total FROM {assoc} GROUP BY tissue")
def g16(t):
    return t.assoc.groupBy("tissue").agg(r(F.sum("zscore"), 4).alias("total"))


_ACAT = "SELECT tf, locus, 5e-1 - atan(avg(tan((5e-1 - least(pvalue, 1 - 1e-15)) * pi()))) / pi() AS p FROM {assoc} GROUP BY tf, locus"


@query("g17_cauchy", f"SELECT tf, locus, round(p, 8) AS p FROM ({_ACAT}) q")
def g17(t):
    return t.assoc.groupBy("tf", "locus").agg(r(C.p_combined(F.col("pvalue")), 8).alias("p"))


@query("g18_category_values", "SELECT tf, tissue, round(max(abs(zscore)), 6) AS top FROM {assoc} WHERE tissue IN ('ECONOMY', 'PROMO') GROUP BY tf, tissue")
def g18(t):
    kinds = t.spark.createDataFrame([("ECONOMY",), ("PROMO",)], "tissue string")
    rows = t.assoc.withColumn("size", F.abs("zscore")).join(F.broadcast(kinds), "tissue")
    return rows.groupBy("tf", "tissue").agg(r(F.max("size")).alias("top"))


@query("g19_venn", "SELECT count(*) FILTER (f.gene IS NOT NULL AND o.gene IS NOT NULL) AS n_both, count(*) FILTER (o.gene IS NULL) AS n_left, count(*) FILTER (f.gene IS NULL) AS n_right FROM {set_f} f FULL JOIN {set_o} o ON f.gene = o.gene")
def g19(t):
    return G.set_sizes(t.set_f, t.set_o, "gene")


@query("g21_checked_matrix", "SELECT label, count(*) AS n, round(sum(embedding[1]), 4) + 0e0 AS first_sum FROM (SELECT label, embedding::DOUBLE[] AS embedding FROM embeddings) e GROUP BY label")
def g21(t):
    rows = G.checked_matrix(t.embeddings, "embedding", 64)
    return rows.groupBy("label").agg(F.count("*").alias("n"), r(F.sum(F.col("embedding")[0].cast("double")), 4).alias("first_sum"))


@query("g22_against_reference", "SELECT tf, round(m, 6) AS m, round(ref, 6) AS reference, m > ref AS above FROM (SELECT tf, round(avg(abs(zscore)), 9) AS m FROM {assoc} GROUP BY tf) a, (SELECT round(avg(abs(zscore)), 9) AS ref FROM {assoc} WHERE tf = 'Brand#2') b")
def g22(t):
    by = t.assoc.groupBy("tf").agg(r(F.avg(F.abs("zscore")), 9).alias("m"))
    return rounded(G.against_reference(by, by.where("tf = 'Brand#2'"), "m"), "m", "reference")


@query("g23_transpose", """WITH c AS MATERIALIZED (SELECT feature FROM (SELECT unnest(range(64))::INTEGER AS feature, unnest(embedding)::DOUBLE AS x FROM embeddings WHERE label = 3) e GROUP BY feature HAVING avg(x) > 0),
x AS MATERIALIZED (SELECT vec_id, unnest(range(64))::INTEGER AS feature, unnest(embedding)::DOUBLE AS x FROM embeddings WHERE label = 3)
SELECT feature AS vec_id, vec_id AS feature, round(x, 6) + 0e0 AS x FROM x SEMI JOIN c USING (feature)""")
def g23(t):
    keep = t.embeddings.where("label = 3").select("vec_id")
    cols = t.w_long.where("model = 3 and w > 0").select("feature")
    return rounded(G.transposed(t.x_long, "vec_id", "feature", keep, cols), "x")


_RANKS = f"SELECT tf, locus, p, rank() OVER (PARTITION BY locus ORDER BY p) + (count(*) OVER (PARTITION BY locus, p) - 1) / 2e0 AS rank FROM (SELECT tf, locus, round(p, 8) AS p FROM ({_ACAT}) c) a"


@query("w1_average_ranks", f"SELECT tf, locus, rank FROM ({_RANKS}) q")
def w1(t):
    return W.average_rank(g17(t), "p", ["locus"]).select("tf", "locus", "rank")


@query("w2_factor_order", f"SELECT tf, round(median(rank), 6) AS median_rank, count(*) AS n_loci FROM ({_RANKS}) q GROUP BY tf")
def w2(t):
    """The flagship: combined p of each factor and locus, ranks of factors at each locus, order by their medians."""
    ranks = W.average_rank(g17(t), "p", ["locus"])
    medians = W.group_quantiles(ranks, ["tf"], F.col("rank"), {"median_rank": 0.5}, F.count("*").alias("n_loci"))
    return rounded(medians, "median_rank").select("tf", "median_rank", "n_loci").orderBy("median_rank", "tf")


@query("w4_sampled_rows")
def w4(t):
    rows = t.assoc.withColumn("key", F.concat_ws("-", "l_orderkey", "l_linenumber", "l_partkey"))
    return W.sampled_rows(rows, ["tf"], "key", 10, 7).select("tf", "key")


@query("w5_cumulative", "SELECT s_suppkey, round(sum(s_acctbal) OVER (ORDER BY s_acctbal DESC, s_suppkey DESC), 4) + 0e0 AS running FROM supplier")
def w5(t):
    return rounded(W.cumulative(t.supplier.select("s_suppkey", "s_acctbal"), "s_acctbal", ["s_acctbal", "s_suppkey"], "running", descending=True), "running", digits=4).select("s_suppkey", "running")


@query("w6_qq_uniform", "SELECT l_orderkey, l_linenumber, pvalue, round(row_number() OVER (ORDER BY pvalue, l_orderkey, l_linenumber, l_partkey) / (count(*) OVER () + 1e0), 8) AS expected FROM {assoc}")
def w6(t):
    q = W.qq_uniform(t.assoc, "pvalue", ["l_orderkey", "l_linenumber", "l_partkey"])
    return rounded(q.select("l_orderkey", "l_linenumber", "pvalue", "expected"), "expected", digits=8)


@query("w6_qq_normal")
def w6_normal(t):
    q = W.qq_normal(t.assoc, "zscore", ["l_orderkey", "l_linenumber", "l_partkey"])
    return rounded(q.select("l_orderkey", "l_linenumber", "zscore", "expected"), "expected")


@query("w7_qq_two_samples", """WITH a AS (SELECT zscore, row_number() OVER (ORDER BY zscore) AS i FROM {set_f}), b AS (SELECT zscore, row_number() OVER (ORDER BY zscore) AS k FROM {set_o}),
n AS (SELECT (SELECT count(*) FROM a) AS na, (SELECT count(*) FROM b) AS nb),
s AS (SELECT CASE WHEN na <= nb THEN 1 ELSE 0 END AS a_small, least(na, nb) AS n, greatest(na, nb) AS big FROM n),
few AS (SELECT i, zscore AS v FROM a, s WHERE a_small = 1 UNION ALL SELECT k, zscore FROM b, s WHERE a_small = 0),
many AS (SELECT k AS j, zscore AS v FROM b, s WHERE a_small = 1 UNION ALL SELECT i, zscore FROM a, s WHERE a_small = 0),
p AS (SELECT i, v, 1 + (i - 1) * ((big - 1) / greatest(n - 1, 1)::DOUBLE) AS pos, big, a_small FROM few, s),
o AS (SELECT p.i, p.v, a_small, lo.v + (pos - floor(pos)) * (hi.v - lo.v) AS w FROM p JOIN many lo ON lo.j = floor(pos)::BIGINT JOIN many hi ON hi.j = least(floor(pos)::BIGINT + 1, big))
SELECT i, round(CASE WHEN a_small = 1 THEN v ELSE w END, 6) + 0e0 AS x, round(CASE WHEN a_small = 1 THEN w ELSE v END, 6) + 0e0 AS y FROM o""")
def w7(t):
    q = W.qq_two_samples(t.set_f.select("zscore"), t.set_o.select("zscore"), "zscore")
    return rounded(q.withColumn("i", F.col("i").cast("long")), "x", "y")


@query("w8_bonferroni", "SELECT tf, locus, p < 5e-2 / count(*) OVER () AS significant FROM (SELECT tf, locus, round(p, 8) AS p FROM (" + _ACAT + ") c) q")
def w8(t):
    return W.bonferroni(g17(t), "p").select("tf", "locus", "significant")


@query("w9_q_values", "SELECT l_orderkey, l_linenumber, round(least(1e0, min(q) OVER (ORDER BY pvalue DESC ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)), 8) AS qvalue FROM (SELECT *, 8e-1 * pvalue * (count(*) OVER ()) / (rank() OVER (ORDER BY pvalue) + count(*) OVER (PARTITION BY pvalue) - 1) AS q FROM {assoc}) s")
def w9(t):
    return rounded(W.q_values(t.assoc, "pvalue", 0.8).select("l_orderkey", "l_linenumber", "qvalue"), "qvalue", digits=8)


_GENOME = "placed AS (SELECT snp, s.chrom, pos + coalesce(off, 0) AS genome_pos FROM {snps} s JOIN (SELECT chrom, sum(len) OVER (ORDER BY chrom ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)::BIGINT AS off FROM (SELECT chrom, max(pos) AS len FROM {snps} GROUP BY chrom) l) o ON s.chrom = o.chrom)"


@query("w10_genome_position", f"WITH {_GENOME} SELECT snp, chrom, genome_pos, round(avg(genome_pos) OVER (PARTITION BY chrom), 4) AS centre FROM placed")
def w10(t):
    placed, centres = W.genome_position(t.snps, "chrom", "pos")
    return rounded(placed.join(F.broadcast(centres), "chrom").select("snp", "chrom", "genome_pos", "centre"), "centre", digits=4)


@query("w11_share_of_total", "SELECT tf, n, round(n * 1e2 / sum(n) OVER (), 6) AS percent FROM (SELECT tf, count(*) AS n FROM {assoc} GROUP BY tf) q")
def w11(t):
    return rounded(W.share_of_total(G.counted(t.assoc, "tf"), "n"), "percent")


@query("w12_scaled", "SELECT vec_id, feature, round((x - avg(x) OVER (PARTITION BY feature)) / nullif(stddev_samp(x) OVER (PARTITION BY feature), 0), 5) + 0e0 AS z FROM {x_long}")
def w12(t):
    return rounded(W.scaled(t.x_long, ["feature"], "x", "z").select("vec_id", "feature", "z"), "z", digits=5)


@query("w13_extreme_rows", "SELECT tf, l_orderkey, l_linenumber, zscore FROM (SELECT *, max(zscore) OVER (PARTITION BY tf) AS top FROM {assoc}) q WHERE zscore = top")
def w13(t):
    return W.extreme_rows(t.assoc, ["tf"], "zscore").select("tf", "l_orderkey", "l_linenumber", "zscore")


@query("x30_manhattan", f"""WITH {_GENOME} SELECT p.snp, p.genome_pos, round(-log10(greatest(q.p, 1e-29)), 6) + 0e0 AS logp, CASE WHEN p.chrom % 2 = 0 THEN 'even' ELSE 'odd' END AS bucket, q.p < 5e-2 / count(*) OVER () AS significant, p.snp % 3 AS programme
FROM placed p JOIN (SELECT snp, ((snp * 7919) % 1000003 + 5e-1) / 1.000003e6 AS p FROM {{snps}}) q ON p.snp = q.snp""")
def x30(t):
    rows = t.snps.withColumn("p", ((F.col("snp") * 7919) % 1000003 + 0.5) / 1.000003e6)
    placed, _ = W.genome_position(rows, "chrom", "pos")
    labelled = placed.join(t.snps.select("snp", (F.col("snp") % 3).alias("programme")), "snp", "left")
    out = W.bonferroni(labelled, "p").withColumn("logp", C.minus_log10(F.col("p")))
    return rounded(out.select("snp", "genome_pos", "logp", C.parity_bucket(F.col("chrom")).alias("bucket"), "significant", "programme"), "logp")


@query("x32_training_curve", "SELECT n, count(*) AS n_models, round(avg(abs(zscore)), 6) AS mean_abs, round(max(abs(zscore)), 6) AS max_abs FROM (SELECT zscore, regexp_extract(tf, '(\\d+)', 1)::BIGINT AS n FROM {assoc}) q GROUP BY n")
def x32(t):
    rows = t.assoc.withColumn("n", F.regexp_extract("tf", r"(\d+)", 1).cast("long"))
    return rounded(rows.groupBy("n").agg(F.count("*").alias("n_models"), F.avg(F.abs("zscore")).alias("mean_abs"), F.max(F.abs("zscore")).alias("max_abs")), "mean_abs", "max_abs").orderBy("n")


@query("f3_column_aggregates", f"SELECT locus, round(median(rank), 6) AS median_rank FROM ({_RANKS}) q GROUP BY locus")
def f3(t):
    return rounded(W.group_quantiles(W.average_rank(g17(t), "p", ["locus"]), ["locus"], F.col("rank"), {"median_rank": 0.5}), "median_rank")


@query("f4_table_function", "SELECT chrom, k AS bin, count(*) AS n FROM (SELECT chrom, unnest(range(start // 600, stop // 600 + 1)) AS k FROM {peaks} WHERE start >= 0) q GROUP BY chrom, k")
def f4(t):
    cells = t.peaks.where("start >= 0").select("chrom", F.explode(F.sequence(C.bin_number(F.col("start"), 600), C.bin_number(F.col("stop"), 600))).alias("bin"))
    return G.counted(cells, "chrom", "bin")


@query("l1_by_lookup", "SELECT r_name, count(*) AS n FROM nation JOIN region ON r_regionkey = n_regionkey GROUP BY r_name")
def l1_lookup(t):
    return R.shaped(t.nation.join(F.broadcast(t.region), F.col("n_regionkey") == F.col("r_regionkey")).groupBy("r_name", "r_regionkey").agg(F.count("*").alias("n")).orderBy("r_regionkey"), ["r_name", "n"])
