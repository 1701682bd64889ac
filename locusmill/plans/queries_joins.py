"""Queries: equality joins (j1-j8, j17-j19)."""

from __future__ import annotations

from pyspark.sql import functions as F

from locusmill.functions.columns import locus_parts
from locusmill.operators import joins as J
from locusmill.plans.base import query, rounded


@query("j1_inner_renamed", "SELECT f.gene, f.zscore AS zscore_x, f.pvalue AS pvalue_x, o.zscore AS zscore_y, o.pvalue AS pvalue_y FROM {set_f} f JOIN {set_o} o ON f.gene = o.gene")
def j1(t):
    return J.joined(t.set_f, t.set_o.withColumnRenamed("gene", "id"), {"gene": "id"})


@query("j2_composite_key", "SELECT a.l_orderkey, a.l_linenumber, a.l_quantity, b.zscore FROM lineitem a JOIN {assoc} b USING (l_orderkey, l_linenumber, l_partkey)")
def j2(t):
    keys = ["l_orderkey", "l_linenumber", "l_partkey"]
    return t.lineitem.select(*keys, "l_quantity").join(t.assoc.select(*keys, "zscore"), keys).select("l_orderkey", "l_linenumber", "l_quantity", "zscore")


@query("j3_chained_left", "SELECT s_suppkey, n_name, r_name FROM supplier LEFT JOIN nation ON s_nationkey = n_nationkey AND n_nationkey < 20 LEFT JOIN region ON n_regionkey = r_regionkey")
def j3(t):
    n = t.nation.where("n_nationkey < 20").withColumnRenamed("n_nationkey", "s_nationkey")
    return t.supplier.join(n, "s_nationkey", "left").join(t.region.withColumnRenamed("r_regionkey", "n_regionkey"), "n_regionkey", "left").select("s_suppkey", "n_name", "r_name")


@query("j4_full_outer", "SELECT coalesce(f.gene, o.gene) AS gene, f.pvalue AS pvalue_x, o.pvalue AS pvalue_y FROM {set_f} f FULL JOIN {set_o} o ON f.gene = o.gene")
def j4(t):
    return J.joined(t.set_f.select("gene", "pvalue"), t.set_o.select("gene", "pvalue"), {"gene": "gene"}, "full")


@query("j5_first_match", """SELECT p_partkey, l_orderkey FROM part LEFT JOIN (SELECT l_partkey, l_orderkey, row_number() OVER (PARTITION BY l_partkey ORDER BY l_orderkey, l_linenumber) AS n FROM lineitem) q ON l_partkey = p_partkey AND n = 1""")
def j5(t):
    right = t.lineitem.select(F.col("l_partkey").alias("p_partkey"), "l_orderkey", "l_linenumber")
    return J.first_match(t.part, right, ["p_partkey"], ["l_orderkey", "l_linenumber"]).select("p_partkey", "l_orderkey")


@query("j6_many_full_joins", """SELECT gene, max(CASE WHEN s = 'f' THEN pvalue END) AS f, max(CASE WHEN s = 'o' THEN pvalue END) AS o, max(CASE WHEN s = 'all' THEN pvalue END) AS "all"
FROM (SELECT gene, pvalue, 'f' AS s FROM {set_f} UNION ALL SELECT gene, pvalue, 'o' FROM {set_o} UNION ALL SELECT l_partkey, min(pvalue), 'all' FROM {assoc} GROUP BY l_partkey) q GROUP BY gene""")
def j6(t):
    every = t.assoc.groupBy(F.col("l_partkey").alias("gene")).agg(F.min("pvalue").alias("pvalue"))
    return J.all_joined({"f": t.set_f, "o": t.set_o, "all": every}, "gene", "pvalue")


@query("j7_many_to_many", "SELECT p.p_partkey, n.n_nationkey FROM part p JOIN nation n ON p.p_size % 5 = n.n_regionkey")
def j7(t):
    left = t.part.select("p_partkey", (F.col("p_size") % 5).alias("k"))
    right = t.nation.select("n_nationkey", F.col("n_regionkey").alias("k"))
    return J.exploding(left, right, ["k"], 1_000_000_000).select("p_partkey", "n_nationkey")


@query("j8_provenance", """SELECT coalesce(f.gene, o.gene) AS gene, CASE WHEN f.gene IS NULL THEN 'right' WHEN o.gene IS NULL THEN 'left' ELSE 'both' END AS provenance FROM {set_f} f FULL JOIN {set_o} o ON f.gene = o.gene""")
def j8(t):
    return J.provenance(t.set_f, t.set_o, ["gene"])


@query("j17_common_keys", "SELECT gene FROM {set_f} INTERSECT SELECT gene FROM {set_o} INTERSECT SELECT p_partkey FROM part WHERE p_size > 10")
def j17(t):
    return J.common_keys([t.set_f, t.set_o, t.part.where("p_size > 10").select(F.col("p_partkey").alias("gene"))], ["gene"])


@query("j18_parameter_grid", "SELECT prior, r_name, k::BIGINT AS k FROM (VALUES ('exponential'), ('normal')) a(prior), region, range(2, 6) b(k)")
def j18(t):
    priors = t.spark.createDataFrame([("exponential",), ("normal",)], "prior string")
    return J.grid(priors, t.region.select("r_name"), t.spark.range(2, 6).withColumnRenamed("id", "k"))


@query("j19_exists_flag", "SELECT gene, gene IN (SELECT gene FROM {set_o}) AS also_open FROM {set_f}")
def j19(t):
    return J.flagged(t.set_f.select("gene"), t.set_o, ["gene"], "also_open")


@query("x7_format_model", """SELECT c.locus, split_part(a.name, '_', 1) AS chrom, split_part(a.name, '_', 2)::BIGINT AS start, a.name AS annotated, round(score, 6) AS score
FROM (SELECT locus, score FROM {cells} WHERE feature = 3) c LEFT JOIN (SELECT vec_id AS locus, 'chr' || (vec_id % 22 + 1) || '_' || (vec_id * 128) AS name FROM embeddings WHERE label <> 7) a USING (locus)""")
def x7(t):
    names = t.embeddings.where("label <> 7").select(F.col("vec_id").alias("locus"), F.format_string("chr%d_%d", F.col("vec_id") % 22 + 1, F.col("vec_id") * 128).alias("annotated"))
    one = J.formatted_model(t.cells, 3, names)
    chrom, start, _ = locus_parts(F.col("annotated"))
    return rounded(one.select("locus", chrom, start, "annotated", "score"), "score")
