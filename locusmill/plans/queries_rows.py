"""Queries: projections and filters (p), strings (st), sets (u), sorts (l)."""

from __future__ import annotations

from pyspark.sql import functions as F

from locusmill.functions import columns as C
from locusmill.operators import groups as G, ranks as W, rows as R
from locusmill.plans.base import query, r, rounded


@query("p1_shape", "SELECT l_partkey AS variant, l_suppkey AS locus, l_quantity FROM lineitem")
def p1(t):
    return R.shaped(t.lineitem, ["l_suppkey", "l_partkey", "l_quantity", "l_tax"], {"l_suppkey": "locus", "l_partkey": "variant"}, ["variant"], ["l_tax"])


@query("p2_experiment_qc", "SELECT l_orderkey, l_partkey, l_quantity, l_discount FROM lineitem WHERE l_quantity IS NOT NULL AND l_quantity > 3e1 AND l_discount >= 5e-2 AND l_returnflag IS NOT NULL")
def p2(t):
    return R.where_all(t.lineitem, F.col("l_quantity").isNotNull(), F.col("l_quantity") > 30, F.col("l_discount") >= 0.05, F.col("l_returnflag").isNotNull()).select("l_orderkey", "l_partkey", "l_quantity", "l_discount")


@query("p3_remove_then_anti", """WITH bad AS (SELECT DISTINCT s_suppkey FROM supplier WHERE s_acctbal < 0 OR s_nationkey IN (3, 5) OR nullif(s_acctbal, 0) IS NULL)
SELECT l_suppkey, count(*) AS n FROM lineitem WHERE NOT EXISTS (SELECT 1 FROM bad WHERE s_suppkey = l_suppkey) GROUP BY l_suppkey""")
def p3(t):
    bad = R.where_any(t.supplier, F.col("s_acctbal") < 0, F.col("s_nationkey").isin(3, 5), F.nullif(F.col("s_acctbal"), F.lit(0.0)).isNull())
    return G.counted(R.not_in_keys(t.lineitem, bad.withColumnRenamed("s_suppkey", "l_suppkey"), ["l_suppkey"]), "l_suppkey")


@query("p4_membership", "SELECT o_orderkey, o_custkey FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customer WHERE c_mktsegment = 'BUILDING')")
def p4(t):
    return R.in_keys(t.orders, t.customer.where("c_mktsegment = 'BUILDING'").withColumnRenamed("c_custkey", "o_custkey"), ["o_custkey"]).select("o_orderkey", "o_custkey")


@query("p5_blocklist", "SELECT o_orderkey, o_custkey FROM orders WHERE NOT EXISTS (SELECT 1 FROM customer WHERE c_mktsegment = 'BUILDING' AND c_custkey = o_custkey)")
def p5(t):
    return R.not_in_keys(t.orders, t.customer.where("c_mktsegment = 'BUILDING'").withColumnRenamed("c_custkey", "o_custkey"), ["o_custkey"]).select("o_orderkey", "o_custkey")


@query("p6_recode", "SELECT l_orderkey, l_linenumber, CASE l_returnflag WHEN 'A' THEN 'accepted' WHEN 'R' THEN 'returned' ELSE 'none' END AS flag, coalesce(nullif(CASE WHEN l_linenumber % 2 = 0 THEN '' ELSE l_linestatus END, ''), l_returnflag) AS target FROM lineitem")
def p6(t):
    return t.lineitem.select("l_orderkey", "l_linenumber", C.recode(F.col("l_returnflag"), {"A": "accepted", "R": "returned"}, "none").alias("flag"), C.filled(F.when(F.col("l_linenumber") % 2 == 0, "").otherwise(F.col("l_linestatus")), F.col("l_returnflag")).alias("target"))


@query("p7_casts", "SELECT l_orderkey, l_linenumber::BIGINT AS l_linenumber, l_quantity::BIGINT AS l_quantity, l_suppkey::VARCHAR AS l_suppkey FROM lineitem")
def p7(t):
    return R.cast_all(t.lineitem, {"l_linenumber": "bigint", "l_quantity": "bigint", "l_suppkey": "string"}).select("l_orderkey", "l_linenumber", "l_quantity", "l_suppkey")


@query("p8_complete", "SELECT rsid, chrom, pos, variant_id FROM {gwas} WHERE variant_id IS NOT NULL AND rsid IS NOT NULL")
def p8(t):
    return R.complete(t.gwas, ["rsid", "variant_id"]).select("rsid", "chrom", "pos", "variant_id")


@query("p9_finite", "SELECT l_orderkey, l_linenumber, round(1 / l_tax, 6) AS x FROM lineitem WHERE l_tax > 0")
def p9(t):
    x = F.when(F.col("l_tax") == 0, float("inf")).otherwise(1 / F.nullif(F.col("l_tax"), F.lit(0.0)))
    return rounded(t.lineitem.select("l_orderkey", "l_linenumber", x.alias("x")).where(C.finite(F.col("x"))), "x")


@query("p10_outside_sd", "SELECT l_orderkey, l_linenumber, distance FROM {effects}, (SELECT avg(distance) m, stddev_samp(distance) s FROM {effects}) q WHERE abs(distance - m) > 1.6e0 * s AND beta BETWEEN -4e-2 AND 4e-2")
def p10(t):
    return R.outside_sd(t.effects, "distance", 1.6).where(F.col("beta").between(-0.04, 0.04)).select("l_orderkey", "l_linenumber", "distance")


@query("p11_text_filters", "SELECT p_partkey, p_name FROM part WHERE contains(p_name, 'ring') OR regexp_matches(p_name, '^s.*t$') OR starts_with(p_name, 'red')")
def p11(t):
    n = F.col("p_name")
    return R.where_any(t.part, n.contains("ring"), n.rlike("^s.*t$"), n.startswith("red")).select("p_partkey", "p_name")


@query("p12_model_columns", """SELECT l_suppkey, coalesce(max(CASE WHEN m = '2_ECONOMY' THEN p END), 0) AS "2_ECONOMY", coalesce(max(CASE WHEN m = '3_ECONOMY' THEN p END), 0) AS "3_ECONOMY"
FROM (SELECT l_suppkey, replace(p_brand, 'Brand#', '') || '_' || p_type AS m, l_partkey AS p FROM lineitem JOIN part ON p_partkey = l_partkey) q GROUP BY l_suppkey""")
def p12(t):
    """Of a table with a column for each model those of one kind stay, the first model's left out."""
    models = [f"{b}_{k}" for k in ("ECONOMY", "PROMO") for b in (1, 2, 3)]
    rows = t.assoc.select(F.col("locus").alias("l_suppkey"), F.concat_ws("_", F.replace("tf", F.lit("Brand#"), F.lit("")), "tissue").alias("m"), F.col("l_partkey").alias("p"))
    wide = G.wider(rows, ["l_suppkey"], "m", "p", models, 0)
    first = R.columns_like(wide, prefix="1_")
    return wide.select("l_suppkey", *[f"`{c}`" for c in R.columns_like(wide, suffix="_ECONOMY") if c not in first])


@query("p13_distinct", "SELECT DISTINCT l_suppkey, l_returnflag FROM lineitem")
def p13(t):
    return t.lineitem.select("l_suppkey", "l_returnflag").distinct()


@query("p14_row_ids", "SELECT locus, row_number() OVER (ORDER BY locus) AS id FROM {loci}")
def p14(t):
    return R.numbered(t.loci, ["locus"]).withColumn("id", F.col("id").cast("long"))


@query("p15_gwas_z", "SELECT rsid, pos, variant_id, round(beta / se, 6) + 0e0 AS zscore FROM {gwas} WHERE variant_id IS NOT NULL AND se <> 0")
def p15(t):
    z = t.gwas.where("variant_id is not null").withColumn("zscore", r(C.z_score(F.col("beta"), F.col("se"))))
    return z.where("zscore is not null").select("rsid", "pos", "variant_id", "zscore")


@query("p16_probability", "SELECT l_orderkey, l_linenumber, round(1 / (1 + exp(-((l_quantity - 2.5e1) / 1e1))), 6) AS probability FROM lineitem")
def p16(t):
    return t.lineitem.select("l_orderkey", "l_linenumber", r(C.probability((F.col("l_quantity") - 25.0) / 10.0)).alias("probability"))


@query("p17_minus_log10", "SELECT l_orderkey, l_linenumber, round(-log10(greatest(pvalue, 1e-3)), 6) + 0e0 AS logp FROM {assoc}")
def p17(t):
    return t.assoc.select("l_orderkey", "l_linenumber", r(C.minus_log10(F.col("pvalue"), 1e-3)).alias("logp"))


@query("p18_log_counts", "SELECT doc_id, round(log10(1 + n_chars), 6) AS y, round((n_chars - min(n_chars) OVER ()) / (max(n_chars) OVER () - min(n_chars) OVER () + 0e0), 6) AS scaled FROM {classed}")
def p18(t):
    ends = t.classed.agg(F.min("n_chars").alias("lo"), F.max("n_chars").alias("hi"))
    return t.classed.crossJoin(F.broadcast(ends)).select("doc_id", r(C.log_count(F.col("n_chars"))).alias("y"), r((F.col("n_chars") - F.col("lo")) / (F.col("hi") - F.col("lo")).cast("double")).alias("scaled"))


@query("p19_binarise", "SELECT vec_id, feature, coalesce((x > 0)::INTEGER, 0) AS bound FROM {x_long}")
def p19(t):
    return t.x_long.select("vec_id", "feature", C.binarised(F.col("x")).alias("bound"))


@query("p20_indicators", "SELECT p_partkey, (p_type IN ('ECONOMY', 'PROMO'))::INTEGER AS cheap, (p_size IN (1, 2, 3))::INTEGER AS tiny, (p_brand = 'Brand#2')::INTEGER AS brand2 FROM part")
def p20(t):
    return t.part.select("p_partkey", C.indicator(F.col("p_type"), ["ECONOMY", "PROMO"]).alias("cheap"), C.indicator(F.col("p_size"), [1, 2, 3]).alias("tiny"), C.indicator(F.col("p_brand"), ["Brand#2"]).alias("brand2"))


@query("p21_synonyms", "SELECT s_suppkey, n_name AS mapped FROM (SELECT s_suppkey, replace(replace('N-' || s_nationkey, 'N-1', 'NATION_1'), 'N-', 'NATION_') AS k FROM supplier) q LEFT JOIN nation ON n_name = k")
def p21(t):
    key = C.synonyms_replaced(F.concat(F.lit("N-"), "s_nationkey"), [("N-1", "NATION_1"), ("N-", "NATION_")])
    return t.supplier.select("s_suppkey", key.alias("k")).join(F.broadcast(t.nation.select("n_name")), F.col("k") == F.col("n_name"), "left").select("s_suppkey", F.col("n_name").alias("mapped"))


@query("p22_midpoint", "SELECT gene, (start + stop) / 2e0 AS middle, ceil((start + stop) / 2e0)::BIGINT AS next_whole FROM {genes}")
def p22(t):
    a, b = F.col("start"), F.col("stop")
    return t.genes.select("gene", C.midpoint(a, b).alias("middle"), C.midpoint(a, b, up=True).alias("next_whole"))


@query("p23_parity", "SELECT gene, chrom, CASE WHEN chrom % 2 = 0 THEN 'even' ELSE 'odd' END AS bucket FROM {genes}")
def p23(t):
    return t.genes.select("gene", "chrom", C.parity_bucket(F.col("chrom")).alias("bucket"))


@query("p24_unit_intervals", "SELECT snp, chrom, pos AS start, pos + 1 AS stop, abs(pos - 1000000) AS away FROM {snps}")
def p24(t):
    return t.snps.select("snp", "chrom", *C.unit_interval(F.col("pos")), F.abs(F.col("pos") - 1_000_000).alias("away"))


_SPLIT = "split_part(locus, '_', 1) AS chrom, split_part(locus, '_', 2)::BIGINT AS start, split_part(locus, '_', 3)::BIGINT AS stop"


@query("st1_split_locus", f"SELECT locus, {_SPLIT} FROM {{loci}}")
def st1(t):
    colon = C.first_replaced(C.first_replaced(F.col("locus"), "_", ":"), "_", "-")
    return t.loci.select("locus", *C.locus_parts(colon, "[:-]"))


@query("st2_split_model", "SELECT DISTINCT p_brand || '_' || p_type AS model, p_brand AS tf, p_type AS tissue FROM part")
def st2(t):
    m = t.part.select(C.key_of(F.col("p_brand"), F.col("p_type")).alias("model")).distinct()
    parts = F.split("model", "_")
    return m.select("model", F.try_element_at(parts, F.lit(1)).alias("tf"), F.try_element_at(parts, F.lit(2)).alias("tissue"))


@query("st3_keys", "SELECT snp, concat_ws('_', chrom, pos, 'A', 'C') AS variant, 'chr' || chrom || ':' || pos || '-' || (pos + 1) AS locus FROM {snps}")
def st3(t):
    return t.snps.select("snp", C.key_of(F.col("chrom"), F.col("pos"), F.lit("A"), F.lit("C")).alias("variant"), F.format_string("chr%d:%d-%d", "chrom", "pos", F.col("pos") + 1).alias("locus"))


@query("st4_strip", "SELECT locus, regexp_replace(locus, '^chr', '') AS bare, regexp_replace(locus, '^.*_', '') AS tail FROM {loci}")
def st4(t):
    return t.loci.select("locus", C.stripped(F.col("locus"), "^chr").alias("bare"), C.stripped(F.col("locus"), "^.*_").alias("tail"))


@query("st5_first_only", "SELECT locus, regexp_replace(regexp_replace(locus, '_', ':'), '_', '-') AS pretty FROM {loci}")
def st5(t):
    return t.loci.select("locus", C.first_replaced(C.first_replaced(F.col("locus"), "_", ":"), "_", "-").alias("pretty"))


@query("st6_prefix", "SELECT split_part(locus, '_', 1) AS chrom, count(*) AS n FROM {loci} GROUP BY 1")
def st6(t):
    return G.counted(t.loci.select(C.prefix_before(F.col("locus")).alias("chrom")), "chrom")


@query("st7_cell_to_rows", "SELECT p_partkey, unnest(string_split(p_name, ' ')) AS word FROM part")
def st7(t):
    return G.list_rows(t.part.select("p_partkey", F.col("p_name").alias("word")), "word", " ")


@query("st8_rows_to_cell", "SELECT n_regionkey, string_agg(n_name, ',' ORDER BY n_name) AS n_name FROM nation GROUP BY n_regionkey")
def st8(t):
    return G.list_cell(t.nation, ["n_regionkey"], "n_name")


@query("st9_p_labels", "SELECT l_orderkey, l_linenumber, CASE WHEN pvalue < 1e-2 THEN printf('p = %.1e', pvalue) ELSE printf('p = %.4f', pvalue) END AS label FROM {assoc}")
def st9(t):
    return t.assoc.select("l_orderkey", "l_linenumber", C.p_label(F.col("pvalue")).alias("label"))


@query("st10_stars", "SELECT l_orderkey, l_linenumber, CASE WHEN pvalue < 1e-3 THEN '***' WHEN pvalue < 1e-2 THEN '**' WHEN pvalue < 5e-2 THEN '*' ELSE 'ns' END AS stars FROM {assoc}")
def st10(t):
    return t.assoc.select("l_orderkey", "l_linenumber", C.significance_stars(F.col("pvalue")).alias("stars"))


@query("st11_natural_order", "SELECT chrom, row_number() OVER (ORDER BY regexp_extract(chrom, '^(\\D*)', 1), regexp_extract(chrom, '(\\d+)', 1)::BIGINT, chrom) AS place FROM (SELECT DISTINCT split_part(locus, '_', 1) AS chrom FROM {loci}) q")
def st11(t):
    names = t.loci.select(C.prefix_before(F.col("locus")).alias("chrom")).distinct()
    keyed = names.select("chrom", *[k.alias(f"k{i}") for i, k in enumerate(C.natural_key(F.col("chrom")))])
    return R.numbered(keyed, ["k0", "k1", "k2"], "place").select("chrom", F.col("place").cast("long").alias("place"))


@query("st12_file_stems", "SELECT s_suppkey, regexp_extract('/data/x/' || s_name || '.bed.gz', '([^/]+?)(?:\\.[^./]+)*$', 1) AS stem FROM supplier")
def st12(t):
    return t.supplier.select("s_suppkey", C.file_stem(F.concat(F.lit("/data/x/"), "s_name", F.lit(".bed.gz"))).alias("stem"))


@query("u1_tagged_union", "SELECT gene, zscore, 'finished' AS source FROM {set_f} UNION ALL SELECT gene, NULL, 'open' FROM {set_o}")
def u1(t):
    return R.tagged_union({"finished": t.set_f.select("gene", "zscore"), "open": t.set_o.select("gene")})


@query("u2_intersect", "SELECT gene FROM {set_f} INTERSECT SELECT gene FROM {set_o}")
def u2(t):
    return t.set_f.select("gene").intersect(t.set_o.select("gene"))


@query("u3_difference", "SELECT gene FROM {set_f} EXCEPT SELECT gene FROM {set_o}")
def u3(t):
    return t.set_f.select("gene").subtract(t.set_o.select("gene"))


@query("u4_distinct_list", "SELECT DISTINCT p_type FROM part")
def u4(t):
    return t.part.select("p_type").distinct()


@query("u5_ragged_lists", """WITH a AS (SELECT p_name, row_number() OVER (ORDER BY p_name) AS pos FROM (SELECT DISTINCT p_name FROM part) q),
b AS (SELECT n_name, row_number() OVER (ORDER BY n_name) AS pos FROM nation)
SELECT coalesce(a.pos, b.pos) AS pos, p_name AS parts, n_name AS nations FROM a FULL JOIN b ON a.pos = b.pos""")
def u5(t):
    return R.side_by_side({"parts": t.part.select("p_name"), "nations": t.nation.select("n_name")}).withColumn("pos", F.col("pos").cast("long"))


@query("l1_multi_key_sort", "SELECT o_orderkey, row_number() OVER (ORDER BY ord, o_totalprice DESC, o_orderkey) AS place FROM orders JOIN (VALUES ('F', 1), ('P', 2), ('O', 3)) v(s, ord) ON s = o_orderstatus")
def l1(t):
    order = t.spark.createDataFrame([("F", 1), ("P", 2), ("O", 3)], "o_orderstatus string, ord int")
    rows = t.orders.join(F.broadcast(order), "o_orderstatus").withColumn("down", -F.col("o_totalprice"))
    return R.numbered(rows, ["ord", "down", "o_orderkey"], "place").select("o_orderkey", F.col("place").cast("long").alias("place"))


@query("l2_top_k", "SELECT l_orderkey, l_linenumber, pvalue FROM {assoc} ORDER BY pvalue, l_orderkey, l_linenumber, l_partkey LIMIT 20")
def l2(t):
    return t.assoc.orderBy("pvalue", "l_orderkey", "l_linenumber", "l_partkey").limit(20).select("l_orderkey", "l_linenumber", "pvalue")


@query("l3_ends", """SELECT * FROM (SELECT s_suppkey, s_acctbal, 'first' AS part FROM supplier ORDER BY s_acctbal, s_suppkey LIMIT 5) a
UNION ALL SELECT * FROM (SELECT s_suppkey, s_acctbal, 'last' FROM supplier ORDER BY s_acctbal DESC, s_suppkey DESC LIMIT 5) b""")
def l3(t):
    return R.ends(t.supplier.select("s_suppkey", "s_acctbal"), ["s_acctbal", "s_suppkey"], 5)


@query("l4_best_row", "SELECT tf, n FROM (SELECT tf, count(*) AS n FROM {assoc} GROUP BY tf) q ORDER BY n DESC, tf LIMIT 1")
def l4(t):
    return R.best(G.counted(t.assoc, "tf"), "n", "tf")


@query("w3_top_rows_per_group", "SELECT tf, locus, l_orderkey, l_linenumber, pvalue FROM (SELECT *, row_number() OVER (PARTITION BY tf ORDER BY pvalue, l_orderkey, l_linenumber, l_partkey) AS n FROM {assoc}) q WHERE n <= 3")
def w3(t):
    return W.top_rows(t.assoc, ["tf"], 3, F.col("pvalue"), F.col("l_orderkey"), F.col("l_linenumber"), F.col("l_partkey")).select("tf", "locus", "l_orderkey", "l_linenumber", "pvalue")
