"""Queries: sources and sinks (s1-s14, x8). What is written and read again are the driver's rows, in the shared folder."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from locusmill.operators import linear as L, rows as R
from locusmill.plans.base import Tables, query, r, rounded
from locusmill.plans.queries_stats import RELATIONSHIP_SQL
from locusmill.sources import tables as S


def _folder(t: Tables) -> str:
    return R.gone_at_exit(t.spark, f"{R.shared_dir(t.spark)}/tables-{uuid.uuid4().hex}")


@query("s1_delimited_gz", "SELECT s_suppkey, s_name, s_acctbal FROM supplier")
def s1(t):
    path = _folder(t)
    S.write_gz(t.supplier.select("s_suppkey", "s_name", "s_acctbal"), path)
    return S.read_table(t.spark, path, "s_suppkey bigint, s_name string, s_acctbal double", repartition=4)


@query("s4_delimited_gz_write", "SELECT 'n_nationkey' || chr(9) || 'n_name' || chr(9) || 'n_regionkey' AS line, true AS zipped UNION ALL SELECT n_nationkey || chr(9) || n_name || chr(9) || n_regionkey, true FROM nation")
def s4(t):
    """The lines that are in the files, and whether the files are zipped."""
    path = _folder(t)
    S.write_gz(t.nation.select("n_nationkey", "n_name", "n_regionkey").coalesce(1), path)
    return t.spark.read.text(path).select(F.col("value").alias("line"), F.col("_metadata.file_name").endswith(".gz").alias("zipped"))


@query("s2_bed", "SELECT 'chr' || chrom AS chrom, start + 1 AS start, stop, id::VARCHAR AS id FROM {peaks}")
def s2(t):
    path = _folder(t)
    t.peaks.select(F.concat(F.lit("chr"), "chrom"), "start", "stop", "id").write.csv(path, sep="\t")
    return S.read_bed(t.spark, path, zero_based=True)


@query("s3_file_per_entity", "SELECT replace(p_brand, '#', '') AS entity, count(*) AS n, false AS missing FROM part WHERE p_brand <> 'Brand#3' GROUP BY p_brand UNION ALL SELECT 'Brand3', 0, true")
def s3(t):
    """A file for each brand but one, named after it; the reader takes the names for the entities."""
    path = _folder(t)
    brand = F.regexp_replace("p_brand", "#", "")
    S.write_entities(t.part.where("p_brand <> 'Brand#3'").select("p_partkey", brand.alias("entity")), path, "entity")
    rows, missing = S.read_entities(t.spark, path, t.part.select(brand.alias("entity")).distinct(), "p_partkey bigint")
    found = rows.groupBy("entity").agg(F.count("*").alias("n")).withColumn("missing", F.lit(False))
    return found.union(missing.select("entity", F.lit(0).cast("long"), F.lit(True)))


@query("s5_split_by_key", "SELECT chrom, count(*) AS n FROM {peaks} GROUP BY chrom")
def s5(t):
    path = _folder(t)
    S.write_by_key(t.peaks, path, "chrom")
    return t.spark.read.parquet(path).groupBy(F.col("chrom").cast("long").alias("chrom")).agg(F.count("*").alias("n"))


@query("s6_group_write", "SELECT tf, tissue, count(*) AS n, count(DISTINCT locus) AS n_loci FROM {assoc} GROUP BY tf, tissue")
def s6(t):
    """A folder for each model (two keys), each read back by its keys alone."""
    path = _folder(t)
    S.write_by_key(t.assoc.select("tf", "tissue", "locus", "zscore"), path, "tf", "tissue")
    return t.spark.read.parquet(path).groupBy("tf", "tissue").agg(F.count("*").alias("n"), F.countDistinct("locus").alias("n_loci"))


_MODELS = ["lasso", "top1", "full"]


def _store(t):
    w = t.snp_weights.select("gene", "variant", F.col("weight").alias("lasso"), F.when(F.col("weight") > 0.3, F.col("weight")).alias("top1"), (F.col("weight") * 0).alias("full"))
    p = t.part.groupBy(F.col("p_brand").alias("gene")).agg(F.avg("p_size").alias("lasso"), F.max("p_size").cast("double").alias("top1"), F.min("p_size").cast("double").alias("full"))
    perf = R.tagged_union({"rsq": p, "pval": p.select("gene", *[(F.col(m) / 128).alias(m) for m in _MODELS])}, "measure")
    return S.model_store(w, perf, ["variant"], _MODELS)


@query("s7_model_store", """WITH w AS (SELECT gene, variant, 'lasso' AS model, weight FROM {snp_weights} WHERE weight <> 0 UNION ALL SELECT gene, variant, 'top1', weight FROM {snp_weights} WHERE weight > 3e-1),
n AS (SELECT gene, model, count(*) AS n_snps FROM w GROUP BY ALL), p AS (SELECT p_brand AS gene, avg(p_size) AS lasso, max(p_size)::DOUBLE AS top1 FROM part GROUP BY p_brand)
SELECT gene, model, round(CASE model WHEN 'lasso' THEN lasso ELSE top1 END, 9) AS r2, round(CASE model WHEN 'lasso' THEN lasso ELSE top1 END / 128, 9) AS pval, n_snps FROM n JOIN p USING (gene)""")
def s7(t):
    return rounded(_store(t)[1], "r2", "pval", digits=9)


@query("s8_read_store", "SELECT gene, variant, round(weight, 6) + 0e0 AS weight FROM {snp_weights} WHERE weight > 3e-1")
def s8(t):
    path = _folder(t)
    S.write_store(*_store(t), path)
    return rounded(S.read_store(t.spark, path, "weights", "top1").select("gene", "variant", "weight"), "weight")


@query("s9_nested_config", """WITH m AS (SELECT r_name AS tf, list(DISTINCT s_name ORDER BY s_name) AS motifs FROM supplier JOIN nation ON n_nationkey = s_nationkey JOIN region ON r_regionkey = n_regionkey WHERE s_suppkey < 20 GROUP BY r_name),
f AS (SELECT r_name AS tf, n_name, list(DISTINCT s_name ORDER BY s_name) AS files FROM supplier JOIN nation ON n_nationkey = s_nationkey JOIN region ON r_regionkey = n_regionkey WHERE s_suppkey >= 20 GROUP BY r_name, n_name),
p AS (SELECT tf, string_agg('"' || n_name || '":' || to_json(files)::VARCHAR, ',' ORDER BY n_name) AS j FROM f GROUP BY tf)
SELECT tf, '{"motifFiles":' || to_json(motifs)::VARCHAR || ',"peakFiles":{' || j || '}}' AS config FROM m JOIN p USING (tf)""")
def s9(t):
    n = t.nation.join(F.broadcast(t.region), F.col("n_regionkey") == F.col("r_regionkey"))
    rows = t.supplier.join(F.broadcast(n), F.col("s_nationkey") == F.col("n_nationkey"))
    motifs = rows.where("s_suppkey < 20").select(F.col("r_name").alias("tf"), F.col("s_name").alias("motif"))
    peaks = rows.where("s_suppkey >= 20").select(F.col("r_name").alias("tf"), F.col("n_name").alias("tissue"), F.col("s_name").alias("peak"))
    return S.nested_config(motifs, peaks)


@query("s10_catalog", "SELECT 1 AS ord, 'table2' AS name, 'Nations' AS header, count(*) AS n_rows, 3 AS n_cols FROM nation UNION ALL SELECT 2, 'table10', 'Suppliers', count(*), 4 FROM supplier UNION ALL SELECT 3, 'table11', 'Regions', count(*), 2 FROM region")
def s10(t):
    """Names stand in natural order, and the written tables are checked against what was to be written."""
    return S.catalog({"table10": ("Suppliers", t.supplier), "table11": ("Regions", t.region), "table2": ("Nations", t.nation)}, _folder(t))


@query("s11_bin_matrix", "SELECT bin, count(*) AS n, round(sum(x), 4) + 0e0 AS total FROM {bins} WHERE chrom = 3 AND bin >= 5 AND bin < 30 GROUP BY bin")
def s11(t):
    path = _folder(t)
    S.write_bins(t.bins, path)
    rows = S.read_bins(t.spark, path, 3, 5, 30)
    return rows.groupBy("bin").agg(F.count("*").alias("n"), r(F.sum("x"), 4).alias("total"))


@query("s12_dosage_long", "SELECT variant, 's' || sample AS sample, dosage FROM {pop_dosage}")
def s12(t):
    """A column for each of the nations, and back."""
    ids = list(range(25))
    wide = t.pop_dosage.groupBy("variant").pivot("sample", ids).agg(F.max("dosage"))
    names = [f"s{i}" for i in ids]
    return S.dosage_long(wide.toDF("variant", *names), ["variant"], names)


@query("s13_aligned_matrix", f"WITH {RELATIONSHIP_SQL} SELECT k.* FROM k WHERE id1 IN (SELECT n_nationkey FROM nation WHERE n_regionkey <> 2) AND id2 IN (SELECT n_nationkey FROM nation WHERE n_regionkey <> 2)")
def s13(t):
    samples = t.nation.where("n_regionkey <> 2").select(F.col("n_nationkey").alias("id"))
    return rounded(S.aligned_matrix(L.relationship(t.pop_dosage), samples), "value")


@query("s14_gathered", "SELECT batch, idx, iter, count(*) AS n FROM (SELECT l_linenumber AS batch, l_suppkey % 4 AS idx, dense_rank() OVER (ORDER BY l_linenumber, l_suppkey % 4) AS iter FROM lineitem) q GROUP BY ALL")
def s14(t):
    batches = t.lineitem.select(F.col("l_linenumber").alias("batch"), (F.col("l_suppkey") % 4).alias("idx"))
    expected = t.spark.createDataFrame([(i,) for i in range(1, 8)], "batch int")
    return S.gathered(batches, expected).groupBy("batch", "idx", F.col("iter").cast("long").alias("iter")).agg(F.count("*").alias("n"))


@query("x8_fit_tables", """WITH f AS (SELECT p_brand AS gene, p_type AS model, avg(p_size) / 5e1 AS rsq, 1 / (1e0 + count(*)) AS pval, max(p_size) / 1e2 AS h2 FROM part GROUP BY p_brand, p_type)
SELECT gene, model, 'cv_' || stat AS stat, round(value, 6) AS value FROM f UNPIVOT (value FOR stat IN (rsq, pval)) UNION ALL SELECT gene, 'all', 'h2', round(max(h2), 6) FROM f GROUP BY gene
UNION ALL SELECT gene, 'lasso', 'weight_' || variant, round(weight, 6) + 0e0 FROM {snp_weights} WHERE weight <> 0""")
def x8(t):
    fits = t.part.groupBy(F.col("p_brand").alias("gene"), F.col("p_type").alias("model")).agg((F.avg("p_size") / 50).alias("rsq"), (1 / (1.0 + F.count("*"))).alias("pval"), (F.max("p_size") / 100).alias("h2"))
    weights = t.snp_weights.select("gene", F.lit("lasso").alias("model"), "variant", "weight")
    return rounded(S.fit_tables(fits, weights), "value")
