"""The three chains of operators: scoring individuals, association with annotation, consensus programs.

Each is one lazy plan up to the model fits; stages hand on DataFrames, not files.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from locusmill.functions import columns as C
from locusmill.functions.distributions import normal_two_sided
from locusmill.operators import groups as G, intervals as I, linear as L, programs as P, ranks as W, rows as R, stats as S
from locusmill.plans.base import query, rounded
from locusmill.plans.queries_stats import covariance


def score_individuals(loci: DataFrame, bins: DataFrame, weights: DataFrame, low, high, width: int) -> DataFrame:
    """Bins of each locus -> mean features -> checked matrix -> scores of all models: (row, model, score)."""
    means = I.bin_means(loci.withColumns({"low": low, "high": high}), bins, ["row"], "values").drop("n")
    return L.score_dense(G.checked_matrix(means, "values", width), weights)


def associate(weights: DataFrame, gwas: DataFrame, covariance: DataFrame, genes: DataFrame, blocks: DataFrame, bin_width: int) -> DataFrame:
    """Association z -> p -> Bonferroni and q -> overlap with blocks: one row a gene and block, genes without a block once."""
    tests = R.settled(L.association(weights, gwas, covariance)).withColumn("p", normal_two_sided(F.col("z")))  # a row a gene, read several times
    judged = W.q_values(W.bonferroni(tests, "p"), "p")
    hits = I.overlap_join(genes, blocks, bin_width).select("gene", "r_start", "r_stop")
    return judged.join(hits, "gene", "left")


def consensus(cells: DataFrame, n_iter: int, k_factors: int, k_clusters: int) -> DataFrame:
    """Subsamples -> factors -> normalised -> clustered programs -> locus scores -> best program of each locus."""
    factors = R.settled(P.normalised(P.factorised(cells, P.subsamples(cells, "locus", n_iter), "locus", "feature", "score", k_factors, "point_exponential")))
    assigned = P.clustered(P.program_vectors(P.stacked(factors)), k_clusters)
    loads = factors.where("kind = 'L'").select(F.concat(F.lit("iter"), "iter", F.lit("_k"), "k").alias("program"), F.col("key").alias("locus"), F.col("ld").alias("value"))
    return G.arg_max(P.cluster_means(loads, assigned, "locus", "value"), "locus", "cluster", "score")


@query("flow_score_individuals", """WITH l AS (SELECT label AS chrom, min(vec_id // 10) AS low FROM embeddings GROUP BY label),
m AS (SELECT l.chrom AS row, feature, avg(x) AS x FROM l JOIN {bins} b ON b.chrom = l.chrom AND bin >= low AND bin < low + 8 GROUP BY 1, 2)
SELECT row, model, round(sum(x * w), 5) + 0e0 AS score FROM m JOIN {w_long} USING (feature) GROUP BY row, model""")
def flow_scores(t):
    loci = t.embeddings.groupBy(F.col("label").alias("chrom")).agg(F.min(F.floor(F.col("vec_id") / 10)).cast("long").alias("low")).withColumn("row", F.col("chrom"))
    bins = t.embeddings.select(F.col("label").alias("chrom"), F.floor(F.col("vec_id") / 10).cast("long").alias("bin"), F.col("embedding").alias("values"))
    return rounded(score_individuals(loci, bins, t.w_long, F.col("low"), F.col("low") + 8, 64), "score", digits=5)


@query("flow_association")
def flow_association(t):
    genes = t.snp_weights.groupBy("gene").agg(F.min("variant").alias("v")).select("gene", (F.col("v") % 22 + 1).alias("chrom"), (F.col("v") * 50).alias("start"), (F.col("v") * 50 + 30_000).alias("stop"))
    blocks = t.blocks.withColumnsRenamed({"start": "r_start", "stop": "r_stop"})
    return rounded(associate(t.snp_weights, t.snp_z, covariance(t), genes, blocks, 21_600), "z", "p", "qvalue")


@query("flow_consensus_programs")
def flow_programs(t):
    cells = t.cells.select("locus", "feature", F.greatest("score", F.lit(0.0)).alias("score"))
    return G.counted(consensus(cells, 5, 4, 3), "cluster")


@query("flow_compare_and_annotate", """WITH c AS (SELECT gene, CASE WHEN f.pvalue < 5e-2 AND o.pvalue < 5e-2 THEN 'both' WHEN f.pvalue < 5e-2 THEN 'a' WHEN o.pvalue < 5e-2 THEN 'b' ELSE 'none' END AS found_by, f.pvalue AS p FROM {set_f} f JOIN {set_o} o USING (gene))
SELECT found_by, p_type AS term, count(*) AS n, round(max(-log10(greatest(p, 1e-29))), 5) + 0e0 AS top FROM c JOIN part ON p_partkey = gene GROUP BY found_by, p_type""")
def flow_annotate(t):
    both = S.compared(t.set_f, t.set_o, "gene", "zscore", "pvalue", 0.05)
    terms = R.shaped(t.terms, rename={"member": "gene"})
    rows = both.join(terms, "gene").withColumn("logp", C.minus_log10(F.col("p_a")))
    return rounded(rows.groupBy("found_by", "term").agg(F.count("*").alias("n"), F.max("logp").alias("top")), "top", digits=5)
