"""Queries: model fitting (x1-x3, x11, x13, x14) and programs (x15-x22)."""

from __future__ import annotations

from pyspark.sql import functions as F

from locusmill.operators import linear as L, models as M, programs as P
from locusmill.operators.groups import counted
from locusmill.operators.rows import settled, tagged_union
from locusmill.plans.base import query, rounded


def _target():
    return (F.col("label") < 5).cast("int")


@query("x1_logistic_cv")
def x1(t):
    metrics = M.cross_validated(t.embeddings.withColumn("y", _target()), "vec_id", "embedding", "y")
    return metrics.groupBy("lambda").agg(F.count("*").alias("n_folds"), F.avg("metric").alias("auc"))


@query("x2_linear_cv")
def x2(t):
    """The penalties that either rule chooses from the path, with the error on held-out folds and the size of the net of all rows."""
    metrics, weights = M.regularised_path(t.embeddings.withColumn("y", F.log10(1 + F.col("label"))), "vec_id", "embedding", "y", "gaussian")
    size = weights.where("feature >= 0").groupBy("lambda").agg(F.count("*").alias("n_features"))
    by = metrics.groupBy("lambda").agg(F.count("*").alias("n_folds"), F.avg("metric").alias("mse"))
    return M.chosen_lambda(metrics, larger_is_better=False).join(by, "lambda").join(size, "lambda", "left").na.fill(0, ["n_features"])


_METRICS = "SELECT CAST(l_linenumber AS DOUBLE) / 1e1 AS lam, l_suppkey % 5 AS fold, avg(l_quantity) / 5e1 AS metric FROM {lineitem} GROUP BY l_linenumber, l_suppkey % 5"


@query("x3_choose_lambda", f"""WITH m AS ({_METRICS}), b AS (SELECT lam, avg(metric) AS mean, stddev_samp(metric) / sqrt(count(*)) AS se FROM m GROUP BY lam),
t AS (SELECT * FROM b ORDER BY mean DESC, lam DESC LIMIT 1)
SELECT 'best' AS rule, lam AS "lambda" FROM t UNION ALL SELECT '1se', max(b.lam) FROM b, t WHERE b.mean >= t.mean - t.se""")
def x3(t):
    return M.chosen_lambda(t.sql(_METRICS).withColumnRenamed("lam", "lambda"))


def _dosages(t):
    """Samples are the embeddings, variants their signs: a small cis window for each of four loci."""
    cells = t.x_long.select(F.col("vec_id").alias("sample"), F.col("feature").alias("variant"), F.when(F.col("x") > 0.05, 2).when(F.col("x") > -0.05, 1).otherwise(0).alias("dosage"))
    y = t.embeddings.select(F.col("vec_id").alias("sample"), F.posexplode(F.slice("embedding", 1, 4)).alias("locus", "y"))
    return cells.withColumn("locus", (F.col("variant") / 16).cast("int")).join(y.withColumn("y", F.col("y").cast("double")), ["sample", "locus"])


@query("x11_snp_models")
def x11(t):
    return rounded(M.snp_models(_dosages(t).select("locus", "sample", "y", "variant", "dosage")), "weight", "cv_r2", "nested_r2", "nested_p")


def _phenotypes(t):
    """A phenotype for each line number: the nations' mean prices."""
    people = t.orders.join(t.customer, F.col("c_custkey") == F.col("o_custkey")).select("o_orderkey", "c_nationkey")
    rows = t.lineitem.join(people, F.col("l_orderkey") == F.col("o_orderkey"))
    return rows.groupBy(F.col("l_linenumber").alias("phenotype"), F.col("c_nationkey").alias("id")).agg(F.avg("l_extendedprice").cast("double").alias("y"))


@query("x13_heritability")
def x13(t):
    return M.heritability(_phenotypes(t), L.relationship(t.pop_dosage), ["phenotype"])


@query("x14_heritability_by_chromosome")
def x14(t):
    """Chromosomes are the brands of the variants."""
    brand = t.part.select(F.col("p_partkey").alias("variant"), F.col("p_brand").alias("chrom"))
    d = t.pop_dosage.join(brand, "variant")
    grm = settled(L.relationship(d, ["chrom"]))
    return M.heritability(grm.select("chrom").distinct().join(_phenotypes(t), how="cross"), grm, ["chrom", "phenotype"])


def _loci(t):
    return t.cells.select("locus", "feature", F.greatest("score", F.lit(0.0)).alias("score"))


@query("x15_subsamples", "SELECT iter, (SELECT floor(count(DISTINCT locus) * 8e-1 + 5e-1)::BIGINT FROM {cells}) AS n FROM range(20) i(iter)")
def x15(t):
    return counted(P.subsamples(_loci(t), "locus", 20), "iter")


def _factors(t):
    cells = _loci(t)
    return P.factorised(cells, P.subsamples(cells, "locus", 6), "locus", "feature", "score", 4, "point_exponential")


@query("x16_factorised_subsamples")
def x16(t):
    return _factors(t).groupBy("iter", "k").agg(F.max("pve").alias("pve"), F.min("value").alias("least"), F.max("evidence").alias("evidence"), F.count("*").alias("n"))


@query("f5_prior_switch")
def f5_prior(t):
    """The same subsamples under each of the five prior families, fitted in the same sweeps."""
    cells = t.cells.select("locus", "feature", "score")
    made = P.factorised(cells, P.subsamples(cells, "locus", 2), "locus", "feature", "score", 2, sorted(P.FAMILIES))
    return rounded(made.groupBy("prior", "iter", "kind").agg(F.countDistinct("k").alias("n_factors"), F.avg("value").alias("mean"), F.max("evidence").alias("evidence")), "mean", "evidence", digits=4)


_FACTORS = """SELECT CAST(l_linenumber AS BIGINT) AS iter, CAST(l_suppkey % 3 AS INT) AS k, CASE WHEN l_partkey % 2 = 0 THEN 'L' ELSE 'F' END AS kind,
    CAST(l_partkey % 40 AS STRING) AS key, avg(l_quantity) AS value FROM {lineitem} GROUP BY l_linenumber, l_suppkey % 3, CASE WHEN l_partkey % 2 = 0 THEN 'L' ELSE 'F' END, l_partkey % 40"""
_DUCK_FACTORS = _FACTORS.replace("AS STRING", "AS VARCHAR")


@query("x17_normalised_factors", f"""WITH f AS ({_DUCK_FACTORS}), n AS (SELECT iter, k, kind, sqrt(sum(value * value)) AS norm FROM f GROUP BY ALL), d AS (SELECT iter, k, product(norm) AS d FROM n GROUP BY ALL)
SELECT f.iter, f.k, f.kind, f.key, round(value / norm, 6) AS value, round(d, 3) AS d, round(CASE WHEN f.kind = 'L' THEN value / norm * d END, 3) AS ld FROM f JOIN n USING (iter, k, kind) JOIN d USING (iter, k)""")
def x17(t):
    return rounded(rounded(P.normalised(t.sql(_FACTORS)), "value"), "d", "ld", digits=3)


@query("f5_strategy_switch", f"""WITH f AS ({_DUCK_FACTORS}), g AS (SELECT iter, k, kind, sum(abs(value)) AS l1, sqrt(sum(value * value)) AS l2, max(value) AS linf FROM f GROUP BY ALL)
SELECT iter, k, norm, round(product(v), 3) AS d FROM g UNPIVOT (v FOR norm IN (l1, l2, linf)) GROUP BY iter, k, norm""")
def f5(t):
    factors = t.sql(_FACTORS)
    parts = {n: P.normalised(factors, n).select("iter", "k", "d").distinct() for n in ("l1", "l2", "linf")}
    return rounded(tagged_union({n: df.groupBy("iter", "k").agg(F.max("d").alias("d")) for n, df in parts.items()}, "norm"), "d", digits=3)


@query("x18_stacked_factors", f"SELECT 'iter' || iter || '_k' || k AS program, key AS feature, round(value, 6) AS value FROM ({_DUCK_FACTORS}) f WHERE kind = 'F'")
def x18(t):
    return rounded(P.stacked(t.sql(_FACTORS)), "value")


@query("x19_choose_k_and_cluster")
def x19(t):
    vectors = settled(P.program_vectors(P.stacked(_factors(t))))
    best = P.choose_k(vectors, list(range(2, 21))).orderBy(F.desc("silhouette"), "k").first()["k"]
    return counted(P.clustered(vectors, best), "cluster")


_ASSIGNED = f"SELECT DISTINCT concat('iter', CAST(iter AS STRING), '_k', CAST(k AS STRING)) AS program, CAST((iter + k) % 3 AS INT) AS cluster FROM ({_FACTORS}) f"
_DUCK_ASSIGNED = _ASSIGNED.replace("AS STRING", "AS VARCHAR")


@query("x20_locus_scores", f"SELECT l.key AS locus, cluster, round(avg(value), 6) AS score FROM (SELECT *, 'iter' || iter || '_k' || k AS program FROM ({_DUCK_FACTORS}) f WHERE kind = 'L') l JOIN ({_DUCK_ASSIGNED}) a USING (program) GROUP BY l.key, cluster")
def x20(t):
    loads = t.sql(_FACTORS).where("kind = 'L'").select(F.concat(F.lit("iter"), "iter", F.lit("_k"), "k").alias("program"), F.col("key").alias("locus"), "value")
    return rounded(P.cluster_means(loads, t.sql(_ASSIGNED), "locus", "value"), "score")


@query("x21_feature_contributions", f"SELECT key AS feature, cluster, round(avg(value), 6) AS score FROM (SELECT *, 'iter' || iter || '_k' || k AS program FROM ({_DUCK_FACTORS}) f WHERE kind = 'F') l JOIN ({_DUCK_ASSIGNED}) a USING (program) GROUP BY key, cluster")
def x21(t):
    return rounded(P.cluster_means(P.stacked(t.sql(_FACTORS)), t.sql(_ASSIGNED), "feature", "value"), "score")


@query("x22_cluster_members", f"SELECT cluster, regexp_extract(program, '^iter(\\d+)_', 1)::BIGINT AS iter, count(*) AS n FROM ({_DUCK_ASSIGNED}) a GROUP BY 1, 2")
def x22(t):
    return P.members_by_sample(t.sql(_ASSIGNED))
