"""Scoring with linear models: matrices are long tables, or an array a row where the width is fixed."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F

from locusmill.operators.rows import settled
from locusmill.operators.tiles import row_products


def score_long(x: DataFrame, weights: DataFrame, row: str = "row", model: str = "model") -> DataFrame:
    """(row, model, score): x(row, feature, x) times weights(model, feature, w), summed over the features both have."""
    return x.join(weights, "feature").groupBy(row, model).agg(F.sum(F.col("x") * F.col("w")).alias("score"))


#: Values of a weight matrix that is sent to all executors at most.
MAX_WEIGHTS = 50_000_000


def score_dense(x: DataFrame, weights: DataFrame, row: str = "row", values: str = "values", model: str = "model") -> DataFrame:
    """The same for rows with an array of all features in order 0..n-1: one block product for each batch.

    The weight matrix (features * models, ``MAX_WEIGHTS`` at most) is broadcast; the rows aren't shuffled. Fails if a row has another width.
    """
    size = weights.count()
    if size > MAX_WEIGHTS:
        raise ValueError(f"{size} weights are too many to broadcast; use score_long")
    table = weights.toPandas().pivot(index="feature", columns=model, values="w").fillna(0.0).sort_index()
    shared = x.sparkSession.sparkContext.broadcast((table.to_numpy(), table.columns.to_numpy()))
    kinds = f"{row} {x.schema[row].dataType.simpleString()}, {model} {weights.schema[model].dataType.simpleString()}, score double"

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        w, models = shared.value
        for batch in batches:
            if len(batch):
                block = np.stack(batch[values].to_numpy()).astype(float)
                if block.shape[1] != len(w):
                    raise ValueError(f"a row has {block.shape[1]} values, the weights {len(w)}")
                yield pd.DataFrame({row: np.repeat(batch[row].to_numpy(), len(models)), model: np.tile(models, len(batch)), "score": (block @ w).ravel()})

    return x.select(row, values).mapInPandas(run, kinds)


def complete_cube(scores: DataFrame, locus: str, individual: str, model: str) -> DataFrame:
    """Cells of loci and models that every individual has."""
    n = scores.select(individual).distinct().agg(F.count("*").alias("__n"))
    for key in (locus, model):
        seen = scores.groupBy(key).agg(F.countDistinct(individual).alias("__k")).crossJoin(F.broadcast(n)).where("__k = __n").select(key)
        scores = scores.join(seen, key, "left_semi")
    return scores


def evaluated(df: DataFrame, features: str, weights: list[float], intercept: float, keep: list[str]) -> DataFrame:
    """Link and probability from an array of features and fitted weights."""
    link = reduce(lambda a, b: a + b, [F.col(features)[i].cast("double") * w for i, w in enumerate(weights)]) + intercept
    return df.select(*keep, link.alias("link")).withColumn("probability", 1 / (1 + F.exp(-F.col("link"))))


def allele_dosage(dosage: Column, ref: Column, eff: Column, counted: Column) -> Column:
    """Copies of the effect allele from copies of the counted one; null if the alleles don't fit."""
    return F.when(counted == eff, dosage).when(counted == ref, 2 - dosage)


def genotype_scores(dosages: DataFrame, weights: DataFrame) -> tuple[DataFrame, DataFrame]:
    """((gene, sample, score), (gene, n_in_model, n_used)): weighted sums of dosages over each gene's variants.

    dosages(sample, variant, counted, dosage), weights(gene, variant, ref, eff, weight).
    """
    fit = dosages.join(weights, "variant").withColumn("d", allele_dosage(F.col("dosage"), F.col("ref"), F.col("eff"), F.col("counted"))).where("d is not null")
    scores = fit.groupBy("gene", "sample").agg(F.sum(F.col("weight") * F.col("d")).alias("score"))
    used = fit.groupBy("gene").agg(F.countDistinct("variant").alias("n_used"))
    coverage = weights.groupBy("gene").agg(F.countDistinct("variant").alias("n_in_model")).join(used, "gene", "left").na.fill(0, ["n_used"])
    return scores, coverage


def association(weights: DataFrame, gwas: DataFrame, covariance: DataFrame) -> DataFrame:
    """(gene, n_snps, z): z = sum(w * sd * z_snp) / sqrt(w' C w).

    weights(gene, variant, eff, weight), gwas(variant, eff_gwas, z), covariance(gene, v1, v2, cov) with each pair once and the
    diagonal. A GWAS effect on the other allele changes sign. Null where the variance is not positive.
    """
    w = weights.join(gwas, "variant").withColumn("z", F.when(F.col("eff") == F.col("eff_gwas"), F.col("z")).otherwise(-F.col("z")))
    diagonal = covariance.where("v1 = v2").select("gene", F.col("v1").alias("variant"), F.sqrt("cov").alias("sd"))
    top = w.join(diagonal, ["gene", "variant"]).groupBy("gene").agg(F.count("*").alias("n_snps"), F.sum(F.col("weight") * F.col("sd") * F.col("z")).alias("num"))
    left = w.select("gene", F.col("variant").alias("v1"), F.col("weight").alias("w1"))
    right = w.select("gene", F.col("variant").alias("v2"), F.col("weight").alias("w2"))
    pairs = covariance.join(left, ["gene", "v1"]).join(right, ["gene", "v2"])
    twice = F.when(F.col("v1") == F.col("v2"), 1.0).otherwise(2.0)
    var = pairs.groupBy("gene").agg(F.sum(twice * F.col("w1") * F.col("w2") * F.col("cov")).alias("var"))
    return top.join(var, "gene").select("gene", "n_snps", F.try_divide(F.col("num"), F.when(F.col("var") > 0, F.sqrt("var"))).alias("z"))


def relationship(dosages: DataFrame, by: list[str] | None = None) -> DataFrame:
    """(by..., id1, id2, value), id1 <= id2: mean product of scaled genotypes over the variants that vary.

    Tiles of samples are multiplied over blocks of variants (``row_products``), so any number of samples will do. Missing
    genotypes count as the mean. With ``by`` (a column of the variants, say) there is a matrix for each of its values. The
    dosages are read once: a variant's mean and deviation are taken where its rows meet, and the scaled genotypes are written.
    """
    by = by or []
    variant = Window.partitionBy(*by, "variant")
    stats = dosages.dropna(subset=[*by, "variant"]).withColumns({"__m": F.avg("dosage").over(variant), "__s": F.stddev_samp("dosage").over(variant)})
    z = settled(stats.where("__s > 0").select(*by, "sample", "variant", ((F.col("dosage") - F.col("__m")) / F.col("__s")).alias("z")))
    m = z.select(*by, "variant").distinct().groupBy(*by).agg(F.count("*").alias("__n"))
    sums = row_products(z, "sample", "variant", "z", by)
    whole = sums.join(F.broadcast(m), by) if by else sums.crossJoin(F.broadcast(m))
    return whole.select(*by, F.col("a").alias("id1"), F.col("b").alias("id2"), (F.col("s") / F.col("__n")).alias("value"))


def ratio(assoc: DataFrame, gwas: DataFrame, locus: str) -> DataFrame:
    """Squared association z over the locus's squared GWAS z."""
    return assoc.join(gwas.select(locus, F.col("z").alias("__g")), locus).withColumn("ratio", F.try_divide(F.col("z") * F.col("z"), F.col("__g") * F.col("__g"))).drop("__g")
