"""Sources and sinks. Readers take a schema, never infer one."""

from __future__ import annotations

import re
from collections.abc import Mapping

from pyspark.sql import DataFrame, SparkSession, functions as F

from locusmill.operators.rows import numbered

BED = "chrom string, start bigint, stop bigint, id string"


def read_table(spark: SparkSession, path, schema: str, sep: str = "\t", header: bool = True, repartition: int | None = None) -> DataFrame:
    """Delimited text, also gzipped, NA as null. Gzip can't be split: ``repartition`` spreads what follows."""
    df = spark.read.csv(path, schema=schema, sep=sep, header=header, nullValue="NA")
    return df.repartition(repartition) if repartition else df


def read_bed(spark: SparkSession, path, schema: str = BED, zero_based: bool = False) -> DataFrame:
    """Headerless BED with the caller's names; ``zero_based`` moves the start to closed 1-based."""
    df = spark.read.csv(path, schema=schema, sep="\t", header=False)
    return df.withColumn("start", F.col("start") + 1) if zero_based else df


def read_entities(spark: SparkSession, folder: str, expected: DataFrame, schema: str, pattern: str = "*.tsv*", sep: str = "\t") -> tuple[DataFrame, DataFrame]:
    """(rows with the file's stem as ``entity``, expected entities without a file)."""
    stem = F.regexp_extract(F.col("_metadata.file_name"), r"^([^.]+)", 1)
    rows = spark.read.option("pathGlobFilter", pattern).csv(folder, schema=schema, sep=sep, header=True, nullValue="NA").withColumn("entity", stem)
    return rows, expected.join(rows.select("entity").distinct(), "entity", "left_anti")


def write_entities(df: DataFrame, folder: str, entity: str, sep: str = "\t") -> None:
    """A headed file for each entity, named after it: ``<entity>.tsv``. An entity's rows go through one task, as they make one file."""
    spark = df.sparkSession
    df.repartition(entity).write.mode("overwrite").partitionBy(entity).csv(f"{folder}.parts", sep=sep, header=True, nullValue="NA")
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    fs = path(folder).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    fs.mkdirs(path(folder))
    for part in fs.listStatus(path(f"{folder}.parts")):
        name = part.getPath().getName()
        if name.startswith(f"{entity}="):
            for file in fs.globStatus(path(f"{folder}.parts/{name}/part-*")):
                fs.rename(file.getPath(), path(f"{folder}/{name.partition('=')[2]}.tsv"))
    fs.delete(path(f"{folder}.parts"), True)


def natural(name: str) -> list:
    """Key of the order in which numbers inside names count as numbers."""
    return [(int(x), "") if x.isdigit() else (-1, x) for x in re.findall(r"\d+|\D+", name)]


def fit_tables(fits: DataFrame, weights: DataFrame) -> DataFrame:
    """(gene, model, stat, value) of all fits: cross-validated rsq and pval of each model, the gene's h2, and the weights that aren't 0.

    fits(gene, model, rsq, pval, h2), weights(gene, model, variant, weight).
    """
    cv = fits.unpivot(["gene", "model"], ["rsq", "pval"], "stat", "value").withColumn("stat", F.concat(F.lit("cv_"), "stat"))
    h2 = fits.groupBy("gene").agg(F.max("h2").alias("value")).select("gene", F.lit("all").alias("model"), F.lit("h2").alias("stat"), "value")
    own = weights.where("weight <> 0").select("gene", "model", F.concat(F.lit("weight_"), "variant").alias("stat"), F.col("weight").alias("value"))
    return cv.unionByName(h2).unionByName(own)


def write_gz(df: DataFrame, path: str, sep: str = "\t") -> None:
    df.write.mode("overwrite").csv(path, sep=sep, header=True, compression="gzip", nullValue="NA")


def write_by_key(df: DataFrame, path: str, *keys: str, fmt: str = "parquet") -> None:
    """A folder for each key. Rows of a key are spread over tasks first, so one large key isn't one task's file."""
    df.write.mode("overwrite").partitionBy(*keys).option("maxRecordsPerFile", 5_000_000).format(fmt).save(path)


def model_store(weights: DataFrame, performance: DataFrame, ids: list[str], models: list[str]) -> tuple[DataFrame, DataFrame]:
    """(weights, extra) of all models in long form: non-zero weights, and performance of the genes that have some.

    ``weights`` has ids, gene and a column for each model; ``performance`` gene, measure (pval, rsq) and a column for each model.
    """
    w = weights.unpivot(["gene", *ids], models, "model", "weight").where("weight is not null and weight <> 0")
    p = performance.unpivot(["gene", "measure"], models, "model", "v").groupBy("gene", "model").agg(F.max(F.when(F.col("measure") == "rsq", F.col("v"))).alias("r2"), F.max(F.when(F.col("measure") == "pval", F.col("v"))).alias("pval"))
    n = w.groupBy("gene", "model").agg(F.count("*").alias("n_snps"))
    return w, p.join(n, ["gene", "model"])


def write_store(weights: DataFrame, extra: DataFrame, path: str) -> None:
    for name, df in (("weights", weights), ("extra", extra)):
        df.write.mode("overwrite").partitionBy("model").parquet(f"{path}/{name}")


def read_store(spark: SparkSession, path: str, table: str, model: str | None = None) -> DataFrame:
    """A store's table; a model prunes partitions."""
    df = spark.read.parquet(f"{path}/{table}")
    return df if model is None else df.where(F.col("model") == model)


def nested_config(motifs: DataFrame, peaks: DataFrame) -> DataFrame:
    """(tf, config as JSON) from motifs(tf, motif) and peaks(tf, tissue, peak), for factors that have both; lists are sorted."""
    m = motifs.groupBy("tf").agg(F.array_sort(F.collect_set("motif")).alias("motifFiles"))
    t = peaks.groupBy("tf", "tissue").agg(F.array_sort(F.collect_set("peak")).alias("files"))
    p = t.groupBy("tf").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("tissue", "files")))).alias("peakFiles"))
    return m.join(p, "tf").select("tf", F.to_json(F.struct("motifFiles", "peakFiles")).alias("config"))


def catalog(tables: Mapping[str, tuple[str, DataFrame]], path: str | None = None) -> DataFrame:
    """(ord, name, header, n_rows, n_cols) of named tables (name to header and table), in natural order of the names.

    With a path they are written, and what is read back must have the same columns and as many rows.
    """
    spark = next(iter(tables.values()))[1].sparkSession
    rows = None
    for i, (name, (header, df)) in enumerate(sorted(tables.items(), key=lambda x: natural(x[0])), 1):
        if path:
            df.write.mode("overwrite").parquet(f"{path}/{name}")
            back = spark.read.parquet(f"{path}/{name}")
            if back.columns != df.columns or back.count() != df.count():
                raise ValueError(f"{name} was not written whole")
            df = back
        one = df.agg(F.count("*").alias("n_rows")).select(F.lit(i).alias("ord"), F.lit(name).alias("name"), F.lit(header).alias("header"), "n_rows", F.lit(len(df.columns)).alias("n_cols"))
        rows = one if rows is None else rows.union(one)
    return rows if rows is not None else spark.createDataFrame([], "ord int, name string, header string, n_rows bigint, n_cols int")


def write_bins(df: DataFrame, path: str) -> None:
    """Bin rows (chrom, bin, values) by chromosome, sorted by bin, so that a range of bins reads few row groups."""
    df.repartition("chrom").sortWithinPartitions("bin").write.mode("overwrite").partitionBy("chrom").parquet(path)


def read_bins(spark: SparkSession, path: str, chrom, low: int, high: int) -> DataFrame:
    """Rows low <= bin < high of one chromosome: partition pruning and a pushed-down range."""
    return spark.read.parquet(path).where((F.col("chrom") == chrom) & (F.col("bin") >= low) & (F.col("bin") < high))


def dosage_long(wide: DataFrame, ids: list[str], samples: list[str]) -> DataFrame:
    """(ids..., sample, dosage) from a column for each sample; missing genotypes are left out."""
    return wide.unpivot(ids, samples, "sample", "dosage").where("dosage is not null")


def aligned_matrix(grm: DataFrame, samples: DataFrame) -> DataFrame:
    """Entries (id1, id2, value) both of whose samples are in ``samples(id)``."""
    return grm.join(samples.select(F.col("id").alias("id1")), "id1", "left_semi").join(samples.select(F.col("id").alias("id2")), "id2", "left_semi")


def gathered(batches: DataFrame, expected: DataFrame) -> DataFrame:
    """Batch outputs (batch, idx, ...) numbered through from 1 as ``iter``; fails if an expected batch has no rows."""
    missing = expected.join(batches.select("batch").distinct(), "batch", "left_anti").count()
    if missing:
        raise FileNotFoundError(f"{missing} of the expected batches have no output")
    return batches.join(numbered(batches.select("batch", "idx").distinct(), ["batch", "idx"], "iter"), ["batch", "idx"])
