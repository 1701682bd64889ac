"""Registry of the queries, and the stand-ins: inputs in the shapes the operators need, derived from the driver's tables.

A stand-in is one SQL text that Spark and DuckDB read alike; ``{name}`` stands for a table or another stand-in.
"""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

TABLES = "region nation customer supplier part orders lineitem events documents embeddings labels".split()
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

_POS = "timestampdiff(SECOND, TIMESTAMP_NTZ '2024-01-01 00:00:00', ts)"
_DUCK = {_POS: "(CAST(floor(epoch(ts)) AS BIGINT) - 1704067200)"}

STANDINS = {
    "assoc": """SELECT l_suppkey AS locus, p_brand AS tf, p_type AS tissue, l_partkey, l_orderkey, l_linenumber, l_linestatus,
        (l_quantity - 2.55e1) / 1.44e1 AS zscore,
        (((l_orderkey * 7919 + l_partkey * 104729 + l_linenumber * 1299709) % 1000003) + 5e-1) / 1.000003e6 AS pvalue
        FROM {lineitem} JOIN {part} ON l_partkey = p_partkey""",
    "set_f": "SELECT l_partkey AS gene, min(pvalue) AS pvalue, max(zscore) AS zscore FROM {assoc} WHERE l_linestatus = 'F' AND l_partkey % 7 <> 1 GROUP BY l_partkey",
    "set_o": "SELECT l_partkey AS gene, min(pvalue) AS pvalue, max(zscore) AS zscore FROM {assoc} WHERE l_linestatus = 'O' AND l_partkey % 5 <> 2 GROUP BY l_partkey",
    "peaks": f"SELECT event_id AS id, user_id % 22 + 1 AS chrom, {_POS} - 600 AS start, {_POS} + 600 AS stop, value AS score FROM {{events}} WHERE event_type = 'purchase'",
    "genes": f"SELECT event_id AS gene, user_id % 22 + 1 AS chrom, {_POS} AS start, {_POS} + 100 + event_id % 1000 AS stop FROM {{events}} WHERE event_type = 'click'",
    "snps": f"SELECT event_id AS snp, user_id % 22 + 1 AS chrom, {_POS} AS pos FROM {{events}} WHERE event_type = 'view'",
    "blocks": "SELECT chrom, k * 21600 + 1 AS start, (k + 1) * 21600 AS stop FROM (SELECT DISTINCT user_id % 22 + 1 AS chrom FROM {events}) c CROSS JOIN (SELECT DISTINCT event_id % 120 AS k FROM {events}) b",
    "lift": """SELECT chrom, k * 86400 AS src_start, (k + 1) * 86400 - 1 AS src_stop, chrom AS dst_chrom, chrom * 1000 AS shift,
        CASE WHEN k % 2 = 0 THEN '+' ELSE '-' END AS strand
        FROM (SELECT DISTINCT user_id % 22 + 1 AS chrom FROM {events}) c CROSS JOIN (SELECT DISTINCT event_id % 31 AS k FROM {events}) b WHERE k % 7 <> 6""",
    "x_long": "SELECT vec_id, feature, CAST(x AS DOUBLE) AS x FROM {embeddings} LATERAL VIEW posexplode(embedding) e AS feature, x",
    "w_long": "SELECT label AS model, feature, avg(x) AS w FROM {x_long} JOIN {embeddings} USING (vec_id) GROUP BY label, feature",
    "cells": "SELECT vec_id AS locus, label AS feature, sum(x * w) AS score FROM {x_long} JOIN (SELECT model AS label, feature AS f, w FROM {w_long}) m ON feature = f GROUP BY vec_id, label",
    "bins": "SELECT label AS chrom, feature, CAST(floor(vec_id / 1e1) AS BIGINT) AS bin, x FROM {x_long} JOIN {embeddings} USING (vec_id)",
    "classed": "SELECT doc_id, quality, toxic, n_chars, lang FROM {labels} JOIN {documents} USING (doc_id)",
    "dosage": "SELECT o_custkey AS sample, l_partkey AS variant, CAST(max((l_orderkey + l_linenumber) % 3) AS BIGINT) AS dosage FROM {lineitem} JOIN {orders} ON l_orderkey = o_orderkey GROUP BY o_custkey, l_partkey",
    "pop_dosage": "SELECT c_nationkey AS sample, variant, CAST(max(dosage) AS BIGINT) AS dosage FROM {dosage} JOIN {customer} ON c_custkey = sample GROUP BY c_nationkey, variant",
    "snp_weights": "SELECT p_brand AS gene, p_partkey AS variant, CASE WHEN p_partkey % 3 = 0 THEN 'A' ELSE 'C' END AS ref, CASE WHEN p_partkey % 3 = 0 THEN 'C' ELSE 'A' END AS eff, (p_size - 25) / 5e1 AS weight FROM {part}",
    "loci": "SELECT DISTINCT concat('chr', CAST(l_suppkey % 22 + 1 AS STRING), '_', CAST(l_partkey AS STRING), '_', CAST(l_partkey + CAST(l_quantity AS BIGINT) AS STRING)) AS locus FROM {lineitem}",
    "effects": "SELECT l_orderkey, l_linenumber, (l_partkey - 1000) * 500 AS distance, l_discount - 5e-2 AS beta FROM {lineitem}",
    "terms": "SELECT p_type AS term, p_partkey AS member FROM {part}",
    "asked": "SELECT DISTINCT n_name AS query, l_partkey AS member FROM {lineitem} JOIN {supplier} ON s_suppkey = l_suppkey JOIN {nation} ON n_nationkey = s_nationkey",
    "tracks": f"SELECT user_id % 22 + 1 AS chrom, CAST(floor(({_POS}) / 1.28e2) AS BIGINT) AS bin, avg(value) AS x FROM {{events}} GROUP BY 1, 2",
    "gwas": "SELECT concat('rs', CAST(l_orderkey AS STRING)) AS rsid, l_suppkey % 22 + 1 AS chrom, l_partkey AS pos, CASE WHEN l_linenumber % 5 = 0 THEN NULL ELSE concat('v', CAST(l_partkey AS STRING)) END AS variant_id, l_discount - 5e-2 AS beta, l_tax AS se FROM {lineitem}",
    "snp_z": "SELECT p_partkey AS variant, CASE WHEN p_partkey % 4 = 0 THEN 'A' ELSE 'C' END AS eff_gwas, (p_size - 20) / 1e1 AS z FROM {part}",
}
#: Stand-ins of which DuckDB reads another text.
_DUCK_STANDINS = {"x_long": "SELECT vec_id, CAST(feature AS INTEGER) AS feature, CAST(embedding[feature + 1] AS DOUBLE) AS x FROM embeddings, range(64) r(feature)"}

#: Stand-ins of which Spark reads another text with the same rows: here the largest of all a nation's dosages is taken at once.
_SPARK_STANDINS = {
    "pop_dosage": """SELECT c_nationkey AS sample, l_partkey AS variant, CAST(max(d) AS BIGINT) AS dosage
        FROM (SELECT c_nationkey, l_partkey, (l_orderkey + l_linenumber) % 3 AS d
        FROM {lineitem} JOIN (SELECT o_orderkey, c_nationkey FROM {orders} JOIN {customer} ON c_custkey = o_custkey) p ON l_orderkey = o_orderkey) r GROUP BY c_nationkey, l_partkey"""
}


def _used(sql: str) -> list[str]:
    return list(dict.fromkeys(re.findall(r"\{(\w+)\}", sql)))


def with_standins(sql: str) -> str:
    """An oracle's text with its stand-ins as common table expressions."""
    parts: dict[str, str] = {}

    def add(name: str) -> None:
        if name in STANDINS and name not in parts:
            text = _DUCK_STANDINS.get(name, STANDINS[name])
            for n in _used(text):
                add(n)
            parts[name] = text

    for name in _used(sql):
        add(name)
    plain = lambda s: re.sub(r"\{(\w+)\}", lambda m: m[1] if m[1] in STANDINS or m[1] in TABLES else m[0], s)
    sql = plain(sql).strip()
    if parts:
        head = ", ".join(f"{n} AS ({plain(t)})" for n, t in parts.items())
        sql = f"WITH {head}, {sql[5:]}" if sql.upper().startswith("WITH ") else f"WITH {head} {sql}"
    for a, b in _DUCK.items():
        sql = sql.replace(a, b)
    return sql


class Tables:
    """The driver's tables and the stand-ins by name."""

    def __init__(self, spark: SparkSession, sf_dir: str) -> None:
        self.spark, self.sf_dir = spark, sf_dir

    def __getattr__(self, name: str) -> DataFrame:
        if name in STANDINS:
            return self.sql(_SPARK_STANDINS.get(name, STANDINS[name]))
        if name in TABLES:
            return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")
        raise AttributeError(name)

    def sql(self, text: str) -> DataFrame:
        return self.spark.sql(text, **{n: getattr(self, n) for n in _used(text)})


def query(name: str, sql: str | None = None):
    """Registers a function of ``Tables`` as a query, with the SQL of the same rows."""

    def register(f: Callable[[Tables], DataFrame]):
        QUERIES[name] = lambda spark, sf_dir: f(Tables(spark, sf_dir))
        if sql is not None:
            ORACLES[name] = with_standins(sql)
        return f

    return register


def r(col: Column | str, digits: int = 6) -> Column:
    """Rounded, with no negative zero."""
    return F.round(F.col(col) if isinstance(col, str) else col, digits) + F.lit(0.0)


def rounded(df: DataFrame, *columns: str, digits: int = 6) -> DataFrame:
    return df.withColumns({c: r(c, digits) for c in columns})
