"""Labelled keys, roots of components and metadata values that very many rows share."""

import random

import pytest
from pyspark.sql import functions as F

from locusmill.llm import graph, sharding, toxicity


@pytest.mark.parametrize("most", [1, 3])
def test_labelled_key_on_very_many_rows(spark, monkeypatch, most):
    """The sample is bounded in rows: different texts of one key are rows of the sample, equal ones count once."""
    rows = [(1, f"text number {i} idiot") for i in range(500)] + [(2, "a river and a stone")] * 300 + [(3, None)] * 2 + [(None, "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(1, 1), (1, 0), (2, 0), (3, 0), (None, 1), (9, None)], "doc_id long, toxic int")
    seen = []
    monkeypatch.setattr(toxicity, "fit", lambda sample, ids: seen.append(sorted(sample.y)))
    toxicity.train(docs, labels, max_labelled=most)
    (ys,) = seen
    assert ys.count(1) == most and ys.count(0) == min(most, 2)  # none of the three keys is held out


def test_component_of_one_hub_and_long_chains(spark):
    """A hub with 6,000 neighbours beside 2,000 pairs and a chain: the hub's edges go the broadcast way, all others the shuffled one."""
    rng = random.Random(3)
    hub = [(7, 10_000 + i) for i in range(6_000)]
    pairs = [(100_000 + 2 * i, 100_001 + 2 * i) for i in range(2_000)]
    chain = [(200_000 + i, 200_001 + i) for i in range(300)]
    edges = [e if rng.random() < 0.5 else e[::-1] for e in hub + pairs + chain]
    got = {r.node: r.root for r in graph.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    want = {7: 7} | {b: 7 for _, b in hub} | {x: a for a, b in pairs for x in (a, b)} | {200_000 + i: 200_000 for i in range(301)}
    assert got == want


def test_shards_read_each_table_a_bounded_number_of_times(spark):
    """The plan doesn't double with each dimension."""
    df = spark.range(3_000).select(F.col("id").alias("doc_id"), F.concat(F.lit("t"), F.col("id") % 2_900).alias("text"), F.lit("en").alias("lang"), (F.col("id") % 1_500).cast("string").alias("source"))
    got = sharding.shard_by_curve(df)
    assert got._jdf.queryExecution().optimizedPlan().toString().count("Relation") <= 4
    sizes = {r["shard"]: r["count"] for r in got.groupBy("shard").count().collect()}
    assert sum(sizes.values()) == 3_000 and set(sizes.values()) == {125}
