"""The training-data pipeline: toxicity, SimHash near-dedup, substring dedup, decontamination, BPE."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from locusmill.llm import bpe, decontaminate, line_dedup, simhash, toxicity
from locusmill.llm.common import dropped, only, table


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier rejects go; it learns from the labels outside the held-out fifth."""
    return toxicity.remove_toxic(docs, table(spark, sf_dir, "labels"))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies (0.8 of their five-word shingles, or fingerprints 2 bits apart) the document of smallest doc_id stays."""
    return simhash.near_dedup(docs)


def cut_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Stretches of text that an earlier document, or the same one, holds go; every document stays."""
    return line_dedup.remove_repeated_units(docs)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of which benchmark windows make up a twentieth go."""
    return decontaminate.remove_contaminated(docs, table(spark, sf_dir, "benchmark"))


def tokenize(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token counts and digests of ids and decoded text."""
    return bpe.encode_decode(docs, outputs="digest")


STAGES = [
    ("toxicity", drop_toxic),
    ("simhash_near_dedup", drop_near_copies),
    ("substring_dedup", cut_repeats),
    ("decontamination", drop_contaminated),
    ("bpe", tokenize),
]

#: SQL has neither the classifier nor XXH64; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 of the documents that all stages kept, one row for each row.

    The stages define what happens to null, empty, long, tied and repeated rows; none drops a row for these, except that
    documents without words are near copies of each other. An empty table gives no rows. Only a stage's result is kept, its scratch tables and the
    table before it go.
    """
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        before, docs = docs, only(lambda: stage(spark, docs, sf_dir))  # noqa: B023
        dropped(before)
    return STAGES[-1][1](spark, docs, sf_dir)
