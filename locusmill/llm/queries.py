"""The queries of this subpackage, each over its whole table with production parameters, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from locusmill.llm import bpe, chat, decontaminate, divergence, html_main, line_dedup, packing, pivots, prefix_trie, sharding, simhash, suffix_dedup, toxicity
from locusmill.llm.common import table


def op1_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.remove_repeats(table(spark, sf_dir, "documents"), outputs="digest")


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    scored = toxicity.score(docs, toxicity.train(docs, table(spark, sf_dir, "labels")))
    held_out = F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))) % 5 == 0
    return scored.select("doc_id", held_out.alias("held_out"), "score", "predicted")


def op3_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.encode_decode(table(spark, sf_dir, "documents"), outputs="digest")


def op4_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat.collapse_snapshots(table(spark, sf_dir, "conversations"))


def op5_hilbert(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard_by_curve(table(spark, sf_dir, "documents"))


def op6_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op7_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.repeat_report(table(spark, sf_dir, "documents"))


def op8_pivots(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pivots.search(table(spark, sf_dir, "embeddings"), F.col("id") % 20 == 0)


def op9_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_groups(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op10_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    return html_main.extract(pages, html_main.train(pages))


def op11_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_trie.conversation_trie(table(spark, sf_dir, "conversations"), lend=(5, 9))


def op12_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), outputs="digest")


def op13_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence.audit(table(spark, sf_dir, "documents"))


QUERIES = {
    "op1_suffix_dedup": op1_suffix_dedup,
    "op2_toxicity": op2_toxicity,
    "op3_bpe": op3_bpe,
    "op4_chat": op4_chat,
    "op5_hilbert": op5_hilbert,
    "op6_decontaminate": op6_decontaminate,
    "op7_line_dedup": op7_line_dedup,
    "op8_pivots": op8_pivots,
    "op9_simhash": op9_simhash,
    "op10_html": op10_html,
    "op11_trie": op11_trie,
    "op12_packing": op12_packing,
    "op13_divergence": op13_divergence,
}

ORACLES: dict[str, str] = {
    "op1_suffix_dedup": suffix_dedup.REPEATS_SQL,
    "op4_chat": chat.COLLAPSE_SQL,
    "op6_decontaminate": decontaminate.CONTAMINATION_SQL,
    "op11_trie": prefix_trie.TRIE_SQL,
    "op13_divergence": divergence.AUDIT_SQL,
}
