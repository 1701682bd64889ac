"""Benchmark decontamination: windows of test words found in training texts, verified, then cut out."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from locusmill.llm.common import ascii_lower, saved

WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: Benchmark windows, counted with their items, that are sent to all executors at once; more are taken in blocks, a scan of the texts for each.
MAX_BROADCAST_WINDOWS = 2_000_000


def words_of(text: Column) -> Column:
    """The words, A-Z in lower case; none for null."""
    return F.regexp_extract_all(ascii_lower(F.coalesce(text, F.lit(""))), F.lit(WORD), F.lit(0))


def benchmark_windows(bench: DataFrame, item: str, text: str, width: int) -> DataFrame:
    """(anchor, back, size, phrase, items): each distinct window, its anchor word and how far back it begins.

    The anchor is the window's word that fewest windows' places hold in the benchmark, so that few places of the
    training texts need a look. An item of fewer words, but not none, is one window.
    """
    items = bench.select(F.col(item).cast("string").alias("item"), words_of(F.col(text)).alias("w")).where(F.size("w") > 0)
    phrases = (
        items.select("item", "w", F.explode(F.sequence(F.lit(1), F.greatest(F.lit(1), F.size("w") - width + 1))).alias("at"))
        .select("item", F.slice("w", F.col("at"), F.least(F.lit(width), F.size("w"))).alias("w"))
        .groupBy("w").agg(F.collect_set("item").alias("items"))
    )
    places = phrases.select("w", "items", F.posexplode("w").alias("back", "anchor"))
    common = places.groupBy("anchor").agg(F.count("*").alias("n"))
    pick = F.min(F.struct("n", F.xxhash64("anchor").alias("h"), "anchor", "back")).alias("best")
    best = places.join(common, "anchor").groupBy("w", "items").agg(pick)
    return best.select(F.col("best.anchor").alias("anchor"), F.col("best.back").alias("back"), F.size("w").alias("size"), F.array_join("w", " ").alias("phrase"), "items")


def found_windows(docs: DataFrame, bench: DataFrame, key: str, text: str, item: str, item_text: str, width: int) -> DataFrame:
    """(key, h, n_words, start, size, items): every occurrence of a benchmark window, and a row of null start for each row of ``docs``.

    start counts words from 0, h is the text's hash. The texts' words are laid out in a row each, behind them the empty word, and
    meet the anchors in a broadcast join; at the few places left, the whole window is compared. The empty word stands for the
    row itself. Words are never shuffled: with very many windows the anchors come in blocks of MAX_BROADCAST_WINDOWS.
    """
    windows = saved(benchmark_windows(bench, item, item_text, width))
    held = windows.agg(F.count("*") + F.coalesce(F.sum(F.size("items")), F.lit(0))).first()[0]
    blocks = -(-held // MAX_BROADCAST_WINDOWS) or 1
    words = docs.select(F.col(key).alias("key"), F.xxhash64(text).alias("h"), words_of(F.col(text)).alias("words"))
    row = windows.sparkSession.range(1).select(F.lit("").alias("anchor"), F.lit(0).alias("back"), F.lit(0).alias("size"), F.lit("").alias("phrase"), F.array().cast("array<string>").alias("items"))
    start = F.col("at") - F.col("back")
    out = None
    for block in range(blocks):
        anchors = windows.where(F.pmod(F.xxhash64("anchor"), F.lit(blocks)) == block).select("anchor", "back", "size", "phrase", "items")
        if block == 0:
            anchors = anchors.union(row)
        places = words.select("key", "h", F.size("words").cast("long").alias("n_words"), "words", F.posexplode(F.array_append("words", F.lit(""))).alias("at", "anchor"))
        inside = (start >= 0) & (start + F.col("size") <= F.size("words"))
        equal = F.array_join(F.slice("words", F.greatest(start, F.lit(0)) + 1, F.col("size")), " ") == F.col("phrase")
        found = places.join(F.broadcast(anchors), "anchor").where((F.col("anchor") == "") | inside & equal)
        found = found.select("key", "h", "n_words", F.when(F.col("size") > 0, start).alias("start"), "size", "items")
        out = found if out is None else out.union(found)
    return out


def _judged(docs: DataFrame, bench: DataFrame, key: str, text: str, item: str, item_text: str, width: int) -> DataFrame:
    """(key, h, n_words, copies, n_hit, items, contaminated) of each key and text of ``docs``; h is the text's hash, copies its number of rows."""
    place = F.when(F.col("start").isNotNull(), F.sequence(F.col("start"), F.col("start") + F.col("size") - 1))
    found = found_windows(docs, bench, key, text, item, item_text, width).groupBy("key", "h", "n_words").agg(
        F.count_if(F.col("start").isNull()).alias("copies"),
        F.size(F.array_distinct(F.flatten(F.collect_set(place)))).cast("long").alias("n_hit"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_set("items")))).alias("items"),
    )
    return found.withColumn("contaminated", (F.col("n_hit") > 0) & (20 * F.col("n_hit") >= F.col("n_words")))


def contamination(docs: DataFrame, bench: DataFrame, key: str = "doc_id", text: str = "text", item: str = "item_id", item_text: str = "text", width: int = 13) -> DataFrame:
    """One row for each row of ``docs``: key, n_words, n_hit, n_items, items_sha256, contaminated.

    A word within any occurrence of a benchmark window is hit; contaminated if a twentieth of the words are, and one at
    least. Null and blank texts have no words; null item ids mark words but are not listed; repeated items and rows
    change nothing but the number of rows. Rows of one key and different texts are told apart by the text's hash.
    Only the named columns are read. Empty tables give no rows, or no hits.
    """
    judged = _judged(docs, bench, key, text, item, item_text, width).withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies"))))
    return judged.select(
        F.col("key").alias(key), "n_words", "n_hit", F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), "contaminated",
    )


def remove_contaminated(docs: DataFrame, bench: DataFrame, key: str = "doc_id", text: str = "text", item: str = "item_id", item_text: str = "text", width: int = 13) -> DataFrame:
    """``docs`` without the contaminated documents, all columns kept. Rows of one key, or of none, are each judged by their own text."""
    bad = _judged(docs, bench, key, text, item, item_text, width).where("contaminated").select(F.col("key").alias("__key"), F.col("h").alias("__hash"))
    return docs.join(bad, docs[key].eqNullSafe(bad["__key"]) & (F.xxhash64(docs[text]) == bad["__hash"]), "left_anti")


def remove_spans(docs: DataFrame, bench: DataFrame, key: str = "doc_id", text: str = "text", item: str = "item_id", item_text: str = "text", width: int = 13) -> DataFrame:
    """``docs`` with the words of every found window, and what stands between them, cut out of the text."""
    hits = found_windows(docs, bench, key, text, item, item_text, width).where("start is not null").select("key", "h", "start", (F.col("start") + F.col("size")).alias("stop"))
    order = Window.partitionBy("key", "h").orderBy("start", "stop")
    reach = F.max("stop").over(order.rowsBetween(Window.unboundedPreceding, -1))
    runs = hits.distinct().withColumn("new", F.when(reach >= F.col("start"), 0).otherwise(1)).withColumn("run", F.sum("new").over(order))
    spans = runs.groupBy("key", "h", "run").agg(F.min("start").alias("start"), F.max("stop").alias("stop")).groupBy("key", "h").agg(F.array_sort(F.collect_list(F.struct("start", "stop"))).alias("__spans"))
    spans = spans.withColumnsRenamed({"key": "__key", "h": "__hit"})
    joined = docs.withColumn("__h", F.xxhash64(text)).join(spans, docs[key].eqNullSafe(F.col("__key")) & (F.col("__h") == F.col("__hit")), "left")
    # pieces[i] is the i-th word with what stands before it; the last piece is what follows the last word
    pieces = F.regexp_extract_all(F.col(text), F.lit(r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]*(?:[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+|$)"), F.lit(0))
    hit = lambda i: F.exists("__spans", lambda s: (s.start <= i) & (i < s.stop))
    cut = F.array_join(F.transform(F.filter(F.transform(pieces, lambda p, i: F.struct(p.alias("p"), i.alias("i"))), lambda x: ~hit(x.i)), lambda x: x.p), "")
    return joined.withColumn(text, F.when(F.col("__spans").isNull(), F.col(text)).otherwise(cut)).select(*docs.columns)


CONTAMINATION_SQL = r"""
WITH b AS (SELECT item_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
win AS (SELECT DISTINCT item_id, w[i:i + 12] AS k FROM b, range(1, 100000) r(i) WHERE len(w) > 0 AND i <= greatest(1, len(w) - 12)),
d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
sizes AS (SELECT DISTINCT len(k) AS n FROM win),
p AS (SELECT doc_id, n, unnest(range(1, len(w) - n + 2)) AS i, w FROM d, sizes WHERE len(w) >= n),
hit AS (SELECT doc_id, i, n, item_id FROM (SELECT doc_id, i, n, w[i:i + n - 1] AS k FROM p) q JOIN win USING (k)),
agg AS (SELECT doc_id, count(DISTINCT item_id) AS n_items, string_agg(DISTINCT item_id::VARCHAR, ',' ORDER BY item_id::VARCHAR) AS items FROM hit GROUP BY doc_id),
cov AS (SELECT doc_id, count(DISTINCT j) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS j FROM (SELECT DISTINCT doc_id, i, n FROM hit) q) r GROUP BY doc_id)
SELECT d.doc_id, len(d.w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
  sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(d.w) AS contaminated
FROM d LEFT JOIN agg USING (doc_id) LEFT JOIN cov USING (doc_id)
"""
