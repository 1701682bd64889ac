"""Substring dedup by hashing lines, and stretches of words inside and across lines: the earliest stays, later ones go."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window, functions as F

from locusmill.llm.common import bytes_of, saved, spread, text_batches
from locusmill.llm.shingles import mixed, run_names, stretches, words_of
from locusmill.llm.suffix_dedup import REMOVED, ROWS, combined, document_key, rank_by_name, text_hashes

#: Words of the least repeat that goes; of so many consecutive stretches of that size one is looked up.
RUN_WORDS, PLACES = 25, 8
#: Characters of the texts that are hashed at once.
CHARS = 500_000
COLUMNS = ["kh", "sh", "key", "crc", "start", "n", "idx", "words"]


def hashed_units(texts: list[str], unit_words: int, stretch_words: int) -> dict[str, np.ndarray]:
    """Lines of ``unit_words`` words and more, and stretches of ``stretch_words`` words (none for 0).

    kh, sh: names; text; start, n: characters; idx: the first word's number in its text; words: how many, negative for stretches.
    """
    w = words_of(texts)
    first = np.append(0, np.cumsum(np.bincount(w.text, minlength=len(texts))))  # word where each text begins
    new = np.append(True, (w.text[1:] != w.text[:-1]) | (w.line[1:] != w.line[:-1])) if len(w.text) else np.zeros(0, bool)
    begin = np.flatnonzero(new)
    end = np.append(begin[1:], len(w.text)).astype(np.int64)[: len(begin)]
    long_ = end - begin >= unit_words
    begin, end = begin[long_], end[long_]
    size = (end - begin).astype(np.uint64)
    found = [(mixed(run_names(mixed(w.name, 29), begin, end) + size), mixed(run_names(mixed(w.name, 31), begin, end) + size), begin, end, end - begin)]
    if stretch_words:
        at, kh, sh = stretches(w, stretch_words, PLACES)
        found.append((kh, sh, at, at + stretch_words, np.full(len(at), -stretch_words)))
    kh, sh, begin, end, words = (np.concatenate(x) for x in zip(*found, strict=True))
    text = w.text[begin]
    return {"kh": kh, "sh": sh, "text": text, "start": w.start[begin], "n": w.stop[end - 1] - w.start[begin], "idx": begin - first[text], "words": words}


def slices(texts: list[str]) -> Iterator[tuple[int, int]]:
    """Ranges of texts of CHARS characters at most, or of one text."""
    start = size = 0
    for i, t in enumerate(texts):
        if i > start and size + len(t) > CHARS:
            yield start, i
            start, size = i, 0
        size += len(t)
    if start < len(texts):
        yield start, len(texts)


def repeated_units(df: DataFrame, key: str = "doc_id", text: str = "text", unit_words: int = 1, run_words: int = RUN_WORDS, stretch_words: int = RUN_WORDS) -> DataFrame:
    """(key, crc, spans, lines): what later documents repeat, as offsets in their characters.

    Lines are compared without regard to case and white space; one is a repeat if an equal line stands at a smaller (key,
    offset). ``lines`` (start, stop, words) lists every repeated line of ``unit_words`` words and more. ``spans`` (start, stop) is
    what goes: repeated lines that follow one another and hold ``run_words`` words together, and stretches of
    ``stretch_words`` equal words at any place, across sentences and lines (0: none), joined where they overlap or touch. So
    every passage of stretch_words + PLACES - 1 words and more goes but for PLACES - 1 words at each end at most; with
    ``run_words=1, stretch_words=0`` every repeated line goes and nothing else. A batch sends each name once: a line
    that a third of all documents hold arrives once from each batch, and its other copies there are settled at once.
    """
    body = F.coalesce(F.col(text), F.lit(""))

    def hashed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            texts, keys = batch.text.tolist(), batch.key.to_numpy()
            for a, b in slices(texts):
                found = hashed_units(texts[a:b], unit_words, stretch_words)
                crc, own = text_hashes([t.encode() for t in texts[a:b]]), found.pop("text")
                if len(own):
                    rows = pd.DataFrame({"key": keys[a:b][own], "crc": crc[own]} | {c: x.view(np.int64) if c in ("kh", "sh") else x.astype(np.int32) for c, x in found.items()})
                    yield combined(rows[COLUMNS], True)[["kh", "sh", "key", "crc", "start", "ns", "idx", "words"]]

    docs = df.select(document_key(key, body).alias("key"), body.alias("text"))
    made = text_batches(docs).mapInPandas(hashed, ROWS + ", idx int, words int")
    parts = spread(df, bytes_of(docs) / 20)  # about a row for 20 bytes
    again = rank_by_name(made, True, ("idx", "words"), parts).where(F.col("state") == REMOVED).select("key", "crc", "start", "n", "idx", "words")
    units = saved(again.distinct()).withColumns({"stop": F.col("start") + F.col("n"), "end": F.col("idx") + F.abs("words"), "line": F.col("words") > 0})

    def runs(rows: DataFrame, own: list[str]) -> DataFrame:
        """Rows whose words overlap or adjoin become one."""
        order = Window.partitionBy(*own).orderBy("idx", "end")
        reach = F.max("end").over(order.rowsBetween(Window.unboundedPreceding, -1))
        apart = rows.withColumn("run", F.sum(F.when(reach >= F.col("idx"), 0).otherwise(1)).over(order))
        return apart.groupBy(*own, "run").agg(F.min("start").alias("start"), F.max("stop").alias("stop"), F.min("idx").alias("idx"), F.max("end").alias("end"))

    one_kind = runs(units, ["key", "crc", "line"]).where(~F.col("line") | (F.col("end") - F.col("idx") >= run_words))
    kept = runs(one_kind, ["key", "crc"])
    span, line = F.struct("start", "stop"), F.struct("start", "stop", "words")
    parts_ = kept.select("key", "crc", span.alias("span"), F.lit(None).cast("struct<start:int,stop:int,words:int>").alias("line")).unionByName(
        units.where("line").select("key", "crc", F.lit(None).cast("struct<start:int,stop:int>").alias("span"), line.alias("line"))
    )
    return parts_.groupBy("key", "crc").agg(F.array_sort(F.collect_list("span")).alias("spans"), F.array_sort(F.collect_list("line")).alias("lines"))


def _with_spans(df: DataFrame, key: str, text: str, *more, **how) -> DataFrame:
    body = F.coalesce(F.col(text), F.lit(""))
    base = df.select(*more, document_key(key, body).alias("__key"), F.xxhash64(body).alias("__crc"))
    found = repeated_units(df, key, text, **how).withColumnsRenamed({"key": "__key", "crc": "__crc", "spans": "__spans", "lines": "__lines"})
    return base.join(found, ["__key", "__crc"], "left")


def repeat_report(df: DataFrame, key: str = "doc_id", text: str = "text", **how) -> DataFrame:
    """One row for each row: key, n_chars, n_removed, n_spans, spans (start, stop in characters of the input), n_lines, lines.

    ``spans`` go, ``lines`` are all repeated lines; see ``repeated_units``, also for ``how``. Null texts count as empty, null keys
    rank before all others; of rows with one key a hash of the text decides, and a repeated row is the same document and
    gets the same result. Only ``key`` and ``text`` are read. No rows, no result.
    """
    n_chars = F.length(F.coalesce(F.col(text), F.lit(""))).cast("long")
    out = _with_spans(df, key, text, F.col(key), n_chars.alias("n_chars"), **how)
    out = out.withColumns({"spans": F.coalesce("__spans", F.array().cast("array<struct<start:int,stop:int>>")), "lines": F.coalesce("__lines", F.array().cast("array<struct<start:int,stop:int,words:int>>"))})
    removed = F.aggregate("spans", F.lit(0).cast("long"), lambda a, s: a + s.stop - s.start)
    return out.select(key, "n_chars", removed.alias("n_removed"), F.size("spans").cast("long").alias("n_spans"), "spans", F.size("lines").cast("long").alias("n_lines"), "lines")


def remove_repeated_units(df: DataFrame, key: str = "doc_id", text: str = "text", **how) -> DataFrame:
    """``df`` with the repeated stretches cut out of ``text``; all other columns and rows stay. Null texts stay null."""
    # kept: from each span's end, or the text's start, to the next span's start, or the text's end
    starts = F.concat(F.array(F.lit(0)), F.transform("__spans", lambda s: s.stop))
    ends = F.concat(F.transform("__spans", lambda s: s.start), F.array(F.length(text)))
    kept = F.array_join(F.transform(F.arrays_zip(starts.alias("a"), ends.alias("b")), lambda s: F.substring(F.col(text), s.a + 1, F.greatest(s.b - s.a, F.lit(0)))), "")
    out = _with_spans(df, key, text, *df.columns, **how)
    return out.withColumn(text, F.when(F.col("__spans").isNull(), F.col(text)).otherwise(kept)).select(*df.columns)
