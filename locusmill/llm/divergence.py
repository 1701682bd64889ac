"""Source divergence audit: how far the term frequencies of a language's sources lie apart, from count-level bitmaps.

A count level is the set of terms that a group has exactly so many times, as a bitset over the language's kept terms. A pair's
joint cells (terms that one has c and the other c' times) are an AND and a popcount of two levels, whatever the cell's
weight f(c, c') is. Level 0 isn't stored: its cells are the complement, from the sizes of the levels. Terms are numbered by
falling frequency, so 64 neighbours have similar counts and a word of 64 terms has few levels.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window, functions as F

from locusmill.llm.common import hot_join, running, saved, text_batches

#: Documents of its language that hold a kept term at least; terms listed for a group.
MIN_DOCS, TOP = 30, 50
#: Entries that a worker counts before it hands them on; words of 64 terms in a block; sources in a tile.
HELD, BLOCK, TILE = 300_000, 16, 32
#: What a byte of UTF-8 becomes: letters and bytes of other characters stay, A-Z in lower case; all else parts terms.
PARTED = bytes(b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


def shares(count: np.ndarray, total: np.ndarray, kept: np.ndarray) -> np.ndarray:
    """1 + floor(10**9 * (count + 5) / (total + 5 * kept)), exact, three digits at a time."""
    below = np.maximum(total + 5 * kept, 1)
    out, rest = np.divmod(count + 5, below)
    for _ in range(3):
        digit, rest = np.divmod(rest * 1000, below)
        out = out * 1000 + digit
    return out + 1


def _share(count: str, total: str, kept: str):
    return F.expr(f"1 + (cast({count} + 5 as decimal(20, 0)) * 1000000000bd) div greatest({total} + 5 * {kept}, 1)")


def term_counts(docs: DataFrame) -> DataFrame:
    """(lang, source, term, n, df): occurrences and documents of each term in documents (lang, source, text), summed by worker."""

    def told(held: dict) -> Iterator[pd.DataFrame]:
        for (lang, source), (n, df) in held.items():
            if n:
                yield pd.DataFrame({"lang": lang, "source": source, "term": [t.decode() for t in n], "n": list(n.values()), "df": [df[t] for t in n]})

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held, size = {}, 0
        for batch in batches:
            for lang, source, text in zip(batch.lang, batch.source, batch.text, strict=True):
                words = text.encode().translate(PARTED).split()
                n, df = held.setdefault((lang, source), (Counter(), Counter()))
                size -= len(n)
                n.update(words)
                df.update(set(words))
                size += len(n)
                if size > HELD:
                    yield from told(held)
                    held, size = {}, 0
        yield from told(held)

    parts = text_batches(docs).mapInPandas(run, "lang string, source string, term string, n long, df long")
    return parts.groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("df").alias("df"))


PAIR = "lang string, a string, b string, part long"


def joint_cells(own: pd.DataFrame) -> pd.DataFrame:
    """What the cells of a pair of tiles add in a block of words: for each pair of sources a (tile ti) and b (tile tj), the sum of popcount * weight.

    Rows: lang, ti, tj, tile, source, word, n, bits, total, kept. The weight of a cell is f(c, c') less f(c, 0) and f(0, c')
    and more f(0, 0), as ``zero_cells`` counts every term as if the other count were 0. In one tile a < b.
    """
    own = own.sort_values(["word", "source", "n"], kind="stable")
    total, kept = own.total.to_numpy(), own.kept.to_numpy()
    own = own.assign(p=shares(own.n.to_numpy(), total, kept), p0=shares(np.zeros(len(own), np.int64), total, kept), bits=own.bits.to_numpy().view(np.uint64))
    left, right = own[own.tile == own.ti], own[own.tile == own.tj]
    names = [np.unique(x.source.to_numpy()) for x in (left, right)]
    sums = np.zeros((len(names[0]), len(names[1])), np.int64)
    by_word = {w: x for w, x in right.groupby("word", sort=False)}
    for (word, source), a in left.groupby(["word", "source"], sort=False):
        if (b := by_word.get(word)) is None:
            continue
        cells = np.bitwise_count(a.bits.to_numpy()[:, None] & b.bits.to_numpy()[None, :]).astype(np.int64)
        p, p0, q, q0 = a.p.to_numpy()[:, None], a.p0.to_numpy()[:, None], b.p.to_numpy()[None, :], b.p0.to_numpy()[None, :]
        by_row = (cells * (np.abs(p - q) - np.abs(p - q0) - np.abs(p0 - q) + np.abs(p0 - q0))).sum(axis=0)
        np.add.at(sums[np.searchsorted(names[0], source)], np.searchsorted(names[1], b.source.to_numpy()), by_row)
    return _pairs(own, names, sums)


def zero_cells(own: pd.DataFrame) -> pd.DataFrame:
    """The cells of level 0 of each pair of sources in a pair of tiles, by complement: as if no term were in both.

    Rows: lang, ti, tj, tile, source, total, kept, levels (n, terms). Every pair gets a row, also without any term.
    """
    own = own.sort_values("source", kind="stable")
    left, right = own[own.tile == own.ti], own[own.tile == own.tj]

    def against_zero(x: pd.DataFrame, other: np.ndarray) -> np.ndarray:
        """For each source of ``x`` and each share of 0 elsewhere: its levels' terms times the difference."""
        out = []
        for levels, total, kept in zip(x.levels, x.total, x.kept, strict=True):
            n, terms = np.array([(v["n"], v["terms"]) for v in levels], np.int64).reshape(-1, 2).T
            p = shares(n, np.int64(total), np.int64(kept))
            order = np.argsort(p)
            p, terms = p[order], terms[order]
            some, whole = np.append(0, np.cumsum(terms)), np.append(0, np.cumsum(terms * p))
            at = np.searchsorted(p, other)
            out.append((other * some[at] - whole[at]) + (whole[-1] - whole[at] - other * (some[-1] - some[at])))
        return np.array(out, np.int64).reshape(len(x), len(other))

    zero = [shares(np.zeros(len(x), np.int64), x.total.to_numpy(), x.kept.to_numpy()) for x in (left, right)]
    held = [np.array([sum(v["terms"] for v in s) for s in x.levels], np.int64) for x in (left, right)]
    neither = left.kept.to_numpy()[:, None] - held[0][:, None] - held[1][None, :]
    sums = against_zero(left, zero[1]) + against_zero(right, zero[0]).T + neither * np.abs(zero[0][:, None] - zero[1][None, :])
    return _pairs(own, [left.source.to_numpy(), right.source.to_numpy()], sums)


def _pairs(own: pd.DataFrame, names: list[np.ndarray], sums: np.ndarray) -> pd.DataFrame:
    i, j = np.indices(sums.shape)
    out = pd.DataFrame({"lang": own.lang.iloc[0], "a": names[0][i.ravel()], "b": names[1][j.ravel()], "part": sums.ravel()})
    return (out[out.a < out.b] if own.ti.iloc[0] == own.tj.iloc[0] else out).astype({"lang": object, "a": object, "b": object})  # also if no row is left


def audit(df: DataFrame, lang: str = "lang", source: str = "source", text: str = "text", min_docs: int = MIN_DOCS, top: int = TOP) -> DataFrame:
    """(lang, source, part, item, value, rank) for every (lang, source) that occurs.

    Part ``pair``: each other source of the language by the summed difference of the smoothed frequencies of the language's kept
    terms (in ``min_docs`` documents of it at least); part ``term``: the ``top`` terms that the group holds above the language's
    own frequency. Frequencies are parts of 10**9 in whole numbers, so results are exact. Nulls count as empty texts;
    ties go by the item's bytes; repeated rows are documents of their own; a language without kept terms has pairs of value 0.
    Other columns aren't read. An empty table gives no rows.

    A worker sums up its documents before anything is shuffled. Pairs are the result: sources are dealt into tiles of about TILE, a
    task has a pair of tiles and BLOCK words of terms, and never a language or a source as a whole.
    """
    docs = df.select(F.coalesce(F.col(lang).cast("string"), F.lit("")).alias("lang"), F.coalesce(F.col(source).cast("string"), F.lit("")).alias("source"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    counts = saved(term_counts(docs))
    terms = counts.groupBy("lang", "term").agg(F.sum("df").alias("df"), F.sum("n").alias("term_n")).where(F.col("df") >= min_docs)
    numbered = saved(running(terms.select("lang", "term", "term_n", (-F.col("term_n")).alias("rare")), ["lang", "rare", "term"], place=F.lit(1)).drop("rare"))
    cells = saved(counts.select("lang", "source", "term", "n").join(numbered, ["lang", "term"]))

    levels = cells.groupBy("lang", "source", "n").agg(F.count("*").alias("terms"))
    held = levels.groupBy("lang", "source").agg(F.sum(F.col("n") * F.col("terms")).alias("total"), F.sum("terms").alias("rows"), F.collect_list(F.struct("n", "terms")).alias("levels"))
    vocabulary = numbered.groupBy("lang").agg(F.count("*").alias("kept"), F.sum("term_n").alias("lang_total"))
    every = saved(docs.select("lang", "source").distinct())
    langs = every.groupBy("lang").agg(F.count("*").alias("sources")).join(vocabulary, "lang", "left").na.fill(0, ["kept", "lang_total"])
    groups = hot_join(every, saved(langs), ["lang"], "sources", every.count()).join(held, ["lang", "source"], "left").na.fill(0, ["total", "rows"])
    tiles = F.ceil(F.col("sources") / TILE).cast("int")
    groups = saved(groups.withColumn("tiles", tiles).withColumn("tile", F.pmod(F.xxhash64("source"), "tiles").cast("int")).withColumn("levels", F.coalesce("levels", F.array().cast("array<struct<n:bigint,terms:bigint>>"))))

    per_group = groups.where("rows > 0").select("lang", "source", "total", "kept", "lang_total", "tiles", "tile", "rows")
    known = hot_join(cells, per_group, ["lang", "source"], "rows", per_group.agg(F.sum("rows")).first()[0] or 0)

    def paired(rows: DataFrame) -> DataFrame:
        """Each row to the pairs of tiles (ti <= tj) that its own tile is in."""
        other = F.explode(F.sequence(F.lit(0), F.col("tiles") - 1)).alias("x")
        return rows.select("*", other).withColumns({"ti": F.least("tile", "x"), "tj": F.greatest("tile", "x")}).drop("x", "tiles")

    word = F.shiftright("place", 6).alias("word")
    bits = known.groupBy("lang", "source", word, "n").agg(
        F.bit_or(F.call_function("shiftleft", F.lit(1).cast("long"), (F.col("place") % 64).cast("int"))).alias("bits"), *[F.first(c).alias(c) for c in ("total", "kept", "tile", "tiles")]
    )
    both = paired(bits).groupBy("lang", "ti", "tj", F.floor(F.col("word") / BLOCK).alias("block")).applyInPandas(joint_cells, PAIR)
    zero = paired(groups.select("lang", "source", "total", "kept", "tile", "tiles", "levels")).groupBy("lang", "ti", "tj").applyInPandas(zero_cells, PAIR)
    once = both.unionByName(zero).groupBy("lang", "a", "b").agg(F.sum("part").alias("value"))
    ends = F.explode(F.array(F.struct(F.col("a").alias("source"), F.col("b").alias("item")), F.struct(F.col("b").alias("source"), F.col("a").alias("item")))).alias("e")
    pairs = once.select("lang", ends, "value").select("lang", "e.source", F.lit("pair").alias("part"), "e.item", "value")

    over = known.select("lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"), (_share("n", "total", "kept") - _share("term_n", "lang_total", "kept")).alias("value")).where("value > 0")
    order = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    ranked = pairs.withColumn("rank", F.row_number().over(order)).unionByName(over.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top))
    return ranked.select("lang", "source", "part", "item", "value", "rank")


AUDIT_SQL = r"""
WITH d AS (SELECT row_number() OVER () AS id, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
    regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS ws FROM documents),
w AS (SELECT id, lang, source, unnest(ws) AS term FROM d),
k AS (SELECT lang, term, count(*) AS term_n FROM w GROUP BY lang, term HAVING count(DISTINCT id) >= 30),
l AS (SELECT lang, count(*) AS v, sum(term_n)::BIGINT AS lang_total FROM k GROUP BY lang),
g AS (SELECT DISTINCT lang, source FROM d),
c AS (SELECT lang, source, term, count(*) AS n FROM w SEMI JOIN k USING (lang, term) GROUP BY ALL),
s AS (SELECT lang, source, sum(n)::BIGINT AS total FROM c GROUP BY lang, source),
f AS MATERIALIZED (SELECT g.lang, g.source, k.term, coalesce(c.n, 0) AS n,
    1 + (1000000000::HUGEINT * (coalesce(c.n, 0) + 5)) // (coalesce(s.total, 0) + 5 * l.v) AS p, 1 + (1000000000::HUGEINT * (k.term_n + 5)) // (l.lang_total + 5 * l.v) AS q
    FROM g JOIN k USING (lang) JOIN l USING (lang) LEFT JOIN s USING (lang, source) LEFT JOIN c USING (lang, source, term)),
x AS (SELECT a.lang, a.source, b.source AS item, sum(abs(a.p - b.p)) AS value FROM f a JOIN f b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
r AS (SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(x.value, 0)::BIGINT AS value FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source LEFT JOIN x ON x.lang = a.lang AND x.source = a.source AND x.item = b.source
  UNION ALL SELECT lang, source, 'term', term, (p - q)::BIGINT FROM f WHERE n > 0 AND p > q)
SELECT lang, source, part, item, value, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item)::INTEGER AS rank FROM r
QUALIFY part = 'pair' OR row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) <= 50
"""
