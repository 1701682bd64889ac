"""Approximate nearest neighbours with a permutation index: pivots in order of nearness stand for a vector."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F

from locusmill.llm.common import saved

#: Pivots of a shard (a bounded sample of its vectors) and how many of the nearest stand for a vector.
PIVOTS, PREFIX = 256, 64
#: Share of the vectors, by footrule distance, that are ranked again by the exact measure, at SHARE_AT vectors; it falls as the
#: cube root of their number, since the nearest come nearer. At least LEAST of a shard are ranked again.
SHARE, SHARE_AT, LEAST = 0.25, 2_000, 64
#: Vectors of a shard and queries of a block at most, about.
SHARD_ROWS, QUERY_ROWS = 8_192, 16_384


def usable(df: DataFrame, key: str, vector: str) -> DataFrame:
    """(id, v, n): the vectors that take part and their length, a row for each row.

    Null vectors and keys, null or non-finite components and zero vectors take no part.
    """
    v = F.col(vector).cast("array<double>")
    fine = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("v", lambda x: x != 0)
    rows = df.select(F.col(key).cast("long").alias("id"), v.alias("v")).where(F.col("id").isNotNull() & F.col("v").isNotNull() & fine)
    return rows.withColumn("n", F.size("v"))


def share_of(total: int) -> float:
    """Which share of ``total`` vectors is ranked again."""
    return SHARE * min(1.0, (SHARE_AT / max(1, total)) ** (1 / 3))


def lift(rows: np.ndarray, top: float) -> np.ndarray:
    """One more component, so that all have length ``top`` and the nearest is the one of largest inner product."""
    return np.column_stack([rows, np.sqrt(np.maximum(0, top * top - (rows * rows).sum(axis=1)))])


def orders(rows: np.ndarray, pivots: np.ndarray, prefix: int) -> np.ndarray:
    """The nearest pivots of each row (by angle), nearest first."""
    near = rows @ pivots.T
    best = np.argpartition(-near, prefix - 1, axis=1)[:, :prefix] if prefix < near.shape[1] else np.tile(np.arange(near.shape[1]), (len(near), 1))
    return np.take_along_axis(best, np.argsort(-np.take_along_axis(near, best, 1), axis=1, kind="stable"), 1)


class PivotFile:
    """The vectors of a shard, posted under each pivot of their prefix with its place there."""

    def __init__(self, perms: np.ndarray, pivots: int) -> None:
        self.n, self.prefix = perms.shape
        flat = perms.ravel()
        order = np.argsort(flat, kind="stable")
        self.rows, self.at = np.divmod(order, self.prefix)
        self.begin = np.searchsorted(flat[order], np.arange(pivots + 1))

    def gains(self, perm: np.ndarray) -> np.ndarray:
        """For each vector, how far its footrule distance to ``perm`` is below the largest (a pivot not in the prefix is at its end)."""
        gain = np.zeros(self.n, np.int32)
        for place, p in enumerate(perm):
            own = slice(self.begin[p], self.begin[p + 1])
            gain[self.rows[own]] += self.prefix - np.maximum(self.at[own], place).astype(np.int32)
        return gain


def drawn(v: np.ndarray) -> np.ndarray:
    """PIVOTS of the shard's different vectors at most, evenly from their order."""
    own = np.unique(v, axis=0)
    return own[np.unique(np.linspace(0, len(own) - 1, PIVOTS).astype(int))]


def search(df: DataFrame, is_query: Column, key: str = "vec_id", vector: str = "embedding", k: int = 20, share: float | None = None) -> DataFrame:
    """(query_id, rank, vec_id, score): the ``k`` largest inner products found for each query, ties to the smaller key.

    Every row but the query's own is a candidate, other rows of its key too, if its vector is as long; ``is_query`` is a condition
    on the column ``id``. Vectors are dealt out into shards, each with its own pivots and pivot files, and every query goes to every
    shard. There the files give footrule distances, the nearest ``share`` (``share_of`` the number of vectors; with all that tie
    with the last of it) are measured exactly on the original vectors in double precision, and the best ``k`` of all shards
    are merged. Each query row has an answer of its own, also if its key repeats. See ``usable`` for what takes no part. An empty
    table, or one without queries, gives no rows.
    """
    rows = saved(usable(df, key, vector).withColumn("row", F.monotonically_increasing_id()))
    total, n_asked = rows.agg(F.count("*"), F.count_if(is_query)).first()
    part = share_of(total) if share is None else share
    n_shards, n_blocks = -(-total // SHARD_ROWS) or 1, -(-n_asked // QUERY_ROWS) or 1

    h = F.xxhash64("row")
    own = rows.withColumns({"shard": F.pmod(h, F.lit(n_shards)).cast("long"), "block": F.explode(F.sequence(F.lit(0), F.lit(n_blocks - 1)))})
    asked = rows.where(is_query).withColumns({"shard": F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n_shards - 1).cast("long"))), "block": F.pmod(h, F.lit(n_blocks)).cast("int")})

    def find(held: pd.DataFrame, queries: pd.DataFrame) -> pd.DataFrame:
        names = ("query_id", "query_row", "vec_id", "score")
        if not len(held) or not len(queries):
            return pd.DataFrame({c: [] for c in names})
        ids, at, v = held.id.to_numpy(), held["row"].to_numpy(), np.stack(held.v.to_numpy())
        top = np.sqrt((v * v).sum(axis=1).max())
        pivots = lift(drawn(v), top)
        prefix = min(PREFIX, len(pivots))
        files = PivotFile(orders(lift(v, top), pivots, prefix), len(pivots))
        q = np.stack(queries.v.to_numpy())
        perms = orders(np.column_stack([q, np.zeros(len(q))]), pivots, prefix)
        n = min(len(ids), max(LEAST, int(np.ceil(part * len(ids)))))
        found = []
        for qid, row, x, perm in zip(queries.id.tolist(), queries["row"].tolist(), q, perms, strict=True):
            gain = files.gains(perm)
            near = np.flatnonzero(gain >= np.partition(gain, len(gain) - n)[len(gain) - n])
            near = near[at[near] != row]
            score = (v[near] * x).sum(axis=1)
            best = np.lexsort((ids[near], -score))[:k]
            found.append((np.full(len(best), qid), np.full(len(best), row), ids[near[best]], score[best]))
        return pd.DataFrame({c: np.concatenate([f[i] for f in found]) for i, c in enumerate(names)})

    keys = ["n", "shard", "block"]
    pairs = own.groupBy(*keys).cogroup(asked.groupBy(*keys)).applyInPandas(find, "query_id bigint, query_row bigint, vec_id bigint, score double")
    rank = F.row_number().over(Window.partitionBy("query_row").orderBy(F.desc("score"), "vec_id"))
    return pairs.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
