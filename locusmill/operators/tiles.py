"""Products of all pairs of rows of a long matrix, tile by tile."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from locusmill.operators.rows import numbered, settled
from locusmill.operators.sums import tree_sum

#: Rows of a tile and about as many columns of a block; numbered rows that are sent to all executors at most.
TILE, BLOCK, MAX_SENT = 256, 4096, 200_000


def row_products(cells: DataFrame, row: str, column: str, value: str, by: list[str] | None = None) -> DataFrame:
    """(by..., a, b, s): sum of the products of rows a <= b over the columns, for all pairs of rows of each group ``by``.

    Rows are numbered in their group and cut into tiles. A cell goes to each pair of tiles that its row's tile is in, not to each pair of rows;
    a task multiplies two tiles over a block of its group's columns, and blocks are summed as a tree. A missing cell counts as 0, cells of one
    place add up, null values and null rows don't count. Any number of rows and columns: a task holds 2 * TILE * BLOCK numbers or so.
    A group has as many blocks as its own columns need, and no tile is larger than the largest group.
    """
    by = by or []
    cells = cells.where(F.col(row).isNotNull() & F.col(value).isNotNull()).select(*by, row, F.col(column).alias("__c"), F.col(value).cast("double").alias("__z"))
    rows = settled(numbered(cells.select(*by, row).distinct(), [*by, row], "__n"))
    ends = rows.groupBy(*by).agg(F.min("__n").alias("__from"), F.count("*").alias("__size"))
    wide = cells.groupBy(*by).agg(F.greatest(F.lit(1), F.ceil(F.approx_count_distinct("__c") / BLOCK)).alias("__blocks"))
    ends = settled(ends.join(wide, by) if by else ends.crossJoin(wide))  # a row a group
    n_rows, largest = ends.agg(F.sum("__size"), F.max("__size")).first()
    tile = max(1, min(TILE, largest or 0))
    sent = F.broadcast if (n_rows or 0) <= MAX_SENT else lambda df: df
    placed = rows.join(F.broadcast(ends), by) if by else rows.crossJoin(F.broadcast(ends))
    placed = placed.withColumn("__n", (F.col("__n") - F.col("__from")).cast("int")).drop("__from")
    known = cells.join(sent(placed), [*by, row]).withColumns({"__t": F.floor(F.col("__n") / tile).cast("int"), "__block": F.pmod(F.xxhash64("__c"), F.col("__blocks")).cast("int")})
    dealt = known.select(*by, "__n", "__c", "__z", "__t", "__block", F.explode(F.sequence(F.lit(0), F.floor((F.col("__size") - 1) / tile).cast("int"))).alias("__x"))
    dealt = dealt.withColumns({"__i": F.least("__t", "__x"), "__j": F.greatest("__t", "__x")}).drop("__x", "__t")
    names = [*by, "__i", "__j", "__block"]
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in dealt.select(*names).schema)

    def multiplied(key: tuple, own: pd.DataFrame) -> pd.DataFrame:
        columns, at = np.unique(own["__c"].to_numpy(), return_inverse=True)
        n = own["__n"].to_numpy()
        x = np.zeros((2, tile, len(columns)))
        for side, t in enumerate(key[len(by) : len(by) + 2]):
            mine = n // tile == t
            np.add.at(x[side], (n[mine] - t * tile, at[mine]), own["__z"].to_numpy()[mine])
        return pd.DataFrame([[*key, (x[0] @ x[1].T).ravel()]], columns=[*names, "s"])

    partial = dealt.groupBy(*names).applyInPandas(multiplied, f"{kinds}, s array<double>")
    sums = tree_sum(partial, [*by, "__i", "__j"], part="__block").select(*by, "__i", "__j", F.posexplode("s").alias("__at", "s"))
    sums = sums.select(*by, (F.col("__i") * tile + F.floor(F.col("__at") / tile)).alias("__a"), (F.col("__j") * tile + F.col("__at") % tile).alias("__b"), "s").where("__a <= __b")
    left, right = (placed.select(*by, F.col("__n").alias(n), F.col(row).alias(m)) for n, m in (("__a", "a"), ("__b", "b")))
    return sums.join(sent(left), [*by, "__a"]).join(sent(right), [*by, "__b"]).select(*by, "a", "b", "s")
