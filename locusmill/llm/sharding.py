"""Sharding by a Hilbert curve over quantised metadata, with row counts at most one apart."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from locusmill.llm.common import dropped, hot_join, running, saved


def hilbert_index(cells: np.ndarray, bits: int) -> np.ndarray:
    """Place on the Hilbert curve of each cell; ``cells`` is (dimensions, n) with values below 2**bits.

    From the highest bit down, Gray-code the coordinates and undo the curve's turns; then weave the bits.
    """
    x = cells.astype(np.int64).copy()
    dims = len(x)
    bit = 1 << (bits - 1)
    while bit > 1:
        low = bit - 1
        for d in range(dims):
            set_ = (x[d] & bit) != 0
            swap = np.where(set_, 0, (x[0] ^ x[d]) & low)
            x[0] = np.where(set_, x[0] ^ low, x[0] ^ swap)
            if d:
                x[d] ^= swap
        bit >>= 1
    for d in range(1, dims):
        x[d] ^= x[d - 1]
    turn = np.zeros_like(x[0])
    bit = 1 << (bits - 1)
    while bit > 1:
        turn ^= np.where((x[-1] & bit) != 0, bit - 1, 0)
        bit >>= 1
    x ^= turn
    out = np.zeros_like(x[0])
    for b in range(bits - 1, -1, -1):
        for d in range(dims):
            out = (out << 1) | ((x[d] >> b) & 1)
    return out


def quantile_cells(rows: DataFrame, col: str, bits: int, total: int) -> DataFrame:
    """(col, n, cell) of each distinct value: how many rows have it, and in which of 2**bits quantiles it begins in the values' order."""
    counts = rows.groupBy(col).agg(F.count("*").alias("n"))
    return running(counts, [col], before=F.col("n")).select(col, "n", F.expr(f"before * {2**bits} div {max(total, 1)}").alias(f"{col}_cell"))


def homes(cut: list[int], held: list[int], groups: list[tuple[int, int, int]]) -> list[int | None]:
    """The shard for each group (first place, last place, rows) that lies across a cut: the nearest one with room for all of it.

    ``held`` are the rows that the shards' other groups take up; it grows by what is placed. None: no shard has room.
    """
    shards, out = len(held), []
    of = lambda place: int(np.searchsorted(cut, place, side="right")) - 1
    for first, last, n in groups:
        middle = of((first + last) // 2)
        near = sorted(range(shards), key=lambda s: (abs(s - middle), s))
        to = next((s for s in near if held[s] + n <= cut[s + 1] - cut[s]), None)
        if to is not None:
            held[to] += n
        out.append(to)
    return out


def shard_by_curve(df: DataFrame, shards: int = 24, key: str = "doc_id", text: str = "text", dims: tuple[str, ...] = ("lang", "source"), bits: int = 5) -> DataFrame:
    """One row for each row: key, size, text_crc32, law, shard, slot, grown_shard, curve.

    The dimensions are ``dims`` (whole values, in their order) and the text's size, each cut at quantiles of the whole table into
    2**bits cells. Groups of equal texts take the metadata of one of their rows. Rows go in order of the cell's place on the
    curve, and runs are cut after equal numbers of rows (law ``rows``: counts differ by one at most). A group across a cut
    goes as a whole to the nearest shard with room for it, and rows without copies move over the cuts to make the
    counts right; only a group that is larger than a shard, or for which no shard has room, is cut. Within a shard the
    groups come first. Null texts count as empty, null metadata and keys come first, ties are broken by the text's hash and the key;
    equal rows are interchangeable. An empty table gives no rows. The text itself is hashed where it is read and never shuffled.
    """
    if bits * (len(dims) + 1) > 18:
        raise ValueError("the curve has at most 2**18 cells: take fewer bits")
    body = F.coalesce(F.col(text), F.lit(""))
    names, same = [f"d{i}" for i in range(len(dims))], ["h", "crc", "size"]
    lite = saved(df.select(
        F.col(key).alias("key"),
        (F.octet_length(body) + 8).cast("long").alias("size"),
        F.crc32(body).alias("crc"),
        F.xxhash64(body).alias("h"),
        F.struct(*[F.coalesce(F.concat(F.lit("="), F.col(c).cast("string")), F.lit("")).alias(n) for c, n in zip(dims, names, strict=True)]).alias("meta"),
    ))
    total = lite.count()
    copies = lite.groupBy(*same).agg(F.min("meta").alias("own"), F.count("*").alias("copies")).where("copies > 1")
    rows = hot_join(lite, copies, same, "copies", total).select("key", *same, F.coalesce("copies", F.lit(1)).alias("copies"), F.coalesce("own", "meta").alias("meta"))
    rows = saved(rows.select("key", *same, "copies", *[F.col(f"meta.{n}").alias(n) for n in names]))  # each join reads it twice
    for n in names:
        cells, before = saved(quantile_cells(rows, n, bits, total)), rows
        rows = saved(hot_join(before, cells, [n], "n", total).drop(n, "n"))
        dropped(before)
        dropped(cells)
    steps = lite.agg(F.percentile_approx("size", [i / 2**bits for i in range(1, 2**bits)], 10_000)).first()[0] or []
    size_cell = F.size(F.filter(F.array([F.lit(x) for x in steps]).cast("array<bigint>"), lambda x: x < F.col("size")))
    cell = sum((F.col(f"{n}_cell") * (1 << (bits * i)) for i, n in enumerate(names)), size_cell.cast("long") * (1 << (bits * len(names))))
    grid = np.arange(1 << (bits * (len(names) + 1)))
    index = hilbert_index(np.stack([(grid >> (bits * i)) & ((1 << bits) - 1) for i in range(len(names) + 1)]), bits)
    lookup = df.sparkSession.createDataFrame(pd.DataFrame({"cell": grid, "curve": index}))  # 2**18 rows at most
    on_curve = rows.withColumn("cell", cell).join(F.broadcast(lookup), "cell").select("key", *same, "copies", "curve")

    one = (F.col("copies") == 1).cast("long")
    placed = running(on_curve, ["curve", "h", "crc", "size", "key"], place=F.lit(1), singles=one)
    placed = saved(placed.withColumn("shard", F.expr(f"place * {shards} div {max(total, 1)}").cast("int")))
    cut = [-(-s * total // shards) for s in range(shards + 1)]
    span = placed.where("copies > 1").groupBy(*same).agg(F.min("place").alias("first"), F.max("place").alias("last"), F.min("shard").alias("a"), F.max("shard").alias("b"), F.first("copies").alias("n"))
    across = span.where(f"a < b and n <= {total // shards}").orderBy(F.desc("n"), "first").collect()  # fewer than the shards
    held = [0] * shards
    for r in placed.where("copies > 1").groupBy("shard").count().collect():
        held[r["shard"]] = r["count"]
    for r in across:
        for s in range(r["a"], r["b"] + 1):
            held[s] -= min(r["last"] + 1, cut[s + 1]) - max(r["first"], cut[s])
    fixed, own = held[:], [(r["first"], r["last"], r["n"]) for r in across]
    to = homes(cut, held, own)
    for r, s in zip(own, to, strict=True):
        if s is None:  # stays where it is, cut
            for t in range(shards):
                part = max(0, min(r[1] + 1, cut[t + 1]) - max(r[0], cut[t]))
                fixed[t] += part
                held[t] += part
    moved, used = [], fixed[:]
    for r, s in zip(across, to, strict=True):
        if s is not None:
            moved.append((r["h"], r["crc"], r["size"], s, r["first"], r["n"], used[s]))
            used[s] += r["n"]
    room = np.cumsum([0] + [cut[s + 1] - cut[s] - held[s] for s in range(shards)]).tolist()  # rows without copies before each shard
    at = lambda values, i: F.element_at(F.array([F.lit(int(v)).cast("long") for v in values]), i + 1)
    home = df.sparkSession.createDataFrame(moved, "h long, crc long, size long, home int, first long, n long, base long")
    single = F.col("copies") == 1
    to_single = F.size(F.filter(F.array([F.lit(int(v)).cast("long") for v in room[1:-1]]), lambda v: v <= F.col("singles"))).cast("int")
    gone = sum((F.when(F.col("place") > m[4], m[5]).otherwise(0) for m in moved), F.lit(0))
    shard = F.when(single, to_single).otherwise(F.coalesce("home", "shard"))
    before_fixed = np.cumsum([0] + fixed).tolist()
    slot = (
        F.when(single, at(held, F.col("shard")) + F.col("singles") - at(room, F.col("shard")))
        .when(F.col("home").isNotNull(), F.col("base") + F.col("place") - F.col("first"))
        .otherwise(F.col("place") - F.col("singles") - gone - at(before_fixed, F.col("shard")))
    )
    return placed.join(F.broadcast(home), same, "left").withColumn("shard", shard).select(
        F.col("key").alias(key), "size", F.col("crc").alias("text_crc32"), F.lit("rows").alias("law"), "shard",
        slot.cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"), "curve",
    )
