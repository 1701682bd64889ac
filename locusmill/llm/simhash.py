"""SimHash near-dedup: fingerprints, a vantage-point tree over Hamming distance, components."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from locusmill.llm.common import hot_join, saved, text_batches
from locusmill.llm.graph import components
from locusmill.llm.line_dedup import slices
from locusmill.llm.shingles import stretches, words_of

#: Distinct fingerprints that the tree is built on at most; rows of a leaf aimed at; pairs that one task compares at most.
SAMPLE, LEAF_ROWS, TASK_PAIRS = 32_768, 8_192, 4_000_000_000
#: Pairs compared at once.
BLOCK = 2_000_000
#: Sections of a text for ``near_dedup``: words, of how many consecutive ones one is chosen, and how many of the chosen ones (the least) stand for it.
SECTION_WORDS, SECTION_PLACES, SECTIONS = 8, 12, 16
#: Orders of fingerprints, of which a section takes one to choose the text that stands for it.
ORDERS = 4
#: Bits by which the fingerprints of texts that share a section may differ to be compared word by word; pairs that a copy of a text meets.
LIKE_BITS, COPY_PAIRS = 20, 200


def fingerprint(text: str | None, width: int) -> int:
    """The 64 majority bits over the XXH64 (seed 42) of a text's word shingles, repeats included; 0 without words."""
    import xxhash

    words = (text or "").encode().lower().split()  # bytes: only A-Z and the six ASCII blanks
    if not words:
        return 0
    one, join = xxhash.xxh64_intdigest, b" ".join
    hashes = [one(join(words[i : i + width]), 42) for i in range(max(1, len(words) - width + 1))]
    counts = np.zeros(64, np.int64)
    for at in range(0, len(hashes), 65_536):
        part = np.array(hashes[at : at + 65_536], np.uint64)
        counts += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * counts > len(hashes), bitorder="little").view(np.uint64)[0])


def fingerprints(df: DataFrame, key: str = "doc_id", text: str = "text", width: int = 3, sections: bool = False) -> DataFrame:
    """(key, th, fp), and sections if wanted: th is the text's hash, fp a signed long with the fingerprint's bits.

    Null and blank texts have fp 0. ``sections`` are names of word stretches that texts with equal passages share.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            texts = [t or "" for t in batch.pop("text").tolist()]
            batch["fp"] = np.array([fingerprint(t, width) for t in texts], np.uint64).view(np.int64)
            if sections:
                batch["sections"] = [x for a, b in slices(texts) for x in sections_of(texts[a:b])]
            yield batch

    kind = df.select(key).schema[0].dataType.simpleString()
    body = df.select(F.col(key).alias("key"), F.xxhash64(text).alias("th"), F.col(text).alias("text"))
    return text_batches(body).mapInPandas(run, f"key {kind}, th bigint, fp bigint" + ", sections array<bigint>" * sections)


def sections_of(texts: list[str]) -> list[np.ndarray]:
    """The SECTIONS least names of each text's chosen stretches."""
    words = words_of(texts)
    at, name, _ = stretches(words, SECTION_WORDS, SECTION_PLACES)
    text = words.text[at]
    edge = np.searchsorted(text, np.arange(len(texts) + 1))
    return [np.unique(name[a:b])[:SECTIONS].view(np.int64) for a, b in zip(edge, edge[1:], strict=False)]


class VantageTree:
    """A binary tree: each node has a vantage point and a radius; what lies within goes left.

    Two points within ``reach`` of each other have distances to a vantage point that differ by ``reach`` at most
    (triangle inequality), so a query enters both branches only if its own distance is that near the radius.
    """

    def __init__(self, sample: np.ndarray, depth: int) -> None:
        self.depth = depth
        self.point = np.zeros(1 << depth, np.uint64)
        self.radius = np.full(1 << depth, 64, np.int64)
        self._build(sample, 1, 0)

    def _build(self, own: np.ndarray, node: int, level: int) -> None:
        if level == self.depth or len(own) < 2:
            return
        self.point[node] = own[len(own) // 2]
        far = np.bitwise_count(own ^ self.point[node]).astype(np.int64)
        self.radius[node] = np.sort(far)[(len(own) - 1) // 2]
        self._build(own[far <= self.radius[node]], 2 * node, level + 1)
        self._build(own[far > self.radius[node]], 2 * node + 1, level + 1)

    def route(self, points: np.ndarray, reach: int) -> tuple[np.ndarray, np.ndarray]:
        """(index of the point, leaf) for all leaves that may hold a point within ``reach``; its own leaf for 0."""
        at, node = np.arange(len(points)), np.ones(len(points), np.int64)
        for _ in range(self.depth):
            far = np.bitwise_count(points[at] ^ self.point[node]).astype(np.int64)
            left, right = far - reach <= self.radius[node], far + reach > self.radius[node]
            at = np.concatenate([at[left], at[right]])
            node = np.concatenate([2 * node[left], 2 * node[right] + 1])
        return at, node


def near_pairs(home: np.ndarray, guest: np.ndarray, reach: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Index pairs (home, guest) within ``reach``, by further vantage points until a block is small."""
    todo = [(np.arange(len(home)), np.arange(len(guest)), 0)]
    while todo:
        h, g, level = todo.pop()
        if not len(h) or not len(g):
            continue
        if len(h) * len(g) > BLOCK and len(h) > 64 and level < 24:
            point = home[h[(level * 7919) % len(h)]]
            dh = np.bitwise_count(home[h] ^ point).astype(np.int64)
            dg = np.bitwise_count(guest[g] ^ point).astype(np.int64)
            radius = int(np.sort(dh)[(len(h) - 1) // 2])
            if (dh > radius).any():
                todo.append((h[dh <= radius], g[dg - reach <= radius], level + 1))
                todo.append((h[dh > radius], g[dg + reach > radius], level + 1))
                continue
        rows = max(1, BLOCK // len(g))
        for i in range(0, len(h), rows):
            part = h[i : i + rows]
            for j in range(0, len(g), BLOCK):
                other = g[j : j + BLOCK]
                a, b = np.nonzero(np.bitwise_count(home[part][:, None] ^ guest[other][None, :]) <= reach)
                yield part[a], other[b]


def join_roots(parent: np.ndarray, a: np.ndarray, b: np.ndarray) -> None:
    """Unites the ends of the edges in ``parent`` (each node's root, the smallest of its set)."""
    while len(a):
        pa, pb = parent[a], parent[b]
        keep = pa != pb
        a, b, pa, pb = a[keep], b[keep], pa[keep], pb[keep]
        np.minimum.at(parent, np.maximum(pa, pb), np.minimum(pa, pb))
        while (up := parent[parent]).tobytes() != parent.tobytes():
            parent[:] = up


#: Roles of a row in a task: it is only met, only meets, or both.
GUEST, HOME, BOTH = 0, 1, 2


def leaf_edges(leaf: pd.DataFrame, reach: int) -> pd.DataFrame:
    """A spanning forest of the near pairs in one task: at most an edge for each row."""
    points = leaf.fp.to_numpy().view(np.uint64)
    role = leaf.role.to_numpy()
    values, at = np.unique(points, return_inverse=True)
    parent = np.arange(len(values))
    home, guest = np.flatnonzero(role != GUEST), np.flatnonzero(role != HOME)
    for h, g in near_pairs(points[home], points[guest], reach):
        join_roots(parent, at[home[h]], at[guest[g]])
    moved = np.flatnonzero(parent != np.arange(len(values)))
    return pd.DataFrame({"a": values[moved].view(np.int64), "b": values[parent[moved]].view(np.int64)})


def dealt(points: DataFrame, reach: int) -> DataFrame:
    """(leaf, i, j, fp, role): the distinct ``points(fp)`` in the tasks that compare them, by a sharded vantage-point tree.

    The tree is built on a bounded sample (SAMPLE, lowest hashes) and has about a leaf for LEAF_ROWS points; every
    point is put in its own leaf and sent as a guest to the leaves whose bounds it is near. A leaf of more than TASK_PAIRS
    pairs is dealt out as a grid: home rows in parts i, all its rows as guests in parts j, so that each pair meets in one task.
    """
    spark = points.sparkSession
    total = points.count()
    depth = max(0, min(int(np.ceil(np.log2(max(1, total) / LEAF_ROWS))), int(np.log2(SAMPLE)) - 4))
    drawn = points.orderBy(F.xxhash64("fp"), "fp").limit(SAMPLE).toPandas() if depth else pd.DataFrame({"fp": np.zeros(0, np.int64)})
    tree = spark.sparkContext.broadcast(VantageTree(drawn.fp.to_numpy().astype(np.int64).view(np.uint64), depth))

    def sent(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            fp = batch.fp.to_numpy()
            at, leaf = tree.value.route(fp.view(np.uint64), reach)
            _, own = (lambda x: (x[0], x[1][np.argsort(x[0])]))(tree.value.route(fp.view(np.uint64), 0))
            yield pd.DataFrame({"leaf": leaf, "fp": fp[at], "home": leaf == own[at]})

    routed = points.select("fp").mapInPandas(sent, "leaf bigint, fp bigint, home boolean")
    # one row a leaf, of which there are SAMPLE / 16 at most
    sizes = routed.groupBy("leaf").agg(F.count("*").alias("n"), F.count_if("home").alias("h"))
    cells = F.ceil(F.col("n") * F.col("h") / F.lit(TASK_PAIRS))
    rows = F.greatest(F.lit(1), F.least(cells, F.ceil(F.sqrt(cells * F.col("h") / F.col("n"))))).cast("int")
    grid = sizes.withColumn("rows", rows).select("leaf", "rows", F.greatest(F.lit(1), F.ceil(cells / F.col("rows"))).cast("int").alias("cols"))
    one = (F.col("rows") == 1) & (F.col("cols") == 1)
    part = lambda n: F.pmod(F.xxhash64("fp"), n).cast("int")
    count = lambda n: F.sequence(F.lit(0), F.col(n) - 1)
    place = lambda i, j, role: F.struct(i.alias("i"), j.alias("j"), F.lit(role).alias("role"))
    split = F.concat(
        F.when(F.col("home"), F.transform(count("cols"), lambda j: place(part(F.col("rows")), j, HOME))).otherwise(F.array().cast("array<struct<i:int,j:int,role:int>>")),
        F.transform(count("rows"), lambda i: place(i, part(F.col("cols")), GUEST)),
    )
    whole = F.array(F.struct(F.lit(0).alias("i"), F.lit(0).alias("j"), F.when(F.col("home"), BOTH).otherwise(GUEST).alias("role")))
    return routed.join(F.broadcast(grid), "leaf").select("leaf", "fp", F.explode(F.when(one, whole).otherwise(split)).alias("x")).select("leaf", "x.i", "x.j", "fp", "x.role")


def near_edges(points: DataFrame, reach: int = 2) -> DataFrame:
    """Edges (a, b) that connect all of the distinct ``points(fp)`` within ``reach`` bits.

    Pairs are exact; only the forest that a task needs comes out, never all pairs of a group.
    """
    return dealt(points, reach).groupBy("leaf", "i", "j").applyInPandas(lambda leaf: leaf_edges(leaf, reach), "a bigint, b bigint")


def _points(rows: DataFrame) -> DataFrame:
    """(fp, best, n): each fingerprint's row of smallest key (null keys last, ties by the text's hash) and its number of rows."""
    return rows.groupBy("fp").agg(F.min(F.struct(F.isnull("key").alias("none"), "key", "th")).alias("best"), F.count("*").alias("n"))


def _grouped(points: DataFrame, edges: DataFrame) -> DataFrame:
    """(fp, n, best): the best row of all that links reach from each fingerprint."""
    roots = saved(components(edges))
    linked = roots.join(points, roots.node == points.fp).select("node", "root", "best")
    of_root = linked.groupBy("root").agg(F.min("best").alias("all"), F.count("*").alias("n"))
    of_point = hot_join(linked, of_root, ["root"], "n", roots.count()).select(F.col("node").alias("fp"), "all")
    return points.join(of_point, "fp", "left").select("fp", "n", F.coalesce("all", "best").alias("best"))


def near_groups(df: DataFrame, key: str = "doc_id", text: str = "text", width: int = 3, reach: int = 2) -> DataFrame:
    """(key, fp, component_id): each row's fingerprint and the smallest key that chains of links reach, itself included.

    Null and blank texts share fingerprint 0 and link like any other. Repeated rows come out as often as they go in.
    Null keys take part but are never a component_id, which is null only if all of its keys are. Only ``key`` and
    ``text`` are read, so other columns can't clash. An empty table gives an empty one.
    """
    rows = saved(fingerprints(df, key, text, width))
    points = saved(_points(rows))
    named = saved(_grouped(points, near_edges(points, reach)).select("fp", "n", F.col("best.key").alias("component_id")))
    return hot_join(rows, named, ["fp"], "n", rows.count()).select(F.col("key").alias(key), "fp", "component_id")


def shingle_set(text: str | None, width: int) -> frozenset:
    words = (text or "").encode().lower().split()
    return frozenset(zip(*[words[i:] for i in range(width)], strict=False)) if len(words) >= width else frozenset([tuple(words)])


def like_edges(docs: DataFrame, rows: DataFrame, points: DataFrame, width: int, similarity: float) -> DataFrame:
    """Edges (a, b) between fingerprints of texts that share a section and ``similarity`` of their ``width``-word shingles (Jaccard).

    Of the texts that share a section one stands for it and meets the others, so a section that very many texts hold makes a
    pair for each text and never all pairs. Which one hangs on the section too (ORDERS ways), so that texts that share several
    sections meet several others. Pairs more than LIKE_BITS apart are left out, all others
    are settled on the whole texts. A head that meets many texts is copied, for COPY_PAIRS of them each.
    """
    total = rows.count()
    parts = rows.select("fp", F.explode("sections").alias("s"))
    head = F.min_by("fp", F.xxhash64("fp", F.pmod("s", F.lit(ORDERS))))
    heads = parts.groupBy("s").agg(head.alias("head"), F.min("fp").alias("a"), F.max("fp").alias("b"), F.count("*").alias("many")).where("a <> b").select("s", "head", "many")
    met = hot_join(parts, heads, ["s"], "many", total * SECTIONS).where("head <> fp")
    pairs = saved(met.where(F.bit_count(F.col("fp").bitwiseXOR(F.col("head"))) <= LIKE_BITS).select("fp", "head").distinct())
    n_pairs = pairs.count()
    copies = saved(pairs.groupBy("head").agg(F.count("*").alias("met")))
    salted = hot_join(pairs, copies, ["head"], "met", n_pairs).select("fp", "head", F.pmod(F.xxhash64("fp"), F.ceil(F.col("met") / COPY_PAIRS)).alias("copy"))
    ends = pairs.select("fp").union(copies.select("head")).distinct().join(points, "fp").select("fp", "n", F.col("best.key").alias("own"), F.col("best.th").alias("th"))
    texts = hot_join(docs.select("key", F.xxhash64("text").alias("th"), "text"), ends, ["th"], "n", total)
    texts = saved(texts.where(F.col("fp").isNotNull() & F.col("key").eqNullSafe(F.col("own"))).groupBy("fp").agg(F.first("text").alias("text")))
    of_head = texts.join(copies, texts.fp == copies["head"]).select("head", F.explode(F.sequence(F.lit(0).cast("long"), F.ceil(F.col("met") / COPY_PAIRS) - 1)).alias("copy"), F.col("text").alias("head_text"))

    def like(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        last, own = None, frozenset()
        for batch in batches:
            keep = []
            for head, b, a in zip(batch["head"].tolist(), batch.head_text.tolist(), batch.text.tolist(), strict=True):
                if head != last:
                    last, own = head, shingle_set(b, width)
                other = shingle_set(a, width)
                both = len(own & other)
                keep.append(both >= similarity * (len(own) + len(other) - both))
            yield batch[keep][["fp", "head"]].rename(columns={"fp": "a", "head": "b"})

    return text_batches(salted.join(texts, "fp").join(of_head, ["head", "copy"]).select("fp", "head", "text", "head_text")).mapInPandas(like, "a bigint, b bigint")


def near_dedup(df: DataFrame, key: str = "doc_id", text: str = "text", width: int = 5, reach: int = 2, similarity: float = 0.8) -> DataFrame:
    """``df`` with one document of each group: the one of smallest key, with all its rows; null keys come last.

    Texts link if their fingerprints are within ``reach`` bits, found by the tree, or if their shingles of ``width`` words are alike
    (Jaccard of ``similarity`` or more). A tree can't prune as far as like texts' fingerprints lie apart, so these are looked for
    among texts that share a section: of SECTION_PLACES consecutive stretches of SECTION_WORDS words one is chosen, and the
    SECTIONS least stand for a text. Like texts miss each other only if every such stretch was edited. Rows of one key and
    different texts are told apart by the text's hash. Null and blank texts are one group. No rows, no result.
    """
    rows = saved(fingerprints(df, key, text, width, sections=True))
    points = saved(_points(rows))
    docs = df.select(F.col(key).alias("key"), F.col(text).alias("text"))
    links = saved(near_edges(points, reach)).union(saved(like_edges(docs, rows, points, width, similarity)))
    kept = _grouped(points, links).select(F.col("best.key").alias("__kept"), F.col("best.th").alias("__th")).distinct()
    return df.join(kept, df[key].eqNullSafe(kept["__kept"]) & (F.xxhash64(df[text]) == kept["__th"]), "left_semi")
