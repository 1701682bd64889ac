"""Conversation prefix trie: adaptive radix trees over fixed-width big-endian turn ids, merged by node.

A turn's id is 16 bytes of a SHA-256 of role and text, read as a big-endian number of fixed width; a conversation is the
string of its turns' ids. Conversations are cut into segments of SEGMENT turns at most, each headed by the id of the node at which it
hangs, and dealt out in order of these strings, so neighbours share beginnings. A task puts its segments into radix trees
(nodes of 4, 16, 48 and 256 places, compressed paths) and tells one row for each turn-aligned depth, wherever in a path
it lies; depths inside an id are no nodes. Rows of one node from different tasks are summed.

A node is named by its depth and the XOR of two 64-bit hashes of (place, id) over its turns (128 bits), which running windows give
for all depths at once. Sums over subtrees need no walk level by level: they are sums over members (see ``conversation_trie``).
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F

from locusmill.llm.common import hot_join, saved, spread

#: Bytes of a turn's id; turns of a segment; segments that a worker's tree holds.
WIDTH, SEGMENT, HELD = 16, 32, 20_000
NODE = ["depth", "x1", "x2"]


class Node:
    """A radix node: the compressed path after its edge byte, the rows that end here, and children in a layout that fits their number.

    Up to 16 children: their bytes in order, beside them (4 places, then 16). Up to 48: a table of 256 places that says where. Beyond: 256 children.
    """

    __slots__ = ("path", "rows", "places", "keys", "children")

    def __init__(self, path: bytes) -> None:
        self.path, self.rows, self.places, self.keys, self.children = path, [], 4, bytearray(), []

    def child(self, byte: int) -> Node | None:
        if self.places <= 16:
            at = self.keys.find(byte)
            return self.children[at] if at >= 0 else None
        if self.places == 48:
            at = self.keys[byte]
            return self.children[at - 1] if at else None
        return self.children[byte]

    def add(self, byte: int, node: Node) -> None:
        if self.places < 256 and len(self.children) == self.places:
            self.grow()
        if self.places <= 16:
            at = sum(k < byte for k in self.keys)
            self.keys.insert(at, byte)
            self.children.insert(at, node)
        elif self.places == 48:
            self.children.append(node)
            self.keys[byte] = len(self.children)
        else:
            self.children[byte] = node

    def replace(self, byte: int, node: Node) -> None:
        at = self.keys.find(byte) if self.places <= 16 else self.keys[byte] - 1 if self.places == 48 else byte
        self.children[at] = node

    def grow(self) -> None:
        if self.places == 4:
            self.places = 16
        elif self.places == 16:
            index = bytearray(256)
            for i, byte in enumerate(self.keys):
                index[byte] = i + 1
            self.places, self.keys = 48, index
        else:
            self.places, self.children = 256, [self.children[i - 1] if i else None for i in self.keys]
            self.keys = bytearray()

    def below(self) -> list[Node]:
        return [c for c in self.children if c is not None]


def common(a: bytes, b: bytes) -> int:
    """Bytes that two strings have in common at their beginning."""
    n = min(len(a), len(b))
    if a[:n] == b[:n]:
        return n
    low, high = 0, n - 1
    while low < high:
        middle = (low + high + 1) // 2
        if a[:middle] == b[:middle]:
            low = middle
        else:
            high = middle - 1
    return low


def insert(root: Node, key: bytes, row: int) -> None:
    """Adds a row under its key (not empty)."""
    node, at = root, 0
    while at < len(key):
        byte = key[at]
        child = node.child(byte)
        if child is None:
            child = Node(key[at + 1 :])
            node.add(byte, child)
            child.rows.append(row)
            return
        rest = key[at + 1 :]
        same = common(child.path, rest)
        if same < len(child.path):  # the path splits
            upper = Node(child.path[:same])
            upper.add(child.path[same], child)
            child.path = child.path[same + 1 :]
            node.replace(byte, upper)
            child = upper
        node, at = child, at + 1 + same
    node.rows.append(row)


def aligned(root: Node, weights: list[list[int]], least: list[int]) -> Iterator[tuple[int, int, int, list[int]]]:
    """(a row below, turns, smallest ``least``, sums of ``weights``) for each turn-aligned depth of the tree, children first."""
    stack: list[tuple[Node, int, bool]] = [(root, 0, False)]
    done: dict[int, tuple[int, int, list[int]]] = {}
    while stack:
        node, begin, seen = stack.pop()
        end = begin + (node is not root) + len(node.path)
        if not seen:
            stack.append((node, begin, True))
            stack.extend((c, end, False) for c in node.below())
            continue
        parts = [done.pop(id(c)) for c in node.below()]
        parts += [(r, least[r], [w[r] for w in weights]) for r in node.rows]
        if not parts:
            continue
        row, low = parts[0][0], min(p[1] for p in parts)
        sums = [sum(x) for x in zip(*[p[2] for p in parts], strict=True)]
        done[id(node)] = (row, low, sums)
        for depth in range(begin // WIDTH + 1, end // WIDTH + 1):
            if depth > 1:  # the first id names the node at which the segment hangs
                yield row, depth - 1, low, sums


SEGMENTS = "conv long, depth long, a1 long, a2 long, ids array<binary>, x1 array<long>, x2 array<long>, sizes array<long>, upto array<long>"


def trie_nodes(segments: DataFrame, weights: list[str]) -> DataFrame:
    """(depth, x1, x2, p1, p2, size, upto, least, weights...): a row for each node of ``segments`` with its members' sums.

    p1, p2: the parent; size: bytes of the last turn's text; upto: of all turns' texts; least: the smallest conv.
    """
    names = [*NODE, "p1", "p2", "size", "upto", "least", *weights]

    def told(rows: list) -> pd.DataFrame:
        root = Node(b"")
        for i, r in enumerate(rows):
            head = (r.a1 & (2**64 - 1)) << 64 | r.a2 & (2**64 - 1)
            insert(root, (head ^ r.depth).to_bytes(WIDTH, "big") + b"".join(r.ids), i)
        out = []
        for i, turns, low, sums in aligned(root, [[int(getattr(r, w)) for r in rows] for w in weights], [r.conv for r in rows]):
            r, j = rows[i], turns - 1
            above = (r.x1[j - 1], r.x2[j - 1]) if j else (r.a1, r.a2)
            out.append((r.depth + turns, r.x1[j], r.x2[j], *above, r.sizes[j], r.upto[j], low, *sums))
        return pd.DataFrame(out, columns=names)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rows: list = []
        for batch in batches:
            for r in batch.itertuples(index=False):
                rows.append(r)
                if len(rows) >= HELD:
                    yield told(rows)
                    rows = []
        if rows:
            yield told(rows)

    order = ["depth", "a1", "a2", "ids", "conv"]
    dealt = segments.repartitionByRange(spread(segments), *order).sortWithinPartitions(*order)
    made = dealt.mapInPandas(run, ", ".join(f"{c} long" for c in names))
    return made.groupBy(*NODE).agg(*[F.first(c).alias(c) for c in ("p1", "p2", "size", "upto")], F.min("least").alias("least"), *[F.sum(w).alias(w) for w in weights])


def _sized(col: str) -> Column:
    return F.concat(F.octet_length(col).cast("string"), F.lit(":"), F.col(col))


def ordered_turns(df: DataFrame, conv: str, turn: str, role: str, text: str) -> DataFrame:
    """(conv, part, at, id, size): turns by conversation, in ``part`` and at place ``at`` of it; parts are ranges of (conv, turn, role, text)."""
    empty = F.lit("")
    turns = df.select(F.col(conv).cast("long").alias("conv"), F.col(turn).alias("turn"), F.coalesce(F.col(role), empty).alias("role"), F.coalesce(F.col(text), empty).alias("text")).where("conv is not null")
    order = ["conv", "turn", "role", "text"]
    number = F.monotonically_increasing_id()
    dealt = turns.repartitionByRange(spread(turns), *order).sortWithinPartitions(*order).withColumn("number", number)
    digest = F.substring(F.unhex(F.sha2(F.concat(_sized("role"), _sized("text")), 256)), 1, WIDTH)
    return dealt.select("conv", F.shiftright("number", 33).alias("part"), "number", digest.alias("id"), F.octet_length("text").cast("long").alias("size"))


def openings(df: DataFrame, conv: str, turn: str, role: str, text: str, lend: tuple[int, int] | None) -> tuple[DataFrame, DataFrame]:
    """((conv, part, pos, id, size, last), (conv, length)): the turns of every conversation, rebuilt if ``lend`` says so.

    ``lend`` (b, m): conversation c gets the first crc32(c) % m turns of conversation c - c % b in place of as many of its own.
    A conversation's turns are numbered from counts of its parts, so that it may be of any length.
    """
    turns = saved(ordered_turns(df, conv, turn, role, text))
    spans = turns.groupBy("conv", "part").agg(F.min("number").alias("first"), F.count("*").alias("n"))
    whole = saved(spans.groupBy("conv").agg(F.sum("n").alias("n")))
    base, most = lend or (1, 1)
    h = (F.crc32(F.col("conv").cast("string")) % most).alias("h")
    heads = whole.where(F.col("conv") % base == 0).select(F.col("conv").alias("base"), F.col("n").alias("n_base"))
    known = whole.select("conv", "n", h, (F.col("conv") - F.col("conv") % base).alias("base")).join(heads, "base", "left")
    known = known.withColumn("k", F.least("h", F.coalesce("n_base", F.lit(0)))).withColumn("length", F.col("k") + F.greatest(F.col("n") - F.col("h"), F.lit(0)))
    known = saved(known.select("conv", "base", "h", "k", "length"))

    before = F.coalesce(F.sum("n").over(Window.partitionBy("conv").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = spans.withColumn("start", before - F.col("first")).join(known, "conv").select("conv", "part", "start", "h", "k", "length")
    indexed = turns.join(starts, ["conv", "part"]).withColumn("i", F.col("number") + F.col("start"))
    own = indexed.where("i >= h").select("conv", "part", (F.col("i") - F.col("h") + F.col("k")).alias("pos"), "id", "size", "length")
    lent = indexed.where((F.col("conv") % base == 0) & (F.col("i") < most - 1)).select(F.col("conv").alias("base"), F.col("i").alias("pos"), "id", "size")
    asked = known.where("k > 0").select("conv", "base", "length", F.explode(F.sequence(F.lit(0).cast("long"), F.col("k") - 1)).alias("pos"))
    taken = asked.join(lent, ["base", "pos"]).select("conv", F.lit(-1).cast("long").alias("part"), "pos", "id", "size", "length")
    return saved(own.unionByName(taken).select("conv", "part", "pos", "id", "size", (F.col("pos") == F.col("length") - 1).alias("last"))), known.select("conv", "length")


def segmented(turns: DataFrame) -> DataFrame:
    """SEGMENTS, and last: the turns of openings in pieces of SEGMENT at most, with the names of all nodes on the way."""
    hashes = {"x1": F.xxhash64("pos", "id"), "x2": F.xxhash64("id", F.lit("second"), "pos")}
    turns = turns.withColumns(hashes)
    blocks = turns.groupBy("conv", "part").agg(F.bit_xor("x1").alias("b1"), F.bit_xor("x2").alias("b2"), F.sum("size").alias("bytes"))
    earlier = Window.partitionBy("conv").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    zero = F.lit(0).cast("long")
    carried = blocks.select("conv", "part", F.coalesce(F.bit_xor("b1").over(earlier), zero).alias("c1"), F.coalesce(F.bit_xor("b2").over(earlier), zero).alias("c2"), F.coalesce(F.sum("bytes").over(earlier), zero).alias("c_bytes"))
    inside = Window.partitionBy("conv", "part").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    named = turns.join(carried, ["conv", "part"]).select(
        "conv", "part", "pos", "id", "size", "last", "x1", "x2",
        F.col("c1").bitwiseXOR(F.bit_xor("x1").over(inside)).alias("n1"), F.col("c2").bitwiseXOR(F.bit_xor("x2").over(inside)).alias("n2"), (F.col("c_bytes") + F.sum("size").over(inside)).alias("upto"),
    )
    one = F.struct("pos", "id", "size", "last", "x1", "x2", "n1", "n2", "upto")
    runs = named.groupBy("conv", "part", F.floor(F.col("pos") / SEGMENT).alias("run")).agg(F.array_sort(F.collect_list(one)).alias("t"))
    first, pick = F.col("t")[0], lambda name: F.transform("t", lambda x: x[name])
    return runs.select(
        "conv", first.pos.alias("depth"), first.n1.bitwiseXOR(first.x1).alias("a1"), first.n2.bitwiseXOR(first.x2).alias("a2"), pick("id").alias("ids"),
        pick("n1").alias("x1"), pick("n2").alias("x2"), pick("size").alias("sizes"), pick("upto").alias("upto"), F.element_at("t", -1).last.alias("last"),
    )


def end_hashes(ends: DataFrame) -> DataFrame:
    """(depth, x1, x2, ends_sha256): of the decimal convs of each node, ascending, joined by commas; they stream through, none is gathered."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        at, held, out = None, None, []
        for batch in batches:
            keys, convs = list(zip(*[batch[c].tolist() for c in NODE], strict=True)), batch.conv.tolist()
            for key, conv in zip(keys, convs, strict=True):
                if key == at:
                    held.update(b",%d" % conv)
                    continue
                if at is not None:
                    out.append((*at, held.hexdigest()))
                at, held = key, hashlib.sha256(b"%d" % conv)
            if out:
                yield pd.DataFrame(out, columns=[*NODE, "ends_sha256"])
                out = []
        if at is not None:
            yield pd.DataFrame([(*at, held.hexdigest())], columns=[*NODE, "ends_sha256"])

    return ends.repartition(*NODE).sortWithinPartitions(*NODE, "conv").mapInPandas(run, "depth long, x1 long, x2 long, ends_sha256 string")


def conversation_trie(df: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text", lend: tuple[int, int] | None = None) -> DataFrame:
    """A row for each node: conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256.

    A node is a beginning of d turns (role, text) that some conversation has, from the root (d = 0) on. conv_id: its smallest
    member; n_leaves: childless nodes of its subtree; saved_tokens: over the subtree, (members - 1) times the UTF-8 bytes of
    the node's last text; ends_sha256: of the members of just d turns. ``lend`` rebuilds conversations first (see ``openings``).
    Turns stand in order of (turn, role, text), null turns first; null role and text are empty; repeated rows are turns of their own;
    rows of null conv belong to no conversation and don't count. Convs are whole numbers. Other columns aren't read. No conversation, no rows.

    Sums over a subtree come from sums over members. Let T be a member's bytes, B a node's bytes up to and with its last text, b of
    that text alone, and let each node belong to its smallest member m. Members times bytes over a subtree: sum(T) - n (B - b). Bytes of
    its distinct nodes: each member's own nodes are the lower end of its path, and all lie in the subtree unless the member
    is m: sum(own) - own(m) + T(m) - (B - b). The difference is saved_tokens. Each childless node counts for its smallest member.
    """
    turns, convs = openings(df, conv, turn, role, text, lend)
    segments = saved(segmented(turns))
    zero = F.lit(0).cast("long")
    root = convs.agg(F.min("conv").alias("least"), F.count("*").alias("n")).where("n > 0").select(*[zero.alias(c) for c in (*NODE, "p1", "p2", "size", "upto")], "least", "n")
    nodes = saved(trie_nodes(segments.withColumn("n", F.lit(1)), ["n"]).unionByName(root))
    children = nodes.where("depth > 0").groupBy((F.col("depth") - 1).alias("depth"), F.col("p1").alias("x1"), F.col("p2").alias("x2")).agg(F.count("*").alias("n_children"))
    nodes = saved(nodes.join(children, NODE, "left").na.fill(0, ["n_children"]))

    owned = nodes.groupBy(F.col("least").alias("conv")).agg(F.min_by(F.col("upto") - F.col("size"), "depth").alias("skipped"), F.count_if(F.col("n_children") == 0).alias("leaf"), F.count("*").alias("n_owned"))
    per_conv = segments.groupBy("conv").agg(F.max(F.element_at("upto", -1)).alias("total"), F.count("*").alias("n_segments"))
    weights = convs.join(per_conv, "conv", "left").join(owned, "conv", "left").na.fill(0, ["total", "n_segments", "leaf", "n_owned"])
    weights = saved(weights.withColumn("own", F.coalesce(F.col("total") - F.col("skipped"), zero)))
    n_segments = weights.agg(F.sum("n_segments")).first()[0] or 0
    sums = ["total", "own", "leaf"]
    weighed = hot_join(segments, weights.where("n_segments > 0").select("conv", *sums, "n_segments"), ["conv"], "n_segments", n_segments)
    below = trie_nodes(weighed, sums).select(*NODE, *sums).unionByName(weights.agg(F.count("*").alias("any"), *[F.sum(c).alias(c) for c in sums]).where("any > 0").select(*[zero.alias(c) for c in NODE], *sums))
    n_nodes = nodes.count()
    summed = saved(nodes.join(below, NODE))
    mine = weights.where("n_owned > 0").select(F.col("conv").alias("least"), F.col("total").alias("total_m"), F.col("own").alias("own_m"), "n_owned")
    summed = hot_join(summed, mine, ["least"], "n_owned", n_nodes)
    ends = segments.where("last").select((F.col("depth") + F.size("ids")).cast("long").alias("depth"), F.element_at("x1", -1).alias("x1"), F.element_at("x2", -1).alias("x2"), "conv")
    ends = ends.unionByName(convs.where("length = 0").select(*[zero.alias(c) for c in NODE], "conv"))
    above = F.col("upto") - F.col("size")
    gain = F.col("total") - F.col("n") * above - (F.col("own") - F.col("own_m") + F.col("total_m") - above)
    done = saved(summed.join(end_hashes(ends), NODE, "left").select(
        "least", "depth", (F.col("depth") - 1).alias("up"), "p1", "p2", "n", "n_children", F.col("leaf").alias("n_leaves"), gain.alias("saved_tokens"), F.coalesce("ends_sha256", F.sha2(F.lit(""), 256)).alias("ends_sha256")
    ))
    parents = nodes.where("n_children > 0").select(F.col("depth").alias("up"), F.col("x1").alias("p1"), F.col("x2").alias("p2"), F.col("least").alias("parent"), F.col("n_children").alias("n_here"))
    out = hot_join(done, parents, ["up", "p1", "p2"], "n_here", n_nodes)
    return out.select(F.col("least").alias("conv_id"), "depth", F.col("parent").alias("parent_conv_id"), F.col("n").alias("n_convs"), "n_children", "n_leaves", "saved_tokens", "ends_sha256")


TRIE_SQL = """
WITH t AS (SELECT conv_id AS c, coalesce(role, '') AS r, coalesce(text, '') AS x, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) AS i FROM conversations WHERE conv_id IS NOT NULL),
o AS (SELECT c, list({'r': r, 'x': x} ORDER BY i) AS ts FROM t GROUP BY c),
b AS (SELECT c, ts, flatten(list_transform(string_split(c::VARCHAR, ''), lambda ch: list_transform(range(8), lambda k: (ascii(ch) >> k) & 1))) AS bits FROM o),
h AS (SELECT c, ts, c - c % 5 AS base, xor(list_reduce(list_prepend(4294967295, bits), lambda a, bit: xor(a >> 1, 3988292384 * (xor(a, bit) & 1))), 4294967295) % 9 AS h FROM b),
f AS (SELECT h.c, list_concat(coalesce(o.ts[1:h.h], []), h.ts[h.h + 1:]) AS ts FROM h LEFT JOIN o ON o.c = h.base),
m AS (SELECT c, ts, len(ts) AS n, unnest(range(0, len(ts) + 1)) AS d FROM f),
v AS (SELECT ts[1:d] AS p, d, min(c) AS conv_id, count(*) AS n_convs, string_agg(CASE WHEN n = d THEN c::VARCHAR END, ',' ORDER BY c) AS ends FROM m GROUP BY 1, 2),
k AS (SELECT p[1:d - 1] AS p, count(*) AS n_children FROM v WHERE d > 0 GROUP BY 1),
w AS (SELECT v.*, coalesce(n_children, 0) AS n_children, CASE WHEN d = 0 THEN 0 ELSE (n_convs - 1) * octet_length(encode(v.p[d].x)) END AS gain FROM v LEFT JOIN k USING (p)),
u AS (SELECT p, n_children, gain, unnest(range(0, d + 1)) AS e FROM w),
s AS (SELECT p[1:e] AS p, count(*) FILTER (n_children = 0) AS n_leaves, sum(gain)::BIGINT AS saved_tokens FROM u GROUP BY 1)
SELECT w.conv_id, w.d AS depth, q.conv_id AS parent_conv_id, w.n_convs, w.n_children, s.n_leaves, s.saved_tokens, sha256(coalesce(w.ends, '')) AS ends_sha256
FROM w JOIN s USING (p) LEFT JOIN v q ON w.d > 0 AND q.p = w.p[1:w.d - 1]
"""
