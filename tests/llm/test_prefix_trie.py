"""The prefix trie against a plain dictionary of beginnings, and the radix tree's layouts."""

import hashlib
import random
import zlib
from collections import defaultdict

import pytest

from locusmill.llm import prefix_trie, queries
from tests.compare import assert_same, connect

SCHEMA = "conv_id long, turn long, role string, text string, depth int, x1 string, part long, n string"


def by_force(rows, lend=None):
    convs = defaultdict(list)
    for conv, turn, role, text in rows:
        if conv is not None:
            convs[conv].append((turn is not None, turn or 0, role or "", text or ""))
    own = {c: [t[2:] for t in sorted(ts)] for c, ts in convs.items()}
    if lend:
        base, most = lend
        h = {c: zlib.crc32(str(c).encode()) % most for c in own}
        own = {c: own.get(c - c % base, [])[: h[c]] + ts[h[c] :] for c, ts in own.items()}
    members = defaultdict(list)
    for c, ts in own.items():
        for d in range(len(ts) + 1):
            members[tuple(ts[:d])].append(c)
    children = defaultdict(int)
    for p in members:
        if p:
            children[p[:-1]] += 1
    leaves, gains = defaultdict(int), defaultdict(int)
    for p, m in members.items():
        for d in range(len(p) + 1):
            leaves[p[:d]] += not children[p]
            gains[p[:d]] += (len(m) - 1) * len(p[-1][1].encode()) if p else 0
    return sorted(
        (min(m), len(p), min(members[p[:-1]]) if p else None, len(m), children[p], leaves[p], gains[p], hashlib.sha256(",".join(str(c) for c in sorted(m) if len(own[c]) == len(p)).encode()).hexdigest())
        for p, m in members.items()
    )


def sorted_rows(df):
    return sorted(tuple(r) for r in df.collect())


def frame(spark, rows):
    return spark.createDataFrame([(*r, 1, "x", 2, "y") for r in rows], SCHEMA).repartition(3)


@pytest.mark.parametrize("lend", [None, (5, 9), (3, 4)])
def test_equals_brute_force(spark, monkeypatch, lend):
    monkeypatch.setattr(prefix_trie, "SEGMENT", 3)
    monkeypatch.setattr(prefix_trie, "HELD", 7)
    rng = random.Random(str(lend))
    rows = [(c, t, rng.choice(["user", None, ""]), rng.choice(["a", "bé", None, "ccc"])) for c in [*range(40), 10**15, 12345] for t in range(rng.choice([1, 2, 4, 9]))]
    rows += [(c, None if t == 3 else t, "user", f"t{t}") for c in range(50, 62) for t in range(8)]  # copies
    rows += [(70, t // 2, "user", "same") for t in range(60)] + [(71, 0, "user", "same")] * 45  # long ones, ties and repeated rows
    rows += [(None, 1, "user", "nobody's"), (None, None, None, None)]
    assert sorted_rows(prefix_trie.conversation_trie(frame(spark, rows), lend=lend)) == by_force(rows, lend)


def test_edges(spark):
    assert prefix_trie.conversation_trie(frame(spark, []), lend=(5, 9)).count() == 0
    assert prefix_trie.conversation_trie(frame(spark, [(None, 1, "a", "b")])).count() == 0
    # crc32("7") % 9 is 8 and there is no conversation 5: without turns
    assert zlib.crc32(b"7") % 9 > 1
    assert sorted_rows(prefix_trie.conversation_trie(frame(spark, [(7, 0, "u", "x")]), lend=(5, 9))) == [(7, 0, None, 1, 0, 1, 0, hashlib.sha256(b"7").hexdigest())]
    long_ = [(1, 0, "u", "x" * 1_000_000), (2, 0, "u", "x" * 1_000_000), (2, 1, "u", "")]
    assert sorted_rows(prefix_trie.conversation_trie(frame(spark, long_))) == by_force(long_)


def test_one_conversation_of_most_rows_spreads_over_parts(spark):
    rows = [(1, t, "user", f"t{t % 7}") for t in range(3000)] + [(2, t, "user", f"t{t % 7}") for t in range(1500)] + [(c, 0, "user", "t0") for c in range(3, 9)]
    df = frame(spark, rows)
    assert prefix_trie.ordered_turns(df, "conv_id", "turn", "role", "text").where("conv = 1").select("part").distinct().count() > 1
    got = {(r.conv_id, r.depth): r for r in prefix_trie.conversation_trie(df).collect()}
    assert len(got) == 3001 and got[1, 0].n_convs == 8 and got[1, 1500].n_convs == 2 and got[1, 3000].n_leaves == 1 and got[1, 0].saved_tokens == 2 * 1499 + 2 * 7


def test_query_on_more_rows(spark):
    sf = "/root/testdata/sf0.01"
    assert_same(spark, connect(sf), queries.op11_trie, prefix_trie.TRIE_SQL, sf)


def test_layouts_grow_and_paths_split():
    rng = random.Random(5)
    keys = {bytes([rng.randrange(n), *[rng.randrange(3) for _ in range(31)]]) for n in (3, 10, 40, 256) for _ in range(400)}
    keys |= {k[:16] for k in list(keys)[:50]}
    root = prefix_trie.Node(b"")
    for i, k in enumerate(sorted(keys, key=hash)):
        prefix_trie.insert(root, k, i)
        assert root.places in (4, 16, 48, 256) and len(root.below()) <= root.places
    assert root.places == 256
    for k in keys:
        node, at = root, 0
        while at < len(k):
            node, at = node.child(k[at]), at + 1
            assert k[at : at + len(node.path)] == node.path
            at += len(node.path)
        assert len(node.rows) == 1
    seen = [d for _, d, _, _ in prefix_trie.aligned(root, [], [0] * len(keys))]
    assert len(seen) == len({k for k in keys if len(k) == 32}) and set(seen) == {1}
