"""Packing: the plan against best fit document by document, the pieces against the tokenizers library, slots without gaps."""

import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from locusmill.llm import packing, queries

SF = "/root/testdata/sf0.001"


def by_document(lengths, limit):
    """Plain best fit by falling length: the room that each document leaves, in order."""
    rooms, left = [], []
    for n in sorted(lengths, reverse=True):
        i = min((r, i) for i, r in enumerate([*rooms, limit]) if r >= n)[1]
        if i == len(rooms):
            rooms.append(limit)
        rooms[i] -= n
        left.append(rooms[i])
    return rooms, left


def filled(plan, limit):
    """Sequences of the plan as sorted (offset, length); fails if two slots of one length and rank exist."""
    out, seen = defaultdict(list), set()
    for length, rank, n, sequence, each, place in plan:
        for i in range(n):
            assert (length, rank + i) not in seen
            seen.add((length, rank + i))
            out[sequence + i // each].append((place + i % each * length, length))
    for slots in out.values():
        at = 0
        for place, length in sorted(slots):
            assert place == at
            at += length
        assert at <= limit
    return out, seen


@pytest.mark.parametrize("seed", range(12))
def test_plan_equals_best_fit_by_document(seed):
    rng = random.Random(seed)
    limit = rng.choice([7, 16, 64, 100])
    lengths = [min(limit, max(1, int(rng.expovariate(1 / rng.choice([3, limit / 2, limit]))))) for _ in range(rng.choice([1, 40, 300]))]
    lengths += [limit, limit, 1] + [limit // 2] * rng.randint(0, 30)
    counts = Counter(lengths)
    out, seen = filled(packing.best_fit(dict(counts), limit), limit)
    assert seen == {(n, i) for n, c in counts.items() for i in range(c)}
    rooms, _ = by_document(lengths, limit)
    assert sorted(limit - sum(n for _, n in s) for s in out.values()) == sorted(rooms)


def test_plan_does_not_grow_with_the_documents():
    counts = {n: 3 + n % 11 for n in range(1, 1025)}
    small, large = packing.best_fit(counts), packing.best_fit({n: c * 10**9 for n, c in counts.items()})
    assert len(large) < 2 * len(small) and packing.best_fit({}) == []


def test_ids_equal_the_library():
    library = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    rng = random.Random(3)
    texts = ["", "<|endoftext|>", "a<|endoftext|> b", "I'll  go\n\n \tnow 12.5  x", "İß😀é‍", " " * 300_000 + "x", "\n" * 300_000, "z" * 60_000]
    texts += ["".join(chr(rng.choice([rng.randint(1, 127), rng.randint(128, 0x2FFF), rng.randint(0xE000, 0x1FFFF)])) for _ in range(200)) for _ in range(200)]
    for t in texts:
        assert packing.encoder().ids(t).tolist() == library.encode(t, add_special_tokens=False).ids


def check(rows, out, limit=1024):
    library = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    want = Counter()
    for key, text in rows:
        ids = [*library.encode(text or "", add_special_tokens=False).ids, 2]
        first, start, piece = (len(ids) - 1) % limit + 1, 0, 0
        while start < len(ids):
            own = ids[start : start + (first if start == 0 else limit)]
            want[key, piece, start, len(own), zlib.crc32(np.array(own, "<u4").tobytes())] += 1
            start, piece = start + len(own), piece + 1
    assert Counter((r[0], r.piece, r.start, r.length, r.ids_crc32) for r in out) == want
    sequences = defaultdict(list)
    for r in out:
        sequences[r.sequence_id].append((r.offset, r.length))
    for slots in sequences.values():
        at = 0
        for offset, length in sorted(slots):
            assert offset == at
            at += length
        assert at <= limit
    return len(sequences)


def test_query(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()]
    out = queries.op12_packing(spark, SF)
    assert out.columns == ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"]
    got = out.collect()
    used = check(rows, got)
    assert used == len(by_document([r.length for r in got], 1024)[0]) and used <= 1.01 * sum(r.length for r in got) / 1024 + 1


def test_edges(spark):
    rows = [(1, None), (1, None), (None, ""), (2, "a"), (2, "a"), (3, "word " * 4000), (None, "word " * 1023), (4, "word " * 1024), (5, "<|endoftext|>")]
    df = spark.createDataFrame([(*r, 1, 2, "x", 3, 4) for r in rows], "doc_id long, text string, part int, nth int, length string, sequence int, n int").repartition(3)
    check(rows, packing.pack(df, outputs="digest").collect())
    with_ids = packing.pack(df).collect()
    check(rows, with_ids)
    for r in with_ids:
        assert len(r.ids) == r.length and zlib.crc32(np.array(r.ids, "<u4").tobytes()) == r.ids_crc32
    assert packing.pack(df.limit(0), outputs="digest").count() == 0
    named = df.selectExpr("concat('d', doc_id) AS name", "text AS body")
    assert sorted({r.name for r in packing.pack(named, "name", "body", limit=16).collect()}, key=lambda x: x or "z") == ["d1", "d2", "d3", "d4", "d5", None]
    check([(f"d{k}" if k else None, t) for k, t in rows], packing.pack(named, "name", "body", limit=16).collect(), 16)
