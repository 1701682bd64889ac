"""The divergence audit against exact arithmetic on plain dictionaries."""

import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest

from locusmill.llm import divergence

TERM = re.compile(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def by_force(rows, min_docs, top):
    docs = [(lang or "", source or "", TERM.findall((text or "").translate(LOWER))) for text, lang, source in rows]
    out = []
    for lang in {d[0] for d in docs}:
        own = [d for d in docs if d[0] == lang]
        held = Counter(t for d in own for t in set(d[2]))
        kept = {t for t, n in held.items() if n >= min_docs}
        counts = defaultdict(Counter)
        for _, source, terms in own:
            counts[source].update(t for t in terms if t in kept)
        whole = sum(counts.values(), Counter())
        p = lambda c, total, kept=kept: 1 + 1000000000 * (c + 5) // (total + 5 * len(kept))
        for source in counts:
            n = counts[source].total()
            pairs = [(-sum(abs(p(counts[source][t], n) - p(counts[s][t], counts[s].total())) for t in kept), s) for s in counts if s != source]
            above = [(p(whole[t], whole.total()) - p(c, n), t) for t, c in counts[source].items() if c and p(c, n) > p(whole[t], whole.total())]
            by = lambda x: (x[0], x[1].encode())
            out += [(lang, source, "pair", s, -v, i + 1) for i, (v, s) in enumerate(sorted(pairs, key=by))]
            out += [(lang, source, "term", t, -v, i + 1) for i, (v, t) in enumerate(sorted(above, key=by)[:top])]
    return sorted(out)


def frame(spark, rows):
    return spark.createDataFrame([(*r, "t", 1, 2, "x") for r in rows], "text string, lang string, source string, term string, n int, bits long, tile string").repartition(3)


@pytest.mark.parametrize("tile,block,held", [(32, 16, 300_000), (2, 1, 20)])
def test_equals_brute_force(spark, monkeypatch, tile, block, held):
    monkeypatch.setattr(divergence, "TILE", tile)
    monkeypatch.setattr(divergence, "BLOCK", block)
    monkeypatch.setattr(divergence, "HELD", held)
    rng = random.Random(tile)
    words = [f"{a}{b}" for a in ("Ab", "cé", "zZ", "ß", "İ") for b in "abcdefghijklmnopqrstuvwxyz"] + ["x-y", "a1b", "ÀB"]
    rows = [(" ".join(rng.choices(words[: rng.choice([9, 60, 133])], k=rng.randint(0, 80))), rng.choice(["en", "en", "fr", None, ""]), rng.choice(["s0", "s0", "s0", "s1", "S2", None, "é"])) for _ in range(150)]
    rows += [(None, "en", "void"), ("", "zz", "only"), ("rare words", "zz", "other"), ("ab " * 30_000, "en", "s1")] + [("same row", "fr", "s9")] * 3
    got = sorted(tuple(r) for r in divergence.audit(frame(spark, rows), min_docs=4, top=7).collect())
    assert got == by_force(rows, 4, 7)
    assert ("zz", "only", "pair", "other", 0, 1) in got  # no kept term


def test_empty_and_odd_columns(spark):
    assert divergence.audit(frame(spark, [])).count() == 0
    assert sorted(tuple(r) for r in divergence.audit(frame(spark, [(None, None, None), (None, None, "b")])).collect()) == [("", "", "pair", "b", 0, 1), ("", "b", "pair", "", 0, 1)]


def test_shares_are_exact():
    rng = random.Random(1)
    for _ in range(200):
        total, kept = rng.randint(0, 10**rng.randint(1, 13)), rng.randint(1, 10**rng.randint(1, 8))
        c = rng.randint(0, total)
        assert divergence.shares(np.array([c]), np.array([total]), np.array([kept]))[0] == 1 + 10**9 * (c + 5) // (total + 5 * kept)
