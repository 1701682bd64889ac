"""Each operator against brute force, an exact round trip, SQL or held-out accuracy."""

import hashlib
import html
import random
import re
import struct
import zlib

import numpy as np
import pytest
from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F

from locusmill.llm import bpe, decontaminate, graph, html_main, line_dedup, pivots, queries, sharding, shingles, simhash, suffix_dedup, toxicity
from tests.compare import assert_same, connect

SF = "/root/testdata/sf0.001"


def rows_of(spark, name, *columns):
    return [tuple(r) for r in spark.read.parquet(f"{SF}/{name}.parquet").select(*columns).collect()]


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_sql(spark, name):
    assert_same(spark, connect(SF), queries.QUERIES[name], queries.ORACLES[name], SF)


def removed_by_force(rows, size=100):
    seen, out = set(), {}
    for i, text in sorted(rows):
        data = (text or "").encode()
        gone = bytearray(len(data))
        for p in range(len(data) - size + 1):
            if data[p : p + size] in seen:
                gone[p : p + size] = b"\1" * size
            seen.add(data[p : p + size])
        kept = bytes(b for b, g in zip(data, gone, strict=True) if not g)
        runs = sum(1 for p, g in enumerate(gone) if g and (p == 0 or not gone[p - 1]))
        out[i] = (len(data), sum(gone), runs, hashlib.sha256(kept).hexdigest())
    return out


def repeated_rows(seed, n):
    rng = random.Random(seed)
    base = ["".join(rng.choice("ab cdé") for _ in range(400)) for _ in range(5)]
    cut = lambda: rng.choice(base)[rng.randint(0, 200) :][: rng.randint(50, 250)]
    rows = [(i, "".join(cut() + rng.choice(["", "x", "yy"]) for _ in range(4))) for i in range(n)]
    return rows + [(n, "a" * 1000), (n + 1, "ab" * 700), (n + 2, "a" * 99), (n + 3, "a" * 100), (n + 4, None)]


@pytest.mark.parametrize("group", [64, 2])
def test_suffix_dedup_equals_brute_force(spark, monkeypatch, group):
    monkeypatch.setattr(suffix_dedup, "GROUP", group)
    monkeypatch.setattr(suffix_dedup, "BLOCK", 700)
    rows = repeated_rows(group, 70)
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    got = {r[0]: tuple(r[1:]) for r in suffix_dedup.remove_repeats(df, outputs="digest").collect()}
    assert got == removed_by_force(rows)


def test_suffix_dedup_on_documents(spark):
    got = {r[0]: tuple(r[1:]) for r in queries.op1_suffix_dedup(spark, SF).collect()}
    assert got == removed_by_force(rows_of(spark, "documents", "doc_id", "text"))


def test_suffix_dedup_keeps_bytes_outside_the_spans(spark):
    df = spark.createDataFrame(repeated_rows(9, 30), "doc_id long, text string")
    source = {r.doc_id: (r.text or "").encode() for r in df.collect()}
    for r in suffix_dedup.remove_repeats(df).collect():
        left, at = b"", 0
        for s in r.spans:
            left += source[r.doc_id][at : s.start]
            at = s.stop
        assert bytes(r.kept) == left + source[r.doc_id][at:]


def test_toxicity_held_out(spark):
    sf = "/root/testdata/sf0.1"
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    got = queries.op2_toxicity(spark, sf).join(labels, "doc_id").where("held_out").toPandas()
    hits = ((got.predicted == 1) & (got.toxic == 1)).sum()
    assert hits / (got.toxic == 1).sum() > 0.8
    assert ((got.predicted == 1) & (got.toxic == 0)).sum() <= 0.01 * (got.toxic == 0).sum()
    assert docs.count() == queries.op2_toxicity(spark, sf).count()


def test_counterfactual_penalty_flattens_identity_terms(spark, monkeypatch):
    rng = random.Random(0)
    fill = lambda: " ".join(rng.choice("river stone cloud tree path".split()) for _ in range(8))
    rows = [(i, f"{fill()} muslim {fill()} idiot" if i % 2 else f"{fill()} christian {fill()}") for i in range(400)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = docs.select("doc_id", (F.col("doc_id") % 2).cast("int").alias("toxic"))
    neutral = "a muslim wrote this about a river and a stone"
    fair = toxicity.train(docs, labels).score(neutral)
    monkeypatch.setattr(toxicity, "SWAP_PENALTY", 0.0)
    unfair = toxicity.train(docs, labels).score(neutral)
    assert fair < 0.5 and fair < unfair


def test_counterfactual_penalty_spares_neutral_mentions(spark, monkeypatch):
    """Held-out texts that name a group which stands in toxic texts only: fewer are rejected than without the penalty."""
    rng = random.Random(5)
    fill = lambda n: " ".join(rng.choice("river stone cloud tree path boat field house".split()) for _ in range(n))
    rows = [(i, f"{fill(6)} {'immigrants' if rng.random() < 0.7 else ''} {rng.choice(['idiot', 'scum', 'filth'])} {fill(4)}" if i % 2 else fill(12), i % 2) for i in range(600)]
    rows += [(1000 + i, f"{fill(6)} immigrants {fill(6)}", 0) for i in range(100)] + [(2000 + i, f"{fill(5)} scum {fill(5)}", 1) for i in range(100)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, toxic int")
    labels = docs.where("doc_id < 1000").select("doc_id", "toxic")

    def rejected(penalty):
        monkeypatch.setattr(toxicity, "SWAP_PENALTY", penalty)
        got = toxicity.score(docs.where("doc_id >= 1000"), toxicity.train(docs.select("doc_id", "text"), labels)).collect()
        return sum(r.predicted for r in got if r.doc_id < 2000), sum(r.predicted for r in got if r.doc_id >= 2000)

    fair, unfair = rejected(10.0), rejected(0.0)
    assert fair[0] < unfair[0] and fair[0] <= 5 and fair[1] >= 95


def test_toxicity_scores_by_hand(spark):
    """The scores of the query equal a plain reading of the weights over each text's features."""
    docs, labels = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")
    model = toxicity.train(docs, labels)
    texts = dict(rows_of(spark, "documents", "doc_id", "text"))
    for r in queries.op2_toxicity(spark, SF).collect():
        held = {f for w in re.findall(r"[^\W\d_]+", (texts[r.doc_id] or "").lower()) for f in toxicity.word_features(w)}
        logit = model.bias + sum(w for f, w in model.weights.items() if f in held)
        assert abs(r.score - 1 / (1 + np.exp(-logit))) < 1e-9 and r.predicted == (r.score >= 0.5)
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0)


def texts_and_library():
    tool = bpe.TrieBpe(bpe.default_path())

    def check(texts):
        for text, (ids, decoded) in zip(texts, tool.encode(texts), strict=True):
            want = tool.library.encode(text, add_special_tokens=False).ids
            assert list(struct.unpack(f"<{len(ids) // 4}I", ids)) == want
            assert decoded == tool.library.decode(want, skip_special_tokens=False)

    return check


CHECK_BPE = texts_and_library()


@given(st.lists(st.text(max_size=60), max_size=5))
@settings(max_examples=150, deadline=None)
def test_bpe_equals_library(texts):
    CHECK_BPE(texts)


def test_bpe_special_cases(spark):
    CHECK_BPE(["<|endoftext|>x<|startoftext|>", "it's 'S 'll''ve", "a" * 3000, "ΑΣ İ Kß", "x\x1cy\u0085z", ""])
    CHECK_BPE([t or "" for _, t in rows_of(spark, "documents", "doc_id", "text")])


def test_bpe_query(spark):
    library = bpe.TrieBpe(bpe.default_path()).library
    texts = dict(rows_of(spark, "documents", "doc_id", "text"))
    for r in queries.op3_bpe(spark, SF).collect():
        ids = library.encode(texts[r.doc_id] or "", add_special_tokens=False).ids
        decoded = library.decode(ids, skip_special_tokens=False)
        assert (r.n_tokens, r.ids_sha256) == (len(ids), hashlib.sha256(struct.pack(f"<{len(ids)}I", *ids)).hexdigest())
        assert r.decoded_sha256 == hashlib.sha256(decoded.encode()).hexdigest()


def test_hilbert_curve_steps_to_neighbours():
    for dims, bits in ((2, 4), (3, 3), (4, 2)):
        cells = np.indices([1 << bits] * dims).reshape(dims, -1)
        index = sharding.hilbert_index(cells, bits)
        order = np.argsort(index)
        assert (np.sort(index) == np.arange(len(index))).all()
        assert (np.abs(np.diff(cells[:, order], axis=1)).sum(axis=0) == 1).all()


def test_sharding_law(spark):
    got = queries.op5_hilbert(spark, SF).toPandas()
    source = dict(rows_of(spark, "documents", "doc_id", "text"))
    assert sorted(got.doc_id) == sorted(source)
    sizes = got.groupby("shard").size()
    assert set(sizes.index) == set(range(24)) and sizes.max() - sizes.min() <= 1
    for _, shard in got.groupby("shard"):
        assert sorted(shard.slot) == list(range(len(shard)))
    for r in got.itertuples():
        data = (source[r.doc_id] or "").encode()
        assert r.size == len(data) + 8 and r.text_crc32 == zlib.crc32(data)


def cells_by_force(values, bits):
    """Quantile of where each value begins in their order, nulls first."""
    order = sorted(values, key=lambda v: (v is not None, v or ""))
    return {v: order.index(v) * 2**bits // len(values) for v in set(values)}


@pytest.mark.parametrize("seed", range(4))
def test_sharding_equals_brute_force(spark, seed):
    """Groups stay whole, and rows without copies lie along the curve over whole values of the metadata."""
    rng = random.Random(seed)
    rows = []
    for g in range(rng.randint(5, 50)):
        rows += [(f"group {g}", rng.choice(["en", "de", None]), f"common-crawl-{rng.randint(0, 9)}") for _ in range(rng.choice([1, 2, 3, 5, 9, 14]))]
    rows += [(f"single {i}", rng.choice(["en", "de", None]), f"common-crawl-{rng.randint(0, 9)}") for i in range(rng.randint(40, 90))]
    rows = [(i, *r) for i, r in enumerate(rows)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").repartition(3)
    got = sharding.shard_by_curve(df, shards=6).toPandas()
    sizes = got.groupby("shard").size()
    assert sorted(got.doc_id) == list(range(len(rows))) and sizes.max() - sizes.min() <= 1
    assert all(sorted(x.slot) == list(range(len(x))) for _, x in got.groupby("shard"))
    groups = got.groupby(["text_crc32", "size"])
    assert (groups.shard.nunique() == 1).all() and (groups.size() > 1).any()
    count, least = {}, {}
    for _, text, lang, source in rows:
        count[text] = count.get(text, 0) + 1
        least[text] = min(least.get(text, ("~",)), ("=" + lang if lang else "", "=" + source))
    langs, sources = (cells_by_force([least[t][k] for _, t, _, _ in rows], 5) for k in (0, 1))
    by_id = got.set_index("doc_id")
    steps = [sorted(len(t) + 8 for _, t, _, _ in rows)[max(0, -(-i * len(rows) // 32) - 1)] for i in range(1, 32)]
    for i, text, _, _ in rows:
        cell = np.array([[langs[least[text][0]]], [sources[least[text][1]]], [sum(s < len(text) + 8 for s in steps)]])
        assert by_id.loc[i, "curve"] == sharding.hilbert_index(cell, 5)[0]
    single = got[[count[rows[i][1]] == 1 for i in got.doc_id]].sort_values(["shard", "slot"])
    assert single.curve.is_monotonic_increasing


def test_sharding_of_a_group_larger_than_a_shard(spark):
    rows = [(i, "same" if i < 50 else f"text {i}", "en", "s") for i in range(100)]
    got = sharding.shard_by_curve(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string"), shards=10).toPandas()
    assert (got.groupby("shard").size() == 10).all() and sorted(got.doc_id) == list(range(100))
    assert all(sorted(x.slot) == list(range(10)) for _, x in got.groupby("shard"))


def lines_of(text):
    """(start, stop, normalised words) of the lines that have words."""
    at = 0
    for line in (text or "").split("\n"):
        if words := line.lower().split():
            begin = at + len(line) - len(line.lstrip())
            yield begin, at + len(line.rstrip()), words
        at += len(line) + 1


def test_repeated_lines_equal_brute_force(spark):
    rows = rows_of(spark, "documents", "doc_id", "text") + [(900, "one\nTwo  words\n\none\n two words \nlast"), (901, "One\nother"), (902, None)]
    seen, want = set(), {}
    for i, text in sorted(rows):
        want[i] = []
        for start, stop, words in lines_of(text):
            if tuple(words) in seen:
                want[i].append((start, stop, len(words)))
            seen.add(tuple(words))
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    assert {r.doc_id: [tuple(x) for x in r.lines] for r in line_dedup.repeat_report(df).collect()} == want
    assert any(n < 8 for own in want.values() for _, _, n in own)
    cut = {r.doc_id: r.text for r in line_dedup.remove_repeated_units(df, run_words=1, stretch_words=0).collect()}
    for i, text in rows:
        gone = {p for a, b, _ in want[i] for p in range(a, b)}
        left = [w for w in "".join("\n" if p in gone else c for p, c in enumerate(text or "")).split()]
        assert (cut[i] or "").split() == left  # repeated lines that adjoin go with the line feeds between them


def test_cut_spans_equal_brute_force(spark):
    """Each cut word stands in a repeated run, and every repeat of RUN_WORDS + PLACES - 1 words is cut but for its ends."""
    least, places = line_dedup.RUN_WORDS, line_dedup.PLACES
    rows = rows_of(spark, "documents", "doc_id", "text")
    spans = {r.doc_id: [tuple(x) for x in r.spans] for r in queries.op7_line_dedup(spark, SF).collect()}
    seen, lines, cut = set(), set(), 0
    for i, text in sorted(rows):
        words = [(m.start(), m.end(), m[0].lower()) for m in re.finditer(r"\S+", text or "")]
        repeat = [False] * len(words)
        long = [False] * len(words)
        grams = [tuple(w for _, _, w in words[j : j + least]) for j in range(len(words) - least + 1)]
        again = []
        for j, g in enumerate(grams):
            again.append(g in seen)
            if again[-1]:
                repeat[j : j + least] = [True] * least
            seen.add(g)
        run = 0
        for j, hit in enumerate([*again, False]):
            if hit:
                run += 1
            else:
                if run >= places:  # run + least - 1 words repeat
                    a, b = j - run, j + least - 1
                    long[a + places - 1 : b - places + 1] = [True] * (b - a - 2 * places + 2)
                run = 0
        own = []
        for a, b, line in lines_of(text):
            own.append((a, b, len(line), tuple(line) in lines))
            lines.add(tuple(line))
        at = 0
        while at < len(own):
            end = at
            while end < len(own) and own[end][3]:
                end += 1
            if sum(x[2] for x in own[at:end]) >= least:
                for k, (a, b, _) in enumerate(words):
                    if own[at][0] <= a and b <= own[end - 1][1]:
                        repeat[k] = long[k] = True
            at = max(end, at + 1)
        gone = [any(a <= x and y <= b for a, b in spans[i]) for x, y, _ in words]
        assert all(r for g, r in zip(gone, repeat, strict=True) if g), i
        assert all(g for g, x in zip(gone, long, strict=True) if x), i
        assert all(a[1] < b[0] for a, b in zip(spans[i], spans[i][1:], strict=False))
        cut += sum(gone)
    assert cut > 0


def test_words_equal_brute_force(monkeypatch):
    rng = random.Random(1)
    for block in (40, 1 << 19):
        monkeypatch.setattr(shingles, "BLOCK", block)
        for _ in range(60):
            texts = ["".join(rng.choice("ab Çİ\n\u2003\u3000😀\t") for _ in range(rng.randint(0, 200))) for _ in range(rng.randint(0, 6))]
            want = [(i, m.start(), m.end(), t[: m.start()].count("\n"), shingles.lowered(m[0])) for i, t in enumerate(texts) for m in re.finditer(r"\S+", t)]
            w = shingles.words_of(texts)
            assert list(zip(w.text, w.start, w.stop, w.line, strict=True)) == [x[:4] for x in want]
            name = dict(zip([x[4] for x in want], w.name.tolist(), strict=True))
            assert [name[x[4]] for x in want] == w.name.tolist() and len(set(name.values())) == len(name)


@pytest.mark.parametrize("ends", [0.1, 0.0])
def test_planted_passage_inside_lines(spark, ends):
    rng = random.Random(4)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 8)))
    prose = lambda n: " ".join(word() + ("." if rng.random() < ends else "") for _ in range(n))
    passage = prose(56)
    rows = [(i, f"{prose(40)} {passage} {prose(40)}" if i % 3 == 0 else prose(120)) for i in range(30)]
    got = {r.doc_id: r.n_removed for r in line_dedup.repeat_report(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert all((n > 0) == (i % 3 == 0 and i > 0) for i, n in got.items())


def test_vector_search_recall_and_order(spark):
    rows = {i: np.array(v, float) for i, v in rows_of(spark, "embeddings", "vec_id", "embedding")}
    got = queries.op8_pivots(spark, SF).toPandas()
    hits = total = 0
    for q, own in got.sort_values("rank").groupby("query_id"):
        scores = sorted(((-(v * rows[q]).sum(), i) for i, v in rows.items() if i != q))[:20]
        assert list(own["rank"]) == list(range(1, 21)) and (own.score.diff().dropna() <= 1e-12).all()
        hits += len({i for _, i in scores} & set(own.vec_id))
        total += 20
    assert got.query_id.nunique() == sum(i % 20 == 0 for i in rows)
    assert hits / total >= 0.9


def test_vector_search_recall_below_full_rerank(spark, monkeypatch):
    monkeypatch.setattr(pivots, "SHARD_ROWS", 700)
    df = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet")
    rows = {r.vec_id: np.array(r.embedding, float) for r in df.collect()}
    ids, block = np.array(sorted(rows)), np.stack([rows[i] for i in sorted(rows)])
    hits = total = 0
    for q, own in pivots.search(df, F.col("id") % 50 == 0).toPandas().groupby("query_id"):
        order = np.lexsort((ids, -(block @ rows[q])))
        hits += len(set(ids[[o for o in order if ids[o] != q][:20]]) & set(own.vec_id))
        total += 20
    assert hits / total >= 0.9


def test_vector_search_keeps_rows_of_one_key(spark):
    rows = [(1, [5.0, 0.0]), (1, [2.0, 0.0]), (20, [1.0, 0.0]), (20, [0.0, 1.0]), (3, [1.0, 1.0, 1.0]), (40, [1.0, 0.0, 2.0])]
    got = sorted(tuple(r) for r in pivots.search(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), F.col("id") % 20 == 0).collect())
    assert got == [(20, 1, 1, 0.0), (20, 1, 1, 5.0), (20, 2, 1, 0.0), (20, 2, 1, 2.0), (20, 3, 20, 0.0), (20, 3, 20, 0.0), (40, 1, 3, 3.0)]


def test_vector_share_falls():
    assert pivots.share_of(10) == pivots.share_of(2_000) == 0.25 and 0.08 < pivots.share_of(51_282) < 0.09 and pivots.share_of(10**9) < 0.004


def groups_by_force(rows, near):
    label = {i: i for i, _ in rows}
    change = True
    while change:
        change = False
        for i, x in rows:
            for j, y in rows:
                if label[j] < label[i] and near(x, y):
                    label[i], change = label[j], True
    return label


def test_simhash_equals_brute_force(spark, monkeypatch):
    monkeypatch.setattr(simhash, "LEAF_ROWS", 16)
    monkeypatch.setattr(simhash, "TASK_PAIRS", 200)
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text")
    near = docs.select((F.col("doc_id") + 1000).alias("doc_id"), F.concat("text", F.lit(" tail")).alias("text")).union(docs)
    rows = [(r.doc_id, simhash.fingerprint(r.text, 3)) for r in near.collect()]
    want = groups_by_force(rows, lambda x, y: (x ^ y).bit_count() <= 2)
    got = simhash.near_groups(near).collect()
    assert {r.doc_id: r.component_id for r in got} == want
    assert {r.doc_id: r.fp % 2**64 for r in got} == dict(rows)
    assert sorted(r.doc_id for r in simhash.near_dedup(near, width=3, similarity=1.1).collect()) == sorted(set(want.values()))


def test_simhash_query(spark):
    docs = dict(rows_of(spark, "documents", "doc_id", "text"))
    got = queries.op9_simhash(spark, SF).collect()
    assert {r.doc_id: r.fingerprint for r in got} == {i: f"{simhash.fingerprint(t, 3):016x}" for i, t in docs.items()}
    assert {r.doc_id: r.component_id for r in got} == groups_by_force([(i, simhash.fingerprint(t, 3)) for i, t in docs.items()], lambda x, y: (x ^ y).bit_count() <= 2)


def test_split_leaves_compare_no_more_pairs(spark, monkeypatch):
    monkeypatch.setattr(simhash, "LEAF_ROWS", 256)
    rng = np.random.default_rng(2)
    points = spark.createDataFrame([(int(x),) for x in rng.integers(-(1 << 63), 1 << 62, 3000)], "fp long")
    compared = {}
    for limit in (400_000_000, 40_000, 4_000):
        monkeypatch.setattr(simhash, "TASK_PAIRS", limit)
        tasks = simhash.dealt(points, 2).groupBy("leaf", "i", "j").agg(F.count_if(F.col("role") != simhash.GUEST).alias("h"), F.count_if(F.col("role") != simhash.HOME).alias("g")).toPandas()
        compared[limit] = int((tasks.h * tasks.g).sum())
        if limit < 400_000_000:
            assert (tasks.h * tasks.g).max() < 4 * limit
    assert len(set(compared.values())) == 1


def test_near_dedup_equals_brute_force(spark):
    rng = random.Random(3)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(rng.randint(2, 7)))
    common = [word() for _ in range(30)]
    rows = []
    for i in range(60):
        words = [word() for _ in range(rng.choice([6, 12, 40, 150, 400]))]
        words[3:3] = common if i % 3 == 0 else []
        rows.append((10 * i, " ".join(words)))
        for j in range(1, rng.randint(1, 5)):
            copy = list(words)
            for _ in range(rng.randint(0, max(1, len(words) // 40))):
                at = rng.randrange(len(copy))
                copy[at : at + rng.randint(0, 1)] = [word()]
            rows.append((10 * i + j, " ".join(copy).upper() if j == 2 else " ".join(copy)))
    sets = {i: simhash.shingle_set(t, 5) for i, t in rows}
    want = groups_by_force([(i, i) for i, _ in rows], lambda x, y: len(sets[x] & sets[y]) >= 0.8 * len(sets[x] | sets[y]))
    df = spark.createDataFrame(rows + rows[:20], "doc_id long, text string").repartition(4)
    kept = [r.doc_id for r in simhash.near_dedup(df).collect()]
    assert set(want.values()) <= set(kept)
    copies, left = len(rows) - len(set(want.values())), set(kept) - set(want.values())
    assert copies > 60 and len(left) <= 0.03 * copies
    assert len(kept) == len(set(kept)) + sum(kept.count(i) - 1 for i in set(kept) if i in {r[0] for r in rows[:20]})


def test_fingerprint_by_hand():
    import xxhash

    hashes = [xxhash.xxh64_intdigest(s, 42) for s in ("a b c", "b c b", "c b c")]
    want = sum(1 << i for i in range(64) if 2 * sum(h >> i & 1 for h in hashes) > 3)
    assert simhash.fingerprint("A b\x0bC  b\nc", 3) == want
    assert simhash.fingerprint("Á b", 3) == xxhash.xxh64_intdigest("Á b", 42)
    assert simhash.fingerprint(" \n", 3) == simhash.fingerprint(None, 3) == 0


def test_vantage_routing_loses_no_near_pair():
    rng = np.random.default_rng(1)
    points = rng.integers(0, 1 << 63, 3000, np.uint64)
    flips = np.uint64(1) << rng.integers(0, 64, (3000, 2), np.uint64)
    near = points ^ flips[:, 0] ^ flips[:, 1]
    tree = simhash.VantageTree(points[:500], 5)
    _, home = (lambda x: (x[0], x[1][np.argsort(x[0])]))(tree.route(points, 0))
    at, leaf = tree.route(near, 2)
    assert len(home) == 3000 and {(i, home[i]) for i in range(3000)} <= set(zip(at.tolist(), leaf.tolist(), strict=True))


@pytest.mark.parametrize("seed", [0, 1])
def test_components(spark, seed):
    rng = random.Random(seed)
    edges = [(rng.randint(0, 300), rng.randint(0, 300)) for _ in range(200)] + [(1000 + i, 1001 + i) for i in range(40)] + [(2000, 2000 + i) for i in range(30)] + [(5, 5)]
    parent = {}

    def find(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in edges:
        if a != b:
            ra, rb = find(a), find(b)
            parent[max(ra, rb)] = min(ra, rb)
    got = graph.components(spark.createDataFrame(edges, "a long, b long"))
    assert {r.node: r.root for r in got.collect()} == {x: find(x) for x in parent}
    assert graph.components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_decontamination_in_blocks_of_windows(spark, monkeypatch):
    want = sorted(map(tuple, queries.op6_decontaminate(spark, SF).collect()))
    monkeypatch.setattr(decontaminate, "MAX_BROADCAST_WINDOWS", 400)
    assert sorted(map(tuple, queries.op6_decontaminate(spark, SF).collect())) == want


def test_remove_spans_cuts_the_hit_words(spark):
    bench = spark.createDataFrame([(1, "one two three four five six seven eight nine ten eleven twelve thirteen"), (2, "short item")], "item_id long, text string")
    docs = spark.createDataFrame([(1, "Start: ONE two, three four five six seven eight nine ten eleven twelve thirteen! End of it."), (2, "a short-item here"), (3, "clean")], "doc_id long, text string")
    got = {r.doc_id: r.text for r in decontaminate.remove_spans(docs, bench).collect()}
    assert got == {1: "Start! End of it.", 2: "a here", 3: "clean"}


def test_html_held_out_layouts(spark):
    pages = spark.read.parquet(f"{SF}/pages.parquet")
    model = html_main.train(pages)
    exact = total = 0
    for i, (source,) in enumerate(rows_of(spark, "pages", "html")):
        for made in html_main.layouts(source, 10_000 + i):
            page = html_main.Page(made)
            inner = [False] * len(page.tag)
            for n in range(1, len(inner)):
                inner[n] = inner[page.parent[n]] if page.truth[n] is None else page.truth[n] == "1"
            kept = html_main.kept_nodes(page, model.logits(html_main.node_features(page)))
            exact += [t for a, t, _ in page.blocks if inner[a]] == [t for a, t, _ in page.blocks if kept[a]]
            total += 1
    assert exact / total > 0.8


#: Pages marked by hand, most of them such that the rule "in an article, in nothing named as boilerplate" gets them wrong.
MARKED = [
    ("<body><div id=nav><a href=/>Home</a> <a href=/n>News</a></div><div class=post-content><h1>A storm came over the bay</h1><p>Rain fell for two days, and the river rose.</p><p>Nobody was hurt, the mayor said, but many cellars are full.</p></div><div class=footer>Copyright 2020</div></body>", "A storm came over the bay\nRain fell for two days, and the river rose.\nNobody was hurt, the mayor said, but many cellars are full."),
    ("<body><main><article><header><h1>On bread</h1></header><p>Flour, water and salt make bread, and time does the rest of it.</p><footer><a href=/t>tags</a></footer></article></main></body>", "On bread\nFlour, water and salt make bread, and time does the rest of it."),
    ("<body><table><tr><td class=menu><a href=/a>a</a><a href=/b>b</a></td><td class=text><p>The old mill stands by the stream, and its wheel still turns.</p><p>It ground corn for the village, until the war came.</p></td></tr></table></body>", "The old mill stands by the stream, and its wheel still turns.\nIt ground corn for the village, until the war came."),
    ("<body><article><p>Three men went up the hill, with a dog and a rope.</p><aside class=related><a href=/x>More hills</a></aside><p>At noon they saw the sea, and sat down to eat.</p></article><section class=comments><article class=comment><p>Nice one!</p></article></section></body>", "Three men went up the hill, with a dog and a rope.\nAt noon they saw the sea, and sat down to eat."),
    ("<head><title>x</title><body><article><p>Short news of the day, told in one sentence, without an end tag.", "Short news of the day, told in one sentence, without an end tag."),
    ("<body><div class=cookie-banner><p>We use cookies. <button>OK</button></p></div><div class=story><p>She opened the letter, read it twice, and burned it.</p><blockquote>There was no other way, she told me.</blockquote></div></body>", "She opened the letter, read it twice, and burned it.\nThere was no other way, she told me."),
    ("<body><nav><ul><li><a href=/1>One</a></ul></nav><form><input name=q><button>Search</button></form></body>", ""),
    ("<body><div class=entry><p>Steps for the repair, in order.</p><ol><li>Take off the lid, and keep the screws.</li><li>Clean the seal with a cloth, then dry it.</li></ol></div><div class=sidebar><ul><li><a href=/p>Popular</a></li></ul></div></body>", "Steps for the repair, in order.\nTake off the lid, and keep the screws.\nClean the seal with a cloth, then dry it."),
]


def test_html_on_pages_marked_by_hand(spark):
    model = html_main.train(spark.read.parquet(f"{SF}/pages.parquet"))
    df = spark.createDataFrame([(i, "u", h) for i, (h, _) in enumerate(MARKED)], "page_id long, url string, html string")
    got = {r.page_id: r.text for r in html_main.extract(df, model).collect()}
    right = [got[i] == want for i, (_, want) in enumerate(MARKED)]
    print("marked by hand:", right)
    assert sum(right) >= 6, [(got[i], w) for i, (_, w) in enumerate(MARKED) if got[i] != w]


def test_html_query(spark):
    """On the given layout the article's blocks are known: all headings and paragraphs between its tags, split by a plain reading."""
    pages = {i: (u, h) for i, u, h in rows_of(spark, "pages", "page_id", "url", "html")}
    got = queries.op10_html(spark, SF).collect()
    assert sorted(r.page_id for r in got) == sorted(pages)
    same = total = 0
    for r in got:
        url, source = pages[r.page_id]
        assert r.url == url and r.n_chars == len(r.text)
        inner = re.search(r"<article[^>]*>(.*?)(?:</article>|<footer|\Z)", source or "", re.S)
        if inner and not re.search(r"<(?:nav|aside|form|section|div|script|style|header|ul|ol|table)", inner[1]):
            blocks = [" ".join(html.unescape(re.sub(r"<!--.*?-->|<(?!br)[^>]*>", "", x.replace("<br>", " "))).split()) for x in re.split(r"</?(?:p|h[1-6]|blockquote|pre|figure|figcaption)\b[^>]*>", inner[1])]
            total += 1
            same += r.text == "\n".join(b for b in blocks if b)
    assert total > 20 and same >= 0.97 * total, (same, total)


def test_html_deep_nesting_is_linear():
    page = html_main.Page("<div>" * 40_000 + "<p>deep</p>")
    assert len(page.tag) == 40_002 and [t for _, t, _ in page.blocks] == ["deep"]


def test_html_decoding_is_consistent():
    page = html_main.Page("<div><p>a</p><div><p>b</p></div></div>")
    logit = np.array([5.0, -9.0, 3.0, 2.0, 4.0])
    kept = html_main.kept_nodes(page, logit)
    assert all(not kept[i] or kept[page.parent[i]] for i in range(1, len(kept)))
    assert html_main.main_text(page, np.full(5, 9.0)) == "a\nb"


def test_html_blocks():
    page = html_main.Page("<html><head><title>t</title></head><body>x &amp; y<!-- no --><ul><li>one<li>two &#65;</ul><p>p1<b>bold<p>p2<br>more</body>")
    assert [t for _, t, _ in page.blocks] == ["x & y", "one", "two A", "p1bold", "p2 more"]


def test_pipeline_equals_brute_force(spark):
    """run() against plain loops over the same texts: weights, shingle sets, words, library."""
    import corpus_pipeline as c

    model = toxicity.train(spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet"))
    texts = {i: t for i, t in rows_of(spark, "documents", "doc_id", "text") if model.score(t) < 0.5}
    sets = {i: simhash.shingle_set(t, 5) for i, t in texts.items()}
    prints = {i: simhash.fingerprint(t, 5) for i, t in texts.items()}
    alike = lambda x, y: (prints[x] ^ prints[y]).bit_count() <= 2 or len(sets[x] & sets[y]) >= 0.8 * len(sets[x] | sets[y])
    texts = {i: texts[i] for i in set(groups_by_force([(i, i) for i in sorted(texts)], alike).values())}
    df = spark.createDataFrame(sorted(texts.items()), "doc_id long, text string")
    for r in line_dedup.repeat_report(df).collect():  # its spans have a brute-force test of their own
        left, at = "", 0
        for a, b in r.spans:
            left += texts[r.doc_id][at:a]
            at = b
        texts[r.doc_id] = left + (texts[r.doc_id] or "")[at:]
    word = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
    low = lambda t: word.findall("".join(chr(ord(x) + 32) if "A" <= x <= "Z" else x for x in t or ""))
    windows = {tuple(w[i : i + 13]) for _, t in rows_of(spark, "benchmark", "item_id", "text") if (w := low(t)) for i in range(max(1, len(w) - 12))}
    library = bpe.TrieBpe(bpe.default_path()).library
    want = []
    for i, t in texts.items():
        words = low(t)
        hit = {k for n in {len(x) for x in windows} for j in range(len(words) - n + 1) if tuple(words[j : j + n]) in windows for k in range(j, j + n)}
        if not (hit and 20 * len(hit) >= len(words)):
            ids = library.encode(t, add_special_tokens=False).ids
            want.append((i, len(ids), hashlib.sha256(struct.pack(f"<{len(ids)}I", *ids)).hexdigest(), hashlib.sha256(library.decode(ids, skip_special_tokens=False).encode()).hexdigest()))
    assert sorted(map(tuple, c.run(spark, SF).collect())) == sorted(want)


def test_pipeline_stages(spark):
    import corpus_pipeline as c

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns = docs.columns
    by_stage = []
    for name, stage in c.STAGES:
        before = {r.doc_id for r in docs.select("doc_id").collect()}
        docs = c.only(lambda: stage(spark, docs, SF))  # noqa: B023
        after = {r.doc_id for r in docs.select("doc_id").collect()}
        assert after <= before
        by_stage.append((name, len(before), len(after)))
        if name != c.STAGES[-1][0]:
            assert docs.columns == columns
    assert by_stage[2][1] == by_stage[2][2] and by_stage[4][1] == by_stage[4][2]
    assert by_stage[0][1] > by_stage[0][2] or by_stage[1][1] > by_stage[1][2]
    whole = c.run(spark, SF).collect()
    assert sorted(map(tuple, whole)) == sorted(map(tuple, docs.collect()))
