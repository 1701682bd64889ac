"""Nulls, empty and long texts, ties, repeated rows, empty tables and clashing extra columns, for all ten operators."""

import hashlib

import pytest
from pyspark.sql import functions as F

from locusmill.llm import bpe, chat, decontaminate, html_main, line_dedup, pivots, sharding, simhash, suffix_dedup, toxicity

LONG = "the and attion of one thing or another, again and again. " * 4000
SCHEMA = "doc_id long, text string, key string, crc string, fp string, h int, words string, score string, spans int, lang string, source string, start int, n int, __x int"


def docs(spark, empty=False):
    passage = "a passage of some words that stands in two texts and is long enough to be found by anyone who looks for it. And it goes on with a second sentence, as passages do, so that it has over thirty words in all."
    rows = [(1, "one plain text " + passage), (1, "one plain text " + passage), (2, passage), (3, None), (4, ""), (5, LONG), (None, passage), (None, None), (6, "idiot scum"), (7, "Á ñ 😀 <|endoftext|> K"), (8, " \t\n ")]
    extra = ("k", "c", "f", 1, "w", "s", 2, None, "src", 3, 4, 5)
    return spark.createDataFrame([] if empty else [(*r, *extra) for r in rows], SCHEMA)


BENCH = "item_id long, text string, key string, words int, size int, anchor int"


def bench(spark, rows=()):
    return spark.createDataFrame([(*r, "k", 1, 2, 3) for r in rows], BENCH)


def labels(spark, rows=()):
    return spark.createDataFrame([(*r, "x") for r in rows], "doc_id long, quality int, toxic int, text string")


@pytest.mark.parametrize("empty", [False, True])
def test_row_counts(spark, empty):
    df = docs(spark, empty)
    n = df.count()
    b = bench(spark, [(1, "a passage of some words that stands in two texts and is long enough"), (2, None), (3, ""), (None, "plain"), (1, "again")])
    assert suffix_dedup.remove_repeats(df, outputs="digest").count() == n
    assert suffix_dedup.remove_repeats(df).count() == n
    assert bpe.encode_decode(df).count() == n
    assert line_dedup.repeat_report(df).count() == n
    assert sharding.shard_by_curve(df).count() == n
    assert decontaminate.contamination(df, b).count() == n
    assert decontaminate.contamination(df, bench(spark)).where("n_hit > 0").count() == 0
    assert simhash.near_groups(df).count() == n
    model = toxicity.train(df, labels(spark, [(6, 0, 1), (1, 1, 0), (2, None, None), (None, 1, 1)]))
    assert toxicity.score(df, model).where("score between 0 and 1").count() == n


@pytest.mark.parametrize("empty", [False, True])
def test_filters_keep_the_columns(spark, empty):
    df = docs(spark, empty)
    b = bench(spark, [(1, "a passage of some words that stands in two texts and is long enough")])
    kept = {
        "toxic": toxicity.remove_toxic(df, labels(spark)),
        "near": simhash.near_dedup(df),
        "lines": line_dedup.remove_repeated_units(df),
        "documents": decontaminate.remove_contaminated(df, b),
        "spans": decontaminate.remove_spans(df, b),
    }
    for name, out in kept.items():
        assert out.columns == df.columns, name
        assert out.count() <= df.count()
    if not empty:
        assert kept["toxic"].count() == df.count()  # no labels: nobody is rejected
        texts = {r.doc_id: r.text for r in kept["spans"].collect()}
        assert texts[2].startswith(" to be found") and texts[3] is None and texts[5] == LONG
        assert 2 not in {r.doc_id for r in kept["documents"].collect()}
        assert sorted(r.doc_id for r in kept["near"].where("doc_id in (1, 3, 4, 8)").collect()) == [1, 1, 3]  # 3, 4 and 8 have no words


def test_defined_results(spark):
    df = docs(spark)
    got = suffix_dedup.remove_repeats(df, outputs="digest").collect()
    void = hashlib.sha256(b"").hexdigest()
    by = {}
    for r in got:
        by.setdefault(r.doc_id, []).append(r)
    assert by[1][0] == by[1][1] and by[1][0].n_removed > 150  # the null key's text comes first
    assert by[2][0].n_removed == by[2][0].n_bytes and by[2][0].kept_sha256 == void
    assert by[3][0].n_bytes == by[4][0].n_bytes == 0 and by[3][0].kept_sha256 == void
    assert sorted(r.n_removed for r in by[None]) == [0, 0]
    report = {(r.doc_id, r.n_chars): r for r in line_dedup.repeat_report(df).collect()}
    assert report[2, 205].n_removed > 150 if (2, 205) in report else any(k[0] == 2 and v.n_removed > 150 for k, v in report.items())


def test_chat_edges(spark):
    schema = "conv_id long, turn long, role string, text string, turns string, h string, kept int"
    rows = [(1, 0, "user", "hi"), (1, 1, "assistant", "yes"), (2, 0, "user", "hi"), (3, 5, "user", "hi"), (3, 6, "assistant", "yes"), (3, 7, "user", "more"), (4, 0, None, None), (None, 0, "user", ""), (None, None, "user", "<|end|>"), (5, 0, "user", "hi"), (5, 0, "user", "hi"), (6, 0, None, ""), (7, 0, "user", None)]
    df = spark.createDataFrame([(*r, "x", "y", 1) for r in rows], schema)
    got = {r.conv_id: r for r in chat.collapse_snapshots(df).collect()}
    assert set(got) == {3, 4, None, 6, 7}  # 1, 2 and 5 begin 3; null text and role differ from empty ones
    assert got[3].rendered == "<|user|>\nhi<|end|>\n<|assistant|>\nyes<|end|>\n<|user|>\nmore<|end|>\n"
    assert got[None].rendered == "<|user|>\n< |end|><|end|>\n<|user|>\n<|end|>\n" and got[4].rendered == "<|unknown|>\n<|end|>\n"
    assert chat.collapse_snapshots(df.limit(0)).count() == 0
    same = spark.createDataFrame([(i, t, "user", f"t{t}") for i in range(9) for t in range(3)], "conv_id long, turn long, role string, text string")
    assert [(r.conv_id, r.n_copies, r.n_turns) for r in chat.collapse_snapshots(same).collect()] == [(0, 9, 3)]


def test_vector_edges(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 0.0]), (20, [0.0, 2.0]), (1, [1.0, 0.0]), (1, [1.0, 0.0]), (2, [1.0, 0.0]), (3, None), (40, [0.0, 0.0]), (5, [nan, 1.0]), (6, [inf, 1.0]), (7, [1.0, None]), (8, [1.0]), (None, [3.0, 3.0]), (9, [])]
    df = spark.createDataFrame([(*r, 1, "s") for r in rows], "vec_id long, embedding array<float>, id int, score string")
    got = [tuple(r) for r in pivots.search(df, F.col("id") % 20 == 0).orderBy("query_id", "rank").collect()]
    assert got == [(0, 1, 1, 1.0), (0, 2, 1, 1.0), (0, 3, 2, 1.0), (0, 4, 20, 0.0), (20, 1, 0, 0.0), (20, 2, 1, 0.0), (20, 3, 1, 0.0), (20, 4, 2, 0.0)]
    assert pivots.search(df.limit(0), F.col("id") % 20 == 0).count() == 0


def test_page_edges(spark):
    rows = [(1, "u", None), (2, "u", ""), (None, None, "<p>a&nbsp;&amp; b<br>c"), (4, "u", "<<<>>> & text < 3"), (5, "u", "<script>x"), (5, "u", "<script>x"), (6, "u", "<p><b>" * 500 + "deep")]
    df = spark.createDataFrame([(*r, "t", 5) for r in rows], "page_id long, url string, html string, text string, n_chars int")
    model = html_main.train(df.limit(0))
    got = html_main.extract(df, model).collect()
    assert len(got) == 7 and all(r.text is not None and r.n_chars == len(r.text) for r in got)
    assert {r.page_id: r.text for r in got}[1] == ""
    assert html_main.extract(df.limit(0), model).count() == 0


def test_pipeline_edges(spark):
    import corpus_pipeline

    for name, stage in corpus_pipeline.STAGES[1:3] + corpus_pipeline.STAGES[4:]:
        for empty in (False, True):
            out = stage(spark, docs(spark, empty), "")
            assert out.count() <= docs(spark, empty).count(), name
            if name != "bpe":
                assert out.columns == docs(spark).columns
    near = corpus_pipeline.drop_near_copies(spark, docs(spark), "").collect()
    assert sum(r.text is None or not r.text.split() for r in near) == 1  # documents without words are one group


@pytest.mark.parametrize("empty", [False, True])
def test_whole_pipeline_edges(spark, tmp_path, empty):
    """All stages and run() on nulls, repeated rows, empty and odd texts, clashing columns, and empty tables."""
    import corpus_pipeline

    docs(spark, empty).write.parquet(f"{tmp_path}/documents.parquet")
    labels(spark, [] if empty else [(6, 0, 1), (1, 1, 0), (2, None, None), (None, 1, 1), (5, 1, 0)]).write.parquet(f"{tmp_path}/labels.parquet")
    bench(spark, [] if empty else [(1, "a passage of some words that stands in two texts and is long enough"), (2, None)]).write.parquet(f"{tmp_path}/benchmark.parquet")
    have = docs(spark, empty)
    for name, stage in corpus_pipeline.STAGES:
        have = stage(spark, have, str(tmp_path))
        if name != "bpe":
            assert have.columns == docs(spark).columns, name
    staged = sorted(map(str, have.collect()))
    assert sorted(map(str, corpus_pipeline.run(spark, str(tmp_path)).collect())) == staged
    assert bool(staged) != empty


def test_chat_with_many_rows_of_null_conversation(spark):
    df = spark.range(3000).select(F.lit(None).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.lit("user").alias("role"), F.concat(F.lit("t"), "id").alias("text"))
    got = chat.collapse_snapshots(df).collect()
    assert len(got) == 1 and got[0].n_turns == 3000
