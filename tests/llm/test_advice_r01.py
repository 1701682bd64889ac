"""Cases of the first review: each failed before its fix."""

import random

import corpus_pipeline
from locusmill.llm import decontaminate, html_main, line_dedup, suffix_dedup

PASSAGE = " ".join(f"word{i} of a passage that nobody else holds," for i in range(12)) + " and so it ends."


def test_repeated_rows_keep_their_text(spark):
    rows = [(1, PASSAGE)] * 4 + [(2, PASSAGE[:200] + " but then goes on")] + [(None, "null keys: " + PASSAGE[::-1])] * 2
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    by = {}
    for r in suffix_dedup.remove_repeats(df, outputs="digest").collect():
        by.setdefault(r.doc_id, []).append(r.n_removed)
    assert by == {1: [0] * 4, 2: [200], None: [0, 0]}
    kept = {}
    for r in line_dedup.remove_repeated_units(df).collect():
        kept.setdefault(r.doc_id, []).append(r.text)
    assert kept[1] == [PASSAGE] * 4 and kept[None] == ["null keys: " + PASSAGE[::-1]] * 2
    assert {r.n_removed for r in line_dedup.repeat_report(df).where("doc_id = 1 or doc_id is null").collect()} == {0}


def test_repeated_rows_of_wide_names(spark, monkeypatch):
    monkeypatch.setattr(suffix_dedup, "GROUP", 2)
    monkeypatch.setattr(suffix_dedup, "BLOCK", 700)
    rows = [(i, f"{i} " * 60 + PASSAGE[: 150 + 10 * i]) for i in range(6)]
    want = {r.doc_id: r.n_removed for r in suffix_dedup.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string"), outputs="digest").collect()}
    got = suffix_dedup.remove_repeats(spark.createDataFrame(rows * 3, "doc_id long, text string").repartition(4), outputs="digest").collect()
    assert len(got) == 18 and all(r.n_removed == want[r.doc_id] for r in got)


def test_decontamination_judges_each_text(spark):
    item = "one two three four five six seven eight nine ten eleven twelve thirteen"
    bench = spark.createDataFrame([(1, item)], "item_id long, text string")
    rows = [(None, item), (None, "clean without an id"), (None, None), (7, f"so {item} it is"), (7, "clean under the same id"), (8, "clean")]
    got = decontaminate.remove_contaminated(spark.createDataFrame(rows, "doc_id long, text string"), bench).collect()
    assert sorted((r.doc_id or 0, r.text or "") for r in got) == [(0, ""), (0, "clean without an id"), (7, "clean under the same id"), (8, "clean")]


def test_html_head_without_end_and_formulas():
    page = html_main.Page("<html><head><title>t</title><meta charset=utf-8><style>p {}</style><body><article><p>Area <math><mi>a</mi><mo>=</mo><msup><mi>r</mi><mn>2</mn></msup><annotation>a=r^2</annotation></math> of it.<p><object data=x>See the plan.</object></article>")
    assert [t for _, t, _ in page.blocks] == ["Area a=r2 of it.", "See the plan."]
    page = html_main.Page("<head><title>t</title><script>x</script><article>Text</article>")
    assert [t for _, t, _ in page.blocks] == ["Text"]


def test_html_training_cuts_no_page(spark, monkeypatch):
    monkeypatch.setattr(html_main, "TRAIN_CHARS", 400, raising=False)
    page = "<article>" + "<p>A plain sentence, of some words, stands here.</p>" * 3 + "</article><nav>menu</nav>"
    short = spark.createDataFrame([(page,)], "html string")
    both = spark.createDataFrame([(page,), ("<nav>" + "menu and more " * 20_000,)], "html string")
    a, b = html_main.train(short), html_main.train(both)
    assert a.base == b.base and (a.leaf == b.leaf).all()


def test_stage_cuts_every_passage_of_over_fifty_words(spark):
    rows, passages = [], {}
    for seed in range(60):
        rng = random.Random(seed)
        end = rng.choice(["! ", ". ", "\n", " ", ",\n\n"])
        every = rng.choice([1, 3, 6, 11])
        word = lambda: "".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 8)))  # noqa: B023, E731
        prose = lambda n: "".join(word() + (end if i % every == every - 1 else " ") for i in range(n))  # noqa: B023, E731
        passage = prose(51).strip()
        passages[seed] = passage.split()
        rows += [(3 * seed + i, f"{prose(rng.randint(0, 40))} {passage} {prose(rng.randint(0, 40))}") for i in range(2)]
        rows.append((3 * seed + 2, prose(80)))
    source = dict(rows)
    got = {r.doc_id: r.text for r in corpus_pipeline.cut_repeats(spark, spark.createDataFrame(rows, "doc_id long, text string").repartition(3), "").collect()}
    for i, text in got.items():
        if i % 3 == 1:
            left = set(passages[i // 3]) & set(text.split())
            assert len(left) <= 2 * (line_dedup.PLACES - 1), (i, len(left))
        else:
            assert text == source[i]
