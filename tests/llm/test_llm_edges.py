"""Nulls, empty and long texts, ties, repeated rows, empty tables and clashing columns."""
import brute
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from corvid.llm import decontaminate, exactdup, html_text, linededup, lmscore, pack, simhash, tokencount, toxicity, warc

DOC = "doc_id long, text string"
ODD = [(1, None), (2, ""), (3, " \n\t "), (None, "lone words here"), (None, None), (5, "same text twice"), (5, "same text twice"),
       (6, "same text twice"), (7, "word " * 60_000), (8, "x" * 100_000), (9, "日本語   é")]
#: columns that operators use for results
CLASH = ["n_words", "n_hit", "n_items", "item_ids", "contaminated", "n_lines", "n_exact", "n_near", "p_toxic",
         "fingerprint", "component_id", "kept", "keep_id", "rid", "states", "lh", "n_bytes", "n_tokens", "over_limit", "_row", "score"]
PAGES = "page_id long, url string, html string"
CHAIN = toxicity.Chain(["low_quality", "toxic"], ["=idiot"], [__import__("numpy").array([0.0, -3.0]), __import__("numpy").array([9.0, 0.0, -4.0])])


def operators(spark):
    items = spark.createDataFrame([(1, "same text twice"), (2, None), (None, "lone words here")], "item_id long, text string")
    return {
        "toxicity": lambda d: toxicity.score(d, CHAIN),
        "decontaminate": lambda d: decontaminate.mark_contamination(d, items),
        "pack": lambda d: pack.pack(d),
        "lm": lambda d: lmscore.score_documents(d),
        "simhash": lambda d: simhash.near_groups(d),
        "exact": lambda d: exactdup.exact_groups(d),
        "tokens": lambda d: tokencount.count_tokens(d),
        "lines": lambda d: linededup.dedup_lines(d, chars_per_edit=linededup.CHARS_PER_EDIT),
    }


NAMES = ["toxicity", "decontaminate", "pack", "lm", "simhash", "exact", "tokens", "lines"]


@pytest.mark.parametrize("name", NAMES)
def test_odd_rows_and_clashing_columns(spark, name):
    op = operators(spark)[name]
    plain = spark.createDataFrame(ODD, DOC)
    clash = plain.select("*", *[F.lit("theirs").alias(c) for c in CLASH])
    a = op(plain)
    out = a.columns
    want, got = (sorted(map(repr, (tuple(r) for r in x.select(*out).collect()))) for x in (a, op(clash)))
    assert want == got
    if name != "pack":
        assert len(want) == len(ODD)


@pytest.mark.parametrize("name", NAMES)
def test_empty_table(spark, name):
    assert operators(spark)[name](spark.createDataFrame([], DOC)).count() == 0


def test_empty_benchmark_and_labels(spark):
    docs = spark.createDataFrame(ODD, DOC)
    none = spark.createDataFrame([], "item_id long, text string")
    assert {r.contaminated for r in decontaminate.mark_contamination(docs, none).collect()} == {False}
    chain = toxicity.corpus_chain(docs, spark.createDataFrame([], "doc_id long, quality int, toxic int"))
    assert all(r.p_toxic < 0.5 for r in toxicity.score(docs, chain).collect())
    half = spark.createDataFrame([(5, None, 1), (9, 1, None), (99, 0, 1), (None, 1, 1)], "doc_id long, quality int, toxic int")
    assert toxicity.score(docs, toxicity.corpus_chain(docs, half)).count() == len(ODD)


def test_pages(spark):
    rows = [(1, "u", None), (2, None, ""), (None, "u", "<p>words of a page</p>"), (4, "u", "<p>words of a page</p>" * 2),
            (4, "u", "<p>words of a page</p>" * 2), (5, "u", "<" * 50_000), (6, "u", "<p " * 20_000), (7, "u", "<p>long " * 50_000)]
    pages = spark.createDataFrame(rows, PAGES)
    clash = pages.select("*", F.lit("theirs").alias("text"), F.lit(1).alias("n_chars"), F.lit(2).alias("payload_bytes"), F.lit(3).alias("refers_to"))
    for p in (pages, clash):
        got = html_text.main_text(p).select("page_id", "text", "n_chars").collect()
        by = {r.page_id: r.text for r in got}
        assert len(got) == len(rows) and by[1] == by[2] == "" and by[None] == "words of a page"
        back = warc.archive_digest(p).collect()
        assert len(back) == len(rows) and all(r.record_type == "response" for r in back)
    none = spark.createDataFrame([], PAGES)
    assert html_text.main_text(none).count() == 0 and warc.archive_digest(none).count() == 0


def test_hot_groups_are_whole(spark):
    """A third of all rows in one group of copies."""
    rows = [(i, "the same line of a hot passage here\nand another one of some length" if i % 3 == 0 else f"text number {i} is its own line of words") for i in range(600)]
    df = spark.createDataFrame(rows, DOC)
    got = {r.doc_id: r for r in exactdup.exact_groups(df, keep="largest").collect()}
    assert all(got[i].keep_id == 597 and got[i].group_size == 200 for i in range(0, 600, 3))
    near = {r.doc_id: r.component_id for r in simhash.near_groups(df).collect()}
    assert {near[i] for i in range(0, 600, 3)} == {0}
    lines = {r.doc_id: r.text for r in linededup.dedup_lines(df).collect()}
    assert lines[0] and not any(lines[i] for i in range(3, 600, 3))


def stage(name):
    return dict(corpus_pipeline.STAGES)[name]


def test_pipeline_stages_take_odd_rows(spark, tmp_path):
    spark.createDataFrame([(5, 1, 0), (6, 0, 1)], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    spark.createDataFrame([(1, "same text twice")], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    docs = spark.createDataFrame(ODD, DOC).select("*", F.lit("en").alias("lang"), F.lit("s").alias("source"), F.lit(3).cast("long").alias("n_chars"),
                                                 *[F.lit("theirs").alias(c) for c in CLASH])
    for name, f in corpus_pipeline.STAGES:
        out = f(spark, docs, str(tmp_path))
        got = out.collect()
        empty = f(spark, docs.limit(0), str(tmp_path)).count()
        assert empty == 0
        if name != "best_fit_packing":
            assert out.columns == docs.columns and all(r.states == "theirs" for r in got)


def test_pipeline_decisions(spark, tmp_path):
    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    texts = {r.doc_id: r.text for r in docs.collect()}
    # line dedup keeps every row, and each line stays where it is first
    out = {r.doc_id: r for r in stage("line_dedup")(spark, docs, sf).collect()}
    want = brute.near_lines(list(texts.items()), per=linededup.CHARS_PER_EDIT)
    assert {d: r.text for d, r in out.items()} == {d: w[3] for d, w in want.items()}
    assert all(r.n_chars == len(r.text) for r in out.values())
    # near-dedup leaves the smallest id of each component
    groups = brute.simhash_groups(list(texts.items()))
    kept = {r.doc_id for r in stage("simhash_near_dedup")(spark, docs, sf).collect()}
    assert kept == {c for _, _, c in groups}
    # decontamination drops exactly the hit documents
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    clean = {r[0] for r in brute.contamination(list(texts.items()), items) if not r[5]}
    assert {r.doc_id for r in stage("benchmark_decontamination")(spark, docs, sf).collect()} == clean
    # toxicity leaves clean documents alone
    left = {r.doc_id for r in stage("toxicity")(spark, docs, sf).collect()}
    assert left <= set(texts) and len(left) >= 0.85 * len(texts)


def test_near_dedup_leaves_one_of_repeated_rows(spark):
    docs = spark.createDataFrame([(1, "a b c d"), (1, "a b c d"), (2, "a b c d"), (3, "other words of another text"), (3, "x y z")], DOC)
    got = sorted(tuple(r) for r in stage("simhash_near_dedup")(spark, docs, "").collect())
    assert got == [(1, "a b c d"), (3, "other words of another text"), (3, "x y z")]
    # a component without ids, and two texts with one id in one component, leave one row each
    long = "one two three four five six seven eight nine ten " * 30
    docs = spark.createDataFrame([(None, "a b c d"), (None, "a b c d"), (None, "A b c d"), (7, long), (7, long.upper()), (None, long)], DOC)
    left = [tuple(r) for r in stage("simhash_near_dedup")(spark, docs, "").collect()]
    assert [i for i, t in left if t.lower() == long] == [7] and [i for i, t in left if t.lower() == "a b c d"] == [None] and len(left) == 2


def test_pipeline_runs_end_to_end(spark):
    sf = "/root/testdata/sf0.001"
    got = corpus_pipeline.run(spark, sf).collect()
    assert got and {r.length <= 2048 for r in got} == {True}
    n = spark.read.parquet(f"{sf}/documents.parquet").count()
    assert len({r.doc_id for r in got}) >= 0.6 * n
