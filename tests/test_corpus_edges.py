"""Hand-derived edge cases for the corpus operators."""
from pyspark.sql import functions as F

from corvid.functions import tokens as TK
from corvid.functions.chat import ASSISTANT_MARKER
from corvid.operators import corpus as C
from corvid.operators import formatters as FM
from corvid.operators import quality as Q
from corvid.plans.corpus_build import CorpusSource, build_corpus
from corvid.plans.ordering import global_index, int_bucket

V = TK.DEFAULT_VOCAB
MARKER = TK.encode_py(ASSISTANT_MARKER)


def _labels(spark, ids):
    df = spark.createDataFrame([(ids,)], "ids array<int>")
    return df.select(TK.clamp_labels(TK.assistant_labels(F.col("ids")), V.full_length).alias("l")).first()["l"]


def test_label_mask_first_marker_and_later_turns(spark):
    user2 = [7, 8]
    ids = [1, 2] + MARKER + [10, 11] + [V.im_start_id, 5] + user2 + MARKER + [12]
    lab = _labels(spark, ids)
    k = len(MARKER)
    assert lab[:2 + k] == [-100] * (2 + k)
    assert lab[2 + k:] == ids[2 + k:]          # the second user turn stays in the labels


def test_label_mask_quoted_marker_wins(spark):
    ids = [3] + MARKER + [4] + MARKER + [9]
    lab = _labels(spark, ids)
    assert lab == [-100] * (1 + len(MARKER)) + ids[1 + len(MARKER):]


def test_no_marker_or_short_ids_all_masked(spark):
    assert _labels(spark, [1, 2, 3, 4]) == [-100] * 4
    assert _labels(spark, MARKER[:2]) == [-100, -100]
    assert _labels(spark, []) == []


def test_special_id_above_base_vocab_kept(spark):
    ids = MARKER + [V.im_end_id, V.full_length + 3]
    lab = _labels(spark, ids)
    assert lab[len(MARKER)] == V.im_end_id and lab[-1] == -100


def test_exact_context_length_is_overflow(spark):
    df = spark.createDataFrame([(0, 0, False)], "raw_idx long, sample_idx int, rejected boolean") \
        .withColumn("messages", F.array(F.struct(F.lit("user").alias("role"), F.lit("a b c").alias("content"))))
    t = C.tokenize_and_mask(df, context_length=100, default_system=None).first()
    n = t["n_tokens"]
    exact = C.tokenize_and_mask(df, context_length=n, default_system=None).first()
    assert exact["status"] == C.OVERFLOW
    one_more = C.tokenize_and_mask(df, context_length=n + 1, default_system=None).first()
    assert one_more["status"] == C.MASKED       # no assistant turn -> all labels masked


def test_quality_unknowns_pass(spark):
    vals = ["-1", "nan", "", "x", None, " 0.9 ", "0.5", "1d", "1_0"]
    df = spark.createDataFrame([(v,) for v in vals], "s string")
    got = [r[0] for r in df.select(Q.parse_test_score(F.col("s"))).collect()]
    assert got[0] == -1.0 and got[2] == -1.0 and got[3] == -1.0 and got[4] == -1.0
    assert got[1] != got[1]                     # NaN, and NaN passes
    assert got[5] == 0.9 and got[6] == 0.5 and got[7] == -1.0 and got[8] == 10.0
    ok = [r[0] for r in df.select(Q.passes(Q.parse_test_score(F.col("s")), 0.8)).collect()]
    assert ok == [True, True, True, True, True, True, False, True, True]


def test_judgement_rules(spark):
    cases = {'{"a":{"score":"5"}}': -1.0, '{"a":{"score":4},"b":{"score":5}}': 4.5, '[1,2]': -1.0,
             '{"a":{"score":true},"b":{"score":2}}': 1.5, '{"a":{"x":1}}': -1.0, '{"a":{"score":null}}': -1.0,
             '{"a":{"score":5.0},"n":"z"}': 5.0}
    df = spark.createDataFrame([(k,) for k in cases], "j string")
    got = {r[0]: r[1] for r in df.select("j", Q.parse_judgement(F.col("j"))).collect()}
    assert got == cases
    assert df.select(Q.passes(F.lit(4.5), 4.5)).first()[0] is True


def test_typed_signature_rejected_first_docstring_only(spark):
    rows = [("python", 'def f(x: int):\n    """doc"""\n    return x', "doc"),
            ("python", 'def f(x):\n    """one"""\n    s = """two"""\n', "one"),
            ("java", "/** a */ int f() { /** keep */ }", "a")]
    df = spark.createDataFrame(rows, "language string, func_code_string string, func_documentation_string string")
    out = df.select(FM.fmt_docstring(df).alias("s")).collect()
    assert out[0]["s"] is None
    assert '"""two"""' in out[1]["s"][0][1]["content"] and '"""one"""' not in out[1]["s"][0][1]["content"]
    assert "/** keep */" in out[2]["s"][0][1]["content"] and "/** a */" not in out[2]["s"][0][1]["content"]


def test_fanout_sample_counts(spark):
    rows = [("p", "j", None, None, None), ("p", "j", "c", None, None), ("p", "j", "c", "py", None),
            ("p", "j", "c", "py", "js"), ("p", None, None, None, " "), (" ", "j", None, None, None)]
    df = spark.createDataFrame(rows, "content string, java string, `c++` string, python string, javascript string")
    got = [r[0] for r in df.select(F.size(FM.fmt_fanout(df))).collect()]
    assert got[:4] == [1, 4, 9, 16]
    assert got[4] in (-1, None) and got[5] in (-1, None)


def test_quota_cut_inside_multi_sample_row(spark):
    # row 0 rejected, row 1 has 5 valid samples; n = 2 -> samples 2..4 of row 1 never counted
    rows = [("s", 0, 0, C.REJECTED)] + [("s", 1, i, C.VALID) for i in range(5)] + [("s", 2, 0, C.VALID)]
    df = spark.createDataFrame(rows, "source string, raw_idx long, sample_idx int, status string")
    quota = spark.createDataFrame([("s", 2)], "source string, n long")
    st = C.take_quota(df, quota)
    assert sorted((r.raw_idx, r.sample_idx) for r in st.collect()) == [(0, 0), (1, 0), (1, 1)]
    d = C.collect_diagnostics(st, quota).first()
    assert (d.raw_streamed, d.samples_collected, d.format_rejected, d.exhausted) == (2, 2, 1, False)
    quota5 = spark.createDataFrame([("s", 9)], "source string, n long")
    d5 = C.collect_diagnostics(C.take_quota(df, quota5), quota5).first()
    assert (d5.raw_streamed, d5.samples_collected, d5.exhausted) == (3, 6, True)


def test_short_source_all_eval(spark):
    rows = [(i, f"q{i}", f"a{i}") for i in range(3)]
    df = spark.createDataFrame(rows, "raw_id long, query string, answer string")
    res = build_corpus(spark, [CorpusSource("code_feedback", 1.0, df)], total_samples=100)
    assert res.train.count() == 0 and res.eval.count() == 3      # eval alloc 5 >= n


def test_two_level_rank_matches_row_number(spark):
    from pyspark.sql import Window
    df = spark.range(0, 5000).select((F.col("id") * 7919 % 100003).alias("k"), (F.col("id") % 3).alias("g"))
    want = df.withColumn("r", F.row_number().over(Window.partitionBy("g").orderBy("k")))
    for parts in (1, 64):
        got = global_index(df.repartition(parts), ["k"], int_bucket("k", 97), ["g"], name="r")
        assert sorted(tuple(r) for r in got.select("g", "k", "r").collect()) == \
            sorted(tuple(r) for r in want.select("g", "k", "r").collect())


def test_weights_must_sum_to_one(spark):
    import pytest
    df = spark.createDataFrame([(1, "q", "a")], "raw_id long, query string, answer string")
    with pytest.raises(ValueError):
        build_corpus(spark, [CorpusSource("code_feedback", 0.5, df)], 10)
    with pytest.raises(KeyError):
        build_corpus(spark, [CorpusSource("no_such_loader", 1.0, df)], 10)


def test_quota_of_zero_keeps_nothing_and_is_an_error_in_a_build(spark):
    import pytest
    rows = [("s", i, 0, C.VALID) for i in range(5)]
    df = spark.createDataFrame(rows, "source string, raw_idx long, sample_idx int, status string")
    assert C.take_quota(df, spark.createDataFrame([("s", 0)], "source string, n long")).count() == 0
    raw = spark.createDataFrame([(1, "q", "a")], "raw_id long, query string, answer string")
    with pytest.raises(ValueError):
        build_corpus(spark, [CorpusSource("code_feedback", 0.995, raw), CorpusSource("magicoder_oss", 0.005, raw)], 100)


def test_default_encoder_keeps_white_space():
    text = "def f(x):\n    return  x <|im_end|> y"
    import regex
    assert "".join(regex.findall(TK.PIECE_PATTERN, text)) == text


def test_source_with_zero_samples_is_an_error(spark):
    import pytest
    good = spark.createDataFrame([(i, f"q{i}", f"a{i}") for i in range(5)], "raw_id long, query string, answer string")
    empty = spark.createDataFrame([(i, " ", None) for i in range(5)], "raw_id long, query string, answer string")
    res = build_corpus(spark, [CorpusSource("code_feedback", 0.5, good),
                               CorpusSource("magicoder_oss", 0.5, empty.withColumnRenamed("query", "problem")
                                            .withColumnRenamed("answer", "solution"))], 20)
    with pytest.raises(RuntimeError, match="no valid sample"):
        res.collected
