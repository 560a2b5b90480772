"""Registered corpus queries (S1, F1-F9, Q1-Q3, P1-P19) over driver-derived views."""
from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import tokens as TK
from ..functions.chat import ASSISTANT_MARKER, messages, render_chat
from ..operators import corpus as C
from ..operators import formatters as FM
from ..operators import quality as Q
from ..sources.fixtures import register_views, view
from ..sources.tables import read_table
from . import duck as D
from ..session import ensure_checkpoint_dir
from ..sources.registry import register_table_function
from .corpus_build import CorpusSource, build_corpus, write_corpus
from .registry import register

CTX = 512            # context length of the fixture runs (the reference smoke-test setting)
# the mix asks for as many samples as there are turn pairs, so it grows with the tables
D_TOTAL = "(SELECT count(*) FROM v_pairs)"
# The three-source fixture mix (weights 0.55 / 0.28 / 0.17).
MIX = (("opencode_instruct", 0.55, "v_scored"), ("codealpaca", 0.28, "v_alpaca"),
       ("code_feedback", 0.17, "v_query_answer"))
MIX_VIEWS = tuple(v for _, _, v in MIX)


# ------------------------------------------------------------------ helpers
def _msg_rows(df: DataFrame, key: str, samples: Column = None) -> DataFrame:
    x = df.select(key, F.posexplode_outer(samples).alias("sample_idx", "_msgs"))
    y = x.select(key, "sample_idx", F.posexplode_outer("_msgs").alias("msg_idx", "_m"))
    return y.select(key, F.col("sample_idx").cast("bigint").alias("sample_idx"),
                    F.col("msg_idx").cast("bigint").alias("msg_idx"),
                    F.col("_m.role").alias("role"), F.col("_m.content").alias("content"))


def _d_msg_rows(src: str, key: str, samples_sql: str) -> str:
    return f"""
s AS (SELECT {key}, {samples_sql} AS samples FROM {src}),
x AS (SELECT {key}, generate_subscripts(samples, 1) - 1 AS sample_idx, unnest(samples) AS msgs FROM s
      WHERE samples IS NOT NULL AND len(samples) > 0),
y AS (SELECT {key}, sample_idx, generate_subscripts(msgs, 1) - 1 AS msg_idx, unnest(msgs) AS m FROM x)
SELECT {key}, sample_idx, msg_idx, m.role AS role, m.content AS content FROM y
UNION ALL SELECT {key}, NULL, NULL, NULL, NULL FROM s WHERE samples IS NULL OR len(samples) = 0"""


def _single(*pairs) -> str:
    return "[[" + ", ".join(D.msg(r, c) for r, c in pairs) + "]]"


S = D.strip
BN = D.blank_null

D_ALPACA = (f"CASE WHEN instruction IS NOT NULL AND input IS NOT NULL AND output IS NOT NULL THEN "
            + _single(("user", f"CASE WHEN {S('input')} <> '' THEN {S('instruction')} || chr(10) || chr(10) || "
                               f"{S('input')} ELSE {S('instruction')} END"), ("assistant", S("output"))) + " END")
D_PROMPT_CUT = (f"CASE WHEN prompt IS NOT NULL AND output IS NOT NULL THEN "
                + _single(("user", f"CASE WHEN instr(prompt, '### Output:') > 0 THEN "
                                   f"{S('substring(prompt, 1, instr(prompt, ' + D.q('### Output:') + ') - 1)')} "
                                   f"ELSE prompt END"), ("assistant", S("output"))) + " END")


def _d_both(a, b):
    return f"CASE WHEN {BN(a)} IS NOT NULL AND {BN(b)} IS NOT NULL THEN " + _single(
        ("user", BN(a)), ("assistant", BN(b))) + " END"


D_CONTEST = ("CASE WHEN coalesce(solution_type = 'CORRECT' AND programming_language IN ('cpp', 'java', 'python3'), false) "
             "AND description IS NOT NULL AND solution IS NOT NULL THEN "
             + _single(("user", S("description")),
                       ("assistant", f"'# Language: ' || programming_language || chr(10) || chr(10) || {S('solution')}"))
             + " END")

D_TEST_SCORE = ("CASE WHEN average_test_score IS NULL OR average_test_score = '' THEN -1.0 "
                "ELSE coalesce(TRY_CAST(average_test_score AS DOUBLE), -1.0) END")
# the view's one text with a repeated key, as the last one leaves it
_J = """replace(llm_judgement, '"a":{"score":1},"a"', '"a"')"""
_JJ = f"(CASE WHEN llm_judgement <> '' AND json_valid({_J}) AND json_type({_J}) = 'OBJECT' THEN {_J} ELSE '{{}}' END)"
D_JUDGEMENT = f"""CASE WHEN json_type({_JJ.replace("ELSE '{}'", "ELSE NULL")}) IS DISTINCT FROM 'OBJECT' THEN -1.0
 ELSE coalesce((SELECT CASE WHEN bool_or(json_type(v, '$.score') NOT IN ('BIGINT', 'UBIGINT', 'DOUBLE', 'BOOLEAN'))
      THEN -1.0 ELSE avg(CAST(json_extract(v, '$.score') AS DOUBLE)) END
   FROM (SELECT json_extract({_JJ}, '$."' || k || '"') AS v FROM unnest(json_keys({_JJ})) t(k))
   WHERE json_type(v) = 'OBJECT' AND json_exists(v, '$.score')), -1.0) END"""


def _d_pass(score, minimum):
    return f"NOT coalesce(({score}) >= 0 AND ({score}) < {minimum}, false)"


D_SCORED = (f"CASE WHEN {BN('input')} IS NOT NULL AND {BN('output')} IS NOT NULL AND {_d_pass(D_TEST_SCORE, 0.8)} "
            f"AND {_d_pass(D_JUDGEMENT, 4.5)} THEN " + _single(("user", BN("input")), ("assistant", BN("output"))) + " END")

# docstring: the fixture's code is ASCII, where RE2's \w and \s agree with Python's
_D_LANG = S("lower(coalesce(language, ''))")
_D_CODE = BN("func_code_string")
_D_PY_RE = r"(def\s+\w+[^:]*:[ \t]*\n)([ \t]*)(\"\"\"[\s\S]*?\"\"\"|'''[\s\S]*?''')"
_D_JD_RE = r"/\*\*[\s\S]*?\*/"
_D_STRIPPED = (f"CASE WHEN {_D_LANG} = 'python' THEN CASE WHEN regexp_matches({_D_CODE}, {D.q(_D_PY_RE)}) THEN "
               f"{S('regexp_replace(' + _D_CODE + ', ' + D.q(_D_PY_RE) + ', ' + D.q(chr(92) + '1') + ')')} END "
               f"ELSE CASE WHEN regexp_matches({_D_CODE}, {D.q(_D_JD_RE)}) THEN "
               f"{S('regexp_replace(' + _D_CODE + ', ' + D.q(_D_JD_RE) + ', ' + D.q('') + ')')} END END")
D_DOCSTRING = (f"CASE WHEN {_D_LANG} IN ('python', 'java', 'javascript') AND {_D_CODE} IS NOT NULL "
               f"AND {BN('func_documentation_string')} IS NOT NULL AND ({_D_STRIPPED}) IS NOT NULL THEN "
               + _single(("system", D.q(FM.DOCSTRING_SYSTEM)),
                         ("user", f"'Write a docstring for the following ' || {_D_LANG} || ' function:' || chr(10) || "
                                  f"chr(10) || '```' || {_D_LANG} || chr(10) || ({_D_STRIPPED}) || chr(10) || '```'"),
                         ("assistant", BN("func_documentation_string"))) + " END")

_D_SOLS = ("list_filter([" + ", ".join(
    f"{{'display': {D.q(d)}, 'code': {BN(chr(34) + c + chr(34))}}}" for c, d in FM.FANOUT_LANGUAGES)
    + "], lambda s: s.code IS NOT NULL)")
D_FANOUT = (f"CASE WHEN {BN('content')} IS NOT NULL AND len({_D_SOLS}) > 0 THEN list_concat("
            f"list_transform({_D_SOLS}, lambda s: [{D.msg('user', chr(39) + 'Solve the following coding problem in ' + chr(39) + ' || s.display || ' + chr(39) + ':' + chr(39) + ' || chr(10) || chr(10) || ' + BN('content'))}, "
            f"{D.msg('assistant', 's.code')}]), "
            f"flatten(list_transform(list_transform({_D_SOLS}, lambda s, j: {{'display': s.display, 'code': s.code, 'j': j}}), "
            f"lambda a: list_transform(list_filter(list_transform({_D_SOLS}, lambda s, j: {{'display': s.display, 'code': s.code, 'j': j}}), "
            f"lambda b: b.j <> a.j), lambda b: [{D.msg('user', chr(39) + 'Convert the following ' + chr(39) + ' || a.display || ' + chr(39) + ' solution to ' + chr(39) + ' || b.display || ' + chr(39) + ':' + chr(39) + ' || chr(10) || chr(10) || a.code')}, "
            f"{D.msg('assistant', 'b.code')}])))) END")

D_BIDIR = (f"CASE WHEN {BN('answer')} IS NOT NULL AND {BN('question')} IS NOT NULL AND {BN('context')} IS NOT NULL THEN ["
           f"[{D.msg('system', D.q(FM.SQL_SYSTEM_NL_TO_SQL))}, {D.msg('user', BN('context') + ' || chr(10) || chr(10) || ' + BN('question'))}, {D.msg('assistant', BN('answer'))}], "
           f"[{D.msg('system', D.q(FM.SQL_SYSTEM_SQL_TO_NL))}, {D.msg('user', BN('context') + ' || chr(10) || chr(10) || ' + BN('answer'))}, {D.msg('assistant', BN('question'))}]] END")

FORMAT_CASES = {
    # key: (formatter, view, key column, duckdb samples expression)
    "fmt_alpaca": (FM.fmt_alpaca, "v_alpaca", "raw_id", D_ALPACA),
    "fmt_prompt_cut": (FM.fmt_prompt_cut, "v_prompt_cut", "raw_id", D_PROMPT_CUT),
    "fmt_query_answer": (FM.fmt_query_answer, "v_query_answer", "raw_id", _d_both("query", "answer")),
    "fmt_problem_solution": (FM.fmt_problem_solution, "v_problem_solution", "raw_id", _d_both("problem", "solution")),
    "fmt_contest": (FM.fmt_contest, "v_contest", "raw_id", D_CONTEST),
    "fmt_scored": (FM.fmt_scored, "v_scored", "raw_id", D_SCORED),
    "fmt_docstring": (FM.fmt_docstring, "v_code", "doc_id", D_DOCSTRING),
    "fmt_fanout": (FM.fmt_fanout, "v_lang4", "doc_id", D_FANOUT),
    "fmt_bidirectional": (FM.fmt_bidirectional, "v_schema_q", "raw_id", D_BIDIR),
}


def _fmt_query(fn, vname, key):
    def q(spark, sf):
        df = view(spark, sf, vname)
        return _msg_rows(df, key, fn(df))
    return q


for _k, (_fn, _v, _key, _dsql) in FORMAT_CASES.items():
    register(_k, (_v,), "WITH " + _d_msg_rows(_v, _key, _dsql).strip())(_fmt_query(_fn, _v, _key))


# ------------------------------------------------------------------ Q1 - Q3
@register("parse_test_score", ("v_scored",), f"""
SELECT raw_id, average_test_score AS raw, {D_TEST_SCORE} AS test_score FROM v_scored""")
def q_test_score(spark, sf):
    v = view(spark, sf, "v_scored")
    return v.select("raw_id", F.col("average_test_score").alias("raw"),
                    Q.parse_test_score(F.col("average_test_score")).alias("test_score"))


@register("parse_judgement", ("v_scored",), f"""
SELECT raw_id, round({D_JUDGEMENT}, 6) AS llm_score FROM v_scored""")
def q_judgement(spark, sf):
    v = view(spark, sf, "v_scored")
    return v.select("raw_id", F.round(Q.parse_judgement(F.col("llm_judgement")), 6).alias("llm_score"))


@register("quality_filter", ("v_scored",), f"""
SELECT raw_id, {_d_pass(D_TEST_SCORE, 0.8)} AS test_ok, {_d_pass(D_JUDGEMENT, 4.5)} AS judge_ok FROM v_scored""")
def q_quality(spark, sf):
    v = view(spark, sf, "v_scored")
    return v.select("raw_id", Q.passes(Q.parse_test_score(F.col("average_test_score")), 0.8).alias("test_ok"),
                    Q.passes(Q.parse_judgement(F.col("llm_judgement")), 4.5).alias("judge_ok"))


# ------------------------------------------------------------------ S1 / P1
@register("scan_source", (), """
SELECT conv_id, turn, row_number() OVER (ORDER BY conv_id, turn) - 1 AS raw_idx, length(text) AS n_chars
FROM conversations""")
def q_scan(spark, sf):
    from ..sources.registry import scan_source
    from pyspark.sql import types as T
    schema = T.StructType([T.StructField("conv_id", T.LongType()), T.StructField("turn", T.LongType()),
                           T.StructField("role", T.StringType()), T.StructField("text", T.StringType())])
    df = scan_source(spark, f"{sf}/conversations.parquet", "parquet", schema)
    df = df.withColumn("_k", F.col("conv_id") * 1_000_003 + F.col("turn"))
    out = C.with_raw_index(df, "_k")
    return out.select("conv_id", "turn", "raw_idx", F.length("text").cast("bigint").alias("n_chars"))


@register("explode_samples", ("v_lang4",), f"""
WITH s AS (SELECT doc_id, {D_FANOUT} AS samples FROM v_lang4)
SELECT doc_id, generate_subscripts(samples, 1) - 1 AS sample_idx, len(unnest(samples)) AS n_messages, false AS rejected
FROM s WHERE samples IS NOT NULL
UNION ALL SELECT doc_id, 0, NULL, true FROM s WHERE samples IS NULL""")
def q_explode(spark, sf):
    v = view(spark, sf, "v_lang4")
    ex = C.explode_samples(v.select("doc_id", FM.fmt_fanout(v).alias("samples")), keep=("doc_id",))
    return ex.select("doc_id", F.col("sample_idx").cast("bigint").alias("sample_idx"),
                     F.size("messages").cast("bigint").alias("n_messages"), "rejected")


# ------------------------------------------------------------------ P2 - P7 on the alpaca view
def _alpaca_samples(spark, sf):
    v = view(spark, sf, "v_alpaca")
    ex = C.explode_samples(v.select("raw_id", FM.fmt_alpaca(v).alias("samples")), keep=("raw_id",))
    return ex.filter(~F.col("rejected"))


D_ALPACA_SAMPLES = f"""
s AS (SELECT raw_id, {D_ALPACA} AS samples FROM v_alpaca),
x AS (SELECT raw_id, generate_subscripts(samples, 1) - 1 AS sample_idx, unnest(samples) AS messages FROM s
      WHERE samples IS NOT NULL),
r AS (SELECT *, {D.render('messages')} AS text FROM x),
e AS (SELECT *, {D.encode('text')} AS ids_full FROM r),
e2 AS (SELECT *, len(ids_full) AS n_tokens, CASE WHEN len(ids_full) < {CTX} THEN ids_full END AS input_ids FROM e),
m AS (SELECT *, {D.marker_pos('input_ids')} AS mpos FROM e2),
lb AS (SELECT *, {D.labels('input_ids', 'mpos')} AS labels FROM m)"""


@register("chat_template", ("v_alpaca",), "WITH " + D_ALPACA_SAMPLES.strip() + """
SELECT raw_id, sample_idx, text FROM r""")
def q_template(spark, sf):
    s = _alpaca_samples(spark, sf)
    return s.select("raw_id", F.col("sample_idx").cast("bigint").alias("sample_idx"),
                    render_chat(F.col("messages")).alias("text"))


@register("build_prompt", ("v_alpaca",), f"""
WITH s AS (SELECT raw_id, [{D.msg('system', D.q(FM.DOCSTRING_SYSTEM))}, {D.msg('user', 'instruction')}] AS msgs FROM v_alpaca)
SELECT raw_id, {D.render('msgs', True)} AS prompt FROM s""")
def q_build_prompt(spark, sf):
    v = view(spark, sf, "v_alpaca")
    m = messages(("system", F.lit(FM.DOCSTRING_SYSTEM)), ("user", F.col("instruction")))
    return v.select("raw_id", render_chat(m, add_generation_prompt=True).alias("prompt"))


def _tok(spark, sf):
    s = _alpaca_samples(spark, sf)
    return C.tokenize_and_mask(s, CTX)


@register("encode_tokens", ("v_alpaca",), "WITH " + D_ALPACA_SAMPLES.strip() + """
SELECT raw_id, sample_idx, n_tokens, md5(array_to_string(ids_full, ',')) AS ids_md5 FROM e2""")
def q_encode(spark, sf):
    s = _alpaca_samples(spark, sf)
    ids = TK.encode(render_chat(F.col("messages")))
    return s.select("raw_id", F.col("sample_idx").cast("bigint").alias("sample_idx"),
                    F.size(ids).cast("bigint").alias("n_tokens"),
                    F.md5(F.array_join(ids, ",")).alias("ids_md5"))


@register("drop_overflow", ("v_alpaca",), "WITH " + D_ALPACA_SAMPLES.strip() + f"""
SELECT raw_id, sample_idx, n_tokens FROM e2 WHERE n_tokens < {CTX}""")
def q_overflow(spark, sf):
    t = _tok(spark, sf).filter(F.col("input_ids").isNotNull())
    return C.drop_overflow(t, CTX).select("raw_id", F.col("sample_idx").cast("bigint").alias("sample_idx"),
                                          F.col("n_tokens").cast("bigint").alias("n_tokens"))


@register("label_mask", ("v_alpaca",), "WITH " + D_ALPACA_SAMPLES.strip() + """
SELECT raw_id, sample_idx, mpos AS marker_pos, len(list_filter(labels, lambda l: l <> -100)) AS n_label_tokens,
 md5(array_to_string(labels, ',')) AS labels_md5 FROM lb WHERE input_ids IS NOT NULL""")
def q_label_mask(spark, sf):
    t = _tok(spark, sf).filter(F.col("input_ids").isNotNull())
    marker = TK.encode_literal(ASSISTANT_MARKER)
    return t.select("raw_id", F.col("sample_idx").cast("bigint").alias("sample_idx"),
                    TK.marker_position(F.col("input_ids"), marker).cast("bigint").alias("marker_pos"),
                    TK.n_label_tokens(F.col("labels")).cast("bigint").alias("n_label_tokens"),
                    F.md5(F.array_join("labels", ",")).alias("labels_md5"))


@register("clamp_labels", ("v_alpaca",), "WITH " + D_ALPACA_SAMPLES.strip() + """
SELECT raw_id, sample_idx,
 len(list_filter(list_transform(labels, lambda l: CASE WHEN l = -100 OR (l >= 0 AND l < 100000) THEN l ELSE -100 END),
     lambda l: l <> -100)) AS n_kept FROM lb WHERE input_ids IS NOT NULL""")
def q_clamp(spark, sf):
    t = _tok(spark, sf).filter(F.col("input_ids").isNotNull())
    return t.select("raw_id", F.col("sample_idx").cast("bigint").alias("sample_idx"),
                    TK.n_label_tokens(TK.clamp_labels(F.col("labels"), 100000)).cast("bigint").alias("n_kept"))


@register("drop_all_masked", ("v_alpaca",), "WITH " + D_ALPACA_SAMPLES.strip() + """
SELECT raw_id, sample_idx FROM lb WHERE input_ids IS NOT NULL AND len(list_filter(labels, lambda l: l <> -100)) > 0""")
def q_all_masked(spark, sf):
    t = _tok(spark, sf).filter(F.col("input_ids").isNotNull())
    return C.drop_all_masked(t).select("raw_id", F.col("sample_idx").cast("bigint").alias("sample_idx"))


# ------------------------------------------------------------------ the fixture mix
def _sources(spark, sf):
    register_views(spark, sf, *MIX_VIEWS)
    return [CorpusSource(n, w, spark.table(v)) for n, w, v in MIX]


def _d_source(name, vname, samples_sql):
    t = name
    return f"""
{t}_f AS (SELECT '{name}' AS source, row_number() OVER (ORDER BY raw_id) - 1 AS raw_idx, {samples_sql} AS samples FROM {vname}),
{t}_x AS (SELECT source, raw_idx, unnest(CASE WHEN samples IS NULL OR len(samples) = 0 THEN [NULL] ELSE samples END) AS messages,
  generate_subscripts(CASE WHEN samples IS NULL OR len(samples) = 0 THEN [NULL] ELSE samples END, 1) - 1 AS sample_idx
  FROM {t}_f)"""


_MIX_SQL = {"opencode_instruct": D_SCORED, "codealpaca": D_ALPACA, "code_feedback": _d_both("query", "answer")}

D_MIX = "WITH " + ",".join(_d_source(n, v, _MIX_SQL[n]) for n, _, v in MIX).strip() + f""",
allx AS ({" UNION ALL ".join(f"SELECT * FROM {n}_x" for n, _, _ in MIX)}),
t0 AS (SELECT *, messages IS NULL AS rejected,
  CASE WHEN messages IS NOT NULL THEN {D.encode(D.render('messages'))} END AS ids_full FROM allx),
t1 AS (SELECT *, len(ids_full) AS n_tokens, coalesce(len(ids_full) >= {CTX}, false) AS overflow FROM t0),
t2 AS (SELECT *, CASE WHEN NOT rejected AND NOT overflow THEN ids_full[1:{CTX}] END AS input_ids FROM t1),
t3 AS (SELECT *, {D.marker_pos('input_ids')} AS mpos FROM t2),
t4 AS (SELECT *, {D.labels('input_ids', 'mpos')} AS labels FROM t3),
samples AS (SELECT source, raw_idx, sample_idx, input_ids, labels,
  CASE WHEN rejected THEN 'format_rejected' WHEN overflow THEN 'context_overflow'
       WHEN len(list_filter(labels, lambda l: l <> -100)) = 0 THEN 'all_labels_masked' ELSE 'valid' END AS status FROM t4),
spec AS (SELECT * FROM (VALUES {", ".join(f"('{n}', {w}, {i})" for i, (n, w, _) in enumerate(MIX))}) t(source, weight, ord)),
alloc AS (SELECT source, weight, CAST(floor({D_TOTAL} * CAST(weight AS DOUBLE)) AS BIGINT) AS total_alloc FROM spec),
alloc2 AS (SELECT *, greatest(1, CAST(floor(total_alloc * 0.05) AS BIGINT)) AS eval_alloc FROM alloc),
vr AS (SELECT source, raw_idx, sample_idx, row_number() OVER (PARTITION BY source ORDER BY raw_idx, sample_idx) AS vrank
  FROM samples WHERE status = 'valid'),
cut AS (SELECT vr.source, raw_idx AS cut_raw, sample_idx AS cut_s FROM vr JOIN alloc2 a ON a.source = vr.source AND vrank = a.total_alloc),
streamed AS (SELECT s.* FROM samples s LEFT JOIN cut c ON c.source = s.source
  WHERE c.cut_raw IS NULL OR s.raw_idx < c.cut_raw OR (s.raw_idx = c.cut_raw AND s.sample_idx <= c.cut_s)),
collected AS (SELECT *, {D.seeded(42, 'source', 'raw_idx', 'sample_idx')} AS shuffle_key FROM streamed WHERE status = 'valid'),
cn AS (SELECT source, count(*) AS n FROM collected GROUP BY source),
sr AS (SELECT c.*, row_number() OVER (PARTITION BY c.source ORDER BY shuffle_key) AS srank,
  cn.n - least(a.eval_alloc, cn.n) AS n_train FROM collected c JOIN cn USING (source) JOIN alloc2 a USING (source)),
split AS (SELECT *, CASE WHEN srank <= n_train THEN 'train' ELSE 'eval' END AS split FROM sr)"""


def _d_interleave(label):
    cum = []
    acc = 0.0
    for n, w, _ in MIX[:-1]:
        acc += w
        cum.append((n, acc))
    case = "CASE " + " ".join(f"WHEN u < {c!r} THEN '{n}'" for n, c in cum) + f" ELSE '{MIX[-1][0]}' END"
    return f""",
{label}_rows AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY shuffle_key) AS rk FROM split WHERE split = '{label}'),
{label}_n AS (SELECT s.source, coalesce(c.n, 0) AS n FROM spec s LEFT JOIN
   (SELECT source, count(*) AS n FROM {label}_rows GROUP BY source) c USING (source)),
{label}_tot AS (SELECT CAST(sum(n) AS BIGINT) AS tot FROM {label}_n),
{label}_d0 AS (SELECT k, CAST(('0x' || substr({D.seeded(42, "'draw'", f"'{label}'", 'k')}, 1, 8))::BIGINT AS DOUBLE) / 4294967296.0 AS u
   FROM {label}_tot, range(0, {label}_tot.tot) r(k)),
{label}_d AS (SELECT k, {case} AS source FROM {label}_d0),
{label}_dr AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY k) AS rk FROM {label}_d),
{label}_stop AS (SELECT coalesce(min(CASE WHEN n.n > 0 THEN d.k ELSE d.k - 1 END), (SELECT tot FROM {label}_tot) - 1) AS stop
   FROM {label}_dr d JOIN {label}_n n USING (source) WHERE (n.n > 0 AND d.rk = n.n) OR (n.n = 0 AND d.rk = 1)),
{label}_mix AS (SELECT d.k AS mix_idx, r.* FROM {label}_dr d JOIN {label}_rows r USING (source, rk), {label}_stop s
   WHERE d.k <= s.stop)"""


def _mix(spark, sf, materialize=True):
    sources = _sources(spark, sf)
    return build_corpus(spark, sources, spark.table("v_pairs").count(), context_length=CTX, materialize=materialize)


def _streamed(spark, sf):
    res = _mix(spark, sf)
    return res.streamed, res.quota, res


@register("take_quota", MIX_VIEWS, D_MIX + """
SELECT source, raw_idx, sample_idx, status FROM streamed""")
def q_quota(spark, sf):
    st, _, _ = _streamed(spark, sf)
    return st.select("source", "raw_idx", F.col("sample_idx").cast("bigint").alias("sample_idx"), "status")


@register("collect_diagnostics", MIX_VIEWS, D_MIX + """,
g AS (SELECT source, max(raw_idx) + 1 AS raw_streamed, count(*) FILTER (WHERE status = 'valid') AS samples_collected,
  count(*) FILTER (WHERE status = 'format_rejected') AS format_rejected,
  count(*) FILTER (WHERE status = 'context_overflow') AS context_overflow,
  count(*) FILTER (WHERE status = 'all_labels_masked') AS all_labels_masked FROM streamed GROUP BY source)
SELECT a.source, a.total_alloc AS requested, coalesce(raw_streamed, 0) AS raw_streamed,
 coalesce(samples_collected, 0) AS samples_collected, coalesce(format_rejected, 0) AS format_rejected,
 coalesce(context_overflow, 0) AS context_overflow, coalesce(all_labels_masked, 0) AS all_labels_masked,
 coalesce(format_rejected, 0) + coalesce(context_overflow, 0) + coalesce(all_labels_masked, 0) AS total_skipped,
 round(CASE WHEN coalesce(raw_streamed, 0) > 0 THEN context_overflow / raw_streamed * 100.0 ELSE 0.0 END, 6) AS overflow_rate,
 coalesce(samples_collected, 0) < a.total_alloc AS exhausted
FROM alloc2 a LEFT JOIN g USING (source)""")
def q_diag(spark, sf):
    return _mix(spark, sf).diagnostics.withColumn("overflow_rate", F.round("overflow_rate", 6))


@register("allocate", MIX_VIEWS, D_MIX + """
SELECT source, total_alloc, eval_alloc, total_alloc - eval_alloc AS train_alloc FROM alloc2""")
def q_alloc(spark, sf):
    return _mix(spark, sf).allocation.select("source", "total_alloc", "eval_alloc", "train_alloc")


@register("seeded_shuffle", MIX_VIEWS, D_MIX + """
SELECT source, raw_idx, sample_idx, srank AS shuffle_rank FROM sr""")
def q_shuffle(spark, sf):
    from ..plans.ordering import global_index, hex_bucket
    col = _mix(spark, sf).collected.withColumn("shuffle_key", C.seeded_shuffle_key())
    r = global_index(col, ["shuffle_key"], hex_bucket("shuffle_key"), ["source"], name="shuffle_rank")
    return r.select("source", "raw_idx", F.col("sample_idx").cast("bigint").alias("sample_idx"), "shuffle_rank")


@register("train_eval_split", MIX_VIEWS, D_MIX + """
SELECT source, raw_idx, sample_idx, split FROM split""")
def q_split(spark, sf):
    sp = _mix(spark, sf).split
    return sp.select("source", "raw_idx", F.col("sample_idx").cast("bigint").alias("sample_idx"), "split")


@register("align_union", MIX_VIEWS, D_MIX + """
SELECT split, source, count(*) AS n_rows, CAST(sum(len(input_ids)) AS BIGINT) AS n_tokens,
 CAST(sum(raw_idx) AS BIGINT) AS raw_sum FROM split GROUP BY 1, 2""")
def q_align(spark, sf):
    sp = _mix(spark, sf).split
    frames = [sp.filter(F.col("source") == n) for n, _, _ in MIX]
    # the other sources come with types of their own and are cast to the first one's
    frames[1] = frames[1].withColumns({"raw_idx": F.col("raw_idx").cast("string"), "input_ids": F.col("input_ids").cast("array<long>")})
    frames[2] = frames[2].withColumns({"raw_idx": F.col("raw_idx").cast("double"), "extra": F.lit(1)})
    u = C.align_union(frames)
    assert u.dtypes == frames[0].dtypes
    return u.groupBy("split", "source").agg(F.count(F.lit(1)).alias("n_rows"),
                                            F.sum(F.size("input_ids")).cast("bigint").alias("n_tokens"),
                                            F.sum("raw_idx").alias("raw_sum"))


@register("weighted_interleave", MIX_VIEWS, D_MIX + _d_interleave("train") + """
SELECT mix_idx, source, raw_idx, sample_idx FROM train_mix""")
def q_interleave(spark, sf):
    res = _mix(spark, sf)
    return res.train.select("mix_idx", "source", "raw_idx", F.col("sample_idx").cast("bigint").alias("sample_idx"))


@register("build_corpus", MIX_VIEWS, D_MIX + _d_interleave("train") + _d_interleave("eval") + f"""
SELECT 'train' AS split, {D.seeded(42, "'mix'", "'train'", 'mix_idx')} AS order_key, source, raw_idx, sample_idx,
  len(input_ids) AS n_tokens, md5(array_to_string(input_ids, ',')) AS ids_md5,
  md5(array_to_string(labels, ',')) AS labels_md5 FROM train_mix
UNION ALL
SELECT 'eval', {D.seeded(42, "'mix'", "'eval'", 'mix_idx')}, source, raw_idx, sample_idx, len(input_ids),
  md5(array_to_string(input_ids, ',')), md5(array_to_string(labels, ',')) FROM eval_mix""")
def q_build(spark, sf):
    return _mix(spark, sf).mixed.select("split", "order_key", "source", "raw_idx", F.col("sample_idx").cast("bigint").alias("sample_idx"),
                      F.size("input_ids").cast("bigint").alias("n_tokens"),
                      F.md5(F.array_join("input_ids", ",")).alias("ids_md5"),
                      F.md5(F.array_join("labels", ",")).alias("labels_md5"))


def _mixed(spark, sf):
    return _mix(spark, sf).mixed


@register("validate_samples", MIX_VIEWS, D_MIX + _d_interleave("train") + _d_interleave("eval") + f""",
bothx AS (SELECT 'train' AS split, input_ids, labels FROM train_mix UNION ALL SELECT 'eval', input_ids, labels FROM eval_mix)
SELECT split, count(*) AS n_rows, count(*) FILTER (WHERE len(input_ids) <> len(labels)) AS length_mismatch,
 CAST(0 AS BIGINT) AS mask_mismatch, count(*) FILTER (WHERE len(input_ids) > {CTX}) AS too_long,
 count(*) FILTER (WHERE len(list_filter(labels, lambda l: l <> -100)) = 0) AS all_masked,
 CAST(sum(len(list_filter(labels, lambda l: l <> -100))) AS BIGINT) AS label_tokens,
 CAST(sum(len(input_ids)) AS BIGINT) AS tokens
FROM bothx GROUP BY split""")
def q_validate(spark, sf):
    return C.validate_samples(_mixed(spark, sf), CTX)


@register("write_corpus", MIX_VIEWS, D_MIX + _d_interleave("train") + _d_interleave("eval") + """
SELECT 'train' AS split, source, raw_idx, sample_idx, len(input_ids) AS n_tokens, md5(array_to_string(labels, ',')) AS labels_md5 FROM train_mix
UNION ALL SELECT 'eval', source, raw_idx, sample_idx, len(input_ids), md5(array_to_string(labels, ',')) FROM eval_mix""")
def q_write(spark, sf):
    path = f"{ensure_checkpoint_dir(spark).rstrip('/')}/corvid-written-{uuid.uuid4().hex}"
    write_corpus(_mix(spark, sf), path)
    back = spark.read.parquet(path)
    return back.select("split", "source", "raw_idx", F.col("sample_idx").cast("bigint").alias("sample_idx"),
                       F.size("input_ids").cast("bigint").alias("n_tokens"), F.md5(F.array_join("labels", ",")).alias("labels_md5"))


class PairShape:
    """U4 example: a turn pair as a sample, or why it is none."""

    def eval(self, instruction, output):
        if instruction is None or not instruction.strip():
            yield None, "no question"
        elif len(output or "") < 300:
            yield None, "short answer"
        elif len(instruction) > len(output) * 2:
            yield None, "long question"
        elif "ö" not in instruction:
            yield [[("user", instruction), ("assistant", output)]] * (2 if len(output) % 2 else 1), None


@register("custom_source", ("v_pairs",), f"""
WITH t AS (SELECT *, row_number() OVER (ORDER BY raw_id) - 1 AS raw_idx,
  CASE WHEN {S("coalesce(instruction, '')")} = '' THEN 'no question' WHEN length(output) < 300 THEN 'short answer'
       WHEN length(instruction) > length(output) * 2 THEN 'long question' WHEN NOT instruction LIKE '%ö%' THEN 'kept' END AS tag FROM v_pairs),
k AS (SELECT raw_idx, tag, CASE WHEN tag = 'kept' THEN CASE WHEN length(output) % 2 = 1 THEN 2 ELSE 1 END ELSE 0 END AS n,
  CASE WHEN tag = 'kept' THEN len({D.encode(D.render("[" + D.msg('user', 'instruction') + ", " + D.msg('assistant', 'output') + "]"))}) END AS toks FROM t)
SELECT CASE WHEN tag = 'kept' THEN CASE WHEN toks >= {CTX} THEN 'context_overflow' ELSE 'valid' END ELSE 'format_rejected' END AS status,
 CASE WHEN tag <> 'kept' THEN tag END AS reject_reason, CAST(sum(greatest(n, 1)) AS BIGINT) AS n_rows
FROM k GROUP BY 1, 2""")
def q_custom(spark, sf):
    register_table_function("turn_pairs", PairShape, ("instruction", "output"))
    pairs = view(spark, sf, "v_pairs")
    res = build_corpus(spark, [CorpusSource("turn_pairs", 1.0, pairs)], max(1, 2 * pairs.count()), context_length=CTX)
    return res.streamed.groupBy("status", "reject_reason").agg(F.count(F.lit(1)).alias("n_rows"))


@register("pad_batches_left", MIX_VIEWS, D_MIX + _d_interleave("train") + f""",
o AS (SELECT *, {D.seeded(42, "'mix'", "'train'", 'mix_idx')} AS order_key FROM train_mix),
p AS (SELECT *, row_number() OVER (ORDER BY order_key) - 1 AS position FROM o),
b AS (SELECT *, CAST(floor(position / 8) AS BIGINT) AS batch_id FROM p),
m AS (SELECT *, CAST(ceil(max(len(input_ids)) OVER (PARTITION BY batch_id) / 8) * 8 AS INTEGER) AS padded_len FROM b)
SELECT batch_id, position, padded_len,
 md5(array_to_string(list_concat(list_transform(range(padded_len - len(input_ids)), lambda z: {TK.DEFAULT_VOCAB.pad_id}), input_ids), ',')) AS ids_md5,
 md5(array_to_string(list_concat(list_transform(range(padded_len - len(input_ids)), lambda z: 0), list_transform(input_ids, lambda z: 1)), ',')) AS mask_md5
FROM m""")
def q_pad_left(spark, sf):
    p = C.pad_batches(_mix(spark, sf).train, "order_key", 8, side="left")
    return p.select("batch_id", "position", F.col("padded_len").cast("int").alias("padded_len"),
                    F.md5(F.array_join("input_ids", ",")).alias("ids_md5"), F.md5(F.array_join("attention_mask", ",")).alias("mask_md5"))


@register("corpus_summary", MIX_VIEWS, D_MIX + _d_interleave("train") + _d_interleave("eval") + """
SELECT 'train' AS split, count(*) AS n_rows, CAST(floor(count(*) / 16) AS BIGINT) AS steps_per_epoch FROM train_mix
UNION ALL SELECT 'eval', count(*), CAST(floor(count(*) / 16) AS BIGINT) FROM eval_mix""")
def q_summary(spark, sf):
    return C.corpus_summary(_mixed(spark, sf), 16, 1)


@register("pad_batches", MIX_VIEWS, D_MIX + _d_interleave("train") + f""",
o AS (SELECT *, {D.seeded(42, "'mix'", "'train'", 'mix_idx')} AS order_key FROM train_mix),
p AS (SELECT *, row_number() OVER (ORDER BY order_key) - 1 AS position FROM o),
b AS (SELECT *, CAST(floor(position / 16) AS BIGINT) AS batch_id FROM p),
m AS (SELECT *, CAST(ceil(max(len(input_ids)) OVER (PARTITION BY batch_id) / 8) * 8 AS INTEGER) AS padded_len FROM b)
SELECT batch_id, position, padded_len, len(input_ids) AS n_tokens,
 md5(array_to_string(list_concat(input_ids, list_transform(range(padded_len - len(input_ids)), lambda z: {TK.DEFAULT_VOCAB.pad_id})), ',')) AS ids_md5,
 md5(array_to_string(list_concat(labels, list_transform(range(padded_len - len(labels)), lambda z: -100)), ',')) AS labels_md5,
 len(list_filter(list_concat(list_transform(input_ids, lambda z: 1), list_transform(range(padded_len - len(input_ids)), lambda z: 0)), lambda z: z = 1)) AS mask_ones
FROM m""")
def q_pad(spark, sf):
    res = _mix(spark, sf)
    p = C.pad_batches(res.train, "order_key", 16)
    ones = F.size(F.filter("attention_mask", lambda z: z == 1)).cast("bigint")
    return p.select("batch_id", "position", F.col("padded_len").cast("int").alias("padded_len"),
                    ones.alias("n_tokens"),
                    F.md5(F.array_join("input_ids", ",")).alias("ids_md5"),
                    F.md5(F.array_join("labels", ",")).alias("labels_md5"),
                    ones.alias("mask_ones"))


@register("language_breakdown", (), """
SELECT lang, count(*) AS n, round(count(*) * 100.0 / sum(count(*)) OVER (), 6) AS pct FROM documents GROUP BY lang""")
def q_lang(spark, sf):
    d = read_table(spark, sf, "documents")
    return C.language_breakdown(d, "lang").withColumn("pct", F.round("pct", 6))


@register("reload_select", (), """
SELECT conv_id, turn FROM conversations""")
def q_reload(spark, sf):
    d = read_table(spark, sf, "conversations")
    return C.reload_select(d, ("conv_id", "turn", "input_ids"))
