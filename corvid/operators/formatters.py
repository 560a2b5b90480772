"""Source formatters F1-F9: raw example columns -> message lists or a rejection.

Each formatter is a function ``DataFrame -> Column`` producing
``ARRAY<ARRAY<STRUCT<role, content>>>`` (one inner list per training sample)
or NULL when the raw row is rejected.  They are pure projections, so Catalyst
fuses them into the scan's codegen stage.

Where the reference indexes a field directly (and would raise on NULL) the
row is rejected instead.
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.chat import messages
from ..functions.text import blank_to_null, py_strip
from . import quality as Q

# System prompts and prompt templates of the reference formatters.
DOCSTRING_SYSTEM = ("You are an expert software engineer. "
                    "Write a concise, accurate docstring for the given function. "
                    "Output only the docstring text — no code, no explanation, no surrounding quotes.")
SQL_SYSTEM_NL_TO_SQL = ("You are an expert SQL assistant. "
                        "Given a database schema and a natural language question, "
                        "write a correct SQL query that answers the question. "
                        "Return only the SQL query with no explanation.")
SQL_SYSTEM_SQL_TO_NL = ("You are an expert SQL assistant. "
                        "Given a database schema and a SQL query, "
                        "write the natural language question that the query is answering. "
                        "Return only the question with no explanation.")
CONTEST_LANGUAGES = ("cpp", "java", "python3")
DOCSTRING_LANGUAGES = ("python", "java", "javascript")
# Fan-out languages in order, with display names.
FANOUT_LANGUAGES = (("java", "Java"), ("c++", "C++"), ("python", "Python"), ("javascript", "JavaScript"))
PROMPT_CUT_MARKER = "### Output:"
MIN_TEST_SCORE = 0.8
MIN_LLM_SCORE = 4.5

# The patterns of the reference.  Python-regex equivalents (anchored so that only the first match is replaced).
PY_DOCSTRING_FIRST = (r"(?U)^([\s\S]*?def\s+\w+[^:]*:[ \t]*\n)([ \t]*)"
                      r"(\"\"\"[\s\S]*?\"\"\"|'''[\s\S]*?''')")
JAVADOC_FIRST = r"^([\s\S]*?)/\*\*[\s\S]*?\*/"


def _single(*pairs) -> Column:
    return F.array(messages(*pairs))


def fmt_alpaca(df: DataFrame) -> Column:
    """instruction [+ blank line + input] -> output; no empty check."""
    inst, inp, out = py_strip(F.col("instruction")), py_strip(F.col("input")), py_strip(F.col("output"))
    user = F.when(inp != "", F.concat(inst, F.lit("\n\n"), inp)).otherwise(inst)
    ok = F.col("instruction").isNotNull() & F.col("input").isNotNull() & F.col("output").isNotNull()
    return F.when(ok, _single(("user", user), ("assistant", out)))


def fmt_prompt_cut(df: DataFrame) -> Column:
    """cut the prompt at the first ``### Output:`` and strip; unstripped if absent."""
    p = F.col("prompt")
    pos = F.instr(p, PROMPT_CUT_MARKER)
    user = F.when(pos > 0, py_strip(F.substring(p, F.lit(1), pos - 1))).otherwise(p)
    ok = p.isNotNull() & F.col("output").isNotNull()
    return F.when(ok, _single(("user", user), ("assistant", py_strip(F.col("output")))))


def _both_required(a: str, b: str) -> Column:
    x, y = blank_to_null(F.col(a)), blank_to_null(F.col(b))
    return F.when(x.isNotNull() & y.isNotNull(), _single(("user", x), ("assistant", y)))


def fmt_query_answer(df: DataFrame) -> Column:
    """query -> answer, both required after strip."""
    return _both_required("query", "answer")


def fmt_problem_solution(df: DataFrame) -> Column:
    """problem -> solution, both required after strip."""
    return _both_required("problem", "solution")


def fmt_contest(df: DataFrame) -> Column:
    """correct solutions in cpp / java / python3 only."""
    lang = F.col("programming_language")
    keep = (F.col("solution_type") == "CORRECT") & lang.isin(*CONTEST_LANGUAGES)
    keep = F.coalesce(keep, F.lit(False)) & F.col("description").isNotNull() & F.col("solution").isNotNull()
    answer = F.concat(F.lit("# Language: "), lang, F.lit("\n\n"), py_strip(F.col("solution")))
    return F.when(keep, _single(("user", py_strip(F.col("description"))), ("assistant", answer)))


def fmt_scored(df: DataFrame, min_test: float = MIN_TEST_SCORE, min_llm: float = MIN_LLM_SCORE) -> Column:
    """input/output required, then the test-score and judgement thresholds."""
    x, y = blank_to_null(F.col("input")), blank_to_null(F.col("output"))
    ok = (x.isNotNull() & y.isNotNull()
          & Q.passes(Q.parse_test_score(F.col("average_test_score")), min_test)
          & Q.passes(Q.parse_judgement(F.col("llm_judgement")), min_llm))
    return F.when(ok, _single(("user", x), ("assistant", y)))


def strip_first_docstring(code: Column) -> Column:
    """Remove the first Python docstring after a ``def`` line (NULL if none)."""
    return F.when(code.rlike(PY_DOCSTRING_FIRST),
                  py_strip(F.regexp_replace(code, PY_DOCSTRING_FIRST, "$1")))


def strip_first_javadoc(code: Column) -> Column:
    """Remove the first ``/** ... */`` block (NULL if none)."""
    return F.when(code.rlike(JAVADOC_FIRST), py_strip(F.regexp_replace(code, JAVADOC_FIRST, "$1")))


def fmt_docstring(df: DataFrame) -> Column:
    """code with its first docstring removed -> the docstring."""
    lang = py_strip(F.lower(F.coalesce(F.col("language"), F.lit(""))))
    code = blank_to_null(F.col("func_code_string"))
    doc = blank_to_null(F.col("func_documentation_string"))
    stripped = F.when(lang == "python", strip_first_docstring(code)).otherwise(strip_first_javadoc(code))
    user = F.concat(F.lit("Write a docstring for the following "), lang, F.lit(" function:\n\n```"),
                    lang, F.lit("\n"), stripped, F.lit("\n```"))
    ok = lang.isin(*DOCSTRING_LANGUAGES) & code.isNotNull() & doc.isNotNull() & stripped.isNotNull()
    return F.when(ok, _single(("system", F.lit(DOCSTRING_SYSTEM)), ("user", user), ("assistant", doc)))


def fmt_fanout(df: DataFrame) -> Column:
    """F8: one 'solve in L' sample per solution, then every ordered pair 'convert A to B'."""
    sols = F.filter(F.array(*[F.struct(F.lit(d).alias("display"), blank_to_null(F.col(f"`{c}`")).alias("code"))
                              for c, d in FANOUT_LANGUAGES]), lambda s: s["code"].isNotNull())

    def samples(of: Column) -> Column:
        content, sols = of["content"], of["sols"]
        # fixed values: the texts of both tasks
        solve = F.transform(sols, lambda s: messages(
            ("user", F.concat(F.lit("Solve the following coding problem in "), s["display"], F.lit(":\n\n"), content)),
            ("assistant", s["code"])))
        convert = F.flatten(F.transform(sols, lambda a, i: F.transform(
            F.filter(sols, lambda b, j: j != i),
            lambda b: messages(
                ("user", F.concat(F.lit("Convert the following "), a["display"], F.lit(" solution to "),
                                  b["display"], F.lit(":\n\n"), a["code"])),
                ("assistant", b["code"])))))
        return F.when(content.isNotNull() & (F.size(sols) > 0), F.concat(solve, convert))

    # the stripped texts are bound once per row; every sample reads them from there
    return F.get(F.transform(F.array(F.struct(blank_to_null(F.col("content")).alias("content"), sols.alias("sols"))), samples), F.lit(0))


def fmt_bidirectional(df: DataFrame) -> Column:
    """context+question -> answer and context+answer -> question."""
    a, q, c = blank_to_null(F.col("answer")), blank_to_null(F.col("question")), blank_to_null(F.col("context"))
    s1 = messages(("system", F.lit(SQL_SYSTEM_NL_TO_SQL)), ("user", F.concat(c, F.lit("\n\n"), q)), ("assistant", a))
    s2 = messages(("system", F.lit(SQL_SYSTEM_SQL_TO_NL)), ("user", F.concat(c, F.lit("\n\n"), a)), ("assistant", q))
    return F.when(a.isNotNull() & q.isNotNull() & c.isNotNull(), F.array(s1, s2))


FORMATTERS = {
    "alpaca": fmt_alpaca,
    "prompt_cut": fmt_prompt_cut,
    "query_answer": fmt_query_answer,
    "problem_solution": fmt_problem_solution,
    "contest": fmt_contest,
    "scored": fmt_scored,
    "docstring": fmt_docstring,
    "fanout": fmt_fanout,
    "bidirectional": fmt_bidirectional,
}
