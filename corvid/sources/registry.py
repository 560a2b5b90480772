"""Source registry (S1, S2, U4): dataset name -> formatter and expected columns.

Unknown names raise before any Spark job starts.  A custom source shape is
added with :func:`register_source` (a ``DataFrame -> Column`` formatter that
returns ``ARRAY<ARRAY<STRUCT<role, content>>>`` or NULL) or, where a row's samples
take Python, with :func:`register_table_function` (a table function that gives
each row its samples or the reason it is rejected for).
"""
from __future__ import annotations

from dataclasses import dataclass
from typing import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators.formatters import FORMATTERS


@dataclass(frozen=True)
class SourceDef:
    name: str
    formatter: Callable[[DataFrame], Column] | None
    columns: tuple[str, ...]
    table_function: type | None = None


#: What a source's table function returns for a row: its samples, or why it has none.
TAGGED = "samples array<array<struct<role:string,content:string>>>, reject_reason string"


def _s(*cols):
    return tuple(cols)


# Dataset names of the reference configuration and their shapes.
REGISTRY: dict[str, SourceDef] = {
    "opencode_instruct": SourceDef("opencode_instruct", FORMATTERS["scored"],
                                   _s("input", "output", "average_test_score", "llm_judgement")),
    "codealpaca": SourceDef("codealpaca", FORMATTERS["alpaca"], _s("instruction", "input", "output")),
    "python_instructions": SourceDef("python_instructions", FORMATTERS["prompt_cut"], _s("prompt", "output")),
    "code_feedback": SourceDef("code_feedback", FORMATTERS["query_answer"], _s("query", "answer")),
    "magicoder_oss": SourceDef("magicoder_oss", FORMATTERS["problem_solution"], _s("problem", "solution")),
    "code_contests": SourceDef("code_contests", FORMATTERS["contest"],
                               _s("solution_type", "programming_language", "description", "solution")),
    "code_search_net": SourceDef("code_search_net", FORMATTERS["docstring"],
                                 _s("language", "func_code_string", "func_documentation_string")),
    "leetcode": SourceDef("leetcode", FORMATTERS["fanout"], _s("content", "java", "c++", "python", "javascript")),
    "sql_context": SourceDef("sql_context", FORMATTERS["bidirectional"], _s("context", "question", "answer")),
}


def register_source(name: str, formatter: Callable[[DataFrame], Column], columns: tuple[str, ...]) -> None:
    REGISTRY[name] = SourceDef(name, formatter, tuple(columns))


def register_table_function(name: str, handler: type, columns: tuple[str, ...]) -> None:
    """U4: a source whose rows go through a Python table function.

    ``handler`` has ``eval(*values)``, given a row's ``columns``, and yields one tuple
    ``(samples, None)`` or ``(None, reason)``; a row for which it yields nothing is rejected
    without a reason."""
    class OneEach(handler):
        """The handler, with one result for every row."""

        def eval(self, *values):
            yield next(iter(super().eval(*values)), (None, None))
    REGISTRY[name] = SourceDef(name, None, tuple(columns), OneEach)


def formatted(shape: SourceDef, df: DataFrame) -> DataFrame:
    """``df`` with ``samples`` and ``reject_reason``."""
    if shape.table_function is None:
        return df.withColumns({"samples": shape.formatter(df), "reject_reason": F.lit(None).cast("string")})
    told = F.udtf(shape.table_function, returnType=TAGGED)
    return df.drop("samples", "reject_reason").lateralJoin(told(*[F.col(c).outer() for c in shape.columns]))


def resolve(name: str) -> SourceDef:
    if name not in REGISTRY:
        raise KeyError(f"no source named {name!r}; register_source() adds one")
    return REGISTRY[name]


def scan_source(spark: SparkSession, path: str, fmt: str = "parquet", schema: T.StructType | None = None,
                streaming: bool = False, subset: str | None = None, split: str | None = None, **options) -> DataFrame:
    """Open a dataset with an explicit schema; the same call serves batch and stream.

    ``subset`` and ``split`` name folders below ``path``; empty ones are left out."""
    r = spark.readStream if streaming else spark.read
    r = r.format(fmt).options(**options)
    if schema is not None:
        r = r.schema(schema)
    return r.load("/".join([path.rstrip("/"), *[p for p in (subset, split) if p]]))


def clean_prompt_lines(lines: DataFrame, value: str = "value") -> DataFrame:
    """S6 on a line table: each line stripped, blank lines dropped."""
    from pyspark.sql import functions as F
    from ..functions.text import py_strip
    keep = [c for c in lines.columns if c != value]
    return lines.select(*keep, py_strip(F.col(value)).alias("prompt")).filter(F.col("prompt") != "")


def prompt_lines(spark: SparkSession, path: str) -> DataFrame:
    """Prompts from a text file, one per line (``\n``, ``\r\n`` or ``\r``)."""
    return clean_prompt_lines(spark.read.text(path))
