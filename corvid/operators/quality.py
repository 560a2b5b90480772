"""Quality predicates Q1-Q3 as Column expressions."""
from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .chat import strict_json_text

UNKNOWN = -1.0
# Java's number parser accepts a type suffix (``1d``, ``2.5f``) that Python's float() rejects.
_JAVA_SUFFIX = r"^\s*[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?[dDfF]\s*$"
# Python's float() accepts single underscores between digits.
_PY_UNDERSCORE = r"^\s*[+-]?[0-9]+(_[0-9]+)+(\.[0-9]+(_[0-9]+)*)?\s*$"


def parse_test_score(s: Column) -> Column:
    """Q1: numeric text -> double; empty, NULL or unparseable -> -1.0."""
    txt = F.when(s.rlike(_PY_UNDERSCORE), F.regexp_replace(s, "_", "")).otherwise(s)
    val = F.when(txt.rlike(_JAVA_SUFFIX), F.lit(None).cast("double")).otherwise(txt.try_cast("double"))
    return F.when(s.isNull() | (s == ""), F.lit(UNKNOWN)).otherwise(F.coalesce(val, F.lit(UNKNOWN)))


def parse_judgement(s: Column) -> Column:
    """Q2: mean of ``score`` over the object-valued entries that hold one.

    Unknown (-1.0) when the text is empty or not a JSON object, when no entry
    has a score, or when any score is not a number or boolean (the reference's
    ``sum`` raises and the error is caught).  The text is read as Python does: the last of
    repeated keys wins, text after the object makes it no JSON.
    """
    m = F.from_json(strict_json_text(s), "map<string,variant>")
    objs = F.filter(F.map_values(m), lambda x: F.schema_of_variant(x).startswith("OBJECT<")
                    & F.variant_get(x, "$.score", "variant").isNotNull())
    scores = F.transform(objs, lambda x: F.variant_get(x, "$.score", "variant"))
    numeric = F.forall(scores, lambda v: F.schema_of_variant(v).isin("BIGINT", "DOUBLE", "BOOLEAN", "FLOAT")
                       | F.schema_of_variant(v).startswith("DECIMAL"))
    as_num = F.transform(scores, lambda v: F.coalesce(
        F.try_variant_get(v, "$", "double"),
        F.when(F.try_variant_get(v, "$", "boolean"), F.lit(1.0)).otherwise(F.lit(0.0))))
    mean = F.aggregate(as_num, F.lit(0.0).cast("double"), lambda a, x: a + x) / F.size(as_num)
    ok = s.isNotNull() & (s != "") & m.isNotNull() & (F.size(scores) > 0) & numeric
    return F.when(F.coalesce(ok, F.lit(False)), mean).otherwise(F.lit(UNKNOWN))


def passes(score: Column, minimum: float) -> Column:
    """Q3: reject iff the score is known (>= 0) and below the minimum; NaN passes."""
    return ~F.coalesce((score >= 0) & (score < minimum), F.lit(False))
