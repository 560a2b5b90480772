"""Python-exact string helpers as Spark Column expressions (JVM-side)."""
from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The characters Python's str.isspace() accepts (str.strip()).
PY_WHITESPACE_CLASS = (r"[\t\n\x0b\x0c\r\x1c-\x1f \x85\xa0\x{1680}\x{2000}-\x{200a}"
                       r"\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]")
# The line boundaries of Python's str.splitlines().
PY_LINE_BREAK = r"\r\n|[\n\r\x0b\x0c\x1c-\x1e\x85\x{2028}\x{2029}]"

_STRIP_RE = f"^{PY_WHITESPACE_CLASS}+|{PY_WHITESPACE_CLASS}+\\z"


def _c(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def py_strip(c) -> Column:
    """Python ``str.strip()``; Spark ``trim`` only removes spaces."""
    return F.regexp_replace(_c(c), _STRIP_RE, "")


def py_lstrip(c) -> Column:
    return F.regexp_replace(_c(c), f"^{PY_WHITESPACE_CLASS}+", "")


def blank_to_null(c) -> Column:
    """strip(); empty or NULL -> NULL (the ``(x or '').strip()`` + ``if not x`` idiom)."""
    s = py_strip(F.coalesce(_c(c), F.lit("")))
    return F.when(s != "", s)


def py_splitlines(c) -> Column:
    """``str.splitlines()`` (an empty string gives ``['']`` instead of ``[]``)."""
    return F.split(_c(c), PY_LINE_BREAK)


def strip_markdown(c) -> Column:
    """Drop a leading fence line and a trailing bare fence line."""
    lines = py_splitlines(py_strip(_c(c)))
    first_dropped = F.when(F.startswith(F.try_element_at(lines, F.lit(1)), F.lit("```")),
                           F.slice(lines, 2, F.greatest(F.size(lines) - 1, F.lit(0)))).otherwise(lines)
    n = F.size(first_dropped)
    last_dropped = F.when((n > 0) & (py_strip(F.try_element_at(first_dropped, F.lit(-1))) == "```"),
                          F.slice(first_dropped, 1, n - 1)).otherwise(first_dropped)
    return F.array_join(last_dropped, "\n")


def run_tag(folder) -> Column:
    """Run tag from a checkpoint folder: every ``/`` becomes ``_`` (E5)."""
    return F.regexp_replace(_c(folder), "/", "_")
