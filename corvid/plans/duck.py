"""DuckDB text for the oracle statements (verification only, never executed by Spark).

These mirror the Spark Column helpers in ``corvid.functions`` so the oracle
SQL can restate each operator over the same parquet tables.
"""
from __future__ import annotations

from ..functions.chat import IM_END, IM_START, QWEN_DEFAULT_SYSTEM
from ..functions.text import PY_LINE_BREAK, PY_WHITESPACE_CLASS
from ..functions.tokens import DEFAULT_VOCAB, PIECE_PATTERN

V = DEFAULT_VOCAB


def q(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def strip(x: str) -> str:
    return f"regexp_replace({x}, {q('^' + PY_WHITESPACE_CLASS + '+|' + PY_WHITESPACE_CLASS + '+\\z')}, '', 'g')"


def blank_null(x: str) -> str:
    s = strip(f"coalesce({x}, '')")
    return f"nullif({s}, '')"


def lit(s: str) -> str:
    """A string literal with newlines written as chr(10)."""
    parts = s.split("\n")
    return " || chr(10) || ".join(q(p) for p in parts) if len(parts) > 1 else q(s)


def msg(role: str, content: str) -> str:
    return f"{{'role': {q(role)}, 'content': {content}}}"


def render(msgs: str, add_generation_prompt: bool = False, default_system: str | None = QWEN_DEFAULT_SYSTEM) -> str:
    body = (f"array_to_string(list_transform({msgs}, lambda m: {q(IM_START)} || m.role || chr(10) || "
            f"coalesce(m.content, '') || {q(IM_END)} || chr(10)), '')")
    if default_system is not None:
        sys_txt = f"{q(IM_START + 'system')} || chr(10) || {q(default_system)} || {q(IM_END)} || chr(10)"
        body = f"(CASE WHEN coalesce({msgs}[1].role = 'system', false) THEN {body} ELSE {sys_txt} || {body} END)"
    if add_generation_prompt:
        body = f"({body} || {q(IM_START + 'assistant')} || chr(10))"
    return body


def piece_id(p: str) -> str:
    return (f"CAST(CASE WHEN {p} = '<|im_start|>' THEN {V.im_start_id} WHEN {p} = '<|im_end|>' THEN {V.im_end_id} "
            f"WHEN {p} = '<|endoftext|>' THEN {V.endoftext_id} "
            f"ELSE ('0x' || substr(md5({p}), 1, 8))::BIGINT % {V.base_vocab} END AS INTEGER)")


def encode(text: str) -> str:
    return f"list_transform(regexp_extract_all({text}, {q(PIECE_PATTERN)}, 0), lambda p: {piece_id('p')})"


MARKER = f"[{V.im_start_id}, {piece_id(q('assistant'))}, {piece_id('chr(10)')}]"


def marker_pos(ids: str) -> str:
    return f"(list_filter(range(1, len({ids}) - 1), lambda i: {ids}[i:i+2] = {MARKER})[1])"


def labels(ids: str, pos: str) -> str:
    return (f"list_transform({ids}, lambda x, i: CASE WHEN {pos} IS NOT NULL AND i - 1 >= {pos} + 2 "
            f"AND (x = -100 OR (x >= 0 AND x < {V.full_length})) THEN x ELSE -100 END)")


def splitlines(x: str) -> str:
    return f"string_split_regex({x}, {q(PY_LINE_BREAK)})"


def seeded(seed, *parts: str) -> str:
    inner = " || '-' || ".join([q(str(seed))] + [f"CAST({p} AS VARCHAR)" for p in parts])
    return f"md5({inner})"
