"""Arrow-batched Python functions (U1-U3) for what Spark SQL cannot express.

* U1 ``tokenizer_udf``: a user tokenizer file (``tokenizers`` JSON) shipped
  with ``SparkContext.addFile`` and loaded once per Python worker.
* U2 ``decode_calls_udf`` / ``prepare_messages_udf`` / ``strict_body_udf``: strict JSON rules
  (Python ``json``: no trailing garbage, last duplicate key wins).
* U3 ``batch_generate``: a user model function over ``mapInPandas`` batches.
"""
from __future__ import annotations

import dataclasses
import hashlib
import json
import re
from typing import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .chat import ASSISTANT_MARKER, ENDOFTEXT, IM_END, IM_START, PROMPT
from .tokens import DEFAULT_VOCAB, Encoder, HashVocab, hash_encoder, pieces_of

TOOL_CALL = T.StructType([T.StructField("name", T.StringType()), T.StructField("arguments", T.StringType())])

class _BAD:
    """Stands for text that is not one strict JSON value (a class, so that it stays itself in Python workers)."""


def strict_json(text):
    """The value of a text that is exactly one JSON value (the last of repeated keys wins)."""
    try:
        return json.loads(text)
    except (TypeError, ValueError, RecursionError):
        return _BAD


# ------------------------------------------------------------------ C5: one candidate
def decode_call(candidate: str | None) -> dict | None:
    """A tool call ``{name, arguments}`` of a candidate without fences, or None."""
    value = strict_json(candidate) if candidate else _BAD
    if not isinstance(value, dict):
        return None
    given = [value[k] for k in ("arguments", "parameters") if k in value]   # arguments win, even if null
    if "name" not in value or not given:
        return None
    inner = strict_json(given[0]) if isinstance(given[0], str) else given[0]
    return {"name": str(value["name"]), "arguments": inner if isinstance(inner, dict) else {}}


def unfenced(text: str) -> str:
    """The candidate inside a text: stripped, without an opening fence and closing backticks."""
    body = text.strip()
    opening = _FENCE.match(body)
    return body[opening.end():].rstrip("`").strip() if opening else body


_FENCE = re.compile(r"```(?:json)?")
#: a fenced block at the start, and what follows it
_FENCED = re.compile(r"\s*```(?:json)?(.*?)```\s*(.*)\Z", re.S)
_OBJECT = re.compile(r"\s*\{")


@F.pandas_udf(T.ArrayType(TOOL_CALL))
def decode_calls_udf(candidates: pd.Series) -> pd.Series:
    """C5 over arrays of candidate texts; a null stands for every candidate that is no call."""
    def one(c):
        call = decode_call(c)
        return None if call is None else {"name": call["name"], "arguments": json.dumps(call["arguments"])}
    return candidates.map(lambda cs: None if cs is None else [one(c) for c in cs])


# ------------------------------------------------------------------ C7: ordered pieces
def push_piece(pending: str, piece: str) -> tuple[list[tuple[str, object]], str]:
    """One step of the chunk scanner: (parts to emit, text held back).

    Only a text that begins like an object is held until it decodes; a complete fenced
    call leaves what follows it; everything else passes through at once."""
    text = pending + piece
    if fenced := _FENCED.match(text):
        if (call := decode_call(fenced[1].strip())) is not None:
            return [("tool_call", call)], fenced[2]
    elif _OBJECT.match(text):
        # only a text that ends like an object can be one
        call = decode_call(text.strip()) if text.rstrip().endswith("}") else None
        return ([], text) if call is None else ([("tool_call", call)], "")
    return ([("text", text)] if text else []), ""


def flush_pending(pending: str) -> list[tuple[str, object]]:
    """What the end of a stream makes of the text held back."""
    if not pending:
        return []
    call = decode_call(unfenced(pending))
    return [("text", pending) if call is None else ("tool_call", call)]


def wire_parts(parts) -> list[tuple[str, str]]:
    """Parts with calls as JSON text."""
    return [(kind, json.dumps(v) if kind == "tool_call" else v) for kind, v in parts]


def scan_block(pending: str, pieces) -> tuple[list[tuple[str, str]], str]:
    """Parts of a run of pieces that begins with ``pending`` held back, and what is held after it."""
    out = []
    for p in pieces:
        parts, pending = push_piece(pending, p or "")
        out += parts
    return wire_parts(out), pending


def scan_chunks(pieces: list[str]) -> list[tuple[str, str]]:
    """C7 for one ordered chunk list: (kind, value) parts, arguments as JSON text."""
    parts, pending = scan_block("", pieces)
    return parts + wire_parts(flush_pending(pending))


# ------------------------------------------------------------------ C4
def _objects(call):
    """A tool call whose JSON-text arguments are decoded; other values are left alone."""
    function = call.get("function") if isinstance(call, dict) else None
    if not isinstance(function, dict) or not isinstance(function.get("arguments"), str):
        return call
    value = strict_json(function["arguments"])
    return call if value is _BAD else {**call, "function": {**function, "arguments": value}}


def _prepare(messages_json: str | None) -> str | None:
    messages = strict_json(messages_json)
    if not isinstance(messages, list):
        return messages_json
    calls = [m.get("tool_calls") if isinstance(m, dict) else None for m in messages]
    return json.dumps([{**m, "tool_calls": [_objects(c) for c in own]} if isinstance(own, list) and own else m
                       for m, own in zip(messages, calls, strict=True)])


@F.pandas_udf(T.StringType())
def prepare_messages_udf(messages_json: pd.Series) -> pd.Series:
    """C4: tool-call arguments decoded from JSON text back to objects."""
    return messages_json.map(_prepare)


@F.pandas_udf(T.StringType())
def strict_body_udf(bodies: pd.Series) -> pd.Series:
    """JSON text by Python's rules, written anew: repeated keys collapse to the last one,
    text that is not exactly one JSON value gives null."""
    def one(b):
        v = strict_json(b)
        return None if v is _BAD else json.dumps(v, ensure_ascii=False)
    return bodies.map(one)


class _NoPrompt(Exception):
    """The template cannot be filled from this request."""


_template_json = json.JSONEncoder(ensure_ascii=False).encode


def _joined_text(value) -> str:
    """Content that the template adds to other text: only a string can be."""
    if not isinstance(value, str):
        raise _NoPrompt
    return value


def _template_call(call) -> dict:
    call = _objects(call) if isinstance(call, dict) else {}
    of = call["function"] if "function" in call else call
    if not isinstance(of, dict) or "arguments" not in of:
        raise _NoPrompt
    return {"name": str(of.get("name", "")), "arguments": _template_json(of["arguments"])}


def _template_message(message, first: bool, tools: bool) -> dict:
    message = message if isinstance(message, dict) else {}
    role, content = message.get("role"), message.get("content")
    calls = message.get("tool_calls") or []
    if role == "assistant" and calls:
        # a turn that only calls has no text
        return {"role": role, "content": _joined_text(content) if content else None, "calls": [_template_call(c) for c in calls]}
    if role == "tool" or role == "system" and first and tools:     # written out, not added
        return {"role": role, "content": "" if "content" not in message else str(content), "calls": None}
    if role in ("user", "assistant", "system"):
        return {"role": role, "content": _joined_text(content), "calls": None}
    return {"role": role if isinstance(role, str) else None, "content": None, "calls": None}


def prompt_parts(body: str | None) -> dict | None:
    """What the chat template needs of a request body, or None if it is no prompt.

    Tool-call arguments given as JSON text are decoded (C4); nested values are written as
    the template does, in the order of their keys."""
    request = strict_json(body)
    messages = request.get("messages") if isinstance(request, dict) else None
    tools = (request.get("tools") or []) if isinstance(request, dict) else []
    if not isinstance(messages, list) or not messages or not isinstance(tools, list | dict | str):
        return None
    try:
        return {"messages": [_template_message(m, i == 0, bool(tools)) for i, m in enumerate(messages)],
                "tools": [_template_json(t) for t in tools]}
    except _NoPrompt:
        return None


_CALLS = pa.list_(pa.struct([("name", pa.string()), ("arguments", pa.string())]))
_PARTS = pa.struct([("messages", pa.list_(pa.struct([("role", pa.string()), ("content", pa.string()), ("calls", _CALLS)]))),
                    ("tools", pa.list_(pa.string()))])


@F.arrow_udf(PROMPT)
def prompt_parts_udf(bodies: pa.Array) -> pa.Array:
    """``prompt_parts`` of each body; a body without a prompt has no messages."""
    return pa.array([prompt_parts(b) or {"messages": None, "tools": None} for b in bodies.to_pylist()], _PARTS)


def piece_ids_udf(vocab: HashVocab = DEFAULT_VOCAB) -> Callable[[Column], Column]:
    """Ids of the built-in encoder for arrays of pieces; a piece is hashed once per batch."""
    base, special = vocab.base_vocab, {IM_START: vocab.im_start_id, IM_END: vocab.im_end_id, ENDOFTEXT: vocab.endoftext_id}

    @F.arrow_udf(T.ArrayType(T.IntegerType()))
    def _ids(pieces: pa.Array) -> pa.Array:
        flat = pieces.flatten().dictionary_encode()
        known = pa.array([special[p] if p in special else int(hashlib.md5(p.encode()).hexdigest()[:8], 16) % base
                          for p in flat.dictionary.to_pylist()], pa.int32())
        ends = np.cumsum(pieces.value_lengths().fill_null(0).to_numpy(zero_copy_only=False), dtype=np.int32)
        return pa.ListArray.from_arrays(pa.array(np.concatenate([np.zeros(1, np.int32), ends])), known.take(flat.indices), mask=pieces.is_null())

    return _ids


def batch_hash_encoder(vocab: HashVocab = DEFAULT_VOCAB) -> Encoder:
    """``hash_encoder`` for long texts: the JVM cuts the pieces, their ids come from Arrow batches."""
    ids = piece_ids_udf(vocab)
    return dataclasses.replace(hash_encoder(vocab), ids=lambda text: ids(pieces_of(text)))


# ------------------------------------------------------------------ U1
_TOKENIZERS: dict[str, object] = {}


def tokenizer_udf(tokenizer_file: str) -> Callable[[Column], Column]:
    """Ids of a ``tokenizers`` JSON tokenizer (shipped with ``addFile``).

    Returns a Column function usable as ``encoder`` in
    :func:`corvid.operators.corpus.tokenize_and_mask`.
    """
    import os

    name = os.path.basename(tokenizer_file)

    @F.pandas_udf(T.ArrayType(T.IntegerType()))
    def _encode(texts: pd.Series) -> pd.Series:
        tok = _TOKENIZERS.get(name)
        if tok is None:
            from pyspark import SparkFiles
            from tokenizers import Tokenizer
            tok = Tokenizer.from_file(SparkFiles.get(name))
            _TOKENIZERS[name] = tok
        present = [t for t in texts if t is not None]
        ids = iter(e.ids for e in tok.encode_batch(present, add_special_tokens=False)) if present else iter(())
        return pd.Series([next(ids) if t is not None else None for t in texts], dtype=object)

    return _encode


def tokenizer_encoder(tokenizer_file: str, marker: str = ASSISTANT_MARKER, pad_token: str | None = None) -> Encoder:
    """A tokenizer file as the encoder of a corpus build.  Marker ids, vocabulary length
    (added tokens included) and pad id come from the same file as the ids."""
    from tokenizers import Tokenizer
    tok = Tokenizer.from_file(tokenizer_file)
    pad = tok.token_to_id(pad_token) if pad_token else None
    return Encoder(tokenizer_udf(tokenizer_file), tuple(tok.encode(marker, add_special_tokens=False).ids),
                   tok.get_vocab_size(with_added_tokens=True), 0 if pad is None else pad)


# ------------------------------------------------------------------ U3
def batch_generate(prompts: DataFrame, model_fn: Callable[[list[str]], list[str]],
                   prompt_col: str = "prompt", out_col: str = "completion") -> DataFrame:
    """Run a user model over Arrow batches of prompts (no model ships here)."""
    schema = T.StructType(prompts.schema.fields + [T.StructField(out_col, T.StringType())])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            pdf = pdf.copy()
            pdf[out_col] = model_fn(pdf[prompt_col].tolist()) if len(pdf) else []
            yield pdf

    return prompts.mapInPandas(run, schema)
