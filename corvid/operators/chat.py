"""Chat request and completion logs.

Requests are JSON text; open parts are read through ``try_parse_json``
(VARIANT).  Chunk logs are put together in blocks of a request's chunks first;
what a block makes of them is one row per text or tool call, and only these
rows meet per request, so a very long request spreads over many tasks.
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import udfs as U
from ..functions.chat import render_prompt
from ..functions.text import py_lstrip, py_strip
from ..functions.tokens import Encoder
from ..plans.barrier import compute_once

# Generation defaults of the reference server.
DEFAULT_MAX_NEW_TOKENS = 512
MAX_NEW_TOKENS_CAP = 4096
DEFAULT_TEMPERATURE = 0.2
DEFAULT_TOP_P = 0.95
DEFAULT_TOP_K = 50
DEFAULT_REPETITION_PENALTY = 1.05
DEFAULT_MODEL = "default"        # served model name when the request names none


REQ = "_req"      # the parsed request body (VARIANT), computed once per row
KEYS = "_req_keys"  # its top-level keys


def _v(body: Column) -> Column:
    return F.col(REQ)


def parse_requests(df: DataFrame, body: str = "body") -> DataFrame:
    """Parse the JSON body once, by Python's rules, into a VARIANT column shared by C1-C3.

    SQL's parser refuses repeated keys and passes over text after the object.  A body that
    its parsed value writes out again at the same length has neither; the others are
    rewritten by :func:`strict_body_udf` (last key wins, trailing text is invalid)."""
    if REQ in df.columns:
        return df
    raw = F.col(body)
    df = compute_once(df, _strict=strict_json_text(raw))
    keys = F.json_object_keys("_strict")          # NULL unless the body is an object
    return compute_once(df, **{REQ: F.try_parse_json("_strict"), KEYS: keys}).drop("_strict")


def strict_json_text(raw: Column) -> Column:
    """JSON text that SQL's parser reads as Python does, or null where Python reads none.

    Only texts that their parsed value does not write out again at the same length go to
    Python; for the others it is handed nulls."""
    plain = F.coalesce(F.length(F.to_json(F.try_parse_json(raw))) == F.length(raw), F.lit(False))
    return F.when(plain, raw).otherwise(U.strict_body_udf(F.when(~plain, raw)))


def _get(body: Column, path: str) -> Column:
    return F.try_variant_get(_v(body), path, "variant")


def py_truthy(v: Column) -> Column:
    """Python ``bool()`` of a JSON value held in a VARIANT (missing/null -> False)."""
    t = F.schema_of_variant(v)
    as_num = F.try_variant_get(v, "$", "double")
    return (F.when(v.isNull() | F.is_variant_null(v), F.lit(False))
            .when(t == "BOOLEAN", F.try_variant_get(v, "$", "boolean"))
            .when(t == "STRING", F.length(F.try_variant_get(v, "$", "string")) > 0)
            .when(t.startswith("ARRAY"), F.size(F.try_variant_get(v, "$", "array<variant>")) > 0)
            .when(t.startswith("OBJECT"), t != "OBJECT<>")
            .otherwise(F.coalesce(as_num != 0, F.lit(True))))


def _has_key(body: Column, key: str) -> Column:
    return F.coalesce(F.array_contains(F.col(KEYS), key), F.lit(False))


# The error a request without messages gets.
ERROR_TYPE = "invalid_request_error"
NO_MESSAGES = "messages is required and must be non-empty"


def request_validate(df: DataFrame, body: str = "body") -> DataFrame:
    """``status`` ``ok`` or ``invalid_request_error``, and the ``error`` record
    ``{message, type}`` (null for ``ok``).

    A body that is not one JSON object, one without messages, and a token limit that is
    no number are errors."""
    df = parse_requests(df, body)
    limit = F.coalesce(*[F.when(~F.is_variant_null(_get(F.col(body), f"$.{k}")), _get(F.col(body), f"$.{k}"))
                         for k in ("max_tokens", "max_completion_tokens")])
    message = (F.when(F.col(KEYS).isNull(), F.lit("the body is not a JSON object"))
               .when(~py_truthy(_get(F.col(body), "$.messages")), F.lit(NO_MESSAGES))
               .when(limit.isNotNull() & F.try_variant_get(limit, "$", "double").isNull(), F.lit("max_tokens is not a number")))
    return df.withColumn("_message", message).withColumns({
        "status": F.when(F.col("_message").isNull(), F.lit("ok")).otherwise(F.lit(ERROR_TYPE)),
        "error": F.when(F.col("_message").isNotNull(), F.struct(F.col("_message").alias("message"), F.lit(ERROR_TYPE).alias("type")))
    }).drop("_message")


def request_params(df: DataFrame, body: str = "body", default_model: str = DEFAULT_MODEL) -> DataFrame:
    """Generation parameters; a key that is present but null stays null.  A token limit
    that is no number gives null (``request_validate`` reports it)."""
    df = parse_requests(df, body)
    b = F.col(body)
    num = lambda k: F.try_variant_get(_v(b), f"$.{k}", "double")
    given = lambda k: _get(b, f"$.{k}").isNotNull() & ~F.is_variant_null(_get(b, f"$.{k}"))
    mt = (F.when(given("max_tokens"), num("max_tokens")).when(given("max_completion_tokens"), num("max_completion_tokens"))
          .otherwise(F.lit(float(DEFAULT_MAX_NEW_TOKENS))))
    opt = lambda k, d: F.when(_has_key(b, k), num(k)).otherwise(F.lit(float(d)))
    temperature = opt("temperature", DEFAULT_TEMPERATURE)
    model = F.try_variant_get(_v(b), "$.model", "string")
    capped = F.when(mt.isNotNull(), F.least(mt.cast("bigint"), F.lit(MAX_NEW_TOKENS_CAP)))
    return df.select(
        "*",
        capped.alias("max_new_tokens"),
        temperature.alias("temperature"),
        opt("top_p", DEFAULT_TOP_P).alias("top_p"),
        opt("top_k", DEFAULT_TOP_K).cast("int").alias("top_k"),
        opt("repetition_penalty", DEFAULT_REPETITION_PENALTY).alias("repetition_penalty"),
        F.when(model.isNotNull() & (model != ""), model).otherwise(F.lit(default_model)).alias("model_name"),
        F.coalesce(temperature > 0, F.lit(False)).alias("do_sample"))


def request_facts(df: DataFrame, body: str = "body") -> DataFrame:
    """n_messages, has_tools, stream, include_usage."""
    df = parse_requests(df, body)
    b = F.col(body)
    return df.select(
        "*",
        F.coalesce(F.when(F.schema_of_variant(_get(b, "$.messages")).startswith("ARRAY"),
                          F.size(F.try_variant_get(_get(b, "$.messages"), "$", "array<variant>"))), F.lit(0)).cast("bigint").alias("n_messages"),
        py_truthy(_get(b, "$.tools")).alias("has_tools"),
        py_truthy(_get(b, "$.stream")).alias("stream"),
        py_truthy(_get(b, "$.stream_options.include_usage")).alias("include_usage"))


def messages_prepare(df: DataFrame, body: str = "body") -> DataFrame:
    """C4: message history with tool-call arguments decoded to objects (strict JSON)."""
    msgs = F.get_json_object(F.col(body), "$.messages")
    return df.withColumn("prepared_messages", U.prepare_messages_udf(msgs))


def request_prompt(df: DataFrame, body: str = "body", add_generation_prompt: bool = True) -> DataFrame:
    """P2 of a request body: ``prompt``, the filled chat template with tool list, calls and
    tool turns; null where there are no messages or the template cannot be filled (content
    that is no text, a call without arguments)."""
    parts = df.withColumn("_parts", U.prompt_parts_udf(F.col(body)))
    return parts.withColumn("prompt", F.when(F.col("_parts.messages").isNotNull(), render_prompt(F.col("_parts"), add_generation_prompt))).drop("_parts")


def prompt_usage(df: DataFrame, encoder: Encoder | None = None, body: str = "body") -> DataFrame:
    """Exact prompt counts from the request itself: body, prompt (P2), token ids (P3), count.

    Adds ``prompt`` and ``prompt_tokens_est`` (null without a prompt), the column that
    :func:`usage_totals` falls back on where generation has reported no count."""
    encoder = encoder or U.batch_hash_encoder()
    held = compute_once(request_prompt(df, body), _ids=encoder.ids(F.col("prompt")))
    return held.withColumn("prompt_tokens_est", F.when(F.col("prompt").isNotNull(), F.size("_ids"))).drop("_ids")


def tool_call_extract(df: DataFrame, text: str = "raw_text") -> DataFrame:
    """Remaining text and the parsed calls (ARRAY<STRUCT<name, arguments>>).

    The JVM cuts a text into candidates: the body of a leading fenced block, what follows
    the block, and the whole text without fences.  Python only decodes candidates, and
    only for texts that begin with a fence or an object; all others pass through."""
    raw = F.col(text)
    lead = F.col("_lead")
    df = compute_once(df, _lead=py_lstrip(raw))
    fenced = lead.startswith("```")
    may_call = fenced | lead.startswith("{")
    block = r"^```(?:json)?([\s\S]*?)```([\s\S]*)$"
    closed = fenced & lead.rlike(block)

    def without_fences(t: Column) -> Column:
        return py_strip(F.regexp_replace(F.regexp_replace(t, r"^```(?:json)?", ""), r"`+\z", ""))
    # one row in two steps: what is cut out first is not cut again by what reads it; other texts meet no pattern
    held = compute_once(df, _gate=may_call, _cut=F.when(may_call, F.struct(
        F.when(closed, F.regexp_extract(lead, block, 1)).alias("body"), F.when(closed, py_lstrip(F.regexp_extract(lead, block, 2))).alias("rest"),
        py_strip(lead).alias("bare"))))
    rest = F.col("_cut.rest")
    held = compute_once(held, _bare_rest=F.when(F.col("_gate"), py_strip(rest)))
    after = F.when(F.col("_bare_rest").startswith("```"), without_fences(F.col("_bare_rest"))).otherwise(F.col("_bare_rest"))
    whole = F.when(F.col("_cut.bare").startswith("```"), without_fences(F.col("_cut.bare"))).otherwise(F.col("_cut.bare"))
    held = compute_once(held, _rest=rest, _cands=F.when(F.col("_gate"), F.array(py_strip(F.col("_cut.body")), after, whole)))
    # of rows that cannot hold a call Python sees nulls
    decoded = held.withColumn("_calls", U.decode_calls_udf(F.col("_cands")))
    one, two, all_text = (F.get("_calls", F.lit(i)) for i in range(3))
    found = F.filter(F.when(one.isNotNull(), F.array(one, two)).otherwise(F.array(all_text)), lambda c: c.isNotNull())
    content = (F.when(one.isNotNull() & two.isNull(), F.col("_rest"))
               .when(one.isNotNull() | all_text.isNotNull(), F.lit("")).otherwise(raw))
    return decoded.withColumns(
        {"content": content, "tool_calls": F.coalesce(found, F.array().cast(T.ArrayType(U.TOOL_CALL)))}
    ).drop("_lead", "_cut", "_bare_rest", "_gate", "_rest", "_cands", "_calls")


def tool_call_rows(extracted: DataFrame, key: str = "request_id") -> DataFrame:
    """One row per call (requests without calls keep one row with NULL call)."""
    return extracted.select(key, "content", F.size("tool_calls").alias("n_calls"),
                            F.posexplode_outer("tool_calls").alias("call_idx", "_c")) \
        .select(key, "content", "n_calls", "call_idx", F.col("_c.name").alias("name"),
                F.col("_c.arguments").alias("arguments"))


def tool_call_stats(extracted: DataFrame, key: str = "request_id") -> DataFrame:
    """C6 report: calls and calling requests per tool name, and the calling share.

    One pass: each request brings a row per distinct name with its number of calls, and
    one unnamed row; the share of the unnamed rows is read off the per-name totals (one
    row per tool name)."""
    names = F.array_distinct(F.transform("tool_calls", lambda c: c["name"]))
    per_name = F.transform(names, lambda n: F.struct(n.alias("name"), F.size(
        F.filter("tool_calls", lambda c: c["name"] == n)).alias("n"), F.lit(1).alias("named")))
    own = F.array(F.struct(F.lit(None).cast("string").alias("name"), F.when(F.size("tool_calls") > 0, 1).otherwise(0).alias("n"),
                           F.lit(0).alias("named")))
    rows = extracted.select(F.inline(F.concat(own, per_name)))
    totals = rows.groupBy("named", "name").agg(F.sum("n").alias("n_calls"), F.count(F.lit(1)).alias("n_requests"))
    # names are free text of a model, so only the one unnamed row is joined to all
    share = totals.where("named = 0").select((F.col("n_calls") / F.col("n_requests") * 100.0).alias("calling_pct"))
    return totals.where("named = 1").join(F.broadcast(share)).select("name", "n_calls", "n_requests", "calling_pct")


#: Chunk numbers in a block of a request.
BLOCK_CHUNKS = 1024


def tool_call_stream(chunks: DataFrame, key: str = "request_id", seq: str = "seq",
                     content: str = "content", block_chunks: int = BLOCK_CHUNKS) -> DataFrame:
    """The streaming scanner per request over its ordered chunks (batch form).

    Blocks of chunks are scanned side by side, each as if nothing were held back when it
    begins.  A pass over the blocks of a request in order then hands on what is held back:
    a block that begins with nothing held keeps its parts, another is scanned again from
    the held text.  Rows stream through that pass; no request is held in memory, only the
    text that the scanner itself holds back."""
    kind = chunks.schema[key].dataType
    blocks = (chunks.select(key, F.expr(f"`{seq}` div {block_chunks}").alias("_block"), F.col(seq).alias("_seq"),
                            F.coalesce(F.col(content), F.lit("")).alias("_piece"))
              .groupBy(key, "_block").agg(F.transform(F.array_sort(F.collect_list(F.struct("_seq", "_piece"))), lambda z: z["_piece"]).alias("_pieces")))

    def scan(pdfs):
        import pandas as pd
        for pdf in pdfs:
            got = [U.scan_block("", own) for own in pdf["_pieces"]]
            yield pd.DataFrame({key: pdf[key], "_block": pdf["_block"], "_pieces": pdf["_pieces"],
                                "_parts": [[{"kind": k, "value": v} for k, v in parts] for parts, _ in got], "_held": [held for _, held in got]})

    part = T.ArrayType(T.StructType([T.StructField("kind", T.StringType()), T.StructField("value", T.StringType())]))
    scanned = blocks.mapInPandas(scan, T.StructType([*blocks.schema.fields, T.StructField("_parts", part), T.StructField("_held", T.StringType())]))

    def fold(pdfs):
        import pandas as pd
        now, n, held = None, 0, ""
        for pdf in pdfs:
            out = []

            def emit(parts, out=out):
                nonlocal n
                out += [(now, n + i, k, v) for i, (k, v) in enumerate(parts)]
                n += len(parts)
            for rid, first, pieces, parts, after in zip(pdf[key], pdf["_first"], pdf["_pieces"], pdf["_parts"], pdf["_held"], strict=True):
                if first:
                    emit(U.wire_parts(U.flush_pending(held)))
                    now, n, held = None if pd.isna(rid) else rid, 0, ""
                if held:
                    again, held = U.scan_block(held, pieces)
                    emit(again)
                else:
                    emit([(p["kind"], p["value"]) for p in parts])
                    held = after
            yield pd.DataFrame(out, columns=[key, "part_idx", "kind", "value"])
        yield pd.DataFrame([(now, n + i, k, v) for i, (k, v) in enumerate(U.wire_parts(U.flush_pending(held)))], columns=[key, "part_idx", "kind", "value"])

    first = F.row_number().over(Window.partitionBy(key).orderBy("_block")) == 1
    out_schema = T.StructType([T.StructField(key, kind), T.StructField("part_idx", T.IntegerType()),
                               T.StructField("kind", T.StringType()), T.StructField("value", T.StringType())])
    return scanned.withColumn("_first", first).mapInPandas(fold, out_schema)


def finish_reason(n_calls: Column, gen_ids: Column, eos_id: int) -> Column:
    """tool_calls, else stop when the last generated id is EOS, else length."""
    last = F.try_element_at(gen_ids, F.lit(-1))
    return (F.when(n_calls > 0, F.lit("tool_calls"))
            .when((F.size(gen_ids) > 0) & (last == eos_id), F.lit("stop"))
            .otherwise(F.lit("length")))


def call_records(calls: Column, key: Column) -> Column:
    """Calls as the wire has them: ``{id, type, function{name, arguments}}``.  Ids follow
    from request and position, so that they are the same however often a row is computed."""
    return F.transform(calls, lambda c, i: F.struct(
        F.concat(F.lit("call_"), F.substring(F.md5(F.concat_ws("-", key.cast("string"), i.cast("string"))), 1, 24)).alias("id"),
        F.lit("function").alias("type"), F.struct(c["name"].alias("name"), c["arguments"].alias("arguments")).alias("function")))


def completion_record(df: DataFrame, key: str = "request_id") -> DataFrame:
    """The completion object with usage totals; empty content -> NULL.

    Input columns: content, tool_calls, finish_reason, model_name,
    prompt_tokens, completion_tokens and, if there is one, created (seconds).
    """
    msg = F.struct(F.lit("assistant").alias("role"),
                   F.when(F.col("content") != "", F.col("content")).alias("content"),
                   F.when(F.size("tool_calls") > 0, call_records(F.col("tool_calls"), F.col(key))).alias("tool_calls"))
    usage = F.struct(F.col("prompt_tokens").alias("prompt_tokens"),
                     F.col("completion_tokens").alias("completion_tokens"),
                     (F.col("prompt_tokens") + F.col("completion_tokens")).alias("total_tokens"))
    created = F.col("created") if "created" in df.columns else F.lit(None)
    return df.select(F.col(key).alias("id"), F.lit("chat.completion").alias("object"), created.cast("bigint").alias("created"),
                     F.col("model_name").alias("model"),
                     F.array(F.struct(F.lit(0).alias("index"), msg.alias("message"),
                                      F.col("finish_reason").alias("finish_reason"))).alias("choices"),
                     usage.alias("usage"))


# Fixed value: the shape of a streamed chunk.
CHUNK = ("id string, created bigint, model string, choices array<struct<index: int, delta: struct<content: string, tool_calls: "
         "array<struct<index: int, id: string, type: string, function: struct<name: string, arguments: string>>>>, "
         "finish_reason: string>>, usage struct<prompt_tokens: bigint, completion_tokens: bigint, total_tokens: bigint>")


def chunk_rows(lines: DataFrame, value: str = "value") -> DataFrame:
    """The chunks of a served log (``data: {...}`` lines), flat: one row per chunk and
    tool-call delta.  Comments, ``[DONE]``, error objects and undecodable lines drop out."""
    data = py_strip(F.substring(F.col(value), 6, 1 << 30))
    seen = lines.where(F.col(value).startswith("data:")).withColumn("_data", data)
    c = compute_once(seen.where("_data <> '' and _data <> '[DONE]'"), _text=strict_json_text(F.col("_data"))) \
        .withColumn("_c", F.from_json("_text", CHUNK)).where("_c.choices is not null")
    choice = F.get("_c.choices", F.lit(0))
    keep = [x for x in lines.columns if x != value]
    flat = c.select(*keep, F.col("_c.id").alias("id"), F.col("_c.created").alias("created"), F.col("_c.model").alias("model"),
                    choice["delta"]["content"].alias("content"), choice["finish_reason"].alias("finish_reason"), "_c.usage",
                    F.posexplode_outer(choice["delta"]["tool_calls"]).alias("_nth", "_t"))
    first = F.col("_nth").isNull() | (F.col("_nth") == 0)
    return flat.select(*keep, "id", "created", "model", F.when(first, F.col("content")).alias("content"), "finish_reason",
                       F.coalesce("_nth", F.lit(0)).alias("tool_nth"), F.col("_t.index").alias("tool_index"), F.col("_t.id").alias("tool_id"), F.col("_t.function.name").alias("tool_name"),
                       F.col("_t.function.arguments").alias("tool_args"),
                       *[F.col(f"usage.{u}_tokens").alias(f"usage_{u}_tokens") for u in ("prompt", "completion", "total")])


def chat_log_report(requests: DataFrame, chunks: DataFrame, key: str = "request_id", body: str = "body") -> DataFrame:
    """Requests with their streamed answers: C1-C3 of the body, C11 reassembly, C6 calls
    still in the text, C8 finish reason, C12 latency and C13 usage.  ``chunks`` is the
    result of :func:`chunk_rows` with ``seq`` and ``ts``; a request without chunks keeps
    nulls there."""
    asked = request_facts(request_params(request_validate(requests, body), body), body).drop(body, REQ, KEYS)
    whole = chunk_reassemble(chunks, key, ts="ts")
    calls = F.coalesce(F.transform("tool_calls", lambda c: F.struct(c["name"].alias("name"), c["arguments"].alias("arguments"))),
                       F.array().cast(T.ArrayType(U.TOOL_CALL)))
    answered = tool_call_extract(whole.withColumns({"_streamed": calls, "_text": F.col("content"), "_finish": F.col("finish_reason")})
                                 .drop("tool_calls", "content", "finish_reason"), "_text")
    answered = answered.withColumn("tool_calls", F.concat("_streamed", "tool_calls")).withColumn(
        "finish_reason", F.when(F.size("tool_calls") > 0, F.lit("tool_calls")).otherwise(F.coalesce("_finish", F.lit("length"))))
    answered = answered.drop("_streamed", "_text", "_finish")
    return asked.join(answered, key, "left")


def chunk_reassemble(chunks: DataFrame, key: str = "request_id", seq: str = "seq", ts: str | None = None,
                     block_chunks: int = BLOCK_CHUNKS) -> DataFrame:
    """C11: content joined in order, last non-null finish reason, usage if any.

    Optional columns: ``tool_index``, ``tool_id``, ``tool_name``, ``tool_args`` (tool-call
    deltas; ``tool_nth`` orders those of one chunk) and ``usage_*`` (the choice-less chunk).
    With ``ts`` the latency columns of :func:`ttft` come along.

    The chunks of a block are joined first, text and each tool call on their own; a request
    then puts together one row per block and text or call."""
    cols = set(chunks.columns)
    tools = "tool_index" in cols
    none = F.lit(None).cast(f"struct<s:{chunks.schema[seq].dataType.simpleString()},v:string>")

    def given(c: str) -> Column:
        """The value and its chunk's number where there is one."""
        value = F.when(F.col(c) != "", F.col(c)) if c in ("tool_id", "tool_name") else F.col(c)
        return F.when(value.isNotNull(), F.struct(F.col(seq).alias("s"), value.alias("v")))
    piece = F.struct(F.lit(-1).alias("slot"), F.lit(0).alias("nth"), F.coalesce(F.col("content"), F.lit("")).alias("text"),
                     given("finish_reason").alias("finish"), none.alias("name"), none.alias("id"))
    entries = F.array(piece)
    if tools:
        nth = F.col("tool_nth") if "tool_nth" in cols else F.lit(0)
        delta = F.struct(F.col("tool_index").cast("int").alias("slot"), nth.alias("nth"), F.coalesce("tool_args", F.lit("")).alias("text"),
                         none.alias("finish"), given("tool_name").alias("name"), given("tool_id").alias("id"))
        entries = F.when(F.col("tool_index").isNotNull(), F.array(piece, delta)).otherwise(entries)
    usage = [u for u in ("usage_prompt_tokens", "usage_completion_tokens", "usage_total_tokens") if u in cols]
    clock = [F.unix_micros(F.col(ts).cast("timestamp")).alias("_t")] if ts else []
    rows = chunks.select(key, F.col(seq).alias("_seq"), F.expr(f"`{seq}` div {block_chunks}").alias("_block"), *[given(u).alias(u) for u in usage], *clock,
                         F.inline(entries))
    own = F.col("slot") == -1
    marks = ["finish", "name", "id"]
    parts = rows.groupBy(key, "_block", "slot").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("_seq", "nth", "text"))), lambda z: z["text"]), "").alias("text"),
        F.count(F.lit(1)).alias("n"), *[F.max(c).alias(c) for c in [*marks, *usage]],
        *([F.min("_t").alias("t0"), F.max("_t").alias("t1"), F.min(F.when(F.col("text") != "", F.col("_t"))).alias("tf")] if ts else []))
    whole = parts.groupBy(key).agg(
        F.array_sort(F.collect_list(F.struct("slot", "_block", "text", "name", "id"))).alias("_parts"),
        F.max("finish").alias("_finish"), F.sum(F.when(own, F.col("n"))).alias("n_chunks"), *[F.max(u).alias(u) for u in usage],
        *([F.min("t0").alias("t0"), F.max("t1").alias("t1"), F.min(F.when(own, F.col("tf"))).alias("tf")] if ts else []))

    def joined(of: Column) -> Column:
        return F.array_join(F.transform(of, lambda p: p["text"]), "")

    def call(slot: Column) -> Column:
        of = F.filter("_parts", lambda p: p["slot"] == slot)
        return F.struct(slot.alias("tool_index"), F.array_max(F.transform(of, lambda p: p["id"]))["v"].alias("id"),
                        F.array_max(F.transform(of, lambda p: p["name"]))["v"].alias("name"), joined(of).alias("arguments"))
    slots = F.array_distinct(F.transform(F.filter("_parts", lambda p: p["slot"] >= 0), lambda p: p["slot"]))
    out = [F.col(key), joined(F.filter("_parts", lambda p: p["slot"] == -1)).alias("content"), F.col("_finish.v").alias("finish_reason"), "n_chunks",
           *[F.col(f"{u}.v").alias(u) for u in usage]]
    if tools:
        out.append(F.when(F.size(slots) > 0, F.transform(slots, call)).alias("tool_calls"))
    if ts:
        out += [((F.col("tf") - F.col("t0")) / 1e6).alias("ttft_sec"), ((F.col("t1") - F.col("t0")) / 1e6).alias("total_sec")]
    return whole.select(*out)


def ttft(chunks: DataFrame, key: str = "request_id", ts: str = "ts", start: str | None = None) -> DataFrame:
    """Seconds to the first non-empty content and total seconds (from ``start`` or the first chunk)."""
    t = F.unix_micros(F.col(ts).cast("timestamp"))
    first = F.min(F.when(F.coalesce(F.col("content"), F.lit("")) != "", t))
    t0 = F.min(F.unix_micros(F.col(start).cast("timestamp"))) if start else F.min(t)
    return chunks.groupBy(key).agg(((first - t0) / 1e6).alias("ttft_sec"), ((F.max(t) - t0) / 1e6).alias("total_sec"))


def usage_totals(log: DataFrame, by: str = "model") -> DataFrame:
    """Exact prompt counts preferred over estimates; totals per model."""
    p = F.coalesce(F.col("prompt_tokens_exact"), F.col("prompt_tokens_est"))
    x = log.withColumn("_p", p).withColumn("_t", F.col("_p") + F.col("completion_tokens"))
    return x.groupBy(by).agg(F.count(F.lit(1)).alias("n_requests"),
                             F.sum("_p").cast("bigint").alias("prompt_tokens"),
                             F.sum("completion_tokens").cast("bigint").alias("completion_tokens"),
                             F.sum("_t").cast("bigint").alias("total_tokens"))
