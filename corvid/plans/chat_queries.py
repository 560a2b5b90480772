"""Registered chat-log queries (C1-C13) over request, completion and chunk views."""
from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.chat import ASSISTANT_MARKER, IM_END, IM_START, QWEN_DEFAULT_SYSTEM, TOOLS_HEAD, TOOLS_TAIL
from ..functions.tokens import DEFAULT_VOCAB, PIECE_PATTERN
from ..operators import chat as CH
from ..sources.fixtures import view
from . import duck
from .registry import register

EOS = DEFAULT_VOCAB.eos_id
CALL_FORMS = (0, 1, 2, 4, 6)     # v_tool_text forms (event_id % 8) that hold one call

# the strict reading of a body: repeated keys keep the last (form 5), trailing text is no JSON (form 6)
D_REQ = """
r AS (SELECT request_id, CASE WHEN form = 6 THEN NULL WHEN form = 5 THEN
  '{"messages":' || regexp_extract(body, '"messages":\\[\\], "messages":(.*), "max_tokens":7\\}$', 1, 's') || ',"max_tokens":7}' ELSE body END AS body
 FROM v_requests)"""
D_NUM = "TRY_CAST(json_extract_string(body, '$.{k}') AS DOUBLE)"


def _d_opt(k, d):
    return f"CASE WHEN list_contains(json_keys(body), '{k}') THEN {D_NUM.format(k=k)} ELSE {d} END"


D_PARAMS = f"""
SELECT request_id,
 CASE WHEN json_extract_string(body, '$.max_tokens') IS NOT NULL AND {D_NUM.format(k='max_tokens')} IS NULL THEN NULL ELSE
 least(CAST(trunc(coalesce({D_NUM.format(k='max_tokens')}, {D_NUM.format(k='max_completion_tokens')}, 512.0)) AS BIGINT), 4096) END AS max_new_tokens,
 {_d_opt('temperature', 0.2)} AS temperature, {_d_opt('top_p', 0.95)} AS top_p, CAST({_d_opt('top_k', 50.0)} AS INTEGER) AS top_k,
 {_d_opt('repetition_penalty', 1.05)} AS repetition_penalty,
 coalesce(nullif(json_extract_string(body, '$.model'), ''), 'default') AS model_name,
 coalesce({_d_opt('temperature', 0.2)} > 0, false) AS do_sample
FROM r"""

D_FACTS = """
SELECT request_id, CAST(coalesce(json_array_length(body, '$.messages'), 0) AS BIGINT) AS n_messages,
 coalesce(json_array_length(body, '$.tools'), 0) > 0 AS has_tools,
 coalesce(json_extract_string(body, '$.stream') = 'true', false) AS stream,
 coalesce(json_extract_string(body, '$.stream_options.include_usage') = 'true', false) AS include_usage
FROM r"""

D_MESSAGE = f"""CASE WHEN body IS NULL THEN 'the body is not a JSON object'
  WHEN coalesce(json_array_length(body, '$.messages'), 0) = 0 THEN 'messages is required and must be non-empty'
  WHEN json_extract_string(body, '$.max_tokens') IS NOT NULL AND {D_NUM.format(k='max_tokens')} IS NULL THEN 'max_tokens is not a number' END"""
D_STATUS = f"""
SELECT request_id, CASE WHEN {D_MESSAGE} IS NULL THEN 'ok' ELSE 'invalid_request_error' END AS status, {D_MESSAGE} AS error_message FROM r"""


def _requests(spark, sf):
    return view(spark, sf, "v_requests")


@register("request_validate", ("v_requests",), "WITH " + D_REQ.strip() + D_STATUS)
def q_validate(spark, sf):
    return CH.request_validate(_requests(spark, sf)).select("request_id", "status", F.col("error.message").alias("error_message"))


@register("request_params", ("v_requests",), "WITH " + D_REQ.strip() + D_PARAMS)
def q_params(spark, sf):
    return CH.request_params(_requests(spark, sf)).drop("body", "form", "n_turns", CH.REQ, CH.KEYS)


@register("request_facts", ("v_requests",), "WITH " + D_REQ.strip() + D_FACTS)
def q_facts(spark, sf):
    return CH.request_facts(_requests(spark, sf)).drop("body", "form", "n_turns", CH.REQ, CH.KEYS)


@register("messages_prepare", ("v_tool_history",), """
SELECT request_id, request_id % 3 <> 1 AS args_decoded,
 CASE WHEN request_id % 3 <> 1 THEN json_extract_string(e.props, '$.k') END AS arg_k
FROM v_tool_history JOIN events e ON e.event_id = request_id""")
def q_prepare(spark, sf):
    p = CH.messages_prepare(view(spark, sf, "v_tool_history"))
    a = F.get_json_object("prepared_messages", "$[1].tool_calls[0].function.arguments")
    return p.select("request_id", a.startswith("{").alias("args_decoded"),
                    F.get_json_object("prepared_messages", "$[1].tool_calls[0].function.arguments.k").alias("arg_k"))


_SYSTEM = f"{IM_START}system\n{QWEN_DEFAULT_SYSTEM}"
_CALL = """'\n<tool_call>\n{{"name": "' || {name} || '", "arguments": ' || {args} || '}}\n</tool_call>'"""


def _d_prompts():
    """Expected prompts, written out from the tables that the bodies are made of."""
    def nl(text):
        return text.replace("\n", "' || chr(10) || '")
    head, tail, end = (nl(duck.q(x)) for x in (TOOLS_HEAD, TOOLS_TAIL, IM_END + "\n"))
    ask = nl(duck.q(ASSISTANT_MARKER))
    start, default = duck.q(IM_START), nl(duck.q(_SYSTEM))
    tool = """'{"type": "function", "function": {"name": "f", "parameters": {"type": "object", "z": {"k": "é"}, "a": [1, 2.5, true, null]}}}'"""
    call = nl(_CALL)
    answer = nl("'\n<tool_response>\n' || {x} || '\n</tool_response>'")
    return f"""
WITH t AS (SELECT conv_id, list(role ORDER BY turn) AS roles, list(coalesce(text, '') ORDER BY turn) AS texts FROM conversations GROUP BY conv_id),
a AS (SELECT 'requests' AS src, v.request_id, CASE WHEN form IN (2, 3, 6) THEN NULL ELSE
  CASE WHEN t.roles[1] = 'system' THEN {start} || 'system' || chr(10) || t.texts[1] ELSE {default} END ||
  CASE WHEN form = 4 THEN {head} || chr(10) || '{{"type": "function"}}' || {tail} ELSE '' END || {end} ||
  array_to_string(list_transform(range(1, len(t.roles) + 1), lambda i: CASE WHEN t.roles[i] = 'system' AND i = 1 THEN '' ELSE
    {start} || t.roles[i] || chr(10) || t.texts[i] || {end} END), '') || {ask} END AS prompt
  FROM v_requests v JOIN t ON t.conv_id = v.request_id),
h AS (SELECT 'history' AS src, request_id, {default} || {end} || {start} || 'user' || chr(10) || 'q' || {end} || {start} || 'assistant' ||
  {call.format(name='e.event_type', args="CASE WHEN request_id % 3 = 1 THEN '" + chr(34) + "x{" + chr(34) + "' ELSE e.props END")} || {end} || {ask} AS prompt
  FROM v_tool_history JOIN events e ON e.event_id = request_id),
c AS (SELECT 'tools' AS src, request_id, CASE WHEN request_id % 2 = 0 THEN {start} || 'system' || chr(10) || 'Be brief.' ELSE {default} END ||
  CASE WHEN request_id % 5 = 0 THEN '' ELSE {head} || chr(10) || {tool} || {tail} END || {end} ||
  {start} || 'user' || chr(10) || 'run ' || event_type || {end} || {start} || 'assistant' || CASE WHEN request_id % 3 = 2 THEN chr(10) || 'Let me see.' ELSE '' END ||
  {call.format(name='event_type', args='props')} || {call.format(name="'g'", args='props')} || {end} ||
  {start} || 'user' || {answer.format(x="'one'")} || {answer.format(x='CAST(user_id AS VARCHAR)')} || {end} ||
  {start} || 'assistant' || chr(10) || 'done' || {end} || {start} || 'user' || chr(10) || 'thanks é' || {end} ||
  {start} || 'user' || {answer.format(x="'late'")} || {end} || {ask} AS prompt FROM v_tool_chat),
p AS (SELECT * FROM a UNION ALL SELECT * FROM h UNION ALL SELECT * FROM c)"""


def _bodies(spark, sf):
    parts = [view(spark, sf, v).select(F.lit(src).alias("src"), "request_id", "body")
             for src, v in (("requests", "v_requests"), ("history", "v_tool_history"), ("tools", "v_tool_chat"))]
    # a table in one file is read by one task; the work per body is dealt to all
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)
    return parts[0].unionAll(parts[1]).unionAll(parts[2]).repartition(tasks, "src", "request_id", "body")


@register("chat_prompt_tools", ("v_requests", "v_tool_history", "v_tool_chat"), _d_prompts() + """
SELECT src, request_id, prompt FROM p""")
def q_prompt_tools(spark, sf):
    return CH.request_prompt(_bodies(spark, sf)).drop("body")


@register("prompt_usage", ("v_requests", "v_tool_history", "v_tool_chat"), _d_prompts() + f"""
SELECT src AS model, count(*) AS n_requests, CAST(sum(n) AS BIGINT) AS prompt_tokens, CAST(sum(done) AS BIGINT) AS completion_tokens,
 CAST(sum(n + done) AS BIGINT) AS total_tokens
FROM (SELECT src, CASE WHEN request_id % 4 = 0 THEN 11 ELSE len(regexp_extract_all(prompt, {duck.q(PIECE_PATTERN)}, 0)) END AS n, request_id % 97 AS done FROM p)
GROUP BY src""")
def q_prompt_usage(spark, sf):
    counted = CH.prompt_usage(_bodies(spark, sf)).select(
        F.col("src").alias("model"), "prompt_tokens_est", F.when(F.col("request_id") % 4 == 0, 11).alias("prompt_tokens_exact"),
        (F.col("request_id") % 97).alias("completion_tokens"))
    return CH.usage_totals(counted)


def _d_calls():
    forms = ", ".join(str(x) for x in CALL_FORMS)
    return f"""
WITH t AS (SELECT v.request_id, v.raw_text, e.event_type, e.props, v.request_id % 8 AS form
           FROM v_tool_text v JOIN events e ON e.event_id = v.request_id),
c AS (SELECT request_id,
  CASE WHEN form IN ({forms}) THEN (CASE WHEN form = 2 THEN 'tail' ELSE '' END) ELSE raw_text END AS content,
  CASE WHEN form IN ({forms}) THEN 1 ELSE 0 END AS n_calls,
  CASE WHEN form IN ({forms}) THEN 0 END AS call_idx,
  CASE WHEN form = 0 THEN event_type WHEN form IN ({forms}) THEN 'f' END AS name,
  CASE WHEN form IN (0, 1) THEN props WHEN form IN ({forms}) THEN '{{}}' END AS arguments FROM t)"""


@register("tool_call_extract", ("v_tool_text",), _d_calls() + """
SELECT request_id, content, n_calls, call_idx, name, arguments FROM c""")
def q_tool_extract(spark, sf):
    x = CH.tool_call_extract(view(spark, sf, "v_tool_text"))
    r = CH.tool_call_rows(x)
    return r.select("request_id", "content", F.col("n_calls").cast("int").alias("n_calls"),
                    F.col("call_idx").cast("int").alias("call_idx"), "name", "arguments")


@register("tool_call_stats", ("v_tool_text",), _d_calls() + """
SELECT name, count(*) AS n_calls, count(DISTINCT request_id) AS n_requests,
 round((SELECT sum(n_calls) * 100.0 / count(*) FROM c), 6) AS calling_pct
FROM c WHERE n_calls > 0 GROUP BY name""")
def q_tool_stats(spark, sf):
    x = CH.tool_call_extract(view(spark, sf, "v_tool_text"))
    return CH.tool_call_stats(x).withColumn("calling_pct", F.round("calling_pct", 6))


@register("tool_call_stream", ("v_chunks",), """
SELECT request_id, CAST(row_number() OVER (PARTITION BY request_id ORDER BY seq) - 1 AS INTEGER) AS part_idx,
 'text' AS kind, content AS value FROM v_chunks WHERE content <> ''""")
def q_tool_stream(spark, sf):
    return CH.tool_call_stream(view(spark, sf, "v_chunks"))


def _gen_ids():
    c = F.col("completion_tokens")
    return (F.when(c == 0, F.array().cast("array<int>"))
            .when(F.col("ends_with_eos"), F.concat(F.array_repeat(F.lit(17), c - 1), F.array(F.lit(EOS))))
            .otherwise(F.array_repeat(F.lit(17), c)))


def _completions(spark, sf):
    log = view(spark, sf, "v_completion_log")
    x = CH.tool_call_extract(log)
    x = x.withColumn("finish_reason", CH.finish_reason(F.size("tool_calls"), _gen_ids(), EOS))
    return x


D_FINISH = f"""CASE WHEN request_id % 8 IN ({", ".join(str(x) for x in CALL_FORMS)}) THEN 'tool_calls'
 WHEN completion_tokens > 0 AND ends_with_eos THEN 'stop' ELSE 'length' END"""


@register("finish_reason", ("v_completion_log",), f"""
SELECT request_id, {D_FINISH} AS finish_reason FROM v_completion_log""")
def q_finish(spark, sf):
    return _completions(spark, sf).select("request_id", "finish_reason")


@register("completion_record", ("v_completion_log", "v_tool_text"), _d_calls() + f""",
l AS (SELECT * FROM v_completion_log)
SELECT l.request_id AS id, 'chat.completion' AS object, coalesce(l.model, 'default') AS model,
 nullif(c.content, '') AS content, c.n_calls AS n_tool_calls,
 CASE WHEN c.n_calls > 0 THEN 'call_' || substr(md5(CAST(l.request_id AS VARCHAR) || '-0'), 1, 24) END AS call_id, c.name AS call_name, {D_FINISH.replace('request_id', 'l.request_id')} AS finish_reason,
 coalesce(prompt_tokens_exact, prompt_tokens_est) AS prompt_tokens, completion_tokens,
 coalesce(prompt_tokens_exact, prompt_tokens_est) + completion_tokens AS total_tokens
FROM l JOIN c ON c.request_id = l.request_id""")
def q_record(spark, sf):
    x = _completions(spark, sf)
    x = x.withColumn("model_name", F.coalesce("model", F.lit(CH.DEFAULT_MODEL))) \
        .withColumn("prompt_tokens", F.coalesce("prompt_tokens_exact", "prompt_tokens_est"))
    r = CH.completion_record(x)
    ch = F.col("choices")[0]
    call = F.get(ch["message"]["tool_calls"], F.lit(0))
    return r.select("id", "object", "model", ch["message"]["content"].alias("content"),
                    F.coalesce(F.size(ch["message"]["tool_calls"]), F.lit(0)).alias("n_tool_calls"),
                    call["id"].alias("call_id"), call["function"]["name"].alias("call_name"),
                    ch["finish_reason"].alias("finish_reason"),
                    F.col("usage.prompt_tokens").alias("prompt_tokens"),
                    F.col("usage.completion_tokens").alias("completion_tokens"),
                    F.col("usage.total_tokens").alias("total_tokens"))


@register("chunk_reassemble", ("v_chunks",), """
SELECT request_id, string_agg(content, '' ORDER BY seq) AS content,
 arg_max(finish_reason, seq) FILTER (WHERE finish_reason IS NOT NULL) AS finish_reason, count(*) AS n_chunks
FROM v_chunks GROUP BY request_id""")
def q_reassemble(spark, sf):
    return CH.chunk_reassemble(view(spark, sf, "v_chunks"))


@register("ttft", ("v_chunks",), """
SELECT request_id,
 round((min(epoch_us(ts)) FILTER (WHERE content <> '') - min(epoch_us(ts))) / 1e6, 6) AS ttft_sec,
 round((max(epoch_us(ts)) - min(epoch_us(ts))) / 1e6, 6) AS total_sec
FROM v_chunks GROUP BY request_id""")
def q_ttft(spark, sf):
    t = CH.ttft(view(spark, sf, "v_chunks"))
    return t.select("request_id", F.round("ttft_sec", 6).alias("ttft_sec"), F.round("total_sec", 6).alias("total_sec"))


@register("usage_totals", ("v_completion_log",), """
SELECT model, count(*) AS n_requests, CAST(sum(coalesce(prompt_tokens_exact, prompt_tokens_est)) AS BIGINT) AS prompt_tokens,
 CAST(sum(completion_tokens) AS BIGINT) AS completion_tokens,
 CAST(sum(coalesce(prompt_tokens_exact, prompt_tokens_est) + completion_tokens) AS BIGINT) AS total_tokens
FROM v_completion_log GROUP BY model""")
def q_usage(spark, sf):
    return CH.usage_totals(view(spark, sf, "v_completion_log"))


# the served log by the rules of its lines: text after the object (x) is no JSON, the last of repeated keys wins
D_CHUNKS = """
l AS (SELECT request_id, seq, ts, trim(substr(line, 6)) AS j FROM v_chunk_lines WHERE starts_with(line, 'data:')),
j AS (SELECT request_id, seq, ts, CASE WHEN j LIKE '%"content":"a","content":"b"%' THEN replace(j, '"content":"a",', '') ELSE j END AS j
      FROM l WHERE j <> '[DONE]' AND NOT j LIKE '%} x'),
k AS (SELECT request_id, seq, ts, json_extract_string(j, '$.choices[0].delta.content') AS content,
  json_extract_string(j, '$.choices[0].finish_reason') AS finish_reason,
  CAST(json_extract(j, '$.choices[0].delta.tool_calls') AS JSON[]) AS deltas, json_extract(j, '$.usage') AS usage FROM j),
d AS (SELECT request_id, seq, generate_subscripts(deltas, 1) AS nth, unnest(deltas) AS t FROM k WHERE deltas IS NOT NULL),
tc AS (SELECT request_id, CAST(json_extract(t, '$.index') AS INTEGER) AS idx,
  arg_max(json_extract_string(t, '$.function.name'), seq) FILTER (WHERE json_extract_string(t, '$.function.name') IS NOT NULL) AS name,
  string_agg(json_extract_string(t, '$.function.arguments'), '' ORDER BY seq, nth) AS args FROM d GROUP BY 1, 2),
tcs AS (SELECT request_id, count(*) AS n_tools, string_agg(coalesce(name, '?') || args, ' ' ORDER BY idx) AS tools FROM tc GROUP BY 1),
whole AS (SELECT request_id, string_agg(content, '' ORDER BY seq) AS content,
  arg_max(finish_reason, seq) FILTER (WHERE finish_reason IS NOT NULL) AS finish_reason,
  CAST(json_extract(arg_max(usage, seq) FILTER (WHERE usage IS NOT NULL), '$.total_tokens') AS BIGINT) AS total_tokens,
  round((min(epoch_us(ts)) FILTER (WHERE content <> '') - min(epoch_us(ts))) / 1e6, 6) AS ttft_sec,
  round((max(epoch_us(ts)) - min(epoch_us(ts))) / 1e6, 6) AS total_sec FROM k GROUP BY 1)"""


def _chunk_rows(spark, sf):
    return CH.chunk_rows(view(spark, sf, "v_chunk_lines"), "line")


@register("chunk_log_reassemble", ("v_chunk_lines",), "WITH " + D_CHUNKS.strip() + """
SELECT request_id, coalesce(content, '') AS content, finish_reason, total_tokens, coalesce(tools, '') AS tools
FROM whole LEFT JOIN tcs USING (request_id)""")
def q_chunk_log(spark, sf):
    w = CH.chunk_reassemble(_chunk_rows(spark, sf))
    tools = F.array_join(F.transform("tool_calls", lambda c: F.concat(F.coalesce(c["name"], F.lit("?")), c["arguments"])), " ")
    return w.select("request_id", "content", "finish_reason", F.col("usage_total_tokens").alias("total_tokens"),
                    F.coalesce(tools, F.lit("")).alias("tools"))


@register("chat_report", ("v_requests", "v_chunk_lines"), f"""
WITH {D_REQ.strip()}, st AS ({D_STATUS}), pa AS ({D_PARAMS}), fa AS ({D_FACTS}), {D_CHUNKS.strip()},
an AS (SELECT request_id, CASE WHEN json_valid(content) THEN '' ELSE coalesce(content, '') END AS content,
  coalesce(n_tools, 0) + CASE WHEN json_valid(content) THEN 1 ELSE 0 END AS n_calls, finish_reason, total_tokens, ttft_sec, total_sec
  FROM whole LEFT JOIN tcs USING (request_id))
SELECT st.*, pa.* EXCLUDE request_id, fa.* EXCLUDE request_id, content, CAST(n_calls AS INTEGER) AS n_calls,
 CASE WHEN n_calls > 0 THEN 'tool_calls' WHEN n_calls IS NOT NULL THEN coalesce(finish_reason, 'length') END AS finish_reason,
 total_tokens, ttft_sec, total_sec
FROM st JOIN pa USING (request_id) JOIN fa USING (request_id) LEFT JOIN an USING (request_id)""")
def q_chat_report(spark, sf):
    r = CH.chat_log_report(_requests(spark, sf).drop("form", "n_turns"), _chunk_rows(spark, sf))
    return r.select(*[c for c in r.columns if c not in ("error", "tool_calls", "n_chunks", "ttft_sec", "total_sec")
                      and not c.startswith("usage_")], F.col("error.message").alias("error_message"),
                    F.when(F.col("tool_calls").isNotNull(), F.size("tool_calls")).alias("n_calls"),
                    F.col("usage_total_tokens").alias("total_tokens"), F.round("ttft_sec", 6).alias("ttft_sec"),
                    F.round("total_sec", 6).alias("total_sec"))
