"""Input views derived from the driver tables.

Each view is plain SQL over the driver tables so the same rows can be
produced by Spark (for the library) and by DuckDB (for the oracle check).
Where the two dialects differ the view carries one text per dialect.
The views only reshape driver data into the record shapes the operators
consume (raw examples, router logits, chat logs); every view scales with the
tables it reads.
"""
from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

from .tables import register_tables

# name -> (dependencies, spark sql, duckdb sql or None when identical)
VIEWS: dict[str, tuple[tuple[str, ...], str, str | None]] = {}


def _view(name, deps, spark_sql, duck_sql=None):
    VIEWS[name] = (tuple(deps), spark_sql.strip(), duck_sql.strip() if duck_sql else None)


_view("v_pairs", (), """
SELECT u.conv_id*1000003+u.turn AS raw_id, u.text AS instruction, a.text AS output
FROM conversations u JOIN conversations a ON a.conv_id=u.conv_id AND a.turn=u.turn+1
WHERE u.role='user' AND a.role='assistant'
""")

_view("v_alpaca", ("v_pairs",), """
SELECT raw_id, instruction,
 CASE raw_id%4 WHEN 0 THEN NULL WHEN 1 THEN '' WHEN 2 THEN ' ' || chr(10) ELSE 'ctx ' || raw_id END AS input,
 output
FROM v_pairs
""")

_view("v_scored", ("v_pairs",), """
SELECT raw_id, instruction AS input, CASE WHEN raw_id%13=0 THEN '  ' ELSE output END AS output,
 CASE raw_id%7 WHEN 0 THEN '' WHEN 1 THEN 'n/a' WHEN 2 THEN '0.5' WHEN 3 THEN '0.8' ELSE '1' END AS average_test_score,
 CASE raw_id%5 WHEN 0 THEN '' WHEN 1 THEN '{bad'
   WHEN 2 THEN '{"a":{"score":5},"b":{"score":4},"c":{"score":4}}'
   WHEN 3 THEN '{"a":{"score":5},"b":{"score":4},"note":"x"}'
   ELSE CASE raw_id%3 WHEN 0 THEN '{"a":{"score":1},"a":{"score":5}}' WHEN 1 THEN '{"a":{"score":5}} {"b":1}' ELSE '{"a":{"score":5}}' END END AS llm_judgement
FROM v_pairs
""")

_view("v_prompt_cut", ("v_pairs",), """
SELECT raw_id,
 CASE WHEN raw_id%2=0 THEN instruction || chr(10) || chr(10) || '### Output:' || chr(10) || output
      ELSE ' ' || instruction || chr(10) END AS prompt,
 output
FROM v_pairs
""")

_view("v_contest", ("v_pairs",), """
SELECT raw_id,
 CASE WHEN raw_id%3=2 THEN 'INCORRECT' ELSE 'CORRECT' END AS solution_type,
 CASE raw_id%4 WHEN 0 THEN 'cpp' WHEN 1 THEN 'java' WHEN 2 THEN 'python3' ELSE 'python2' END AS programming_language,
 instruction AS description, output AS solution
FROM v_pairs
""")

_view("v_query_answer", ("v_pairs",), """
SELECT raw_id, CASE WHEN raw_id%11=0 THEN NULL ELSE instruction END AS query,
 CASE WHEN raw_id%9=0 THEN chr(10) || ' ' ELSE output END AS answer
FROM v_pairs
""")

_view("v_problem_solution", ("v_pairs",), """
SELECT raw_id, CASE WHEN raw_id%10=3 THEN '' ELSE instruction END AS problem,
 CASE WHEN raw_id%8=1 THEN NULL ELSE output END AS solution
FROM v_pairs
""")

_view("v_code", (), """
SELECT doc_id, CASE doc_id%3 WHEN 0 THEN ' Python ' WHEN 1 THEN 'java' ELSE 'go' END AS language,
 CASE doc_id%3
   WHEN 0 THEN CASE doc_id%2 WHEN 0 THEN 'def f(x):' ELSE 'def f(x: int):' END || chr(10) || '    \"\"\"' || text || '\"\"\"' || chr(10) || '    return x'
   WHEN 1 THEN '/** ' || text || ' */ int f() { /** keep */ return 1; }'
   ELSE 'func f() {}' END AS func_code_string,
 text AS func_documentation_string
FROM documents
""")

_LANG4 = """
SELECT doc_id, text AS content,
 CASE WHEN doc_id%2=0 THEN 'J' || text END AS java, CASE WHEN doc_id%3=0 THEN 'C' || text END AS {cpp},
 CASE WHEN doc_id%5<>0 THEN 'P' || text END AS python,
 CASE WHEN doc_id%7=0 THEN ' ' ELSE 'S' || text END AS javascript
FROM documents
"""
_view("v_lang4", (), _LANG4.format(cpp="`c++`"), _LANG4.format(cpp='"c++"'))

_view("v_schema_q", (), """
SELECT doc_id AS raw_id,
 CASE WHEN doc_id%11=0 THEN ' ' ELSE 'CREATE TABLE t_' || lang || ' (id INT, ' || source || ' TEXT)' END AS context,
 CASE WHEN doc_id%13=0 THEN NULL ELSE text END AS question,
 'SELECT ' || source || ' FROM t_' || lang || ' WHERE n = ' || CAST(n_chars AS STRING) AS answer
FROM documents
""", """
SELECT doc_id AS raw_id,
 CASE WHEN doc_id%11=0 THEN ' ' ELSE 'CREATE TABLE t_' || lang || ' (id INT, ' || source || ' TEXT)' END AS context,
 CASE WHEN doc_id%13=0 THEN NULL ELSE text END AS question,
 'SELECT ' || source || ' FROM t_' || lang || ' WHERE n = ' || CAST(n_chars AS VARCHAR) AS answer
FROM documents
""")

# One pass over all embeddings: 64 values are 8 layers x 8 experts.  A session has 50 rows;
# its steps start from 0 again and have two tokens and one token by turns.
_LOGIT_ROWS = """SELECT CAST(floor(vec_id/50) AS BIGINT) AS session, CAST(floor((vec_id%50)*2/3) AS BIGINT) AS step,
 CASE WHEN (vec_id%50)%3=1 THEN 1 ELSE 0 END AS token, CAST(floor(vec_id/2) AS BIGINT) AS train_step,
 CAST(floor((vec_id%50)*2/3)*0.5 + (CAST(floor((vec_id%50)*2/3) AS BIGINT)%3)*0.125 AS DOUBLE) AS t_sec, embedding FROM embeddings"""

_view("v_logits", (), f"""
SELECT session, step, token, train_step, t_sec, layer, transform(slice(embedding, layer*8+1, 8), x -> CAST(x AS DOUBLE)) AS logits
FROM ({_LOGIT_ROWS}) k LATERAL VIEW explode(sequence(0,7)) t AS layer
""", f"""
SELECT session, step, token, train_step, t_sec, layer, list_transform(embedding[layer*8+1:layer*8+8], lambda x: x::DOUBLE) AS logits
FROM ({_LOGIT_ROWS}) k, range(8) l(layer)
""")

# Layer 7 does not report in some steps, and layer 3 reports again in others
_view("v_reports", ("v_logits",), """
SELECT session, step, token, train_step, t_sec, layer, logits, 1 AS report FROM v_logits WHERE NOT (layer=7 AND step%17=5)
UNION ALL
SELECT session, step, token, train_step, t_sec, layer, reverse(logits), CASE WHEN step%2=0 THEN 0 ELSE 2 END AS report
FROM v_logits WHERE layer=3 AND step%5=2
""", """
SELECT session, step, token, train_step, t_sec, layer, logits, 1 AS report FROM v_logits WHERE NOT (layer=7 AND step%17=5)
UNION ALL
SELECT session, step, token, train_step, t_sec, layer, list_reverse(logits), CASE WHEN step%2=0 THEN 0 ELSE 2 END AS report
FROM v_logits WHERE layer=3 AND step%5=2
""")

# each row carries the labels of its sample of ten
_view("v_scored_tokens", (), """
SELECT CAST(floor(vec_id/10) AS BIGINT) AS sample, CAST(vec_id%10 AS INT) AS pos,
 transform(embedding, x -> CAST(x AS DOUBLE)*40.0D) AS logits,
 transform(sequence(0, 9), i -> CASE WHEN i < 3 THEN -100 ELSE CAST(((vec_id - vec_id%10 + i)*7)%64 AS INT) END) AS labels,
 CAST(floor(vec_id/40) AS BIGINT) AS step, CAST(floor(vec_id/400) AS BIGINT) AS eval_id
FROM embeddings
""", """
SELECT CAST(floor(vec_id/10) AS BIGINT) AS sample, CAST(vec_id%10 AS INT) AS pos,
 list_transform(embedding, lambda x: x::DOUBLE*40.0) AS logits,
 list_transform(range(10), lambda i: CASE WHEN i < 3 THEN -100 ELSE CAST(((vec_id - vec_id%10 + i)*7)%64 AS INT) END) AS labels,
 CAST(floor(vec_id/40) AS BIGINT) AS step, CAST(floor(vec_id/400) AS BIGINT) AS eval_id
FROM embeddings
""")

_view("v_chunks", (), """
SELECT user_id AS request_id, ROW_NUMBER() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS seq, ts,
 CASE WHEN event_type='error' THEN '' ELSE event_type || ' ' END AS content,
 CASE WHEN LEAD(event_id) OVER (PARTITION BY user_id ORDER BY ts, event_id) IS NULL
      THEN CASE WHEN event_type='view' THEN 'length' ELSE 'stop' END END AS finish_reason
FROM events
""")

# a served chunk log: an event is a line; every request streams text, tool-call deltas and usage
_CHUNK_LINES = """
SELECT user_id AS request_id, ROW_NUMBER() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS seq, ts,
 CASE WHEN user_id%10=3 AND event_id%7<>2 THEN 'data: [DONE]' ELSE CASE event_id%7
  WHEN 0 THEN 'data: {"id":"r","created":5,"model":"m","choices":[{"index":0,"delta":{"content":"' || event_type || ' "},"finish_reason":null}]}'
  WHEN 1 THEN 'data: {"id":"r","choices":[{"index":0,"delta":{"tool_calls":[{"index":' || CAST(user_id%2 AS {string}) || ',"id":"c' || CAST(event_id AS {string}) || '","type":"function","function":{"name":"' || event_type || '","arguments":"<"}}]},"finish_reason":null}]}'
  WHEN 2 THEN CASE WHEN user_id%10=3 THEN 'data: {"id":"r","choices":[{"index":0,"delta":{"content":"{\\"name\\":\\"f\\",\\"arguments\\":{}} "},"finish_reason":"stop"}]}'
    ELSE 'data:{"id":"r","choices":[{"index":0,"delta":{"content":"a","content":"b","tool_calls":[{"index":2,"function":{"arguments":"x"}},{"index":2,"function":{"arguments":"y"}}]},"finish_reason":null}]}' END
  WHEN 3 THEN 'data: {"id":"r","choices":[],"usage":{"prompt_tokens":' || CAST(event_id AS {string}) || ',"completion_tokens":2,"total_tokens":' || CAST(event_id + 2 AS {string}) || '}}'
  WHEN 4 THEN ':keepalive'
  WHEN 5 THEN 'data: {"id":"r","choices":[{"index":0,"delta":{},"finish_reason":"' || event_type || '"}]}'
  ELSE 'data: {"choices":[{"index":0,"delta":{"content":"no"},"finish_reason":null}]} x' END END AS line
FROM events
"""
_view("v_chunk_lines", (), _CHUNK_LINES.replace("{string}", "STRING").replace('\\"', '\\\\"'), _CHUNK_LINES.replace("{string}", "VARCHAR"))

# a request per conversation, with all its turns; some bodies repeat a key or have text after the object
_REQUESTS = """
SELECT conv_id AS request_id, CASE conv_id%9
 WHEN 0 THEN '{"messages":' || msgs || ',"max_tokens":9000}'
 WHEN 1 THEN '{"messages":' || msgs || ',"max_completion_tokens":64,"temperature":0}'
 WHEN 2 THEN '{"messages":[]}' WHEN 3 THEN '{"model":"m1"}'
 WHEN 4 THEN '{"messages":' || msgs || ',"tools":[{"type":"function"}],"temperature":null}'
 WHEN 5 THEN '{"max_tokens":1, "messages":[], "messages":' || msgs || ', "max_tokens":7}'
 WHEN 6 THEN '{"messages":' || msgs || '} {"x":1}'
 WHEN 7 THEN '{"messages":' || msgs || ',"max_tokens":"abc"}'
 ELSE '{"messages":' || msgs || ',"stream":true,"stream_options":{"include_usage":true}}' END AS body, conv_id%9 AS form, n_turns
FROM """
_view("v_requests", (), _REQUESTS + """(SELECT conv_id, count(*) AS n_turns, to_json(transform(array_sort(collect_list(struct(turn, role, text))),
  m -> struct(m.role AS role, m.text AS content))) AS msgs FROM conversations GROUP BY conv_id) c""",
      _REQUESTS + """(SELECT conv_id, count(*) AS n_turns, CAST(to_json(list({'role': role, 'content': text} ORDER BY turn)) AS VARCHAR) AS msgs
  FROM conversations GROUP BY conv_id) c""")

_TOOL_TEXT = """CASE event_id%8
 WHEN 0 THEN '{"name":"' || event_type || '","arguments":' || props || '}'
 WHEN 1 THEN '```json' || chr(10) || '{"name":"f","parameters":' || props || '}' || chr(10) || '```'
 WHEN 2 THEN '```' || chr(10) || '{"name":"f","arguments":"{}"}' || chr(10) || '``` tail'
 WHEN 3 THEN 'Sure: {"name":"f","arguments":{}}'
 WHEN 4 THEN '```json {"name":"f","arguments":{}}'
 WHEN 5 THEN '{"name":"f"}' WHEN 6 THEN '{"name":"f","arguments":null,"parameters":{"x":1}}'
 ELSE event_type END"""
_view("v_tool_text", (), f"""
SELECT event_id AS request_id, {_TOOL_TEXT} AS raw_text FROM events
""")

_view("v_fenced", (), """
SELECT doc_id, CASE doc_id%4
 WHEN 0 THEN '```python' || chr(10) || text || chr(10) || ' ```' WHEN 1 THEN '```'
 WHEN 2 THEN '  ' || text || chr(10) || '```' || chr(10)
 ELSE text || chr(13) || chr(10) || lang END AS completion
FROM documents
""")

_view("v_problems", (), """
SELECT 'B/' || CAST(item_id AS STRING) AS task_id, text AS prompt,
 CASE item_id%5 WHEN 0 THEN NULL WHEN 1 THEN CAST(array() AS ARRAY<STRING>)
   WHEN 2 THEN array('assert f(' || CAST(item_id AS STRING) || ')')
   WHEN 3 THEN array('assert a', 'assert b')
   ELSE array('assert x', 'assert y', 'assert z') END AS test_list
FROM benchmark
""", """
SELECT 'B/' || CAST(item_id AS VARCHAR) AS task_id, text AS prompt,
 CASE item_id%5 WHEN 0 THEN NULL WHEN 1 THEN CAST([] AS VARCHAR[])
   WHEN 2 THEN ['assert f(' || CAST(item_id AS VARCHAR) || ')']
   WHEN 3 THEN ['assert a', 'assert b']
   ELSE ['assert x', 'assert y', 'assert z'] END AS test_list
FROM benchmark
""")


_COMPLETIONS = """
SELECT event_id AS request_id, {raw} AS raw_text, CASE WHEN event_id%5=0 THEN NULL ELSE 'm' || CAST(user_id%3 AS {string}) END AS model,
 CAST(length(props) AS INT) AS prompt_tokens_est,
 CASE WHEN event_id%4=0 THEN NULL ELSE CAST(floor(value*10) AS INT) END AS prompt_tokens_exact,
 CASE WHEN event_id%11=0 THEN 0 ELSE CAST(user_id%97 + 1 AS INT) END AS completion_tokens,
 event_id%3=0 AS ends_with_eos
FROM events
"""
_view("v_completion_log", (), _COMPLETIONS.replace("{raw}", _TOOL_TEXT).replace("{string}", "STRING"), _COMPLETIONS.replace("{raw}", _TOOL_TEXT).replace("{string}", "VARCHAR"))

_view("v_tool_history", (), """
SELECT event_id AS request_id,
 '{"messages":[{"role":"user","content":"q"},{"role":"assistant","content":null,"tool_calls":[{"id":"c1","type":"function","function":{"name":"' || event_type || '","arguments":' ||
 CASE WHEN event_id%3=0 THEN '"' || replace(props, '"', '\\\\"') || '"' WHEN event_id%3=1 THEN '"x{"' ELSE props END || '}}]}]}' AS body
FROM events
""", """
SELECT event_id AS request_id,
 '{"messages":[{"role":"user","content":"q"},{"role":"assistant","content":null,"tool_calls":[{"id":"c1","type":"function","function":{"name":"' || event_type || '","arguments":' ||
 CASE WHEN event_id%3=0 THEN '"' || replace(props, '"', '\\"') || '"' WHEN event_id%3=1 THEN '"x{"' ELSE props END || '}}]}]}' AS body
FROM events
""")


# a request with tools: calls with text and object arguments, tool turns in a row and alone
_TOOL_CHAT = """
SELECT event_id AS request_id, '{"messages":[' || CASE WHEN event_id%2=0 THEN '{"role":"system","content":"Be brief."},' ELSE '' END ||
 '{"role":"user","content":"run ' || event_type || '"},{"role":"assistant","content":' ||
 CASE event_id%3 WHEN 0 THEN 'null' WHEN 1 THEN '""' ELSE '"Let me see."' END || ',"tool_calls":[{"id":"c1","type":"function","function":{"name":"' ||
 event_type || '","arguments":"' || replace(props, '"', '{quote}') || '"}},{"id":"c2","type":"function","function":{"name":"g","arguments":' || props ||
 '}}]},{"role":"tool","tool_call_id":"c1","content":"one"},{"role":"tool","tool_call_id":"c2","content":"' || CAST(user_id AS {string}) ||
 '"},{"role":"assistant","content":"done"},{"role":"user","content":"thanks é"},{"role":"tool","content":"late"}]' ||
 CASE WHEN event_id%5=0 THEN '' ELSE ',"tools":[{"type":"function","function":{"name":"f","parameters":{"type":"object","z":{"k":"é"},"a":[1,2.50,true,null]}}}]' END ||
 '}' AS body, event_type, props, user_id
FROM events
"""
_view("v_tool_chat", (), _TOOL_CHAT.replace("{quote}", '\\\\"').replace("{string}", "STRING"), _TOOL_CHAT.replace("{quote}", '\\"').replace("{string}", "VARCHAR"))


def _order(names):
    seen, out = set(), []

    def visit(n):
        if n in seen:
            return
        seen.add(n)
        for d in VIEWS[n][0]:
            visit(d)
        out.append(n)

    for n in names:
        visit(n)
    return out


def _tables_of(names) -> list[str]:
    from .tables import TABLES
    used = set()
    for n in _order(names):
        for t in TABLES:
            if re.search(rf"\b{t}\b", VIEWS[n][1]):
                used.add(t)
    return sorted(used)


def register_views(spark: SparkSession, sf_dir: str, *names: str) -> None:
    """Register the driver tables the named views read, then the views."""
    register_tables(spark, sf_dir, _tables_of(names))
    for n in _order(names):
        spark.sql(VIEWS[n][1]).createOrReplaceTempView(n)


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    register_views(spark, sf_dir, name)
    return spark.table(name)


def duck_sql(*names: str) -> str:
    """``WITH`` clause defining the named views for DuckDB."""
    parts = []
    for n in _order(names):
        _, s, d = VIEWS[n]
        parts.append(f"{n} AS ({d or s})")
    return "WITH " + ",\n".join(parts)


def oracle(views: tuple[str, ...] | list[str], body: str) -> str:
    """Prefix an oracle statement with the DuckDB definitions of ``views``."""
    body = body.strip()
    if not views:
        return body
    head = duck_sql(*views)
    if body[:5].upper() == "WITH ":
        return head + ",\n" + body[5:]
    return head + "\n" + body
