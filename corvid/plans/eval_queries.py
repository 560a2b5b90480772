"""Registered queries for benchmark prompts (E1-E5), token loss (N1-N4) and logs."""
from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..functions.text import py_strip, run_tag, strip_markdown
from ..functions.udfs import batch_generate
from ..operators import evalset as EV
from ..operators import loss as LS
from ..operators import routing as R
from ..operators.sse import sse_routing_events
from ..session import ensure_checkpoint_dir
from ..sources.fixtures import view
from ..sources.tables import read_table
from . import duck as D
from .barrier import compute_once
from .registry import register
from .routing_queries import D_EVENTS, D_METRICS, _events, router_metrics

_EMPTY = "CAST([] AS VARCHAR[])"


@register("eval_prompts_completion", ("v_problems",), f"""
WITH s AS (SELECT task_id, [{D.msg('system', D.q(EV.COMPLETION_SYSTEM))},
  {D.msg('user', "'Complete this Python function:' || chr(10) || chr(10) || prompt")}] AS msgs FROM v_problems)
SELECT task_id, {D.render('msgs', True)} AS prompt FROM s""")
def q_prompts_completion(spark, sf):
    return EV.eval_prompts(view(spark, sf, "v_problems"), "completion")


@register("eval_prompts_task", ("v_problems",), f"""
WITH s AS (SELECT task_id, [{D.msg('system', D.q(EV.TASK_SYSTEM))},
  {D.msg('user', "'Task: ' || prompt || chr(10) || chr(10) || 'Example tests:' || chr(10) || array_to_string(coalesce(test_list, " + _EMPTY + ")[1:2], chr(10))")}] AS msgs FROM v_problems)
SELECT task_id, {D.render('msgs', True)} AS prompt FROM s""")
def q_prompts_task(spark, sf):
    return EV.eval_prompts(view(spark, sf, "v_problems"), "task")


_LINES = D.splitlines(D.strip("completion"))
D_STRIP_MD = f"""
WITH a AS (SELECT doc_id, {_LINES} AS lines FROM v_fenced),
b AS (SELECT doc_id, CASE WHEN starts_with(lines[1], '```') THEN lines[2:] ELSE lines END AS l1 FROM a),
c AS (SELECT doc_id, CASE WHEN len(l1) > 0 AND {D.strip('l1[-1]')} = '```' THEN l1[1:len(l1) - 1] ELSE l1 END AS l2 FROM b)
SELECT doc_id, array_to_string(l2, chr(10)) AS completion FROM c"""


@register("strip_markdown", ("v_fenced",), D_STRIP_MD)
def q_strip_md(spark, sf):
    v = view(spark, sf, "v_fenced")
    return v.select("doc_id", strip_markdown(F.col("completion")).alias("completion"))


@register("run_tag", ("v_problems",), """
SELECT task_id, 'mbpp_' || replace('runs/' || task_id, '/', '_') AS run FROM v_problems""")
def q_run_tag(spark, sf):
    v = view(spark, sf, "v_problems")
    return v.select("task_id", F.concat(F.lit("mbpp_"), run_tag(F.concat(F.lit("runs/"), F.col("task_id")))).alias("run"))


def echo_model(prompts: list[str]) -> list[str]:
    """A stand-in model for tests: fences the last user line of each prompt."""
    out = []
    for p in prompts:
        body = p.split("<|im_start|>user\n")[-1].split("<|im_end|>")[0]
        out.append("```python\n" + body + "\n```")
    return out


@register("batch_infer")
def q_batch_infer(spark, sf):
    prompts = EV.eval_prompts(view(spark, sf, "v_problems"), "completion")
    return batch_generate(prompts, echo_model)


@register("eval_run")
def q_eval_run(spark, sf):
    return EV.eval_run(view(spark, sf, "v_problems"), echo_model, "runs/echo", "humaneval")


# ------------------------------------------------------------------ N1 - N4
D_NLL = """
t AS (SELECT *, labels[pos + 2] AS tgt FROM v_scored_tokens),
k AS (SELECT *, list_transform(logits, lambda x: greatest(least(x, 1e4), -1e4)) AS lg FROM t
      WHERE tgt IS NOT NULL AND tgt <> -100 AND tgt >= 0 AND tgt < len(logits)),
n AS (SELECT step, list_max(lg) + ln(list_reduce(list_transform(lg, lambda x: exp(x - list_max(lg))), lambda a, b: a + b))
      - lg[tgt + 1] AS nll FROM k),
nl AS (SELECT step, avg(nll) AS loss, count(*) AS n_tokens FROM n GROUP BY step)"""


def _nll(spark, sf):
    return LS.masked_nll(view(spark, sf, "v_scored_tokens"))


@register("masked_nll", ("v_scored_tokens",), "WITH " + D_NLL.strip() + """
SELECT step, round(loss, 6) AS loss, n_tokens FROM nl""")
def q_nll(spark, sf):
    return _nll(spark, sf).select("step", F.round("loss", 6).alias("loss"), "n_tokens")


@register("perplexity", ("v_scored_tokens",), "WITH " + D_NLL.strip() + """
SELECT step, round(exp(loss), 6) AS perplexity FROM nl""")
def q_ppl(spark, sf):
    return _nll(spark, sf).select("step", F.round(LS.perplexity(F.col("loss")), 6).alias("perplexity"))


@register("combined_loss", ("v_logits", "v_scored_tokens"), D_METRICS + "," + D_NLL + """
SELECT step, round(loss + 0.001 * aux_loss, 6) AS total_loss FROM nl JOIN metrics USING (step)""")
def q_combined(spark, sf):
    aux = router_metrics(spark, sf)
    c = LS.combined_loss(_nll(spark, sf), aux)
    return c.select("step", F.round("total_loss", 6).alias("total_loss"))


_LOGGED = f"""
lg AS (SELECT step, round(routing_entropy_raw, 4) AS routing_entropy, round(aux_loss, 6) AS train_aux_loss,
  {", ".join(f"round(u{e} * 100.0, 2) AS expert_{e}_pct" for e in range(R.NUM_EXPERTS))} FROM metrics)"""


@register("training_record", ("v_logits", "v_scored_tokens"), D_METRICS + "," + D_NLL + "," + _LOGGED + """
SELECT coalesce(nl.step, lg.step) AS step, round(loss, 6) AS loss, round(exp(loss), 6) AS train_perplexity, lg.* EXCLUDE step
FROM nl FULL JOIN lg ON lg.step = nl.step""")
def q_training_record(spark, sf):
    log = R.training_log(router_metrics(spark, sf), R.NUM_EXPERTS)
    r = LS.training_record(log, _nll(spark, sf))
    return r.withColumns({c: F.round(c, 6) for c in ("loss", "train_perplexity", "train_aux_loss")})


@register("evaluation_record", ("v_logits", "v_scored_tokens"), D_METRICS + "," + D_NLL + """,
b AS (SELECT CAST(floor(coalesce(nl.step, m.step) / 20) AS BIGINT) AS eval_id, loss, aux_loss FROM nl FULL JOIN metrics m ON m.step = nl.step)
SELECT eval_id, round(avg(loss), 6) AS eval_loss, round(avg(aux_loss), 6) AS eval_aux_loss, round(exp(avg(loss)), 6) AS eval_perplexity
FROM b GROUP BY eval_id""")
def q_evaluation_record(spark, sf):
    own = F.floor(F.col("step") / 20).cast("bigint")
    r = LS.evaluation_record(_nll(spark, sf).withColumn("eval_id", own), router_metrics(spark, sf).withColumn("eval_id", own))
    return r.select("eval_id", *[F.round(c, 6).alias(c) for c in ("eval_loss", "eval_aux_loss", "eval_perplexity")])


@register("write_completions", ("v_fenced",), D_STRIP_MD.replace("SELECT doc_id, array_to_string(l2, chr(10)) AS completion FROM c",
          "SELECT 'D/' || CAST(doc_id AS VARCHAR) AS task_id, array_to_string(l2, chr(10)) AS completion, 'docs_runs_1' AS run FROM c"))
def q_write_completions(spark, sf):
    v = view(spark, sf, "v_fenced")
    rows = v.select(F.concat(F.lit("D/"), F.col("doc_id").cast("string")).alias("task_id"), strip_markdown(F.col("completion")).alias("completion"),
                    F.concat(F.lit("docs_"), run_tag(F.lit("runs/1"))).alias("run"))
    path = f"{ensure_checkpoint_dir(spark).rstrip('/')}/corvid-completions-{uuid.uuid4().hex}"
    EV.write_completions(rows, path)
    return spark.read.schema("task_id string, completion string, run string").json(path)


# ------------------------------------------------------------------ S6 / S7
@register("prompt_lines", (), f"""
WITH a AS (SELECT doc_id, string_split_regex(text, '\\r\\n|\\r|\\n') AS ls FROM documents),
b AS (SELECT doc_id, generate_subscripts(ls, 1) - 1 AS line_no, {D.strip('unnest(ls)')} AS prompt FROM a)
SELECT doc_id, line_no, prompt FROM b WHERE prompt <> ''""")
def q_prompt_lines(spark, sf):
    from ..sources.registry import clean_prompt_lines
    d = read_table(spark, sf, "documents")
    # the documents' lines as a text reader would produce them
    ls = d.select("doc_id", F.posexplode(F.split("text", r"\r\n|\r|\n")).alias("line_no", "value"))
    return clean_prompt_lines(ls.withColumn("line_no", F.col("line_no").cast("bigint")))


# Fixed junk lines mixed into every session's event log
SSE_NOISE = (":keepalive", "data: [DONE]", "data: {bad", 'data: {"type":"other","token_index":1}',
             'data: {"type":"routing","token_index":2}', "data:   ", "event: ping")


def sse_lines(events):
    """The event log a telemetry stream would write: one ``data:`` line per event plus noise."""
    # the log's text is made once; its readers look at it several times
    good = compute_once(events, value=F.concat(F.lit("data: "), R.event_json(events))).select("session", "value")
    noise = events.select("session").distinct().select(
        "session", F.explode(F.array(*[F.lit(x) for x in SSE_NOISE])).alias("value"))
    return good.unionByName(noise)


@register("sse_routing_events", ("v_logits",), D_EVENTS + """
SELECT session, token_index, round(entropy_pct, 1) AS entropy_pct, array_to_string(layer_experts, ',') AS layer_experts
FROM events""")
def q_sse(spark, sf):
    ev = sse_routing_events(sse_lines(_events(spark, sf)))
    return ev.select("session", "token_index", "entropy_pct",
                     F.array_join(F.col("layer_experts").cast("array<string>"), ",").alias("layer_experts"))
