"""Registered routing queries (T1-T21) over the ``v_logits`` view."""
from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import routing as R
from ..sources.fixtures import view
from .registry import register

E = R.NUM_EXPERTS
L = 8            # the v_logits view reads each 64-wide embedding as 8 layers x 8 experts
K = R.TOP_K
def _keys():
    return ("session", "step", "token", F.col("layer").cast("bigint").alias("layer"))


def _logits(spark, sf):
    return view(spark, sf, "v_logits")


def _sum_terms(fmt: str) -> str:
    return " + ".join(fmt.format(e=e, i=e + 1) for e in range(E))


# DuckDB: routed logits with probabilities and top-k (ties to the lowest id)
def _d_routed(source: str) -> str:
    return f"""
WITH r0 AS (SELECT session, step, token, train_step, t_sec, layer, logits,
   list_transform(logits, lambda x: exp(x - list_max(logits))) AS ex FROM {source}),
r1 AS (SELECT *, list_transform(ex, lambda x: x / list_reduce(ex, lambda a, b: a + b)) AS probs FROM r0),
routed AS (SELECT *, list_transform(list_slice(list_sort(list_transform(probs, lambda v, i: {{'n': -v, 'i': i - 1}})), 1, {K}),
   lambda z: z.i) AS top FROM r1),
routed_w AS (SELECT *, list_transform(top, lambda t: probs[t + 1]) AS tw FROM routed),
routed2 AS (SELECT *, list_transform(tw, lambda x: x / list_reduce(tw, lambda a, b: a + b)) AS top_w FROM routed_w)
"""


D_ROUTED = _d_routed("v_logits")
# the latest report of each layer
D_LATEST = _d_routed("(SELECT * FROM v_reports QUALIFY report = max(report) OVER (PARTITION BY session, step, layer))")

_HITS = ",\n ".join(f"sum(len(list_filter(top, lambda x: x = {e}))) AS h{e}" for e in range(E))
_D_STEPS = f""",
lc AS (SELECT session, step, layer, max(t_sec) AS t_sec, count(*) AS n_tokens,
 {_HITS} FROM routed GROUP BY session, step, layer),
lcc AS (SELECT * FROM (SELECT *, count(*) OVER (PARTITION BY session, step) AS nl FROM lc) WHERE nl = {L}),
lcd AS (SELECT *, list_position([{", ".join(f"h{e}" for e in range(E))}],
   list_max([{", ".join(f"h{e}" for e in range(E))}])) - 1 AS dom FROM lcc),
st0 AS (SELECT session, step, max(t_sec) AS t_sec, {", ".join(f"sum(h{e}) AS t{e}" for e in range(E))},
   list(dom ORDER BY layer) AS layer_experts FROM lcd GROUP BY session, step),
st1 AS (SELECT *, ({_sum_terms("t{e}")}) AS total FROM st0),
st AS (SELECT session, step, t_sec, layer_experts,
 [{", ".join(f"CASE WHEN total > 0 THEN t{e} / total * 100.0 ELSE 0.0 END" for e in range(E))}] AS expert_pct,
 -(0.0 + {" + ".join(f"(CASE WHEN total > 0 THEN t{e} / total ELSE 0.125 END) * log2((CASE WHEN total > 0 THEN t{e} / total ELSE 0.125 END) + 1e-9)" for e in range(E))})
   / log2(8.0) * 100.0 AS entropy_pct FROM st1),
sg AS (SELECT *, t_sec - lag(t_sec) OVER (PARTITION BY session ORDER BY step) AS gap FROM st),
sw AS (SELECT *, avg(gap) OVER (PARTITION BY session ORDER BY step ROWS BETWEEN 9 PRECEDING AND CURRENT ROW) AS avg_gap,
 [{", ".join(f"avg(expert_pct[{e + 1}]) OVER (PARTITION BY session ORDER BY step ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)" for e in range(E))}] AS session_avg,
 row_number() OVER (PARTITION BY session ORDER BY step) AS token_index FROM sg),
ev AS (SELECT *, CASE WHEN avg_gap IS NULL THEN 1.0 WHEN avg_gap > 0 THEN 1.0 / avg_gap ELSE 0.0 END AS rate FROM sw)
"""
D_LAYER = D_ROUTED + _D_STEPS
D_REPORTED = D_LATEST + _D_STEPS


def _routed(spark, sf):
    return R.route(_logits(spark, sf), K)


@register("softmax", ("v_logits",), D_ROUTED + """
SELECT session, step, token, layer, e AS expert, round(probs[e + 1], 6) AS prob
FROM routed, range(8) t(e)""")
def q_softmax(spark, sf):
    r = _routed(spark, sf)
    return r.select(*_keys(), F.posexplode("probs").alias("expert", "p")) \
        .select(*_keys(), F.col("expert").cast("bigint").alias("expert"), F.round("p", 6).alias("prob"))


@register("topk_experts", ("v_logits",), D_ROUTED + """
SELECT session, step, token, layer, s - 1 AS slot, top[s] AS expert FROM routed, range(1, 3) t(s)""")
def q_topk(spark, sf):
    r = _routed(spark, sf)
    return r.select(*_keys(), F.posexplode("top").alias("slot", "expert")) \
        .select(*_keys(), F.col("slot").cast("bigint").alias("slot"), F.col("expert").cast("bigint").alias("expert"))


@register("topk_weights", ("v_logits",), D_ROUTED + """
SELECT session, step, token, layer, s - 1 AS slot, round(top_w[s], 6) AS weight FROM routed2, range(1, 3) t(s)""")
def q_topk_weights(spark, sf):
    r = _routed(spark, sf)
    return r.select(*_keys(), F.posexplode("top_w").alias("slot", "w")) \
        .select(*_keys(), F.col("slot").cast("bigint").alias("slot"), F.round("w", 6).alias("weight"))


@register("dispatch_assignments", ("v_logits",), D_ROUTED + """
SELECT layer, top[s] AS expert, count(*) AS n_tokens, round(sum(top_w[s]), 6) AS weight_sum
FROM routed2, range(1, 3) t(s) GROUP BY 1, 2""")
def q_dispatch(spark, sf):
    a = R.dispatch_assignments(_routed(spark, sf))
    return R.expert_load(a).select(F.col("layer").cast("bigint").alias("layer"),
                                   F.col("expert").cast("bigint").alias("expert"),
                                   "n_tokens", F.round("weight_sum", 6).alias("weight_sum"))


# expert outputs derived from the logits: value(expert e, dim d) = (e + 1) * logits[(e + d) % 8]
@register("combine_weighted", ("v_logits",), D_ROUTED + """,
a AS (SELECT session, step, token, layer, top[s] AS expert, top_w[s] AS weight, logits FROM routed2, range(1, 3) t(s)),
o AS (SELECT session, step, token, layer, d AS dim, sum(weight * (expert + 1) * logits[((expert + d) % 8) + 1]) AS v
      FROM a, range(4) u(d) GROUP BY 1, 2, 3, 4, 5)
SELECT session, step, token, layer, dim, round(v, 6) AS value FROM o""")
def q_combine(spark, sf):
    lg = _logits(spark, sf)
    routed = R.route(lg, K)
    assign = R.dispatch_assignments(routed).drop("t_sec", "train_step")
    expert_out = (lg.select("session", "step", "token", "layer", "logits",
                            F.explode(F.sequence(F.lit(0), F.lit(E - 1))).alias("expert"))
                  .select("session", "step", "token", "layer", "expert", F.posexplode(F.array_repeat(F.lit(0), 4)).alias("dim", "_z"),
                          "logits")
                  .select("session", "step", "token", "layer", "expert", "dim",
                          ((F.col("expert") + 1) * F.try_element_at("logits", ((F.col("expert") + F.col("dim")) % 8) + 1))
                          .alias("value")))
    out = R.combine_weighted(assign, expert_out)
    return out.select("session", "step", "token", F.col("layer").cast("bigint").alias("layer"),
                      F.col("dim").cast("bigint").alias("dim"), F.round("value", 6).alias("value"))


def _layer_counts(spark, sf):
    return R.layer_expert_counts(_routed(spark, sf), E)


@register("layer_expert_counts", ("v_reports",), D_REPORTED + f"""
SELECT session, step, layer, e AS expert,
 CAST(CASE e {" ".join(f"WHEN {e} THEN h{e}" for e in range(E))} END AS BIGINT) AS hits
FROM lc, range(8) t(e)""")
def q_layer_counts(spark, sf):
    lc = R.layer_expert_counts(R.route(view(spark, sf, "v_reports"), K), E)
    return lc.select("session", "step", F.col("layer").cast("bigint").alias("layer"),
                     F.posexplode("counts").alias("expert", "hits")) \
        .select("session", "step", "layer", F.col("expert").cast("bigint").alias("expert"),
                F.col("hits").cast("bigint").alias("hits"))


@register("complete_steps", ("v_reports",), D_REPORTED + """
SELECT session, step, count(*) AS n_layers, CAST(sum(n_tokens) AS BIGINT) AS n_token_rows FROM lcc GROUP BY 1, 2""")
def q_complete(spark, sf):
    lc = R.complete_steps(R.layer_expert_counts(R.route(view(spark, sf, "v_reports"), K), E), L)
    return lc.groupBy("session", "step").agg(F.count(F.lit(1)).alias("n_layers"),
                                             F.sum("n_tokens").alias("n_token_rows"))


def _steps(spark, sf):
    return R.step_summary(_layer_counts(spark, sf).repartition("session"), E, L)


@register("expert_pct", ("v_logits",), D_LAYER + """
SELECT session, step, e AS expert, round(expert_pct[e + 1], 6) AS pct FROM st, range(8) t(e)""")
def q_expert_pct(spark, sf):
    st = _steps(spark, sf)
    return st.select("session", "step", F.posexplode("expert_pct").alias("expert", "p")) \
        .select("session", "step", F.col("expert").cast("bigint").alias("expert"), F.round("p", 6).alias("pct"))


@register("layer_dominant", ("v_logits",), D_LAYER + """
SELECT session, step, layer, CAST(dom AS BIGINT) AS dominant FROM lcd""")
def q_dominant(spark, sf):
    lc = R.complete_steps(_layer_counts(spark, sf), L)
    return lc.select("session", "step", F.col("layer").cast("bigint").alias("layer"),
                     R.dominant_expert(F.col("counts"), E).cast("bigint").alias("dominant"))


@register("routing_entropy", ("v_logits",), D_LAYER + """
SELECT session, step, round(entropy_pct, 6) AS entropy_pct FROM st""")
def q_entropy(spark, sf):
    return _steps(spark, sf).select("session", "step", F.round("entropy_pct", 6).alias("entropy_pct"))


def _windows(spark, sf):
    return R.session_windows(_steps(spark, sf), E)


@register("rolling_rate", ("v_logits",), D_LAYER + """
SELECT session, step, round(rate, 6) AS tokens_per_sec FROM ev""")
def q_rate(spark, sf):
    return _windows(spark, sf).select("session", "step", F.round("tokens_per_sec_raw", 6).alias("tokens_per_sec"))


@register("session_avg", ("v_logits",), D_LAYER + """
SELECT session, step, e AS expert, round(session_avg[e + 1], 6) AS session_avg FROM ev, range(8) t(e)""")
def q_session_avg(spark, sf):
    w = _windows(spark, sf)
    return w.select("session", "step", F.posexplode("session_avg").alias("expert", "a")) \
        .select("session", "step", F.col("expert").cast("bigint").alias("expert"),
                F.round("a", 6).alias("session_avg"))


@register("token_index", ("v_logits",), D_LAYER + """
SELECT session, step, token_index FROM ev""")
def q_token_index(spark, sf):
    return _windows(spark, sf).select("session", "step", F.col("token_index").cast("bigint").alias("token_index"))


D_EVENTS = D_LAYER + """,
events AS (SELECT session, step, 'routing' AS type,
 list_transform(expert_pct, lambda x: round(x, 1)) AS expert_pct,
 list_transform(session_avg, lambda x: round(x, 1)) AS session_avg,
 round(entropy_pct, 1) AS entropy_pct, round(rate, 1) AS tokens_per_sec,
 token_index, layer_experts FROM ev)
"""


def _events(spark, sf):
    return R.routing_events(_logits(spark, sf), L, K, E)


@register("routing_events", ("v_logits",), D_EVENTS + """
SELECT session, step, token_index, entropy_pct, tokens_per_sec,
 array_to_string(expert_pct, ',') AS expert_pct, array_to_string(session_avg, ',') AS session_avg,
 array_to_string(layer_experts, ',') AS layer_experts FROM events""")
def q_events(spark, sf):
    ev = _events(spark, sf)
    return ev.select("session", "step", "token_index", "entropy_pct", "tokens_per_sec",
                     F.array_join(F.col("expert_pct").cast("array<string>"), ",").alias("expert_pct"),
                     F.array_join(F.col("session_avg").cast("array<string>"), ",").alias("session_avg"),
                     F.array_join(F.col("layer_experts").cast("array<string>"), ",").alias("layer_experts"))


@register("routing_matrix", ("v_logits",), D_EVENTS + f""",
cells AS (SELECT session, token_index, l - 1 AS layer, layer_experts[l] AS expert, step
          FROM events, range(1, 37) t(l) WHERE l <= len(layer_experts)),
latest AS (SELECT session, token_index, layer, arg_max(expert, step) AS expert FROM cells GROUP BY 1, 2, 3),
toks AS (SELECT DISTINCT session, token_index FROM latest WHERE layer = 0)
SELECT k.session, k.token_index, g.layer, CAST(coalesce(c.expert, -1) AS BIGINT) AS expert
FROM toks k, range(36) g(layer)
LEFT JOIN latest c ON c.session = k.session AND c.token_index = k.token_index AND c.layer = g.layer""")
def q_matrix(spark, sf):
    m = R.routing_matrix(_events(spark, sf), R.MATRIX_LAYERS)
    return m.select("session", "token_index", F.col("layer").cast("bigint").alias("layer"),
                    F.col("expert").cast("bigint").alias("expert"))


@register("routing_summary", ("v_logits",), D_EVENTS + """
SELECT session, token_index,
 printf('Token %3d: %s', token_index, array_to_string(list_transform(layer_experts[1:36], lambda e, l: printf('L%02d:E%d', l - 1, e)), ' ')) AS line
FROM events""")
def q_summary(spark, sf):
    return R.routing_summary(_events(spark, sf), R.MATRIX_LAYERS)


@register("routing_summary_text", ("v_logits",), D_EVENTS + f"""
SELECT session, token_index AS line_no,
 printf('Token %3d: %s', token_index, array_to_string(list_transform(layer_experts[1:36], lambda e, l: printf('L%02d:E%d', l - 1, e)), ' ')) AS line
FROM events UNION ALL SELECT DISTINCT session, 0, '{R.SUMMARY_HEADER}' FROM events""")
def q_summary_text(spark, sf):
    return R.summary_text(_events(spark, sf), R.MATRIX_LAYERS)


D_METRICS = D_ROUTED + f""",
pl AS (SELECT train_step AS step, layer,
  avg(-(0.0 + {" + ".join(f"probs[{e + 1}] * ln(probs[{e + 1}] + 1e-9)" for e in range(E))})) AS ent,
  {", ".join(f"avg(probs[{e + 1}]) AS u{e}" for e in range(E))},
  {", ".join(f"sum(CASE WHEN list_contains(top, {e}) THEN 1 ELSE 0 END) AS f{e}" for e in range(E))},
  {", ".join(f"sum(probs[{e + 1}]) AS p{e}" for e in range(E))}, count(*) AS n
  FROM routed GROUP BY train_step, layer),
ps AS (SELECT step, avg(ent) AS routing_entropy_raw, {", ".join(f"avg(u{e}) AS u{e}" for e in range(E))},
  {", ".join(f"sum(f{e}) AS f{e}" for e in range(E))}, {", ".join(f"sum(p{e}) AS p{e}" for e in range(E))}, sum(n) AS n
  FROM pl GROUP BY step),
metrics AS (SELECT step, routing_entropy_raw, {", ".join(f"u{e}" for e in range(E))},
  (0.0 + {" + ".join(f"(f{e} / n) * (p{e} / n)" for e in range(E))}) * 8.0 AS aux_loss, n FROM ps)
"""


def router_metrics(spark, sf):
    lg = _logits(spark, sf).withColumn("step", F.col("train_step"))
    return R.router_metrics(lg, K, E)


def _metrics(spark, sf):
    return router_metrics(spark, sf)


@register("router_entropy_nats", ("v_logits",), D_METRICS + """
SELECT step, round(routing_entropy_raw, 4) AS routing_entropy FROM metrics""")
def q_entropy_nats(spark, sf):
    return _metrics(spark, sf).select("step", F.round("routing_entropy_raw", 4).alias("routing_entropy"))


@register("expert_usage", ("v_logits",), D_METRICS + f"""
SELECT step, {", ".join(f"round(u{e} * 100.0, 2) AS expert_{e}_pct" for e in range(E))} FROM metrics""")
def q_usage(spark, sf):
    return R.training_log(_metrics(spark, sf), E).drop("routing_entropy", "aux_loss")


@register("load_balance_loss", ("v_logits",), D_METRICS + """
SELECT step, round(aux_loss, 6) AS aux_loss, CAST(n AS BIGINT) AS n_router_rows FROM metrics""")
def q_lb(spark, sf):
    return _metrics(spark, sf).select("step", F.round("aux_loss", 6).alias("aux_loss"), "n_router_rows")


@register("eval_aux_mean", ("v_logits",), D_METRICS + """
SELECT CAST(floor(step / 20) AS BIGINT) AS eval_id, round(avg(aux_loss), 6) AS eval_aux_loss, count(*) AS n_batches
FROM metrics GROUP BY 1""")
def q_eval_aux(spark, sf):
    m = _metrics(spark, sf).withColumn("eval_id", F.floor(F.col("step") / 20).cast("bigint"))
    return R.eval_aux_mean(m).select("eval_id", F.round("eval_aux_loss", 6).alias("eval_aux_loss"), "n_batches")


@register("router_metrics", ("v_logits",), D_METRICS + f"""
SELECT step, round(routing_entropy_raw, 4) AS routing_entropy,
 {", ".join(f"round(u{e} * 100.0, 2) AS expert_{e}_pct" for e in range(E))}, round(aux_loss, 6) AS aux_loss FROM metrics""")
def q_router_metrics(spark, sf):
    return R.training_log(_metrics(spark, sf), E).withColumn("aux_loss", F.round("aux_loss", 6))
