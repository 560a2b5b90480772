"""Expert routing: top-k assignment, telemetry events and router metrics.

Input: a router-logit table, one row per (session, step, token, layer) with
``logits ARRAY<DOUBLE>`` of length ``num_experts`` and an optional step clock
``t_sec``.  Per-expert aggregates are written as ``num_experts`` separate
``sum`` expressions (the expert count is a model parameter), so every
aggregation is a codegen'd hash aggregate with map-side partial combine; no
row is exploded per expert.

Group sizes: (session, step, layer) groups hold the tokens of one forward
pass; (session, step) groups hold ``num_layers`` layer rows; windows over a
session run per block of steps, with one row per block carried on.  None of
these grows with the table.
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

NUM_EXPERTS = 8          # fixed value: experts per layer in the reference model config
TOP_K = 2                # fixed value: experts per token
NUM_LAYERS = 36          # fixed value: decoder layers of the served model
MATRIX_LAYERS = 36       # fixed value: rows of the routing matrix
RATE_WINDOW = 10         # fixed value: inter-step gaps in the tokens/s window
ENTROPY_EPS = 1e-9       # fixed value: added inside the log


# ---------------------------------------------------------------- T1 - T3
def let(value: Column, body) -> Column:
    """``body(value)`` with ``value`` computed once per row, not once per use inside lambdas."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def softmax(logits: Column) -> Column:
    """Numerically stable softmax of an array column, linear in its length."""
    def total(e: Column) -> Column:
        return F.aggregate(e, F.lit(0.0).cast("double"), lambda a, x: a + x)

    return let(logits, lambda x: let(F.array_max(x), lambda m: let(
        F.transform(x, lambda v: F.exp(v - m)), lambda e: let(total(e), lambda s: F.transform(e, lambda v: v / s)))))


def topk_experts(scores: Column, k: int = TOP_K) -> Column:
    """Indices of the k largest scores, ties to the lowest expert id."""
    ranked = F.array_sort(F.transform(scores, lambda v, i: F.struct((-v).alias("n"), i.alias("i"))))
    return F.transform(F.slice(ranked, 1, k), lambda z: z["i"])


def topk_weights(probs: Column, top: Column) -> Column:
    """The chosen experts' probabilities renormalised to sum to 1."""
    w = F.transform(top, lambda i: F.try_element_at(probs, i + 1))
    s = F.aggregate(w, F.lit(0.0).cast("double"), lambda a, x: a + x)
    return F.transform(w, lambda x: x / s)


def route(logits_df: DataFrame, k: int = TOP_K) -> DataFrame:
    """Adds ``probs``, ``top`` (expert ids) and ``top_w`` (renormalised weights).

    Softmax is monotone, so top-k is taken on the probabilities computed once
    and reused by every downstream metric.
    """
    return (logits_df.withColumn("probs", softmax(F.col("logits")))
            .withColumn("top", topk_experts(F.col("probs"), k))
            .withColumn("top_w", topk_weights(F.col("probs"), F.col("top"))))


# ---------------------------------------------------------------- T4 / T5
def dispatch_assignments(routed: DataFrame) -> DataFrame:
    """T4: one row per (token, chosen expert) with its slot and weight."""
    keys = [c for c in routed.columns if c not in ("logits", "probs", "top", "top_w")]
    return routed.select(*keys, F.posexplode(F.arrays_zip("top", "top_w")).alias("slot", "z")) \
        .select(*keys, "slot", F.col("z.top").alias("expert"), F.col("z.top_w").alias("weight"))


def expert_load(assign: DataFrame, by=("layer",)) -> DataFrame:
    """T4 report: tokens and weight routed to each expert (empty experts absent)."""
    return assign.groupBy(*by, "expert").agg(F.count(F.lit(1)).alias("n_tokens"),
                                             F.sum("weight").alias("weight_sum"))


def combine_weighted(assign: DataFrame, expert_out: DataFrame,
                     token_keys=("session", "step", "token", "layer")) -> DataFrame:
    """T5: scale each expert's per-token output by its weight and sum back per token.

    ``expert_out`` holds (token keys..., expert, dim, value); joining on the
    token keys and expert is an equi-join, the sum a partial aggregate.
    """
    j = assign.join(expert_out, [*token_keys, "expert"])
    return j.groupBy(*token_keys, "dim").agg(F.sum(F.col("weight") * F.col("value")).alias("value"))


# ---------------------------------------------------------------- T6 / T7
def _expert_sums(col: Column, num_experts: int, prefix: str):
    return [F.sum(F.try_element_at(col, F.lit(e + 1))).alias(f"{prefix}{e}") for e in range(num_experts)]


def _pack(prefix: str, num_experts: int) -> Column:
    return F.array(*[F.col(f"{prefix}{e}") for e in range(num_experts)])


def expert_hits(top: Column, num_experts: int = NUM_EXPERTS) -> Column:
    """One-hot hits of the chosen experts, one number per expert."""
    def hits(e: int) -> Column:
        return F.size(F.filter(top, lambda t: t == e)).cast("long")
    return F.array(*[hits(e) for e in range(num_experts)])


def layer_expert_counts(routed: DataFrame, num_experts: int = NUM_EXPERTS,
                        report_col: str = "report") -> DataFrame:
    """Expert hit counts per (session, step, layer); zero-hit experts are 0.

    If a layer of a step was reported more than once, its latest report counts (T7's
    overwrite rule); reports are told apart by ``report_col`` where the table has it.
    """
    keys = ["session", "step", "layer"]
    reports = [report_col] if report_col in routed.columns else []
    agg = routed.withColumn("_hits", expert_hits(F.col("top"), num_experts)).groupBy(*keys, *reports).agg(
        *_expert_sums(F.col("_hits"), num_experts, "_h"),
        F.count(F.lit(1)).alias("n_tokens"),
        (F.max("t_sec") if "t_sec" in routed.columns else F.lit(None).cast("double")).alias("t_sec"))
    out = agg.select(*keys, *reports, _pack("_h", num_experts).alias("counts"), "n_tokens", "t_sec")
    if not reports:
        return out
    last = out.groupBy(*keys).agg(F.max_by(F.struct("counts", "n_tokens", "t_sec"), report_col).alias("_r"))
    return last.select(*keys, "_r.*")


def complete_steps(layer_counts: DataFrame, num_layers: int) -> DataFrame:
    """Steps where every one of ``num_layers`` layers reported."""
    w = Window.partitionBy("session", "step")
    return (layer_counts.withColumn("_nl", F.count(F.lit(1)).over(w))
            .filter(F.col("_nl") == num_layers).drop("_nl"))


def dominant_expert(counts: Column, num_experts: int = NUM_EXPERTS) -> Column:
    """Argmax of hit counts, ties to the lowest expert id."""
    best = F.array_min(F.transform(F.sequence(F.lit(0), F.lit(num_experts - 1)),
                                   lambda e: F.struct((-F.try_element_at(counts, e + 1)).alias("n"), e.alias("e"))))
    return best["e"].cast("int")


# ---------------------------------------------------------------- T8 - T13
def step_summary(layer_counts: DataFrame, num_experts: int = NUM_EXPERTS,
                 num_layers: int | None = None) -> DataFrame:
    """Per step: expert totals over layers, T8 shares, T9 layer map, T10 entropy.

    With ``num_layers`` the T7 completeness rule is applied inside the same
    aggregation (no separate window).
    """
    lc = layer_counts.withColumn("_dom", dominant_expert(F.col("counts"), num_experts))
    agg = lc.groupBy("session", "step").agg(
        *_expert_sums(F.col("counts"), num_experts, "_t"),
        F.array_sort(F.collect_list(F.struct("layer", "_dom"))).alias("_layers"),
        F.max("t_sec").alias("t_sec"),
        F.count(F.lit(1)).alias("_nl"))
    if num_layers is not None:
        agg = agg.filter(F.col("_nl") == num_layers)
    pct, entropy = share_and_entropy([F.col(f"_t{e}") for e in range(num_experts)])
    return agg.select("session", "step", "t_sec", pct.alias("expert_pct"), entropy.alias("entropy_pct"),
                      F.transform(F.col("_layers"), lambda z: z["_dom"]).alias("layer_experts"))


def share_and_entropy(totals: list[Column]) -> tuple[Column, Column]:
    """T8 shares and T10 entropy from the hit totals of a step."""
    total = sum(totals, F.lit(0))
    pct = F.array(*[F.when(total > 0, t / total * 100.0).otherwise(F.lit(0.0)) for t in totals])
    # fixed value: an empty step is scored as uniform over 8 experts
    probs = F.when(total > 0, F.array(*[t / total for t in totals])).otherwise(F.array_repeat(F.lit(1.0 / 8), 8))
    ent = -F.aggregate(probs, F.lit(0.0).cast("double"), lambda a, p: a + p * F.log2(p + F.lit(ENTROPY_EPS)))
    return pct, ent / F.log2(F.lit(float(len(totals)))) * 100.0


def rate_of(avg_gap: Column) -> Column:
    """Steps per second of a mean gap; 1 before the first gap, 0 for gaps of no length."""
    return F.when(avg_gap.isNull(), F.lit(1.0)).when(avg_gap > 0, 1.0 / avg_gap).otherwise(F.lit(0.0))


#: Steps in a block of a session; step numbers are distinct, so a block never holds more rows.
BLOCK_STEPS = 4096


def session_windows(steps: DataFrame, num_experts: int = NUM_EXPERTS, block_steps: int = BLOCK_STEPS) -> DataFrame:
    """T11 tokens/s over the last 10 gaps, T12 running mean share, T13 token index.

    A segmented prefix scan: a session is cut into blocks of ``block_steps`` step numbers,
    which windows run over on their own.  What a block leaves to the next ones is one row
    (number of rows, sums of shares, clocks of its last ten steps), and only these rows are
    ordered per session, so one very long session spreads over many tasks."""
    rows = steps.withColumn("_block", F.expr(f"step div {block_steps}"))
    inside = Window.partitionBy("session", "_block").orderBy("step")
    upto = inside.rowsBetween(Window.unboundedPreceding, 0)
    clock = F.struct("t_sec")              # a struct, so that missing clocks keep their place
    rows = rows.withColumns({
        "_n": F.row_number().over(inside),
        "_clocks": F.collect_list(clock).over(inside.rowsBetween(-RATE_WINDOW, 0)),
        "_sums": F.array(*[F.sum(F.try_element_at("expert_pct", F.lit(e + 1))).over(upto) for e in range(num_experts)])})
    blocks = rows.groupBy("session", "_block").agg(
        F.max("_n").alias("n"), F.max_by(F.struct("_sums", F.slice("_clocks", -F.least(F.size("_clocks"), F.lit(RATE_WINDOW)), RATE_WINDOW)
                                                  .alias("clocks")), "_n").alias("last"))
    before = Window.partitionBy("session").orderBy("_block")
    sofar = before.rowsBetween(Window.unboundedPreceding, -1)
    carried = blocks.select(
        "session", "_block", F.coalesce(F.sum("n").over(sofar), F.lit(0)).alias("_n0"),
        F.array(*[F.coalesce(F.sum(F.get("last._sums", F.lit(e))).over(sofar), F.lit(0.0)) for e in range(num_experts)]).alias("_sums0"),
        # ten blocks hold ten steps at least
        F.flatten(F.collect_list("last.clocks").over(before.rowsBetween(-RATE_WINDOW, -1))).alias("_clocks0"))
    both = rows.join(carried, ["session", "_block"])
    index = F.col("_n0") + F.col("_n")
    clocks = F.concat("_clocks0", "_clocks")
    last = F.slice(clocks, -F.least(F.size(clocks), F.lit(RATE_WINDOW + 1)), RATE_WINDOW + 1)
    gaps = let(last, lambda t: F.filter(F.transform(t, lambda x, i: x["t_sec"] - F.get(t, i - 1)["t_sec"]), lambda g: g.isNotNull()))
    avg_gap = let(gaps, lambda g: F.aggregate(g, F.lit(0.0).cast("double"), lambda a, x: a + x) / F.nullif(F.size(g), F.lit(0)))
    return both.select(
        *steps.columns, rate_of(avg_gap).alias("tokens_per_sec_raw"),
        F.array(*[(F.get("_sums0", F.lit(e)) + F.get("_sums", F.lit(e))) / index for e in range(num_experts)]).alias("session_avg"),
        index.cast("bigint").alias("token_index"))


def routing_events(logits_df: DataFrame, num_layers: int, k: int = TOP_K,
                   num_experts: int = NUM_EXPERTS, report_col: str = "report") -> DataFrame:
    """The routing event per complete step, values rounded to 1 decimal at the edge.

    Layer counts, steps and blocks of steps are partitioned by their own keys, so no
    session is one task; the logits themselves are aggregated before the first shuffle.
    """
    lc = layer_expert_counts(route(logits_df, k), num_experts, report_col)
    ev = session_windows(step_summary(lc, num_experts, num_layers), num_experts)
    r1 = lambda c: F.transform(c, lambda x: F.round(x, 1))
    return ev.select(
        "session", "step", F.lit("routing").alias("type"),
        r1(F.col("expert_pct")).alias("expert_pct"),
        r1(F.col("session_avg")).alias("session_avg"),
        F.round("entropy_pct", 1).alias("entropy_pct"),
        F.round("tokens_per_sec_raw", 1).alias("tokens_per_sec"),
        F.col("token_index").cast("bigint").alias("token_index"),
        "layer_experts")


def event_json(events: DataFrame) -> Column:
    return F.to_json(F.struct("type", "expert_pct", "session_avg", "entropy_pct",
                              "tokens_per_sec", "token_index", "layer_experts"))


# ---------------------------------------------------------------- T16 / T17
def routing_matrix(events: DataFrame, num_layers: int = MATRIX_LAYERS, seq_col: str | None = None) -> DataFrame:
    """Long-form routing matrix (session, token_index, layer, expert).

    The latest event wins per cell (``seq_col`` orders events; default:
    ``step``); tokens whose layer 0 is empty are dropped; layers a token's
    events never reported are -1.  Each token's row holds at most
    ``num_layers`` cells, so the re-pack is a bounded group.
    """
    seq = seq_col or "step"
    # one array per token: per layer the expert of the latest event that reported it
    per_tok = events.groupBy("session", "token_index").agg(*[
        F.max_by(F.get("layer_experts", F.lit(l)), F.when(F.size("layer_experts") > l, F.col(seq))).alias(f"_c{l}")
        for l in range(num_layers)])
    full = F.array(*[F.coalesce(F.col(f"_c{l}"), F.lit(-1)) for l in range(num_layers)])
    return (per_tok.where(F.col("_c0").isNotNull())
            .select("session", "token_index", F.posexplode(full).alias("layer", "expert")))


def routing_summary(events: DataFrame, num_layers: int = MATRIX_LAYERS) -> DataFrame:
    """One text line per event, ``Token {idx:3d}: L00:E3 L01:E5 ...``."""
    cells = F.transform(F.slice("layer_experts", 1, num_layers),
                        lambda e, l: F.printf(F.lit("L%02d:E%d"), l, e))
    return events.select("session", "token_index",
                         F.printf(F.lit("Token %3d: %s"), F.col("token_index").cast("int"),
                                  F.array_join(cells, " ")).alias("line"))


# Fixed value: the first line of the text summary.
SUMMARY_HEADER = "Per\u2011token expert routing (layer \u2192 expert ID):"


def summary_text(events: DataFrame, num_layers: int = MATRIX_LAYERS) -> DataFrame:
    """T17 as the text file has it: per session a header line (``line_no`` 0) and the tokens' lines,
    which ``line_no`` puts in token order."""
    header = events.select("session").distinct().select("session", F.lit(0).cast("bigint").alias("line_no"), F.lit(SUMMARY_HEADER).alias("line"))
    lines = routing_summary(events, num_layers).select("session", F.col("token_index").cast("bigint").alias("line_no"), "line")
    return header.unionAll(lines)


def write_summary(events: DataFrame, path: str, num_layers: int = MATRIX_LAYERS) -> None:
    """The text summary of every session as files under ``session=``, lines in order.  Ranges of
    (session, line) are sorted side by side, so a long session is many files in order."""
    (summary_text(events, num_layers).repartitionByRange("session", "line_no").sortWithinPartitions("session", "line_no")
     .select("session", "line").write.partitionBy("session").text(path))


# ---------------------------------------------------------------- T18 - T21
def router_metrics(logits_df: DataFrame, k: int = TOP_K, num_experts: int = NUM_EXPERTS,
                   by: str = "step") -> DataFrame:
    """T18 entropy (nats), T19 mean expert usage, T20 balance loss per training step.

    One pass over the logits: per (step, layer) token means, then per step
    means over layers; the balance loss needs only per-step sums.
    """
    routed = route(logits_df, k)
    tok_ent = -F.aggregate(F.col("probs"), F.lit(0.0).cast("double"),
                           lambda a, p: a + p * F.log(p + F.lit(ENTROPY_EPS)))
    hit = lambda e: F.when(F.array_contains("top", e), 1).otherwise(0)
    per_layer = routed.groupBy(by, "layer").agg(
        F.avg(tok_ent).alias("_ent"),
        *[F.avg(F.try_element_at("probs", F.lit(e + 1))).alias(f"_u{e}") for e in range(num_experts)],
        *[F.sum(hit(e)).alias(f"_f{e}") for e in range(num_experts)],
        *[F.sum(F.try_element_at("probs", F.lit(e + 1))).alias(f"_p{e}") for e in range(num_experts)],
        F.count(F.lit(1)).alias("_n"))
    per_step = per_layer.groupBy(by).agg(
        F.avg("_ent").alias("routing_entropy_raw"),
        *[F.avg(f"_u{e}").alias(f"_u{e}") for e in range(num_experts)],
        *[F.sum(f"_f{e}").alias(f"_f{e}") for e in range(num_experts)],
        *[F.sum(f"_p{e}").alias(f"_p{e}") for e in range(num_experts)],
        F.sum("_n").alias("_n"))
    n = F.col("_n")
    lb = sum(((F.col(f"_f{e}") / n) * (F.col(f"_p{e}") / n) for e in range(num_experts)), F.lit(0.0)) \
        * F.lit(float(num_experts))
    return per_step.select(
        by, "routing_entropy_raw",
        *[F.col(f"_u{e}").alias(f"expert_{e}_usage") for e in range(num_experts)],
        lb.alias("aux_loss"), n.alias("n_router_rows"))


def training_log(metrics: DataFrame, num_experts: int = NUM_EXPERTS, by: str = "step") -> DataFrame:
    """The logged view of T18/T19: entropy to 4 decimals, ``expert_{i}_pct`` to 2."""
    return metrics.select(by, F.round("routing_entropy_raw", 4).alias("routing_entropy"),
                          *[F.round(F.col(f"expert_{e}_usage") * 100.0, 2).alias(f"expert_{e}_pct")
                            for e in range(num_experts)],
                          "aux_loss")


def eval_aux_mean(step_aux: DataFrame, eval_col: str = "eval_id") -> DataFrame:
    """Mean balance loss over the batches of each evaluation."""
    return step_aux.groupBy(eval_col).agg(F.avg("aux_loss").alias("eval_aux_loss"),
                                          F.count(F.lit(1)).alias("n_batches"))
