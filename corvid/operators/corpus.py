"""Corpus preparation P1-P19: samples, tokens, masks, quotas, splits and batches.

Every function is ``DataFrame -> DataFrame``.  Global orders (stream order,
seeded shuffles, batch order) use the two-level ranks of
:mod:`corvid.plans.ordering`; per-source tables (spec, quotas, cutoffs) have
one row per source and are the only things broadcast.
"""
from __future__ import annotations

from functools import reduce
from typing import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import tokens as TK
from ..functions.chat import QWEN_DEFAULT_SYSTEM, render_chat
from ..plans.barrier import compute_once
from ..plans.ordering import KeyRanges, global_index, hex_bucket, int_bucket, key_ranges, nth_row, range_index, seeded_key
from ..session import cut_lineage

CONTEXT_LENGTH = 2048     # fixed value: training context length
EVAL_FRACTION = 0.05      # fixed value: eval share of each source's allocation
SEED = 42                 # fixed value: shuffle / interleave seed
PAD_MULTIPLE = 8          # fixed value: batch padding multiple

REJECTED, OVERFLOW, MASKED, VALID = "format_rejected", "context_overflow", "all_labels_masked", "valid"


# ---------------------------------------------------------------- S1 / P1
def with_raw_index(df: DataFrame, key: str, ranges: KeyRanges | None = None, name: str = "raw_idx") -> DataFrame:
    """Dense, stable 0-based stream position from a unique integer source key of any spread.

    ``ranges`` are the key's ranges (:func:`corvid.plans.ordering.key_ranges`); without them
    they are looked up first.  Rows without a key are left out."""
    ranges = ranges or key_ranges({name: (df, key)})[name]
    return range_index(df.where(F.col(key).isNotNull()), key, ranges, name)


def explode_samples(formatted: DataFrame, samples: str = "samples", keep: Sequence[str] = ()) -> DataFrame:
    """One row per sample in order; a rejected raw row keeps one placeholder row."""
    cols = list(keep) or [c for c in formatted.columns if c != samples]
    x = formatted.select(*cols, F.posexplode_outer(samples).alias("_pos", "messages"))
    return (x.withColumn("sample_idx", F.coalesce(F.col("_pos"), F.lit(0)).cast("int"))
            .withColumn("rejected", F.col("messages").isNull() | (F.size("messages") == 0))
            .drop("_pos"))


# ---------------------------------------------------------------- P2 - P7
def tokenize_and_mask(samples: DataFrame, context_length: int = CONTEXT_LENGTH,
                      encoder: TK.Encoder | None = None,
                      default_system: str | None = QWEN_DEFAULT_SYSTEM) -> DataFrame:
    """P2-P7 and the status of every sample.

    ``encoder`` brings ids, marker and vocabulary length of one tokenizer; default is the
    built-in hashed encoder (files: :func:`corvid.functions.udfs.tokenizer_encoder`).
    Rejected rows are never rendered or tokenized.
    """
    enc = encoder or TK.hash_encoder()
    text = F.when(~F.col("rejected"), render_chat(F.col("messages"), False, default_system))
    df = compute_once(samples, _ids_full=enc.ids(text))
    df = df.withColumn("n_tokens", F.size("_ids_full"))
    df = df.withColumn("overflow", F.coalesce(F.col("n_tokens") >= context_length, F.lit(False)))
    ids = F.slice("_ids_full", 1, context_length)
    df = df.withColumn("input_ids", F.when(~F.col("rejected") & ~F.col("overflow"), ids)).drop("_ids_full")
    df = compute_once(df, labels=TK.clamp_labels(TK.assistant_labels(F.col("input_ids"), enc.marker), enc.full_length))
    df = df.withColumn("attention_mask", F.array_repeat(F.lit(1), F.size("input_ids")))
    status = (F.when(F.col("rejected"), F.lit(REJECTED))
              .when(F.col("overflow"), F.lit(OVERFLOW))
              .when(~TK.has_label(F.col("labels")), F.lit(MASKED))
              .otherwise(F.lit(VALID)))
    return df.withColumn("status", status)


def drop_overflow(df: DataFrame, context_length: int = CONTEXT_LENGTH) -> DataFrame:
    """Keep samples shorter than the context (an exact-length sample is dropped)."""
    return df.filter(F.size("input_ids") < context_length)


def drop_all_masked(df: DataFrame) -> DataFrame:
    """Keep samples with at least one label."""
    return df.filter(TK.has_label(F.col("labels")))


# ---------------------------------------------------------------- P8 / P9
def take_quota(samples: DataFrame, quota: DataFrame, width: int = 1 << 16) -> DataFrame:
    """Rows streamed up to and including the n-th valid sample of each source.

    ``quota`` holds (source, n).  Only the raw-index bucket containing the
    n-th valid sample is ranked; a source that never reaches n keeps all rows, and one
    with n <= 0 keeps none.
    """
    valid = samples.filter(F.col("status") == VALID).select("source", "raw_idx", "sample_idx")
    cut = nth_row(valid, ["raw_idx", "sample_idx"], int_bucket("raw_idx", width), quota, ["source"])
    cut = cut.select("source", F.col("raw_idx").alias("_cut_raw"), F.col("sample_idx").alias("_cut_s"))
    # one row per source; a source without a cut keeps its rows only if it asks for any
    want = quota.select("source", (F.col("n") > 0).alias("_any")).join(cut, "source", "left")
    j = samples.join(F.broadcast(want), "source", "left")
    inside = F.coalesce("_any", F.lit(True)) & (
        F.col("_cut_raw").isNull() | (F.col("raw_idx") < F.col("_cut_raw"))
        | ((F.col("raw_idx") == F.col("_cut_raw")) & (F.col("sample_idx") <= F.col("_cut_s"))))
    return j.filter(inside).drop("_cut_raw", "_cut_s", "_any")


def collect_diagnostics(streamed: DataFrame, quota: DataFrame) -> DataFrame:
    """Per-source counters over the streamed rows (rejections count raw rows)."""
    cnt = lambda s: F.sum(F.when(F.col("status") == s, 1).otherwise(0))
    agg = streamed.groupBy("source").agg(
        (F.max("raw_idx") + 1).alias("raw_streamed"),
        cnt(VALID).alias("samples_collected"),
        cnt(REJECTED).alias("format_rejected"),
        cnt(OVERFLOW).alias("context_overflow"),
        cnt(MASKED).alias("all_labels_masked"))
    d = F.broadcast(quota.select("source", "n")).join(agg, "source", "left")
    z = lambda c: F.coalesce(F.col(c), F.lit(0)).cast("bigint")
    d = d.select("source", F.col("n").alias("requested"), *[z(c).alias(c) for c in
                 ("raw_streamed", "samples_collected", "format_rejected", "context_overflow", "all_labels_masked")])
    return (d.withColumn("total_skipped", F.col("format_rejected") + F.col("context_overflow") + F.col("all_labels_masked"))
            .withColumn("overflow_rate", F.when(F.col("raw_streamed") > 0,
                                                F.col("context_overflow") / F.col("raw_streamed") * 100.0)
                        .otherwise(F.lit(0.0)))
            .withColumn("exhausted", F.col("samples_collected") < F.col("requested")))


def reject_reasons(streamed: DataFrame) -> DataFrame:
    """Streamed raw rows that were rejected, per source and stated reason (null where a shape
    states none)."""
    return (streamed.where(F.col("status") == REJECTED).groupBy("source", "reject_reason").agg(F.count(F.lit(1)).alias("n_rows")))


# ---------------------------------------------------------------- P10 - P13
def allocate(spec: DataFrame, total_samples: int, eval_fraction: float = EVAL_FRACTION) -> DataFrame:
    """P10: total / eval / train allocation per source from (name, weight)."""
    total = F.floor(F.lit(float(total_samples)) * F.col("weight")).cast("bigint")
    ev = F.greatest(F.lit(1), F.floor(total * F.lit(eval_fraction)).cast("bigint"))
    return spec.select(F.col("name").alias("source"), "weight", *[c for c in ("ord",) if c in spec.columns],
                       total.alias("total_alloc")) \
        .withColumn("eval_alloc", ev.cast("bigint")) \
        .withColumn("train_alloc", F.col("total_alloc") - F.col("eval_alloc"))


def seeded_shuffle_key(seed: int = SEED, *parts) -> Column:
    """The seeded order of samples (md5 of seed and sample identity)."""
    return seeded_key(seed, *(parts or ("source", "raw_idx", "sample_idx")))


def train_eval_split(collected: DataFrame, alloc: DataFrame, seed: int = SEED) -> DataFrame:
    """P11 + P12: shuffle each source, the last min(eval_alloc, n) rows are eval.

    Adds ``shuffle_key`` and ``split``.  Only the md5 bucket that holds the
    train/eval boundary is ranked.
    """
    df = collected.withColumn("shuffle_key", seeded_shuffle_key(seed))
    n = df.groupBy("source").agg(F.count(F.lit(1)).alias("_n"))
    q = (F.broadcast(alloc.select("source", "eval_alloc")).join(n, "source")
         .select("source", (F.col("_n") - F.least(F.col("eval_alloc"), F.col("_n"))).alias("n")))
    cut = nth_row(df, ["shuffle_key"], hex_bucket("shuffle_key"), q, ["source"])
    cut = cut.select("source", F.col("shuffle_key").alias("_cut"))
    j = df.join(F.broadcast(cut), "source", "left")
    split = F.when(F.col("_cut").isNotNull() & (F.col("shuffle_key") <= F.col("_cut")), "train").otherwise("eval")
    return j.withColumn("split", split).drop("_cut")


def align_union(frames: Sequence[DataFrame]) -> DataFrame:
    """Cast every frame to the first frame's schema, then union by name."""
    target = frames[0].schema
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f.select(*[F.col(fl.name).cast(fl.dataType).alias(fl.name) for fl in target]))
    return out


# ---------------------------------------------------------------- P14
def draw_source(u: Column, names: Sequence, weights: Sequence[float]) -> Column:
    """First source whose cumulative weight exceeds u (u uniform in [0, 1))."""
    expr, cum = None, 0.0
    for name, w in zip(names[:-1], weights[:-1]):
        cum += w
        expr = (F.when(u < cum, F.lit(name)) if expr is None else expr.when(u < cum, F.lit(name)))
    return F.lit(names[-1]) if expr is None else expr.otherwise(F.lit(names[-1]))


#: Draws that are looked at together.
DRAW_BUCKET = 4096


def weighted_interleave(df: DataFrame, names: Sequence[str], weights: Sequence[float],
                        seed: int = SEED, label: str = "train", width: int = DRAW_BUCKET) -> DataFrame:
    """P14 of one set of rows; see :func:`interleave_splits`."""
    return interleave_splits(df.withColumn("split", F.lit(label)), names, weights, seed, (label,), width).drop("split")


def interleave_splits(df: DataFrame, names: Sequence[str], weights: Sequence[float], seed: int = SEED,
                      labels: Sequence[str] = ("train", "eval"), width: int = DRAW_BUCKET) -> DataFrame:
    """P14 for every ``split`` at once: weighted draw of sources, each draw takes that source's
    next row (in ``shuffle_key`` order), stopping once any source is used up (its last row
    included).  Adds ``mix_idx`` (draw number) and ``order_key`` (final seeded shuffle).

    A draw is a function of its number, so draws are made where they are needed, in buckets
    of ``width`` numbers: how often a bucket draws each source gives, by prefix sums over
    buckets, the rank of every draw and the bucket in which a source ends.  Nothing but one
    row per bucket is shuffled for them; the rows are ranked once for all splits.  A source
    without rows stops the mix before its first draw."""
    spark = df.sparkSession
    rows = {(r["split"], r["source"]): r["n"] for r in df.groupBy("split", "source").agg(F.count(F.lit(1)).alias("n")).collect()}
    has = {label: [rows.get((label, s), 0) for s in names] for label in labels}
    parts = [spark.range(-(-sum(n) // width)).select(F.lit(label).alias("split"), F.col("id").alias("_b"), F.lit(sum(n)).cast("long").alias("_total"))
             for label, n in has.items()]
    buckets = reduce(DataFrame.unionAll, parts)

    def per_split(value) -> Column:
        """A number of each split."""
        return F.coalesce(*[F.when(F.col("split") == label, F.lit(value(n))) for label, n in has.items()])

    def draws(of: DataFrame) -> DataFrame:
        numbers = F.sequence(F.col("_b") * width, F.least((F.col("_b") + 1) * width, F.col("_total")) - 1)

        def one(k: Column) -> Column:
            u = F.conv(F.substring(seeded_key(seed, F.lit("draw"), F.col("split"), k), 1, 8), 16, 10).cast("double") / F.lit(4294967296.0)
            return F.struct(k.alias("k"), draw_source(u, list(range(len(names))), weights).alias("s"))
        return compute_once(of, _draws=F.transform(numbers, one))

    def drawn(i: int) -> Column:
        return F.filter("_draws", lambda d: d["s"] == i)
    sources = range(len(names))
    counts = draws(buckets).select("split", "_b", "_total", *[F.size(drawn(i)).cast("long").alias(f"_c{i}") for i in sources])
    before = Window.partitionBy("split").orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    offsets = cut_lineage(counts.select("*", *[F.coalesce(F.sum(f"_c{i}").over(before), F.lit(0)).alias(f"_o{i}") for i in sources]))
    # the draw that takes a source's last row (or, of an empty one, its first): in one bucket per source and split
    wanted = [per_split(lambda n, i=i: max(1, n[i])) for i in sources]
    ends_here = [(F.col(f"_o{i}") < wanted[i]) & (wanted[i] <= F.col(f"_o{i}") + F.col(f"_c{i}")) for i in sources]
    last = [F.when(ends_here[i], F.get(drawn(i), (wanted[i] - F.col(f"_o{i}") - 1).cast("int"))["k"] - per_split(lambda n, i=i: int(n[i] == 0)))
            for i in sources]
    stop = (draws(offsets.where(reduce(Column.__or__, ends_here))).select("split", F.array_min(F.array(*last)).alias("_k"))
            .groupBy("split").agg(F.min("_k").alias("_stop")))

    def ranked_of(i: int) -> Column:
        return F.transform(drawn(i), lambda d, j: F.struct(F.lit(names[i]).alias("source"), (F.col(f"_o{i}") + j + 1).alias("_rank"), d["k"].alias("mix_idx")))
    mix = draws(offsets.join(F.broadcast(stop), "split", "left")).select("split", "_stop", F.inline(F.concat(*map(ranked_of, sources))))
    mix = mix.where(F.col("_stop").isNull() | (F.col("mix_idx") <= F.col("_stop"))).drop("_stop")
    ranked = global_index(df, ["shuffle_key"], hex_bucket("shuffle_key"), ["split", "source"], name="_rank")
    out = mix.join(ranked, ["split", "source", "_rank"]).drop("_rank")
    return out.withColumn("order_key", seeded_key(seed, F.lit("mix"), F.col("split"), F.col("mix_idx")))


# ---------------------------------------------------------------- P15 - P18
def validate_samples(df: DataFrame, context_length: int = CONTEXT_LENGTH) -> DataFrame:
    """Violation counts over every row (not just row 0)."""
    bad = lambda c: F.sum(F.when(c, 1).otherwise(0)).cast("bigint")
    return df.groupBy("split").agg(
        F.count(F.lit(1)).alias("n_rows"),
        bad(F.size("input_ids") != F.size("labels")).alias("length_mismatch"),
        bad(F.size("input_ids") != F.size("attention_mask")).alias("mask_mismatch"),
        bad(F.size("input_ids") > context_length).alias("too_long"),
        bad(~TK.has_label(F.col("labels"))).alias("all_masked"),
        F.sum(TK.n_label_tokens(F.col("labels"))).cast("bigint").alias("label_tokens"),
        F.sum(F.size("input_ids")).cast("bigint").alias("tokens"))


def language_breakdown(df: DataFrame, lang_col: str = "lang") -> DataFrame:
    """Count and share per language (the share uses a one-row global total)."""
    c = df.groupBy(lang_col).agg(F.count(F.lit(1)).alias("n"))
    # one row per language: the global window runs over the aggregated table only
    return c.withColumn("pct", F.col("n") / F.sum("n").over(Window.partitionBy()) * 100.0)


def pad_batches(df: DataFrame, order_col: str = "order_key", batch_size: int = 16,
                pad_id: int = TK.DEFAULT_VOCAB.pad_id, multiple: int = PAD_MULTIPLE,
                side: str = "right") -> DataFrame:
    """Consecutive groups of ``batch_size`` padded to the batch max rounded
    up to ``multiple``; labels pad with -100, the mask with 0."""
    r = global_index(df, [order_col], hex_bucket(order_col), name="_pos")
    r = r.withColumn("batch_id", F.floor((F.col("_pos") - 1) / batch_size).cast("bigint"))
    w = Window.partitionBy("batch_id")           # at most batch_size rows per group
    r = r.withColumn("padded_len", TK.round_up(F.max(F.size("input_ids")).over(w), multiple))
    pad = TK.pad_right if side == "right" else TK.pad_left
    t = F.col("padded_len")
    return r.select(*[c for c in r.columns if c not in ("input_ids", "labels", "attention_mask", "_pos")],
                    (F.col("_pos") - 1).alias("position"),
                    pad(F.col("input_ids"), t, pad_id).alias("input_ids"),
                    pad(F.col("labels"), t, TK.IGNORE_INDEX).alias("labels"),
                    pad(F.col("attention_mask"), t, 0).alias("attention_mask"))


def corpus_summary(df: DataFrame, batch_size: int = 16, grad_accum: int = 1) -> DataFrame:
    """Rows per split and optimizer steps per epoch."""
    return df.groupBy("split").agg(F.count(F.lit(1)).alias("n_rows")) \
        .withColumn("steps_per_epoch", F.floor(F.col("n_rows") / F.lit(batch_size * grad_accum)).cast("bigint"))


def reload_select(df: DataFrame, wanted: Sequence[str] = ("input_ids", "attention_mask", "labels")) -> DataFrame:
    """Keep the known tensor columns that exist (pruned at the scan)."""
    return df.select(*[c for c in wanted if c in df.columns])
