"""Latency and usage of requests out of a live chunk stream.

Event-time aggregation: chunks that are sent again are dropped, a request is closed once
no chunk of it has come for ``idle`` (in event time) and the watermark has passed, and
its state goes with it.
"""
from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

_USAGE = ("prompt_tokens", "completion_tokens", "total_tokens")


def stream_usage(chunks: DataFrame, key: str = "request_id", seq: str = "seq", ts: str = "ts",
                 delay: str = "10 minutes", idle: str = "30 minutes") -> DataFrame:
    """One row per closed request: ``ttft_sec`` and ``total_sec`` as :func:`corvid.operators.chat.ttft`
    has them, ``n_chunks``, ``model`` and the ``usage_*`` counts where the stream has them.

    ``chunks`` has ``key``, ``seq``, a timestamp ``ts`` and ``content``.  A chunk may come up to
    ``delay`` late; repeats of a ``(key, seq)`` that late count once.  Works on a stream in
    append mode and on a batch alike."""
    cols = set(chunks.columns)
    once = chunks.withWatermark(ts, delay)
    once = once.dropDuplicatesWithinWatermark([key, seq]) if chunks.isStreaming else once.dropDuplicates([key, seq])
    t = F.unix_micros(F.col(ts))
    extra = [F.max("model").alias("model")] if "model" in cols else []
    extra += [F.max(f"usage_{u}").alias(f"usage_{u}") for u in _USAGE if f"usage_{u}" in cols]
    whole = once.groupBy(F.session_window(F.col(ts), idle), F.col(key)).agg(
        F.min(t).alias("_t0"), F.max(t).alias("_t1"), F.min(F.when(F.coalesce(F.col("content"), F.lit("")) != "", t)).alias("_tf"),
        F.count(F.lit(1)).alias("n_chunks"), *extra)
    kept = [c for c in whole.columns if c not in ("session_window", "_t0", "_t1", "_tf")]
    return whole.select(*kept, ((F.col("_tf") - F.col("_t0")) / 1e6).alias("ttft_sec"), ((F.col("_t1") - F.col("_t0")) / 1e6).alias("total_sec"),
                        F.col("session_window.end").alias("closed_at"))
