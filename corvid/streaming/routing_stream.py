"""Routing events over a stream of router logits (T7, T11-T14 as a stateful operator).

Row-count window frames are not available on streaming DataFrames, so a session's state
carries what the batch windows compute.  The work is split in three: Column functions
route the logits and make one-hot hits; the state step adds arrays (hit totals of open
steps, the last gaps, running sums of shares); Column functions shared with the batch
operators turn its output into shares, dominant experts, entropy and rate.

State is typed and keyed: a map entry per reported (step, layer) of an open step, a map
entry per open step with the layers it still waits for, and one value per session.  A
batch reads and writes the entries of its own rows only; a step that is complete takes its
entries with it, so state does not grow with closed steps.

Input contract (as the telemetry hook reports): the rows of one report of a layer arrive
in the same micro-batch, and a session's steps arrive in step order.  A later report of
a layer replaces an earlier one (``report``) until its step is complete.
"""
from __future__ import annotations

from typing import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from ..operators import routing as R

STEP_SCHEMA = T.StructType([
    T.StructField("session", T.LongType()), T.StructField("step", T.LongType()), T.StructField("token_index", T.LongType()),
    T.StructField("layer_counts", T.ArrayType(T.ArrayType(T.LongType()))), T.StructField("share_sums", T.ArrayType(T.DoubleType())),
    T.StructField("gap_sum", T.DoubleType()), T.StructField("gap_n", T.LongType())])
#: Processing time after which entries of an idle session go.
IDLE_MS = 60 * 60 * 1000
#: The state store that keyed state needs.
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class SessionSteps(StatefulProcessor):
    """Completes the steps of one session."""

    def __init__(self, num_layers: int, num_experts: int, idle_ms: int | None):
        self.num_layers, self.num_experts, self.idle_ms = num_layers, num_experts, idle_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.reports = handle.getMapState("reports", "step long, layer int", "report long, hits array<long>", self.idle_ms)
        self.open = handle.getMapState("open", "step long", "layers array<int>, clock double", self.idle_ms)
        self.session = handle.getValueState("session", "steps long, clock double, gaps array<double>, sums array<double>", self.idle_ms)

    def _report(self, step: int, layer: int, report: int, hits: np.ndarray) -> None:
        held = self.reports.getValue((step, layer)) if self.reports.containsKey((step, layer)) else None
        if held is not None and held[0] == report:
            hits = hits + np.array(held[1])      # token rows of one report, split over batches
        if held is None or held[0] <= report:
            self.reports.updateValue((step, layer), (report, hits.tolist()))

    def _close(self, step: int, layers: list[int], clock: float | None) -> tuple:
        counts = np.array([self.reports.getValue((step, layer))[1] for layer in sorted(layers)])
        for layer in layers:
            self.reports.removeKey((step, layer))
        steps, last, gaps, sums = self.session.get() if self.session.exists() else (0, None, [], [0.0] * self.num_experts)
        sums = (np.array(sums) + counts.sum(axis=0) * (100.0 / max(1, counts.sum()))).tolist()
        if clock is not None:
            if last is not None:
                gaps = [*gaps, clock - last][-R.RATE_WINDOW:]
            last = clock
        self.session.update((steps + 1, last, list(gaps), sums))
        return step, steps + 1, counts.tolist(), sums, float(sum(gaps)), len(gaps)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        frames = [p for p in rows if len(p)]
        if not frames:
            return
        pdf = pd.concat(frames, ignore_index=True)
        done = []
        for step, of_step in pdf.groupby("step", sort=True):
            step = int(step)
            layers, clock = self.open.getValue((step,)) if self.open.containsKey((step,)) else ([], None)
            layers = set(layers)
            for (layer, report), own in of_step.groupby(["layer", "report"], sort=True):
                self._report(step, int(layer), int(report), np.stack(own["hits"].to_numpy()).sum(axis=0))
                layers.add(int(layer))
            if (t := of_step["t_sec"].max()) is not None and t == t:
                clock = float(t) if clock is None else max(clock, float(t))
            if len(layers) < self.num_layers:
                self.open.updateValue((step,), (sorted(layers), clock))
                continue
            if self.open.containsKey((step,)):
                self.open.removeKey((step,))
            done.append((key[0], *self._close(step, sorted(layers), clock)))
        if done:
            yield pd.DataFrame(done, columns=STEP_SCHEMA.names)

    def close(self) -> None:
        pass


def stream_routing_events(logits: DataFrame, num_layers: int, k: int = R.TOP_K, num_experts: int = R.NUM_EXPERTS,
                          idle_timeout_ms: int | None = IDLE_MS) -> DataFrame:
    """Streaming routing events keyed by session; emit order follows step order.

    State that has not been written for ``idle_timeout_ms`` of processing time goes; ``None``
    keeps it.  Sets the session's state store to the one that keyed state needs.
    """
    logits.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)
    report = F.col("report") if "report" in logits.columns else F.lit(0)
    routed = R.route(logits, k).select("session", "step", "layer", "t_sec", report.cast("long").alias("report"),
                                       R.expert_hits(F.col("top"), num_experts).alias("hits"))
    steps = routed.groupBy("session").transformWithStateInPandas(
        SessionSteps(num_layers, num_experts, idle_timeout_ms), STEP_SCHEMA, "Append", "ProcessingTime" if idle_timeout_ms else "None")

    def over_layers(e: int) -> Column:
        return F.aggregate("layer_counts", F.lit(0).cast("long"), lambda a, c: a + F.get(c, F.lit(e)))
    totals = F.array(*[over_layers(e) for e in range(num_experts)])
    pct, entropy = R.share_and_entropy([F.get("_totals", F.lit(e)) for e in range(num_experts)])
    return steps.withColumn("_totals", totals).select(
        "session", "step", "token_index", pct.alias("expert_pct"),
        F.transform("share_sums", lambda s: s / F.col("token_index")).alias("session_avg"), entropy.alias("entropy_pct"),
        R.rate_of(F.col("gap_sum") / F.nullif(F.col("gap_n"), F.lit(0))).alias("tokens_per_sec"),
        F.transform("layer_counts", lambda c: R.dominant_expert(c, num_experts)).alias("layer_experts"))


def rounded(events: DataFrame) -> DataFrame:
    """The event record's 1-decimal view."""
    r1 = lambda c: F.transform(c, lambda x: F.round(x, 1))
    return events.select("session", "step", F.lit("routing").alias("type"), r1(F.col("expert_pct")).alias("expert_pct"),
                         r1(F.col("session_avg")).alias("session_avg"), F.round("entropy_pct", 1).alias("entropy_pct"),
                         F.round("tokens_per_sec", 1).alias("tokens_per_sec"), "token_index", "layer_experts")
