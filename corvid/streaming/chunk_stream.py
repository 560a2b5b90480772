"""Tool calls out of a live chunk stream (C7) and SSE log tails.

State per request is the text held back; it is flushed when the finishing chunk
(non-null ``finish_reason``) arrives, or when the request has been idle past the timeout.
"""
from __future__ import annotations

from typing import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..functions import udfs as U
from ..operators.sse import sse_routing_events

PART_SCHEMA = "request_id long, seq long, kind string, value string"
STATE_SCHEMA = "buf string"


#: Processing time after which an abandoned request is flushed.
IDLE_MS = 15 * 60 * 1000


def _scanner(idle_timeout_ms):
    def fn(key, pdfs: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        pending = state.get[0] if state.exists else ""
        out: list[tuple[int, str, object]] = []
        if state.hasTimedOut:
            out = [(-1, *part) for part in U.flush_pending(pending)]
            pending = ""
        else:
            frames = [p for p in pdfs if len(p)]
            rows = pd.concat(frames, ignore_index=True).sort_values("seq") if frames else pd.DataFrame(columns=["seq", "content", "finish_reason"])
            for seq, content, fin in zip(rows["seq"], rows["content"], rows["finish_reason"], strict=True):
                parts, pending = U.push_piece(pending, content or "")
                if fin is not None and not pd.isna(fin):
                    parts, pending = parts + U.flush_pending(pending), ""
                out += [(int(seq), *part) for part in parts]
        if pending:
            state.update((pending,))
            if idle_timeout_ms:
                state.setTimeoutDuration(idle_timeout_ms)
        elif state.exists:
            state.remove()
        if out:
            wired = U.wire_parts([(k, v) for _, k, v in out])
            yield pd.DataFrame({"request_id": [key[0]] * len(out), "seq": [o[0] for o in out],
                                "kind": [k for k, _ in wired], "value": [v for _, v in wired]})
    return fn


def stream_tool_calls(chunks: DataFrame, idle_timeout_ms: int | None = IDLE_MS) -> DataFrame:
    """(request_id, seq, content, finish_reason) stream -> text / tool_call parts.

    A request has state only while text is held back: chunks that come after the finish,
    such as the usage chunk, leave none.  A request that is abandoned with text held back
    is flushed after ``idle_timeout_ms``; ``None`` turns that off (a timeout keeps Spark
    scheduling batches, so ``availableNow`` runs do not end by themselves).
    """
    timeout = GroupStateTimeout.ProcessingTimeTimeout if idle_timeout_ms else GroupStateTimeout.NoTimeout
    return chunks.select("request_id", "seq", "content", "finish_reason").groupBy("request_id") \
        .applyInPandasWithState(_scanner(idle_timeout_ms), PART_SCHEMA, STATE_SCHEMA, "append", timeout)


def tail_routing_events(spark: SparkSession, folder: str) -> DataFrame:
    """S7 on a growing folder of SSE log files."""
    return sse_routing_events(spark.readStream.text(folder))
