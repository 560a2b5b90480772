"""Server-sent-event logs (S7): routing events out of ``data:`` lines."""
from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import py_strip
from ..plans.barrier import compute_once
from .chat import strict_json_text

ROUTING_EVENT = ("type string, expert_pct array<double>, session_avg array<double>, entropy_pct double, "
                 "tokens_per_sec double, token_index bigint, layer_experts array<int>")


def sse_routing_events(lines: DataFrame, value: str = "value") -> DataFrame:
    """Keep ``data:`` lines, parse the JSON payload, keep routing events with a layer map.

    Comment lines (``:keepalive``), ``[DONE]``, undecodable payloads and other
    event types drop out through the same predicates.  Works on
    ``spark.read.text`` and ``spark.readStream.text`` alike.
    """
    v = F.col(value)
    data = py_strip(F.substring(v, 6, 1 << 30))
    df = lines.filter(v.startswith("data:")).withColumn("_data", data).filter(F.col("_data") != "")
    ev = compute_once(df, _text=strict_json_text(F.col("_data"))).withColumn("_e", F.from_json("_text", ROUTING_EVENT))
    keep = (F.col("_e.type") == "routing") & F.col("_e.layer_experts").isNotNull() & F.col("_e.token_index").isNotNull()
    cols = [c for c in lines.columns if c != value]
    return ev.filter(keep).select(*cols, "_e.*")
