"""Partitioning independence and streaming log tails."""
import os
import tempfile

from conftest import SF_SMALL

from __spark_entry__ import queries

Q = queries()


def _rows(df):
    return sorted(tuple(r) for r in df.collect())


def test_same_result_with_1_and_64_shuffle_partitions(spark):
    keys = ["routing_events", "seeded_shuffle", "pad_batches", "chunk_reassemble", "weighted_interleave"]
    old = spark.conf.get("spark.sql.shuffle.partitions")
    try:
        got = {}
        for n in ("1", "64"):
            spark.conf.set("spark.sql.shuffle.partitions", n)
            got[n] = {k: _rows(Q[k](spark, SF_SMALL)) for k in keys}
        for k in keys:
            assert got["1"][k] == got["64"][k], k
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", old)


def test_sse_tail_stream(spark):
    from corvid.plans.eval_queries import sse_lines
    from corvid.plans.routing_queries import _events
    from corvid.streaming.chunk_stream import tail_routing_events
    ev = _events(spark, SF_SMALL)
    d = tempfile.mkdtemp(prefix="corvid-sse-", dir="/tmp")
    sse_lines(ev).select("value").coalesce(2).write.text(os.path.join(d, "logs"))
    q = (tail_routing_events(spark, os.path.join(d, "logs")).writeStream.format("memory").queryName("sse_tail")
         .option("checkpointLocation", os.path.join(d, "ck")).trigger(availableNow=True).start())
    q.awaitTermination(300)
    got = sorted((r.token_index, tuple(r.layer_experts)) for r in spark.table("sse_tail").collect())
    want = sorted((r.token_index, tuple(r.layer_experts)) for r in ev.collect())
    assert got == want
