"""Streams against their batch forms: replayed batches, late and repeated chunks, typed state."""
import os
import random
import tempfile

from pyspark.sql import functions as F

from corvid.operators import chat as CH
from corvid.operators import routing as R
from corvid.streaming import matrix_stream as M
from corvid.streaming import usage_stream as S

EVENTS = "session long, token_index long, step long, layer_experts array<int>"


def folder():
    return tempfile.mkdtemp(prefix="corvid-stream-", dir="/tmp")


def test_matrix_stream_equals_batch_and_survives_replay(spark):
    rng = random.Random(5)
    events = [(rng.randrange(4), rng.randrange(1, 9), step, [rng.choice([0, 1, 2, None]) for _ in range(rng.randrange(0, 5))]) for step in range(120)]
    d = folder()
    batches = [events[i:i + 30] for i in range(0, 120, 30)]
    for b in batches:
        spark.createDataFrame(b, EVENTS).coalesce(1).write.mode("append").parquet(f"{d}/in")
    stream = spark.readStream.schema(EVENTS).option("maxFilesPerTrigger", 1).parquet(f"{d}/in")
    M.write_routing_matrix(stream, f"{d}/matrix", f"{d}/ck", 4, buckets=3).awaitTermination(300)
    df = spark.createDataFrame(events, EVENTS)
    want = sorted(tuple(r) for r in R.routing_matrix(df, 4).collect())

    def got():
        return sorted(tuple(r) for r in M.read_routing_matrix(spark, f"{d}/matrix", 4).collect())
    assert got() == want
    # the last batch comes again, and one that fails before its manifest is there leaves no trace
    cells = M.event_cells(spark.createDataFrame(batches[-1], EVENTS), 4, "step")
    last = max(int(x) for x in os.listdir(f"{d}/matrix/manifest"))
    M.upsert_batch(cells, last, f"{d}/matrix", 3)
    assert got() == want
    late = spark.createDataFrame([(0, 1, -5, [7, 7, 7, 7])], EVENTS)             # an older event does not win
    M.upsert_batch(M.event_cells(late, 4, "step"), last + 1, f"{d}/matrix", 3)
    after = dict(((s, t, la), e) for s, t, la, e in got())
    assert all(after[s, t, la] == e for s, t, la, e in want if (s, t) != (0, 1))


def test_usage_stream_drops_repeats_and_closes_requests(spark):
    schema = "request_id long, seq long, ts timestamp, content string, model string, usage_total_tokens long"
    at = "2024-01-01 00:00:00"

    def row(request, seq, second, content, total=None):
        return (request, seq, second, content, "m", total)
    files = [[row(1, 0, 0, ""), row(1, 1, 3, "a"), row(2, 0, 10, None)], [row(1, 1, 3, "a"), row(1, 2, 9, "b"), row(2, 1, 40, "x", 7)],
             [row(1, 3, 7, "", 12), row(1, 2, 9, "b"), row(2, 1, 40, "x", 7)], [row(3, 0, 9000, "late")], [row(4, 0, 20000, "z")]]
    d = folder()
    for rows in files:
        df = spark.createDataFrame(rows, schema.replace("ts timestamp", "ts long"))
        df.withColumn("ts", F.timestamp_seconds(F.unix_timestamp(F.lit(at)) + F.col("ts"))).coalesce(1).write.mode("append").parquet(f"{d}/in")
    src = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{d}/in")
    q = (S.stream_usage(src).writeStream.format("memory").queryName("usage_closed").outputMode("append")
         .option("checkpointLocation", f"{d}/ck").trigger(availableNow=True).start())
    q.awaitTermination(300)
    got = {r.request_id: r for r in spark.table("usage_closed").collect()}
    whole = spark.read.schema(schema).parquet(f"{d}/in").dropDuplicates(["request_id", "seq"])
    want = {r.request_id: r for r in CH.ttft(whole).collect()}
    assert set(got) == {1, 2, 3}                       # request 4 is still open
    for k, r in got.items():
        assert (r.ttft_sec, r.total_sec) == (want[k].ttft_sec, want[k].total_sec)
    assert (got[1].n_chunks, got[1].usage_total_tokens, got[2].n_chunks) == (4, 12, 2)
    batch = {r.request_id: r for r in S.stream_usage(spark.read.schema(schema).parquet(f"{d}/in")).collect()}
    assert all((batch[k].ttft_sec, batch[k].n_chunks, batch[k].model) == (r.ttft_sec, r.n_chunks, r.model) for k, r in got.items())
    state = q.recentProgress[-1].stateOperators if hasattr(q.recentProgress[-1], "stateOperators") else q.recentProgress[-1]["stateOperators"]
    assert sum(s["numRowsTotal"] if isinstance(s, dict) else s.numRowsTotal for s in state) <= 4


def test_routing_state_does_not_grow_with_closed_steps(spark):
    from corvid.streaming.routing_stream import stream_routing_events
    schema = "session long, step long, token int, layer int, t_sec double, logits array<double>"
    d = folder()
    for first in (0, 20):
        rows = [(s, step, 0, layer, step * 0.5, [float((step * 7 + layer + e) % 5) for e in range(8)])
                for s in (1, 2) for step in range(first, first + 20) for layer in (0, 1)]
        rows += [(1, 100 + first, 0, 0, 60.0, [0.0] * 8)]                       # a step that stays open
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(f"{d}/in")
    src = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{d}/in")
    q = (stream_routing_events(src, num_layers=2, idle_timeout_ms=None).writeStream.format("memory").queryName("rt_state").outputMode("append")
         .option("checkpointLocation", f"{d}/ck").trigger(availableNow=True).start())
    q.awaitTermination(300)
    got = {(r.session, r.step): r for r in spark.table("rt_state").collect()}
    assert len(got) == 80 and got[2, 39].token_index == 40
    state = [s["numRowsTotal"] for p in q.recentProgress for s in p["stateOperators"]]
    # a value per session, and two entries per open step
    assert state[-1] == 2 + 2 * 2 and max(state) <= 6
