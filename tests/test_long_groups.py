"""Sessions and requests that hold most of the rows."""
import random

import pytest
from pyspark.sql import functions as F

from corvid.operators import routing as R


def plain(rows, experts=2):
    """(session, step) -> (rate, averages, index) by walking each session."""
    out, by = {}, {}
    for session, step, t, pct in sorted(rows, key=lambda r: (r[0], r[1])):
        by.setdefault(session, []).append((step, t, pct))
    for session, steps in by.items():
        for i, (step, _, _) in enumerate(steps):
            clocks = [t for _, t, _ in steps[max(0, i - 10):i + 1]]
            gaps = [b - a for a, b in zip(clocks, clocks[1:]) if a is not None and b is not None]
            mean = sum(gaps) / len(gaps) if gaps else None
            rate = 1.0 if mean is None else 1 / mean if mean > 0 else 0.0
            avg = [sum(p[e] for _, _, p in steps[:i + 1]) / (i + 1) for e in range(experts)]
            out[session, step] = (rate, avg, i + 1)
    return out


@pytest.mark.parametrize("block", [1, 3, 7, 64, 4096])
def test_session_windows_equal_a_walk(spark, block):
    rng = random.Random(block)
    rows = []
    for session in range(5):
        t = 0.0
        for step in sorted(rng.sample(range(-50, 400), rng.choice([1, 2, 11, 12, 150]))):
            t += rng.choice([0.0, 0.25, 0.5, 2.0])
            rows.append((session, step, None if rng.random() < 0.1 else t, [rng.random() * 100, rng.random()]))
    df = spark.createDataFrame(rows, "session long, step long, t_sec double, expert_pct array<double>")
    want = plain(rows)
    got = R.session_windows(df, 2, block).collect()
    assert len(got) == len(rows)
    for r in got:
        rate, avg, index = want[r.session, r.step]
        assert r.token_index == index and r.tokens_per_sec_raw == pytest.approx(rate) and r.session_avg == pytest.approx(avg)


def test_a_session_of_ten_million_steps_spreads_over_tasks(spark):
    n = 10_000_000
    steps = spark.range(0, n, 1, 32).select(F.lit(1).alias("session"), F.col("id").alias("step"), (F.col("id") * 0.5).alias("t_sec"),
                                            F.array((F.col("id") % 2).cast("double")).alias("expert_pct"))
    got = R.session_windows(steps, 1)
    spread = got.groupBy(F.spark_partition_id().alias("p")).agg(F.count(F.lit(1)).alias("n"), F.max("token_index").alias("top"),
                                                                F.sum((F.col("tokens_per_sec_raw") == 2.0).cast("int")).alias("even")).collect()
    assert sum(r.n for r in spread) == n == max(r.top for r in spread) and sum(r.even for r in spread) == n - 1
    assert len(spread) >= 4 and max(r.n for r in spread) <= n / 2


def test_tool_call_stream_over_blocks_equals_the_serial_scan(spark):
    from corvid.functions import udfs as U
    from corvid.operators import chat as CH
    rng = random.Random(3)
    pool = ["word ", "", '{"name":"f",', '"arguments":{"k":1}}', "```json", '```json {"name":"g","arguments":{}} ``` tail', "{", "}", " ", "```", '{"name":"h","arguments":"{}"}', "\n"]
    rows, want = [], set()
    for request in [*range(40), None]:
        pieces = [rng.choice(pool if request is None or request % 2 else pool[:4] + pool[5:6]) for _ in range(rng.randrange(0, 60))]
        rows += [(request, i * 3 - 20, p or None) for i, p in enumerate(pieces)]
        want |= {(request, i, k, v) for i, (k, v) in enumerate(U.scan_chunks(pieces))}
    df = spark.createDataFrame(rows, "request_id long, seq long, content string")
    for block in (1, 7, 50, 1024):
        assert {tuple(r) for r in CH.tool_call_stream(df.repartition(5), block_chunks=block).collect()} == want


def test_a_request_of_a_million_chunks(spark):
    from corvid.functions import udfs as U
    from corvid.operators import chat as CH
    n = 1_000_000
    calls = {500: '{"name":"f",', 2_050: '"arguments":{}}', 999_999: "{"}
    piece = F.element_at(F.create_map(*[F.lit(x) for kv in calls.items() for x in kv]), F.col("id").cast("int"))
    df = spark.range(0, n, 1, 16).select(F.lit(9).alias("request_id"), F.col("id").alias("seq"),
                                         F.when(F.col("id").isin(*calls), piece).when((F.col("id") > 500) & (F.col("id") < 2_050), F.lit(" "))
                                         .otherwise(F.concat(F.lit("t"), F.col("id").cast("string"))).alias("content"),
                                         F.when(F.col("id") == n - 2, "stop").alias("finish_reason"))
    want = U.scan_chunks([r.content for r in df.orderBy("seq").select("content").toLocalIterator()])
    got = CH.tool_call_stream(df).orderBy("part_idx").collect()
    assert [(r.kind, r.value) for r in got] == want and sum(r.kind == "tool_call" for r in got) == 1
    whole = CH.chunk_reassemble(df).first()
    assert whole.finish_reason == "stop" and whole.n_chunks == n
    assert whole.content == "".join(r.content for r in df.orderBy("seq").select("content").toLocalIterator())


@pytest.mark.parametrize("block", [1, 4, 1024])
def test_reassembly_over_blocks(spark, block):
    from corvid.operators import chat as CH
    rows = [(1, 0, "a", None, None, 0, None, None, None), (1, 1, None, None, 1, 0, "c1", "f", "x"), (1, 1, None, None, 0, 1, "c0", "", "p"),
            (1, 5, "b", "length", 1, 0, "", None, "y"), (1, 9, "c", None, 1, 0, None, "g", "z"), (1, 12, "", "stop", None, 0, None, None, None), (2, 3, None, None, None, 0, None, None, None)]
    df = spark.createDataFrame(rows, "request_id long, seq long, content string, finish_reason string, tool_index int, tool_nth int, tool_id string, tool_name string, tool_args string")
    df = df.withColumn("ts", F.timestamp_seconds(F.col("seq")))
    got = {r.request_id: r for r in CH.chunk_reassemble(df, ts="ts", block_chunks=block).collect()}
    assert (got[1].content, got[1].finish_reason, got[1].n_chunks, got[1].ttft_sec, got[1].total_sec) == ("abc", "stop", 6, 0.0, 12.0)
    assert [tuple(c) for c in got[1].tool_calls] == [(0, "c0", None, "p"), (1, "c1", "g", "xyz")]
    assert (got[2].content, got[2].finish_reason, got[2].tool_calls, got[2].ttft_sec) == ("", None, None, None)
