"""Early stop equals whole-table processing; writers; user tokenizer; stream scanner."""
import json
import os
import tempfile

from pyspark.sql import functions as F

from conftest import SF_SMALL
from corvid.operators import corpus as C
from corvid.plans.corpus_build import CorpusSource, build_corpus, write_corpus
from corvid.sources.fixtures import register_views

MIX = (("opencode_instruct", 0.5, "v_scored"), ("codealpaca", 0.3, "v_alpaca"), ("code_feedback", 0.2, "v_query_answer"))


def _sources(spark, sf="/root/testdata/sf0.01"):
    register_views(spark, sf, *[v for _, _, v in MIX])
    return [CorpusSource(n, w, spark.table(v)) for n, w, v in MIX]


def _rows(df, cols):
    return sorted(tuple(r) for r in df.select(*cols).collect())


def test_early_stop_many_rounds_equals_whole_tables(spark):
    src = _sources(spark)
    full = build_corpus(spark, src, 60, context_length=512, early_stop=False)
    early = build_corpus(spark, src, 60, context_length=512, early_stop=True, first_rows=20)
    dcols = ["source", "raw_streamed", "samples_collected", "format_rejected", "context_overflow",
             "all_labels_masked", "exhausted"]
    assert _rows(early.diagnostics, dcols) == _rows(full.diagnostics, dcols)
    assert early.samples.count() < full.samples.count()          # only a prefix was tokenized
    cols = ["source", "raw_idx", "sample_idx", "mix_idx", "order_key"]
    assert _rows(early.train, cols) == _rows(full.train, cols)
    assert _rows(early.eval, cols) == _rows(full.eval, cols)
    # invariants: disjoint splits, sizes add up to what was collected
    tr, ev = set(_rows(early.train, cols[:3])), set(_rows(early.eval, cols[:3]))
    assert not (tr & ev)


def test_write_corpus_and_reload(spark):
    res = build_corpus(spark, _sources(spark, SF_SMALL), 40, context_length=512)
    out = tempfile.mkdtemp(prefix="corvid-out-", dir="/tmp")
    write_corpus(res, out)
    back = spark.read.parquet(out)
    assert set(r.split for r in back.select("split").distinct().collect()) <= {"train", "eval"}
    assert back.count() == res.train.count() + res.eval.count()
    sel = C.reload_select(back, ("input_ids", "attention_mask", "labels", "nope"))
    assert sel.columns == ["input_ids", "attention_mask", "labels"]


def test_completions_jsonl(spark):
    from corvid.operators.evalset import eval_run, write_completions
    from corvid.plans.eval_queries import echo_model
    from corvid.sources.fixtures import view
    runs = eval_run(view(spark, SF_SMALL, "v_problems"), echo_model, "ckpt/run-1", "mbpp")
    out = tempfile.mkdtemp(prefix="corvid-jsonl-", dir="/tmp")
    write_completions(runs, out)
    files = [os.path.join(dp, f) for dp, _, fs in os.walk(out) for f in fs if f.endswith(".json")]
    recs = [json.loads(line) for f in files for line in open(f)]
    assert recs and set(recs[0]) == {"task_id", "completion"}
    assert os.path.isdir(os.path.join(out, "run=mbpp_ckpt_run-1"))
    assert not any(r["completion"].startswith("```") for r in recs)


def test_scan_source_takes_subset_and_split(spark):
    from corvid.sources.registry import register_source, resolve, scan_source
    d = tempfile.mkdtemp(prefix="corvid-src-", dir="/tmp")
    df = spark.createDataFrame([("q", "a")], "query string, answer string")
    df.write.parquet(os.path.join(d, "main", "train"))
    df.limit(0).write.parquet(os.path.join(d, "train"))
    assert scan_source(spark, d, schema=df.schema, subset="main", split="train").count() == 1
    assert scan_source(spark, d, schema=df.schema, subset="", split="train").count() == 0
    register_source("own", lambda frame: F.array(), ("query", "answer"))
    assert resolve("own").columns == ("query", "answer")


def test_user_tokenizer_hook(spark):
    from tokenizers import Tokenizer, models, pre_tokenizers, trainers
    from corvid.functions.udfs import tokenizer_udf
    tok = Tokenizer(models.WordLevel(unk_token="[UNK]"))
    tok.pre_tokenizer = pre_tokenizers.Whitespace()
    tok.add_special_tokens(["<|im_start|>", "<|im_end|>"])
    tok.train_from_iterator(["user assistant hello world a b c"], trainers.WordLevelTrainer(special_tokens=["[UNK]"]))
    d = tempfile.mkdtemp(prefix="corvid-tok-", dir="/tmp")
    path = os.path.join(d, "tok.json")
    tok.save(path)
    spark.sparkContext.addFile(path)
    enc = tokenizer_udf(path)
    df = spark.createDataFrame([("hello world",), (None,)], "t string")
    got = [r[0] for r in df.select(enc(F.col("t"))).collect()]
    assert got[0] == tok.encode("hello world", add_special_tokens=False).ids and got[1] is None


def test_build_with_a_tokenizer_file_keeps_valid_samples(spark):
    """Marker and vocabulary length come from the same file as the ids."""
    from tokenizers import Tokenizer, models, pre_tokenizers
    from corvid.functions.udfs import tokenizer_encoder
    words = ["[UNK]", "<|im_start|>", "<|im_end|>", "user", "assistant", "system", "q", "a"]
    tok = Tokenizer(models.WordLevel({w: i for i, w in enumerate(words)}, unk_token="[UNK]"))
    tok.pre_tokenizer = pre_tokenizers.Whitespace()
    tok.add_special_tokens(["<|im_start|>", "<|im_end|>"])
    path = os.path.join(tempfile.mkdtemp(prefix="corvid-tok-", dir="/tmp"), "words.json")
    tok.save(path)
    spark.sparkContext.addFile(path)
    enc = tokenizer_encoder(path)
    assert enc.full_length == len(words) and enc.marker_ids == (1, 4)
    raw = spark.createDataFrame([(i, f"q {i}", "a a") for i in range(20)], "raw_id long, query string, answer string")
    res = build_corpus(spark, [CorpusSource("code_feedback", 1.0, raw)], 20, encoder=enc)
    rows = res.collected.collect()
    assert len(rows) == 20 and all(any(x != -100 for x in r.labels) for r in rows)


def test_usage_chunk_after_the_finish_leaves_no_state(spark):
    from corvid.streaming.chunk_stream import stream_tool_calls
    d = tempfile.mkdtemp(prefix="corvid-chunks-", dir="/tmp")
    schema = "request_id long, seq long, content string, finish_reason string"
    for rows in ([(1, 1, "hi", None), (1, 2, "", "stop")], [(1, 3, None, None)]):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(os.path.join(d, "in"))
    src = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(os.path.join(d, "in"))
    q = (stream_tool_calls(src, idle_timeout_ms=None).writeStream.format("memory").queryName("tc_late").outputMode("append")
         .option("checkpointLocation", os.path.join(d, "ck")).trigger(availableNow=True).start())
    q.awaitTermination(300)
    assert [(r.kind, r.value) for r in spark.table("tc_late").collect()] == [("text", "hi")]
    assert sum(s["numRowsTotal"] for p in q.recentProgress[-1:] for s in p["stateOperators"]) == 0


def test_stream_tool_calls_flush_on_finish(spark):
    from corvid.streaming.chunk_stream import stream_tool_calls
    d = tempfile.mkdtemp(prefix="corvid-chunks-", dir="/tmp")
    rows = [(1, 1, '{"name":"f",', None), (1, 2, '"arguments":{}}', None), (1, 3, "", "tool_calls"),
            (2, 1, "hello ", None), (2, 2, "world", "stop")]
    spark.createDataFrame(rows, "request_id long, seq long, content string, finish_reason string") \
        .write.parquet(os.path.join(d, "in"))
    src = spark.readStream.schema("request_id long, seq long, content string, finish_reason string") \
        .parquet(os.path.join(d, "in"))
    q = (stream_tool_calls(src, idle_timeout_ms=None).writeStream.format("memory").queryName("tc_parts").outputMode("append")
         .option("checkpointLocation", os.path.join(d, "ck")).trigger(availableNow=True).start())
    q.awaitTermination(300)
    got = sorted((r.request_id, r.kind, r.value) for r in spark.table("tc_parts").collect())
    assert got == [(1, "tool_call", json.dumps({"name": "f", "arguments": {}})), (2, "text", "hello "),
                   (2, "text", "world")]
