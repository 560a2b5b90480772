"""The whole chat template and the token counts that follow from it."""
import json

import pytest
from pyspark.sql import functions as F

from corvid.functions import udfs as U
from corvid.functions.chat import QWEN_DEFAULT_SYSTEM, TOOLS_HEAD, TOOLS_TAIL
from corvid.functions.tokens import encode, encode_py
from corvid.operators import chat as CH

HEAD = f"<|im_start|>system\n{QWEN_DEFAULT_SYSTEM}"
CALL = {"id": "c", "type": "function", "function": {"name": "f", "arguments": "{\"b\": 1, \"a\": [1.50, \"é\"]}"}}
BODIES = {
    "plain": {"messages": [{"role": "user", "content": "hi"}]},
    "system": {"messages": [{"role": "system", "content": "S"}, {"role": "user", "content": ""}, {"role": "system", "content": "again"}]},
    "tools": {"messages": [{"role": "system", "content": "S"}], "tools": [{"z": 1, "a": {"k": None}}, "name"]},
    "calls": {"messages": [{"role": "assistant", "content": None, "tool_calls": [CALL, {"name": "g", "arguments": {}}]}]},
    "bad_args": {"messages": [{"role": "assistant", "content": "t", "tool_calls": [{"function": {"name": "f", "arguments": "x{"}}]}]},
    "turns": {"messages": [{"role": "tool", "content": "1"}, {"role": "tool", "content": None}, {"role": "user", "content": "u"}, {"role": "tool", "content": [2]}]},
    "other_role": {"messages": [{"role": "developer", "content": "d"}, "text", {"role": "user", "content": "u"}]},
    "no_text": {"messages": [{"role": "user", "content": [{"type": "text"}]}]},
    "null_text": {"messages": [{"role": "user", "content": None}]},
    "no_arguments": {"messages": [{"role": "assistant", "tool_calls": [{"function": {"name": "f"}}]}]},
    "empty": {"messages": []},
    "none": {},
}
ASK = "<|im_start|>assistant\n"
WANT = {
    "plain": f"{HEAD}<|im_end|>\n<|im_start|>user\nhi<|im_end|>\n{ASK}",
    "system": f"<|im_start|>system\nS<|im_end|>\n<|im_start|>user\n<|im_end|>\n<|im_start|>system\nagain<|im_end|>\n{ASK}",
    "tools": f"<|im_start|>system\nS{TOOLS_HEAD}\n{{\"z\": 1, \"a\": {{\"k\": null}}}}\n\"name\"{TOOLS_TAIL}<|im_end|>\n{ASK}",
    "calls": f"{HEAD}<|im_end|>\n<|im_start|>assistant\n<tool_call>\n{{\"name\": \"f\", \"arguments\": {{\"b\": 1, \"a\": [1.5, \"é\"]}}}}\n</tool_call>"
             f"\n<tool_call>\n{{\"name\": \"g\", \"arguments\": {{}}}}\n</tool_call><|im_end|>\n{ASK}",
    "bad_args": f"{HEAD}<|im_end|>\n<|im_start|>assistant\nt\n<tool_call>\n{{\"name\": \"f\", \"arguments\": \"x{{\"}}\n</tool_call><|im_end|>\n{ASK}",
    "turns": f"{HEAD}<|im_end|>\n<|im_start|>user\n<tool_response>\n1\n</tool_response>\n<tool_response>\nNone\n</tool_response><|im_end|>\n"
             f"<|im_start|>user\nu<|im_end|>\n<|im_start|>user\n<tool_response>\n[2]\n</tool_response><|im_end|>\n{ASK}",
    "other_role": f"{HEAD}<|im_end|>\n<|im_start|>user\nu<|im_end|>\n{ASK}",
}


@pytest.fixture(scope="module")
def bodies(spark):
    rows = [(k, json.dumps(v, ensure_ascii=False)) for k, v in BODIES.items()] + [("not_json", "{"), ("null", None), ("list", "[1]"), ("trailing", '{"messages":[{"role":"user","content":"a"}]} x')]
    return spark.createDataFrame(rows, "name string, body string")


def test_prompts(bodies):
    got = {r.name: r.prompt for r in CH.request_prompt(bodies).collect()}
    assert {k: v for k, v in got.items() if v is not None} == WANT
    whole = CH.request_prompt(bodies.where("name = 'plain'"), add_generation_prompt=False).first().prompt
    assert whole == WANT["plain"].removesuffix(ASK)


def test_prompt_counts_feed_the_usage(spark, bodies):
    counted = CH.prompt_usage(bodies)
    got = {r.name: r.prompt_tokens_est for r in counted.collect()}
    assert got == {k: len(encode_py(WANT[k])) if k in WANT else None for k in got}
    log = counted.select(F.lit("m").alias("model"), "prompt_tokens_est", F.when(F.col("name") == "plain", 100).alias("prompt_tokens_exact"), F.lit(2).alias("completion_tokens"))
    row = CH.usage_totals(log).first()
    assert row.prompt_tokens == 100 + sum(n for k, n in got.items() if n and k != "plain")


def test_prompt_counts_with_a_tokenizer_file(spark, bodies):
    public = pytest.importorskip("public_tokenizers")
    tokenizers = pytest.importorskip("tokenizers")
    path = public.path("byte_bpe_50k.json")
    spark.sparkContext.addFile(path)
    tok = tokenizers.Tokenizer.from_file(path)
    got = {r.name: r.prompt_tokens_est for r in CH.prompt_usage(bodies, U.tokenizer_encoder(path)).collect()}
    assert got == {k: len(tok.encode(WANT[k], add_special_tokens=False).ids) if k in WANT else None for k in got}


def test_batch_ids_are_the_ids_of_the_encoder(spark):
    texts = [None, "", " ", WANT["calls"], WANT["plain"] * 3, "<<|im_start|><|im_end| >   a  <a<|endoftext|>é  ß_9\n\x00😀 <|im_end|", WANT["turns"]]
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string").coalesce(1)
    got = {r.i: (r.a, r.b) for r in rows.select("i", U.batch_hash_encoder().ids(F.col("t")).alias("a"), encode(F.col("t")).alias("b")).collect()}
    assert all(a == b for a, b in got.values()) and got[0] == (None, None) and got[1] == ([], [])
    sliced = rows.where("i > 2").select(U.batch_hash_encoder().ids(F.col("t")).alias("a")).collect()
    assert [r.a for r in sliced] == [encode_py(t) for t in texts[3:]]


def test_bodies_of_one_file_are_dealt_to_all_tasks(spark):
    from corvid.plans import chat_queries
    bodies = chat_queries._bodies(spark, "/root/testdata/sf0.001")
    assert bodies.rdd.getNumPartitions() >= spark.sparkContext.defaultParallelism
    assert min(len(p) for p in bodies.select("src").rdd.glom().collect()) > 0
