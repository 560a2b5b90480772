"""Benchmark prompts and completions."""
from __future__ import annotations

from typing import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.chat import messages, render_chat
from ..functions.text import run_tag, strip_markdown
from ..functions.udfs import batch_generate

# System prompts of the evaluation script.
COMPLETION_SYSTEM = ("You are an expert Python programmer. Complete the function below. "
                     "Return ONLY the function body — no explanation, no markdown, no extra text.")
TASK_SYSTEM = ("You are an expert Python programmer. Write a Python function that solves the given task. "
               "Return ONLY the function — no explanation, no markdown, no extra text.")


def completion_user(prompt: Column) -> Column:
    """E1 user turn (fixed value: its first line)."""
    return F.concat(F.lit("Complete this Python function:\n\n"), prompt)


def task_user(prompt: Column, tests: Column) -> Column:
    """E2 user turn: the first two tests, a missing list counts as empty (fixed values: its two labels)."""
    shown = F.array_join(F.slice(F.coalesce(tests, F.array().cast("array<string>")), 1, 2), "\n")
    return F.concat(F.lit("Task: "), prompt, F.lit("\n\nExample tests:\n"), shown)


def eval_prompts(problems: DataFrame, kind: str = "completion", default_system=None) -> DataFrame:
    """E1 / E2 + P2: the rendered prompt (generation prompt on) per task."""
    if kind == "completion":
        msgs = messages(("system", F.lit(COMPLETION_SYSTEM)), ("user", completion_user(F.col("prompt"))))
    else:
        msgs = messages(("system", F.lit(TASK_SYSTEM)), ("user", task_user(F.col("prompt"), F.col("test_list"))))
    kw = {} if default_system is None else {"default_system": default_system}
    return problems.select("task_id", render_chat(msgs, add_generation_prompt=True, **kw).alias("prompt"))


def eval_run(problems: DataFrame, model_fn: Callable[[list[str]], list[str]], tag_folder: str,
             bench: str, kind: str = "completion") -> DataFrame:
    """E1/E2 -> E4 -> E3 -> E5: cleaned completions with the run tag."""
    prompts = eval_prompts(problems, kind)
    gen = batch_generate(prompts, model_fn)
    return gen.select("task_id", strip_markdown(F.col("completion")).alias("completion"),
                      F.concat(F.lit(bench + "_"), run_tag(F.lit(tag_folder))).alias("run"))


def write_completions(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    """JSON lines ``{task_id, completion}`` (one folder per run tag)."""
    df.select("task_id", "completion", "run").write.mode(mode).partitionBy("run").json(path)
