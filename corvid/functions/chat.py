"""Chat messages and the ChatML template as Column expressions."""
from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

MESSAGE = T.StructType([T.StructField("role", T.StringType()), T.StructField("content", T.StringType())])
MESSAGES = T.ArrayType(MESSAGE)

# ChatML control strings of the public Qwen2.5 chat template.
IM_START = "<|im_start|>"
IM_END = "<|im_end|>"
ENDOFTEXT = "<|endoftext|>"
ASSISTANT_MARKER = "<|im_start|>assistant\n"
# Fixed value: default system message the public Qwen2.5 template inserts when
# a conversation has no system turn.
QWEN_DEFAULT_SYSTEM = "You are Qwen, created by Alibaba Cloud. You are a helpful assistant."


def msg(role: str | Column, content: Column) -> Column:
    r = F.lit(role) if isinstance(role, str) else role
    return F.struct(r.alias("role"), content.alias("content"))


def messages(*pairs: tuple[str, Column]) -> Column:
    return F.array(*[msg(r, c) for r, c in pairs])


def render_chat(msgs: Column, add_generation_prompt: bool = False,
                default_system: str | None = QWEN_DEFAULT_SYSTEM) -> Column:
    """Render a message list with the ChatML template.

    ``default_system`` is inserted when the first message is not a system
    turn; pass ``None`` for templates that add nothing.
    """
    body = F.array_join(F.transform(msgs, lambda m: F.concat(
        F.lit(IM_START), m["role"], F.lit("\n"), F.coalesce(m["content"], F.lit("")), F.lit(IM_END + "\n"))), "")
    if default_system is not None:
        first_is_system = F.coalesce(F.try_element_at(msgs, F.lit(1))["role"] == "system", F.lit(False))
        body = F.when(first_is_system, body).otherwise(
            F.concat(F.lit(f"{IM_START}system\n{default_system}{IM_END}\n"), body))
    if add_generation_prompt:
        body = F.concat(body, F.lit(ASSISTANT_MARKER))
    return body


# The tool texts of the public Qwen2.5 chat template.
TOOLS_HEAD = ("\n\n# Tools\n\nYou may call one or more functions to assist with the user query.\n\n"
              "You are provided with function signatures within <tools></tools> XML tags:\n<tools>")
TOOLS_TAIL = ("\n</tools>\n\nFor each function call, return a json object with function name and arguments within "
              "<tool_call></tool_call> XML tags:\n<tool_call>\n"
              "{\"name\": <function-name>, \"arguments\": <args-json-object>}\n</tool_call>")

#: Messages with their calls, and the tools of a request; nested JSON values as the template writes them.
PROMPT = T.StructType([
    T.StructField("messages", T.ArrayType(T.StructType([
        T.StructField("role", T.StringType()), T.StructField("content", T.StringType()),
        T.StructField("calls", T.ArrayType(T.StructType([T.StructField("name", T.StringType()), T.StructField("arguments", T.StringType())])))]))),
    T.StructField("tools", T.ArrayType(T.StringType()))])


def render_prompt(parts: Column, add_generation_prompt: bool = True, default_system: str = QWEN_DEFAULT_SYSTEM) -> Column:
    """The whole template over a ``PROMPT`` value, which must be a computed column.

    A tool list joins the system turn.  An assistant turn with calls has its text, if any,
    and one block per call.  Consecutive tool turns are one user turn with a block each:
    the first opens it, the last closes it.  Turns of other roles leave nothing."""
    msgs, tools = parts["messages"], parts["tools"]
    first = F.get(msgs, F.lit(0))
    system = F.when(first["role"] == "system", first["content"]).otherwise(F.lit(default_system))
    listed = F.when(F.size(tools) > 0, F.concat(F.lit(TOOLS_HEAD), F.array_join(F.transform(tools, lambda t: F.concat(F.lit("\n"), t)), ""),
                                                F.lit(TOOLS_TAIL))).otherwise(F.lit(""))
    head = F.concat(F.lit(f"{IM_START}system\n"), system, listed, F.lit(f"{IM_END}\n"))

    def call(c: Column) -> Column:
        return F.concat(F.lit("\n<tool_call>\n{\"name\": \""), c["name"], F.lit("\", \"arguments\": "), c["arguments"], F.lit("}\n</tool_call>"))

    def turn(m: Column, i: Column) -> Column:
        def is_tool(j: Column) -> Column:
            return F.coalesce(F.get(msgs, j)["role"] == "tool", F.lit(False))
        plain = F.concat(F.lit(IM_START), m["role"], F.lit("\n"), m["content"], F.lit(f"{IM_END}\n"))
        text = F.when(F.coalesce(m["content"], F.lit("")) != "", F.concat(F.lit("\n"), m["content"])).otherwise(F.lit(""))
        calls = F.concat(F.lit(f"{IM_START}assistant"), text, F.array_join(F.transform(m["calls"], call), ""), F.lit(f"{IM_END}\n"))
        answer = F.concat(F.when(is_tool(i - 1), F.lit("")).otherwise(F.lit(f"{IM_START}user")), F.lit("\n<tool_response>\n"), m["content"],
                          F.lit("\n</tool_response>"), F.when(is_tool(i + 1), F.lit("")).otherwise(F.lit(f"{IM_END}\n")))
        return (F.when((m["role"] == "assistant") & (F.size(m["calls"]) > 0), calls)
                .when((m["role"] == "user") | (m["role"] == "assistant") | (m["role"] == "system") & (i > 0), plain)
                .when(m["role"] == "tool", answer).otherwise(F.lit("")))

    body = F.array_join(F.transform(msgs, turn), "")
    return F.concat(head, body, F.lit(ASSISTANT_MARKER if add_generation_prompt else ""))
