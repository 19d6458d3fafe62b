"""Chat, token and prompt expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

NO_THINK = " /no_think"
IGNORED = -100


def messages(system: str | Column, question: Column, answer: Column) -> Column:
    """Three messages: system, user (ending in the no-think mark), assistant."""
    system = F.lit(system) if isinstance(system, str) else system
    rows = (("system", system), ("user", F.concat(question, F.lit(NO_THINK))), ("assistant", answer))
    return F.array(*(F.struct(F.lit(r).alias("role"), c.alias("content")) for r, c in rows))


def strip_no_think(text: Column) -> Column:
    return F.regexp_replace(text, r"\s*/no_think\s*$", "")


def prompt_render(template: str, **values: Column) -> Column:
    """``{name}`` filled in, ``{{`` and ``}}`` reduced; values are never read as templates."""
    parts, rest = [], template
    while rest:
        cut = min((i for i in (rest.find("{"), rest.find("}")) if i >= 0), default=len(rest))
        if cut:
            parts.append(F.lit(rest[:cut]))
        rest = rest[cut:]
        if rest[:2] in ("{{", "}}"):
            parts.append(F.lit(rest[0]))
            rest = rest[2:]
        elif rest:
            name, _, rest = rest[1:].partition("}")
            parts.append(values[name].cast("string"))
    return F.concat(*parts)


def qa_count_range(length: Column, per_question: int = 1000, spread: int = 3, least: int = 1, most: int = 20) -> tuple[Column, Column]:
    n = F.floor(length / per_question)
    clamp = lambda c: F.greatest(F.lit(least), F.least(F.lit(most), c))
    return clamp(n - spread), clamp(n + spread)


def label_mask(ids: Column, prompt_length: Column) -> Column:
    k = F.least(prompt_length, F.size(ids))
    return F.concat(F.array_repeat(F.lit(IGNORED), k), F.slice(ids, k + 1, F.size(ids)))


def padded_length(longest: Column, multiple: int = 8) -> Column:
    return (F.ceil(longest / multiple) * multiple).cast("int")


def pad(ids: Column, to: Column, value: int) -> Column:
    return F.concat(ids, F.array_repeat(F.lit(value), to - F.size(ids)))


def template_render(
    ms: Column, tools: Column | None = None, generation_prompt: bool = False, thinking: bool = True, fields: tuple[str, ...] = ()
) -> Column:
    """ChatML of array<struct<role, content[, reasoning_content, tool_calls]>>; ``fields`` names the optional ones there are.

    Tool calls are array<struct<name, arguments>> with the arguments as JSON text.  Given reasoning is used as it is.

    Give ``ms`` as a plain column: it is read at several places.  Else reasoning is what stands before ``</think>``; it is kept
    only after the last user turn that is not a tool response; tool turns in a row share one user block.
    """
    # The control strings and marks of the template, here and below.
    n = F.size(ms)
    think_end = F.lit("</think>")
    tool_reply = lambda m: m["content"].startswith("<tool_response>") & m["content"].endswith("</tool_response>")
    queries = F.filter(F.sequence(F.lit(1), n), lambda i: (F.element_at(ms, i)["role"] == "user") & ~F.coalesce(tool_reply(F.element_at(ms, i)), F.lit(False)))
    last_query = F.coalesce(F.array_max(queries), n)

    def turn(m: Column, i: Column) -> Column:
        at = i + 1
        content = F.coalesce(m["content"], F.lit(""))
        has = F.contains(content, think_end)
        before = F.split_part(content, think_end, F.lit(1))
        thought = F.regexp_replace(F.regexp_replace(before, r"\n+$", ""), r"^(?s:.*)<think>", "")
        thought = F.when(has, F.regexp_replace(thought, r"^\n+", "")).otherwise("")
        reply = F.when(has, F.regexp_replace(F.split_part(content, think_end, F.lit(-1)), r"^\n+", "")).otherwise(content)
        if "reasoning_content" in fields:
            given = m["reasoning_content"]
            thought, reply = F.coalesce(given, thought), F.when(given.isNotNull(), content).otherwise(reply)
        kept = (at > last_query) & ((at == n) | (thought != ""))
        block = F.concat(F.lit("<think>\n"), F.regexp_replace(thought, r"^\n+|\n+$", ""), F.lit("\n</think>\n\n"))
        shown = F.when(kept, F.concat(block, F.regexp_replace(reply, r"^\n+", ""))).otherwise(reply)
        if "tool_calls" in fields:
            # The wording of the template.
            call = lambda c: F.concat(F.lit('<tool_call>\n{"name": "'), c["name"], F.lit('", "arguments": '), c["arguments"], F.lit("}\n</tool_call>"))
            calls = F.array_join(F.transform(F.coalesce(m["tool_calls"], F.array()), call), "\n")
            shown = F.concat(shown, F.when((reply != "") & (calls != ""), "\n").otherwise(""), calls)
        assistant = F.concat(F.lit("<|im_start|>assistant\n"), shown, F.lit("<|im_end|>\n"))
        neighbour = lambda k: F.coalesce(F.get(ms, i + k)["role"] == "tool", F.lit(False))
        opens = F.when((at == 1) | ~neighbour(-1), F.lit("<|im_start|>user")).otherwise("")
        closes = F.when((at == n) | ~neighbour(1), F.lit("<|im_end|>\n")).otherwise("")
        tool = F.concat(opens, F.lit("\n<tool_response>\n"), content, F.lit("\n</tool_response>"), closes)
        plain = F.concat(F.lit("<|im_start|>"), m["role"], F.lit("\n"), content, F.lit("<|im_end|>\n"))
        return (
            F.when((m["role"] == "user") | ((m["role"] == "system") & (at > 1)), plain)
            .when(m["role"] == "assistant", assistant).when(m["role"] == "tool", tool).otherwise("")
        )

    first = F.element_at(ms, 1)
    system = F.when(first["role"] == "system", F.concat(F.lit("<|im_start|>system\n"), first["content"], F.lit("<|im_end|>\n"))).otherwise("")
    if tools is not None:
        lead = F.when(first["role"] == "system", F.concat(first["content"], F.lit("\n\n"))).otherwise("")
        header = F.concat(
            F.lit("<|im_start|>system\n"), lead,
            # The wording of the template.
            F.lit("# Tools\n\nYou may call one or more functions to assist with the user query.\n\nYou are provided with function signatures within <tools></tools> XML tags:\n<tools>"),
            F.array_join(F.transform(tools, lambda t: F.concat(F.lit("\n"), t)), ""),
            F.lit('\n</tools>\n\nFor each function call, return a json object with function name and arguments within <tool_call></tool_call> XML tags:\n<tool_call>\n{"name": <function-name>, "arguments": <args-json-object>}\n</tool_call><|im_end|>\n'),
        )
        system = F.when(F.size(tools) > 0, header).otherwise(system)
    suffix = "<|im_start|>assistant\n" + ("" if thinking else "<think>\n\n</think>\n\n") if generation_prompt else ""
    return F.concat(system, F.array_join(F.transform(ms, turn), ""), F.lit(suffix))
