"""Chat formatting by prefix-target expansion, in DataFrame functions only.

A turn is written ``<|im_start|>ROLE\\nTEXT<|im_end|>\\n``.  Inside roles and texts a backslash becomes ``\\\\`` and ``<|``
becomes ``\\l|`` (a line break in a role ``\\n``), so no control string can occur there and reading back is exact.  Every
assistant turn becomes an example of its own: all preceding turns are context and only that reply's text is trainable.
Turns after the last reply (or all of them, if there is none) go to one closing row with an empty loss span, so the
rows of a conversation always hold all of it.

A conversation is read by turn (ties by role, then text; a null turn first) and is one row, as the format asks; it is the
unit of memory.  Examples hold their context, so their total size grows with the square of a conversation's turns; they
are made after the only shuffle.  Defined results: a null role or text is empty; repeated rows are repeated turns; rows with a
null conv_id are one conversation with a null id; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

OPEN, CLOSE = "<|im_start|>", "<|im_end|>\n"


def escape(text: Column) -> Column:
    return F.replace(F.replace(text, F.lit("\\"), F.lit("\\\\")), F.lit("<|"), F.lit("\\l|"))


def unescape(text: Column) -> Column:
    """Undo ``escape``: doubled backslashes are set aside, as a control character pair that escape can't leave alone."""
    parts = F.split(text, r"\\\\", -1)
    return F.array_join(F.transform(parts, lambda p: F.replace(p, F.lit("\\l|"), F.lit("<|"))), "\\")


def escape_role(role: Column) -> Column:
    return F.replace(escape(role), F.lit("\n"), F.lit("\\n"))


def unescape_role(role: Column) -> Column:
    parts = F.split(role, r"\\\\", -1)
    return F.array_join(
        F.transform(parts, lambda p: F.replace(F.replace(p, F.lit("\\n"), F.lit("\n")), F.lit("\\l|"), F.lit("<|"))), "\\"
    )


def expand(turns: DataFrame) -> DataFrame:
    """(conv_id, example, text, loss_start, loss_length, trainable, whole) from (conv_id, turn, role, text).

    ``loss_start`` counts from 0 in code points; ``whole`` marks the row that holds the whole conversation.
    """
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    rows = turns.select("conv_id", F.struct("turn", role.alias("role"), text.alias("text")).alias("t"))
    convs = rows.groupBy("conv_id").agg(F.array_sort(F.collect_list("t")).alias("ts"))
    convs = convs.select(
        "conv_id",
        F.transform("ts", lambda t: F.concat(F.lit(OPEN), escape_role(t["role"]), F.lit("\n"))).alias("heads"),
        F.transform("ts", lambda t: escape(t["text"])).alias("bodies"),
        F.transform("ts", lambda t: t["role"] == "assistant").alias("replies"),
    )
    n = F.size("heads")
    convs = convs.withColumn("reply_at", F.filter(F.sequence(F.lit(1), n), lambda i: F.element_at("replies", i)))
    closing = F.when(F.element_at("replies", -1), F.array()).otherwise(F.array(n)).cast("array<int>")
    examples = convs.select("*", F.posexplode(F.concat("reply_at", closing)).alias("example", "last"))
    turns_of = F.arrays_zip(F.slice("heads", 1, F.col("last")).alias("h"), F.slice("bodies", 1, F.col("last")).alias("b"))
    joined = F.transform(turns_of, lambda t: F.concat(t["h"], t["b"], F.lit(CLOSE)))
    trainable = F.element_at("replies", F.col("last"))
    body = F.char_length(F.element_at("bodies", F.col("last")))
    out = examples.select(
        "conv_id", "example", F.array_join(joined, "").alias("text"), trainable.alias("trainable"),
        body.alias("body"), (F.col("last") == n).alias("whole"),
    )
    return out.select(
        "conv_id", "example", "text",
        (F.char_length("text") - len(CLOSE) - F.col("body")).alias("loss_start"),
        F.when(F.col("trainable"), F.col("body")).otherwise(0).alias("loss_length"), "trainable", "whole",
    )


def loss_text(examples: DataFrame) -> Column:
    """The text under the loss mask, read from the formatted text."""
    return unescape(F.substring(F.col("text"), F.col("loss_start") + 1, F.col("loss_length")))


def read_turns(text: Column) -> Column:
    """array<struct<role, text>> read from a formatted text."""
    parts = F.filter(F.split(text, r"<\|im_start\|>", -1), lambda p: p != "")
    end = len(CLOSE)

    def turn(p: Column) -> Column:
        cut = F.instr(p, "\n")
        body = F.substring(p, cut + 1, F.char_length(p) - cut - end)
        return F.struct(unescape_role(F.substring(p, F.lit(1), cut - 1)).alias("role"), unescape(body).alias("text"))

    return F.transform(parts, turn)


def digest(examples: DataFrame) -> DataFrame:
    """A row for each conversation, read back from its examples."""
    by_conv = examples.select(
        "conv_id", "example", F.char_length("text").cast("long").alias("chars"),
        F.when(F.col("trainable"), loss_text(examples)).alias("reply"), F.when(F.col("whole"), F.col("text")).alias("full"),
    )
    whole = by_conv.groupBy("conv_id").agg(
        F.array_join(
            F.transform(F.array_sort(F.collect_list(F.when(F.col("reply").isNotNull(), F.struct("example", "reply")))), lambda x: x["reply"]), ""
        ).alias("loss"),
        F.max("full").alias("full"),
        F.sum("chars").alias("formatted_chars"),
    )
    whole = whole.withColumn("turns", read_turns(F.col("full")))
    flat = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return whole.select(
        "conv_id", F.size("turns").cast("long").alias("n_turns"), F.sha2(flat, 256).alias("turns_sha256"),
        F.char_length("loss").cast("long").alias("loss_chars"), F.sha2("loss", 256).alias("loss_sha256"), "formatted_chars",
    )
