"""Chat formatting with Spark expressions only.

The rows of a conversation are collected as structs and sorted by turn (ties by role, then text);
adjacent turns of one role are merged into one block by aggregating the array between the places where the
role changes, in time linear in the turns; blocks are concatenated into one string. A block is

    <|start|>ROLE<|text|>TEXT(<|next|>TEXT)*<|end|>\n

so merged texts stay apart and the string can be read back exactly. Control strings inside roles and
texts get a backslash after their first character, and backslashes are doubled; no control string is
left in a text and unescaping restores it.

Beside the string the operator returns a run-length mask: one (chars, loss) pair for each segment in
order, loss being true for each assistant text and for nothing else.

Cases: null text or role: empty; null turn: sorts first; null conv_id: a conversation of its own;
repeated rows: kept, each a turn; an empty table: an empty result; other columns are ignored, so
clashing names do no harm. A conversation becomes one row, so it must fit into one.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skeinwork.llm._shared import let

START, TEXT, NEXT, END = "<|start|>", "<|text|>", "<|next|>", "<|end|>"

#: Strings that steer a model in this template or in wide-spread ones.
CONTROLS = (START, TEXT, NEXT, END, "<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>", "<|im_start|>", "<|im_end|>", "<|endoftext|>", "<|startoftext|>")


def escape(text: Column) -> Column:
    doubled = F.replace(text, F.lit("\\"), F.lit("\\\\"))
    return reduce(lambda t, c: F.replace(t, F.lit(c), F.lit(c[0] + "\\" + c[1:])), CONTROLS, doubled)


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"(?s)\\(.)", "$1")


def _merged(turns: Column) -> Column:
    """array<struct<role, texts>> of the sorted turns: the places where a role starts cut them into blocks, each gathered once."""
    n = F.size(turns)
    starts = F.filter(F.sequence(F.lit(1), n), lambda i: (i == 1) | (F.get(turns, i - 1)["role"] != F.get(turns, i - 2)["role"]))

    def block(all_: Column) -> Column:
        def one(s: Column, k: Column) -> Column:
            end = F.coalesce(F.get(all_, k + 1), n + 1)
            return F.struct(F.get(turns, s - 1)["role"].alias("role"), F.transform(F.slice(turns, s, end - s), lambda t: t["text"]).alias("texts"))

        return F.transform(all_, one)

    return let(starts, block)


def _segments(blocks: Column) -> Column:
    """array<struct<text, loss>>: headers, texts, separators and ends in order."""

    def seg(text: Column, loss: Column) -> Column:
        return F.struct(text.alias("text"), loss.alias("loss"))

    def block(b: Column) -> Column:
        texts = F.flatten(
            F.transform(
                b["texts"],
                lambda t, i: F.array(seg(F.when(i > 0, F.lit(NEXT)).otherwise(F.lit("")), F.lit(False)), seg(escape(t), b["role"] == "assistant")),
            )
        )
        head = F.array(seg(F.concat(F.lit(START), escape(b["role"]), F.lit(TEXT)), F.lit(False)))
        return F.concat(head, texts, F.array(seg(F.lit(END + "\n"), F.lit(False))))

    return F.flatten(F.transform(blocks, block))


def format_chats(df: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """One row per conversation: conv_id, formatted string, mask array<struct<chars long, loss boolean>>."""
    row = F.struct(F.col(turn).alias("turn"), F.coalesce(F.col(role), F.lit("")).alias("role"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    turns = df.groupBy(F.col(conv).alias("conv_id")).agg(F.array_sort(F.collect_list(row)).alias("turns"))
    segments = turns.select("conv_id", let(_merged(F.col("turns")), _segments).alias("segments"))
    return segments.select(
        "conv_id",
        F.array_join(F.transform("segments", lambda s: s["text"]), "").alias("formatted"),
        F.filter(
            F.transform("segments", lambda s: F.struct(F.length(s["text"]).cast("long").alias("chars"), s["loss"].alias("loss"))),
            lambda m: (m["chars"] > 0) | m["loss"],
        ).alias("mask"),
    )


def read_turns(formatted: Column) -> Column:
    """array<struct<role, text>> read back from a formatted string, a turn for each text."""
    blocks = F.filter(F.split(formatted, r"\Q" + END + r"\E\n", -1), lambda b: b != "")

    def turns(b: Column) -> Column:
        body = F.substring_index(b, TEXT, -1)
        role = F.substring(F.substring_index(b, TEXT, 1), len(START) + 1, 1 << 30)
        return F.transform(F.split(body, r"\Q" + NEXT + r"\E", -1), lambda t: F.struct(unescape(role).alias("role"), unescape(t).alias("text")))

    return F.flatten(F.transform(blocks, turns))


def loss_texts(formatted: Column, mask: Column) -> Column:
    """The unescaped texts under the mask, in order."""
    start = F.struct(F.lit(0).cast("long").alias("at"), F.array().cast("array<string>").alias("out"))

    def step(acc: Column, m: Column) -> Column:
        cut = F.substr(formatted, (acc["at"] + 1).cast("int"), m["chars"].cast("int"))
        return F.struct((acc["at"] + m["chars"]).alias("at"), F.when(m["loss"], F.concat(acc["out"], F.array(cut))).otherwise(acc["out"]).alias("out"))

    return F.transform(F.aggregate(mask, start, step, lambda acc: acc["out"]), unescape)
