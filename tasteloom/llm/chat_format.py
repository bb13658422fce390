"""Relational chat formatting: sorted turn structs, merged runs of one role, Spark expressions only.

A conversation becomes one string. Each run of adjacent turns with one role is a block::

    <|role|>
    first text<|next|>second text<|end|>

Texts and roles are escaped so that none of these marks can appear inside them: a backslash becomes
two, and ``<|`` and ``|>`` get a backslash between their characters. Undoing this from left to right gives back
the very same text, so ``read_back`` recovers every turn from the string alone.

Nulls: a null text or role is an empty string; a null turn number comes first. Turns with equal
numbers are ordered by role, then text; repeated rows stay repeated turns. A null ``conv_id`` is a
conversation of its own. Other columns of the input are ignored. An empty table gives no rows.
One conversation is one training sample and has to fit a row; that is the only bound.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

OPEN, CLOSE = "<|", "|>"
NEXT, END = "<|next|>", "<|end|>"


def escape(text: Column) -> Column:
    text = F.replace(F.coalesce(text, F.lit("")), F.lit("\\"), F.lit("\\\\"))
    text = F.replace(text, F.lit(OPEN), F.lit("<\\|"))
    return F.replace(text, F.lit(CLOSE), F.lit("|\\>"))


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"(?s)\\(.)", "$1")


def merge_runs(turns: Column) -> Column:
    """Adjacent structs of one role merged to ``(role, texts)``."""
    start = F.array().cast("array<struct<role:string,texts:array<string>>>")

    def step(done: Column, turn: Column) -> Column:
        last = F.element_at(done, -1)
        single = F.struct(turn["role"].alias("role"), F.array(turn["text"]).alias("texts"))
        longer = F.struct(
            last["role"].alias("role"), F.concat(last["texts"], F.array(turn["text"])).alias("texts")
        )
        same = (F.size(done) > 0) & (F.get(done, F.size(done) - 1)["role"] == turn["role"])
        return F.when(
            same, F.concat(F.slice(done, F.lit(1), F.greatest(F.size(done) - 1, F.lit(0))), F.array(longer))
        ).otherwise(F.concat(done, F.array(single)))

    return F.aggregate(turns, start, step)


def format_conversations(
    conversations: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text"
) -> DataFrame:
    """``(conv, n_turns, formatted)``: one row and one string per conversation."""
    # equal turns go by role and text as they stand, so escapes come after the order
    entry = F.struct(
        F.col(turn).alias("turn"), F.coalesce(role, F.lit("")).alias("role"), F.coalesce(text, F.lit("")).alias("text")
    )
    escaped = F.transform("turns", lambda t: F.struct(escape(t["role"]).alias("role"), escape(t["text"]).alias("text")))
    blocks = merge_runs(escaped)
    written = F.transform(
        blocks,
        lambda b: F.concat(
            F.lit(OPEN), b["role"], F.lit(CLOSE + "\n"), F.array_join(b["texts"], NEXT), F.lit(END)
        ),
    )
    return (
        conversations.groupBy(F.col(conv).alias(conv))
        .agg(F.array_sort(F.collect_list(entry)).alias("turns"))
        .select(conv, F.size("turns").cast("long").alias("n_turns"), F.array_join(written, "").alias("formatted"))
    )


def read_back(formatted: Column) -> Column:
    """Array of ``(role, text)`` in order, recovered from the formatted string."""
    blocks = F.filter(F.split(formatted, r"<\|end\|>"), lambda b: b != "")

    def turns(block: Column) -> Column:
        # the role holds no unescaped "|>", so the first mark ends it
        head = F.substring_index(block, CLOSE + "\n", 1)
        body = F.substr(block, F.length(head) + F.lit(len(CLOSE) + 2))
        role = unescape(F.substr(head, F.lit(len(OPEN) + 1)))
        return F.transform(
            F.split(body, r"<\|next\|>"),
            lambda t: F.struct(role.alias("role"), unescape(t).alias("text")),
        )

    return F.flatten(F.transform(blocks, turns))


def loss_text(turns: Column, trained_role: str = "assistant") -> Column:
    """All text under the loss mask: the trained role's texts, in order, nothing between."""
    return F.array_join(
        F.transform(F.filter(turns, lambda t: t["role"] == trained_role), lambda t: t["text"]), ""
    )
