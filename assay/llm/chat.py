"""Conversations as training examples, one for each assistant turn.

Every assistant turn becomes an example of its own: all turns before it are
context and only that reply is under the loss mask. Turns after the last
reply make one more example without a reply, so that no turn is lost.

A turn is `<|im_start|>role`, a line feed, the text and `<|im_end|>`, a line feed. Inside
texts and roles `<|` becomes `<||`, so no control string can occur there, and the
other way round every `<||` is read back as `<|`. A line feed in a role is
`<|nl|>`.

* Turns stand by (turn, role, text), nulls first; a null role or text is empty.
* Rows with a null conv_id make one conversation. Repeated rows are turns of their own.
* Without an assistant turn a conversation gives one example without loss.
* An empty table gives an empty result. Other columns are ignored. A conversation is
  a row: it must fit into a task, other groups need not.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

START, END, BREAK = "<|im_start|>", "<|im_end|>\n", "<|nl|>"
TRAINED = "assistant"


def escaped(text: Column) -> Column:
    return F.replace(text, F.lit("<|"), F.lit("<||"))


def unescaped(text: Column) -> Column:
    return F.replace(text, F.lit("<||"), F.lit("<|"))


def opening(role: Column) -> Column:
    name = F.replace(escaped(role), F.lit("\n"), F.lit(BREAK))
    return F.concat(F.lit(START), name, F.lit("\n"))


def formatted(turn: Column) -> Column:
    return F.concat(opening(turn["role"]), escaped(turn["text"]), F.lit(END))


def examples(conversations: DataFrame) -> DataFrame:
    """conv_id, example (from 1), text, loss_start, loss_chars: a row per reply.

    The loss mask is one span of code points, from `loss_start` (0 at the start of
    the text); null when nothing is trained.
    """
    rows = conversations.select(
        "conv_id",
        "turn",
        F.coalesce("role", F.lit("")).alias("role"),
        F.coalesce("text", F.lit("")).alias("text"),
    )
    turns = F.array_sort(F.collect_list(F.struct(F.col("turn").isNotNull(), "turn", "role", "text")))
    held = rows.groupBy("conv_id").agg(turns.alias("turns"))
    # Where examples end: at every reply, and at the last turn.
    ends = F.filter(
        F.sequence(F.lit(1), F.size("turns")),
        lambda i: (F.get("turns", i - 1)["role"] == TRAINED) | (i == F.size("turns")),
    )
    one = held.select("conv_id", "turns", F.posexplode(ends).alias("place", "upto"))
    last = F.get("turns", F.col("upto") - 1)
    context = F.array_join(F.transform(F.slice("turns", F.lit(1), F.col("upto") - 1), formatted), "")
    reply = escaped(last["text"])
    parts = one.select(
        "conv_id",
        (F.col("place") + 1).cast("long").alias("example"),
        (last["role"] == TRAINED).alias("trained"),
        F.concat(context, opening(last["role"])).alias("before"),
        reply.alias("reply"),
    )
    return parts.select(
        "conv_id",
        "example",
        F.concat("before", "reply", F.lit(END)).alias("text"),
        F.when(F.col("trained"), F.char_length("before")).cast("long").alias("loss_start"),
        F.when(F.col("trained"), F.char_length("reply")).cast("long").alias("loss_chars"),
    )


def turns_of(text: Column) -> Column:
    """The turns of a formatted text, as (role, text)."""
    split = F.split(text, r"<\|im_start\|>", -1)
    pieces = F.slice(split, F.lit(2), F.size(split))

    def parsed(piece: Column) -> Column:
        body = F.substr(piece, F.lit(1), F.char_length(piece) - len(END))
        at = F.locate("\n", body)
        role = F.replace(F.substr(body, F.lit(1), at - 1), F.lit(BREAK), F.lit("\n"))
        said = F.substr(body, at + 1)
        return F.struct(unescaped(role).alias("role"), unescaped(said).alias("text"))

    return F.transform(pieces, parsed)


def read_back(rows: DataFrame) -> DataFrame:
    """Per conversation, what its examples hold: turns, text under the loss mask, size."""
    said = F.substr("text", F.col("loss_start").cast("int") + 1, F.col("loss_chars").cast("int"))
    held = rows.select(
        "conv_id",
        "example",
        "text",
        F.char_length("text").alias("chars"),
        unescaped(said).alias("said"),
    )
    per = held.groupBy("conv_id").agg(
        F.max_by("text", "example").alias("longest"),
        F.array_sort(F.collect_list(F.when(F.col("said").isNotNull(), F.struct("example", "said")))).alias(
            "replies"
        ),
        F.sum("chars").cast("long").alias("formatted_chars"),
    )
    whole = F.array_join(
        F.transform(
            turns_of(F.col("longest")),
            lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n")),
        ),
        "",
    )
    loss = F.array_join(F.transform("replies", lambda r: r["said"]), "")
    return per.select(
        "conv_id",
        F.size(turns_of(F.col("longest"))).cast("long").alias("n_turns"),
        F.sha2(whole, 256).alias("turns_sha256"),
        F.char_length(loss).cast("long").alias("loss_chars"),
        F.sha2(loss, 256).alias("loss_sha256"),
        "formatted_chars",
    )
