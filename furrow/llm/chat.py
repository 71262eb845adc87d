"""Chat examples by prefix-target expansion, in DataFrame functions only.

Every assistant turn becomes an example of its own: all preceding turns are the
context, and only that reply is trainable. Turns that no reply follows (and
conversations without any reply) end up in one more example without a trainable
part, so that the output holds every turn.

A turn is written ``<|im_start|>role\\ntext<|im_end|>\\n``. Inside roles and texts a
backslash becomes two and ``<|`` becomes ``<\\|``; in roles a line feed becomes a
backslash and a line feed. So ``<|`` only ever stands in a mark, the first line
feed without a backslash ends the role, and dropping the first of each backslash
and its next character gives everything back.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

START, END = "<|im_start|>", "<|im_end|>\n"
TURN = "struct<turn: bigint, role: string, text: string>"


def escaped(text: Column) -> Column:
    return F.replace(F.replace(text, F.lit("\\"), F.lit("\\\\")), F.lit("<|"), F.lit("<\\|"))


def unescaped(text: Column) -> Column:
    return F.regexp_replace(text, r"(?s)\\(.)", "$1")


def written(role: Column, text: Column) -> Column:
    return F.concat(
        F.lit(START), F.replace(escaped(role), F.lit("\n"), F.lit("\\\n")), F.lit("\n"), escaped(text), F.lit(END)
    )


def conversations_of(rows: DataFrame) -> DataFrame:
    """(conv_id, turns): each conversation's turns in order of turn, then role and text where turns tie.

    A null role or text is empty, a null turn comes first; repeated rows are turns
    of their own. Roles and texts may be of any length. An empty table has no
    conversation. Other columns of rows, whatever their names, are left out. A
    conversation has to be one row here, as its digest is one; rows that share a
    null conv_id are one conversation.
    """
    turn = F.struct(
        F.col("turn").cast("bigint").alias("turn"),
        F.coalesce("role", F.lit("")).alias("role"),
        F.coalesce("text", F.lit("")).alias("text"),
    )
    return rows.select("conv_id", turn.alias("t")).groupBy("conv_id").agg(F.array_sort(F.collect_list("t")).alias("turns"))


def examples(rows: DataFrame) -> DataFrame:
    """(conv_id, example, context, target, n_turns, last): one row for each assistant turn, one more for turns after the last.

    ``context`` is the formatted text before the trainable part and ``target`` the
    formatted reply (null in the example without a trainable part); the loss mask
    is target's text between its role and its end mark. ``last`` marks each
    conversation's longest example. The formatted text of a conversation grows
    with the square of its replies: that is what the expansion is.
    """
    said = conversations_of(rows).select("conv_id", "turns", F.transform("turns", lambda t: written(t["role"], t["text"])).alias("out"))
    n = F.size("turns")
    replies = F.filter(F.sequence(F.lit(1), n), lambda i: F.get(F.col("turns"), i - 1)["role"] == "assistant")
    tail = F.get("turns", n - 1)["role"] != "assistant"
    ends = F.concat(F.transform(replies, lambda i: F.struct(i.alias("at"), F.lit(True).alias("trains"))),
                    F.when(tail, F.array(F.struct(n.alias("at"), F.lit(False).alias("trains")))).otherwise(F.array().cast("array<struct<at: int, trains: boolean>>")))
    each = said.withColumn("ends", ends).select("conv_id", "out", n.alias("n"), F.posexplode("ends").alias("example", "end"))
    at, trains = F.col("end.at"), F.col("end.trains")
    return each.select(
        "conv_id",
        "example",
        F.array_join(F.slice("out", 1, F.when(trains, at - 1).otherwise(at)), "").alias("context"),
        F.when(trains, F.get("out", at - 1)).alias("target"),
        (at == F.col("n")).alias("last"),
    )


#: A role as it is written: possessive, so that the matcher neither recurses nor goes back, however long the role.
_ROLE = r"[^\\\n]*+(?:\\.[^\\\n]*+)*+"


def _body(turn: Column) -> Column:
    """The unescaped text of one formatted turn: what follows the role, without the end mark."""
    said = F.regexp_replace(turn, rf"(?s)^<\|im_start\|>{_ROLE}\n", "")
    return unescaped(F.substr(said, F.lit(1), F.char_length(said) - len(END)))


def _role(turn: Column) -> Column:
    return unescaped(F.regexp_extract(turn, rf"(?s)^<\|im_start\|>({_ROLE})\n", 1))


def read_back(made: DataFrame) -> DataFrame:
    """One row for each conversation, from its examples: turns and loss text as the formatted text gives them.

    The turns are read from the longest example. Cutting at start marks is safe,
    as no text holds one.
    """
    whole = F.concat("context", F.coalesce("target", F.lit("")))
    turns = F.transform(F.filter(F.split(whole, r"(?=<\|im_start\|>)"), lambda t: t != ""), lambda t: F.concat(_role(t), F.lit("\n"), _body(t), F.lit("\n")))
    per_example = made.select(
        "conv_id",
        "example",
        F.when(F.col("last"), turns).alias("turns"),
        F.coalesce(_body(F.col("target")), F.lit("")).alias("loss"),
        F.char_length(whole).cast("long").alias("chars"),
    )
    joined = per_example.groupBy("conv_id").agg(
        F.max("turns").alias("turns"),
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("example", "loss"))), lambda x: x["loss"]), "").alias("loss"),
        F.sum("chars").alias("formatted_chars"),
    )
    return joined.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(F.array_join("turns", ""), 256).alias("turns_sha256"),
        F.char_length("loss").cast("long").alias("loss_chars"),
        F.sha2("loss", 256).alias("loss_sha256"),
        "formatted_chars",
    )
