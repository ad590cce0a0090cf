"""Chat formatting by prefix-target expansion, in DataFrame operations only.

A turn is written <s>role, a line feed, its text, </s>.  Every assistant turn becomes an example of its own: all
turns before it as context, and its text alone under the loss mask.  Turns after the last reply come
as a last example without a loss, so that the examples hold the whole conversation.

Control strings inside a text get a backslash after their first character, one more than they had; the role is
URL-encoded.  Both can be undone exactly.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

OPEN, CLOSE = "<s>", "</s>"
ASSISTANT = "assistant"
_CONTROL = r"(/?s>|/?INST\])"


def escape(text: Column) -> Column:
    return F.regexp_replace(text, r"([<\[])(\\*)" + _CONTROL, r"$1\\$2$3")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"([<\[])\\(\\*)" + _CONTROL, r"$1$2$3")


def examples(turns: DataFrame) -> DataFrame:
    """Examples of rows (conv_id, turn, role, text): conv_id, target, text, loss_start, loss_chars, whole.

    target: place of the reply among the conversation's turns, from 0 (null for the last example without a loss);
    loss_start, loss_chars: code points of `text` under the loss mask; whole: whether the example has all
    turns.  Turns are ordered by (turn, role, text), nulls first; a null role or text is empty.  A
    null conv_id is a conversation too.  Repeated rows are turns of their own.  Other columns are not read.
    """
    rows = turns.select("conv_id", "turn", F.coalesce(F.col("role").cast("string"), F.lit("")).alias("role"), F.coalesce(F.col("text"), F.lit("")).alias("text"))
    said = rows.select("conv_id", "turn", "role", "text", F.concat(F.lit(OPEN), F.url_encode("role"), F.lit("\n")).alias("head"), escape(F.col("text")).alias("body"))
    # Where each turn ends; equal turns are equally long, so which of them is first doesn't matter.
    upto = Window.partitionBy("conv_id").orderBy("turn", "role", "text").rowsBetween(Window.unboundedPreceding, 0)
    said = said.withColumn("end", F.sum(F.length("head") + F.length("body") + len(CLOSE)).over(upto).cast("int"))
    # A conversation is one training text: its turns are together in one string in any case.
    chats = said.groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct(F.struct("turn", "role", "text").alias("said"), "end", "head", "body"))).alias("turns"))
    chats = chats.withColumn("all", F.array_join(F.transform("turns", lambda t: F.concat(t["head"], t["body"], F.lit(CLOSE))), ""))
    at = F.sequence(F.lit(0), F.size("turns") - 1)
    last = F.size("turns") - 1
    wanted = F.filter(at, lambda i: (F.get(F.col("turns"), i)["said"]["role"] == ASSISTANT) | (i == last))
    each = chats.select("conv_id", F.size("turns").alias("n"), F.explode(F.transform(wanted, lambda i: F.struct(i.alias("i"), F.get(F.col("turns"), i).alias("turn")))).alias("x"), "all")
    each = each.select("conv_id", "n", "x.i", "x.turn", "all")
    turn, body = F.col("turn"), F.length("turn.body")
    reply = turn["said"]["role"] == ASSISTANT
    return each.select(
        "conv_id",
        F.when(reply, F.col("i")).alias("target"),
        F.substring(F.col("all"), F.lit(1), turn["end"]).alias("text"),
        F.when(reply, turn["end"] - len(CLOSE) - body).otherwise(0).alias("loss_start"),
        F.when(reply, body).otherwise(0).alias("loss_chars"),
        (F.col("i") == F.col("n") - 1).alias("whole"),
    )


def read_turns(text: Column) -> Column:
    """The turns (role, text) that a formatted text has, unescaped."""
    pieces = F.split(text, CLOSE)
    turns = F.slice(pieces, F.lit(1), F.size(pieces) - 1)

    def turn(piece: Column) -> Column:
        cut = F.instr(piece, "\n")
        role = F.substring(piece, F.lit(len(OPEN) + 1), cut - 1 - len(OPEN))
        return F.struct(F.url_decode(role).alias("role"), unescape(F.substring(piece, cut + 1, F.length(piece))).alias("text"))

    return F.transform(turns, turn)


def read_loss(text: Column, start: Column, chars: Column) -> Column:
    """The text under the loss mask, unescaped."""
    return unescape(F.substring(text, start + 1, chars))


def digests(formatted: DataFrame) -> DataFrame:
    """Of each conversation, from its examples: n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars."""
    loss = F.when(F.col("target").isNotNull(), F.struct("target", read_loss(F.col("text"), F.col("loss_start"), F.col("loss_chars")).alias("loss")))
    gathered = formatted.groupBy("conv_id").agg(F.max(F.when(F.col("whole"), F.col("text"))).alias("all"), F.sum(F.length("text").cast("long")).alias("formatted_chars"), F.sort_array(F.collect_list(loss)).alias("losses"))
    read = gathered.withColumn("turns", read_turns(F.col("all"))).withColumn("trained", F.array_join(F.transform("losses", lambda x: x["loss"]), ""))
    told = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return read.select("conv_id", F.size("turns").cast("long").alias("n_turns"), F.sha2(told.cast("binary"), 256).alias("turns_sha256"), F.length("trained").cast("long").alias("loss_chars"), F.sha2(F.col("trained").cast("binary"), 256).alias("loss_sha256"), "formatted_chars")
