"""Chat formatting with relational operators: one string per conversation, with a loss mask, and the way back.

Template: every block is <|im_start|>role<|im_sep|>text<|im_end|>; adjacent turns of one role share a
block, their texts parted by <|im_turn|>. Control strings inside roles and texts get a backslash after
their first character (one more if they have some), so that they cannot be mistaken and come back exactly.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Turns whose spans are gathered at once.
RUN = 512
START, SEP, TURN, END = "<|im_start|>", "<|im_sep|>", "<|im_turn|>", "<|im_end|>"
#: Control strings of this template and of others in common use, by what follows their first character.
CONTROL = r"(?=\||/?s>|/?INST\]|<SYS>>|</SYS>>)"


def escape(c: Column) -> Column:
    return F.regexp_replace(c, rf"([<\[])(\\*){CONTROL}", r"$1\\$2")


def unescape(c: Column) -> Column:
    return F.regexp_replace(c, rf"([<\[])\\(\\*){CONTROL}", "$1$2")


def format_chats(turns: DataFrame, id_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text", loss_role: str = "assistant") -> DataFrame:
    """One row per conversation: id, formatted, loss_spans (array of start, length: code points of formatted under the loss mask).

    Turns are ordered by turn, then role and text, nulls first; null roles and texts are empty; a
    conversation of null id is one; repeated rows stay; an empty table gives no rows; other columns are
    ignored. A conversation is one output row, so its turns are collected; nothing else is.
    """
    turn = F.struct(F.col(turn_col).alias("turn"), F.coalesce(F.col(role_col), F.lit("")).alias("role"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    # sort the collected structs as they are, escape after; a turn opens a block where its role differs from the one before
    got = turns.select(F.col(id_col).alias("_id"), turn.alias("_turn")).groupBy("_id").agg(F.array_sort(F.collect_list("_turn")).alias("_turns"))
    got = got.select("_id", F.transform("_turns", lambda x: F.struct(escape(x["role"]).alias("role"), escape(x["text"]).alias("text"))).alias("_turns"))
    size = F.size("_turns")

    def piece(x: Column, i: Column) -> Column:
        same = (i > 0) & (F.get("_turns", i - 1)["role"] == x["role"])
        ends = (i == size - 1) | (F.get("_turns", i + 1)["role"] != x["role"])
        before = F.when(same, F.lit(TURN)).otherwise(F.concat(F.lit(START), x["role"], F.lit(SEP)))
        return F.struct(before.alias("before"), x["text"].alias("text"), F.when(ends, F.lit(END)).otherwise("").alias("after"), (x["role"] == escape(F.lit(loss_role))).alias("loss"))

    pieces = got.select("_id", F.transform("_turns", piece).alias("_pieces"))
    formatted = F.array_join(F.transform("_pieces", lambda p: F.concat(p["before"], p["text"], p["after"])), "")
    none = F.lit(None).cast("array<struct<start:bigint,length:bigint>>")
    step = lambda a, p: F.struct(
        (a["at"] + F.length(p["before"]) + F.length(p["text"]) + F.length(p["after"])).cast("long").alias("at"),
        F.when(p["loss"], F.array_append(a["spans"], F.struct((a["at"] + F.length(p["before"])).cast("long").alias("start"), F.length(p["text"]).cast("long").alias("length")))).otherwise(a["spans"]).alias("spans"),
    )
    empty = F.coalesce(none, F.expr("cast(array() as array<struct<start:bigint,length:bigint>>)"))
    zero = lambda at: F.struct(at.cast("long").alias("at"), empty.alias("spans"))
    # spans are gathered run by run, so that a long conversation does not copy them all for every turn
    run = lambda a, k: F.aggregate(F.slice("_pieces", k * RUN + 1, F.lit(RUN)), zero(a["at"]), step)
    join = lambda a, k: F.get(F.transform(F.array(run(a, k)), lambda r: F.struct(r["at"].alias("at"), F.concat(a["spans"], r["spans"]).alias("spans"))), F.lit(0))
    spans = F.aggregate(F.sequence(F.lit(0), F.floor((F.size("_pieces") - 1) / RUN).cast("int")), zero(F.lit(0)), join)["spans"]
    return pieces.select(F.col("_id").alias(id_col), formatted.alias("formatted"), spans.alias("loss_spans"))


def read_turns(formatted: Column) -> Column:
    """The turns of a formatted conversation: array of (role, text), unescaped."""
    block = lambda b: F.split(F.replace(b, F.lit(END), F.lit("")), r"<\|im_sep\|>", 2)
    blocks = F.filter(F.split(formatted, r"<\|im_start\|>"), lambda b: b != "")
    of = lambda b: F.transform(F.split(block(b)[1], r"<\|im_turn\|>", -1), lambda t: F.struct(unescape(block(b)[0]).alias("role"), unescape(t).alias("text")))
    return F.flatten(F.transform(blocks, of))


def read_loss(formatted: Column, spans: Column) -> Column:
    """The texts under the loss mask, unescaped, in order."""
    return F.transform(spans, lambda s: unescape(F.substring(formatted, (s["start"] + 1).cast("int"), s["length"].cast("int"))))
