"""Chat formatting with prefix-target expansion, in SQL functions only.

A turn is written as ``<|role:`` and its role, ``|>`` and a line feed, its text, ``<|end|>`` and
a line feed. Inside roles and texts a backslash is written ``\\\\`` and a bar ``\\p``. So every bar
belongs to a marker, whatever lies beside it, and every role and text comes back unchanged.
Each assistant turn becomes an example of its own: all preceding turns are its context, and
only that reply's text is under the loss mask.

A conversation is formatted once, and an example is a prefix of it, kept as its end and the
mask's start and length (1-based code points) until :func:`expanded` makes it a row. So the
formatted table grows with the turns, not with their square.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestone.functions.joins import matched
from lodestone.functions.text import let
from lodestone.llm.common import written

HEAD, CLOSE, END = "<|role:", "|>\n", "<|end|>\n"


def escaped(text: Column) -> Column:
    return F.replace(F.replace(text, F.lit("\\"), F.lit("\\\\")), F.lit("|"), F.lit("\\p"))


def unescaped(text: Column) -> Column:
    # pairs of backslashes are cut out from the left, so what is left of a backslash is that of a bar
    return F.array_join(F.transform(F.split(text, r"\\\\", -1), lambda x: F.replace(x, F.lit("\\p"), F.lit("|"))), "\\")


def formatted(turns: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text", target: str = "assistant") -> DataFrame:
    """One row per conversation: ``conv_id``, ``formatted``, and ``targets`` with each reply's place.

    Turns go by number, those of the same number by role and text, null numbers first;
    repeated rows are repeated turns. A null role or text is empty. Null conversation ids
    are one conversation. No rows give no rows; further columns are left out. Texts may be of
    any length; a conversation is one row, so it has to fit a task.
    """
    head = F.concat(F.lit(HEAD), escaped(F.coalesce(F.col(role_col).cast("string"), F.lit(""))), F.lit(CLOSE))
    rows = turns.select(
        F.col(conv_col).alias("conv_id"),
        F.struct(
            F.col(turn_col).alias("n"),
            F.coalesce(F.col(role_col).cast("string"), F.lit("")).alias("r"),
            F.coalesce(F.col(text_col), F.lit("")).alias("t"),
            head.alias("h"),
            escaped(F.coalesce(F.col(text_col), F.lit(""))).alias("e"),
        ).alias("x"),
    )
    convs = rows.groupBy("conv_id").agg(F.array_sort(F.collect_list("x")).alias("x"))
    whole = F.array_join(F.transform("x", lambda x: F.concat(x["h"], x["e"], F.lit(END))), "")
    # a fold that keeps where the next turn starts and, for each target, where its text lies
    start = F.struct(F.lit(1).alias("at"), F.array().cast("array<struct<turn:int,context:int,start:int,length:int>>").alias("out"), F.lit(0).alias("k"))

    def step(acc: Column, x: Column) -> Column:
        at = acc["at"] + F.length(x["h"])
        place = F.struct(acc["k"].alias("turn"), (acc["at"] - 1).alias("context"), at.alias("start"), F.length(x["e"]).alias("length"))
        return F.struct((at + F.length(x["e"]) + len(END)).alias("at"), F.when(x["r"] == target, F.concat(acc["out"], F.array(place))).otherwise(acc["out"]).alias("out"), (acc["k"] + 1).alias("k"))

    targets = F.aggregate("x", start, step, lambda acc: acc["out"])
    return convs.select("conv_id", whole.alias("formatted"), targets.alias("targets"))


def expanded(convs: DataFrame) -> DataFrame:
    """The training examples: one row per target turn, with its whole context.

    ``text`` is the prefix up to and with the reply and its end marker, ``loss_start`` and
    ``loss_length`` the mask in code points (1-based); ``target`` is the turn's place.
    Conversations without a target turn have no example.
    """
    rows = convs.select("conv_id", "formatted", F.explode("targets").alias("x"))
    return rows.select(
        "conv_id",
        F.col("x.turn").alias("target"),
        F.substring(F.col("formatted"), F.lit(1), F.col("x.start") + F.col("x.length") - 1 + len(END)).alias("text"),
        F.col("x.start").alias("loss_start"),
        F.col("x.length").alias("loss_length"),
    )


def read_back(convs: DataFrame) -> DataFrame:
    """The rows with ``turns``, an array of (role, text) parsed from what was formatted, and ``loss``.

    ``loss`` is all text under the loss masks of the conversation's expanded examples, unescaped,
    in turn order; of an example only that text leaves its row. Written once, since both are read from it.
    """
    convs = written(convs, "formatted")

    def turn(part: Column) -> Column:
        def fields(x: Column) -> Column:
            # "<", "role:" and the role, ">", a line feed and the text
            role, text = F.get(x, F.lit(1)), F.get(x, F.lit(2))
            return F.struct(unescaped(F.substring(role, F.lit(6), F.length(role))).alias("role"), unescaped(F.substring(text, F.lit(3), F.length(text))).alias("text"))

        return let(F.split(part, r"\|", -1), fields)

    parts = F.split("formatted", r"<\|end\|>\n", -1)
    turns = let(parts, lambda p: F.transform(F.slice(p, F.lit(1), F.size(p) - 1), turn))

    said = unescaped(F.substring(F.col("text"), F.col("loss_start"), F.col("loss_length")))
    replies = expanded(convs).select("conv_id", F.struct("target", said.alias("said")).alias("x")).groupBy("conv_id").agg(F.array_sort(F.collect_list("x")).alias("x"))
    rows = matched(convs.select("*", turns.alias("turns")), replies, ["conv_id"], "left")
    return rows.withColumn("loss", F.coalesce(F.array_join("x.said", ""), F.lit(""))).drop("x")
