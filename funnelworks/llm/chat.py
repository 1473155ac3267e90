"""Chat formatting from an event log.

A conversation is kept as events: ``message`` opens a message, ``delta`` adds streamed text,
``edit`` replaces what there is, ``regenerate`` throws it away and starts over. Events are folded
per message in order of their sequence, messages are ordered within their conversation and rendered,
and a loss mask gives the spans of the assistant's texts.

Template, one turn: ``<s>[INST]`` role ``[/INST]`` text ``</s>``. Inside of roles and texts every
backslash, ``<`` and ``[`` is escaped, so no control string can be written by a text.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from funnelworks.llm import columns as C

OPEN, MIDDLE, CLOSE = "<s>[INST]", "[/INST]", "</s>"
ESCAPES = [("\\", "\\b"), ("<", "\\l"), ("[", "\\s")]


def escape(text: Column) -> Column:
    for plain, written in ESCAPES:
        text = F.replace(text, F.lit(plain), F.lit(written))
    return text


def unescape(text: Column) -> Column:
    for plain, written in reversed(ESCAPES):
        text = F.replace(text, F.lit(written), F.lit(plain))
    return text


def fold_events(events: DataFrame) -> DataFrame:
    """Final messages (conv, msg, role, text) of events (conv, msg, seq, kind, role, text).

    The last edit or regeneration outdates all earlier events of its message. Events of equal
    sequence come in order of kind, role and text. NULL texts and roles are empty, a message's role is that of
    its last event that has one. Only the events of one message meet, never a whole conversation.
    """
    clean = events.select("conv", "msg", F.struct(
        F.col("seq"), F.coalesce("kind", F.lit("delta")).alias("kind"), F.col("role"), F.coalesce("text", F.lit("")).alias("text")).alias("e"))
    grouped = clean.groupBy("conv", "msg").agg(F.sort_array(F.collect_list("e")).alias("es"))
    last = F.array_max(F.transform(F.col("es"), lambda e, i: F.when(e["kind"].isin("edit", "regenerate"), i).otherwise(0)))
    live = F.slice("es", F.col("last") + 1, F.greatest(F.size("es"), F.lit(1)))
    texts = F.transform(live, lambda e: F.when(e["kind"] == "regenerate", F.lit("")).otherwise(e["text"]))
    roles = F.filter(F.transform("es", lambda e: e["role"]), lambda r: r.isNotNull())
    return grouped.withColumn("last", last).select(
        "conv", "msg", F.coalesce(F.get(F.reverse(roles), F.lit(0)), F.lit("")).alias("role"),
        F.array_join(texts, "").alias("text"))


def render(messages: DataFrame, trained: str = "assistant") -> DataFrame:
    """(conv, formatted, turns: start, length, loss_start, loss_length in code points; lengths of 0 for other roles).

    Every conversation is one string, as the format wants it; its offsets come from a running sum.
    """
    text = escape(F.col("text"))
    head = F.concat(F.lit(OPEN), escape(F.col("role")), F.lit(MIDDLE))
    parts = messages.select("conv", "msg", (F.col("role") == trained).alias("on"), F.length(head).alias("head"),
                            F.length(text).alias("body"), F.concat(head, text, F.lit(CLOSE)).alias("piece"))
    order = Window.partitionBy("conv").orderBy("msg").rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.withColumn("start", F.coalesce(F.sum(F.length("piece")).over(order), F.lit(0)))
    span = F.struct("start", F.length("piece").cast("bigint").alias("length"), (F.col("start") + F.col("head")).alias("loss_start"),
                    F.when(F.col("on"), F.col("body")).otherwise(0).cast("bigint").alias("loss_length"))
    rows = parts.groupBy("conv").agg(F.sort_array(F.collect_list(F.struct("msg", span.alias("span"), "piece"))).alias("xs"))
    return rows.select("conv", F.array_join(F.transform("xs", lambda x: x["piece"]), "").alias("formatted"),
                       F.transform("xs", lambda x: x["span"]).alias("turns"))


def read_back(formatted: DataFrame) -> DataFrame:
    """Turns and trained texts from the rendered strings: (conv, formatted, turns_read: role, text; trained: texts).

    A rendered turn ends at the closing mark, which no escaped text holds, so one split finds them all.
    """
    pieces = F.slice(F.split("formatted", CLOSE), F.lit(1), F.size("turns"))
    cut = F.transform(pieces, lambda p: F.struct(
        unescape(F.substring_index(F.substring(p, len(OPEN) + 1, 2**31 - 1), MIDDLE, 1)).alias("role"),
        unescape(F.substring_index(p, MIDDLE, -1)).alias("text")))
    masked = F.zip_with(pieces, F.col("turns"), lambda p, t: unescape(F.substring(
        p, (t["loss_start"] - t["start"] + 1).cast("int"), t["loss_length"].cast("int"))))
    return formatted.select("conv", "formatted", cut.alias("turns_read"), masked.alias("trained"))


def turn_events(conversations: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """The log of finished conversations: every row opens a message and streams its text. Rows of equal
    turn come in order of role and text; equal rows are turns of their own."""
    rows = conversations.select(C.name(conv).alias("conv"), C.name(turn).alias("turn"), C.name(role).cast("string").alias("role"), C.text_of(text).alias("text"))
    n = F.row_number().over(Window.partitionBy("conv", "turn").orderBy("role", "text"))
    msg = F.struct("turn", n.alias("n"))
    rows = rows.withColumn("msg", msg)  # numbered before rows are split into events
    return rows.select("conv", "msg", F.explode(F.array(
        F.struct(F.lit(0).alias("seq"), F.lit("message").alias("kind"), F.col("role").alias("role"), F.lit("").alias("text")),
        F.struct(F.lit(1).alias("seq"), F.lit("delta").alias("kind"), F.lit(None).cast("string").alias("role"), F.col("text").alias("text")),
    )).alias("e")).select("conv", "msg", "e.*")
