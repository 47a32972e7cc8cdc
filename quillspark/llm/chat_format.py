"""Chat formatting from an event log, in DataFrame functions only.

A log has rows (conv_id, seq, message, kind, role, text): ``message`` orders a conversation's messages, ``seq`` its
events. Kinds: ``delta`` appends to its message, ``edit`` and ``message`` replace what it said, ``regenerate`` starts
it anew. ``fold_events`` folds a log into final messages; ``render`` writes each conversation by a template that marks
turns, with a loss mask; ``read_back`` recovers roles, texts and the text under the mask from the output alone.

Escaping: in a role or text, ``<`` followed by k >= 1 bars is written with k + 1. So ``<`` with exactly one bar stands
only in the template's own marks, and reading takes one bar away again. A line break in a role is the mark ``<|nl|>``.

Events of a message are folded, and messages rendered, before a conversation is gathered; gathering it is the result
itself (one formatted string), so one task must hold the longest conversation once.

Defined cases: a null text or role is empty. A null kind counts as ``message``. A null conv_id is a conversation, a
null turn sorts first. Events of equal seq apply in the order of kind, role and text. Repeated rows are repeated
turns to ``from_turns``. Empty tables give empty results; extra columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

START, END, NL = "<|im_start|>", "<|im_end|>", "<|nl|>"


def escape(text: Column) -> Column:
    return F.regexp_replace(text, r"<(\|+)", r"<|$1")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"<\|(\|+)", r"<$1")


def from_turns(turns: DataFrame) -> DataFrame:
    """The log of conversations that come as finished turns (conv_id, turn, role, text): one event each."""
    w = W.partitionBy("conv_id").orderBy("turn", "role", "text")
    nth = F.row_number().over(w).cast("long")
    return turns.select("conv_id", nth.alias("seq"), F.lit("message").alias("kind"), "role", "text").withColumn(
        "message", F.col("seq")
    )


def streamed(turns: DataFrame) -> DataFrame:
    """The log that a chat service keeps of finished turns (conv_id, turn, role, text), whose fold they are.

    An assistant's turn begins as a draft (the second half of its text) that is regenerated and then streamed as two
    deltas; any other turn is sent with its first half and edited to the whole.
    """
    said = F.coalesce("text", F.lit(""))
    half = F.floor(F.length(said) / 2).cast("int")
    first, rest = F.substr(said, F.lit(1), half), F.substr(said, half + 1)
    none = F.lit(None).cast("string")

    def events(*made: tuple[str, Column, Column]) -> Column:
        return F.array(*[
            F.struct(F.lit(i).alias("i"), F.lit(kind).alias("kind"), role.alias("role"), text.alias("text")) for i, (kind, role, text) in enumerate(made)
        ])

    role = F.col("role").cast("string")
    answer = events(("delta", role, rest), ("regenerate", none, none), ("delta", role, first), ("delta", none, rest))
    other = events(("message", role, first), ("edit", none, said))
    log = from_turns(turns).withColumn("e", F.explode(F.when(F.col("role") == "assistant", answer).otherwise(other)))
    return log.select("conv_id", (F.col("seq") * 4 + F.col("e.i")).alias("seq"), "message", "e.kind", "e.role", "e.text")


def fold_events(events: DataFrame) -> DataFrame:
    """(conv_id, message, role, text): each message's text after its last event, and the last role it was given."""
    entry = F.struct("seq", F.coalesce("kind", F.lit("message")).alias("kind"), "role", "text")
    log = events.groupBy("conv_id", "message").agg(F.sort_array(F.collect_list(entry)).alias("log"))
    log = log.withColumn(
        "base", F.array_max(F.transform("log", lambda x, i: F.when(x["kind"] == "delta", 0).otherwise(i)))
    )
    valid = F.slice("log", F.col("base") + 1, F.size("log"))
    roles = F.filter(F.transform("log", lambda x: x["role"]), lambda r: r.isNotNull())
    return log.select(
        "conv_id",
        "message",
        F.coalesce(F.try_element_at(roles, F.lit(-1)), F.lit("")).alias("role"),
        F.array_join(F.transform(valid, lambda x: F.coalesce(x["text"], F.lit(""))), "").alias("text"),
    )


def render(messages: DataFrame, loss_role: str = "assistant") -> DataFrame:
    """(conv_id, formatted, loss_mask): loss_mask has an entry per turn, null outside the loss, else the offset of
    the turn in ``formatted`` (code points), and start and length of its masked text within the turn."""
    role = F.regexp_replace(escape(F.coalesce("role", F.lit(""))), "\n", NL)
    written = messages.select(
        "conv_id", "message", (F.col("role") == loss_role).alias("loss"),
        F.concat(F.lit(START), role, F.lit("\n")).alias("head"), escape(F.coalesce("text", F.lit(""))).alias("body"),
    )
    turn = F.concat("head", "body", F.lit(END + "\n"))
    w = W.partitionBy("conv_id").orderBy("message").rowsBetween(W.unboundedPreceding, -1)
    placed = written.select(
        "conv_id", "message", turn.alias("turn"),
        F.when(F.col("loss"), F.struct(
            F.coalesce(F.sum(F.length(turn)).over(w), F.lit(0)).alias("offset"),
            F.length("head").alias("start"),
            F.length("body").alias("length"),
        )).alias("mask"),
    )
    gathered = placed.groupBy("conv_id").agg(
        F.sort_array(F.collect_list(F.struct("message", "turn", "mask"))).alias("all")
    )
    return gathered.select(
        "conv_id",
        F.array_join(F.transform("all", lambda x: x["turn"]), "").alias("formatted"),
        F.transform("all", lambda x: x["mask"]).alias("loss_mask"),
    )


def read_back(formatted: DataFrame) -> DataFrame:
    """(conv_id, turns, loss): turns (role, text) and the texts under the mask (null elsewhere), from the output."""
    parts = F.split("formatted", r"<\|im_end\|>\n", -1)
    parts = F.slice(parts, 1, F.size(parts) - 1)

    def one(part: Column) -> Column:
        inner = F.substring(part, len(START) + 1, 2**31 - 1)
        role = F.substring_index(inner, "\n", 1)
        text = F.substr(inner, F.length(role) + 2)
        return F.struct(
            unescape(F.regexp_replace(role, r"<\|nl\|>", "\n")).alias("role"), unescape(text).alias("text")
        )

    def masked(part: Column, mask: Column) -> Column:
        return F.when(mask.isNotNull(), unescape(F.substr(part, mask["start"] + 1, mask["length"])))

    return formatted.select(
        "conv_id", "formatted", F.transform(parts, one).alias("turns"), F.zip_with(parts, "loss_mask", masked).alias("loss")
    )


def digests(back: DataFrame) -> DataFrame:
    said = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    loss = F.array_join("loss", "")  # skips nulls
    return back.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(said, 256).alias("turns_sha256"),
        F.length(loss).cast("long").alias("loss_chars"),
        F.sha2(loss, 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
    )
