"""Chat formatting by event-sourced reconstruction.

An event log holds what a chat service saw: ``start`` opens a message (or opens it anew), ``delta`` appends
streamed text to it, ``edit`` replaces its text, ``regenerate`` discards its text and every message after it
that had been opened before. Logs are partitioned by conversation and folded in sequence into the final
messages, which a template renders with a loss mask over the assistant's texts. All of it is DataFrame
expressions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

OPEN, TEXT, CLOSE = "<|turn|>", "<|text|>", "<|end|>\n"

#: Characters that begin a control string of this or a common foreign template, and their escapes.
ESCAPES = (("&", "&a"), ("<", "&l"), ("[", "&b"))


def escape(text: Column) -> Column:
    """Afterwards no '<' or '[' is left, so no control string can be spelled inside a text."""
    for plain, code in ESCAPES:
        text = F.replace(text, F.lit(plain), F.lit(code))
    return text


def unescape(text: Column) -> Column:
    for plain, code in reversed(ESCAPES):
        text = F.replace(text, F.lit(code), F.lit(plain))
    return text


def fold_rows(events: DataFrame) -> DataFrame:
    """Messages of an event log, a row each: (conv_id, turn, role, text).

    Columns of events: conv_id, seq, kind (start, delta, edit, regenerate), turn, role, text; others are
    ignored. Null text counts as empty, a null role as the role the message was opened with, else ''.
    Events with equal seq apply in order of (kind, role, text); repeated events apply as often as they
    stand. A message exists if any of its events is a start or an edit; deltas that precede its last
    reset are gone. An event of unknown kind is ignored. No events give no rows.

    Each message is folded by itself. Whether a regeneration of an earlier message cuts it off is decided by the running maximum
    of the earlier messages' cuts in order of turn, so time is linear in a conversation's messages, however many there are.
    """
    e = events.select("conv_id", "turn", "seq", "kind", "role", F.coalesce("text", F.lit("")).alias("text"))
    reset = F.col("kind").isin("start", "edit", "regenerate")
    one = F.struct("seq", F.when(reset, 0).otherwise(1).alias("late"), "kind", "role", "text")
    m = e.where(F.col("kind").isin("start", "delta", "edit", "regenerate")).groupBy("conv_id", "turn").agg(
        F.array_sort(F.collect_list(one)).alias("log"),
        F.max(F.when(F.col("kind") == "regenerate", F.col("seq"))).alias("cut_seq"),
        F.min(F.when(F.col("kind").isin("start", "edit"), F.col("seq"))).alias("begun"),
        F.max(F.when(F.col("kind").isin("start", "edit"), F.col("seq"))).alias("opened"),
    )
    resets = F.filter("log", lambda x: x["late"] == 0)
    last = F.try_element_at(resets, F.lit(-1))
    roles = F.filter(F.transform("log", lambda x: x["role"]), lambda x: x.isNotNull())
    m = m.where(F.col("begun").isNotNull()).select(
        "conv_id", "turn", "opened", "cut_seq",
        F.coalesce(F.try_element_at(roles, F.lit(-1)), F.lit("")).alias("role"),
        F.concat(
            last["text"],
            F.array_join(F.transform(F.filter("log", lambda x: (x["late"] == 1) & (x["seq"] >= last["seq"])), lambda x: x["text"]), ""),
        ).alias("text"),
    )
    earlier = Window.partitionBy("conv_id").orderBy("turn").rowsBetween(Window.unboundedPreceding, -1)
    m = m.withColumn("_cut", F.max("cut_seq").over(earlier)).where(F.coalesce(F.col("_cut") <= F.col("opened"), F.lit(True)))
    return m.select("conv_id", "turn", "role", "text")


def fold_events(events: DataFrame) -> DataFrame:
    """(conv_id, messages array<struct<turn, role, text>>) in order of turn: fold_rows(), a row per conversation. Conversations none of whose messages are left
    give no row."""
    return fold_rows(events).groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "role", "text"))).alias("messages"))


def _body(role: Column, text: Column) -> Column:
    return F.concat(F.lit(OPEN), escape(role), F.lit(TEXT), escape(text), F.lit(CLOSE))


def render_rows(messages: DataFrame) -> DataFrame:
    """(conv_id, formatted, loss_mask) of messages (conv_id, turn, role, text): what render() gives, with offsets from running sums over each conversation's messages.

    (conv_id, turn) tells messages apart. Null roles and texts count as empty, texts may have any length, other columns are ignored, no messages give no rows. The formatted string is one
    value, so a conversation's text must fit one; nothing else of it meets in a row."""
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    upto = Window.partitionBy("conv_id").orderBy("turn").rowsBetween(Window.unboundedPreceding, 0)
    m = messages.select("conv_id", "turn", (role == "assistant").alias("_said"), F.length(escape(role)).alias("_role"), _body(role, text).alias("_piece"))
    m = m.withColumn("_size", F.length("_piece")).withColumn("_at", F.sum("_size").over(upto) - F.col("_size"))
    span = F.struct((F.col("_at") + len(OPEN) + len(TEXT) + F.col("_role")).cast("int").alias("start"), (F.col("_at") + F.col("_size") - len(CLOSE)).cast("int").alias("end"))
    g = m.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("_at", "_piece"))).alias("_p"), F.array_sort(F.collect_list(F.when(F.col("_said"), span))).alias("loss_mask"))
    return g.select("conv_id", F.array_join(F.transform("_p", lambda x: x["_piece"]), "").alias("formatted"), "loss_mask")


def render(folded: DataFrame) -> DataFrame:
    """(conv_id, formatted, loss_mask): the template's string, and the spans [start, end) in code points that
    hold the assistant's escaped texts.

    A message's null role or text makes the row's result null (fold_events gives none). Empty texts have empty spans; texts of any length and control strings
    within them are escaped, never cut. No messages give an empty string, an empty table no rows; other columns are ignored."""
    body = lambda x: _body(x["role"], x["text"])
    step = lambda acc, x: F.struct(
        (acc["at"] + F.length(body(x))).alias("at"),
        F.when(
            x["role"] == "assistant",
            F.concat(acc["spans"], F.array(F.struct(
                (acc["at"] + len(OPEN) + len(TEXT) + F.length(escape(x["role"]))).alias("start"),
                (acc["at"] + F.length(body(x)) - len(CLOSE)).alias("end"),
            ))),
        ).otherwise(acc["spans"]).alias("spans"),
    )
    none = F.array().cast("array<struct<start:int,end:int>>")
    return folded.select(
        "conv_id",
        F.array_join(F.transform("messages", body), "").alias("formatted"),
        F.aggregate("messages", F.struct(F.lit(0).alias("at"), none.alias("spans")), step)["spans"].alias("loss_mask"),
    )


def parse(formatted: Column) -> Column:
    """The turns of a formatted string: array<struct<role, text>>, also where texts are empty, repeated or long; null for null, none for an empty string."""
    pieces = F.filter(F.split(formatted, r"<\|end\|>\n", -1), lambda x: x != "")
    halves = lambda x: F.split(F.substring(x, len(OPEN) + 1, 2**30), r"<\|text\|>", 2)
    return F.transform(pieces, lambda x: F.struct(unescape(halves(x)[0]).alias("role"), unescape(halves(x)[1]).alias("text")))


#: Code points in a part of a formatted string: a span is taken from its own parts, as finding a place in a whole string takes time in proportion to the place.
PART = 2048


def masked_text(formatted: Column, loss_mask: Column) -> Column:
    """All text under the mask, unescaped."""
    parts = F.regexp_extract_all(formatted, F.lit(f"(?s).{{1,{PART}}}"), 0)

    def under(parts: Column, s: Column) -> Column:
        first = F.floor(s["start"] / PART).cast("int")
        own = F.array_join(F.slice(parts, first + 1, F.floor((F.greatest(s["end"], s["start"] + 1) - 1) / PART).cast("int") - first + 1), "")
        return F.substring(own, s["start"] - first * PART + 1, s["end"] - s["start"])

    # the parts are bound by a fold of one step, so that they are cut once, not for each span
    said = F.aggregate(F.array(parts), F.lit(""), lambda acc, p: F.array_join(F.transform(loss_mask, lambda s: under(p, s)), ""))
    return unescape(said)


def events_of_rows(rows: DataFrame) -> DataFrame:
    """An event log whose folding gives the conversations (conv_id, turn, role, text), as a service with drafts would have seen them.

    Every message starts, and a draft is streamed to it. An assistant's draft is regenerated and its text streamed in two deltas; others see their draft
    edited into the first half of their text, and the second half streamed, while the next message has begun already. Rows with an equal turn,
    repeated ones included, are messages of their own, in order of role and text; a null turn comes first, a null text is empty, a null role ''. Long texts pass as they
    are. Other columns are ignored. No rows give no events.
    """
    nth = F.row_number().over(Window.partitionBy("conv_id").orderBy("turn", "role", "text")).cast("long")
    r = rows.select("conv_id", "role", F.coalesce("text", F.lit("")).alias("text"), nth.alias("nth"))
    said = F.col("role").eqNullSafe("assistant")
    half = F.floor(F.length("text") / 2).cast("int")
    first, second = F.substring(F.col("text"), F.lit(1), half), F.substring(F.col("text"), half + 1, F.length("text"))
    event = lambda at, kind, text: F.struct((F.col("nth") * 10 + at).cast("long").alias("seq"), kind.alias("kind"), text.alias("text"))
    log = F.array(
        event(0, F.lit("start"), F.lit("")),
        event(1, F.lit("delta"), F.concat(F.lit("draft: "), F.substring("text", 1, 40))),
        event(F.when(said, 2).otherwise(12), F.when(said, "regenerate").otherwise("edit"), F.when(said, "").otherwise(first)),
        event(F.when(said, 3).otherwise(13), F.lit("delta"), F.when(said, first).otherwise(second)),
        event(F.lit(14), F.lit("delta"), F.when(said, second).otherwise("")),
    )
    return r.select("conv_id", F.col("nth").alias("turn"), "role", F.explode(log).alias("e")).select("conv_id", "turn", "role", "e.*")


def digest(rendered: DataFrame) -> DataFrame:
    """Figures of rendered conversations, taken from their formatted strings and masks alone: a row per row, repeated ones too, zeros and hashes of
    nothing where a string is empty, nulls where it is null."""
    turns = F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n")))
    r = rendered.select("conv_id", "formatted", parse(F.col("formatted")).alias("turns"), masked_text(F.col("formatted"), F.col("loss_mask")).alias("loss"))
    return r.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(F.array_join(turns, "").cast("binary"), 256).alias("turns_sha256"),
        F.length("loss").cast("long").alias("loss_chars"),
        F.sha2(F.col("loss").cast("binary"), 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
    )
