r"""Chat formatting by event sourcing, in DataFrame functions only.

A log holds events (conv_id, seq, kind, message, role, text): `message` begins a message with its text, `delta` appends to it (a
streamed piece), `edit` replaces its text, `regenerate` begins its text anew (deltas may follow), `delete` removes it.
Events are gathered by conversation and message, ordered by seq and folded; messages, ordered by when they began, are rendered.

Template: `### role: text</turn>` and a line feed for each message. In texts `\`, `#` and `<` are written `\b`, `\h` and `\l`
(in roles `:` and a line feed too, as `\c` and `\n`), so no control string can occur inside one, and reading back is exact.
The loss mask is the list of the output's stretches with their lengths: only assistants' texts carry loss.

One conversation is one output row, so its events meet in one task: that is what the result is, not a choice of this code.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

END = "</turn>\n"
KINDS = ("message", "delta", "edit", "regenerate", "delete")


def escaped(text: Column) -> Column:
    out = F.replace(text, F.lit("\\"), F.lit("\\b"))
    out = F.replace(out, F.lit("#"), F.lit("\\h"))
    return F.replace(out, F.lit("<"), F.lit("\\l"))


def unescaped(text: Column) -> Column:
    out = F.replace(text, F.lit("\\l"), F.lit("<"))
    out = F.replace(out, F.lit("\\h"), F.lit("#"))
    return F.replace(out, F.lit("\\b"), F.lit("\\"))


def escaped_role(role: Column) -> Column:
    return F.replace(F.replace(escaped(role), F.lit(":"), F.lit("\\c")), F.lit("\n"), F.lit("\\n"))


def unescaped_role(role: Column) -> Column:
    return unescaped(F.replace(F.replace(role, F.lit("\\n"), F.lit("\n")), F.lit("\\c"), F.lit(":")))


def events_of_rows(rows: DataFrame) -> DataFrame:
    """The log of a table that has one finished message in each row (conv_id, turn, role, text): a `message` event for each row, its turn the sequence number.

    Every row is a message of its own, also where rows share a turn or repeat each other.
    """
    return rows.select("conv_id", F.col("turn").alias("seq"), F.lit("message").alias("kind"), F.monotonically_increasing_id().alias("message"), "role", "text")


def fold_events(events: DataFrame) -> DataFrame:
    """(conv_id, messages array<struct<role, text>>) of a log; columns beside the six named above are ignored.

    Messages are ordered by their first event's seq (nulls first), then role and text.

    Events of one message are ordered by seq, then kind and text, so repeated events and ties fold alike on every run; an event that comes
    twice counts twice. Unknown kinds, and events without a message id, are ignored. A null text is empty, a null role is taken from the
    message's first event that has one, else empty. A delta before any `message` begins the message. Deleted messages do not appear.
    """
    # dealt by conversation once; both groupings below find a conversation's events in one place
    known = events.where(F.col("kind").isin(*KINDS) & F.col("message").isNotNull()).repartition("conv_id")
    step = F.struct(
        F.coalesce(F.col("seq").cast("long"), F.lit(-(2**63))).alias("seq"), F.col("kind").alias("kind"), F.coalesce("text", F.lit("")).alias("text"), F.col("role").alias("role")
    )
    by_message = known.groupBy("conv_id", "message").agg(F.array_sort(F.collect_list(step)).alias("steps"))
    # only what follows the last event that sets the text matters, so long streams of deltas are joined once
    resets = F.filter("steps", lambda s: s["kind"] != "delta")
    last = F.array_max(F.transform(resets, lambda s: F.struct(s["seq"].alias("seq"), s["kind"].alias("kind"))))
    live = F.filter("steps", lambda s: last.isNull() | (F.struct(s["seq"].alias("seq"), s["kind"].alias("kind")) >= last) | ((s["kind"] == "delta") & (s["seq"] >= last["seq"])))
    # at one seq a delta counts as following the event that sets the text
    setting = F.filter(live, lambda s: s["kind"] != "delta")
    deltas = F.array_join(F.transform(F.filter(live, lambda s: s["kind"] == "delta"), lambda s: s["text"]), "")
    folded = by_message.select(
        "conv_id", F.col("steps")[0]["seq"].alias("began"), "message", F.coalesce(F.get(F.filter(F.transform("steps", lambda s: s["role"]), lambda r: r.isNotNull()), F.lit(0)), F.lit("")).alias("role"),
        F.concat(F.coalesce(F.try_element_at(setting, F.lit(-1))["text"], F.lit("")), deltas).alias("text"),
        F.coalesce(last["kind"] == "delete", F.lit(False)).alias("gone"),
    )
    item = F.struct("began", "role", "text", F.col("message").cast("string").alias("message"))
    whole = folded.where(~F.col("gone")).groupBy("conv_id").agg(F.array_sort(F.collect_list(item)).alias("m"))
    return whole.select("conv_id", F.transform("m", lambda x: F.struct(x["role"].alias("role"), x["text"].alias("text"))).alias("messages"))


def render(folded: DataFrame) -> DataFrame:
    """(conv_id, formatted, mask): the output text and its stretches as array<struct<chars, loss>>, three for each message."""
    pieces = F.transform("messages", lambda m: F.struct(F.concat(F.lit("### "), escaped_role(m["role"]), F.lit(": ")).alias("head"), escaped(m["text"]).alias("body"), (m["role"] == "assistant").alias("loss")))
    stretch = lambda chars, loss: F.struct(chars.cast("int").alias("chars"), loss.alias("loss"))
    return folded.select("conv_id", pieces.alias("p")).select(
        "conv_id",
        F.array_join(F.transform("p", lambda x: F.concat(x["head"], x["body"], F.lit(END))), "").alias("formatted"),
        F.flatten(F.transform("p", lambda x: F.array(stretch(F.length(x["head"]), F.lit(False)), stretch(F.length(x["body"]), x["loss"]), stretch(F.lit(len(END)), F.lit(False))))).alias("mask"),
    )


def read_back(rendered: DataFrame) -> DataFrame:
    """(conv_id, turns array<struct<role, text, loss>>, formatted) parsed from the output text and its mask alone.

    A turn's text is under the mask if the stretch at its place carries loss; the mask's lengths must fit the text, else the row fails.
    """
    lines = F.slice(F.split("formatted", END, -1), 1, F.size(F.split("formatted", END, -1)) - 1)
    split = rendered.select("conv_id", "formatted", "mask", lines.alias("lines"))
    head = F.transform("lines", lambda line: F.substring_index(line, ": ", 1))
    parsed = split.withColumn("heads", head)
    zipped = F.transform(
        F.arrays_zip("lines", "heads"),
        lambda x: F.struct(
            unescaped_role(F.substring(x["heads"], F.lit(5), F.length(x["heads"]))).alias("role"),
            F.substring(x["lines"], F.length(x["heads"]) + 3, F.length(x["lines"])).alias("body"),
            (F.length(x["heads"]) + 2).alias("head_chars"),
        ),
    )
    turns = F.transform(
        "z",
        lambda t, i: F.struct(
            t["role"].alias("role"), unescaped(t["body"]).alias("text"),
            F.when((F.col("mask")[i * 3]["chars"] == t["head_chars"]) & (F.col("mask")[i * 3 + 1]["chars"] == F.length(t["body"])), F.col("mask")[i * 3 + 1]["loss"]).otherwise(
                F.raise_error(F.lit("the mask does not fit the text")).cast("boolean")).alias("loss"),
        ),
    )
    return parsed.withColumn("z", zipped).select("conv_id", turns.alias("turns"), "formatted")
