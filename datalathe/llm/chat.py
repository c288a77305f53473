"""Chat formatting: a finite-state machine over roles and a declarative template, in DataFrame functions alone.

A template names the marks around a turn, the roles that are trained on, and the machine: which
role leads from which state to which. A conversation's turns, ordered by turn number (ties by
role, then text), drive the machine; it is valid when it ends in an accepting state. Every
conversation is formatted, valid or not, as segments of text with a loss flag each: mark and role,
text, end mark. Only the text segments of trained roles carry loss.

Control strings inside roles and texts are escaped reversibly: a backslash is doubled, every ``##``
becomes ``#\\#``, the end mark gets a backslash after its first character, and a role's colon one
before it. So ``###`` and the end mark stand in no escaped text, and taking away one backslash
before any character restores it. Reading back splits at the end marks and undoes the escapes.

Null roles and texts count as empty, a null turn number sorts first, a null id is a conversation
of its own, repeated rows are repeated turns. Extra columns are ignored; an empty table gives
none. A conversation is one row of the result, so its turns meet in one task.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession, functions as F


@dataclass(frozen=True)
class Template:
    start: str = "### "
    after_role: str = ": "
    end: str = "</turn>\n"
    trained: tuple[str, ...] = ("assistant",)
    initial: str = "start"
    accepting: tuple[str, ...] = ("answered",)
    #: (state, role) to next state; whatever is not listed rejects the conversation.
    moves: dict[tuple[str, str], str] = field(
        default_factory=lambda: {
            ("start", "system"): "told",
            ("start", "user"): "asked",
            ("told", "user"): "asked",
            ("asked", "assistant"): "answered",
            ("answered", "user"): "asked",
        }
    )


_STOP = "</turn>"


def escaped(text: Column) -> Column:
    text = F.replace(text, F.lit("\\"), F.lit("\\\\"))
    text = F.replace(text, F.lit("##"), F.lit("#\\#"))
    return F.replace(text, F.lit(_STOP), F.lit(_STOP[0] + "\\" + _STOP[1:]))


def unescaped(text: Column) -> Column:
    return F.regexp_replace(text, r"(?s)\\(.)", "$1")


def final_state(roles: Column, template: Template) -> Column:
    """The machine's state after an array of roles; ``rejected`` once a move is missing."""
    pairs = [F.lit(x) for (state, role), to in template.moves.items() for x in (f"{state}\n{role}", to)]
    moves = F.create_map(*pairs)
    step = lambda state, role: F.coalesce(F.element_at(moves, F.concat(state, F.lit("\n"), role)), F.lit("rejected"))
    return F.aggregate(roles, F.lit(template.initial), step)


def segmented(
    df: DataFrame, template: Template = Template(), key: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text"
) -> DataFrame:
    """Per conversation: key, valid, state, and segments, an array of (text, loss)."""
    if not template.end.startswith(_STOP):
        raise ValueError(f"the end mark must start with {_STOP}")
    turns = df.select(
        F.col(f"`{key}`").alias("key"),
        F.struct(
            F.col(f"`{turn}`").alias("turn"),
            F.coalesce(F.col(f"`{role}`"), F.lit("")).alias("role"),
            F.coalesce(F.col(f"`{text}`"), F.lit("")).alias("text"),
        ).alias("turn"),
    )
    grouped = turns.groupBy("key").agg(F.array_sort(F.collect_list("turn")).alias("turns"))
    part = lambda text, loss: F.struct(text.alias("text"), loss.alias("loss"))

    def parts(t: Column) -> Column:
        name = F.replace(escaped(t["role"]), F.lit(":"), F.lit("\\:"))
        head = F.concat(F.lit(template.start), name, F.lit(template.after_role))
        return F.array(
            part(head, F.lit(False)), part(escaped(t["text"]), t["role"].isin(*template.trained)), part(F.lit(template.end), F.lit(False))
        )

    state = final_state(F.transform("turns", lambda t: t["role"]), template)
    return grouped.select(
        F.col("key").alias(key),
        state.alias("state"),
        state.isin(*template.accepting).alias("valid"),
        F.flatten(F.transform("turns", parts)).alias("segments"),
    )


def formatted(segments: Column) -> Column:
    return F.array_join(F.transform(segments, lambda s: s["text"]), "")


def read_back(text: Column, template: Template = Template()) -> Column:
    """The turns of a formatted conversation as an array of (role, text)."""
    pieces = F.split(text, re.escape(template.end))
    pieces = F.slice(pieces, 1, F.size(pieces) - 1)
    head = "(?s)^" + re.escape(template.start) + r"([^\\:]*+(?:\\.[^\\:]*+)*+)" + re.escape(template.after_role)

    def turn(piece: Column) -> Column:
        mark = F.regexp_extract(piece, head, 0)
        body = F.substring(piece, F.length(mark) + 1, F.length(piece))
        return F.struct(unescaped(F.regexp_extract(piece, head, 1)).alias("role"), unescaped(body).alias("text"))

    return F.transform(pieces, turn)


def probe(spark: SparkSession) -> DataFrame:
    """Conversation -7, whose texts hold the template's own marks."""
    said = F.lit("\\### Assistant: </turn> ok")
    roles = F.when(F.col("id") == 0, "user").otherwise("assistant")
    return spark.range(2).select(F.lit(-7).cast("long").alias("conv_id"), F.col("id").alias("turn"), roles.alias("role"), said.alias("text"))


def digests(df: DataFrame, template: Template = Template(), key: str = "conv_id") -> DataFrame:
    """What a reader of the formatted conversations gets back, as counts and digests."""
    whole = segmented(df, template, key).select(
        key,
        "valid",
        formatted(F.col("segments")).alias("formatted"),
        F.array_join(F.transform(F.filter("segments", lambda s: s["loss"]), lambda s: unescaped(s["text"])), "").alias("loss"),
    )
    turns = whole.withColumn("turns", read_back(F.col("formatted"), template))
    line = lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))
    return turns.select(
        key,
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(F.array_join(F.transform("turns", line), "").cast("binary"), 256).alias("turns_sha256"),
        F.length("loss").cast("long").alias("loss_chars"),
        F.sha2(F.col("loss").cast("binary"), 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
        "valid",
    )
