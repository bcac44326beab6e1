r"""Chat formatting: a declared state machine over roles, and text segments with loss flags.

A conversation's rows are ordered by turn. The machine of the template reads the roles
and tells whether their order is allowed; the first row that it can't read is reported.
Every turn gives three segments: the head with the role, the text, the end. Only texts
of the template's loss roles carry the loss flag.

All control strings of a template begin with ``<|``. Inside roles and texts a backslash
becomes two and ``<|`` becomes ``<\|``, so no control string can occur there, and
dropping one backslash before every escaped character gives the text back.

Defined cases: a null role or text is an empty one; rows with equal turns are ordered by
role, then text, nulls first, as are null turns; a null conversation id is one
conversation of its own; a conversation whose order is not allowed is formatted all the
same, with ``valid`` false; an empty table gives no rows; columns other than the four
named are not looked at. A conversation is one value of the result, so it has to fit
into a row; its rows are gathered by one aggregate and nothing else is grouped.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class ChatTemplate:
    """Control strings, roles whose text is learned, and the machine over roles."""

    turn: str = "<|turn|>"
    text: str = "<|text|>"
    end: str = "<|end|>"
    loss_roles: tuple[str, ...] = ("assistant",)
    start: str = "start"
    # (state, role) -> state
    transitions: dict[tuple[str, str], str] = field(
        default_factory=lambda: {
            ("start", "system"): "system",
            ("start", "user"): "user",
            ("system", "user"): "user",
            ("user", "assistant"): "assistant",
            ("assistant", "user"): "user",
        }
    )
    # States in which a conversation is complete.
    final: tuple[str, ...] = ("assistant",)

    def __post_init__(self):
        marks = (self.turn, self.text, self.end)
        if len(set(marks)) < 3 or any("<|" not in m[:2] or "<|" in m[1:] for m in marks):
            raise ValueError("control strings must differ and have '<|' at the beginning only")


TEMPLATE = ChatTemplate()


def escape(text: Column) -> Column:
    return F.replace(F.replace(text, F.lit("\\"), F.lit("\\\\")), F.lit("<|"), F.lit("<\\|"))


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"\\([\\|])", "$1")


def _read_roles(turns: Column, template: ChatTemplate) -> Column:
    """``struct<state, bad>``: the last state, and the position of the first unreadable role."""
    moves = F.create_map(
        *[F.lit(x) for (a, role), b in template.transitions.items() for x in (f"{a}\n{role}", b)]
    )

    def step(done: Column, turn: Column) -> Column:
        state = F.element_at(moves, F.concat(done["state"], F.lit("\n"), turn["role"]))
        kept = F.when(done["bad"].isNull(), state)
        return F.struct(
            F.coalesce(kept, done["state"]).alias("state"),
            F.coalesce(done["bad"], F.when(kept.isNull(), done["at"])).alias("bad"),
            (done["at"] + 1).alias("at"),
        )

    begin = F.struct(
        F.lit(template.start).alias("state"),
        F.lit(None).cast("int").alias("bad"),
        F.lit(0).alias("at"),
    )
    return F.aggregate(turns, begin, step)


def format_chats(
    rows: DataFrame,
    template: ChatTemplate = TEMPLATE,
    conv_col: str = "conv_id",
    turn_col: str = "turn",
    role_col: str = "role",
    text_col: str = "text",
) -> DataFrame:
    """``(conv, valid, complete, bad_turn, segments array<text, loss>)`` per conversation.

    ``bad_turn`` counts from 0. The formatted text is the segments joined.
    """
    row = F.struct(
        F.col(turn_col).alias("turn"), F.col(role_col).alias("role"), F.col(text_col).alias("text")
    )
    turns = F.transform(
        F.sort_array(F.collect_list(row)),
        lambda t: F.struct(
            F.coalesce(t["role"], F.lit("")).alias("role"),
            F.coalesce(t["text"], F.lit("")).alias("text"),
        ),
    )
    chats = rows.groupBy(F.col(conv_col).alias(conv_col)).agg(turns.alias("_turns"))
    chats = chats.withColumn("_read", _read_roles(F.col("_turns"), template))

    def segment(text: Column, loss: Column) -> Column:
        return F.struct(text.alias("text"), loss.alias("loss"))

    segments = F.flatten(
        F.transform(
            "_turns",
            lambda t: F.array(
                segment(
                    F.concat(F.lit(template.turn), escape(t["role"]), F.lit(template.text)),
                    F.lit(False),
                ),
                segment(escape(t["text"]), t["role"].isin(*template.loss_roles)),
                segment(F.lit(template.end), F.lit(False)),
            ),
        )
    )
    return chats.select(
        conv_col,
        F.col("_read.bad").isNull().alias("valid"),
        (F.col("_read.bad").isNull() & F.col("_read.state").isin(*template.final)).alias(
            "complete"
        ),
        F.col("_read.bad").alias("bad_turn"),
        segments.alias("segments"),
    )


def formatted(segments: Column | str = "segments") -> Column:
    return F.array_join(F.transform(segments, lambda s: s["text"]), "")


def loss_text(segments: Column | str = "segments") -> Column:
    """What a model learns from: the texts under the loss mask, unescaped and joined."""
    learned = F.filter(segments, lambda s: s["loss"])
    return F.array_join(F.transform(learned, lambda s: unescape(s["text"])), "")


def read_turns(text: Column, template: ChatTemplate = TEMPLATE) -> Column:
    """``array<struct<role, text>>`` read back from a formatted text."""

    def between(part: Column, at: int) -> Column:
        return unescape(F.get(F.split(part, re.escape(template.text), 2), F.lit(at)))

    parts = F.split(text, re.escape(template.turn), -1)
    # What stands before the first turn is empty.
    return F.transform(
        F.slice(parts, F.lit(2), F.greatest(F.size(parts) - 1, F.lit(0))),
        lambda p: F.struct(
            between(p, 0).alias("role"),
            between(F.substring_index(p, template.end, 1), 1).alias("text"),
        ),
    )


def chat_report(chats: DataFrame, template: ChatTemplate = TEMPLATE, conv_col: str = "conv_id"):
    """Digests of what is read back from the formatted text and from the loss mask."""
    texts = chats.select(
        conv_col, "valid", formatted().alias("formatted"), loss_text().alias("loss")
    )
    turns = texts.withColumn("turns", read_turns(F.col("formatted"), template))
    said = F.array_join(
        F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))),
        "",
    )
    return turns.select(
        conv_col,
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(said, 256).alias("turns_sha256"),
        F.length("loss").cast("long").alias("loss_chars"),
        F.sha2("loss", 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
        "valid",
    )
