"""Chat formatting by a declarative template, and reading the output back.

A template names for every role what stands before its text and whether the text counts for the loss; unknown roles
get ``other`` with the escaped role in it. A finite-state machine over roles tells whether the turns come in a valid
order. Only SQL functions are used: a conversation is one row of the result, so its turns meet in one array and
everything after that is an expression on this row.

Control strings inside texts are broken by a backslash after their first character and backslashes are doubled, so the
output can be read back without loss: a backslash that is not doubled is never part of a text.

Defined cases: null text and null role are empty; turns are ordered by (turn, role, text), null turns first; rows with
null ``conv_id`` form one conversation; repeated rows are turns of their own; no rows give no rows; other columns are
ignored.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Template:
    """What surrounds texts, which roles are learned, and which role may follow which."""

    headers: dict[str, str] = field(
        default_factory=lambda: {"system": "### System: ", "user": "### User: ", "assistant": "### Assistant: "}
    )
    other: tuple[str, str] = ("### Role ", "</role>")
    end: str = "</turn>\n"
    learned: tuple[str, ...] = ("assistant",)
    #: state -> {role: next state}; a missing move is an invalid order, ``final`` states may end a conversation.
    moves: dict[str, dict[str, str]] = field(
        default_factory=lambda: {
            "start": {"system": "ready", "user": "asked"},
            "ready": {"user": "asked"},
            "asked": {"assistant": "answered"},
            "answered": {"user": "asked"},
        }
    )
    final: tuple[str, ...] = ("answered",)
    #: Whatever of these appears in a text or role is escaped; none may hold a backslash.
    controls: tuple[str, ...] = ("### ", "</turn>", "</role>")


CHAT = Template()


def _controls(template: Template) -> str:
    quoted = "|".join("(?<=" + _q(c[0]) + ")(?=" + _q(c[1:]) + ")" for c in template.controls)
    return quoted


def _q(text: str) -> str:
    return "".join("\\" + c if c in "\\^$.|?*+()[]{}-#&~/<>" else c for c in text)


def escape(text: Column, template: Template = CHAT) -> Column:
    """Double backslashes, then put one after the first character of each control string."""
    doubled = F.replace(text, F.lit("\\"), F.lit("\\\\"))
    return F.regexp_replace(doubled, F.lit(_controls(template)), F.lit("\\\\"))


def unescape(text: Column) -> Column:
    """Undo ``escape``: of each run of backslashes, every second one stays."""
    return F.regexp_replace(text, F.lit(r"\\(\\?)"), F.lit("$1"))


def _header(role: Column, template: Template) -> Column:
    known = F.element_at(F.create_map(*[F.lit(x) for kv in template.headers.items() for x in kv]), role)
    named = F.concat(F.lit(template.other[0]), escape(role, template), F.lit(template.other[1]))
    return F.coalesce(known, named)


def _order_state(turns: Column, template: Template) -> Column:
    """The state after the last turn; ``invalid`` once a move is missing."""
    moves = {f"{s}>{r}": to for s, row in template.moves.items() for r, to in row.items()}
    table = F.create_map(*[F.lit(x) for kv in moves.items() for x in kv])
    step = lambda state, t: F.coalesce(F.element_at(table, F.concat(state, F.lit(">"), t["role"])), F.lit("invalid"))
    return F.aggregate(turns, F.lit("start"), step)


def format_chats(turns: DataFrame, template: Template = CHAT) -> DataFrame:
    """(conv_id, formatted, segments, valid) of ``turns`` (conv_id, turn, role, text).

    ``segments`` is array<struct<start, length, loss>> over code points of ``formatted``: header, text and end of each
    turn, with the loss flag on texts of learned roles only.
    """
    learned = [F.lit(r) for r in template.learned]
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    parts = turns.select("conv_id", "turn", role.alias("role"), text.alias("text")).select(
        "*",
        _header(F.col("role"), template).alias("head"),
        escape(F.col("text"), template).alias("body"),
        F.col("role").isin(*learned).alias("loss"),
    )
    size = F.length("head") + F.length("body") + F.lit(len(template.end))
    order = Window.partitionBy("conv_id").orderBy("turn", "role", "text")
    placed = parts.select(
        "conv_id",
        F.struct(
            F.row_number().over(order).alias("n"),
            (F.sum(size).over(order.rowsBetween(Window.unboundedPreceding, 0)) - size).alias("at"),
            "role", "head", "body", "loss",
        ).alias("t"),
    )
    packed = placed.groupBy("conv_id").agg(F.sort_array(F.collect_list("t")).alias("turns"))
    ends = F.array(*[F.lit(s) for s in template.final])

    def segments(t: Column) -> Column:
        head, body = F.length(t["head"]).cast("long"), F.length(t["body"]).cast("long")
        return F.array(
            F.struct(t["at"].alias("start"), head.alias("length"), F.lit(False).alias("loss")),
            F.struct((t["at"] + head).alias("start"), body.alias("length"), t["loss"].alias("loss")),
            F.struct((t["at"] + head + body).alias("start"), F.lit(len(template.end)).cast("long").alias("length"), F.lit(False).alias("loss")),
        )

    whole = F.transform("turns", lambda t: F.concat(t["head"], t["body"], F.lit(template.end)))
    return packed.select(
        "conv_id",
        F.concat_ws("", whole).alias("formatted"),
        F.flatten(F.transform("turns", segments)).alias("segments"),
        F.array_contains(ends, _order_state(F.col("turns"), template)).alias("valid"),
    )


def read_turns(formatted: Column, template: Template = CHAT) -> Column:
    """array<struct<role, text>> of an output, from its characters alone."""
    pieces = F.filter(F.split(formatted, _q(template.end[:-1]) + "\\n"), lambda p: F.length(p) > 0)
    opening, closing = template.other

    def turn(piece: Column) -> Column:
        cut = F.locate(closing, piece)
        first = F.lit(len(opening) + 1)
        role = F.when(piece.startswith(opening), unescape(F.substring(piece, first, cut - first)))
        text = F.when(piece.startswith(opening), F.substring(piece, cut + F.lit(len(closing)), F.length(piece)))
        for name, header in template.headers.items():
            role = F.when(piece.startswith(header), F.lit(name)).otherwise(role)
            text = F.when(piece.startswith(header), F.substring(piece, F.lit(len(header) + 1), F.length(piece))).otherwise(text)
        return F.struct(role.alias("role"), unescape(text).alias("text"))

    return F.transform(pieces, turn)


def loss_text(formatted: Column, segments: Column) -> Column:
    """All text under the loss mask, unescaped, in order."""
    learned = F.filter(segments, lambda s: s["loss"])
    cut = lambda s: unescape(F.substring(formatted, (s["start"] + 1).cast("int"), s["length"].cast("int")))
    return F.concat_ws("", F.transform(learned, cut))


def digests(formatted: DataFrame, template: Template = CHAT) -> DataFrame:
    """One row of counts and digests per output of ``format_chats``, read back from it."""
    read = formatted.select(
        "conv_id",
        "formatted",
        "valid",
        read_turns(F.col("formatted"), template).alias("turns"),
        loss_text(F.col("formatted"), F.col("segments")).alias("loss"),
    )
    line = lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))
    return read.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(F.concat_ws("", F.transform("turns", line)), 256).alias("turns_sha256"),
        F.length("loss").cast("long").alias("loss_chars"),
        F.sha2("loss", 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
        "valid",
    )
