"""Chat formatting with built-in functions only.

A declarative template gives each turn's opening and closing marks and which roles carry the loss. A
finite-state machine over roles (its state is the role last seen) checks the order of turns. The
output is the formatted text, its segments with a loss flag each, and the machine's verdict. Escaping
replaces the template's control characters inside texts and roles, so the marks never occur in them
and reading back is exact: after escaping, a backslash always opens one of three two-character codes.

Defined results: null text and null role are empty; turns are ordered by turn (null first), then role
and text; a null conv_id is a conversation of its own; conversations in a wrong order are formatted
all the same and marked not valid; an empty table gives no rows.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Template:
    """opening + role + after_role + text + closing, for each turn."""

    opening: str = "### "
    after_role: str = ": "
    closing: str = "</turn>\n"
    loss_roles: tuple[str, ...] = ("assistant",)
    #: State (the last role, or start) -> roles that may follow; states in which a conversation may end.
    follows: dict[str, tuple[str, ...]] = field(default_factory=lambda: {"start": ("system", "user"), "system": ("user",), "user": ("assistant",), "assistant": ("user", "tool"), "tool": ("assistant",)})
    ends: tuple[str, ...] = ("assistant", "user")
    #: Control characters and the letter that stands for each after a backslash; the backslash is last to be read back.
    codes: tuple[tuple[str, str], ...] = (("#", "h"), ("<", "l"), (":", "c"))


DEFAULT = Template()


def escape(text: Column, template: Template = DEFAULT) -> Column:
    text = F.replace(text, F.lit("\\"), F.lit("\\b"))
    for char, letter in template.codes:
        text = F.replace(text, F.lit(char), F.lit("\\" + letter))
    return text


def unescape(text: Column, template: Template = DEFAULT) -> Column:
    for char, letter in template.codes:
        text = F.replace(text, F.lit("\\" + letter), F.lit(char))
    return F.replace(text, F.lit("\\b"), F.lit("\\"))


def _machine(roles: Column, template: Template) -> Column:
    """Final state of the machine over a list of roles; 'error' absorbs."""
    def step(state: Column, role: Column) -> Column:
        out = F.lit("error")
        for name, nexts in template.follows.items():
            out = F.when((state == name) & role.isin(*nexts), role).otherwise(out)
        return out

    return F.aggregate(roles, F.lit("start"), step)


def format_chats(turns: DataFrame, template: Template = DEFAULT, conv_id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """One row per conversation: conv_id, n_turns, segments (text, loss), formatted, state, valid.

    Marks are segments without loss; each text under a loss role is one segment with it.
    """
    # Written out before the shuffle; each map task sends one partial list per conversation.
    one = turns.select(F.col(conv_id).alias("conv_id"), F.struct(F.col(turn).alias("turn"), F.coalesce(role, F.lit("")).alias("role"), F.coalesce(text, F.lit("")).alias("text")).alias("t"))
    listed = one.groupBy("conv_id").agg(F.sort_array(F.collect_list("t")).alias("t"))
    marks = lambda x: F.concat(F.lit(template.opening), escape(x["role"], template), F.lit(template.after_role))
    segments = F.flatten(F.transform("t", lambda x: F.array(
        F.struct(marks(x).alias("text"), F.lit(False).alias("loss")),
        F.struct(escape(x["text"], template).alias("text"), x["role"].isin(*template.loss_roles).alias("loss")),
        F.struct(F.lit(template.closing).alias("text"), F.lit(False).alias("loss")),
    )))
    out = listed.select("conv_id", F.size("t").cast("long").alias("n_turns"), segments.alias("segments"), _machine(F.transform("t", lambda x: x["role"]), template).alias("state"))
    return out.select("conv_id", "n_turns", "segments", F.array_join(F.transform("segments", lambda s: s["text"]), "").alias("formatted"), "state", F.col("state").isin(*template.ends).alias("valid"))


def read_back(formatted: Column, template: Template = DEFAULT) -> Column:
    """The turns (role, text) of a formatted conversation: marks never occur inside escaped texts, so splitting at them is exact."""
    blocks = F.filter(F.split(formatted, "\\Q" + template.closing + "\\E", -1), lambda b: b != "")

    def turn(block: Column) -> Column:
        at = F.locate(template.after_role, block) if isinstance(block, str) else F.position(F.lit(template.after_role), block)
        return F.struct(
            unescape(F.substring(block, F.lit(len(template.opening) + 1), at - len(template.opening) - 1), template).alias("role"),
            unescape(F.substring(block, at + len(template.after_role), F.length(block)), template).alias("text"),
        )

    return F.transform(blocks, turn)
