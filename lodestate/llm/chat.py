"""Chat formatting with DataFrame functions only.

A declarative template names the control strings, the roles whose text counts for the loss, and the turn order as a
finite-state machine over roles. Conversations become segments (text, loss flag) whose concatenation is the formatted
text; control strings inside texts are escaped, so that the turns can be read back from it.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Template:
    """Control strings, loss roles and the role machine: transitions[state][role] = next state; missing: out of order."""

    opening: str = "### "
    after_role: str = ": "
    closing: str = " </turn>\n"
    loss_roles: tuple[str, ...] = ("assistant",)
    start: str = "start"
    final: tuple[str, ...] = ("answered",)
    transitions: dict[str, dict[str, str]] = field(
        default_factory=lambda: {
            "start": {"system": "primed", "user": "asked"},
            "primed": {"user": "asked"},
            "asked": {"assistant": "answered", "tool": "asked"},
            "answered": {"user": "asked", "tool": "asked"},
        }
    )
    #: (plain, escaped) in the order in which they are escaped; unescaping goes backwards. Every backslash in an escaped
    #: text begins one of these, and none of the control strings' cores is left.
    escapes: tuple[tuple[str, str], ...] = (("\\", "\\b"), ("###", "\\h"), ("</turn>", "\\t"), (": ", "\\c"))


    def __post_init__(self) -> None:
        """Refuses templates whose formatted texts could not be read back."""
        plain, escaped = zip(*self.escapes, strict=True)
        if plain[0] != "\\" or any(len(e) != 2 or e[0] != "\\" for e in escaped) or len(set(escaped)) != len(escaped):
            raise ValueError("escapes must begin with the backslash's own and be a backslash and a letter each")
        if any("\\" in p or any(p.startswith(e[1]) for e in escaped[:i]) for i, p in enumerate(plain) if i):
            raise ValueError("no escaped string may hold a backslash or begin with the letter of an escape before it")
        for control in (self.opening, self.after_role, self.closing):
            if not any(p in control for p in plain[1:]):
                raise ValueError(f"nothing in {control!r} is escaped inside texts")
        if not any(self.after_role == p for p in plain):
            raise ValueError("the string behind a role must be escaped as a whole, as texts and roles may hold parts of it")


CHAT = Template()


def _replace_all(text: Column, pairs) -> Column:
    for old, new in pairs:
        text = F.replace(text, F.lit(old), F.lit(new))
    return text


def escape(text: Column, template: Template = CHAT) -> Column:
    return _replace_all(text, template.escapes)


def unescape(text: Column, template: Template = CHAT) -> Column:
    return _replace_all(text, [(new, old) for old, new in reversed(template.escapes)])


def _machine(turns: Column, template: Template) -> Column:
    """The state after all turns, null if one is out of order."""
    table = {f"{state}\n{role}": after for state, roles in template.transitions.items() for role, after in roles.items()}
    arcs = F.create_map(*[F.lit(x) for pair in table.items() for x in pair])
    step = lambda state, turn: F.try_element_at(arcs, F.concat(state, F.lit("\n"), turn["role"]))
    return F.aggregate(turns, F.lit(template.start), step)


def format_chats(turns: DataFrame, *, conversation: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text", template: Template = CHAT) -> DataFrame:
    """One row for each conversation: conv_id, n_turns, in_order, segments (array of text and loss flag), formatted.

    Rows go by turn; equal turn numbers by role, then text (repeated rows are turns of their own). Null roles and texts
    count as empty; a null turn number comes first; a row without a conversation is one of its own (equal ones together),
    so that such rows make no endless text. Conversations out
    of order are formatted as well, with in_order false. Other columns are left out, so their names can't clash.
    """
    rows = turns.select(
        F.col(conversation).alias("conv_id"),
        F.struct(F.col(turn).alias("turn"), F.coalesce(F.col(role), F.lit("")).alias("role"), F.coalesce(F.col(text), F.lit("")).alias("text")).alias("t"),
    )
    alone = F.when(F.col("conv_id").isNull(), F.col("t"))
    chats = rows.groupBy("conv_id", alone.alias("_alone")).agg(F.array_sort(F.collect_list("t")).alias("turns"))

    def segments(t: Column) -> Column:
        # the role's own separator is escaped in roles and texts alike
        head = F.concat(F.lit(template.opening), escape(t["role"], template), F.lit(template.after_role))
        return F.array(
            F.struct(head.alias("text"), F.lit(False).alias("loss")),
            F.struct(escape(t["text"], template).alias("text"), t["role"].isin(*template.loss_roles).alias("loss")),
            F.struct(F.lit(template.closing).alias("text"), F.lit(False).alias("loss")),
        )

    state = _machine(F.col("turns"), template)
    return chats.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.coalesce(state.isin(*template.final), F.lit(False)).alias("in_order"),
        F.flatten(F.transform("turns", segments)).alias("segments"),
    ).withColumn("formatted", F.array_join(F.transform("segments", lambda s: s["text"]), ""))


def read_turns(formatted: Column, template: Template = CHAT) -> Column:
    """The turns of a formatted text: array of (role, text), unescaped."""
    parts = F.split(formatted, _quoted(template.closing), -1)
    whole = F.slice(parts, 1, F.size(parts) - 1)
    head = len(template.opening)

    def turn(part: Column) -> Column:
        at = F.instr(part, template.after_role)
        return F.struct(
            unescape(F.substr(part, F.lit(head + 1), at - head - 1), template).alias("role"),
            unescape(F.substr(part, at + len(template.after_role)), template).alias("text"),
        )

    return F.transform(whole, turn)


def _quoted(text: str) -> str:
    """A regular expression for the text itself."""
    return "\\Q" + text + "\\E"


def loss_text(turns: Column, template: Template = CHAT) -> Column:
    """All text under the loss mask, of turns as ``read_turns`` gives them: each loss role's text once, in order, nothing between."""
    return F.array_join(F.transform(F.filter(turns, lambda t: t["role"].isin(*template.loss_roles)), lambda t: t["text"]), "")
