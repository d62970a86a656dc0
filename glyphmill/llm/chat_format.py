"""Chat formatting (operator 7): a finite-state machine over roles and a declarative template, DataFrame functions only.

A template gives each role its opening and closing mark and a loss flag.  Each turn becomes three segments: mark, text,
mark.  Inside texts the characters that marks are made of are escaped, so no text can hold a mark, and the formatted
string alone can be read back into the turns.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Escapes, in the order in which they are applied; undone in reverse order.  Each tilde in an escaped text is followed by
#: a digit, so plain replacement is unambiguous.
ESCAPES = (("~", "~0"), ("<", "~1"), ("[", "~2"), ("]", "~3"))
_PLAIN = r"[^<\[\]]*+"


@dataclass(frozen=True)
class Role:
    name: str
    opening: str
    closing: str
    loss: bool = False


@dataclass(frozen=True)
class Template:
    """Marks by role, marks of all other roles (the escaped name goes between `other_opening` and a bracket), and the
    transitions of the turn-order machine: state and role to next state."""

    roles: tuple[Role, ...]
    other_opening: str
    other_closing: str
    transitions: tuple[tuple[str, str, str], ...]
    accepting: tuple[str, ...]


INSTRUCT = Template(
    roles=(Role("system", "<<SYS>>", "<</SYS>>\n"), Role("user", "[INST]", "[/INST]"), Role("assistant", "<s>", "</s>", loss=True)),
    other_opening="[ROLE ",
    other_closing="[/ROLE]",
    transitions=(
        ("start", "system", "system"), ("start", "user", "user"), ("system", "user", "user"), ("user", "assistant", "assistant"), ("assistant", "user", "user"),
    ),
    accepting=("assistant",),
)


def escape(text: Column) -> Column:
    return reduce(lambda c, e: F.replace(c, F.lit(e[0]), F.lit(e[1])), ESCAPES, text)


def unescape(text: Column) -> Column:
    return reduce(lambda c, e: F.replace(c, F.lit(e[1]), F.lit(e[0])), reversed(ESCAPES), text)


def _chosen(template: Template, role: Column, of, other: Column) -> Column:
    return reduce(lambda c, r: F.when(role == r.name, of(r)).otherwise(c), reversed(template.roles), other)


def _segments(template: Template, turn: Column) -> Column:
    role = turn["role"]
    other = F.concat(F.lit(template.other_opening), escape(F.coalesce(role, F.lit(""))), F.lit("]"))
    opening = _chosen(template, role, lambda r: F.lit(r.opening), other)
    closing = _chosen(template, role, lambda r: F.lit(r.closing), F.lit(template.other_closing))
    loss = _chosen(template, role, lambda r: F.lit(r.loss), F.lit(False))
    piece = lambda text, flag: F.struct(text.alias("text"), flag.alias("loss"))
    return F.array(piece(opening, F.lit(False)), piece(escape(turn["text"]), loss), piece(closing, F.lit(False)))


def _next_state(template: Template, state: Column, role: Column) -> Column:
    out = F.lit("error")
    for at, by, to in template.transitions:
        out = F.when((state == at) & F.coalesce(role == by, F.lit(False)), F.lit(to)).otherwise(out)
    return out


def format_chats(
    rows: DataFrame, template: Template = INSTRUCT, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text",
) -> DataFrame:
    """One row per conversation: `(conv_id, segments, formatted, state, valid)`.

    Turns stand by `turn_col`, ties by role and text, null turns first; repeated rows are turns of their own.  Null
    texts are empty, null roles have an empty name; rows with a null id form one conversation.  A conversation out of
    order is formatted all the same, with state `error` and `valid` false; `valid` needs an accepting last state.  Extra
    columns are ignored; an empty table gives an empty result.
    """
    turn = F.struct(F.col(turn_col).alias("turn"), F.col(role_col).cast("string").alias("role"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    turns = rows.select(F.col(conv_col).alias("conv_id"), turn.alias("t")).groupBy("conv_id").agg(F.sort_array(F.collect_list("t")).alias("turns"))
    out = turns.select(
        "conv_id",
        F.flatten(F.transform("turns", lambda t: _segments(template, t))).alias("segments"),
        F.aggregate("turns", F.lit("start"), lambda s, t: _next_state(template, s, t["role"])).alias("state"),
    )
    return out.select(
        "conv_id", "segments", F.array_join(F.transform("segments", lambda s: s["text"]), "").alias("formatted"), "state", F.col("state").isin(*template.accepting).alias("valid")
    )


def _quoted(text: str) -> str:
    return "".join(f"\\{c}" if c in r"\[](){}.*+?^$|" else c for c in text)


def read_back(formatted: Column, template: Template = INSTRUCT) -> Column:
    """Turns of a formatted string, as an array of (role, text)."""
    marks = [_quoted(r.opening) for r in template.roles]
    pattern = f"({'|'.join(marks)}|{_quoted(template.other_opening)}{_PLAIN}\\])({_PLAIN})"
    name = lambda mark: reduce(
        lambda c, r: F.when(mark == r.opening, F.lit(r.name)).otherwise(c),
        reversed(template.roles),
        unescape(F.substr(mark, F.lit(len(template.other_opening) + 1), F.length(mark) - len(template.other_opening) - 1)),
    )
    opened = F.regexp_extract_all(formatted, F.lit(pattern), F.lit(1))
    texts = F.regexp_extract_all(formatted, F.lit(pattern), F.lit(2))
    return F.zip_with(opened, texts, lambda mark, text: F.struct(name(mark).alias("role"), unescape(text).alias("text")))


def loss_text(segments: Column) -> Column:
    """All text under the loss mask, unescaped."""
    return F.array_join(F.transform(F.filter(segments, lambda s: s["loss"]), lambda s: unescape(s["text"])), "")
