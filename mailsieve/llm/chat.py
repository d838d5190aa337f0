"""Chat formatting by a declarative template, with DataFrame functions only.

A finite-state machine over the roles checks the order of the turns; the
template makes three segments of each turn (head, text, tail), each with a flag
that says whether it counts in the loss.  Control strings inside roles and
texts are made harmless reversibly: every backslash is doubled, and one is put
after the first character of each control string.

Turns are gathered in two steps, so that a very long conversation is not dealt
to one task as rows: ``turns_per_part`` neighbouring turns become one part, with
the states that the machine goes to from each state, and the parts of a
conversation are then put in a row.  Only the finished text of a conversation,
which is one value of the result, is in one place.

Defined cases: a null role or text is empty; turns are in the order of turn,
role and text, null turns first, so ties and repeated rows have one place and
are all kept; rows with a null conversation make one conversation; an unknown
role is formatted like any other and makes the conversation invalid; extra
columns are ignored.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Template:
    head: str = "<|im_start|>"
    sep: str = "<|im_sep|>"
    tail: str = "<|im_end|>\n"
    loss_roles: tuple[str, ...] = ("assistant",)
    #: Further strings that a model or another template may take for control.
    control: tuple[str, ...] = ("<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>", "<|endoftext|>", "<|startoftext|>")
    start: str = "start"
    #: (state, role): next state; what is missing is an error.
    moves: tuple[tuple[str, str, str], ...] = (
        ("start", "system", "told"),
        ("start", "user", "asked"),
        ("told", "user", "asked"),
        ("asked", "assistant", "answered"),
        ("answered", "user", "asked"),
    )
    accepts: tuple[str, ...] = ("asked", "answered")

    def __post_init__(self) -> None:
        for c in self.controls():
            if len(c) < 2 or "\\" in c:
                raise ValueError(f"not usable as a control string: {c!r}")

    def controls(self) -> list[str]:
        return sorted({self.head, self.sep, self.tail.strip(), *self.control})

    def states(self) -> list[str]:
        return sorted({self.start, *(m[0] for m in self.moves), *(m[2] for m in self.moves)})


ERROR = "error"


def escaped(c: Column, template: Template) -> Column:
    starts = "|".join(re.escape(x) for x in template.controls()).replace("/", "\\/")
    doubled = F.replace(c, F.lit("\\"), F.lit("\\\\"))
    return F.regexp_replace(doubled, f"(?s)(?={starts})(.)", "$1\\\\")


def unescaped(c: Column) -> Column:
    return F.regexp_replace(c, r"\\(\\?)", "$1")


def turn_segments(conversations: DataFrame, template: Template = Template()) -> DataFrame:
    """One row per turn: ``conv_id``, ``turn``, ``role``, ``text`` and ``segments``, an array of text and loss flag."""
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    no = F.lit(False)
    segments = F.array(
        F.struct(F.concat(F.lit(template.head), escaped(role, template), F.lit(template.sep)).alias("text"), no.alias("loss")),
        F.struct(escaped(text, template).alias("text"), role.isin(*template.loss_roles).alias("loss")),
        F.struct(F.lit(template.tail).alias("text"), no.alias("loss")),
    )
    return conversations.select("conv_id", "turn", role.alias("role"), text.alias("text"), segments.alias("segments"))


def format_conversations(conversations: DataFrame, template: Template = Template(), *, turns_per_part: int = 256) -> DataFrame:
    """One row per conversation: ``conv_id``, ``n_turns``, ``valid``, ``segments`` and ``formatted``."""
    states = template.states()
    delta = F.create_map(*(F.lit(x) for s, r, t in template.moves for x in (f"{s}\n{r}", t)))
    step = lambda state, role: F.coalesce(F.try_element_at(delta, F.concat(state, F.lit("\n"), role)), F.lit(ERROR))
    turns = turn_segments(conversations, template)
    order = F.floor(F.col("turn") / turns_per_part)
    parts = (
        turns.groupBy("conv_id", order.alias("part"))
        .agg(F.sort_array(F.collect_list(F.struct("turn", "role", "text", "segments"))).alias("t"))
        .select(
            "conv_id",
            "part",
            F.size("t").cast("long").alias("n"),
            F.map_from_arrays(F.array(*map(F.lit, states)), F.array(*(F.aggregate("t.role", F.lit(s), step) for s in states))).alias("move"),
            F.flatten("t.segments").alias("segments"),
        )
    )
    whole = parts.groupBy("conv_id").agg(F.sum("n").alias("n_turns"), F.sort_array(F.collect_list(F.struct("part", "n", "segments"))).alias("p"), F.sort_array(F.collect_list(F.struct("part", F.map_entries("move").alias("move")))).alias("m"))
    end = F.aggregate("m", F.lit(template.start), lambda state, m: F.coalesce(F.try_element_at(F.map_from_entries(m["move"]), state), F.lit(ERROR)))
    segments = F.flatten("p.segments")
    return whole.select(
        "conv_id",
        "n_turns",
        end.isin(*template.accepts).alias("valid"),
        segments.alias("segments"),
        F.array_join(F.transform(segments, lambda s: s["text"]), "").alias("formatted"),
    )


def read_turns(formatted: Column, template: Template = Template()) -> Column:
    """The turns of a formatted conversation: an array of role and text, as they were."""
    quote = lambda s: "\\Q" + s + "\\E"
    blocks = F.split(formatted, quote(template.tail))
    blocks = F.slice(blocks, 1, F.greatest(F.size(blocks) - 1, F.lit(0)))

    def turn(block: Column) -> Column:
        halves = F.split(F.substr(block, F.lit(len(template.head) + 1)), quote(template.sep), 2)
        return F.struct(unescaped(halves[0]).alias("role"), unescaped(halves[1]).alias("text"))

    return F.transform(blocks, turn)


def loss_text(segments: Column) -> Column:
    """All text under the loss mask, as it was."""
    return F.array_join(F.transform(F.filter(segments, lambda s: s["loss"]), lambda s: unescaped(s["text"])), "")
