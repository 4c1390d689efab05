"""Chat formatting: role order checked by a finite-state machine, text emitted
as segments with loss flags from a declarative template. DataFrame functions only.

Defined cases: a null text or role is empty; turns are ordered by (turn, role,
text), so repeated turns are kept and ties have one order; a null conversation
id is a conversation like any other; an empty table gives an empty table;
further columns are not read. A conversation whose roles the machine does not
accept is formatted all the same, with valid = false.

The formatted conversation is one string, so one conversation must fit into a
task; that is a property of the result, not of the method.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ORDER = {
    ("start", "system"): "system",
    ("start", "user"): "user",
    ("system", "user"): "user",
    ("user", "assistant"): "assistant",
    ("assistant", "user"): "user",
}


@dataclass(frozen=True)
class Template:
    """Control strings around each turn, roles whose text is learnt from, and
    the moves of the role machine. All control strings start with the same
    character, which occurs nowhere else in them."""

    turn: str = "<|turn|>"
    text: str = "<|text|>"
    end: str = "<|end|>"
    loss_roles: tuple[str, ...] = ("assistant",)
    moves: dict[tuple[str, str], str] = field(default_factory=lambda: dict(ORDER))
    accepts: tuple[str, ...] = ("assistant",)

    def __post_init__(self):
        controls = (self.turn, self.text, self.end)
        if len({c[0] for c in controls}) != 1 or len(set(controls)) != 3 or any(c[0] in c[1:] or len(c) < 2 for c in controls):
            raise ValueError("control strings must differ and share a first character that occurs once in each")
        if any("\\" in c for c in controls):
            raise ValueError("control strings must not hold a backslash")

    @property
    def _rest(self) -> str:
        return "|".join(re.escape(c[1:]) for c in (self.turn, self.text, self.end))

    def escape(self, column: Column) -> Column:
        """A backslash goes in after the first character of every control
        string, and one more where there already are some."""
        return F.regexp_replace(column, f"({re.escape(self.turn[0])})(\\\\*)({self._rest})", r"$1\\$2$3")

    def unescape(self, column: Column) -> Column:
        return F.regexp_replace(column, f"({re.escape(self.turn[0])})\\\\(\\\\*)({self._rest})", "$1$2$3")


def format_conversations(turns: DataFrame, template: Template = Template()) -> DataFrame:
    """One row per conversation: conv_id, segments (array of text and loss
    flag), formatted (all segments joined), state (of the machine), valid."""
    rows = turns.select(
        "conv_id",
        F.struct("turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text")).alias("row"),
    )
    grouped = rows.groupBy("conv_id").agg(F.array_sort(F.collect_list("row")).alias("turns"))
    moves = F.create_map(*[F.lit(x) for (state, role), after in template.moves.items() for x in (f"{state}\n{role}", after)])

    def move(state: Column, row: Column) -> Column:
        return F.coalesce(F.try_element_at(moves, F.concat(state, F.lit("\n"), row.role)), F.lit("invalid"))

    def emit(row: Column) -> Column:
        head = F.concat(F.lit(template.turn), template.escape(row.role), F.lit(template.text))
        part = lambda text, loss: F.struct(text.alias("text"), loss.alias("loss"))
        return F.array(
            part(head, F.lit(False)),
            part(template.escape(row.text), row.role.isin(*template.loss_roles)),
            part(F.lit(template.end), F.lit(False)),
        )

    made = grouped.select(
        "conv_id",
        F.flatten(F.transform("turns", emit)).alias("segments"),
        F.aggregate("turns", F.lit("start"), move).alias("state"),
    )
    return made.select(
        "conv_id",
        "segments",
        F.array_join(F.transform("segments", lambda s: s.text), "").alias("formatted"),
        "state",
        F.col("state").isin(*template.accepts).alias("valid"),
    )


def read_back(formatted: DataFrame, template: Template = Template()) -> DataFrame:
    """The turns (array of role and text), read from the formatted string alone,
    and loss_text, the text under the loss mask."""
    between = F.filter(F.split("formatted", re.escape(template.turn), -1), lambda x, i: i > 0)

    def parse(turn: Column) -> Column:
        parts = F.split(turn, re.escape(template.text), 2)
        text = parts[1]
        return F.struct(
            template.unescape(parts[0]).alias("role"),
            template.unescape(text.substr(F.lit(1), F.length(text) - len(template.end))).alias("text"),
        )

    masked = F.filter("segments", lambda s: s.loss)
    return formatted.withColumns({
        "turns": F.transform(between, parse),
        "loss_text": F.array_join(F.transform(masked, lambda s: template.unescape(s.text)), ""),
    })
