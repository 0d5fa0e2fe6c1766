"""Chat formatting (operator 3), in DataFrame functions only.

A template says how a turn is marked, which control strings are escaped and how, which
roles carry loss, and which role may follow which. A conversation becomes segments of
text with a loss flag each; their concatenation is the formatted text. Control strings
inside texts and roles are written with escapes that contain none of the marks' own characters, so
a text can never open or close a turn, and reading back is exact.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Template:
    """``escapes``: the escape character first; each replacement starts with it and ends in another letter."""

    open: str = "### "
    after_role: str = ": "
    close: str = " </turn>\n"
    escapes: tuple[tuple[str, str], ...] = (("\\", "\\b"), ("<", "\\l"), ("#", "\\h"))
    role_escapes: tuple[tuple[str, str], ...] = (("\\", "\\b"), ("<", "\\l"), ("#", "\\h"), (":", "\\c"))
    loss_roles: tuple[str, ...] = ("assistant",)
    start: str = "start"
    #: (state, role) -> state; anything else leads to the state "invalid", which is never left
    moves: dict[tuple[str, str], str] = field(
        default_factory=lambda: {
            ("start", "system"): "primed",
            ("start", "user"): "asked",
            ("primed", "user"): "asked",
            ("asked", "assistant"): "answered",
            ("answered", "user"): "asked",
        }
    )
    finals: tuple[str, ...] = ("asked", "answered")


def _escape(c: Column, pairs: tuple[tuple[str, str], ...]) -> Column:
    for raw, safe in pairs:
        c = F.replace(c, F.lit(raw), F.lit(safe))
    return c


def _unescape(c: Column, pairs: tuple[tuple[str, str], ...]) -> Column:
    # the escape character itself comes last: until then each one left starts an escape
    for raw, safe in (*pairs[1:], pairs[0]):
        c = F.replace(c, F.lit(safe), F.lit(raw))
    return c


def format_conversations(turns: DataFrame, template: Template | None = None) -> DataFrame:
    """Per conversation ``conv_id, n_turns, segments, formatted, end_state, valid``.

    Turns go by ``turn``, then role, then text; null turn numbers come first. A null
    role or text is empty, rows with a null conv_id are one conversation. Conversations that break
    the turn order are formatted too, with ``valid`` false. Repeated rows are turns of their own; other columns
    are ignored; an empty table gives no rows. A conversation is one row, as a training sample is; nothing larger
    is gathered.
    """
    t = template or Template()
    rows = turns.select(
        "conv_id", F.col("turn").alias("turn"), F.coalesce(F.col("role").cast("string"), F.lit("")).alias("role"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")
    )
    conv = rows.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "role", "text"))).alias("turns"))
    moves = F.create_map(*(F.lit(x) for (s, r), to in t.moves.items() for x in (f"{s}\x00{r}", to)))
    state = F.aggregate("turns", F.lit(t.start), lambda s, x: F.coalesce(F.try_element_at(moves, F.concat(s, F.lit("\x00"), x["role"])), F.lit("invalid")))

    def seg(text: Column, loss: Column) -> Column:
        return F.struct(text.alias("text"), loss.alias("loss"))

    def parts(x: Column) -> Column:
        head = F.concat(F.lit(t.open), _escape(x["role"], t.role_escapes), F.lit(t.after_role))
        return F.array(seg(head, F.lit(False)), seg(_escape(x["text"], t.escapes), x["role"].isin(*t.loss_roles)), seg(F.lit(t.close), F.lit(False)))

    out = conv.select("conv_id", F.size("turns").cast("long").alias("n_turns"), F.flatten(F.transform("turns", parts)).alias("segments"), state.alias("end_state"))
    return out.select(
        "conv_id", "n_turns", "segments", F.array_join(F.transform("segments", lambda s: s["text"]), "").alias("formatted"),
        "end_state", F.col("end_state").isin(*t.finals).alias("valid"),
    )


def parse_turns(formatted: Column, template: Template | None = None) -> Column:
    """Array of ``(role, text)`` read back from a formatted conversation."""
    t = template or Template()
    turn = f"(?s)^{re.escape(t.open)}([^:]*?){re.escape(t.after_role)}(.*)$"
    pieces = F.filter(F.split(formatted, re.escape(t.close)), lambda p: p != "")
    return F.transform(
        pieces,
        lambda p: F.struct(
            _unescape(F.regexp_extract(p, turn, 1), t.role_escapes).alias("role"), _unescape(F.regexp_extract(p, turn, 2), t.escapes).alias("text")
        ),
    )


def loss_text(segments: Column, template: Template | None = None) -> Column:
    """All text under the loss mask, unescaped, nothing between."""
    t = template or Template()
    return _unescape(F.array_join(F.transform(F.filter(segments, lambda s: s["loss"]), lambda s: s["text"]), ""), t.escapes)
