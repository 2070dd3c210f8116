"""Chat formatting: a finite-state machine over roles, and text segments with loss flags from a declarative template.

Column expressions only. A conversation is one training example and so one output row; its turns
meet in that row and nowhere else.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Template:
    """A turn is start + role + sep + text + end. Every control string begins with opener; escape stands before what would form one inside a role or text.

    transitions: state -> role -> next state; what is missing leads to the state 'invalid', which no role leaves.
    """

    start: str = "<|im_start|>"
    sep: str = "<|im_sep|>"
    end: str = "<|im_end|>"
    opener: str = "<|"
    escape: str = "\\"
    loss_roles: tuple[str, ...] = ("assistant",)
    initial: str = "begin"
    final: tuple[str, ...] = ("assistant",)
    transitions: dict[str, dict[str, str]] = field(
        default_factory=lambda: {"begin": {"system": "system", "user": "user"}, "system": {"user": "user"}, "user": {"assistant": "assistant"}, "assistant": {"user": "user"}}
    )


CHAT = Template()


def escaped(text: Column, t: Template = CHAT) -> Column:
    """Reversible, and free of t.opener: the escape is doubled first, then set inside every opener."""
    once = F.replace(text, F.lit(t.escape), F.lit(2 * t.escape))
    return F.replace(once, F.lit(t.opener), F.lit(t.opener[0] + t.escape + t.opener[1:]))


def unescaped(text: Column, t: Template = CHAT) -> Column:
    return F.regexp_replace(text, f"\\{t.escape}([\\{t.escape}{_quoted(t.opener[1])}])", "$1")


def _quoted(s: str) -> str:
    return "".join(c if c.isalnum() or c == "_" else f"\\{c}" for c in s)


def _final_state(roles: Column, t: Template) -> Column:
    step = F.create_map(*[F.lit(x) for state, nexts in t.transitions.items() for role, nxt in nexts.items() for x in (f"{state}\n{role}", nxt)])
    return F.aggregate(roles, F.lit(t.initial), lambda state, role: F.coalesce(F.try_element_at(step, F.concat(state, F.lit("\n"), role)), F.lit("invalid")))


def format_chats(turns: DataFrame, template: Template = CHAT, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """One row per conversation: conv_id, n_turns, valid, segments array<struct<text,loss>>.

    Turns are ordered by turn, then role, then text, nulls first, so that ties and repeated rows
    have one order and each stays a turn. A null role or text is an empty one; a null conv_id is a
    conversation of its own. valid says whether the machine accepts the roles; invalid conversations
    are formatted too. Other columns are left out. No rows give no rows.
    """
    t = template
    turn = F.struct(F.col(turn_col).cast("long").alias("turn"), F.coalesce(F.col(role_col), F.lit("")).alias("role"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    convs = turns.groupBy(F.col(conv_col).cast("long").alias("conv_id")).agg(F.array_sort(F.collect_list(turn), _before).alias("turns"))
    segment = lambda text, loss: F.struct(text.alias("text"), loss.alias("loss"))
    of_turn = lambda x: F.array(
        segment(F.concat(F.lit(t.start), escaped(x["role"], t), F.lit(t.sep)), F.lit(False)),
        segment(escaped(x["text"], t), x["role"].isin(*t.loss_roles)),
        segment(F.lit(t.end), F.lit(False)),
    )
    return convs.select(
        "conv_id", F.size("turns").cast("long").alias("n_turns"),
        _final_state(F.transform("turns", lambda x: x["role"]), t).isin(*t.final).alias("valid"),
        F.flatten(F.transform("turns", of_turn)).alias("segments"),
    )


def _before(a: Column, b: Column) -> Column:
    """Order of turns; a null turn comes first."""
    less = lambda x, y: F.when(x < y, -1).when(x > y, 1)
    turn = F.when(a["turn"].isNull() & b["turn"].isNotNull(), -1).when(a["turn"].isNotNull() & b["turn"].isNull(), 1)
    return F.coalesce(turn, less(a["turn"], b["turn"]), less(a["role"], b["role"]), less(a["text"], b["text"]), F.lit(0))


def formatted_text(segments: Column) -> Column:
    return F.array_join(F.transform(segments, lambda s: s["text"]), "")


def read_back(formatted: Column, template: Template = CHAT) -> Column:
    """array<struct<role,text>> from formatted text alone."""
    t = template
    blocks = F.filter(F.split(formatted, _quoted(t.end)), lambda b: b != "")
    parts = F.transform(blocks, lambda b: F.split(F.substr(b, F.lit(len(t.start) + 1)), _quoted(t.sep), 2))
    return F.transform(parts, lambda p: F.struct(unescaped(p[0], t).alias("role"), unescaped(p[1], t).alias("text")))


def loss_text(segments: Column, template: Template = CHAT) -> Column:
    """All text under the loss mask, unescaped, in order."""
    return F.array_join(F.transform(F.filter(segments, lambda s: s["loss"]), lambda s: unescaped(s["text"], template)), "")


def chat_digest(formatted: DataFrame, template: Template = CHAT) -> DataFrame:
    """What the formatted conversations say when they are read back."""
    rows = formatted.select("conv_id", "valid", formatted_text(F.col("segments")).alias("f"), loss_text(F.col("segments"), template).alias("l"))
    rows = rows.select("conv_id", "valid", "f", "l", read_back(F.col("f"), template).alias("turns"))
    said = F.array_join(F.transform("turns", lambda x: F.concat(x["role"], F.lit("\n"), x["text"], F.lit("\n"))), "")
    return rows.select(
        "conv_id", F.size("turns").cast("long").alias("n_turns"), F.sha2(said, 256).alias("turns_sha256"), F.length("l").cast("long").alias("loss_chars"),
        F.sha2(F.col("l"), 256).alias("loss_sha256"), F.length("f").cast("long").alias("formatted_chars"), "valid",
    )
