"""Chat formatting: a finite-state machine over roles and a declarative template, in DataFrame functions only.

A template is data: the marks around a turn, which roles bear the loss, and the machine's transitions. ``format_chats``
emits for each conversation its text segments with a loss flag each, the formatted text, and the machine's verdict;
``read_back`` recovers turns and loss text from that output alone.

Escapes. Inside a text (or an unknown role's name) a backslash becomes ``\\b`` and the n-th control string ``\\`` with the
n-th code letter. No control string holds a backslash, so one never appears inside an escaped text, each backslash of
an escaped text starts a code, and plain replacements in the opposite order undo it.

Defined results: a null text is empty; a null role is the role with the empty name; roles that the template does not
list get the generic mark, carry no loss and are no input of any transition, so the machine stops there; turns go by
(turn, role, text), null turns first, so ties and repeated rows keep one order; every conversation is formatted, valid
or not. An empty table gives an empty one. Extra columns are ignored. A conversation is one row of the result by
contract, so its turns meet in one task; only that much is gathered there.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Letters that may follow a backslash; b stands for the backslash itself.
CODES = "0123456789acdefghijklmnopqrstuvwxyz"


@dataclass(frozen=True)
class ChatTemplate:
    """heads: role to the mark before its text; any_head and any_end enclose an unlisted role's name; end: the mark
    after a text; loss: the roles that are trained on; moves: state to {role: next state}; final: states to end in."""

    heads: dict[str, str] = field(default_factory=lambda: {"system": "### System: ", "user": "### User: ", "assistant": "### Assistant: "})
    any_head: str = "### Role <"
    any_end: str = ">: "
    end: str = " </turn>\n"
    loss: tuple[str, ...] = ("assistant",)
    moves: dict[str, dict[str, str]] = field(
        default_factory=lambda: {"start": {"system": "primed", "user": "asked"}, "primed": {"user": "asked"}, "asked": {"assistant": "answered"}, "answered": {"user": "asked"}}
    )
    final: tuple[str, ...] = ("answered",)

    def __post_init__(self):
        marks = self.controls()
        if len(marks) > len(CODES) or any(not m or "\\" in m for m in marks):
            raise ValueError("control strings must be non-empty, free of backslashes and few")
        if any(self.end.startswith(self.end[-n:]) for n in range(1, len(self.end))):
            raise ValueError("the end mark must not overlap itself, or a text could shift it")
        if any(a != b and a.startswith(b) for a in self.all_heads() for b in self.all_heads()):
            raise ValueError("no head may start with another")

    def all_heads(self) -> list[str]:
        return [*self.heads.values(), self.any_head]

    def controls(self) -> list[str]:
        """What must not appear inside a text: each mark without its outer white space."""
        return list(dict.fromkeys(m.strip() for m in [self.end, *self.all_heads(), self.any_end]))


DEFAULT = ChatTemplate()


def escape(text: Column, t: ChatTemplate = DEFAULT) -> Column:
    out = F.replace(text, F.lit("\\"), F.lit("\\b"))
    return reduce(lambda c, kv: F.replace(c, F.lit(kv[1]), F.lit("\\" + CODES[kv[0]])), enumerate(t.controls()), out)


def unescape(text: Column, t: ChatTemplate = DEFAULT) -> Column:
    out = reduce(lambda c, kv: F.replace(c, F.lit("\\" + CODES[kv[0]]), F.lit(kv[1])), enumerate(t.controls()), text)
    return F.replace(out, F.lit("\\b"), F.lit("\\"))


def _literal_map(d: dict[str, str]) -> Column:
    return F.create_map(*[F.lit(x) for kv in d.items() for x in kv])


def format_chats(rows: DataFrame, template: ChatTemplate = DEFAULT) -> DataFrame:
    """(conv_id, turn, role, text) rows to one row per conversation: conv_id, n_turns, segments (array of text and
    loss), formatted, valid, bad_turn (place of the first turn the machine refuses, the count of turns if the
    conversation only ends too early, null if valid)."""
    t = template
    empty = F.lit("")
    src = rows.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), F.coalesce(F.col("role"), empty).alias("role"), F.coalesce(F.col("text"), empty).alias("text"))
    conv = src.groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("turn", "role", "text"))).alias("turns"))

    heads = _literal_map(t.heads)

    def pieces(x: Column) -> Column:
        head = F.coalesce(F.try_element_at(heads, x["role"]), F.concat(F.lit(t.any_head), escape(x["role"], t), F.lit(t.any_end)))
        seg = lambda c, loss: F.struct(c.alias("text"), loss.alias("loss"))
        return F.array(seg(head, F.lit(False)), seg(escape(x["text"], t), x["role"].isin(*t.loss)), seg(F.lit(t.end), F.lit(False)))

    moves = _literal_map({f"{state}\n{role}": to for state, by in t.moves.items() for role, to in by.items()})
    to = lambda state, role: F.coalesce(F.try_element_at(moves, F.concat(state, F.lit("\n"), role)), F.lit(""))  # noqa: E731  the empty state has refused
    walked = F.aggregate(
        F.transform("turns", lambda x: x["role"]),
        F.struct(F.lit("start").alias("state"), F.lit(0).cast("long").alias("at")),
        lambda acc, role: F.when(acc["state"] == "", acc).otherwise(F.struct(to(acc["state"], role).alias("state"), (acc["at"] + F.when(to(acc["state"], role) == "", 0).otherwise(1)).alias("at"))),
    )
    out = conv.select("conv_id", F.size("turns").cast("long").alias("n_turns"), F.flatten(F.transform("turns", pieces)).alias("segments"), walked.alias("walked"))
    valid = F.coalesce(F.col("walked.state").isin(*t.final), F.lit(False))
    return out.select("conv_id", "n_turns", "segments", F.concat_ws("", F.transform("segments", lambda s: s["text"])).alias("formatted"), valid.alias("valid"), F.when(~valid, F.col("walked.at")).alias("bad_turn"))


def read_back(chats: DataFrame, template: ChatTemplate = DEFAULT) -> DataFrame:
    """From what format_chats returned: conv_id, turns (array of role and text) parsed out of ``formatted``, and
    loss_text, the unescaped segments under the loss flag. Nothing of the source rows is used."""
    t = template
    parts = F.split(F.col("formatted"), "\\Q" + t.end + "\\E", -1)
    known = list(t.heads.items())

    def turn(p: Column) -> Column:
        at = F.instr(p, t.any_end)
        role = unescape(p.substr(F.lit(len(t.any_head) + 1), F.greatest(at - F.lit(len(t.any_head) + 1), F.lit(0))), t)
        text = p.substr(at + F.lit(len(t.any_end)), F.length(p))
        for name, head in known:
            hit = p.startswith(F.lit(head))
            role, text = F.when(hit, F.lit(name)).otherwise(role), F.when(hit, p.substr(F.lit(len(head) + 1), F.length(p))).otherwise(text)
        return F.struct(role.alias("role"), unescape(text, t).alias("text"))

    kept = F.transform(F.filter("segments", lambda s: s["loss"]), lambda s: unescape(s["text"], t))
    return chats.select("conv_id", "formatted", F.transform(F.slice(parts, 1, F.greatest(F.size(parts) - 1, F.lit(0))), turn).alias("turns"), F.concat_ws("", kept).alias("loss_text"), "valid", "bad_turn")


def digests(back: DataFrame) -> DataFrame:
    """Counts and sha-256 digests of what was read back."""
    turns = F.concat_ws("", F.transform("turns", lambda x: F.concat(x["role"], F.lit("\n"), x["text"], F.lit("\n"))))
    return back.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(turns.cast("binary"), 256).alias("turns_sha256"),
        F.length("loss_text").cast("long").alias("loss_chars"),
        F.sha2(F.col("loss_text").cast("binary"), 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
        "valid",
        "bad_turn",
    )
