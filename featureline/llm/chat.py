"""Conversations as training text: a finite-state machine over the roles, and segments with loss flags from a declarative
template.

A template names the marks around a turn, the roles whose text is trained on, and which role may follow which. Each turn
gives three segments: its head, its text and its end; only the texts of trained roles carry the loss flag. Marks inside
a text can't be taken for marks: a backslash is put between ``<`` and ``|`` (one more, if there are some), which
:func:`unescaped` undoes.

Turns are ordered by turn, then role, then text; null turns come first. A null text or role is empty. A conversation
whose roles don't follow the template is formatted all the same, with ``valid`` false. Repeated rows are repeated turns;
rows with a null conv_id are one conversation; an empty table gives an empty one. Columns besides conv_id, turn, role
and text are not read.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, functions as F


@dataclass(frozen=True)
class Template:
    start: str = "<|im_start|>"
    after_role: str = "\n"
    end: str = "<|im_end|>\n"
    trained: tuple[str, ...] = ("assistant",)
    #: What may follow each state; the state is the last role, "" before the first turn.
    follows: dict[str, tuple[str, ...]] = field(default_factory=lambda: {
        "": ("system", "user"), "system": ("user",), "user": ("assistant",), "assistant": ("user",)})
    #: Roles that a conversation may end with.
    last: tuple[str, ...] = ("user", "assistant")


def escaped(text: Column) -> Column:
    return F.regexp_replace(text, r"<(\\*)\|", r"<$1\\|")


def unescaped(text: Column) -> Column:
    return F.regexp_replace(text, r"<(\\*)\\\|", r"<$1|")


def _role_out(role: Column) -> Column:
    """Roles end at a line end, so their own are written as backslash and n."""
    return escaped(F.replace(F.replace(role, F.lit("\\"), F.lit("\\b")), F.lit("\n"), F.lit("\\n")))


def _role_in(role: Column) -> Column:
    return F.replace(F.replace(unescaped(role), F.lit("\\n"), F.lit("\n")), F.lit("\\b"), F.lit("\\"))


def format_conversations(rows: DataFrame, template: Template = Template()) -> DataFrame:
    """One row per conv_id: formatted (the whole text), segments (text, loss) that make it up, and valid."""
    empty = F.lit("")
    turn = F.struct("turn", F.coalesce(F.col("role").cast("string"), empty).alias("role"),
                    F.coalesce(F.col("text").cast("string"), empty).alias("text"))
    talks = rows.groupBy("conv_id").agg(F.sort_array(F.collect_list(turn)).alias("turns"))

    allowed = F.create_map(*(x for state, roles in template.follows.items()
                             for x in (F.lit(state), F.array(*map(F.lit, roles)))))
    step = lambda state, t: F.when(F.coalesce(F.array_contains(allowed[state], t["role"]), F.lit(False)), t["role"])
    # A null state is the one that no role leads out of.
    final = F.aggregate("turns", empty, step)

    def segments(t: Column) -> Column:
        head = F.concat(F.lit(template.start), _role_out(t["role"]), F.lit(template.after_role))
        return F.array(F.struct(head.alias("text"), F.lit(False).alias("loss")),
                       F.struct(escaped(t["text"]).alias("text"), t["role"].isin(*template.trained).alias("loss")),
                       F.struct(F.lit(template.end).alias("text"), F.lit(False).alias("loss")))

    cut = talks.select("conv_id", F.flatten(F.transform("turns", segments)).alias("segments"),
                       F.coalesce(final.isin(*template.last), F.lit(False)).alias("valid"))
    return cut.select("conv_id", F.array_join(F.col("segments.text"), "").alias("formatted"), "segments", "valid")


def read_back(formatted: DataFrame, template: Template = Template()) -> DataFrame:
    """The turns (role, text) found in the formatted text, and the unescaped text under the loss flags."""
    quoted = "".join(f"\\x{{{ord(c):x}}}" for c in template.end)
    pieces = F.split("formatted", quoted, -1)
    pieces = F.slice(pieces, 1, F.size(pieces) - 1)

    def turn(piece: Column) -> Column:
        body = F.substring(piece, len(template.start) + 1, 1 << 30)
        head = F.substring_index(body, template.after_role, 1)
        text = body.substr(F.length(head) + 1 + len(template.after_role), F.lit(1 << 30))
        return F.struct(_role_in(head).alias("role"), unescaped(text).alias("text"))

    trained = F.transform(F.filter("segments", lambda s: s["loss"]), lambda s: unescaped(s["text"]))
    return formatted.select("conv_id", F.transform(pieces, turn).alias("turns"), F.array_join(trained, "").alias("loss_text"),
                            F.length("formatted").cast("long").alias("formatted_chars"), "valid")
