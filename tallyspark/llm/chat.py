"""Chat formatting: a role state machine and a declarative template, in DataFrame functions only.

A formatted conversation is a run of segments, each with a loss flag:
``<turn ROLE>``, the escaped text, ``</turn>`` and a line end for every turn.
Escaping writes ``&`` as ``&amp;`` and ``<`` as ``&lt;`` (in roles also ``>``
as ``&gt;``), so a plain ``<`` only ever begins a mark, whatever the texts
hold, and undoing it in the opposite order gives the text back.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: The template: marks, and the roles whose texts bear loss.
TEMPLATE = {"open": "<turn {role}>", "close": "</turn>\n", "loss": ("assistant",)}
#: The state machine: state -> role -> next state; any other step goes to "error" and stays there.
TRANSITIONS = {
    "start": {"system": "system", "user": "user"},
    "system": {"user": "user"},
    "user": {"assistant": "assistant"},
    "assistant": {"user": "user"},
}
ACCEPTING = ("assistant", "user")


def escape(text: Column) -> Column:
    return F.replace(F.replace(text, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;"))


def unescape(text: Column) -> Column:
    return F.replace(F.replace(text, F.lit("&lt;"), F.lit("<")), F.lit("&amp;"), F.lit("&"))


def _role_out(role: Column) -> Column:
    return F.replace(escape(role), F.lit(">"), F.lit("&gt;"))


def _role_in(role: Column) -> Column:
    return unescape(F.replace(role, F.lit("&gt;"), F.lit(">")))


def final_state(roles: Column) -> Column:
    """The state after an array of roles; "error" once a role may not follow."""
    steps = F.create_map(*[F.lit(x) for s, row in TRANSITIONS.items() for role, to in row.items()
                           for x in (f"{s}>{role}", to)])
    return F.aggregate(roles, F.lit("start"),
                       lambda s, r: F.coalesce(F.element_at(steps, F.concat(s, F.lit(">"), r)), F.lit("error")))


def format_chats(conversations: DataFrame, template: dict = TEMPLATE) -> DataFrame:
    """(conv_id, formatted, segments, n_turns, end_state, valid), one row per conversation.

    Turns are taken by ``turn``, ties by role and text.  Null roles and texts
    count as empty, a null conv_id as a conversation of its own; every
    conversation is formatted, ``valid`` says whether the machine accepts it.
    A conversation is the unit of the result, so its turns meet in one row.
    Repeated turns all count; very long texts are kept whole; no rows give no
    conversations.  Columns other than conv_id, turn, role and text are not read.
    """
    empty = F.lit("")
    turns = conversations.select(
        "conv_id", F.struct("turn", F.coalesce("role", empty).alias("role"), F.coalesce("text", empty).alias("text")).alias("t"))
    chats = turns.groupBy("conv_id").agg(F.sort_array(F.collect_list("t")).alias("turns"))
    before, after = template["open"].split("{role}")

    def segments(t: Column) -> Column:
        mark = F.concat(F.lit(before), _role_out(t["role"]), F.lit(after))
        bears = t["role"].isin(*template["loss"])
        one = lambda text, loss: F.struct(text.alias("text"), loss.alias("loss"))
        return F.array(one(mark, F.lit(False)), one(escape(t["text"]), bears), one(F.lit(template["close"]), F.lit(False)))

    state = final_state(F.transform("turns", lambda t: t["role"]))
    return (chats.select("conv_id", F.flatten(F.transform("turns", segments)).alias("segments"),
                         F.size("turns").cast("long").alias("n_turns"), state.alias("end_state"))
            .select("conv_id", F.array_join(F.transform("segments", lambda s: s["text"]), "").alias("formatted"),
                    "segments", "n_turns", "end_state", F.col("end_state").isin(*ACCEPTING).alias("valid")))


def parsed(formatted: Column, template: dict = TEMPLATE) -> Column:
    """The turns of a formatted string, as an array of (role, text)."""
    before, after = template["open"].split("{role}")
    shut = len(template["close"])

    def turn(piece: Column) -> Column:
        role = F.substring_index(piece, after, 1)
        text = F.substr(piece, F.length(role) + F.lit(1 + len(after)), F.length(piece) - F.length(role) - F.lit(len(after) + shut))
        return F.struct(_role_in(role).alias("role"), unescape(text).alias("text"))

    pieces = F.split(formatted, before)
    return F.transform(F.slice(pieces, F.lit(2), F.size(pieces)), turn)


def digests(formatted: DataFrame, template: dict = TEMPLATE) -> DataFrame:
    """What a reader gets back from the formatted strings and from the loss mask, as digests.

    The marks of the string give the turns (``n_turns``, ``turns_sha256``);
    the segments under the loss mask, unescaped, give ``loss_*``.
    """
    loss = F.array_join(F.transform(F.filter("segments", lambda s: s["loss"]), lambda s: unescape(s["text"])), "")
    read = formatted.select("conv_id", "formatted", "end_state", "valid", loss.alias("loss_text"),
                            parsed(F.col("formatted"), template).alias("turns"))
    whole = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return read.select(
        "conv_id", F.size("turns").cast("long").alias("n_turns"), F.sha2(whole, 256).alias("turns_sha256"),
        F.length("loss_text").cast("long").alias("loss_chars"), F.sha2("loss_text", 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"), "end_state", "valid")
