"""Chat formatting: a declarative template lays out the turns of a conversation and flags the text that counts for the loss.

A finite-state machine over the roles checks the order of the turns: its table is data, ``TRANSITIONS``; what it refuses
is formatted all the same and reported in ``valid`` and ``bad_turn``. The template is a list of segments for a turn;
each has a text, or takes the role or the text of the turn, and names the roles for which it is under the loss mask.
Control strings inside texts are escaped: ``&`` becomes ``&amp;`` and ``<|`` becomes ``&lt;|``; ``unescape`` undoes it.

Rows: turns are ordered by ``turn`` (null first), equal ones by role and text; repeated rows are turns of their own. A null
text or role is empty; rows with a null conversation are one conversation. Further columns are not read. The turns of one
conversation become one string, as the output asks for: a conversation is the unit that is held in memory.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F



@dataclass(frozen=True)
class Segment:
    """A piece of a formatted turn: fixed ``text``, or the turn's ``field`` (role or text)."""

    text: str = ""
    field: str = ""
    loss_roles: tuple[str, ...] = ()


START, END = "<|im_start|>", "<|im_end|>"
TEMPLATE = (Segment(START), Segment(field="role"), Segment("\n"), Segment(field="text", loss_roles=("assistant",)), Segment(END), Segment("\n"))
#: (state, role) -> state; the machine starts in "start", and a conversation may end in one of ``FINAL``.
TRANSITIONS = {
    ("start", "system"): "system",
    ("start", "user"): "user",
    ("system", "user"): "user",
    ("user", "assistant"): "assistant",
    ("assistant", "user"): "user",
}
FINAL = ("assistant",)


def escape(text: Column) -> Column:
    return F.replace(F.replace(text, F.lit("&"), F.lit("&amp;")), F.lit("<|"), F.lit("&lt;|"))


def unescape(text: Column) -> Column:
    return F.replace(F.replace(text, F.lit("&lt;|"), F.lit("<|")), F.lit("&amp;"), F.lit("&"))


def escape_role(role: Column) -> Column:
    """A role also must not hold the line end that closes it."""
    return F.replace(escape(role), F.lit("\n"), F.lit("&nl;"))


def unescape_role(role: Column) -> Column:
    return unescape(F.replace(role, F.lit("&nl;"), F.lit("\n")))


def _machine(roles: Column, transitions: dict, final: tuple[str, ...]) -> Column:
    """struct(state, bad): the state after all turns and the number of the first refused turn, or null."""
    moves = F.create_map(*[F.lit(x) for (a, b), c in transitions.items() for x in (f"{a} {b}", c)])
    start = F.struct(F.lit("start").alias("state"), F.lit(0).alias("at"), F.lit(None).cast("int").alias("bad"))

    def step(s: Column, role: Column) -> Column:
        to = F.try_element_at(moves, F.concat_ws(" ", s["state"], role))
        bad = F.coalesce(s["bad"], F.when(to.isNull(), s["at"]))
        return F.struct(F.coalesce(to, s["state"]).alias("state"), (s["at"] + 1).alias("at"), bad.alias("bad"))

    return F.aggregate(roles, start, step, lambda s: F.struct(s["bad"].alias("bad"), (s["bad"].isNull() & s["state"].isin(*final)).alias("valid")))


def format_chats(turns: DataFrame, conv_id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text",
                 template: tuple[Segment, ...] = TEMPLATE, transitions: dict = TRANSITIONS, final: tuple[str, ...] = FINAL) -> DataFrame:
    """Per conversation: segments (text, loss), formatted (their texts in a row), loss_spans (start, length), n_turns, valid, bad_turn."""
    row = F.struct(F.col(turn).alias("turn"), F.coalesce(F.col(role).cast("string"), F.lit("")).alias("role"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text"))
    chats = turns.select(F.col(conv_id).alias("conv_id"), row.alias("t")).groupBy("conv_id").agg(F.sort_array(F.collect_list("t")).alias("_turns"))

    def emit(t: Column) -> Column:
        return F.array(*[
            F.struct((escape_role(t["role"]) if s.field == "role" else escape(t["text"]) if s.field else F.lit(s.text)).alias("text"), (t["role"].isin(*s.loss_roles) if s.loss_roles else F.lit(False)).alias("loss"))
            for s in template
        ])

    out = chats.select("conv_id", F.size("_turns").cast("long").alias("n_turns"), F.flatten(F.transform("_turns", emit)).alias("segments"), _machine(F.transform("_turns", lambda t: t["role"]), transitions, final).alias("_m"))
    out = out.select("conv_id", "n_turns", "segments", F.array_join(F.transform("segments", lambda s: s["text"]), "").alias("formatted"), F.col("_m.valid").alias("valid"), F.col("_m.bad").alias("bad_turn"))
    return out.withColumn("loss_spans", loss_spans(F.col("segments"))).select("conv_id", "n_turns", "segments", "formatted", "loss_spans", "valid", "bad_turn")


def loss_spans(segments: Column) -> Column:
    """Start (from 0, in code points) and length of each segment under the loss mask."""
    zero = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start:int,length:int>>").alias("out"))

    def step(s: Column, e: Column) -> Column:
        size = F.length(e["text"])
        added = F.when(e["loss"], F.concat(s["out"], F.array(F.struct(s["at"].alias("start"), size.alias("length"))))).otherwise(s["out"])
        return F.struct((s["at"] + size).alias("at"), added.alias("out"))

    return F.aggregate(segments, zero, step, lambda s: s["out"])


def read_turns(formatted: Column, start: str = START, end: str = END) -> Column:
    """The turns in a formatted text: array of struct(role, text)."""
    parts = F.slice(F.split(formatted, f"\\Q{start}\\E"), 2, F.greatest(F.length(formatted), F.lit(1)))

    def turn(part: Column) -> Column:
        role = F.substring_index(part, "\n", 1)
        body = F.substring(part, F.length(role) + 2, F.length(part) - F.length(role) - 1 - len(end) - 1)
        return F.struct(unescape_role(role).alias("role"), unescape(body).alias("text"))

    return F.transform(parts, turn)


def loss_text(formatted: Column, spans: Column) -> Column:
    """All text under the loss mask, unescaped, nothing between."""
    return F.array_join(F.transform(spans, lambda s: unescape(F.substring(formatted, s["start"] + 1, s["length"]))), "")


def chat_digest(chats: DataFrame) -> DataFrame:
    """Digests of what ``format_chats`` wrote, read back from it."""
    back = chats.select("conv_id", "formatted", "valid", "bad_turn", read_turns(F.col("formatted")).alias("_turns"), loss_text(F.col("formatted"), F.col("loss_spans")).alias("_loss"))
    plain = F.array_join(F.transform("_turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return back.select(
        "conv_id", F.size("_turns").cast("long").alias("n_turns"), F.sha2(plain.cast("binary"), 256).alias("turns_sha256"),
        F.length("_loss").cast("long").alias("loss_chars"), F.sha2(F.col("_loss").cast("binary"), 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"), "valid", "bad_turn",
    )
