"""Operator 8: chat formatting with a grammar round trip.

Template (a conversation is its turns one after another, nothing between):

    assistant turn:  <s>TEXT</s>
    any other turn:  [INST]ROLE\\nTEXT[/INST]

Control strings are ``<s> </s> [INST] [/INST]``. A text is escaped by one backslash after the bracket of every control
string in it, and one more where backslashes stand there already, so escaping can be undone whatever the text holds.
Roles are written with ``% \\n [ <`` percent-encoded.

Each conversation is rendered as it is and read back by a deterministic parser: cut after closing markers, each segment
one turn, no control string inside. If the turns differ from the source, or a segment isn't a turn, its texts are
escaped and it is rendered and read again. If the turns still differed the job would fail; escaping makes that
impossible.

Cases: turns are in order of ``turn`` (null first), then role and text, so ties and repeated rows have one order, and
repeated rows are turns of their own; a null text is empty; a null role is an empty role; a null ``conv_id`` is a
conversation; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_CONTROL = r"([\[<])(\\*)(/?)(INST\]|s>)"
_BARE = r"\[/?INST\]|</?s>"


def escape(text: Column) -> Column:
    # a role's control strings differ in their bracket, so "[s>" and "<INST]" are escaped as well; that is undone alike
    return F.regexp_replace(text, _CONTROL, r"$1\\$2$3$4")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"([\[<])\\(\\*)(/?)(INST\]|s>)", "$1$2$3$4")


def _role_out(role: Column) -> Column:
    for a, b in (("%", "%25"), ("\n", "%0A"), ("[", "%5B"), ("<", "%3C")):
        role = F.replace(role, F.lit(a), F.lit(b))
    return role


def _role_in(role: Column) -> Column:
    for a, b in (("<", "%3C"), ("[", "%5B"), ("\n", "%0A"), ("%", "%25")):
        role = F.replace(role, F.lit(b), F.lit(a))
    return role


def _turn(x: Column, write) -> Column:
    other = F.concat(F.lit("[INST]"), _role_out(x["role"]), F.lit("\n"), write(x["text"]), F.lit("[/INST]"))
    return F.when(x["role"] == "assistant", F.concat(F.lit("<s>"), write(x["text"]), F.lit("</s>"))).otherwise(other)


def _render(turns: Column, write) -> Column:
    return F.array_join(F.transform(turns, lambda x: _turn(x, write)), "")


def _body(segment: Column) -> Column:
    """A segment's text as it is written."""
    n = F.char_length(segment)
    said = segment.substr(F.lit(4), n - 7)
    rest = segment.substr(F.lit(7), n - 13)
    return F.when(segment.startswith("<s>"), said).otherwise(rest.substr(F.instr(rest, "\n") + 1, n))


def segments(rendered: Column) -> Column:
    """The parser's first step: cut after every closing marker."""
    return F.filter(F.split(rendered, r"(?<=\[/INST\])|(?<=</s>)"), lambda s: s != "")


def parse(rendered: Column) -> Column:
    """``array<struct<role, text>>``; a segment that isn't a turn, or holds a bare control string, gives nulls."""

    def one(s):
        said = s.startswith("<s>") & s.endswith("</s>")
        rest = s.substr(F.lit(7), F.char_length(s) - 13)
        other = s.startswith("[INST]") & s.endswith("[/INST]") & rest.contains("\n")
        fine = (said | other) & ~_body(s).rlike(_BARE)
        role = F.when(said, F.lit("assistant")).otherwise(_role_in(F.substring_index(rest, "\n", 1)))
        return F.struct(F.when(fine, role).alias("role"), F.when(fine, unescape(_body(s))).alias("text"))

    return F.transform(segments(rendered), one)


def format_conversations(rows: DataFrame) -> DataFrame:
    """``(conv_id, rendered, turns, mask)``: the text, the turns read back from it, and the loss spans.

    ``mask`` holds ``(start, length)`` in code points of every assistant text inside ``rendered``, as written there.
    """
    turn = F.struct("turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    source = rows.groupBy("conv_id").agg(F.array_sort(F.collect_list(turn)).alias("t"))
    source = source.withColumn("source", F.transform("t", lambda x: F.struct(x["role"].alias("role"), x["text"].alias("text"))))
    plain = source.withColumn("plain", _render(F.col("source"), lambda t: t)).withColumn("same", F.col("source") == parse(F.col("plain")))
    done = plain.withColumn("rendered", F.when(F.col("same"), F.col("plain")).otherwise(_render(F.col("source"), escape)))
    done = done.withColumn("turns", parse(F.col("rendered")))
    done = done.withColumn("turns", F.when(F.col("turns") == F.col("source"), F.col("turns")).otherwise(F.raise_error(F.lit("a conversation does not survive its template"))))
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start:int,length:int>>").alias("mask"))

    def step(acc, s):
        n = F.char_length(s)
        span = F.struct((acc["at"] + 3).alias("start"), (n - 7).alias("length"))
        mask = F.when(s.startswith("<s>"), F.array_append(acc["mask"], span)).otherwise(acc["mask"])
        return F.struct((acc["at"] + n).alias("at"), mask.alias("mask"))

    done = done.withColumn("cut", segments(F.col("rendered")))
    return done.select("conv_id", "rendered", "turns", F.aggregate("cut", start, step, lambda acc: acc["mask"]).alias("mask"))


def op8(rows: DataFrame) -> DataFrame:
    """Per conversation: ``conv_id``, ``n_turns``, ``turns_sha256``, ``loss_chars``, ``loss_sha256``, ``formatted_chars``."""
    out = format_conversations(rows)
    turns = F.array_join(F.transform("turns", lambda x: F.concat(x["role"], F.lit("\n"), x["text"], F.lit("\n"))), "")
    loss = F.array_join(F.transform("mask", lambda m: unescape(F.col("rendered").substr(m["start"] + 1, m["length"]))), "")
    out = out.withColumn("loss", loss)
    return out.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(turns, 256).alias("turns_sha256"),
        F.char_length("loss").cast("long").alias("loss_chars"),
        F.sha2("loss", 256).alias("loss_sha256"),
        F.char_length("rendered").cast("long").alias("formatted_chars"),
    )
