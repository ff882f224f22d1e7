"""Chat formatting with a grammar round trip, in DataFrame functions only.

A conversation is rendered as one text, reparsed by a deterministic grammar, and the recovered turns
are compared with the source. Where a text holds a control string, or the comparison fails, the
conversation is rendered again with that content escaped; the result is checked again.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The control strings of the template.
SYSTEM = ("<<SYS>>", "<</SYS>>")
USER = ("[INST]", "[/INST]")
ASSISTANT = ("<s>", "</s>")
OTHER = ("<<TURN>>", "<<TEXT>>", "<</TURN>>")

#: One control string with any number of escape signs behind its first character.
_CONTROL = r"([<\[])(\\*)(</?SYS>>|<TURN>>|</TURN>>|<TEXT>>|/?INST\]|/?s>)"
_ESCAPED = r"([<\[])\\(\\*)(</?SYS>>|<TURN>>|</TURN>>|<TEXT>>|/?INST\]|/?s>)"
_TURN = r"(?s)<<SYS>>.*?<</SYS>>|\[INST\].*?\[/INST\]|<s>.*?</s>|<<TURN>>.*?<<TEXT>>.*?<</TURN>>"


def escape(text: Column) -> Column:
    """One more escape sign in every control string, escaped or not: none is left as it is."""
    return F.regexp_replace(text, _CONTROL, r"$1$2\\$3")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, _ESCAPED, "$1$2$3")


def render_turn(role: Column, body: Column) -> Column:
    def between(marks):
        return F.concat(F.lit(marks[0]), body, F.lit(marks[1]))

    return (
        F.when(role == "system", between(SYSTEM)).when(role == "user", between(USER)).when(role == "assistant", between(ASSISTANT))
        .otherwise(F.concat(F.lit(OTHER[0]), role, F.lit(OTHER[1]), body, F.lit(OTHER[2])))
    )


def parse(formatted: Column) -> Column:
    """Turns of a formatted text: role, body as it stands there, and whether the body is under the loss mask."""

    def inner(turn, marks, role):
        return F.struct(
            F.lit(role).alias("role"), F.substring(turn, F.lit(len(marks[0]) + 1), F.length(turn) - len(marks[0]) - len(marks[1])).alias("body"),
            F.lit(role == "assistant").alias("loss"),
        )

    def turn(t):
        split = F.instr(t, OTHER[1])
        return (
            F.when(t.startswith(USER[0]), inner(t, USER, "user")).when(t.startswith(ASSISTANT[0]), inner(t, ASSISTANT, "assistant"))
            .when(t.startswith(SYSTEM[0]), inner(t, SYSTEM, "system"))
            .otherwise(F.struct(
                F.substring(t, F.lit(len(OTHER[0]) + 1), split - len(OTHER[0]) - 1).alias("role"),
                F.substring(t, split + len(OTHER[1]), F.length(t) - split - len(OTHER[1]) - len(OTHER[2]) + 1).alias("body"),
                F.lit(False).alias("loss"),
            ))
        )

    return F.transform(F.regexp_extract_all(formatted, F.lit(_TURN), F.lit(0)), turn)


def recovered(formatted: Column, escaped: Column) -> Column:
    """Source turns read back from a formatted text."""
    def plain(t):
        return F.struct(
            F.when(escaped, unescape(t["role"])).otherwise(t["role"]).alias("role"),
            F.when(escaped, unescape(t["body"])).otherwise(t["body"]).alias("text"), t["loss"].alias("loss"),
        )

    return F.transform(parse(formatted), plain)


def round_trip(formatted: Column, escaped: Column, turns: Column) -> Column:
    """Whether the grammar covers the whole text and gives back exactly the source turns."""
    covered = F.aggregate(F.regexp_extract_all(formatted, F.lit(_TURN), F.lit(0)), F.lit(0).cast("long"), lambda n, t: n + F.length(t))
    same = F.transform(recovered(formatted, escaped), lambda t: F.struct(t["role"], t["text"])) == F.transform(turns, lambda t: F.struct(t["role"], t["text"]))
    return (covered == F.length(formatted)) & same


def format_conversations(turns: DataFrame) -> DataFrame:
    """One formatted text per conversation.

    ``turns`` needs ``conv_id, turn, role, text``; other columns are ignored. Rows are ordered by turn (null first), then role and
    text where turns repeat; repeated rows stay. A null text or role is empty; roles other than system, user
    and assistant are written out. A null conversation id is a conversation of its own.
    Returns ``conv_id, formatted, escaped, exact`` (the round trip holds; it does for every input) and ``spans``: role, body and
    ``loss`` of every turn as they stand in the text; the loss mask covers bodies of assistants.
    """
    rows = turns.select(
        F.col("conv_id").cast("long").alias("conv_id"),
        F.struct(
            F.col("turn").cast("long").alias("turn"), F.coalesce(F.col("role").cast("string"), F.lit("")).alias("role"),
            F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"),
        ).alias("row"),
    )
    grouped = rows.groupBy("conv_id").agg(F.array_sort(F.collect_list("row")).alias("turns"))

    def render(escaped: bool) -> Column:
        body = escape if escaped else lambda c: c
        return F.array_join(F.transform("turns", lambda t: render_turn(
            F.when(t["role"].isin("system", "user", "assistant"), t["role"]).otherwise(body(t["role"])), body(t["text"]))), "")

    conflict = F.exists("turns", lambda t: F.concat_ws("\n", t["role"], t["text"]).rlike(_CONTROL))
    plain = grouped.withColumn("formatted", render(False))
    checked = plain.withColumn("escaped", conflict | ~round_trip(F.col("formatted"), F.lit(False), F.col("turns")))
    final = checked.withColumn("formatted", F.when(F.col("escaped"), render(True)).otherwise(F.col("formatted")))
    return final.select(
        "conv_id", "formatted", "escaped", round_trip(F.col("formatted"), F.col("escaped"), F.col("turns")).alias("exact"),
        parse(F.col("formatted")).alias("spans"),
    )
