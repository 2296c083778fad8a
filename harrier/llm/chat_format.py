r"""Chat formatting with a grammar round trip, in DataFrame functions only.

A conversation is rendered turn by turn, ordered by turn number (then role and text, so that ties have an order):

    user        <s>[INST] text [/INST]
    assistant   (blank)text </s>
    any other   [ROLE] hex-of-role text [/ROLE]

The rendering is parsed again by a regular grammar whose alternatives start with different characters, and the
recovered turns are compared with the source. A conversation that doesn't come back identical has its conflicting
content escaped: a backslash goes before each control string inside a text, and parsing takes one away again.
After that no control string inside a text follows a blank, so the parser can't mistake it for a delimiter, and
the second round always comes back identical; ``identical`` reports the comparison with the final rendering.

The loss mask is given by ``segments``: the formatted text in pieces, each in the loss or not. Only the texts of
assistant turns are. Null roles and texts are empty; a null turn number comes first; rows with a null conversation
id form one conversation; repeated rows are turns of their own. Other columns are not read. A conversation is one
training sample, so its turns are gathered into one row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Control strings of the template.
CONTROL = r"</?s>|\[/?INST\]|\[/?ROLE\]"
#: The grammar of one rendered turn.
TURN = r"(?s)<s>\[INST\] .*? \[/INST\]|\[ROLE\] [0-9A-F]* .*? \[/ROLE\]| .*? </s>"


def escape(text: Column) -> Column:
    return F.regexp_replace(text, f"({CONTROL})", r"\\$1")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, rf"\\({CONTROL})", "$1")


def _pieces(role: Column, text: Column) -> tuple[Column, Column]:
    """What stands before and after the text of a turn."""
    user, assistant = role == "user", role == "assistant"
    before = F.when(user, "<s>[INST] ").when(assistant, " ").otherwise(F.concat(F.lit("[ROLE] "), F.hex(F.encode(role, "UTF-8")), F.lit(" ")))
    after = F.when(user, " [/INST]").when(assistant, " </s>").otherwise(" [/ROLE]")
    return before, after


def _render(turns: Column, change) -> Column:
    def one(t: Column) -> Column:
        before, after = _pieces(t["role"], t["text"])
        return F.concat(before, change(t["text"]), after)

    return F.transform(turns, one)


def _recover(piece: Column) -> Column:
    """Role and text of one parsed turn."""

    def inner(first: int | Column, last: int) -> Column:
        return unescape(F.substring(piece, F.lit(first) + 1, F.length(piece) - F.lit(first) - last))

    name = F.regexp_extract(piece, r"^\[ROLE\] ([0-9A-F]*) ", 1)
    other = F.struct(F.decode(F.unhex(name), "UTF-8").alias("role"), inner(F.length(name) + 8, 8).alias("text"))
    user = F.struct(F.lit("user").alias("role"), inner(10, 8).alias("text"))
    assistant = F.struct(F.lit("assistant").alias("role"), inner(1, 5).alias("text"))
    return F.when(piece.startswith("<"), user).when(piece.startswith(" "), assistant).otherwise(other)


def format_conversations(conversations: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """conv id, formatted, escaped (whether that was needed), recovered turns, identical, and segments with the loss mask."""
    rows = conversations.select(
        F.col(conv).alias("conv_id"),
        F.struct(F.col(turn).alias("turn"), F.coalesce(F.col(role), F.lit("")).alias("role"), F.coalesce(F.col(text), F.lit("")).alias("text")).alias("t"),
    )
    turns = rows.groupBy("conv_id").agg(F.sort_array(F.collect_list("t")).alias("turns"))
    # first round: as it is
    plain = turns.withColumn("plain", _render(F.col("turns"), lambda x: x))
    plain = plain.withColumn("parsed", F.regexp_extract_all(F.array_join("plain", ""), F.lit(TURN), F.lit(0)))
    same = (F.col("parsed") == F.col("plain")) & ~F.exists("turns", lambda t: t["text"].rlike(rf"\\({CONTROL})"))
    # second round, where the first didn't come back identical: escape conflicting content
    chosen = plain.select("conv_id", "turns", "plain", (~same).alias("escaped"))
    chosen = chosen.select("conv_id", "turns", "escaped", F.when(F.col("escaped"), _render(F.col("turns"), escape)).otherwise(F.col("plain")).alias("rendered"))
    final = chosen.select("conv_id", "turns", "escaped", F.array_join("rendered", "").alias("formatted"))
    parsed = final.withColumn("parsed", F.regexp_extract_all("formatted", F.lit(TURN), F.lit(0)))
    recovered = parsed.withColumn("recovered", F.transform("parsed", _recover))

    def in_loss(piece: Column) -> Column:
        body = F.substring(piece, F.lit(2), F.length(piece) - 6)
        masked = F.array(*(F.struct(t.alias("text"), F.lit(m).alias("in_loss")) for t, m in ((F.lit(" "), False), (body, True), (F.lit(" </s>"), False))))
        return F.when(piece.startswith(" "), masked).otherwise(F.array(F.struct(piece.alias("text"), F.lit(False).alias("in_loss"))))

    source = F.transform("turns", lambda t: F.struct(t["role"].alias("role"), t["text"].alias("text")))
    return recovered.select(
        "conv_id",
        "formatted",
        "escaped",
        "recovered",
        (F.col("recovered") == source).alias("identical"),
        F.flatten(F.transform("parsed", in_loss)).alias("segments"),
    )
