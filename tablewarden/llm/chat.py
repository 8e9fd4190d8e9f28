"""Chat formatting by prefix-target expansion, in DataFrame functions alone.

Every assistant turn becomes an example of its own: all turns before it are context, and only its text is trainable.  A conversation
that does not end with an assistant turn gets one more example of all its turns with nothing to train, so what was formatted can
be read back whole.

Template: ``<s>role\\ntext</s>`` per turn.  ``<s>``, ``</s>``, ``[INST]`` and ``[/INST]`` are control strings.  One that occurs inside
a role or text, with any number of backslashes after its first character, gets one backslash more there, so a text never holds a
control string, and taking that backslash away gives the text back.  In a role a backslash is written ``\\0`` and a line end ``\\1``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import rows_of

OPEN, CLOSE = "<s>", "</s>"
CONTROL = r"(/?(?:s>|INST\]))"
REPLY = "assistant"


def escape(text: Column) -> Column:
    return F.regexp_replace(text, r"([<\[])(\\*)" + CONTROL, r"$1\\$2$3")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"([<\[])\\(\\*)" + CONTROL, "$1$2$3")


def _role_out(role: Column) -> Column:
    return escape(F.replace(F.replace(role, F.lit("\\"), F.lit("\\0")), F.lit("\n"), F.lit("\\1")))


def _role_in(role: Column) -> Column:
    return F.replace(F.replace(unescape(role), F.lit("\\1"), F.lit("\n")), F.lit("\\0"), F.lit("\\"))


def examples(turns: DataFrame, id_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """One row per assistant turn, and one per conversation that ends with another: ``conv_id``, ``example`` (from 0, in order),
    ``text``, ``loss_start``, ``loss_stop`` (code points of ``text``, the stop exclusive; null where nothing is trained), ``whole``
    (true for the last example, which holds all turns).

    Turns stand in the order of turn (null first), role, text; repeated turns are all kept.  Null roles and texts count as empty; an
    empty reply is an example with an empty span.  Rows without conversation id form one conversation.  An empty table gives
    no rows.  Turns of a conversation meet in one row, because its last example holds them all in one text; the examples are
    made from that row one at a time, and no example is shuffled.
    """
    flat = rows_of(turns, conv_id=F.col(id_col).cast("bigint"), turn=F.col(turn_col).cast("bigint"), role=F.coalesce(F.col(role_col), F.lit("")),
                   text=F.coalesce(F.col(text_col), F.lit("")))
    held = flat.groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("turn", "role", "text"))).alias("turns"))
    piece = lambda t: F.concat(F.lit(OPEN), _role_out(t["role"]), F.lit("\n"), escape(t["text"]), F.lit(CLOSE))
    last = F.size("turns")
    places = F.filter(F.sequence(F.lit(1), last), lambda i: (F.get("turns", i - 1)["role"] == REPLY) | (i == last))
    cut = held.select("conv_id", F.transform("turns", piece).alias("pieces"), (F.element_at("turns", -1)["role"] == REPLY).alias("closed"), places.alias("places"))
    spread = cut.select("conv_id", "pieces", "closed", F.size("places").alias("n"), F.posexplode("places").alias("example", "stop"))
    whole = F.col("example") == F.col("n") - 1
    trained = ~whole | F.col("closed")
    made = spread.select("conv_id", "example", F.array_join(F.slice("pieces", F.lit(1), F.col("stop")), "").alias("text"),
                         F.length(F.get("pieces", F.col("stop") - 1)).alias("reply"), trained.alias("trained"), whole.alias("whole"))
    head, size = len(f"{OPEN}{REPLY}\n"), F.length("text")
    return made.select("conv_id", "example", "text", F.when(F.col("trained"), size - F.col("reply") + head).cast("bigint").alias("loss_start"),
                       F.when(F.col("trained"), size - len(CLOSE)).cast("bigint").alias("loss_stop"), "whole")


def parse(text: Column) -> Column:
    """The turns of a formatted text as an array of ``role``, ``text``."""
    parts = F.split(text, CLOSE, -1)

    def turn(part: Column) -> Column:
        at = F.instr(part, "\n")
        return F.struct(_role_in(F.substring(part, F.lit(len(OPEN) + 1), at - (len(OPEN) + 1))).alias("role"),
                        unescape(F.substring(part, at + 1, F.length(part))).alias("text"))

    return F.transform(F.slice(parts, F.lit(1), F.size(parts) - 1), turn)


def masked(text: Column, start: Column, stop: Column) -> Column:
    """What the loss mask covers, unescaped."""
    return unescape(F.substring(text, (start + 1).cast("int"), (stop - start).cast("int")))


def read_back(made: DataFrame) -> DataFrame:
    """Per conversation, from the formatted texts and masks of ``examples``: ``conv_id``, ``turns`` (array of role, text), ``replies``
    (trained texts in order, nothing between), ``formatted_chars`` (code points of all its examples)."""
    read = made.select("conv_id", "example", F.when(F.col("whole"), parse(F.col("text"))).alias("turns"),
                       masked(F.col("text"), F.col("loss_start"), F.col("loss_stop")).alias("loss"), F.length("text").cast("bigint").alias("n"))
    told = read.groupBy("conv_id").agg(
        F.first("turns", ignorenulls=True).alias("turns"), F.sum("n").alias("formatted_chars"),
        F.sort_array(F.collect_list(F.when(F.col("loss").isNotNull(), F.struct("example", "loss")))).alias("losses"))
    return told.select("conv_id", "turns", F.array_join(F.col("losses.loss"), "").alias("replies"), "formatted_chars")


def digests(told: DataFrame) -> DataFrame:
    """``conv_id``, ``n_turns``, ``turns_sha256``, ``loss_chars``, ``loss_sha256``, ``formatted_chars`` of ``read_back``."""
    lines = F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n")))
    return told.select("conv_id", F.size("turns").cast("bigint").alias("n_turns"), F.sha2(F.array_join(lines, ""), 256).alias("turns_sha256"),
                       F.length("replies").cast("bigint").alias("loss_chars"), F.sha2("replies", 256).alias("loss_sha256"), "formatted_chars")
