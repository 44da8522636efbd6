"""Prefix-target expansion of conversations, by DataFrame functions alone.

Every assistant turn becomes an example: all preceding turns as context and that
reply as the only trainable text.  Template of a turn::

    ### <role, percent-encoded>\\n<text, escaped></turn>\\n

Escaping doubles backslashes, then breaks control strings inside (``</turn>`` to
``<\\/turn>``, ``###`` to ``#\\##``), so neither ever appears in a text; dropping
one backslash before any character undoes it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

END = "</turn>\n"


def escape(text: Column) -> Column:
    out = F.replace(text, F.lit("\\"), F.lit("\\\\"))
    out = F.replace(out, F.lit("</turn>"), F.lit("<\\/turn>"))
    return F.regexp_replace(out, "#(?=##)", "#\\\\")  # overlapping runs too: no three are left together


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"(?s)\\(.)", "$1")


def examples(turns: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """``(conv_id, n_turns, target, formatted, loss_start, loss_length)``, a row per assistant turn.

    ``loss_start`` and ``loss_length`` count code points of ``formatted``; the
    span holds the escaped reply without its markers.  A conversation that does
    not end with the assistant has one more example, of all its turns, that
    trains nothing, so no turn is lost.  Turns are ordered by turn (null first),
    then role and text; repeated rows are turns of their own.  A null role or
    text is empty; a null conversation id is a conversation.
    """
    turn = F.struct(F.col(turn_col).alias("turn"), F.coalesce(F.col(role_col).cast("string"), F.lit("")).alias("role"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    # a conversation is one record: its last example holds all of it in any case
    convs = turns.select(F.col(conv_col).alias("conv_id"), turn.alias("t")).groupBy("conv_id").agg(F.sort_array(F.collect_list("t")).alias("turns"))
    heads = F.transform("turns", lambda t: F.concat(F.lit("### "), F.url_encode(t["role"]), F.lit("\n")))
    bodies = F.transform("turns", lambda t: escape(t["text"]))
    convs = convs.select("conv_id", "turns", heads.alias("heads"), bodies.alias("bodies"))
    convs = convs.select("conv_id", F.transform("turns", lambda t: t["role"]).alias("roles"), F.zip_with("heads", "bodies", lambda h, b: F.concat(h, b, F.lit(END))).alias("parts"), F.transform("heads", F.length).alias("head_chars"), F.transform("bodies", F.length).alias("body_chars"))
    kept = convs.select("*", F.posexplode("roles").alias("target", "role")).filter("role = 'assistant' OR target = size(roles) - 1")
    formatted = F.array_join(F.slice("parts", F.lit(1), F.col("target") + 1), "")
    trained = F.col("role") == "assistant"
    reply = F.when(trained, F.get("body_chars", F.col("target"))).otherwise(0)
    return kept.select(
        "conv_id",
        (F.col("target") + 1).cast("bigint").alias("n_turns"),
        "target",
        formatted.alias("formatted"),
        (F.length(formatted) - len(END) - F.when(trained, reply).otherwise(-len(END))).cast("bigint").alias("loss_start"),
        reply.cast("bigint").alias("loss_length"),
    )


def parse(formatted: Column) -> Column:
    """The turns of a formatted text: an array of (role, text)."""
    raw = F.split(formatted, END)
    turns = F.slice(raw, F.lit(1), F.size(raw) - 1)
    return F.transform(turns, lambda t: F.struct(
        F.url_decode(F.substring_index(F.substr(t, F.lit(5)), "\n", 1)).alias("role"),
        unescape(F.substr(t, F.instr(t, "\n") + 1)).alias("text"),
    ))


def digests(formatted: DataFrame) -> DataFrame:
    """A row per conversation, from its examples alone: turns read back from the longest, replies from the masks."""
    loss = unescape(F.substr("formatted", (F.col("loss_start") + 1).cast("int"), F.col("loss_length").cast("int")))
    marked = formatted.select("conv_id", "n_turns", "formatted", F.length("formatted").alias("chars"), F.struct("target", F.when(F.col("loss_length") > 0, loss).otherwise("").alias("text")).alias("loss"))
    by = marked.groupBy("conv_id").agg(F.max_by("formatted", "n_turns").alias("whole"), F.sort_array(F.collect_list("loss")).alias("losses"), F.sum("chars").alias("formatted_chars"))
    said = F.array_join(F.transform("losses", lambda x: x["text"]), "")
    by = by.select("conv_id", parse(F.col("whole")).alias("turns"), said.alias("said"), "formatted_chars")
    lines = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return by.select("conv_id", F.size("turns").cast("bigint").alias("n_turns"), F.sha2(lines.cast("binary"), 256).alias("turns_sha256"), F.length("said").cast("bigint").alias("loss_chars"), F.sha2(F.col("said").cast("binary"), 256).alias("loss_sha256"), F.col("formatted_chars").cast("bigint").alias("formatted_chars"))
