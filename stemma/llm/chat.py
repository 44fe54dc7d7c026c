"""Chat formatting: every assistant turn becomes a training example of its own.

An example is the formatted text of all turns up to and including one assistant turn. Only the text of
that last turn is trainable; the turns before it are context. A conversation that does not end with an
assistant turn gets one more row, its whole text without anything trainable, so no turn is lost.

A turn is written `<|im_start|>role\\ntext<|im_end|>\\n`. Control strings inside texts and roles are
escaped, and `decode` undoes it exactly:

    &    ->  &amp;
    <|   ->  &lt;|
    \\n   ->  &nl;      (roles only)

Everything is a DataFrame expression. The rows of a conversation meet once, in an array ordered by
(turn, role, text); copies of whole conversations stay apart by their conv_id. Prefixes are formatted
row by row while they are read, so a conversation of n turns never holds its n prefixes in memory at
once, and no prefix is shuffled.

Defined results: null texts and roles are empty, a null turn sorts first, rows without conv_id form the
conversation null, repeated rows are turns of their own, an empty table gives no row, other columns are
ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

START, END = "<|im_start|>", "<|im_end|>\n"


def encode(text: Column) -> Column:
    """Text without any control string."""
    return F.replace(F.replace(text, F.lit("&"), F.lit("&amp;")), F.lit("<|"), F.lit("&lt;|"))


def decode(text: Column) -> Column:
    """The text that `encode` was given."""
    return F.replace(F.replace(text, F.lit("&lt;|"), F.lit("<|")), F.lit("&amp;"), F.lit("&"))


def encode_role(role: Column) -> Column:
    return F.replace(encode(role), F.lit("\n"), F.lit("&nl;"))


def decode_role(role: Column) -> Column:
    return decode(F.replace(role, F.lit("&nl;"), F.lit("\n")))


def format_turn(role: Column, text: Column) -> Column:
    return F.concat(F.lit(START), encode_role(role), F.lit("\n"), encode(text), F.lit(END))


def expand(rows: DataFrame) -> DataFrame:
    """(conv_id, turn, role, text) to one row per example.

    Returns conv_id, example (from 1), n_context (turns before the reply; all turns in a row without
    reply), complete (the example holds the whole conversation), formatted, loss_start (characters before the trainable text), loss_chars (its length as
    written, 0 without reply).
    """
    turns = (
        rows.select("conv_id", F.struct("turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text")).alias("t"))
        .groupBy("conv_id")
        .agg(F.sort_array(F.collect_list("t")).alias("t"))
        .select(
            "conv_id",
            F.transform("t", lambda t: F.struct((t["role"] == "assistant").alias("reply"), format_turn(t["role"], t["text"]).alias("s"), F.char_length(encode(t["text"])).alias("n"))).alias("t"),
        )
    )
    at = F.filter(F.sequence(F.lit(1), F.size("t")), lambda i: F.element_at("t", i)["reply"] | (i == F.size("t")))
    return (
        turns.select("conv_id", "t", F.posexplode(at).alias("example", "i"))
        .select(
            "conv_id",
            (F.col("example") + 1).alias("example"),
            "i",
            F.element_at("t", F.col("i")).alias("last"),
            (F.col("i") == F.size("t")).alias("complete"),
            F.array_join(F.transform(F.slice("t", 1, F.col("i")), lambda t: t["s"]), "").alias("formatted"),
        )
        .select(
            "conv_id",
            "example",
            F.when(F.col("last.reply"), F.col("i") - 1).otherwise(F.col("i")).alias("n_context"),
            "complete",
            "formatted",
            F.when(F.col("last.reply"), F.char_length("formatted") - len(END) - F.col("last.n")).otherwise(F.char_length("formatted")).alias("loss_start"),
            F.when(F.col("last.reply"), F.col("last.n")).otherwise(0).alias("loss_chars"),
        )
    )


def parse(formatted: Column) -> Column:
    """Formatted text back to its array of (role, text)."""
    pieces = F.split(formatted, r"<\|im_end\|>\n", -1)
    body = F.transform(F.slice(pieces, 1, F.size(pieces) - 1), lambda p: F.substring(p, len(START) + 1, 2147483647))
    return F.transform(
        body,
        lambda p: F.struct(
            decode_role(F.substring_index(p, "\n", 1)).alias("role"),
            decode(F.substring(p, F.char_length(F.substring_index(p, "\n", 1)) + 2, F.lit(2147483647))).alias("text"),
        ),
    )


def digest(examples: DataFrame) -> DataFrame:
    """One row per conversation, read back from the formatted examples alone."""
    written = F.array_join(F.transform(parse(F.col("formatted")), lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    loss = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("example", "loss"))), lambda x: x["loss"]), "")
    return (
        examples.select(
            "conv_id",
            "example",
            decode(F.substring("formatted", F.col("loss_start") + 1, F.col("loss_chars"))).alias("loss"),
            F.char_length("formatted").cast("long").alias("n"),
            F.when(F.col("complete"), F.size(parse(F.col("formatted")))).cast("long").alias("n_turns"),
            F.when(F.col("complete"), F.sha2(written, 256)).alias("turns_sha256"),
        )
        .groupBy("conv_id")
        .agg(F.max("n_turns").alias("n_turns"), F.max("turns_sha256").alias("turns_sha256"), loss.alias("loss"), F.sum("n").alias("formatted_chars"))
        .select(
            "conv_id",
            "n_turns",
            "turns_sha256",
            F.char_length("loss").cast("long").alias("loss_chars"),
            F.sha2("loss", 256).alias("loss_sha256"),
            "formatted_chars",
        )
    )
