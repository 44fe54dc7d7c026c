"""Splitting texts into chunks, sections and windows. Each document is cut inside its own row: no shuffle."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stemma.functions.text import D, HEADER, lines_of, strip, words_of


def fixed_chunks(df: DataFrame, text: str = "text", size: int = 8000, whole_up_to: int = 10000) -> DataFrame:
    """Slices of `size` characters for texts longer than `whole_up_to`, else the text itself."""
    t = F.col(text)
    starts = F.when(F.length(t) > whole_up_to, F.sequence(F.lit(0), F.length(t) - 1, F.lit(size))).otherwise(F.array(F.lit(0)))
    cut = F.when(F.length(t) > whole_up_to, F.substring(t, F.col("_s") + 1, F.lit(size))).otherwise(t)
    return df.select("*", F.posexplode(starts).alias("chunk_index", "_s")).withColumn("chunk", cut).drop("_s", text)


def token_windows(df: DataFrame, text: str = "text", size: int = 512, overlap: int = 128) -> DataFrame:
    """Overlapping windows of whitespace tokens, stepping size - overlap; the tail window may be short."""
    d = df.withColumn("_w", words_of(F.col(text)))
    starts = F.when(F.size("_w") > 0, F.sequence(F.lit(0), F.size("_w") - 1, F.lit(size - overlap)))
    return (
        d.select("*", F.posexplode(starts).alias("chunk_index", "token_start"))
        .withColumn("_t", F.slice("_w", F.col("token_start") + 1, F.lit(size)))
        .withColumn("n_tokens", F.size("_t"))
        .withColumn("chunk", F.array_join("_t", " "))
        .drop("_w", "_t", text)
    )


def line_chunks(df: DataFrame, text: str = "text", size: int = 100) -> DataFrame:
    d = df.withColumn("_l", lines_of(F.col(text)))
    starts = F.when(F.size("_l") > 0, F.sequence(F.lit(0), F.size("_l") - 1, F.lit(size)))
    return (
        d.select("*", F.posexplode(starts).alias("chunk_index", "_s"))
        .withColumn("_t", F.slice("_l", F.col("_s") + 1, F.lit(size)))
        .select("*", (F.col("_s") + 1).alias("line_start"), (F.col("_s") + F.size("_t")).alias("line_end"), F.array_join("_t", "\n").alias("chunk"))
        .drop("_l", "_s", "_t", text)
    )


def sections(df: DataFrame, text: str = "text") -> DataFrame:
    """One row per markdown header with the lines from it up to the next header; lines before the first header belong to none."""
    d = df.withColumn("_l", lines_of(F.col(text)))
    at = F.array_compact(F.transform("_l", lambda x, i: F.when(x.rlike(HEADER), i)))
    d = d.withColumn("_h", at).withColumn("_n", F.size("_l"))
    d = d.select("*", F.posexplode("_h").alias("section_index", "line_number"))
    stop = F.coalesce(F.get("_h", F.col("section_index") + 1), F.col("_n"))
    head = F.get("_l", F.col("line_number"))
    return d.select(
        *[c for c in df.columns if c != text],
        "section_index",
        "line_number",
        F.length(F.regexp_extract(head, HEADER, 1)).alias("level"),
        strip(F.regexp_extract(head, HEADER, 2)).alias("title"),
        F.array_join(F.slice("_l", F.col("line_number") + 1, stop - F.col("line_number")), "\n").alias("content"),
    )


def _packing_starts(lengths: Column, limit: int) -> Column:
    """Index of the first paragraph of every chunk, by a fold over the paragraph lengths."""
    zero = F.struct(F.lit(0).alias("cur"), F.lit(0).alias("i"), F.array().cast("array<int>").alias("starts"))

    def step(acc, n):
        fits = acc["cur"] + n < limit
        opens = (acc["i"] == 0) | ~fits
        return F.struct(
            F.when(fits, acc["cur"] + n + 2).otherwise(n + 2).alias("cur"),
            (acc["i"] + 1).alias("i"),
            F.when(opens, F.array_append(acc["starts"], acc["i"])).otherwise(acc["starts"]).alias("starts"),
        )

    return F.aggregate(lengths, zero, step, lambda acc: acc["starts"])


def paragraph_chunks(df: DataFrame, text: str = "text", limit: int = 8000) -> DataFrame:
    """Paragraphs packed greedily while the chunk stays under `limit`; texts up to `limit` stay whole."""
    t = F.col(text)
    d = df.withColumn("_long", F.length(t) > limit).withColumn("_p", F.when(F.col("_long"), F.split(t, "\n\n")))
    d = d.withColumn("_s", F.when(F.col("_long"), _packing_starts(F.transform("_p", F.length), limit)).otherwise(F.array(F.lit(0))))
    d = d.select("*", F.posexplode("_s").alias("chunk_index", "_a"))
    stop = F.coalesce(F.get("_s", F.col("chunk_index") + 1), F.size("_p"))
    joined = strip(F.array_join(F.slice("_p", F.col("_a") + 1, stop - F.col("_a")), "\n\n"))
    return d.withColumn("chunk", F.when(F.col("_long"), joined).otherwise(t)).drop("_long", "_p", "_s", "_a", text)


def table_rows(text: Column) -> Column:
    """Cells of pipe-table lines of a text, without the rule line."""
    lines = F.filter(lines_of(text), lambda x: x.rlike(r"^\s*\|.*\|\s*$") & ~x.rlike(r"^[\s|:-]+$"))
    return F.transform(lines, lambda x: F.transform(F.split(F.regexp_replace(strip(x), r"^\||\|$", ""), r"\|"), strip))


def numbered_lines(text: Column) -> Column:
    return F.filter(lines_of(text), lambda x: x.rlike(rf"^{D}+[\.)]\s+"))
