"""Audit of how filters interact: what each of them removes in every order, and its Shapley value.

**Removal game.** A coalition S of filters removes v(S) documents: those that fail at least one of them.
All that an audit asks follows from v on the 2^k coalitions of k filters. Documents are counted once per
part by the set of filters they fail, so 2^k counts per part stand for all of them; no order is replayed.

**Potential.** The potential P of Hart and Mas-Colell is P(empty) = 0 and
|S| P(S) = v(S) + sum of P(S without f) over f in S. It is computed from smaller coalitions to larger
ones, as the integer |S|! P(S). The Shapley value of f is P(all) - P(all without f); times k! it is a whole
number, the documents that f removes summed over all orders. The step that applies f after the coalition
S removes v(S with f) - v(S), and likewise for documents with a good or a toxic label.

**Copies** (filter E) are found without a join to the texts: rows are counted by digest and part with the
smallest id among them, and the smallest id of a digest tells which of its rows do not fail.

Defined results: a null text counts as empty; a text without words has 0 distinct words and fails A, not B
or C; rows that repeat the smallest id of their text do not fail E, nor do rows without id, and these make
no other row fail; a document is good (toxic) if any of its label rows says so; a null source is the part
'', together with empty names; an empty table gives no row; other columns are ignored.
"""

from __future__ import annotations

from itertools import permutations
from math import factorial

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stemma.session import cut_lineage

LETTERS = "ABCDE"
LEAST_WORDS, DISTINCT_PERCENT, CAPITAL_PERCENT = 200, 50, 2
SPACE, SYMBOLS = r"[\x20\x09-\x0D]+", "[#$%&*|]"


def text_failures(text: Column) -> Column:
    """Bits of the filters A to D that a text fails."""
    inner = F.btrim(text, F.lit(" \t\n\x0b\x0c\r"))
    words = F.when(inner == "", F.array().cast("array<string>")).otherwise(F.split(inner, SPACE))
    n, distinct = F.size(words), F.size(F.array_distinct(words))
    capitals = F.octet_length(F.regexp_replace(text, "[^A-Z]+", ""))
    tests = [
        n < LEAST_WORDS,
        F.lit(100) * distinct < F.lit(DISTINCT_PERCENT) * n,
        F.lit(100) * capitals > F.lit(CAPITAL_PERCENT) * F.char_length(text),
        text.rlike(SYMBOLS),
    ]
    mask = F.lit(0)
    for k, failed in enumerate(tests):
        mask = mask + F.when(failed, 1 << k).otherwise(0)
    return mask


def failure_counts(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(part, mask, n, good, toxic): documents of each part by the set of filters they fail."""
    text = F.coalesce("text", F.lit(""))
    rows = docs.select("doc_id", F.coalesce("source", F.lit("")).alias("part"), text.alias("t"))
    rows = rows.select("doc_id", "part", F.unhex(F.sha2("t", 256)).alias("digest"), text_failures(F.col("t")).alias("mask"))
    rows = rows.groupBy("doc_id", "part", "digest", "mask").agg(F.count("*").alias("n"))
    marks = labels.groupBy("doc_id").agg(F.max((F.col("quality") == 1).cast("int")).alias("is_good"), F.max((F.col("toxic") == 1).cast("int")).alias("is_toxic"))
    rows = rows.join(marks, "doc_id", "left").select("doc_id", "part", "digest", "mask", "n", *[(F.col("n") * F.coalesce(f"is_{c}", F.lit(0))).alias(c) for c in ("good", "toxic")])
    counts = ["n", "good", "toxic"]
    unnamed = F.col("doc_id").isNull()
    sums = rows.groupBy("digest", "part", "mask", unnamed.alias("unnamed")).agg(
        F.min("doc_id").alias("first"), *[F.sum(c).alias(c) for c in counts], *[F.min_by(c, "doc_id").alias(f"first_{c}") for c in counts]
    )
    sums = cut_lineage(sums)
    smallest = sums.groupBy("digest").agg(F.min("first").alias("smallest"))
    sums = sums.join(smallest, "digest")
    copy = 1 << 4
    kept = lambda c: F.when(F.col("unnamed"), F.col(c)).when(F.col("first") == F.col("smallest"), F.col(f"first_{c}")).otherwise(0)
    both = F.array(F.struct(F.col("mask"), *[kept(c).alias(c) for c in counts]), F.struct((F.col("mask") + copy).alias("mask"), *[(F.col(c) - kept(c)).alias(c) for c in counts]))
    cells = sums.select("part", F.inline(both))
    return cells.groupBy("part", "mask").agg(*[F.sum(c).alias(c) for c in counts])


def potentials(v: str, k: int) -> Column:
    """|S|! P(S) for all coalitions S of k filters in the order of their bits, from the array of v(S)."""
    smaller = " + ".join(f"IF(s & {1 << i} <> 0, element_at(q, s - {1 << i} + 1), 0L)" for i in range(k))
    weights = ", ".join(f"{factorial(i)}L" for i in range(k))
    one = f"element_at(array({weights}), bit_count(s)) * element_at({v}, s + 1) + {smaller}"
    return F.expr(f"aggregate(sequence(1, {(1 << k) - 1}), array(0L), (q, s) -> concat(q, array({one})))")


def audit(cells: DataFrame, letters: str = LETTERS) -> DataFrame:
    """One row per part, order of the filters and step, from the counts of `failure_counts`."""
    k = len(letters)
    every = (1 << k) - 1
    game = lambda c: F.array(*[F.sum(F.when(F.col("mask").bitwiseAND(s) != 0, F.col(c)).otherwise(0)) for s in range(every + 1)])
    parts = cells.groupBy("part").agg(F.sum("n").alias("total"), game("n").alias("v"), game("good").alias("good"), game("toxic").alias("toxic"))
    parts = parts.withColumn("q", potentials("v", k))
    orders = parts.withColumn("filter_order", F.explode(F.array(*[F.lit("".join(p)) for p in permutations(letters)])))
    steps = orders.withColumn("step", F.explode(F.sequence(F.lit(1), F.lit(k))))
    bits = lambda some: sum((F.when(F.instr(some, c) > 0, 1 << i).otherwise(0) for i, c in enumerate(letters)), F.lit(0))
    steps = steps.withColumn("own", bits(F.substring("filter_order", F.col("step"), F.lit(1)))).withColumn("before", bits(F.substring("filter_order", F.lit(1), F.col("step") - 1)))
    at = lambda c, s: F.element_at(c, s + 1)
    after, own, before = F.col("before") + F.col("own"), F.col("own"), F.col("before")
    gone = lambda c: at(c, after) - at(c, before)
    return steps.select(
        "part",
        "filter_order",
        "step",
        (F.col("total") - at("v", after)).alias("kept"),
        gone("v").alias("removed"),
        (at("v", own) - gone("v")).alias("redundant"),
        (at("v", F.lit(every)) - at("v", F.lit(every) - own)).alias("unique_fails"),
        gone("good").alias("good_lost"),
        gone("toxic").alias("toxic_lost"),
        (at("q", F.lit(every)) - F.lit(k) * at("q", F.lit(every) - own)).alias("shapley"),
    )
