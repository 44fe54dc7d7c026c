"""Selecting papers for a collection: topics, years, bibliographies, profiles."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stemma.functions.text import any_word, strip
from stemma.functions.vectors import let

# Section titles of the bibliography and the category each stands for.
SECTIONS = [
    ("context_amplification", "context as exponential amplifier"),
    ("information_transformation", "information as transformation"),
    ("observer_relativity", "observer-relative information"),
    ("boundary_actors", "boundary actors, gatekeepers"),
    ("entropy_communication", "entropy generation in communication"),
    ("multidimensional_models", "multi-dimensional information models"),
    ("asymmetric_flows", "asymmetric information flows"),
    ("semantic_similarity", "semantic similarity through metadata"),
    ("transformer_architectures", "transformer architectures"),
    ("critical_perspectives", "critical and interdisciplinary"),
]


def year_range(year: Column, start: int | None = None, end: int | None = None) -> Column:
    """Both bounds, only a start (to 2099), only an end (from 1900), or no test."""
    if start is None and end is None:
        return F.lit(True)
    return year.between(1900 if start is None else start, 2099 if end is None else end)


def _first(df: DataFrame, by: list[str], order: list, n: int, name: str) -> DataFrame:
    return df.withColumn(name, F.row_number().over(Window.partitionBy(*by).orderBy(*order))).where(F.col(name) <= n)


def year_top(df: DataFrame, year: str, category: str, relevance: str, key: str, per_year: int, per_category: int | None = None) -> DataFrame:
    """Most relevant papers per year, after a first cut per category.

    Both cuts are row_number filters, which Spark also applies before the shuffle.
    """
    cut = per_category if per_category is not None else max(10, per_year // 7)
    order = [F.desc(relevance), F.col(key)]
    return _first(_first(df, [year, category], order, cut, "_c").drop("_c"), [year], order, per_year, "rank")


def gather_topics(df: DataFrame, topics: dict[str, list[str]], text: str, key: str, per_topic: int, years: tuple | None = None) -> DataFrame:
    """(topic, paper) for papers holding any term of the topic, each paper once per topic."""
    low = F.lower(F.col(text))
    hits = F.array_compact(F.array(*[F.when(any_word(low, terms), F.lit(t)) for t, terms in topics.items()]))
    d = df.where(year_range(F.col("year"), *years)) if years else df
    d = d.select(key, F.explode(hits).alias("topic")).distinct()
    return _first(d, ["topic"], [F.col(key)], per_topic, "_r").drop("_r")


def gather_queries(df: DataFrame, topics: dict[str, list[str]], text: str, key: str, per_topic: int, years: tuple | None = None) -> DataFrame:
    """(topic, paper, query, hits): each query of a topic gets an equal share of `per_topic`, filled in the
    order of relevance (how often the query's term occurs); a paper counts once per topic, for its best query.
    """
    d = df.where(year_range(F.col("year"), *years)) if years else df
    low = F.lower(F.col(text))
    found = [
        F.struct(F.lit(t).alias("topic"), F.lit(q).alias("query"), F.lit(max(1, per_topic // len(qs))).alias("share"), F.regexp_count(low, F.lit(re.escape(q.lower()))).alias("hits"))
        for t, qs in topics.items() for q in qs
    ]
    rows = d.select(key, F.inline(F.filter(F.array(*found), lambda x: x["hits"] > 0)))
    best = rows.groupBy("topic", key).agg(F.max(F.struct("hits", "query", "share")).alias("b"))  # on equal hits the later query by name
    order = Window.partitionBy("topic", "query").orderBy(F.desc("hits"), key)
    ranked = best.select("topic", key, "b.*").withColumn("_r", F.row_number().over(order))
    return ranked.where(F.col("_r") <= F.col("share")).select("topic", key, "query", "hits")


def relevant(text: Column, keywords: list[str], floor: int = 2) -> Column:
    return reduce(lambda a, b: a + b, [F.contains(F.lower(text), F.lit(k)).cast("int") for k in keywords]) >= floor


def profile(df: DataFrame, year: str, categories: str, top: int = 10) -> DataFrame:
    """Papers per year, and the most frequent categories."""
    y = df.groupBy(F.col(year).cast("string").alias("value")).agg(F.count("*").alias("n")).select(F.lit("year").alias("facet"), "value", "n")
    c = df.select(F.explode(categories).alias("value")).groupBy("value").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "value").limit(top)
    return y.unionByName(c.select(F.lit("category").alias("facet"), "value", "n"))


def category_of(arxiv_id: Column, text_low: Column) -> Column:
    """Category of the section title that stands closest before the paper's id; `general` without one."""
    at = F.instr(text_low, arxiv_id)
    # a substring test on bytes comes first: counting characters up to a title is slow, and most are absent
    where = lambda t: F.when(F.contains(text_low, F.lit(t)), F.instr(text_low, F.lit(t))).otherwise(F.lit(0))
    heads = F.array(*[F.struct(where(t).alias("at"), F.lit(-i).alias("order"), F.lit(c).alias("category")) for i, (c, t) in enumerate(SECTIONS)])
    before = F.array_max(F.filter(heads, lambda h: (h["at"] > 0) & (h["at"] < at)))
    return F.coalesce(before["category"], F.lit("general"))


def bibliography(df: DataFrame, key: str, text: str) -> DataFrame:
    """Lines that carry an arXiv id, with author and title where the line marks them.

    Lines are matched inside the row, so that only entries leave it and the text is not copied per line.
    """
    pattern = r"arXiv:(\d{4}\.\d{4,5})"
    marked = r'\*\*(.*?)\*\*.*?"(.*?)"'

    def entry(line, arxiv_id, low):
        found = line.rlike(marked)
        return F.struct(
            arxiv_id.alias("arxiv_id"), F.when(found, strip(F.regexp_extract(line, marked, 1))).otherwise(F.lit("Unknown")).alias("author"),
            F.when(found, strip(F.regexp_extract(line, marked, 2))).otherwise(strip(line)).alias("title"), strip(line).alias("line"),
            category_of(F.lower(arxiv_id), low).alias("category"),
        )

    hits = F.filter(F.split(text, "\n"), lambda x: x.rlike(pattern))
    # lambda variables hold the lowered text and the id, so that neither is computed once per use
    entries = let(F.lower(F.col(text)), lambda low: F.transform(hits, lambda line: let(F.regexp_extract(line, pattern, 1), lambda i: entry(line, i, low))))
    return df.where(F.contains(text, F.lit("arXiv:"))).select(key, F.inline(entries))
