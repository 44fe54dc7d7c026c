"""URL filter: host rules first, then a classifier over the words of segmented host names and paths.

Host names glue words together. A unigram model splits them: the Viterbi path over a name is the most
likely sequence of words, where an unknown run of n characters costs as much as in the usual unigram
segmenters, 10 / (N * 10**n). Its lexicon is counted over all urls, once per host: parts of names that
hyphens or paths show apart, and names that at least two hosts use. The words of `SEEDS` are always in.

Urls whose segmented host holds a word of `BLOCK_WORDS` are the first examples to block, all others to
allow. A multinomial naive Bayes model is counted over the words of all urls of both kinds and judges
each url that no rule decides; words seen beside the seeds count against a url as well.

The lexicon and the model hold every word that was counted. Up to `MAX_WORDS` of them travel to the
tasks; a larger lexicon or model stays a table and is joined, to the pieces of distinct names that could
be words and to the words of distinct urls, with the same results.

Defined results: host and path are empty if the url is null or has no `://`; such urls have no words
and get the verdict of the prior; repeated rows are judged alike; an empty table gives no row; other
columns are passed on, those named like a result are replaced.
"""

from __future__ import annotations

import functools
import math
import re
from typing import NamedTuple

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stemma.session import cut_lineage

MAX_WORDS = 50_000
LONGEST_WORD = 24

# Words whose presence in a host marks the first examples to block.
BLOCK_WORDS = (
    "ad ads adserver adult betting bets bet casino escort gambling hacked jackpot keygen lottery malware payday phish phishing pills "
    "poker porn sex slots spam spyware track tracker tracking viagra warez xxx"
).split()
# Frequent words of host names, so that the first names can be split.
SEEDS = BLOCK_WORDS + (
    "best blog book books buy cash cheap cloud code daily data deal deals doc docs farm food forum free game games health help home "
    "hot house info life live loan loans mail market media money music net news now online page photo play poster pro school shop "
    "site sky soft sport store tech the top travel video web wiki win winner work world"
).split()

_TOKEN = re.compile(r"[^\W_]+")


def host_of(url: Column) -> Column:
    host = F.regexp_extract(url, "://([^/?#]*)", 1)
    return F.coalesce(F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), F.lit(""))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, "://[^/?#]*([^?#]*)", 1), F.lit(""))


def rule_of(host: Column, path: Column, rules: list[tuple[str, str]]) -> tuple[Column, Column]:
    """The longest of the (verdict, rule) that fits and its verdict, both null if none does."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for kind, text in sorted(rules, key=lambda r: (len(r[1]), r[1])):
        at = text.index("/")
        name, start = text[:at], text[at:]
        fits = ((host == name) | host.endswith("." + name)) & path.startswith(start)
        rule, verdict = F.when(fits, F.lit(text)).otherwise(rule), F.when(fits, F.lit(kind)).otherwise(verdict)
    return rule, verdict


class Segmenter:
    """Most likely words of a name under unigram counts; total is given if counts are a part of them."""

    def __init__(self, counts: dict[str, int], total: int | None = None):
        self.total = max(2, sum(counts.values()) if total is None else total)
        self.cost = {w: math.log(self.total / c) for w, c in counts.items()}
        self.longest = max([1, *map(len, counts)])
        self._remember()

    def _remember(self):
        self.split = functools.lru_cache(maxsize=100_000)(self._split)

    def __getstate__(self):
        return {k: v for k, v in self.__dict__.items() if k != "split"}

    def __setstate__(self, state):
        self.__dict__.update(state)
        self._remember()

    def _split(self, name: str) -> tuple[str, ...]:
        if len(name) < 4 or not name.isalpha():
            return (name,)
        unknown, n = math.log(self.total / 10), len(name)
        best = [(0.0, 0)] + [(math.inf, 0)] * n
        for end in range(1, n + 1):
            for start in range(max(0, end - max(self.longest, LONGEST_WORD)), end):
                word = name[start:end]
                c = best[start][0] + self.cost.get(word, unknown + (end - start) * math.log(10))
                if c < best[end][0]:
                    best[end] = (c, start)
        if math.isinf(best[n][0]) or best[n][1] == 0:
            return (name,)
        words, end = [], n
        while end:
            words.append(name[best[end][1] : end])
            end = best[end][1]
        return tuple(reversed(words))

    def words(self, host: str, path: str) -> list[str]:
        """Words of a host and, marked by a slash, of a path; numbers are one word."""
        return [mark + w for mark, t in _names(host, path) for w in self.split(t)]


class Lexicon(NamedTuple):
    """Counts of more words than travel to the tasks: a table (word, n) and its total."""

    counts: DataFrame
    total: int

    def split(self, names: DataFrame) -> DataFrame:
        """(name, parts) of distinct names; each looks up those of its pieces that are words."""
        n, total = F.length("name"), self.total
        ends = lambda i: F.sequence(F.lit(2), F.least(F.lit(LONGEST_WORD), n - i + 1))
        pieces = F.flatten(F.transform(F.sequence(F.lit(1), n - 1), lambda i: F.transform(ends(i), lambda k: F.col("name").substr(i, k))))
        long = names.where((F.length("name") >= 4) & ~F.col("name").rlike("[0-9]"))
        found = long.select("name", F.explode(F.array_distinct(pieces)).alias("word")).join(self.counts, "word")
        known = found.groupBy("name").agg(F.collect_list("word").alias("words"), F.collect_list("n").alias("ns"))

        @F.pandas_udf("array<string>")
        def parts(name: pd.Series, words: pd.Series, ns: pd.Series) -> pd.Series:
            has = [{} if w is None else dict(zip(w, map(int, c))) for w, c in zip(words, ns)]
            return pd.Series([list(Segmenter(h, total)._split(x)) for x, h in zip(name, has)], dtype=object)

        return names.join(known, "name", "left").select("name", parts("name", "words", "ns").alias("parts"))


def _names(host: str, path: str) -> list[tuple[str, str]]:
    """Names of a host and, marked by a slash, of a path; numbers in it are one word."""
    return [("", t) for t in _TOKEN.findall(host)] + [("/", "0" if t.isdigit() else t) for t in _TOKEN.findall(path.lower())]


def _few(counts: DataFrame) -> list | None:
    """The rows of a table of words, unless they are more than may travel."""
    rows = counts.limit(MAX_WORDS + 1).collect()
    return rows if len(rows) <= MAX_WORDS else None


def fit_segmenter(urls: DataFrame) -> Segmenter | Lexicon:
    """Counts words once per host over all (host, path)."""
    lower = F.lower(F.col("path"))
    pieces = urls.select(
        "host",
        F.explode(
            F.array_distinct(
                F.concat(
                    F.transform(F.split("host", r"[^\p{L}]+"), lambda w: F.struct(w.alias("word"), F.lit(False).alias("apart"))),
                    F.transform(F.filter(F.split("host", r"[.]"), lambda x: x.contains("-")), lambda x: F.struct(x.alias("word"), F.lit(True).alias("apart"))),
                    F.transform(F.split(lower, r"[^\p{L}]+"), lambda w: F.struct(w.alias("word"), F.lit(True).alias("apart"))),
                )
            )
        ).alias("p"),
    )
    parts = pieces.select("host", F.explode(F.split("p.word", "-")).alias("word"), "p.apart")
    counts = (
        parts.where(F.length("word").between(2, LONGEST_WORD))
        .groupBy("word", "host")
        .agg(F.max("apart").alias("apart"))
        .groupBy("word")
        .agg(F.count("*").alias("n"), F.max("apart").alias("apart"))
        .where("apart OR n >= 2")
    )
    rows = _few(counts.select("word", "n"))
    if rows is not None:
        found = {r["word"]: r["n"] for r in rows}
        floor = 1 + sum(found.values()) // max(1, len(found))
        return Segmenter(found | {w: max(found.get(w, 0), floor) for w in SEEDS})
    counts = cut_lineage(counts.select("word", "n"))
    whole = counts.agg(F.sum("n").alias("n"), F.count("*").alias("words")).first()
    seeds = counts.sparkSession.createDataFrame([(w, 1 + whole["n"] // whole["words"]) for w in SEEDS], "word string, n long")
    counts = cut_lineage(counts.unionByName(seeds).groupBy("word").agg(F.max("n").alias("n")))
    return Lexicon(counts, counts.agg(F.sum("n")).first()[0])


def seen_words(urls: DataFrame, lexicon: Segmenter | Lexicon) -> DataFrame:
    """Distinct (host, path) with their count and words."""
    seen = urls.groupBy("host", "path").count()
    if isinstance(lexicon, Segmenter):

        @F.pandas_udf("array<string>")
        def words(host: pd.Series, path: pd.Series) -> pd.Series:
            return pd.Series([lexicon.words(h, p) for h, p in zip(host, path)], dtype=object)

        return seen.withColumn("words", words("host", "path"))

    @F.pandas_udf("array<struct<mark string, name string>>")
    def names(host: pd.Series, path: pd.Series) -> pd.Series:
        return pd.Series([[{"mark": m, "name": t} for m, t in _names(h, p)] for h, p in zip(host, path)], dtype=object)

    seen = cut_lineage(seen.withColumn("names", names("host", "path")))
    each = seen.select("host", "path", F.posexplode("names").alias("at", "x")).select("host", "path", "at", "x.mark", "x.name")
    split = lexicon.split(each.select("name").distinct())
    placed = each.join(split, "name").select("host", "path", F.struct("at", F.transform("parts", lambda w: F.concat("mark", w)).alias("words")).alias("w"))
    words = placed.groupBy("host", "path").agg(F.flatten(F.transform(F.array_sort(F.collect_list("w")), lambda x: x["words"])).alias("words"))
    return seen.drop("names").join(words, ["host", "path"], "left").withColumn("words", F.coalesce("words", F.array().cast("array<string>")))


def fit_bayes(seen: DataFrame) -> tuple[dict[str, float] | DataFrame, float]:
    """Weight of each word, as a table if there are many, and the bias, as log odds of block against allow, counted over all urls."""
    bad = F.arrays_overlap("words", F.array(*map(F.lit, BLOCK_WORDS)))
    seen = seen.select("words", F.when(bad, F.col("count")).otherwise(0).alias("bad"), F.when(bad, 0).otherwise(F.col("count")).alias("good"))
    n = seen.agg(F.coalesce(F.sum("bad"), F.lit(0)).alias("bad"), F.coalesce(F.sum("good"), F.lit(0)).alias("good")).first()
    bias = math.log((n["bad"] + 1) / (n["good"] + 1))
    counts = seen.select(F.explode("words").alias("word"), "bad", "good").groupBy("word").agg(F.sum("bad").alias("bad"), F.sum("good").alias("good"))
    rows = _few(counts)
    if rows is not None:
        table = {r["word"]: (r["bad"], r["good"]) for r in rows}
        table |= {w: (1, 0) for w in BLOCK_WORDS if w not in table}
        total_bad, total_good = (sum(v[i] for v in table.values()) + len(table) for i in (0, 1))
        return {w: math.log((b + 1) / total_bad) - math.log((g + 1) / total_good) for w, (b, g) in table.items()}, bias
    counts = cut_lineage(counts)
    absent = set(BLOCK_WORDS) - {r["word"] for r in counts.where(F.col("word").isin(BLOCK_WORDS)).collect()}
    t = counts.agg(F.sum("bad").alias("bad"), F.sum("good").alias("good"), F.count("*").alias("words")).first()
    words = t["words"] + len(absent)
    total_bad, total_good = t["bad"] + len(absent) + words, t["good"] + words
    return counts.select("word", (F.log((F.col("bad") + 1) / total_bad) - F.log((F.col("good") + 1) / total_good)).alias("weight")), bias


def _score(odds: float) -> float:
    return 1 / (1 + math.exp(-max(-700.0, min(700.0, odds))))


def _joined_scores(seen: DataFrame, weight: DataFrame, bias: float) -> DataFrame:
    """(host, path, score, words) of distinct urls; the weights of a url are gathered in the order of its words."""
    each = seen.select("host", "path", F.posexplode("words").alias("at", "word")).join(weight, "word")
    sums = each.groupBy("host", "path").agg(F.transform(F.array_sort(F.collect_list(F.struct("at", "weight"))), lambda x: x["weight"]).alias("weights"))

    @F.pandas_udf("double")
    def score(weights: pd.Series) -> pd.Series:
        return pd.Series([_score(bias + (0 if w is None else sum(map(float, w)))) for w in weights], dtype=float)

    return seen.join(sums, ["host", "path"], "left").select("host", "path", score("weights").alias("score"), F.array_join("words", " ").alias("words"))


def judge(pages: DataFrame, rules: list[tuple[str, str]], url: str = "url") -> DataFrame:
    """Adds host, path, rule, verdict, score (probability of block by the method) and words."""
    urls = pages.select(host_of(F.col(url)).alias("host"), path_of(F.col(url)).alias("path"))
    lexicon = fit_segmenter(urls)
    seen = seen_words(urls, lexicon)
    seen = seen if isinstance(lexicon, Segmenter) else cut_lineage(seen)
    weight, bias = fit_bayes(seen)

    keep = [c for c in pages.columns if c not in ("host", "path", "rule", "verdict", "score", "words")]
    rule, verdict = rule_of(F.col("host"), F.col("path"), rules)
    judged = pages.select(*keep, host_of(F.col(url)).alias("host"), path_of(F.col(url)).alias("path"))
    if isinstance(lexicon, Segmenter) and isinstance(weight, dict):

        @F.pandas_udf("score double, words string")
        def method(host: pd.Series, path: pd.Series) -> pd.DataFrame:
            words = [lexicon.words(h, p) for h, p in zip(host, path)]
            return pd.DataFrame({"score": [_score(bias + sum(weight.get(w, 0.0) for w in ws)) for ws in words], "words": [" ".join(ws) for ws in words]})

        judged = judged.withColumn("_m", method("host", "path"))
    else:
        if isinstance(weight, dict):
            weight = seen.sparkSession.createDataFrame(list(weight.items()), "word string, weight double")
        scores = _joined_scores(seen, weight, bias)
        judged = judged.join(scores.select("host", "path", F.struct("score", "words").alias("_m")), ["host", "path"])
    return judged.select(
        *keep,
        "host",
        "path",
        rule.alias("rule"),
        F.coalesce(verdict, F.when(F.col("_m.score") >= 0.5, "block").otherwise("allow")).alias("verdict"),
        "_m.score",
        "_m.words",
    )
