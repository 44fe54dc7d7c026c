"""Citation contexts, authors, institutions and collaboration."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stemma.functions import citation as C
from stemma.functions.vectors import let
from stemma.session import cut_lineage


MARK = r"\[[^\[\]\s]+\]"


def contexts(docs: DataFrame, doc: str, text: str, marks: DataFrame, pattern: str = MARK) -> DataFrame:
    """One row per paragraph and citation mark found in it, with the sentence and the paragraphs around it.

    marks: citing, cited, mark; every mark has the shape of `pattern`. Marks are found inside the row of
    their text, so only the paragraphs around a hit leave it; whole texts are not joined or shuffled.
    """
    parts = F.split(text, "\n\n")

    def hits(ps):
        near = lambda i: F.coalesce(F.get(ps, i), F.lit(""))

        def found(t, i):
            before = F.when(i > 0, near(i - 1)).otherwise(F.lit(""))
            row = lambda m: F.struct(i.alias("paragraph"), m.alias("mark"), C.sentence_with(t, m).alias("citation_text"), before.alias("context_before"), near(i + 1).alias("context_after"))
            return F.transform(F.array_distinct(F.regexp_extract_all(t, F.lit(pattern), F.lit(0))), row)

        return F.flatten(F.transform(ps, found))

    rows = docs.where(F.col(text).rlike(pattern)).select(F.col(doc).alias("citing"), F.inline(let(parts, hits)))
    known = marks.select("citing", "cited", "mark")
    return C.with_features(rows.join(known, ["citing", "mark"]).select("citing", "cited", "paragraph", "citation_text", "context_before", "context_after"))


def citation_velocity(count: Column, year: Column, now: int = 2024) -> Column:
    return F.when(year > 0, count / F.greatest(F.lit(1), F.lit(now) - year)).otherwise(F.lit(0.0))


def citation_network(papers: DataFrame, references: DataFrame, cited_by: DataFrame) -> DataFrame:
    """Distinct edges whose two ends are known papers, from reference lists and cited-by lists alike."""
    key = papers.columns[0]
    ids = papers.select(F.col(key).alias("id"))
    e = references.select("src", "dst").unionByName(cited_by.select("src", "dst"))
    e = e.join(ids.withColumnRenamed("id", "src"), "src", "left_semi").join(ids.withColumnRenamed("id", "dst"), "dst", "left_semi")
    return e.select("src", "dst").distinct()


def capped(edges: DataFrame, owner: str, other: str, cap: int) -> DataFrame:
    """First `cap` entries of each owner's list, in the order of `other`."""
    w = Window.partitionBy(owner).orderBy(other)
    return edges.withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= cap).drop("_r")


def author_numbers(authors: DataFrame, author: str = "author_id") -> DataFrame:
    """Dense numbers for the distinct authors, for any id type: position in its partition plus an offset.

    Numbers follow the order of ids: authors who entered together mostly write together, so that the sets of
    co-authors fill few words instead of one word per co-author.
    """
    ids = authors.select(author).distinct().orderBy(author)
    numbered = cut_lineage(ids.withColumn("_m", F.monotonically_increasing_id()))
    part = F.shiftright("_m", 33)
    sizes = numbered.groupBy(part.alias("_part")).agg(F.count("*").alias("_n"))  # one row per partition
    w = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select("_part", F.coalesce(F.sum("_n").over(w), F.lit(0)).alias("_off"))
    j = numbered.withColumn("_part", part).join(F.broadcast(offsets), "_part")
    return j.select(author, (F.col("_off") + F.col("_m").bitwiseAND(F.lit((1 << 33) - 1))).alias("num"))


HOT_PAPER = 4096
HOT_SHARE = 8192  # papers of one author in the share of one task
ENTRIES_TOGETHER = 1 << 20
CARRIED_AUTHORS = 1 << 20
BINS = 8192


def coauthor_counts(authors: DataFrame, author: str = "author_id", paper: str = "paper_id", hot: int = HOT_PAPER, hot_share: int = HOT_SHARE) -> DataFrame:
    """Number of distinct co-authors per author, without sending the pairs of a paper.

    A paper becomes one list of author numbers. Authors are cut into ranges of about as many entries, and a list goes once
    to each range it has authors in; there the lists of an author are united. What is sent does not depend on how many
    tasks the papers lie in. Authors of a paper of more than `hot` authors, and those met too often for one range, are counted by words.
    """
    names = cut_lineage(authors.select(author).distinct())
    numbers = cut_lineage(author_numbers(names, author))
    n = max(1, numbers.count())
    carried = F.broadcast(numbers) if n <= CARRIED_AUTHORS else numbers
    pairs = authors.where(F.col(paper).isNotNull()).join(carried, author).select(F.col(paper).alias("paper"), "num")
    lists = cut_lineage(_author_lists(pairs, hot))
    often, edges = _ranges(lists, n, hot_share)
    found = numbers.join(_united(lists, n, often, edges).withColumnRenamed("n", "x"), "num").select(author, "x")
    every = names.join(found, author, "left")
    if often or lists.where("list IS NULL").take(1):
        large = lists.where("list IS NULL").select("paper")
        who = pairs.join(large, "paper", "left_semi").select("num").union(pairs.sparkSession.createDataFrame([(x,) for x in often], "num long")).distinct()
        by_words = _counted_by_words(authors, numbers, cut_lineage(numbers.join(who, "num", "left_semi").select(author)), author, paper, hot)
        every = every.join(by_words, author, "left").withColumn("x", F.coalesce("c", "x"))
    return every.select(author, (F.coalesce("x", F.lit(0)) - 1).cast("long").alias("n_coauthors"))


def _author_lists(pairs: DataFrame, hot: int) -> DataFrame:
    """(paper, list): the sorted author numbers of every paper as packed integers, its name left out; of one with more than `hot` the name alone."""

    def run(batches):
        last, held, size = None, [], 0  # the paper that may go on in the next batch

        def ended():
            if size > hot:
                return [last], [None]
            return ([None], [np.concatenate(held).astype(np.int32).tobytes()]) if size else ([], [])

        for pdf in batches:
            p, num = pdf["paper"].to_numpy(), pdf["num"].to_numpy()
            if not len(p):
                continue
            at = np.flatnonzero(np.append(True, p[1:] != p[:-1]))
            names, made = [], []
            for lo, hi in zip(at, [*at[1:], len(p)]):
                if not (size and p[lo] == last):
                    for to, more in zip((names, made), ended()):
                        to += more
                    last, held, size = p[lo], [], 0
                own = num[lo:hi]
                own = own[np.append(not held or own[0] != held[-1][-1], own[1:] != own[:-1])]
                size += len(own)
                if size > hot:
                    held = [num[hi - 1 : hi]]
                elif len(own):
                    held.append(own)
            yield pd.DataFrame({"paper": pd.Series(names, dtype=object), "list": pd.Series(made, dtype=object)})
        names, made = ended()
        yield pd.DataFrame({"paper": pd.Series(names, dtype=object), "list": pd.Series(made, dtype=object)})

    kind = pairs.schema["paper"].dataType.simpleString()
    return pairs.repartition("paper").sortWithinPartitions("paper", "num").mapInPandas(run, f"paper {kind}, list binary")


def _ranges(lists: DataFrame, n: int, hot_share: int) -> tuple[list[int], list[int]]:
    """Authors that one task meets in at least `hot_share` papers, and where the ranges of about as many entries begin."""

    def run(batches):
        bins, met = np.zeros(BINS, np.int64), np.zeros(n, np.int64)
        for pdf in batches:
            num = np.frombuffer(b"".join(pdf["list"]), np.int32).astype(np.int64)
            bins += np.bincount(num * BINS // n, minlength=BINS)
            met += np.bincount(num, minlength=n)
        yield pd.DataFrame({"bins": [bins], "often": [np.flatnonzero(met >= hot_share)]})

    parts = lists.where("list IS NOT NULL").select("list").mapInPandas(run, "bins array<long>, often array<long>").toPandas()
    bins = np.sum(np.stack([np.zeros(BINS, np.int64), *parts["bins"]]), axis=0)
    total, cores = int(bins.sum()), lists.sparkSession.sparkContext.defaultParallelism
    blocks = max(-(-total // ENTRIES_TOGETHER), min(cores, -(-total // (ENTRIES_TOGETHER // 16))), 1)
    first = np.unique(np.searchsorted(np.cumsum(bins), np.arange(1, blocks) * total / blocks, side="right"))
    starts = sorted({0, *(int(-(-x * n // BINS)) for x in first)})
    return sorted({int(x) for some in parts["often"] for x in some}), starts


def _united(lists: DataFrame, n: int, often: list[int], edges: list[int]) -> DataFrame:
    """(num, n): how many numbers stand in the lists of each author together, but for those in `often`."""
    starts, left_out = np.array(edges, np.int64), np.array(often, np.int64)

    def deal(batches):
        for pdf in batches:
            packed = pdf["list"].to_numpy()
            num = np.frombuffer(b"".join(packed), np.int32)
            of = np.repeat(np.arange(len(packed)), [len(x) // 4 for x in packed])
            block = np.searchsorted(starts, num, side="right") - 1
            keep = np.append(True, (of[1:] != of[:-1]) | (block[1:] != block[:-1]))[: len(num)]
            yield pd.DataFrame({"block": block[keep], "list": packed[of[keep]]})

    def unite(pdf: pd.DataFrame) -> pd.DataFrame:
        block, size = int(pdf["block"].iloc[0]), np.array([len(x) // 4 for x in pdf["list"]])
        every = np.frombuffer(b"".join(pdf["list"]), np.int32)
        at, low = np.cumsum(size) - size, int(every.min())
        mark = np.zeros(int(every.max()) - low + 1, bool)
        own = every >= starts[block]
        if block + 1 < len(starts):
            own &= every < starts[block + 1]
        own = np.flatnonzero(own)
        own = own[~np.isin(every[own], left_out)]
        who, of = every[own], np.searchsorted(at, own, side="right") - 1
        by = np.argsort(who, kind="stable")
        who, of = who[by], of[by]
        ends = np.flatnonzero(np.append(who[1:] != who[:-1], True)) + 1 if len(who) else np.zeros(0, np.int64)
        counts, lo = [], 0
        for hi in ends:
            met = of[lo:hi]
            few = 16 * int(size[met].sum()) < len(mark)
            parts = []
            for some in np.split(met, np.arange(ENTRIES_TOGETHER // 16, len(met), ENTRIES_TOGETHER // 16)):
                long = size[some]
                others = every[np.repeat(at[some] - np.cumsum(long) + long, long) + np.arange(long.sum())] - low
                parts.append(others)
                if not few:
                    mark[others] = True
                    parts = []
            if few:
                counts.append(len(np.unique(np.concatenate(parts))))
            else:
                counts.append(int(np.count_nonzero(mark)))
                mark[:] = False
            lo = hi
        return pd.DataFrame({"num": who[ends - 1].astype(np.int64), "n": np.array(counts, np.int64)})

    dealt = lists.where("list IS NOT NULL").select("list").mapInPandas(deal, "block long, list binary")
    return dealt.groupBy("block").applyInPandas(unite, "num long, n long")


def _counted_by_words(authors: DataFrame, numbers: DataFrame, who: DataFrame, author: str, paper: str, hot: int) -> DataFrame:
    """(author, c): authors met with by the authors of `who`, themselves included, as unions of words of 64 authors.

    A paper of more than `hot` authors is never joined to each of them: its authors are grouped by the set of such
    papers they share, the union of a set is taken once, and every author of the group takes over its size. Smaller
    papers are OR-ed per author and cleared of what that union already holds.
    """
    d = cut_lineage(authors.join(who, author, "left_semi").select(paper).distinct().join(authors.select(paper, author).distinct(), paper))
    size = d.groupBy(paper).agg(F.count("*").alias("n"))
    a = d.join(size, paper).join(numbers, author)
    a = cut_lineage(a.select(paper, author, "n", F.floor(F.col("num") / 64).alias("idx"), F.expr("shiftleft(1L, int(num % 64))").alias("bit")))
    words = a.groupBy(paper, "idx").agg(F.bit_or("bit").alias("word"))
    # the large papers of an author: at most as many as there are large papers
    large = a.where(F.col("n") > hot).groupBy(author).agg(F.sort_array(F.collect_list(paper)).alias("set"))
    sets = large.select("set").distinct()
    union = cut_lineage(sets.select("set", F.explode("set").alias(paper)).join(words, paper).groupBy("set", "idx").agg(F.bit_or("word").alias("own")))
    whole = union.groupBy("set").agg(F.sum(F.bit_count("own")).alias("whole"))
    seen = a.where(F.col("n") <= hot).join(who, author, "left_semi").select(paper, author).join(words, paper).groupBy(author, "idx").agg(F.bit_or("word").alias("word"))
    fresh = seen.join(large, author, "left").join(union, ["set", "idx"], "left")
    extra = fresh.groupBy(author).agg(F.sum(F.bit_count(F.col("word").bitwiseAND(F.bitwise_not(F.coalesce("own", F.lit(0))))).cast("long")).alias("x"))
    every = who.join(large, author, "left").join(whole, "set", "left").join(extra, author, "left")
    return every.select(author, (F.coalesce("whole", F.lit(0)) + F.coalesce("x", F.lit(0))).cast("long").alias("c"))


def coauthors_of(authors: DataFrame, who: list, author: str = "author_id", paper: str = "paper_id") -> DataFrame:
    """(author, coauthor) for the given authors: linear in the authors of their papers."""
    a = authors.select(paper, author).distinct()
    mine = a.where(F.col(author).isin(list(who)))
    return mine.join(a.select(paper, F.col(author).alias("coauthor")), paper).where(F.col(author) != F.col("coauthor")).select(author, "coauthor").distinct()


def author_profiles(authors: DataFrame, papers: DataFrame, now: int = 2024) -> DataFrame:
    """Papers, co-authors and mean citation velocity per author."""
    v = papers.select("paper_id", citation_velocity(F.col("citation_count"), F.col("year"), now).alias("velocity"))
    p = authors.join(v, "paper_id", "left").groupBy("author_id").agg(
        F.count("*").alias("n_papers"), F.coalesce(F.avg("velocity"), F.lit(0.0)).alias("conveyance_score")
    )
    return p.join(coauthor_counts(authors), "author_id")


def institution_profiles(authors: DataFrame, affil: DataFrame, papers: DataFrame, now: int = 2024) -> DataFrame:
    """Distinct authors and papers, citations and mean author score per institution.

    Papers are made distinct per institution before counting, so no institution is gathered in one task.
    """
    cited = authors.join(papers, "paper_id").groupBy("author_id").agg(F.sum("citation_count").alias("citations"))
    score = author_profiles_scores(authors, papers, now)
    people = affil.select("institution_id", "author_id").distinct().join(score, "author_id").join(cited, "author_id", "left")
    who = people.groupBy("institution_id").agg(
        F.count("*").alias("n_authors"), F.sum(F.coalesce("citations", F.lit(0))).alias("total_citations"), F.avg("conveyance_score").alias("avg_conveyance")
    )
    what = authors.join(affil, "author_id").select("institution_id", "paper_id").distinct().groupBy("institution_id").agg(F.count("*").alias("n_papers"))
    return who.join(what, "institution_id")


def author_profiles_scores(authors: DataFrame, papers: DataFrame, now: int = 2024) -> DataFrame:
    v = papers.select("paper_id", citation_velocity(F.col("citation_count"), F.col("year"), now).alias("velocity"))
    return authors.join(v, "paper_id", "left").groupBy("author_id").agg(F.coalesce(F.avg("velocity"), F.lit(0.0)).alias("conveyance_score"))


def communities(authors: DataFrame, free_rounds: int = 10, author: str = "author_id", paper: str = "paper_id") -> DataFrame:
    """(author, community) by label propagation between authors and their papers, until no label moves.

    Stands in for greedy modularity. Each round a paper takes the most frequent label of its authors and
    an author the most frequent label of its papers, ties to the smaller label; the co-author pairs are
    never formed and votes are counted before they are compared. After `free_rounds` a label may only
    become smaller, so labels that would swing back and forth come to rest and the loop always ends.
    """
    a = cut_lineage(authors.select(author, paper).distinct())
    label = cut_lineage(a.select(author).distinct().withColumn("label", F.col(author)))

    def vote(rows: DataFrame, key: str) -> DataFrame:
        n = rows.groupBy(key, "label").agg(F.count("*").alias("n"))
        return n.groupBy(key).agg(F.min(F.struct((-F.col("n")).alias("n"), "label")).alias("b")).select(key, "b.label")

    done = 0
    while True:
        at_paper = vote(a.join(label, author), paper)
        new = vote(a.join(at_paper, paper), author).withColumnRenamed("label", "new").join(label, author)
        done += 1
        free = F.col("new") if done <= free_rounds else F.least("new", "label")
        both = cut_lineage(new.select(author, free.alias("new"), "label"))
        label = both.select(author, F.col("new").alias("label"))
        if not both.where("new <> label").take(1):
            return label.withColumnRenamed("label", "community")
