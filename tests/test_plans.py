"""Shapes of plans, and operators on inputs that used to break them."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from stemma.functions import vectors as V
from stemma.operators import citations as O
from stemma.operators import graph as G
from stemma.plans import vector_plans as VP
from stemma.plans import citation_plans as CP

SF = "/root/testdata/sf0.001"


def plan(df) -> str:
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_pagerank_with_dangling_nodes(spark):
    rng = np.random.default_rng(0)
    n = 60
    edges = sorted({(int(a), int(b)) for a, b in rng.integers(0, n, (150, 2)) if a != b and a % 5})  # every fifth node has no link
    rank, m = np.full(n, 1 / n), np.zeros((n, n))
    for a, b in edges:
        m[b, a] = 1
    out = m.sum(0)
    m = m / np.where(out > 0, out, 1)
    while True:
        new = 0.15 / n + 0.85 * (m @ rank + rank[out == 0].sum() / n)
        if np.abs(new - rank).sum() < n * 1e-9:
            break
        rank = new
    nodes = spark.range(n).withColumnRenamed("id", "doc")
    got = G.pagerank(nodes, spark.createDataFrame(edges, "src long, dst long"), rounds=200, tolerance=1e-9)
    assert len(plan(got).splitlines()) <= 3  # nothing of earlier rounds is left in it
    assert np.allclose([r.rank for r in got.orderBy("id").collect()], new, atol=1e-7)
    with pytest.raises(RuntimeError):
        G.pagerank(nodes, spark.createDataFrame(edges, "src long, dst long"), rounds=2)
    assert G.pagerank(nodes.limit(0), spark.createDataFrame([], "src long, dst long")).count() == 0


def test_neighbour_search_runs_once(spark):
    edges = VP.symmetric(VP.weighted_knn(spark, SF))
    assert plan(edges).count("MapInPandas") + plan(edges).count("FlatMapCoGroups") == 1


def test_communities_come_to_rest(spark):
    """A chain of papers of two authors each makes synchronous votes swing."""
    rows = [(p, a) for p in range(40) for a in (p, p + 1)] + [(100, 200), (100, 201)]
    got = {r.author_id: r.community for r in O.communities(spark.createDataFrame(rows, "paper_id long, author_id long"), free_rounds=2).collect()}
    assert len(got) == 43 and got[200] == got[201] == 200
    assert all(got[a] <= a for a in got)


def test_score_keeps_rows_that_do_not_fit(spark):
    df = spark.createDataFrame([(1, [1.0, 0.0]), (2, [1.0]), (3, None), (4, []), (5, [0.0, 2.0])], "i int, v array<double>")
    got = {r.i: r.score for r in V.score(df, "v", [1.0, 0.0]).collect()}
    assert got == {1: 1.0, 2: None, 3: None, 4: None, 5: 0.0}


def test_no_exchange_carries_whole_texts(spark):
    def shuffled(node):
        """Names of the columns that each exchange moves."""
        if node.nodeName().startswith("AdaptiveSparkPlan"):
            node = node.initialPlan()
        if node.nodeName() == "Exchange" and "RoundRobin" not in node.toString().splitlines()[0]:  # dealing out a one-file table
            yield {node.output().apply(i).name() for i in range(node.output().size())}
        for i in range(node.children().size()):
            yield from shuffled(node.children().apply(i))

    for df in (CP.contexts(spark, SF), CP.shared(spark, SF), CP.shared(spark, SF, "Is")):
        moved = list(shuffled(df._jdf.queryExecution().executedPlan()))
        assert moved and not any("text" in names for names in moved), moved


def test_contexts_of_several_marks_in_a_paragraph(spark):
    docs = spark.createDataFrame([(1, "First.\n\nWe use [2] here. And [3], [2] again.\n\nLast [9].")], "d long, t string")
    marks = spark.createDataFrame([(1, 2, "[2]"), (1, 3, "[3]"), (1, 4, "[4]"), (7, 9, "[9]")], "citing long, cited long, mark string")
    got = {(r.cited, r.paragraph, r.citation_text, r.context_before, r.context_after) for r in O.contexts(docs, "d", "t", marks).collect()}
    assert got == {(2, 1, "We use [2] here", "First.", "Last [9]."), (3, 1, "And [3], [2] again", "First.", "Last [9].")}


def test_unknown_owners_are_not_one_owner(spark):
    from stemma.operators import edges as E

    rows = [("/a/x.py", "/a", "x", ".py", "644", None, 1, True), ("/a/y.py", "/a", "y", ".py", "600", None, 1, False), ("/a/z.py", "/a", "z", ".py", None, "u", 1, True)]
    df = spark.createDataFrame(rows, "path string, parent string, stem string, ext string, perms string, owner string, size long, readable boolean").withColumns(
        {c: F.lit(False) for c in ("executable", "encrypted", "compressed", "special_tool")}
    )
    got = {(r.same_perms, r.same_owner): r.n_pairs for r in E.pair_counts(df, []).groupBy("same_perms", "same_owner").agg(F.sum("n_pairs").alias("n_pairs")).collect()}
    assert got == {(False, False): 3}


@pytest.mark.parametrize("hot", [3, 12, 4096])
def test_coauthors_with_several_large_papers(spark, hot):
    rng = np.random.default_rng(1)
    rows = {(p, int(a)) for p in range(30) for a in rng.integers(0, 200, 1 + p % 6)}
    rows |= {(100, a) for a in range(150)} | {(101, a) for a in range(60, 200)} | {(102, a) for a in range(0, 200, 3)} | {(7, 999)}
    rows |= {(55, 5000)}  # an author alone
    by = {}
    for p, a in rows:
        by.setdefault(p, set()).add(a)
    want = {}
    for p, a in rows:
        want.setdefault(a, set()).update(by[p])
    got = {r.author_id: r.n_coauthors for r in O.coauthor_counts(spark.createDataFrame(list(rows), "paper_id long, author_id long"), hot=hot).collect()}
    assert got == {a: len(s) - 1 for a, s in want.items()}


def test_betweenness_in_blocks(spark):
    rng = np.random.default_rng(3)
    edges = spark.createDataFrame(sorted({(int(a), int(b)) for a, b in rng.integers(0, 25, (60, 2)) if a != b}), "src long, dst long")
    nodes = spark.range(25)
    whole = {r.id: r.betweenness for r in G.betweenness(nodes, edges).collect()}
    parts = {r.id: r.betweenness for r in G.betweenness(nodes, edges, block=9).collect()}
    assert max(whole.values()) > 0 and whole == pytest.approx(parts)
