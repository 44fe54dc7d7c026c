from collections import deque
from itertools import combinations

import numpy as np
import pytest
from pyspark.sql import functions as F

from stemma.operators import citations as O
from stemma.operators import graph as G
from stemma.plans import citation_plans


def graph(spark, edges, n):
    return spark.createDataFrame([(i,) for i in range(n)], "id long"), spark.createDataFrame(edges, "src long, dst long")


def test_three_cycle(spark):
    nodes, edges = graph(spark, [(0, 1), (1, 2), (2, 0)], 3)
    assert [r.rank for r in G.pagerank(nodes, edges).collect()] == pytest.approx([1 / 3] * 3)
    assert [r.clustering for r in G.clustering(nodes, edges).collect()] == pytest.approx([0.5] * 3)


def random_edges(n=24, m=90, seed=5):
    rng = np.random.default_rng(seed)
    return sorted({(int(a), int(b)) for a, b in rng.integers(0, n, (m, 2)) if a != b} | {(i, 0) for i in range(1, 8)})


def test_pagerank_with_dangling_nodes(spark):
    edges = [e for e in random_edges() if e[0] != 3]
    nodes, df = graph(spark, edges, 24)
    n, r = 24, np.full(24, 1 / 24)
    out = np.zeros(24)
    for a, _ in edges:
        out[a] += 1
    for _ in range(60):
        nxt = np.full(n, 0.15 / n) + 0.85 * r[out == 0].sum() / n
        for a, b in edges:
            nxt[b] += 0.85 * r[a] / out[a]
        r = nxt
    got = {x.id: x.rank for x in G.pagerank(nodes, df, rounds=300, tolerance=1e-12).collect()}
    assert [got[i] for i in range(n)] == pytest.approx(r.tolist(), abs=1e-9)


def test_clustering_matches_brute_force(spark):
    edges = random_edges()
    nodes, df = graph(spark, edges, 24)
    a = np.zeros((24, 24))
    for x, y in edges:
        a[x, y] = 1
    m = a + a.T
    t = np.diag(m @ m @ m)
    d, both = m.sum(1), (a * a.T).sum(1)
    want = [t[i] / (2 * (d[i] * (d[i] - 1) - 2 * both[i])) if t[i] else 0.0 for i in range(24)]
    got = {r.id: r.clustering for r in G.clustering(nodes, df).collect()}
    assert [got[i] for i in range(24)] == pytest.approx(want)


def brandes(n, edges):
    adj = {i: [b for a, b in edges if a == i] for i in range(n)}
    total = [0.0] * n
    for s in range(n):
        dist, sigma, prev, order, q = {s: 0}, {s: 1}, {s: []}, [], deque([s])
        while q:
            v = q.popleft()
            order.append(v)
            for w in adj[v]:
                if w not in dist:
                    dist[w], sigma[w], prev[w] = dist[v] + 1, 0, []
                    q.append(w)
                if dist[w] == dist[v] + 1:
                    sigma[w] += sigma[v]
                    prev[w].append(v)
        delta = dict.fromkeys(order, 0.0)
        for w in reversed(order):
            for v in prev[w]:
                delta[v] += sigma[v] / sigma[w] * (1 + delta[w])
            if w != s:
                total[w] += delta[w]
    return [x / ((n - 1) * (n - 2)) for x in total]


def test_betweenness_matches_brute_force(spark):
    edges = random_edges(n=12, m=26)
    edges = [e for e in edges if max(e) < 12]
    nodes, df = graph(spark, edges, 12)
    got = {r.id: r.betweenness for r in G.betweenness(nodes, df).collect()}
    assert [got[i] for i in range(12)] == pytest.approx(brandes(12, edges))


def test_betweenness_carried_and_joined(spark):
    """Small edge tables travel to the tasks: a few jobs however deep the graph is. Larger ones are joined, level by level."""
    edges = random_edges(n=60, m=130) + [(i, i + 1) for i in range(30)] + [(7, 1000), (1000, 8)]
    nodes, df = graph(spark, edges, 60)
    sc = spark.sparkContext
    sc.setJobGroup("betweenness", "betweenness")
    carried = {r.id: r.betweenness for r in G.betweenness(nodes, df).collect()}
    sc.setJobGroup("after", "after")
    assert len(sc.statusTracker().getJobIdsForGroup("betweenness")) < 20
    joined = {r.id: r.betweenness for r in G.betweenness(nodes, df, block=40, carried_bytes=0).collect()}
    assert carried == pytest.approx(joined) and len(carried) == 60
    assert {r.betweenness for r in G.betweenness(nodes, df.limit(0)).collect()} == {0.0}


def test_betweenness_of_chains_and_circles(spark):
    """Nodes whose one arc leads on share a search; the tasks that search stay many, whatever the shuffle is set to."""
    rng, shared = np.random.default_rng(3), 0
    for _ in range(60):
        n = int(rng.integers(4, 14))
        edges = sorted({(i, int(b)) for i, d in enumerate(rng.choice([0, 1, 1, 1, 2, 3], n)) for b in rng.integers(0, n, d) if b != i})
        if edges:
            src, dst = (np.array(x) for x in zip(*edges))
            arcs, got = G._Arcs(src, dst, np.unique(src)), np.zeros(n)
            for step in (1, 3):
                total = np.zeros(len(arcs.names))
                for at in range(0, len(arcs.roots), step):
                    G._searched(arcs, arcs.roots[at : at + step], total, np.arange(1))
                got[arcs.names] = total / ((n - 1) * (n - 2))
                assert got.tolist() == pytest.approx(brandes(n, edges))
            shared += len(np.unique(src)) - len(arcs.roots)
    assert shared > 100
    nodes, df = graph(spark, random_edges(), 24)
    was = spark.conf.get("spark.sql.shuffle.partitions")
    try:
        spark.conf.set("spark.sql.shuffle.partitions", "24")
        assert G._carried_dependencies(nodes.distinct(), df).rdd.getNumPartitions() == 24
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", was)


def test_paths_and_traversal(spark):
    _, e = graph(spark, [(0, 1), (1, 2), (2, 3), (3, 1), (1, 3)], 4)
    start, goal = spark.createDataFrame([(0,)], "id long"), spark.createDataFrame([(3,)], "id long")
    assert sorted(tuple(r.path) for r in G.simple_paths(start, goal, e, 4).collect()) == [(0, 1, 2, 3), (0, 1, 3)]
    walks = {tuple(r.path) for r in G.traverse(start, e, 1, 3).collect()}
    assert walks == {(0, 1), (0, 1, 2), (0, 1, 3), (0, 1, 2, 3), (0, 1, 3, 1)}


def test_edge_queries(spark):
    rows = [("d", "f1", "contains", 1.0), ("d", "f2", "contains", 1.0), ("f1", "f2", "similar_to", 0.85), ("f1", "f2", "imports", 0.9)]
    e = spark.createDataFrame(rows, "src string, dst string, relationship string, weight double")
    assert e.where("weight > 0.8").count() == 4
    u = G.update_edges(e, F.col("relationship") == "similar_to", 1.05)
    assert [(r.weight, r.traversal_count) for r in u.where("relationship = 'similar_to'").collect()] == [(pytest.approx(0.8925), 1)]
    assert G.neighbors(e, "imports").count() == 2


def test_coauthors_with_a_hot_paper(spark):
    """One paper holds most authors; copies of its rows change nothing."""
    rows = [(0, a) for a in range(70)] * 2 + [(1, 3), (1, 200), (2, 200), (2, 201), (3, 3), (3, 201), (4, 300), (5, 5), (5, 130), (5, 131)]
    df = spark.createDataFrame(rows, "paper_id long, author_id long")
    by = {}
    for p, a in rows:
        by.setdefault(p, set()).add(a)
    want = {}
    for members in by.values():
        for a in members:
            want.setdefault(a, set())
        for a, b in combinations(members, 2):
            want[a].add(b)
            want[b].add(a)
    got = {r.author_id: r.n_coauthors for r in O.coauthor_counts(df).collect()}
    assert got == {a: len(s) for a, s in want.items()}
    assert {(r.author_id, r.coauthor) for r in O.coauthors_of(df, [3]).collect()} == {(3, c) for c in want[3]}


def test_coauthors_by_lists_and_by_words(spark):
    """Ranges of authors, large papers and authors of many papers give what the pairs give; nothing is sent per co-author."""
    rng = np.random.default_rng(4)
    rows = [(int(p), int(a)) for p, a in zip(rng.integers(0, 300, 3000), 7 * rng.integers(0, 400, 3000))] + [(1000, 7 * a) for a in range(60)] + [(1001, 7 * a) for a in range(50, 110)]
    rows += [(p, 77) for p in range(200)] + [(2000, 5000)] + rows[:50]
    df = spark.createDataFrame(rows, "paper_id long, author_id long").repartition(5)
    by, want = {}, {}
    for p, a in rows:
        by.setdefault(p, set()).add(a)
    for members in by.values():
        for a in members:
            want.setdefault(a, set()).update(members - {a})
    want = {a: len(s) for a, s in want.items()}
    for limits in ({}, {"hot": 40}, {"hot_share": 30}, {"hot": 40, "hot_share": 30}):
        assert {r.author_id: r.n_coauthors for r in O.coauthor_counts(df, **limits).collect()} == want
    pairs = df.selectExpr("paper_id AS paper", "author_id DIV 7 AS num")
    lists = O._author_lists(pairs, 40).collect()
    assert len([x for x in lists if x.list is not None]) == len(by) - 2 and {x.paper for x in lists} == {None, 1000, 1001}
    assert O._ranges(O._author_lists(pairs, 40), 800, 30)[0] == [11]


def test_coauthors_by_name(spark):
    df = spark.createDataFrame([("p", "Ann"), ("p", "Bo"), ("q", "Ann"), ("q", "Cy")], "paper_id string, author_id string")
    assert {r.author_id: r.n_coauthors for r in O.coauthor_counts(df).collect()} == {"Ann": 2, "Bo": 1, "Cy": 1}


def test_communities_of_two_groups(spark):
    rows = [(p, a) for p in range(3) for a in range(4)] + [(p, a) for p in range(3, 6) for a in range(10, 14)] + [(6, 3), (6, 10)]
    c = {r.author_id: r.community for r in O.communities(spark.createDataFrame(rows, "paper_id long, author_id long")).collect()}
    assert len({c[a] for a in range(4)}) == 1 and len({c[a] for a in range(10, 14)}) == 1 and c[0] != c[13]


def test_velocity_and_dominant_type(spark):
    df = spark.createDataFrame([(40, 2020), (40, 2024), (40, 0)], "c long, y int")
    assert [r.v for r in df.select(O.citation_velocity(F.col("c"), F.col("y")).alias("v")).collect()] == [10.0, 40.0, 0.0]
    t = spark.createDataFrame([("implements", False), ("builds_on", False), ("builds_on", False)], "citation_type string, is_methodological boolean")
    assert t.agg(*O.C.dominant_type()).first()[0] == "implementation"


def test_author_numbers_follow_ids(spark):
    """Authors with neighbouring ids share the words of co-author sets."""
    df = spark.range(5000).selectExpr("id * 3 AS author_id").repartition(7)
    got = {r.author_id: r.num for r in O.author_numbers(df).collect()}
    assert got == {3 * i: i for i in range(5000)}


def test_similarity_keeps_the_digits_of_the_cosine(spark):
    """1 / 128 by square roots lies just below the half of a millionth."""
    x, y = [1.0] * 4 + [2.0] * 31 + [0.0] * 127, [1.0] + [0.0] * 34 + [1.0] * 127
    df = spark.createDataFrame([(x, y)], "x array<double>, y array<double>")
    assert df.select(F.round(citation_plans.word_similarity(F.col("x"), F.col("y")), 6)).first()[0] == 0.007812
