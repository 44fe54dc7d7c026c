import numpy as np
import pytest

from stemma.operators import modularity as M


def quality(edges, c):
    """Modularity by its definition; edges are undirected pairs."""
    m = len(edges)
    deg = {}
    for a, b in edges:
        deg[a], deg[b] = deg.get(a, 0) + 1, deg.get(b, 0) + 1
    inside = sum(c[a] == c[b] for a, b in edges) / m
    sums = {}
    for x, d in deg.items():
        sums[c[x]] = sums.get(c[x], 0) + d
    return inside - sum((s / (2 * m)) ** 2 for s in sums.values())


def greedy(edges):
    """Joins the two communities that raise modularity most until none does."""
    c = {x: x for e in edges for x in e}
    best = quality(edges, c)
    while True:
        near = {tuple(sorted((c[a], c[b]))) for a, b in edges if c[a] != c[b]}
        tries = [(quality(edges, {x: p if k == q else k for x, k in c.items()}), p, q) for p, q in near]
        if not tries or max(tries)[0] <= best:
            return best
        best, p, q = max(tries)
        c = {x: p if k == q else k for x, k in c.items()}


def ring_of_cliques(n, size):
    edges = [(g * size + i, g * size + j) for g in range(n) for i in range(size) for j in range(i)]
    return edges + [(g * size, (g * size + size + 1) % (n * size)) for g in range(n)]


def planted(seed):
    rng = np.random.default_rng(seed)
    return [(a, b) for a in range(32) for b in range(a) if rng.random() < (0.6 if a // 8 == b // 8 else 0.05)]


@pytest.mark.parametrize("edges", [ring_of_cliques(6, 5), planted(0)], ids=["cliques", "planted"])
def test_at_least_as_good_as_greedy(spark, edges):
    ids = sorted({x for e in edges for x in e})
    nodes = spark.createDataFrame([(x,) for x in [*ids, 900, ids[0]]], "id long")
    rows = spark.createDataFrame([*edges, *[(b, a) for a, b in edges[:9]], (3, 3)], "src long, dst long")
    got = {r.node: r.community for r in M.communities(nodes, rows).collect()}
    assert set(got) == {*ids, 900} and got[900] == 900 and all(got[c] == c for c in got.values())
    plain = [tuple(sorted(e)) for e in edges]
    assert quality(plain, got) >= greedy(plain) - 1e-9
    member = spark.createDataFrame(list(got.items()), "node long, c long")
    assert M.modularity(M.both_ways(rows), member) == pytest.approx(quality(plain, got))


def test_without_edges(spark):
    nodes = spark.range(3)
    none = spark.createDataFrame([], "src long, dst long")
    assert sorted(map(tuple, M.communities(nodes, none).collect())) == [(0, 0), (1, 1), (2, 2)]
    assert M.modularity(M.both_ways(none), nodes.selectExpr("id AS node", "id AS c")) == 0.0
