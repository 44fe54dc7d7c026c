"""A neighbour graph grown in parts equals one built at once."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from stemma.operators import neighbours as NB
from stemma.operators import simjoin
from stemma.plans.vector_plans import chain_gap, weighted_tau

SMALL = simjoin.Limits(broadcast_bytes=0, block_rows=16, probe_rows=64)
COSINE = NB.Measure(simjoin.cosine_gap, lambda d: np.arccos(np.clip(1.0 - d, -1.0, 1.0)))


def frame(spark, x, ids):
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    return spark.createDataFrame([(int(i), [float(c) for c in unit[i]]) for i in ids], "id long, v array<double>")


def brute(x, ids, k):
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    d = np.round(1.0 - unit @ unit.T, 12)
    return {int(i): sorted((d[i, j], int(j)) for j in ids if j != i)[:k] for i in ids}


def lists(g):
    out = {}
    for r in NB.edges(g).collect():
        out.setdefault(r.src, []).append((r.dist, r.dst))
    return {i: sorted(v) for i, v in out.items()}


@pytest.mark.parametrize("limits", [simjoin.Limits(), SMALL])
def test_grown_and_cleared_equals_brute_force(spark, limits):
    rng = np.random.default_rng(5)
    x = rng.normal(size=(160, 6))
    x[30:85] = x[30]  # a third of the nodes are one vector, in every part
    g = NB.build(frame(spark, x, range(0, 60)), 5, COSINE, limits)
    g = NB.insert(g, frame(spark, x, range(60, 100)))
    g = NB.insert(g, frame(spark, x, range(100, 160)))
    got = lists(g)
    want = brute(x, range(160), 5)
    assert {i: [j for _, j in v] for i, v in got.items()} == {i: [j for _, j in v] for i, v in want.items()}
    gone = [i for i in range(160) if i % 4 == 2] + [30]
    left = [i for i in range(160) if i not in gone]
    g = NB.remove(g, spark.createDataFrame([(i,) for i in gone], "id long"))
    got, want = lists(g), brute(x, left, 5)
    assert {i: [j for _, j in v] for i, v in got.items()} == {i: [j for _, j in v] for i, v in want.items()}


def test_short_lists_and_empty_changes(spark):
    x = np.eye(4)
    g = NB.build(frame(spark, x, [0, 1]), 3, COSINE)
    assert {i: len(v) for i, v in lists(g).items()} == {0: 1, 1: 1}
    g = NB.insert(g, frame(spark, x, [2, 3]))
    assert {i: [j for _, j in v] for i, v in lists(g).items()} == {0: [1, 2, 3], 1: [0, 2, 3], 2: [0, 1, 3], 3: [0, 1, 2]}
    g = NB.remove(NB.insert(g, frame(spark, x, [])), spark.createDataFrame([], "id long"))
    assert len(lists(g)) == 4
    assert lists(NB.remove(g, spark.createDataFrame([(i,) for i in range(4)], "id long"))) == {}


def test_copies_with_a_distance_of_their_own(spark, monkeypatch):
    """Nodes without a directory chain are half a step from everything, their copies included; hot groups are dealt."""
    monkeypatch.setattr(NB, "HOT_ROWS", 4)
    rows = [(i, [1.0, 0.0], None if i % 2 else ["a"], 0.5) for i in range(20)] + [(20 + i, [0.6, 0.8], ["a", "b"], 0.5) for i in range(3)]
    df = spark.createDataFrame(rows, "id long, v array<double>, chain array<string>, fid double")
    g = NB.insert(NB.build(df.where("id < 9"), 4, NB.Measure(chain_gap, weighted_tau)), df.where("id >= 9"))
    pdf = df.toPandas()
    d = chain_gap(pdf, pdf)
    want = {i: [j for _, j in sorted((d[i, j], j) for j in range(23) if j != i)[:4]] for i in range(23)}
    assert {i: [j for _, j in v] for i, v in lists(g).items()} == want
    assert g.groups.count() == 3 and g.lists.where(F.col("src") == F.col("dst")).isEmpty()
