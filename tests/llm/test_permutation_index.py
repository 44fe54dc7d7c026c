import numpy as np
import pytest

from stemma.llm import permutation_index as index

SCHEMA = "vec_id long, embedding array<float>, extra string"


def table(spark, x, more=()):
    return spark.createDataFrame([(i, [float(c) for c in v], "e") for i, v in enumerate(x)] + list(more), SCHEMA)


def brute(x, q, k):
    x = np.array([[np.float32(c) for c in v] for v in x]).astype(float)
    s = (x * x[q]).sum(axis=1)
    ids = [i for i in np.lexsort((np.arange(len(x)), -s)) if i != q][:k]
    return [(i, s[i]) for i in ids]


def test_whole_share_is_exact_with_ties_and_odd_vectors(spark):
    rng = np.random.default_rng(0)
    x = rng.normal(size=(150, 8)) * rng.uniform(0.5, 2, (150, 1))
    x[40:90] = x[40]  # a third of the rows are one vector
    odd = [(200, None, "n"), (201, [0.0] * 8, "z"), (202, [1.0, None] + [0.0] * 6, "n"), (203, [float("nan")] * 8, "n"), (204, [float("inf")] * 8, "i"), (205, [1.0], "short"), (None, [9.0] * 8, "no id"), (206, [], "empty")]
    t = table(spark, x, odd)
    got = {}
    for r in index.search(t, t.where("vec_id % 20 = 0"), k=20).collect():
        got.setdefault(r.query_id, []).append((r["rank"], r.vec_id, r.score))
    assert sorted(got) == list(range(0, 150, 20))
    for q, rows in got.items():
        want = brute(x, q, 20)
        assert [(k, i) for k, i, _ in sorted(rows)] == [(k + 1, i) for k, (i, _) in enumerate(want)]
        assert max(abs(a[2] - b[1]) for a, b in zip(sorted(rows), want)) == 0


@pytest.mark.parametrize("spread", [0.0, 0.6])
def test_recall_without_structure_and_with_norms(spark, spread):
    rng = np.random.default_rng(1)
    x = rng.normal(size=(6000, 64))
    x *= np.exp(spread * rng.normal(size=(6000, 1))) / np.linalg.norm(x, axis=1, keepdims=True)
    t = table(spark, x)
    asked = t.where("vec_id % 200 = 0")
    got = {}
    for r in index.search(t, asked).collect():
        got.setdefault(r.query_id, set()).add(r.vec_id)
    recall = np.mean([len(got[q] & {i for i, _ in brute(x, q, 20)}) / 20 for q in got])
    assert len(got) == 30 and recall >= 0.9


def test_blocks_shards_and_small_tables(spark, monkeypatch):
    x = np.random.default_rng(2).normal(size=(130, 4))
    t = table(spark, x)
    whole = sorted(map(tuple, index.search(t, t.where("vec_id % 3 = 0"), k=3).collect()))
    monkeypatch.setattr(index, "BLOCK", 10)
    assert sorted(map(tuple, index.search(t, t.where("vec_id % 3 = 0"), k=3).collect())) == whole
    two = table(spark, x[:2])
    assert [(r.query_id, r.vec_id) for r in index.search(two, two).collect()] == [(0, 1), (1, 0)]
    assert index.search(t.limit(0), t.limit(0)).count() == 0 and index.search(t, t.limit(0)).count() == 0
    lists = index.Pivots(x[:6], 9.0, 3)
    post, order = lists.post(x), lists.order(x, False)
    plain = [sum(abs(k - (list(order[j]).index(p) if p in order[j] else 3)) for k, p in enumerate(order[7])) for j in range(len(x))]
    assert index.footrule(post, order[7]).tolist() == plain
