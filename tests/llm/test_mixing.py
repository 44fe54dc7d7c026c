import hashlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from stemma.llm import mixing, tables

WEIGHTS = {"domain": {"a": 3}, "lang": {"x": 2}, "source": {}}


def fill(supply, weights, budget):
    """Largest-remainder-free water filling by repeated passes, in exact fractions."""
    from fractions import Fraction

    left, open_, out = Fraction(budget), dict(weights), {}
    while open_:
        share = {k: left * w / sum(open_.values()) for k, w in open_.items()}
        full = [k for k in open_ if supply[k] <= share[k]]
        if not full:
            return out | share
        for k in full:
            out[k] = Fraction(supply[k])
            left -= supply[k]
            del open_[k]
    return out


@pytest.mark.parametrize("small_rows", [100_000, 0])
def test_mixture_matches_brute_force(spark, monkeypatch, small_rows):
    monkeypatch.setattr(tables, "SMALL_ROWS", small_rows)
    monkeypatch.setattr(mixing, "RANGE_ROWS", 7)
    rng = np.random.default_rng(5)
    docs = []
    for i in range(300):
        hot = i % 3 == 0  # a leaf with a third of all rows
        docs.append((i, " ".join(["w"] * int(rng.integers(1, 30))), "a" if hot else str(rng.choice(["a", "b", "c"])), "x" if hot else str(rng.choice(["x", "y"])), "s0" if hot else f"s{rng.integers(0, 3)}"))
    docs += [(300, None, "a", "x", "s0"), (301, " \t\n", "b", None, None), docs[4]]
    df = spark.createDataFrame(docs, "doc_id long, text string, domain string, lang string, source string").withColumns({"rest": F.lit(1), "key": F.lit("k"), "tokens": F.lit(0)})
    levels = {k: F.col(k) for k in WEIGHTS}
    out = mixing.mix(df, levels, WEIGHTS, F.floor(F.col("tokens") * 0.9), max_epochs=2, seed=3).collect()
    n = {d[0]: len(d[1].split()) if d[1] else 0 for d in docs}
    leaves = {}
    for d in docs:
        if n[d[0]]:
            leaves.setdefault(tuple(x or "" for x in d[2:5]), []).append(d[0])
    budget = int(sum(n[d[0]] for d in docs) * 0.9)
    supply = {leaf: 2 * sum(n[i] for i in ids) for leaf, ids in leaves.items()}
    given = {(): budget}
    for k, level in enumerate(WEIGHTS):
        nxt = {}
        for parent, b in given.items():
            kids = sorted({leaf[: k + 1] for leaf in leaves if leaf[:k] == parent})
            nxt |= fill({c: sum(s for leaf, s in supply.items() if leaf[: k + 1] == c) for c in kids}, {c: WEIGHTS[level].get(c[k], 1) for c in kids}, b)
        given = nxt
    taken = {}
    for r in out:
        taken.setdefault((r.domain, r.lang, r.source), []).append((r.epoch, r.doc_id))
    order = lambda e, i: (int(hashlib.md5(f"3|{e}|{i}".encode()).hexdigest()[:13], 16), i)
    for leaf, ids in leaves.items():
        total = sum(n[i] for i in ids)
        got = sorted(taken.get(leaf, []))
        used = sum(n[i] for _, i in got)
        assert used <= given[leaf] + 3
        whole = int(given[leaf] // total)
        for e in range(whole):
            assert sorted(i for x, i in got if x == e) == sorted(ids)
        last = [i for x, i in got if x == whole]
        ranked = sorted(ids, key=lambda i: order(whole, i))
        assert sorted(last) == sorted(ranked[: len(last)])
        if len(last) < len(ids):  # the next document does not fit
            peers = ids.count(ranked[len(last)])
            assert used + peers * n[ranked[len(last)]] > given[leaf] - 3


def test_root_budget_is_met_exactly_by_allocation(spark):
    leaves = spark.createDataFrame([("a", "x", "s", 10), ("a", "y", "s", 1000), ("b", "x", "s", 7), ("b", "x", "t", 500)], "domain string, lang string, source string, tokens long")
    got = mixing.allocate(leaves, WEIGHTS, F.lit(701), 1).collect()
    assert sum(r.x for r in got) == 701 and all(0 <= r.x <= r.tokens for r in got)
    assert {(r.domain, r.lang): r.x for r in got}[("a", "x")] == 10  # its shortage goes to its sibling first


def test_empty_and_no_budget(spark):
    df = spark.createDataFrame([], "doc_id long, text string, domain string, lang string, source string")
    levels = {k: F.col(k) for k in WEIGHTS}
    assert mixing.mix(df, levels, WEIGHTS, F.col("tokens")).count() == 0
    one = spark.createDataFrame([(1, "a b", None, None, None)], df.schema)
    assert mixing.mix(one, levels, WEIGHTS, F.lit(0)).count() == 0
    assert mixing.mix(one, levels, WEIGHTS, F.lit(4), max_epochs=2).count() == 2
