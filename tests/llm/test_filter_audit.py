import re
from itertools import permutations

import numpy as np
import pytest

from stemma.llm import filter_audit
from stemma.llm.filter_audit import LETTERS


def brute(docs, labels):
    """Replays all orders on lists of documents."""
    first = {}
    for i, _, t in docs:
        if i is not None:
            first[t or ""] = min(first.get(t or "", i), i)
    good, bad = {i for i, q, _ in labels if q == 1}, {i for i, _, x in labels if x == 1}
    parts = {}
    for i, s, t in docs:
        t = t or ""
        w = re.findall("[^\x20\x09-\x0d]+", t)
        tests = [len(w) < 200, 100 * len(set(w)) < 50 * len(w), 100 * len(re.findall("[A-Z]", t)) > 2 * len(t), bool(re.search("[#$%&*|]", t)), i is not None and i > first[t]]
        fails = {c for c, x in zip(LETTERS, tests) if x}
        parts.setdefault(s or "", []).append((fails, i is not None and i in good, i is not None and i in bad))
    out, total = [], {}
    for part, rows in parts.items():
        for order in permutations(LETTERS):
            left = rows
            for step, c in enumerate(order, 1):
                gone = [r for r in left if c in r[0]]
                left = [r for r in left if c not in r[0]]
                failing = sum(c in r[0] for r in rows)
                total[part, c] = total.get((part, c), 0) + len(gone)
                out.append([part, "".join(order), step, len(left), len(gone), failing - len(gone), sum(r[0] == {c} for r in rows), sum(r[1] for r in gone), sum(r[2] for r in gone)])
    return sorted(tuple([*r, total[r[0], r[1][r[2] - 1]]]) for r in out)


def corpus():
    rng = np.random.default_rng(0)
    docs = []
    for i in range(150):
        n = int(rng.choice([0, 3, 199, 200, 201, 260]))
        words = [str(rng.choice(["Ab", "cd", "E"])) if i % 3 else f"w{k}" for k in range(n)]
        text = str(rng.choice([" ", "\n", "\t ", "\x0b"])).join(words) + str(rng.choice(["", " ", " #", "É", " x", "\x85"]))
        docs.append((i, [None, "", "a", "b"][i % 4], [None, text][i % 10 > 0]))
    docs += [(500 + i, "a" if i % 2 else "hot", docs[7][2]) for i in range(80)]  # a third of the rows are copies
    docs += [(3, "a", docs[3][2]), (3, "a", "other"), (None, "a", docs[7][2]), (None, None, None), (None, "a", "unseen"), (None, "a", "unseen")]
    labels = [(i, int(rng.integers(0, 2)), int(rng.integers(0, 2))) for i in range(0, 600, 2)] + [(4, 1, 0), (4, 0, 1), (None, 1, 1), (6, None, None)]
    return docs, labels


def test_audit_matches_replayed_orders(spark):
    docs, labels = corpus()
    df = spark.createDataFrame([(*d, "x", 1) for d in docs], "doc_id long, source string, text string, part string, n int")
    marks = spark.createDataFrame([(*x, "y") for x in labels], "doc_id long, quality int, toxic int, mask string")
    got = filter_audit.audit(filter_audit.failure_counts(df, marks)).collect()
    assert sorted(map(tuple, got)) == brute(docs, labels)


def test_shares_add_up_and_match_the_definition(spark):
    """The Shapley values of a part sum to what all filters remove together, times 120."""
    docs, labels = corpus()
    cells = filter_audit.failure_counts(spark.createDataFrame(docs, "doc_id long, source string, text string"), spark.createDataFrame(labels, "doc_id long, quality int, toxic int"))
    rows = filter_audit.audit(cells).where("filter_order = 'ABCDE'").collect()
    for part in {r.part for r in rows}:
        mine = [r for r in rows if r.part == part]
        assert sum(r.shapley for r in mine) == 120 * sum(r.removed for r in mine)


@pytest.mark.parametrize("k", [1, 2, 3])
def test_potentials_of_small_games(spark, k):
    v = [0, 5, 3, 7, 2, 6, 5, 9][: 1 << k]
    q = spark.range(1).selectExpr(f"array({', '.join(f'{x}L' for x in v)}) AS v").select(filter_audit.potentials("v", k)).first()[0]
    p, size = {0: 0.0}, lambda s: bin(s).count("1")
    for s in range(1, 1 << k):
        p[s] = (v[s] + sum(p[s & ~(1 << i)] for i in range(k) if s >> i & 1)) / size(s)
    fact = [1, 1, 2, 6]
    assert [x / fact[size(s)] for s, x in enumerate(q)] == pytest.approx([p[s] for s in range(1 << k)])


def test_empty_tables(spark):
    docs, labels = corpus()
    none = spark.createDataFrame(docs, "doc_id long, source string, text string").limit(0)
    marks = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    assert filter_audit.audit(filter_audit.failure_counts(none, marks)).count() == 0
    some = spark.createDataFrame(docs[:5], "doc_id long, source string, text string")
    assert filter_audit.audit(filter_audit.failure_counts(some, marks.limit(0))).count() == len({d[1] or "" for d in docs[:5]}) * 600
