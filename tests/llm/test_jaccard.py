import re

import numpy as np
import pytest

from stemma.llm import components, jaccard
from stemma.llm.wordhash import windows, word_hashes


def shingles(text):
    w = re.findall("[^\x20\x09-\x0d]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return {tuple(w)} - {()} if len(w) < 5 else {tuple(w[i : i + 5]) for i in range(len(w) - 4)}


def brute(docs):
    sets = {i: shingles(t) for i, t in docs}
    root = {i: i for i in sets}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    ids = sorted(sets)
    for k, i in enumerate(ids):
        for j in ids[k + 1 :]:
            both = len(sets[i] & sets[j])
            if sets[i] and 100 * both >= 80 * (len(sets[i]) + len(sets[j]) - both):
                a, b = sorted((find(i), find(j)))
                root[b] = a
    return {i: (len(sets[i]), find(i)) for i in ids}


def corpus(seed=0):
    """Exact and near copies, chains, a shared passage, edge similarities and odd texts."""
    rng = np.random.default_rng(seed)
    word = lambda: "v" + str(rng.integers(0, 4000))
    docs, base = [], [word() for _ in range(120)]
    for _ in range(90):  # near copies of one text, a third of all rows
        w = list(base)
        for _ in range(int(rng.integers(0, 7))):
            w[int(rng.integers(len(w)))] = word()
        docs.append(" ".join(w))
    chain = [word() for _ in range(60)]
    for k in range(25):  # each links with the next, the ends do not
        docs.append(" ".join(chain))
        chain[(k * 2) % 60 : (k * 2) % 60 + 1] = [word()]
    passage = " ".join(word() for _ in range(30))
    for _ in range(60):
        docs.append(" ".join(word() for _ in range(int(rng.integers(5, 80)))) + " " + passage)
    docs += ["same text here", "Same TEXT\there", "same text", "", None, "   ", "one", "ONE", "É two three four five", "é two three four five"]
    for n in range(5, 40):  # similarity exactly at and around the edge
        docs.append(" ".join(f"e{n}x{k}" for k in range(n)))
        docs.append(" ".join(f"e{n}x{k}" for k in range(n)) + "".join(f" z{n}y{k}" for k in range((n - 4) // 4 + n % 2)))
    docs.append(" ".join(word() for _ in range(30_000)))
    order = rng.permutation(len(docs))
    return [(int(i), docs[k]) for i, k in enumerate(order)]


@pytest.mark.parametrize("small", [True, False])
@pytest.mark.parametrize("longest", [1, 4])
def test_components_match_brute_force(spark, monkeypatch, small, longest):
    monkeypatch.setattr(jaccard, "LONGEST", longest)
    monkeypatch.setattr(jaccard, "LEAST_LISTED", 4)
    if not small:
        monkeypatch.setattr(jaccard, "SMALL_IDS", 0)
        monkeypatch.setattr(jaccard, "MARKS", 8)
    docs = corpus(longest)
    df = spark.createDataFrame([(i, t, 1, "r") for i, t in docs], "doc_id long, text string, n int, root string")
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard.near_duplicates(df).collect()}
    assert got == brute(docs)


def test_prefixes_without_stars_find_the_same(spark, monkeypatch):
    """The prefix join alone is complete."""
    monkeypatch.setattr(jaccard, "SHARED_HEADS", 99)
    docs = corpus(5)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard.near_duplicates(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    assert got == brute(docs)


def test_hot_documents_take_longer_prefixes():
    tokens = np.sort(np.random.default_rng(0).integers(1, 2**63, 200).astype(np.uint64))
    cold = jaccard._describe(1, tokens, jaccard.Ranks(np.empty(0, np.uint64), np.empty(0, np.int64)))
    hot = jaccard._describe(1, tokens, jaccard.Ranks(tokens, np.full(200, 1000)))
    assert cold[5] == 1 and hot[5] > 1 and len(hot[6]) == len(cold[6]) + hot[5] - 1


def test_repeated_rows_and_empty_table(spark):
    df = spark.createDataFrame([(3, "a b c d e f"), (3, "a b c d e f"), (1, "A b c d e f")], "doc_id long, text string")
    assert sorted(map(tuple, jaccard.near_duplicates(df).collect())) == [(1, 2, 1), (3, 2, 1), (3, 2, 1)]
    assert jaccard.near_duplicates(df.limit(0)).count() == 0


def test_components(spark):
    edges = [(i, i + 1) for i in range(100, 140)] + [(5, k) for k in range(6, 60)] + [(200, 201), (201, 200), (7, 7)]
    got = {r.node: r.root for r in components.connected(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {k: 100 for k in range(101, 141)} | {k: 5 for k in range(6, 60)} | {201: 200}


def test_hashes_follow_words():
    texts = ["Ab  cd", "ab cd ", None, "", "a,b", "é", "x" * 600_000 + " y"]
    h = word_hashes(texts)
    assert h[0].tolist() == h[1].tolist() and [len(x) for x in h] == [2, 2, 0, 0, 1, 1, 2]
    assert [len(x) for x in word_hashes(texts, "letters")] == [2, 2, 0, 0, 2, 1, 2]
    w = np.arange(9, dtype=np.uint64)
    assert len(windows(w, 5)) == 5 and len(windows(w[:3], 5)) == 1 and windows(w[2:7], 5)[0] == windows(w, 5)[2]


def test_shingles_of_two_components_are_sent_in_few_bytes(spark, monkeypatch):
    import numpy as np

    from stemma.llm import jaccard

    monkeypatch.setattr(jaccard, "RANGE", 300)
    monkeypatch.setattr(jaccard, "SENT_TOGETHER", 200)
    rng = np.random.default_rng(4)
    tokens = rng.integers(-(2**63), 2**63, 900)
    rows = [(int(r), [int(t) for t in rng.choice(tokens, rng.integers(0, 9), replace=False)] + [-1, 7]) for r in rng.integers(-3, 2**40, 250)]
    rows += [(5, [11, 12]), (5, [11]), (6, []), (rows[0][0], [2**63 - 1]), (6, [-(2**63)]), (8, [-(2**63)])]
    roots = {}
    for r, p in rows:
        for t in p:
            roots.setdefault(t, set()).add(r)
    df = spark.createDataFrame(rows, "root long, prefix array<long>").repartition(5)
    got = [r.token for r in jaccard._mixed(df).collect()]
    assert sorted(got) == sorted(t for t, rs in roots.items() if len(rs) > 1)
    assert jaccard._mixed(df.limit(0)).count() == 0
    many = np.sort(rng.integers(0, 2**63, 100_000).astype(np.uint64))
    import zlib

    assert len(zlib.compress(jaccard._planes(np.diff(many, prepend=np.uint64(0))), 1)) < 7 * len(many)


def test_pairs_that_cannot_link_are_no_candidates(spark):
    """Texts that share a third of their words meet in their prefixes, but what they share there shows that it is too little."""
    rng = np.random.default_rng(3)
    word = lambda: "p" + str(rng.integers(0, 10**9))
    docs = []
    for _ in range(12):
        block = [word() for _ in range(100)]
        docs += [" ".join(block + [word() for _ in range(200)]) for _ in range(2)]
        whole = [word() for _ in range(300)]
        docs += [" ".join(whole), " ".join(whole[:-20] + [word() for _ in range(20)])]
    docs = list(enumerate(docs))
    table = spark.createDataFrame(docs, "id long, t string")
    rows = jaccard.describe(table, jaccard.WIDTH)
    roots = spark.createDataFrame([], "node long, root long")
    found = {(r["a"], r["b"]) for r in jaccard._candidates(rows, roots).collect()}
    links = {(4 * k + 2, 4 * k + 3) for k in range(12)}
    assert found == links
    got = jaccard.near_duplicates(table, doc_id="id", text="t").collect()
    assert {r["id"]: (r["n_shingles"], r["component_id"]) for r in got} == brute(docs)


def test_posted_matches_never_refuse_a_link(spark):
    """Pairs right at the similarity that is needed, of equal and of unequal size."""
    rng = np.random.default_rng(4)
    word = lambda: "q" + str(rng.integers(0, 10**9))
    docs = []
    for n in range(9, 160, 3):
        whole = [word() for _ in range(n + 4)]
        for cut in ((n // 9), n // 5):  # n shingles each, and a shorter one
            docs.append(" ".join(whole))
            docs.append(" ".join(whole[cut:] + [word() for _ in range(cut)] if cut == n // 9 else whole[cut:]))
            whole = [word() for _ in range(n + 4)]
    docs = list(enumerate(docs))
    table = spark.createDataFrame(docs, "id long, t string")
    rows = jaccard.describe(table, jaccard.WIDTH)
    found = {(r["a"], r["b"]) for r in jaccard._candidates(rows, spark.createDataFrame([], "node long, root long")).collect()}
    sets = {i: shingles(t) for i, t in docs}
    links = {(i, i + 1) for i in range(0, len(docs), 2) if 100 * len(sets[i] & sets[i + 1]) >= 80 * len(sets[i] | sets[i + 1])}
    assert len(links) > 50 and links <= found
