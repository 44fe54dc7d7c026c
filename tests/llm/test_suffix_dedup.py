import hashlib
from collections import Counter

import numpy as np
import pytest

from stemma.llm import suffix_dedup
from stemma.llm.run_index import RunIndex


def brute(docs, window):
    """(n_bytes, removed spans, kept) of every row by counting all windows."""
    texts = [(i, (t or "").encode()) for i, t in docs]
    seen = Counter(t[k : k + window] for _, t in texts for k in range(len(t) - window + 1))
    out = []
    for i, t in texts:
        gone = np.zeros(len(t) + 1, bool)
        for k in range(len(t) - window + 1):
            if seen[t[k : k + window]] > 1:
                gone[k : k + window] = True
        edge = np.flatnonzero(np.diff(np.r_[False, gone]))
        out.append((i, len(t), tuple(map(int, edge)), bytes(b for b, g in zip(t, gone) if not g)))
    return sorted(out, key=str)


def found(df, window, grams):
    rows = suffix_dedup.removal(df, window=window, grams=grams).collect()
    return sorted(((r.doc_id, r.n_bytes, tuple(x for s in r.spans for x in (s.starts, s.ends)), bytes(r.kept)) for r in rows), key=str)


def corpus(seed, window):
    """Copies, near copies, shared passages at and around the limit, periods, odd and multi-byte texts."""
    rng = np.random.default_rng(seed)
    some = lambda n: "".join(rng.choice(list("abcdefgh é\n"), n))
    base, passage, line = some(6 * window), some(window), some(window - 1)
    texts = [some(int(rng.integers(0, 5 * window))) for _ in range(40)]
    for k in range(60):  # a third of the rows are near copies
        at = int(rng.integers(0, len(base)))
        texts.append(base[:at] + some(int(rng.integers(0, 4))) + base[at + int(rng.integers(0, 3)) :])
    texts += [some(int(rng.integers(0, window))) + passage + some(int(rng.integers(0, window))) for _ in range(15)]
    texts += [some(int(rng.integers(0, window))) + line + some(int(rng.integers(0, window))) for _ in range(30)]
    texts += ["a" * (3 * window), "ab" * (2 * window), "xyz" * window + some(9) + "xyz" * window, passage, passage[: window - 1]]
    texts += [None, "", "é", texts[3], texts[3], some(40 * window)]
    texts += [texts[-1][window : 9 * window], "é" * window, "\0" * (window + 3) + "\0a" * window]
    order = rng.permutation(len(texts))
    return [(int(i), texts[k]) for i, k in enumerate(order)]


@pytest.mark.parametrize("hot", [1, 256])
def test_removed_bytes_match_brute_force(spark, monkeypatch, hot):
    monkeypatch.setattr(suffix_dedup, "HOT", hot)
    if hot == 1:
        monkeypatch.setattr(suffix_dedup, "FILTERED", 0)
        monkeypatch.setattr(suffix_dedup, "SHARD", 2000)
    docs = corpus(hot, 40)
    df = spark.createDataFrame([(i, t, b"x", 7) for i, t in docs], "doc_id long, text string, key binary, lo int")
    assert found(df, 40, (8, 16, 28, 40)) == brute(docs, 40)


def test_production_window(spark):
    docs = corpus(9, 400)
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(7)
    assert found(df, suffix_dedup.WINDOW, suffix_dedup.GRAMS) == brute(docs, 400)


def test_nulls_repeats_and_empty_table(spark):
    docs = [(None, "q" * 50), (None, None), (1, "z" * 39), (1, "z" * 39), (2, "".join(map(str, range(40)))), (2, "".join(map(str, range(40))))]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    assert found(df, 40, (8, 16, 28, 40)) == brute(docs, 40)
    assert suffix_dedup.removal(df.limit(0)).count() == 0


def test_equal_long_texts_on_a_third_of_the_rows(spark):
    """Copies are told by digest; they hide no passage that other texts share with them."""
    rng = np.random.default_rng(3)
    some = lambda n: "".join(rng.choice(list("abcdefghijk "), n))
    hot, tail = some(900), some(500)
    docs = [(i, hot if i % 3 == 0 else some(300) + (tail if i % 2 else hot[100:600])) for i in range(120)]
    assert found(spark.createDataFrame(docs, "doc_id long, text string"), 400, suffix_dedup.GRAMS) == brute(docs, 400)


@pytest.mark.parametrize("q", [8, 12, 40])
def test_pieces_hold_each_window_once(monkeypatch, q):
    monkeypatch.setattr(suffix_dedup, "PIECE", 30)
    rng = np.random.default_rng(q)
    texts = [b"ab" * 80, b"x" * 40, bytes(rng.integers(97, 100, 500).astype(np.uint8)), b"q" * 41, bytes(rng.integers(97, 120, 300).astype(np.uint8))]
    of, first, windows, name, twice = suffix_dedup.pieces(texts, q, 40)
    got = sorted((int(o), int(f + k)) for o, f, w in zip(of, first, windows) for k in range(w))
    assert got == [(o, k) for o, t in enumerate(texts) for k in range(len(t) - 39)] and windows.max() <= 30
    named = {}
    for o, f, w, v in zip(of, first, windows, name):
        for k in range(w):
            assert named.setdefault(texts[o][f + k : f + k + 40], v) == v
    for o, f, w, two in zip(of, first, windows, twice):
        inside = [texts[o][f + k : f + k + 40] for k in range(w)]
        assert two or len(set(inside)) == len(inside)


def suffixes(strings):
    """Order of all suffixes with separators of their own, and the neighbours' common lengths."""
    at = [(o, k) for o, s in enumerate(strings) for k in range(len(s))]
    return sorted(at, key=lambda p: ([b + 1 for b in strings[p[0]][p[1] :]] + [0], p[0]))


@pytest.mark.parametrize("seed", range(6))
def test_run_index_matches_plain_suffix_order(seed):
    rng = np.random.default_rng(seed)
    letters = [b"ab", b"abc\0", b"a"][seed % 3]
    strings = [bytes(rng.choice(list(letters), int(rng.integers(1, 60)))) for _ in range(12)]
    strings += strings[:2] + [b"ab" * 30]
    index = RunIndex(strings)
    order = suffixes(strings)
    before = [strings[o][k - 1] if k else -1 for o, k in order]
    runs = [before[0]]
    for x, y in zip(before, before[1:]):
        if y != x or y < 0:
            runs.append(y)
    assert index.symbols.tolist() == runs and index.lengths.sum() == index.n and len(index.symbols) <= index.n
    flat = [index.starts[o] + k for o, k in order]
    ends = np.cumsum(index.lengths)
    assert index.head_at.tolist() == [flat[i] for i in np.r_[0, ends[:-1]]] and index.tail_at.tolist() == [flat[i] for i in ends - 1]
    want = {}
    for (o, k), (p, j) in zip(order, order[1:]):
        x, y = strings[o][k:], strings[p][j:]
        n = next((i for i, (a, b) in enumerate(zip(x, y)) if a != b), min(len(x), len(y)))
        for q in ((o, k), (p, j)):
            want[q] = max(want.get(q, 0), n)
    assert index.matching().tolist() == [want.get((o, k), 0) for o, s in enumerate(strings) for k in range(len(s))]


def test_runs_stay_few_in_repetitive_strings():
    rng = np.random.default_rng(0)
    base = bytes(rng.integers(97, 123, 700).astype(np.uint8))
    strings = [base[: int(k)] + b"!" + base[int(k) :] for k in rng.integers(0, 700, 50)]
    index = RunIndex(strings)
    assert len(index.symbols) < index.n / 8 and (index.matching() > 0).all()


def test_too_long_strings_are_refused():
    with pytest.raises(ValueError):
        RunIndex([b"a" * 2000])


def test_query_columns(spark, tmp_path):
    from stemma.llm.plans import op12_run_index

    text = "".join(map(str, range(300)))
    spark.createDataFrame([(1, text), (2, "x" + text), (3, None)], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    rows = {r.doc_id: tuple(r)[1:] for r in op12_run_index(spark, str(tmp_path)).collect()}
    n = len(text)
    assert rows[1] == (n, n, 1, hashlib.sha256(b"").hexdigest()) and rows[2] == (n + 1, n, 1, hashlib.sha256(b"x").hexdigest())
    assert rows[3] == (0, 0, 0, hashlib.sha256(b"").hexdigest())
