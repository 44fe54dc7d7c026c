import time

import numpy as np
import pytest
from corpora import say

from stemma.llm import decontaminate as dc
from stemma.llm.wordhash import word_hashes


def brute(doc, item, least):
    """Greedy string tiling as first published: all pairs of places, longest first."""
    free_d, free_i, tiles = [True] * len(doc), [True] * len(item), []
    while True:
        best = []
        for i in range(len(doc)):
            for j in range(len(item)):
                n = 0
                while i + n < len(doc) and j + n < len(item) and doc[i + n] == item[j + n] and free_d[i + n] and free_i[j + n]:
                    n += 1
                if n >= least:
                    best.append((-n, i, j))
        if not best:
            return tiles
        top = min(best)[0]
        for n, i, j in sorted(b for b in best if b[0] == top):
            if all(free_d[i : i - n]) and all(free_i[j : j - n]):
                free_d[i : i - n] = [False] * -n
                free_i[j : j - n] = [False] * -n
                tiles.append((i, j, -n))


@pytest.mark.parametrize("letters", [2, 4, 9])
def test_tiling_matches_brute_force(letters):
    rng = np.random.default_rng(letters)
    for _ in range(60):
        doc, item = (rng.integers(0, letters, int(rng.integers(1, 40))).astype(np.uint64) for _ in range(2))
        least = int(rng.integers(2, 5))
        assert dc.tile(doc, item, least) == brute(doc.tolist(), item.tolist(), least)


def fresh(rng, n):
    return " ".join("w" + "".join(chr(97 + c) for c in rng.integers(0, 26, 6)) for _ in range(n))


@pytest.mark.parametrize("block_words", [1_000_000, 60])
def test_leaks_and_clean_documents(spark, monkeypatch, block_words):
    monkeypatch.setattr(dc, "BLOCK_WORDS", block_words)
    rng = np.random.default_rng(3)
    items = [fresh(rng, 24) for _ in range(20)]
    words = items[3].split()
    moved = " ".join(words[16:] + [fresh(rng, 5)] + words[:8] + [fresh(rng, 4)] + words[8:16])
    docs = {
        1: fresh(rng, 50) + " " + items[0] + " " + fresh(rng, 50),
        2: items[1].upper().replace(" ", ", ") + "!",
        3: moved,
        4: fresh(rng, 40) + " " + " ".join(items[5].split()[:8]) + " " + fresh(rng, 40),  # a third of an item
        5: fresh(rng, 200),
        6: items[6] + "\n" + items[7],
        7: None,
        8: "",
        9: fresh(rng, 120_000) + " " + items[8],
        10: "short one",
        11: " ".join(w + " " + x for w, x in zip(items[9].split(), fresh(rng, 24).split())),  # same words, no run
    }
    rows = [(i, t, "x") for i, t in docs.items()] + [(2, docs[2], "again")]
    df = spark.createDataFrame(rows, "doc_id long, text string, item_id string")
    bench = spark.createDataFrame([(i, t) for i, t in enumerate(items)] + [(50, "short one"), (51, None), (52, ""), (0, items[0])], "item_id long, text string")
    got = sorted((r.doc_id, r.item_id, r.coverage) for r in dc.leaks(df, bench).collect())
    assert sorted(set(got)) == [(1, 0, 1.0), (2, 1, 1.0), (3, 3, 1.0), (6, 6, 1.0), (6, 7, 1.0), (9, 8, 1.0)]
    assert got.count((2, 1, 1.0)) == 2 and got.count((1, 0, 1.0)) == 2  # repeated rows, repeated items
    clean = dc.clean(df, bench)
    assert sorted(r.doc_id for r in clean.collect()) == [4, 5, 7, 8, 10, 11] and clean.columns == df.columns
    assert dc.leaks(df, bench.limit(0)).count() == 0 and dc.leaks(df.limit(0), bench).count() == 0 and dc.clean(df, bench.limit(0)).count() == len(rows)


def test_whole_comparison_agrees_with_tiling_of_whole_texts():
    """Cutting a document to the places of its seeds changes no coverage."""
    rng = np.random.default_rng(9)
    items = [say(rng, "en", 30) for _ in range(6)]
    block = dc.Items(list(range(6)), items)
    for _ in range(30):
        parts = [" ".join(items[int(rng.integers(6))].split()[a : a + int(rng.integers(4, 20))]) for a in rng.integers(0, 20, 4)]
        doc = word_hashes([" ".join(p + " " + say(rng, "en", 6) for p in parts)], "letters")[0]
        got = {m["item_id"]: m["matched"] for m in block.matches(doc)}
        for i, words in enumerate(word_hashes(items, "letters")):
            whole = sum(n for _, _, n in dc.tile(doc, words))
            assert got.get(i, 0) == (whole if whole >= dc.FROM * len(words) else 0)


@pytest.mark.parametrize(
    "doc, item, matched",
    [
        ("no " * 20_000, "no " * 30, 30),
        ("no " * 4_000, ("no " * 50 + "x y z w ") * 10, 500),
        ("a b " * 50_000 + "no " * 50_000, "a b " * 100 + "no " * 100, 300),
    ],
)
def test_repetitive_texts_take_little_time(doc, item, matched):
    block = dc.Items([1, 2], [item, "quite another item without any of it"])
    start = time.monotonic()
    got = block.matches(word_hashes([doc], "letters")[0])
    assert [(m["item_id"], m["matched"]) for m in got] == [(1, matched)]
    assert time.monotonic() - start < 10


def test_seeds_of_many_items_in_one_text():
    """A run of one word that every item holds leads to each item once."""
    items = ["no no no no no " + f"k{i} l{i} m{i} n{i} o{i}" for i in range(300)]
    block = dc.Items(list(range(300)), items)
    start = time.monotonic()
    got = block.matches(word_hashes(["no " * 20_000 + "k7 l7 m7 n7 o7"], "letters")[0])
    assert [m["item_id"] for m in got] == list(range(300)) and {m["matched"] for m in got} == {5, 9, 10} - {9}
    assert time.monotonic() - start < 30
