"""Benchmark decontamination by greedy string tiling.

Texts are sequences of words: runs of letters and digits, with A-Z folded to a-z, so case and
punctuation do not matter. A document is compared with a benchmark item if they share at least one run
of `SEED` words. The common tiles of the two are then marked by running Karp-Rabin: rolling hashes of
all unmarked windows are compared to find the greatest width that both share; the longest matches that
do not overlap words marked before become tiles, until no unmarked run of `SEED` words is shared.
Tiles may stand in any order, so reordered passages are found. The coverage of an item is the share of
its words that tiles mark; from `FROM` on, the document leaks it.

Words outside shared seeds cannot be in a tile, so tiling reads only the parts of a document where
seeds were found; its cost does not grow with the rest of the text. The items travel to the tasks in
blocks of about `BLOCK_WORDS` words (a stated set against all rows), and every block judges every
document where it is read. Documents are neither shuffled nor collected.

Defined results: null or wordless texts match nothing, nor do items of fewer than `SEED` words, which
any text might hold; repeated documents and repeated items are compared each; an empty table on either
side gives no match; other columns are passed on or ignored.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stemma.llm.tables import collected, small_batches
from stemma.llm.wordhash import windows, word_hashes

SEED, FROM = 4, 0.5
BLOCK_WORDS = 1_000_000
_BASE = np.uint64(0x5DEECE66D1CE4E5B)
_MATCH = "array<struct<item_id:long,tiles:int,matched:int,item_words:int,coverage:double>>"


class Rolling:
    """Karp-Rabin hashes of all windows of one word sequence."""

    def __init__(self, words: np.ndarray, top: int):
        powers = np.cumprod(np.full(top + 1, _BASE, np.uint64))
        self.sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(words * powers[: len(words)])])
        self.shift = powers[::-1]

    def windows(self, at: np.ndarray, size: int) -> np.ndarray:
        return (self.sums[at + size] - self.sums[at]) * self.shift[at]


def _free(marked: np.ndarray, size: int) -> np.ndarray:
    """Starts of the windows without marked words."""
    if len(marked) < size:
        return np.empty(0, np.int64)
    before = np.concatenate([[0], np.cumsum(marked)])
    return np.flatnonzero(before[size:] == before[:-size])


def _shared(doc: np.ndarray, item: np.ndarray) -> np.ndarray:
    """Which of the hashes `doc` occur in the sorted hashes `item`."""
    at = np.searchsorted(item, doc)
    return item[np.minimum(at, len(item) - 1)] == doc if len(item) else np.zeros(len(doc), bool)


def tile(doc: np.ndarray, item: np.ndarray, least: int = SEED) -> list[tuple[int, int, int]]:
    """Greedy string tiles (place in doc, place in item, length), in the order they were marked.

    Of matches with equal length the first in the document, then in the item, is marked first. Each round
    finds the greatest width at which unmarked windows share a rolling hash, by bisection, and marks the
    matches of that width; a round costs a few passes over both texts, however often their words repeat.
    """
    top = max(len(doc), len(item))
    roll_doc, roll_item = Rolling(doc, top), Rolling(item, top)
    marked_doc, marked_item = np.zeros(len(doc), bool), np.zeros(len(item), bool)
    tiles, most = [], min(len(doc), len(item))

    def hits(size: int):
        """Hashes of the item's unmarked windows, their places, and those of the document that occur among them."""
        at_doc, at_item = _free(marked_doc, size), _free(marked_item, size)
        h_doc, h_item = roll_doc.windows(at_doc, size), roll_item.windows(at_item, size)
        order = np.argsort(h_item, kind="stable")
        found = _shared(h_doc, h_item[order])
        return h_item[order], at_item[order], h_doc[found], at_doc[found]

    while most >= least:
        lo, hi = least - 1, most  # windows of `lo` words are shared, those of more than `hi` are not
        while lo < hi:
            mid = (lo + hi + 1) // 2
            lo, hi = (mid, hi) if len(hits(mid)[3]) else (lo, mid - 1)
        if lo < least:
            break
        h_item, at_item, h_doc, at_doc = hits(lo)
        first, stop = np.searchsorted(h_item, h_doc, "left"), np.searchsorted(h_item, h_doc, "right")
        head = {int(f): int(f) for f in np.unique(first)}  # first item window of a hash that may be free
        past = 0
        for i, f, end in zip(at_doc.tolist(), first.tolist(), stop.tolist()):
            if i < past or f not in head:
                continue
            k = head[f]
            while k < end and marked_item[at_item[k] : at_item[k] + lo].any():
                k += 1
            head[f] = k
            if k == end:
                del head[f]
                if not head:
                    break
                continue
            j = int(at_item[k])
            if np.array_equal(doc[i : i + lo], item[j : j + lo]):
                marked_doc[i : i + lo] = True
                marked_item[j : j + lo] = True
                tiles.append((i, j, lo))
                past = i + lo
        most = lo - 1
    return tiles


class Items:
    """A block of benchmark items and the seeds that lead to them."""

    def __init__(self, ids: list[int], texts: list[str]):
        known = [(i, w) for i, w in zip(ids, word_hashes(texts, "letters")) if len(w) >= SEED]
        self.ids, self.words = [i for i, _ in known], [w for _, w in known]
        seeds = [windows(w, SEED) for w in self.words]
        seed = np.concatenate(seeds) if seeds else np.empty(0, np.uint64)
        owner = np.repeat(np.arange(len(seeds)), [len(s) for s in seeds]) if seeds else np.empty(0, int)
        order = np.lexsort((owner, seed))
        seed, owner = seed[order], owner[order]
        first = np.ones(len(seed), bool)  # a seed that an item repeats leads to it once
        first[1:] = (seed[1:] != seed[:-1]) | (owner[1:] != owner[:-1])
        self.seed, self.owner = seed[first], owner[first]
        self.maybe = np.zeros(1 << 20, bool)
        self.maybe[(seed & np.uint64(0xFFFFF)).astype(np.int64)] = True

    def matches(self, words: np.ndarray) -> list[dict]:
        """Items that a document's words cover to `FROM` or more."""
        if len(words) < SEED or not len(self.seed):
            return []
        own = windows(words, SEED)
        at = np.flatnonzero(self.maybe[(own & np.uint64(0xFFFFF)).astype(np.int64)])
        at = at[np.argsort(own[at], kind="stable")]
        seen, start, count = np.unique(own[at], return_index=True, return_counts=True)
        lo, hi = np.searchsorted(self.seed, seen, "left"), np.searchsorted(self.seed, seen, "right")
        held = np.repeat(np.arange(len(seen)), hi - lo)
        owner = self.owner[np.arange(len(held)) - np.repeat(np.cumsum(hi - lo) - hi, hi - lo)]
        order = np.argsort(owner, kind="stable")
        items, cut = np.unique(owner[order], return_index=True)
        out = []
        for item, mine in zip(items.tolist(), np.split(held[order], cut[1:])):
            target = self.words[item]
            if (SEED * count[mine]).sum() < FROM * len(target):
                continue
            places = np.concatenate([at[start[k] : start[k] + count[k]] for k in mine])
            inside = np.unique(places[:, None] + np.arange(SEED))
            if len(inside) < FROM * len(target):
                continue
            # parts of the document apart from each other are kept apart by a word that no text has
            part = np.insert(words[inside], np.flatnonzero(np.diff(inside) > 1) + 1, np.uint64(0))
            tiles = tile(part, target)
            matched = sum(n for _, _, n in tiles)
            if matched >= FROM * len(target):
                out.append({"item_id": self.ids[item], "tiles": len(tiles), "matched": matched, "item_words": len(target), "coverage": matched / len(target)})
        return out


def item_blocks(items: DataFrame, item_id: str = "item_id", text: str = "text") -> list[Items]:
    """The benchmark in blocks of about `BLOCK_WORDS` words."""
    known = items.select(F.col(item_id).cast("long").alias("i"), F.col(text).alias("t")).where("i IS NOT NULL AND t IS NOT NULL")
    size = known.agg(F.coalesce(F.sum(F.regexp_count("t", F.lit("[^ \\t-\\r]+"))), F.lit(0))).first()[0]
    n = -(-size // BLOCK_WORDS)
    out = []
    for b in range(n):
        got = collected(known.where(F.pmod(F.xxhash64("i", "t"), F.lit(n)) == b).orderBy("i", "t"))
        out.append(Items(got["i"].tolist(), got["t"].tolist()))
    return out


def matches_of(text: Column, blocks: list[Items], spark) -> Column:
    """Array of the items that a text leaks, over all blocks."""

    small_batches(spark)

    def column(block: Items) -> Column:
        sent = spark.sparkContext.broadcast(block)

        @F.pandas_udf(_MATCH)
        def find(texts: pd.Series) -> pd.Series:
            return pd.Series([sent.value.matches(w) for w in word_hashes(list(texts), "letters")], dtype=object)

        return find(text)

    return F.concat(*map(column, blocks)) if blocks else F.array().cast(_MATCH)


def leaks(docs: DataFrame, items: DataFrame, *, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, item_id, tiles, matched, item_words, coverage) of every leaked item."""
    found = matches_of(F.col(text), item_blocks(items), docs.sparkSession)
    return docs.select(doc_id, F.explode(found).alias("m")).select(doc_id, "m.*")


def clean(docs: DataFrame, items: DataFrame, *, text: str = "text") -> DataFrame:
    """The documents that leak nothing."""
    return docs.where(F.size(matches_of(F.col(text), item_blocks(items), docs.sparkSession)) == 0)
