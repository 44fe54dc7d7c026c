"""Removal of long repeats: bytes covered by a string of WINDOW bytes that also starts anywhere else.

**Routing.** Windows are compared only where they can be equal. Each window of WINDOW bytes is named by the
smallest hash among its grams of `GRAMS[0]` bytes, so equal windows have equal names. Neighbouring windows
mostly share their name and form a piece, at most PIECE windows. Names that occur at one place only, with
one such gram inside, are settled. Pieces with other names are folded by content and dealt to shards by name, about SHARD bytes each.
A shard leaves out the windows whose longest common gram occurs there only once.

**Index.** A shard builds a run-length index (`run_index`) of its distinct pieces and streams the matching
statistics of all positions from the sampled run ends; a window is marked where its match reaches WINDOW
bytes. Pieces with the same content in two places are marked whole.

**Hot names.** A name with more than HOT distinct pieces (a line that many documents hold in different
surroundings) is split: the windows of its pieces are named anew by longer grams, at last by the whole
window, for which there is only one content. Each step is the same procedure over the pieces of the step
before, so no group grows with the input.

**What moves.** Names and hashes of places; the bytes of pieces whose name is repeated, once per task; at
the end the texts once, to meet their spans, at every size alike. A bitmap of fixed size thins the pieces
before they are made; beyond FILTERED repeated names they are joined exactly as well. Texts are never gathered. Equal texts are told by their digest and marked whole.

Defined results: a null text counts as empty; texts under WINDOW bytes hold no window and stay whole, but
for none of their bytes anything can repeat; repeated rows are places of their own, so each of two equal
rows is removed where it is long enough; an empty table gives no row; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from typing import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stemma.llm.jaccard import MARKS, _marked
from stemma.llm.run_index import LONGEST, RunIndex
from stemma.llm.tables import attach, small_batches
from stemma.llm.wordhash import _mix
from stemma.session import cut_lineage

WINDOW = 400
GRAMS = (32, 128, 272, 400)
PIECE = 480
HOT = 256
SHARD = 1 << 20
FILTERED = 1 << 24
TOGETHER = 1 << 17
assert PIECE + WINDOW - 1 <= LONGEST

_BYTE = _mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
_ODD = np.uint64(0x9E3779B97F4A7C15)


def gram_hashes(x: np.ndarray, q: int) -> np.ndarray:
    """Hash of every q bytes."""
    h, size = _BYTE[x], 1
    while size * 2 <= q:
        h = h[:-size] * _ODD + (h[size:] ^ h[size:] >> np.uint64(29))
        h ^= h >> np.uint64(31)
        size *= 2
    if size < q:
        h = h[: len(x) - q + 1] * _ODD + (h[q - size :] ^ h[q - size :] >> np.uint64(29))
        h ^= h >> np.uint64(31)
    return h


def _smallest(h: np.ndarray, w: int) -> np.ndarray:
    """Minimum of every w neighbours."""
    v, size = h, 1
    while size * 2 <= w:
        v = np.minimum(v[:-size], v[size:])
        size *= 2
    return v if size == w else np.minimum(v[: len(h) - w + 1], v[w - size :])


def pieces(texts: list[bytes], q: int, window: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(text, first window, windows, name, whether its gram occurs twice) of the pieces of texts at least one window long."""
    sizes = np.array([len(t) for t in texts], np.int64)
    ends = np.cumsum(sizes)
    starts = ends - sizes
    x = np.frombuffer(b"".join(texts), np.uint8)
    grams = gram_hashes(x, q)
    name = _smallest(grams, window - q + 1)
    new = np.ones(len(name) + 1, bool)
    new[1:-1] = name[1:] != name[:-1]
    new[starts] = True
    beyond = ends - window + 1
    new[beyond[beyond < len(new)]] = True
    at = np.flatnonzero(new)
    size = np.diff(at)
    at = at[:-1]
    of = np.searchsorted(starts, at, side="right") - 1
    inside = at < beyond[of]
    at, size, of = at[inside], size[inside], of[inside]
    parts = -(-size // PIECE)
    which = np.repeat(np.arange(len(at)), parts)
    nth = np.arange(len(which)) - np.repeat(np.cumsum(parts) - parts, parts)
    first = at[which] + nth * PIECE
    windows = np.minimum(PIECE, size[which] - nth * PIECE)
    twice = _occurrences(grams, name[first], first, first + windows + window - q) > 1
    return of[which], first - starts[of[which]], windows, name[first], twice


def _occurrences(grams: np.ndarray, name: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
    """How often each name is among grams[lo:hi]."""
    low = np.uint64(0xFFFF)
    maybe = np.zeros(1 << 16, bool)
    maybe[(name & low).astype(np.int64)] = True
    names, rank = np.unique(name, return_inverse=True)
    at = np.flatnonzero(maybe[(grams & low).astype(np.int64)])
    place = np.minimum(np.searchsorted(names, grams[at]), len(names) - 1)
    real = names[place] == grams[at]
    n = len(grams) + 1
    found = np.sort(place[real] * n + at[real])
    return np.searchsorted(found, rank * n + hi) - np.searchsorted(found, rank * n + lo)


def _blocks(keys, texts, window: int, seen: set) -> Iterator[tuple[list, list]]:
    """Distinct texts that hold a window, a few at a time."""
    ks, ts, size = [], [], 0
    for k, t in zip(keys, texts):
        if len(t) < window or k in seen:
            continue
        seen.add(k)
        ks.append(k)
        ts.append(bytes(t))
        size += len(t)
        if size >= TOGETHER:
            yield ks, ts
            ks, ts, size = [], [], 0
    if ks:
        yield ks, ts


def _places(keys: list, of: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Hash that stands for the place of a piece."""
    k = np.array([int.from_bytes(k[:8], "little") for k in keys], np.uint64)
    return _mix(_mix(k)[of] + first.astype(np.uint64) * _ODD)


def repeated_names(rows: DataFrame, q: int, window: int) -> DataFrame:
    """Names of windows that occur at two places at least."""

    def named(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        seen: set = set()
        for b in batches:
            for ks, ts in _blocks(b["key"], b["b"], window, seen):
                of, first, _, name, twice = pieces(ts, q, window)
                place = _places(ks, of, first)
                both = np.r_[np.arange(len(of)), np.flatnonzero(twice)]
                place = np.r_[place, place[twice] + np.uint64(1)]
                yield pd.DataFrame({"token": name[both].view(np.int64), "place": place.view(np.int64)})

    found = rows.mapInPandas(named, "token long, place long").groupBy("token").agg(F.min("place").alias("lo"), F.max("place").alias("hi"))
    return cut_lineage(found.where("lo < hi").select("token"))


def candidates(rows: DataFrame, q: int, window: int) -> DataFrame:
    """Pieces whose name is repeated: (key, first, windows, token, digest, place, b); b once per task and content."""
    names = repeated_names(rows, q, window)
    many = names.count() > FILTERED
    marks = rows.sparkSession.sparkContext.broadcast(_marked(names))

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        seen: set = set()
        sent: set = set()
        for b in batches:
            for ks, ts in _blocks(b["key"], b["b"], window, seen):
                of, first, size, name, _ = pieces(ts, q, window)
                low = name & np.uint64((1 << MARKS) - 1)
                hit = np.flatnonzero(marks.value[(low >> np.uint64(6)).astype(np.int64)] >> (low & np.uint64(63)) & np.uint64(1))
                if not len(hit):
                    continue
                of, first, size, name = of[hit], first[hit], size[hit], name[hit]
                out = [ts[o][f : f + s + window - 1] for o, f, s in zip(of, first, size)]
                digest = [hashlib.blake2b(p, digest_size=16).digest() for p in out]
                for j, d in enumerate(digest):
                    if d in sent:
                        out[j] = None
                    else:
                        sent.add(d)
                place = _places(ks, of, first).view(np.int64)
                yield pd.DataFrame({"key": [ks[o] for o in of], "first": first, "windows": size, "token": name.view(np.int64), "digest": digest, "place": place, "b": out})

    found = rows.mapInPandas(cut, "key binary, first long, windows long, token long, digest binary, place long, b binary")
    return cut_lineage(found.join(names, "token", "left_semi") if many else found)


def _kept_parts(strings: list[bytes], window: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(string, first window, windows) of the parts of some strings whose long grams occur twice among them."""
    of, first, windows, name, twice = pieces(strings, window - window // 3, window)
    _, which, times = np.unique(name, return_inverse=True, return_counts=True)
    keep = (times[which] > 1) | twice
    of, first, windows = of[keep], first[keep], windows[keep]
    new = np.r_[True, (of[1:] != of[:-1]) | (first[1:] != first[:-1] + windows[:-1])][: len(of)]
    at = np.flatnonzero(new)
    return of[at], first[at], np.add.reduceat(windows, at) if len(at) else windows


def _shard_marks(window: int):
    def marks(part: pd.DataFrame) -> pd.DataFrame:
        """Windows of the distinct pieces of a shard that start elsewhere in it too, as ranges."""
        strings = [bytes(b) for b in part["b"]]
        of, first, windows = _kept_parts(strings, window)
        parts = [strings[o][f : f + w + window - 1] for o, f, w in zip(of, first, windows)]
        number: dict[bytes, int] = {}
        content = np.array([number.setdefault(p, len(number)) for p in parts], np.int64)
        index = RunIndex(list(number))
        hit = index.matching() >= window
        edge = np.diff(np.r_[0, hit.astype(np.int8), 0])
        lo, hi = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1) - 1
        holder = np.searchsorted(index.starts, lo, side="right") - 1
        lo, hi = lo - index.starts[holder], hi - index.starts[holder]
        begin = np.searchsorted(holder, np.arange(len(number) + 1))
        many = np.bincount(content, minlength=len(number)) > 1
        found: list[tuple[int, list]] = []
        for c, o, f, w in zip(content, of, first, windows):
            ranges = [(f, f + w - 1)] if many[c] else [(f + x, f + y) for x, y in zip(lo[begin[c] : begin[c + 1]], hi[begin[c] : begin[c + 1]])]
            if ranges:
                found.append((o, [{"lo": int(x), "hi": int(y)} for x, y in ranges]))
        digest = part["digest"].to_numpy()
        return pd.DataFrame({"digest": pd.Series([digest[o] for o, _ in found], dtype=object), "ranges": pd.Series([r for _, r in found], dtype=object)})

    return marks


def _joined(ranges) -> list[dict]:
    """Ranges of whole numbers, joined where they touch."""
    lo, end = spans(np.array([r["lo"] for r in ranges], np.int64), np.array([r["hi"] for r in ranges], np.int64), 1)
    return [{"lo": int(a), "hi": int(b) - 1} for a, b in zip(lo, end)]


def _gathered(rows: DataFrame, key: str) -> DataFrame:
    """One row per key with its ranges."""

    @F.pandas_udf("array<struct<lo:long,hi:long>>")
    def merged(ranges: pd.Series) -> pd.Series:
        return pd.Series([_joined(r) for r in ranges], dtype=object)

    return cut_lineage(rows.groupBy(key).agg(F.flatten(F.collect_list("ranges")).alias("ranges")).withColumn("ranges", merged("ranges")))


def repeated_windows(rows: DataFrame, window: int = WINDOW, grams: tuple[int, ...] = GRAMS) -> DataFrame:
    """(key, ranges): first bytes of windows of the distinct texts (key, b) that start elsewhere too, as ranges (lo, hi)."""
    found = candidates(rows, grams[0], window)
    contents = found.groupBy("token", "digest").agg(F.max("b").alias("b"), F.min("place").alias("lo"), F.max("place").alias("hi"), F.max("windows").alias("windows"))
    contents = cut_lineage(contents)
    sizes = cut_lineage(contents.groupBy("token").agg(F.count("*").alias("c"), F.sum(F.octet_length("b")).alias("bytes")))
    split = F.col("c") > HOT if len(grams) > 1 else F.lit(False)
    total = sizes.where(~split).agg(F.sum("bytes")).first()[0]
    shards = -(-int(total or 0) // SHARD) or 1
    hot = sizes.where(split).select("token")
    any_hot = len(grams) > 1 and hot.limit(1).count() > 0
    some = attach(contents, hot, ["token"], "left_anti") if any_hot else contents
    dealt = some.select("digest", "b", F.pmod(F.xxhash64("token"), F.lit(shards)).alias("shard"))
    marks = dealt.groupBy("shard").applyInPandas(_shard_marks(window), "digest binary, ranges array<struct<lo:long,hi:long>>")
    one = F.array(F.struct(F.lit(0).cast("long").alias("lo"), (F.col("windows") - 1).alias("hi")))
    marks = marks.unionByName(contents.where("lo < hi").select("digest", one.alias("ranges")))
    if any_hot:
        again = repeated_windows(attach(contents, hot, ["token"], "left_semi").select(F.col("digest").alias("key"), "b"), window, grams[1:])
        marks = marks.unionByName(again.withColumnRenamed("key", "digest"))
    placed = attach(found.select("key", "first", "digest").distinct(), _gathered(marks, "digest"), ["digest"])
    moved = F.transform("ranges", lambda r: F.struct((F.col("first") + r.lo).alias("lo"), (F.col("first") + r.hi).alias("hi")))
    return _gathered(placed.select("key", moved.alias("ranges")), "key")


def spans(lo: np.ndarray, hi: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray]:
    """Maximal runs of bytes [start, end) that windows with first bytes lo..hi cover."""
    order = np.argsort(lo, kind="stable")
    lo, end = lo[order], np.maximum.accumulate(hi[order] + window)
    new = np.r_[True, lo[1:] > end[:-1]]
    return lo[new], end[np.r_[new[1:], True]]


def removal(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", window: int = WINDOW, grams: tuple[int, ...] = GRAMS) -> DataFrame:
    """(doc_id, n_bytes, spans, kept): the removed runs of bytes of every row and what is left of its text."""
    small_batches(docs.sparkSession)
    body = F.coalesce(F.col(text), F.lit(""))
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.unhex(F.sha2(body, 256)).alias("key"), F.encode(body, "UTF-8").alias("b"))
    found = repeated_windows(rows.where(F.octet_length("b") >= window).select("key", "b"), window, grams)
    copies = rows.where(F.octet_length("b") >= window).groupBy("key").agg(F.count("*").alias("c"), F.max(F.octet_length("b")).alias("n"))
    whole = F.array(F.struct(F.lit(0).cast("long").alias("lo"), (F.col("n") - window).cast("long").alias("hi")))
    ranges = _gathered(found.unionByName(copies.where("c > 1").select("key", whole.alias("ranges"))), "key")
    joined = rows.join(ranges, "key", "left").select("doc_id", "b", F.col("ranges.lo").alias("lo"), F.col("ranges.hi").alias("hi"))

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for t, lo, hi in zip(b["b"], b["lo"], b["hi"]):
                t = bytes(t)
                if lo is None or not len(lo):
                    out.append((len(t), [], [], t))
                    continue
                s, e = spans(np.asarray(lo, np.int64), np.asarray(hi, np.int64), window)
                left = b"".join(t[i:j] for i, j in zip(np.r_[0, e], np.r_[s, len(t)]))
                out.append((len(t), s, e, left))
            made = pd.DataFrame(out, columns=["n_bytes", "starts", "ends", "kept"])
            made.insert(0, "doc_id", b["doc_id"].to_numpy())
            yield made

    kind = dict(rows.dtypes)["doc_id"]
    made = joined.mapInPandas(cut, f"doc_id {kind}, n_bytes long, starts array<long>, ends array<long>, kept binary")
    return made.select(F.col("doc_id").alias(doc_id), "n_bytes", F.arrays_zip("starts", "ends").alias("spans"), "kept")
