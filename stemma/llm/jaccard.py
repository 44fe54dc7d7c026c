"""Near-duplicate join on word shingles with adaptive multi-match prefixes.

Two documents link if the Jaccard similarity of their sets of shingles (`WIDTH` words) is at least
`PERCENT` per cent, decided exactly on the whole sets. Shingles are 64-bit hashes.

**Prefixes.** All sets are written in one order: rare shingles first. Of two linked sets r and s, at
least m shingles are shared within the first |r| - a + m of r and |s| - a + m of s, where a is the
overlap they need, for every m up to a. A document posts its first |r| - ceil(PERCENT |r|) + l shingles.
It chooses l by estimated cost: a longer prefix posts more and reads longer lists, but a partner then
has to share l of them before it is verified. A pair uses m = min(l_r, l_s), for which both posted
enough, so the choice never loses a link. The two ends above also bound the positions of every posted
match, given both sizes. Pairs found this way are then held against all that they posted: the prefix that
ends first in the order has all its shared shingles posted by the other one too, so a pair shares at most
these and what one of the two did not post. Where that is too little, no text is read again.

**Order.** Each task reports the shingles that several of its documents share; the sums give the counts
of the most frequent ones (at most `LISTED`, all others count as rare). Any common order gives the same
result; the counts only keep frequent lines and passages out of the prefixes.

**Copies.** Equal sets are folded to their smallest id first. The rest of a group of near copies is tied
together by stars: documents that share several of their `HEADS` smallest hashes are verified against
the most central of them, the one whose shingles are the most frequent. After that the prefix join
looks only at pairs in different components, so a group of n near copies costs about n pairs instead of
n * n / 2. Skipped pairs are inside one component already and could not change the result.

Prefixes, pairs and sets are shuffled by Spark. What reaches the driver has a fixed size: the counts of
`LISTED` shingles, and a bitmap of those that occur in two components, which thins the prefixes before
they are joined. Sets are rebuilt from the text only for documents in a candidate pair, a quarter of each
first. Tables of ids are sent to the tasks below `SMALL_IDS` counted rows and joined by shuffle beyond.

Defined results: a null or empty text has 0 shingles and links with nothing, not even with its like; a
text with fewer than `WIDTH` words has one shingle, the whole sequence; repeated rows of one id are one
node and are returned once each (ids are expected to be unique: if rows with one id differ in text, links
of either text may join them); an empty table gives no row; other columns are ignored.
"""

from __future__ import annotations

from typing import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stemma.llm.components import connected
from stemma.llm.tables import attach, collected, small_batches
from stemma.llm.wordhash import _mix, windows, word_hashes
from stemma.session import cut_lineage

WIDTH, PERCENT = 5, 80
HEADS, SHARED_HEADS = 8, 3
LONGEST = 4
LISTED, LEAST_LISTED = 1 << 18, 16
COUNTED_TOGETHER, TOGETHER = 1_000_000, 256
SMALL_IDS = 300_000
RANGE, SENT_TOGETHER = 150_000, 250_000
MARKS = 26  # bits of the hash that address the bitmap of shared shingles, 8 MB
_VERIFY = 20.0


def _sets(rows: pd.DataFrame, width: int) -> Iterator[tuple[int, np.ndarray]]:
    """Id and sorted distinct shingles of each row, built for a few rows at a time."""
    for at in range(0, len(rows), TOGETHER):
        part = rows.iloc[at : at + TOGETHER]
        for i, words in zip(part["id"], word_hashes(list(part["t"]))):
            yield i, np.unique(windows(words, width))


def _overlap(n: Column, m: Column) -> Column:
    """Shared shingles that sets of n and m need."""
    return F.expr(f"({PERCENT} * ({n} + {m}) + {99 + PERCENT}) DIV {100 + PERCENT}")


def frequent(docs: DataFrame, width: int) -> tuple[np.ndarray, np.ndarray]:
    """The most frequent shingles, sorted by hash, and how often tasks saw them more than once at a time."""

    def shared(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: list[np.ndarray] = []
        size = 0
        for b in batches:
            for _, s in _sets(b, width):
                held.append(s)
                size += len(s)
                if size >= COUNTED_TOGETHER:
                    yield count(held)
                    held, size = [], 0
        if held:
            yield count(held)

    def count(held: list[np.ndarray]) -> pd.DataFrame:
        token, n = np.unique(np.concatenate(held), return_counts=True)
        return pd.DataFrame({"token": token[n > 1].view(np.int64), "n": n[n > 1]})

    counts = cut_lineage(docs.mapInPandas(shared, "token long, n long").groupBy("token").agg(F.sum("n").alias("n")).where(F.col("n") >= LEAST_LISTED))
    levels = sorted(((r["level"], r["c"]) for r in counts.groupBy(F.floor(F.log2("n")).alias("level")).agg(F.count("*").alias("c")).collect()), reverse=True)
    total, least = 0, None
    for level, c in levels:
        total += c
        if total > LISTED:
            break
        least = 2**level
    if least is None:
        return np.empty(0, np.uint64), np.empty(0, np.int64)
    got = collected(counts.where(F.col("n") >= least))
    token, n = got["token"].to_numpy(np.int64).view(np.uint64), got["n"].to_numpy(np.int64)
    order = np.argsort(token)
    return token[order], n[order]


class Ranks:
    """Estimated counts of shingles, 1 for those that are not listed."""

    def __init__(self, token: np.ndarray, n: np.ndarray):
        self.token, self.n = token, n
        self.maybe = np.zeros(1 << 20, bool)
        self.maybe[(token & np.uint64(0xFFFFF)).astype(np.int64)] = True

    def count(self, s: np.ndarray) -> np.ndarray:
        out = np.ones(len(s), np.int64)
        at = np.flatnonzero(self.maybe[(s & np.uint64(0xFFFFF)).astype(np.int64)]) if len(self.token) else []
        if len(at):
            place = np.minimum(np.searchsorted(self.token, s[at]), len(self.token) - 1)
            hit = self.token[place] == s[at]
            out[at[hit]] = self.n[place[hit]]
        return out


def _describe(id_, s: np.ndarray, ranks: Ranks) -> tuple:
    """The row of one document: size, fingerprint, centrality, l, prefix and heads."""
    if not len(s):
        return id_, 0, 0, 0, 0.0, 0, [], []
    count = ranks.count(s)
    order = np.argsort(count, kind="stable")  # rare first, equal counts by hash
    need = -(-PERCENT * len(s) // 100)
    most = min(LONGEST, need)
    others = np.cumsum(count[order] - 1.0)
    ends = len(s) - need + np.arange(1, most + 1)
    found = others[ends - 1]
    cost = ends + found + _VERIFY * found / np.arange(1, most + 1)
    l = int(np.argmin(cost)) + 1
    fold = _mix(s ^ np.uint64(0x5851F42D4C957F2D)).sum(), _mix(s + np.uint64(0x14057B7EF767814F)).sum()
    first, second = np.array(fold, np.uint64).view(np.int64)
    return id_, len(s), int(first), int(second), float(count.mean()), l, s[order[: ends[l - 1]]].view(np.int64), s[:HEADS].view(np.int64)


_ROW = "id long, n int, f1 long, f2 long, central double, l int, prefix array<long>, heads array<long>"


def describe(docs: DataFrame, width: int) -> DataFrame:
    """One row per document with all that the join needs but the whole set."""
    ranks = docs.sparkSession.sparkContext.broadcast(Ranks(*frequent(docs, width)))
    names = [c.split()[0] for c in _ROW.split(", ")]

    def rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield pd.DataFrame([_describe(i, s, ranks.value) for i, s in _sets(b, width)], columns=names)

    return cut_lineage(docs.mapInPandas(rows, _ROW))


def _only(rows: DataFrame, ids: DataFrame, on: str) -> DataFrame:
    """Rows whose key is in a table of numbers, which is sent to the tasks if its counted rows allow it."""
    return rows.join(F.broadcast(ids) if ids.limit(SMALL_IDS + 1).count() <= SMALL_IDS else ids, on, "left_semi")


def _compare(docs: DataFrame, pairs: DataFrame, width: int, bits: int) -> DataFrame:
    """The pairs that can be similar enough, judged on the shingles whose hash begins with `bits` zeros.

    Of shingles outside that part, as many are taken as shared as the sizes allow, so no similar pair is
    lost. With 0 bits the whole sets are compared and the answer is exact. The set of b travels to its
    partners, the sets that are met there once each.
    """
    pairs = cut_lineage(pairs.select("a", "b").distinct())
    few = pairs.limit(SMALL_IDS + 1).count() <= SMALL_IDS
    both = pairs.select(F.col("b").alias("id"), F.col("a").alias("partner")).unionByName(pairs.select(F.col("a").alias("id"), F.lit(None).cast("long").alias("partner")))
    needs = cut_lineage(both.groupBy("id").agg(F.collect_list("partner").alias("partners"), F.max(F.col("partner").isNull()).alias("met")))
    below = np.uint64((1 << (64 - bits)) - 1)

    def build(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            made = [(len(s), s[s <= below].tobytes()) for _, s in _sets(b, width)]
            yield b.assign(n=[n for n, _ in made], s=[s for _, s in made]).drop(columns="t")

    sets = docs.join(F.broadcast(needs) if few else needs, "id").select("id", "t", "partners", "met")
    sets = cut_lineage(sets.mapInPandas(build, "id long, partners array<long>, met boolean, n int, s binary"))

    @F.pandas_udf("boolean")
    def similar(x: pd.Series, y: pd.Series, nx: pd.Series, ny: pd.Series) -> pd.Series:
        out = []
        for p, q, n, m in zip(x, y, nx, ny):
            p, q = np.frombuffer(p, np.uint64), np.frombuffer(q, np.uint64)
            most = len(np.intersect1d(p, q, assume_unique=True)) + min(n - len(p), m - len(q))
            out.append(100 * most >= PERCENT * (n + m - most))
        return pd.Series(out, dtype=bool)

    sent = sets.select(F.explode("partners").alias("a"), F.col("id").alias("b"), F.col("s").alias("sb"), F.col("n").alias("nb"))
    met = sets.where("met").select(F.col("id").alias("a"), F.col("s").alias("sa"), F.col("n").alias("na"))
    return sent.join(met, "a").where(similar("sa", "sb", "na", "nb")).select("a", "b").distinct()


def verify(docs: DataFrame, pairs: DataFrame, width: int) -> DataFrame:
    """The pairs (a, b) whose whole sets are similar enough: a quarter of the sets first, then all of those left."""
    return _compare(docs, _compare(docs, pairs, width, 2), width, 0)


def _stars(reps: DataFrame) -> DataFrame:
    """Pairs of the most central document (a) with each of those that share a head with it (b)."""
    heads = reps.select("id", "n", "central", F.explode("heads").alias("token"))
    best = heads.groupBy("token").agg(F.max(F.struct("central", (-F.col("id")).alias("minus"), "n")).alias("best"), F.count("*").alias("c")).where("c > 1")
    pivot = best.select("token", (-F.col("best.minus")).alias("hub"), F.col("best.n").alias("hub_n"))
    return (
        heads.join(pivot, "token")
        .where(F.col("id") != F.col("hub"))
        .where(_overlap("n", "hub_n") <= F.least("n", "hub_n"))
        .groupBy("id", "hub")
        .count()
        .where(F.col("count") >= SHARED_HEADS)
        .select(F.col("hub").alias("a"), F.col("id").alias("b"))
    )


def _marked(tokens: DataFrame) -> np.ndarray:
    """Bitmap of the low hash bits of some shingles; its size does not depend on their number."""
    low = F.col("token").bitwiseAND(F.lit((1 << MARKS) - 1))
    words = tokens.groupBy(F.shiftright(low, 6).alias("at")).agg(F.bit_or(F.expr(f"shiftleft(1L, CAST(token & 63 AS INT))")).alias("bits"))
    got = collected(words)
    out = np.zeros(1 << (MARKS - 6), np.uint64)
    out[got["at"].to_numpy(np.int64)] = got["bits"].to_numpy(np.int64).view(np.uint64)
    return out


def _ends(token: np.ndarray, root: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sorted shingles with the smallest and the largest root of each, once where they are the same."""
    order = np.lexsort((root, token))
    token, root = token[order], root[order]
    new = token[1:] != token[:-1]
    first, last = np.r_[True, new], np.r_[new, True]
    start = root[np.maximum.accumulate(np.where(first, np.arange(len(token)), 0))]
    keep = first | (last & (root != start))
    return token[keep], root[keep]


def _planes(x: np.ndarray) -> bytes:
    """Numbers byte by byte, all lowest bytes first, so that the high bytes, mostly zeros, take no room when Spark compresses them."""
    return x.view(np.uint8).reshape(-1, 8).T.tobytes()


def _unplaned(b: bytes) -> np.ndarray:
    return np.frombuffer(b, np.uint8).reshape(8, -1).T.copy().view(np.uint64).ravel()


def _mixed(prefixes: DataFrame) -> DataFrame:
    """The shingles (token) that prefixes of two components hold, from (root, prefix).

    A task sorts the shingles of its prefixes and sends each range of them as differences, half the bytes of a row per
    shingle; of a shingle it sends two roots at most. A range holds about `RANGE` shingles in all.
    """
    total = prefixes.agg(F.sum(F.size("prefix")).alias("n")).first()["n"] or 0
    ranges = np.uint64(min(max(prefixes.sparkSession.sparkContext.defaultParallelism, -(-total // RANGE)), 1 << 24))

    def packed(held: list[tuple[np.ndarray, np.ndarray]]) -> pd.DataFrame:
        token, root = _ends(*(np.concatenate(c) for c in zip(*held)))
        at = ((token >> np.uint64(40)) * ranges >> np.uint64(24)).astype(np.int32)
        cut = np.flatnonzero(np.r_[True, at[1:] != at[:-1]])
        rows = [(int(at[lo]), _planes(np.diff(token[lo:hi], prepend=np.uint64(0))), _planes(root[lo:hi])) for lo, hi in zip(cut, [*cut[1:], len(token)])]
        return pd.DataFrame(rows, columns=["range", "tokens", "roots"])

    def sent(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held, size = [], 0
        for b in batches:
            for root, p in zip(b["root"].to_numpy(np.int64).view(np.uint64), b["prefix"]):
                if len(p):
                    held.append((np.asarray(p, np.int64).view(np.uint64), np.full(len(p), root)))
                    size += len(p)
                if size >= SENT_TOGETHER:
                    yield packed(held)
                    held, size = [], 0
        if held:
            yield packed(held)

    def met(rows: pd.DataFrame) -> pd.DataFrame:
        token = np.concatenate([np.cumsum(_unplaned(b), dtype=np.uint64) for b in rows["tokens"]])
        token, _ = _ends(token, np.concatenate([_unplaned(b) for b in rows["roots"]]))
        return pd.DataFrame({"token": token[1:][token[1:] == token[:-1]].view(np.int64)})

    return prefixes.mapInPandas(sent, "range int, tokens binary, roots binary").groupBy("range").applyInPandas(met, "token long")


def _candidates(rows: DataFrame, roots: DataFrame) -> DataFrame:
    """Pairs in different components that share enough of their prefixes."""
    placed = rows.join(roots.withColumnRenamed("node", "id"), "id", "left").select("id", "n", "l", F.coalesce("root", "id").alias("root"), "prefix")
    mixed = cut_lineage(_mixed(placed.select("root", "prefix")))
    marks = rows.sparkSession.sparkContext.broadcast(_marked(mixed))

    def shared(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """Only the places of prefixes whose shingle may occur in two components."""
        for b in batches:
            at, token = [], []
            for p in b["prefix"]:
                low = p.view(np.uint64) & np.uint64((1 << MARKS) - 1)
                hit = np.flatnonzero(marks.value[(low >> np.uint64(6)).astype(np.int64)] >> (low & np.uint64(63)) & np.uint64(1))
                at.append(hit.astype(np.int32))
                token.append(p[hit])
            yield b.assign(at=at, token=token).drop(columns="prefix")

    some = cut_lineage(placed.mapInPandas(shared, "id long, n int, l int, root long, at array<int>, token array<long>"))
    posts = some.select("id", "n", "l", "root", F.explode(F.arrays_zip("at", "token")).alias("p")).select("id", "n", "l", "root", F.col("p.at").alias("pos"), F.col("p.token").alias("token"))
    posts = cut_lineage(posts.join(mixed, "token", "left_semi"))
    x, y = posts.alias("x"), posts.alias("y")
    need, m = _overlap("x.n", "y.n"), F.least("x.l", "y.l")
    met = (
        x.join(y, F.col("x.token") == F.col("y.token"))
        .where((F.col("x.id") < F.col("y.id")) & (F.col("x.root") != F.col("y.root")) & (need <= F.least("x.n", "y.n")))
        .where((F.col("x.pos") < F.col("x.n") - need + m) & (F.col("y.pos") < F.col("y.n") - need + m))
        .select(F.col("x.id").alias("a"), F.col("y.id").alias("b"), m.alias("m"))
        .groupBy("a", "b")
        .agg(F.count("*").alias("c"), F.max("m").alias("m"))
        .where("c >= m")
        .select("a", "b")
    )
    return _reaching(met, some)


def _reaching(pairs: DataFrame, posted: DataFrame) -> DataFrame:
    """The pairs (a, b) that can reach the overlap they need by all shingles that both posted (id, n, l, token)."""
    side = lambda s: posted.select(F.col("id").alias(s), *[F.col(c).alias(f"{c}_{s}") for c in ("n", "l", "token")])
    unposted = F.greatest(*[F.expr(f"({PERCENT} * n_{s} + 99) DIV 100 - l_{s}") for s in "ab"])
    both = pairs.join(side("a"), "a").join(side("b"), "b")
    return both.where(F.size(F.array_intersect("token_a", "token_b")) + unposted >= _overlap("n_a", "n_b")).select("a", "b")


def near_duplicates(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", width: int = WIDTH) -> DataFrame:
    """(doc_id, n_shingles, component_id) of every row; component_id is the smallest id that links reach."""
    small_batches(docs.sparkSession)
    docs = docs.select(F.col(doc_id).cast("long").alias("id"), F.col(text).alias("t"))
    rows = describe(docs, width)
    folded = cut_lineage(rows.where("n > 0").groupBy("f1", "f2").agg(F.min("id").alias("rep")))
    reps = _only(rows.where("n > 0"), cut_lineage(folded.select(F.col("rep").alias("id")).distinct()), "id")
    stars = verify(docs, _stars(reps), width)
    roots = connected(stars)
    links = verify(docs, _candidates(reps, roots), width)
    roots = connected(links.unionByName(roots.select(F.col("root").alias("a"), F.col("node").alias("b"))))
    named = rows.select("id", "n", "f1", "f2").join(folded, ["f1", "f2"], "left").withColumn("rep", F.when(F.col("n") > 0, F.col("rep")).otherwise(F.col("id")))
    return named.join(roots.withColumnRenamed("node", "rep"), "rep", "left").select(
        F.col("id").alias(doc_id), F.col("n").cast("long").alias("n_shingles"), F.coalesce("root", "rep").alias("component_id")
    )


def one_of_each(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row of each group of near copies: that with the smallest id, rows without id last.

    Each row is a node of its own, told by a hash of all its columns; so rows that share an id but not their
    text stay, and of equal rows one. Only ids and hashes are grouped; whole rows are compared where two of
    them are equal.
    """
    empty = F.array(*[F.col(c).isNull() for c in docs.columns])
    rows = docs.withColumn("_node", F.xxhash64(*docs.columns, empty)).withColumn("_twin", F.xxhash64(F.lit(1), *docs.columns, empty))
    groups = near_duplicates(rows.select("_node", text), doc_id="_node", text=text).select("_node", "component_id").distinct()
    named = cut_lineage(groups).join(rows.select("_node", doc_id), "_node").groupBy("component_id", doc_id).agg(F.min("_node").alias("_node"))
    first = named.groupBy("component_id").agg(F.coalesce(F.min_by("_node", doc_id), F.min("_node")).alias("_node"))
    left = cut_lineage(_only(rows, cut_lineage(first.select("_node")), "_node").groupBy("_node", "_twin").agg(F.count("*").alias("c")))
    often = left.where("c > 1").select("_node", "_twin")
    once = _only(rows, left.where("c = 1").select("_node").distinct(), "_node")
    if not often.limit(1).count():
        return once.select(*docs.columns)
    many = attach(rows, often, ["_node", "_twin"], "left_semi").dropDuplicates(["_node", "_twin"])
    alone = attach(once, often, ["_node", "_twin"], "left_anti")
    return alone.unionByName(many).select(*docs.columns)
