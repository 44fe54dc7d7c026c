"""Merkle manifest of a dataset as a content-addressed graph, with proofs by descent from the root.

**Records.** Every inner node is a record: its digest, and the digests of its children. Leaves of a group
ascend by their order; every `ARITY` consecutive nodes become a parent. The records of `LEVELS` levels
under one node travel together as a pack, keyed by the digest of that node, so a tree of any depth is
built and read with one exchange per `LEVELS` levels and no row holds more than `SPAN` leaves.

**Descent.** A request names a leaf by group and rank. It starts at the root. The digits of its rank in
base `ARITY` say which child to take at each record; the children not taken are its siblings. Requests
that share the digits so far are one row: they are split only where their digits part. A node is always
looked up by its digest. The path segments come out from the root down and are reversed for the proof.

**Ranks** are counted by range partitions: rows are sorted by (group, order) in ranges, and the counts of
each range before it are added. So a group with most of the rows is spread over many tasks.

Defined results: a missing value is written `-`, an empty text `0:`; rows without an id come first in
their source; equal rows are leaves of their own, with equal digests and the ranks of neighbours (rows
with one id are ordered by their digest); an empty table gives no row; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stemma.llm.tables import attach
from stemma.session import cut_lineage

ARITY, LEVELS = 3, 5
SPAN = ARITY**LEVELS
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
TOP = ""


def _written(value: Column) -> Column:
    s = value.cast("string")
    return F.when(value.isNull(), "-").otherwise(F.concat(F.octet_length(s).cast("string"), F.lit(":"), s))


def leaf_digest(*values: Column) -> Column:
    """Digest of a row: each value with its length in bytes, so no two rows are written alike."""
    return F.sha2(F.concat(*[_written(v) for v in values]), 256)


def group_key(source: Column) -> Column:
    """Text that orders sources by their bytes, a missing one first."""
    return F.coalesce(F.concat(F.lit("="), source.cast("string")), F.lit(TOP))


def _ceil_div(n: str, by: int) -> str:
    return f"(({n} + {by - 1}) DIV {by})"


def _depth(n: str) -> str:
    """Levels of a pack whose tier has n nodes: as many as its group still needs, at most LEVELS."""
    return "(" + " + ".join(f"CAST({n} > {ARITY**k} AS INT)" for k in range(LEVELS)) + ")"


def ranked(rows: DataFrame, group: str, *order: str) -> DataFrame:
    """Rows with their place `i` in their group and the size `n` of the group, without a task per group."""
    dealt = rows.repartitionByRange(group, *order).sortWithinPartitions(group, *order)
    dealt = cut_lineage(dealt.withColumn("_at", F.monotonically_increasing_id()).withColumn("_part", F.shiftright("_at", 33)))
    counts = dealt.groupBy(group, "_part").agg(F.min("_at").alias("_first"), F.count("*").alias("_n"))
    of = Window.partitionBy(group)
    before = F.sum("_n").over(of.orderBy("_part").rowsBetween(Window.unboundedPreceding, Window.currentRow)) - F.col("_n")
    counts = cut_lineage(counts.select(group, "_part", (before - F.col("_first")).alias("_shift"), F.sum("_n").over(of).alias("n")))
    return attach(dealt, counts, [group, "_part"]).withColumn("i", F.col("_at") + F.col("_shift")).drop("_at", "_part", "_shift")


def build(nodes: DataFrame) -> tuple[DataFrame, list[DataFrame]]:
    """Roots (g, n, digest) of nodes (g, i, n, digest), and the packs of each tier (top, keys, children)."""
    tiers, finished, n_sql = [], [], "n"
    while True:
        most = nodes.agg(F.max(F.expr(n_sql))).first()[0]
        finished.append(nodes.where(F.expr(n_sql) == 1).select("g", "n", "digest"))
        if most is None or most <= 1:
            break
        parents = f"transform(sequence(0, size(element_at(acc, -1)) - 1, {ARITY}), k -> sha2(array_join(slice(element_at(acc, -1), k + 1, {ARITY}), ''), 256))"
        levels = f"aggregate(slice(sequence(1, {LEVELS}), 1, {_depth(n_sql)}), array(base), (acc, l) -> concat(acc, array({parents})))"
        grouped = nodes.where(F.expr(n_sql) > 1).groupBy("g", "n", F.expr(f"i DIV {SPAN}").alias("i")).agg(F.sort_array(F.collect_list(F.struct("i", "digest"))).alias("base"))
        built = cut_lineage(grouped.withColumn("base", F.col("base.digest")).withColumn("levels", F.expr(levels)).drop("base").withColumn("digest", F.expr("element_at(levels, -1)[0]")))
        record = f"transform(slice(levels, 2, {LEVELS}), (ps, l) -> transform(ps, (p, k) -> struct(p AS digest, slice(levels[l], {ARITY} * k + 1, {ARITY}) AS children)))"
        tiers.append(built.select(F.col("digest").alias("top"), F.expr(f"flatten({record})").alias("records")))
        nodes, n_sql = built.select("g", "n", "i", "digest"), _ceil_div("n", SPAN ** len(tiers))
    roots = finished[0]
    for f in finished[1:]:
        roots = roots.unionByName(f)
    return roots, tiers


def records(tiers: list[DataFrame]) -> DataFrame:
    """All stored nodes: (digest, children), each digest once."""
    out = None
    for packs in tiers:
        rows = packs.select(F.inline("records"))
        out = rows if out is None else out.unionByName(rows)
    return out.dropDuplicates(["digest"]) if out is not None else None


def _walk() -> str:
    """Descent inside a pack: digits of r.i choose children, those left out are collected as (before, after)."""
    digits = f"transform(slice(sequence(1, {LEVELS}), 1, h), k -> CAST(r.i DIV element_at(array({', '.join(str(ARITY**k) for k in range(LEVELS))}), h - k + 1) % {ARITY} AS INT))"
    kids = "children[array_position(keys, s.digest) - 1]"
    left, right = f"array_join(slice({kids}, 1, d), '')", f"array_join(slice({kids}, d + 2, {ARITY}), '')"
    step = f"named_struct('digest', {kids}[d], 'path', concat(s.path, array(struct({left} AS before, {right} AS after))))"
    return f"aggregate({digits}, struct(digest, path), (s, d) -> {step})"


def descend(start: DataFrame, tiers: list[DataFrame], requests: DataFrame) -> DataFrame:
    """Rows (payload, digest, path, ...) of requests (g, i, payload), from the rows (g, n, digest, path, ...) of `start`.

    `path` gains one (before, after) per level, from the root down. Other columns of `start` are kept.
    """
    kept = [c for c in start.columns if c not in ("g", "n", "digest", "path")]
    state = start.withColumn("node", F.lit(0).cast("long"))
    for t in range(max(len(tiers), 1) - 1, -1, -1):
        here = F.expr(f"i DIV {SPAN**t}")
        if t:
            want = requests.select("g", here.alias("to")).distinct().select("g", "to", F.lit(0).alias("payload"))
        else:
            want = requests.select("g", F.col("i").alias("to"), "payload")
        want = want.groupBy("g", F.expr(f"to DIV {SPAN}").alias("node")).agg(F.collect_list(F.struct((F.col("to") % SPAN).alias("i"), "to", "payload")).alias("wanted"))
        at = want.join(state, ["g", "node"])
        if tiers:
            packs = tiers[t].select("top", F.col("records.digest").alias("keys"), F.col("records.children").alias("children")).dropDuplicates(["top"])
            at = at.join(packs, F.col("digest") == F.col("top"), "left")
        else:
            at = at.withColumn("keys", F.lit(None).cast("array<string>")).withColumn("children", F.lit(None).cast("array<array<string>>"))
        at = at.withColumn("h", F.expr(_depth(_ceil_div("n", SPAN**t))))
        reached = F.expr(f"explode(transform(wanted, r -> struct(r.to AS node, r.payload AS payload, {_walk()} AS s)))").alias("x")
        at = at.select("g", "n", *kept, reached).select("g", "n", *kept, "x.node", "x.payload", "x.s.digest", "x.s.path")
        state = cut_lineage(at.drop("payload")) if t else at
    return state


def proofs(docs: DataFrame, tampered: Column, changed_text: Column, fields: tuple[str, ...] = FIELDS) -> DataFrame:
    """Leaf, subroot, root and proof of every row, and the root that follows from the row as it is now.

    Rows for which `tampered` holds are read again with `changed_text` as their text; the proof stays that
    of the manifest. `verified` says whether the root follows still.
    """
    doc_id, source, _, _, text = fields
    values = [F.col(f) for f in fields]
    leaf = leaf_digest(*values)
    now = F.when(tampered, leaf_digest(*[changed_text if f == text else F.col(f) for f in fields]))
    leaves = docs.select(group_key(F.col(source)).alias("g"), F.col(doc_id).alias("doc_id"), leaf.alias("digest"), now.alias("now"))
    nodes = cut_lineage(ranked(cut_lineage(leaves), "g", "doc_id", "digest"))
    roots, tiers = build(nodes.select("g", "i", "n", "digest"))
    tops = cut_lineage(ranked(roots.select(F.lit(TOP).alias("one"), F.col("g").alias("of"), F.col("n").alias("size"), "digest"), "one", "of"))
    upper_root, upper = build(tops.select(F.col("one").alias("g"), "i", "n", "digest"))
    start = upper_root.select("g", "n", "digest", F.expr("CAST(array() AS array<struct<before:string,after:string>>)").alias("path"), F.col("digest").alias("root"))
    sources = descend(start, upper, tops.select(F.col("one").alias("g"), "i", F.struct("of", "size").alias("payload")))
    sources = cut_lineage(sources.select(F.col("payload.of").alias("g"), F.col("payload.size").alias("n"), "digest", "path", "root", F.col("digest").alias("subroot")))
    found = descend(sources, tiers, nodes.select("g", "i", F.struct("doc_id", F.col("digest").alias("leaf"), "now").alias("payload")))
    up = found.select("payload.*", "subroot", "root", F.reverse("path").alias("path"))
    siblings = F.expr("array_join(transform(path, s -> concat(s.before, s.after)), '')")
    folded = F.expr("aggregate(path, coalesce(now, leaf), (acc, s) -> sha2(concat(s.before, acc, s.after), 256))")
    return up.select(F.col("doc_id").alias(doc_id), "leaf", "subroot", "root", F.sha2(siblings, 256).alias("proof_sha256"), folded.alias("folded_root")).withColumn("verified", F.col("folded_root") == F.col("root"))
