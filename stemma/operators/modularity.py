"""Communities of an undirected weighted graph by modularity: parallel local moving and contraction.

A node moves to the neighbouring community that raises modularity most. All nodes of a round judge the
same state, so moves of neighbours could undo each other; only a part of the nodes, chosen by a hash of node
and round, may move at once, and a round that lowers modularity is taken back and tried with a smaller part.
When hardly any node gains, communities become the nodes of a smaller graph, whose loops hold the weight inside,
and the moves start again there. It ends when a level changes nothing.

A round is aggregates and joins on narrow rows: weight between a node and each community near it (a hub is
summed before the shuffle), total weight of each community, and the best choice by `max_by`. States are
written to the shared folder, so a lost executor re-reads the last one.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stemma.session import ensure_checkpoint_dir

LEAST_GAIN = 1e-9
LEAST_RISE = 3e-3  # a level ends with the second round that raises modularity by less; the next level is smaller and goes on
PARTS = (2, 4, 8, 16)


def _stored(df: DataFrame) -> DataFrame:
    """The rows written to the shared folder and read again.

    A file has a known size. The size estimate of a checkpoint is that of its plan, and estimates multiply
    in joins, so with several joined states a round planning would take ever longer.
    """
    path = f"{ensure_checkpoint_dir(df.sparkSession).rstrip('/')}/stemma/modularity-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def both_ways(edges: DataFrame, weight: str | None = None) -> DataFrame:
    """Rows (u, v, w) from either end of an edge list (src, dst); parallel edges count once, loops not at all."""
    w = F.col(weight) if weight else F.lit(1.0)
    one = edges.where("src <> dst").select(F.least("src", "dst").alias("u"), F.greatest("src", "dst").alias("v"), w.cast("double").alias("w"))
    one = one.groupBy("u", "v").agg(F.sum("w").alias("w") if weight else F.max("w").alias("w"))
    return one.select(F.inline(F.array(F.struct("u", "v", "w"), F.struct(F.col("v").alias("u"), F.col("u").alias("v"), "w"))))


def modularity(arcs: DataFrame, member: DataFrame) -> float:
    """Modularity of the communities (node, c) of arcs (u, v, w), each edge given from both ends; 0 without edges."""
    m = member.select(F.col("node").alias("u"), F.col("c").alias("cu"))
    n = member.select(F.col("node").alias("v"), F.col("c").alias("cv"))
    placed = arcs.join(m, "u").join(n, "v")
    sums = placed.groupBy("cu").agg(F.sum("w").alias("total"), F.sum(F.when(F.col("cu") == F.col("cv"), F.col("w")).otherwise(0.0)).alias("inside"))
    got = sums.agg(F.sum("total").alias("all"), F.sum("inside").alias("inside"), F.sum(F.col("total") * F.col("total")).alias("squares")).first()
    return got["inside"] / got["all"] - got["squares"] / got["all"] ** 2 if got["all"] else 0.0


def _choices(arcs: DataFrame, member: DataFrame, degree: DataFrame, total: float) -> DataFrame:
    """(node, to) of nodes that gain by joining a neighbour's community; ties go to the smaller one."""
    sums = member.join(degree, "node").groupBy("c").agg(F.sum("k").alias("sum_c"), F.count("*").alias("size"))
    near = arcs.where("u <> v").join(member.select(F.col("node").alias("v"), F.col("c").alias("to")), "v").groupBy(F.col("u").alias("node"), "to").agg(F.sum("w").alias("near"))
    own = member.join(degree, "node").select("node", F.col("c").alias("own"), "k")
    stay = near.withColumnRenamed("to", "own").withColumnRenamed("near", "stay")
    of = own.join(stay, ["node", "own"], "left").join(sums.select(F.col("c").alias("own"), F.col("sum_c").alias("sum_own"), F.col("size").alias("size_own")), "own")
    to = near.join(of, "node").where("to <> own").join(sums.select(F.col("c").alias("to"), F.col("sum_c").alias("sum_to"), F.col("size").alias("size_to")), "to")
    k = F.col("k")
    gain = (F.col("near") - F.coalesce("stay", F.lit(0.0))) - k * (F.col("sum_to") - (F.col("sum_own") - k)) / F.lit(total)
    swaps = (F.col("size_own") == 1) & (F.col("size_to") == 1) & (F.col("to") > F.col("own"))
    told = to.withColumn("gain", gain).where((F.col("gain") > LEAST_GAIN * total) & ~swaps)
    return told.groupBy("node").agg(F.max_by("to", F.struct("gain", -F.col("to"))).alias("to"))


def _local_moving(arcs: DataFrame, member: DataFrame, rounds: int) -> tuple[DataFrame, float]:
    degree = _stored(arcs.groupBy(F.col("u").alias("node")).agg(F.sum("w").alias("k")))
    total = degree.agg(F.sum("k")).first()[0] or 0.0
    best, part, turn, slow = modularity(arcs, member), 0, 0, 0
    if not total:
        return member, best
    while turn < rounds and slow < 2:
        turn += 1
        wish = _stored(_choices(arcs, member, degree, total))
        if wish.isEmpty():
            break
        awake = F.pmod(F.xxhash64("node", F.lit(turn)), F.lit(PARTS[part])) == 0
        tried = _stored(member.join(wish.where(awake), "node", "left").select("node", F.coalesce("to", "c").alias("c")))
        q = modularity(arcs, tried)
        slow += q >= best and q - best < LEAST_RISE
        if q >= best:
            member, best = tried, q
        elif part + 1 < len(PARTS):
            part += 1
    return member, best


def communities(nodes: DataFrame, edges: DataFrame, weight: str | None = None, rounds: int = 40) -> DataFrame:
    """(node, community) of every node; a community is named by its smallest node, a node without edges is its own."""
    key = nodes.columns[0]
    out = _stored(nodes.select(F.col(key).cast("long").alias("node")).distinct().withColumn("c", F.col("node")))
    arcs = _stored(both_ways(edges, weight))
    while True:
        start = arcs.select(F.col("u").alias("node")).distinct().withColumn("c", F.col("node"))
        before = _stored(start)
        after, _ = _local_moving(arcs, before, rounds)
        small = after.groupBy("c").agg(F.min("node").alias("name"))
        named = _stored(after.join(small, "c").select("node", F.col("name").alias("to")))
        if named.where("node <> to").isEmpty():
            return out.select("node", F.col("c").alias("community"))
        out = _stored(out.join(named.select(F.col("node").alias("c"), "to"), "c", "left").select("node", F.coalesce("to", "c").alias("c")))
        a = named.select(F.col("node").alias("u"), F.col("to").alias("tu"))
        b = named.select(F.col("node").alias("v"), F.col("to").alias("tv"))
        arcs = _stored(arcs.join(a, "u").join(b, "v").groupBy(F.col("tu").alias("u"), F.col("tv").alias("v")).agg(F.sum("w").alias("w")))
