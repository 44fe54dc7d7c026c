"""A neighbour graph that follows inserts and removals of nodes.

Nodes with equal properties are one group: members only belong to it, and lists are kept between groups,
so a third of all nodes being copies costs no more than one node. A list holds the `k` nearest groups of a
group; equal distances go to the smaller group name.

An insert touches only what it can change. New groups search all groups; an old group keeps its list
unless a new group lies within the distance of its last neighbour, which is a metric join with a radius
per old group (a reverse nearest-neighbour join). A removal refills the lists that named a group which
has no member left. The graph equals one built at once from the nodes that remain.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from stemma.operators.simjoin import Limits, metric_join, nearest
from stemma.session import cut_lineage

HOT_ROWS = 100_000


@dataclass(frozen=True)
class Measure:
    """A distance of node properties, and the largest angle of `v` at which a pair can still have a distance."""

    distance: Callable[[pd.DataFrame, pd.DataFrame], np.ndarray]
    tau: Callable[[np.ndarray], np.ndarray]


@dataclass(frozen=True)
class Graph:
    """members: (id, name); groups: (id = name, v and what the distance reads); lists: (src, dst, dist) of names."""

    members: DataFrame
    groups: DataFrame
    lists: DataFrame
    k: int
    measure: Measure
    limits: Limits = Limits()


def _named(nodes: DataFrame) -> DataFrame:
    """Nodes with the digest of all they hold beside the id."""
    rest = [c for c in nodes.columns if c != "id"]
    return nodes.withColumn("name", F.sha2(F.to_json(F.struct(*rest)), 256))


def _top(lists: DataFrame, k: int) -> DataFrame:
    w = Window.partitionBy("src").orderBy("dist", "dst")
    return lists.withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= k).drop("_r")


def _groups(named: DataFrame) -> DataFrame:
    return named.drop("id").dropDuplicates(["name"]).withColumnRenamed("name", "id")


def build(nodes: DataFrame, k: int, measure: Measure, limits: Limits = Limits()) -> Graph:
    """The graph of `nodes`: id, v (unit vectors) and whatever the distance reads; ids are unique."""
    named = cut_lineage(_named(nodes))
    groups = cut_lineage(_groups(named))
    lists = cut_lineage(nearest(groups, groups, k, measure.distance, measure.tau, limits))
    return Graph(named.select("id", "name"), groups, lists, k, measure, limits)


def _within(g: Graph, new: DataFrame) -> DataFrame:
    """(src, dst, dist): new groups that are at most as far from an old group as its last neighbour."""
    k, distance, tau_of = g.k, g.measure.distance, g.measure.tau
    last = g.lists.groupBy(F.col("src").alias("id")).agg(F.max("dist").alias("d"), F.count("*").alias("n"))
    old = g.groups.join(last, "id", "left").withColumn("reach", F.when(F.col("n") >= k, F.col("d")).otherwise(F.lit(float("inf")))).drop("d", "n")
    schema = T.StructType([*old.schema.fields, T.StructField("tau", T.DoubleType())])

    def angle(batches):
        for pdf in batches:
            r = pdf["reach"].to_numpy()
            full = np.isfinite(r)
            yield pdf.assign(tau=np.where(full, tau_of(np.where(full, r, 0.0)), np.pi))

    def kernel(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        d = distance(a, b)
        src, dst = np.nonzero(d <= a["reach"].to_numpy()[:, None])
        out = pd.DataFrame({"src": a["id"].to_numpy()[src], "dst": b["id"].to_numpy()[dst], "dist": d[src, dst]})
        return out.sort_values(["dist", "dst"]).groupby("src", sort=False).head(k)  # no list takes more of one block

    return metric_join(old.mapInPandas(angle, schema), new, kernel, g.lists.schema, "angle", g.limits, few=True)


def insert(g: Graph, nodes: DataFrame) -> Graph:
    """The graph with further nodes; their ids are not in the graph yet."""
    named = cut_lineage(_named(nodes))
    members = cut_lineage(g.members.unionByName(named.select("id", "name")))
    new = cut_lineage(_groups(named).join(g.groups.select("id"), "id", "left_anti"))
    if new.isEmpty():
        return Graph(members, g.groups, g.lists, g.k, g.measure, g.limits)
    groups = cut_lineage(g.groups.unionByName(new))
    own = nearest(new, groups, g.k, g.measure.distance, g.measure.tau, g.limits)
    hits = cut_lineage(_within(g, new))
    touched = hits.select("src").distinct()
    kept = g.lists.join(touched, "src", "left_anti")
    mended = _top(g.lists.join(touched, "src", "left_semi").unionByName(hits), g.k)
    return Graph(members, groups, cut_lineage(kept.unionByName(mended).unionByName(own)), g.k, g.measure, g.limits)


def remove(g: Graph, ids: DataFrame) -> Graph:
    """The graph without the nodes of `ids` (id)."""
    members = cut_lineage(g.members.join(ids.select("id"), "id", "left_anti"))
    left = members.select(F.col("name").alias("id")).distinct()
    groups = cut_lineage(g.groups.join(left, "id", "left_semi"))
    gone = g.groups.select("id").join(left, "id", "left_anti").select(F.col("id").alias("dst"))
    stay = cut_lineage(g.lists.join(groups.select(F.col("id").alias("src")), "src", "left_semi"))
    broken = cut_lineage(stay.join(gone, "dst", "left_semi").select("src").distinct())
    if broken.isEmpty():
        return Graph(members, groups, stay, g.k, g.measure, g.limits)
    probes = groups.join(broken.select(F.col("src").alias("id")), "id", "left_semi")
    again = nearest(probes, groups, g.k, g.measure.distance, g.measure.tau, g.limits)
    return Graph(members, groups, cut_lineage(stay.join(broken, "src", "left_anti").unionByName(again)), g.k, g.measure, g.limits)


def edges(g: Graph) -> DataFrame:
    """(src, dst, dist) of nodes: the k nearest nodes of every node, copies of itself included, ties to the smaller id.

    A group offers its k + 1 smallest ids, all that any list can need. Members of large groups are dealt
    over several tasks.
    """
    k, distance = g.k, g.measure.distance
    first = Window.partitionBy("name").orderBy("id")
    offered = cut_lineage(g.members.withColumn("_r", F.row_number().over(first)).where(F.col("_r") <= k + 1).drop("_r"))
    own_schema = "src string, dst string, dist double"

    def self_distance(batches):
        for pdf in batches:
            for lo in range(0, len(pdf), 64):
                part = pdf.iloc[lo : lo + 64]
                name = part["id"].to_numpy()
                yield pd.DataFrame({"src": name, "dst": name, "dist": np.diag(distance(part, part))})

    lists = g.lists.unionByName(g.groups.mapInPandas(self_distance, own_schema))
    near = lists.join(offered.select(F.col("name").alias("dst"), "id"), "dst").select("src", F.col("id").alias("dst"), "dist")
    near = cut_lineage(_top(near, k + 1).groupBy("src").agg(F.array_sort(F.collect_list(F.struct("dist", "dst"))).alias("near")))
    parts = cut_lineage(g.members.groupBy("name").agg(F.ceil(F.count("*") / HOT_ROWS).cast("int").alias("parts")))
    dealt = near.join(parts.withColumnRenamed("name", "src"), "src").withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    hot = parts.where("parts > 1")  # at most one per HOT_ROWS members
    few = hot.count() <= 10_000
    rows = g.members.join(F.broadcast(hot) if few else hot, "name", "left")
    rows = rows.withColumn("part", F.pmod(F.xxhash64("id"), F.coalesce("parts", F.lit(1))).cast("int")).drop("parts")
    own = rows.join(dealt.select(F.col("src").alias("name"), "part", "near"), ["name", "part"])
    left = F.slice(F.filter("near", lambda x: x["dst"] != F.col("id")), 1, k)
    return own.select(F.col("id").alias("src"), F.explode(left).alias("e")).select("src", "e.dst", "e.dist")
