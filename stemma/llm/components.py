"""Connected components of an edge table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stemma.session import cut_lineage


def _mins(edges: DataFrame) -> DataFrame:
    return edges.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.select("u", "v").unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    return both.join(_mins(both), "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))


def _small_star(edges: DataFrame) -> DataFrame:
    mins = _mins(edges)
    return edges.join(mins, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(mins.select("u", F.col("m").alias("v")))


def connected(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, root) of every node with an edge to another; root is the smallest node it can reach.

    Large-star and small-star rounds alternate until nothing changes. Minima are aggregates with partial
    sums and are joined back, so a node with very many edges is not gathered in one task.
    """
    u, v = F.greatest(a, b), F.least(a, b)
    edges = cut_lineage(edges.select(u.alias("u"), v.alias("v")).where("u <> v").distinct())
    before = None
    while True:
        mark = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if mark == before:
            return edges.select(F.col("u").alias("node"), F.col("v").alias("root"))
        before = mark
        edges = cut_lineage(_small_star(_large_star(edges).distinct()).where("u <> v").distinct())
