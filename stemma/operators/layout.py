"""Force layout of documents: neighbours attract, everything within distance one repels.

State is a table (id, pos, vel, stress, last_move, is_anchor) next to an edge table (src, dst, dist).
All nodes of a step read the positions of the step before, so a step is one parallel plan; the state is
written to the checkpoint folder between steps.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from stemma.functions import vectors as V
from stemma.operators.simjoin import Limits, metric_join, nearest
from stemma.session import cut_lineage

# Strengths, damping and thresholds of the movement rules.
ATTRACTION = 0.1
REPULSION = 0.05
SOFTENING = 0.1
REACH = 1.0
MOMENTUM = 0.9
LEARNING_RATE = 0.1
ANCHOR_FIDELITY = 0.8
INITIAL_SPREAD = 0.0001
CLOSE_TOGETHER = 65_536
CELLS_TOGETHER = 262_144

Policy = Callable[[Column, Column, Column], Column]


def fixed_policy(stress: Column, last_move: Column, iteration: Column) -> Column:
    """Scale of a move: .5 under stress, .1 after ten idle rounds, else none."""
    return F.when(stress > 0.1, 0.5).when(iteration - last_move > 10, 0.1).otherwise(F.lit(0.0))


def initial(nodes: DataFrame, dims: int, iteration: int = 0) -> DataFrame:
    """Start state of (id, fid): normal positions from a hash of id and dimension, so reruns and lost tasks agree."""
    def unit_hash(tag: int):
        h = lambda k: F.md5(F.concat_ws("|", F.lit(str(tag)), F.col("id").cast("string"), k.cast("string")).cast("binary"))
        return lambda k: (F.conv(F.substring(h(k), 1, 13), 16, 10).cast("long") + 1) / F.lit(float((1 << 52) + 1))

    u, w = unit_hash(1), unit_hash(2)
    normal = F.transform(
        F.sequence(F.lit(0), F.lit(dims - 1)), lambda k: F.sqrt(F.log(u(k)) * -2.0) * F.cos(w(k) * float(2 * np.pi)) * INITIAL_SPREAD
    )
    return nodes.select(
        "id", normal.alias("pos"), F.array_repeat(F.lit(0.0), dims).alias("vel"), F.lit(0.0).alias("stress"), F.lit(iteration).alias("last_move"),
        (F.col("fid") > ANCHOR_FIDELITY).alias("is_anchor"),
    )


def vector_sum(df: DataFrame, key: str, v: str, dims: int) -> DataFrame:
    """Component-wise sum per key with map-side folding; long vectors are summed in rows instead of columns."""
    if dims <= 64:
        g = df.groupBy(key).agg(*[F.sum(F.get(v, F.lit(i))).alias(f"_{i}") for i in range(dims)])
        return g.select(key, F.array(*[f"_{i}" for i in range(dims)]).alias(v))
    g = df.select(key, F.posexplode(v).alias("_i", "_x")).groupBy(key, "_i").agg(F.sum("_x").alias("_x"))
    packed = g.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("_i", "_x"))).alias("_p"))  # dims entries
    return packed.select(key, F.transform("_p", lambda p: p["_x"]).alias(v))


def attraction(state: DataFrame, edges: DataFrame) -> DataFrame:
    """Unit direction to each neighbour times its document distance."""
    a = state.where("NOT is_anchor").select(F.col("id").alias("src"), F.col("pos").alias("p"))
    b = state.select(F.col("id").alias("dst"), F.col("pos").alias("q"))
    j = edges.select("src", "dst", "dist").join(a, "src").join(b, "dst")
    away = F.zip_with("q", "p", lambda x, y: x - y)
    pull = V.let(V.unit(away), lambda u: F.transform(u, lambda x: x * F.col("dist") * ATTRACTION))
    return j.select(F.col("src").alias("id"), pull.alias("force"))


def _repel(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
    p, q = V.matrix(a["v"]), V.matrix(b["v"])
    centre = q.mean(0)
    p, q = p - centre, q - centre
    ids, others = a["id"].to_numpy(), b["id"].to_numpy()
    sq = (q * q).sum(1)
    scale = max((p * p).sum(1).max(), sq.max(), 1e-300)
    step = max(8, CELLS_TOGETHER // len(q))
    force = [np.zeros((0, q.shape[1]))] + [_pushed(p[lo : lo + step], q, sq, ids[lo : lo + step], others, scale) for lo in range(0, len(p), step)]
    return pd.DataFrame({"id": ids, "force": list(np.concatenate(force))})


def _pushed(p: np.ndarray, q: np.ndarray, sq: np.ndarray, ids: np.ndarray, others: np.ndarray, scale: float) -> np.ndarray:
    """Force on each of a few nodes; their squares against all others stay in the cache."""
    d2 = p @ (-2.0 * q.T)
    d2 += (p * p).sum(1)[:, None]
    d2 += sq[None, :]
    np.maximum(d2, 0.0, out=d2)
    near = np.flatnonzero(d2 <= 1e-8 * scale)
    d2.ravel()[near] = 4.0 * REACH * REACH  # the node itself, and those taken below
    d = np.sqrt(d2, out=d2)
    reached = d < REACH
    d *= d + SOFTENING
    w = np.where(reached, REPULSION, 0.0)
    w /= d
    force = p * w.sum(1)[:, None] - w @ q
    rows, cols = np.divmod(near, len(q))
    other = ids[rows] != others[cols]
    rows, cols = rows[other], cols[other]
    for at in range(0, len(rows), CLOSE_TOGETHER):  # too near for the expanded square: take the differences themselves
        i = rows[at : at + CLOSE_TOGETHER]
        diff = p[i] - q[cols[at : at + CLOSE_TOGETHER]]
        n = np.sqrt((diff * diff).sum(1))
        ok = (n > 0) & (n < REACH)
        np.add.at(force, i[ok], diff[ok] * (REPULSION / (n[ok] * (n[ok] + SOFTENING)))[:, None])
    return force


def repulsion(state: DataFrame, limits: Limits = Limits()) -> DataFrame:
    """Push from every node within reach, summed per block of nodes before anything is shuffled."""
    members = state.select("id", F.col("pos").alias("v"))
    probes = state.where("NOT is_anchor").select("id", F.col("pos").alias("v"), F.lit(REACH).alias("tau"))
    schema = T.StructType([state.schema["id"], T.StructField("force", T.ArrayType(T.DoubleType()))])
    return metric_join(probes, members, _repel, schema, "euclid", limits, few=True)


def step(state: DataFrame, edges: DataFrame, dims: int, iteration: int, policy: Policy = fixed_policy, limits: Limits = Limits()) -> DataFrame:
    """One round: forces, velocity with momentum, position, stress. Anchors and resting nodes stay."""
    forces = vector_sum(attraction(state, edges).unionByName(repulsion(state, limits)), "id", "force", dims)
    j = state.join(forces, "id", "left").withColumn("force", F.coalesce("force", F.array_repeat(F.lit(0.0), dims)))
    scale = F.when(F.col("is_anchor"), F.lit(0.0)).otherwise(policy(F.col("stress"), F.col("last_move"), F.lit(iteration)))
    j = j.withColumn("_s", scale)
    moves = F.col("_s") > 0
    vel = F.when(moves, F.zip_with("vel", "force", lambda v, f: v * MOMENTUM + f * F.col("_s") * LEARNING_RATE)).otherwise(F.col("vel"))
    j = j.withColumn("vel", vel)
    return j.select(
        "id", F.when(moves, F.zip_with("pos", "vel", lambda p, v: p + v)).otherwise(F.col("pos")).alias("pos"), "vel",
        F.when(moves, V.norm(F.col("force"))).otherwise(F.col("stress")).alias("stress"),
        F.when(moves, F.lit(iteration)).otherwise(F.col("last_move")).alias("last_move"), "is_anchor",
    )


def run(state: DataFrame, edges: DataFrame, dims: int, iterations: int, policy: Policy = fixed_policy, limits: Limits = Limits()) -> DataFrame:
    edges = cut_lineage(edges)
    for it in range(1, iterations + 1):
        state = cut_lineage(step(state, edges, dims, it, policy, limits))
    return state


def stability(state: DataFrame) -> DataFrame:
    """1 / (1 + mean stress); one for an empty layout."""
    return state.agg((F.lit(1.0) / (F.lit(1.0) + F.coalesce(F.avg("stress"), F.lit(0.0)))).alias("stability"))


def add_nodes(state: DataFrame, edges: DataFrame, new_state: DataFrame, probes: DataFrame, members: DataFrame, k: int, distance, tau_of, limits: Limits = Limits()):
    """Insert documents: their k nearest among all documents become neighbours in both directions."""
    found = nearest(probes, members, k, distance, tau_of, limits)
    back = found.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "dist")
    return state.unionByName(new_state), edges.unionByName(found).unionByName(back).dropDuplicates(["src", "dst"])


def remove_nodes(state: DataFrame, edges: DataFrame, gone: DataFrame):
    """Drop documents and every edge at them."""
    left = edges.join(gone.select(F.col("id").alias("src")), "src", "left_anti").join(gone.select(F.col("id").alias("dst")), "dst", "left_anti")
    return state.join(gone.select("id"), "id", "left_anti"), left


def semantic_edges(state: DataFrame, edges: DataFrame, fidelity: DataFrame) -> DataFrame:
    """Neighbour edges weighted by 1 - stress of the source, with the fidelity gap."""
    a = fidelity.select(F.col("id").alias("src"), F.col("fid").alias("fa"))
    b = fidelity.select(F.col("id").alias("dst"), F.col("fid").alias("fb"))
    s = state.select(F.col("id").alias("src"), "stress")
    j = edges.join(s, "src").join(a, "src").join(b, "dst")
    return j.select("src", "dst", (F.lit(1.0) - F.col("stress")).alias("weight"), F.abs(F.col("fa") - F.col("fb")).alias("conveyance_diff"))
