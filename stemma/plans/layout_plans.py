"""Force layout over the weighted neighbour graph."""

from __future__ import annotations

from pyspark.sql import functions as F

from stemma.functions import vectors as V
from stemma.operators import layout as L
from stemma.plans.registry import Registry
from stemma.plans.vector_plans import symmetric, weighted_knn, wknn_sql
from stemma.session import cut_lineage
from stemma.sources import tables as S

R = Registry()
DIMS = 64


def start(spark, sf_dir):
    """Known start: the whole embedding at a scale where some nodes are within reach and others beyond, moving backwards through it."""
    v = S.v3(spark, sf_dir)
    return v.select(
        "id", F.transform("e", lambda x: x * 0.75).alias("pos"), F.transform(F.reverse("e"), lambda x: x * 0.1).alias("vel"),
        F.when(F.col("clarity") > 0.3, 0.2).otherwise(0.0).alias("stress"), F.when(F.col("act") < 0.5, -20).otherwise(0).alias("last_move"), (F.col("fid") > L.ANCHOR_FIDELITY).alias("is_anchor"),
    )


def one_step(spark, sf_dir):
    edges = symmetric(weighted_knn(spark, sf_dir))
    return L.step(start(spark, sf_dir), edges, DIMS, 1)


_STEP = """, st AS (SELECT id, list_transform(e, lambda x: x * 0.75::DOUBLE) AS pos, list_transform(list_reverse(e), lambda x: x * 0.1::DOUBLE) AS vel, CASE WHEN clarity > 0.3 THEN 0.2 ELSE 0 END::DOUBLE AS stress,
  CASE WHEN act < 0.5 THEN -20 ELSE 0 END AS last_move, fid > 0.8 AS is_anchor FROM v3),
 ed AS (SELECT src, dst, dist FROM wk UNION SELECT dst, src, dist FROM wk),
 pair AS (SELECT a.id, list_distance(a.pos, b.pos) AS d, a.pos AS p, b.pos AS q FROM st a JOIN st b ON a.id <> b.id WHERE NOT a.is_anchor),
 f AS (SELECT id, i, (p[i]-q[i])/d * (1/(d+0.1::DOUBLE)) * 0.05::DOUBLE AS x FROM pair, range(1, 65) r(i) WHERE d > 0 AND d < 1
  UNION ALL SELECT a.id, i, (b.pos[i]-a.pos[i]) / list_distance(a.pos, b.pos) * dist * 0.1::DOUBLE FROM ed JOIN st a ON a.id = src JOIN st b ON b.id = dst, range(1, 65) r(i) WHERE NOT a.is_anchor AND list_distance(a.pos, b.pos) > 0),
 fs AS (SELECT id, i, sum(x) AS x FROM f GROUP BY 1, 2),
 sc AS (SELECT *, CASE WHEN is_anchor THEN 0 WHEN stress > 0.1 THEN 0.5 WHEN 1 - last_move > 10 THEN 0.1 ELSE 0 END::DOUBLE AS s FROM st),
 nx AS (SELECT sc.id, i, s, stress, sc.last_move, sc.is_anchor, coalesce(x, 0) AS x, CASE WHEN s > 0 THEN vel[i]*0.9::DOUBLE + coalesce(x, 0)*s*0.1::DOUBLE ELSE vel[i] END AS v, pos[i] AS p FROM sc CROSS JOIN range(1, 65) r(i) LEFT JOIN fs USING (id, i)),
 res AS (SELECT id, string_agg(round((CASE WHEN s > 0 THEN p + v ELSE p END)*1e6, 0)::BIGINT::VARCHAR, ',' ORDER BY i) AS pos, round(CASE WHEN any_value(s) > 0 THEN sqrt(sum(x*x)) ELSE any_value(stress) END, 6) AS stress,
  CASE WHEN any_value(s) > 0 THEN 1 ELSE any_value(last_move) END::INT AS last_move, any_value(is_anchor) AS is_anchor FROM nx GROUP BY id)"""


@R.query("layout_step", wknn_sql("SELECT id, pos, stress, last_move, is_anchor FROM res", _STEP))
def layout_step(spark, sf_dir):
    return one_step(spark, sf_dir).select("id", V.micro(F.col("pos")).alias("pos"), F.round("stress", 6).alias("stress"), "last_move", "is_anchor")


@R.query("global_stability", wknn_sql("SELECT round(1.0::DOUBLE / (1 + avg(stress)), 5) AS stability FROM res", _STEP))
def global_stability(spark, sf_dir):
    return L.stability(one_step(spark, sf_dir)).select(F.round("stability", 5).alias("stability"))


@R.query("layout_edges", wknn_sql("SELECT src, dst, round(1 - stress, 6) AS weight, round(abs(a.fid - b.fid), 6) AS conveyance_diff FROM ed JOIN res ON res.id = src JOIN v3 a ON a.id = src JOIN v3 b ON b.id = dst", _STEP))
def layout_edges(spark, sf_dir):
    edges = cut_lineage(symmetric(weighted_knn(spark, sf_dir)))
    state = L.step(start(spark, sf_dir), edges, DIMS, 1)
    out = L.semantic_edges(state, edges, S.v3(spark, sf_dir))
    return out.select("src", "dst", F.round("weight", 6).alias("weight"), F.round("conveyance_diff", 6).alias("conveyance_diff"))


RUN_DIMS, RUN_ROUNDS = 8, 3


def _run_sql() -> str:
    """Hashed start positions and the rounds written out one after the other."""
    unit = lambda tag: f"(('0x' || substr(md5('{tag}|' || id || '|' || k), 1, 13))::BIGINT + 1) / 4503599627370497.0::DOUBLE"
    out = f""",
 ed AS (SELECT src, dst, dist FROM wk UNION SELECT dst, src, dist FROM wk),
 st0 AS MATERIALIZED (SELECT id, list(sqrt(ln({unit(1)}) * -2) * cos({unit(2)} * 6.283185307179586::DOUBLE) * 0.0001::DOUBLE ORDER BY k) AS pos, list_transform(range(0, {RUN_DIMS}), lambda x: 0.0::DOUBLE) AS vel,
  0.2::DOUBLE AS stress, 0 AS last_move, any_value(fid) > 0.8 AS is_anchor FROM v3, range(0, {RUN_DIMS}) r(k) GROUP BY id)"""
    for n in range(RUN_ROUNDS):
        out += f""",
 pair{n} AS (SELECT a.id, list_distance(a.pos, b.pos) AS d, a.pos AS p, b.pos AS q FROM st{n} a JOIN st{n} b ON a.id <> b.id WHERE NOT a.is_anchor),
 f{n} AS (SELECT id, i, (p[i]-q[i])/d * (1/(d+0.1::DOUBLE)) * 0.05::DOUBLE AS x FROM pair{n}, range(1, {RUN_DIMS + 1}) r(i) WHERE d > 0 AND d < 1
  UNION ALL SELECT a.id, i, (b.pos[i]-a.pos[i]) / list_distance(a.pos, b.pos) * dist * 0.1::DOUBLE FROM ed JOIN st{n} a ON a.id = src JOIN st{n} b ON b.id = dst, range(1, {RUN_DIMS + 1}) r(i) WHERE NOT a.is_anchor AND list_distance(a.pos, b.pos) > 0),
 fs{n} AS (SELECT id, i, sum(x) AS x FROM f{n} GROUP BY 1, 2),
 sc{n} AS (SELECT *, CASE WHEN is_anchor THEN 0 WHEN stress > 0.1 THEN 0.5 WHEN {n + 1} - last_move > 10 THEN 0.1 ELSE 0 END::DOUBLE AS s FROM st{n}),
 nx{n} AS (SELECT c.id, i, s, stress, c.last_move, c.is_anchor, coalesce(x, 0) AS x, CASE WHEN s > 0 THEN vel[i]*0.9::DOUBLE + coalesce(x, 0)*s*0.1::DOUBLE ELSE vel[i] END AS v, pos[i] AS p FROM sc{n} c CROSS JOIN range(1, {RUN_DIMS + 1}) r(i) LEFT JOIN fs{n} USING (id, i)),
 st{n + 1} AS MATERIALIZED (SELECT id, list(CASE WHEN s > 0 THEN p + v ELSE p END ORDER BY i) AS pos, list(v ORDER BY i) AS vel, CASE WHEN any_value(s) > 0 THEN sqrt(sum(x*x)) ELSE any_value(stress) END AS stress,
  CASE WHEN any_value(s) > 0 THEN {n + 1} ELSE any_value(last_move) END AS last_move, any_value(is_anchor) AS is_anchor FROM nx{n} GROUP BY id)"""
    return out


@R.query(
    "layout_run",
    wknn_sql(f"SELECT id, array_to_string(list_transform(pos, lambda x: round(x * 1e4, 0)::BIGINT::VARCHAR), ',') AS pos, round(stress, 4) AS stress, last_move::INT AS last_move, is_anchor FROM st{RUN_ROUNDS}", _run_sql()),
)
def layout_run(spark, sf_dir):
    """A few rounds from hashed start positions with stress that lets every free node move."""
    state = L.initial(S.v3(spark, sf_dir), RUN_DIMS).withColumn("stress", F.lit(0.2))
    out = L.run(state, symmetric(weighted_knn(spark, sf_dir)), RUN_DIMS, RUN_ROUNDS)
    told = F.array_join(F.transform("pos", lambda x: F.round(x * 1e4, 0).cast("long").cast("string")), ",")
    return out.select("id", told.alias("pos"), F.round("stress", 4).alias("stress"), "last_move", "is_anchor")
