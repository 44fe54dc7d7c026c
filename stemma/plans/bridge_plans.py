"""Bridges between theory-like and practice-like documents."""

from __future__ import annotations

from pyspark.sql import functions as F

from stemma.operators import bridges as B
from stemma.operators import graph as G
from stemma.plans import dialect as d
from stemma.plans.registry import Registry
from stemma.plans.vector_plans import cos_sql
from stemma.session import cut_lineage
from stemma.sources import tables as S
from stemma.sources.tables import with_ctes

R = Registry()

THEORY_LISTS = [["Link Analysis"], ["attention", "Entropy"], ["embedding theory"], []]
PRACTICE_LISTS = [["PageRank function", "Vector store"], ["transformer layer"], ["entropy code"]]


def docs(spark, sf_dir):
    """Vectors with scores and a path by label."""
    return S.v3(spark, sf_dir).withColumn("path", F.concat(F.lit("/papers/"), F.col("label").cast("string"), F.lit("/"), F.col("id").cast("string")))


def _lists(values, key):
    return F.element_at(F.array(*[F.array(*[F.lit(v) for v in vs]).cast("array<string>") for vs in values]), (key + 1).cast("int"))


def context(spark, sf_dir):
    v = S.v3(spark, sf_dir)
    i = F.col("id")
    n = S.table(spark, sf_dir, "embeddings").count()
    refs = F.transform(F.sequence(F.lit(1), (i % 3 + 1).cast("int")), lambda j: (i * 7 + j * 13) % n)
    return v.select(
        "id", F.array(F.col("label").cast("long"), i % 7).alias("authors"), F.lit(None).cast("string").alias("venue"), F.array(F.col("label").cast("long"), i % 3 + 10).alias("keywords"),
        refs.alias("references"), _lists(THEORY_LISTS, i % 4).alias("theory_components"), _lists(PRACTICE_LISTS, i % 3).alias("practice_components"), "fid",
        (((i * 41 + 3) % 101) / F.lit(100.0)).alias("abstraction"),
    )


def meta(spark, sf_dir):
    text = S.docs_ann(spark, sf_dir).select(F.col("doc_id").alias("id"), *[c.alias(k) for k, c in B.evidence_flags(F.col("text")).items()])
    return context(spark, sf_dir).join(text, "id", "left")


MIN = 0.004


def bridges(spark, sf_dir, min_strength: float = MIN):
    return B.detect(docs(spark, sf_dir), meta(spark, sf_dir), min_strength)


def strong(spark, sf_dir, min_strength: float = MIN):
    """Bridges before their evidence."""
    return B.strong_pairs(docs(spark, sf_dir), context(spark, sf_dir), min_strength)


def _match_sql(a: str, b: str) -> str:
    x, y = f"lower({a})", f"lower({b})"
    rel = "CASE " + " ".join(
        f"WHEN contains({h}, '{k}') THEN {d.any_word(t, ts)}" for k, ts in B.RELATED_TERMS.items() for h, t in ((x, y), (y, x))
    ) + " ELSE FALSE END"
    return f"(contains({x}, {y}) OR contains({y}, {x}) OR {rel})"


_OV = "CASE WHEN least(len(list_distinct({a})), len(list_distinct({b}))) > 0 THEN len(list_intersect({a}, {b}))::DOUBLE / least(len(list_distinct({a})), len(list_distinct({b}))) ELSE 0 END"
_SQL = f""", n AS (SELECT count(*) AS n FROM embeddings),
 d AS (SELECT v3.*, '/papers/' || label || '/' || id AS path, [label::BIGINT, id%7] AS authors, [label::BIGINT, id%3+10] AS keywords,
  list_transform(range(1, id%3+2), lambda j: (id*7 + j*13) % n) AS refs, ({THEORY_LISTS})[(id%4+1)::INT] AS tc, ({PRACTICE_LISTS})[(id%3+1)::INT] AS pc,
  ((id*41+3)%101)/100.0::DOUBLE AS abstraction, text FROM v3 CROSS JOIN n LEFT JOIN docs_ann ON doc_id = id),
 g AS (SELECT t.id AS theory, p.id AS practice, least(1, {cos_sql('t.w', 'p.w')} + 0.2::DOUBLE * exp(-abs(t.year - p.year) / 2.0::DOUBLE) + 0.1::DOUBLE * least((2 + (t.label = p.label)::INT) / 3.0::DOUBLE, 1)) AS where_sim,
  {cos_sql('t.t', 'p.t')} AS what_sim, ((1 - t.act) * t.clarity * (p.act * p.fid) + {cos_sql('t.c', 'p.c')}) / 2 AS conv_sim,
  least(1, 0.3::DOUBLE * ({_OV.format(a='t.authors', b='p.authors')}) + 0.2::DOUBLE + 0.3::DOUBLE * ({_OV.format(a='t.keywords', b='p.keywords')})
   + CASE WHEN list_contains(p.refs, t.id) THEN 0.5::DOUBLE ELSE 0.2::DOUBLE * ({_OV.format(a='t.refs', b='p.refs')}) END) AS context,
  list_filter([CASE WHEN contains(lower(t.text), 'algorithm') AND {d.any_word('lower(p.text)', ['def ', 'function', 'class '])} THEN 'Algorithm → Implementation' END,
   CASE WHEN {d.any_word('t.text', ['∑', '∏', '∫', 'Σ'])} AND {d.any_word('lower(p.text)', ['compute', 'calculate'])} THEN 'Formula → Computation' END,
   CASE WHEN contains(lower(t.text), 'theorem') AND {d.any_word('lower(p.text)', ['accuracy', 'performance', 'results'])} THEN 'Theory → Benchmark' END,
   CASE WHEN t.abstraction > 0.7 AND p.fid > 0.7 THEN 'Abstract → Concrete' END], lambda x: x IS NOT NULL) AS steps,
  flatten(list_transform(t.tc, lambda a: list_transform(list_filter(p.pc, lambda b: {_match_sql('a', 'b')}), lambda b: a || ' → ' || b))) AS concepts
  FROM d t, d p WHERE t.act < 0.3 AND p.act > 0.7 AND p.fid > 0.6),
 b AS (SELECT *, where_sim*what_sim*conv_sim*pow(context, 1.7) AS strength FROM g WHERE where_sim >= 0.1 AND what_sim >= 0.1 AND conv_sim >= 0.1)
"""


def sql(body: str) -> str:
    return with_ctes(["v3", "docs_ann"], _SQL + body)


_SIMS = ["where_sim", "what_sim", "conv_sim"]


@R.query(
    "bridges",
    sql(f"""SELECT theory, practice, round(where_sim, 6) AS where_sim, round(what_sim, 6) AS what_sim, round(conv_sim, 6) AS conv_sim, round(strength, 6) AS strength,
 round(least(1, strength + least(0.2, len(concepts)*0.05)::DOUBLE + least(0.2, len(steps)*0.05)::DOUBLE), 6) AS confidence FROM b WHERE strength >= {MIN}"""),
)
def bridges_query(spark, sf_dir):
    b = bridges(spark, sf_dir).orderBy(F.desc("strength"), "theory", "practice")
    return b.select("theory", "practice", *[F.round(c, 6).alias(c) for c in _SIMS + ["strength", "confidence"]])


@R.query("bridge_pairs", sql("SELECT theory, practice, round(where_sim, 6) AS where_sim, round(what_sim, 6) AS what_sim, round(conv_sim, 6) AS conv_sim FROM b"))
def bridge_pairs(spark, sf_dir):
    """Every pair that passes the gate, before context."""
    return B.gated_pairs(docs(spark, sf_dir)).select("theory", "practice", *[F.round(c, 6).alias(c) for c in _SIMS])


@R.query("bridge_context", sql(f"SELECT theory, practice, round(context, 6) AS context, round(pow(context, 1.7), 6) AS amplification FROM b WHERE strength >= {MIN}"))
def bridge_context(spark, sf_dir):
    return strong(spark, sf_dir).select("theory", "practice", F.round("context", 6).alias("context"), F.round("amplification", 6).alias("amplification"))


@R.query("bridge_evidence", sql(f"SELECT theory, practice, array_to_string(concepts, '|') AS concepts, array_to_string(steps, '|') AS steps FROM b WHERE strength >= {MIN}"))
def bridge_evidence(spark, sf_dir):
    return bridges(spark, sf_dir).select("theory", "practice", F.array_join("concepts", "|").alias("concepts"), F.array_join("steps", "|").alias("steps"))


@R.query(
    "bridge_graph_nodes",
    sql(f"""SELECT id, CASE WHEN act < 0.3 THEN 'theory' ELSE 'practice' END AS type, id::VARCHAR AS title FROM d WHERE id IN (SELECT theory FROM b WHERE strength >= {MIN} UNION SELECT practice FROM b WHERE strength >= {MIN})"""),
)
def bridge_graph_nodes(spark, sf_dir):
    return B.graph_nodes(strong(spark, sf_dir), docs(spark, sf_dir).withColumn("title", F.lit(None).cast("string")))


@R.query("bridge_chains", sql("SELECT theory::VARCHAR AS path, 0::INT AS n_edges FROM b WHERE FALSE"))
def bridge_chains(spark, sf_dir):
    """Chains over bridges only: always empty, since no practice document is a theory document."""
    b = cut_lineage(strong(spark, sf_dir).select("theory", "practice"))
    e = b.select(F.col("theory").alias("src"), F.col("practice").alias("dst"))
    out = G.simple_paths(b.select("theory").distinct(), b.select("practice").distinct(), e, 4)
    return out.select(F.array_join("path", ">").alias("path"), "n_edges")


@R.query("theory_practice", sql("SELECT count(*) FILTER (act < 0.3) AS n_theory, count(*) FILTER (act > 0.7 AND fid > 0.6) AS n_practice, count(*) FILTER (act < 0.3 AND act > 0.7 AND fid > 0.6) AS n_both FROM v3"))
def theory_practice(spark, sf_dir):
    """Sizes of the two classes; they never meet."""
    t, p = B.is_theory(F.col("act")), B.is_practice(F.col("act"), F.col("fid"))
    return S.v3(spark, sf_dir).agg(F.count_if(t).alias("n_theory"), F.count_if(p).alias("n_practice"), F.count_if(t & p).alias("n_both"))
