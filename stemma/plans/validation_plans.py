"""Validation of scores over labelled documents."""

from __future__ import annotations

from pyspark.sql import functions as F

from stemma.functions import text as X
from stemma.functions import validation as VA
from stemma.plans import dialect as d
from stemma.plans.registry import Registry
from stemma.sources import tables as S
from stemma.sources.tables import with_ctes

R = Registry()


def analyses(spark, sf_dir):
    """One analysis per label: scores by quality and length, components found in the text, short or long reasoning."""
    lab = S.table(spark, sf_dir, "labels")
    docs = S.docs_ann(spark, sf_dir).select("doc_id", "text")
    low = F.lower("text")
    i = F.col("doc_id")
    a = docs.join(lab, "doc_id").withColumns(
        {
            "implementation_fidelity": F.col("quality") * 0.6 + (i % 7) * 0.1,
            "actionability": (i % 11) * 0.1,
            "bridge_potential": F.col("toxic") * 0.3 + (i % 5) * 0.2,
            "theory_components": F.array_compact(F.array(F.when(F.contains(low, F.lit("entropy")), F.lit("entropy")))),
            "practice_components": F.array_compact(F.array(F.when(F.contains(low, F.lit("algorithm")), F.lit("algorithms")))),
            "reasoning": F.when(F.col("quality") == 1, F.lit("The scores follow from the numbered steps and the code of the text.")).otherwise(F.lit("short")),
        }
    )
    return VA.validate(a)


_A = f""", a AS (SELECT doc_id, lower(text) AS low, quality*0.6::DOUBLE + (doc_id%7)*0.1::DOUBLE AS f, (doc_id%11)*0.1::DOUBLE AS a, toxic*0.3::DOUBLE + (doc_id%5)*0.2::DOUBLE AS b,
  contains(lower(text), 'entropy')::INT AS t, contains(lower(text), 'algorithm')::INT AS p, quality = 1 AS long FROM labels JOIN docs_ann USING (doc_id)),
 i AS (SELECT *, list_filter([CASE WHEN f < 0 OR f > 1 THEN 'implementation_fidelity out of bounds: ' || f END, CASE WHEN a < 0 OR a > 1 THEN 'actionability out of bounds: ' || a END,
  CASE WHEN b < 0 OR b > 1 THEN 'bridge_potential out of bounds: ' || b END,
  CASE WHEN f > 0.7 AND a < 0.3 THEN printf('Inconsistent: high implementation_fidelity (%.2f) but low actionability (%.2f)', f, a) END,
  CASE WHEN b > 0.6 AND (t = 0 OR p = 0) THEN printf('High bridge_potential (%.2f) but missing theory (%d) or practice (%d) components', b, t, p) END,
  CASE WHEN NOT long THEN 'Reasoning too brief for academic standards' END], lambda x: x IS NOT NULL) AS issues,
  (f > 0.7 AND a < 0.3)::INT + (b > 0.6 AND (t = 0 OR p = 0))::INT + (t = 0 AND contains(low, 'theory'))::INT + (p = 0 AND {d.any_word('low', VA.PRACTICE_WORDS)})::INT + (NOT long)::INT AS n_suggestions FROM a),
 v AS (SELECT *, greatest(0, least(1, 1 - len(issues)*0.1::DOUBLE - abs(f - least(1, {d.count_words('low', VA.IMPLEMENTATION_WORDS)}/5.0::DOUBLE))*0.2::DOUBLE)) AS consistency FROM i)
"""


def sql(body: str) -> str:
    return with_ctes(["docs_ann"], _A + body)


_STRIP_NUM = "regexp_replace({}, '[0-9.]{{6,}}$', '')"


@R.query("validate", sql("SELECT doc_id, len(issues)::INT AS n_issues, n_suggestions, round(consistency, 6) AS consistency_score, len(issues) = 0 AND round(consistency, 9) > 0.7 AS is_valid FROM v"))
def validate(spark, sf_dir):
    v = analyses(spark, sf_dir)
    valid = (F.size("issues") == 0) & (F.round("consistency_score", 9) > 0.7)
    return v.select("doc_id", F.size("issues").alias("n_issues"), F.size("suggestions").alias("n_suggestions"), F.round("consistency_score", 6).alias("consistency_score"), valid.alias("is_valid"))


@R.query(
    "validation_summary",
    sql("""SELECT count(*) AS total_validated, count(*) FILTER (len(issues) = 0 AND consistency > 0.7) AS valid_count, round(count(*) FILTER (len(issues) = 0 AND consistency > 0.7) / count(*)::DOUBLE, 6) AS validity_rate,
 round(avg(consistency), 6) AS avg_consistency_score FROM v"""),
)
def validation_summary(spark, sf_dir):
    s = VA.batch_summary(analyses(spark, sf_dir))
    return s.select("total_validated", "valid_count", F.round("validity_rate", 6).alias("validity_rate"), F.round("avg_consistency_score", 6).alias("avg_consistency_score"))


@R.query("issue_freq", sql("SELECT string_split(x, ':')[1] AS issue_type, count(*) AS n FROM (SELECT unnest(issues) AS x FROM v) GROUP BY 1"))
def issue_freq(spark, sf_dir):
    return VA.issue_types(analyses(spark, sf_dir))


@R.query("common_issues", sql("SELECT x AS issue, count(*) AS n FROM (SELECT regexp_replace(unnest(issues), 'bounds: ([0-9.-]+)$', 'bounds') AS x FROM v) GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 10"))
def common_issues(spark, sf_dir):
    """Ten most frequent issues; an out-of-range value counts by its score, not by the digits it has."""
    v = analyses(spark, sf_dir).withColumn("issues", F.transform("issues", lambda x: F.regexp_replace(x, "bounds: ([0-9.E-]+)$", "bounds")))
    return VA.common_issues(v)


@R.query(
    "score_distribution",
    sql("""SELECT score, round(avg(value), 6) AS mean, round(stddev_pop(value), 6) AS std, round(min(value), 6) AS low, round(max(value), 6) AS high FROM
 (SELECT 'implementation_fidelity' AS score, f AS value FROM v UNION ALL SELECT 'actionability', a FROM v UNION ALL SELECT 'bridge_potential', b FROM v) GROUP BY 1"""),
)
def score_distribution(spark, sf_dir):
    s = VA.score_distribution(analyses(spark, sf_dir))
    return s.select("score", *[F.round(c, 6).alias(c) for c in ("mean", "std", "low", "high")])


def ratings(spark, sf_dir):
    """Two score triples per labelled document."""
    i, lab = F.col("doc_id"), S.table(spark, sf_dir, "labels")
    trip = lambda k, m: F.struct(*[(((i * (k + n) + F.col("quality") * m) % 97) / 97.0).alias(s) for n, s in enumerate(X.MAIN_SCORES)])
    return lab.select("doc_id", trip(31, 0).alias("m1"), trip(31, 5).alias("m2"))


_RAT = """WITH r AS (SELECT doc_id, ((doc_id*31)%97)/97.0::DOUBLE AS x1, ((doc_id*32)%97)/97.0::DOUBLE AS x2, ((doc_id*33)%97)/97.0::DOUBLE AS x3,
 ((doc_id*31+quality*5)%97)/97.0::DOUBLE AS y1, ((doc_id*32+quality*5)%97)/97.0::DOUBLE AS y2, ((doc_id*33+quality*5)%97)/97.0::DOUBLE AS y3 FROM labels),
 l AS (SELECT doc_id, unnest([x1, x2, x3]) AS x, unnest([y1, y2, y3]) AS y FROM r)"""


@R.query(
    "inter_rater",
    _RAT + """ SELECT doc_id, CASE WHEN max(x) > min(x) AND max(y) > min(y) THEN round(corr(x, y), 6) END AS correlation, round(avg(abs(x - y)), 6) AS mean_absolute_difference FROM l GROUP BY 1""",
)
def inter_rater(spark, sf_dir):
    c = VA.pairwise_agreement("m1", "m2")
    return ratings(spark, sf_dir).select("doc_id", *[F.round(c[k], 6).alias(k) for k in ("correlation", "mean_absolute_difference")])


@R.query("kappa", _RAT + " SELECT count(*) AS total, round((count(*) FILTER (abs(x - y) <= 0.1) / count(*)::DOUBLE - 0.1::DOUBLE) / 0.9::DOUBLE, 6) AS kappa FROM l")
def kappa(spark, sf_dir):
    c = VA.pairwise_agreement("m1", "m2")
    diffs = ratings(spark, sf_dir).select(*[c[f"diff_{k}"].alias(f"diff_{k}") for k in X.MAIN_SCORES])
    k = VA.kappa(diffs)
    return k.select("total", F.round("kappa", 6).alias("kappa"))


@R.query(
    "metric_scores",
    """WITH s AS (SELECT vec_id AS id, ((vec_id*37)%101)/100.0::DOUBLE AS f, ((vec_id*53+17)%101)/100.0::DOUBLE AS a, ((vec_id*29+7)%101)/100.0::DOUBLE AS b FROM embeddings)
 SELECT id, round(least(CASE WHEN b > 0.8 THEN f*a*b*1.5::DOUBLE ELSE f*a*b END, 1), 6) AS bridge_metric, round(0.7::DOUBLE + least(10*((f-(f+a+b)/3)*(f-(f+a+b)/3) + (a-(f+a+b)/3)*(a-(f+a+b)/3) + (b-(f+a+b)/3)*(b-(f+a+b)/3))/3, 1)*0.3::DOUBLE, 6) AS spread_metric,
 CASE WHEN id < 50 OR a < 0.3 THEN 'bootstrap' WHEN id < 200 OR a < 0.6 THEN 'random_search' ELSE 'mipro' END AS optimizer FROM s""",
)
def metric_scores(spark, sf_dir):
    f, a, b = F.col("act"), F.col("fid"), F.col("clarity")
    budget = F.when(a < 0.3, "low").when(a < 0.6, "medium").otherwise("high")
    return S.v3(spark, sf_dir).select(
        "id", F.round(VA.bridge_metric(f, a, b), 6).alias("bridge_metric"), F.round(VA.spread_metric(f, a, b), 6).alias("spread_metric"), VA.optimizer(F.col("id"), budget).alias("optimizer")
    )


@R.query(
    "metadata_metric",
    """SELECT conv_id, round(least(count(DISTINCT role)/5.0::DOUBLE, 1)*0.25 + CASE WHEN min(role) = 'assistant' THEN 0.25 ELSE 0 END + least(count(DISTINCT turn)/3.0::DOUBLE, 1)*0.25
 + least(count(DISTINCT turn)/10.0::DOUBLE, 1)*0.25, 6) AS score FROM conversations GROUP BY 1""",
)
def metadata_metric(spark, sf_dir):
    """Richness of conversation metadata: roles as domains, turns as prerequisites and concepts."""
    c = S.table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.collect_set("role").alias("roles"), F.countDistinct("turn").alias("n"), F.min("role").alias("first"))
    turns = F.sequence(F.lit(1), F.least(F.col("n"), F.lit(10)).cast("int"))  # no share counts more than ten
    level = F.array(F.when(F.col("first") == "assistant", "advanced").otherwise("other"))
    return c.select("conv_id", F.round(VA.metadata_metric(F.col("roles"), level, turns, turns), 6).alias("score"))
