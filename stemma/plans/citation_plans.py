"""Citation contexts and their semantics over the document graph."""

from __future__ import annotations

from pyspark.sql import functions as F

from stemma.functions import citation as C
from stemma.functions import text as X
from stemma.functions import vectors as V
from stemma.operators import citations as O
from stemma.operators import embedding as EM
from stemma.plans import dialect as d
from stemma.plans.registry import Registry
from stemma.plans.vector_plans import cos_sql
from stemma.sources import tables as S
from stemma.sources.tables import with_ctes

R = Registry()


def marks(spark, sf_dir):
    return S.cites(spark, sf_dir).select(F.col("src").alias("citing"), F.col("dst").alias("cited"), F.concat(F.lit("["), F.col("dst").cast("string"), F.lit("]")).alias("mark"))


def contexts(spark, sf_dir):
    return O.contexts(S.docs_ann(spark, sf_dir), "doc_id", "text", marks(spark, sf_dir))


def with_similarity(spark, sf_dir, df, a="citing", b="cited"):
    """Cosine of the stored vectors of the two ends; vector ids repeat over the documents."""
    v = S.vectors(spark, sf_dir).select("vec_id", V.unit(F.col("e")).alias("e"))
    n = S.table(spark, sf_dir, "embeddings").count()
    left, right = v.select(F.col("vec_id").alias("_a"), F.col("e").alias("_x")), v.select(F.col("vec_id").alias("_b"), F.col("e").alias("_y"))
    j = df.withColumns({"_a": F.col(a) % n, "_b": F.col(b) % n}).join(left, "_a").join(right, "_b")
    return j.withColumn("similarity", V.dot(F.col("_x"), F.col("_y"))).drop("_a", "_b", "_x", "_y")


def scored_contexts(spark, sf_dir):
    return with_similarity(spark, sf_dir, contexts(spark, sf_dir)).withColumn("influence", C.influence(F.col("similarity")))


def _type_sql(low: str) -> str:
    return "CASE " + " ".join(f"WHEN {d.any_match(low, ps)} THEN '{t}'" for t, ps in reversed(C.TYPE_PATTERNS.items())) + " ELSE '' END"


def _features_sql(text: str, before: str) -> str:
    low = f"lower({text})"
    section = "CASE " + " ".join(f"WHEN {d.any_word(f'lower({before})', ws)} THEN '{s}'" for s, ws in C.SECTION_WORDS.items()) + " ELSE 'other' END"
    return f"""{_type_sql(low)} AS citation_type, {d.any_word(low, C.VERBS['high'])} AS high_verb, {d.any_word(low, C.VERBS['medium'])} AS medium_verb,
 {d.count_words(low, [v for t in C.VERBS.values() for v in t])} AS n_verbs, {d.any_word(low, C.METHOD_WORDS)} AS is_methodological,
 {d.any_word(low, C.FOUNDATION_WORDS)} AS is_foundational, {section} AS section_type"""


def _weight_sql(col: str, table: dict, default: float) -> str:
    return f"CASE {col} " + " ".join(f"WHEN '{k}' THEN {v}" for k, v in table.items()) + f" ELSE {default} END::DOUBLE"


def _influence_sql(sim: str) -> str:
    return f"""least(1, ({sim}*0.4::DOUBLE + {_weight_sql('citation_type', C.TYPE_WEIGHTS, 0.1)}*0.3::DOUBLE + CASE WHEN high_verb THEN 0.2 WHEN medium_verb THEN 0.1 ELSE 0 END::DOUBLE
 + CASE WHEN is_methodological THEN 0.1 ELSE 0 END::DOUBLE + CASE WHEN is_foundational THEN 0.15 ELSE 0 END::DOUBLE) * {_weight_sql('section_type', C.SECTION_WEIGHTS, 0.5)})"""


_CTX = f""", para AS (SELECT doc_id AS citing, dst AS cited, '[' || dst || ']' AS mark, string_split(text, chr(10)||chr(10)) AS ps FROM docs_ann JOIN cites ON src = doc_id),
 hit AS (SELECT *, unnest(range(1, len(ps)+1)) AS i FROM para),
 ctx0 AS (SELECT citing, cited, (i-1)::INT AS paragraph, coalesce({d.strip("list_filter(regexp_split_to_array(ps[i], '[.!?]+'), lambda s: contains(s, mark))[1]")}, '') AS citation_text,
  CASE WHEN i > 1 THEN ps[i-1] ELSE '' END AS context_before, coalesce(ps[i+1], '') AS context_after FROM hit WHERE contains(ps[i], mark)),
 ctx AS (SELECT *, {_features_sql('citation_text', 'context_before')} FROM ctx0),
 sim AS (SELECT c.*, {cos_sql('a.e', 'b.e')} AS similarity FROM ctx c JOIN vecs a ON a.vec_id = c.citing % (SELECT count(*) FROM embeddings) JOIN vecs b ON b.vec_id = c.cited % (SELECT count(*) FROM embeddings)),
 inf AS (SELECT *, {_influence_sql('similarity')} AS influence FROM sim)
"""


def sql(body: str) -> str:
    return with_ctes(["vecs", "docs_ann", "cites"], _CTX + body)


@R.query("citation_contexts", sql("SELECT citing, cited, paragraph, citation_text, md5(context_before) AS before_digest, md5(context_after) AS after_digest, citation_type, section_type FROM ctx"))
def citation_contexts(spark, sf_dir):
    return contexts(spark, sf_dir).select(
        "citing", "cited", "paragraph", "citation_text", F.md5("context_before").alias("before_digest"), F.md5("context_after").alias("after_digest"), "citation_type", "section_type"
    )


@R.query("citation_types", with_ctes(["docs_ann"], f"SELECT doc_id, citation_type, high_verb, medium_verb, n_verbs, is_methodological, is_foundational, section_type FROM (SELECT doc_id, {_features_sql('text', 'text')} FROM docs_ann)"))
def citation_types(spark, sf_dir):
    """Features of every whole text read as one citation sentence."""
    f = C.with_features(S.docs_ann(spark, sf_dir), "text", "text")
    return f.select("doc_id", "citation_type", "high_verb", "medium_verb", F.size("action_verbs").alias("n_verbs"), "is_methodological", "is_foundational", "section_type")


@R.query("influence", sql("SELECT citing, cited, paragraph, round(similarity, 6) AS similarity, round(influence, 6) AS influence FROM inf"))
def influence(spark, sf_dir):
    return scored_contexts(spark, sf_dir).select("citing", "cited", "paragraph", F.round("similarity", 6).alias("similarity"), F.round("influence", 6).alias("influence"))


def _bag_sql(name: str, source: str, key: str, text: str, dims: int = 64) -> str:
    """The stand-in embedding of texts, one row per key with its list of counts."""
    return f"""{name}_t AS (SELECT {key}, md5(w) AS h FROM (SELECT {key}, unnest({d.words(text)}) AS w FROM {source})),
 {name}_d AS (SELECT {key}, ('0x' || h[1:8])::BIGINT % {dims} AS i, sum(CASE WHEN ('0x' || h[9])::BIGINT % 2 = 0 THEN 1 ELSE -1 END)::DOUBLE AS x FROM {name}_t GROUP BY 1, 2),
 {name} AS (SELECT {key}, list(coalesce(x, 0) ORDER BY k.i) AS e FROM (SELECT DISTINCT {key} FROM {source}) s CROSS JOIN range(0, {dims}) k(i) LEFT JOIN {name}_d USING ({key}, i) GROUP BY 1)"""


_WHOLE = "context_before || ' ' || citation_text || ' ' || context_after"


def word_similarity(said, cited):
    """Cosine itself: taken from one and back, a distance loses the last digits and rounds differently."""
    return V.cosine(said, cited)


@R.query(
    "context_influence",
    sql(f""", cw AS (SELECT *, citing || '/' || cited || '/' || paragraph AS k, {_WHOLE} AS whole FROM ctx), {_bag_sql('ce', 'cw', 'k', 'whole')}, {_bag_sql('de', 'docs_ann', 'doc_id', 'text')},
 cs AS (SELECT cw.*, {cos_sql('ce.e', 'de.e')} AS similarity FROM cw JOIN ce USING (k) JOIN de ON de.doc_id = cw.cited)
 SELECT citing, cited, paragraph, round(similarity, 6) AS similarity, round({_influence_sql('similarity')}, 6) AS influence FROM cs"""),
)
def context_influence(spark, sf_dir):
    """Influence of a citation from what is said around it: its words against those of the cited text."""
    c = contexts(spark, sf_dir).withColumn("k", F.concat_ws("/", "citing", "cited", "paragraph"))
    model = lambda: EM.HashingModel(64)
    whole = c.select("k", F.concat_ws(" ", "context_before", "citation_text", "context_after").alias("whole"))
    said = EM.embed(whole, "k", "whole", model).select("k", F.col("embedding").alias("x"))
    cited = EM.embed(S.docs_ann(spark, sf_dir).select(F.col("doc_id").alias("cited"), "text"), "cited", "text", model).select("cited", F.col("embedding").alias("y"))
    j = c.join(said, "k").join(cited, "cited").withColumn("similarity", word_similarity(F.col("x"), F.col("y")))
    return j.withColumn("influence", C.influence(F.col("similarity"))).select("citing", "cited", "paragraph", F.round("similarity", 6).alias("similarity"), F.round("influence", 6).alias("influence"))


_MOCK = f""", mock0 AS (SELECT src AS citing, dst AS cited, 'We build on doc_' || dst AS citation_text, t.text[1:200] AS context_before FROM cites JOIN docs_ann t ON t.doc_id = src JOIN docs_ann u ON u.doc_id = dst),
 mock AS (SELECT *, {_features_sql('citation_text', 'context_before')} FROM mock0),
 msim AS (SELECT m.*, {cos_sql('a.e', 'b.e')} AS similarity FROM mock m JOIN vecs a ON a.vec_id = m.citing % (SELECT count(*) FROM embeddings) JOIN vecs b ON b.vec_id = m.cited % (SELECT count(*) FROM embeddings)),
 minf AS (SELECT *, {_influence_sql('similarity')} AS influence FROM msim),
 agg AS (SELECT citing, cited, avg(influence) AS total_influence, CASE WHEN count(*) FILTER (citation_type = 'implements') > 0 THEN 'implementation'
  WHEN count(*) FILTER (citation_type = 'builds_on') > count(*) / 2 THEN 'extension' WHEN count(*) FILTER (citation_type = 'compares') > count(*) / 2 THEN 'comparison'
  WHEN bool_or(is_methodological) THEN 'methodological' ELSE 'reference' END AS conveyance_type, count(*) AS n_contexts FROM (SELECT citing, cited, influence, citation_type, is_methodological FROM minf
  UNION ALL SELECT citing, cited, influence, citation_type, is_methodological FROM inf) GROUP BY 1, 2)
"""


def all_contexts(spark, sf_dir):
    """Contexts found in the text, and one stated context per citation whose two papers are known."""
    docs = S.docs_ann(spark, sf_dir)
    c = S.cites(spark, sf_dir).select(F.col("src").alias("citing"), F.col("dst").alias("cited"))
    known = docs.select(F.col("doc_id").alias("cited"))
    stated = c.join(docs.select(F.col("doc_id").alias("citing"), F.substring("text", 1, 200).alias("context_before")), "citing").join(known, "cited")
    stated = C.with_features(stated.withColumn("citation_text", F.concat(F.lit("We build on doc_"), F.col("cited").cast("string"))))
    cols = ["citing", "cited", "influence", "citation_type", "is_methodological"]
    scored = with_similarity(spark, sf_dir, stated).withColumn("influence", C.influence(F.col("similarity")))
    return scored.select(*cols).unionByName(scored_contexts(spark, sf_dir).select(*cols))


def semantic(spark, sf_dir):
    a = all_contexts(spark, sf_dir).groupBy("citing", "cited")
    return a.agg(F.coalesce(F.avg("influence"), F.lit(0.0)).alias("total_influence"), *O.C.dominant_type(), F.count("*").alias("n_contexts"))


def msql(body: str) -> str:
    return with_ctes(["vecs", "docs_ann", "cites"], _CTX + _MOCK + body)


@R.query("conveyance_type", msql("SELECT citing, cited, round(total_influence, 6) AS total_influence, conveyance_type, n_contexts FROM agg"))
def conveyance_type(spark, sf_dir):
    return semantic(spark, sf_dir).select("citing", "cited", F.round("total_influence", 6).alias("total_influence"), "conveyance_type", "n_contexts")


@R.query("type_distribution", msql("SELECT conveyance_type, count(*) AS n, round(100.0::DOUBLE * count(*) / (SELECT count(*) FROM agg), 6) AS percent FROM agg GROUP BY 1"))
def type_distribution(spark, sf_dir):
    from pyspark.sql import Window

    n = semantic(spark, sf_dir).groupBy("conveyance_type").agg(F.count("*").alias("n"))  # one row per type
    return n.select("conveyance_type", "n", F.round(F.lit(100.0) * F.col("n") / F.sum("n").over(Window.partitionBy(F.lit(1))), 6).alias("percent"))


@R.query("high_influence", msql("SELECT citing, cited, round(total_influence, 6) AS total_influence FROM agg WHERE round(total_influence, 9) >= 0.2"))
def high_influence(spark, sf_dir, threshold: float = 0.2):
    s = semantic(spark, sf_dir).where(F.round("total_influence", 9) >= threshold)
    return s.orderBy(F.desc("total_influence"), "citing", "cited").select("citing", "cited", F.round("total_influence", 6).alias("total_influence"))


@R.query("best_context", sql("SELECT citing, max(round(influence, 6)) AS influence, arg_max(citation_text, (round(influence, 6), -cited, -paragraph)) AS citation_text FROM inf GROUP BY citing"))
def best_context(spark, sf_dir):
    s = scored_contexts(spark, sf_dir).withColumn("influence", F.round("influence", 6))
    order = F.struct("influence", (-F.col("cited")).alias("c"), (-F.col("paragraph")).alias("p"))
    return s.groupBy("citing").agg(F.max("influence").alias("influence"), F.max_by("citation_text", order).alias("citation_text"))


# A concept is bounded by non-word characters; doubling those lets neighbouring matches share one.
_SEP = r"[^\p{L}\p{N}_]"
_CONCEPTS = f"""list_filter(list_distinct(list_transform(regexp_extract_all(regexp_replace(text, '({_SEP})', '\\1\\1', 'g'),
 '(?:^|{_SEP})([A-Z][a-z]+(?:\\s+[A-Z][a-z]+)*)(?:{_SEP}|$)', 1), lambda x: replace(replace(x, '  ', ' '), chr(10)||chr(10), chr(10)))), lambda x: x NOT IN {tuple(C.COMMON_CONCEPTS)})"""
_SHARED = f""", k AS (SELECT doc_id, text, {_CONCEPTS} AS ks FROM docs_ann),
 sh AS (SELECT src AS citing, dst AS cited, list_sort(list_intersect(a.ks, b.ks))[1:10] AS shared, a.text AS ta, b.text AS tb FROM cites JOIN k a ON a.doc_id = src JOIN k b ON b.doc_id = dst)
"""


def shared(spark, sf_dir, concept: str | None = None):
    """Shared concepts of both ends of each citation; with a concept, also how each end words it.

    Concepts and wordings are short and taken once per document; texts stay where they are read.
    """
    more = [C.usage_window(F.col("text"), F.lit(concept)).alias("u")] if concept else []
    k = S.docs_ann(spark, sf_dir).select("doc_id", C.concepts(F.col("text")).alias("ks"), *more)
    if concept:
        k = X.settled(k.where(F.array_contains("ks", concept)), "u")
    side = lambda end, x: k.select(F.col("doc_id").alias(end), F.col("ks").alias("k" + x), *[F.col("u").alias("u" + x) for _ in more])
    c = S.cites(spark, sf_dir).select(F.col("src").alias("citing"), F.col("dst").alias("cited"))
    return c.join(side("citing", "a"), "citing").join(side("cited", "b"), "cited").withColumn("shared", C.shared_concepts(F.col("ka"), F.col("kb"))).drop("ka", "kb")


@R.query("shared_concepts", with_ctes(["docs_ann", "cites"], _SHARED + "SELECT citing, cited, array_to_string(shared, '|') AS shared FROM sh"))
def shared_concepts(spark, sf_dir):
    return shared(spark, sf_dir).select("citing", "cited", F.array_join("shared", "|").alias("shared"))


def _usage_sql(text: str) -> str:
    s = f"list_filter(regexp_split_to_array({text}, '[.!?]+'), lambda s: len(list_filter({d.words('s')}, lambda w: contains(lower(w), 'is'))) > 0)[1]"
    w = d.words(s)
    at = f"list_position(list_transform({w}, lambda w: contains(lower(w), 'is')), TRUE)"
    return f"coalesce(array_to_string(({w})[greatest({at}-3, 1):{at}+3], ' '), '')"


@R.query(
    "concept_evolution",
    with_ctes(["vecs", "docs_ann", "cites"], _CTX + _MOCK + _SHARED + f"""SELECT sh.citing, sh.cited, original_usage, evolved_usage, round(total_influence, 6) AS influence FROM
 (SELECT citing, cited, {_usage_sql('tb')} AS original_usage, {_usage_sql('ta')} AS evolved_usage FROM sh WHERE list_contains(shared, 'Is')) sh JOIN agg USING (citing, cited) WHERE original_usage <> evolved_usage"""),
)
def concept_evolution(spark, sf_dir, concept: str = "Is"):
    """How a shared concept is worded in the cited and in the citing text, where the wording differs."""
    s = shared(spark, sf_dir, concept).where(F.array_contains("shared", concept))
    s = s.select("citing", "cited", F.col("ub").alias("original_usage"), F.col("ua").alias("evolved_usage"))
    inf = semantic(spark, sf_dir).select("citing", "cited", F.round("total_influence", 6).alias("influence"))
    return s.join(inf, ["citing", "cited"]).where("original_usage <> evolved_usage").orderBy(F.desc("influence"), "citing", "cited")
