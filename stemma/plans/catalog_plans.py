"""Stored documents and queries, gathering, classification, summaries."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from stemma.functions import paths as P
from stemma.functions import text as X
from stemma.operators import gathering as GA
from stemma.operators import store as ST
from stemma.plans import dialect as d
from stemma.plans.registry import Registry
from stemma.sources import tables as S
from stemma.sources.tables import with_ctes
from stemma.streaming.ingest import work_folder

R = Registry()


@R.query("query_history", with_ctes(["qhist"], "SELECT query_id, run_ts, avg_conveyance, total_results FROM qhist WHERE event_type = 'purchase'"))
def query_history(spark, sf_dir, researcher: str = "purchase"):
    """Runs of one researcher, newest first."""
    h = S.qhist(spark, sf_dir).where(F.col("event_type") == researcher)
    return h.orderBy(F.desc("run_ts"), "query_id").select("query_id", "run_ts", "avg_conveyance", "total_results")


@R.query(
    "query_evolution",
    with_ctes(["qhist"], """, h AS (SELECT *, range(total_results, total_results + 4) AS ids FROM qhist),
 g AS (SELECT query_id, count(*) AS execution_count, arg_min(avg_conveyance, run_ts) AS a, arg_max(avg_conveyance, run_ts) AS b, arg_min(total_results, run_ts) AS ra,
  arg_max(total_results, run_ts) AS rb, arg_min(ids, run_ts) AS ia, arg_max(ids, run_ts) AS ib, max(avg_conveyance) AS peak FROM h GROUP BY 1 HAVING count(*) > 1)
 SELECT query_id, execution_count, a AS initial_conveyance, b AS current_conveyance, round(b - a, 6) AS conveyance_delta, CASE WHEN b - a > 0 THEN 'increasing' ELSE 'decreasing' END AS conveyance_trend,
  rb - ra AS result_count_delta, len(list_filter(ib, lambda x: NOT list_contains(ia, x)))::INT AS new_high_value_results, peak AS peak_conveyance FROM g"""),
)
def query_evolution(spark, sf_dir):
    ids = F.sequence(F.col("total_results"), F.col("total_results") + 3)
    h = S.qhist(spark, sf_dir).withColumn("ids", ids)
    return ST.evolution(h, "query_id", "run_ts", "avg_conveyance", "total_results", "ids").withColumn("conveyance_delta", F.round("conveyance_delta", 6))


def tagged(spark, sf_dir):
    """Queries with their tag set; a query is active unless its smallest run was an error."""
    e = S.table(spark, sf_dir, "events")
    return e.groupBy(F.col("user_id").alias("doc_id")).agg(
        F.collect_set("event_type").alias("collection_tags"), (F.min_by("event_type", "event_id") != "error").alias("is_active")
    )  # tags come from a fixed vocabulary, so the set is bounded


_TAGGED = """t AS (SELECT user_id AS doc_id, list_distinct(list(event_type)) AS tags, arg_min(event_type, event_id) <> 'error' AS is_active FROM events GROUP BY 1),
 g AS (SELECT doc_id, list_contains(tags, 'signup') OR list_contains(tags, 'error') AS hit, is_active AS was FROM t),
 u AS (SELECT doc_id, hit AND was AS affected, CASE WHEN hit THEN FALSE ELSE was END AS is_active FROM g)"""


@R.query("query_toggle", f"WITH {_TAGGED} SELECT doc_id, affected, is_active FROM u")
def query_toggle(spark, sf_dir):
    return ST.toggle(tagged(spark, sf_dir), ["signup", "error"], False).select("doc_id", "affected", "is_active")


@R.query("toggle_affected", f"WITH {_TAGGED} SELECT count(*) FILTER (affected) AS affected, count(*) FILTER (is_active) AS active FROM u")
def toggle_affected(spark, sf_dir):
    return query_toggle(spark, sf_dir).agg(F.count_if("affected").alias("affected"), F.count_if("is_active").alias("active"))


@R.query(
    "toggle_nodes",
    f"""WITH {_TAGGED}, n AS (SELECT doc_id FROM documents) SELECT doc_id FROM n WHERE doc_id NOT IN (SELECT doc_id FROM u WHERE affected AND NOT is_active)""",
)
def toggle_nodes(spark, sf_dir):
    t = ST.toggle(tagged(spark, sf_dir), ["signup", "error"], False)
    return ST.toggle_nodes(S.table(spark, sf_dir, "documents").select("doc_id"), t)


@R.query("extraction_ready", "SELECT DISTINCT user_id AS doc_id FROM events WHERE event_type IN ('purchase', 'signup')")
def extraction_ready(spark, sf_dir):
    """Queries with any of the tags, as a semi-join of exploded tags."""
    q = tagged(spark, sf_dir)
    tags = spark.createDataFrame([("purchase",), ("signup",)], "tag string")
    hits = q.select("doc_id", F.explode("collection_tags").alias("tag")).join(F.broadcast(tags), "tag", "left_semi").select("doc_id").distinct()
    return q.join(hits, "doc_id", "left_semi").select("doc_id")


@R.query(
    "node_upsert",
    """SELECT coalesce(d.doc_id, l.doc_id) AS doc_id, CASE WHEN l.quality = 1 THEN 'high' ELSE d.lang END AS lang, d.source AS source, l.toxic AS toxic FROM documents d FULL JOIN labels l ON l.doc_id = d.doc_id""",
)
def node_upsert(spark, sf_dir):
    """Labels merged into documents: a missing new value keeps the old one."""
    old = S.table(spark, sf_dir, "documents").select("doc_id", "lang", "source")
    new = S.table(spark, sf_dir, "labels").select("doc_id", F.when(F.col("quality") == 1, "high").alias("lang"), "toxic")
    return ST.merge(old, new, "doc_id").select("doc_id", "lang", "source", "toxic")


@R.query("batch_replace", """SELECT doc_id, NULL::VARCHAR AS lang, quality FROM labels UNION ALL SELECT doc_id, lang, NULL FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)""")
def batch_replace(spark, sf_dir):
    old = S.table(spark, sf_dir, "documents").select("doc_id", "lang")
    new = S.table(spark, sf_dir, "labels").select("doc_id", "quality")
    return ST.replace(old, new, "doc_id").select("doc_id", "lang", "quality")


@R.query(
    "edge_upsert",
    """SELECT l_partkey AS src, l_suppkey AS dst, l_returnflag AS relationship, 'semantic' AS edge_type, arg_max(l_quantity, l_orderkey * 10 + l_linenumber) AS weight FROM lineitem GROUP BY 1, 2, 3""",
)
def edge_upsert(spark, sf_dir):
    """Lines as edge writes in order of their key; the last write of an edge stays."""
    e = S.table(spark, sf_dir, "lineitem").select(
        F.col("l_partkey").alias("src"), F.col("l_suppkey").alias("dst"), F.col("l_returnflag").alias("relationship"), F.col("l_quantity").alias("weight"),
        (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("seq"),
    )
    return ST.latest_edges(e, "seq").select("src", "dst", "relationship", "edge_type", "weight")


@R.query("skip_existing", "SELECT doc_id, source FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def skip_existing(spark, sf_dir):
    return ST.skip_existing(S.table(spark, sf_dir, "documents").select("doc_id", "source"), S.table(spark, sf_dir, "labels"), "doc_id")


@R.query("dedupe_first", "SELECT user_id, min(event_id) AS event_id, arg_min(event_type, event_id) AS event_type FROM events GROUP BY 1")
def dedupe_first(spark, sf_dir):
    e = S.table(spark, sf_dir, "events").select("user_id", "event_id", "event_type").withColumn("seq", F.col("event_id"))
    return ST.first_seen(e, "user_id", "seq").select("user_id", "event_id", "event_type")


@R.query("point_lookup", "SELECT doc_id, lang, source, n_chars FROM documents WHERE doc_id = 42")
def point_lookup(spark, sf_dir):
    return S.table(spark, sf_dir, "documents").where("doc_id = 42").select("doc_id", "lang", "source", "n_chars")


@R.query("store_stats", "SELECT (SELECT count(*) FROM documents) AS n_nodes, (SELECT count(*) FROM lineitem) AS n_edges, (SELECT count(*) FROM embeddings) AS n_vectors")
def store_stats(spark, sf_dir):
    t = {"n_nodes": "documents", "n_edges": "lineitem", "n_vectors": "embeddings"}
    parts = [S.table(spark, sf_dir, v).agg(F.count("*").alias("n")).select(F.lit(k).alias("k"), "n") for k, v in t.items()]
    every = parts[0].unionByName(parts[1]).unionByName(parts[2])
    return every.agg(*[F.max(F.when(F.col("k") == k, F.col("n"))).alias(k) for k in t])


@R.query(
    "section_asof",
    """WITH p AS (SELECT * FROM events WHERE event_type = 'purchase'), s AS (SELECT * FROM events WHERE event_type = 'view')
 SELECT p.user_id, p.event_id, coalesce(s.event_id, -1) AS section FROM p ASOF LEFT JOIN s ON p.user_id = s.user_id AND p.ts > s.ts""",
)
def section_asof(spark, sf_dir):
    """Each purchase with the last view before it, as an item is filed under the section above it."""
    e = S.table(spark, sf_dir, "events")
    items = e.where("event_type = 'purchase'").select("user_id", "ts", "event_id")
    heads = e.where("event_type = 'view'").select("user_id", "ts", F.col("event_id").alias("section"))
    return ST.asof(items, heads, "user_id", "ts", F.date_trunc("day", F.col("ts")), ["section"], {"section": -1}).select("user_id", "event_id", "section")


_NOW = "1998 + doc_id % 27"


@R.query(
    "year_topn",
    f"""SELECT year, doc_id, n_chars, rank::INT AS rank FROM (SELECT *, row_number() OVER (PARTITION BY year ORDER BY n_chars DESC, doc_id) AS rank FROM
 (SELECT *, row_number() OVER (PARTITION BY year, lang ORDER BY n_chars DESC, doc_id) AS r FROM (SELECT ({_NOW})::INT AS year, doc_id, lang, n_chars FROM documents)) WHERE r <= 10) WHERE rank <= 20""",
)
def year_topn(spark, sf_dir):
    """Longest documents per year, after at most ten per language."""
    docs = S.table(spark, sf_dir, "documents").select((F.lit(1998) + F.col("doc_id") % 27).cast("int").alias("year"), "doc_id", "lang", "n_chars")
    return GA.year_top(docs, "year", "lang", "n_chars", "doc_id", per_year=20, per_category=10).select("year", "doc_id", "n_chars", "rank")


@R.query(
    "topic_gather",
    f"""SELECT topic, doc_id FROM (SELECT *, row_number() OVER (PARTITION BY topic ORDER BY doc_id) AS r FROM (SELECT DISTINCT topic, doc_id FROM
 (SELECT 'entropy' AS topic, doc_id FROM docs_ann WHERE contains(lower(text), 'entropy') OR contains(lower(text), 'information theory')
 UNION ALL SELECT 'algorithms', doc_id FROM docs_ann WHERE contains(lower(text), 'algorithm') OR contains(lower(text), 'matrix')) WHERE {_NOW} BETWEEN 2000 AND 2020)) WHERE r <= 25""".join(["WITH " + S.CTE["docs_ann"] + "\n", ""]),
)
def topic_gather(spark, sf_dir):
    """Per topic, documents matching any of its terms within the years, each once, the first 25."""
    docs = S.docs_ann(spark, sf_dir).withColumn("year", F.lit(1998) + F.col("doc_id") % 27)
    topics = {"entropy": ["entropy", "information theory"], "algorithms": ["algorithm", "matrix"]}
    return GA.gather_topics(docs, topics, "text", "doc_id", per_topic=25, years=(2000, 2020)).select("topic", "doc_id")


_TOPICS = {"structure": ["the", "matrix", "graph"], "method": ["algorithm", "step"]}


def _n_sql(q: str) -> str:
    return f"((length(low) - length(replace(low, '{q}', ''))) / {len(q)})::INT"


@R.query(
    "topic_shares",
    "WITH " + S.CTE["docs_ann"] + ", low AS (SELECT doc_id, lower(text) AS low FROM docs_ann), h AS ("
    + " UNION ALL ".join(f"SELECT '{t}' AS topic, '{q}' AS query, {max(1, 50 // len(qs))} AS share, doc_id, {_n_sql(q)} AS hits FROM low" for t, qs in _TOPICS.items() for q in qs)
    + """), b AS (SELECT topic, doc_id, max(hits) AS hits, arg_max(query, (hits, query)) AS query, arg_max(share, (hits, query)) AS share FROM h WHERE hits > 0 GROUP BY 1, 2)
 SELECT topic, doc_id, query, hits FROM (SELECT *, row_number() OVER (PARTITION BY topic, query ORDER BY hits DESC, doc_id) AS r FROM b) WHERE r <= share""",
)
def topic_shares(spark, sf_dir):
    """Topics whose queries share the places of the topic, most relevant documents first."""
    return GA.gather_queries(S.docs_ann(spark, sf_dir), _TOPICS, "text", "doc_id", 50)


_KEYWORDS = ["entropy", "algorithm", "matrix", "graph", "theorem", "code"]


@R.query("keyword_relevance", "WITH " + S.CTE["docs_ann"] + " SELECT doc_id, " + " + ".join(f"contains(lower(text), '{k}')::INT" for k in _KEYWORDS) + " >= 2 AS relevant FROM docs_ann")
def keyword_relevance(spark, sf_dir):
    """Whether a text holds at least two of the collection's keywords."""
    return S.docs_ann(spark, sf_dir).select("doc_id", GA.relevant(F.col("text"), _KEYWORDS).alias("relevant"))


@R.query("query_store", f"WITH {_TAGGED} SELECT doc_id, array_to_string(list_sort(tags), '|') AS tags, is_active, is_active AS has_node FROM t")
def query_store(spark, sf_dir):
    """Queries written to a stored table together with the nodes of the active ones, read back."""
    q = tagged(spark, sf_dir)
    root = work_folder(spark, "queries")
    ST.write_queries(spark, root, q)
    nodes = ST.Table(spark, root, "nodes").read().select("doc_id", F.lit(True).alias("has_node"))
    stored = ST.Table(spark, root, "queries").read().join(nodes, "doc_id", "left")
    return stored.select("doc_id", F.array_join(F.sort_array("collection_tags"), "|").alias("tags"), "is_active", F.coalesce("has_node", F.lit(False)).alias("has_node"))


@R.query(
    "confidence_filter",
    """SELECT doc_id, round((a + b) / 2.0::DOUBLE, 6) AS mean_confidence, ((a >= 0.7)::INT + (b >= 0.7)::INT)::INT AS kept FROM
 (SELECT doc_id, (1 + doc_id % 10) / 10.0::DOUBLE AS a, (1 + doc_id % 7) / 7.0::DOUBLE AS b FROM documents)""",
)
def confidence_filter(spark, sf_dir):
    """Mean confidence of recognised words, and how many are sure enough; blanks and zeros do not count."""
    i = F.col("doc_id")
    words = F.array(F.lit("alpha"), F.lit(" "), F.lit("beta"), F.lit("gamma"))
    sure = F.array((1 + i % 10) / 10.0, F.lit(0.9), (1 + i % 7) / 7.0, F.lit(0.0))
    d = S.table(spark, sf_dir, "documents").select("doc_id", words.alias("w"), sure.alias("c"))
    kept = F.size(F.filter(F.arrays_zip("w", "c"), lambda z: (z["c"] >= 0.7) & (F.trim(z["w"]) != "")))
    return d.select("doc_id", F.round(X.confidence_mean(F.col("w"), F.col("c")), 6).alias("mean_confidence"), kept.alias("kept"))


@R.query("collection_profile", f"""SELECT 'year' AS facet, ({_NOW})::VARCHAR AS value, count(*) AS n FROM documents GROUP BY 1, 2
 UNION ALL (SELECT 'category', source, count(*) FROM documents GROUP BY 2 ORDER BY 3 DESC, 2 LIMIT 10)""")
def collection_profile(spark, sf_dir):
    docs = S.table(spark, sf_dir, "documents").select((F.lit(1998) + F.col("doc_id") % 27).alias("year"), F.array("source").alias("categories"))
    return GA.profile(docs, "year", "categories")


_LCC = """, cl AS (SELECT doc_id, text, source, lang, regexp_extract(text, '^[^\\n]*') AS title, CASE source WHEN 'src0' THEN 'cs.LG' WHEN 'src1' THEN 'cs.CL' WHEN 'src2' THEN 'stat.ML' ELSE 'math.CO' END AS cat FROM docs_ann),
 k AS (SELECT *, CASE cat WHEN 'cs.LG' THEN 'QA76.9.A43' WHEN 'cs.CL' THEN 'P98' WHEN 'stat.ML' THEN 'QA76.9.A43' ELSE CASE
  WHEN contains(low, 'shannon') OR contains(low, 'entropy') OR contains(low, 'information theory') OR contains(low, 'mutual information') THEN 'QA76.9.I52'
  WHEN (contains(low, 'anthropolog') OR contains(low, 'ethnograph') OR contains(low, 'cultural') OR contains(low, 'society') OR contains(low, 'social')) THEN
   CASE WHEN contains(low, 'cogniti') THEN 'GN476' WHEN contains(low, 'linguistic') OR contains(low, 'language') THEN 'GN495' ELSE 'GN301' END
  ELSE 'QA76.9' END END AS code FROM (SELECT *, lower(title) || ' ' || lower(text) AS low FROM cl))
"""


def classified(spark, sf_dir):
    docs = S.docs_ann(spark, sf_dir).withColumn("title", F.regexp_extract("text", r"^[^\n]*", 0))
    cat = P.lookup(F.col("source"), {"src0": "cs.LG", "src1": "cs.CL", "src2": "stat.ML"}, "math.CO")
    return docs.withColumn("class", P.classify(F.col("title"), F.col("text"), F.array(cat)))


@R.query("lcc_classify", with_ctes(["docs_ann"], _LCC + "SELECT doc_id, code FROM k"))
def lcc_classify(spark, sf_dir):
    return classified(spark, sf_dir).select("doc_id", "class.code")


_STOP = "(" + ", ".join(d.q(w) for w in P.ACRONYM_STOP_WORDS) + ")"
_FNAME = f""", f AS (SELECT doc_id, code, lang, ({_NOW})::VARCHAR AS year, list_filter(regexp_split_to_array(title, '\\s+'), lambda w: w <> '' AND lower(w) NOT IN {_STOP}) AS ws FROM k),
 nm AS (SELECT doc_id, code, year, regexp_replace(regexp_replace(code || '_' || year || '_' || lang || 'son_A_' || CASE WHEN len(ws) > 0 THEN
  array_to_string(list_transform(ws[1:4], lambda w: CASE WHEN regexp_replace(w, '[^\\p{{Lu}}]', '', 'g') <> '' THEN regexp_replace(w, '[^\\p{{Lu}}]', '', 'g') ELSE replace(upper(w[1]), 'ẞ', 'SS') END), '')[1:8] ELSE 'PAPER' END
  || '_' || '23_' || doc_id || '.pdf', '[^\\p{{L}}\\p{{N}}_\\-.]', '_', 'g'), '_+', '_', 'g') AS filename FROM f)
"""


def named(spark, sf_dir):
    k = classified(spark, sf_dir)
    year = (F.lit(1998) + F.col("doc_id") % 27).cast("string")
    author = F.concat(F.lit("Ann "), F.col("lang"), F.lit("son"))
    original = F.concat(F.lit("arxiv_23."), F.col("doc_id").cast("string"))
    name = P.class_filename(F.col("class.code"), F.concat(year, F.lit("-01-01")), author, F.col("title"), original)
    return k.select("doc_id", "class.code", year.alias("year"), name.alias("filename"))


@R.query("lcc_filename", with_ctes(["docs_ann"], _LCC + _FNAME + "SELECT doc_id, filename, code[1] || '/' || code AS folder FROM nm"))
def lcc_filename(spark, sf_dir):
    return named(spark, sf_dir).select("doc_id", "filename", P.class_folder(F.col("code")).alias("folder"))


@R.query("lcc_index_files", with_ctes(["docs_ann"], _LCC + _FNAME + """SELECT doc_id, code, string_split(filename, '_')[2] AS year, string_split(filename, '_')[3] AS author, filename FROM nm"""))
def lcc_index_files(spark, sf_dir):
    """The file rows behind the index: class, year and author of every file."""
    p = F.split("filename", "_")
    return named(spark, sf_dir).select("doc_id", "code", p[1].alias("year"), p[2].alias("author"), "filename")


@R.query("lcc_index", with_ctes(["docs_ann"], _LCC + _FNAME + """SELECT code, year, author, count(*) AS n FROM (SELECT code, string_split(filename, '_')[2] AS year, string_split(filename, '_')[3] AS author FROM nm) GROUP BY GROUPING SETS ((code), (year), (author), ())"""))
def lcc_index(spark, sf_dir):
    """Counts by class, by year, by author and in total, in one pass."""
    p = F.split("filename", "_")
    n = named(spark, sf_dir).select("code", p[1].alias("year"), p[2].alias("author"))
    return n.groupingSets([["code"], ["year"], ["author"], []], "code", "year", "author").agg(F.count("*").alias("n"))


@R.query(
    "bibliography",
    """SELECT doc_id, '2301.' || lpad((doc_id % 100000)::VARCHAR, 5, '0') AS arxiv_id, 'Author ' || lang AS author, 'Title ' || doc_id AS title,
 CASE WHEN contains(lower(text), 'observer-relative information') THEN 'observer_relativity' ELSE 'entropy_communication' END AS category FROM documents""",
)
def bibliography(spark, sf_dir):
    """Entries of a bibliography text per document, filed under the nearest section title above them."""
    body = F.concat(
        "text", F.lit("\n## Entropy Generation in Communication\n**Author "), F.col("lang"), F.lit('** et al. "Title '), F.col("doc_id").cast("string"),
        F.lit('", arXiv:2301.'), F.lpad((F.col("doc_id") % 100000).cast("string"), 5, "0"), F.lit("\n## Asymmetric Information Flows\n"),
    )
    docs = S.texts(spark, sf_dir).select("doc_id", body.alias("text"))
    return GA.bibliography(docs, "doc_id", "text").select("doc_id", "arxiv_id", "author", "title", "category")


@R.query("download_summary", """SELECT source AS category, count(*) FILTER (doc_id IN (SELECT doc_id FROM labels WHERE quality = 1)) AS downloaded, count(*) FILTER (doc_id NOT IN (SELECT doc_id FROM labels WHERE quality = 1)) AS failed,
 min(doc_id) FILTER (doc_id NOT IN (SELECT doc_id FROM labels WHERE quality = 1)) AS first_failed FROM documents GROUP BY 1""")
def download_summary(spark, sf_dir):
    docs = S.table(spark, sf_dir, "documents")
    got = S.table(spark, sf_dir, "labels").where("quality = 1").select("doc_id", F.lit(True).alias("ok"))
    j = docs.join(got, "doc_id", "left")
    bad = F.col("ok").isNull()
    return j.groupBy(F.col("source").alias("category")).agg(F.count_if(~bad).alias("downloaded"), F.count_if(bad).alias("failed"), F.min(F.when(bad, F.col("doc_id"))).alias("first_failed"))


@R.query("failed_downloads", "SELECT source AS category, doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels WHERE quality = 1)")
def failed_downloads(spark, sf_dir):
    """Every failed id with its category."""
    docs = S.table(spark, sf_dir, "documents").select(F.col("source").alias("category"), "doc_id")
    return docs.join(S.table(spark, sf_dir, "labels").where("quality = 1").select("doc_id"), "doc_id", "left_anti").select("category", "doc_id")


@R.query("pipeline_counters", """SELECT count(*) AS processed, count(*) FILTER (l.doc_id IS NULL) AS failed, count(*) FILTER (e.vec_id IS NOT NULL) AS embeddings, count(*) FILTER (l.quality = 1) AS relationships
 FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id LEFT JOIN embeddings e ON e.vec_id = d.doc_id""")
def pipeline_counters(spark, sf_dir):
    docs, lab = S.table(spark, sf_dir, "documents").select("doc_id"), S.table(spark, sf_dir, "labels")
    emb = S.table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("doc_id"), F.lit(True).alias("emb"))
    j = docs.join(lab, "doc_id", "left").join(emb, "doc_id", "left")
    return j.agg(
        F.count("*").alias("processed"), F.count_if(F.col("quality").isNull()).alias("failed"), F.count_if(F.col("emb").isNotNull()).alias("embeddings"),
        F.count_if(F.col("quality") == 1).alias("relationships"),
    )


@R.query("dataset_summary", "SELECT count(*) AS total_documents, max(len(embedding))::INT AS dims, bool_or(label = 3) AS has_positions FROM embeddings")
def dataset_summary(spark, sf_dir):
    e = S.table(spark, sf_dir, "embeddings")
    return e.agg(F.count("*").alias("total_documents"), F.max(F.size("embedding")).alias("dims"), F.bool_or(F.col("label") == 3).alias("has_positions"))


@R.query("paper_store", "SELECT doc_id, md5(text[1:1000]) AS content, lang, (doc_id % 100 = 99) AS checkpoint FROM documents")
def paper_store(spark, sf_dir):
    """Stored form of a paper: the first thousand characters, and whether its number triggers a checkpoint."""
    t = S.table(spark, sf_dir, "documents")
    return t.select("doc_id", F.md5(F.substring("text", 1, 1000)).alias("content"), "lang", (F.col("doc_id") % 100 == 99).alias("checkpoint"))


@R.query("result_difference", "SELECT vec_id FROM embeddings WHERE label = 1 AND vec_id NOT IN (SELECT doc_id FROM labels WHERE quality = 1)")
def result_difference(spark, sf_dir):
    """Ids of a later result that an earlier one did not have."""
    late = S.table(spark, sf_dir, "embeddings").where("label = 1").select("vec_id")
    early = S.table(spark, sf_dir, "labels").where("quality = 1").select(F.col("doc_id").alias("vec_id"))
    return late.exceptAll(late.join(early, "vec_id", "left_semi"))
