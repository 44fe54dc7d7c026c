"""Records around the documents: appended edges, document structs, prompts, durations, reports, stored results."""

from __future__ import annotations

from pyspark.sql import functions as F

from stemma.functions import paths as P
from stemma.functions import text as X
from stemma.functions import vectors as V
from stemma.operators import citations as O
from stemma.operators import store as ST
from stemma.plans import dialect as d
from stemma.plans.layout_plans import one_step
from stemma.plans.registry import Registry
from stemma.plans.text_plans import SCORED, scored
from stemma.session import cut_lineage
from stemma.sources import tables as S
from stemma.sources.tables import with_ctes
from stemma.streaming.ingest import work_folder

R = Registry()


@R.query("edge_append", with_ctes(["cites"], "SELECT src, dst, 2::BIGINT AS stored FROM cites"))
def edge_append(spark, sf_dir):
    """Edges appended by two runs, one row per edge when read, with how often it is stored."""
    folder = work_folder(spark, "appended")
    for _ in range(2):
        S.cites(spark, sf_dir).select("src", "dst").write.mode("append").parquet(folder)
    return spark.read.parquet(folder).groupBy("src", "dst").agg(F.count("*").alias("stored"))


# A template with named places.
PROMPT = "Rate the text titled {title} in {lang}.\nText: {text}\nAnswer with three numbers."


@R.query(
    "prompt_fill",
    "SELECT doc_id, md5(replace(replace(replace('" + PROMPT.replace("\n", "' || chr(10) || '") + "', '{title}', 'Doc ' || doc_id), '{lang}', lang), '{text}', text[1:300])) AS prompt FROM documents",
)
def prompt_fill(spark, sf_dir):
    """The named places of a template filled per document."""
    values = {"title": F.concat(F.lit("Doc "), F.col("doc_id").cast("string")), "lang": F.col("lang"), "text": F.substring("text", 1, 300)}
    return S.table(spark, sf_dir, "documents").select("doc_id", F.md5(X.fill(PROMPT, values)).alias("prompt"))


@R.query("durations", "SELECT user_id, round((epoch_us(max(ts)) - epoch_us(min(ts))) / 1000000.0::DOUBLE, 3) AS seconds FROM events GROUP BY 1")
def durations(spark, sf_dir):
    """Seconds between the first and the last event of a user."""
    us = F.unix_micros(F.col("ts").cast("timestamp"))
    return S.table(spark, sf_dir, "events").groupBy("user_id").agg(F.round((F.max(us) - F.min(us)) / 1e6, 3).alias("seconds"))


@R.query("loc_count", f"SELECT doc_id, CASE WHEN text = '' THEN 0 ELSE len({d.lines('text', X.LINE_BREAK)}) END::INT AS loc, md5(text) AS content_hash, md5(text[1:500]) AS sample FROM documents")
def loc_count(spark, sf_dir):
    """Lines, content hash and a sample of the first 500 characters, as a file node stores them."""
    t = F.col("text")
    return S.texts(spark, sf_dir).select("doc_id", F.when(t == "", 0).otherwise(F.size(X.lines_of(t))).alias("loc"), F.md5(t).alias("content_hash"), F.md5(F.substring(t, 1, 500)).alias("sample"))


@R.query(
    "document_struct",
    """SELECT doc_id, '/corpus/' || lang || '/' || source AS parent, 3::INT AS depth, CASE doc_id % 3 WHEN 0 THEN 'python' WHEN 1 THEN 'markdown' ELSE 'text' END AS doc_type,
 length(text)::INT AS chars, 0::INT AS n_errors FROM documents""",
)
def document_struct(spark, sf_dir):
    """Loader rows turned into nested documents, written as JSON text and restored."""
    i = F.col("doc_id")
    ext = F.when(i % 3 == 0, ".py").when(i % 3 == 1, ".md").otherwise(".txt")
    path = F.concat_ws("/", F.lit("/corpus"), "lang", "source", F.concat(F.lit("doc_"), i.cast("string"), ext))
    doc = F.struct(
        i.alias("doc_id"),
        P.document_type(ext).alias("doc_type"),
        F.struct(path.alias("absolute_path"), P.ancestors(path).alias("directory_chain")).alias("location"),
        F.struct(F.col("text").alias("raw_text")).alias("content"),
        F.array().cast("array<string>").alias("errors"),
    )
    schema = "doc_id long, doc_type string, location struct<absolute_path: string, directory_chain: array<string>>, content struct<raw_text: string>, errors array<string>"
    back = S.texts(spark, sf_dir).select(F.from_json(F.to_json(doc), schema).alias("x"))
    return back.select(
        "x.doc_id", P.parent(F.col("x.location.absolute_path")).alias("parent"), F.size("x.location.directory_chain").alias("depth"), "x.doc_type",
        F.char_length("x.content.raw_text").alias("chars"), F.size("x.errors").alias("n_errors"),
    )


@R.query("training_filter", "SELECT doc_id, confidence FROM (SELECT doc_id, ((doc_id * 37) % 100) / 100.0::DOUBLE AS confidence FROM labels) WHERE confidence > 0.7")
def training_filter(spark, sf_dir):
    """Training examples whose confidence is high enough."""
    c = ((F.col("doc_id") * 37) % 100 / 100.0).alias("confidence")
    return S.table(spark, sf_dir, "labels").select("doc_id", c).where("confidence > 0.7")


@R.query("position_store", "SELECT count(*) AS stored, 0::BIGINT AS changed FROM embeddings")
def position_store(spark, sf_dir):
    """Positions after a layout round, stored and compared with what is read back."""
    state = cut_lineage(one_step(spark, sf_dir).select("id", V.micro(F.col("pos")).alias("pos")))
    t = ST.Table(spark, work_folder(spark, "positions"), "positions")
    t.write(state)
    return t.read().join(state.withColumnRenamed("pos", "was"), "id").agg(F.count("*").alias("stored"), F.count_if(F.col("pos") != F.col("was")).alias("changed"))


@R.query(
    "network_dump",
    with_ctes(["cites"], "SELECT 'nodes' AS part, count(*) AS n, sum(doc_id)::BIGINT AS mark FROM documents UNION ALL SELECT 'edges', count(*), sum(src * 31 + dst)::BIGINT FROM cites"),
)
def network_dump(spark, sf_dir):
    """The citation network written as node and edge tables and read back."""
    folder = work_folder(spark, "network")
    S.table(spark, sf_dir, "documents").select("doc_id", "lang").write.parquet(f"{folder}/nodes")
    S.cites(spark, sf_dir).select("src", "dst").write.parquet(f"{folder}/edges")
    nodes = spark.read.parquet(f"{folder}/nodes").agg(F.count("*").alias("n"), F.sum("doc_id").alias("mark"))
    edges = spark.read.parquet(f"{folder}/edges").agg(F.count("*").alias("n"), F.sum(F.col("src") * 31 + F.col("dst")).alias("mark"))
    return nodes.select(F.lit("nodes").alias("part"), "n", "mark").unionByName(edges.select(F.lit("edges").alias("part"), "n", "mark"))


@R.query(
    "network_report",
    with_ctes(["papers", "authors", "affil"], """ SELECT 'papers' AS measure, count(*)::DOUBLE AS value FROM papers UNION ALL SELECT 'authors', count(DISTINCT author_id) FROM authors UNION ALL SELECT 'institutions', count(DISTINCT institution_id) FROM affil
 UNION ALL SELECT 'citations', sum(citation_count) FROM papers UNION ALL SELECT 'papers per author', round(count(*) / count(DISTINCT author_id)::DOUBLE, 6) FROM authors
 UNION ALL SELECT 'mean velocity', round(avg(citation_count / greatest(1, 2024 - year)), 6) FROM papers"""),
)
def network_report(spark, sf_dir):
    """The figures of a network report as rows."""
    papers, authors = S.papers(spark, sf_dir), S.authors(spark, sf_dir)
    p = papers.agg(
        F.count("*").alias("papers"), F.sum("citation_count").alias("citations"), F.round(F.avg(O.citation_velocity(F.col("citation_count"), F.col("year"))), 6).alias("mean velocity")
    )
    a = authors.groupBy("author_id").agg(F.count("*").alias("n")).agg(F.count("*").alias("authors"), F.round(F.sum("n") / F.count("*"), 6).alias("papers per author"))
    i = S.affil(spark, sf_dir).select("institution_id").distinct().agg(F.count("*").alias("institutions"))
    rows = lambda df: df.select(F.inline(F.array(*[F.struct(F.lit(c).alias("measure"), F.col(f"`{c}`").cast("double").alias("value")) for c in df.columns])))
    return rows(p).unionByName(rows(a)).unionByName(rows(i))


@R.query(
    "processing_results",
    with_ctes(["docs_ann"], SCORED + """SELECT s.doc_id, s.doc_id % 17 <> 0 AS success, CASE WHEN s.doc_id % 17 = 0 THEN 'unreadable' END AS error, CASE WHEN s.doc_id % 17 <> 0 THEN round(implementation_fidelity, 6) END AS implementation_fidelity,
 CASE WHEN s.doc_id % 17 <> 0 THEN CASE WHEN implementation_fidelity >= 0.7 THEN 'high' WHEN implementation_fidelity >= 0.4 THEN 'medium' ELSE 'low' END END AS band FROM scored s"""),
)
def processing_results(spark, sf_dir):
    """One result row per file: its score and band, or the error that kept it from being scored."""
    bad = F.col("doc_id") % 17 == 0
    s = scored(spark, sf_dir)
    f = F.col("implementation_fidelity")
    band = F.when(f >= 0.7, "high").when(f >= 0.4, "medium").otherwise("low")
    return s.select("doc_id", (~bad).alias("success"), F.when(bad, "unreadable").alias("error"), F.when(~bad, F.round(f, 6)).alias("implementation_fidelity"), F.when(~bad, band).alias("band"))


@R.query("stored_metadata", "SELECT doc_id, 'Doc ' || doc_id AS title, lang AS category, (doc_id % 3)::INT AS n_authors FROM documents WHERE doc_id % 4 <> 0 UNION ALL SELECT doc_id, NULL, NULL, 0 FROM documents WHERE doc_id % 4 = 0")
def stored_metadata(spark, sf_dir):
    """Metadata files of papers read with a declared schema; papers without one get empty metadata."""
    i = F.col("doc_id")
    docs = S.table(spark, sf_dir, "documents").select("doc_id", "lang")
    authors = F.slice(F.array(F.lit("A"), F.lit("B")), 1, (i % 3).cast("int"))
    meta = docs.where(i % 4 != 0).select(i.alias("arxiv_id"), F.concat(F.lit("Doc "), i.cast("string")).alias("title"), F.array("lang").alias("categories"), authors.alias("authors"))
    folder = work_folder(spark, "metadata")
    meta.write.json(folder)
    read = spark.read.schema("arxiv_id long, title string, categories array<string>, authors array<string>").json(folder)
    j = docs.select("doc_id").join(read.withColumnRenamed("arxiv_id", "doc_id"), "doc_id", "left")
    return j.select("doc_id", "title", F.get("categories", F.lit(0)).alias("category"), F.coalesce(F.size("authors"), F.lit(0)).alias("n_authors"))
