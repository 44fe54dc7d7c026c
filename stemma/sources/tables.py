"""Views that give the stored tables the shape of documents, vectors, file nodes, papers and query logs.

Every view exists twice: as a DataFrame builder and as a SQL common table expression in `CTE`, so that
a query can be checked by an engine that never sees the DataFrame code.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Text appended to a document by doc_id % 8, so that feature detectors have something to find.
TEMPLATES = [
    "Algorithm 1: Link ranking\nInput: graph\nOutput: scores\n1. Build the matrix\n2. Iterate the step\n3. Normalise\n4. Return scores",
    "Theorem 2 holds. Let $x$ be given.\nE = mc2\nwhere m = mass\nThe proof uses entropy and information theory. ∑ terms",
    "For example, consider the case 12. Such as this application, imagine a library for practical results. We compute accuracy.",
    "```python\nimport os\ndef main():\n    return list(os.environ)\n```\nfor x in items",
    "First, do this.\nThen, do that.\nFinally, stop.\nNext, follow these steps step by step to implement code.",
    "# Overview\n## Parts\n- item one\n- item two\n[link](http://example.org/a)\n![fig](fig.png)\n| a | b |\n| - | - |\n> quoted\nabstract",
    "\n\nRelated work and Background of Graph Theory.\n\nWe extend the method of [REF]. However, it fails to scale.\n\nThe Graph Theory ends",
    "",
]

# File suffixes, permission strings given by doc_id.
SUFFIXES = [".py", ".md", ".txt", ".json", ".yaml", ".gz"]
PERMS = ["644", "600", "755"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


SPREAD_FILES = 8


def spread(df: DataFrame) -> DataFrame:
    """Deal a table of a few files over all cores; one of many files is read as it is split."""
    few = len(df.limit(1).inputFiles()) <= SPREAD_FILES
    return df.repartition(df.sparkSession.sparkContext.defaultParallelism) if few else df


def texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spread(table(spark, sf_dir, "documents"))


def _pick(values, key):
    return F.element_at(F.array(*[F.lit(v) for v in values]), (key + 1).cast("int"))


def vectors(spark, sf_dir) -> DataFrame:
    """vec_id, label and the embedding widened to double."""
    return table(spark, sf_dir, "embeddings").select(
        "vec_id", "label", F.transform("embedding", lambda x: x.cast("double")).alias("e")
    )


def v3(spark, sf_dir) -> DataFrame:
    """Three-slice vectors (3 / 32 / 29 dims) with scores and a year."""
    i = F.col("vec_id")
    return vectors(spark, sf_dir).select(
        i.alias("id"),
        "label",
        F.slice("e", 1, 3).alias("w"),
        F.slice("e", 4, 32).alias("t"),
        F.slice("e", 36, 29).alias("c"),
        "e",
        (((i * 37) % 101) / F.lit(100.0)).alias("act"),
        (((i * 53 + 17) % 101) / F.lit(100.0)).alias("fid"),
        (((i * 29 + 7) % 101) / F.lit(100.0)).alias("clarity"),
        (F.lit(1998) + i % 27).cast("int").alias("year"),
    )


def docs_ann(spark, sf_dir) -> DataFrame:
    docs = texts(spark, sf_dir)
    n = table(spark, sf_dir, "documents").count()
    ref = F.concat(F.lit("["), ((F.col("doc_id") * 7 + 13) % n).cast("string"), F.lit("]"))
    tail = F.replace(_pick(TEMPLATES, F.col("doc_id") % 8), F.lit("[REF]"), ref)
    return docs.select("doc_id", "lang", "source", F.concat("text", F.lit("\n"), tail).alias("text"))


def fs_files(spark, sf_dir) -> DataFrame:
    docs = texts(spark, sf_dir)
    n = table(spark, sf_dir, "documents").count()
    i = F.col("doc_id")
    ext = _pick(SUFFIXES, i % 6)
    parent = F.concat_ws("/", F.lit("/corpus"), "lang", "source")
    body = F.concat(
        F.col("text"),
        F.lit("\nimport doc_"), ((i * 7) % n).cast("string"),
        F.lit("\nsee doc_"), (i + 6).cast("string"), F.lit("\n"),
    )
    return docs.select(
        F.concat(parent, F.lit("/doc_"), i.cast("string"), ext).alias("path"),
        parent.alias("parent"),
        F.concat(F.lit("doc_"), i.cast("string")).alias("stem"),
        ext.alias("ext"),
        _pick(PERMS, i % 3).alias("perms"),
        F.concat(F.lit("user"), ((i % 4)).cast("string")).alias("owner"),
        "lang",
        (F.col("n_chars") * 20000).alias("size"),
        (i % 11 != 0).alias("readable"),
        (i % 5 == 0).alias("executable"),
        (i % 13 == 0).alias("encrypted"),
        (ext == ".gz").alias("compressed"),
        (i % 17 == 0).alias("special_tool"),
        F.when(ext == ".py", body).alias("content"),
    )


def papers(spark, sf_dir) -> DataFrame:
    """part as paper: citation count = its line items, year of its first shipment."""
    return table(spark, sf_dir, "lineitem").groupBy(F.col("l_partkey").alias("paper_id")).agg(
        F.count("*").alias("citation_count"), F.min(F.year("l_shipdate")).alias("year")
    )


def authors(spark, sf_dir) -> DataFrame:
    return table(spark, sf_dir, "lineitem").select(
        F.col("l_partkey").alias("paper_id"), F.col("l_suppkey").alias("author_id")
    ).distinct()


def affil(spark, sf_dir) -> DataFrame:
    s, n = table(spark, sf_dir, "supplier"), table(spark, sf_dir, "nation")
    return s.join(n, s.s_nationkey == n.n_nationkey).select(
        F.col("s_suppkey").alias("author_id"), F.col("n_name").alias("institution_id")
    )


def cites(spark, sf_dir) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    n = docs.count()
    i = F.col("doc_id")
    return (
        docs.select(i.alias("src"), F.explode(F.sequence(F.lit(1), (1 + i % 3).cast("int"))).alias("j"))
        .select("src", ((F.col("src") * 7 + F.col("j") * 13) % n).alias("dst"))
        .where("src <> dst")
        .distinct()
    )


def qhist(spark, sf_dir) -> DataFrame:
    return table(spark, sf_dir, "events").select(
        F.col("user_id").alias("query_id"),
        F.col("ts").alias("run_ts"),
        F.col("event_id"),
        F.col("event_type"),
        F.col("value").alias("avg_conveyance"),
        F.get_json_object("props", "$.k").cast("int").alias("total_results"),
    )


def _lit(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


_TPL = "[" + ", ".join(_lit(t) for t in TEMPLATES) + "]"
_EXT = "[" + ", ".join(_lit(t) for t in SUFFIXES) + "]"
_PRM = "[" + ", ".join(_lit(t) for t in PERMS) + "]"

CTE = {
    "vecs": "vecs AS (SELECT vec_id, label, list_transform(embedding, lambda x: x::DOUBLE) AS e FROM embeddings)",
    "v3": """vecs AS (SELECT vec_id, label, list_transform(embedding, lambda x: x::DOUBLE) AS e FROM embeddings),
v3 AS (SELECT vec_id AS id, label, e[1:3] AS w, e[4:35] AS t, e[36:64] AS c, e,
 ((vec_id*37)%101)/100.0::DOUBLE AS act, ((vec_id*53+17)%101)/100.0::DOUBLE AS fid,
 ((vec_id*29+7)%101)/100.0::DOUBLE AS clarity, (1998 + vec_id%27)::INT AS year FROM vecs)""",
    "docs_ann": f"""docs_ann AS (SELECT doc_id, lang, source, text || chr(10) || replace(({_TPL})[(doc_id % 8 + 1)::INT], '[REF]',
 '[' || ((doc_id*7+13) % (SELECT count(*) FROM documents))::VARCHAR || ']') AS text FROM documents)""",
    "files": f"""files AS (SELECT '/corpus/' || lang || '/' || source || '/doc_' || doc_id || ({_EXT})[(doc_id%6+1)::INT] AS path,
 '/corpus/' || lang || '/' || source AS parent, 'doc_' || doc_id AS stem, ({_EXT})[(doc_id%6+1)::INT] AS ext,
 ({_PRM})[(doc_id%3+1)::INT] AS perms, 'user' || (doc_id%4) AS owner, lang, n_chars*20000 AS size,
 doc_id%11 <> 0 AS readable, doc_id%5 = 0 AS executable, doc_id%13 = 0 AS encrypted,
 doc_id%6 = 5 AS compressed, doc_id%17 = 0 AS special_tool,
 CASE WHEN doc_id%6 = 0 THEN text || chr(10) || 'import doc_' || ((doc_id*7) % (SELECT count(*) FROM documents)) || chr(10)
  || 'see doc_' || (doc_id+6) || chr(10) END AS content FROM documents)""",
    "papers": """papers AS (SELECT l_partkey AS paper_id, count(*) AS citation_count, min(year(l_shipdate))::INT AS year
 FROM lineitem GROUP BY 1)""",
    "authors": "authors AS (SELECT DISTINCT l_partkey AS paper_id, l_suppkey AS author_id FROM lineitem)",
    "affil": """affil AS (SELECT s_suppkey AS author_id, n_name AS institution_id FROM supplier JOIN nation
 ON s_nationkey = n_nationkey)""",
    "cites": """cites AS (SELECT DISTINCT src, dst FROM (SELECT doc_id AS src,
 (doc_id*7 + j*13) % (SELECT count(*) FROM documents) AS dst FROM documents, range(1, 4) r(j) WHERE j <= 1 + doc_id%3) WHERE src <> dst)""",
    "qhist": """qhist AS (SELECT user_id AS query_id, ts AS run_ts, event_id, event_type, value AS avg_conveyance,
 json_extract_string(props, '$.k')::INT AS total_results FROM events)""",
}


def with_ctes(names: list[str], body: str, recursive: bool = False) -> str:
    return f"WITH {'RECURSIVE ' if recursive else ''}" + ",\n".join(CTE[n] for n in names) + "\n" + body
