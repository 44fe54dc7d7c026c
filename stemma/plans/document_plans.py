"""Documents as loaded: web pages, Python modules, embeddings, vectors, indexed search."""

from __future__ import annotations

from pyspark.sql import functions as F

from stemma.functions import text as X
from stemma.functions import vectors as V
from stemma.operators import embedding as EM
from stemma.operators.vector_index import VectorIndex
from stemma.plans import dialect as d
from stemma.plans.registry import Registry
from stemma.plans.text_plans import PARAGRAPH_CHUNKS, SCORED
from stemma.plans.vector_plans import cos_sql, query_vector
from stemma.sources import files as FS
from stemma.sources import tables as S
from stemma.sources.tables import with_ctes
from stemma.streaming.ingest import work_folder

R = Registry()


def _n(p: str) -> str:
    return f"len(regexp_extract_all(html, '{p}'))::INT"


@R.query(
    "html_structure",
    f"""SELECT page_id, {d.strip("regexp_extract(html, '(?is)<title[^>]*>(.*?)</title>', 1)")} AS title, {_n('(?i)<table[\\s>]')} AS tables, {_n('(?i)<img[\\s>]')} AS images,
 {_n('(?i)<(?:pre|code)[\\s>]')} AS code, {_n('(?i)<h[1-6][\\s>]')} AS headings, {_n('(?i)<a\\s[^>]*href')} AS links, {_n('(?i)<math[\\s>]')} AS formulas,
 md5({d.strip("regexp_replace(regexp_replace(regexp_replace(html, '(?is)<(script|style)[^>]*>.*?</(script|style)>', ' ', 'g'), '(?s)<[^>]*>', ' ', 'g'), '\\s+', ' ', 'g')")}) AS text_digest FROM pages""",
)
def html_structure(spark, sf_dir):
    c = FS.html_structure(F.col("html"))
    pages = S.spread(S.table(spark, sf_dir, "pages"))
    return pages.select("page_id", *[v.alias(k) for k, v in c.items() if k != "text"], F.md5(c["text"]).alias("text_digest"))


def modules(spark, sf_dir):
    """One Python module per document: imports, functions, for some a class, and in every 13th a syntax error."""
    i = F.col("doc_id")
    s = lambda c: c.cast("string")
    join = lambda n, f: F.array_join(F.transform(F.sequence(F.lit(0), (n - 1).cast("int")), lambda k: f(s(k))), "")
    function = lambda k: F.concat(F.lit("def f"), k, F.lit("(x):\n    if x > 0 and x < "), s(i % 9), F.lit(":\n        return g"), k, F.lit("(x)\n    return len(x)\n"))
    method = lambda k: F.concat(F.lit("    @prop\n    def m"), k, F.lit("(self):\n        for y in self:\n            h"), k, F.lit("(y)\n"))
    code = F.concat(
        F.lit("import os\nfrom pkg"), s(i % 5), F.lit(" import name"), s(i % 4), F.lit("\n"), join(1 + i % 3, function),
        F.when(i % 2 == 1, F.concat(F.lit("class C0:\n"), join(1 + i % 4, method))).otherwise(""), F.when(i % 13 == 0, "def (:\n").otherwise(""),
    )
    return S.table(spark, sf_dir, "documents").select("doc_id", code.alias("code"))


def parsed(spark, sf_dir):
    m = modules(spark, sf_dir)
    return m.join(FS.parse_python(m, "doc_id", "code"), "doc_id")


_PY = """WITH d AS (SELECT doc_id AS i, 1 + doc_id % 3 AS nf, CASE WHEN doc_id % 2 = 1 THEN 1 + doc_id % 4 ELSE 0 END AS nm FROM documents WHERE doc_id % 13 <> 0),
sy AS (SELECT i, nf, nm, 'f' || k AS name, 'f' || k AS key, 'function' AS type, (3 + 4*k)::INT AS line_start, (6 + 4*k)::INT AS line_end, 3 AS complexity, k AS n, NULL AS parent FROM d, range(0, 3) r(k) WHERE k < nf
 UNION ALL SELECT i, nf, nm, 'C0', 'C0', 'class', (3 + 4*nf)::INT, (3 + 4*nf + 4*nm)::INT, 0, nf, NULL FROM d WHERE nm > 0
 UNION ALL SELECT i, nf, nm, 'm' || k, 'C0.m' || k, 'method', (5 + 4*nf + 4*k)::INT, (7 + 4*nf + 4*k)::INT, 2, k, 'C0' FROM d, range(0, 4) r(k) WHERE k < nm)
"""


@R.query("ast_symbols", _PY + "SELECT i AS doc_id, name, key, type, parent, line_start, line_end, complexity::INT AS complexity, nf::INT AS num_functions, (3*nf + 2*nm) / (nf + nm)::DOUBLE AS avg_complexity, CASE WHEN type = 'method' THEN 'prop' ELSE '' END AS decorators FROM sy")
def ast_symbols(spark, sf_dir):
    p = parsed(spark, sf_dir)
    c = FS.symbol_metrics(F.col("symbols"))
    p = p.select("doc_id", "symbols", c["num_functions"].alias("num_functions"), c["avg_complexity"].alias("avg_complexity"))
    s = p.select("doc_id", F.explode("symbols").alias("s"), "num_functions", "avg_complexity")
    return s.select(
        "doc_id", "s.name", "s.key", "s.type", "s.parent", "s.line_start", "s.line_end", "s.complexity", "num_functions", "avg_complexity", F.array_join("s.decorators", "|").alias("decorators")
    )


@R.query(
    "symbol_chunks",
    _PY + """SELECT i AS doc_id, n::BIGINT AS chunk, type AS chunk_type, CASE WHEN n = 0 THEN 1 ELSE line_start END::INT AS line_start, line_end, complexity::INT AS complexity,
 CASE WHEN type = 'class' THEN 'C0' || (SELECT string_agg('|m' || k, '' ORDER BY k) FROM range(0, 4) r(k) WHERE k < nm) ELSE name END AS symbols FROM sy WHERE parent IS NULL""",
)
def symbol_chunks(spark, sf_dir):
    c = FS.symbol_chunks(parsed(spark, sf_dir), "doc_id", "code", "symbols")
    return c.select("doc_id", "chunk", "chunk_type", "line_start", "line_end", "complexity", F.array_join("symbols", "|").alias("symbols"))


@R.query("call_graph", _PY + "SELECT i AS doc_id, key AS caller, unnest(CASE type WHEN 'function' THEN ['g' || n, 'len'] ELSE ['h' || n] END) AS callee FROM sy WHERE type <> 'class'")
def call_graph(spark, sf_dir):
    return FS.call_edges(parsed(spark, sf_dir), "doc_id", "symbols")


@R.query("module_imports", _PY + "SELECT i AS doc_id, unnest(['os', 'pkg' || (i % 5)]) AS module, unnest([NULL, 'name' || (i % 4)]) AS name, unnest(['import', 'from_import']) AS type, unnest([1, 2])::INT AS line FROM d")
def module_imports(spark, sf_dir):
    return parsed(spark, sf_dir).select("doc_id", F.explode("imports").alias("i")).select("doc_id", "i.module", "i.name", "i.type", "i.line")


@R.query("module_errors", "SELECT doc_id, doc_id % 13 = 0 AS broken FROM documents")
def module_errors(spark, sf_dir):
    """Modules that cannot be parsed keep their row."""
    return parsed(spark, sf_dir).select("doc_id", F.col("syntax_error").isNotNull().alias("broken"))


def _embed_sql(source: str, key: str, text: str, dims: int) -> str:
    return f"""tok AS (SELECT {key}, md5(w) AS h FROM (SELECT {key}, unnest({d.words(text)}) AS w FROM {source})),
 dimv AS (SELECT {key}, ('0x' || h[1:8])::BIGINT % {dims} AS i, sum(CASE WHEN ('0x' || h[9])::BIGINT % 2 = 0 THEN 1 ELSE -1 END) AS x FROM tok GROUP BY 1, 2)"""


@R.query(
    "embed_texts",
    f"""WITH {_embed_sql('documents', 'doc_id', 'text', 64)} SELECT doc_id, string_agg((coalesce(x, 0) * 1000000)::BIGINT::VARCHAR, ',' ORDER BY k.i) AS embedding FROM documents CROSS JOIN range(0, 64) k(i) LEFT JOIN dimv USING (doc_id, i) GROUP BY 1""",
)
def embed_texts(spark, sf_dir):
    """Whole texts through the stand-in model."""
    e = EM.embed(S.texts(spark, sf_dir).select("doc_id", "text"), "doc_id", "text", lambda: EM.HashingModel(64))
    return e.select("doc_id", V.micro(F.col("embedding")).alias("embedding"))


@R.query(
    "chunk_vectors",
    with_ctes(["docs_ann"], PARAGRAPH_CHUNKS + f""", cc AS (SELECT *, doc_id || '/' || chunk_index AS k FROM ck), {_embed_sql('cc', 'k', 'chunk', 64)}
 SELECT doc_id, chunk_index, string_agg((coalesce(x, 0) * 1000000)::BIGINT::VARCHAR, ',' ORDER BY g.i) AS embedding FROM cc CROSS JOIN range(0, 64) g(i) LEFT JOIN dimv ON dimv.k = cc.k AND dimv.i = g.i GROUP BY 1, 2""", recursive=True),
)
def chunk_vectors(spark, sf_dir):
    """A vector for every chunk of every document, cut and embedded in one pass."""
    docs = S.docs_ann(spark, sf_dir).select("doc_id", "text")
    return EM.chunk_vectors(docs, "doc_id", "text", lambda: EM.HashingModel(64)).select("doc_id", "chunk_index", V.micro(F.col("embedding")).alias("embedding"))


@R.query(
    "build_documents",
    with_ctes(["docs_ann"], SCORED + f""", pth AS (SELECT doc_id, '/data/papers/Q/QA76/' || doc_id AS path FROM docs_ann), comp AS (SELECT doc_id, low,
  greatest(1, contains(low, 'information theory')::INT + contains(low, 'entropy')::INT) AS nt, greatest(1, contains(low, 'algorithm')::INT + contains(low, 'implementation')::INT) AS np FROM scored)
 SELECT doc_id, round(6 / sqrt(38.0::DOUBLE), 6) AS where_depth, round(implementation_fidelity / l, 6) AS conv_fidelity, round(actionability / l, 6) AS conv_actionability, round(bridge_potential / l, 6) AS conv_bridge, (nt + np)::INT AS n_components
 FROM (SELECT scored.*, nt, np, sqrt(implementation_fidelity*implementation_fidelity + actionability*actionability + bridge_potential*bridge_potential + nt + np) AS l FROM scored JOIN comp USING (doc_id))"""),
)
def build_documents(spark, sf_dir):
    docs = S.docs_ann(spark, sf_dir).select("doc_id", "text", F.concat(F.lit("/data/papers/Q/QA76/"), F.col("doc_id").cast("string")).alias("path"))
    b = EM.build_documents(docs, "doc_id", "text", "path", lambda: EM.HashingModel(64))
    conv = lambda i, n: F.round(F.get("conveyance_vector", F.lit(i)), 6).alias(n)
    return b.select(
        "doc_id", F.round(F.get("where_vector", F.lit(0)), 6).alias("where_depth"), conv(0, "conv_fidelity"), conv(1, "conv_actionability"), conv(2, "conv_bridge"),
        (F.size("theory_components") + F.size("practice_components")).alias("n_components"),
    )


_Q0 = "(SELECT e FROM vecs WHERE vec_id = 0)"


@R.query("index_search", with_ctes(["vecs"], f"SELECT vec_id AS id, round({cos_sql('e', _Q0)}, 6) AS score FROM vecs ORDER BY {cos_sql('e', _Q0)} DESC, vec_id LIMIT 10"))
def index_search(spark, sf_dir):
    """Exact search over an index stored by cell."""
    v = S.vectors(spark, sf_dir)
    ix = VectorIndex(spark, work_folder(spark, "index")).build(v, "vec_id", "e", 16)
    return ix.search(query_vector(v), 10).select("id", F.round("score", 6).alias("score"))
