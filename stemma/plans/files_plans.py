"""File tree, dimensional edges and their queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from stemma.functions import paths as P
from stemma.functions import vectors as V
from stemma.operators import edges as E
from stemma.operators import graph as G
from stemma.operators import ignore as IG
from stemma.plans import dialect as d
from stemma.plans.registry import Registry
from stemma.sources import tables as S
from stemma.sources.tables import with_ctes

R = Registry()

# SQL side: brute force over all pairs.
DIRS = """dirs AS (SELECT DISTINCT path, regexp_replace(path, '/[^/]*$', '') AS parent FROM
 (SELECT '/' || array_to_string((string_split(parent, '/')[2:])[1:k], '/') AS path FROM (SELECT DISTINCT parent FROM files), range(1, 20) r(k)
  WHERE k <= len(string_split(parent, '/')) - 1)),
nodes AS (SELECT path, parent, 'directory' AS node_type FROM dirs UNION ALL SELECT path, parent, 'file' FROM files)"""
PAIRS = """p AS (SELECT a.path AS src, b.path AS dst, a.parent AS parent, a.parent = b.parent AS sibling, a.ext AS ext, a.ext = b.ext AS same_ext, a.stem AS sa, b.stem AS sb,
 a.content AS ca, b.content AS cb, a.perms = b.perms AS same_perms, a.owner = b.owner AS same_owner, a.owner AS owner, a.readable AND b.readable AS both_readable,
 a.encrypted OR b.encrypted AS encrypted, a.compressed OR b.compressed AS compressed, a.special_tool OR b.special_tool AS special_tool,
 (a.size + b.size) / 2 > 100000000 AS large FROM files a JOIN files b ON a.path < b.path),
c AS (SELECT *, CASE WHEN same_owner THEN least(w * 1.1::DOUBLE, 1) ELSE w END AS conv FROM (SELECT *,
 (CASE WHEN same_perms THEN 0.9::DOUBLE WHEN both_readable THEN 0.8::DOUBLE ELSE 0 END)
 * (CASE WHEN encrypted THEN 0.1::DOUBLE ELSE 1 END) * (CASE WHEN compressed THEN 0.8::DOUBLE ELSE 1 END)
 * (CASE WHEN special_tool THEN 0.5::DOUBLE ELSE 1 END) * (CASE WHEN large THEN 0.7::DOUBLE ELSE 1 END) AS w FROM p)),
x AS (SELECT *, CASE WHEN NOT same_ext THEN 0 WHEN ext = '.py' THEN CASE
   WHEN contains(ca, 'import ' || sb) OR contains(ca, 'from ' || sb) OR contains(cb, 'import ' || sa) OR contains(cb, 'from ' || sa) THEN 0.9
   WHEN contains(ca, sb) OR contains(cb, sa) THEN 0.7 ELSE 0.5 END
  WHEN ext IN ('.json', '.yaml', '.yml', '.toml', '.ini') THEN 0.7 WHEN ext IN ('.md', '.rst', '.txt') THEN 0.6 ELSE 0.5 END::DOUBLE AS what FROM c)"""
FILES = ["files"]


def sql(body: str) -> str:
    return with_ctes(FILES, ",\n" + DIRS + ",\n" + PAIRS + "\n" + body).replace("FROM documents)\n,", "FROM documents),")


def files(spark, sf_dir):
    return S.fs_files(spark, sf_dir)


@R.query("fs_dirs", sql("SELECT path, parent, regexp_extract(path, '[^/]*$') AS name, (len(string_split(path, '/')) - 1)::INT AS depth FROM dirs"))
def fs_dirs(spark, sf_dir):
    return E.directories(files(spark, sf_dir)).select("path", "parent", "name", "depth")


@R.query("contains_edges", sql("SELECT n.parent AS src, n.path AS dst, 1.0::DOUBLE AS weight, 'contains' AS relationship FROM nodes n JOIN dirs ON dirs.path = n.parent"))
def contains_edges(spark, sf_dir):
    return E.contains_edges(files(spark, sf_dir))


def where_counts(f):
    inside = E.contains_edges(f).groupBy(F.col("src").alias("parent"), "weight").agg(F.count("*").alias("n_edges"))
    cols = ["relationship", "parent", "weight", "n_edges"]
    return inside.withColumn("relationship", F.lit("contains")).select(*cols).unionByName(
        E.sibling_counts(f).withColumn("relationship", F.lit("sibling")).select(*cols)
    )


@R.query(
    "where_edges",
    sql("""SELECT relationship, parent, weight, count(*) AS n_edges FROM (SELECT 'contains' AS relationship, n.parent, 1.0::DOUBLE AS weight FROM nodes n JOIN dirs ON dirs.path = n.parent
 UNION ALL SELECT 'sibling', a.parent, 0.8::DOUBLE FROM nodes a JOIN nodes b ON a.parent = b.parent AND a.path <> b.path) GROUP BY ALL"""),
)
def where_edges(spark, sf_dir):
    return where_counts(files(spark, sf_dir))


@R.query("what_edges", sql("SELECT ext, what AS weight, count(*) AS n_pairs FROM x WHERE same_ext GROUP BY ALL"))
def what_edges(spark, sf_dir):
    return E.what_counts(files(spark, sf_dir)).select("ext", "weight", F.col("n_pairs"))


@R.query(
    "who_edges",
    sql("""SELECT owner, CASE WHEN same_perms THEN 'same_owner_same_perms' ELSE 'same_owner_diff_perms' END AS relationship,
 CASE WHEN same_perms THEN 1.0 ELSE 0.8 END::DOUBLE AS weight, count(*) AS n_pairs FROM p WHERE same_owner GROUP BY ALL"""),
)
def who_edges(spark, sf_dir):
    return E.who_counts(files(spark, sf_dir)).select("owner", "relationship", "weight", "n_pairs")


_BARRIERS = """array_to_string(list_filter([CASE WHEN encrypted THEN 'encryption' END, CASE WHEN compressed THEN 'compression' END,
 CASE WHEN special_tool THEN 'special_tools' END, CASE WHEN large THEN 'large_size' END], lambda b: b IS NOT NULL), '|')"""


@R.query(
    "conveyance_edges",
    sql(f"""SELECT CASE WHEN same_perms THEN 'same_permissions' WHEN both_readable THEN 'both_readable' ELSE '' END AS relationship, {_BARRIERS} AS barriers, same_owner,
 round(conv, 6) AS weight, count(*) AS n_pairs FROM x WHERE conv > 0.1 GROUP BY ALL"""),
)
def conveyance_edges(spark, sf_dir):
    c = E.conveyance_counts(files(spark, sf_dir))
    return c.groupBy(
        E.conveyance_relationship().alias("relationship"), F.array_join(E.conveyance_barriers(), "|").alias("barriers"), "same_owner", F.round("weight", 6).alias("weight")
    ).agg(F.sum("n_pairs").alias("n_pairs"))


@R.query(
    "composite_edges",
    sql("""SELECT parent, ext, 0.8::DOUBLE AS where_weight, what AS what_weight, round(conv, 6) AS conveyance_weight, round(0.8::DOUBLE * what * conv, 6) AS composite_weight,
 count(*) AS n_pairs FROM x WHERE sibling AND same_ext AND conv > 0.1 GROUP BY ALL"""),
)
def composite_edges(spark, sf_dir):
    c = E.composite_counts(files(spark, sf_dir))
    return c.select(
        "parent", "ext", F.col("where").alias("where_weight"), F.col("what").alias("what_weight"), F.round("conveyance", 6).alias("conveyance_weight"),
        F.round("composite", 6).alias("composite_weight"), "n_pairs",
    )


@R.query(
    "named_files",
    sql("SELECT src, dst, what AS weight FROM x WHERE sibling AND same_ext AND ext = '.py' AND what > 0.5"),
)
def named_files(spark, sf_dir):
    """Sibling Python files that import or name each other, pair by pair."""
    return E.named_siblings(files(spark, sf_dir)).select("src", "dst", F.col("what").alias("weight"))


@R.query(
    "zero_dim_check",
    sql("""SELECT where_active, what_active, conveyance_active, count(*) AS n_pairs, count(*) FILTER (NOT (where_active AND what_active AND conveyance_active) AND w * t * cv <> 0) AS violations FROM
 (SELECT TRUE AS where_active, same_ext AS what_active, conv > 0.1 AS conveyance_active, 0.8 AS w, what AS t, CASE WHEN conv > 0.1 THEN conv ELSE 0 END AS cv FROM x WHERE sibling
 UNION ALL SELECT FALSE, same_ext, conv > 0.1, 0, what, CASE WHEN conv > 0.1 THEN conv ELSE 0 END FROM x WHERE NOT sibling AND (same_ext OR conv > 0.1)
 UNION ALL SELECT TRUE, FALSE, FALSE, 0.8, 0, 0 FROM x WHERE sibling
 UNION ALL SELECT TRUE, FALSE, FALSE, 0.8, 0, 0 FROM nodes a JOIN nodes b ON a.parent = b.parent AND a.path <> b.path AND (a.node_type = 'directory' OR b.node_type = 'directory')
 UNION ALL SELECT TRUE, FALSE, FALSE, 1, 0, 0 FROM nodes n JOIN dirs ON dirs.path = n.parent) GROUP BY 1, 2, 3"""),
)
def zero_dim_check(spark, sf_dir):
    """Pairs of the outer edge set by active dimensions; a product with a zero factor is zero, so none violates."""
    p = E.dimension_pattern(files(spark, sf_dir))
    product = F.col("where_active").cast("int") * F.col("what_active").cast("int") * F.col("conveyance_active").cast("int")
    full = F.col("where_active") & F.col("what_active") & F.col("conveyance_active")
    return p.withColumn("violations", F.when(~full & (product != 0), F.col("n_pairs")).otherwise(F.lit(0).cast("long")))


@R.query(
    "strong_edges_top5",
    sql("""SELECT parent, ext, what AS what_weight, round(conv, 6) AS conveyance_weight, round(0.8::DOUBLE * what * conv, 6) AS composite_weight, count(*) AS n_pairs
 FROM x WHERE sibling AND same_ext AND conv > 0.1 AND 0.8::DOUBLE * what * conv > 0.5 GROUP BY ALL ORDER BY composite_weight DESC, parent, ext, what_weight LIMIT 5"""),
)
def strong_edges_top5(spark, sf_dir):
    """The five strongest kinds of composite edge; members of one kind share one weight."""
    c = composite_edges(spark, sf_dir).where("composite_weight > 0.5").drop("where_weight")
    return c.orderBy(F.desc("composite_weight"), "parent", "ext", "what_weight").limit(5)


@R.query(
    "strong_edges_ends",
    sql("""SELECT src, regexp_extract(src, '[^/]*$') AS src_name, dst, regexp_extract(dst, '[^/]*$') AS dst_name, 0.8::DOUBLE AS where_weight, what AS what_weight,
 round(conv, 6) AS conveyance_weight, round(0.8::DOUBLE * what * conv, 6) AS composite_weight
 FROM x WHERE sibling AND same_ext AND conv > 0.1 AND 0.8::DOUBLE * what * conv > 0.5 ORDER BY composite_weight DESC, parent, ext, what_weight, src, dst LIMIT 5"""),
)
def strong_edges_ends(spark, sf_dir):
    """The five strongest composite edges with both ends."""
    return E.strongest(files(spark, sf_dir), 5)


@R.query(
    "barriers",
    sql("""SELECT regexp_extract(path, '[^/]*$') AS name, path, encrypted, special_tool, readable FROM files WHERE encrypted OR special_tool OR NOT readable ORDER BY path LIMIT 3"""),
)
def barriers(spark, sf_dir):
    f = files(spark, sf_dir).where(F.col("encrypted") | F.col("special_tool") | ~F.col("readable"))
    return f.orderBy("path").limit(3).select(P.name(F.col("path")).alias("name"), "path", "encrypted", "special_tool", "readable")


@R.query(
    "incident_edges",
    sql(""", e AS (SELECT n.parent AS src, n.path AS dst FROM nodes n JOIN dirs ON dirs.path = n.parent)
 SELECT path, node_type, sum(o)::BIGINT AS n_out, sum(i)::BIGINT AS n_in FROM (SELECT src AS path, 1 AS o, 0 AS i FROM e UNION ALL SELECT dst, 0, 1 FROM e) JOIN nodes USING (path) GROUP BY ALL""").replace("FROM c)\n,", "FROM c),"),
)
def incident_edges(spark, sf_dir):
    """Incident edges per node, counted in both roles; a node without edges is left out."""
    f = files(spark, sf_dir)
    return G.incident(E.nodes(f).select("path", "node_type"), E.contains_edges(f), "path").select("path", "node_type", "n_out", "n_in")


@R.query(
    "edge_stats",
    sql("""SELECT coalesce(dimension, 'TOTAL') AS dimension, sum(n)::BIGINT AS n_edges, round(sum(n * w) / sum(n), 6) AS avg_weight FROM (
 SELECT 'WHERE' AS dimension, 1.0::DOUBLE AS w, 1 AS n FROM nodes nn JOIN dirs ON dirs.path = nn.parent
 UNION ALL SELECT 'WHERE', 0.8::DOUBLE, 1 FROM nodes a JOIN nodes b ON a.parent = b.parent AND a.path <> b.path
 UNION ALL SELECT 'WHAT', what, 1 FROM x WHERE same_ext
 UNION ALL SELECT 'WHO', CASE WHEN same_perms THEN 1.0 ELSE 0.8 END::DOUBLE, 1 FROM p WHERE same_owner
 UNION ALL SELECT 'CONVEYANCE', conv, 1 FROM x WHERE conv > 0.1
 UNION ALL SELECT 'COMPOSITE', 0.8::DOUBLE * what * conv, 1 FROM x WHERE sibling AND same_ext AND conv > 0.1) GROUP BY ROLLUP (dimension)"""),
)
def edge_stats(spark, sf_dir):
    f = files(spark, sf_dir)
    flat = E.attributes(f)
    sets = {
        "WHERE": where_counts(flat).select(F.col("weight").alias("w"), F.col("n_edges").alias("n")),
        "WHAT": E.what_counts(f, flat).select(F.col("weight").alias("w"), F.col("n_pairs").alias("n")),
        "WHO": E.who_counts(flat).select(F.col("weight").alias("w"), F.col("n_pairs").alias("n")),
        "CONVEYANCE": E.conveyance_counts(flat).select(F.col("weight").alias("w"), F.col("n_pairs").alias("n")),
        "COMPOSITE": E.composite_counts(f, flat).select(F.col("composite").alias("w"), F.col("n_pairs").alias("n")),
    }
    every = None
    for k, v in sets.items():
        part = v.withColumn("dimension", F.lit(k))
        every = part if every is None else every.unionByName(part)
    return every.rollup("dimension").agg(
        F.sum("n").alias("n_edges"), F.round(F.sum(F.col("n") * F.col("w")) / F.sum("n"), 6).alias("avg_weight")
    ).select(F.coalesce("dimension", F.lit("TOTAL")).alias("dimension"), "n_edges", "avg_weight")


@R.query(
    "edge_update",
    sql("""SELECT n.parent AS src, n.path AS dst, CASE WHEN n.path LIKE '%.py' THEN 1.0::DOUBLE * 1.05::DOUBLE ELSE 1.0::DOUBLE END AS weight,
 CASE WHEN n.path LIKE '%.py' THEN 1 END::INT AS traversal_count FROM nodes n JOIN dirs ON dirs.path = n.parent"""),
)
def edge_update(spark, sf_dir):
    hit = (F.col("relationship") == "contains") & F.endswith("dst", F.lit(".py"))
    return G.update_edges(E.contains_edges(files(spark, sf_dir)), hit, 1.05).select("src", "dst", "weight", "traversal_count")


@R.query(
    "edge_projection",
    sql("""SELECT n.parent AS "from", n.path AS "to", 'contains' AS relationship, 1.0::DOUBLE AS weight FROM nodes n JOIN dirs ON dirs.path = n.parent ORDER BY 1, 2 LIMIT 10"""),
)
def edge_projection(spark, sf_dir):
    e = E.contains_edges(files(spark, sf_dir)).where("weight > 0.8")
    return e.select(F.col("src").alias("from"), F.col("dst").alias("to"), "relationship", "weight").orderBy("from", "to").limit(10)


@R.query(
    "neighbors_any",
    sql("""SELECT node, neighbor, direction, node_type FROM (SELECT n.parent AS node, n.path AS neighbor, 'out' AS direction FROM nodes n JOIN dirs ON dirs.path = n.parent
 UNION ALL SELECT n.path, n.parent, 'in' FROM nodes n JOIN dirs ON dirs.path = n.parent) JOIN nodes m ON m.path = neighbor"""),
)
def neighbors_any(spark, sf_dir):
    f = files(spark, sf_dir)
    both = G.neighbors(E.contains_edges(f))
    n = E.nodes(f).select(F.col("path").alias("neighbor"), "node_type")
    return both.join(n, "neighbor").select("node", "neighbor", "direction", "node_type")


@R.query(
    "traverse_1_3",
    sql(""", e AS (SELECT n.parent AS src, n.path AS dst FROM nodes n JOIN dirs ON dirs.path = n.parent),
 t AS (SELECT dst, 1 AS hops, [src, dst] AS path FROM e WHERE src = '/corpus' UNION ALL SELECT e.dst, hops + 1, list_append(path, e.dst) FROM t JOIN e ON e.src = t.dst WHERE hops < 3)
 SELECT dst, hops::INT AS hops, array_to_string(path, '>') AS path FROM t""").replace("FROM c)\n,", "FROM c),").replace("WITH ", "WITH RECURSIVE ", 1),
)
def traverse_1_3(spark, sf_dir):
    e = E.contains_edges(files(spark, sf_dir))
    start = spark.createDataFrame([("/corpus",)], "node string")
    return G.traverse(start, e, 1, 3).select("dst", "hops", F.array_join("path", ">").alias("path"))


@R.query("key_hash", sql("SELECT path, md5(path) AS key, replace(replace(path, '/', '_'), '.', '_') AS safe FROM files"))
def key_hash(spark, sf_dir):
    p = F.col("path")
    return files(spark, sf_dir).select("path", F.md5(p).alias("key"), P.safe_key(p).alias("safe"))


@R.query(
    "inherited_ctx",
    sql("""SELECT path, array_to_string(list_concat(['/'], string_split(path, '/')[2:-2]), '|') AS components,
 array_to_string(list_transform(string_split(path, '/')[2:-2], lambda x, i: x || ':' || i), '|') AS chain, (len(string_split(path, '/')) - 1)::INT AS structural_depth FROM files"""),
)
def inherited_ctx(spark, sf_dir):
    c = P.inherited_context(F.col("path"))
    chain = F.transform(c["directory_chain"], lambda x: F.concat_ws(":", x["name"], x["level"].cast("string")))
    return files(spark, sf_dir).select(
        "path", F.array_join(c["path_components"], "|").alias("components"), F.array_join(chain, "|").alias("chain"), c["structural_depth"].alias("structural_depth")
    )


_PURPOSE = "list_concat(" * (len(P.PURPOSES) - 1) + "), ".join(
    f"CASE WHEN contains(lower(url), {d.q(k)}) THEN {ts} ELSE []::VARCHAR[] END" + ("" if i == 0 else "") for i, (k, ts) in enumerate(P.PURPOSES.items())
).replace("END), CASE", "END, CASE", 1) + ")"


@R.query("purpose_tags", f"SELECT page_id, array_to_string(list_sort(list_distinct({_PURPOSE})), '|') AS purposes FROM pages")
def purpose_tags(spark, sf_dir):
    return S.table(spark, sf_dir, "pages").select("page_id", F.array_join(F.array_sort(P.purposes(F.col("url"))), "|").alias("purposes"))


@R.query(
    "skip_filters",
    f"""SELECT page_id, len(list_intersect(string_split(url, '/'), {P.IGNORED_COMPONENTS})) > 0 AS ignored, {d.any_word('url', P.SKIPPED_SUBSTRINGS)} AS skipped FROM pages""",
)
def skip_filters(spark, sf_dir):
    u = F.col("url")
    return S.table(spark, sf_dir, "pages").select("page_id", P.ignored(u).alias("ignored"), P.skipped(u).alias("skipped"))


# A sample ignore file at the corpus root: suffix, directory, anchored and name patterns.
IGNORE_RULES = [("*.gz", "/corpus"), ("src1/", "/corpus"), ("/fr/src2/doc_1*", "/corpus"), ("doc_7?.md", "/corpus")]


@R.query(
    "gitignore_filter",
    sql("""SELECT path FROM files WHERE NOT (path LIKE '%.gz' OR contains(path, '/src1/') OR path LIKE '/corpus/fr/src2/doc_1%' OR regexp_matches(path, '/doc_7.\\.md$'))"""),
)
def gitignore_filter(spark, sf_dir):
    return files(spark, sf_dir).where(~P.gitignored(F.col("path"), IGNORE_RULES)).select("path")


_RULE_SQL = """SELECT 'doc_' || doc_id || '?.md' AS pattern, '/corpus' AS dir, '/doc_' || doc_id || '.\\.md(/|$)' AS rx FROM documents WHERE doc_id % 20 = 1
 UNION ALL SELECT '/' || lang || '/' || source || '/doc_' || doc_id || '.*', '/corpus', '^/corpus/' || lang || '/' || source || '/doc_' || doc_id || '\\..*(/|$)' FROM documents WHERE doc_id % 20 = 2
 UNION ALL SELECT 'doc_' || doc_id || '.txt', '/corpus', '/doc_' || doc_id || '\\.txt(/|$)' FROM documents WHERE doc_id % 20 = 3
 UNION ALL SELECT '*_' || doc_id || '.p?', '/corpus', '_' || doc_id || '\\.p.(/|$)' FROM documents WHERE doc_id % 20 = 4"""


@R.query(
    "ignore_rules_rows",
    sql(f"SELECT path FROM files WHERE NOT EXISTS (SELECT 1 FROM ({_RULE_SQL}) r WHERE regexp_matches(path, r.rx))"),
)
def ignore_rules_rows(spark, sf_dir):
    """Files left by a table of rules, whose number grows with the documents."""
    i, docs = F.col("doc_id").cast("string"), S.table(spark, sf_dir, "documents")
    pattern = (
        F.when(F.col("doc_id") % 20 == 1, F.concat(F.lit("doc_"), i, F.lit("?.md")))
        .when(F.col("doc_id") % 20 == 2, F.concat(F.lit("/"), "lang", F.lit("/"), "source", F.lit("/doc_"), i, F.lit(".*")))
        .when(F.col("doc_id") % 20 == 3, F.concat(F.lit("doc_"), i, F.lit(".txt")))
        .when(F.col("doc_id") % 20 == 4, F.concat(F.lit("*_"), i, F.lit(".p?")))
    )
    rules = docs.select(pattern.alias("pattern"), F.lit("/corpus").alias("dir"))
    return IG.kept(files(spark, sf_dir).select("path"), rules)


@R.query(
    "doc_survey",
    sql("""SELECT coalesce(t, 'ALL') AS doc_type, coalesce(lang, 'ALL') AS project, count(*) AS n_files, sum(size)::BIGINT AS bytes FROM
 (SELECT CASE ext WHEN '.py' THEN 'python' WHEN '.md' THEN 'markdown' WHEN '.txt' THEN 'text' WHEN '.json' THEN 'json' WHEN '.yaml' THEN 'yaml' END AS t, lang, size FROM files WHERE ext <> '.gz') GROUP BY ROLLUP (t, lang)"""),
)
def doc_survey(spark, sf_dir):
    f = files(spark, sf_dir).select(P.lookup(F.lower("ext"), P.SURVEY_TYPES, "").alias("t"), "lang", "size").where("t <> ''")
    out = f.rollup("t", "lang").agg(F.count("*").alias("n_files"), F.sum("size").alias("bytes"))
    return out.select(F.coalesce("t", F.lit("ALL")).alias("doc_type"), F.coalesce("lang", F.lit("ALL")).alias("project"), "n_files", "bytes")


@R.query(
    "loader_dispatch",
    sql("""SELECT path, CASE ext WHEN '.py' THEN 'python' WHEN '.md' THEN 'markdown' WHEN '.txt' THEN 'text' WHEN '.json' THEN 'json' ELSE 'none' END AS loader,
 CASE ext WHEN '.py' THEN 'python' WHEN '.md' THEN 'markdown' WHEN '.txt' THEN 'text' ELSE 'unknown' END AS doc_type FROM files"""),
)
def loader_dispatch(spark, sf_dir):
    e = P.suffix(F.col("path"))
    return files(spark, sf_dir).select("path", P.loader(e).alias("loader"), P.document_type(e).alias("doc_type"))


@R.query(
    "where_vector",
    sql("""SELECT path, round(1 / l * len(string_split(path, '/')), 6) AS depth_part, 102::INT AS dims, 1::INT AS nonzero FROM (SELECT path, len(string_split(path, '/'))::DOUBLE AS l FROM files)"""),
)
def where_vector(spark, sf_dir):
    from stemma.functions.vectors import where_vector as wv

    v = files(spark, sf_dir).select("path", wv(F.col("path")).alias("v"))
    return v.select("path", F.round(F.get("v", F.lit(0)), 6).alias("depth_part"), F.size("v").alias("dims"), F.size(F.filter("v", lambda x: x != 0)).alias("nonzero"))


@R.query(
    "path_overlap",
    with_ctes(["cites"], """, ch AS (SELECT doc_id, list_filter(string_split('/corpus/' || lang || '/' || source, '/'), lambda x: x <> '') AS c FROM documents)
 SELECT src, dst, round(1 - len(list_intersect(a.c, b.c)) / (len(a.c) + len(b.c) - len(list_intersect(a.c, b.c)))::DOUBLE, 6) AS distance FROM cites JOIN ch a ON a.doc_id = src JOIN ch b ON b.doc_id = dst"""),
)
def path_overlap(spark, sf_dir):
    """Distance of the two ends of each citation by the directories they share."""
    docs = S.table(spark, sf_dir, "documents")
    chain = docs.select("doc_id", P.parts(F.concat_ws("/", F.lit("/corpus"), "lang", "source")).alias("c"))
    j = S.cites(spark, sf_dir).join(chain.select(F.col("doc_id").alias("src"), F.col("c").alias("a")), "src").join(chain.select(F.col("doc_id").alias("dst"), F.col("c").alias("b")), "dst")
    return j.select("src", "dst", F.round(V.path_distance(F.col("a"), F.col("b")), 6).alias("distance"))


@R.query("sibling_counts", sql("SELECT a.parent, 0.8::DOUBLE AS weight, count(*) AS n_edges FROM nodes a JOIN nodes b ON a.parent = b.parent AND a.path <> b.path GROUP BY 1"))
def sibling_counts(spark, sf_dir):
    return E.sibling_counts(files(spark, sf_dir))
