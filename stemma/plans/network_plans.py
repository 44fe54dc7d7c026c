"""Authors, institutions, the citation network and graph measures."""

from __future__ import annotations

from pyspark.sql import functions as F

from stemma.operators import citations as O
from stemma.operators import graph as G
from stemma.operators import modularity as M
from stemma.plans.registry import Registry
from stemma.session import cut_lineage
from stemma.sources import tables as S
from stemma.sources.tables import with_ctes

R = Registry()

_VEL = "CASE WHEN year > 0 THEN citation_count / greatest(1, 2024 - year)::DOUBLE ELSE 0 END"
_PROF = f""", vel AS (SELECT paper_id, citation_count, year, {_VEL} AS velocity FROM papers),
 sc AS (SELECT author_id, count(*) AS n_papers, avg(velocity) AS score, sum(citation_count) AS citations FROM authors JOIN vel USING (paper_id) GROUP BY 1),
 co AS (SELECT a.author_id, count(DISTINCT b.author_id) - 1 AS n_coauthors FROM authors a JOIN authors b USING (paper_id) GROUP BY 1)
"""


def sql(body):
    return with_ctes(["papers", "authors", "affil"], _PROF + body)


@R.query("author_profile", sql("SELECT author_id, n_papers, n_coauthors, round(score, 6) AS conveyance_score FROM sc JOIN co USING (author_id)"))
def author_profile(spark, sf_dir):
    p = O.author_profiles(S.authors(spark, sf_dir), S.papers(spark, sf_dir))
    return p.select("author_id", "n_papers", "n_coauthors", F.round("conveyance_score", 6).alias("conveyance_score"))


@R.query("author_papers", sql("SELECT author_id, paper_id, round(velocity, 6) AS velocity FROM authors JOIN vel USING (paper_id)"))
def author_papers(spark, sf_dir):
    """The paper list behind each author profile, as rows."""
    v = O.citation_velocity(F.col("citation_count"), F.col("year"))
    papers = S.papers(spark, sf_dir).select("paper_id", F.round(v, 6).alias("velocity"))
    return S.authors(spark, sf_dir).join(papers, "paper_id").select("author_id", "paper_id", "velocity")


@R.query("coauthors", sql("SELECT author_id, n_coauthors FROM co"))
def coauthors(spark, sf_dir):
    """Size of every author's co-author set, from bitmap unions."""
    return O.coauthor_counts(S.authors(spark, sf_dir))


@R.query("top_authors", sql("SELECT author_id, n_papers, round(score, 6) AS conveyance_score FROM sc WHERE n_papers > 2 ORDER BY round(score, 9) DESC, author_id LIMIT 50"))
def top_authors(spark, sf_dir, n: int = 50):
    v = S.papers(spark, sf_dir).select("paper_id", O.citation_velocity(F.col("citation_count"), F.col("year")).alias("velocity"))
    p = S.authors(spark, sf_dir).join(v, "paper_id").groupBy("author_id").agg(F.count("*").alias("n_papers"), F.avg("velocity").alias("score"))
    top = p.where("n_papers > 2").orderBy(F.desc(F.round("score", 9)), "author_id").limit(n)
    return top.select("author_id", "n_papers", F.round("score", 6).alias("conveyance_score"))


@R.query(
    "institution_profile",
    sql("""SELECT institution_id, n_authors, n_papers, total_citations, avg_conveyance FROM (SELECT institution_id, count(*) AS n_authors, sum(citations)::BIGINT AS total_citations, round(avg(score), 6) AS avg_conveyance
 FROM affil JOIN sc USING (author_id) GROUP BY 1) JOIN (SELECT institution_id, count(DISTINCT paper_id) AS n_papers FROM affil JOIN authors USING (author_id) GROUP BY 1) USING (institution_id)"""),
)
def institution_profile(spark, sf_dir):
    p = O.institution_profiles(S.authors(spark, sf_dir), S.affil(spark, sf_dir), S.papers(spark, sf_dir))
    return p.select("institution_id", "n_authors", "n_papers", "total_citations", F.round("avg_conveyance", 6).alias("avg_conveyance"))


@R.query("top_institutions", sql("SELECT institution_id, round(avg(score), 6) AS avg_conveyance, sum(citations)::BIGINT AS total_citations FROM affil JOIN sc USING (author_id) GROUP BY 1 ORDER BY round(avg(score), 9) DESC, institution_id LIMIT 10"))
def top_institutions(spark, sf_dir):
    p = O.institution_profiles(S.authors(spark, sf_dir), S.affil(spark, sf_dir), S.papers(spark, sf_dir))
    top = p.orderBy(F.desc(F.round("avg_conveyance", 9)), "institution_id").limit(10)
    return top.select("institution_id", F.round("avg_conveyance", 6).alias("avg_conveyance"), "total_citations")


@R.query("velocity", sql("SELECT paper_id, citation_count, year, round(velocity, 6) AS velocity FROM vel"))
def velocity(spark, sf_dir):
    v = O.citation_velocity(F.col("citation_count"), F.col("year"))
    return S.papers(spark, sf_dir).select("paper_id", "citation_count", "year", F.round(v, 6).alias("velocity"))


@R.query("top_velocity", sql("SELECT paper_id, round(velocity, 6) AS velocity FROM vel ORDER BY round(velocity, 9) DESC, paper_id LIMIT 10"))
def top_velocity(spark, sf_dir):
    v = S.papers(spark, sf_dir).select("paper_id", O.citation_velocity(F.col("citation_count"), F.col("year")).alias("v"))
    return v.orderBy(F.desc(F.round("v", 9)), "paper_id").limit(10).select("paper_id", F.round("v", 6).alias("velocity"))


@R.query(
    "citation_network",
    with_ctes(["cites"], """, e AS (SELECT src, dst FROM cites UNION SELECT dst + 1, src FROM cites WHERE dst + 1 <> src)
 SELECT src, dst FROM e WHERE src IN (SELECT doc_id FROM labels) AND dst IN (SELECT doc_id FROM labels)"""),
)
def citation_network(spark, sf_dir):
    """Reference lists and cited-by lists merged; both ends must be labelled documents."""
    c = S.cites(spark, sf_dir)
    back = c.select((F.col("dst") + 1).alias("src"), F.col("src").alias("dst")).where("src <> dst")
    return O.citation_network(S.table(spark, sf_dir, "labels").select("doc_id"), c, back)


@R.query(
    "cited_by_caps",
    with_ctes(["cites"], """SELECT dst, src FROM (SELECT *, row_number() OVER (PARTITION BY dst ORDER BY src) AS r FROM cites) WHERE r <= 100"""),
)
def cited_by_caps(spark, sf_dir):
    """First hundred citing papers of each paper, the cap of the cited-by list."""
    return O.capped(S.cites(spark, sf_dir), "dst", "src", 100).select("dst", "src")


@R.query(
    "reference_caps",
    with_ctes(["authors"], """SELECT author_id, paper_id FROM (SELECT *, row_number() OVER (PARTITION BY author_id ORDER BY paper_id) AS r FROM authors) WHERE r <= 50"""),
)
def reference_caps(spark, sf_dir):
    """First fifty entries of each list, the cap the list reader applies."""
    return O.capped(S.authors(spark, sf_dir), "author_id", "paper_id", 50).select("author_id", "paper_id")


def _pagerank_sql(rounds: int = 100) -> str:
    """All rounds written out; the answer is the first whose change is small enough."""
    out = """, n AS (SELECT count(*)::DOUBLE AS n FROM documents), v AS (SELECT doc_id AS id, count(dst) AS deg FROM documents LEFT JOIN cites ON src = doc_id GROUP BY 1),
 r0 AS MATERIALIZED (SELECT id, deg, 1.0 / n AS rank, NULL::DOUBLE AS old FROM v, n)"""
    for i in range(rounds):
        out += f""",
 r{i+1} AS MATERIALIZED (SELECT v.id, v.deg, 0.15::DOUBLE / n.n + 0.85::DOUBLE * (coalesce(s.got, 0) + l.lost / n.n) AS rank, o.rank AS old FROM v JOIN r{i} o USING (id) CROSS JOIN n
 CROSS JOIN (SELECT coalesce(sum(rank) FILTER (deg = 0), 0) AS lost FROM r{i}) l LEFT JOIN (SELECT dst, sum(rank / deg) AS got FROM r{i} JOIN cites ON src = id GROUP BY dst) s ON s.dst = v.id)"""
    every = " UNION ALL ".join(f"SELECT {i} AS k, id, rank, old FROM r{i}" for i in range(1, rounds + 1))
    out += f", a AS MATERIALIZED ({every}), done AS (SELECT min(k) AS k FROM (SELECT k, sum(abs(rank - old)) AS change, count(*) * 1e-6 AS least FROM a GROUP BY k) WHERE change < least)"
    return with_ctes(["cites"], out + "\nSELECT id, round(rank, 9) AS rank FROM a WHERE k = (SELECT k FROM done)")


@R.query("pagerank", _pagerank_sql())
def pagerank(spark, sf_dir):
    docs = S.table(spark, sf_dir, "documents").select("doc_id")
    return G.pagerank(docs, S.cites(spark, sf_dir)).select("id", F.round("rank", 9).alias("rank"))


@R.query(
    "clustering",
    with_ctes(["cites"], """, m AS (SELECT least(src, dst) AS a, greatest(src, dst) AS b, count(*) AS m FROM cites GROUP BY 1, 2),
 w AS (SELECT a AS i, b AS j, m FROM m UNION ALL SELECT b, a, m FROM m),
 t AS (SELECT x.i, sum(x.m * y.m * z.m) AS t FROM w x JOIN w y ON y.i = x.i AND x.j < y.j JOIN w z ON z.i = x.j AND z.j = y.j GROUP BY 1),
 g AS (SELECT i, sum(m) AS total, count(*) FILTER (m = 2) AS bi FROM w GROUP BY 1)
 SELECT doc_id AS id, round(coalesce(t.t / (total * (total - 1) - 2 * bi), 0)::DOUBLE, 9) AS clustering FROM documents LEFT JOIN g ON g.i = doc_id LEFT JOIN t ON t.i = doc_id"""),
)
def clustering(spark, sf_dir):
    docs = S.table(spark, sf_dir, "documents").select("doc_id")
    return G.clustering(docs, S.cites(spark, sf_dir)).select("id", F.round("clustering", 9).alias("clustering"))


def _betweenness_sql(levels: int = 24) -> str:
    """Breadth-first levels forward, dependencies backward, written out level by level."""
    out = ", l0 AS MATERIALIZED (SELECT doc_id AS s, doc_id AS x, 1.0::DOUBLE AS sigma FROM documents)"
    for i in range(1, levels + 1):
        seen = " UNION ALL ".join(f"SELECT s, x FROM l{k}" for k in range(i))
        out += f"""
, l{i} AS MATERIALIZED (SELECT r.* FROM (SELECT s, dst AS x, sum(sigma) AS sigma FROM l{i-1} JOIN cites ON src = x GROUP BY 1, 2) r ANTI JOIN ({seen}) q ON q.s = r.s AND q.x = r.x)"""
    out += f"\n, d{levels} AS MATERIALIZED (SELECT s, x, 0.0::DOUBLE AS delta FROM l{levels})"
    for i in range(levels - 1, 0, -1):
        out += f"""
, d{i} AS MATERIALIZED (SELECT a.s, a.x, coalesce(sum(a.sigma / b.sigma * (1 + b.delta)), 0) AS delta FROM l{i} a LEFT JOIN (SELECT c.src, l.s, l.sigma, d.delta FROM l{i+1} l JOIN d{i+1} d ON d.s = l.s AND d.x = l.x
 JOIN cites c ON c.dst = l.x) b ON b.src = a.x AND b.s = a.s GROUP BY 1, 2)"""
    total = " UNION ALL ".join(f"SELECT x, delta FROM d{i}" for i in range(1, levels + 1))
    return with_ctes(["cites"], out + f"""
, n AS (SELECT count(*)::DOUBLE AS n FROM documents) SELECT doc_id AS id, round(coalesce(b, 0) / ((n - 1) * (n - 2)), 9) AS betweenness FROM documents CROSS JOIN n LEFT JOIN (SELECT x, sum(delta) AS b FROM ({total}) GROUP BY 1) t ON t.x = doc_id""")


@R.query("betweenness", _betweenness_sql())
def betweenness(spark, sf_dir):
    docs = S.table(spark, sf_dir, "documents").select("doc_id")
    return G.betweenness(docs, S.cites(spark, sf_dir)).select("id", F.round("betweenness", 9).alias("betweenness"))


def _communities_sql(source: str, author: str, paper: str, rounds: int = 40) -> str:
    """Rounds written out, more than the tables need: once no label moves, further rounds change nothing."""
    out = f"\n, ap AS (SELECT DISTINCT {author} AS author_id, {paper} AS paper_id FROM {source}), b0 AS MATERIALIZED (SELECT DISTINCT author_id, author_id AS label FROM ap)"
    for i in range(rounds):
        vote = "SELECT {k}, arg_min(label, (-n, label)) AS label FROM (SELECT {k}, label, count(*) AS n FROM ap JOIN {t} USING ({j}) GROUP BY 1, 2) GROUP BY 1"
        free = "x.label" if i < 10 else "least(x.label, b.label)"
        out += f"\n, p{i} AS MATERIALIZED ({vote.format(k='paper_id', t=f'b{i}', j='author_id')})"
        out += f", b{i+1} AS MATERIALIZED (SELECT author_id, {free} AS label FROM ({vote.format(k='author_id', t=f'p{i}', j='paper_id')}) x JOIN b{i} b USING (author_id))"
    return sql(out + f" SELECT label AS community, count(*) AS n_authors, round(avg(score), 6) AS score FROM b{rounds} JOIN sc USING (author_id) GROUP BY 1")


def _scored_communities(spark, sf_dir, members):
    a, p = S.authors(spark, sf_dir), S.papers(spark, sf_dir)
    c = members.join(O.author_profiles_scores(a, p), "author_id")
    out = c.groupBy("community").agg(F.count("*").alias("n_authors"), F.round(F.avg("conveyance_score"), 6).alias("score"))
    return out.orderBy(F.desc("score"), "community")


@R.query("communities", _communities_sql("authors", "author_id", "paper_id"))
def communities(spark, sf_dir):
    """Communities of co-authors with their mean author score, best first."""
    return _scored_communities(spark, sf_dir, O.communities(S.authors(spark, sf_dir)))


@R.query("affiliation_communities", _communities_sql("affil", "author_id", "institution_id"))
def affiliation_communities(spark, sf_dir):
    """Communities of authors by shared institutions."""
    return _scored_communities(spark, sf_dir, O.communities(S.affil(spark, sf_dir), paper="institution_id"))


@R.query(
    "path_chains",
    with_ctes(["cites"], """, k AS (SELECT doc_id, quality, toxic FROM labels),
 p AS (SELECT doc_id AS dst, [doc_id] AS path FROM k WHERE quality = 0 AND toxic = 1 UNION ALL SELECT c.dst, list_append(p.path, c.dst) FROM p JOIN cites c ON c.src = p.dst WHERE len(p.path) <= 4 AND NOT list_contains(p.path, c.dst))
 SELECT array_to_string(path, '>') AS path, (len(path) - 1)::INT AS n_edges FROM p WHERE len(path) > 2 AND dst IN (SELECT doc_id FROM k WHERE quality = 1)""", recursive=True),
)
def path_chains(spark, sf_dir):
    """Simple paths of two to four citations from a toxic low-quality document to one of high quality."""
    k = S.table(spark, sf_dir, "labels")
    starts, goals = k.where("quality = 0 AND toxic = 1").select("doc_id"), k.where("quality = 1").select("doc_id")
    out = G.simple_paths(starts, goals, S.cites(spark, sf_dir), 4)
    return out.select(F.array_join("path", ">").alias("path"), "n_edges")


@R.query(
    "top_betweenness",
    _betweenness_sql().replace("SELECT doc_id AS id, round(coalesce(b, 0)", "SELECT * FROM (SELECT doc_id AS id, round(coalesce(b, 0)") + ") ORDER BY betweenness DESC, id LIMIT 10",
)
def top_betweenness(spark, sf_dir):
    """The ten papers that most shortest citation paths run through."""
    return betweenness(spark, sf_dir).orderBy(F.desc("betweenness"), "id").limit(10)


@R.query(
    "group_modularity",
    with_ctes(["cites"], """, e AS (SELECT DISTINCT least(src, dst) AS a, greatest(src, dst) AS b FROM cites), w AS (SELECT a AS u, b AS v FROM e UNION ALL SELECT b, a FROM e),
 g AS (SELECT 'lang' AS by_, doc_id, lang AS c FROM documents UNION ALL SELECT 'source', doc_id, source FROM documents UNION ALL SELECT 'own', doc_id, doc_id::VARCHAR FROM documents),
 s AS (SELECT x.by_, x.c, count(*)::DOUBLE AS total, count(*) FILTER (x.c = y.c)::DOUBLE AS inside FROM w JOIN g x ON x.doc_id = u JOIN g y ON y.doc_id = v AND y.by_ = x.by_ GROUP BY 1, 2)
 SELECT by_ AS grouping, count(*) AS n_groups, round(sum(inside) / sum(total) - sum(total * total) / (sum(total) * sum(total)), 9) AS modularity FROM s GROUP BY 1"""),
)
def group_modularity(spark, sf_dir):
    """How well languages, sources and single documents divide the citation network, as modularity."""
    docs = S.texts(spark, sf_dir).select("doc_id", "lang", "source")
    arcs = cut_lineage(M.both_ways(S.cites(spark, sf_dir)))
    cited = arcs.select(F.col("u").alias("doc_id")).distinct()
    out = None
    for name, c in (("lang", F.col("lang")), ("source", F.col("source")), ("own", F.col("doc_id").cast("string"))):
        member = docs.select(F.col("doc_id").alias("node"), c.alias("c"))
        q = F.round(F.lit(M.modularity(arcs, member)), 9)
        row = docs.join(cited, "doc_id", "left_semi").agg(F.count_distinct(c).alias("n_groups")).select(F.lit(name).alias("grouping"), "n_groups", q.alias("modularity"))
        out = row if out is None else out.unionByName(row)
    return out


@R.query("modularity_communities")
def modularity_communities(spark, sf_dir):
    """Communities of the citation network by modularity, largest first, with what each adds to it."""
    docs = S.table(spark, sf_dir, "documents").select("doc_id")
    arcs = cut_lineage(M.both_ways(S.cites(spark, sf_dir)))
    member = cut_lineage(M.communities(docs, S.cites(spark, sf_dir)))
    ends = arcs.join(member.select(F.col("node").alias("u"), F.col("community").alias("a")), "u").join(member.select(F.col("node").alias("v"), F.col("community").alias("b")), "v")
    sums = ends.groupBy(F.col("a").alias("community")).agg(F.sum("w").alias("total"), F.sum(F.when(F.col("a") == F.col("b"), F.col("w")).otherwise(0.0)).alias("inside"))
    every = arcs.agg(F.sum("w")).first()[0] or 1.0
    sizes = member.groupBy("community").agg(F.count("*").alias("n_nodes"))
    share = F.col("inside") / every - (F.col("total") / every) ** 2
    return sizes.join(sums, "community", "left").select("community", "n_nodes", F.round(F.coalesce(share, F.lit(0.0)), 9).alias("share")).orderBy(F.desc("n_nodes"), "community")
