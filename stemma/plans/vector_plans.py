"""Vector search, similarity graphs and neighbour graphs over the embeddings table."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from stemma.functions import vectors as V
from stemma.operators import neighbours as NB
from stemma.operators import simjoin
from stemma.plans.registry import Registry
from stemma.session import cut_lineage
from stemma.sources import tables as S
from stemma.sources.tables import with_ctes

R = Registry()

_COS = "(list_dot_product({a},{b}) / (sqrt(list_dot_product({a},{a})) * sqrt(list_dot_product({b},{b}))))"


def cos_sql(a: str, b: str) -> str:
    return _COS.format(a=a, b=b)


def query_vector(df, vec_id: int = 0) -> list[float]:
    """One row, the question asked of the index."""
    return list(df.where(F.col("vec_id") == vec_id).select("e").first()["e"])


_Q0 = "(SELECT e FROM vecs WHERE vec_id = 0)"


@R.query(
    "knn_topk",
    with_ctes(["vecs"], f"SELECT vec_id, label, round({cos_sql('e', _Q0)}, 6) AS score FROM vecs ORDER BY {cos_sql('e', _Q0)} DESC, vec_id LIMIT 10"),
)
def knn_topk(spark, sf_dir, k: int = 10):
    df = S.vectors(spark, sf_dir)
    hits = V.score(df, "e", query_vector(df)).where("score IS NOT NULL").orderBy(F.desc("score"), "vec_id").limit(k)
    return hits.select("vec_id", "label", F.round("score", 6).alias("score"))


@R.query(
    "knn_filtered",
    with_ctes(["vecs"], f"SELECT vec_id, label, round({cos_sql('e', _Q0)}, 6) AS score FROM vecs WHERE label IN (1, 3, 5) ORDER BY {cos_sql('e', _Q0)} DESC, vec_id LIMIT 10"),
)
def knn_filtered(spark, sf_dir, k: int = 10):
    """The predicate runs before the top-k, so k rows come back whenever k rows match."""
    df = S.vectors(spark, sf_dir)
    hits = V.score(df.where(F.col("label").isin(1, 3, 5)), "e", query_vector(df)).where("score IS NOT NULL").orderBy(F.desc("score"), "vec_id").limit(k)
    return hits.select("vec_id", "label", F.round("score", 6).alias("score"))


@R.query(
    "search_lookup",
    with_ctes(["vecs"], f"""SELECT d.doc_id, d.lang, d.source, h.score FROM
 (SELECT vec_id, round({cos_sql('e', _Q0)}, 6) AS score FROM vecs ORDER BY {cos_sql('e', _Q0)} DESC, vec_id LIMIT 10) h
 JOIN documents d ON d.doc_id = h.vec_id"""),
)
def search_lookup(spark, sf_dir):
    """Search ids joined to their documents; ids without a document fall away."""
    hits = knn_topk(spark, sf_dir).select("vec_id", "score")
    docs = S.table(spark, sf_dir, "documents")
    return docs.join(F.broadcast(hits), docs.doc_id == hits.vec_id).select("doc_id", "lang", "source", "score")


@R.query(
    "knn_batch",
    with_ctes(["vecs"], f"""SELECT src, dst, rank::INT AS rank, round(dist, 6) AS dist FROM (
 SELECT a.vec_id AS src, b.vec_id AS dst, round(1 - {cos_sql('a.e', 'b.e')}, 12) AS dist,
 row_number() OVER (PARTITION BY a.vec_id ORDER BY round(1 - {cos_sql('a.e', 'b.e')}, 12), b.vec_id) AS rank
 FROM vecs a JOIN vecs b ON a.vec_id <> b.vec_id) WHERE rank <= 10"""),
)
def knn_batch(spark, sf_dir, k: int = 10):
    out = simjoin.knn(S.vectors(spark, sf_dir), "vec_id", "e", k)
    return out.select("src", "dst", "rank", F.round("dist", 6).alias("dist"))


@R.query(
    "dim_search_sim",
    with_ctes(["vecs"], f"""SELECT vec_id, round(s*0.8, 6) AS where_score, round(s, 6) AS what_score, round(s*0.9, 6) AS conveyance_score,
 round(amp, 6) AS amplified FROM (SELECT vec_id, s, (s*0.8*0.05 + s*0.5 + s*0.9*0.45) * pow(s*0.9, 1.5) AS amp
 FROM (SELECT vec_id, {cos_sql('e', _Q0)} AS s FROM vecs) WHERE s >= 0) ORDER BY amp DESC, vec_id LIMIT 10"""),
)
def dim_search_sim(spark, sf_dir, k: int = 10):
    df = S.vectors(spark, sf_dir)
    f = V.SIMULATED_FACTORS
    s = V.score(df, "e", query_vector(df)).select("vec_id", *[(F.col("score") * f[d]).alias(d) for d in f])
    amp = V.amplified(F.col("where"), F.col("what"), F.col("conveyance"))
    top = s.withColumn("amp", amp).where("amp IS NOT NULL").orderBy(F.desc("amp"), "vec_id").limit(k)
    return top.select("vec_id", *[F.round(d, 6).alias(f"{d}_score") for d in f], F.round("amp", 6).alias("amplified"))


_D3 = "(SELECT e[{}:{}] FROM vecs WHERE vec_id = 0)"


@R.query(
    "dim_search_true",
    with_ctes(["vecs"], f"""SELECT vec_id, round(w, 6) AS where_score, round(t, 6) AS what_score, round(c, 6) AS conveyance_score, round(amp, 6) AS amplified
 FROM (SELECT *, (w*0.05 + t*0.5 + c*0.45) * pow(c, 1.5) AS amp FROM (SELECT vec_id, {cos_sql('e[1:3]', _D3.format(1, 3))} AS w,
 {cos_sql('e[4:35]', _D3.format(4, 35))} AS t, {cos_sql('e[36:64]', _D3.format(36, 64))} AS c FROM vecs) WHERE c >= 0) ORDER BY amp DESC, vec_id LIMIT 10"""),
)
def dim_search_true(spark, sf_dir, k: int = 10):
    df = S.vectors(spark, sf_dir)
    s = V.score(df, "e", query_vector(df), [(0, 3), (3, 35), (35, 64)])
    amp = V.amplified(F.col("score_0"), F.col("score_1"), F.col("score_2"))
    top = s.withColumn("amp", amp).where("amp IS NOT NULL").orderBy(F.desc("amp"), "vec_id").limit(k)
    names = ["where_score", "what_score", "conveyance_score"]
    return top.select("vec_id", *[F.round(f"score_{i}", 6).alias(n) for i, n in enumerate(names)], F.round("amp", 6).alias("amplified"))


_MICRO = "array_to_string(list_transform({}, lambda x: round(x * 1e6, 0)::BIGINT::VARCHAR), ',')"


@R.query(
    "vec_normalize",
    with_ctes(["vecs"], f"""SELECT vec_id, round(n, 6) AS length, {_MICRO.format('list_transform(e, lambda x: x / n)')} AS unit
 FROM (SELECT vec_id, e, sqrt(list_dot_product(e, e)) AS n FROM vecs)"""),
)
def vec_normalize(spark, sf_dir):
    e = F.col("e")
    return S.vectors(spark, sf_dir).select("vec_id", F.round(V.norm(e), 6).alias("length"), V.micro(V.unit(e)).alias("unit"))


@R.query("vec_truncate", with_ctes(["vecs"], f"SELECT vec_id, len(e[1:16])::INT AS dims, {_MICRO.format('e[1:16]')} AS head FROM vecs"))
def vec_truncate(spark, sf_dir):
    p = V.truncate(F.col("e"), 16)
    return S.vectors(spark, sf_dir).select("vec_id", F.size(p).alias("dims"), V.micro(p).alias("head"))


@R.query(
    "vec_metrics",
    with_ctes(["vecs"], f"""SELECT vec_id, round(1 - {cos_sql('e', _Q0)}, 6) AS cosine, round(list_distance(e, {_Q0}), 6) AS euclidean,
 round(list_sum(list_transform(list_zip(e, {_Q0}), lambda z: abs(z[1] - z[2]))), 6) AS manhattan FROM vecs"""),
)
def vec_metrics(spark, sf_dir):
    df = S.vectors(spark, sf_dir)
    q = F.array(*[F.lit(float(x)) for x in query_vector(df)])
    return df.select("vec_id", *[F.round(V.distance(F.col("e"), q, m), 6).alias(m) for m in ("cosine", "euclidean", "manhattan")])


@R.query(
    "vec_concat",
    with_ctes(["v3"], f"SELECT id, len(list_concat(list_concat(w, t), c))::INT AS dims, {_MICRO.format('list_concat(list_concat(c, w), t)')} AS rotated FROM v3"),
)
def vec_concat(spark, sf_dir):
    return S.v3(spark, sf_dir).select("id", F.size(F.concat("w", "t", "c")).alias("dims"), V.micro(F.concat("c", "w", "t")).alias("rotated"))


@R.query(
    "label_centroid",
    with_ctes(["vecs"], """SELECT label, count(*) AS n, string_agg(m, ',' ORDER BY i) AS centroid FROM (SELECT label, i, round(avg(e[i])*1e6, 0)::BIGINT::VARCHAR AS m,
 FROM vecs, range(1, 65) r(i) GROUP BY label, i) JOIN (SELECT label, count(*) AS n FROM vecs GROUP BY label) USING (label) GROUP BY label""").replace("count(*) AS n, string_agg", "any_value(n) AS n, string_agg"),
)
def label_centroid(spark, sf_dir):
    """Coarse centroids: one average per dimension in a single aggregation, no row per coordinate."""
    df = S.vectors(spark, sf_dir)
    d = int(df.select(F.size("e")).first()[0])
    agg = df.groupBy("label").agg(F.count("*").alias("n"), *[F.avg(F.col("e")[i]).alias(f"d{i}") for i in range(d)])
    return agg.select("label", "n", V.micro(F.array(*[f"d{i}" for i in range(d)])).alias("centroid"))


_GEO_PAIRS = f"""pairs AS (SELECT a.id AS src, b.id AS dst, {cos_sql('a.w', 'b.w')} AS sw, {cos_sql('a.t', 'b.t')} AS st, {cos_sql('a.c', 'b.c')} AS sc
 FROM u a JOIN u b ON a.id < b.id)"""


def _geo_sql(cond: str) -> str:
    return with_ctes(["v3"], f""", u AS (SELECT min(id) AS id, count(*) AS copies, w, t, c FROM v3 GROUP BY w, t, c), {_GEO_PAIRS},
 s AS (SELECT *, CASE WHEN sw*st*sc > 0 THEN pow(sw*st*sc, 1.0/3) END AS g FROM pairs)
 SELECT src, dst, round(sw, 6) AS sim_w, round(st, 6) AS sim_t, round(sc, 6) AS sim_c, round(g, 6) AS sim,
 (a.copies*b.copies)::BIGINT AS n_pairs FROM s JOIN u a ON a.id = src JOIN u b ON b.id = dst WHERE {cond}
 UNION ALL SELECT id, id, 1, 1, 1, 1, (copies*(copies-1)/2)::BIGINT FROM u WHERE copies > 1""").replace("FROM vecs)\n,", "FROM vecs),")


def _geo(spark, sf_dir, theta, strict):
    out = simjoin.geometric_pairs(S.v3(spark, sf_dir), "id", ("w", "t", "c"), theta, strict)
    return out.select("src", "dst", *[F.round(c, 6).alias(c) for c in ("sim_w", "sim_t", "sim_c", "sim")], "n_pairs")


@R.query("sim_graph_geo", _geo_sql("g >= 0.4"))
def sim_graph_geo(spark, sf_dir, theta: float = 0.4):
    return _geo(spark, sf_dir, theta, False)


@R.query("sim_graph_layout", _geo_sql("g > 0.35"))
def sim_graph_layout(spark, sf_dir, theta: float = 0.35):
    """Edges that seed the layout: the same maths with a strict threshold."""
    return _geo(spark, sf_dir, theta, True)


@R.query(
    "sim_graph_or",
    with_ctes(["v3"], f""", u AS (SELECT min(id) AS id, count(*) AS copies, t, c FROM v3 GROUP BY t, c),
 s AS (SELECT a.id AS src, b.id AS dst, (a.copies*b.copies)::BIGINT AS n_pairs, {cos_sql('a.t', 'b.t')} AS st, {cos_sql('a.c', 'b.c')} AS sc FROM u a JOIN u b ON a.id < b.id)
 SELECT src, dst, round((st+sc)/2, 6) AS weight, n_pairs FROM s WHERE st > 0.45 OR sc > 0.5
 UNION ALL SELECT id, id, 1, (copies*(copies-1)/2)::BIGINT FROM u WHERE copies > 1""").replace("FROM vecs)\n,", "FROM vecs),"),
)
def sim_graph_or(spark, sf_dir, t1: float = 0.45, t2: float = 0.5):
    out = simjoin.either_pairs(S.v3(spark, sf_dir), "id", "t", "c", t1, t2)
    return out.select("src", "dst", F.round((F.col("sim_1") + F.col("sim_2")) / 2, 6).alias("weight"), "n_pairs")


def _weighted(same_label, products, fid_a, fid_b) -> np.ndarray:
    w = V.DIMENSION_WEIGHTS
    jac = np.where(same_label, 0.0, 1.0 - 1.0 / 3.0)
    return np.round(w["where"] * jac + w["what"] * (1.0 - products) + w["conveyance"] * np.abs(fid_a - fid_b), 12)


def _weighted_cross(a, b) -> np.ndarray:
    same = a["label"].to_numpy()[:, None] == b["label"].to_numpy()[None, :]
    return _weighted(same, V.matrix(a["v"]) @ V.matrix(b["v"]).T, a["fid"].to_numpy()[:, None], b["fid"].to_numpy()[None, :])


def _weighted_rows(a, b, products) -> np.ndarray:
    return _weighted(a["label"].to_numpy() == b["label"].to_numpy(), products, a["fid"].to_numpy(), b["fid"].to_numpy())


# Weighted distance with label chains ['/', label] as WHERE, the whole vector as WHAT, fidelity as CONVEYANCE.
weighted_gap = simjoin.Gap(_weighted_cross, _weighted_rows)


def weighted_tau(d: np.ndarray) -> np.ndarray:
    """WHERE and CONVEYANCE only add to the distance, so the vector part alone must stay within it."""
    return np.arccos(np.clip(1.0 - d / V.DIMENSION_WEIGHTS["what"], -1.0, 1.0))


def weighted_knn(spark, sf_dir, k: int = 10, limits=simjoin.Limits()):
    side = S.v3(spark, sf_dir).where("exists(e, x -> x <> 0)").select("id", V.unit(F.col("e")).alias("v"), "label", "fid")
    return simjoin.nearest(side, side, k, weighted_gap, weighted_tau, limits)


_WDIST = f"""round(0.05*(CASE WHEN a.label = b.label THEN 0.0 ELSE 1 - 1.0/3 END) + 0.5*(1 - {cos_sql('a.e', 'b.e')}) + 0.45*abs(a.fid - b.fid), 12)"""
WKNN_SQL = f""", wd AS (SELECT a.id AS src, b.id AS dst, {_WDIST} AS dist FROM v3 a JOIN v3 b ON a.id <> b.id),
 wk AS (SELECT src, dst, dist FROM (SELECT *, row_number() OVER (PARTITION BY src ORDER BY dist, dst) AS r FROM wd) WHERE r <= 10)"""


def wknn_sql(body: str, more: str = "") -> str:
    return with_ctes(["v3"], WKNN_SQL + more + "\n" + body).replace("FROM vecs)\n,", "FROM vecs),")


@R.query("weighted_distance", wknn_sql("SELECT src, dst, round(dist, 6) AS dist FROM wk"))
def weighted_distance(spark, sf_dir):
    return weighted_knn(spark, sf_dir).select("src", "dst", F.round("dist", 6).alias("dist"))


def chain_distance(a, b) -> np.ndarray:
    """Jaccard distance of directory chains; 1 where a chain is empty, 0.5 where one is unknown.

    Equal chains are folded first, so a block costs a product of its distinct chains over their directories.
    """

    def distinct(chains):
        keys = [None if c is None else tuple(sorted(set(c))) for c in chains]
        number: dict = {}
        return np.array([number.setdefault(k, len(number)) for k in keys], np.int64), list(number)

    at, ua = distinct(a)
    bt, ub = distinct(b)
    names = {d: i for i, d in enumerate(sorted({d for c in (*ua, *ub) for d in c or ()}))}

    def incidence(chains):
        out = np.zeros((len(chains), len(names)), np.float64)
        for i, c in enumerate(chains):
            out[i, [names[d] for d in c or ()]] = 1.0
        return out

    x, y = incidence(ua), incidence(ub)
    both = x @ y.T
    union = x.sum(1)[:, None] + y.sum(1)[None, :] - both
    gap = np.where((x.sum(1) > 0)[:, None] & (y.sum(1) > 0)[None, :], 1.0 - both / np.maximum(union, 1.0), 1.0)
    gap[[c is None for c in ua], :] = 0.5
    gap[:, [c is None for c in ub]] = 0.5
    return gap[at][:, bt]


def chain_cross(a, b) -> np.ndarray:
    """Weighted distance with directory chains as WHERE, the whole vector as WHAT, fidelity as CONVEYANCE."""
    w = V.DIMENSION_WEIGHTS
    what = 1.0 - V.matrix(a["v"]) @ V.matrix(b["v"]).T
    conv = np.abs(a["fid"].to_numpy()[:, None] - b["fid"].to_numpy()[None, :])
    return np.round(w["where"] * chain_distance(a["chain"], b["chain"]) + w["what"] * what + w["conveyance"] * conv, 12)


def _held(chains, names: dict) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Number of each chain among the distinct ones (-1: unknown), and their directories as numbers, one after the other from `start` on."""
    keys = [None if c is None else tuple(sorted(set(c))) for c in chains]
    number: dict = {}
    at = np.array([-1 if k is None else number.setdefault(k, len(number)) for k in keys], np.int64)
    size = np.array([len(k) for k in number], np.int64)
    return at, size, np.cumsum(size) - size, np.array([names.setdefault(d, len(names)) for k in number for d in k], np.int64)


def chain_between(a, b):
    """The distance of numbered rows, and what it is without the chains, which only add to it."""
    names: dict = {}
    (at, size_a, start, held), (bt, size_b, _, held_b) = _held(a["chain"], names), _held(b["chain"], names)
    in_b = np.sort(np.repeat(np.arange(len(size_b)), size_b) * len(names) + held_b)
    fid_a, fid_b, w = a["fid"].to_numpy(), b["fid"].to_numpy(), V.DIMENSION_WEIGHTS

    def least(i, j, products):
        return w["what"] * (1.0 - products) + w["conveyance"] * np.abs(fid_a[i] - fid_b[j])

    def where(i, j):
        gap = np.full(len(i), 0.5)
        known = np.flatnonzero((at[i] >= 0) & (bt[j] >= 0))
        x, y = at[i[known]], bt[j[known]]
        n = size_a[x]
        of = np.repeat(np.arange(len(x)), n)
        key = y[of] * len(names) + held[np.repeat(start[x] - np.cumsum(n) + n, n) + np.arange(len(of))]
        place = np.minimum(np.searchsorted(in_b, key), max(0, len(in_b) - 1))
        both = np.bincount(of, in_b[place] == key, len(x)) if len(of) and len(in_b) else np.zeros(len(x))
        union = n + size_b[y] - both
        gap[known] = np.where((n > 0) & (size_b[y] > 0), 1.0 - both / np.maximum(union, 1.0), 1.0)
        return gap

    def exact(i, j, products):
        return np.round(w["where"] * where(i, j) + w["what"] * (1.0 - products) + w["conveyance"] * np.abs(fid_a[i] - fid_b[j]), 12)

    return exact, least


chain_gap = simjoin.Gap(chain_cross, None, chain_between)


def url_chain(url):
    """Host and folders of a url, the last name left out; empty without a scheme."""
    inner = F.regexp_extract(url, "://([^?#]*)/", 1)
    return F.filter(F.split(inner, "/"), lambda d: d != "")


@R.query(
    "weighted_distance_chains",
    with_ctes(["v3"], """, c AS (SELECT v3.id, e, fid, CASE WHEN url IS NOT NULL THEN list_distinct(list_filter(string_split(regexp_extract(url, '://([^?#]*)/', 1), '/'), lambda d: d <> '')) END AS chain FROM v3 LEFT JOIN pages ON page_id = v3.id),
 g AS (SELECT a.id AS src, b.id AS dst, CASE WHEN a.chain IS NULL OR b.chain IS NULL THEN 0.5 WHEN len(a.chain) = 0 OR len(b.chain) = 0 THEN 1.0
  ELSE 1 - len(list_intersect(a.chain, b.chain))::DOUBLE / (len(a.chain) + len(b.chain) - len(list_intersect(a.chain, b.chain))) END AS w, """
    + f"{cos_sql('a.e', 'b.e')}"
    + """ AS cos, abs(a.fid - b.fid) AS conv FROM c a JOIN c b ON a.id <> b.id),
 d AS (SELECT src, dst, round(0.05*w + 0.5*(1 - cos) + 0.45*conv, 12) AS dist FROM g)
 SELECT src, dst, round(dist, 6) AS dist FROM (SELECT *, row_number() OVER (PARTITION BY src ORDER BY dist, dst) AS r FROM d) WHERE r <= 10""").replace("FROM vecs)\n,", "FROM vecs),"),
)
def weighted_distance_chains(spark, sf_dir, k: int = 10, limits=simjoin.Limits()):
    """Ten nearest nodes under the weighted distance, with the folders of the page of the same number as chain."""
    pages = S.table(spark, sf_dir, "pages").select(F.col("page_id").alias("id"), url_chain(F.col("url")).alias("chain"))
    side = S.v3(spark, sf_dir).where("exists(e, x -> x <> 0)").select("id", V.unit(F.col("e")).alias("v"), "fid").join(pages, "id", "left")
    return simjoin.nearest(side, side, k, chain_gap, weighted_tau, limits).select("src", "dst", F.round("dist", 6).alias("dist"))


def symmetric(edges):
    """Both directions of every neighbour edge, each once; the search behind the edges runs once."""
    ways = F.array(F.struct("src", "dst", "dist"), F.struct(F.col("dst").alias("src"), F.col("src").alias("dst"), "dist"))
    return edges.select(F.inline(ways)).distinct()


@R.query("knn_graph_sym", wknn_sql("SELECT src, dst, round(dist, 6) AS dist FROM (SELECT src, dst, dist FROM wk UNION SELECT dst, src, dist FROM wk)"))
def knn_graph_sym(spark, sf_dir):
    return symmetric(weighted_knn(spark, sf_dir)).select("src", "dst", F.round("dist", 6).alias("dist"))


@R.query(
    "neighbor_context",
    wknn_sql("""SELECT src, dst, rank::INT AS rank, round(dist, 6) AS dist, label, fid AS fidelity FROM (SELECT src, dst, dist,
 row_number() OVER (PARTITION BY src ORDER BY dist, dst) AS rank FROM (SELECT src, dst, dist FROM wk UNION SELECT dst, src, dist FROM wk))
 JOIN v3 ON v3.id = dst WHERE rank <= 5"""),
)
def neighbor_context(spark, sf_dir):
    """The five closest neighbours of each node with type, distance and fidelity."""
    from pyspark.sql import Window

    edges = symmetric(weighted_knn(spark, sf_dir))
    w = Window.partitionBy("src").orderBy("dist", "dst")
    top = edges.withColumn("rank", F.row_number().over(w)).where("rank <= 5")
    nodes = S.v3(spark, sf_dir).select(F.col("id").alias("dst"), "label", F.col("fid").alias("fidelity"))
    return top.join(nodes, "dst").select("src", "dst", "rank", F.round("dist", 6).alias("dist"), "label", "fidelity")


@R.query(
    "local_density",
    wknn_sql("""SELECT src, count(*) AS n, round(any_value(m), 6) AS median_dist, count(*) FILTER (dist < m) AS density FROM
 (SELECT *, median(dist) OVER (PARTITION BY src) AS m FROM (SELECT src, dst, dist FROM wk UNION SELECT dst, src, dist FROM wk)) GROUP BY src"""),
)
def local_density(spark, sf_dir):
    """Neighbours closer than the median neighbour distance."""
    edges = cut_lineage(symmetric(weighted_knn(spark, sf_dir)))
    med = edges.groupBy("src").agg(F.median("dist").alias("m"))
    return edges.join(med, "src").groupBy("src").agg(
        F.count("*").alias("n"), F.round(F.first("m"), 6).alias("median_dist"), F.count_if(F.col("dist") < F.col("m")).alias("density")
    )


@R.query("index_memory", """SELECT count(*) AS n, max(len(embedding))::INT AS dims, round(count(*) * max(len(embedding)) * 4 / 1048576.0::DOUBLE, 6) AS mib FROM embeddings""")
def index_memory(spark, sf_dir):
    e = S.table(spark, sf_dir, "embeddings")
    a = e.agg(F.count("*").alias("n"), F.max(F.size("embedding")).alias("dims"))
    return a.select("n", "dims", F.round(F.col("n") * F.col("dims") * 4 / 1048576.0, 6).alias("mib"))


@R.query(
    "neighbour_graph_grown",
    with_ctes(["vecs"], f""", n AS (SELECT vec_id, e FROM vecs WHERE vec_id % 7 <> 3), p AS (SELECT a.vec_id AS src, b.vec_id AS dst, round(1 - {cos_sql('a.e', 'b.e')}, 12) AS dist FROM n a JOIN n b ON a.vec_id <> b.vec_id)
 SELECT src, dst, round(dist, 6) AS dist FROM (SELECT *, row_number() OVER (PARTITION BY src ORDER BY dist, dst) AS r FROM p) WHERE r <= 10""").replace("FROM vecs)\n,", "FROM vecs),"),
)
def neighbour_graph_grown(spark, sf_dir, k: int = 10, limits=simjoin.Limits()):
    """Ten nearest nodes of a graph built from two thirds of the vectors, grown by the rest and cleared of every seventh."""
    nodes = S.vectors(spark, sf_dir).where("exists(e, x -> x <> 0)").select(F.col("vec_id").alias("id"), V.unit(F.col("e")).alias("v"))
    cosine = NB.Measure(simjoin.cosine_gap, simjoin.cosine_tau)
    g = NB.build(nodes.where("id % 3 <> 1"), k, cosine, limits)
    g = NB.remove(NB.insert(g, nodes.where("id % 3 = 1")), nodes.where("id % 7 = 3").select("id"))
    return NB.edges(g).select("src", "dst", F.round("dist", 6).alias("dist"))
