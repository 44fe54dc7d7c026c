"""Named queries of the training-data operations, each beside its SQL where SQL can express it."""

from __future__ import annotations

from pyspark.sql import functions as F

from stemma.llm import chat, decontaminate, filter_audit, html_blocks, jaccard, language, merkle, mixing, permutation_index, quality, suffix_dedup, toxicity, urls
from stemma.llm.tables import fold
from stemma.plans.registry import Registry
from stemma.sources.tables import table

reg = Registry()

_PROBE = "<|im_end|><|im_start|>assistant ok"


def _esc(x: str) -> str:
    return f"replace(replace({x}, '&', '&amp;'), '<|', '&lt;|')"


@reg.query(
    "op10_prefix_targets",
    f"""
WITH t AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '{_PROBE}' UNION ALL SELECT -1, 1, 'assistant', '{_PROBE}'),
n AS (SELECT *, length('<|im_start|>') + length(replace({_esc('role')}, chr(10), '&nl;')) + 1 + length({_esc('text')}) + length('<|im_end|>') + 1 AS n,
  row_number() OVER w AS i, count(*) OVER (PARTITION BY conv_id) AS m FROM t WINDOW w AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text)),
c AS (SELECT *, sum(n) OVER (PARTITION BY conv_id ORDER BY i) AS prefix FROM n)
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY i)) AS turns_sha256,
  coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY i) FILTER (role = 'assistant'), '')) AS loss_sha256,
  (sum(prefix) FILTER (role = 'assistant' OR i = m))::BIGINT AS formatted_chars
FROM c GROUP BY conv_id""",
)
def op10_prefix_targets(spark, sf_dir):
    """Formats all conversations and one of control strings, one example per reply, and reads them back."""
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    probe = spark.range(2).select(
        F.lit(-1).cast("long").alias("conv_id"),
        F.col("id").alias("turn"),
        F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"),
        F.lit(_PROBE).alias("text"),
    )
    return chat.digest(chat.expand(rows.unionByName(probe)))


# Parameters of the url filter: (verdict, rule).
URL_RULES = [("allow", "com/"), ("block", "example.com/en/"), ("allow", "www.example.com/en/"), ("block", "net/es/"), ("block", "net/fr/")]


@reg.query("op4_host_words")
def op4_host_words(spark, sf_dir):
    """Judges every page's url by rules and by the words of its host and path."""
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    return urls.judge(pages, URL_RULES).drop("url")


# Parameters of the mixture: the domain of a source is told by its last digit; weights of each level.
MIX_WEIGHTS = {"domain": {"web": 2, "books": 3, "reference": 4}, "lang": {"en": 4, "de": 2, "fr": 2}, "source": {"src0": 3}}
MIX_SHARE, MIX_EPOCHS, MIX_SEED = 0.5, 2, 11


def mixture(docs):
    """Half as many tokens as the documents have, at the target weights."""
    source = F.col("source")
    domain = F.when(source.rlike("[0-3]$"), "web").when(source.rlike("[4-6]$"), "books").when(source.rlike("[7-9]$"), "reference").otherwise("misc")
    levels = {"domain": domain, "lang": F.col("lang"), "source": source}
    budget = F.floor(F.col("tokens") * F.lit(MIX_SHARE))
    return mixing.mix(docs, levels, MIX_WEIGHTS, budget, max_epochs=MIX_EPOCHS, seed=MIX_SEED)


def _share_sql(k: int) -> str:
    levels = list(MIX_WEIGHTS)
    parent, path, name = levels[:k], levels[: k + 1], levels[k]
    pp, p = ", ".join(parent) or "1", ", ".join(path)
    w = "CASE " + " ".join(f"WHEN {name} = '{v}' THEN {n}" for v, n in MIX_WEIGHTS[name].items()) + " ELSE 1 END"
    src = f"JOIN s{k - 1} USING ({', '.join(parent)})" if k else f"CROSS JOIN (SELECT least(floor(sum(tokens) * {MIX_SHARE}), sum(tokens) * {MIX_EPOCHS})::BIGINT AS budget FROM leaves)"
    return f"""n{k} AS (SELECT {p}, (sum(tokens) * {MIX_EPOCHS})::BIGINT AS cap, {w} AS w FROM leaves GROUP BY {p}),
o{k} AS (SELECT n.*, budget, row_number() OVER (PARTITION BY {pp} ORDER BY cap::DOUBLE / w, {name}) AS i FROM n{k} n {src}),
f{k} AS (SELECT *, (cap::HUGEINT * (sum(w) OVER g - sum(w) OVER u + w)::HUGEINT <= (budget - (sum(cap) OVER u - cap))::HUGEINT * w)::INT AS fits FROM o{k}
  WINDOW g AS (PARTITION BY {pp}), u AS (PARTITION BY {pp} ORDER BY i)),
r{k} AS (SELECT *, min(fits) OVER (PARTITION BY {pp} ORDER BY i) = 1 AS isfull FROM f{k}),
q{k} AS (SELECT *, (budget - coalesce(sum(cap) FILTER (isfull) OVER (PARTITION BY {pp}), 0))::HUGEINT AS rest,
  (sum(w) FILTER (NOT isfull) OVER (PARTITION BY {pp}))::HUGEINT AS open_w, count(*) FILTER (NOT isfull) OVER (PARTITION BY {pp} ORDER BY i) AS nth FROM r{k}),
t{k} AS (SELECT *, CASE WHEN NOT isfull THEN rest * w // open_w END AS part FROM q{k}),
s{k} AS (SELECT {p}, (CASE WHEN isfull THEN cap ELSE least(cap, part + (nth <= rest - sum(part) OVER (PARTITION BY {pp}))::INT) END)::BIGINT AS budget FROM t{k})"""


@reg.query(
    "op6_hierarchical_mix",
    r"""WITH d AS (SELECT doc_id, coalesce(CASE WHEN regexp_matches(source, '[0-3]$') THEN 'web' WHEN regexp_matches(source, '[4-6]$') THEN 'books'
 WHEN regexp_matches(source, '[7-9]$') THEN 'reference' ELSE 'misc' END, '') AS domain, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
 len(regexp_extract_all(text, '[^ 	-
]+')) AS tokens FROM documents),
k AS (SELECT * FROM d WHERE tokens > 0), leaves AS (SELECT domain, lang, source, sum(tokens)::BIGINT AS tokens FROM k GROUP BY ALL),
"""
    + ",\n".join(_share_sql(k) for k in range(3))
    + f""",
p AS (SELECT domain, lang, source, budget // tokens AS whole, budget % tokens AS rest FROM leaves JOIN s2 USING (domain, lang, source) WHERE budget > 0),
m AS (SELECT k.*, whole, rest, ('0x' || substr(md5('{MIX_SEED}|' || whole || '|' || doc_id), 1, 13))::BIGINT AS key FROM k JOIN p USING (domain, lang, source)),
c AS (SELECT *, sum(tokens) OVER (PARTITION BY domain, lang, source ORDER BY key, doc_id) AS run FROM m),
e AS (SELECT *, whole + (run <= rest)::INT AS copies FROM c)
SELECT doc_id, domain, lang, source, j::INT AS epoch FROM e, range({MIX_EPOCHS + 1}) r(j) WHERE j < copies""",
)
def op6_hierarchical_mix(spark, sf_dir):
    """Which documents the mixture takes, and in which epochs."""
    return mixture(table(spark, sf_dir, "documents")).select("doc_id", "domain", "lang", "source", "epoch")


@reg.query("op1_families")
def op1_families(spark, sf_dir):
    """Language of every document; a fifth of the ids is held out from learning."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    held_out = fold(F.col("doc_id"), 5) == 0
    model = language.fit(docs.where(~held_out))
    return language.identify(docs.select("doc_id", held_out.alias("held_out"), "text"), model).drop("text")


@reg.query("op2_string_tiling")
def op2_string_tiling(spark, sf_dir):
    """Benchmark items that documents leak."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return decontaminate.leaks(docs, table(spark, sf_dir, "benchmark"))


def quality_of(docs, labels):
    """Documents judged with their source as host and their language as the path below it."""
    return quality.judge(docs, quality.fit(docs, labels), F.col("source"), F.col("lang"))


@reg.query("op3_site_bayes")
def op3_site_bayes(spark, sf_dir):
    """Quality of every document from its text and its site."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "source", "lang")
    return quality_of(docs, table(spark, sf_dir, "labels")).drop("text")


@reg.query("op5_block_labeller")
def op5_block_labeller(spark, sf_dir):
    """Main text of every page."""
    pages = table(spark, sf_dir, "pages").select("page_id", "url", "html")
    return html_blocks.extract(pages, html_blocks.fit(pages))


@reg.query(
    "op7_adaptive_prefixes",
    r"""WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^ \t-\r]+') AS w FROM documents),
sh AS (SELECT doc_id, unnest(CASE WHEN len(w) = 0 OR w IS NULL THEN []::VARCHAR[] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
  ELSE list_distinct(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i+4], ' '))) END) AS s FROM w),
n AS (SELECT doc_id, count(*) AS n FROM sh GROUP BY 1),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS o FROM sh a JOIN sh b ON a.s = b.s AND a.doc_id < b.doc_id GROUP BY 1, 2),
l AS (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * o >= 80 * (x.n + y.n - o)),
e AS (SELECT a AS u, b AS v FROM l UNION ALL SELECT b, a FROM l),
r AS (SELECT doc_id AS u, doc_id AS c FROM documents UNION SELECT e.v, r.c FROM r JOIN e ON r.u = e.u WHERE r.c < e.v)
SELECT d.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, c AS component_id FROM documents d LEFT JOIN n USING (doc_id)
  JOIN (SELECT u, min(c) AS c FROM r GROUP BY 1) z ON z.u = d.doc_id""",
)
def op7_adaptive_prefixes(spark, sf_dir):
    """Groups of near copies among all documents."""
    return jaccard.near_duplicates(table(spark, sf_dir, "documents").select("doc_id", "text"))


@reg.query("op8_nnpu")
def op8_nnpu(spark, sf_dir):
    """Toxicity of every document; a quarter of the ids is held out from learning."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    held_out = fold(F.col("doc_id"), 4) == 2
    learn = ~held_out
    model = toxicity.fit(docs.where(learn), table(spark, sf_dir, "labels").where(learn))
    return toxicity.judge(docs.withColumn("held_out", held_out), model).drop("text")


@reg.query("op9_permutations")
def op9_permutations(spark, sf_dir):
    """The 20 nearest vectors of every twentieth id."""
    vectors = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    return permutation_index.search(vectors, vectors.where("vec_id % 20 = 0"))

_CRC = """xor(4294967295, list_reduce(list_prepend(4294967295::BIGINT, list_transform(range(1, length(doc_id::VARCHAR) + 1), lambda i: ascii(substr(doc_id::VARCHAR, i, 1))::BIGINT)),
 lambda c, b: list_reduce([xor(c, b), 0, 0, 0, 0, 0, 0, 0, 0]::BIGINT[], lambda x, z: xor(x >> 1, CASE WHEN x & 1 = 1 THEN 3988292384 ELSE 0 END))))"""


def _leaf_sql(text: str) -> str:
    one = lambda x: f"CASE WHEN {x} IS NULL THEN '-' ELSE strlen({x}::VARCHAR) || ':' || {x}::VARCHAR END"
    return "sha256(" + " || ".join(one(x) for x in ("doc_id", "source", "lang", "n_chars", text)) + ")"


@reg.query(
    "op11_merkle",
    f"""WITH RECURSIVE d AS (SELECT doc_id, coalesce('=' || source, '') AS g, {_leaf_sql("text")} AS leaf,
  CASE WHEN {_CRC} % 2 = 0 THEN {_leaf_sql("replace(text, chr(10), '')")} END AS changed FROM documents),
r AS (SELECT *, row_number() OVER () AS rid, row_number() OVER (PARTITION BY g ORDER BY doc_id NULLS FIRST, leaf) - 1 AS i, count(*) OVER (PARTITION BY g) AS n FROM d),
t AS (SELECT g, n, 0 AS lev, i, leaf AS h FROM r
  UNION ALL SELECT g, (n + 2) // 3, lev + 1, i // 3, sha256(string_agg(h, '' ORDER BY i)) FROM t WHERE n > 1 GROUP BY g, n, lev, i // 3),
s AS (SELECT g, h, row_number() OVER (ORDER BY g) - 1 AS i, count(*) OVER () AS n FROM t WHERE n = 1),
u AS (SELECT n, 0 AS lev, i, h FROM s UNION ALL SELECT (n + 2) // 3, lev + 1, i // 3, sha256(string_agg(h, '' ORDER BY i)) FROM u WHERE n > 1 GROUP BY n, lev, i // 3),
p AS (SELECT rid, lev AS k, coalesce(string_agg(h, '' ORDER BY t.i) FILTER (t.i < r.i // (3 ** lev)::BIGINT), '') AS a, coalesce(string_agg(h, '' ORDER BY t.i) FILTER (t.i > r.i // (3 ** lev)::BIGINT), '') AS b
  FROM r JOIN t ON t.g = r.g AND t.n > 1 AND t.i // 3 = r.i // (3 ** lev)::BIGINT // 3 GROUP BY ALL
  UNION ALL SELECT rid, 100 + lev, coalesce(string_agg(u.h, '' ORDER BY u.i) FILTER (u.i < s.i // (3 ** lev)::BIGINT), ''), coalesce(string_agg(u.h, '' ORDER BY u.i) FILTER (u.i > s.i // (3 ** lev)::BIGINT), '')
  FROM r JOIN s USING (g) JOIN u ON u.n > 1 AND u.i // 3 = s.i // (3 ** lev)::BIGINT // 3 GROUP BY ALL),
q AS (SELECT rid, list({{'a': a, 'b': b, 'h': ''}} ORDER BY k) AS path FROM p GROUP BY rid),
f AS (SELECT r.doc_id, r.leaf, s.h AS subroot, (SELECT h FROM u WHERE n = 1) AS root, sha256(array_to_string(list_transform(coalesce(path, []), lambda x: x.a || x.b), '')) AS proof_sha256,
  list_reduce(list_prepend({{'a': '', 'b': '', 'h': coalesce(changed, leaf)}}, coalesce(path, [])), lambda x, y: {{'a': '', 'b': '', 'h': sha256(y.a || x.h || y.b)}}).h AS folded_root
  FROM r JOIN s USING (g) LEFT JOIN q USING (rid))
SELECT *, folded_root = root AS verified FROM f""",
)
def op11_merkle(spark, sf_dir):
    """Manifest of all documents and the proof of each; every second id is read again without its line ends."""
    docs = table(spark, sf_dir, "documents").select(*merkle.FIELDS)
    return merkle.proofs(docs, fold(F.col("doc_id"), 2) == 0, F.replace(F.col("text"), F.lit("\n"), F.lit("")))


@reg.query("op12_run_index")
def op12_run_index(spark, sf_dir):
    """What is left of every document without its repeats of 400 bytes."""
    cut = suffix_dedup.removal(table(spark, sf_dir, "documents").select("doc_id", "text"))
    removed = F.col("n_bytes") - F.octet_length("kept")
    return cut.select("doc_id", "n_bytes", removed.cast("long").alias("n_removed"), F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))


def _fails_sql(some: str) -> str:
    return "(" + " OR ".join(f"({c} AND contains({some}, '{c}'))" for c in filter_audit.LETTERS) + ")"


@reg.query(
    "op13_potential",
    rf"""WITH t AS (SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^ \t-\r]+') AS w FROM documents),
d AS (SELECT part, len(w) < 200 AS A, 100 * len(list_distinct(w)) < 50 * len(w) AS B, 100 * length(regexp_replace(t, '[^A-Z]', '', 'g')) > 2 * length(t) AS C,
  regexp_matches(t, '[#$%&*|]') AS D, coalesce(doc_id > min(doc_id) OVER (PARTITION BY t), false) AS E,
  doc_id IN (SELECT doc_id FROM labels WHERE quality = 1 AND doc_id IS NOT NULL) AS good, doc_id IN (SELECT doc_id FROM labels WHERE toxic = 1 AND doc_id IS NOT NULL) AS bad FROM t),
l AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS c),
o AS (SELECT a.c || b.c || e.c || f.c || g.c AS filter_order FROM l a JOIN l b ON b.c <> a.c JOIN l e ON e.c NOT IN (a.c, b.c) JOIN l f ON f.c NOT IN (a.c, b.c, e.c) JOIN l g ON g.c NOT IN (a.c, b.c, e.c, f.c)),
s AS (SELECT filter_order, j AS step, substr(filter_order, j::INT, 1) AS f, substr(filter_order, 1, j::INT - 1) AS before FROM o, range(1, 6) r(j)),
c AS (SELECT part, A, B, C, D, E, coalesce(good, false) AS good, coalesce(bad, false) AS bad, count(*) AS n FROM d GROUP BY ALL),
x AS (SELECT *, {_fails_sql("before")} AS gone, {_fails_sql("f")} AS fails, {_fails_sql("replace('ABCDE', f, '')")} AS other FROM c, s),
y AS (SELECT part, filter_order, step::INT AS step, f, coalesce(sum(n) FILTER (NOT gone AND NOT fails), 0)::BIGINT AS kept, coalesce(sum(n) FILTER (NOT gone AND fails), 0)::BIGINT AS removed,
  coalesce(sum(n) FILTER (gone AND fails), 0)::BIGINT AS redundant, coalesce(sum(n) FILTER (fails AND NOT other), 0)::BIGINT AS unique_fails,
  coalesce(sum(n) FILTER (NOT gone AND fails AND good), 0)::BIGINT AS good_lost, coalesce(sum(n) FILTER (NOT gone AND fails AND bad), 0)::BIGINT AS toxic_lost FROM x GROUP BY ALL)
SELECT * EXCLUDE (f), (sum(removed) OVER (PARTITION BY part, f))::BIGINT AS shapley FROM y""",
)
def op13_potential(spark, sf_dir):
    """What five filters remove from every source in each of their orders, with their Shapley values."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", "text")
    return filter_audit.audit(filter_audit.failure_counts(docs, table(spark, sf_dir, "labels")))


def all_queries():
    return dict(reg.queries)


def all_oracles():
    return dict(reg.oracles)
