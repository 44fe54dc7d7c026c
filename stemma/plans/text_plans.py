"""Text features, usability scores, chunking over documents, pages and conversations."""

from __future__ import annotations

from pyspark.sql import functions as F

from stemma.functions import text as X
from stemma.operators import chunking
from stemma.plans import dialect as d
from stemma.plans.registry import Registry
from stemma.sources import tables as S
from stemma.sources.tables import with_ctes

R = Registry()

_T = "0.0::DOUBLE"


_L = d.lines("text", X.LINE_BREAK)


def _scored_cte(structured: bool = False) -> str:
    """docs_ann with flags and scores, written out in SQL."""
    steps = d.count_matches("t", [X.NUMBERED_STEP], True)
    alg = "0.3::DOUBLE + " + d.case_sum([(d.match("low", X.ALGORITHM_PATTERNS[0]), "0.2"), (f"{steps} > 3", f"least(0.3::DOUBLE, {steps} * 0.05::DOUBLE)"), ("contains(low, 'input:') AND contains(low, 'output:')", "0.2")])
    eq = f"0.2::DOUBLE + least(0.5::DOUBLE, {d.count_matches('t', X.EQUATION_PATTERNS[:4])} * 0.05::DOUBLE) + " + d.case_sum([(d.match("low", rf"where\s+{X.W}+\s*="), "0.3")])
    ex = f"0.2::DOUBLE + least(0.5::DOUBLE, {d.count_true([d.match('low', p) for p in X.EXAMPLE_PATTERNS])} * 0.1::DOUBLE) + " + d.case_sum([(d.match("t", X.D), "0.3")])
    blocks = "least(0.3::DOUBLE, executable * 0.1::DOUBLE) + " + d.case_sum([("code_lines > 10", "0.2")]) + " + " if structured else ""
    code = "0.5::DOUBLE + " + blocks + d.case_sum([("contains(t, 'import') AND (contains(t, 'if __name__') OR contains(t, 'def main'))", "0.3")])
    proc = f"0.3::DOUBLE + least(0.4::DOUBLE, {d.count_true([d.match('low', p) for p in X.PROCEDURE_PATTERNS])} * 0.1::DOUBLE) + " + d.case_sum([(f"{d.count_words('low', X.SEQUENCE_WORDS)} >= 3", "0.3")])
    outline = "least(0.3::DOUBLE, headers * 0.05::DOUBLE) + " + d.case_sum([("headers > 0", "0.2")]) + " + " if structured else ""
    struct = outline + d.case_sum([(d.match("t", X.LIST_ITEM, True), "0.2"), ("len(string_split(t, chr(10) || chr(10))) > 3", "0.3")])
    comp = f"(CASE WHEN n > 5000 THEN 0.3 WHEN n > 2000 THEN 0.2 WHEN n > 500 THEN 0.1 ELSE 0 END)::DOUBLE + (CASE WHEN n > 0 THEN least(0.3::DOUBLE, u / n) ELSE 0 END) + least(0.4::DOUBLE, {d.count_words('low', X.TECH_TERMS)} * 0.05::DOUBLE)"
    shape = f""", len(regexp_extract_all(text, {d.q(X.FENCE)}, 1)) + len(regexp_extract_all(text, {d.q(X.INDENTED)}, 1)) AS blocks,
 len(list_filter(regexp_extract_all(text, {d.q(X.FENCE)}, 1), lambda g: g IN ('python','javascript','bash','sh'))) AS executable,
 coalesce(list_sum(list_transform(list_concat(regexp_extract_all(text, {d.q(X.FENCE)}, 2), regexp_extract_all(text, {d.q(X.INDENTED)}, 1)), lambda x: len({d.lines('x', X.LINE_BREAK)}))), 0) AS code_lines,
 len(list_filter({_L}, lambda x: {d.match('x', X.HEADER)})) AS headers""" if structured else ""
    has_blocks = " OR blocks > 0" if structured else ""
    return f"""low AS (SELECT doc_id, text AS t, lower(text) AS low, {d.words('text')} AS ws{shape} FROM docs_ann),
flagged AS (SELECT *, len(ws) AS n, len(list_distinct(ws)) AS u,
 {d.any_match('low', X.ALGORITHM_PATTERNS, True)} OR {d.any_word('low', X.ALGORITHM_WORDS)} AS has_algorithms,
 {d.any_match('t', X.EQUATION_PATTERNS)} OR {d.any_word('low', X.EQUATION_WORDS)} AS has_equations,
 {d.any_match('low', X.EXAMPLE_PATTERNS)} OR contains(low, 'example') AS has_examples,
 {d.any_match('t', X.CODE_PATTERNS, True)}{has_blocks} AS has_code,
 {d.any_match('low', X.PROCEDURE_PATTERNS)} OR {d.match('t', X.NUMBERED_STEP, True)} AS has_procedures FROM low),
parts AS (SELECT doc_id, t, low, has_algorithms, has_equations, has_examples, has_code, has_procedures,
 CASE WHEN has_algorithms THEN least({alg}, 1) ELSE {_T} END AS algorithm_score,
 CASE WHEN has_equations THEN least({eq}, 1) ELSE {_T} END AS equation_score,
 CASE WHEN has_examples THEN least({ex}, 1) ELSE {_T} END AS example_score,
 CASE WHEN has_code THEN least({code}, 1) ELSE {_T} END AS code_score,
 CASE WHEN has_procedures THEN least({proc}, 1) ELSE {_T} END AS procedure_score,
 least({struct}, 1) AS structure_score, least({comp}, 1) AS complexity_score FROM flagged),
scored AS (SELECT *,
 greatest(0, least(1, (code_score*0.4::DOUBLE + procedure_score*0.3::DOUBLE + algorithm_score*0.2::DOUBLE + equation_score*0.1::DOUBLE) * (1 - complexity_score*0.3::DOUBLE))) AS implementation_fidelity,
 greatest(0, least(1, code_score*0.4::DOUBLE + example_score*0.3::DOUBLE + procedure_score*0.2::DOUBLE + structure_score*0.1::DOUBLE)) AS actionability,
 CASE WHEN (has_equations OR has_algorithms) AND (has_code OR has_examples) THEN
  least(1, (has_equations::INT*0.3::DOUBLE + has_algorithms::INT*0.2::DOUBLE + has_code::INT*0.3::DOUBLE + has_examples::INT*0.2::DOUBLE) * 0.8::DOUBLE + algorithm_score*code_score*0.2::DOUBLE)
  ELSE {_T} END AS bridge_potential FROM parts)"""


SCORED = "\n," + _scored_cte() + "\n"


def scored(spark, sf_dir):
    return X.with_scores(S.docs_ann(spark, sf_dir))


def _r(cols):
    return [F.round(c, 6).alias(c) for c in cols]


def _rs(cols):
    return ", ".join(f"round({c}, 6) AS {c}" for c in cols)


@R.query("conveyance_flags", with_ctes(["docs_ann"], SCORED + f"SELECT doc_id, {', '.join(X.FLAGS)} FROM scored"))
def conveyance_flags(spark, sf_dir):
    return X.with_flags(S.docs_ann(spark, sf_dir)).select("doc_id", *X.FLAGS)


@R.query("conveyance_scores", with_ctes(["docs_ann"], SCORED + f"SELECT doc_id, {_rs(X.PART_SCORES + ['complexity_score'] + X.MAIN_SCORES)} FROM scored"))
def conveyance_scores(spark, sf_dir):
    return scored(spark, sf_dir).select("doc_id", *_r(X.PART_SCORES + ["complexity_score"] + X.MAIN_SCORES))


@R.query(
    "score_bands",
    with_ctes(["docs_ann"], SCORED + """SELECT count(*) AS n, round(avg(implementation_fidelity), 6) AS mean_fidelity, count(*) FILTER (implementation_fidelity > 0.7) AS high,
 count(*) FILTER (implementation_fidelity > 0.3 AND implementation_fidelity <= 0.7) AS medium, count(*) FILTER (implementation_fidelity <= 0.3) AS low FROM scored"""),
)
def score_bands(spark, sf_dir):
    s = F.coalesce("implementation_fidelity", F.lit(0.0))
    return scored(spark, sf_dir).agg(
        F.count("*").alias("n"), F.round(F.avg(s), 6).alias("mean_fidelity"), F.count_if(s > 0.7).alias("high"),
        F.count_if((s > 0.3) & (s <= 0.7)).alias("medium"), F.count_if(s <= 0.3).alias("low"),
    )


@R.query("high_bridge_potential", with_ctes(["docs_ann"], SCORED + "SELECT doc_id, round(bridge_potential, 6) AS bridge_potential FROM scored WHERE round(bridge_potential, 9) > 0.3"))
def high_bridge_potential(spark, sf_dir, threshold: float = 0.3):
    out = X.settled(scored(spark, sf_dir).select("doc_id", "bridge_potential"), "bridge_potential").where(F.round("bridge_potential", 9) > threshold)
    return out.select("doc_id", *_r(["bridge_potential"]))


_FA = f"""SELECT doc_id, round(least(1, {d.count_words('low', X.FALLBACK_IMPLEMENTATION)} / 5.0::DOUBLE * 2), 6) AS implementation_fidelity,
 round(least(1, {d.count_words('low', X.FALLBACK_PRACTICE)} / 5.0::DOUBLE * 2), 6) AS actionability,
 round(least(1, ({d.count_words('low', X.FALLBACK_THEORY)} / 5.0::DOUBLE + {d.count_words('low', X.FALLBACK_PRACTICE)} / 5.0::DOUBLE) / 2), 6) AS bridge_potential
 FROM (SELECT doc_id, lower(text) AS low FROM docs_ann)"""


@R.query("fallback_a", with_ctes(["docs_ann"], _FA))
def fallback_a(spark, sf_dir):
    low = S.docs_ann(spark, sf_dir).select("doc_id", F.lower("text").alias("low"))
    return low.select("doc_id", *[F.round(c, 6).alias(k) for k, c in X.fallback_fractions(F.col("low")).items()])


_FB = f"""SELECT doc_id, round(CASE WHEN a+t+p = 0 THEN 0.3 ELSE least(0.9, a/10.0) END::DOUBLE, 6) AS implementation_fidelity,
 round(CASE WHEN a+t+p = 0 THEN 0.2 ELSE least(0.9, p/8.0) END::DOUBLE, 6) AS actionability,
 round(CASE WHEN a+t+p = 0 THEN 0.1 WHEN t > 0 AND p > 0 THEN least(0.9, (t+p)/15.0) ELSE 0.2 END::DOUBLE, 6) AS bridge_potential,
 CASE WHEN contains(low, 'information theory') THEN 'information theory' || CASE WHEN contains(low, 'entropy') THEN '|entropy' ELSE '' END
  WHEN contains(low, 'entropy') THEN 'entropy' ELSE 'general concepts' END AS theory_components,
 CASE WHEN contains(low, 'algorithm') THEN 'algorithms' || CASE WHEN contains(low, 'implementation') THEN '|implementation details' ELSE '' END
  WHEN contains(low, 'implementation') THEN 'implementation details' ELSE 'general methods' END AS practice_components,
 'Pattern-based analysis found ' || a || ' algorithm indicators, ' || t || ' theory indicators, and ' || p || ' practice indicators.' AS reasoning
 FROM (SELECT doc_id, low, {d.count_words('low', X.INDICATOR_ALGORITHM)} AS a, {d.count_words('low', X.INDICATOR_THEORY)} AS t,
 {d.count_words('low', X.INDICATOR_PRACTICE)} AS p FROM (SELECT doc_id, lower(text) AS low FROM docs_ann))"""


@R.query("fallback_b", with_ctes(["docs_ann"], _FB))
def fallback_b(spark, sf_dir):
    low = S.docs_ann(spark, sf_dir).select("doc_id", F.lower("text").alias("low"))
    c = X.fallback_indicators(F.col("low"))
    return low.select(
        "doc_id", *[F.round(c[k], 6).alias(k) for k in X.MAIN_SCORES],
        *[F.array_join(c[k], "|").alias(k) for k in ("theory_components", "practice_components")], c["reasoning"].alias("reasoning"),
    )




def with_lines(df):
    """Lines as a column of their own, so that the text is split once."""
    return df.withColumn("lines", X.lines_of(F.col("text")))


@R.query(
    "text_stats",
    with_ctes(["docs_ann"], f""", l AS (SELECT doc_id, text, {_L} AS ls FROM docs_ann),
 h AS (SELECT *, list_transform(ls[1:20], lambda x: {d.strip('x')}) AS head FROM l)
 SELECT doc_id, len(ls)::INT AS line_count, len({d.words('text')})::INT AS word_count, length(text)::INT AS character_count,
 round(CASE WHEN len(ls) > 0 THEN list_sum(list_transform(ls, lambda x: length(x)))::DOUBLE / len(ls) ELSE 0 END, 6) AS average_line_length,
 coalesce(list_max(list_transform(ls, lambda x: length(x))), 0)::INT AS max_line_length,
 len(list_filter(ls, lambda x: {d.strip('x')} = ''))::INT AS empty_lines,
 len(ls) >= 3 AND len(list_filter(head, lambda x: starts_with(x, '#') OR starts_with(x, '==') OR regexp_matches(x, '^(\\p{{Nd}}|(?i:chapter|section))'))) > 0 AS has_headers,
 CASE WHEN len(list_intersect(list_distinct(regexp_split_to_array(lower(text[1:1000]), '\\s+')), {X.ENGLISH_WORDS})) >= 3 THEN 'en' ELSE 'unknown' END AS language FROM h"""),
)
def text_stats(spark, sf_dir):
    c = X.text_stats(F.col("text"), F.col("lines"))
    c["average_line_length"] = F.round(c["average_line_length"], 6)
    return with_lines(S.docs_ann(spark, sf_dir)).select("doc_id", *[v.alias(k) for k, v in c.items()])


@R.query(
    "lang_guess",
    f"""SELECT conv_id, turn, CASE WHEN len(list_intersect(list_distinct(regexp_split_to_array(lower(text[1:1000]), '\\s+')), {X.ENGLISH_WORDS})) >= 3
 THEN 'english' ELSE 'unknown' END AS likely_language FROM conversations""",
)
def lang_guess(spark, sf_dir):
    c = S.table(spark, sf_dir, "conversations")
    return c.select("conv_id", "turn", X.guess_language(F.col("text"), "english").alias("likely_language"))


def _line_count(p: str) -> str:
    return f"coalesce(list_sum(list_transform(ls, lambda x: len(regexp_extract_all(x, {d.q(p)})))), 0)::INT"


@R.query(
    "md_structure",
    with_ctes(["docs_ann"], f""", l AS (SELECT doc_id, {_L} AS ls FROM docs_ann)
 SELECT doc_id, len(list_filter(ls, lambda x: {d.match('x', X.HEADER)}))::INT AS headers,
 len(list_filter(ls, lambda x: NOT {d.match('x', X.HEADER)} AND {d.match('x', r'^[\s]*[-*+]\s+|^[\s]*' + X.D + r'+\.\s+')}))::INT AS lists,
 {_line_count(X.LINK)} AS links, {_line_count(X.IMAGE)} AS images,
 len(list_filter(ls, lambda x, i: i > 1 AND {d.match('x', X.TABLE_RULE)} AND contains(ls[i-1], '|')))::INT AS tables,
 len(list_filter(ls, lambda x: starts_with({d.strip('x')}, '>')))::INT AS blockquotes FROM l"""),
)
def md_structure(spark, sf_dir):
    d = with_lines(S.docs_ann(spark, sf_dir))
    return d.select("doc_id", *[v.alias(k) for k, v in X.markdown_structure(F.col("text"), F.col("lines")).items()])


@R.query(
    "md_metadata",
    with_ctes(["docs_ann"], f"""SELECT doc_id, contains(text, '[TOC]') OR contains(text, '[[TOC]]') AS has_toc, round(len({d.words('text')}) / 200.0::DOUBLE, 6) AS reading_time_minutes,
 CASE WHEN {d.any_word('low[1:500]', ['documentation', 'api reference', 'user guide', 'tutorial'])} THEN 'documentation'
  WHEN {d.any_word('low[1:200]', ['author:', 'date:', 'published:'])} THEN 'article'
  WHEN {d.any_word('low', ['abstract', 'references', 'bibliography', 'citation'])} THEN 'academic' ELSE 'general' END AS document_type
 FROM (SELECT *, lower(text) AS low FROM docs_ann)"""),
)
def md_metadata(spark, sf_dir):
    t = F.col("text")
    return S.docs_ann(spark, sf_dir).select(
        "doc_id", X.any_word(t, ["[TOC]", "[[TOC]]"]).alias("has_toc"), F.round(F.size(X.words_of(t)) / 200.0, 6).alias("reading_time_minutes"),
        X.markdown_type(t).alias("document_type"),
    )


@R.query(
    "code_blocks",
    with_ctes(["docs_ann"], f""", b AS (SELECT doc_id, regexp_extract_all(text, {d.q(X.FENCE)}, 1) AS langs, regexp_extract_all(text, {d.q(X.FENCE)}, 2) AS bodies,
 regexp_extract_all(text, {d.q(X.INDENTED)}, 1) AS ind FROM docs_ann)
 SELECT doc_id, (len(langs) + len(ind))::INT AS blocks, len(list_filter(langs, lambda g: g IN ('python','javascript','bash','sh')))::INT AS executable,
 coalesce(list_sum(list_transform(list_concat(bodies, ind), lambda x: len({d.lines('x', X.LINE_BREAK)}))), 0)::INT AS code_lines FROM b"""),
)
def code_blocks(spark, sf_dir):
    b = S.docs_ann(spark, sf_dir).select("doc_id", X.code_blocks(F.col("text")).alias("b"))
    return b.select(
        "doc_id", F.size("b").alias("blocks"), F.size(F.filter("b", lambda x: x["executable"])).alias("executable"),
        F.aggregate("b", F.lit(0), lambda a, x: a + x["lines"]).alias("code_lines"),
    )


@R.query(
    "readability",
    f"""SELECT *, readability < 0.5 AS low_readability FROM (SELECT doc_id, len(ws)::INT AS word_count, g::INT AS readable_words,
 round(CASE WHEN len(ws) > 0 THEN g / len(ws) ELSE 0 END, 6) AS readability,
 ({' + '.join(f"(length(text) - length(replace(text, {d.q(a)}, ''))) / {len(a)}" for a in X.OCR_ARTIFACTS)})::INT AS artifacts
 FROM (SELECT *, len(list_filter(ws, lambda w: length(w) > 2 AND regexp_matches(w, '^\\p{{L}}+$')))::DOUBLE AS g FROM (SELECT doc_id, text, {d.words('text')} AS ws FROM documents)))""",
)
def readability(spark, sf_dir):
    c = X.readability(F.col("text"), F.col("words"))
    out = S.texts(spark, sf_dir).withColumn("words", X.words_of(F.col("text"))).select("doc_id", *[v.alias(k) for k, v in c.items() if k != "low_readability"])
    return out.withColumn("readability", F.round("readability", 6)).withColumn("low_readability", F.col("readability") < 0.5)


_OCR_T = f"list_sum(list_transform({d.lines('text', X.LINE_BREAK)}, lambda x: (len(regexp_extract_all(x, '  ')) > 2 OR contains(x, chr(9)))::INT + contains(x, '|')::INT))"


@R.query(
    "ocr_features",
    with_ctes(["docs_ann"], f"""SELECT doc_id, CASE WHEN c >= 90 THEN 'excellent' WHEN c >= 80 THEN 'good' WHEN c >= 70 THEN 'fair' WHEN c >= 60 THEN 'poor' ELSE 'very_poor' END AS quality,
 c > 70 AS is_readable, {d.count_words('text', X.MATH_SYMBOLS)} > 5 AS has_equations, coalesce({_OCR_T}, 0) > 5 AS has_tables,
 length(text)::DOUBLE / (1 + doc_id % 40) < 100 AS needs_ocr FROM (SELECT *, (doc_id * 7 % 61 + 40)::DOUBLE AS c FROM docs_ann)"""),
)
def ocr_features(spark, sf_dir):
    c, t = (F.col("doc_id") * 7 % 61 + 40).cast("double"), F.col("text")
    return S.docs_ann(spark, sf_dir).select(
        "doc_id", X.ocr_quality(c).alias("quality"), (c > 70).alias("is_readable"), X.ocr_equations(t).alias("has_equations"),
        X.ocr_tables(t).alias("has_tables"), X.needs_ocr(F.length(t), F.lit(1) + F.col("doc_id") % 40).alias("needs_ocr"),
    )


@R.query(
    "adapter",
    with_ctes(["docs_ann"], f"SELECT doc_id, CASE WHEN {d.any_word('text', X.CODE_TOKENS)} THEN 'code' ELSE 'retrieval' END AS adapter FROM docs_ann"),
)
def adapter(spark, sf_dir):
    return S.docs_ann(spark, sf_dir).select("doc_id", X.adapter(F.col("text")).alias("adapter"))


@R.query("token_budget", "SELECT doc_id, (length(text) // 4)::INT AS tokens, length(text) // 4 <= 16384 AS fits, length(text[1:77920])::INT AS kept FROM documents")
def token_budget(spark, sf_dir):
    t = F.col("text")
    c = X.token_estimate(t)
    return S.table(spark, sf_dir, "documents").select(
        "doc_id", c["tokens"].alias("tokens"), c["fits"].alias("fits"), F.length(X.truncate_for_context(t)).alias("kept")
    )


@R.query("training_examples", with_ctes(["docs_ann"], """SELECT doc_id, md5(text[1:1000]) AS excerpt, contains(text, '=') OR contains(text, '∑') AS has_math,
 contains(text, 'def ') OR contains(text, 'function') AS has_code, length(text)::INT AS content_length FROM docs_ann"""))
def training_examples(spark, sf_dir):
    c = X.training_example(F.col("text"))
    return S.docs_ann(spark, sf_dir).select("doc_id", F.md5(c["content"]).alias("excerpt"), *[c[k].alias(k) for k in ("has_math", "has_code", "content_length")])


@R.query(
    "model_responses",
    """SELECT doc_id, quality::DOUBLE / 2 AS implementation_fidelity, 0.25::DOUBLE AS actionability, toxic::DOUBLE AS bridge_potential,
 'Doc ' || doc_id || '|clear steps' AS theory_components, 'thought ' || doc_id AS reasoning FROM labels""",
)
def model_responses(spark, sf_dir):
    """Parse model output made from the labels: reasoning tag, then the JSON block with the scores."""
    resp = F.format_string(
        'noise {"x": 1} <think> thought %d </think>\n{"implementation_fidelity": %s, "actionability": 0.25, "bridge_potential": %d, '
        '"analysis": {"implementation_fidelity_analysis": "Doc %d. clear steps. more"}} tail',
        F.col("doc_id"), (F.col("quality") / 2).cast("string"), F.col("toxic"), F.col("doc_id"),
    )
    p = S.table(spark, sf_dir, "labels").select("doc_id", X.parse_analysis(resp).alias("p"), X.reasoning_of(resp).alias("reasoning"))
    return p.select("doc_id", *[f"p.{k}" for k in X.MAIN_SCORES], F.array_join("p.theory_components", "|").alias("theory_components"), "reasoning")


@R.query(
    "chunk_fixed",
    """SELECT doc_id, i::INT AS chunk_index, length(c)::INT AS chars, md5(c) AS digest FROM (SELECT doc_id, i, CASE WHEN length(text) > 10000 THEN text[i*8000+1:(i+1)*8000] ELSE text END AS c
 FROM documents, range(0, 100000) r(i) WHERE i = 0 OR (length(text) > 10000 AND i * 8000 < length(text)))""".replace("range(0, 100000)", "(SELECT unnest(range(0, (SELECT max(length(text)) // 8000 + 1 FROM documents))) AS i)").replace(" r(i)", ""),
)
def chunk_fixed(spark, sf_dir):
    out = chunking.fixed_chunks(S.texts(spark, sf_dir).select("doc_id", "text"))
    return out.select("doc_id", "chunk_index", F.length("chunk").alias("chars"), F.md5("chunk").alias("digest"))


@R.query(
    "chunk_overlap",
    f"""SELECT doc_id, (s // 384)::INT AS chunk_index, s::INT AS token_start, len(w)::INT AS n_tokens, md5(array_to_string(w, ' ')) AS digest FROM
 (SELECT doc_id, s, ws[s+1:s+512] AS w FROM (SELECT doc_id, {d.words('text')} AS ws FROM documents), (SELECT unnest(range(0, (SELECT max(length(text)) FROM documents), 384)) AS s) WHERE s < len(ws))""",
)
def chunk_overlap(spark, sf_dir):
    out = chunking.token_windows(S.texts(spark, sf_dir).select("doc_id", "text"))
    return out.select("doc_id", "chunk_index", "token_start", "n_tokens", F.md5("chunk").alias("digest"))


@R.query(
    "chunk_lines",
    f"""SELECT doc_id, (s // 100)::INT AS chunk_index, (s+1)::INT AS line_start, (s+len(w))::INT AS line_end, md5(array_to_string(w, chr(10))) AS digest FROM
 (SELECT doc_id, s, ls[s+1:s+100] AS w FROM (SELECT page_id AS doc_id, {d.lines('html', X.LINE_BREAK)} AS ls FROM pages UNION ALL SELECT doc_id, {_L} FROM documents),
 (SELECT unnest(range(0, (SELECT max(length(text)) FROM documents), 100)) AS s) WHERE s < len(ls))""",
)
def chunk_lines(spark, sf_dir):
    docs = S.texts(spark, sf_dir).select("doc_id", "text")
    pages = S.table(spark, sf_dir, "pages").select(F.col("page_id").alias("doc_id"), F.col("html").alias("text"))
    out = chunking.line_chunks(pages.unionByName(docs))
    return out.select("doc_id", "chunk_index", "line_start", "line_end", F.md5("chunk").alias("digest"))


PARAGRAPH_CHUNKS = f""", p AS (SELECT doc_id, string_split(text, chr(10)||chr(10)) AS ps FROM docs_ann WHERE length(text) > 8000),
 f AS (SELECT doc_id, ps, 1 AS i, length(ps[1]) + 2 AS cur, 0 AS k FROM p UNION ALL
 SELECT doc_id, ps, i+1, CASE WHEN cur + length(ps[i+1]) < 8000 THEN cur + length(ps[i+1]) + 2 ELSE length(ps[i+1]) + 2 END,
  CASE WHEN cur + length(ps[i+1]) < 8000 THEN k ELSE k + 1 END FROM f WHERE i < len(ps)),
 ck AS (SELECT doc_id, k::INT AS chunk_index, {d.strip("string_agg(ps[i], chr(10)||chr(10) ORDER BY i)")} AS chunk FROM f GROUP BY doc_id, k UNION ALL SELECT doc_id, 0, text FROM docs_ann WHERE length(text) <= 8000)
"""


@R.query(
    "chunk_paragraph",
    with_ctes(["docs_ann"], PARAGRAPH_CHUNKS + "SELECT doc_id, chunk_index, length(chunk)::INT AS chars, md5(chunk) AS digest FROM ck", recursive=True),
)
def chunk_paragraph(spark, sf_dir):
    out = chunking.paragraph_chunks(S.docs_ann(spark, sf_dir).select("doc_id", "text"))
    return out.select("doc_id", "chunk_index", F.length("chunk").alias("chars"), F.md5("chunk").alias("digest"))


@R.query(
    "section_segments",
    with_ctes(["docs_ann"], f""", l AS (SELECT doc_id, {_L} AS ls FROM docs_ann),
 h AS (SELECT doc_id, ls, list_filter(range(1, len(ls)+1), lambda i: {d.match('ls[i]', X.HEADER)}) AS hs FROM l),
 e AS (SELECT doc_id, ls, hs, unnest(range(1, len(hs)+1)) AS k FROM h)
 SELECT doc_id, (k-1)::INT AS section_index, (hs[k]-1)::INT AS line_number, length(regexp_extract(ls[hs[k]], {d.q(X.HEADER)}, 1))::INT AS level,
 {d.strip(f"regexp_extract(ls[hs[k]], {d.q(X.HEADER)}, 2)")} AS title,
 md5(array_to_string(ls[hs[k]:coalesce(hs[k+1]-1, len(ls))], chr(10))) AS digest FROM e"""),
)
def section_segments(spark, sf_dir):
    out = chunking.sections(S.docs_ann(spark, sf_dir).select("doc_id", "text"))
    return out.select("doc_id", "section_index", "line_number", "level", "title", F.md5("content").alias("digest"))


@R.query(
    "markdown_tables",
    with_ctes(["docs_ann"], """SELECT doc_id, 'a | b' || chr(10) || '--- | ---' AS table_text FROM docs_ann WHERE doc_id % 8 = 5"""),
)
def markdown_tables(spark, sf_dir):
    rows = S.docs_ann(spark, sf_dir).select("doc_id", chunking.table_rows(F.col("text")).alias("rows")).where("size(rows) > 0")
    return rows.select("doc_id", X.markdown_table(F.col("rows")).alias("table_text"))


@R.query(
    "md_items",
    """SELECT doc_id, 'header' AS kind, (1 + doc_id % 6)::INT AS level, 'Part ' || doc_id AS text, NULL AS url, 2::INT AS line FROM documents
 UNION ALL SELECT doc_id, 'image', 0, 'fig', 'f' || (doc_id % 3) || '.png', 3 FROM documents
 UNION ALL SELECT doc_id, 'link', 0, 'here ' || (doc_id % 7), 'http://e.org/' || doc_id, 3 FROM documents
 UNION ALL SELECT doc_id, 'link', 0, 'fig', 'f' || (doc_id % 3) || '.png', 3 FROM documents""",
)
def md_items(spark, sf_dir):
    """Headers, images and links of a note about every document, as rows."""
    i = F.col("doc_id")
    s = lambda c: c.cast("string")
    note = F.concat(
        F.lit("Plain\n"), F.repeat(F.lit("#"), (1 + i % 6).cast("int")), F.lit(" Part "), s(i), F.lit("\nsee [here "), s(i % 7), F.lit("](http://e.org/"), s(i), F.lit(") and ![fig](f"), s(i % 3), F.lit(".png)")
    )
    n = S.table(spark, sf_dir, "documents").select("doc_id", note.alias("note"))
    return n.select("doc_id", F.inline(X.markdown_items(F.split("note", "\n"))))


@R.query(
    "md_frontmatter",
    """SELECT doc_id, 'T: ' || doc_id AS title, lang AS language, CASE WHEN doc_id % 3 = 0 THEN 'true' END AS draft, CASE WHEN doc_id % 3 = 0 THEN 3 ELSE 2 END::INT AS n_keys FROM documents WHERE doc_id % 5 <> 0
 UNION ALL SELECT doc_id, NULL, NULL, NULL, 0 FROM documents WHERE doc_id % 5 = 0""",
)
def md_frontmatter(spark, sf_dir):
    """Keys of the frontmatter that four of five documents carry."""
    i = F.col("doc_id")
    head = F.concat(F.lit("---\ntitle: T: "), i.cast("string"), F.lit("\nlang:"), F.col("lang"), F.when(i % 3 == 0, "\ndraft : true").otherwise(""), F.lit("\n---\n"))
    text = F.concat(F.when(i % 5 != 0, head).otherwise(""), F.col("text"))
    f = S.table(spark, sf_dir, "documents").select("doc_id", X.frontmatter(text).alias("f"))
    return f.select("doc_id", F.col("f")["title"].alias("title"), F.col("f")["lang"].alias("language"), F.col("f")["draft"].alias("draft"), F.size("f").alias("n_keys"))


@R.query(
    "scores_with_structure",
    with_ctes(["docs_ann"], ",\n" + _scored_cte(True) + """
 SELECT doc_id, round(code_score, 6) AS code_score, round(structure_score, 6) AS structure_score, round(implementation_fidelity, 6) AS implementation_fidelity, round(actionability, 6) AS actionability FROM scored"""),
)
def scores_with_structure(spark, sf_dir):
    """Scores with what a loader knows of a text: its code blocks and its headers, each of which opens a section."""
    t = F.col("text")
    docs = with_lines(S.docs_ann(spark, sf_dir)).select("doc_id", "text", X.code_blocks(t).alias("blocks"), X.markdown_structure(t, F.col("lines"))["headers"].alias("headers"))
    docs = docs.withColumn("outline", F.struct("headers", F.col("headers").alias("sections")))
    s = X.with_scores(docs, "text", "blocks", "outline")
    return s.select("doc_id", *[F.round(c, 6).alias(c) for c in ("code_score", "structure_score", "implementation_fidelity", "actionability")])
