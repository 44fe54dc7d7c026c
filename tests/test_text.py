import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from stemma.functions import citation as C
from stemma.functions import text as X
from stemma.operators import chunking


def one(spark, text, cols):
    df = spark.createDataFrame([(1, text)], "id int, text string")
    return df.select(*[c.alias(k) for k, c in cols.items()]).first()


def test_text_stats(spark):
    r = one(spark, "a b\n\nccc", X.text_stats(F.col("text")))
    assert (r.line_count, r.word_count, r.character_count, r.average_line_length, r.max_line_length, r.empty_lines) == (3, 3, 8, 2.0, 3, 1)


def test_text_stats_of_empty_text(spark):
    r = one(spark, "", X.text_stats(F.col("text")))
    assert (r.line_count, r.word_count, r.max_line_length, r.average_line_length, r.has_headers) == (0, 0, 0, 0.0, False)


def test_algorithm_scores(spark):
    df = spark.createDataFrame([(1, "Algorithm 1:\nInput: x\nOutput: y")], "id int, text string")
    r = X.with_scores(df).first()
    assert r.algorithm_score == pytest.approx(0.7)
    assert r.complexity_score == pytest.approx(0.35)
    assert r.implementation_fidelity == pytest.approx(0.1253)
    assert (r.actionability, r.bridge_potential) == (0.0, 0.0)


def test_empty_text_scores_zero(spark):
    df = spark.createDataFrame([(1, ""), (2, None)], "id int, text string")
    for r in X.with_scores(df).collect():
        assert not any(r[k] for k in X.FLAGS + X.PART_SCORES + X.MAIN_SCORES + ["complexity_score"])


def test_code_blocks_raise_the_code_score(spark):
    df = spark.createDataFrame([(1, "plain", [(True, 20)])], "id int, text string, blocks array<struct<executable:boolean,lines:int>>")
    r = X.with_scores(df, code_blocks="blocks").first()
    assert r.has_code and r.code_score == pytest.approx(0.8)


def test_literal_guard_keeps_regex_results(spark):
    texts = ["def f(x)", "undef f", "class  A", "classA", "from a import b", "for x in y", "import", "e.g. this", "egg", "a == b", "a = b", "example 12: x"]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    word = r"[^\W]"
    for p in X.CODE_PATTERNS + X.EXAMPLE_PATTERNS + X.EQUATION_PATTERNS[:1]:
        py = p.replace(X.W, word).replace(X.D, r"\d")
        got = [r.h for r in df.select(X.has(F.col("t"), p, True).alias("h")).collect()]
        assert got == [bool(re.search(py, t, re.M)) for t in texts], p


def test_fixed_chunks(spark):
    df = spark.createDataFrame([(1, "x" * 16500), (2, "y" * 10000)], "id int, text string")
    got = {}
    for r in chunking.fixed_chunks(df).collect():
        got.setdefault(r.id, {})[r.chunk_index] = len(r.chunk)
    assert got == {1: {0: 8000, 1: 8000, 2: 500}, 2: {0: 10000}}


def test_token_windows(spark):
    df = spark.createDataFrame([(1, " ".join(f"t{i}" for i in range(1000)))], "id int, text string")
    r = sorted((x.token_start, x.n_tokens) for x in chunking.token_windows(df).collect())
    assert r == [(0, 512), (384, 512), (768, 232)]


def test_paragraph_packing(spark):
    text = "\n\n".join("abc"[i] * n for i, n in enumerate((5000, 2000, 3000)))
    df = spark.createDataFrame([(1, text), (2, "short\n\ntext ")], "id int, text string")
    rows = sorted((r.id, r.chunk_index, len(r.chunk)) for r in chunking.paragraph_chunks(df).collect())
    assert rows == [(1, 0, 7002), (1, 1, 3000), (2, 0, 12)]


def test_packing_keeps_every_paragraph(spark):
    paras = [chr(97 + i % 26) * (700 + 613 * i % 4000) for i in range(40)]
    df = spark.createDataFrame([(1, "\n\n".join(paras))], "id int, text string")
    chunks = [r.chunk for r in chunking.paragraph_chunks(df).orderBy("chunk_index").collect()]
    assert "\n\n".join(chunks).split("\n\n") == paras
    assert all(len(c) < 8000 for c in chunks)


def test_sections(spark):
    df = spark.createDataFrame([(1, "pre\n# A\nx\n## B \ny\nz\n")], "id int, text string")
    rows = [(r.line_number, r.level, r.title, r.content) for r in chunking.sections(df).orderBy("section_index").collect()]
    assert rows == [(1, 1, "A", "# A\nx"), (3, 2, "B", "## B \ny\nz")]


def test_markdown_structure_counts_images_as_links(spark):
    text = "# H\n- a\n1. b\n[l](u) ![i](s)\n| a | b |\n| - | - |\n> q"
    r = one(spark, text, X.markdown_structure(F.col("text")))
    assert (r.headers, r.lists, r.links, r.images, r.tables, r.blockquotes) == (1, 2, 2, 1, 1, 1)


def test_code_block_kinds(spark):
    text = "a\n```python\nimport os\nx\n```\nb\n    ind1\n    ind2\nc"
    b = one(spark, text, {"b": X.code_blocks(F.col("text"))}).b
    assert [(x.language, x.type, x.lines, x.executable) for x in b] == [("python", "fenced", 2, True), ("unknown", "indented", 2, False)]
    assert b[1].code == "ind1\nind2"


def test_last_citation_type_wins(spark):
    df = spark.createDataFrame([("However, we extend it", "")], "citation_text string, context_before string")
    r = C.with_features(df).first()
    assert r.citation_type == "critiques" and r.action_verbs == ["extend"]


def test_influence(spark):
    df = spark.createDataFrame([("builds_on", True, False, False, False, "other")], "citation_type string, high_verb boolean, medium_verb boolean, is_methodological boolean, is_foundational boolean, section_type string")
    assert df.select(C.influence(F.lit(0.5)).alias("i")).first().i == pytest.approx(0.268)


def test_concepts_match_python(spark):
    texts = ["The Graph Theory of Łódź Networks. Éa Fooé Bar\nBaz", "We use Graph Theory. In Old Houses, Net-Work"]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    for r in df.select("t", C.concepts(F.col("t")).alias("k")).collect():
        want = set(re.findall(r"\b[A-Z][a-z]+(?:\s+[A-Z][a-z]+)*\b", r.t)) - set(C.COMMON_CONCEPTS)
        assert set(r.k) == want


def test_usage_window(spark):
    df = spark.createDataFrame([("No. One two three four Rank five six seven eight.",)], "t string")
    assert df.select(C.usage_window(F.col("t"), F.lit("rank")).alias("u")).first().u == "two three four Rank five six seven"


def test_parse_analysis_returns_the_parsed_block(spark):
    text = '{"a": {"b": 1}} <think> why </think> {"implementation_fidelity": 0.9, "actionability": 0.4, "bridge_potential": 0.1, "analysis": {"actionability_analysis": "One. Two. Three"}}'
    r = one(spark, text, {"p": X.parse_analysis(F.col("text")), "why": X.reasoning_of(F.col("text"))})
    assert (r.p.implementation_fidelity, r.p.practice_components, r.why) == (0.9, ["One", "Two"], "why")


def test_ocr_rules(spark):
    df = spark.createDataFrame([(95.0, 50, 1), (65.0, 500, 2), (10.0, 0, 0)], "c double, n int, p int")
    rows = df.select(X.ocr_quality(F.col("c")).alias("q"), X.needs_ocr(F.col("n"), F.col("p")).alias("o")).collect()
    assert [(r.q, r.o) for r in rows] == [("excellent", True), ("poor", False), ("very_poor", True)]


def test_equation_patterns_are_tried_only_on_texts_that_can_match(spark):
    texts = ["", "ab = c", "a == b", "a=", "1 = 2", "é= x", "ab=cd=e x =\ny", "\\frac{1}", "\\ frac", "$x$ $", "a$b", "sum", "the sum of", "summary", "_sum", "x∑y", "Σ", "integral\n", "product=3"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "id int, t string")
    t = F.col("t")
    for p in X.EQUATION_PATTERNS:
        row = df.select(X.has(t, p).alias("a"), t.rlike("(?d)" + p).alias("b"), X.count_matches(t, [p]).alias("n"), F.regexp_count(t, F.lit("(?d)" + p)).alias("m"))
        assert all(r.a == r.b and r.n == r.m for r in row.collect()), p
        assert "contains" in str(X.has(t, p)), p


def test_hashing_model_counts_every_word_once():
    import hashlib

    from stemma.operators import embedding

    texts = ["a b  a\tc\x0bd\x0ce\r\nf", "", None, "é\xa0x é y \x1cz"]
    want = np.zeros((4, 16))
    for i, text in enumerate(texts):
        for w in filter(None, re.split(r"[ \t\n\x0b\x0c\r]+", text or "")):
            h = hashlib.md5(w.encode()).hexdigest()
            want[i, int(h[:8], 16) % 16] += 1.0 if int(h[8], 16) % 2 == 0 else -1.0
    model = embedding.HashingModel(16)
    assert (model(texts) == want).all()
    model.WORDS_HELD = 2  # held words are given up, not the result
    assert (model(texts) == want).all() and (model(texts) == want).all()
