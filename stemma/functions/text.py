"""Text features as column expressions. Nothing here leaves the JVM.

Word characters are written as explicit Unicode classes, so that Java and RE2 agree with each other.
"""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stemma.functions.vectors import let

W = r"[\p{L}\p{N}_]"
NOT_W = r"[^\p{L}\p{N}_]"
D = r"\p{Nd}"
LINE_BREAK = "\r\n|[\n\r\x0b\x0c\x1c\x1d\x1e\x85\u2028\u2029]"

# Indicator patterns and keywords of the usability scores.
ALGORITHM_PATTERNS = [
    rf"algorithm\s+{D}+",
    rf"procedure\s+{D}+",
    rf"step\s+{D}+:",
    rf"^{D}+\.\s+",
    rf"function\s+{W}+\s*\(",
    rf"def\s+{W}+\s*\(",
    r"algorithm:",
    r"pseudocode:",
]
ALGORITHM_WORDS = ["algorithm", "procedure", "method", "technique", "approach"]
EQUATION_PATTERNS = [
    r"[A-Za-z]+\s*=\s*[^=]",
    r"\\[A-Za-z]+\{",
    r"\$[^$]+\$",
    r"∑|∏|∫|∂|∇|∆",
    rf"(^|{NOT_W})(sum|product|integral)({NOT_W}|$)",
    r"Σ|Π|√",
]
# Texts of which any match of an equation pattern holds one.
NEEDED = dict(zip(EQUATION_PATTERNS, (["="], ["\\"], ["$"], ["∑", "∏", "∫", "∂", "∇", "∆"], ["sum", "product", "integral"])))
EQUATION_WORDS = ["equation", "formula", "theorem", "lemma", "proof"]
EXAMPLE_PATTERNS = [
    r"for example",
    r"e\.g\.",
    r"such as",
    rf"example {D}+:",
    r"consider the",
    r"suppose that",
    r"let us",
    r"imagine",
]
PROCEDURE_PATTERNS = [
    r"first,",
    r"then,",
    r"finally,",
    r"step by step",
    r"follow these",
    r"to do this",
    r"begin by",
    r"next,",
]
CODE_PATTERNS = [
    rf"```{W}*\n",
    r"^\s{4,}\S",
    rf"def\s+{W}+\s*\(",
    rf"function\s+{W}+\s*\(",
    rf"class\s+{W}+",
    rf"import\s+{W}+",
    rf"from\s+{W}+\s+import",
    r"if\s+__name__\s*==",
    rf"for\s+{W}+\s+in\s+",
    r"while\s+.*:",
    rf"return\s+{W}+",
]
NUMBERED_STEP = rf"^{D}+[\.)]\s+"
LIST_ITEM = r"^[\*\-\+]\s+"
SEQUENCE_WORDS = ["first", "second", "then", "next", "finally", "lastly"]
TECH_TERMS = [
    "algorithm", "theorem", "proof", "lemma", "corollary",
    "implementation", "optimization", "complexity", "polynomial",
]

# Common words of the language guess.
ENGLISH_WORDS = ["the", "is", "and", "to", "of", "in", "a", "that"]

# Keyword lists of the two keyword-only scorings.
FALLBACK_IMPLEMENTATION = ["algorithm", "method", "step", "procedure", "implement"]
FALLBACK_THEORY = ["theory", "hypothesis", "concept", "principle", "abstract"]
FALLBACK_PRACTICE = ["example", "application", "code", "results", "experiment"]
INDICATOR_ALGORITHM = [
    "algorithm", "procedure", "step", "method", "function",
    "implement", "code", "pseudocode", "formula", "equation",
]
INDICATOR_THEORY = [
    "theory", "hypothesis", "conjecture", "principle", "axiom",
    "theorem", "lemma", "proposition", "abstract", "conceptual",
]
INDICATOR_PRACTICE = [
    "example", "application", "use case", "implementation",
    "tool", "library", "framework", "practical", "real-world",
]

# Suffixes and tokens that mark code.
CODE_SUFFIXES = [".py", ".js", ".java", ".cpp", ".c", ".go", ".rs", ".ts", ".jsx", ".tsx"]
CODE_TOKENS = ["def ", "class ", "import ", "function ", "const ", "var ", "let "]

# Symbols and patterns that survive optical recognition.
MATH_SYMBOLS = ["=", "∑", "∫", "+", "×", "÷", "Σ", "π", "θ", "α", "β"]
OCR_EQUATIONS = [r"[a-zA-Z]\s*=\s*[^=]", rf"{D}+\s*[+\-*/]\s*{D}+", r"[A-Z]\([^)]+\)"]
OCR_ARTIFACTS = ["\ufffd", "|", "\\", "/", "_____"]
EXECUTABLE_LANGUAGES = ["python", "javascript", "bash", "sh"]


def has(c: Column, pattern: str, multiline: bool = False) -> Column:
    """Search; line anchors only at newlines.

    A pattern without metacharacters is a substring test, and one that opens with a literal is only
    tried on texts that hold the literal, which is far cheaper than scanning them with the regex.
    """
    if not re.search(r"[\\.\[\](){}*+?^$|]", pattern):
        return F.contains(c, F.lit(pattern))
    if not re.search(r"[\\.\[\](){}*+?^$]", pattern):
        return any_word(c, pattern.split("|"))
    # one letter before the sign is there whenever several are, and is found without trying each start of a word
    found = c.rlike(("(?md)" if multiline else "(?d)") + (r"[A-Za-z]\s*=\s*[^=]" if pattern == EQUATION_PATTERNS[0] else pattern))
    lead = re.match(r"[A-Za-z_` ]{3,}(?![*?{|A-Za-z_` ])", pattern)
    if lead and "|" not in pattern:
        return F.contains(c, F.lit(lead.group(0))) & found
    if pattern in NEEDED:
        return any_word(c, NEEDED[pattern]) & found
    return found


def any_match(c: Column, patterns: list[str], multiline: bool = False) -> Column:
    return reduce(lambda a, b: a | b, [has(c, p, multiline) for p in patterns])


def any_word(c: Column, words: list[str]) -> Column:
    return reduce(lambda a, b: a | b, [F.contains(c, F.lit(w)) for w in words])


def count_true(flags: list[Column]) -> Column:
    return reduce(lambda a, b: a + b, [f.cast("int") for f in flags])


def count_words(c: Column, words: list[str]) -> Column:
    return count_true([F.contains(c, F.lit(w)) for w in words])


def count_matches(c: Column, patterns: list[str], multiline: bool = False) -> Column:
    flag = "(?md)" if multiline else "(?d)"
    count = lambda p: F.regexp_count(c, F.lit(flag + p))
    return reduce(lambda a, b: a + b, [F.when(any_word(c, NEEDED[p]), count(p)).otherwise(0) if p in NEEDED else count(p) for p in patterns])


def words_of(c: Column) -> Column:
    return F.filter(F.split(c, r"\s+"), lambda x: x != "")


def lines_of(c: Column) -> Column:
    """Lines without their breaks; a final break opens no further line."""
    drop_last = lambda p: F.when(F.element_at(p, -1) == "", F.slice(p, 1, F.size(p) - 1)).otherwise(p)
    return let(F.split(c, LINE_BREAK), drop_last)


def strip(c: Column) -> Column:
    return F.regexp_replace(c, r"^\s+|\s+$", "")


def capped(c: Column, top: float = 1.0) -> Column:
    return F.least(c, F.lit(top))


def clamp(c: Column) -> Column:
    return F.greatest(F.lit(0.0), F.least(c, F.lit(1.0)))


# ---- usability ("conveyance") scores ---------------------------------------------------------------

FLAGS = ["has_algorithms", "has_equations", "has_examples", "has_code", "has_procedures"]
PART_SCORES = ["algorithm_score", "equation_score", "example_score", "code_score", "procedure_score", "structure_score"]
MAIN_SCORES = ["implementation_fidelity", "actionability", "bridge_potential"]


def with_flags(df: DataFrame, text: str = "text") -> DataFrame:
    t = F.coalesce(F.col(text), F.lit(""))
    df = df.withColumn("_t", t).withColumn("_low", F.lower("_t"))
    t, low = F.col("_t"), F.col("_low")
    return df.withColumns(
        {
            "has_algorithms": any_word(low, ALGORITHM_WORDS) | any_match(low, ALGORITHM_PATTERNS, True),
            "has_equations": any_word(low, EQUATION_WORDS) | any_match(t, EQUATION_PATTERNS),
            "has_examples": F.contains(low, F.lit("example")) | any_match(low, EXAMPLE_PATTERNS),
            "has_code": any_match(t, CODE_PATTERNS, True),
            "has_procedures": any_match(low, PROCEDURE_PATTERNS) | has(t, NUMBERED_STEP, True),
        }
    )


def with_scores(df: DataFrame, text: str = "text", code_blocks: str | None = None, structure: str | None = None) -> DataFrame:
    """Flags, part scores, complexity and the three main scores of a text; all zero for an empty text.

    `code_blocks` may name an array<struct<executable:boolean,lines:int>> column and `structure` a
    struct<headers:int,sections:int> column, when a loader has produced them.
    """
    df = with_flags(df, text)
    if code_blocks:
        df = df.withColumn("has_code", F.col("has_code") | (F.coalesce(F.size(code_blocks), F.lit(0)) > 0))
    t, low = F.col("_t"), F.col("_low")
    zero = F.lit(0.0)
    steps = count_matches(t, [NUMBERED_STEP], True)
    algorithm = (
        F.lit(0.3)
        + F.when(has(low, ALGORITHM_PATTERNS[0]), 0.2).otherwise(zero)
        + F.when(steps > 3, F.least(F.lit(0.3), steps * 0.05)).otherwise(zero)
        + F.when(F.contains(low, F.lit("input:")) & F.contains(low, F.lit("output:")), 0.2).otherwise(zero)
    )
    equation = (
        F.lit(0.2)
        + F.least(F.lit(0.5), count_matches(t, EQUATION_PATTERNS[:4]) * 0.05)
        + F.when(has(low, rf"where\s+{W}+\s*="), 0.3).otherwise(zero)
    )
    example = (
        F.lit(0.2)
        + F.least(F.lit(0.5), count_true([has(low, p) for p in EXAMPLE_PATTERNS]) * 0.1)
        + F.when(has(t, D), 0.3).otherwise(zero)
    )
    code = F.lit(0.5)
    if code_blocks:
        runnable = F.size(F.filter(code_blocks, lambda b: b["executable"]))
        n_lines = F.aggregate(F.col(code_blocks), F.lit(0), lambda acc, b: acc + b["lines"].cast("int"))
        code = code + F.coalesce(F.least(F.lit(0.3), runnable * 0.1), zero) + F.when(n_lines > 10, 0.2).otherwise(zero)
    code = code + F.when(F.contains(t, F.lit("import")) & any_word(t, ["if __name__", "def main"]), 0.3).otherwise(zero)
    procedure = (
        F.lit(0.3)
        + F.least(F.lit(0.4), count_true([has(low, p) for p in PROCEDURE_PATTERNS]) * 0.1)
        + F.when(count_words(low, SEQUENCE_WORDS) >= 3, 0.3).otherwise(zero)
    )
    outline = zero
    if structure:
        s = F.col(structure)
        outline = F.coalesce(F.least(F.lit(0.3), s["headers"] * 0.05), zero) + F.when(s["sections"] > 0, 0.2).otherwise(zero)
    outline = (
        outline
        + F.when(has(t, LIST_ITEM, True), 0.2).otherwise(zero)
        + F.when(F.size(F.split(t, "\n\n")) > 3, 0.3).otherwise(zero)
    )
    df = df.withColumn("_words", words_of(t)).withColumns({"_n": F.size("_words"), "_u": F.size(F.array_distinct("_words"))})
    n = F.col("_n")
    complexity = (
        F.when(n > 5000, 0.3).when(n > 2000, 0.2).when(n > 500, 0.1).otherwise(zero)
        + F.when(n > 0, F.least(F.lit(0.3), F.col("_u") / n)).otherwise(zero)
        + F.least(F.lit(0.4), count_words(low, TECH_TERMS) * 0.05)
    )

    def given(flag: str, c: Column) -> Column:
        return F.when(F.col(flag), capped(c)).otherwise(zero)

    df = df.withColumns(
        {
            "algorithm_score": given("has_algorithms", algorithm),
            "equation_score": given("has_equations", equation),
            "example_score": given("has_examples", example),
            "code_score": given("has_code", code),
            "procedure_score": given("has_procedures", procedure),
            "structure_score": F.when(t == "", zero).otherwise(capped(outline)),
            "complexity_score": F.when(t == "", zero).otherwise(capped(complexity)),
        }
    ).drop("_words", "_n", "_u")
    c = F.col
    positive = c("code_score") * 0.4 + c("procedure_score") * 0.3 + c("algorithm_score") * 0.2 + c("equation_score") * 0.1
    action = c("code_score") * 0.4 + c("example_score") * 0.3 + c("procedure_score") * 0.2 + c("structure_score") * 0.1
    theory = F.when(c("has_equations"), 0.3).otherwise(zero) + F.when(c("has_algorithms"), 0.2).otherwise(zero)
    practice = F.when(c("has_code"), 0.3).otherwise(zero) + F.when(c("has_examples"), 0.2).otherwise(zero)
    return df.withColumns(
        {
            "implementation_fidelity": clamp(positive * (F.lit(1.0) - c("complexity_score") * 0.3)),
            "actionability": clamp(action),
            "bridge_potential": F.when(
                (theory > 0) & (practice > 0), capped((theory + practice) * 0.8 + c("algorithm_score") * c("code_score") * 0.2)
            ).otherwise(zero),
        }
    ).drop("_t", "_low")


def settled(df: DataFrame, *cols: str) -> DataFrame:
    """Compute `cols` once before anything filters on them; Catalyst would otherwise copy their whole
    expression into the pushed-down filter and evaluate it twice."""
    rest = [c for c in df.columns if c not in cols]
    return df.select(*rest, F.inline(F.array(F.struct(*cols))))


def fallback_fractions(low: Column) -> dict[str, Column]:
    """Shares of three five-word lists, doubled and capped."""
    n = F.lit(5.0)
    impl = count_words(low, FALLBACK_IMPLEMENTATION) / n
    theory = count_words(low, FALLBACK_THEORY) / n
    practice = count_words(low, FALLBACK_PRACTICE) / n
    return {
        "implementation_fidelity": capped(impl * 2),
        "actionability": capped(practice * 2),
        "bridge_potential": capped((theory + practice) / 2),
    }


def fallback_indicators(low: Column) -> dict[str, Column]:
    """Indicator counts with fixed scores when nothing is found, and the components found."""
    a, t, p = (count_words(low, ws) for ws in (INDICATOR_ALGORITHM, INDICATOR_THEORY, INDICATOR_PRACTICE))
    none = (a + t + p) == 0
    f = F.when(none, 0.3).otherwise(F.least(F.lit(0.9), a / 10.0))
    act = F.when(none, 0.2).otherwise(F.least(F.lit(0.9), p / 8.0))
    bridge = F.when(none, 0.1).when((t > 0) & (p > 0), F.least(F.lit(0.9), (t + p) / 15.0)).otherwise(0.2)

    def found(pairs, default):
        xs = F.array_compact(F.array(*[F.when(F.contains(low, F.lit(k)), F.lit(v)) for k, v in pairs]))
        return F.when(F.size(xs) > 0, xs).otherwise(F.array(F.lit(default)))

    return {
        "implementation_fidelity": f,
        "actionability": act,
        "bridge_potential": bridge,
        "theory_components": found([("information theory", "information theory"), ("entropy", "entropy")], "general concepts"),
        "practice_components": found([("algorithm", "algorithms"), ("implementation", "implementation details")], "general methods"),
        "missing_links": F.when(f < 0.7, F.array(F.lit("detailed examples"), F.lit("code implementations"))).otherwise(F.array().cast("array<string>")),
        "implementation_suggestions": F.when(
            act < 0.7, F.array(F.lit("Create reference implementation"), F.lit("Add practical examples"))
        ).otherwise(F.array(F.lit("Document is already actionable"))),
        "reasoning": F.format_string(
            "Pattern-based analysis found %d algorithm indicators, %d theory indicators, and %d practice indicators.", a, t, p
        ),
        "confidence": F.lit(0.7),
    }


# ---- plain text, markdown, recognised text -------------------------------------------------------


def guess_language(text: Column, found: str = "en") -> Column:
    sample = F.lower(F.substring(text, 1, 1000))
    common = F.array_intersect(F.array_distinct(F.split(sample, r"\s+")), F.array(*[F.lit(w) for w in ENGLISH_WORDS]))
    return F.when(F.size(common) >= 3, F.lit(found)).otherwise(F.lit("unknown"))


def text_stats(text: Column, lines: Column | None = None) -> dict[str, Column]:
    """Statistics of a text; pass its lines as a column to split it once for all of them."""
    lines = lines_of(text) if lines is None else lines
    lengths = F.transform(lines, F.length)
    n = F.size(lines)
    sectioned = F.exists(F.slice(lines, 1, 20), lambda x: x.rlike(rf"^\s*(?:#|==|{D}|(?i:chapter|section))"))
    return {
        "line_count": n,
        "word_count": F.size(words_of(text)),
        "character_count": F.length(text),
        "average_line_length": F.when(n > 0, F.aggregate(lengths, F.lit(0), lambda a, x: a + x) / n).otherwise(F.lit(0.0)),
        "max_line_length": F.coalesce(F.array_max(lengths), F.lit(0)),
        "empty_lines": F.size(F.filter(lines, lambda x: x.rlike(r"^\s*$"))),
        "has_headers": (n >= 3) & sectioned,
        "language": guess_language(text),
    }


HEADER = r"^(#{1,6})\s+(.+)$"
LINK = r"\[([^\]]+)\]\(([^)]+)\)"
IMAGE = r"!\[([^\]]*)\]\(([^)]+)\)"
TABLE_RULE = r"^[\s]*\|[\s]*[-:]+[\s]*\|"
FENCE = rf"(?s)```({W}*)\n(.*?)\n```"
INDENTED = r"\n((?:    .*\n)+)"


def _per_line(lines: Column, pattern: str) -> Column:
    return F.aggregate(F.transform(lines, lambda x: F.regexp_count(x, F.lit(pattern))), F.lit(0), lambda a, x: a + x)


def markdown_structure(text: Column, lines: Column | None = None) -> dict[str, Column]:
    """Counts per document; an image is also a link, as its bracket part matches both."""
    lines = lines_of(text) if lines is None else lines
    header = lambda x: x.rlike(HEADER)
    item = lambda x: x.rlike(rf"^[\s]*[-*+]\s+|^[\s]*{D}+\.\s+")
    return {
        "headers": F.size(F.filter(lines, header)),
        "lists": F.size(F.filter(lines, lambda x: ~header(x) & item(x))),
        "links": _per_line(lines, LINK),
        "images": _per_line(lines, IMAGE),
        "tables": F.size(
            F.filter(
                lines,
                lambda x, i: (i > 0) & x.rlike(TABLE_RULE) & F.coalesce(F.contains(F.get(lines, i - 1), F.lit("|")), F.lit(False)),
            )
        ),
        "blockquotes": F.size(F.filter(lines, lambda x: x.rlike(r"^\s*>"))),
    }


def code_blocks(text: Column) -> Column:
    """Fenced and indented blocks as array<struct<language, code, type, lines, executable>>."""
    lang = F.regexp_extract_all(text, F.lit(FENCE), F.lit(1))
    body = F.regexp_extract_all(text, F.lit(FENCE), F.lit(2))
    fenced = F.zip_with(
        lang,
        body,
        lambda g, b: F.struct(
            F.when(g == "", F.lit("unknown")).otherwise(g).alias("language"),
            b.alias("code"),
            F.lit("fenced").alias("type"),
            F.size(lines_of(b)).alias("lines"),
            g.isin(EXECUTABLE_LANGUAGES).alias("executable"),
        ),
    )

    def plain(b):
        code = F.array_join(F.transform(lines_of(b), lambda x: F.substring(x, 5, 1 << 30)), "\n")
        return F.struct(
            F.lit("unknown").alias("language"),
            code.alias("code"),
            F.lit("indented").alias("type"),
            F.size(lines_of(code)).alias("lines"),
            F.lit(False).alias("executable"),
        )

    return F.concat(fenced, F.transform(F.regexp_extract_all(text, F.lit(INDENTED), F.lit(1)), plain))


def markdown_type(text: Column) -> Column:
    low = F.lower(text)
    return (
        F.when(any_word(F.substring(low, 1, 500), ["documentation", "api reference", "user guide", "tutorial"]), "documentation")
        .when(any_word(F.substring(low, 1, 200), ["author:", "date:", "published:"]), "article")
        .when(any_word(low, ["abstract", "references", "bibliography", "citation"]), "academic")
        .otherwise("general")
    )


def readability(text: Column, words: Column | None = None) -> dict[str, Column]:
    words = words_of(text) if words is None else words
    good = F.size(F.filter(words, lambda w: (F.length(w) > 2) & w.rlike(r"^\p{L}+$")))
    n = F.size(words)
    ratio = F.when(n > 0, good / n).otherwise(F.lit(0.0))
    artifacts = reduce(
        lambda a, b: a + b, [((F.length(text) - F.length(F.replace(text, F.lit(s), F.lit("")))) / len(s)).cast("int") for s in OCR_ARTIFACTS]
    )
    return {"word_count": n, "readable_words": good, "readability": ratio, "artifacts": artifacts, "low_readability": ratio < 0.5}


def ocr_quality(confidence: Column) -> Column:
    return (
        F.when(confidence >= 90, "excellent").when(confidence >= 80, "good").when(confidence >= 70, "fair")
        .when(confidence >= 60, "poor").otherwise("very_poor")
    )


def ocr_equations(text: Column) -> Column:
    """More than five symbols, or more than three of three patterns, which cannot happen."""
    return (count_words(text, MATH_SYMBOLS) > 5) | (count_true([has(text, p) for p in OCR_EQUATIONS]) > 3)


def ocr_tables(text: Column) -> Column:
    gaps = lambda x: F.regexp_count(x, F.lit("  ")) > 2
    marks = F.transform(
        lines_of(text),
        lambda x: (gaps(x) | F.contains(x, F.lit("\t"))).cast("int") + F.contains(x, F.lit("|")).cast("int"),
    )
    return F.aggregate(marks, F.lit(0), lambda a, x: a + x) > 5


def confidence_mean(words: Column, confidences: Column) -> Column:
    """Mean confidence of non-blank words with positive confidence; zero when there are none."""
    kept = F.filter(F.arrays_zip(words.alias("w"), confidences.alias("c")), lambda z: (z["c"] > 0) & (strip(z["w"]) != ""))
    total = F.aggregate(kept, F.lit(0.0), lambda a, z: a + z["c"])
    return F.when(F.size(kept) > 0, total / F.size(kept)).otherwise(F.lit(0.0))


def needs_ocr(n_chars: Column, pages: Column, floor: int = 100) -> Column:
    return F.when(pages > 0, n_chars / pages < floor).otherwise(F.lit(True))


def adapter(text: Column, suffix: Column | None = None) -> Column:
    code = any_word(text, CODE_TOKENS)
    if suffix is not None:
        code = reduce(lambda a, b: a | b, [F.endswith(suffix, F.lit(s)) for s in CODE_SUFFIXES]) | code
    return F.when(code, "code").otherwise("retrieval")


def token_estimate(text: Column, context: int = 16384) -> dict[str, Column]:
    n = F.floor(F.length(text) / 4).cast("int")
    return {"tokens": n, "fits": n <= context}


def truncate_for_context(text: Column, context: int = 20480, reserve: int = 1000) -> Column:
    return F.substring(text, 1, (context - reserve) * 4)


def training_example(text: Column) -> dict[str, Column]:
    return {
        "content": F.substring(text, 1, 1000),
        "has_math": F.contains(text, F.lit("=")) | F.contains(text, F.lit("∑")),
        "has_code": F.contains(text, F.lit("def ")) | F.contains(text, F.lit("function")),
        "content_length": F.length(text),
    }


def reasoning_of(response: Column) -> Column:
    """Inside <reasoning>, else inside <think>, else null."""
    def tag(name):
        p = rf"(?s)<{name}>(.*?)</{name}>"
        return F.when(response.rlike(p), strip(F.regexp_extract(response, p, 1)))

    return F.coalesce(tag("reasoning"), tag("think"))


def parse_analysis(response: Column) -> Column:
    """First balanced JSON block of a model response that carries all three scores; null if none does."""
    blocks = F.regexp_extract_all(response, F.lit(r"(?s)\{[^{}]*(?:\{[^{}]*\}[^{}]*)*\}"), F.lit(0))
    has_all = lambda b: reduce(lambda x, y: x & y, [F.get_json_object(b, f"$.{k}").isNotNull() for k in MAIN_SCORES])
    hit = F.get(F.filter(blocks, has_all), F.lit(0))
    narrative = lambda k: F.slice(
        F.filter(F.transform(F.slice(F.split(F.coalesce(F.get_json_object(hit, f"$.analysis.{k}"), F.lit("")), r"\."), 1, 2), strip), lambda s: s != ""), 1, 2
    )
    num = lambda k, d: F.coalesce(F.get_json_object(hit, f"$.{k}").cast("double"), F.lit(d))
    return F.struct(
        *[num(k, 0.5).alias(k) for k in MAIN_SCORES],
        narrative("implementation_fidelity_analysis").alias("theory_components"),
        narrative("actionability_analysis").alias("practice_components"),
        narrative("bridge_potential_analysis").alias("missing_links"),
        num("confidence", 0.8).alias("confidence"),
        hit.isNotNull().alias("parsed"),
    )


def markdown_table(rows: Column) -> Column:
    """array<array<string>> as a pipe table: header, rule, rows."""
    line = lambda r: F.array_join(r, " | ", "None")
    head = F.get(rows, F.lit(0))
    rule = F.array_join(F.transform(head, lambda _: F.lit("---")), " | ")
    body = F.transform(F.slice(rows, 2, 1 << 30), line)
    return F.when(F.size(rows) > 0, F.array_join(F.concat(F.array(line(head), rule), body), "\n")).otherwise(F.lit(""))


# ---- items of Markdown texts ------------------------------------------------------------------------


def markdown_items(lines: Column) -> Column:
    """Headers, images and links of a text's lines as array<struct<kind, level, text, url, line>>, by line.

    An image is also a link, as in the counts of the structure.
    """

    def of(x, i):
        row = lambda kind, level, text, url: F.struct(F.lit(kind).alias("kind"), level.alias("level"), text.alias("text"), url.alias("url"), (i + 1).alias("line"))
        none = F.lit(None).cast("string")
        head = F.when(x.rlike(HEADER), F.array(row("header", F.length(F.regexp_extract(x, r"^(#+)", 1)), strip(F.regexp_replace(x, r"^#+", "")), none)))
        named = r"\[([^\]]*)\]\(([^)]*)\)"
        marked = lambda kind, p: F.transform(
            F.regexp_extract_all(x, F.lit(p), F.lit(0)), lambda m: row(kind, F.lit(0), F.regexp_extract(m, named, 1), F.regexp_extract(m, named, 2))
        )
        return F.concat(F.coalesce(head, F.filter(marked("header", "!" + named), lambda _: F.lit(False))), marked("image", "!" + named), marked("link", named))

    return F.flatten(F.transform(lines, of))


def frontmatter(text: Column) -> Column:
    """map<key, value> of the `key: value` lines between two --- lines at the start; empty without them."""
    body = F.regexp_extract(text, r"\A---\n([\s\S]*?)\n---", 1)
    pairs = F.filter(F.split(body, "\n"), lambda x: F.contains(x, F.lit(":")))
    entries = F.transform(pairs, lambda x: F.struct(strip(F.substring_index(x, ":", 1)).alias("key"), strip(F.substring(x, F.instr(x, ":") + 1, F.length(x))).alias("value")))
    first = F.filter(entries, lambda e, i: F.array_position(F.transform(entries, lambda o: o["key"]), e["key"]) == i + 1)
    return F.map_from_entries(first)


def fill(template: str, values: dict[str, Column]) -> Column:
    """Template with every {name} replaced by its value; what a value holds is not searched again."""
    out, at = [], 0
    for m in re.finditer(r"\{(\w+)\}", template):
        if m[1] in values:
            out += [F.lit(template[at : m.start()]), F.coalesce(values[m[1]], F.lit(""))]
            at = m.end()
    return F.concat(*out, F.lit(template[at:]))
