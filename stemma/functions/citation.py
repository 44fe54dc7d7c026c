"""Citation context features as column expressions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stemma.functions.text import any_word, has, strip, words_of
from stemma.functions.vectors import let

# Citation types in their order with the patterns of each, verbs by tier, keywords and weights.
TYPE_PATTERNS = {
    "builds_on": [r"we (extend|build on|improve|enhance)", r"based on .{0,20} we", r"following .{0,20} we", r"inspired by", r"adapting .{0,20} approach"],
    "implements": [r"we (implement|use|apply|employ)", r"using .{0,20} method", r"following .{0,20} algorithm", r"as described in"],
    "replaces": [r"instead of", r"rather than", r"replaces", r"supersedes", r"improves upon", r"better than"],
    "negates": [r"contrary to", r"does not .{0,20} as claimed", r"incorrect", r"we show that .{0,20} not", r"disproves", r"contradicts"],
    "redefines": [r"we redefine", r"means .{0,20} not", r"should be understood as", r"we propose .{0,20} instead", r"reinterpret"],
    "compares": [r"compared to", r"outperforms", r"in contrast to", r"unlike", r"whereas"],
    "mentions": [r"see also", r"for example", r"such as", r"including", r"e\.g\."],
    "critiques": [r"however", r"limitation", r"fails to", r"does not", r"problem with"],
}
VERBS = {
    "high": ["implement", "extend", "build", "adapt", "improve", "enhance", "apply", "utilize", "incorporate", "integrate"],
    "medium": ["follow", "use", "employ", "consider", "examine", "analyze", "evaluate", "test", "verify"],
    "low": ["mention", "cite", "reference", "note", "acknowledge", "list", "include", "review"],
}
METHOD_WORDS = ["method", "algorithm", "approach", "technique", "procedure"]
FOUNDATION_WORDS = ["based on", "builds on", "extends", "foundation", "fundamental"]
SECTION_WORDS = {
    "related_work": ["related work", "background", "prior work"],
    "methods": ["method", "approach", "algorithm"],
    "introduction": ["introduction", "we propose", "in this"],
}
TYPE_WEIGHTS = {
    "builds_on": 0.9, "implements": 0.8, "replaces": 0.7, "redefines": 0.6,
    "compares": 0.5, "critiques": 0.3, "negates": 0.4, "mentions": 0.2,
}
SECTION_WEIGHTS = {"methods": 0.8, "introduction": 0.6, "related_work": 0.3, "other": 0.4}
COMMON_CONCEPTS = ["The", "This", "These", "That", "Those", "We", "Our", "In", "For"]


def sentence_with(paragraph: Column, citation: Column) -> Column:
    """First sentence piece that holds the citation, trimmed."""
    pieces = F.filter(F.split(paragraph, "[.!?]+"), lambda s: F.contains(s, citation))
    return F.coalesce(strip(F.get(pieces, F.lit(0))), F.lit(""))


def citation_type(low: Column) -> Column:
    """The last type in order that matches; empty when none does."""
    out = None
    for t, ps in reversed(TYPE_PATTERNS.items()):
        hit = reduce(lambda a, b: a | b, [has(low, p) for p in ps])
        out = F.when(hit, t) if out is None else out.when(hit, t)
    return out.otherwise("")


def action_verbs(low: Column) -> Column:
    verbs = F.array(*[F.lit(v) for tier in VERBS.values() for v in tier])
    return F.filter(verbs, lambda v: F.contains(low, v))


def section_type(before_low: Column) -> Column:
    out = None
    for s, ws in SECTION_WORDS.items():
        out = F.when(any_word(before_low, ws), s) if out is None else out.when(any_word(before_low, ws), s)
    return out.otherwise("other")


def with_features(df: DataFrame, text: str = "citation_text", before: str = "context_before") -> DataFrame:
    low = F.lower(F.col(text))
    return df.withColumn("_l", low).withColumns(
        {
            "citation_type": citation_type(F.col("_l")),
            "high_verb": any_word(F.col("_l"), VERBS["high"]),
            "medium_verb": any_word(F.col("_l"), VERBS["medium"]),
            "action_verbs": action_verbs(F.col("_l")),
            "is_methodological": any_word(F.col("_l"), METHOD_WORDS),
            "is_foundational": any_word(F.col("_l"), FOUNDATION_WORDS),
            "section_type": section_type(F.lower(F.col(before))),
        }
    ).drop("_l")


def influence(similarity: Column) -> Column:
    """Influence score of a context from its features and its similarity to the cited paper."""
    c = F.col
    weight = lambda key, table, default: F.coalesce(
        F.try_element_at(F.create_map(*[F.lit(x) for kv in table.items() for x in kv]), key), F.lit(default)
    )
    s = (
        similarity * 0.4
        + weight(c("citation_type"), TYPE_WEIGHTS, 0.1) * 0.3
        + F.when(c("high_verb"), 0.2).when(c("medium_verb"), 0.1).otherwise(0.0)
        + F.when(c("is_methodological"), 0.1).otherwise(0.0)
        + F.when(c("is_foundational"), 0.15).otherwise(0.0)
    )
    return F.least(F.lit(1.0), s * weight(c("section_type"), SECTION_WEIGHTS, 0.5))


def dominant_type() -> list[Column]:
    """Aggregates over the contexts of one citing/cited pair."""
    t, n = F.col("citation_type"), F.count("*")
    share = lambda name: F.count_if(t == name)
    return [
        F.when(share("implements") > 0, "implementation")
        .when(share("builds_on") > n / 2, "extension")
        .when(share("compares") > n / 2, "comparison")
        .when(F.bool_or("is_methodological"), "methodological")
        .otherwise("reference")
        .alias("conveyance_type")
    ]


def concepts(text: Column) -> Column:
    """Distinct capitalised phrases of a text without the common openers."""
    found = F.array_distinct(F.regexp_extract_all(text, F.lit(r"\b[A-Z][a-z]+(?:\s+[A-Z][a-z]+)*\b"), F.lit(0)))
    return F.array_except(found, F.array(*[F.lit(w) for w in COMMON_CONCEPTS]))


def shared_concepts(a: Column, b: Column, top: int = 10) -> Column:
    return F.slice(F.array_sort(F.array_intersect(a, b)), 1, top)


def usage_window(text: Column, concept: Column) -> Column:
    """Three words either side of the first word holding the concept, in the first sentence whose words hold it."""
    low = F.lower(concept)
    held = lambda w: F.contains(F.lower(w), low)
    sentences = F.filter(F.split(text, "[.!?]+"), lambda s: F.contains(F.lower(s), low))
    words = F.get(F.filter(F.transform(sentences, words_of), lambda ws: F.exists(ws, held)), F.lit(0))

    def around(ws):
        first = F.get(F.filter(F.transform(ws, lambda w, i: F.when(held(w), i)), lambda i: i.isNotNull()), F.lit(0))
        return let(first, lambda at: F.array_join(F.slice(ws, F.greatest(at - 3, F.lit(0)) + 1, at + 4 - F.greatest(at - 3, F.lit(0))), " "))

    return F.coalesce(let(words, around), F.lit(""))
