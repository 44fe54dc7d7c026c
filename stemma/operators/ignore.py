"""Ignore rules as rows: any number of rules against any number of paths, nothing collected.

Every rule is posted under one literal that a matching path must hold: a whole name, a suffix, the first
or last letters of a name, the beginning of an anchored path, or letters in a row. The longest such literal
is taken whole, so that rules which differ only in their last letters do not meet each other's paths. Paths
are looked up by the same literals, cut to the lengths that rules have, and only the pairs that meet are
checked with the rule's pattern. Names and suffixes need no check. Rules without any literal (such as `*`)
meet every path.
"""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stemma.functions import paths as P
from stemma.operators.simjoin import Limits, measure
from stemma.session import cut_lineage

HOT_ROWS = 100_000
_WILD = re.compile(r"\*|\?|\[[^\]]*\]")
LONGEST = 64  # letters of a literal; more do not tell rules apart
SIZED = ("path", "head", "tail", "gram")


def rule_key(pattern: str, base: str) -> tuple[str, str, str | None]:
    """Kind and literal under which a rule is posted, and the pattern left to check, if any.

    Kinds: name, folder (a name above the last), suffix, folder suffix, path, head, tail, gram, any.
    """
    only_dirs = pattern.endswith("/")
    bare = pattern[:-1] if only_dirs else pattern
    anchored = bare.startswith("/")
    body = bare[1:] if anchored else bare
    head = "^" + re.escape(base.rstrip("/") + "/") if anchored else "(^|/)"
    check = head + P.glob_regex(body) + ("/" if only_dirs else "(/|$)")
    parts = _WILD.sub("\0", body).split("/")
    whole = [p for p in parts if p and "\0" not in p]
    if not anchored and parts == whole and len(parts) == 1:
        return ("folder" if only_dirs else "name"), body, None
    if not anchored and re.fullmatch("\0\\.[^.\0]+", parts[0]) and len(parts) == 1 and body[0] == "*":
        return ("folder suffix" if only_dirs else "suffix"), body[1:], None
    if anchored:
        lead = []
        for p in parts:
            if "\0" in p:
                lead.append(p.split("\0")[0])
                break
            lead.append(p)
        return "path", base.rstrip("/") + "".join("/" + p for p in lead), check
    if whole:
        return "name", max(whole, key=len), check
    first, last = parts[0].split("\0")[0], parts[-1].split("\0")[-1]
    inner = max((x for p in parts for x in p.split("\0")), key=len, default="")
    if len(inner) >= 3 and len(inner) > max(len(first), len(last)):
        return "gram", inner[:LONGEST], check
    if len(last) >= len(first) and last:
        return "tail", last[-LONGEST:], check
    return ("head", first[:LONGEST], check) if first else ("any", "", check)


def posted(rules: DataFrame) -> DataFrame:
    """(kind, literal, check) of rules (pattern, dir); null and empty patterns are none."""

    def run(batches):
        for pdf in batches:
            yield pd.DataFrame([rule_key(p, d or "/") for p, d in zip(pdf["pattern"], pdf["dir"])], columns=["kind", "literal", "check"])

    known = rules.select("pattern", "dir").where("pattern <> ''").distinct()
    return cut_lineage(known.mapInPandas(run, "kind string, literal string, check string").distinct())


def _literals(path: Column, kinds: set[str], sizes: dict[str, list[int]]) -> Column:
    """array<struct<kind, literal>> of all that rules of these kinds, with literals of these lengths, could be posted under."""
    every = F.split(path, "/")
    above = F.slice(every, 1, F.greatest(F.size(every) - 1, F.lit(0)))
    suffix = lambda x: F.regexp_extract(x, r"(\.[^.]*)$", 1)
    fits = lambda kind, x: F.filter(F.array(*[F.lit(n) for n in sizes.get(kind, [0])]), lambda n: n <= F.length(x))
    heads = lambda kind, x: F.transform(fits(kind, x), lambda n: x.substr(F.lit(1), n))
    tails = lambda x: F.transform(fits("tail", x), lambda n: x.substr(F.length(x) - n + 1, n))
    grams = lambda x: F.flatten(F.transform(fits("gram", x), lambda n: F.transform(F.sequence(F.lit(1), F.length(x) - n + 1), lambda i: x.substr(i, n))))
    found = {
        "name": every,
        "folder": above,
        "suffix": F.transform(every, suffix),
        "folder suffix": F.transform(above, suffix),
        "path": heads("path", path),
        "head": F.flatten(F.transform(every, lambda x: heads("head", x))),
        "tail": F.flatten(F.transform(every, tails)),
        "gram": F.flatten(F.transform(every, grams)),
        "any": F.array(F.lit("")),
    }
    of = lambda kind: F.transform(F.array_distinct(found[kind]), lambda x: F.struct(F.lit(kind).alias("kind"), x.alias("literal")))
    return F.concat(*[of(k) for k in found if k in kinds])


def ignored(paths: DataFrame, rules: DataFrame, limits: Limits = Limits()) -> DataFrame:
    """The distinct `path`s that any of the rules (pattern, dir of its ignore file) ignores."""
    post = posted(rules)
    sized = F.when(F.col("kind").isin(*SIZED), F.length("literal")).otherwise(F.lit(0))
    found = post.select("kind", sized.alias("n")).distinct().collect()  # at most nine kinds and the lengths of literals
    kinds = {r["kind"] for r in found}
    sizes = {k: sorted(r["n"] for r in found if r["kind"] == k) for k in kinds}
    known = paths.select("path").where("path IS NOT NULL").distinct()
    if not kinds:
        return known.limit(0)
    key = ["kind", "literal"]
    rows = known.select("path", F.inline(_literals(F.col("path"), kinds, sizes)))
    if measure(post)[1] <= limits.broadcast_bytes:
        met = rows.join(F.broadcast(post), key)
    else:  # frequent literals are dealt over several tasks
        rows = cut_lineage(rows.join(post.select(*key).distinct(), key, "left_semi"))
        hot = rows.groupBy(*key).agg(F.ceil(F.count("*") / HOT_ROWS).cast("int").alias("parts")).where("parts > 1")
        dealt = rows.join(F.broadcast(hot) if hot.count() <= 10_000 else hot, key, "left").withColumn("part", F.pmod(F.xxhash64("path"), F.coalesce("parts", F.lit(1))).cast("int"))
        copies = post.join(hot, key, "left").withColumn("part", F.explode(F.sequence(F.lit(0), F.coalesce("parts", F.lit(1)) - 1))).drop("parts")
        met = dealt.drop("parts").join(copies, [*key, "part"])
    return met.where("check IS NULL OR path RLIKE check").select("path").distinct()


def kept(files: DataFrame, rules: DataFrame, limits: Limits = Limits()) -> DataFrame:
    """The files that no rule ignores."""
    return files.join(ignored(files, rules, limits), "path", "left_anti")
