"""Ignore rules as rows agree with the same rules as one condition."""

import random
import time

import pytest
from pyspark.sql import functions as F

from stemma.functions import paths as P
from stemma.operators import ignore as IG
from stemma.operators import simjoin

NAMES = ["a", "b", "ab", "src", "build", "x.py", "y.log", "a.b.log", ".git", "doc_1", "doc_12", "log"]
PATTERNS = ["*.log", "*.log/", "src", "build/", "/src", "/src/*", "/a/b*", "a*", "*b", "a/*/b", "**/ab", "doc_1?", "[ab].py", "x.p?", "*oc_*", "*", "/", "src/*.py", "[!a]b", "*.git", "!src", "/a/", ".git/", "?", "*c_1", "a.b.*", "doc*/x.py", "/*.py"]


def random_paths(seed, n):
    rng = random.Random(seed)
    return ["/root/" + "/".join(rng.choice(NAMES) for _ in range(rng.randint(1, 4))) for _ in range(n)]


@pytest.mark.parametrize("broadcast", [32 << 20, 0])
def test_rows_agree_with_condition(spark, monkeypatch, broadcast):
    monkeypatch.setattr(IG, "HOT_ROWS", 50)
    paths = spark.createDataFrame([(p,) for p in random_paths(1, 400)] + [(None,), ("",)], "path string")
    for seed in range(4):
        rng = random.Random(seed)
        rules = [(p, rng.choice(["/root", "/root/src", "/"])) for p in rng.sample([p for p in PATTERNS if p not in ("*", "/", "?")], 7)]
        want = {r.path for r in paths.where(P.gitignored(F.col("path"), rules)).collect()}
        got = [r.path for r in IG.ignored(paths, spark.createDataFrame(rules + [(None, "/"), ("", "/")], "pattern string, dir string"), simjoin.Limits(broadcast_bytes=broadcast)).collect()]
        assert set(got) == want and len(got) == len(want), rules


def test_every_pattern_alone_in_plain_python():
    """A path that the pattern matches always holds the literal of the rule."""
    import re

    for pattern in PATTERNS:
        kind, literal, check = IG.rule_key(pattern, "/root")
        assert kind in {"name", "folder", "suffix", "folder suffix", "path", "head", "tail", "gram", "any"}
        if check:
            for path in random_paths(2, 300):
                if re.search(check, path):
                    names = path.split("/")
                    held = {
                        "name": literal in names, "path": path.startswith(literal), "head": any(n.startswith(literal) for n in names),
                        "tail": any(n.endswith(literal) for n in names), "gram": literal in path, "any": True,
                    }
                    assert held[kind], (pattern, path)


def test_many_rules_without_collecting(spark):
    n = 100_000
    rules = spark.range(n).select(
        F.when(F.col("id") % 2 == 0, F.concat(F.lit("name"), "id")).otherwise(F.concat(F.lit("/top"), "id", F.lit("*"))).alias("pattern"), F.lit("/base").alias("dir")
    )
    paths = spark.createDataFrame([(p,) for p in ["/base/name4/x", "/base/name5", "/base/top7", "/base/x/top7", "/base/q"]], "path string")
    start = time.monotonic()
    assert {r.path for r in IG.ignored(paths, rules).collect()} == {"/base/name4/x", "/base/top7"}
    assert time.monotonic() - start < 60
    assert IG.kept(paths, rules.limit(0)).count() == 5 and IG.ignored(paths.limit(0), rules).count() == 0


def test_rules_with_a_common_beginning_meet_few_paths(spark):
    """Rules named by number share their first letters; each meets the paths of its own number."""
    n = 2000
    i = F.col("id").cast("string")
    shapes = [F.concat(F.lit("doc_"), i, F.lit("?.md")), F.concat(F.lit("/a/doc_"), i, F.lit(".*")), F.concat(F.lit("*_"), i, F.lit(".p?")), F.concat(F.lit("*/doc_"), i, F.lit("*"))]
    rules = spark.range(n).select(F.explode(F.array(*shapes)).alias("pattern"), F.lit("/base").alias("dir"))
    post = IG.posted(rules)
    most = post.groupBy("kind", "literal").count().agg(F.max("count")).first()[0]
    assert most <= 2
    paths = spark.createDataFrame([(p,) for p in ["/base/x/doc_17.md", "/base/a/doc_1999.md", "/base/b/doc_2000.md", "/base/q_5.py", "/base/a/oc_3.md"]], "path string")
    assert {r.path for r in IG.ignored(paths, rules).collect()} == {"/base/x/doc_17.md", "/base/a/doc_1999.md", "/base/b/doc_2000.md", "/base/q_5.py"}
