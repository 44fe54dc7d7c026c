import hashlib
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from stemma.llm import merkle

COLUMNS = "doc_id long, source string, lang string, n_chars long, text string, g string, i int, digest string"


def H(*x):
    return hashlib.sha256("".join(x).encode()).hexdigest()


def tree(nodes):
    """All levels of a tree, leaves first."""
    levels = [nodes]
    while len(levels[-1]) > 1:
        at = levels[-1]
        levels.append([H(*at[k : k + 3]) for k in range(0, len(at), 3)])
    return levels


def path(levels, i):
    out = []
    for level in levels[:-1]:
        run = level[i // 3 * 3 : i // 3 * 3 + 3]
        out.append((run[: i % 3], run[i % 3 + 1 :]))
        i //= 3
    return out


def write(v):
    return "-" if v is None else f"{len(str(v).encode())}:{v}"


def brute(rows, tampered):
    groups = defaultdict(list)
    for r in rows:
        now = H(*map(write, (*r[:4], r[4] and r[4].replace("\n", "")))) if tampered(r[0]) else None
        groups[r[1]].append((r[0] is not None, r[0] or 0, H(*map(write, r[:5])), now))
    names = sorted(groups, key=lambda s: (s is not None, (s or "").encode()))
    trees = {}
    for s in names:
        groups[s].sort(key=lambda x: x[:3])
        trees[s] = tree([x[2] for x in groups[s]])
    top = tree([trees[s][-1][0] for s in names])
    out = []
    for k, s in enumerate(names):
        for i, (named, doc_id, leaf, now) in enumerate(groups[s]):
            up = path(trees[s], i) + path(top, k)
            folded = now or leaf
            for a, b in up:
                folded = H(*a, folded, *b)
            out.append((doc_id if named else None, leaf, trees[s][-1][0], top[-1][0], H(*[x for a, b in up for x in a + b]), folded, folded == top[-1][0]))
    return sorted(out, key=str)


def rows_of(n, hot=0.5):
    out = []
    for i in range(n):
        source = "hot" if i < n * hot else [None, "", "é", "z", "=", "src1"][i % 6]
        out.append((i * 7 % n, source, [None, "en"][i % 2], [None, i][i % 3 == 0], [None, "", "a\nb", f"text {i}\n", "é\n\n"][i % 5], "g", i, "d"))
    return out


@pytest.mark.parametrize("n,hot", [(1, 1), (2, 1), (3, 1), (4, 0.3), (28, 0.9), (243, 1), (244, 1), (730, 1), (1600, 0.6)])
def test_proofs_match_plain_trees(spark, n, hot):
    rows = rows_of(n, hot)
    df = spark.createDataFrame(rows, COLUMNS).repartition(5)
    got = merkle.proofs(df, F.col("doc_id") % 2 == 0, F.replace(F.col("text"), F.lit("\n"), F.lit("")))
    assert sorted(map(tuple, got.collect()), key=str) == brute(rows, lambda i: i % 2 == 0)


def test_repeated_rows_null_ids_and_empty_table(spark):
    rows = [(5, "s", "en", 3, "a\nb", "", 1, "")] * 40 + [(None, "s", None, None, None, "", 1, "")] * 3 + [(5, "s", "en", 3, "other", "", 1, ""), (1, None, None, 1, "x", "", 1, "")]
    df = spark.createDataFrame(rows, COLUMNS)
    run = lambda d: merkle.proofs(d, F.col("doc_id") == 5, F.replace(F.col("text"), F.lit("\n"), F.lit("")))
    assert sorted(map(tuple, run(df).collect()), key=str) == brute(rows, lambda i: i == 5)
    assert run(df.limit(0)).count() == 0


def test_small_packs_and_joined_counts(spark, monkeypatch):
    """Many tiers, and counts of ranges that are not sent to the tasks."""
    from stemma.llm import tables

    monkeypatch.setattr(merkle, "LEVELS", 1)
    monkeypatch.setattr(merkle, "SPAN", 3)
    monkeypatch.setattr(tables, "SMALL_ROWS", 0)
    rows = rows_of(90, 0.8)
    got = merkle.proofs(spark.createDataFrame(rows, COLUMNS), F.col("doc_id") % 2 == 0, F.lit("changed"))
    want = [r for r in brute(rows, lambda i: False)]
    assert sorted(tuple(r)[:5] for r in got.collect()) == sorted(r[:5] for r in want)
    assert {r.doc_id % 2 == 0 for r in got.where("not verified").collect()} == {True}


def test_records_address_their_content(spark):
    nodes = spark.range(500).select(F.lit("a").alias("g"), F.col("id").alias("i"), F.lit(500).cast("long").alias("n"), F.sha2(F.col("id").cast("string"), 256).alias("digest"))
    roots, tiers = merkle.build(nodes)
    stored = {r.digest: r.children for r in merkle.records(tiers).collect()}
    assert all(H(*c) == d and 1 <= len(c) <= 3 for d, c in stored.items())
    reached, todo = 0, [roots.first().digest]
    while todo:
        kids = stored.get(todo.pop())
        reached += kids is None
        todo += kids or []
    assert reached == 500
