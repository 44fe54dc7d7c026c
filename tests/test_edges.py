from itertools import combinations

import pytest
from pyspark.sql import functions as F

from stemma.functions import paths as P
from stemma.operators import edges as E

SCHEMA = "path string, parent string, stem string, ext string, perms string, owner string, size long, readable boolean, executable boolean, encrypted boolean, compressed boolean, special_tool boolean, content string"


def row(path, ext, content=None, perms="644", owner="u", size=10, readable=True, encrypted=False, compressed=False, tool=False):
    parent, name = path.rsplit("/", 1)
    return (path, parent, name[: -len(ext)], ext, perms, owner, size, readable, False, encrypted, compressed, tool, content)


@pytest.fixture(scope="module")
def hot(spark):
    """Half of the files share a directory; sizes straddle the large-file bound."""
    sizes = [10, 99_999_999, 100_000_000, 100_000_001, 150_000_000, 200_000_000, 250_000_000, 70_000_000]
    rows = []
    for i in range(90):
        d = "/r/hot" if i % 2 else f"/r/d{i % 5}"
        ext = [".py", ".json", ".md"][i % 3]
        text = f"import m{(i * 5) % 90}\nsee m{(i * 7) % 90} and m1" if ext == ".py" else None
        rows.append(row(f"{d}/m{i}{ext}", ext, text, perms="644" if i % 4 else "600", owner=f"u{i % 3}", size=sizes[i % 8] + i, readable=i % 7 != 0, encrypted=i % 11 == 0, compressed=i % 5 == 0, tool=i % 13 == 0))
    return rows, spark.createDataFrame(rows, SCHEMA).cache()


def brute(rows):
    names = SCHEMA.replace(",", "").split()[::2]
    out = []
    for a, b in combinations(sorted(rows), 2):
        a, b = dict(zip(names, a)), dict(zip(names, b))
        w = 0.9 if a["perms"] == b["perms"] else 0.8 if a["readable"] and b["readable"] else 0.0
        for flag, f in (("encrypted", 0.1), ("compressed", 0.8), ("special_tool", 0.5)):
            w *= f if a[flag] or b[flag] else 1.0
        w *= 0.7 if (a["size"] + b["size"]) / 2 > 100_000_000 else 1.0
        if a["owner"] == b["owner"]:
            w = min(w * 1.1, 1.0)
        what = 0.0
        if a["ext"] == b["ext"]:
            what = {".py": 0.5, ".json": 0.7, ".md": 0.6}[a["ext"]]
            if a["ext"] == ".py":
                def says(x, y):
                    return f"import {y['stem']}" in x["content"] or f"from {y['stem']}" in x["content"]

                if says(a, b) or says(b, a):
                    what = 0.9
                elif b["stem"] in a["content"] or a["stem"] in b["content"]:
                    what = 0.7
        out.append((a, b, w, what))
    return out


def test_conveyance_counts(hot):
    rows, df = hot
    want = {}
    for _, _, w, _ in brute(rows):
        if w > 0.1:
            want[round(w, 9)] = want.get(round(w, 9), 0) + 1
    got = {r.w: r.n for r in E.conveyance_counts(df).groupBy(F.round("weight", 9).alias("w")).agg(F.sum("n_pairs").alias("n")).collect()}
    assert got == want


@pytest.mark.parametrize("limit", [16 << 20, 0], ids=["search", "join"])
def test_mentions_both_ways(hot, limit):
    rows, df = hot
    py = [r for r in rows if r[3] == ".py"]
    want = {(a[0], b[2], f"import {b[2]}" in a[12] or f"from {b[2]}" in a[12]) for a in py for b in py if b[2] in a[12]}
    assert {(r.path, r.hit, r.imported) for r in E.mentions(df, broadcast_bytes=limit).collect()} == want


def test_what_counts(hot):
    rows, df = hot
    want = {}
    for a, _, _, t in brute(rows):
        if t:
            want[(a["ext"], t)] = want.get((a["ext"], t), 0) + 1
    assert {(r.ext, r.weight): r.n_pairs for r in E.what_counts(df).collect()} == want


def test_composite_counts(hot):
    rows, df = hot
    want = {}
    for a, b, w, t in brute(rows):
        if t and w > 0.1 and a["parent"] == b["parent"]:
            k = (a["parent"], a["ext"], round(0.8 * t * w, 9))
            want[k] = want.get(k, 0) + 1
    got = E.composite_counts(df).groupBy("parent", "ext", F.round("composite", 9).alias("c")).agg(F.sum("n_pairs").alias("n")).collect()
    assert {(r.parent, r.ext, r.c): r.n for r in got} == want


def test_edges_of_one_file(hot):
    rows, df = hot
    path = sorted(rows)[3][0]
    want = {}
    for a, b, w, _ in brute(rows):
        if path in (a["path"], b["path"]) and w > 0.1:
            want[b["path"] if a["path"] == path else a["path"]] = round(w, 9)
    got = {r.dst: round(r.conveyance, 9) for r in E.edges_of(df, [path]).where("conveyance > 0.1").collect()}
    assert got == want


def weight(spark, **flags):
    base = dict.fromkeys(E.PAIR_FLAGS, False) | flags
    return spark.createDataFrame([tuple(base.values())], ", ".join(f"{k} boolean" for k in base)).select(E.conveyance_weight().alias("w")).first().w


def test_weight_examples(spark):
    same = dict(same_perms=True, same_owner=True, both_readable=True)
    assert weight(spark, **same) == pytest.approx(0.99)
    assert weight(spark, **same, compressed=True) == pytest.approx(0.792)
    assert weight(spark, **same, special_tool=True) == pytest.approx(0.495)
    assert weight(spark, **same, encrypted=True) == pytest.approx(0.099)
    assert weight(spark, both_readable=True) == pytest.approx(0.8)


def test_source_tree(spark):
    rows = [row("/t/src/main.py", ".py", "from utils import f\nimport config"), row("/t/src/utils.py", ".py", "def f(): pass"), row("/t/docs/readme.md", ".md")]
    df = spark.createDataFrame(rows, SCHEMA)
    assert [(r.ext, r.weight, r.n_pairs) for r in E.what_counts(df).collect()] == [(".py", 0.9, 1)]
    assert {(r.src, r.dst) for r in E.contains_edges(df).collect()} >= {("/t", "/t/src"), ("/t/src", "/t/src/main.py")}


def test_three_siblings(spark):
    df = spark.createDataFrame([row(f"/d/f{i}.md", ".md") for i in range(3)], SCHEMA)
    r = {x.parent: (x.weight, x.n_edges) for x in E.sibling_counts(df).collect()}
    assert r == {"/d": (0.8, 6)}


def test_paths(spark):
    df = spark.createDataFrame([("/a/.git/x.py",), ("/a/.environment/b.tar.gz",), ("/a/b/.hidden",)], "p string")
    rows = df.select(P.ignored(F.col("p")).alias("i"), P.skipped(F.col("p")).alias("s"), P.suffix(F.col("p")).alias("e"), P.stem(F.col("p")).alias("n")).collect()
    assert [(r.i, r.s, r.e, r.n) for r in rows] == [(True, True, ".py", "x"), (False, True, ".gz", "b.tar"), (False, False, "", ".hidden")]


def test_class_filename(spark):
    df = spark.createDataFrame([("Convolutional Neural Networks", "Yann LeCun", "arxiv_2305.14239", ["cs.LG"])], "t string, a string, s string, c array<string>")
    code = P.classify(F.col("t"), F.lit(""), F.col("c"))
    r = df.select(P.class_filename(code["code"], F.lit("2023-05-01"), F.col("a"), F.col("t"), F.col("s")).alias("f")).first()
    assert r.f == "QA76.9.A43_2023_LeCun_Y_CNN_2305_14239.pdf"


@pytest.mark.parametrize("k, above", [(5, 0.5), (400, 0.2)])
def test_strongest_edges_are_pairs(hot, k, above):
    rows, df = hot
    every = [(-round(0.8 * what * w, 6), a["parent"], a["ext"], what, a["path"], b["path"], round(w, 6)) for a, b, w, what in brute(rows) if a["parent"] == b["parent"] and what and w > 0.1 and 0.8 * what * w > above]
    got = [(-r.composite_weight, r.src.rsplit("/", 1)[0], "." + r.src_name.rsplit(".", 1)[1], r.what_weight, r.src, r.dst, r.conveyance_weight) for r in E.strongest(df, k, above).collect()]
    assert len(every) > k or k > 5
    assert got == sorted(every)[:k]
