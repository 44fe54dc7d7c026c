import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from stemma import jobs
from stemma.functions import jsonops as J
from stemma.functions import validation as VA
from stemma.functions import vectors as V
from stemma.operators import bridges as B
from stemma.operators import layout as L
from stemma.operators.simjoin import Limits
from stemma.sources import files as FS

SOURCE = '''"""Doc."""
import os
from a.b import c


class K:
    """A class."""
    def m(self, x):
        if x and x > 1 or x < 0:
            return f(x)


@dec
def f(y):
    """Line one.
    two"""
    import sys
    def inner():
        return g(y)
    return inner()


def g(z):
    return z
'''


def test_python_symbols(spark):
    df = spark.createDataFrame([("a", SOURCE), ("bad", "def (")], "p string, t string")
    rows = {r.p: r for r in FS.parse_python(df, "p", "t").collect()}
    s = {x.key: x for x in rows["a"].symbols}
    assert set(s) == {"K", "K.m", "f", "inner", "g"}
    assert (s["K.m"].type, s["K.m"].parent, s["K.m"].complexity, s["K.m"].calls) == ("method", "K", 4, ["f"])
    assert (s["f"].decorators, s["f"].imports, s["f"].calls, s["inner"].calls) == (["dec"], ["sys"], ["inner"], ["g"])
    assert [(i.module, i.name, i.type) for i in rows["a"].imports] == [("os", None, "import"), ("a.b", "c", "from_import"), ("sys", None, "import")]
    assert rows["bad"].symbols == [] and rows["bad"].syntax_error


def test_symbol_chunks(spark):
    df = spark.createDataFrame([("a", SOURCE)], "p string, t string")
    d = df.join(FS.parse_python(df, "p", "t"), "p")
    rows = FS.symbol_chunks(d, "p", "t", "symbols").orderBy("chunk").collect()
    assert [(r.chunk_type, r.line_start, r.symbols) for r in rows] == [("class", 1, ["K", "m"]), ("function", 14, ["f"]), ("function", 18, ["inner"]), ("function", 23, ["g"])]
    assert [r.line_end for r in rows] == [13, 17, 22, 24]
    assert [r.complexity for r in rows] == [0, 1, 1, 1]
    assert {(r.caller, r.callee) for r in FS.call_edges(d, "p", "symbols").collect()} == {("K.m", "f"), ("f", "inner"), ("inner", "g")}


@pytest.fixture()
def tree(tmp_path):
    for name, body in {
        "pkg/__init__.py": "", "pkg/sub/__init__.py": "", "pkg/sub/mod.py": SOURCE, "pkg/loose/x.py": "x = 1", "notes/a.txt": "one two\nthree",
        "notes/latin.txt": "caf\xe9".encode("latin-1"), "notes/read.md": "# T\n- a\n```python\nprint(1)\n```\n", "data/d.jsonl": '{"id": 1}\n\n{"id": 2}\n', ".git/x.txt": "no",
        "build/out.txt": "no", ".gitignore": "build/\n# c\n*.log\n", "notes/z.log": "no",
    }.items():
        p = tmp_path / "tree" / name
        p.parent.mkdir(parents=True, exist_ok=True)
        p.write_bytes(body if isinstance(body, bytes) else body.encode())
    return str(tmp_path / "tree")


def test_scan_and_loaders(spark, tree):
    rules = FS.ignore_rules(spark, tree)
    files = FS.scan(spark, tree, rules)
    names = {r.name for r in files.collect()}
    assert names == {"__init__.py", "mod.py", "x.py", "a.txt", "latin.txt", "read.md", "d.jsonl", ".gitignore"}
    root = tree.strip("/").replace("/", ".")
    pk = {r.path.removeprefix(tree): r.package for r in FS.packages(files).collect()}
    assert pk["/pkg/sub/mod.py"] == "pkg.sub" and pk["/pkg/loose/x.py"] == "" and root
    t = {r.path.rsplit("/", 1)[1]: (r.text, r.encoding, r.line_count) for r in FS.load_text(spark, tree + "/notes").collect()}
    assert t["latin.txt"] == ("café", "latin-1", 1) and t["a.txt"][1:] == ("utf-8", 2)
    m = FS.load_markdown(spark, tree).first()
    assert m.structure.headers == 1 and m.code_blocks[0].executable
    j = FS.load_json(spark, tree).first()
    assert j.s.kind == "list" and j.patterns == ["homogeneous_list"]
    assert FS.load_python(spark, tree).count() == 4


def test_binary_plugin_keeps_failures(spark, tree):
    def read(b):
        if b.startswith(b"caf"):
            raise ValueError("broken")
        return {"pages": ["p1", "p2"], "metadata": {"n": len(b)}}

    rows = {r.path.rsplit("/", 1)[1]: r for r in FS.load_binary(spark, tree + "/notes", [".txt"], read).withColumn("t", FS.page_text(F.col("pages"))).collect()}
    assert rows["a.txt"].t == "[Page 1]\np1\n\n[Page 2]\np2" and rows["latin.txt"].error == "broken"


def test_jobs_resume(spark, tree, tmp_path):
    out = str(tmp_path / "out")
    nodes = jobs.process(spark, tree + "/pkg", out)
    assert nodes.read().count() == 4
    jobs.process(spark, tree + "/pkg", out)
    assert nodes.read().count() == 4
    results = jobs.ST.Table(spark, out, "results").read()
    assert results.where("success").count() == 4 and results.where("path LIKE '%mod.py'").first().implementation_fidelity > 0
    chunks = jobs.ST.Table(spark, out, "chunks").read()
    assert chunks.select("doc_id").distinct().count() == 4 and chunks.where("size(embedding) = 64").count() == chunks.count()
    tables = jobs.build(spark, tree + "/pkg", out, {"graph": {"similarity": 0.1}})
    assert tables["contains"].count() > 3


def test_jobs_count_what_they_met(spark, tmp_path):
    root, out = tmp_path / "in", str(tmp_path / "out")
    root.mkdir()
    (root / "a.txt").write_text("An algorithm. First, implement it.")
    (root / "b.md").write_text("# Head\n\ntext")
    (root / "gone.txt").symlink_to(root / "nothing.txt")
    seen = {}
    jobs.process(spark, str(root), out, counters=seen)
    assert (seen["processed"], seen["failed"]) == (2, 1) and seen["seconds"] > 0
    bad = jobs.ST.Table(spark, out, "results").read().where("NOT success").collect()
    assert [r.path.rsplit("/", 1)[1] for r in bad] == ["gone.txt"] and bad[0].error.startswith("FileNotFoundError")
    (root / "gone.txt").unlink()
    again = {}
    jobs.process(spark, str(root), out, counters=again)
    assert (again["processed"], again["failed"]) == (0, 0)


def test_json_shape(spark):
    df = spark.createDataFrame([('{"id":1,"data":[1,2],"status":"ok","meta":{"t":1.5}}',), ("nope",), ("[]",)], "j string")
    rows = df.select(J.describe("j").alias("s")).select("s", J.complexity("s").alias("c"), J.data_type("s").alias("d"), J.patterns("s").alias("p")).collect()
    r = rows[0]
    assert (r.s.depth, len(r.s.value_types), r.c, r.d, r.p) == (2, 4, 1.0, "api_response", ["identifiers", "metadata"])
    assert r.s.content == "id: 1 data: 1 2 status: ok meta: t: 1.5"
    assert rows[1].s.kind is None and (rows[2].s.depth, rows[2].s.arrays) == (0, True)


def test_validation(spark):
    df = spark.createDataFrame([(0.9, 0.2, 0.0, [], [], "", "algorithm step method")], "implementation_fidelity double, actionability double, bridge_potential double, theory_components array<string>, practice_components array<string>, reasoning string, text string")
    r = VA.validate(df).first()
    assert len(r.issues) == 2 and r.consistency_score == pytest.approx(0.74) and not r.is_valid


def test_kappa_and_metrics(spark):
    d = spark.createDataFrame([(0.0, 0.1, 0.05), (0.02, 0.5, 0.1)], ", ".join(f"diff_{k} double" for k in VA.MAIN_SCORES))
    assert VA.kappa(d).first().kappa == pytest.approx(0.814815, abs=1e-6)
    m = spark.createDataFrame([(0.9, 0.9, 0.9), (0.9, 0.9, 0.5)], "f double, a double, b double")
    assert [r.m for r in m.select(VA.bridge_metric(F.col("f"), F.col("a"), F.col("b")).alias("m")).collect()] == pytest.approx([1.0, 0.405])


def test_vector_formulas(spark):
    df = spark.createDataFrame([([3.0, 4.0], [0.0, 0.0], "/data/papers/Q/QA76.9.A43/x.pdf", ["/", "a", "b"], ["/", "a", "c"])], "a array<double>, b array<double>, p string, c array<string>, d array<string>")
    r = df.select(
        V.unit(F.col("a")).alias("u"), V.unit(F.col("b")).alias("z"), V.cosine(F.col("a"), F.col("b")).alias("cos"), V.where_vector(F.col("p")).alias("w"), V.path_distance(F.col("c"), F.col("d")).alias("pd"),
        V.weighted_distance(F.lit(0.5), F.lit(0.2), F.lit(0.5)).alias("wd"), V.geometric_mean(F.lit(0.9), F.lit(0.8), F.lit(0.7)).alias("g"), V.geometric_mean(F.lit(-0.5), F.lit(0.5), F.lit(0.5)).alias("n"),
        V.amplified(F.lit(0.8), F.lit(1.0), F.lit(0.9)).alias("amp"),
    ).first()
    assert r.u == pytest.approx([0.6, 0.8]) and r.z == [0.0, 0.0] and r.cos == 0.0
    assert {i: round(x, 6) for i, x in enumerate(r.w) if x} == {0: 0.973329, 26: 0.162221, 32: 0.162221}
    assert (r.pd, round(r.wd, 6), round(r.g, 6), r.n, round(r.amp, 6)) == (0.5, 0.35, 0.795811, None, 0.806855)


def test_conveyance_vector(spark):
    v = spark.range(1).select(V.conveyance_vector(F.lit(0.5), F.lit(0.5), F.lit(0.0), F.lit(2), F.lit(60)).alias("v")).first().v
    assert len(v) == 922 and sum(x > 0 for x in v) == 2 + 2 + 50 and math.isclose(sum(x * x for x in v), 1.0)


META = "id string, authors array<string>, venue string, keywords array<string>, references array<string>, theory_components array<string>, practice_components array<string>, fid double, abstraction double, text string"


def test_bridge_rules(spark):
    t = ("t", ["Page"], None, ["graph"], [], ["link analysis", "random walk"], [], 0.2, 0.9, "Algorithm 1")
    p = ("p", ["Dean"], None, ["mapreduce"], ["t"], [], ["pagerank function", "distributed processing"], 0.95, 0.1, "def pagerank(): function")
    m = spark.createDataFrame([t, p], META).withColumns(B.evidence_flags(F.col("text")))
    s = m.select(F.struct(*m.columns).alias("x"))
    j = s.where("x.id = 't'").select(F.col("x").alias("t")).crossJoin(s.where("x.id = 'p'").select(F.col("x").alias("p")))
    r = j.select(B.context_score("t", "p").alias("c"), B.shared_concepts(F.col("t.theory_components"), F.col("p.practice_components")).alias("k"), B.transformation_path("t", "p").alias("s")).first()
    assert r.c == pytest.approx(0.7) and r.c**B.CONTEXT_ALPHA == pytest.approx(0.545339, abs=1e-6)
    assert r.k == ["link analysis → pagerank function"]
    assert r.s == ["Algorithm → Implementation", "Abstract → Concrete"]
    conf = j.select(B.confidence(F.lit(0.3), F.array(F.lit("a")), F.array(F.lit("a"), F.lit("b"))).alias("x")).first().x
    assert conf == pytest.approx(0.45)


@pytest.mark.parametrize("limits", [Limits(), Limits(broadcast_bytes=0, block_rows=20, probe_rows=30, max_pivots=6)], ids=["broadcast", "blocks"])
def test_gated_pairs(spark, limits):
    rng = np.random.default_rng(2)
    x = rng.normal(size=(3, 9))[rng.integers(0, 3, 90)] + 0.3 * rng.normal(size=(90, 9))
    act = np.where(np.arange(90) % 2, 0.1, 0.9)
    rows = [(i, v[:3].tolist(), v[3:6].tolist(), v[6:].tolist(), float(act[i]), 0.9, 0.5, 2000 + i % 4, f"/p/{i % 3}/{i}") for i, v in enumerate(x)]
    docs = spark.createDataFrame(rows, "id long, w array<double>, t array<double>, c array<double>, act double, fid double, clarity double, year int, path string")

    def cos(a, b):
        return float(a @ b / np.linalg.norm(a) / np.linalg.norm(b))

    want = set()
    for i in range(1, 90, 2):
        for j in range(0, 90, 2):
            w = min(1.0, cos(x[i, :3], x[j, :3]) + 0.2 * np.exp(-abs(i % 4 - j % 4) / 2) + 0.1 * min((3 if i % 3 == j % 3 else 2) / 3, 1))
            t, c = cos(x[i, 3:6], x[j, 3:6]), (0.9 * 0.5 * 0.81 + cos(x[i, 6:], x[j, 6:])) / 2
            if min(w, t, c) >= 0.1 and w * t * c >= 0.3:
                want.add((i, j))
    assert {(r.theory, r.practice) for r in B.gated_pairs(docs, 0.3, limits).collect()} == want and want


def _bridge_tables(spark, n=48):
    rng = np.random.default_rng(8)
    x = np.abs(rng.normal(size=(n, 9))) + 0.2
    docs = [(i, v[:3].tolist(), v[3:6].tolist(), v[6:].tolist(), 0.1 if i % 2 else 0.9, 0.9, 0.5, 2000 + i % 4, f"/p/{i % 3}/{i}") for i, v in enumerate(x)]
    meta = [
        (i, [i % 5, i % 5, i % 3], None if i % 4 else f"v{i % 3}", [] if i % 7 == 0 else [f"k{i % 6}", "all"], [int(y) for y in rng.integers(0, n, 3)], ["embedding theory", "Entropy"][: i % 3],
         ["vector store", "entropy code"][: i % 3], 0.9, (i % 10) / 10, i % 3 == 0, i % 3 == 1, i % 4 == 0, i % 5 == 0, i % 4 == 1, i % 5 == 1)
        for i in range(n)
    ]
    kinds = "id long, authors array<long>, venue string, keywords array<string>, references array<long>, theory_components array<string>, practice_components array<string>, fid double, abstraction double"
    flags = ", ".join(f"{k} boolean" for k in ("algorithm", "code", "formula", "compute", "theorem", "benchmark"))
    d = spark.createDataFrame(docs, "id long, w array<double>, t array<double>, c array<double>, act double, fid double, clarity double, year int, path string")
    return d, spark.createDataFrame(meta, f"{kinds}, {flags}")


@pytest.mark.parametrize("limits", [Limits(), Limits(broadcast_bytes=0, pair_shard_rows=9, grid=True)], ids=["broadcast", "grid"])
def test_context_in_the_join_is_that_of_the_columns(spark, limits, monkeypatch):
    """The join counts shared lists itself and hands out only bridges; context, concepts and steps are those of the column functions."""
    docs, meta = _bridge_tables(spark)
    m = meta.select(F.struct(*meta.columns).alias("m"))
    pairs = B.gated_pairs(docs, 0.05, limits)
    j = pairs.join(m.select(F.col("m.id").alias("theory"), F.col("m").alias("t")), "theory").join(m.select(F.col("m.id").alias("practice"), F.col("m").alias("p")), "practice")
    strength = F.col("where_sim") * F.col("what_sim") * F.col("conv_sim") * F.pow(B.context_score("t", "p"), F.lit(1.7))
    concepts = B.shared_concepts(F.col("t.theory_components"), F.col("p.practice_components"))
    j = j.where(strength >= 0.05).select("theory", "practice", B.context_score("t", "p"), concepts, B.transformation_path("t", "p"))
    want = sorted(tuple(r) for r in j.collect())
    for most in (B.LISTS_MET, 0):
        monkeypatch.setattr(B, "LISTS_MET", most)
        got = B.detect(docs, meta, 0.05, limits=limits).select("theory", "practice", "context", "concepts", "steps")
        assert sorted(tuple(r) for r in got.collect()) == want and 20 < len(want) < pairs.count()
    strong = B.strong_pairs(docs, meta, 0.05, limits=limits)
    assert {(r.theory, r.practice) for r in strong.collect()} == {r[:2] for r in want}


@pytest.mark.parametrize("limits", [Limits(), Limits(broadcast_bytes=0, block_rows=10, probe_rows=8, max_pivots=5)], ids=["broadcast", "blocks"])
@pytest.mark.parametrize("scale", [1.0, 1e-4])
def test_repulsion(spark, limits, scale):
    rng = np.random.default_rng(4)
    p = rng.normal(size=(60, 4)) * scale
    p[20:40] = p[20]  # copies do not push each other
    rows = [(i, v.tolist(), [0.0] * 4, 0.2, 0, i == 7) for i, v in enumerate(p)]
    state = spark.createDataFrame(rows, "id long, pos array<double>, vel array<double>, stress double, last_move int, is_anchor boolean")
    got = {r.id: r.force for r in L.vector_sum(L.repulsion(state, limits), "id", "force", 4).collect()}
    assert 7 not in got
    for i in range(60):
        want = np.zeros(4)
        for j in range(60):
            d = np.linalg.norm(p[i] - p[j])
            if i != j and 0 < d < 1:
                want += (p[i] - p[j]) / d / (d + 0.1) * 0.05
        if i != 7:
            assert got.get(i, [0.0] * 4) == pytest.approx(want.tolist(), rel=1e-6, abs=1e-9)


def test_layout_step_and_membership(spark):
    rows = [(0, [0.0, 0.0], [0.0, 0.0], 0.2, 0, False), (1, [3.0, 4.0], [0.0, 0.0], 0.0, 0, False), (2, [0.0, 9.0], [1.0, 1.0], 0.9, 0, True)]
    state = spark.createDataFrame(rows, "id long, pos array<double>, vel array<double>, stress double, last_move int, is_anchor boolean")
    edges = spark.createDataFrame([(0, 1, 0.5), (1, 0, 0.5)], "src long, dst long, dist double")
    out = {r.id: r for r in L.step(state, edges, 2, 1).collect()}
    assert out[0].pos == pytest.approx([0.6 * 0.05 * 0.05, 0.8 * 0.05 * 0.05]) and out[0].stress == pytest.approx(0.05) and out[0].last_move == 1
    assert out[1].pos == [3.0, 4.0] and out[2].pos == [0.0, 9.0]
    left, kept = L.remove_nodes(state, edges, spark.createDataFrame([(1,)], "id long"))
    assert left.count() == 2 and kept.count() == 0


def test_initial_positions_are_small_and_repeatable(spark):
    n = spark.range(500).select("id", (F.col("id") % 10 / 10).alias("fid"))
    a = {r.id: r for r in L.initial(n, 6).collect()}
    b = {r.id: r.pos for r in L.initial(n.repartition(7), 6).collect()}
    assert all(a[i].pos == b[i] for i in a)
    xs = np.array([r.pos for r in a.values()])
    assert abs(xs.std() - 1e-4) < 1e-5 and sum(r.is_anchor for r in a.values()) == 50


def test_tree_metadata_and_all_edge_sets(spark, tree, tmp_path):
    """Every edge set of a scanned tree against all pairs of its files."""
    import itertools
    import os

    os.chmod(f"{tree}/pkg/loose/x.py", 0o755)
    with open(f"{tree}/pkg/loose/y.py", "w") as f:
        f.write("import x\n\nz = 2\n")
    out = str(tmp_path / "built")
    jobs.process(spark, tree, out)
    tables = jobs.build(spark, tree, out, {"graph": {"similarity": 0.9}})
    files = {r.path: r for r in jobs.ST.Table(spark, out, "files").read().collect()}
    y = files[f"{tree}/pkg/loose/y.py"]
    assert (y.n_lines, y.loc, y.mime, y.encoding, len(y.content_hash), y.readable, y.error) == (3, 2, "text/x-python", "utf-8", 64, True, None)
    assert files[f"{tree}/pkg/loose/x.py"].perms == "755" and files[f"{tree}/pkg/loose/x.py"].executable and y.owner
    pairs = list(itertools.combinations(files.values(), 2))
    same = [(a, b) for a, b in pairs if a.ext == b.ext]
    assert sum(r.n_pairs for r in tables["what"].collect()) == len(same)
    assert sum(r.n_pairs for r in tables["who"].collect()) == sum(a.owner == b.owner for a, b in pairs)
    weight = lambda a, b: min(1.0, (0.9 if a.perms == b.perms else 0.8 if a.readable and b.readable else 0) * (1.1 if a.owner == b.owner else 1))
    want = {}
    for a, b in pairs:
        want[round(weight(a, b), 6)] = want.get(round(weight(a, b), 6), 0) + 1
    got = {}
    for r in tables["conveyance"].collect():
        got[round(r.weight, 6)] = got.get(round(r.weight, 6), 0) + r.n_pairs
    assert got == {k: v for k, v in want.items() if k > 0.1}
    assert sum(r.n_pairs for r in tables["composite"].collect()) == sum(a.parent == b.parent for a, b in same)
    assert [(r.src, r.dst, r.what) for r in tables["named"].collect()] == [(f"{tree}/pkg/loose/x.py", f"{tree}/pkg/loose/y.py", 0.9)]
    assert tables["contains"].where(F.col("dst") == y.path).first().src == y.parent


def test_unreadable_folders_keep_a_row(spark, tmp_path):
    (tmp_path / "a").mkdir()
    (tmp_path / "a" / "f.txt").write_text("x")
    gone = str(tmp_path / "missing")
    rows = FS.walk(spark, gone, errors=True).collect()
    assert [(r.path, r.readable) for r in rows] == [(gone, False)] and "FileNotFoundError" in rows[0].error
    assert FS.walk(spark, gone).count() == 0 and FS.walk(spark, str(tmp_path)).count() == 1


def test_many_ignore_rules(spark):
    rules = [(f"name{i}", "/") for i in range(3000)] + [(f"*.e{i}", "/") for i in range(3000)] + [("dir7/", "/"), ("/top*", "/base")]
    paths = {"/base/name5/x": True, "/base/x/name2999": True, "/base/name": False, "/q/f.e12": True, "/q/f.e12/g": True, "/q/f.e12x": False, "/q/dir7": False, "/q/dir7/z": True, "/base/topper": True, "/x/topper": False, "/q/.e3": True}
    from stemma.functions import paths as P

    df = spark.createDataFrame([(p,) for p in paths], "p string")
    got = {r.p: r.g for r in df.select("p", P.gitignored(F.col("p"), rules).alias("g")).collect()}
    assert got == paths
