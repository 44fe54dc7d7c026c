import json

import pytest
from pyspark.sql import functions as F

from stemma import config as C
from stemma.operators import gathering as GA
from stemma.operators import store as ST
from stemma.operators.vector_index import VectorIndex
from stemma.streaming import ingest as I


def test_evolution(spark):
    rows = [("q", 1, 0.2, 3, ["a", "b", "c"]), ("q", 2, 0.5, 5, ["a"]), ("q", 3, 0.4, 6, ["b", "c", "d"]), ("once", 1, 0.1, 1, [])]
    h = spark.createDataFrame(rows, "q string, t int, s double, n int, ids array<string>")
    r = ST.evolution(h, "q", "t", "s", "n", "ids").collect()
    assert len(r) == 1
    r = r[0]
    assert (round(r.conveyance_delta, 9), r.conveyance_trend, r.result_count_delta, r.new_high_value_results, r.peak_conveyance) == (0.2, "increasing", 3, 1, 0.5)


def test_asof(spark):
    left = spark.createDataFrame([("d", 5, "x"), ("d", 30, "y"), ("d", 70, "z"), ("d", 10, "at"), ("e", 99, "none")], "k string, at int, item string")
    right = spark.createDataFrame([("d", 10, "first"), ("d", 50, "second")], "k string, at int, section string")
    for width in (1, 25, 1000):
        out = ST.asof(left, right, "k", "at", F.floor(F.col("at") / width), ["section"], {"section": "general"})
        assert {r.item: r.section for r in out.collect()} == {"x": "general", "y": "first", "z": "second", "at": "general", "none": "general"}


def test_merge_and_replace(spark):
    old = spark.createDataFrame([(1, "a", "x"), (2, "b", "y")], "id int, u string, v string")
    new = spark.createDataFrame([(2, None, 7), (3, "c", 8)], "id int, u string, n int")
    assert {tuple(r) for r in ST.merge(old, new, "id").collect()} == {(1, "a", "x", None), (2, "b", "y", 7), (3, "c", None, 8)}
    assert {tuple(r) for r in ST.replace(old, new, "id").collect()} == {(1, "a", "x", None), (2, None, None, 7), (3, "c", None, 8)}


def test_edge_key_holds_relationship(spark):
    e = spark.createDataFrame([("a", "b", "r1", 0.5, 1), ("a", "b", "r1", 0.7, 2), ("a", "b", "r2", None, 3)], "src string, dst string, relationship string, weight double, seq int")
    got = {(r.relationship, r.weight, r.edge_type) for r in ST.latest_edges(e, "seq").collect()}
    assert got == {("r1", 0.7, "semantic"), ("r2", 1.0, "semantic")}


def test_toggle(spark):
    q = spark.createDataFrame([(1, ["a"], True), (2, ["b"], None), (3, None, True), (4, ["a", "b"], False)], "doc_id int, collection_tags array<string>, is_active boolean")
    off = ST.toggle(q, ["a", "b"], False)
    assert {r.doc_id: (r.affected, r.is_active) for r in off.collect()} == {1: (True, False), 2: (True, False), 3: (False, True), 4: (False, False)}
    nodes = spark.createDataFrame([(1,), (2,), (9,)], "doc_id int")
    assert {r.doc_id for r in ST.toggle_nodes(nodes, off).collect()} == {9}
    on = ST.toggle(q, ["a"], True)
    assert {r.doc_id for r in ST.toggle_nodes(nodes, on).collect()} == {1, 2, 9, 4}
    assert {r.doc_id for r in ST.matching_queries(q, ["b"]).collect()} == {2, 4}


def test_table_versions(spark, tmp_path):
    t = ST.Table(spark, str(tmp_path), "nodes")
    assert not t.exists()
    t.upsert(spark.createDataFrame([(1, "a")], "id int, v string"), "id")
    t.upsert(spark.createDataFrame([(1, "b"), (2, "c")], "id int, v string"), "id")
    assert {tuple(r) for r in t.read().collect()} == {(1, "b"), (2, "c")}
    (tmp_path / "nodes" / "v00000009").mkdir()  # a write that never finished
    assert t.read().count() == 2
    assert t.get("id", 2).first().v == "c"
    t.clear()
    assert t.read().count() == 0


def test_stream_resumes(spark, tmp_path):
    src, ck = tmp_path / "in", str(tmp_path / "ck")
    t, counter = ST.Table(spark, str(tmp_path), "t"), ST.Table(spark, str(tmp_path), "c")
    spark.createDataFrame([(1, "a", 1), (1, "b", 2), (2, "c", 3)], "id int, v string, seq int").write.parquet(str(src))
    I.drain(I.file_stream(spark, str(src)), I.insert_new(t, "id", "seq"), ck)
    assert {(r.id, r.v) for r in t.read().collect()} == {(1, "a"), (2, "c")}
    spark.createDataFrame([(2, "late", 4), (3, "d", 5)], "id int, v string, seq int").write.mode("append").parquet(str(src))
    seen = []

    def both(df, i):
        seen.append(df.count())
        I.insert_new(t, "id", "seq")(df, i)
        I.every_n(2, counter)(df, i)

    I.drain(I.file_stream(spark, str(src)), both, ck)
    assert seen == [2]
    assert {(r.id, r.v) for r in t.read().collect()} == {(1, "a"), (2, "c"), (3, "d")}
    assert [(r.rows, r.updates) for r in counter.read().collect()] == [(2, 1)]


def test_vector_index(spark, tmp_path):
    import numpy as np

    rng = np.random.default_rng(1)
    x = rng.normal(size=(5, 8))[rng.integers(0, 5, 200)] + 0.2 * rng.normal(size=(200, 8))
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id long, v array<double>")
    ix = VectorIndex(spark, str(tmp_path)).build(df, "id", "v", 12)
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    for q in (0, 17):
        want = sorted(range(200), key=lambda i: (-round(float(u[i] @ u[q]), 12), i))[:7]
        assert [r.id for r in ix.search(x[q].tolist(), 7).collect()] == want
    ix.remove(spark.createDataFrame([(0,)], "id long"))
    assert 0 not in [r.id for r in ix.search(x[0].tolist(), 200).collect()]
    ix.add(spark.createDataFrame([(999, x[0].tolist())], "id long, v array<double>"), "id", "v")
    assert ix.search(x[0].tolist(), 1).first().id == 999


def test_bibliography(spark):
    text = 'arXiv:1111.1111 early\n# Transformer Architectures\n**A. B.** et al. "T", arXiv:2301.00001\nplain arXiv:2301.00002\n# Boundary Actors, Gatekeepers\n'
    rows = GA.bibliography(spark.createDataFrame([(1, text)], "id int, text string"), "id", "text").collect()
    got = {r.arxiv_id: (r.author, r.title, r.category) for r in rows}
    assert got == {
        "1111.1111": ("Unknown", "arXiv:1111.1111 early", "general"),
        "2301.00001": ("A. B.", "T", "transformer_architectures"),
        "2301.00002": ("Unknown", "plain arXiv:2301.00002", "transformer_architectures"),
    }


def test_year_range(spark):
    df = spark.createDataFrame([(1899,), (1950,), (2050,), (2200,)], "y int")
    years = lambda *a: [r.y for r in df.where(GA.year_range(F.col("y"), *a)).collect()]
    assert years() == [1899, 1950, 2050, 2200] and years(1950) == [1950, 2050] and years(None, 1950) == [1950] and years(1900, 2300) == [1950, 2050, 2200]


def test_config(tmp_path, monkeypatch):
    p = tmp_path / "c.json"
    p.write_text(json.dumps({"storage": {"root": "${ROOT_X:-/d}", "user": "${USER_X}"}}))
    monkeypatch.setenv("USER_X", "me")
    c = C.load(p)
    assert c["storage"] == {"root": "/d", "user": "me"} and c["bridges"]["alpha"] == 1.7
    p.write_text("{broken")
    assert C.load(p) == C.DEFAULTS


def test_registry_is_consistent():
    from stemma.plans import all_oracles, all_queries

    assert set(all_oracles()) <= set(all_queries())
    with pytest.raises(KeyError):
        all_queries()["missing"]


def test_deltas_fold_and_compact(spark, tmp_path):
    t = ST.Table(spark, str(tmp_path), "n")
    t.compact_every = 2
    t.write(spark.createDataFrame([(1, "a", None)], "id int, v string, w int"))
    for i in range(5):
        t.upsert(spark.createDataFrame([(1, None, i), (10 + i, "new", None)], "id int, v string, w int"), "id")
    rows = {r.id: (r.v, r.w) for r in t.read().collect()}
    assert rows == {1: ("a", 4)} | {10 + i: ("new", None) for i in range(5)}
    assert sorted(p.name for p in (tmp_path / "n").iterdir()) == [
        "v00000001", "v00000001.d00000001.id", "v00000001.d00000002.id", "v00000002", "v00000002.d00000001.id", "v00000002.d00000002.id", "v00000003", "v00000003.d00000001.id",
    ]


def test_checkpoint_folder_comes_from_the_session(spark):
    from stemma.session import ensure_checkpoint_dir

    named = spark.conf.get("spark.checkpoint.dir", None)
    got = ensure_checkpoint_dir(spark)
    assert got == named if named else "stemma-ckpt-" in got
    assert spark.sparkContext.getCheckpointDir()
