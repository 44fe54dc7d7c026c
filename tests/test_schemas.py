from pyspark.sql import functions as F

from stemma.functions import paths as P
from stemma.functions import text as X
from stemma.operators import embedding as EM
from stemma.sources import schemas as SC


def test_document_round_trip(spark):
    text = '{"doc_id":"d","doc_type":"python","content":{"concepts":["a"],"entities":[{"k":"v"}]},"embeddings":{"task_adapted":{"t":[1.0,2.0]},"full_vector":[0.5]},"errors":[{"stage":"load","error":"x"}]}'
    df = spark.createDataFrame([(text,)], "j string").select(SC.from_json(F.col("j")).alias("d"))
    back = df.select(SC.from_json(SC.to_json(df, "d")).alias("e"), "d").first()
    assert back.d == back.e and back.d.embeddings.task_adapted == {"t": [1.0, 2.0]} and back.d.embeddings.full_vector == [0.5]


def test_checks(spark):
    e = spark.createDataFrame([("a", "b", 0.5), ("a", "b", 0.5), ("a", None, 0.1), ("c", "d", 1.5)], "src string, dst string, weight double")
    assert SC.duplicates(e, "src", "dst").first().n == 2
    assert SC.bad_edges(e).count() == 2
    v = spark.createDataFrame([([1.0],), ([1.0, 2.0],), (None,)], "w array<double>")
    assert SC.wrong_vectors(v, {"w": 2}).count() == 1
    t = spark.createDataFrame([("python",), ("exe",)], "t string").select(SC.known(F.col("t"), SC.DOCUMENT_TYPES).alias("k"))
    assert [r.k for r in t.collect()] == ["python", "unknown"]


def test_errors_accumulate(spark):
    df = spark.createDataFrame([(1, None), (2, None)], SC._struct(id=SC._L, errors=SC.T.ArrayType(SC.ERROR)))
    out = SC.with_error(SC.with_error(df, "a", F.when(F.col("id") == 1, "bad")), "b", F.lit("worse"))
    assert {r.id: [e.stage for e in r.errors] for r in out.collect()} == {1: ["a", "b"], 2: ["b"]}


def test_small_text_functions(spark):
    df = spark.createDataFrame([(["ok", " ", "no"], [90.0, 50.0, 0.0], [["h1", "h2"], ["a", None]], "A: b -- c!", "import x")], "w array<string>, c array<double>, r array<array<string>>, t string, code string")
    r = df.select(
        X.confidence_mean(F.col("w"), F.col("c")).alias("m"), X.markdown_table(F.col("r")).alias("md"), P.download_name(F.col("t")).alias("n"),
        X.adapter(F.col("t"), F.lit("x.rs")).alias("by_suffix"), X.adapter(F.col("code")).alias("by_text"), X.adapter(F.col("t")).alias("none"),
    ).first()
    assert (r.m, r.md, r.n) == (90.0, "h1 | h2\n--- | ---\na | None", "A_b_c")
    assert (r.by_suffix, r.by_text, r.none) == ("code", "code", "retrieval")


def test_embedding_keeps_images_apart_and_truncates(spark):
    df = spark.createDataFrame([(1, "text", "a b"), (2, "image", ""), (3, "table", "a")], "id long, kind string, body string")
    got = {r.id: r.embedding for r in EM.embed_items(df, "id", "kind", "body", lambda: EM.HashingModel(8)).collect()}
    assert got[2] is None and len(got[1]) == 8 and sum(abs(x) for x in got[3]) == 1
    short = EM.embed(df, "id", "body", lambda: EM.HashingModel(8), truncate=3).first()
    assert len(short.embedding) == 3
