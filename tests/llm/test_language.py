from corpora import corpus, say
from pyspark.sql import functions as F

from stemma.llm import language
from stemma.llm.tables import fold

SCHEMA = "doc_id long, text string, lang string"


def test_families_then_pairs(spark):
    docs = spark.createDataFrame(corpus(300), SCHEMA)
    held = fold(F.col("doc_id"), 5) == 0
    model = language.fit(docs.where(~held))
    assert model.families == ["germanic", "romance", "xx"]
    assert sorted(model.pairs) == [("en", "nl"), ("es", "fr")]
    out = language.identify(docs, model).where(held).collect()
    assert len(out) > 40 and sum(r.lang == r.lang_pred for r in out) / len(out) > 0.97
    assert all(0 <= r.score <= 1 for r in out)


def test_odd_rows(spark):
    import numpy as np

    data = corpus(120)
    model = language.fit(spark.createDataFrame(data + [(900, None, "en"), (901, "the of", None)], SCHEMA))
    long = say(np.random.default_rng(1), "fr", 200_000)
    odd = [(1, None), (2, ""), (3, "12 -- !?"), (4, long), (5, "the"), (6, "THE OF AND TO IN"), (6, "THE OF AND TO IN"), (7, "あ")]
    rows = spark.createDataFrame([(i, t, "x", 0.5) for i, t in odd], "doc_id long, text string, lang_pred string, score double")
    got = {r.doc_id: r for r in language.identify(rows, model).collect()}
    assert [got[i].lang_pred for i in (1, 2, 3)] == ["und"] * 3 and got[1].score == 0
    assert got[4].lang_pred == "fr" and got[6].lang_pred == "en" and got[7].lang_pred != "und"
    assert language.identify(rows, model).count() == len(odd) and language.identify(rows.limit(0), model).count() == 0
    nothing = language.fit(rows.select("doc_id", "text", F.lit(None).cast("string").alias("lang")))
    assert {r.lang_pred for r in language.identify(rows, nothing).collect()} == {"und"}


def test_grams_match_plain_count():
    text = "Ab  cé-9d"
    plain = " ".join(x for x in ["ab", "cé", "d"]).encode()
    n = sum(max(0, len(plain) - k) for k in range(4))
    assert len(language.grams(text)) == n
    assert len(set(language.grams("aaaa").tolist())) == 4
