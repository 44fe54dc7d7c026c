import numpy as np
import pytest
from corpora import corpus, say
from pyspark.sql import functions as F

corpus_pipeline = pytest.importorskip("corpus_pipeline")

COLUMNS = "doc_id long, text string, lang string, source string, n_chars long, score double, rest int"


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    """Documents with junk, copies, leaks, texts without letters and columns named like results."""
    rng = np.random.default_rng(0)
    items = [" ".join("q" + "".join(chr(97 + c) for c in rng.integers(0, 26, 5)) for _ in range(25)) for _ in range(5)]
    docs, role = [], {}
    for i, text, lang in corpus(400):
        role[i] = "clean"
        if i % 10 == 1:
            text, role[i] = "!! ".join(text.upper().split()) + " | | |", "junk"
        elif i % 10 == 2:
            text, role[i] = text + " " + items[i % 5] + " " + say(rng, lang, 5), "leak"
        elif i % 10 == 3:
            text, role[i] = None if i % 20 == 3 else "12 34 !!", "mute"
        docs.append((i, text, lang, f"src{i % 4}"))
    for i in range(400, 430):
        text = docs[0][1] + (" and" if i % 2 else "")
        docs.append((i, text, docs[0][2], "src0"))
        role[i] = "copy"
    docs.append(docs[5])
    folder = str(tmp_path_factory.mktemp("pipeline"))
    spark.createDataFrame([(*d, len(d[1] or ""), 0.5, i) for i, d in enumerate(docs)], COLUMNS).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame([(i, int(role[i] != "junk"), 0) for i in role if i % 2], "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    spark.createDataFrame(list(enumerate(items)), "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    return folder, role, docs


def test_stages_decide_and_keep_clean_documents(spark, tables, tmp_path):
    folder, role, docs = tables
    assert [name for name, _ in corpus_pipeline.STAGES] == ["language ID", "quality classifier", "n-gram Jaccard join", "benchmark decontamination", "mixing to target weights"]
    frame, left = spark.read.parquet(f"{folder}/documents.parquet"), {}
    texts = {d[0]: d[1] for d in docs}
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, frame, folder)
        if k < 4:
            assert sorted(out.columns) == sorted(frame.columns) and dict(out.dtypes) == dict(frame.dtypes)
        out.write.parquet(str(tmp_path / str(k)))
        frame = spark.read.parquet(str(tmp_path / str(k)))
        left[k] = [r.doc_id for r in frame.select("doc_id").collect()]
        gone = (set(left[k - 1]) if k else set(role)) - set(left[k])
        kinds = {role[i] for i in gone}
        if k == 0:
            assert kinds == {"mute"} and not {"mute"} & {role[i] for i in left[0]}
        elif k == 1:
            assert sum(role[i] == "junk" for i in left[1]) <= 1 and sum(role[i] != "junk" for i in gone) <= 2
        elif k == 2:
            from test_jaccard import brute

            groups = brute([(i, texts[i]) for i in set(left[1])])
            assert sorted(left[2]) == sorted({g for _, g in groups.values()})
        elif k == 3:
            assert kinds == {"leak"} and "leak" not in {role[i] for i in left[3]}
        else:
            assert set(left[4]) <= set(left[3]) and len(left[4]) > 0
    n = {i: len(texts[i].split()) for i in left[3]}
    budget = int(sum(n.values()) * 0.5)
    used = sum(n[i] for i in left[4])
    assert budget - 60 * len({(role[i]) for i in left[3]}) * 40 <= used <= budget


def test_run_equals_the_stages(spark, tables):
    folder, _, _ = tables
    a = sorted((r.doc_id, r.epoch) for r in corpus_pipeline.run(spark, folder).collect())
    frame = spark.read.parquet(f"{folder}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES:
        frame = stage(spark, frame, folder)
    assert a == sorted((r.doc_id, r.epoch) for r in frame.select("doc_id", "epoch").collect())


def test_empty_documents(spark, tables, tmp_path):
    folder, _, _ = tables
    out = spark.read.parquet(f"{folder}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        out = stage(spark, out, folder)
    assert out.count() == 0


def test_null_keys(spark, tables):
    folder, _, _ = tables
    text = say(np.random.default_rng(77), "en", 40)
    rows = [(None, text, None, None, None, None, None), (1, "the of and to in is the", "en", None, 5, 1.0, 2)]
    docs = spark.createDataFrame(rows, COLUMNS).unionByName(spark.read.parquet(f"{folder}/documents.parquet"))
    for _, stage in corpus_pipeline.STAGES[:4]:
        docs = stage(spark, docs, folder)
    assert docs.where(F.col("doc_id").isNotNull()).count() > 100 and docs.where(F.col("doc_id").isNull()).count() == 1


def test_shared_and_missing_ids_lose_only_copies(spark, tmp_path):
    """Different texts under one id all stay; of near copies one stays, with or without ids."""
    words = lambda k: " ".join(f"w{k}x{i}" for i in range(60))
    rows = [(7, words(1)), (7, words(2)), (7, words(2)), (9, words(2) + " more"), (None, words(2)), (None, words(3)), (None, words(3)), (None, words(3) + " more"), (None, words(4)), (8, None), (8, "")]
    docs = spark.createDataFrame([(i, t, "en", "s", 1, 0.0, 0) for i, t in rows], COLUMNS)
    docs = docs.unionByName(spark.createDataFrame([(3, words(5), "en", s, 1, 0.0, 0) for s in "ba"], COLUMNS))
    left = sorted(((r.doc_id, r.text, r.source) for r in corpus_pipeline.near_duplicates(spark, docs, str(tmp_path)).collect()), key=str)
    assert [(i, t) for i, t, _ in left if i == 7] == [(7, words(1)), (7, words(2))]
    assert sorted(t.replace(" more", "") for i, t, _ in left if i is None) == [words(3), words(4)]
    assert sum(i == 3 for i, _, _ in left) == 1 and {t for i, t, _ in left if i == 8} == {None, ""} and len(left) == 7
