import numpy as np
from corpora import say
from pyspark.sql import functions as F

from stemma.llm import toxicity
from stemma.llm.tables import fold


def world(n=1200, seed=4):
    """Texts of which an eighth hold an insult; half of the rows have a label."""
    rng = np.random.default_rng(seed)
    docs, labels, truth = [], [], {}
    for i in range(n):
        words = say(rng, "en", int(rng.integers(10, 60))).split()
        truth[i] = int(rng.random() < 0.125)
        if truth[i]:
            words.insert(int(rng.integers(len(words))), str(rng.choice(["grobian", "lummox", "varlet"])).upper())
        docs.append((i, " ".join(words)))
        if i % 2:
            labels.append((i, truth[i]))
    return docs, labels, truth


def test_learns_from_positives_and_unlabelled_only(spark):
    docs, labels, truth = world()
    df = spark.createDataFrame(docs, "doc_id long, text string")
    lab = spark.createDataFrame(labels, "doc_id long, toxic int")
    learn = fold(F.col("doc_id"), 4) != 2
    model = toxicity.fit(df.where(learn), lab.where(learn))
    out = toxicity.judge(df, model).where(~learn).collect()
    assert len(out) > 200
    assert sum(r.predicted == truth[r.doc_id] for r in out) / len(out) > 0.98
    assert all(r.predicted == int(r.score >= 0.3) for r in out)


def test_risk_is_that_of_the_clean_classes():
    """With unlabelled data drawn at the prior, the fit separates as one with true negatives would."""
    rng = np.random.default_rng(0)
    pos = [np.array([0] if rng.random() < 0.9 else [1]) for _ in range(400)]
    unl = [np.array([0]) if rng.random() < 0.2 * 0.9 else np.array([1]) for _ in range(2000)]
    w, b = toxicity.fit_nnpu(pos, unl, 2, 0.2)
    p = 1 / (1 + np.exp(-(w + b)))
    assert p[0] > 0.8 and p[1] < 0.1


def test_odd_rows(spark):
    docs, labels, _ = world(300)
    df = spark.createDataFrame([(i, t, 9.0) for i, t in docs + [(900, None), (901, ""), (902, "grobian " + "the of " * 100_000), (5, docs[5][1])]], "doc_id long, text string, score double")
    lab = spark.createDataFrame(labels + [(1, 1), (None, 1), (7, None)], "doc_id long, toxic int")
    out = toxicity.judge(df, toxicity.fit(df, lab)).collect()
    got = {r.doc_id: r for r in out}
    assert len(out) == 304 and got[900].score == got[901].score and got[900].predicted == 0 and got[902].predicted == 1
    blank = toxicity.fit(df, lab.limit(0))
    assert {r.score for r in toxicity.judge(df, blank).collect()} == {0.5} and toxicity.judge(df.limit(0), blank).count() == 0
