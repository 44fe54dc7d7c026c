import numpy as np
import pytest
from corpora import say
from pyspark.sql import functions as F

from stemma.llm import quality, tables


def world(n=400, seed=2):
    rng = np.random.default_rng(seed)
    docs, labels = [], []
    for i in range(n):
        bad = rng.random() < (0.6 if i % 7 == 0 else 0.1)
        text = say(rng, "en", int(rng.integers(20, 80))).capitalize() + "."
        if bad:
            text = " | ".join(text.split()) if i % 2 else "!! ".join(text.upper().split())
        docs.append((i, text, "h0" if i % 3 == 0 else f"h{i % 7}", f"p{i % 2}"))
        if i % 2:
            labels.append((i, int(not bad)))
    return docs, labels


@pytest.mark.parametrize("small_rows", [100_000, 0])
def test_posteriors_match_plain_arithmetic(spark, monkeypatch, small_rows):
    monkeypatch.setattr(tables, "SMALL_ROWS", small_rows)
    docs, labels = world()
    docs += [(1000, None, "h0", "p0"), (1001, "", None, None), (1002, "  ", "lonely", "p0")]
    df = spark.createDataFrame(docs, "doc_id long, text string, host string, path string").withColumns({"n": F.lit("n"), "s": F.lit(1), "score": F.lit(7)})
    model = quality.fit(df, spark.createDataFrame(labels, "doc_id long, quality int"))
    out = {r.doc_id: r for r in quality.judge(df, model, F.col("host"), F.col("path")).collect()}
    assert len(out) == len(docs) and out[5].n == "n" and out[5].s == 1
    p = dict(zip([d[0] for d in docs], model.predict([d[1] for d in docs])))
    known = {i: v for i, v in p.items() if not np.isnan(v)}
    m = sum(known.values()) / len(known)
    site = {d[0]: (d[2] or "", d[3] or "") for d in docs}
    groups = lambda key: {k: [known[i] for i in known if key(site[i]) == k] for k in {key(site[i]) for i in known}}
    hosts, paths = groups(lambda x: x[0]), groups(lambda x: x)

    def strength(g):
        n = np.array([len(v) for v in g.values()])
        between = sum(len(v) * (np.mean(v) - m) ** 2 for v in g.values())
        spread = (between / (m * (1 - m)) - len(g)) / (n.sum() - (n**2).sum() / n.sum() - len(g))
        spread = min(max(spread, 1e-6), 0.5)
        return (1 - spread) / spread

    kh, kp = strength(hosts), strength(paths)
    logit = lambda x: np.log(np.clip(x, 1e-6, 1 - 1e-6) / (1 - np.clip(x, 1e-6, 1 - 1e-6)))
    for i, r in out.items():
        own, one = (known[i], 1) if i in known else (0, 0)
        h, q = hosts.get(site[i][0], []), paths.get(site[i], [])
        host = (sum(h) - own + kh * m) / (len(h) - one + kh)
        path = (sum(q) - own + kp * host) / (len(q) - one + kp)
        score = 1 / (1 + np.exp(-(logit(known.get(i, m)) - logit(m) + logit(path))))
        assert abs(r.host_share - host) < 1e-6 and abs(r.path_share - path) < 1e-6 and abs(r.score - score) < 1e-6
        assert r.keep == (r.score >= 0.5)
    assert abs(out[1002].path_share - m) < 1e-9  # a site without evidence has the global share
    wrong = [i for i, y in labels if out[i].keep != bool(y)]
    assert len(wrong) <= 0.02 * len(labels)


def test_no_labels_and_empty_table(spark):
    docs = spark.createDataFrame([(1, "a b", "h", "p"), (2, "x" * 300_000, "h", "p")], "doc_id long, text string, host string, path string")
    labels = spark.createDataFrame([(1, None)], "doc_id long, quality int")
    model = quality.fit(docs, labels)
    assert [r.p for r in quality.judge(docs, model, F.col("host"), F.col("path")).collect()] == [0.5, 0.5]
    assert quality.judge(docs.limit(0), model, F.col("host"), F.col("path")).count() == 0
