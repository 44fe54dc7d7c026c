"""Toxicity by non-negative positive-unlabelled learning.

Only confirmed toxic texts and unlabelled text teach the classifier; rows labelled as not toxic are
never used as examples. A linear model over the presence of words minimises the risk

    prior * R_pos(+) + max(0, R_unl(-) - prior * R_pos(-))

with the logistic loss, where the class prior corrects for the toxic texts among the unlabelled ones. In
steps where the second term is negative its gradient is reversed, so the estimate cannot be driven
below zero by memorising the positives (non-negative risk estimator).

Words are counted in the sample by a grouped aggregation; a word becomes a feature if it is in at least
`LEAST_DOCS` toxic texts, more often there than in unlabelled ones, and its log-likelihood ratio between toxic and unlabelled texts reaches
`LEAST_G2`; the `FEATURES` strongest are kept. Sample sizes are about `POSITIVES` and `UNLABELLED`
documents. Every text is scored as a whole, where it is read.

Defined results: a null or empty text gets the score of no feature; so does every text if no toxic
example was given, where the score is the prior; repeated rows are scored alike; of repeated labels the
highest counts; an empty table gives no row; other columns are passed on, those named like a result are
replaced.
"""

from __future__ import annotations

import re

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stemma.llm.tables import collected, sampled, small_batches

POSITIVES, UNLABELLED = 3000, 9000
FEATURES, LEAST_DOCS, LEAST_G2 = 4096, 3, 8.0

_WORD = re.compile(r"[^\W\d_]+")


def words(text: str | None) -> set[str]:
    """The distinct words of a text: runs of letters, lower-cased."""
    return set(_WORD.findall(text.lower())) if text else set()


def fit_nnpu(pos: list[np.ndarray], unl: list[np.ndarray], dim: int, prior: float, *, steps: int = 400, rate: float = 0.05, decay: float = 1e-4):
    """Weights and bias of a linear model over present features, by Adam on the risk of the whole sample."""
    w, bias = np.zeros(dim), float(np.log(prior / (1 - prior)))
    first, second = np.zeros(dim + 1), np.zeros(dim + 1)
    flat = [(np.concatenate([*rows, np.empty(0, int)]).astype(int), np.repeat(np.arange(len(rows)), [len(r) for r in rows]), len(rows)) for rows in (pos, unl)]

    def slopes(at: np.ndarray, own: np.ndarray, n: int, sign: int) -> tuple[float, np.ndarray]:
        """Mean logistic loss for the class `sign`, and its gradient."""
        f = np.bincount(own, w[at], n) + bias
        g = -sign / (1 + np.exp(sign * np.clip(f, -50, 50))) / n
        return float(np.logaddexp(0, -sign * f).mean()), np.append(np.bincount(at, g[own], dim), g.sum())

    for step in range(1, steps + 1):
        _, up = slopes(*flat[0], 1)
        loss_p, down_p = slopes(*flat[0], -1)
        loss_u, down_u = slopes(*flat[1], -1)
        rest = down_u - prior * down_p
        grad = prior * up + rest if loss_u >= prior * loss_p else -rest
        grad[:dim] += decay * w
        first, second = 0.9 * first + 0.1 * grad, 0.999 * second + 0.001 * grad**2
        move = rate * (first / (1 - 0.9**step)) / (np.sqrt(second / (1 - 0.999**step)) + 1e-8)
        w -= move[:dim]
        bias -= move[dim]
    return w, bias


class Model:
    def __init__(self, weights: dict[str, float], bias: float):
        self.weights, self.bias = weights, bias

    def score(self, text: str | None) -> float:
        w = self.weights
        f = self.bias + sum(w[x] for x in sorted(words(text) & w.keys()))
        return float(1 / (1 + np.exp(-min(max(f, -50.0), 50.0))))


def fit(docs: DataFrame, labels: DataFrame, *, text: str = "text", key: str = "doc_id", label: str = "toxic", seed: int = 0) -> Model:
    """Learns from the rows of `labels` that say toxic and from documents without regard to their label.

    The class prior is the share of toxic rows among all given labels.
    """
    small_batches(docs.sparkSession)
    known = labels.where(F.col(label).isin(0, 1)).groupBy(F.col(key).alias("_k")).agg(F.max(label).alias("_y"))
    n = known.agg(F.coalesce(F.sum("_y"), F.lit(0)).alias("toxic"), F.count("*").alias("all")).first()
    prior = min(max((n["toxic"] + 1) / (n["all"] + 2), 1e-3), 0.5)
    positive = known.where("_y = 1").where(sampled(F.col("_k"), n["toxic"], POSITIVES, seed)).select("_k", F.lit(True).alias("_pos")).limit(2 * POSITIVES)
    texts = docs.select(F.col(key).alias("_k"), F.col(text).alias("t"))
    have = docs.count()
    unlabelled = sampled(F.col("_k"), have, UNLABELLED, seed + 1)
    pool = texts.join(F.broadcast(positive), "_k", "left").select(F.coalesce("_pos", F.lit(False)).alias("pos"), unlabelled.alias("unl"), "t").where("pos OR unl")

    def distinct(batches):
        for b in batches:
            yield pd.DataFrame({"pos": b["pos"], "unl": b["unl"], "w": [sorted(words(t)) for t in b["t"]]})

    pool = pool.mapInPandas(distinct, "pos boolean, unl boolean, w array<string>").limit(4 * (POSITIVES + UNLABELLED)).persist()
    try:
        size = pool.agg(F.count_if("pos").alias("p"), F.count_if("unl").alias("u")).first()
        if not size["p"] or not size["u"]:
            return Model({}, float(np.log(prior / (1 - prior))))
        p, u = F.col("p"), F.col("u")
        count = pool.select(F.explode("w").alias("x"), "pos", "unl").groupBy("x").agg(F.count_if("pos").alias("p"), F.count_if("unl").alias("u"))
        share = (p + u) / float(size["p"] + size["u"])
        term = lambda seen, want: F.when(seen > 0, seen * F.log(seen / want)).otherwise(0.0)
        g2 = 2 * sum(
            term(c, share * t) + term(t - c, (1 - share) * t) for c, t in ((p.cast("double"), float(size["p"])), (u.cast("double"), float(size["u"])))
        )
        strongest = count.where((p >= LEAST_DOCS) & (p * size["u"] > u * size["p"])).select("x", g2.alias("g2")).where(F.col("g2") >= LEAST_G2).orderBy(F.desc("g2"), "x").limit(FEATURES)
        vocabulary = {r["x"]: i for i, r in enumerate(strongest.collect())}

        def places(batches):
            for b in batches:
                yield pd.DataFrame({"pos": b["pos"], "unl": b["unl"], "at": [[vocabulary[x] for x in w if x in vocabulary] for w in b["w"]]})

        rows = collected(pool.mapInPandas(places, "pos boolean, unl boolean, at array<int>"))
    finally:
        pool.unpersist()
    at = sorted((tuple(x), a, b) for x, a, b in zip(rows["at"], rows["pos"], rows["unl"]))
    pos, unl = ([np.array(x, int) for x, *flag in at if flag[i]] for i in (0, 1))
    w, bias = fit_nnpu(pos, unl, len(vocabulary), prior)
    return Model({x: float(w[i]) for x, i in vocabulary.items()}, bias)


def judge(docs: DataFrame, model: Model, *, text: str = "text", toxic_from: float = 0.3) -> DataFrame:
    """Adds score (likelihood of toxic) and predicted (1 from `toxic_from` on)."""
    small_batches(docs.sparkSession)
    sent = docs.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("double")
    def score(t: pd.Series) -> pd.Series:
        return pd.Series([sent.value.score(x) for x in t], dtype=float)

    keep = [c for c in docs.columns if c not in ("score", "predicted")]
    out = docs.select(*keep, score(F.col(text)).alias("score"))
    return out.withColumn("predicted", (F.col("score") >= toxic_from).cast("int"))
