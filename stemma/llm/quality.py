"""Quality classification by hierarchical empirical Bayes.

Each document gets a probability p of good quality from a logistic model over measures of its whole text
(letters, case, symbols, repetition of words and lines). The p of all documents are then summed per
path and per host by grouped aggregation. A host's posterior share of good documents is shrunk toward
the global mean m, a path's toward its host,

    host = (sum p + k_host * m) / (n + k_host),    path = (sum p + k_path * host) / (n + k_path),

with prior strengths k fitted by the method of moments from the spread between hosts and between paths,
so sparse sites stay near their priors. A document's own p is left out of its site's sums. Its score is
the posterior with the path's share in place of the global mean as the prior:

    logit(score) = logit(p) - logit(m) + logit(path)

The model is fitted on at most `PER_CLASS` labelled documents of each class (approximately), with the
intercept corrected to the class shares counted over all labels. Sums per path are an aggregate that is
sent to the tasks below a counted size and joined by shuffle beyond. Texts are scored where they are
read, once for the sums and once for the result; nothing but sums is shuffled.

Defined results: a null or empty text says nothing (p = m, so its score is its site's share); null hosts
and paths are sites of their own; without labels of both classes every p is 0.5; of repeated labels the
lowest counts; repeated rows are judged alike; an empty table gives no row; other columns are passed on,
those named like a result are replaced.
"""

from __future__ import annotations

from collections import Counter

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stemma.llm.svm import fit_logistic
from stemma.llm.tables import attach, collected, sampled, small_batches
from stemma.session import cut_lineage

PER_CLASS = 1500
STRONGEST = 1e6

_SETS = [b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz", b"0123456789", b".", b",;:'\"-()", b"!?", b"|", b"#$%&*@~^<>{}[]\\/_=+`", b"\n\r", bytes(range(0x80, 0x100))]
_KIND = np.full(256, len(_SETS), np.int64)
for _i, _s in enumerate(_SETS):
    _KIND[list(_s)] = _i
N_MEASURES = 17


def measures(text: str | None) -> np.ndarray | None:
    """Measures of a whole text, None if it says nothing."""
    words = text.split() if text else []
    if not words:
        return None
    kinds = np.bincount(_KIND, weights=np.bincount(np.frombuffer(text.encode("utf-8", "replace"), np.uint8), minlength=256), minlength=len(_SETS) + 1)
    upper, lower, digit, stop, punct, shout, bar, symbol, lines, wide, blank = kinds
    seen = max(1.0, kinds.sum() - blank - lines)
    n, count = len(words), Counter(words)
    lined = [x for x in text.split("\n") if x.strip()]
    same = sum(map(str.__eq__, words, words[1:])) if n > 1 else 0
    grown = np.log1p(n)
    rate = lambda x: np.log1p(100 * x / seen)
    return np.array(
        [
            rate(digit), rate(stop), rate(punct), rate(shout), rate(bar), rate(symbol), rate(lines),
            upper / max(1.0, upper + lower + wide),
            rate(shout + bar + symbol),
            np.log1p(100 * same / n),
            np.log(len(count)) / max(1.0, np.log(n)) if n > 1 else 1.0,
            len(count) / n,
            np.log1p(100 * max(count.values()) / n),
            len(set(lined)) / max(1, len(lined)),
            np.log(seen / n),
            grown,
            np.log1p(sum(len(w) > 24 for w in count)),
        ]
    )


class Model:
    """Logistic model over standardised measures, their squares and a constant."""

    def __init__(self, x: np.ndarray, y: np.ndarray, share: float):
        self.known = 0 < y.sum() < len(y) and 0 < share < 1
        if not self.known:
            return
        self.mean, self.scale = x.mean(0), x.std(0) + 1e-6
        self.w = fit_logistic(self._columns(x), y)
        taken = y.mean()
        self.w[-1] += np.log(share / (1 - share)) - np.log(taken / (1 - taken))

    def _columns(self, x: np.ndarray) -> np.ndarray:
        z = np.clip((x - self.mean) / self.scale, -6, 6)
        return np.column_stack([z, z * z, np.ones(len(z))])

    def predict(self, texts) -> np.ndarray:
        """Probability of good quality per text, NaN for a text that says nothing."""
        rows = [measures(t) for t in texts]
        out = np.array([np.nan if r is None else 0.5 for r in rows], float)
        at = [i for i, r in enumerate(rows) if r is not None]
        if at and self.known:
            out[at] = 1 / (1 + np.exp(-np.clip(self._columns(np.array([rows[i] for i in at])) @ self.w, -12, 12)))
        return out


def fit(docs: DataFrame, labels: DataFrame, *, text: str = "text", key: str = "doc_id", label: str = "quality", seed: int = 0) -> Model:
    """Learns `label` (1 good, 0 bad) from the documents it is given for."""
    small_batches(docs.sparkSession)
    known = labels.where(F.col(label).isin(0, 1)).groupBy(F.col(key).alias("_k")).agg(F.min(label).alias("_y"))
    sizes = {r["_y"]: r["n"] for r in known.groupBy("_y").agg(F.count("*").alias("n")).collect()}
    chosen = F.lit(False)
    for y, n in sizes.items():
        chosen = F.when(F.col("_y") == y, sampled(F.col("_k"), n, PER_CLASS, seed)).otherwise(chosen)
    picked = known.where(chosen).limit(4 * PER_CLASS)  # bounded, hence broadcast

    def rows(batches):
        for b in batches:
            got = [(y, m) for y, m in zip(b["_y"], map(measures, b["t"])) if m is not None]
            yield pd.DataFrame({"y": [g[0] for g in got], "m": [g[1] for g in got]})

    texts = docs.select(F.col(key).alias("_k"), F.col(text).alias("t")).join(F.broadcast(picked), "_k").select("_k", "_y", "t")
    got = collected(texts.mapInPandas(rows, "y int, m array<double>").limit(8 * PER_CLASS))
    x = np.vstack(got["m"].to_numpy()) if len(got) else np.empty((0, N_MEASURES))
    order = np.lexsort((*x.T, got["y"].to_numpy()))
    return Model(x[order], got["y"].to_numpy()[order], sizes.get(1, 0) / max(1, sum(sizes.values())))


def _strength(sums: DataFrame, mean: float) -> float:
    """Prior strength of groups with n documents and sum of p s, by the method of moments."""
    r = sums.agg(
        F.count("*").alias("g"),
        F.sum("n").alias("n"),
        F.sum(F.col("n") * F.col("n") / 1.0).alias("n2"),
        F.sum(F.col("n") * F.pow(F.col("s") / F.col("n") - mean, 2)).alias("between"),
    ).first()
    unit = mean * (1 - mean)
    if not r["n"] or unit <= 0 or r["n"] == r["g"]:
        return STRONGEST
    spread = (r["between"] / unit - r["g"]) / max(1e-9, r["n"] - r["n2"] / r["n"] - r["g"] if r["g"] > 1 else 1e18)
    spread = min(max(spread, 1 / STRONGEST), 0.5)
    return (1 - spread) / spread


def judge(docs: DataFrame, model: Model, host: Column, path: Column, *, text: str = "text", keep_from: float = 0.5) -> DataFrame:
    """Adds p (from the text alone), host_share, path_share, score and keep (score >= keep_from)."""
    small_batches(docs.sparkSession)
    sent = docs.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("double")
    def evidence(t: pd.Series) -> pd.Series:
        return pd.Series(sent.value.predict(t))

    evidence = evidence.asNondeterministic()  # else a filter on the result would run it a second time
    results = ["p", "host_share", "path_share", "score", "keep"]
    columns = [c for c in docs.columns if c not in results]
    site = [F.coalesce(host.cast("string"), F.lit("")).alias("_host"), F.coalesce(path.cast("string"), F.lit("")).alias("_path")]
    scored = docs.select(*columns, *site, evidence(F.col(text)).alias("p")).withColumn("p", F.when(~F.isnan("p"), F.col("p")))
    paths = cut_lineage(scored.groupBy("_host", "_path").agg(F.count("p").alias("n"), F.coalesce(F.sum("p"), F.lit(0.0)).alias("s")))
    hosts = paths.groupBy("_host").agg(F.sum("n").alias("hn"), F.sum("s").alias("hs"))
    total = hosts.agg(F.sum("hn").alias("n"), F.sum("hs").alias("s")).first()
    m = total["s"] / total["n"] if total["n"] else 0.5
    m = min(max(m, 1e-4), 1 - 1e-4)
    k_host = _strength(hosts.where("hn > 0").select(F.col("hn").alias("n"), F.col("hs").alias("s")), m)
    k_path = _strength(paths.where("n > 0"), m)
    sites = paths.join(hosts, "_host").select("_host", "_path", F.struct("n", "s", "hn", "hs").alias("_site"))
    own, one = F.coalesce("p", F.lit(0.0)), F.when(F.col("p").isNull(), 0).otherwise(1)
    logit = lambda c: F.log(F.least(F.greatest(c, F.lit(1e-6)), F.lit(1 - 1e-6)) / (1 - F.least(F.greatest(c, F.lit(1e-6)), F.lit(1 - 1e-6))))
    return (
        attach(scored, sites, ["_host", "_path"])
        .withColumn("host_share", (F.col("_site.hs") - own + k_host * m) / (F.col("_site.hn") - one + k_host))
        .withColumn("path_share", (F.col("_site.s") - own + k_path * F.col("host_share")) / (F.col("_site.n") - one + k_path))
        .withColumn("p", F.coalesce("p", F.lit(m)))
        .withColumn("score", 1 / (1 + F.exp(-(logit(F.col("p")) - float(np.log(m / (1 - m))) + logit(F.col("path_share"))))))
        .withColumn("keep", F.col("score") >= keep_from)
        .select(*columns, *results)
    )
