"""Language identification by hierarchical discrimination.

The family of a text is predicted first, by a multinomial naive Bayes model over hashed n-grams of one
to four bytes. Linear support vector machines, one for each pair of languages of a family, then separate
the closely related languages; the language with most votes wins. Families are stated in `FAMILIES`; a
language that is not listed is a family of its own.

Models are fitted on a bounded sample, about `PER_LANGUAGE` labelled rows of each of the `LANGUAGES`
most frequent languages; the number of rows per language is counted over all of them. Every text is
read as a whole, and texts are scored where they are read: nothing is shuffled.

Defined results: a null text or one without a letter is `und` with score 0, as is every text if there
was nothing to learn from; rows with a null language teach nothing; copies and repeated rows get equal
results; an empty table gives no row; other columns are passed on, those named like a result are replaced.
"""

from __future__ import annotations

import zlib
from collections import Counter
from itertools import combinations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stemma.llm.svm import fit_svm
from stemma.llm.tables import collected, sampled, small_batches

PER_LANGUAGE = 300
LANGUAGES = 256
BUCKETS = 1 << 16
ORDERS = 4

# Families of languages by their ISO 639-1 codes.
FAMILIES = {
    "germanic": "en de nl sv da no nb nn is af lb fy",
    "romance": "fr es it pt ro ca gl oc",
    "slavic": "ru uk be pl cs sk bg sr hr bs sl mk",
    "baltic": "lt lv",
    "uralic": "fi et hu",
    "celtic": "ga cy gd br",
    "turkic": "tr az kk uz ky tt",
    "indic": "hi mr ne bn gu pa ur si",
    "iranian": "fa ku ps tg",
    "semitic": "ar he mt am",
    "dravidian": "ta te kn ml",
    "sinitic": "zh yue wuu",
    "malayic": "id ms jv su",
}
_FAMILY = {lang: family for family, langs in FAMILIES.items() for lang in langs.split()}

_BYTE = np.array([b if b >= 0x80 or 0x61 <= b <= 0x7A else 0x20 for b in range(256)], np.uint8)


def grams(text: str) -> np.ndarray:
    """Bucket of every run of one to four bytes of the lower-cased text, other ASCII than letters folded to blanks."""
    a = _BYTE[np.frombuffer(text.lower().encode("utf-8", "replace"), np.uint8)]
    blank = a == 0x20
    a = a[~(blank & np.roll(blank, 1))].astype(np.uint32)
    out, code = [], np.zeros(len(a), np.uint32)
    for n in range(ORDERS):
        code = (code[: len(a) - n] << np.uint32(8)) | a[n:] if len(a) > n else code[:0]
        out.append(((code + np.uint32(n)) * np.uint32(2654435761)) >> np.uint32(16))
    return np.concatenate(out).astype(np.int64)


def profile(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Buckets that occur, and how often."""
    count = np.bincount(grams(text), minlength=BUCKETS)
    at = np.flatnonzero(count)
    return at, count[at]


def has_letter(text: str | None) -> bool:
    return text is not None and any(map(str.isalpha, text))


class Model:
    """Family weights and one separating vector per pair of languages."""

    def __init__(self, samples: list[tuple[str, np.ndarray, np.ndarray]]):
        langs = sorted({s[0] for s in samples})
        self.families = sorted({_FAMILY.get(x, x) for x in langs})
        self.members = [[x for x in langs if _FAMILY.get(x, x) == f] for f in self.families]
        total = np.full((len(self.families), BUCKETS), 0.5)
        docs = np.zeros(len(self.families))
        for lang, at, n in samples:
            f = self.families.index(_FAMILY.get(lang, lang))
            total[f, at] += n
            docs[f] += 1
        self.log_p = np.log(total / total.sum(1, keepdims=True)).astype(np.float32) if len(langs) else total
        self.prior = np.log((docs + 1) / (docs.sum() + len(docs))) if len(langs) else docs
        self.pairs = {}
        for members in self.members:
            for a, b in combinations(members, 2):
                rows = [s for s in samples if s[0] in (a, b)]
                x = [(at, np.sqrt(n / max(1, n.sum())).astype(np.float32)) for _, at, n in rows]
                self.pairs[a, b] = fit_svm(x, np.array([1 if s[0] == a else -1 for s in rows]), BUCKETS)

    def predict(self, text: str | None) -> tuple[str, float]:
        if not self.families or not has_letter(text):
            return "und", 0.0
        at, n = profile(text)
        odds = self.prior + (self.log_p[:, at] @ n) / ORDERS  # the orders repeat each other's evidence
        p = np.exp(odds - odds.max())
        f = int(np.argmax(p))
        members, family = self.members[f], float(p[f] / p.sum())
        if len(members) == 1:
            return members[0], family
        x = np.sqrt(n / n.sum())
        votes, sure = Counter(dict.fromkeys(members, 0)), Counter(dict.fromkeys(members, 0.0))
        for a, b in combinations(members, 2):
            w, bias = self.pairs[a, b]
            q = 1 / (1 + np.exp(-2 * float(np.clip(w[at] @ x + bias, -300, 300))))
            votes[a if q >= 0.5 else b] += 1
            sure[a] += q / (len(members) - 1)
            sure[b] += (1 - q) / (len(members) - 1)
        best = max(members, key=lambda m: (votes[m], sure[m]))
        return best, family * float(sure[best])


def fit(docs: DataFrame, *, text: str = "text", lang: str = "lang", key: str = "doc_id", seed: int = 0) -> Model:
    """Learns from all rows given that have a text and a language."""
    small_batches(docs.sparkSession)
    known = docs.where(F.col(text).isNotNull() & F.col(lang).isNotNull())
    sizes = {r["l"]: r["n"] for r in known.groupBy(F.col(lang).alias("l")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "l").limit(LANGUAGES).collect()}
    chosen = F.lit(False)
    for value, n in sizes.items():
        chosen = F.when(F.col(lang) == value, sampled(F.col(key), n, PER_LANGUAGE, seed)).otherwise(chosen)

    def profiles(batches):
        for b in batches:
            rows = [(x, *profile(t)) for x, t in zip(b["l"], b["t"]) if has_letter(t)]
            yield pd.DataFrame({"l": [r[0] for r in rows], "at": [r[1].astype(np.int32) for r in rows], "n": [r[2].astype(np.int32) for r in rows]})

    picked = known.where(chosen).select(F.col(lang).alias("l"), F.col(text).alias("t"))
    most = 2 * PER_LANGUAGE * max(1, len(sizes))  # holds even if one id is repeated very often
    got = collected(picked.mapInPandas(profiles, "l string, at array<int>, n array<int>").limit(most))
    rows = list(zip(got["l"], got["at"], got["n"]))
    rows.sort(key=lambda r: (r[0], len(r[1]), zlib.crc32(r[1]), zlib.crc32(r[2])))  # the order in which tasks end must not matter
    return Model(rows)


def predictor(model: Model, spark):
    """Column function from text to (lang_pred, score)."""
    sent = spark.sparkContext.broadcast(model)

    @F.pandas_udf("lang_pred string, score double")
    def predict(text: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([sent.value.predict(t) for t in text], columns=["lang_pred", "score"])

    return predict.asNondeterministic()  # else a filter on the result would run it a second time


def identify(docs: DataFrame, model: Model, *, text: str = "text") -> DataFrame:
    """Adds lang_pred and score."""
    small_batches(docs.sparkSession)
    keep = [c for c in docs.columns if c not in ("lang_pred", "score", "_p")]
    predict = predictor(model, docs.sparkSession)
    return docs.select(*keep, predict(F.col(text)).alias("_p")).select(*keep, "_p.lang_pred", "_p.score")


def accepted(lang_pred: Column, score: Column, least: float = 0.3) -> Column:
    """Whether a document has a language at all, told with some confidence."""
    return (lang_pred != "und") & (score >= least)
