"""Text to vector with a pluggable model, and documents with their three vectors."""

from __future__ import annotations

import hashlib
from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from stemma.functions import text as X
from stemma.functions import vectors as V
from stemma.operators import chunking
from stemma.session import cut_lineage

Model = Callable[[list[str]], np.ndarray]


class HashingModel:
    """Deterministic stand-in where no model is at hand: signed counts of words hashed to dimensions.

    It has no learned meaning and is never presented as one.
    """

    WORDS_HELD = 1 << 17

    def __init__(self, dims: int = 64):
        self.dims = dims
        self.seen = _Places(dims)

    def __call__(self, texts: list[str]) -> np.ndarray:
        out = np.zeros((len(texts), self.dims))
        seen = self.seen
        if len(seen) > self.WORDS_HELD:
            seen.clear()
        for row, text in enumerate(texts):
            words = (text or "").encode().split()  # at the white space of ASCII
            n = np.bincount(np.fromiter(map(seen.__getitem__, words), np.int64, len(words)), minlength=2 * self.dims)
            out[row] = n[: self.dims] - n[self.dims :]
        return out


class _Places(dict):
    """Dimension of each word met so far, that of negative words `dims` higher."""

    def __init__(self, dims: int):
        self.dims = dims

    def __missing__(self, word: bytes) -> int:
        h = hashlib.md5(word).hexdigest()
        at = self[word] = int(h[:8], 16) % self.dims + (self.dims if int(h[8], 16) % 2 else 0)
        return at


def embed(df: DataFrame, key: str | list[str], text: str, factory: Callable[[], Model], truncate: int | None = None, batch: int = 32) -> DataFrame:
    """key columns and `embedding`; the model is made once per task and fed batches of texts."""
    keys = [key] if isinstance(key, str) else key
    schema = T.StructType([df.schema[k] for k in keys] + [T.StructField("embedding", T.ArrayType(T.DoubleType()))])

    def run(batches):
        model = factory()
        for pdf in batches:
            texts = pdf[text].fillna("").tolist()
            parts = [np.asarray(model(texts[i : i + batch]), dtype=np.float64)[:, :truncate] for i in range(0, len(texts), batch)]
            vecs = [v for p in parts for v in p]
            yield pdf[keys].assign(embedding=vecs)

    return df.select(*keys, text).mapInPandas(run, schema)


def embed_items(df: DataFrame, key: str, kind: str, text: str, factory: Callable[[], Model]) -> DataFrame:
    """Mixed items: texts, tables and code are embedded as text; images have no model and keep a null vector."""
    texts = df.where(F.col(kind) != "image")
    done = embed(texts, key, text, factory)
    return df.join(done, key, "left")


def index_vector(semantic: Column, where: Column, what: Column, conveyance: Column) -> Column:
    """Vector to index: the semantic one, else the three dimensions in a row."""
    return F.coalesce(semantic, F.concat(where, what, conveyance))


def chunk_vectors(df: DataFrame, key: str, text: str, factory: Callable[[], Model]) -> DataFrame:
    """(key, chunk_index, embedding) of every chunk of every document: texts are cut and embedded in one pass."""
    chunks = chunking.paragraph_chunks(df.select(key, F.col(text).alias("text")))
    return embed(chunks.select(key, "chunk_index", "chunk"), [key, "chunk_index"], "chunk", factory)


def build_documents(df: DataFrame, key: str, text: str, path: str, factory: Callable[[], Model], where_dims: int = 102, conveyance_dims: int = 922) -> DataFrame:
    """Scores, chunks and the WHERE / WHAT / CONVEYANCE vectors of every document.

    WHAT is the embedding of the first chunk.
    """
    low = F.lower(F.col(text))
    comp = X.fallback_indicators(low)
    scored = X.with_scores(df.select(key, text, path), text)
    base = scored.select(
        key, path, *X.MAIN_SCORES, comp["theory_components"].alias("theory_components"), comp["practice_components"].alias("practice_components"),
    )
    chunks = cut_lineage(chunk_vectors(df, key, text, factory))
    first = chunks.where("chunk_index = 0").select(key, "embedding")
    n = chunks.groupBy(key).agg(F.count("*").alias("n_chunks"))
    c = F.col
    return base.join(first, key).join(n, key).select(
        key, path, "n_chunks", *X.MAIN_SCORES, "theory_components", "practice_components",
        V.where_vector(c(path), where_dims).alias("where_vector"), V.unit(c("embedding")).alias("what_vector"),
        V.conveyance_vector(c("implementation_fidelity"), c("actionability"), c("bridge_potential"), F.size("theory_components"), F.size("practice_components"), conveyance_dims).alias("conveyance_vector"),
    )
