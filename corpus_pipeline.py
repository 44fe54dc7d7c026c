"""Training-data pipeline over `documents`: five stages, each written as Parquet and read again by the next.

language ID, quality classifier, near-duplicate join, benchmark decontamination, mixing to target weights.
All stages but the last return the columns of `documents`; the last returns the mixture, one row per
document and epoch.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stemma.llm import decontaminate, jaccard, language, plans
from stemma.session import ensure_checkpoint_dir
from stemma.sources.tables import table


def _apart(docs: DataFrame, *needed: str) -> DataFrame:
    """The columns of documents under names that no operation uses, beside those that a stage needs."""
    return docs.select(*[F.col(c).alias(f"_in_{c}") for c in docs.columns], *needed)


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a language that can be told; `lang` becomes the predicted one."""
    model = language.fit(docs)
    judged = language.identify(_apart(docs, "text"), model).where(language.accepted(F.col("lang_pred"), F.col("score")))
    return judged.select(*[F.col("lang_pred" if c == "lang" else f"_in_{c}").alias(c) for c in docs.columns])


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of good quality, judged from their text and site."""
    judged = plans.quality_of(_apart(docs, "doc_id", "text", "source", "lang"), table(spark, sf_dir, "labels")).where("keep")
    return judged.select(*[F.col(f"_in_{c}").alias(c) for c in docs.columns])


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies, that with the smallest id, rows without id last."""
    return jaccard.one_of_each(docs)


def benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that leak no benchmark item."""
    return decontaminate.clean(docs, table(spark, sf_dir, "benchmark"))


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents of the mixture with their domain and epoch."""
    return plans.mixture(docs)


STAGES = [
    ("language ID", language_id),
    ("quality classifier", quality),
    ("n-gram Jaccard join", near_duplicates),
    ("benchmark decontamination", benchmark),
    ("mixing to target weights", mixture),
]

# Trained classifiers and string tiling are not SQL; the stages are tested against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Applies all stages to `documents`; results between stages are written to the shared folder."""
    folder = f"{ensure_checkpoint_dir(spark)}/pipeline-{uuid.uuid4().hex}"
    docs = table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES[:-1]):
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{k}")
        docs = spark.read.parquet(f"{folder}/{k}")
    return STAGES[-1][1](spark, docs, sf_dir)
