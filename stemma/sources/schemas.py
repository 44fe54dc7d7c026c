"""Declared shapes of the stored tables, and the checks a database would have made on write."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

_S, _L, _D, _B, _I, _TS = T.StringType(), T.LongType(), T.DoubleType(), T.BooleanType(), T.IntegerType(), T.TimestampType()
_VEC, _STRS = T.ArrayType(T.DoubleType()), T.ArrayType(T.StringType())


def _struct(**kinds) -> T.StructType:
    return T.StructType([T.StructField(k, v) for k, v in kinds.items()])


# Dimensions of the three vectors and of the whole one, known types and levels.
WHERE_DIMS, WHAT_DIMS, CONVEYANCE_DIMS, FULL_DIMS = 102, 1024, 922, 2048
DOCUMENT_TYPES = ["pdf", "python", "markdown", "jupyter", "text", "code", "directory", "query", "unknown"]
COMPLEXITY_LEVELS = ["beginner", "intermediate", "advanced", "expert", "unknown"]

LOCATION = _struct(
    absolute_path=_S, relative_path=_S, directory_chain=_STRS, file_size=_L, last_modified=_TS, line_start=_I, line_end=_I, chunk_index=_I, total_chunks=_I
)
CONTENT = _struct(
    raw_text=_S, cleaned_text=_S, concepts=_STRS, keywords=_STRS, entities=T.ArrayType(T.MapType(_S, _S)), imports=_STRS, domains=_STRS, topics=_STRS, complexity=_S, prerequisites=_STRS
)
CONVEYANCE = _struct(
    implementation_fidelity=_D, actionability=_D, bridge_potential=_D, test_coverage=_D, cyclomatic_complexity=_I, maintainability_index=_D, enhances=_STRS, enhanced_by=_STRS
)
EMBEDDINGS = _struct(semantic=_VEC, task_adapted=T.MapType(_S, _VEC), where_vector=_VEC, what_vector=_VEC, conveyance_vector=_VEC, full_vector=_VEC, model_versions=T.MapType(_S, _S))
ERROR = _struct(stage=_S, error=_S, timestamp=_TS)
DOCUMENT = _struct(
    doc_id=_S, doc_type=_S, location=LOCATION, content=CONTENT, conveyance=CONVEYANCE, embeddings=EMBEDDINGS, metadata=T.MapType(_S, _S), pipeline_stage=_S, timestamp=_TS,
    errors=T.ArrayType(ERROR), parent_id=_S, child_ids=_STRS, related_ids=_STRS,
)
EDGE = _struct(src=_S, dst=_S, relationship=_S, edge_type=_S, dimension=_S, weight=_D, created_at=_TS, metadata=T.MapType(_S, _S))
RUN = _struct(timestamp=_TS, avg_conveyance=_D, total_results=_I, result_doc_ids=_STRS)
QUERY = _struct(doc_id=_S, is_active=_B, created_at=_TS, collection_tags=_STRS, researcher_id=_S, execution_history=T.ArrayType(RUN))


def to_json(df: DataFrame, struct: str) -> Column:
    return F.to_json(F.col(struct))


def from_json(text: Column, schema: T.StructType = DOCUMENT) -> Column:
    """A document back from its JSON; every declared field survives the round trip."""
    return F.from_json(text, schema)


def known(c: Column, values: list[str]) -> Column:
    return F.when(c.isin(values), c).otherwise(F.lit("unknown"))


def duplicates(df: DataFrame, *key: str) -> DataFrame:
    """Keys that occur more than once; a unique index would have refused them."""
    return df.groupBy(*key).agg(F.count("*").alias("n")).where("n > 1")


def wrong_vectors(df: DataFrame, sizes: dict[str, int]) -> DataFrame:
    """Rows whose vectors do not have the declared length."""
    bad = F.lit(False)
    for c, n in sizes.items():
        bad = bad | (F.col(c).isNotNull() & (F.size(c) != n))
    return df.where(bad)


def bad_edges(df: DataFrame) -> DataFrame:
    """Edges without an end or with a weight outside [0, 1]."""
    return df.where("src IS NULL OR dst IS NULL OR weight < 0 OR weight > 1")


def with_error(df: DataFrame, stage: str, message: Column) -> DataFrame:
    """Append an error entry where the message is not null."""
    entry = F.struct(F.lit(stage).alias("stage"), message.alias("error"), F.current_timestamp().alias("timestamp"))
    old = F.coalesce("errors", F.array().cast(T.ArrayType(ERROR)))
    return df.withColumn("errors", F.when(message.isNotNull(), F.array_append(old, entry)).otherwise(old))
