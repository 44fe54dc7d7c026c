"""Joins and samples with a known bound."""

from __future__ import annotations

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

SMALL_ROWS = 100_000
BATCH_BYTES = 8 << 20


def small_batches(spark: SparkSession) -> None:
    """Lower the bytes that travel to Python at once, so that tasks over long texts need little memory."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    now = spark.conf.get(key, None)
    if not (now or "").rstrip("b").isdigit() or not 0 < int(now.rstrip("b")) <= BATCH_BYTES:
        spark.conf.set(key, str(BATCH_BYTES))


def attach(rows: DataFrame, small: DataFrame, on: list[str], how: str = "inner") -> DataFrame:
    """Join with an aggregate, which is sent to the tasks only if its counted rows allow it."""
    return rows.join(F.broadcast(small) if small.limit(SMALL_ROWS + 1).count() <= SMALL_ROWS else small, on, how)


def collected(rows: DataFrame) -> pd.DataFrame:
    """A bounded table as pandas, through Arrow whatever the session's setting is."""
    out = rows.toArrow().to_pandas(self_destruct=True, split_blocks=True)
    pa.default_memory_pool().release_unused()
    return out


def fold(doc_id: Column, n: int) -> Column:
    """crc32 of the id written as text, modulo n."""
    return F.crc32(doc_id.cast("string").cast("binary")) % n


def sampled(key: Column, have: int, want: int, seed: int = 0) -> Column:
    """Condition that holds for about `want` of `have` rows, told by a hash of the key."""
    return F.lit(True) if have <= want else F.pmod(F.xxhash64(F.lit(seed), key), F.lit(1 << 30)) < int(want / have * (1 << 30))
