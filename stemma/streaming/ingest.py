"""Incremental ingestion: file streams folded into stored tables."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery, StreamingQueryListener

from stemma.operators import store as ST
from stemma.session import ensure_checkpoint_dir


def work_folder(spark: SparkSession, name: str) -> str:
    """A fresh folder of this run under the shared checkpoint folder."""
    return f"{ensure_checkpoint_dir(spark).rstrip('/')}/stemma/{name}-{uuid.uuid4().hex}"


def file_stream(spark: SparkSession, path: str, files_per_batch: int | None = None) -> DataFrame:
    """Parquet files under a folder, or one file, as a stream with the schema of what is already there."""
    schema = spark.read.parquet(path).schema
    r = spark.readStream.schema(schema)
    if files_per_batch:
        r = r.option("maxFilesPerTrigger", files_per_batch)
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    if p.getFileSystem(spark._jsc.hadoopConfiguration()).getFileStatus(p).isFile():  # a file source watches folders
        return r.option("pathGlobFilter", p.getName()).parquet(p.getParent().toString())
    return r.parquet(path)


def drain(stream: DataFrame, batch: Callable[[DataFrame, int], None], checkpoint: str, mode: str = "append") -> StreamingQuery:
    """Process everything available and stop; the checkpoint makes a rerun start where this one ended."""
    q = stream.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).outputMode(mode).trigger(availableNow=True).start()
    q.awaitTermination()
    return q


def upsert_into(table: ST.Table, key: str, order: str | None = None) -> Callable[[DataFrame, int], None]:
    """Merge each batch; of several rows per key in one batch the last in `order` counts. A replayed batch merges to the same table."""
    def go(df: DataFrame, _: int) -> None:
        rows = df
        if order:
            rest = [c for c in df.columns if c != key]
            rows = df.groupBy(key).agg(F.max_by(F.struct(*rest), F.col(order)).alias("_r")).select(key, *[F.col(f"_r.{c}").alias(c) for c in rest])
        table.upsert(rows, key)

    return go


def insert_new(table: ST.Table, key: str, order: str) -> Callable[[DataFrame, int], None]:
    """Keep the first row per key and skip keys that are already stored."""
    def go(df: DataFrame, _: int) -> None:
        rows = ST.first_seen(df.withColumn("_o", F.col(order)), key, "_o").drop("_o")
        if table.exists():
            rows = ST.skip_existing(rows, table.read(), key)
        table.upsert(rows, key)

    return go


def every_n(n: int, table: ST.Table, action: Callable[[DataFrame], None] | None = None) -> Callable[[DataFrame, int], None]:
    """Count rows over batches and run `action` whenever the total passes a multiple of n; one log row per batch."""
    def go(df: DataFrame, batch_id: int) -> None:
        spark = df.sparkSession
        # a replayed batch does not count itself, and replaces its own log row below
        before = (table.read().where(F.col("batch_id") < batch_id).agg(F.max("total")).first()[0] if table.exists() else None) or 0
        rows = df.count()
        fired = (before + rows) // n - before // n
        if fired and action:
            action(df)
        row = spark.createDataFrame([(batch_id, rows, before + rows, fired)], "batch_id long, rows long, total long, updates long")
        table.upsert(row, "batch_id")

    return go


class Progress(StreamingQueryListener):
    """Calls back with the rows of every finished batch."""

    def __init__(self, callback: Callable[[str, int], None]):
        self.callback = callback

    def onQueryStarted(self, event):
        pass

    def onQueryProgress(self, event):
        self.callback(str(event.progress.id), int(event.progress.numInputRows))

    def onQueryIdle(self, event):
        pass

    def onQueryTerminated(self, event):
        pass
