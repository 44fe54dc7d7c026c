"""Streams over the stored tables, drained and compared with their batch result."""

from __future__ import annotations

from pyspark.sql import functions as F

from stemma.operators import store as ST
from stemma.plans.registry import Registry
from stemma.sources import tables as S
from stemma.streaming import ingest as I
from stemma.streaming import stateful

R = Registry()


def _setup(spark, name):
    base = I.work_folder(spark, name)
    return ST.Table(spark, base, name), f"{base}/checkpoint"


@R.query("stream_ingest", "SELECT doc_id, lang, source, n_chars, length(text)::INT AS chars FROM documents")
def stream_ingest(spark, sf_dir):
    t, ck = _setup(spark, "nodes")
    s = I.file_stream(spark, f"{sf_dir}/documents.parquet").select("doc_id", "lang", "source", "n_chars", F.length("text").alias("chars"))
    I.drain(s, I.upsert_into(t, "doc_id"), ck)
    return t.read()


@R.query("stream_dedupe", "SELECT user_id, min(event_id) AS event_id, arg_min(event_type, event_id) AS event_type FROM events GROUP BY 1")
def stream_dedupe(spark, sf_dir):
    t, ck = _setup(spark, "seen")
    s = I.file_stream(spark, f"{sf_dir}/events.parquet").select("user_id", "event_id", "event_type")
    I.drain(s, I.insert_new(t, "user_id", "event_id"), ck)
    return t.read()


@R.query("stream_every_n", "SELECT 0::BIGINT AS batch_id, count(*) AS rows, count(*) AS total, count(*) // 100 AS updates FROM documents")
def stream_every_n(spark, sf_dir):
    t, ck = _setup(spark, "counter")
    s = I.file_stream(spark, f"{sf_dir}/documents.parquet", 1).select("doc_id")
    I.drain(s, I.every_n(100, t), ck)
    return t.read()


@R.query(
    "stream_history",
    """SELECT user_id AS query_id, count(*) AS execution_count, max(value) AS peak_conveyance, arg_min(value, ts) AS initial_conveyance, arg_max(value, ts) AS current_conveyance FROM events GROUP BY 1""",
)
def stream_history(spark, sf_dir):
    """Run history per query kept up to date by a streaming aggregation."""
    t, ck = _setup(spark, "history")
    s = I.file_stream(spark, f"{sf_dir}/events.parquet").groupBy(F.col("user_id").alias("query_id")).agg(
        F.count("*").alias("execution_count"), F.max("value").alias("peak_conveyance"), F.min_by("value", "ts").alias("initial_conveyance"), F.max_by("value", "ts").alias("current_conveyance")
    )
    I.drain(s, I.upsert_into(t, "query_id"), ck, "update")
    return t.read()


@R.query(
    "stream_batches",
    """SELECT k::BIGINT AS batch_id, n AS rows, sum(n) OVER (ORDER BY k)::BIGINT AS total, (sum(n) OVER (ORDER BY k) // 100 - (sum(n) OVER (ORDER BY k) - n) // 100)::BIGINT AS updates
 FROM (SELECT doc_id % 4 AS k, count(*) AS n FROM documents GROUP BY 1)""",
)
def stream_batches(spark, sf_dir):
    """The counter over four arrivals of files, one micro-batch each, with its state kept between them."""
    folder, (t, ck) = I.work_folder(spark, "arrivals"), _setup(spark, "arrival-counter")
    docs = S.table(spark, sf_dir, "documents").select("doc_id")
    for k in range(4):
        docs.where(F.col("doc_id") % 4 == k).coalesce(1).write.mode("append").parquet(folder)
    I.drain(I.file_stream(spark, folder, 1), I.every_n(100, t), ck)
    return t.read()


ARRIVALS = 3


def _arrive(spark, sf_dir, folder: str, k: int) -> None:
    """A third of the events as files, in the order of their ids."""
    events = S.table(spark, sf_dir, "events").select("event_id", "user_id", "event_type", "value", F.unix_micros(F.col("ts").cast("timestamp")).alias("at"))
    n = events.agg(F.max("event_id")).first()[0] + 1
    third = F.floor(F.col("event_id") * ARRIVALS / F.lit(n))
    events.where(third == k).write.mode("append").parquet(folder)


def _in_arrivals(spark, sf_dir, name: str, run) -> None:
    """Each arrival drained as one micro-batch, however many files it has; the query starts again on its checkpoint for the next."""
    folder = I.work_folder(spark, name)
    stateful.use_rocksdb(spark)
    for k in range(ARRIVALS):
        _arrive(spark, sf_dir, folder, k)
        run(I.file_stream(spark, folder))


@R.query("stream_first_seen", "SELECT user_id, min(event_id) AS event_id, arg_min(event_type, event_id) AS event_type FROM events GROUP BY 1")
def stream_first_seen(spark, sf_dir):
    """First event of each user over several arrivals and a restart, with the users seen kept as state."""
    base = I.work_folder(spark, "first-seen")

    def run(stream):
        out = stateful.first_per_key(stream.select("user_id", "event_id", "event_type"), "user_id", "event_id")
        out.writeStream.format("parquet").option("path", f"{base}/rows").option("checkpointLocation", f"{base}/checkpoint").trigger(availableNow=True).start().awaitTermination()

    _in_arrivals(spark, sf_dir, "first-seen-files", run)
    return spark.read.parquet(f"{base}/rows")


@R.query(
    "stream_run_history",
    """SELECT user_id AS query_id, count(*) AS execution_count, max(value) AS peak_conveyance, arg_min(value, (ts, event_id)) AS initial_conveyance, arg_max(value, (ts, -event_id)) AS current_conveyance FROM events GROUP BY 1""",
)
def stream_run_history(spark, sf_dir):
    """Run history of each query over several arrivals and a restart, folded in the state store."""
    t, ck = _setup(spark, "run-history")

    def run(stream):
        rows = stream.select(F.col("user_id").alias("query_id"), "at", "value", "event_id")
        I.drain(stateful.run_history(rows, "query_id", "at", "value", "event_id"), I.upsert_into(t, "query_id"), ck, "update")

    _in_arrivals(spark, sf_dir, "run-history-files", run)
    return t.read()
