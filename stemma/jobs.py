"""The end-to-end jobs: process a corpus into stored nodes, and build its graph."""

from __future__ import annotations

import time
from collections.abc import Callable

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from stemma import config as C
from stemma.functions import paths as P
from stemma.functions import text as X
from stemma.operators import edges as E
from stemma.operators import embedding as EM
from stemma.operators import simjoin
from stemma.operators import store as ST
from stemma.session import cut_lineage
from stemma.sources import files as FS


def process(spark: SparkSession, root: str, out: str, conf: dict | None = None, factory: Callable[[], EM.Model] = EM.HashingModel, counters: dict | None = None) -> ST.Table:
    """Load the texts below `root`, score, chunk and embed them, and merge them into the `nodes` table.

    The tree is read once. Markdown and Python texts are scored with their code blocks and headers. Every
    chunk gets a row with its vector in `chunks`, every file a row in `results` with its scores or its error.
    Documents already stored under the same key and content are left alone, so a rerun resumes. A file or
    folder that cannot be read does not end the job. `counters` is filled with the files `processed` and
    `failed`, as observed while the results are written, and the `seconds` taken.
    """
    began = time.monotonic()
    conf = conf or C.load()
    suffixes = [s for k in ("text", "markdown", "python", "json") for s in P.LOADERS[k]]
    found = FS.read_contents(spark, root, suffixes, errors=True).withColumns({"doc_id": F.md5("path"), "content_hash": F.md5("text")})
    nodes = ST.Table(spark, out, "nodes")
    if nodes.exists():
        found = found.join(nodes.read().select("doc_id", "content_hash"), ["doc_id", "content_hash"], "left_anti")
    found = cut_lineage(found)  # read once: nodes, chunks and results all start from here
    d = found.where("error IS NULL").drop("error")
    built = cut_lineage(EM.build_documents(d, "doc_id", "text", "path", factory))
    chunks = EM.chunk_vectors(d, "doc_id", "text", factory)
    ST.Table(spark, out, "chunks").upsert(chunks.withColumn("chunk_id", F.concat_ws("#", "doc_id", "chunk_index")), "chunk_id")
    t = F.col("text")
    lines = X.lines_of(t)
    loaded = d.select("doc_id", "path", "content_hash", "text", X.code_blocks(t).alias("blocks"), X.markdown_structure(t, lines)["headers"].alias("headers"))
    scored = X.with_scores(loaded.withColumn("outline", F.struct("headers", F.col("headers").alias("sections"))), "text", "blocks", "outline")
    unread = found.where("error IS NOT NULL").select("path", F.col("error").alias("why"))
    files = FS.walk(spark, root, errors=True).select("path", "error").join(unread, "path", "left").select("path", F.coalesce("error", "why").alias("error"))
    results = scored.select("path", "doc_id", *X.MAIN_SCORES, "code_score", "structure_score", F.size("blocks").alias("code_blocks"), "headers")
    results = results.join(files, "path", "full").select("*", (F.col("doc_id").isNotNull()).alias("success"))
    seen = Observation("results")
    results = results.where("doc_id IS NOT NULL OR error IS NOT NULL").observe(seen, F.count_if("success").alias("processed"), F.count_if(~F.col("success")).alias("failed"))
    ST.Table(spark, out, "results").upsert(results, "path")
    nodes.upsert(built.join(d.select("doc_id", "content_hash"), "doc_id"), "doc_id")
    if counters is not None:
        counters |= seen.get | {"seconds": time.monotonic() - began}
    return nodes


def build(spark: SparkSession, root: str, out: str, conf: dict | None = None) -> dict[str, DataFrame]:
    """Edges of a processed corpus, each kind written to its own table: directories, content, owner,
    usability, composite, named files, and similarity of the stored vectors.

    The tree is read once; the edge counts work on its stored file table.
    """
    conf = conf or C.load()
    nodes = ST.Table(spark, out, "nodes").read()
    theta = float(conf["graph"]["similarity"])
    sim = simjoin.geometric_pairs(nodes, "doc_id", ("where_vector", "what_vector", "conveyance_vector"), theta)
    stored = ST.Table(spark, out, "files")
    stored.write(FS.with_contents(FS.scan(spark, root)))
    files = stored.read()
    tables = {
        "contains": E.contains_edges(files),
        "sibling": E.sibling_counts(files),
        "what": E.what_counts(files),
        "who": E.who_counts(files.where("owner IS NOT NULL")),
        "conveyance": E.conveyance_counts(files),
        "composite": E.composite_counts(files),
        "named": E.named_siblings(files),
        "similar": sim,
    }
    for name, df in tables.items():
        ST.Table(spark, out, f"edges_{name}").write(df)
    return {name: ST.Table(spark, out, f"edges_{name}").read() for name in tables}


def organise(papers: DataFrame, out: str) -> None:
    """Write papers under class folders; `main_class` and `code` become directories."""
    papers.write.mode("overwrite").partitionBy("main_class", "code").parquet(out)


def dataset(nodes: DataFrame, out: str) -> DataFrame:
    """Write a node table as JSON and return its one-row summary."""
    nodes.write.mode("overwrite").json(out)
    return nodes.agg(F.count("*").alias("total_documents"), F.max(F.size("what_vector")).alias("dims"))
