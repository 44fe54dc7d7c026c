"""Versioned node and edge tables on Parquet: upserts, queries as documents, run histories.

A table is a folder of numbered versions, each followed by numbered deltas. A write counts once its
success file is there, so a reader never sees half of one and nothing overwrites what it reads. An
upsert writes only its own rows; readers fold the deltas in, and a new version is written now and then.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def merge(old: DataFrame, new: DataFrame, key: str | list[str]) -> DataFrame:
    """Upsert that keeps old values where the new row has none; columns are united."""
    keys = [key] if isinstance(key, str) else key
    cols = keys + [c for c in dict.fromkeys(old.columns + new.columns) if c not in keys]
    a = old.select(*keys, F.struct(*[c for c in old.columns if c not in keys]).alias("_o"))
    b = new.select(*keys, F.struct(*[c for c in new.columns if c not in keys]).alias("_n"))
    j = a.join(b, keys, "full_outer")

    def pick(c):
        if c in keys:
            return F.col(c)
        parts = ([F.col(f"_n.{c}")] if c in new.columns else []) + ([F.col(f"_o.{c}")] if c in old.columns else [])
        return F.coalesce(*parts).alias(c)

    return j.select(*[pick(c) for c in cols])


def replace(old: DataFrame, new: DataFrame, key: str | list[str]) -> DataFrame:
    """Batch write with overwrite: a new row takes the place of the whole old row."""
    keys = [key] if isinstance(key, str) else key
    return old.join(new.select(*keys), keys, "left_anti").unionByName(new, allowMissingColumns=True)


def latest_edges(edges: DataFrame, order: str, with_relationship: bool = True) -> DataFrame:
    """Last write per edge key, with the defaults for missing fields; folded before the shuffle.

    The key holds the relationship, so a second relationship of a pair does not replace the first.
    """
    defaults = {"relationship": "related", "edge_type": "semantic", "weight": 1.0}
    keys = ["src", "dst"] + (["relationship"] if with_relationship else [])
    if with_relationship:
        own = F.col("relationship") if "relationship" in edges.columns else F.lit(None).cast("string")
        edges = edges.withColumn("relationship", F.coalesce(own, F.lit(defaults["relationship"])))
    last = _newest(edges, keys, order)
    for c, d in defaults.items():
        if c not in keys:
            last = last.withColumn(c, F.coalesce(F.col(c), F.lit(d)) if c in last.columns else F.lit(d))
    return last


def _newest(df: DataFrame, keys: list[str], order: str) -> DataFrame:
    """Row with the greatest `order` (unique per key). Fixed-width columns are kept one by one, which Spark
    can hash; a row with texts is kept as a whole."""
    rest = [c for c in df.columns if c not in keys]
    if all(isinstance(df.schema[c].dataType, (T.NumericType, T.BooleanType, T.DatetimeType)) for c in rest):
        return df.groupBy(*keys).agg(*[F.max_by(c, order).alias(c) for c in rest])
    last = df.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.col(order)).alias("_e"))
    return last.select(*keys, *[F.col(f"_e.{c}").alias(c) for c in rest])


def first_seen(df: DataFrame, key: str, order: str) -> DataFrame:
    """First row per id in the given order."""
    rest = [c for c in df.columns if c != key]
    return df.groupBy(key).agg(F.min_by(F.struct(*rest), F.col(order)).alias("_r")).select(key, *[F.col(f"_r.{c}").alias(c) for c in rest])


def skip_existing(new: DataFrame, stored: DataFrame, key: str) -> DataFrame:
    return new.join(stored.select(key), key, "left_anti")


def matching_queries(queries: DataFrame, tags: list[str]) -> DataFrame:
    """Queries that carry any of the tags; one without tags matches nothing."""
    return queries.where(F.arrays_overlap("collection_tags", F.array(*[F.lit(t) for t in tags])))


def toggle(queries: DataFrame, tags: list[str], active: bool) -> DataFrame:
    """Queries after the switch, with `affected` marking those whose state flipped."""
    was = F.coalesce(F.col("is_active"), F.lit(True))
    hit = F.coalesce(F.arrays_overlap("collection_tags", F.array(*[F.lit(t) for t in tags])), F.lit(False))
    return queries.withColumn("affected", hit & (was != F.lit(active))).withColumn("is_active", F.when(hit, F.lit(active)).otherwise(was))


def toggle_nodes(nodes: DataFrame, toggled: DataFrame, key: str = "doc_id") -> DataFrame:
    """Node table after a switch: deactivated queries leave, activated ones enter."""
    flips = toggled.where("affected")
    out = nodes.join(flips.where("NOT is_active").select(key), key, "left_anti")
    come = flips.where("is_active").join(nodes.select(key), key, "left_anti")
    return out.unionByName(come.select(*[c for c in nodes.columns if c in come.columns]), allowMissingColumns=True)


def evolution(history: DataFrame, query: str, ts: str, score: str, results: str, ids: str) -> DataFrame:
    """Change between the first and the last run of each query that ran more than once.

    First and last are min_by/max_by folds, so a query with very many runs costs one partial row per task.
    """
    row = F.struct(score, results, ids)
    g = history.groupBy(query).agg(
        F.count("*").alias("execution_count"), F.min_by(row, F.col(ts)).alias("a"), F.max_by(row, F.col(ts)).alias("b"), F.max(score).alias("peak_conveyance")
    ).where("execution_count > 1")
    delta = F.col(f"b.{score}") - F.col(f"a.{score}")
    return g.select(
        query, "execution_count", F.col(f"a.{score}").alias("initial_conveyance"), F.col(f"b.{score}").alias("current_conveyance"), delta.alias("conveyance_delta"),
        F.when(delta > 0, "increasing").otherwise("decreasing").alias("conveyance_trend"),
        (F.col(f"b.{results}") - F.col(f"a.{results}")).alias("result_count_delta"),
        F.size(F.array_except(F.col(f"b.{ids}"), F.col(f"a.{ids}"))).alias("new_high_value_results"), "peak_conveyance",
    )


def asof(left: DataFrame, right: DataFrame, key: str, at: str, bucket: Column, value: list[str], default: dict | None = None) -> DataFrame:
    """Nearest strictly preceding right row of the same key for every left row.

    Rows are ordered inside (key, bucket) only; what precedes a bucket comes from one summary row per
    bucket, so a hot key is spread over its buckets instead of sorted by one task.
    """
    from pyspark.sql import Window

    pack = F.struct(F.col(at).alias("_at"), *value)
    r = right.select(key, at, F.lit(0).alias("_side"), pack.alias("_v")).withColumn("_b", bucket)
    cols = [c for c in left.columns if c not in (key, at)]
    left_side = left.select(key, at, F.lit(1).alias("_side"), F.struct(*cols).alias("_l")).withColumn("_b", bucket)
    last = r.groupBy(key, "_b").agg(F.max_by("_v", F.col(at)).alias("_last"))
    both_b = last.unionByName(left_side.select(key, "_b").distinct(), allowMissingColumns=True).groupBy(key, "_b").agg(F.max("_last").alias("_last"))
    w_b = Window.partitionBy(key).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    carry = both_b.select(key, "_b", F.last("_last", ignorenulls=True).over(w_b).alias("_carry"))
    every = r.unionByName(left_side, allowMissingColumns=True)
    # left rows sort before right rows of the same time: strictly preceding
    w = Window.partitionBy(key, "_b").orderBy(at, F.desc("_side")).rowsBetween(Window.unboundedPreceding, -1)
    seen = every.withColumn("_near", F.last("_v", ignorenulls=True).over(w)).where("_side = 1")
    out = seen.join(carry, [key, "_b"], "left").withColumn("_m", F.coalesce("_near", "_carry"))
    d = default or {}
    return out.select(key, at, *[F.col(f"_l.{c}").alias(c) for c in cols], *[F.coalesce(F.col(f"_m.{v}"), F.lit(d[v])).alias(v) if v in d else F.col(f"_m.{v}").alias(v) for v in value])


def fold_deltas(parts: list[DataFrame], key: list[str]) -> DataFrame:
    """Rows of a version and its deltas, oldest first: per key the newest value of every column that is not null."""
    every = parts[0].withColumn("_v", F.lit(0))
    for i, p in enumerate(parts[1:], 1):
        every = every.unionByName(p.withColumn("_v", F.lit(i)), allowMissingColumns=True)
    rest = [c for c in every.columns if c not in (*key, "_v")]
    newest = [F.max_by(F.col(c), F.when(F.col(c).isNotNull(), F.col("_v"))).alias(c) for c in rest]
    return every.groupBy(*key).agg(*newest) if rest else every.select(*key).distinct()


class Table:
    """A named table under a root folder."""

    compact_every = 20

    def __init__(self, spark: SparkSession, root: str, name: str):
        self.spark, self.base = spark, f"{root.rstrip('/')}/{name}"
        self._path = spark._jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(self.base).getFileSystem(spark._jsc.hadoopConfiguration())

    def _finished(self) -> list[str]:
        """Names of complete versions (v00000001) and deltas (v00000001.d00000001.key) in order."""
        p = self._path(self.base)
        if not self._fs.exists(p):
            return []
        names = [s.getPath().getName() for s in self._fs.listStatus(p)]
        return sorted(n for n in names if n.startswith("v") and self._fs.exists(self._path(f"{self.base}/{n}/_SUCCESS")))

    def _current(self) -> tuple[str | None, list[str]]:
        names = self._finished()
        versions = [n for n in names if "." not in n]
        if not versions:
            return None, []
        return versions[-1], [n for n in names if n.startswith(versions[-1] + ".")]

    def exists(self) -> bool:
        return self._current()[0] is not None

    def read(self) -> DataFrame:
        version, deltas = self._current()
        if version is None:
            raise FileNotFoundError(self.base)
        parts = [self.spark.read.parquet(f"{self.base}/{n}") for n in [version, *deltas]]
        if not deltas:
            return parts[0]
        return fold_deltas(parts, deltas[0].split(".", 2)[2].split(","))

    def write(self, df: DataFrame, partition_by: list[str] | None = None) -> None:
        """New version with these rows."""
        version, _ = self._current()
        w = df.write.mode("overwrite")
        if partition_by:
            w = w.partitionBy(*partition_by)
        w.parquet(f"{self.base}/v{(int(version[1:]) + 1 if version else 1):08d}")

    def upsert(self, new: DataFrame, key: str | list[str]) -> None:
        """Merge rows by key; the cost is that of the new rows, until the deltas are folded into a version.

        `new` holds each key once. All upserts between two versions share one key. Of two writers that pick
    the same number only the first goes through, the other gets an error.
        """
        keys = [key] if isinstance(key, str) else key
        version, deltas = self._current()
        if version is None:
            return self.write(new)
        if len(deltas) >= self.compact_every or (deltas and deltas[0].split(".", 2)[2] != ",".join(keys)):
            self.write(self.read())
            version, deltas = self._current()
        number = int(deltas[-1].split(".")[1][1:]) + 1 if deltas else 1
        new.write.mode("errorifexists").parquet(f"{self.base}/{version}.d{number:08d}.{','.join(keys)}")

    def overwrite_rows(self, new: DataFrame, key) -> None:
        self.write(replace(self.read(), new, key) if self.exists() else new)

    def clear(self) -> None:
        self.write(self.read().where(F.lit(False)))

    def get(self, key: str, value) -> DataFrame:
        return self.read().where(F.col(key) == value)

    def append_json(self, df: DataFrame, log: str) -> None:
        """Append-only log next to the versions."""
        df.write.mode("append").json(f"{self.base}.{log}")


def write_queries(spark: SparkSession, root: str, queries: DataFrame, key: str = "doc_id") -> None:
    """Merge queries into the table `queries`, and the active ones into `nodes`; inactive ones leave `nodes`."""
    Table(spark, root, "queries").upsert(queries, key)
    nodes = Table(spark, root, "nodes")
    active = queries.where("is_active").select(key)
    nodes.write(nodes.read().select(key).join(queries.select(key), key, "left_anti").unionByName(active) if nodes.exists() else active)
