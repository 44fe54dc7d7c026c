"""Vectors stored by cell, so that a search reads only the cells it needs."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from stemma.functions import vectors as V
from stemma.operators import store as ST


class VectorIndex:
    """Unit vectors partitioned by nearest centre, with the angle each cell spans.

    At most `cells` centres exist, and only centres ever reach the driver.
    """

    def __init__(self, spark: SparkSession, root: str, name: str = "vectors"):
        self.spark = spark
        self.vectors = ST.Table(spark, root, f"{name}-cells")
        self.centres = ST.Table(spark, root, f"{name}-centres")

    def build(self, df: DataFrame, id_col: str, v: str, cells: int = 100) -> "VectorIndex":
        rows = df.select(F.col(id_col).alias("id"), V.unit(F.col(v)).alias("v")).where("exists(v, x -> x <> 0)")
        rows = rows.withColumn("h", F.xxhash64("id"))
        sample = rows.orderBy("h").limit(cells).select("v").collect()
        self._place(rows.drop("h"), np.array([r["v"] for r in sample]))
        return self

    def _place(self, rows: DataFrame, centres: np.ndarray) -> None:
        schema = T.StructType(rows.schema.fields + [T.StructField("angle", T.DoubleType()), T.StructField("cell", T.IntegerType())])

        def run(batches):
            for pdf in batches:
                a = np.arccos(np.clip(V.matrix(pdf["v"]) @ centres.T, -1, 1))
                cell = a.argmin(1)
                yield pdf.assign(angle=a[np.arange(len(pdf)), cell], cell=cell.astype("int32"))

        placed = rows.select("id", "v").mapInPandas(run, schema)
        self.vectors.write(placed.repartition("cell", F.pmod(F.xxhash64("id"), F.lit(8))), ["cell"])
        spans = self.vectors.read().groupBy("cell").agg(F.max("angle").alias("radius"), F.count("*").alias("n"))
        known = self.spark.createDataFrame([(i, c.tolist()) for i, c in enumerate(centres)], "cell int, centre array<double>")
        self.centres.write(known.join(spans, "cell"))

    def add(self, df: DataFrame, id_col: str, v: str) -> None:
        """Upsert vectors; the centres stay."""
        new = df.select(F.col(id_col).alias("id"), V.unit(F.col(v)).alias("v")).where("exists(v, x -> x <> 0)")
        old = self.vectors.read().select("id", "v")
        self._place(ST.replace(old, new, "id"), self._centres()[1])

    def remove(self, ids: DataFrame) -> None:
        keep = self.vectors.read().select("id", "v").join(ids, "id", "left_anti")
        self._place(keep, self._centres()[1])

    def _centres(self):
        c = self.centres.read().orderBy("cell").collect()  # bounded by the number of cells
        return np.array([r["cell"] for r in c]), np.array([r["centre"] for r in c]), np.array([r["radius"] for r in c]), np.array([r["n"] for r in c])

    def search(self, query: list[float], k: int, probes: int | None = None) -> DataFrame:
        """k best (id, score). With `probes` only that many cells are read; without, the answer is exact:
        cells near the query give a k-th score, then every cell that could beat it is read."""
        cell, centre, radius, n = self._centres()
        q = np.asarray(query, dtype=float)
        q = q / np.sqrt((q * q).sum())
        angle = np.arccos(np.clip(centre @ q, -1, 1))
        order = angle.argsort()
        if probes is None:
            filled = n[order].cumsum()
            first = order[: int(np.searchsorted(filled, k)) + 1]
            near = self._score(cell[first], q).where("score IS NOT NULL").orderBy(F.desc("score"), "id").limit(k).agg(F.min("score").alias("s"), F.count("*").alias("c")).first()
            limit = np.arccos(np.clip(near["s"], -1, 1)) + 1e-6 if near["c"] >= k else np.pi
            chosen = cell[angle - radius <= limit]
        else:
            chosen = cell[order[:probes]]
        return self._score(chosen, q).where("score IS NOT NULL").orderBy(F.desc("score"), "id").limit(k)

    def _score(self, cells, q) -> DataFrame:
        part = self.vectors.read().where(F.col("cell").isin([int(c) for c in cells]))
        return V.score(part.select("id", "v"), "v", q.tolist())
