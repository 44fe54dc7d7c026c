"""Column expressions over array<double> vectors."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def total(v: Column) -> Column:
    return F.aggregate(v, F.lit(0.0), lambda acc, x: acc + x)


def dot(a: Column, b: Column) -> Column:
    return total(F.zip_with(a, b, lambda x, y: x * y))


def norm(v: Column) -> Column:
    return F.sqrt(total(F.transform(v, lambda x: x * x)))


def cosine(a: Column, b: Column) -> Column:
    """Zero when either side has no length."""
    na, nb = norm(a), norm(b)
    return F.when((na > 0) & (nb > 0), dot(a, b) / (na * nb)).otherwise(F.lit(0.0))


def let(value: Column, body) -> Column:
    """body(value) with value computed once; inside a lambda an outer expression is computed per element."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def unit(v: Column) -> Column:
    """Row divided by its length; a zero row stays zero instead of turning into NaN."""
    scaled = lambda a: let(norm(a), lambda n: F.when(n > 0, F.transform(a, lambda x: x / n)).otherwise(a))
    return let(v, scaled)


def euclidean(a: Column, b: Column) -> Column:
    return F.sqrt(total(F.zip_with(a, b, lambda x, y: (x - y) * (x - y))))


def manhattan(a: Column, b: Column) -> Column:
    return total(F.zip_with(a, b, lambda x, y: F.abs(x - y)))


def distance(a: Column, b: Column, metric: str = "cosine") -> Column:
    if metric == "cosine":
        return F.lit(1.0) - cosine(a, b)
    if metric == "euclidean":
        return euclidean(a, b)
    if metric == "manhattan":
        return manhattan(a, b)
    raise ValueError(f"unknown metric {metric!r}")


def truncate(v: Column, dims: int) -> Column:
    return F.slice(v, 1, dims)


def micro(v: Column) -> Column:
    """Vector printed as whole millionths, so that two engines can compare it exactly."""
    return F.array_join(F.transform(v, lambda x: F.round(x * 1e6, 0).cast("long").cast("string")), ",")


def geometric_mean(*sims: Column) -> Column:
    """Root of the product; null unless the product is positive (NaN would pass a >= test in Spark)."""
    p = sims[0]
    for s in sims[1:]:
        p = p * s
    return F.when(p > 0, F.pow(p, F.lit(1.0 / len(sims))))


# Weights of the three dimensions, the simulated per-dimension factors and the context exponent.
DIMENSION_WEIGHTS = {"where": 0.05, "what": 0.50, "conveyance": 0.45}
SIMULATED_FACTORS = {"where": 0.8, "what": 1.0, "conveyance": 0.9}
SEARCH_ALPHA = 1.5


def amplified(where: Column, what: Column, conveyance: Column, weights=None, alpha: float = SEARCH_ALPHA) -> Column:
    """Weighted sum of the dimension scores times conveyance^alpha; null for a negative conveyance score."""
    w = weights or DIMENSION_WEIGHTS
    s = where * w["where"] + what * w["what"] + conveyance * w["conveyance"]
    return F.when(conveyance >= 0, s * F.pow(conveyance, F.lit(alpha)))


def weighted_distance(where: Column, what: Column, conveyance: Column, weights=None) -> Column:
    """Missing WHERE or WHAT counts as the unknown distance .5."""
    w = weights or DIMENSION_WEIGHTS
    return F.coalesce(where, F.lit(0.5)) * w["where"] + F.coalesce(what, F.lit(0.5)) * w["what"] + conveyance * w["conveyance"]


def path_distance(a: Column, b: Column) -> Column:
    """1 - Jaccard overlap of the directory chains; 1 when a chain is empty."""
    inter = F.size(F.array_intersect(a, b))
    union = F.size(F.array_union(a, b))
    return F.when((F.size(a) > 0) & (F.size(b) > 0), F.lit(1.0) - inter / union).otherwise(F.lit(1.0))


def where_vector(path: Column, dims: int = 102) -> Column:
    """Place of a path as a sparse unit vector: depth, two topic flags, class letter, hashed subclass."""
    parts = F.split(path, "/")
    at = F.array_position(parts, "papers").cast("int")
    n = F.size(parts)
    inside = (at > 0) & (n > at + 1)
    cls = F.when(inside, F.get(parts, at))
    sub = F.when(inside, F.get(parts, at + 1))
    valid = F.coalesce(F.instr(F.lit("QPBTHGNZ"), cls) > 0, F.lit(False)) & (F.length(cls) == 1)
    letter = F.when(valid, F.lit(10) + F.ascii(cls) - F.ascii(F.lit("A")))
    code = F.aggregate(F.split(sub, ""), F.lit(0), lambda acc, ch: acc + F.ascii(ch))
    hashed = F.when(sub.isNotNull(), F.lit(20) + code % 40)
    low = F.lower(path)
    known = F.struct(
        n.cast("double").alias("depth"),
        F.contains(low, F.lit("anthropology")).cast("double").alias("one"),
        F.contains(low, F.lit("information")).cast("double").alias("two"),
        F.coalesce(letter, F.lit(-1)).alias("letter"),
        F.coalesce(hashed, F.lit(-1)).alias("hashed"),
    )

    def fill(k):
        return F.transform(
            F.sequence(F.lit(0), F.lit(dims - 1)),
            lambda i: F.when(i == 0, k["depth"]).when(i == 1, k["one"]).when(i == 2, k["two"])
            .when((i == k["letter"]) | (i == k["hashed"]), F.lit(1.0)).otherwise(F.lit(0.0)),
        )

    return unit(let(known, fill))


def conveyance_vector(fidelity, actionability, bridge, n_theory, n_practice, dims: int = 922) -> Column:
    """Three scores, then one flag per theory component from 10 and per practice component from 60."""
    t = F.least(n_theory, F.lit(50)).cast("int")
    p = F.least(n_practice, F.lit(50)).cast("int")
    run = lambda x, n: F.array_repeat(F.lit(x), n)
    raw = F.concat(F.array(fidelity, actionability, bridge), run(0.0, 7), run(1.0, t), run(0.0, 50 - t), run(1.0, p), run(0.0, F.lit(dims - 60) - p))
    return unit(raw)


def matrix(column) -> np.ndarray:
    """Rows of a pandas array column as one float64 matrix."""
    rows = column.to_numpy()
    if not len(rows):
        return np.zeros((0, 0))
    if len(set(map(len, rows))) > 1:
        raise ValueError("vectors of different lengths")
    return np.concatenate(rows).astype(np.float64, copy=False).reshape(len(rows), len(rows[0]))


def score(df: DataFrame, v: str, query: list[float], slices: list[tuple[int, int]] | None = None) -> DataFrame:
    """Add cosine to `query` for the whole vector (`score`) or for each (start, stop) slice (`score_0`, ...).

    Arrow batches are viewed as one matrix, so a batch costs one product and no per-row Python. A vector
    that is null or of another length than the query gets a null score.
    """
    q = np.asarray(query, dtype=np.float64)
    parts = slices or [(0, len(q))]
    names = [f"score_{i}" for i in range(len(parts))] if slices else ["score"]
    keep = [c for c in df.columns if c != v]
    schema = T.StructType([df.schema[c] for c in keep] + [T.StructField(n, T.DoubleType()) for n in names])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fits = pc.fill_null(pc.equal(pc.list_value_length(b.column(v)), len(q)), False)
            at = np.flatnonzero(fits.to_numpy(zero_copy_only=False))
            m = b.column(v).filter(fits).flatten().to_numpy(zero_copy_only=False).reshape(-1, len(q)).astype(np.float64)
            cols = []
            for lo, hi in parts:
                a, y = m[:, lo:hi], q[lo:hi]
                len_a, len_y = np.sqrt((a * a).sum(1)), np.sqrt((y * y).sum())
                den = len_a * len_y
                score = np.zeros(b.num_rows)
                score[at] = np.divide(a @ y, den, out=np.zeros(len(a)), where=den > 0)
                cols.append(pa.array(score, mask=~fits.to_numpy(zero_copy_only=False)))
            yield pa.RecordBatch.from_arrays([b.column(c) for c in keep] + cols, names=keep + names)

    return df.mapInArrow(run, schema)
