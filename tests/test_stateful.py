import numpy as np
import pandas as pd
import pytest

from stemma.plans import stream_plans, vector_plans
from stemma.streaming import ingest, stateful


@pytest.fixture
def arrivals(spark, tmp_path):
    folder = str(tmp_path / "in")

    def arrive(rows):
        spark.createDataFrame(rows, "k string, o long, v double").coalesce(1).write.mode("append").parquet(folder)
        return ingest.file_stream(spark, folder, 1)

    return arrive


def test_first_per_key_keeps_what_came_first(spark, arrivals, tmp_path):
    stateful.use_rocksdb(spark)
    base = str(tmp_path / "out")

    def run(stream):
        out = stateful.first_per_key(stream, "k", "o")
        out.writeStream.format("parquet").option("path", base).option("checkpointLocation", f"{base}-ck").trigger(availableNow=True).start().awaitTermination()
        return sorted((r.k, r.o, r.v) for r in spark.read.schema("k string, o long, v double").parquet(base).collect())

    assert run(arrivals([("a", 5, 1.0), ("a", 3, 2.0), ("b", 9, 3.0)])) == [("a", 3, 2.0), ("b", 9, 3.0)]
    assert run(arrivals([("a", 1, 4.0), ("c", 2, 5.0), ("c", 2, 5.0)])) == [("a", 3, 2.0), ("b", 9, 3.0), ("c", 2, 5.0)]
    assert run(arrivals([("b", 0, 0.0)])) == [("a", 3, 2.0), ("b", 9, 3.0), ("c", 2, 5.0)]


def test_history_is_folded_over_restarts(spark, arrivals, tmp_path):
    stateful.use_rocksdb(spark)
    got = {}

    def run(stream):
        ingest.drain(stateful.run_history(stream, "k", "o", "v"), lambda df, _: got.update({r.k: tuple(r)[1:] for r in df.collect()}), str(tmp_path / "ck"), "update")

    run(arrivals([("a", 5, 1.0), ("a", 7, 4.0)]))
    assert got == {"a": (2, 4.0, 1.0, 4.0)}
    run(arrivals([("a", 1, 2.0), ("b", 1, -1.0)]))
    assert got == {"a": (3, 4.0, 2.0, 4.0), "b": (1, -1.0, -1.0, -1.0)}
    run(arrivals([("a", 9, 9.0)]))
    assert got["a"] == (4, 9.0, 2.0, 9.0) and got["b"] == (1, -1.0, -1.0, -1.0)


def _events(spark, folder, parts):
    """Events whose arrivals are several files, the first events of a user in the last of them."""
    n = 3000
    rows = spark.range(n).selectExpr(
        "id AS event_id", "id % 40 AS user_id", "concat('t', id) AS event_type", "cast(id % 97 AS double) AS value", "timestamp_micros(1700000000000000 + (id div 400) * 1000000) AS ts"
    )
    rows.repartition(parts).write.parquet(f"{folder}/events.parquet")
    return str(folder)


def test_arrivals_of_many_files_keep_the_order_of_ids(spark, tmp_path):
    sf = _events(spark, tmp_path / "many", 7)
    got = {r.user_id: (r.event_id, r.event_type) for r in stream_plans.stream_first_seen(spark, sf).collect()}
    assert got == {u: (u, f"t{u}") for u in range(40)}


def test_history_of_arrivals_of_many_files(spark, tmp_path):
    sf = _events(spark, tmp_path / "history", 7)
    got = {r.query_id: (r.execution_count, r.initial_conveyance, r.current_conveyance) for r in stream_plans.stream_run_history(spark, sf).collect()}
    assert got == {u: (75, float(u), float(min(i for i in range(2800, 3000) if i % 40 == u) % 97)) for u in range(40)}


def test_chain_distance_matches_sets():
    rng = np.random.default_rng(0)
    chain = lambda: None if rng.random() < 0.15 else list(rng.choice(list("abcdef"), int(rng.integers(0, 5))))
    a, b = pd.Series([chain() for _ in range(40)]), pd.Series([chain() for _ in range(30)])
    got = vector_plans.chain_distance(a, b)
    for i, x in enumerate(a):
        for j, y in enumerate(b):
            want = 0.5 if x is None or y is None else 1.0 if not x or not y else 1 - len({*x} & {*y}) / len({*x} | {*y})
            assert got[i, j] == pytest.approx(want)
