"""Operators over streams that keep a small state per key in the engine's state store.

The state lives in RocksDB on the executors and is written to the stream's checkpoint, so a micro-batch
reads the keys that arrive and nothing of what earlier batches have stored, and a restart goes on from the
last commit. Output is appended or replaced by key; no stored table is read.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def use_rocksdb(spark: SparkSession) -> None:
    """State beyond the heap of the executors for the streams started from now on."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)


def first_per_key(stream: DataFrame, key: str, order: str) -> DataFrame:
    """The first row of every key: of the batch in which the key first arrives, that with the smallest `order`."""
    columns = stream.columns

    def first(_: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.exists:
            return
        best = None
        for part in parts:
            row = part.loc[[part[order].idxmin()]]
            if best is None or row[order].iloc[0] < best[order].iloc[0]:
                best = row
        if best is not None:
            state.update((True,))
            yield best[columns]

    return stream.groupBy(key).applyInPandasWithState(first, stream.schema, "seen boolean", "append", GroupStateTimeout.NoTimeout)


_HISTORY = "execution_count long, peak double, first_at long, first double, last_at long, last double"


def run_history(stream: DataFrame, key: str, at: str, value: str, order: str | None = None) -> DataFrame:
    """Runs, peak, first and last value of every key so far, given out for the keys of each batch.

    Runs are ordered by `at` (whole microseconds), not by arrival; of runs at one time the earlier arrival counts, of
    those that arrive in one batch that with the smallest `order` (whole numbers), if given.
    """
    kind = dict(stream.dtypes)[key]
    schema = f"{key} {kind}, execution_count long, peak_conveyance double, initial_conveyance double, current_conveyance double"

    def fold(k: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        n, peak, first_at, first, last_at, last = state.get if state.exists else (0, None, None, None, None, None)
        before_first, before_last = first_at, last_at
        first_order = last_order = 0
        for part in parts:
            part = part.sort_values([at, order] if order else at, kind="stable")
            lo, hi = part.iloc[0], part[part[at] == part[at].iloc[-1]].iloc[0]
            o_lo, o_hi = (int(lo[order]), int(hi[order])) if order else (0, 0)
            n += len(part)
            top = part[value].max()
            peak = top if peak is None or top > peak else peak
            if first_at is None or lo[at] < first_at or (lo[at] == first_at != before_first and o_lo < first_order):
                first_at, first_order, first = int(lo[at]), o_lo, float(lo[value])
            if last_at is None or hi[at] > last_at or (hi[at] == last_at != before_last and o_hi < last_order):
                last_at, last_order, last = int(hi[at]), o_hi, float(hi[value])
        state.update((int(n), float(peak), first_at, first, last_at, last))
        yield pd.DataFrame([(k[0], int(n), float(peak), first, last)], columns=[key, "execution_count", "peak_conveyance", "initial_conveyance", "current_conveyance"])

    return stream.groupBy(key).applyInPandasWithState(fold, schema, _HISTORY, "update", GroupStateTimeout.NoTimeout)
