"""Stateful stream operators with processing-time timers, on Spark's own state store.

Timers live in the state store beside the values, survive restarts with the checkpoint, and fire
once; one timer stands for each key, and a new registration takes its place.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from driftlog.functions.workers import reachable

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class QuietCounter(StatefulProcessor):
    """Counts a key's rows and emits the count when none has come for quiet_ms."""

    def __init__(self, key: str, quiet_ms: int):
        self.key, self.quiet_ms = key, quiet_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.count = handle.getValueState("count", "n long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        seen = self.count.get()[0] if self.count.exists() else 0
        self.count.update((seen + sum(len(r) for r in rows),))
        for at in list(self.handle.listTimers()):
            self.handle.deleteTimer(at)
        self.handle.registerTimer(timerValues.getCurrentProcessingTimeInMs() + self.quiet_ms)
        yield self._out([], [])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        n = self.count.get()[0]
        self.count.clear()
        yield self._out([key[0]], [n])

    def _out(self, keys: list, counts: list[int]) -> pd.DataFrame:
        # plain objects: text columns of other kinds come in chunks, which the state server refuses
        return pd.DataFrame({self.key: pd.Series(keys, dtype=object), "n": pd.Series(counts, dtype="int64")})

    def close(self) -> None: ...


def quiet_counts(changes: DataFrame, key: str = "pk", quiet_ms: int = 1000) -> DataFrame:
    """(key, n) of a stream of changes, emitted when a key has been quiet. Needs the RocksDB store."""
    reachable(changes.sparkSession)
    kind = changes.schema[key].dataType.simpleString()
    return changes.groupBy(key).transformWithStateInPandas(
        QuietCounter(key, quiet_ms), outputStructType=f"{key} {kind}, n long", outputMode="Append", timeMode="ProcessingTime"
    )
