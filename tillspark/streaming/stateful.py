"""Stateful stream operators: status transitions and the failure limiter.

Both keep a bounded state for each key: the last status, or at most ``limit`` times. Rows of
one key inside a micro-batch are put in order first; the source bounds a batch in bytes.
"""

from __future__ import annotations

from collections import deque
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import LongType, StringType, StructField, StructType

from tillspark.operators.limiter import DECISION, decide
from tillspark.streaming.sources import rocksdb_state, run_available

TRANSITION = ("collection_name string, document_id string, server_sequence long, status string, "
              "previousStatus string")
_LAST = StructType([StructField("sequence", LongType()), StructField("status", StringType())])
_TIMES = StructType([StructField("at", LongType())])


def _ordered(batches: Iterator[pd.DataFrame], order: str) -> pd.DataFrame:
    return pd.concat(list(batches), ignore_index=True).sort_values(order)


class StatusTransitions(StatefulProcessor):
    """Emits versions that go from queued or processing to needs_review."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self._last = handle.getValueState("last", _LAST)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        batch = _ordered(rows, "server_sequence")
        sequence, status = self._last.get() if self._last.exists() else (-1, None)
        # A version older than the state was seen before or lost the race; it changes nothing.
        batch = batch[batch["server_sequence"] > sequence]
        if batch.empty:
            return
        before = batch["status"].shift(1)
        before.iloc[0] = status
        hit = (batch["status"] == "needs_review") & before.isin(["queued", "processing"])
        self._last.update((int(batch["server_sequence"].iloc[-1]), batch["status"].iloc[-1]))
        found = batch[hit].assign(previousStatus=before[hit])
        if not found.empty:
            yield found[["collection_name", "document_id", "server_sequence", "status",
                         "previousStatus"]]

    def close(self) -> None:
        pass


class FailureLimiter(StatefulProcessor):
    """Decides each attempt of a key from the failure times that still count."""

    def __init__(self, limit: int, seconds: int):
        self._limit, self._window = limit, seconds * 1_000_000

    def init(self, handle: StatefulProcessorHandle) -> None:
        self._times = handle.getListState("times", _TIMES)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        batch = _ordered(rows, "ord")
        recent = deque(row[0] for row in self._times.get()) if self._times.exists() else deque()
        decisions = [decide(recent, int(at), bool(failed), self._window, self._limit)
                     for at, failed in zip(batch["at_micros"], batch["failed"])]
        if recent:
            self._times.put([(at,) for at in recent])
        else:
            self._times.clear()
        yield pd.DataFrame({
            "key": batch["key"].to_numpy(), "ord": batch["ord"].to_numpy(),
            "decision": [d for d, _ in decisions],
            "wait_seconds": pd.array([w for _, w in decisions], dtype="Int64")})

    def close(self) -> None:
        pass


def _run(df: DataFrame, keys: list[str], processor: StatefulProcessor, schema: str, output: str,
         checkpoint: str) -> None:
    decided = df.groupBy(*keys).transformWithStateInPandas(
        statefulProcessor=processor, outputStructType=schema, outputMode="Append",
        timeMode="None")
    with rocksdb_state(df.sparkSession):
        run_available(decided.writeStream.outputMode("append").format("parquet")
                      .option("path", output), checkpoint)


def follow_transitions(versions: DataFrame, output: str, checkpoint: str) -> None:
    _run(versions, ["collection_name", "document_id"], StatusTransitions(), TRANSITION, output,
         checkpoint)


def follow_failures(attempts: DataFrame, output: str, checkpoint: str, limit: int,
                    seconds: int) -> None:
    _run(attempts, ["key"], FailureLimiter(limit, seconds), DECISION, output, checkpoint)


