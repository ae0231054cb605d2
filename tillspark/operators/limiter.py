"""Sliding-window failure limiter.

Failures of a key count for ``window`` seconds. With ``limit`` of them in the window an
attempt is blocked and not recorded; an attempt that succeeds clears the key. Decisions feed
back into the window, so a plain range count is only an upper bound of the recorded failures.

That bound is still enough to find points where the state is certain: no failure at all in
the window before an attempt, or a success that cannot have been blocked before it. Between
such points the attempts of a key are independent segments, so a busy key is spread over
many tasks. A task streams its segments in order and keeps at most ``limit`` times.
"""

from __future__ import annotations

from collections import deque
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window, functions as F

from tillspark.operators.ordered import CHUNK_WIDTH, with_last_marked, with_previous
from tillspark.session import cut_lineage

LIMIT, WINDOW_SECONDS = 10, 300
CELLS = 64
DECISION = "key string, ord long, decision string, wait_seconds long"


def decide(recent: deque, at: int, failed: bool, window: int, limit: int) -> tuple[str, int | None]:
    """Decision on one attempt; changes the recorded failure times in place."""
    while recent and recent[0] <= at - window:
        recent.popleft()
    if len(recent) >= limit:
        left = window - (at - recent[0])
        return "blocked", max(1, -(-left // 1_000_000))
    if failed:
        recent.append(at)
        return "failed", None
    recent.clear()
    return "allowed", None


def _bounded_failures(attempts: DataFrame, window: int) -> DataFrame:
    """Adds ``bound``: at least the failed attempts of the key in the window, this included.

    Failures are counted by (key, time cell) first, so a busy key is one row for each cell
    and not for each attempt; the window then runs over cells. It covers whole cells, which
    can only raise the bound. The counts go back by (key, cell), which spreads a busy key.
    """
    cell = F.floor(F.col("at_micros") / F.lit(max(1, window // CELLS))).cast("long")
    celled = attempts.withColumn("cell", cell)
    span = Window.partitionBy("key").orderBy("cell").rangeBetween(-(CELLS + 1), 0)
    bounds = celled.groupBy("key", "cell").agg(
        F.count(F.when(F.col("failed"), 1)).alias("failures"))
    bounds = bounds.withColumn("bound", F.sum("failures").over(span)).drop("failures")
    return celled.join(bounds, ["key", "cell"]).drop("cell")


def limit_failures(attempts: DataFrame, limit: int = LIMIT, seconds: int = WINDOW_SECONDS,
                   width: int = CHUNK_WIDTH) -> DataFrame:
    """Decides every attempt. ``attempts``: key, ord (unique, in time order), at_micros, failed."""
    window = seconds * 1_000_000
    # Each step uses its input twice; written tables keep them from computing it again and again.
    bounded = cut_lineage(_bounded_failures(attempts, window), "limiter-bounds")
    clears = ~F.col("failed") & (F.col("bound") < limit)
    after = cut_lineage(with_previous(bounded, ["key"], "ord", clears, "cleared", width),
                        "limiter-cleared")
    quiet = (F.col("bound") - F.col("failed").cast("long")) == 0
    starts = quiet | F.coalesce("cleared", F.lit(False))
    segments = with_last_marked(after, ["key"], "ord", starts, "segment", width)
    ordered = (segments.select("key", F.coalesce("segment", F.lit(-1)).alias("segment"), "ord",
                               "at_micros", "failed")
               .repartition("key", "segment")
               .sortWithinPartitions("key", "segment", "ord"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        current, recent = None, deque()
        for batch in batches:
            decisions = []
            for key, segment, at, failed in zip(batch["key"], batch["segment"],
                                                batch["at_micros"], batch["failed"]):
                if (key, segment) != current:
                    current, recent = (key, segment), deque()
                decisions.append(decide(recent, at, failed, window, limit))
            yield pd.DataFrame({
                "key": batch["key"], "ord": batch["ord"],
                "decision": [d for d, _ in decisions],
                "wait_seconds": pd.array([w for _, w in decisions], dtype="Int64")})

    return ordered.mapInPandas(run, DECISION)
