"""Streaming forms of the event-log operators. The reference has no streams; these are additions for live logs."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

GUARD = "user_id bigint, n_failed bigint, in_a_row bigint, longest bigint"


def windowed(events: DataFrame, width: str, late: str) -> DataFrame:
    """Counts and mean values by event type and window of event time; rows later than ``late`` are dropped.
    Times without a zone are taken in the session's."""
    return (
        events.withColumn("ts", F.col("ts").cast("timestamp"))
        .withWatermark("ts", late)
        .groupBy(F.window("ts", width), "event_type")
        .agg(F.count("*").alias("n"), F.avg("value").alias("mean_value"))
        .select(F.col("window.start").alias("start"), "event_type", "n", "mean_value")
    )


def failure_guard(events: DataFrame, failed: str = "error") -> DataFrame:
    """(user_id, n_failed, in_a_row, longest) after each batch, kept as state for each user; rows of a batch
    are taken in the order of event_id."""

    def step(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        total, run, longest = state.get if state.exists else (0, 0, 0)
        bad = (pd.concat(frames).sort_values("event_id")["event_type"] == failed).to_numpy()
        after = np.arange(1, len(bad) + 1)
        # Failures in a row at each event: events since the last good one, or since before this batch.
        rows = np.where(bad, after - np.maximum.accumulate(np.where(bad, -run, after)), 0)
        total, run, longest = total + int(bad.sum()), int(rows[-1]), max(longest, int(rows.max()))
        state.update((total, run, longest))
        yield pd.DataFrame({"user_id": [key[0]], "n_failed": [total], "in_a_row": [run], "longest": [longest]})

    return events.groupBy("user_id").applyInPandasWithState(step, GUARD, "n_failed bigint, in_a_row bigint, longest bigint", "update", GroupStateTimeout.NoTimeout)


class AbortGuard(StatefulProcessor):
    """Counts failures of each key, in all and in a row, and tells once when a limit is passed."""

    def __init__(self, failed: str, most_in_a_row: int, most: int) -> None:
        self.failed, self.most_in_a_row, self.most = failed, most_in_a_row, most

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.counts = handle.getValueState("counts", "n_failed bigint, in_a_row bigint, aborted boolean")

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        total, run, aborted = self.counts.get() if self.counts.exists() else (0, 0, False)
        events = pd.concat(rows).sort_values("event_id")
        for event, kind in zip(events["event_id"].tolist(), events["event_type"].tolist(), strict=True):
            if kind != self.failed:
                run = 0
                continue
            if aborted:  # nothing counts after an abort
                continue
            total, run = total + 1, run + 1
            reason = f"{run} failures in a row" if run >= self.most_in_a_row else f"{total} failures" if total > self.most else None
            if reason:
                aborted = True
                yield pd.DataFrame({"user_id": [key[0]], "event_id": [event], "n_failed": [total], "in_a_row": [run], "reason": [reason]})
        self.counts.update((total, run, aborted))

    def close(self) -> None:
        pass


def aborts(events: DataFrame, failed: str = "error", most_in_a_row: int = 3, most: int = 50) -> DataFrame:
    """(user_id, event_id, n_failed, in_a_row, reason): a row for each user whose failures reach ``most_in_a_row`` in a row or
    exceed ``most`` in all, at the event that does so, and none after it. Rows of a batch are taken in the order of event_id. The state store has
    to be one with state variables (RocksDB)."""
    guard = AbortGuard(failed, most_in_a_row, most)
    return events.groupBy("user_id").transformWithStateInPandas(
        statefulProcessor=guard, outputStructType="user_id bigint, event_id bigint, n_failed bigint, in_a_row bigint, reason string", outputMode="append", timeMode="none"
    )
