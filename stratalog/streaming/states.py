"""States of commits kept over a stream of what workers report.

A worker begins an attempt at a commit, reports each class, and ends the
attempt. The state of a commit holds the attempt and its classes; a report that
comes twice counts once, and one of an older attempt not at all. An attempt that
isn't ended within a time, as its worker or its batch was lost, is closed by a
timer, and the commit is open again under the next attempt.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

from ..fixed import FAILURE_TYPES
from ..operators.listing import UNKNOWN_FAILURE
from ..operators.upsert import Store, latest
from ..schemas import KEYS

#: What is reported: kind is begin, class (failure_type null or empty if produced) or end;
#: a failure of the whole commit is a class without a name.
REPORTS = "source_name string, commit_hash string, attempt int, kind string, class_name string, failure_type string, at timestamp"
STATES = "source_name string, commit_hash string, status string, attempt int, processed_classes_count bigint, saved_models_count bigint, failure_count bigint, failure_types string, last_updated_utc timestamp"


class CommitStates(StatefulProcessor):
    """Attempts of one commit: ``patience`` seconds of event time after its last report, one that hasn't ended is given up."""

    def __init__(self, patience: float):
        self.patience = int(patience * 1000)

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.attempt = handle.getValueState("attempt", "attempt int, open boolean, until bigint")
        self.classes = handle.getMapState("classes", "class_name string", "failure_type string")

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:
        reports = pd.concat(rows).sort_values(["attempt", "at"], kind="stable")
        # Within an attempt its beginning goes first and its end last, whatever the order in which files came.
        place = reports["kind"].map({"begin": 0, "class": 1, "end": 2})
        for r in reports.assign(place=place).sort_values(["attempt", "place"], kind="stable").itertuples():
            now, is_open, until = self.attempt.get() if self.attempt.exists() else (0, False, 0)
            if r.attempt < now or (r.attempt == now and not is_open):
                continue
            if r.attempt > now:
                self._clear_classes()
            until = self._wait(until if is_open else 0, int(r.at.timestamp() * 1000) + self.patience)
            self.attempt.update((int(r.attempt), r.kind != "end", until))
            if r.kind == "class":
                self.classes.updateValue((r.class_name or "",), (r.failure_type or "",))
            elif r.kind == "end":
                self.handle.deleteTimer(until)
                yield self._told(key, "complete", r.attempt, r.at)

    def handleExpiredTimer(self, key: Any, timerValues: Any, expiredTimerInfo: Any) -> Iterator[pd.DataFrame]:
        attempt, is_open, until = self.attempt.get()
        if is_open and expiredTimerInfo.getExpiryTimeInMs() >= until:
            self.attempt.update((attempt, False, until))
            yield self._told(key, "reopened", attempt, pd.Timestamp(until, unit="ms"))

    def close(self) -> None:
        return None

    def _wait(self, before: int, until: int) -> int:
        if until <= before:
            return before
        if before:
            self.handle.deleteTimer(before)
        self.handle.registerTimer(until)
        return until

    def _clear_classes(self) -> None:
        if self.classes.exists():
            self.classes.clear()

    def _told(self, key: Any, status: str, attempt: int, at: pd.Timestamp) -> pd.DataFrame:
        held = [(name[0], kind[0]) for name, kind in self.classes.iterator()] if self.classes.exists() else []
        failed = [kind if kind in FAILURE_TYPES else UNKNOWN_FAILURE for _, kind in held if kind]
        row = {"source_name": key[0], "commit_hash": key[1], "status": status, "attempt": int(attempt), "processed_classes_count": sum(name != "" for name, _ in held), "saved_models_count": sum(not kind for _, kind in held), "failure_count": len(failed), "failure_types": ",".join(sorted(set(failed))), "last_updated_utc": at}
        return pd.DataFrame([row])


def commit_states(reports: DataFrame, patience: float, late: str) -> DataFrame:
    """States that commits come to (``STATES``): complete ones with their counts, and
    reopened ones whose attempt was given up.

    Reports more than ``late`` behind the newest are dropped. The session needs
    the RocksDB state store (``spark.sql.streaming.stateStore.providerClass``).
    """
    keyed = reports.withWatermark("at", late).groupBy("source_name", "commit_hash")
    return keyed.transformWithStateInPandas(CommitStates(patience), STATES, "Append", "EventTime")


def write_states(batch: DataFrame, store: Store) -> None:
    """Put states into the progress table; reopened commits are processing again, so that a run takes them up."""
    newest = latest(batch, KEYS["outcome_progress"], "attempt", "last_updated_utc")
    store.upsert("outcome_progress", newest.withColumn("status", F.when(F.col("status") == "complete", "complete").otherwise("processing")), KEYS["outcome_progress"])


def store_states(states: DataFrame, store: Store, checkpoint: str) -> StreamingQuery:
    """Write states as they come; a batch that comes again changes nothing."""
    writer = states.writeStream.foreachBatch(lambda batch, _: write_states(batch, store))
    return writer.option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
